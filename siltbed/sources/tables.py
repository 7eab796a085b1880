"""Index tables and event logs: read or empty, overwrite, append what is new. Spark's commit protocol makes writes atomic."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one if nothing is there."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_index(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replaces an index (functions, duplicates, routes, hardware, dependencies) as a whole."""
    df.write.mode("overwrite").format(format).save(path)


def create_if_absent(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.mode("ignore").format(format).save(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends session, lock, feature or context events; state is the fold over all of them."""
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Appends the rows whose key the table hasn't yet, one for each key, and returns the table."""
    spark = df.sparkSession
    known = read_or_empty(spark, path, df.schema)
    new = df.dropDuplicates([key]).join(known.select(key), key, "left_anti").select(*df.columns)
    new.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def manifest_field(df: DataFrame, path: str, text: str = "text"):
    """A field of JSON texts such as manifests, by path: ``$.scripts['build']``; null where there is none."""
    return df.select("*", F.get_json_object(text, path).alias("value"))
