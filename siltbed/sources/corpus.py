"""Where corpora come from: folders of files, or any table with an id and a text; and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.functions.text import basename, extension


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(file, text) of all files below ``root``, by paths relative to it; files that vanish or break are skipped."""
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    base = root.rstrip("/") + "/"
    return reader.text(root, wholetext=True).select(F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path).alias("file"), F.make_valid_utf8("value").alias("text"))


def from_table(df: DataFrame, key: str, text: str = "text", suffix: str = "") -> DataFrame:
    return df.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("file"), F.col(text).alias("text"))


def scannable(corpus: DataFrame) -> DataFrame:
    """Without the extensions, folders and names that secrets are not looked for in."""
    folders = "(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in P.IGNORED_DIRS) + ")/"
    ext = F.concat(F.lit("."), extension(F.col("file")))
    return corpus.where(~ext.isin(*P.IGNORED_EXTENSIONS) & ~basename(F.col("file")).isin(*P.IGNORED_NAMES) & ~F.col("file").rlike(folders))


def language(file: Column, names: dict[str, str] = P.LANGUAGES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, extension(file))


def of_language(corpus: DataFrame, names: dict[str, str] = P.LANGUAGES) -> DataFrame:
    return corpus.withColumn("language", language(F.col("file"), names)).where("language is not null")


def in_folders(corpus: DataFrame, excluded: tuple[str, ...] = ("node_modules", "dist", "build", ".git")) -> DataFrame:
    return corpus.where(~F.col("file").rlike("(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in excluded) + ")/"))


def without_tests(corpus: DataFrame) -> DataFrame:
    """Without test and spec files, by name."""
    return corpus.where(~basename(F.col("file")).rlike(r"\.(?:test|spec)\."))


def embedded(corpus: DataFrame) -> DataFrame:
    """Sources that may use hardware; vendors' drivers and middleware are left out."""
    return in_folders(corpus, ("node_modules", "build", ".git", "Drivers", "Middlewares", "CMSIS")).where(extension(F.col("file")).isin("c", "h", "cpp", "hpp", "ino", "py"))


def comparable(corpus: DataFrame) -> DataFrame:
    """Sources whose blocks are compared."""
    return in_folders(corpus).where(extension(F.col("file")).isin("ts", "tsx", "js", "jsx", "py", "cs", "go", "rs", "c", "cpp", "h"))


def lines(corpus: DataFrame) -> DataFrame:
    """(file, line_no from 1, line, and other columns) of lines that aren't empty; a null text has none."""
    rest = [c for c in corpus.columns if c not in ("file", "text")]
    return corpus.select("file", *rest, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("file", *rest, (F.col("pos") + 1).cast("long").alias("line_no"), "line").where("line <> ''")


def sections(corpus: DataFrame) -> DataFrame:
    """(file, section) of what follows each ``## `` at the begin of a line."""
    parts = F.split("text", "(?m)^## ")
    return corpus.select("file", F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("section"))
