"""The corpus pipeline: five stages from raw documents to a training order.

Each stage takes all its predecessor kept and its decisions take effect; all but the last return the columns of
``documents``. :func:`run` chains them, each written as Parquet to the shared folder and read again, so that a lost
executor never costs more than a stage.

Null ids, null and empty texts, ties, repeated rows and empty tables have the results that the operators' modules define;
columns beyond those of ``documents`` pass through every stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm.classifier import good_documents
from siltbed.llm.curriculum import curriculum
from siltbed.llm.decontaminate import clean_documents
from siltbed.llm.ngram_join import without_near_copies
from siltbed.llm.scratch import Scratch
from siltbed.llm.suffix_array import without_repeats
from siltbed.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go."""
    return good_documents(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies the document of least id stays."""
    ship(spark)
    return without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each passage of 50 words or more that repeats, all copies but the first are cut out."""
    ship(spark)
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark passage go; an item of under 5 words tells no leak by itself."""
    return clean_documents(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in training order, with n_tokens, epoch and position."""
    return curriculum(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier is trained and the suffix array iterates, so SQL has no equal; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(ship(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.write(out, name) if k + 1 < len(STAGES) else out
        if k > 1:
            scratch.drop(STAGES[k - 2][0])
    return docs
