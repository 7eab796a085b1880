"""A knowledge table: extraction from notes and code, tags, search, statistics, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.functions.text import clip, extension, strip
from siltbed.operators.similarity import once
from siltbed.sources.corpus import sections


def tags(text: Column, most: int = 5) -> Column:
    """The first ``most`` known tags that the text holds; it is lower-cased once."""
    known = F.array(*[F.lit(t) for t in P.TAGS])
    return F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.slice(F.filter(known, lambda t: F.contains(low, t)), 1, most)), 1)


def entry_id(kind: Column, title: Column, content: Column, feature: Column) -> Column:
    """By content, so that the same entry has the same id and appends can skip it."""
    return F.sha2(F.concat_ws("\x1f", kind, title, content, feature), 256)


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(entry_id(F.col("type"), F.col("title"), F.col("content"), F.col("feature")).alias("id"), "type", "title", "content", "tags", F.struct("feature", "files", "date").alias("source"))


def decisions(notes: DataFrame) -> DataFrame:
    """Entries from (file, text, feature, files): each ``## date`` section with a body of over 10 characters."""
    own = notes.select("file", "text", "feature", "files")
    parts = sections(own.select(F.struct("feature", "files").alias("file"), "text"))
    # generated columns, so that filters and later fields don't compute them again
    text = parts.select(F.col("file.feature").alias("feature"), F.col("file.files").alias("files"), once(strip(F.col("section"))).alias("text"))
    end = F.locate("\n", F.col("text"))
    first = F.when(end > 0, F.substring("text", F.lit(1), end - 1)).otherwise(F.col("text"))
    body = F.when(end > 0, F.substring("text", end, F.length("text"))).otherwise("")
    rows = text.select("feature", "files", strip(first).alias("date"), once(strip(body)).alias("content")).where(F.length("content") > 10)
    return _entries(rows.select(F.lit("decision").alias("type"), F.concat(F.lit("Decision: "), clip(F.col("content"), 50)).alias("title"), "content", tags(F.col("content")).alias("tags"), "feature", "files", "date"))


def markers(lines: DataFrame, feature: str, as_of: str) -> DataFrame:
    """Entries from comments that begin with a marker (pattern, bug, fix)."""
    any_ = "|".join(f"(?:{r})" for _, r in P.MARKERS)
    hits = F.array(*[F.when(F.col("line").rlike(r), F.struct(F.lit(k).alias("type"), strip(F.regexp_replace("line", r, "")).alias("content"))) for k, r in P.MARKERS])
    rows = lines.where(F.col("line").rlike(any_)).select("file", "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    place = F.concat_ws(":", "file", F.col("line_no").cast("string"))
    return _entries(rows.select("h.type", clip(F.col("h.content"), 60).alias("title"), "h.content", F.array("h.type", extension(F.col("file"))).alias("tags"), F.lit(feature).alias("feature"), F.array(place).alias("files"), F.lit(as_of).alias("date")))


def extract_feature(notes: DataFrame, items: DataFrame, lines: DataFrame, feature: str, as_of: str) -> DataFrame:
    """All entries of a feature: decisions, code markers, and ``items`` (kind blocker or note, text, feature)."""
    kind = F.when(F.col("kind") == "blocker", "bug").otherwise("pattern")
    own = items.select(kind.alias("type"), clip(F.col("text"), 60).alias("title"), F.col("text").alias("content"), tags(F.col("text")).alias("tags"), "feature", F.array().cast("array<string>").alias("files"), F.lit(as_of).alias("date"))
    return decisions(notes).unionByName(_entries(own)).unionByName(markers(lines, feature, as_of))


def append(base: DataFrame, new: DataFrame) -> DataFrame:
    """What of ``new`` the table hasn't yet, by id."""
    return new.dropDuplicates(["id"]).join(base.select("id"), "id", "left_anti")


def search(base: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    q = F.lit(query.lower())
    hit = F.contains(F.lower("title"), q) | F.contains(F.lower("content"), q) | F.exists("tags", lambda t: F.contains(F.lower(t), q))
    return base.where(hit if kind is None else hit & (F.col("type") == kind))


def stats(base: DataFrame) -> DataFrame:
    """(type, n), and a row of type null for the total."""
    return base.rollup("type").agg(F.count("*").alias("n"))


def related(features: DataFrame, base: DataFrame, top: int = 3) -> DataFrame:
    """For each feature (name), up to ``top`` entries whose title or content holds its name, ties by id."""
    name = F.lower(F.col("name"))
    hit = features.join(base, F.contains(F.lower("title"), name) | F.contains(F.lower("content"), name))
    w = Window.partitionBy("name").orderBy("id")
    return hit.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= top).select("name", "nth", "id", "type", "title")
