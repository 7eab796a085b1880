"""Code search by n-gram Jaccard: every window of the corpus as long as the snippet, against the snippet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions.text import clip, gram_set, jaccard_percent, squeeze, strip


def cleaned(lines: Column) -> Column:
    """Each line squeezed and lower-cased, comments blank."""
    return F.transform(F.transform(lines, squeeze), lambda x: F.when(x.rlike(r"^(?://|[#*])"), "").otherwise(F.lower(x)))


def code_of(clean: Column) -> Column:
    return F.array_join(F.filter(clean, lambda x: x != ""), " ")


def once(value: Column) -> Column:
    """As a generated column, so that no filter on it makes the optimizer compute it again."""
    return F.explode(F.array(value))


def similar(corpus: DataFrame, snippet: str, min_similarity: int = 60, top: int | None = 20, max_files: int | None = None) -> DataFrame:
    """(file, start_line, end_line, similarity, preview) of the best disjoint windows of each file.

    ``max_files`` takes the first files by name; by default all are searched. The size ratio of two sets bounds their
    Jaccard, which spares most windows the intersection.
    """
    if max_files is not None:
        corpus = corpus.orderBy("file").limit(max_files)
    size = max(3, len(snippet.split("\n")))
    one = corpus.sparkSession.range(1).select(gram_set(code_of(cleaned(F.split(F.lit(snippet), "\n"))))).first()  # the snippet's grams, once
    want = F.array(*[F.lit(g) for g in one[0]]).cast("array<string>")
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = corpus.where("text is not null").repartition(parts, "file").select("file", F.split("text", "\n").alias("lines")).where(F.size("lines") >= size)
    rows = rows.select("file", "lines", once(cleaned(F.col("lines"))).alias("clean"))
    rows = rows.select("file", "lines", "clean", F.explode(F.sequence(F.lit(1), F.size("lines") - (size - 1))).alias("start"))
    rows = rows.select("file", F.col("start").cast("long").alias("start_line"), F.element_at("lines", F.col("start")).alias("first"), once(gram_set(code_of(F.slice("clean", F.col("start"), size)))).alias("grams"))
    least, n = len(one[0]), F.size("grams")
    rows = rows.where((F.least(n, F.lit(least)) * 100.0 >= F.greatest(n, F.lit(least)) * F.lit(float(min_similarity))) & (n > 0))
    rows = rows.select("file", "start_line", "first", once(jaccard_percent(F.col("grams"), want)).alias("score")).where(F.col("score") >= min_similarity)
    rows = rows.select("file", "start_line", (F.col("start_line") + (size - 1)).alias("end_line"), F.round("score").cast("int").alias("similarity"), clip(strip(F.col("first")), 80, 77).alias("preview"), "score")
    best = F.struct((-F.col("score")).alias("order"), "start_line", "end_line", "similarity", "preview")
    lists = rows.groupBy("file").agg(F.sort_array(F.collect_list(best)).alias("found"))
    none = F.filter("found", lambda s: F.lit(False))
    apart = F.aggregate("found", none, lambda acc, s: F.when(F.exists(acc, lambda k: ~((s["end_line"] < k["start_line"]) | (s["start_line"] > k["end_line"]))), acc).otherwise(F.concat(acc, F.array(s))))
    out = lists.select("file", F.explode(apart).alias("s")).select("file", "s.start_line", "s.end_line", "s.similarity", "s.preview")
    out = out.orderBy(F.desc("similarity"), "file", "start_line")
    return out if top is None else out.limit(top)
