"""Quality rules whose cutoffs carry a guarantee.

Five signals, each bad when high, are computed once for each document by built-in expressions: shares of symbols, of
upper-case letters, of words that repeat the one before, of lines said before, and the mean length of words. In each
stratum (language) the documents labelled good are halved by a hash of their id. One half proposes nested policies: level
j rejects what lies above a quantile of any signal, or above a multiple of the most seen. The other half is a holdout that tests them from the most
lenient on: a level is certified if seeing so few rejected good documents has a binomial tail probability, exact, of at
most ``delta`` / number of strata, were the true share of good documents rejected ``alpha``. Testing stops at the first
failure (fixed-sequence testing needs no further correction within a stratum; Bonferroni corrects over strata), so with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents. Where no level is certified,
nothing is rejected.

The signals go to a table in the shared folder, so the text is read once; all that is shuffled is labels and signals,
and ranks of labelled documents are taken in slices, so that a stratum can have any size.
Defined results: null or empty text has signals 0; a null language is a stratum of its own; null labels are ignored, and
of a document labelled twice the lower label holds; repeated rows count once for calibration and are each judged; a null
id can't be labelled, but is judged. Other columns of either table are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltbed.llm.scratch import Scratch

SIGNALS = ("symbol_share", "upper_share", "repeat_share", "known_line_share", "word_length")
SLICES = 64
#: (factor, f): a level's cutoff for a signal is the factor times what f of 10,000 good documents exceed (0: the most seen).
LEVELS = ((4.0, 0), (2.0, 0), (1.5, 0), (1.2, 0), (1.0, 0), (1.0, 10), (1.0, 25), (1.0, 50), (1.0, 100))


def signals(text: Column) -> dict[str, Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    many = F.greatest(F.size(words), F.lit(1))
    return {
        "symbol_share": F.length(F.regexp_replace(text, r"[\p{L}\p{N} \t\n\r.,]+", "")) / n,
        "upper_share": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / n,
        "repeat_share": F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / many,
        "known_line_share": (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
        "word_length": F.length(F.regexp_replace(text, r"[ \t\n\r]+", "")) / many,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly term by term."""
    if k >= n:
        return 1.0
    j = np.arange(1, int(k) + 1, dtype=float)
    log = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - j + 1) / j)) + j * (math.log(p) - math.log1p(-p))])
    top = log.max()
    return float(min(1.0, math.exp(top) * np.exp(log - top).sum()))


@F.pandas_udf(DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(a, b, c) for a, b, c in zip(k, n, p)], dtype=float)


def holdout(doc_id: Column) -> Column:
    return F.substring(F.md5(doc_id.cast("string")), 1, 1).isin(*"01234567")


def order_statistics(long: DataFrame) -> DataFrame:
    """(stratum, signal, v, before, upto, n): each value has the ranks from before + 1 to upto among the n of its stratum.

    In two levels, so that no stratum, however large, is one task: values are counted once, cut into slices by approximate
    quantiles, and ranked within their slice.
    """
    values = long.groupBy("stratum", "signal", "v").agg(F.count("*").alias("many"))
    edges = values.groupBy("stratum", "signal").agg(F.sum("many").alias("n"), F.percentile_approx("v", [k / SLICES for k in range(1, SLICES)], 20 * SLICES).alias("edges"))
    placed = values.join(F.broadcast(edges), ["stratum", "signal"]).withColumn("slice", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")  # a row for each stratum and signal
    slices = placed.groupBy("stratum", "signal", "slice").agg(F.sum("many").alias("all"))
    start = slices.withColumn("start", F.sum("all").over(Window.partitionBy("stratum", "signal").orderBy("slice")) - F.col("all")).drop("all")
    inside = F.sum("many").over(Window.partitionBy("stratum", "signal", "slice").orderBy("v"))
    ranked = placed.withColumn("inside", inside).join(start, ["stratum", "signal", "slice"])
    return ranked.select("stratum", "signal", "v", (F.col("start") + F.col("inside") - F.col("many")).alias("before"), (F.col("start") + F.col("inside")).alias("upto"), "n")


def certified(judged: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, level, one cutoff for each signal) of each stratum's strictest certified policy."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    one = judged.groupBy("doc_id").agg(F.max("stratum").alias("stratum"), *[F.max(s).alias(s) for s in SIGNALS])
    good = one.join(good, "doc_id").withColumn("held", holdout(F.col("doc_id")))
    long = good.where("not held").select("stratum", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in SIGNALS])).alias("x")).select("stratum", "x.*")
    ranked = order_statistics(long)
    levels = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.lit(x).alias("factor"), F.lit(f).alias("cut")) for j, (x, f) in enumerate(LEVELS)]))
    cut = ranked.select("*", levels.alias("l")).where("before < n - (n * l.cut) div 10000 and n - (n * l.cut) div 10000 <= upto")
    cuts = cut.groupBy("stratum", "l.level").agg(*[F.max(F.when(F.col("signal") == s, F.col("v") * F.col("l.factor"))).alias(f"cut_{s}") for s in SIGNALS])
    bad = F.lit(False)
    for s in SIGNALS:
        bad = bad | (F.col(s) > F.col(f"cut_{s}"))
    tried = good.where("held").join(cuts, "stratum").groupBy("stratum", "level", *[f"cut_{s}" for s in SIGNALS]).agg(F.sum(bad.cast("int")).alias("k"), F.count("*").alias("n"))
    strata = tried.agg(F.count_distinct("stratum").alias("strata"))
    tested = tried.crossJoin(F.broadcast(strata)).withColumn("fails", (_tail("k", "n", F.lit(alpha)) > F.lit(delta) / F.col("strata")).cast("int"))
    upto = Window.partitionBy("stratum").orderBy("level")
    passed = tested.withColumn("fails", F.max("fails").over(upto)).where("fails = 0")
    return passed.withColumn("last", F.max("level").over(Window.partitionBy("stratum"))).where("level = last").select("stratum", "level", *[f"cut_{s}" for s in SIGNALS])


def accepted(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Documents that the certified rules keep: doc_id, stratum, level (null: nothing certified) and the signals."""
    scratch = Scratch(docs.sparkSession, "rules")
    measured = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("stratum"), *[c.alias(s) for s, c in signals(F.col("text")).items()])
    judged = scratch.write(measured, "signals")
    policy = certified(judged, labels, alpha, delta)
    bad = F.lit(False)
    for s in SIGNALS:
        bad = bad | (F.col(s) > F.col(f"cut_{s}"))
    return judged.join(F.broadcast(policy), "stratum", "left").where(~F.coalesce(bad, F.lit(False))).select("doc_id", "stratum", F.col("level").cast("int").alias("level"), *SIGNALS)


def _sql(alpha: float, delta: float) -> str:
    cuts = ", ".join(f"max(case when signal = '{s}' then v * factor end) as cut_{s}" for s in SIGNALS)
    bad = " or ".join(f"{s} > cut_{s}" for s in SIGNALS)
    values = ", ".join(f"({j}, {x}::double, {f})" for j, (x, f) in enumerate(LEVELS))
    unpivot = " union all ".join(f"select stratum, '{s}' as signal, {s} as v from good where not held" for s in SIGNALS)
    return f"""
with t as (select doc_id, coalesce(lang, '?') as stratum, coalesce(text, '') as text from documents),
p as (select doc_id, stratum, text, greatest(length(text), 1) as n,
    list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') as words, list_filter(string_split(text, chr(10)), lambda x: x <> '') as lines from t),
judged as (select doc_id, stratum,
    length(regexp_replace(text, '[\\p{{L}}\\p{{N}} \\t\\n\\r.,]+', '', 'g'))::double / n as symbol_share,
    length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g'))::double / n as upper_share,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1]))::double / greatest(len(words), 1) as repeat_share,
    (len(lines) - len(list_distinct(lines)))::double / greatest(len(lines), 1) as known_line_share,
    length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g'))::double / greatest(len(words), 1) as word_length
  from p),
g as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having min(quality) = 1),
good as (select *, substr(md5(doc_id::varchar), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') as held from judged join g using (doc_id)),
long as ({unpivot}),
ranked as (select *, row_number() over (partition by stratum, signal order by v) as rank, count(*) over (partition by stratum, signal) as n from long),
cuts as (select stratum, level, {cuts} from ranked, (values {values}) l(level, factor, cut) where rank = n - (n * cut) // 10000 group by stratum, level),
tried as (select stratum, level, {", ".join(f"cut_{s}" for s in SIGNALS)}, sum(({bad})::int) as k, count(*) as n from good join cuts using (stratum) where held group by all),
tested as (select tried.*, (case when k >= n then 1 else (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha}))) from range(0, 100000) r(j) where j <= k) end
    > {delta} / (select count(distinct stratum) from tried))::int as fail from tried),
passed as (select *, max(fail) over (partition by stratum order by level) as fails from tested),
policy as (select * from (select *, max(level) over (partition by stratum) as last from passed where fails = 0) where level = last)
select doc_id, judged.stratum, level::int as level, {", ".join(SIGNALS)} from judged left join policy on judged.stratum = policy.stratum
where not coalesce({bad}, false)
"""


SQL = _sql(0.05, 0.05)
