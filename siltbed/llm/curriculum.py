"""Mixing sources to target weights that change over training.

A schedule gives each source's weight at knots of training time in [0, 1], linear in between and level before its first
knot and after its last; sources may have different knots. The weights of all sources are normalised at each knot of any. The demand for a source up to time t is the budget times the integral of its weight, a
piecewise quadratic. Documents of a source stand in an order by a hash of their id; the position of one is the time at
which demand reaches the tokens before it, the inverse of that quadratic. Demand beyond a source's tokens starts another
epoch over it, as often as it takes to meet demand; only a given ``max_epochs`` cuts it short, and what a source then lacks
goes to no other. Documents that demand never reaches have no position and are left out. Without a schedule, weights go from the sources' own shares of tokens to shares proportional to their square roots.

The tokens before a document are a prefix sum in two levels: sums by (source, slice of the hash) are added up over
slices, then each slice is summed by itself, so that no source, however large, is one task. Positions have even density
in tokens, so the final range partitioning is arithmetic on the position: no sampling job, no skew.

Tokens are runs of other characters than white space. Defined results: a null or empty text has 0 tokens and takes the
position of its place in the order; a null source is a source of its own; ties of the hash are broken by id, then by
text; repeated rows each have a position; a null id orders as an id that hashes like the empty string; a source with no
tokens, or no weight, has no demand; an empty table gives an empty one. The columns ``n_tokens``, ``epoch`` and
``position`` replace others of these names; every other column is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DOCS = 20_000
EPOCHS = 4096  # of one row in an array


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    """A 60-bit hash of the id that other engines compute alike."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def default_schedule(totals: DataFrame) -> DataFrame:
    """(key, t, weight): from the sources' token shares to shares by square root, given (key, tokens)."""
    return totals.select("key", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), F.col("tokens").cast("double").alias("weight")), F.struct(F.lit(1.0).alias("t"), F.sqrt("tokens").alias("weight")))).alias("x")).select("key", "x.t", "x.weight")


def filled(knots: DataFrame) -> DataFrame:
    """(key, t, weight): every source of a schedule at the times of all its knots."""
    own = knots.groupBy("key", "t").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    grid = own.select("key").distinct().crossJoin(F.broadcast(own.select("t").distinct())).join(own, ["key", "t"], "left")
    w = Window.partitionBy("key").orderBy("t")
    knot = F.when(F.col("weight").isNotNull(), F.struct("t", "weight"))
    grid = grid.withColumn("a", F.last(knot, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(knot, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("a.weight") + (F.col("b.weight") - F.col("a.weight")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return grid.select("key", "t", F.when(F.col("weight").isNotNull(), F.col("weight")).when(F.col("a").isNull(), F.col("b.weight")).when(F.col("b").isNull(), F.col("a.weight")).otherwise(between).alias("weight"))


def demand(totals: DataFrame, knots: DataFrame, budget: Column) -> DataFrame:
    """(key, tokens, segments): for each stretch of the schedule its times, weights and the demand before and after it."""
    sums = knots.groupBy("t").agg(F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda a, x: a + x).alias("all"))
    grid = totals.select("key", "tokens", "corpus").crossJoin(F.broadcast(sums))  # sources x knots: both are small tables
    w = Window.partitionBy("key").orderBy("t")
    rows = (
        grid.join(knots.groupBy("key", "t").agg(F.sum("weight").alias("weight")), ["key", "t"], "left")
        .withColumn("w0", F.when(F.col("all") > 0, F.coalesce(F.col("weight"), F.lit(0.0)) / F.col("all")).otherwise(0.0))
        .withColumn("t1", F.lead("t").over(w))
        .withColumn("w1", F.lead("w0").over(w))
        .where("t1 is not null")
        .withColumn("area", budget * (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t")))
        .withColumn("d1", F.sum("area").over(w))
        .withColumn("d0", F.col("d1") - F.col("area"))
    )
    return rows.groupBy("key", "tokens").agg(F.sort_array(F.collect_list(F.struct("t", "t1", "w0", "w1", "d0", "d1"))).alias("segments"), F.max("d1").alias("wanted"), F.max(budget).alias("budget"))


def curriculum(docs: DataFrame, schedule: DataFrame | None = None, budget_tokens: float | None = None, max_epochs: int | None = None) -> DataFrame:
    """The documents in training order, with ``n_tokens``, ``epoch`` (from 0) and ``position`` (from 0 to below 1).

    ``schedule``: (source, t, weight); without ``budget_tokens`` the budget is the corpus's tokens.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch", "position")]
    rows = docs.select(
        *own,
        token_count(F.col("text")).alias("n_tokens"),
        source_key(F.col("source")).alias("_mix_key"),
        order_key(F.col("doc_id")).alias("_mix_order"),
    )
    n = docs.count()
    bits = max(0, (n // SLICE_DOCS).bit_length())
    rows = rows.withColumn("_mix_slice", F.shiftright("_mix_order", 60 - bits).cast("int"))
    slices = rows.groupBy("_mix_key", "_mix_slice").agg(F.sum("n_tokens").alias("tokens"))
    totals = slices.groupBy("_mix_key").agg(F.sum("tokens").alias("tokens"))
    totals = totals.select(F.col("_mix_key").alias("key"), "tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))).alias("corpus"))  # one row a source
    knots = default_schedule(totals) if schedule is None else filled(schedule.select(source_key(F.col("source")).alias("key"), F.col("t").cast("double"), F.col("weight").cast("double")))
    budget = F.col("corpus").cast("double") if budget_tokens is None else F.lit(float(budget_tokens))
    plan = demand(totals, knots, budget)
    before = slices.select("_mix_key", "_mix_slice", (F.sum("tokens").over(Window.partitionBy("_mix_key").orderBy("_mix_slice")) - F.col("tokens")).alias("_mix_before"))
    offsets = before.join(plan, before["_mix_key"] == plan["key"]).drop("key")
    inside = Window.partitionBy("_mix_key", "_mix_slice").orderBy("_mix_order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mix_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["_mix_key", "_mix_slice"])
    start = F.col("_mix_before") + F.col("_mix_start")
    epochs = F.when(F.col("tokens") > 0, F.ceil((F.col("wanted") - start) / F.col("tokens"))).otherwise(0)
    epochs = (epochs if max_epochs is None else F.least(F.lit(max_epochs), epochs)).cast("int")
    placed = placed.withColumn("_mix_last", epochs - 1).where("_mix_last >= 0")
    placed = placed.withColumn("_mix_run", F.explode(F.sequence(F.lit(0), F.floor(F.col("_mix_last") / EPOCHS).cast("int"))))
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.col("_mix_run") * EPOCHS, F.least(F.col("_mix_last"), F.col("_mix_run") * EPOCHS + EPOCHS - 1))))
    placed = placed.withColumn("_mix_x", (start + F.col("epoch") * F.col("tokens")).cast("double"))
    part = F.element_at(F.filter("segments", lambda s: (F.col("_mix_x") >= s["d0"]) & (F.col("_mix_x") < s["d1"])), 1)
    placed = placed.withColumn("_mix_part", F.coalesce(part, F.element_at("segments", -1)))
    s = F.col("_mix_part")
    y = F.greatest(F.lit(0.0), (F.col("_mix_x") - s["d0"]) / F.col("budget"))
    root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * y * (s["w1"] - s["w0"]) / (s["t1"] - s["t"])))
    placed = placed.withColumn("_mix_at", s["t"] + F.when(y > 0, 2 * y / (s["w0"] + root)).otherwise(0.0))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return (
        placed.select(*own, "n_tokens", "epoch", "_mix_at")
        .repartitionById(parts, F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(F.col("_mix_at") * parts))).cast("int"))
        .sortWithinPartitions("_mix_at", "source", "doc_id", "epoch")
        .select(*own, "n_tokens", "epoch", F.round("_mix_at", 9).alias("position"))  # sorted by all its digits
    )


SQL = """
with d as (
  select *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::bigint as nt,
    coalesce('+' || source, '-') as k, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as o
  from documents),
s as (select k, sum(nt)::bigint as tokens from d group by k),
w as (select k, tokens, tokens::double / sum(tokens) over () as p, sqrt(tokens::double) / sum(sqrt(tokens::double)) over () as q, (sum(tokens) over ())::double as b from s),
x as (select d.*, w.tokens, p, q, b, b * (p + q) / 2 as wanted,
    coalesce(sum(nt) over (partition by d.k order by o, doc_id, text rows between unbounded preceding and 1 preceding), 0)::double as c
  from d join w on d.k = w.k),
e as (select *, c + epoch * tokens as at, (c + epoch * tokens) / b as y from x, range(4) r(epoch) where tokens > 0 and c + epoch * tokens < wanted)
select doc_id, text, lang, source, n_chars, nt as n_tokens, epoch::int as epoch,
  round(case when y > 0 then 2 * y / (p + sqrt(greatest(0, p * p + 2 * y * (q - p)))) else 0 end, 9) as position
from e
"""
