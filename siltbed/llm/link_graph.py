"""URL filters by propagation over the link graph of hosts.

Links of pages (absolute or protocol-relative ``href`` targets; relative ones stay on their host), and those of a link
table if there is one, make host edges, weighted by the number of pages that link. Trust is personalised PageRank from
trusted seeds along the edges; distrust is personalised PageRank from blocked seeds along the reversed edges, since who
links to bad hosts is bad. What a host without edges onward holds goes back to the seeds; that only scales the scores, so
rounds leave it out (y = start + damping * moved y) and the sum is made 1 at the end. A host is refused if it is a blocked
seed, or its distrust reaches ``threshold`` times the uniform share 1 / hosts and exceeds its trust; a trusted seed is
never refused by score.

Both rankings run at once, in rounds over blocks of hosts (one for each ``BLOCK_EDGES`` edges, by a hash): a round adds up
what flows in from other blocks, and each block then iterates over the edges within it, in one task, until it rests. From
below, such rounds come at least as near as plain power iterations, and scores end within damping / (1 - damping) times
what the last round added; rounds go on until that is under ``tolerance`` (of a sum of 1; unless given, a millionth of
1 / hosts or 1e-12, whichever is less, so that rounding and verdicts are those of the solution). Scores are written to the
shared folder after each, so a lost executor costs a round. A seed names a host or a domain: it covers the host itself
and all below it. Seeds are tables, joined by each suffix of a host, so a blocklist can be large. Only edges, hosts and
scores are shuffled; a page's html is read once, for its links.

Defined results: a null, empty or malformed URL has no host, takes no part in the graph and its page is kept with a null
host; null html has no links; repeated pages count once as a linking page (by URL) and are each judged; ties need no
order, since hosts are judged one by one; without seeds all scores are 0 and nothing is refused; an empty table gives an
empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.scratch import Scratch

BLOCK_EDGES = 500_000
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_HREF = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    h = F.regexp_extract(F.lower(F.trim(url)), _HOST, 1)
    return F.when(h != "", h)


def seed_table(spark: SparkSession, seeds: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in seeds], "seed string")


def covered(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host) of those that a seed covers."""
    parts = F.split("host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return hosts.select("host", F.explode(below).alias("seed")).join(seeds.select("seed").distinct(), "seed", "left_semi").select("host").distinct()


def host_edges(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): pages of one host that link to another. ``links``: further (url, target)."""
    found = pages.select(F.col("url").cast("string"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(_HREF), F.lit(1))).alias("target"))
    found = found if links is None else found.unionByName(links.select(F.col("url").cast("string"), F.col("target").cast("string")))
    target = F.when(F.col("target").startswith("//"), F.concat(F.lit("http:"), "target")).otherwise(F.col("target"))
    rows = found.select("url", host_of(F.col("url")).alias("src"), host_of(target).alias("dst"))
    return rows.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count_distinct("url").cast("double").alias("weight"))


def settle(base: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The solution y of y = base + moved y, where edge k moves share[k] of y[a[k]] to b[k]; shares from a node sum to under 1."""
    y = base
    while len(a):
        new = base + np.bincount(b, share * y[a], len(base))
        if not (new - y > 1e-16 * new).any():
            break
        y = new
    return y


def propagate(scratch: Scratch, start: DataFrame, moves: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, score): for each kind the solution of score = start + damping * moved score, scaled to a sum of 1.

    ``start``: (kind, host, start); ``moves``: (kind, a, b, share).
    """
    blocks = -(-moves.count() // BLOCK_EDGES) or 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    moves = moves.select("kind", "a", "b", (damping * F.col("share")).alias("share"), block("a").alias("block"), block("b").alias("to"))
    inner, across = moves.where("block = to").select(F.col("block").alias("of"), "kind", "a", "b", "share"), moves.where("block <> to").select("kind", F.col("a").alias("host"), "b", "share")
    first = start.select(block("host").alias("block"), "kind", "host", F.col("start").alias("score"))
    crossing, schema = not across.isEmpty(), pa.schema([("kind", pa.string()), ("host", pa.string()), ("score", pa.float64())])

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        names, at = np.unique(np.array([f"{k} {h}" for t, c in ((left, "host"), (right, "a"), (right, "b")) for k, h in zip(t["kind"].to_pylist(), t[c].to_pylist())], object).astype(str), return_inverse=True)
        n, m = len(left), len(right)
        y = settle(np.bincount(at[:n], left["score"].to_numpy(), len(names)), at[n : n + m], at[n + m :], right["share"].to_numpy())
        on = np.flatnonzero(y > 0)
        kinds, hosts = zip(*(x.split(" ", 1) for x in names[on].tolist())) if len(on) else ((), ())
        return pa.table([pa.array(kinds, pa.string()), pa.array(hosts, pa.string()), y[on]], schema=schema)

    score, total, n = None, {}, 0
    while True:
        base = first
        if n:
            flow = across.join(score, ["kind", "host"]).select(block("b").alias("block"), "kind", F.col("b").alias("host"), (F.col("share") * F.col("score")).alias("score"))
            base = first.unionByName(flow).groupBy("block", "kind", "host").agg(F.sum("score").alias("score"))
        out = base.groupBy("block").cogroup(inner.groupBy("of")).applyInArrow(local, "kind string, host string, score double")
        score, before, n = scratch.write(out, f"score{n}"), total, n + 1
        scratch.drop(f"score{n - 2}")
        total = {r.kind: r.total for r in score.groupBy("kind").agg(F.sum("score").alias("total")).collect()}  # two rows
        if not crossing or all((total[k] - before.get(k, 0.0)) * damping / (1 - damping) <= tolerance * total[k] for k in total):
            break
    scale = F.lit(0.0)
    for k, t in total.items():
        scale = F.when(F.col("kind") == k, 1 / t).otherwise(scale)
    return score.select("kind", "host", (F.col("score") * scale).alias("score"))


def judged_pages(pages: DataFrame, trusted: DataFrame, blocked: DataFrame, links: DataFrame | None = None, damping: float = 0.85, threshold: float = 1.0, tolerance: float | None = None) -> DataFrame:
    """Every page with its host's scores: page_id, url, host, trust, distrust, keep.

    ``trusted``, ``blocked``: (seed). ``links``: (url, target) of pages, such as a crawl's link table, besides those in html.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "links")
    own = pages.select("page_id", F.col("url").cast("string"), host_of(F.col("url")).alias("host"))
    edges = scratch.write(host_edges(pages, links), "edges")
    names = own.select("host").where("host is not null").union(edges.select("src")).union(edges.select("dst")).distinct()
    flag = lambda seeds, name: covered(names, seeds).withColumn(name, F.lit(True))
    hosts = names.join(flag(trusted, "good"), "host", "left").join(flag(blocked, "bad"), "host", "left")
    hosts = scratch.write(hosts.select("host", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad")), "hosts")
    counts = hosts.agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad")).first()
    if tolerance is None:
        tolerance = min(1e-12, 1e-6 / max(counts.n, 1))
    start = [hosts.where(k).select(F.lit(k).alias("kind"), "host", F.lit(1 / counts[k]).alias("start")) for k in ("good", "bad") if counts[k]]
    verdict = hosts.select("*", F.lit(0.0).alias("t"), F.lit(0.0).alias("d"))
    if start:
        sides = [edges.select(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), "weight") for k, a, b in (("good", "src", "dst"), ("bad", "dst", "src"))]
        both = sides[0].union(sides[1])
        out = both.groupBy("kind", "a").agg(F.sum("weight").alias("out"))
        moves = scratch.write(both.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("out")).alias("share")), "moves")
        score = propagate(scratch, start[0] if len(start) == 1 else start[0].union(start[1]), moves, damping, tolerance)
        one = score.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(x) for k, x in (("good", "t"), ("bad", "d"))])
        verdict = hosts.join(one, "host", "left").select("host", "good", "bad", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("d", F.lit(0.0)).alias("d"))
    refuse = F.col("bad") | (~F.col("good") & (F.col("d") * F.lit(float(counts.n)) >= threshold) & (F.col("d") > F.col("t")))
    verdict = verdict.select("host", F.round("t", 9).alias("trust"), F.round("d", 9).alias("distrust"), (~refuse).alias("keep"))
    return own.join(verdict, "host", "left").select("page_id", "url", "host", "trust", "distrust", F.coalesce("keep", F.lit(True)).alias("keep"))


def sql(trusted: Iterable[str], blocked: Iterable[str], links: str, damping: float = 0.85, rounds: int = 200, threshold: float = 1.0) -> str:
    """The same in SQL, by a recursive query. ``links``: SQL of (url, target)."""

    def cover(seeds: Iterable[str]) -> str:
        return " or ".join(f"host = '{s}' or ends_with(host, '.{s}')" for s in seeds) or "false"

    host = "nullif(regexp_extract(lower(trim({0})), '" + _HOST + "', 1), '')"
    href = _HREF.replace("'", "''")
    target = host.format("case when starts_with(target, '//') then 'http:' || target else target end")
    return f"""
with recursive own as (select page_id, url, {host.format('url')} as host from pages),
found as (select url, unnest(regexp_extract_all(html, '{href}', 1)) as target from pages union all {links}),
edges as (select src, dst, count(distinct url)::double as weight from (select url, {host.format('url')} as src, {target} as dst from found)
  where src is not null and dst is not null and src <> dst group by src, dst),
hosts as (select host, ({cover(trusted)}) as good, ({cover(blocked)}) as bad from (select host from own where host is not null union select src from edges union select dst from edges)),
start as (select 'good' as kind, host, 1.0::double / count(*) over () as start from hosts where good union all select 'bad', host, 1.0::double / count(*) over () from hosts where bad),
sides as (select 'good' as kind, src as a, dst as b, weight from edges union all select 'bad', dst, src, weight from edges),
moves as materialized (select kind, a, b, weight / sum(weight) over (partition by kind, a) as share from sides),
score as (select 0 as k, kind, host, start as score from start
  union all
  select k + 1, kind, host, sum(score) from (
    select s.k, m.kind, m.b as host, {damping} * m.share * s.score as score from score s join moves m on s.kind = m.kind and s.host = m.a
    union all select distinct s.k, x.kind, x.host, x.start from score s join start x on s.kind = x.kind
  ) where k < {rounds} group by k, kind, host),
last as (select kind, host, score / sum(score) over (partition by kind) as score from score where k = {rounds}),
v as (select host, round(t, 9) as trust, round(d, 9) as distrust, not (bad or (not good and d * (select count(*) from hosts) >= {threshold} and d > t)) as keep
  from (select h.host, good, bad, coalesce(t.score, 0) as t, coalesce(d.score, 0) as d from hosts h
    left join last t on t.host = h.host and t.kind = 'good' left join last d on d.host = h.host and d.kind = 'bad'))
select page_id, url, own.host, trust, distrust, coalesce(keep, true) as keep from own left join v on own.host = v.host
"""
