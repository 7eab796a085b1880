"""The import graph: extraction, resolution against the whole file set, reverse edges, cycles, entry points."""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.functions.text import basename, normalize_path
from siltbed.session import ship
from siltbed.sources.corpus import language


def specs(corpus: DataFrame) -> DataFrame:
    """(src, language, spec), distinct, by each import pattern of the file's language over its whole text."""
    rows = corpus.select(F.col("file").alias("src"), language(F.col("file"), P.IMPORT_LANGUAGES).alias("language"), "text").where("language is not null and text is not null")
    found = F.flatten(F.array(*[F.when(F.col("language") == k, F.regexp_extract_all("text", F.lit(r), F.lit(1))).otherwise(F.array().cast("array<string>")) for k, r in P.IMPORTS]))
    return rows.select("src", "language", F.explode(F.array_distinct(found)).alias("spec")).where("spec <> ''")


def is_external(spec: Column, lang: Column) -> Column:
    platform = F.lit(False)
    for name in P.PLATFORM_NAMESPACES:
        platform = platform | spec.startswith(name)
    return (
        F.when(lang == "typescript", ~spec.rlike(r"^[./]"))
        .when(lang == "python", ~spec.startswith("."))
        .when(lang == "go", F.contains(spec, F.lit(".")) & ~spec.startswith("./"))
        .when(lang == "rust", ~spec.rlike("^(?:crate|super|self)"))
        .when(lang == "csharp", platform)
        .otherwise(False)
    )


def _candidates() -> Column:
    """Paths that a spec may stand for, best first; the last is what stays unresolved."""
    src, spec = F.col("src"), F.col("spec")
    folder = F.regexp_extract(src, r"^(.*/)?[^/]*$", 1)
    base = normalize_path(F.concat(folder, spec))
    bare = F.regexp_replace(base, r"\.jsx?$", "")
    script = F.array(base, *[F.concat(b, F.lit(e)) for b in (base, bare) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")], base)
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    up = F.concat(folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    module = normalize_path(F.concat(up, F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")))
    python = F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")), F.concat(module, F.lit(".py")))
    return F.when(F.col("language") == "typescript", script).when(F.col("language") == "python", python).otherwise(F.array(spec))


def edges(corpus: DataFrame) -> DataFrame:
    """(src, spec, dst, external): dst is the file meant, or the path it would have; null if external."""
    files = corpus.select(F.col("file").alias("path"), F.lit(1).alias("exists")).distinct()
    found = specs(corpus).withColumn("external", is_external(F.col("spec"), F.col("language")))
    inner = found.where("not external").withColumn("options", _candidates())
    tried = inner.select("src", "spec", "external", F.element_at("options", -1).alias("fallback"), F.posexplode("options").alias("rank", "path")).join(files, "path", "left")
    solved = tried.groupBy("src", "spec", "external", "fallback").agg(F.min_by("path", F.when(F.col("exists") == 1, F.col("rank"))).alias("hit"))
    solved = solved.select("src", "spec", F.coalesce("hit", "fallback").alias("dst"), "external")
    return solved.unionByName(found.where("external").select("src", "spec", F.lit(None).cast("string").alias("dst"), "external"))


def reverse(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(file, imported_by): importers of each file of the corpus, sorted."""
    rows = found.where("dst is not null").join(corpus.select(F.col("file").alias("dst")), "dst")
    return rows.groupBy(F.col("dst").alias("file")).agg(F.sort_array(F.collect_set("src")).alias("imported_by"))


def strong_components(onward: dict[str, list[str]]) -> list[list[str]]:
    """Tarjan's strongly connected components of two nodes or more, without recursion."""
    seen, low, stack, held, out = {}, {}, [], set(), []
    for root in onward:
        if root in seen:
            continue
        work = [(root, iter(onward[root]))]
        seen[root] = low[root] = len(seen)
        stack.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in seen:
                    seen[x] = low[x] = len(seen)
                    stack.append(x)
                    held.add(x)
                    work.append((x, iter(onward.get(x, ()))))
                    break
                if x in held:
                    low[node] = min(low[node], seen[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    held.difference_update(part)
                    if len(part) > 1:
                        out.append(part)
    return out


def long_cycles(pairs: list[tuple[str, str]], max_length: int) -> list[list[str]]:
    """For each edge that is on cycles, but on none of up to ``max_length`` nodes, a shortest one; each from its least node."""
    onward = defaultdict(list)
    for a, b in sorted(pairs):
        onward[a].append(b)
    found = set()
    for part in strong_components(dict(onward)):
        inside = set(part)
        importers = defaultdict(set)
        for a in part:
            for b in onward[a]:
                importers[b].add(a)
        for v in sorted(part):
            before, queue, wanted = {v: None}, deque([v]), importers[v] & inside - {v}
            while wanted and queue:
                node = queue.popleft()
                for x in onward[node]:
                    if x in inside and x not in before:
                        before[x] = node
                        queue.append(x)
                        if x in wanted:
                            wanted.discard(x)
                            path = [x]
                            while before[path[-1]] is not None:
                                path.append(before[path[-1]])
                            if len(path) > max_length:
                                k = path.index(min(path))
                                found.add(tuple(path[k::-1] + path[:k:-1]))
    return [list(p) for p in sorted(found)]


def cycles(pairs: DataFrame, max_length: int = 8) -> DataFrame:
    """(length, cycle): all elementary cycles of up to ``max_length`` files, each once, from its least file, and longer
    ones for what these leave out: of each edge that is only on longer cycles, a shortest one. So every edge on a cycle is
    in a row, and there are no rows only if there are no cycles.

    The former are a recursive query whose depth is bounded; nodes without an edge in and one out are peeled off first. The
    latter take the remaining edges, names only, in one task: strong components, then a search from each of their nodes.
    """
    spark = ship(pairs.sparkSession)
    clean = pairs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null").distinct()
    clean = clean.join(clean.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(clean.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    query = f"""
    with recursive walk(root, last, path, n) as (
      select src, dst, array(src), 1 from {{pairs}} where src <= dst
      union all
      select w.root, e.dst, concat(w.path, array(w.last)), w.n + 1 from walk w join {{pairs}} e on w.last = e.src
      where w.n < {int(max_length)} and w.last <> w.root and e.dst >= w.root and not array_contains(w.path, w.last))
    select n as length, array_join(path, '>') as cycle from walk where last = root"""

    def longer(edges: pa.Table) -> pa.Table:
        found = long_cycles(list(zip(edges["src"].to_pylist(), edges["dst"].to_pylist())), max(int(max_length), 1))
        return pa.table({"length": pa.array([len(p) for p in found], pa.int32()), "cycle": pa.array([">".join(p) for p in found], pa.string())})

    return spark.sql(query, pairs=clean).unionByName(clean.groupBy().applyInArrow(longer, "length int, cycle string"))


def classify(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(file, role) of files that nothing imports: entry by name or if they import, else orphan."""
    idle = corpus.select("file").distinct().join(found.where("dst is not null").select(F.col("dst").alias("file")), "file", "left_anti")
    importing = found.where("not external").select(F.col("src").alias("file")).distinct().withColumn("imports", F.lit(True))
    name = F.lower(basename(F.col("file")))
    entry = name.rlike("index|main|app|server|cli") | F.coalesce("imports", F.lit(False))
    return idle.join(importing, "file", "left").select("file", F.when(entry, "entry").otherwise("orphan").alias("role"))


def degrees(found: DataFrame, top: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """(most imported, with unresolved targets; most importing): (file, n), ties by name."""
    inner = found.where("dst is not null")

    def most(c: str) -> DataFrame:
        rows = inner.groupBy(F.col(c).alias("file")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file")
        return rows if top is None else rows.limit(top)

    return most("dst"), most("src")


def report(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: files, imports, internal and external, and the external names."""
    agg = found.agg(F.count("*").alias("imports"), F.count_if(~F.col("external")).alias("internal"), F.count_if("external").alias("external"), F.sort_array(F.collect_set(F.when(F.col("external"), F.col("spec")))).alias("external_names"))
    return corpus.agg(F.count_distinct("file").alias("files")).crossJoin(agg)


def summary(found: DataFrame, corpus: DataFrame, rings: DataFrame, most_cycles: int = 3, most_files: int = 5) -> DataFrame:
    """(section, nth, item, n): totals, the first cycles and how many more there are, orphans, and what is imported most."""
    totals = report(found, corpus).select(F.explode(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(k).cast("long").alias("nth"), F.lit(c).alias("item"), v.cast("long").alias("n")) for k, (c, v) in enumerate((("files", F.col("files")), ("imports", F.col("imports")), ("external", F.size("external_names"))), 1)])).alias("x")).select("x.*")

    def first(rows: DataFrame, section: str, most: int) -> DataFrame:
        """``rows``: (item, n, order) of which the first by order are shown."""
        top = rows.orderBy("order", "item").limit(most)
        return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy("order", "item")).cast("long").alias("nth"), "item", F.col("n").cast("long").alias("n"))  # ``most`` rows

    cycles_ = rings.select(F.col("cycle").alias("item"), F.col("length").alias("n"), F.col("length").alias("order"))
    more = rings.agg(F.greatest(F.count("*") - most_cycles, F.lit(0)).alias("n")).select(F.lit("cycle").alias("section"), F.lit(most_cycles + 1).cast("long").alias("nth"), F.lit("more").alias("item"), "n").where("n > 0")
    orphans = classify(found, corpus).where("role = 'orphan'").select(F.col("file").alias("item"), F.lit(0).alias("n"), F.lit(0).alias("order"))
    most, _ = degrees(found, None)
    imported = most.select(F.col("file").alias("item"), "n", (-F.col("n")).alias("order"))
    return totals.unionByName(first(cycles_, "cycle", most_cycles)).unionByName(more).unionByName(first(orphans, "orphan", most_files)).unionByName(first(imported, "most imported", most_files))
