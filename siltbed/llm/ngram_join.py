"""N-gram Jaccard self-join by grouped prefixes.

Each document is the set of its word ``n``-grams (lower-cased; fewer words make one gram of all). Exact, in five steps:

1. Postings. Each task sorts the grams of its documents and sends them in packed blocks, by gram range. Where they meet,
   each gram's document frequency is counted over the whole corpus, and just the grams of two documents or more go back:
   a gram of one document can't be shared, so it only counts towards the size.
2. Prefixes. A document's grams are ordered by frequency, then hash. Jaccard >= t takes a shared gram among the first
   size - ceil(t * size) + 1 of both; the grams of one document come first, so most documents are done here.
3. Groups. Documents of one size and one prefix are a group, with a member for each set of shared grams (a class,
   between whose documents and those of another Jaccard is one number).
4. Homes. A prefix gram is sent to its home, the least group that has it, and so are the groups that have it: the grams
   that a cluster shares have few homes, so that its groups meet there once, and pairs of them are never sent anywhere.
   A home of many postings is a grid of cells, each of which compares two of its slices.
5. Pairs. At a home, groups that share a gram pass the size and the positional filter, pairs of groups are expanded to
   their members, and these are verified by counting shared grams. A pair counts at the first prefix gram that both have
   and nowhere else, so counts of links add up, and pairs need not be sent to be made distinct.

No partner is capped and no gram is dropped. :func:`linked_documents` has a row for each document that is near another,
with its class and the number of its links: every pair is verified, but what leaves a home is a count for each class of
documents and a tree of links, so the result and what is moved don't grow with the square of a cluster.
:func:`near_copies` has a row for each pair; :func:`without_near_copies` works on classes.

Defined results: a null or empty text, or one without a word, has an empty set and is near to nothing; rows equal in id
and text are one document, never near itself, which stays or goes with all its rows; rows that share an id only are
different documents, of whose pairs with another id the highest Jaccard is reported (:func:`linked_documents`: they are one
row, whose links are the other ids that any of them is near); rows of a null id are compared like others, but have no id
by which a pair could be reported; ties have nothing to decide; other columns are ignored, or kept
by :func:`without_near_copies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of, lean, lean_group, pack, texts_of, unpack
from siltbed.llm.scratch import Scratch, collect_garbage
from siltbed.llm.text import chunks, gram_sets, words

CHUNK_GRAMS = 1_000_000
CELL_POSTINGS = 100_000
EXPAND = 1_000_000
BATCH_ROWS = 256
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64

_BLOCK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_SET = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int64()), ("alone", pa.int64()), ("prefix", pa.binary()), ("prefix_key", pa.string()), ("grams", pa.binary()), ("class_key", pa.string())])


def prefix_length(threshold: float, size: np.ndarray) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _ddl(schema: pa.Schema) -> str:
    kind = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


def row_key(docs: DataFrame) -> list[Column]:
    """k1 and k2, 128 bits that tell apart rows of another id or text."""
    doc_id, text = docs["doc_id"].cast("string"), docs["text"].cast("string")
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2")]


def shared_sets(docs: DataFrame, scratch: Scratch, n: int, threshold: float, parts: int) -> DataFrame:
    """Steps 1 and 2: a row for each document with a prefix gram that another document has.

    What comes back of the postings is a table, so the files of their shuffle, the largest, can go before the next.
    """

    def blocks(batches):
        part, number = TaskContext.get().partitionId(), 0
        heads, docs_, grams, total = [], [], [], 0

        def flush():
            nonlocal number
            chunk = (part << 24) | number
            number += 1
            gram, doc = np.concatenate(grams), np.concatenate(docs_)
            order = np.argsort(gram)
            gram, doc = gram[order], doc[order]
            cut = np.searchsorted(gram, [np.uint64((k << 64) // parts) for k in range(1, parts)])
            edges = np.concatenate([[0], cut, [len(gram)]])
            rows = [(k, chunk, pack(gram[a:b], ascending=True), pack(doc[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
            rows.append((chunk % parts, chunk, None, np.concatenate(heads, 1).astype("<i8").tobytes()))
            yield batch_of(_BLOCK, *zip(*rows))  # one batch: rows are as many as chunks times parts

        for batch in batches:
            texts = texts_of(batch, "text")
            ids = batch.column("doc_id")
            own = np.stack([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(False), batch.column("k1").to_numpy(), batch.column("k2").to_numpy()])
            for a, b in chunks(texts):
                doc, gram = gram_sets(words(texts[a:b]), n)
                done = sum(h.shape[1] for h in heads)
                if heads and (total + len(gram) > CHUNK_GRAMS or done + b - a > 65536):
                    yield from flush()
                    heads, docs_, grams, total, done = [], [], [], 0, 0
                heads.append(np.concatenate([own[:, a:b], np.bincount(doc, minlength=b - a)[None]]))
                docs_.append(doc + done)
                grams.append(gram)
                total += len(gram)
        if heads:
            yield from flush()

    def frequencies(batches):
        rows = []
        for batch in batches:
            for _, chunk, gram, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if gram is None:
                    yield batch_of(_BACK, [chunk], [None], [doc], [None])
                else:
                    rows.append((chunk, unpack(gram), unpack(doc)))
        if not rows:
            return
        gram = np.concatenate([r[1] for r in rows])
        order = np.argsort(gram, kind="stable")
        ranked = gram[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        count = np.diff(np.concatenate([edge, [len(ranked)]]))
        each = np.empty(len(gram), np.int64)
        each[order] = np.repeat(count, count)
        starts = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
        del ranked, order
        out = []
        for k, (chunk, g, d) in enumerate(rows):
            own = each[starts[k] : starts[k + 1]]
            on = own > 1
            if on.any():
                out.append((chunk, pack(g[on], ascending=True), pack(d[on]), pack(own[on])))
            if out and (len(out) == BATCH_ROWS or k + 1 == len(rows)):
                yield batch_of(_BACK, *zip(*out))
                out = []

    def prefixes(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        head = next(d for g, d in zip(rows["grams"], rows["docs"]) if g is None)
        ids, valid, k1, k2, sizes = np.frombuffer(head, "<i8").reshape(5, -1)
        n_docs = len(ids)
        chunk = rows["chunk"][0]
        some = [k for k, g in enumerate(rows["grams"]) if g is not None]
        out = []
        if some:
            gram = np.concatenate([unpack(rows["grams"][k]) for k in some])
            doc = np.concatenate([unpack(rows["docs"][k]) for k in some]).astype(np.int64)
            count = np.concatenate([unpack(rows["counts"][k]) for k in some])
            shared = np.bincount(doc, minlength=n_docs)
            useful = prefix_length(threshold, sizes) - (sizes - shared)
            on = useful[doc] > 0
            gram, doc, count = gram[on], doc[on], count[on]
            order = np.lexsort((gram, count, doc))
            gram, doc = gram[order], doc[order]
            first = np.searchsorted(doc, np.arange(n_docs + 1))
            for d in np.flatnonzero((useful > 0) & (shared > 0)):
                own = gram[first[d] : first[d + 1]]
                q = min(int(useful[d]), len(own))
                prefix, full = own[:q].tobytes(), np.sort(own).tobytes()
                key = lambda b: f"{sizes[d]}-{xxhash.xxh128_hexdigest(b)}"
                out.append((chunk << 16 | int(d), int(ids[d]) if valid[d] else None, int(k1[d]), int(k2[d]), int(sizes[d]), int(sizes[d] - shared[d]), prefix, key(prefix), full, key(full)))
        columns = list(zip(*out)) or [[] for _ in _SET]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SET)], schema=_SET)

    parts *= 2  # a part is sorted in memory, in Python
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    own = docs.select(doc_id.alias("doc_id"), text.alias("text"), *row_key(docs))
    back = scratch.write(own.mapInArrow(lean(blocks), _ddl(_BLOCK)).repartitionById(parts, "bucket").mapInArrow(lean(frequencies), _ddl(_BACK)), "shared")
    collect_garbage(docs.sparkSession)
    return back.groupBy("chunk").applyInArrow(lean_group(prefixes), _ddl(_SET))


def _explode_prefix(batches):
    schema = pa.schema([("gram", pa.int64()), ("place", pa.int32()), ("grp", pa.int64()), ("size", pa.int32())])
    for batch in batches:
        grp, size, alone = (batch.column(c).to_numpy() for c in ("grp", "size", "alone"))
        lists = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        many = np.array([len(x) for x in lists], np.int64)
        if many.sum():
            place = np.concatenate([np.arange(k) for k in many]) + np.repeat(alone, many)
            yield batch_of(schema, np.concatenate(lists), place.astype(np.int32), np.repeat(grp, many), np.repeat(size, many).astype(np.int32))


def _stretches(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers starts[k], starts[k] + 1, ..., many[k] of them, for each k in turn."""
    return np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of stretches whose sizes add up to about ``EXPAND``."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // EXPAND)) + 1, [len(sizes)]])
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if a < b]


def candidate_groups(left: pa.Table, groups: np.ndarray, prefixes: list[np.ndarray], threshold: float):
    """Pairs of indexes of ``groups`` at a spot that pass the filters, some at a time: those whose first common prefix gram has its home here.

    At that gram the positional filter bounds all that the two share, and it is one place for each pair in the whole job.
    """
    real = left["place"].to_numpy() >= 0
    grp, gram, cells, cell, size, place = (left[c].to_numpy()[real] for c in ("grp", "gram", "cells", "cell", "size", "place"))
    if not len(grp):
        return
    own = np.searchsorted(groups, grp)
    order = np.lexsort((own, cells, gram))
    gram, cells, cell, size, place, own = gram[order], cells[order], cell[order], size[order].astype(np.int64), place[order].astype(np.int64), own[order]
    fresh = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (cells[1:] != cells[:-1])]))
    length = np.diff(np.append(fresh, len(gram)))
    ahead = np.repeat(fresh + length, length) - np.arange(len(gram)) - 1
    diagonal = (cells >> 32) == (cells & 0xFFFFFFFF)
    kinds, flat = np.unique(np.concatenate(prefixes), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])])
    kind = np.searchsorted(kinds, gram.view(np.uint64))
    mark = np.full(len(kinds), len(kinds))
    by = np.lexsort((place, own))
    first = np.flatnonzero(np.diff(own[by], prepend=-1))
    last = np.append(first[1:], len(by))
    for s, e in _cuts(np.add.reduceat(ahead[by], first)):  # all postings of a group are in one stretch
        x = by[first[s] : last[e - 1]]
        x, y = np.repeat(x, ahead[x]), _stretches(x + 1, ahead[x])
        on = diagonal[x] | (cell[x] != cell[y])
        x, y = x[on], y[on]
        at = np.unique(own[x] * len(groups) + own[y], return_index=True)[1]  # where the pair meets first
        x, y = x[at], y[at]
        big, small = np.maximum(size[x], size[y]), np.minimum(size[x], size[y])
        need = np.ceil(threshold / (1 + threshold) * (size[x] + size[y]) - 1e-9)
        on = (small >= threshold * big - 1e-6) & (np.minimum(size[x] - place[x], size[y] - place[y]) >= need)
        x, y = x[on], y[on]
        a, b, keep = own[x], own[y], np.zeros(len(x), bool)
        edges = np.concatenate([np.flatnonzero(np.diff(a, prepend=-1)), [len(a)]])
        for lo, hi in zip(edges[:-1], edges[1:]):
            mine, other = flat[offsets[a[lo]] : offsets[a[lo] + 1]], b[lo:hi]
            mark[mine] = np.arange(len(mine))
            many = offsets[other + 1] - offsets[other]
            least = np.minimum.reduceat(mark[flat[_stretches(offsets[other], many)]], np.cumsum(many) - many)
            keep[lo:hi] = least == mark[kind[x[lo:hi]]]
            mark[mine] = len(kinds)
        yield a[keep], b[keep]


def shared_counts(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: int) -> np.ndarray:
    """How many numbers sets a[k] and b[k] share; ``a`` ascends, a set is a stretch of ``flat``, whose numbers are under ``kinds``."""
    out, mark = np.zeros(len(a), np.int64), np.zeros(kinds, bool)
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    for s, e in zip(edges[:-1], edges[1:]):
        own = flat[offsets[a[s]] : offsets[a[s] + 1]]
        mark[own] = True
        for lo in range(s, e, 4096):
            other = b[lo : min(e, lo + 4096)]
            many = sizes[other]
            out[lo : lo + len(other)] = np.add.reduceat(mark[flat[_stretches(offsets[other], many)]].astype(np.int64), np.cumsum(many) - many)
        mark[own] = False
    return out


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make ``root``, the least index of each one's tree, hold for links a[k], b[k] too."""
    while True:
        a, b = root[a], root[b]
        on = a != b
        if not on.any():
            return
        a, b = a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("links", pa.int64())])


def _verifier(threshold: float, pairs: bool):
    """Near pairs (a, b, jaccard) of classes, each once in the whole job; without ``pairs`` only those of a class that is ``split``.

    The others then become the links (a, b) of a tree, whose jaccard is null, and for each class a row (a, links) with the
    sum of its partners' ``plain``.
    """

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _FOUND.empty_table()
        groups = np.unique(left["grp"].to_numpy())
        home = np.searchsorted(groups, right["grp"].to_numpy())
        order = np.lexsort((right["uid"].to_numpy(), home))
        home, uid, size, plain, split = home[order], *(right[c].to_numpy()[order] for c in ("uid", "size", "plain", "split"))
        prefixes = [np.zeros(0, np.uint64)] * len(groups)
        for g, p in zip(right["grp"].to_numpy(), right["prefix"].to_pylist()):
            if p is not None:
                prefixes[np.searchsorted(groups, g)] = np.frombuffer(p, np.uint64)
        blobs = right["grams"].to_pylist()
        grams = [np.frombuffer(blobs[k], np.uint64) for k in order]
        kinds, flat = np.unique(np.concatenate(grams), return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        del blobs, grams
        begin = np.searchsorted(home, np.arange(len(groups) + 1))
        many = np.diff(begin)
        inner = np.searchsorted(groups, np.unique(left["grp"].to_numpy()[left["place"].to_numpy() < 0]))  # these compare their members too
        root, links, out = np.arange(len(uid)), np.zeros(len(uid)), []

        def compare(first: np.ndarray, second: np.ndarray) -> None:
            """Members of two groups, or of one, by rows: a member of the first, and a stretch of the second."""
            for s, e in _cuts(many[first]):
                f, g = first[s:e], second[s:e]
                row = _stretches(begin[f], many[f])
                f, g = np.repeat(f, many[f]), np.repeat(g, many[f])
                since = np.where(f == g, row + 1, begin[g])
                number = begin[g] + many[g] - since
                by = np.argsort(row, kind="stable")
                row, since, number = row[by], since[by], number[by]
                for lo, hi in _cuts(number):
                    a, b = np.repeat(row[lo:hi], number[lo:hi]), _stretches(since[lo:hi], number[lo:hi])
                    if not len(a):
                        continue
                    common = shared_counts(flat, offsets, a, b, len(kinds))
                    jaccard = common / (size[a] + size[b] - common)
                    near = jaccard >= threshold
                    a, b, jaccard = a[near], b[near], jaccard[near]
                    if not pairs:
                        join_roots(root, a, b)
                        links[:] += np.bincount(a, plain[b], len(uid)) + np.bincount(b, plain[a], len(uid))
                        on = split[a] | split[b]
                        a, b, jaccard = a[on], b[on], jaccard[on]
                    if len(a):
                        out.append(pa.table([np.minimum(uid[a], uid[b]), np.maximum(uid[a], uid[b]), jaccard, pa.nulls(len(a), pa.int64())], schema=_FOUND))

        for first, second in candidate_groups(left, groups, prefixes, threshold):
            compare(first, second)
        compare(inner, inner)
        child, linked = np.flatnonzero(root != np.arange(len(uid))), np.flatnonzero(links)
        out.append(pa.table([uid[root[child]], uid[child], pa.nulls(len(child), pa.float64()), pa.nulls(len(child), pa.int64())], schema=_FOUND))
        out.append(pa.table([uid[linked], pa.nulls(len(linked), pa.int64()), pa.nulls(len(linked), pa.float64()), links[linked].astype(np.int64)], schema=_FOUND))
        return pa.concat_tables(out)

    return verify


def near_classes(docs: DataFrame, scratch: Scratch, n: int = 3, threshold: float = 0.6, pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cls, members, size, shared, plain, split), one row for each class, and (a, b, jaccard) of near classes.

    ``plain`` is the number of a class's ids that no other class has, ``split`` says whether it has others. Without
    ``pairs`` the second table has what :func:`_verifier` says.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = shared_sets(docs, scratch, n, threshold, parts)
    fields = ("size", "alone", "prefix", "prefix_key", "grams")
    classes = sets.groupBy("class_key").agg(F.min("uid").alias("uid"), F.min_by(F.struct(*fields), "uid").alias("s"), F.sort_array(F.collect_set(F.struct("doc_id", "k1", "k2"))).alias("members"))
    classes = scratch.write(classes.select("uid", "members", "s.*"), "unmarked")
    scratch.drop("shared")
    collect_garbage(spark)
    ids = classes.select("uid", F.explode(F.array_distinct(F.col("members")["doc_id"])).alias("doc_id")).where("doc_id is not null")
    split = ids.groupBy("doc_id").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high").select("doc_id", F.lit(True).alias("split"))
    marks = ids.join(split, "doc_id", "left").groupBy("uid").agg(F.count_if(F.col("split").isNull()).alias("plain"), F.count_if("split").cast("boolean").alias("split"))
    classes = classes.join(marks, "uid", "left").withColumns({"plain": F.coalesce("plain", F.lit(0)), "split": F.coalesce("split", F.lit(False))})
    classes = scratch.write(classes, "classes")
    scratch.drop("unmarked")
    groups = classes.groupBy("prefix_key").agg(F.min("uid").alias("grp"), F.min_by(F.struct("size", "alone", "prefix"), "uid").alias("s"), F.collect_list("uid").alias("classes"))
    groups = scratch.write(groups.select("grp", "classes", "s.*"), "groups")
    lists = groups.select("grp", "size", "alone", "prefix").mapInArrow(lean(_explode_prefix), "gram long, place int, grp long, size int")
    homes = lists.groupBy("gram").agg(F.min("grp").alias("home"), F.max("grp").alias("last"), F.count("*").alias("n")).where("home < last")
    homes = scratch.write(homes.select("gram", "home", "n"), "homes")
    wide = homes.groupBy("home").agg(F.ceil(F.sum("n") / CELL_POSTINGS).cast("int").alias("wide")).where("wide > 1")
    spot = lambda home, cells: F.pmod(F.xxhash64(home, cells), F.lit(4 * parts)).cast("int")
    placed = lists.join(homes.join(wide, "home", "left").select("gram", "home", F.coalesce("wide", F.lit(1)).alias("wide")), "gram")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("grp"), F.col("wide")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    placed = placed.withColumn("cells", F.shiftleft(F.least("cell", "with").cast("long"), 32) + F.greatest("cell", "with"))
    fields = ("gram", "cells", "cell", "grp", "size", "place")
    placed = placed.select(spot(F.col("home"), F.col("cells")).alias("spot"), *fields)
    zero = F.lit(0)
    inner = groups.where(F.size("classes") > 1).select(spot(F.col("grp"), zero.cast("long")).alias("spot"), zero.cast("long").alias("gram"), zero.cast("long").alias("cells"), zero.alias("cell"), "grp", F.col("size").cast("int"), F.lit(-1).alias("place"))
    placed = scratch.write(placed.unionByName(inner), "placed")
    members = groups.select(F.col("grp").alias("of"), F.posexplode("classes").alias("nth", "uid"))
    wanted = placed.select(F.col("spot").alias("at"), F.col("grp").alias("of")).distinct().join(members, "of")
    prefix = F.when(F.col("nth") == 0, F.col("prefix")).alias("prefix")  # once for each group
    blobs = wanted.join(classes.select("uid", "size", "prefix", "grams", "plain", "split"), "uid").select("at", F.col("of").alias("grp"), "uid", "size", "grams", "plain", "split", prefix)
    found = placed.groupBy("spot").cogroup(blobs.groupBy("at")).applyInArrow(lean_group(_verifier(threshold, pairs)), "a long, b long, jaccard double, links long")
    found = scratch.write(found if not pairs else found.where("jaccard is not null").drop("links"), "found")
    scratch.drop("groups", "homes", "placed")
    collect_garbage(spark)
    return classes.select(F.col("uid").alias("cls"), "members", "size", (F.length("grams") / 8).cast("long").alias("shared"), "plain", "split"), found


def inside(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, members, jaccard) of the classes whose own documents are near each other, mostly exact copies."""
    jaccard = F.col("shared") / (2 * F.col("size") - F.col("shared"))
    return classes.where(F.size("members") > 1).select("cls", "members", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """A row for each pair of near documents: doc_id, other_id (the greater id) and their jaccard."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    classes, found = near_classes(docs, scratch, n, threshold)
    known = F.filter(F.col("members")["doc_id"], lambda x: x.isNotNull())
    ids = classes.select("cls", known.alias("ids"))
    across = found.join(ids.select(F.col("cls").alias("a"), F.col("ids").alias("xs")), "a").join(ids.select(F.col("cls").alias("b"), F.col("ids").alias("ys")), "b")
    within = inside(classes, threshold).select(known.alias("xs"), known.alias("ys"), "jaccard")
    pairs = lambda df: df.select(F.explode("xs").alias("x"), "ys", "jaccard").select("x", F.explode("ys").alias("y"), "jaccard")
    pairs = pairs(across).where("x <> y").select("x", "y", "jaccard").unionByName(pairs(within).where("x < y"))
    return pairs.groupBy(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other_id")).agg(F.max("jaccard").alias("jaccard"))


def linked_documents(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """A row for each id that is near another: doc_id, class_id (the least id that a chain of links leads to) and links, the number of other ids near it."""
    scratch = Scratch(docs.sparkSession, "links")
    classes, found = near_classes(docs.where(F.col("doc_id").isNotNull()), scratch, n, threshold, pairs=False)
    within = inside(classes, threshold).select("cls", F.lit(1).alias("own"))
    ids = classes.select("cls", "plain", F.explode(F.array_distinct(F.col("members")["doc_id"])).alias("doc_id"), "split")
    split = ids.where("split").join(ids.where("split").groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high"), "doc_id")
    split = scratch.write(split.select("doc_id", "cls", "low"), "split")
    counts = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    # of an id in one class: the ids of near classes, and the others of its own, where copies are near each other
    sums = classes.join(counts, "cls", "left").join(within, "cls", "left").select("cls", "plain", (F.coalesce("links", F.lit(0)) + F.when(F.col("own") == 1, F.col("plain") - 1).otherwise(0)).alias("links"))
    each = ids.join(split.select("doc_id", "cls"), ["doc_id", "cls"], "left_anti").join(sums.select("cls", "links"), "cls").select("doc_id", "cls", "links")
    if not split.isEmpty():  # ids in several classes count once, however many of these are near
        near = found.where("jaccard is not null").select("a", "b")
        near = near.union(near.select("b", "a")).union(within.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        others = near.join(split.select(F.col("cls").alias("b"), F.col("doc_id").alias("other")), "b")
        more = others.groupBy(F.col("a").alias("cls")).agg(F.countDistinct("other").alias("more"))
        each = each.join(more, "cls", "left").select("doc_id", "cls", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))
        of = split.select("doc_id", F.col("cls").alias("a"))
        plain = of.join(near, "a").select("doc_id", F.col("b").alias("cls")).distinct().join(classes.select("cls", "plain"), "cls").groupBy("doc_id").agg(F.sum("plain").alias("p"))
        also = of.join(others, "a").where("doc_id <> other").groupBy("doc_id").agg(F.countDistinct("other").alias("q"))
        own = split.select("doc_id", F.col("low").alias("cls")).distinct()
        each = each.unionByName(own.join(plain, "doc_id", "left").join(also, "doc_id", "left").select("doc_id", "cls", (F.coalesce("p", F.lit(0)) + F.coalesce("q", F.lit(0))).alias("links")))
    each = scratch.write(each.where("links > 0"), "each")
    edges = found.where("b is not null").select("a", "b").union(within.select(F.col("cls").alias("a"), F.col("cls").alias("b"))).union(split.select(F.col("low").alias("a"), F.col("cls").alias("b")))
    rows = each.join(components(edges, scratch), F.col("cls") == F.col("node"))
    return rows.join(rows.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("doc_id", "class_id", "links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with an edge (a, b).

    Each round takes the least label of the neighbours and then the label of the label, so chains halve; scores go to the
    shared folder after each, until nothing changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = scratch.write(both, "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels0")
    for k in range(1, 200):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = scratch.write(own.join(jump, "next").select("node", F.least("next", "far").alias("label"), "old"), f"labels{k}")
        scratch.drop(f"labels{k - 2}")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def without_near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """The documents without all but the least id of each group of near copies (a connected component of the join).

    A null id is the greatest; of documents of one id the one of least hash is the least.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    classes, found = near_classes(docs, scratch, n, threshold, pairs=False)
    found = found.where("b is not null")
    loops = inside(classes, threshold).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    # classes whose members aren't near each other are joined through a near class, if they have one
    labels = components(found.select("a", "b").union(loops), scratch)
    rows = labels.join(classes.select(F.col("cls").alias("node"), "members"), "node").select("label", F.explode("members").alias("m"))
    order = F.struct(F.col("m.doc_id").isNull().alias("none"), "m.doc_id", "m.k1", "m.k2")
    least = rows.groupBy("label").agg(F.min(order).alias("least"))
    going = rows.join(least, "label").where(order != F.col("least")).select(F.col("m.k1").alias("_near_k1"), F.col("m.k2").alias("_near_k2"))
    going = scratch.write(going, "going")
    scratch.drop("classes", "found", "edges")
    small = going.count() * ROW_BYTES < BROADCAST_BYTES  # as it is in memory, not as Parquet
    k1, k2 = row_key(docs)
    return docs.join(F.broadcast(going) if small else going, (k1 == F.col("_near_k1")) & (k2 == F.col("_near_k2")), "left_anti")


_WORD = r"[\p{L}\p{N}_]+"

SQL = f"""
with recursive w as (select doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) as w from documents where text is not null and doc_id is not null),
g as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then ['~' || array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end)) as g from w),
s as (select doc_id, g, count(*) over (partition by doc_id) as n from g),
p as (select a.doc_id, b.doc_id as other_id, count(*) as c, any_value(a.n) as x, any_value(b.n) as y
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id and a.n >= 0.59 * b.n and b.n >= 0.59 * a.n group by a.doc_id, b.doc_id),
near as materialized (select doc_id, other_id from p where c::double / (x + y - c) >= 0.6),
e as materialized (select doc_id, other_id from near union all select other_id, doc_id from near),
r as (select doc_id, other_id from e union select r.doc_id, e.other_id from r join e on e.doc_id = r.other_id)
select doc_id, min(other_id) as class_id, (select count(*) from e where e.doc_id = r.doc_id) as links from r group by doc_id
"""
