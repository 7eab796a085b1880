"""Suffix-array deduplication: passages of ``min_words`` words or more that occur twice, by a distributed DC3.

Only text that can hold a repeat is sorted, by an exact filter: winnowing selects, of any ``min_words`` neighbouring
words, a gram at a place that depends on the words alone, so both copies of a passage have it; around every gram that
occurs once in the corpus nothing can repeat. (``filtered=False`` sorts all text instead; the result is the same.) What is left are segments of words; equal segments are one, with many
occurrences. Every segment ends in a terminator of its own, and segments live in blocks of about ``BLOCK_WORDS`` words.

The suffix array is built by the difference-cover algorithm over these blocks. Of each segment the triples at places 1
and 2 mod 3 are range-partitioned, sorted and named by rank; the names at 1 mod 3, then those at 2 mod 3, are the segments
of a string two thirds as long, and so on. A name of level k stands for 3^(k+1) words, so recursion ends with a plain sort
of all triples where they tell apart ``min_words`` words. Going back up, places at 0 mod 3 are
ordered by (word, rank of the next place) and merged with the rest by comparing (word, rank) to places 1 mod 3 and (word,
word, rank) to places 2 mod 3, within ranges of the leading four words. At level 0 neighbours in suffix order are compared by
a 64-bit fingerprint of their first ``min_words`` words: a run of equal ones is a repeated window. The first of a run, in the order of segments,
stays; the others are copies, and every word that a copy covers is one (but where a copy overlaps its own first, as in a
phrase said over and over, the words of the first stay). All that moves are packed blocks of integers; levels are tables in the shared folder and are
dropped once used, and the driver's garbage is collected between levels so that old shuffle files go.

Words are lower-cased runs of word characters, told apart by 40 bits of a hash. Defined results: null or empty text and
texts of fewer than ``min_words`` words have no repeats; rows equal in id and text are one document; a null id is a
document like others; ties (equal windows) fall to the order of segments, which depends on their content only; a passage
that repeats within a document counts, and its first stays; other columns are ignored, or kept by :func:`without_repeats`.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of, lean, lean_group, pack, place_of, take_ids, texts_at, texts_of, unpack
from siltbed.llm.scratch import Scratch, collect_garbage
from siltbed.llm.text import chunks, gram_hashes, winnow, words

BLOCK_WORDS = 250_000
PART_BLOCKS = 2
#: Leading words that cut the ranges of a merge: fewer would leave all that begins with a common pair in one part.
LEAD_WORDS = 4
#: Rows an Arrow batch where rows are blocks of words, of some MB each.
BATCH_BLOCKS = 16
_WORD_BITS = np.uint64((1 << 40) - 1)
_END = np.uint64(1 << 63)
_DOCS = ("_sa_uid", "text")
_SEGMENT = "_sa_uid long, start int, n int, key binary, toks binary"

_KEYS = ("k0", "k1", "k2", "k3", "k4", "k5")
_SORT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), *[(k, pa.binary()) for k in _KEYS]])
_NAMED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("name", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("toks", pa.binary()), ("ends", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kind = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


@contextmanager
def few_rows(spark, rows: int = BATCH_BLOCKS):
    """Arrow batches of so many rows at most, for what is run within: a batch is in memory four times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def each_row(batches):
    """Rows as dicts, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


# --- arrays of one block -------------------------------------------------------------------------------------------


class Layout:
    """Segments of a block: each place's segment, place within it, and what follows it (0 past the segment's end)."""

    def __init__(self, toks: np.ndarray, ends: np.ndarray):
        self.toks, self.ends = toks, ends
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.starts, self.sizes = starts, ends - starts
        self.segment = np.repeat(np.arange(len(ends)), self.sizes)
        self.local = np.arange(len(toks)) - starts[self.segment]
        self.left = ends[self.segment] - np.arange(len(toks))

    def ahead(self, values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(values), values.dtype)
        if by < len(values):
            out[:-by] = np.where(self.left[:-by] > by, values[by:], 0)
        return out

    def sampled(self) -> np.ndarray:
        return np.flatnonzero(self.local % 3 != 0)

    def next_level(self) -> tuple[np.ndarray, np.ndarray]:
        """(places in this string of the next one's characters, ends of its segments)."""
        at = self.sampled()
        order = np.lexsort((at, self.local[at] % 3, self.segment[at]))
        at = at[order]
        key = self.segment[at] * 3 + self.local[at] % 3
        return at, np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(at)).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def merge(cls: np.ndarray, t0: np.ndarray, t1: np.ndarray, r0: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Order of suffixes by DC3's comparisons: the index of each in order."""
    n = len(cls)
    a, b, c = (np.flatnonzero(cls == k) for k in (0, 1, 2))
    s = np.flatnonzero(cls != 0)
    s = s[np.argsort(r0[s], kind="stable")]
    a = a[np.lexsort((r1[a], t0[a]))]

    def before(other: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        both = np.concatenate([other, a])
        order = np.lexsort((np.arange(len(both)), *[k[both] for k in keys]))
        mine = order >= len(other)
        out = np.empty(len(a), np.int64)
        out[order[mine] - len(other)] = np.cumsum(~mine)[mine]
        return out

    ahead = np.maximum.accumulate(before(b, r1, t0) + before(c, r2, t1, t0)) if len(a) else np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    spots = ahead + np.arange(len(a))
    free = np.ones(n, bool)
    free[spots] = False
    out[spots] = a
    out[free] = s
    return out


# --- one distributed sort ------------------------------------------------------------------------------------------


def _split(keys: list[np.ndarray], splitters: list[tuple[int, ...]]) -> np.ndarray:
    """Where sorted keys are cut by the splitters."""
    out = []
    for s in splitters:
        lo, hi = 0, len(keys[0])
        for k, v in zip(keys, s):
            part = k[lo:hi]
            lo, hi = lo + int(np.searchsorted(part, np.uint64(v), "left")), lo + int(np.searchsorted(part, np.uint64(v), "right"))
        out.append(lo)
    return np.array(out, np.int64)


class Sorter:
    """Range-partitioned sorts of packed keys of blocks; the latest result is a table in the shared folder.

    A part is sorted in memory, and holds about ``PART_BLOCKS`` blocks of words: each block sends a row to each part, so
    parts that follow the size of all input, of which little is sorted, would make rows that hold next to nothing.
    """

    def __init__(self, scratch: Scratch, parts: int):
        self.scratch, self.parts, self.n = scratch, max(1, parts), 0

    def splitters(self, blocks: DataFrame, keys_of, lead: int) -> list[tuple[int, ...]]:
        """Cuts from a sample of 40 keys a part, as any range partitioning takes; they balance, and decide nothing.

        Of more blocks than that a sample is taken too, by a hash, so that what the driver gets depends on the parts alone.
        """
        some, count = blocks.select("block", "toks", "ends"), max(1, blocks.count())
        most = 5 * self.parts
        if count > most:
            some = some.where(F.pmod(F.xxhash64("block"), F.lit(1 << 30)) < F.lit(int(most / count * (1 << 30))))
        each = max(8, 40 * self.parts // min(count, most))

        def pick(batches):
            for row in each_row(batches):
                _, keys = keys_of(row)
                at = np.linspace(0, len(keys[0]) - 1, min(each, len(keys[0]))).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"k": [np.stack([k[at] for k in keys[:lead]], 1).tobytes()]})

        with few_rows(blocks.sparkSession):
            got = [np.frombuffer(bytes(r[0]), np.uint64).reshape(-1, lead) for r in some.mapInArrow(lean(pick), "k binary").collect()]
        found = sorted(map(tuple, np.concatenate(got).tolist())) if got else []
        return sorted({found[len(found) * k // self.parts] for k in range(1, self.parts)}) if found else []

    def run(self, source: DataFrame, cuts: list[tuple[int, ...]], keys_of, order_of, finish, lead_of=None) -> DataFrame:
        """keys_of(row) -> (places, keys); lead_of(row) -> (places, what the cuts have), both in its order, or the keys
        themselves begin with that; order_of(keys) -> order; finish -> rows back."""
        lead = len(cuts[0]) if cuts else 1

        def send(batches):
            for row in each_row(batches):
                at, keys = keys_of(row)
                edges = np.concatenate([[0], _split((lead_of(row)[1] if lead_of else keys)[:lead], cuts), [len(at)]]).astype(np.int64)
                none = [None] * (len(_KEYS) - len(keys))
                rows = [(k, row["block"], pack(at[a:b]), *(pack(x[a:b], ascending=i == 0) for i, x in enumerate(keys)), *none) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
                del keys
                if rows:  # one batch for a block
                    yield batch_of(_SORT, *zip(*rows))

        def sort(batches):
            rows: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    rows.setdefault(row["bucket"], []).append(row)
            for bucket in sorted(rows):
                own = sorted(rows.pop(bucket), key=lambda r: r["block"])
                many = sum(own[0][k] is not None for k in _KEYS)
                at = [unpack(r.pop("at")) for r in own]
                block = np.repeat(np.array([r["block"] for r in own]), [len(x) for x in at])
                at = np.concatenate(at)
                keys = [np.concatenate([unpack(r.pop(k)) for r in own]) for k in _KEYS[:many]]
                del own
                yield from finish(bucket, block, at, keys, order_of(keys))

        self.n += 1
        with few_rows(source.sparkSession):
            return self.scratch.write(source.mapInArrow(lean(send), _ddl(_SORT)).repartitionById(self.parts, "bucket").mapInArrow(lean(sort), _ddl(_NAMED)), f"sorted{self.n}")


def _named(bucket: int, block: np.ndarray, at: np.ndarray, rank: np.ndarray, count: int):
    """Rows that take names back to their blocks, and one that counts the bucket's names."""
    order = np.lexsort((at, block))
    block, at, rank = block[order], at[order], rank[order]
    edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
    rows = [(bucket, block[a], pack(at[a:b], ascending=True), pack(rank[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    yield batch_of(_NAMED, *zip(*rows, (bucket, -1, None, int(count).to_bytes(8, "little"))))


def _dense(bucket, block, at, keys, order):
    new = np.zeros(len(order), np.int64)
    for k in keys[:3]:
        v = k[order]
        new[1:] |= v[1:] != v[:-1]
    rank = np.empty(len(order), np.int64)
    names = np.cumsum(new)
    rank[order] = names
    yield from _named(bucket, block, at, rank, int(names[-1]) + 1)


def _places(bucket, block, at, keys, order):
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    yield from _named(bucket, block, at, rank, len(order))


def _offsets(named: DataFrame) -> dict[int, int]:
    rows = sorted((r[0], int.from_bytes(bytes(r[1]), "little")) for r in named.where("block = -1").select("bucket", "name").collect())  # one row a partition
    out, total = {}, 1
    for bucket, count in rows:
        out[bucket] = total
        total += count
    return out


def _with_names(blocks: DataFrame, named: DataFrame, offsets: dict[int, int], build, ddl: str) -> DataFrame:
    """build(block row, places, names) for each block and all names of it."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        rows = right.to_pylist()
        at = [unpack(r["at"]) for r in rows]
        name = [unpack(r["name"]) + np.uint64(offsets[r["bucket"]]) for r in rows]
        none = np.zeros(0, np.uint64)
        return build(row, np.concatenate([none, *at]).astype(np.int64), np.concatenate([none, *name]))

    names = named.where("block >= 0").withColumnRenamed("block", "of")
    return blocks.groupBy("block").cogroup(names.groupBy("of")).applyInArrow(lean_group(join), ddl)


def _layout(row: dict) -> Layout:
    return Layout(unpack(row["toks"]), unpack(row["ends"]).astype(np.int64))


def _triples(row: dict, every: bool):
    lay = _layout(row)
    keys = [lay.toks, lay.ahead(lay.toks, 1), lay.ahead(lay.toks, 2)]
    at = np.arange(len(lay.toks)) if every else lay.sampled()
    keys = [k[at] for k in keys]
    order = np.lexsort(keys[::-1])
    return at[order], [k[order] for k in keys]


def _lead(row: dict):
    """(places, their first ``LEAD_WORDS`` words) in the order of those."""
    lay = _layout(row)
    keys = [lay.toks, *(lay.ahead(lay.toks, k) for k in range(1, LEAD_WORDS))]
    order = np.lexsort(keys[::-1])
    return order, [k[order] for k in keys]


def _merge_keys(row: dict, min_words: int | None):
    """What DC3's merge compares; at level 0, with ``min_words``, the hash of the window too."""
    lay, ranks = _layout(row), unpack(row["ranks"])
    t1 = lay.ahead(lay.toks, 1)
    order, _ = _lead(row)
    cls = (lay.local % 3).astype(np.uint64)
    # places 0 mod 3 have no rank yet; the class rides in the low bits
    keys = [lay.toks, t1, ranks * np.uint64(4) + cls, lay.ahead(ranks, 1) * (cls < 2), lay.ahead(ranks, 2) * (cls != 1)]
    if min_words:
        window = np.zeros(len(lay.toks), np.uint64)
        whole = gram_hashes(lay.toks, min_words)
        window[: len(whole)] = np.maximum(whole, np.uint64(1))
        window[lay.left <= min_words] = 0  # the terminator is none of the words
        keys.append(window)
    return order, [k[order] for k in keys]


def _merge_order(keys: list[np.ndarray]) -> np.ndarray:
    return merge((keys[2] & np.uint64(3)).astype(np.int64), keys[0], keys[1], keys[2] >> np.uint64(2), keys[3], keys[4])


# --- the suffix array ----------------------------------------------------------------------------------------------


def sort_parts(blocks: int, parts: int, cores: int) -> int:
    """Parts of a sort of so many blocks: at least two for each core, and no more than twice the session's own."""
    return min(2 * parts, max(2 * cores, -(-blocks // PART_BLOCKS)))


def suffix_runs(blocks: DataFrame, scratch: Scratch, min_words: int, parts: int) -> DataFrame:
    """(bucket, block, at, name): windows of ``min_words`` that have an equal; name is 1 for a run's first, 2 for a
    copy, 3 for a copy that overlaps the first.

    ``blocks``: (block, toks, ends). At least one level of recursion is taken.
    """
    spark = blocks.sparkSession
    sorter = Sorter(scratch, sort_parts(blocks.count(), parts, spark.sparkContext.defaultParallelism))
    levels, reach = [blocks], 3

    def descend(row, at, name):
        ends = unpack(row["ends"]).astype(np.int64)
        lay = Layout(np.zeros(int(ends[-1]), np.uint64), ends)
        lay.toks[at] = name
        places, ends = lay.next_level()
        return pa.Table.from_pydict({"block": [row["block"]], "toks": [pack(lay.toks[places])], "ends": [pack(ends, ascending=True)]}, schema=_BLOCK)

    while True:
        last = len(levels) > 1 and reach >= min_words  # this level's triples tell enough apart: sort them all
        level = levels[-1]
        keys_of = lambda row, every=last: _triples(row, every)
        named = sorter.run(level, sorter.splitters(level, keys_of, 3), keys_of, lambda keys: np.lexsort(keys[2::-1]), _dense)
        offsets = _offsets(named)
        if last:
            break
        levels.append(scratch.write(_with_names(level.select("block", "ends"), named, offsets, descend, _ddl(_BLOCK)), f"level{len(levels)}"))
        scratch.drop(f"sorted{sorter.n}")
        collect_garbage(spark)
        reach *= 3

    ranked_schema = pa.schema([*_BLOCK, ("ranks", pa.binary())])

    def ranked(row, at, name):
        """The sample's ranks at its places; the string below has a character for each of them."""
        lay = _layout(row)
        places, _ = lay.next_level()
        ranks = np.zeros(len(lay.toks), np.uint64)
        ranks[places[at]] = name
        return pa.Table.from_pydict({k: [row[k]] for k in ("block", "toks", "ends")} | {"ranks": [pack(ranks)]}, schema=ranked_schema)

    for depth in range(len(levels) - 2, -1, -1):
        before, level = sorter.n, levels[depth]
        cuts = sorter.splitters(level, _lead, LEAD_WORDS)
        windows = None if depth else min_words
        source = _with_names(level, named, offsets, ranked, _ddl(_BLOCK) + ", ranks binary")
        named = sorter.run(source, cuts, lambda row, w=windows: _merge_keys(row, w), _merge_order, _places if depth else (lambda *args: _runs(*args, min_words)), _lead)
        offsets = _offsets(named) if depth else {}
        scratch.drop(f"sorted{before}", f"level{depth + 1}")
        collect_garbage(spark)
    return named


def _runs(bucket, block, at, keys, order, min_words):
    """Neighbours in suffix order with equal windows: the first (1), copies (2), and copies that overlap their first (3)."""
    window = keys[5][order]
    same = (window[1:] == window[:-1]) & (window[1:] != 0)
    on = np.zeros(len(order), bool)
    on[1:] |= same
    on[:-1] |= same
    run = np.cumsum(np.concatenate([[True], ~same]))[on]
    own = order[on]
    if not len(own):
        return
    place, blk = at[own].astype(np.int64), block[own]
    by = np.lexsort((place, blk, run))
    first = np.ones(len(by), bool)
    first[1:] = run[by][1:] != run[by][:-1]
    place, blk = place[by], blk[by]
    head = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    kind = np.where(first, 1, np.where((blk == blk[head]) & (place - place[head] < min_words), 3, 2))
    back = np.lexsort((place, blk))
    place, blk, kind = place[back], blk[back], kind[back]
    edges = np.concatenate([[0], np.flatnonzero(blk[1:] != blk[:-1]) + 1, [len(blk)]])
    rows = [(bucket, blk[a], pack(place[a:b], ascending=True), pack(kind[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    yield batch_of(_NAMED, *zip(*rows))


# --- from documents to segments and back ---------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("_sa_uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _runs_of(mask: np.ndarray) -> np.ndarray:
    """[begin, end) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _cover(places: np.ndarray, size: int, width: int) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + width, size), -1)
    return np.cumsum(change[:-1]) > 0


def repeats(docs: DataFrame, scratch: Scratch, min_words: int = 50, filtered: bool = True) -> DataFrame:
    """(_sa_uid, copies, firsts): of each document with repeats, the word ranges, as flat arrays of begins and ends.

    Without ``filtered`` the suffix array is built over whole documents.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = (min_words + 1) // 2
    w = min_words - k + 1

    def fingerprints(batches):
        schema = pa.schema([("gram", pa.int64()), ("_sa_uid", pa.int64()), ("place", pa.int32())])
        for batch in batches:
            texts, uid = texts_of(batch, "text"), batch.column("_sa_uid").to_numpy()
            for a, b in chunks(texts):
                doc, place, gram = winnow(words(texts[a:b]), k, w)
                yield batch_of(schema, gram.view(np.int64), uid[a:b][doc], place.astype(np.int32))

    own = _keyed(docs)

    def filtered_spots() -> DataFrame:
        """(_sa_uid, places) of the fingerprints that occur twice; a hot one is counted by parts and joined by parts."""
        grams = scratch.write(own.select(*_DOCS).mapInArrow(lean(fingerprints), "gram long, _sa_uid long, place int"), "grams")
        twice = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        spots = scratch.write(grams.join(twice, "gram").groupBy("_sa_uid").agg(F.collect_set("place").alias("places")), "spots")
        scratch.drop("grams")
        collect_garbage(spark)
        return spots

    segment = pa.schema([("_sa_uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("toks", pa.binary())])

    def segments(batches):
        for batch in batches:
            texts, uid, places = texts_of(batch, "text"), batch.column("_sa_uid").to_pylist(), batch.column("places")
            for a, b in chunks(texts):
                found = words(texts[a:b])
                rows = []
                for d in range(b - a):
                    flat = found.hashes[found.offsets[d] : found.offsets[d + 1]] & _WORD_BITS
                    at = np.maximum(places[a + d].values.to_numpy().astype(np.int64) - (min_words - k), 0)
                    for s, e in _runs_of(_cover(at, len(flat), 2 * min_words - k)):
                        rows.append((uid[a + d], s, e - s, xxhash.xxh128_digest(flat[s:e].tobytes()), pack(flat[s:e])))
                if rows:
                    yield batch_of(segment, *map(list, zip(*rows)))

    def whole(batches):
        for batch in batches:
            texts, uid = texts_of(batch, "text"), batch.column("_sa_uid").to_pylist()
            for a, b in chunks(texts):
                found = words(texts[a:b])
                flat = [found.hashes[found.offsets[d] : found.offsets[d + 1]] & _WORD_BITS for d in range(b - a)]
                rows = [(uid[a + d], 0, len(f), uid[a + d].to_bytes(16, "little", signed=True), pack(f)) for d, f in enumerate(flat) if len(f) >= min_words]
                if rows:
                    yield batch_of(segment, *map(list, zip(*rows)))

    if filtered:
        pieces = own.join(filtered_spots(), "_sa_uid").select(*_DOCS, "places").mapInArrow(lean(segments), _SEGMENT)
    else:
        pieces = own.select(*_DOCS).mapInArrow(lean(whole), _SEGMENT)
    parts_of = scratch.write(pieces, "segments")
    scratch.drop("spots")
    occurs = parts_of.select("_sa_uid", "start", "n", "key").distinct()

    def blocks(batches):
        part, number, toks, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal number
            block = (part << 20) | number
            number += 1
            out = []
            for s, t in enumerate(toks):
                out += [t, np.array([_END | np.uint64(block << 22 | s)], np.uint64)]
            ends = np.cumsum([len(t) + 1 for t in toks])
            return pa.RecordBatch.from_pydict({"block": [block], "toks": [pack(np.concatenate(out))], "ends": [pack(ends, ascending=True)], "keys": [b"".join(keys)]}, schema=pa.schema([*_BLOCK, ("keys", pa.binary())]))

        for batch in batches:
            for key, tok in zip(batch.column("key").to_pylist(), batch.column("toks").to_pylist()):
                toks.append(unpack(tok))
                keys.append(key)
                size += len(toks[-1]) + 1
                if size >= BLOCK_WORDS or len(toks) == 1 << 22:
                    yield flush()
                    toks, keys, size = [], [], 0
        if toks:
            yield flush()

    different = parts_of.select("key", "toks").dropDuplicates(["key"]).sortWithinPartitions("key")
    table = scratch.write(different.mapInArrow(lean(blocks), _ddl(_BLOCK) + ", keys binary"), "blocks")
    occurs = scratch.write(occurs, "occurs")
    scratch.drop("segments")
    collect_garbage(spark)
    runs = suffix_runs(table.select("block", "toks", "ends"), scratch, min_words, parts)

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each segment that has any: the ranges of its windows that are first, and of those that are copies."""
        row, out = left.to_pylist()[0], []
        ends = unpack(row["ends"]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        kind = np.zeros(int(ends[-1]), np.int8)
        for r in right.to_pylist():
            kind[unpack(r["at"]).astype(np.int64)] = unpack(r["name"])
        for s in np.unique(np.searchsorted(ends, np.flatnonzero(kind), "right")):
            mine = kind[starts[s] : ends[s] - 1]
            first, copy, lap = (_cover(np.flatnonzero(mine == v), len(mine), min_words) for v in (1, 2, 3))
            copy |= lap & ~first  # a phrase said over and over keeps one window
            out.append((row["keys"][16 * s : 16 * s + 16], *(_runs_of(m).ravel().tolist() for m in (first & ~copy, copy))))
        cols = list(zip(*out)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32()))], names=["key", "firsts", "copies"])

    spans = table.select("block", "ends", "keys").groupBy("block").cogroup(runs.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(lean_group(judged), "key binary, firsts array<int>, copies array<int>")
    spans = scratch.write(spans, "spans")
    scratch.drop("blocks")
    equal = occurs.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("_sa_uid", "start")).alias("head"))
    each = occurs.join(equal.join(spans, "key", "left").where("many > 1 or firsts is not null"), "key")
    later = F.struct("_sa_uid", "start") != F.col("head")
    none, entire = F.array().cast("array<int>"), F.array(F.lit(0), F.col("n"))
    # of equal segments the first stands for all; in the others every word is a copy
    copies = F.when(later, entire).otherwise(F.coalesce("copies", none))
    firsts = F.when(later, none).when(F.col("many") > 1, entire).otherwise(F.coalesce("firsts", none))
    moved = each.select("_sa_uid", F.transform(copies, lambda x: x + F.col("start")).alias("copies"), F.transform(firsts, lambda x: x + F.col("start")).alias("firsts"))
    result = scratch.write(moved.groupBy("_sa_uid").agg(F.flatten(F.collect_list("copies")).alias("copies"), F.flatten(F.collect_list("firsts")).alias("firsts")), "repeats")
    scratch.drop("occurs", "spans", *[f"sorted{n}" for n in range(1, 30)])
    return result


def _masks(n: int, copies: list[int], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(words of copies, other words of first windows)."""
    out = []
    for spans in (copies, firsts):
        mask = np.zeros(n, bool)
        for s, e in zip(spans[::2], spans[1::2]):
            mask[s:e] = True
        out.append(mask)
    return out[0], out[1] & ~out[0]


_SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("is_copy", pa.bool_())])


def repeated_passages(docs: DataFrame, min_words: int = 50, filtered: bool = True) -> DataFrame:
    """A row for each run of words of a document that repeats: doc_id, start, end (characters), n_words, is_copy."""
    scratch = Scratch(docs.sparkSession, "repeats")
    found = repeats(docs, scratch, min_words, filtered)

    def locate(batches):
        for batch in batches:
            texts, copies, firsts = texts_of(batch, "text"), batch.column("copies").to_pylist(), batch.column("firsts").to_pylist()
            rows = []
            for a, b in chunks(texts):
                w = words(texts[a:b])
                for d in range(b - a):
                    lo, hi = w.offsets[d], w.offsets[d + 1]
                    for mask, is_copy in zip(_masks(hi - lo, copies[a + d], firsts[a + d]), (True, False)):
                        rows += [(a + d, int(w.begin[lo + s]), int(w.end[lo + e - 1]), int(e - s), is_copy) for s, e in _runs_of(mask)]
            if rows:
                at, *rest = zip(*rows)
                yield batch_of(_SPAN, take_ids(batch.column("doc_id"), at), *map(list, rest))

    return _keyed(docs).join(found, "_sa_uid").select("doc_id", "text", "copies", "firsts").mapInArrow(lean(locate), "doc_id long, start long, end long, n_words long, is_copy boolean")


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents with the copies of repeated passages cut out of their text, and ``n_chars``, if there, counted anew.

    A document of which no word is left goes; one without copies is untouched.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    found = repeats(docs, scratch, min_words).where("size(copies) > 0")
    names = docs.columns
    uid = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    side = found.select(F.col("_sa_uid"), F.col("copies").alias("_sa_copies"), F.col("firsts").alias("_sa_firsts"))
    both = docs.withColumn("_sa_key", uid)
    both = both.join(side, both["_sa_key"] == side["_sa_uid"], "left").select(*names, "_sa_copies", "_sa_firsts")
    text_at, chars_at = place_of(docs, "text"), place_of(docs, "n_chars", False)

    def cut(batches):
        for batch in batches:
            copies, firsts = batch.column("_sa_copies").to_pylist(), batch.column("_sa_firsts").to_pylist()
            texts = texts_at(batch, text_at)
            keep = np.ones(len(texts), bool)
            changed = False
            for d in [i for i, c in enumerate(copies) if c]:
                w = words([texts[d]])
                n = len(w.begin)
                gone, _ = _masks(n, copies[d], firsts[d])
                if not gone.any():
                    continue
                changed, parts, at = True, [], 0
                keep[d] = not gone.all()
                for s, e in _runs_of(gone):
                    parts.append(texts[d][at : int(w.begin[s])])
                    at = int(w.begin[e]) if e < n else len(texts[d])
                texts[d] = "".join([*parts, texts[d][at:]])
            columns = [batch.column(i) for i in range(len(names))]
            if changed:
                columns[text_at] = pa.array(texts, pa.string()).cast(columns[text_at].type)
                if chars_at is not None:
                    count = [c if not g else len(t or "") for c, g, t in zip(columns[chars_at].to_pylist(), copies, texts)]
                    columns[chars_at] = pa.array(count, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return both.mapInArrow(lean(cut), docs.schema)
