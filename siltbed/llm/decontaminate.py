"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark text (questions and answers alike) is normalised to lower-case words with single spaces. All windows of
``gram`` words of every item, and the whole of an item that has fewer, go into one automaton, broadcast once (benchmarks
have a fixed size, whatever the corpus). A document is normalised the same way while each kept character remembers its
place, scanned once, and every hit is mapped back to the original text. Narrow: no shuffle, one pass.

Defined results: a null or empty document has no hits; a null or empty item is not looked for, nor one of
fewer words than a caller asks for; items with one text are all reported; repeated documents are reported row by row;
a null id, of a document or an item, is reported as null, and items without an id are one item. Other columns of either table are ignored.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of, lean, place_of, take_ids, texts_at, texts_of
from siltbed.llm.text import _tables, chunks, code_points, word_list

SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("passage", pa.string())])
DDL = "doc_id long, item_id long, start long, end long, passage string"


def _order(row: tuple) -> tuple:
    return tuple((False,) if x is None else (True, x) for x in row)


def patterns(items: list[tuple[int | None, str | None]], gram: int, min_words: int) -> dict[str, list[int | None]]:
    """Normalised pattern, with a space at each end -> items that hold it."""
    out: dict[str, list[int]] = {}
    for item, text in items:
        found = word_list(text)
        if len(found) >= min_words:
            for k in range(max(1, len(found) - gram + 1)):
                own = out.setdefault(f" {' '.join(found[k : k + gram])} ", [])
                if item not in own:
                    own.append(item)
    return out


def build(found: dict[str, list[int]]):
    automaton = ahocorasick.Automaton()
    for pattern, own in found.items():
        automaton.add_word(pattern, (len(pattern), own))
    automaton.make_automaton()
    return automaton


_BUILT: dict[str, object] = {}


def automaton_for(token: str, shared):
    """The automaton of a broadcast table of patterns, built once in each Python worker; None without patterns."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = build(shared.value) if shared.value else None
    return _BUILT[token]


def normalise(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """One normalised string for all texts; the place of each character among the code points; where each text begins.

    Runs of other characters become one space and texts are parted by a line break, which no pattern holds.
    """
    lower, is_word = _tables()
    points, begins = code_points(texts)
    word = is_word[points]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first character after a word stands for the run
    keep[begins[:-1]] = True  # and so does the first of a text, if it is no word
    place = np.flatnonzero(keep)
    out = np.where(word, lower[points], np.uint32(32))[place]
    heads = np.searchsorted(place, begins[:-1])
    ins = np.repeat(heads, 2)
    text = np.insert(out, ins, np.tile(np.array([10, 32], np.uint32), len(heads)))
    return text.tobytes().decode("utf-32-le", "surrogatepass"), np.insert(place, ins, np.repeat(begins[:-1], 2)), begins


def scan(texts: list[str | None], automaton) -> list[tuple[int, int | None, int, int]]:
    """(text index, item, begin, end) of each merged run of hits, in original characters."""
    text, place, begins = normalise(texts)
    hits: dict[tuple[int, int | None], list[list[int]]] = {}
    for stop, (size, items) in automaton.iter(text):
        first, last = place[stop - size + 2], place[stop - 1]
        doc = int(np.searchsorted(begins, first, "right")) - 1
        begin, end = int(first - begins[doc]), int(last - begins[doc]) + 1
        for item in items:
            runs = hits.setdefault((doc, item), [])
            if runs and begin <= runs[-1][1]:
                runs[-1][1] = max(end, runs[-1][1])
            else:
                runs.append([begin, end])
    return [(doc, item, b, e) for (doc, item), runs in sorted(hits.items(), key=lambda x: _order(x[0])) for b, e in runs]


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, gram: int = 13, min_words: int = 1) -> DataFrame:
    """One row for each passage of a benchmark item that a document holds: doc_id, item_id, start, end, passage.

    Items of fewer than ``min_words`` words are not looked for; by default all are.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    found = patterns(sorted(((r[0], r[1]) for r in items.distinct().collect()), key=_order), gram, min_words)
    shared, token = docs.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex

    def find(batches):
        automaton = automaton_for(token, shared)
        for batch in batches:
            texts, rows = texts_of(batch, "text"), []
            for a, b in chunks(texts) if automaton else ():
                rows += [(a + d, item, s, e, texts[a + d][s:e]) for d, item, s, e in scan(texts[a:b], automaton)]
            if rows:
                at, *rest = zip(*rows)
                yield batch_of(SCHEMA, take_ids(batch.column("doc_id"), at), *map(list, rest))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(find), DDL)


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_words: int, gram: int = 13) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns, judged row by row in one narrow pass.

    ``min_words`` is the caller's to choose: an item of fewer words, such as an answer of one, tells no leak by itself.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    found = patterns(sorted(((r[0], r[1]) for r in items.distinct().collect()), key=_order), gram, min_words)
    shared, token = docs.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex
    at = place_of(docs, "text")

    def keep(batches):
        automaton = automaton_for(token, shared)
        for batch in batches:
            texts = texts_at(batch, at)
            clean = np.ones(len(texts), bool)
            for a, b in chunks(texts) if automaton else ():
                for hit in scan(texts[a:b], automaton):
                    clean[a + hit[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(lean(keep), docs.schema)


_WORD = r"[\p{L}\p{N}_]+"
_OTHER = r"[^\p{L}\p{N}_]+"

SQL = f"""
with d as (select row_number() over () as rid, doc_id, text from documents where text is not null),
t as (select rid, doc_id, unnest(x) as t, unnest(range(len(x))) as i from (select rid, doc_id, regexp_extract_all(text, '{_WORD}|{_OTHER}') as x from d)),
o as (select *, (sum(length(t)) over (partition by rid order by i) - length(t))::bigint as b from t),
w as (select rid, doc_id, lower(t) as w, b, b + length(t) as e, row_number() over (partition by rid order by i) as k from o where regexp_full_match(t, '{_WORD}')),
l as (select rid, any_value(doc_id) as doc_id, list(w order by k) as w, list(b order by k) as b, list(e order by k) as e from w group by rid),
items as (select distinct item_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) as w from benchmark where text is not null),
grams as (select distinct item_id, least(len(w), 13) as m, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from items where len(w) > 0)),
windows as (select rid, doc_id, m, b[k] as b, e[k + m - 1] as e, array_to_string(w[k : k + m - 1], ' ') as gram
  from (select l.*, m, unnest(range(1, len(w) - m + 2)) as k from l, (select distinct m from grams))),
hits as (select rid, doc_id, item_id, b, e from windows join grams using (m, gram)),
runs as (select *, coalesce(b > max(e) over (partition by rid, item_id order by b, e rows between unbounded preceding and 1 preceding), true) as fresh from hits),
numbered as (select *, sum(fresh::int) over (partition by rid, item_id order by b, e rows unbounded preceding) as run from runs),
spans as (select rid, item_id, run, min(b) as b, max(e) as e from numbered group by rid, item_id, run)
select doc_id, item_id, b as start, e as "end", text[b + 1 : e] as passage from spans join d using (rid)
"""
