"""Token counts of documents without token ids.

A byte-pair encoder never merges across pre-tokens, so a document's count is the sum, over its distinct pre-tokens, of
frequency times pieces. Each task turns its documents into postings (pre-token -> documents and frequencies) by chunk
and sends each pre-token of a chunk once. They meet by pre-token, where each distinct pre-token is encoded once
and its piece count is joined to its postings in place; sums by chunk go back and are added up. A pre-token that many
documents of a chunk hold, such as the article of a language, has several such places, in proportion to its frequency, so
that no task gets all its postings; it is encoded once in each. What moves is
a few bytes for each (document, distinct pre-token), and nothing is broadcast but the vocabulary's path.

The whitespace class is spelled out, since regular-expression engines differ on it; the result equals that of encoding
each text whole. Defined results: a null or empty text has 0 tokens and 0 pre-tokens; each row of the table gets a row,
repeated rows and null ids too. Other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of, lean, lean_group, pack, texts_of, unpack

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
CHUNK = 2_000_000  # pre-tokens of a chunk; documents of one, at most 65,536
POSTING = np.dtype([("doc", "<u2"), ("freq", "<u4")])

SHARE = 8  # postings of a pre-token that a chunk sends to one place, on average over chunks
KNOWN = 1 << 20  # pre-tokens whose piece counts a task keeps

_SENT = pa.schema([("token", pa.string()), ("chunk", pa.int64()), ("salt", pa.int64()), ("postings", pa.binary())])
_PART = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pre_tokens", pa.int64())])


@lru_cache(2)
def encoder(path: str):
    """An encoder that takes its whole input as one pre-token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def salts(chunk: int, many: np.ndarray) -> np.ndarray:
    """Which of its places each pre-token's postings go to: one for a rare pre-token, more by powers of two for frequent ones."""
    places = 1 << np.ceil(np.log2(np.maximum(1, many / SHARE))).astype(np.int64)
    spread = ((chunk ^ (chunk >> 24)) * 0x9E3779B1) & 0x7FFFFFFF
    return spread % places + places  # the places of another power are others


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens of each document. ``vocabulary``: a rank file that every executor can read."""

    def postings(batches):
        import regex

        find = regex.compile(PRE_TOKEN).findall
        part, number = TaskContext.get().partitionId(), 0
        ids, valid, codes, lengths, known, size = [], [], [], [], {}, 0

        def flush():
            nonlocal number
            chunk = (part << 24) | number
            number += 1
            flat = np.concatenate(codes)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            key, freq = np.unique(flat * 65536 + doc, return_counts=True)
            rows = np.empty(len(key), POSTING)
            rows["doc"], rows["freq"] = key & 65535, freq
            many = np.bincount(key >> 16, minlength=len(known))
            ends = np.cumsum(many) * POSTING.itemsize
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
            yield batch_of(_SENT, list(known), np.full(len(known), chunk), salts(chunk, many), column)
            head = pack(np.array(valid)) + b""
            yield batch_of(_SENT, [None], [chunk], [0], [len(head).to_bytes(4, "little") + head + np.array(ids, np.int64).tobytes()])

        for batch in batches:
            column = batch.column("doc_id")
            for (doc_id, text), null in zip(zip(column.fill_null(0).to_pylist(), texts_of(batch, "text")), column.is_null().to_pylist()):
                found = find(text) if text else []
                ids.append(doc_id)
                valid.append(0 if null else 1)
                codes.append(np.fromiter((known.setdefault(t, len(known)) for t in found), np.int64, len(found)))
                lengths.append(len(found))
                size += len(found)
                if size >= CHUNK or len(ids) == 65536:
                    yield from flush()
                    ids, valid, codes, lengths, known, size = [], [], [], [], {}, 0
        if ids:
            yield from flush()

    def count(batches):
        encode, pieces, heads = encoder(vocabulary).encode_ordinary, {}, []
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            column = batch.column("postings")
            tokens = batch.column("token").to_pylist()
            numbers = np.zeros(len(tokens), np.int64)
            for k, token in enumerate(tokens):
                if token is None:
                    heads.append((int(chunk[k]), column[k].as_py()))
                    continue
                n = pieces.get(token)
                if n is None:
                    if len(pieces) >= KNOWN:
                        pieces.clear()
                    n = pieces[token] = len(encode(token))
                numbers[k] = n
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(tokens) + 1]
            for c in np.unique(chunk):
                rows = np.flatnonzero((chunk == c) & (numbers > 0))
                if not len(rows):
                    continue
                data = column.buffers()[2]
                got = [np.frombuffer(data, POSTING, (offsets[r + 1] - offsets[r]) // POSTING.itemsize, offsets[r]) for r in rows]
                each = np.repeat(numbers[rows], [len(g) for g in got])
                flat = np.concatenate(got)
                total = sums.setdefault(int(c), [np.zeros(0, np.int64), np.zeros(0, np.int64)])
                for i, weight in enumerate((each * flat["freq"], flat["freq"].astype(np.int64))):
                    add = np.bincount(flat["doc"], weight).astype(np.int64)
                    if len(total[i]) < len(add):
                        total[i] = np.concatenate([total[i], np.zeros(len(add) - len(total[i]), np.int64)])
                    total[i][: len(add)] += add
        for c, (tokens, pre) in sums.items():
            at = np.flatnonzero(pre)
            yield batch_of(_PART, [c], [pack(at, ascending=True)], [b"\1" + len(x := pack(tokens[at])).to_bytes(4, "little") + x + pack(pre[at])])
        for c, head in heads:
            yield batch_of(_PART, [c], [head], [b"\0"])

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        head = next(d for d, c in zip(rows["docs"], rows["counts"]) if c[:1] == b"\0")
        n = int.from_bytes(head[:4], "little")
        valid, ids = unpack(head[4 : 4 + n]).astype(bool), np.frombuffer(head[4 + n :], np.int64)
        tokens, pre = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for d, c in zip(rows["docs"], rows["counts"]):
            if c[:1] == b"\1":
                at, m = unpack(d).astype(np.int64), int.from_bytes(c[1:5], "little")
                tokens[at] += unpack(c[5 : 5 + m]).astype(np.int64)
                pre[at] += unpack(c[5 + m :]).astype(np.int64)
        return pa.Table.from_arrays([pa.array(ids, mask=~valid), pa.array(tokens), pa.array(pre)], schema=_OUT)

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(lean(postings), "token string, chunk long, salt long, postings binary")
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.when(F.col("token").isNull(), F.col("chunk")).otherwise(F.xxhash64("token", "salt")))
        .mapInArrow(lean(count), "chunk long, docs binary, counts binary")
        .groupBy("chunk")
        .applyInArrow(lean_group(add_up), "doc_id long, n_tokens long, n_pre_tokens long")
    )
