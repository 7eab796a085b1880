"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences, and only documents are labelled. A sentence's probability is logistic in hashed
features (each word, and each word's first five characters, so that inflected forms share evidence); a document's is
1 - product of (1 - p) over its sentences. The weights maximise the likelihood of document labels, with an L1 penalty,
over a bounded sample of labelled documents (``max_train`` of each label, those of least hash: the bound doesn't grow
with the corpus), so training has to work out by itself which sentences offend. A fifth of the sample is held out: it
picks the penalty among ``PENALTIES`` by likelihood, and sets the threshold, which at most ``max_false`` of its clean
documents may reach (kept between 0.05 and 0.5). The sample's features go to one executor task; the model, of fixed
size, is broadcast and every document is scored whole in one narrow pass.

Defined results: null or empty text has no sentence and isn't toxic; null labels are ignored, and of a document labelled
twice the higher label holds; a labelled id of several rows is one document of the sample; repeated rows are scored each;
a null id is reported as null; ties go by the threshold alone; without both labels in the sample nothing is reported, as
from an empty table. Other columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of, lean, pack, take_ids, texts_of, unpack
from siltbed.llm.text import chunks, code_points, mix, words

BITS = 20
#: L1 penalties that are tried, in units of 1 / documents: a feature of one document can pull with about so much.
PENALTIES = (0.12, 0.25, 0.5, 1.0)
PREFIX = 5
_ENDS = np.array([ord(c) for c in ".!?\n\r…。！？"], np.uint32)
DDL = "doc_id long, toxicity double, sentences array<struct<start:long,end:long,score:double,text:string>>"
_SENTENCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("sentences", pa.list_(_SENTENCE))])


class Bags:
    """Features of some texts: two for each word, sentences as runs of words, texts as runs of sentences."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        found = words(texts)
        short = words(texts, prefix=PREFIX)
        shift = np.uint64(64 - BITS)
        self.features = np.stack([mix(found.hashes) >> shift, mix(short.hashes + np.uint64(1)) >> shift]).astype(np.int64)
        points, begins = code_points(texts)
        ends = np.flatnonzero(np.isin(points, _ENDS))
        self.words, self.owner = found, found.owner
        absolute = begins[:-1][self.owner] + found.begin if len(self.owner) else np.zeros(0, np.int64)
        part = np.searchsorted(ends, absolute)
        fresh = np.ones(len(part), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.first = np.flatnonzero(fresh)
        self.sentence_owner = self.owner[self.first]

    def score(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each sentence, probability of each text)."""
        out = np.zeros(len(self.texts))
        if not len(self.first):
            return np.zeros(0), out
        z = np.add.reduceat(weights[self.features[0]] + weights[self.features[1]], self.first) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out = -np.expm1(np.bincount(self.sentence_owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(self.texts)))
        return p, out

    def span(self, sentence: int) -> tuple[int, int]:
        a = self.first[sentence]
        b = self.first[sentence + 1] - 1 if sentence + 1 < len(self.first) else len(self.owner) - 1
        return int(self.words.begin[a]), int(self.words.end[b])


class Sample:
    """Labelled bags laid end to end: the columns of their words' features, and the sentence and document of each word."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray, int]], used: np.ndarray | None = None):
        self.y = np.array([b[2] for b in bags], float)
        self.n = len(bags)
        flat = np.concatenate([np.zeros((2, 0), np.int64), *(b[0].reshape(2, -1) for b in bags)], 1)
        sizes = [int(b[1].max()) + 1 if len(b[1]) else 0 for b in bags]
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.sentence = np.concatenate([np.zeros(0, np.int64), *(b[1] + base[k] for k, b in enumerate(bags))])
        self.owner = np.repeat(np.arange(self.n), sizes)
        self.sentences = int(base[-1])
        self.used = np.unique(flat) if used is None else used
        index = np.full(1 << BITS, len(self.used))  # a feature that wasn't trained has the column past the last, of weight 0
        index[self.used] = np.arange(len(self.used))
        self.cols = index[flat]

    def chances(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each sentence, log probability that a document has no toxic one)."""
        w = np.append(w, 0.0)
        z = b + np.bincount(self.sentence, w[self.cols[0]] + w[self.cols[1]], self.sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p, np.bincount(self.owner, np.log1p(-np.minimum(p, 1 - 1e-9)), self.n)

    def loss(self, w: np.ndarray, b: float) -> float:
        """Mean negative log likelihood of the document labels."""
        none = self.chances(w, b)[1]
        return float(-np.where(self.y == 1, np.log(np.maximum(-np.expm1(none), 1e-12)), none).mean())

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p, none = self.chances(w, b)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        g = p * np.where(self.y == 1, -np.exp(none) / np.maximum(-np.expm1(none), 1e-9), 1.0)[self.owner] / self.n
        each = g[self.sentence]
        return sum(np.bincount(c, each, len(w) + 1) for c in self.cols)[: len(w)], float(g.sum())


def fit(data: Sample, l1: float, steps: int = 150, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the loss plus ``l1`` times the absolute weights, by proximal Adam.

    The penalty is applied in the metric of the step: a weight shrinks by l1 times the step's own scale, so a feature
    whose gradient stays under ``l1`` has weight 0.
    """
    w, b = np.zeros(len(data.used)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        gw, gb = data.gradient(w, b)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w = w - scale * (m / (1 - 0.9**step))
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale, 0)
        b -= rate / 3 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    return w, b


def chosen_model(bags: list[tuple[np.ndarray, np.ndarray, int]], max_false: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(features in use, weights, bias, threshold): every penalty is fitted to four fifths, the fifth picks one and the threshold.

    Where the fifth lacks a label, all of the sample stands in for it.
    """
    held = np.arange(len(bags)) % 5 == 4
    if any(len({bags[k][2] for k in np.flatnonzero(part)}) < 2 for part in (held, ~held)):
        held[:] = False
    data = Sample([bags[k] for k in np.flatnonzero(~held)])
    judge = Sample([bags[k] for k in np.flatnonzero(held)], data.used) if held.any() else data
    fits = [fit(data, c / data.n) for c in PENALTIES]
    w, b = min(fits, key=lambda f: judge.loss(*f))
    clean = np.sort(-np.expm1(judge.chances(w, b)[1])[judge.y == 0])
    at = float(np.nextafter(clean[len(clean) - 1 - int(max_false * len(clean))], 2.0))  # so few of the clean lie higher
    return data.used, w, b, min(0.5, max(0.05, at))


def sample(labels: DataFrame, column: str, most: int, worst) -> DataFrame:
    """(doc_id, y): at most ``most`` documents of each label 0 and 1, those whose ids hash least."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(worst(F.col(column)).cast("int").alias("y"))
    part = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most) for y in (0, 1)]
    return part[0].unionByName(part[1])


def one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the chosen ids, one row for each: of rows that repeat an id the one of least text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 1500, max_false: float = 0.01) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    chosen = sample(labels, "toxic", max_train, F.max)
    rows = one_each(docs, chosen)

    def encode(batches):
        for batch in batches:
            texts, ys = texts_of(batch, "text"), batch.column("y").to_pylist()
            for a, b in chunks(texts):
                bags = Bags(texts[a:b])
                sent = np.cumsum(np.isin(np.arange(len(bags.owner)), bags.first)) - 1
                for d in range(b - a):
                    lo, hi = bags.words.offsets[d], bags.words.offsets[d + 1]
                    s = sent[lo:hi] - (sent[lo] if hi > lo else 0)
                    yield pa.RecordBatch.from_pydict({"y": [ys[a + d]], "f": [pack(bags.features[:, lo:hi].ravel())], "s": [pack(s, ascending=True)]}, schema=pa.schema([("y", pa.int32()), ("f", pa.binary()), ("s", pa.binary())]))

    def learn(batches):
        bags = [(unpack(f).astype(np.int64).reshape(2, -1), unpack(s).astype(np.int64), y) for batch in batches for y, f, s in zip(*(batch.column(c).to_pylist() for c in ("y", "f", "s")))]
        if len({b[2] for b in bags}) == 2:
            bags.sort(key=lambda b: (b[0].shape[1], b[0].tobytes(), b[2]))  # whatever order they came in
            used, w, bias, at = chosen_model(bags, max_false)
            on = w != 0
            yield pa.RecordBatch.from_pydict({"model": [used[on].astype("<i8").tobytes() + w[on].astype("<f8").tobytes() + np.array([bias, at], "<f8").tobytes()]})

    got = rows.mapInArrow(lean(encode), "y int, f binary, s binary").repartition(1).mapInArrow(lean(learn), "model binary").collect()  # one row, of the model's fixed size
    if not got:
        return None
    raw = bytes(got[0][0])
    n = (len(raw) - 16) // 16
    bias, at = np.frombuffer(raw[-16:], "<f8").tolist()
    return np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n : 16 * n], "<f8"), bias, at


def toxic_documents(docs: DataFrame, labels: DataFrame, max_train: int = 1500, max_false: float = 0.01) -> DataFrame:
    """Documents whose toxicity reaches the threshold, and their offending sentences (as likely by themselves, or the worst)."""
    model = train(docs, labels, max_train, max_false)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        if shared.value is None:
            return
        used, values, bias, threshold = shared.value
        weights = np.zeros(1 << BITS)
        weights[used] = values
        for batch in batches:
            texts, at, total, found = texts_of(batch, "text"), [], [], []
            for a, b in chunks(texts):
                bags = Bags(texts[a:b])
                p, doc = bags.score(weights, bias)
                for d in np.flatnonzero(doc >= threshold):
                    own = np.flatnonzero(bags.sentence_owner == d)
                    bad = own[(p[own] >= threshold) | (p[own] == p[own].max())]
                    at.append(a + d)
                    total.append(float(doc[d]))
                    spans = [(bags.span(s), float(p[s])) for s in bad]
                    found.append([{"start": i, "end": j, "score": x, "text": texts[a + d][i:j]} for (i, j), x in spans])
            if at:
                yield batch_of(_OUT, take_ids(batch.column("doc_id"), at), total, pa.array(found, _OUT.field("sentences").type))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(score), DDL)
