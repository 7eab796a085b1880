"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` characters, and only documents are labelled. Each passage is encoded as
shares of pairs of neighbouring character classes (letter cases, digits, white space, each common symbol) and a few word
statistics, through a learned layer h = tanh(W x). Gated attention gives passage k the weight softmax(w . (tanh(V h_k) *
sigmoid(U h_k))), and a logistic unit scores the weighted sum of the h. All layers are trained together, by Adam on the
likelihood of document labels, over all labelled documents. These lie in shards of about ``SHARD`` by a hash of their ids,
each a packed row, so nothing depends on partitions. The first shard is fitted as a start; where there are more, each of
``len(RATES)`` rounds takes every shard through its documents by small batches, from one model, and the mean of the shards'
models, weighted by documents, is the next. Means and scales of features are those of all. A fifth of the labelled
documents is held out, and all its good ones set the threshold: no more than ``max_loss`` of them may score lower, and it
is at most 0.5.

Encoding and scoring are narrow, by Arrow batches, over every passage of every document; models, of fixed size, are summed
by tasks and in one, and broadcast. Class pairs know no language, so the model doesn't read words.

Defined results: a null or empty text has one empty passage and is scored like any other; null labels are ignored, and of
a document labelled twice the lower label holds; a labelled id of several rows is one document, of least text; repeated
rows are scored each; a null id is kept as null; without both
labels every score is 1. Other columns of either table are ignored, or kept by :func:`good_documents`.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.arrow import batch_of, lean, place_of, texts_at, texts_of
from siltbed.llm.scratch import Scratch
from siltbed.llm.text import chunks, code_points, words

PASSAGE = 512
SHARD = 2000
BATCH = 64
#: Rates of Adam in the rounds over all shards.
RATES = (0.01, 0.005, 0.0025)
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
_CLASSES = 20
_EXTRA = 5
SIZE = _CLASSES * _CLASSES + _EXTRA
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("threshold", pa.float64())])
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _KIND:
        table = np.full(0x110000, 19, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            table[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isalpha() else 4 if ch == "\n" else 5 if ch.isspace() else 19
        for k, ch in enumerate(".,;:!?'\"-|*#%"):
            table[ord(ch)] = 6 + k
        _KIND.append(table)
    return _KIND[0]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, index of its text)."""
    points, begins = code_points(texts)
    sizes = np.maximum(1, -(-(np.diff(begins) - 1) // PASSAGE))
    base = np.concatenate([[0], np.cumsum(sizes)])
    kind = _kinds()[points]
    kind[begins[1:] - 1] = 4
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    passage = base[doc] + np.minimum((np.arange(len(points)) - begins[doc]) // PASSAGE, sizes[doc] - 1)
    pair = kind[:-1] * _CLASSES + kind[1:]
    cells = _CLASSES * _CLASSES
    own = np.ones(len(pair), bool)
    own[begins[1:-1] - 1] = False  # a text's last separator and the next text's first character are no pair
    x = np.zeros((base[-1], SIZE), np.float32)
    x[:, :cells] = np.bincount((passage[:-1] * cells + pair)[own], minlength=base[-1] * cells).reshape(-1, cells)
    n = np.maximum(1, x[:, :cells].sum(1))
    x[:, :cells] = np.sqrt(x[:, :cells] / n[:, None])
    found = words(texts)
    if len(found.hashes):
        owner = found.owner
        own = base[owner] + np.minimum(found.begin // PASSAGE, sizes[owner] - 1)
        count = np.bincount(own, minlength=base[-1])
        many = np.maximum(1, count)
        same = np.flatnonzero((found.hashes[1:] == found.hashes[:-1]) & (own[1:] == own[:-1]))
        order = np.lexsort((found.hashes, own))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (own[order][1:] != own[order][:-1]) | (found.hashes[order][1:] != found.hashes[order][:-1])
        x[:, cells] = np.bincount(own[same + 1], minlength=base[-1]) / many
        x[:, cells + 1] = np.bincount(own[order][fresh], minlength=base[-1]) / many
        x[:, cells + 2] = np.bincount(own, found.end - found.begin, base[-1]) / many / 10
        x[:, cells + 3] = count / 100
    x[:, cells + 4] = n / PASSAGE
    return x, np.repeat(np.arange(len(texts)), sizes)


def forward(m: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
    """Everything from encodings to scores; ``bag`` ascends, and each of the ``bags`` has a passage."""
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    first = np.searchsorted(bag, np.arange(bags))
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["c0"], -30, 30))), "first": first}


def gradients(m: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, y: np.ndarray, balance: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted negative log likelihood, by each layer; ``x`` is standardised already."""
    f = forward(m, x, bag, len(y))
    d = ((f["score"] - y) * balance).astype(m["c"].dtype)
    gz = d[:, None] * m["c"]
    h, a, t, g = f["h"], f["a"], f["t"], f["g"]
    ga = (gz[bag] * h).sum(1)
    ge = a * (ga - np.add.reduceat(a * ga, f["first"])[bag])
    gtg = ge[:, None] * m["w"]
    gt, gg = gtg * g * (1 - t * t), gtg * t * g * (1 - g)
    gh = (a[:, None] * gz[bag] + gt @ m["V"].T + gg @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gg, "w": (t * g).T @ ge, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 160, rate: float = 0.02, decay: float = 1e-4) -> dict[str, np.ndarray]:
    random = np.random.default_rng(5)
    mean, scale = x.mean(0), x.std(0) + 0.02
    m = {"W": random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b": np.zeros(hidden), "V": random.normal(0, 0.3, (hidden, gate)), "U": random.normal(0, 0.3, (hidden, gate)), "w": random.normal(0, 0.3, gate), "c": random.normal(0, 0.3, hidden), "c0": np.zeros(1)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    xs, fixed = (x - mean) / scale, {"mean": np.float32(0), "scale": np.float32(1)}
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    for step in range(1, steps + 1):
        grads = gradients(m | fixed, xs, bag, y, balance)
        for k, v in grads.items():
            v = v + decay * m[k]
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m | {"mean": mean, "scale": scale}


def refine(m: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """``m`` after one pass of Adam over a shard, by batches of ``BATCH`` documents; ``weight`` of each label makes them equal over all shards."""
    own = {k: v for k, v in m.items() if k not in ("mean", "scale")}
    first, second = ({k: np.zeros_like(v) for k, v in own.items()} for _ in range(2))
    fixed = {"mean": np.float32(0), "scale": np.float32(1)}
    edges = np.searchsorted(bag, np.arange(len(y) + 1))
    for step, a in enumerate(range(0, len(y), BATCH), 1):
        b = min(a + BATCH, len(y))
        xs = ((x[edges[a] : edges[b]] - m["mean"]) / m["scale"]).astype(np.float32)
        grads = gradients(own | fixed, xs, bag[edges[a] : edges[b]] - a, y[a:b], (weight[y[a:b].astype(int)] / (b - a)).astype(np.float32))
        for k, v in grads.items():
            v = v + decay * own[k]
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            own[k] = (own[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m | own


_SHARD = pa.schema([("shard", pa.int64()), ("held", pa.bool_()), ("good", pa.int64()), ("bad", pa.int64()), ("y", pa.binary()), ("sizes", pa.binary()), ("x", pa.binary())])


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """All labelled documents, encoded, a row for each shard and whether it is held out: shard, held, good, bad, y, sizes, x."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(doc_id.alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    many = known.count()
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(1, -(-many // SHARD)))).alias("shard")
    chosen = known.select("doc_id", "y", shard, (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 4).alias("held"))
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen) if many * ROW_BYTES < BROADCAST_BYTES else chosen, "doc_id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "shard").groupBy("shard", "held", "doc_id", "y").agg(F.min("text").alias("text")).sortWithinPartitions("shard", "held", "doc_id")

    def packed(batches):
        key, ys, sizes, xs = None, [], [], []

        def row():
            y = np.array(ys, np.int8)
            return batch_of(_SHARD, [key[0]], [key[1]], [int(y.sum())], [int((y == 0).sum())], [y.tobytes()], [np.array(sizes, "<i8").tobytes()], [zstandard.compress(b"".join(xs), 1)])

        for batch in batches:
            texts, keys, y = texts_of(batch, "text"), list(zip(batch.column("shard").to_pylist(), batch.column("held").to_pylist())), batch.column("y").to_pylist()
            for a, b in chunks(texts):
                x, bag = encode(texts[a:b])
                edges = np.searchsorted(bag, np.arange(b - a + 1))
                for d in range(b - a):
                    if key is not None and keys[a + d] != key:
                        yield row()
                        ys, sizes, xs = [], [], []
                    key = keys[a + d]
                    ys.append(y[a + d])
                    sizes.append(edges[d + 1] - edges[d])
                    xs.append(x[edges[d] : edges[d + 1]].astype("<f2").tobytes())
        if key is not None:
            yield row()

    return scratch.write(rows.select("shard", "held", "y", "text").mapInArrow(lean(packed), "shard long, held boolean, good long, bad long, y binary, sizes binary, x binary"), "shards")


def _bags(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    x = np.frombuffer(zstandard.decompress(row["x"]), "<f2").reshape(-1, SIZE).astype(np.float32)
    return x, np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(row["y"], np.int8).astype(np.float32)


def _summed(rows: DataFrame, f) -> dict[str, np.ndarray] | None:
    """The sums of the arrays that ``f`` has for each row: by tasks, then in one."""

    def pack_up(total):
        np.savez(out := io.BytesIO(), **total)
        return pa.RecordBatch.from_pydict({"sums": [out.getvalue()]})

    def add(total, more):
        return {k: v + (total[k] if total else 0) for k, v in more.items()}

    def partial(batches):
        total = None
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time: a row is a shard
                total = add(total, f(batch.slice(k, 1).to_pylist()[0]))
        if total:
            yield pack_up(total)

    def whole(batches):
        total = None
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                total = add(total, dict(np.load(io.BytesIO(blob))))
        if total:
            yield pack_up(total)

    got = rows.mapInArrow(lean(partial), "sums binary").repartition(1).mapInArrow(lean(whole), "sums binary").collect()  # one row, of the model's fixed size
    return dict(np.load(io.BytesIO(bytes(got[0][0])))) if got else None


def train(docs: DataFrame, labels: DataFrame, max_loss: float = 0.005) -> dict[str, np.ndarray] | None:
    scratch = Scratch(docs.sparkSession, "classifier")
    shards = labelled(docs, labels, scratch)
    count = {r.held: (r.bad, r.good, r.n, r.least) for r in shards.groupBy("held").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("n"), F.min("shard").alias("least")).collect()}
    if not all(sum(c[k] for c in count.values()) for k in (0, 1)):
        return None
    apart = False in count and all(count[False][:2])
    some = shards.where(~F.col("held")) if apart else shards
    bad, good, n, least = count[False] if apart else [f(c[k] for c in count.values()) for k, f in enumerate((sum, sum, sum, min))]

    def moments(row):
        x = _bags(row)[0].astype(float)
        return {"n": np.array(float(len(x))), "sum": x.sum(0), "squares": (x * x).sum(0)}

    def start(row):
        x, bag, y = _bags(row)
        return {k: v.astype(float) for k, v in fit(x, bag, y).items()}

    first = some.where(F.col("shard") == least)
    model = _summed(first if apart else first.orderBy((F.col("good") + F.col("bad")).desc(), "shard", "held").limit(1), start)
    if n > 1:
        total = _summed(some, moments)
        mean = total["sum"] / total["n"]
        scale = np.sqrt(np.maximum(0, total["squares"] / total["n"] - mean * mean)) + 0.02
        # the same function of x, standardised by all
        W = model["W"] * (scale / model["scale"])[:, None]
        model |= {"W": W, "b": model["b"] + ((mean - model["mean"]) / model["scale"]) @ model["W"], "mean": mean, "scale": scale}
        weight = np.array([0.5, 0.5]) * (bad + good) / np.array([bad, good])
        for rate in RATES:
            now = {k: v.astype(np.float32) for k, v in model.items()}

            def step(row, now=now, rate=rate):
                x, bag, y = _bags(row)
                return {k: v.astype(float) * len(y) for k, v in refine(now, x, bag, y, weight, rate).items()}

            model = {k: v / (bad + good) for k, v in _summed(some, step).items()}
    model = {k: v.astype(np.float32) for k, v in model.items()}

    def judged(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, bag, y = _bags(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_pydict({"score": forward(model, x, bag, len(y))["score"][y == 1].astype(float)})

    held = shards.where("held") if apart and True in count else some
    least = int(max_loss * (count[True][1] if apart and True in count else good))
    at = held.mapInArrow(lean(judged), "score double").orderBy("score").limit(least + 1).agg(F.max("score")).collect()[0][0]  # one number
    scratch.drop("shards")
    return model | {"threshold": np.float64(0.5 if at is None else min(0.5, at))}


def _scores(model: dict[str, np.ndarray] | None, texts: list[str | None]) -> np.ndarray:
    out = np.ones(len(texts))
    if model is not None:
        for a, b in chunks(texts):
            x, bag = encode(texts[a:b])
            out[a:b] = forward(model, x, bag, b - a)["score"]
    return out


def scored(docs: DataFrame, labels: DataFrame, max_loss: float = 0.005) -> DataFrame:
    """Documents that the classifier accepts: doc_id, score, and the threshold that the score reaches."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_loss))

    def score(batches):
        at = float(shared.value["threshold"]) if shared.value else 0.0
        for batch in batches:
            s = _scores(shared.value, texts_of(batch, "text"))
            yield batch_of(_OUT, batch.column("doc_id"), s, np.full(len(s), at)).filter(pa.array(s >= at))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(score), "doc_id long, score double, threshold double")


def good_documents(docs: DataFrame, labels: DataFrame, max_loss: float = 0.005) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, judged row by row in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_loss))
    at = place_of(docs, "text")

    def keep(batches):
        least = float(shared.value["threshold"]) if shared.value else 0.0
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, texts_at(batch, at)) >= least))

    return docs.mapInArrow(lean(keep), docs.schema)
