"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every unit (word, run of signs, mark of a capitalised or upper-case word) has a fixed sparse random index
vector, hashed from its bucket. A unit's vector is the sum of the index vectors of its neighbours over the
whole corpus; partial sums of whole numbers are added up by slices of the bucket table, so the result does
not depend on order. The table has BUCKETS rows, whatever the input. A document is the mean of its units'
vectors with frequent units weighted down. A two-layer network in numpy is fitted on at most SAMPLE
labelled documents, taken in hashed order of doc_id, and its temperature on a tenth of them held out of
the fitting; score is the calibrated probability of label 1.

Defined cases: null and empty texts pool to a vector of zeros and get a score like any other; repeated
rows are scored alike; a document with several labels counts with the smallest; documents without a label
are scored but not learned from; with labels of one kind only, all scores are that share of label 1 (0.5 with
no labels at all); a row without doc_id is scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, stored

BUCKETS = 1 << 15
DIM = 32
NONZERO = 2
WINDOW = 2
SLICES = 32
FAN = 32  # partial sums one task adds up
SAMPLE = 20_000
HIDDEN = 16
SMOOTH = 1e-2
KEEP = 0.3
CACHE_WORDS = 300_000
_UNITS = re.compile(r"[^\W_]+|[\W_]+")


def bucket_of(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "replace")) % BUCKETS


def units_of(word: str) -> list[str]:
    """Lower-case words, runs of signs (at most four of them count), and a mark before a capitalised or upper-case word."""
    out = []
    for u in _UNITS.findall(word):
        if u[0].isalnum():
            low = u.lower()
            if u != low:
                out.append("<all>" if len(u) > 1 and u == u.upper() else "<cap>")
            out.append("<num>" if u.isdigit() else low)
        else:
            out.append(u[:4])
    return out


class Units:
    """Bucket numbers of a text's units, from a cache of white-space words that is emptied when full."""

    def __init__(self):
        self.cache: dict[str, bytes] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        try:
            return np.frombuffer(b"".join(map(self.cache.get, words)), np.int32)
        except TypeError:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            for w in words:
                if w not in self.cache:
                    self.cache[w] = np.array([bucket_of(u) for u in units_of(w)], np.int32).tobytes()
            return np.frombuffer(b"".join(map(self.cache.__getitem__, words)), np.int32)


_UNITS_HERE: list[Units] = []


def units_here() -> Units:
    if not _UNITS_HERE:
        _UNITS_HERE.append(Units())
    return _UNITS_HERE[0]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of every bucket's index vector."""
    r = np.random.default_rng(20240229)
    places = np.argsort(r.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, r.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def neighbour_sums(total: np.ndarray, count: np.ndarray, ids: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each unit's row the index vectors of units up to WINDOW places away in the same document."""
    count += np.bincount(ids, minlength=BUCKETS)
    flat = total.reshape(-1)
    for step in range(1, WINDOW + 1):
        a, b = ids[:-step], ids[step:]
        same = doc[:-step] == doc[step:]
        a, b = a[same].astype(np.int64), b[same].astype(np.int64)
        for own, other in ((a, b), (b, a)):
            for j in range(NONZERO):
                flat += np.bincount(own * DIM + places[other, j], weights=signs[other, j], minlength=BUCKETS * DIM)


def _added(frames: DataFrame, keys: list[str]) -> DataFrame:
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(x, np.float64) for x in f["data"]], axis=0)
        return pd.DataFrame({"slice": [key[0]], "n": [int(f["n"].min())], "data": [data.tobytes()]})

    return frames.groupBy(*keys).applyInPandas(run, "slice int, n long, data binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM + 1): a weighted unit vector per bucket, and its share of all units."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, (places, signs) = units_here(), index_vectors()
        total, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
        held, doc, size, seen = [], [], 0, 0

        def add() -> None:
            nonlocal held, doc, size
            if held:
                neighbour_sums(total, count, np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]), places, signs)
            held, size = [], 0

        for f in frames:
            for t in f["text"]:
                x = units.of(t)
                if len(x):
                    held.append(x)
                    size += len(x)
                    seen += 1
                if size > 1 << 20:
                    add()
        add()
        if seen:
            rows = np.hstack([total, count[:, None]]).reshape(SLICES, -1)
            yield pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "data": [r.tobytes() for r in rows]})

    part = checkpointed(docs.select("text").mapInPandas(run, "slice int, data binary").withColumn("n", F.spark_partition_id().cast("long")))
    left = part.count() // SLICES
    while left > 1:
        groups = max(1, -(-left // FAN))
        part = checkpointed(_added(part.withColumn("g", F.pmod("n", F.lit(groups))), ["slice", "g"]).withColumn(
            "n", F.pmod("n", F.lit(groups))))
        left = groups if groups < left else 1
    table = np.zeros((SLICES, BUCKETS // SLICES * (DIM + 1)))
    for r in part.collect():  # SLICES rows: the bucket table
        table[r["slice"]] += np.frombuffer(r["data"], np.float64)
    table = table.reshape(BUCKETS, DIM + 1)
    share = table[:, DIM] / max(1.0, table[:, DIM].sum())
    v = table[:, :DIM] - share[:, None] * table[:, :DIM].sum(0)  # against the mean of what would be there by chance
    length = np.sqrt((v * v).sum(1))
    v = v / np.where(length > 0, length, 1)[:, None] * (SMOOTH / (SMOOTH + share))[:, None]
    return v.astype(np.float32)


def document_vector(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(DIM, np.float64)
    for at in range(0, len(ids), 1 << 14):
        total += vectors[ids[at: at + (1 << 14)]].sum(0, dtype=np.float32)
    return np.append(total / max(1, len(ids)), np.log1p(len(ids)) / 10).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x): the mean of the document's unit vectors, and the logarithm of its length, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * DIM numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, v = units_here(), shared.value
        for f in frames:
            out = [document_vector(units.of(t), v).tobytes() for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "x": out})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x binary")


class Network:
    """x -> tanh(x A + a) -> probability, with one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 5):
        self.flat = float(y.mean()) if len(y) else 0.5
        self.ready = len(np.unique(y)) == 2 and len(y) >= 20
        if not self.ready:
            return
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        fit = r.permutation(len(z))
        held, fit = fit[: max(4, len(z) // 10)], fit[max(4, len(z) // 10):]
        d = z.shape[1]
        p = [r.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, s, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(epochs):
            r.shuffle(fit)
            for at in range(0, len(fit), 128):
                i = fit[at: at + 128]
                h = np.tanh(z[i] @ p[0] + p[1])
                g = (_sigmoid(h @ p[2] + p[3]) - y[i]) / len(i)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                rate = 0.01 * (1 - 0.9 * epoch / epochs)
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        margin = self.margin(x[held])
        loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -1, 1) * margin / t).mean()
        self.temperature = min(np.geomspace(0.5, 8, 57), key=loss)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x) / self.temperature) if self.ready else np.full(len(x), self.flat)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fold(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary"))


def fitted(features: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` labelled rows of ``features`` that ``learn`` (a condition on doc_id) allows."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(learn)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = features.groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), DIM + 1)
    return Network(x, np.array([r["quality"] for r in rows], np.float64))


def scored(docs: DataFrame, labels: DataFrame, learn: Column, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; predicted is 1 from a score of ``keep`` on."""
    features = stored(pooled(docs, word_vectors(docs)), "pooled")
    network = fitted(features, labels, learn, sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.frombuffer(b"".join(f["x"]), np.float32).reshape(len(f), DIM + 1).astype(np.float64)
            p = network.probability(x)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": p, "predicted": (p >= keep).astype(np.int32)})

    return features.mapInPandas(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, learn: Column, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score of ``keep`` at least, as they were; no text is shuffled."""
    vectors = word_vectors(docs)
    known = labels.where(F.col("quality").isin(0, 1) & learn).select("doc_id").distinct()
    known = F.broadcast(checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)))  # ``sample`` ids at most
    network = fitted(pooled(docs.join(known, "doc_id", "left_semi"), vectors), labels, learn, sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        import pyarrow as pa

        units, v = units_here(), shared.value
        for b in batches:
            x = np.array([document_vector(units.of(t), v) for t in b.column("text").to_pylist()], np.float64).reshape(-1, DIM + 1)
            yield b.filter(pa.array(network.probability(x) >= keep))
        _UNITS_HERE.clear()  # workers are used again by later stages

    return docs.mapInArrow(run, docs.schema)
