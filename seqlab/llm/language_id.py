"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of one to four characters of a lower-cased word, its edges included; each is hashed to one of
BUCKETS rows of an embedding table. A text is the mean of the embeddings of all of its subwords, and a linear softmax
over that mean gives the languages. Table and weights are trained by stochastic gradient descent in numpy. A fifth of
the sampled texts is held out of the training: it sets the temperature of the probabilities and the least probability
at which a text is accepted, so that at most REJECT_ERROR of the accepted ones are wrong.

The model is fitted on about SAMPLE labelled texts at most, drawn by a hash at a rate per language (small languages
whole, large ones shared down to the same number); every text is scored, by the whole of it. As the softmax is linear
in the mean, embeddings are multiplied by its weights before scoring.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not accepted; so is every text where
no language could be learned; a single language has score 1; rows with a null lang, and those ``learn`` is null for,
are scored but not learned from; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # a bucket number fits 16 bits
GRAMS = 4
DIM = 16
SAMPLE = 4_000
EPOCHS = 6
RATE = 0.5
BATCH = 16
REJECT_ERROR = 0.01
LEAST_CERTAIN = 0.005  # this share of the held-out texts, the least certain ones, lies below the bar in any case
CHARS = 1 << 18  # characters hashed at once
UNKNOWN = "und"
_MULTIPLIER = np.uint32(2654435761)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, text number of each, subwords may start before here) of lower-cased texts, in bounded pieces.

    Texts lie between zeros. A long text is cut into pieces that see GRAMS - 1 characters of the next one.
    """
    codes, owner, size = [], [], 0
    for no, t in enumerate(texts):
        x = np.frombuffer(("\0" + (t or "").lower() + "\0").encode("utf-32-le", "replace"), np.uint32)
        for at in range(0, len(x) - 1, CHARS):
            piece = x[at: at + CHARS + GRAMS - 1]
            starts = min(CHARS, len(x) - at)
            codes.append(piece)
            owner.append((no, starts, len(piece)))
            size += len(piece)
            if size >= CHARS:
                yield _joined(codes, owner)
                codes, owner, size = [], [], 0
    if codes:
        yield _joined(codes, owner)


def _joined(codes: list[np.ndarray], owner: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = np.concatenate(codes)
    text = np.repeat(np.array([o[0] for o in owner]), [o[2] for o in owner])
    own = np.concatenate([np.arange(n) < starts for _, starts, n in owner])
    last = np.repeat(np.cumsum([o[2] for o in owner]), [o[2] for o in owner])
    return whole, np.where(own, text, -1), last - np.arange(len(whole))


def subwords(codes: np.ndarray, text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every subword that starts at a place with a text; ``room`` is what is left of the piece."""
    n = len(codes)
    x = np.concatenate([codes, np.zeros(GRAMS, np.uint32)])
    letter = letters()[x]
    x = np.where(letter, x, np.uint32(0))
    texts, buckets = [], []
    h = np.zeros(n, np.uint32)
    inner = np.ones(n, bool)  # all places but the first and the last are letters
    for size in range(1, GRAMS + 1):
        h = (h + x[size - 1: size - 1 + n] + np.uint32(size)) * _MULTIPLIER
        h ^= h >> np.uint32(15)
        if size == 1:
            good = letter[:n].copy()
        elif size == 2:
            good = letter[:n] | letter[1: n + 1]
        else:
            inner = inner & letter[size - 2: size - 2 + n]
            good = inner.copy()
        good &= (room >= size) & (text >= 0)
        at = np.flatnonzero(good)
        texts.append(text[at])
        buckets.append(((h[at] * _MULTIPLIER) >> np.uint32(16)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(buckets)


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, ascending, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for codes, owner, room in slices([text]):
        total += np.bincount(subwords(codes, owner, room)[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.uint16), total[at].astype(np.float32)


class Model:
    """Embeddings, softmax weights, temperature and the bar of acceptance; ``names`` are the languages."""

    def __init__(self, names: list[str]):
        self.names, self.temperature, self.bar = names, 1.0, 0.0

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> None:
        r, k = np.random.default_rng(seed), len(self.names)
        e = r.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        w, b = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
        steps = EPOCHS * -(-len(texts) // BATCH)
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                own = order[at: at + BATCH]
                ids = np.concatenate([texts[i][0] for i in own]).astype(np.int64)
                doc = np.repeat(np.arange(len(own)), [len(texts[i][0]) for i in own])
                share = np.concatenate([texts[i][1] / max(1.0, texts[i][1].sum()) for i in own]).astype(np.float32)
                z = np.zeros((len(own), DIM), np.float32)
                cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                if len(ids):
                    z[doc[cuts]] = np.add.reduceat(e[ids] * share[:, None], cuts, axis=0)
                p = _softmax(z @ w + b)
                p[np.arange(len(own)), y[own]] -= 1
                rate = RATE * (1 - step / steps)
                back = p @ w.T
                w -= rate * (z.T @ p)
                b -= rate * p.sum(0)
                # preconditioned: by the root of a subword's share of the text, as the bare share of a long text would hardly move it
                move = back[doc] * (rate * np.sqrt(share))[:, None]
                for d in range(DIM):
                    e[:, d] -= np.bincount(ids, weights=move[:, d], minlength=BUCKETS).astype(np.float32)
                step += 1
        self.weights = (e @ w).astype(np.float32)
        self.bias = b

    def logits(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def calibrate(self, logits: np.ndarray, y: np.ndarray, error: float = REJECT_ERROR) -> None:
        """Temperature by least log loss, and the bar: at most ``error`` of the accepted rows are wrong."""
        if not len(y):
            return
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
        self.temperature = float(min(np.geomspace(0.05, 8, 80), key=loss))
        p = _softmax(logits / self.temperature)
        top, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-top, kind="stable")
        wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(wrong <= error)
        least = top[order[good[-1]]] if len(good) else 1.0
        self.bar = float(max(least, np.quantile(top, LEAST_CERTAIN)))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, probability, accepted) of each text."""
        k = len(self.names)
        has = np.zeros(len(texts), bool)
        sums, n = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for codes, owner, room in slices(texts):
            own = owner[letters()[codes] & (owner >= 0)]
            has[np.unique(own)] = True
            if not k:
                continue
            text, bucket = subwords(codes, owner, room)
            for c in range(k):
                sums[:, c] += np.bincount(text, weights=self.weights[:, c][bucket], minlength=len(texts))
            n += np.bincount(text, minlength=len(texts))
        if not k:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p = _softmax(self.logits(sums, n) / self.temperature)
        best = p.argmax(1)
        top = np.where(has, p[np.arange(len(p)), best], 0.0)
        return np.where(has, best, -1), top, has & (top >= self.bar)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def rates(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each language's rows to draw: ``sample`` rows in all, as evenly over the languages as their rows allow."""
    left, out, heap = sample, {}, [(n, name) for name, n in counts.items()]
    heapq.heapify(heap)
    while heap:
        each = left / len(heap)
        n, name = heapq.heappop(heap)
        take = min(n, each)
        out[name] = take / n
        left -= take
    return out


def drawn(docs: DataFrame, learn: Column, sample: int) -> tuple[DataFrame, list[str]]:
    """(lang, text, fit) of the sampled rows, and the languages; of rows only their counts reach the driver."""
    known = docs.where(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    share = rates(counts, sample)
    rate = docs.sparkSession.createDataFrame([(n, share[n]) for n in names] or [("", 0.0)], "lang string, _rate double")
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    hit = known.join(F.broadcast(rate), "lang").where(at < F.col("_rate"))
    fit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(5)) != 0
    return hit.select("lang", "text", fit.alias("fit")).limit(2 * sample), names


def trained(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model of the languages in the rows of ``docs`` that ``learn`` holds for."""
    rows, names = drawn(docs.select("doc_id", "text", "lang"), learn, sample)
    model = Model(names)
    if not names:
        return model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [bucket_counts(t) for t in f["text"]]
            yield pd.DataFrame({
                "lang": f["lang"], "fit": f["fit"], "ids": [i.tobytes() for i, _ in got], "n": [c.astype(np.float16).tobytes() for _, c in got],
            })

    got = sorted(map(tuple, rows.mapInPandas(run, "lang string, fit boolean, ids binary, n binary").collect()))
    no = {name: i for i, name in enumerate(names)}
    y = np.array([no[g[0]] for g in got], np.int64)
    texts = [(np.frombuffer(g[2], np.uint16), np.minimum(np.frombuffer(g[3], np.float16).astype(np.float32), 65504)) for g in got]
    fit = np.array([g[1] for g in got], bool)
    model.fit([t for t, ok in zip(texts, fit) if ok], y[fit])
    held = [t for t, ok in zip(texts, fit) if not ok and len(t[0])]
    held_y = np.array([v for v, t, ok in zip(y, texts, fit) if not ok and len(t[0])], np.int64)
    sums = np.array([(model.weights[i.astype(np.int64)] * n[:, None]).sum(0, dtype=np.float64) for i, n in held]).reshape(len(held), len(names))
    model.calibrate(model.logits(sums, np.array([n.sum() for _, n in held])), held_y)
    return model


def identified(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, learn, sample))  # BUCKETS numbers a language

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for f in frames:
            best, score, accepted = model.scores(list(f["text"]))
            names = [UNKNOWN if b < 0 else model.names[b] for b in best]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "lang_pred": names, "score": score, "accepted": accepted})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, accepted boolean")
