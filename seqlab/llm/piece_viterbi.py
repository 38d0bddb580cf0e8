"""SentencePiece encoding by best total score, and decoding.

An Aho-Corasick automaton over the pieces runs over the text once. At every position its output links name
all pieces that end there, and each relaxes the best score of that position from the position where the
piece begins; the best path read backwards gives the ids. A character no piece covers costs the lowest
score less 10, as in SentencePiece, and is written in its byte pieces (or as the unknown id in a model
without them). Ties go to the path whose last piece is longer.

White space is escaped and a leading mark added as the model asks. No piece holds the mark inside or at its
end except runs of marks, so the best path of a text is that of its marked words put together: each
distinct word is run through the automaton once and cached (the cache is emptied when full).

Defined cases: null is an empty text, which has no ids; repeated rows give repeated results; a text of any
length is encoded whole; an empty table gives no rows; other columns are kept by ``encoded``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
CACHE_WORDS = 200_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a SentencePiece model file and the two directions over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.setup(
            [(p.piece, p.score, p.type) for p in model.pieces], model.normalizer_spec.add_dummy_prefix,
            model.normalizer_spec.remove_extra_whitespaces,
        )
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only models that leave characters as they are are supported")

    def setup(self, pieces: list[tuple[str, float, int]], prefix: bool, squeeze: bool) -> None:
        import ahocorasick

        self.pieces, self.prefix, self.squeeze = pieces, prefix, squeeze
        self.automaton = ahocorasick.Automaton()
        self.bytes, self.unknown = {}, 0
        for i, (piece, score, kind) in enumerate(pieces):
            if kind in (NORMAL, USER):
                self.automaton.add_word(piece, (len(piece), float(score), i))
            elif kind == BYTE:
                self.bytes[int(piece[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
        self.automaton.make_automaton()
        self.lowest = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - UNKNOWN_COST
        inside = [p for p, _, k in pieces if k in (NORMAL, USER) and MARK in p[1:] and p.strip(MARK)]
        self.by_word = not inside
        self.cache: dict[str, tuple[bytes, float]] = {}

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return ((" " if self.prefix and text else "") + text).replace(" ", MARK)

    def best(self, marked: str) -> tuple[list[int], float]:
        """Ids of the path with the highest total score over ``marked``, and that score."""
        n = len(marked)
        score, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(marked):
            ends[end + 1].append(piece)
        for at in range(1, n + 1):
            most, link = score[at - 1] + self.lowest, (at - 1, -1)
            for size, own, i in ends[at]:
                s = score[at - size] + own
                if s > most or (s == most and at - size < link[0]):
                    most, link = s, (at - size, i)
            score[at], back[at] = most, link
        out, at = [], n
        while at:
            start, i = back[at]
            if i < 0:
                data = marked[start:at].encode("utf-8", "replace")
                own = [self.bytes[x] for x in data] if self.bytes else [self.unknown]
                out.extend(reversed(own))
            else:
                out.append(i)
            at = start
        return out[::-1], score[n]

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        marked = self.normal(text or "")
        if not self.by_word:
            ids, score = self.best(marked)
            return np.array(ids, np.int32), score
        words = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, parts, total = self.cache, [], 0.0
        for w in words:
            got = cache.get(w)
            if got is None:
                ids, score = self.best(w)
                got = np.array(ids, np.int32).tobytes(), score
                if len(w) <= 64:
                    cache[w] = got
            parts.append(got[0])
            total += got[1]
        return np.frombuffer(b"".join(parts), np.int32), total

    def surfaces(self) -> list[bytes]:
        """What each id writes."""
        if not hasattr(self, "_surfaces"):
            plain = {NORMAL: True, USER: True}
            self._surfaces = [
                p.replace(MARK, " ").encode() if k in plain else bytes([int(p[1:-1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b""
                for p, _, k in self.pieces
            ]
        return self._surfaces

    def decode(self, ids) -> str:
        of = self.surfaces()
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One model per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _run(docs: DataFrame, path: str, make, more: str) -> DataFrame:
    names = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at: at + 512]
                yield make(model, g)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), more])
    return docs.mapInPandas(run, schema)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``ids`` (array of int) and ``score`` in place of columns so named."""

    def make(model: Pieces, f: pd.DataFrame) -> pd.DataFrame:
        got = [model.encode(t) for t in f[text]]
        return f.assign(ids=[x for x, _ in got], score=[s for _, s in got])

    return _run(docs.drop("ids", "score"), path, make, "ids array<int>, score double")


def decoded(ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """All columns but ``column``, with ``text`` decoded from it; null ids give an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for f in frames:
            yield f.drop(columns=column).assign(text=[model.decode([] if x is None else x) for x in f[column]])

    kept = [c for c in ids.columns if c not in (column, "text")]
    schema = ", ".join([*(f"`{c}` {ids.schema[c].dataType.simpleString()}" for c in kept), "text string"])
    return ids.select(*kept, column).mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, score, n_bytes, same_text): a document's ids, digested, and whether decoding them gives its text.

    ids_crc32 is over little-endian unsigned 32-bit ids.
    """

    def make(model: Pieces, f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, t in zip(f["doc_id"].astype("Int64"), f["text"]):
            ids, score = model.encode(t)
            data = (t or "").encode("utf-8", "replace")
            rows.append((i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), score, len(data), model.decode(ids.tolist()).encode() == data))
        out = pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "score", "n_bytes", "same_text"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for f in frames:
            for at in range(0, len(f), 512):
                yield make(model, f.iloc[at: at + 512])

    rows = docs.select("doc_id", F.col("text"))
    return rows.mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, score double, n_bytes long, same_text boolean")
