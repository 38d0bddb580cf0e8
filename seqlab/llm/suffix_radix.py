"""Repeated passages by a depth-limited radix sort of suffixes.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Suffixes are ordered through LENGTH bytes only, by most-significant-digit passes of eight bytes:
each pass splits the groups of the one before, and a group that is down to one document leaves. What is
left after the last pass are exactly the windows that repeat across documents.

Suffixes are dealt to tasks by content. In every window the run of K bytes with the smallest hash is its
anchor; equal windows have equal anchors at equal places, so they meet in the anchor's bucket, and the
windows of one anchor travel as one stretch of text. First only anchor hashes are exchanged, once per block
of documents, and anchors seen in one document alone leave. Then the stretches of the others are exchanged,
each distinct stretch once per block, and sorted in their bucket. A stretch all documents share is one row
per block, so a common passage or a large group of copies loads no task with its documents. At a common
passage's edges every document has a stretch of its own, though: anchors with more than HOT places in all are
cut into single windows, which are dealt by a hash of the whole window, each distinct one once per block. The answers
(the smallest doc_id per window) go back to the blocks, which mark the bytes. Comparisons are of bytes.

Defined cases: null and empty texts have no bytes and nothing removed; texts shorter than LENGTH keep all;
rows with equal doc_id do not remove from each other; a row without doc_id counts as coming last; an empty
table gives no rows; other columns are ignored (``without_repeats`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.blocks import Block, write_blocks
from seqlab.llm.common import checkpointed, released, stored
from seqlab.runtime import scratch_path

LENGTH = 50
SEGMENT = 1 << 20
BUCKET_BYTES = 16 << 20
LEAST_BITS = 7
HOT = 1 << 14  # places of an anchor; its stretches are some MB then
SEVERAL = 128
LAST = np.iinfo(np.int64).max
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def anchor_size(length: int) -> int:
    if length < 10:
        raise ValueError("length must be 10 at least")
    return 8 * max(1, min(3, length // 16))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - width + 1], out[width - have:][: len(x) - width + 1]) if have < width else out


def anchors(block: Block, length: int) -> dict[str, np.ndarray]:
    """Anchors of all windows: hash, place, document row, first and last window start (in the block's buffer)."""
    k = anchor_size(length)
    parts, doc, n = [], 0, len(block.ids)
    while doc < n:
        to = max(doc + 1, int(np.searchsorted(block.starts, block.starts[doc] + SEGMENT, "right")) - 1)
        a, b = int(block.starts[doc]), int(block.starts[to])
        if b - a >= length:
            parts.append(_segment_anchors(block.buffer[a:b], block.starts[doc: to + 1] - a, length, k, a, doc))
        doc = to
    names = ("hash", "at", "doc", "lo", "hi")
    return {x: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if x == "hash" else np.int64) for i, x in enumerate(names)}


def _segment_anchors(data: bytes, starts: np.ndarray, length: int, k: int, base: int, first: int) -> tuple[np.ndarray, ...]:
    n, w = len(data), length - k + 1
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    places = n - k + 1
    h = words[:places] * _ODD[0]
    h ^= h >> np.uint64(32)
    for at in range(8, k, 8):
        h += words[at: at + places]
        h *= _ODD[1]
        h ^= h >> np.uint64(29)
    h *= _ODD[2]
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)  # zero stands for no window
    m = _sliding(h, w, np.minimum)
    for a, b in zip(starts[:-1], starts[1:]):  # windows that would reach into the next document
        m[max(a, b - length + 1): b] = 0
    edge = np.zeros(w - 1, np.uint64)
    top = _sliding(np.concatenate([edge, m, edge]), w, np.maximum)
    at = np.flatnonzero(h == top)
    own = h[at]
    doc = np.searchsorted(starts, at, "right") - 1
    same = np.concatenate([[False], doc[1:] == doc[:-1]])
    before, less = np.concatenate([[0], at[:-1]]), np.concatenate([[False], own[1:] < own[:-1]])
    lo = np.where(same, np.where(less, at - w + 1, before + 1), starts[doc])
    last = starts[doc + 1] - length
    hi = np.where(np.concatenate([same[1:], [False]]), np.concatenate([lo[1:] - 1, [0]]), last)
    hi = np.minimum(hi, last)
    keep = lo <= hi
    own = own * _ODD[0]  # anchors are the smallest hashes: spread them over the buckets again, one to one
    return own[keep], at[keep] + base, doc[keep] + first, lo[keep] + base, hi[keep] + base


def packed(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    data = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    head = np.array([len(data), *map(len, data)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(data))


def unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    cuts = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int64, n, 8))])
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def order_of(block: Block) -> np.ndarray:
    return np.where(block.known, block.ids, LAST)


def _offered(folder: str, length: int, bits: int):
    """A block's distinct anchor hashes by bucket; a byte each says whether several of its documents have it (SEVERAL),
    and the power of two that its places don't exceed."""

    def run(frames):
        for f in frames:
            for no, file in zip(f["block"], f["file"]):
                block = Block(folder, file)
                a = anchors(block, length)
                if not len(a["at"]):
                    continue
                order = np.argsort(a["hash"], kind="stable")
                h, ids = a["hash"][order], order_of(block)[a["doc"][order]]
                cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
                places = np.ceil(np.log2(np.diff(np.append(cut, len(h))))).astype(np.uint8)
                note = places + SEVERAL * several.astype(np.uint8)
                h = h[cut]
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(edges[1:], len(h))
                blobs = [h[x:y].tobytes() + note[x:y].tobytes() for x, y in zip(edges, ends)]
                yield pd.DataFrame({"bucket": bucket[edges].astype(np.int32), "block": no, "file": file, "n": ends - edges, "data": blobs})

    return run


def _repeated(hot: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        """Anchor hashes of one bucket that more than one document has, with whether they are hot, back to each block."""
        hs = [np.frombuffer(d, np.uint64, n) for d, n in zip(f["data"], f["n"])]
        notes = np.concatenate([np.frombuffer(d, np.uint8, offset=8 * n) for d, n in zip(f["data"], f["n"])])
        found, at, count = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        several = count > 1
        several[at[notes >= SEVERAL]] = True
        heat = np.bincount(at, weights=2.0 ** (notes % SEVERAL), minlength=len(found)) > hot
        keep, many, rows, start = several[at], heat[at], [], 0
        for no, file, own in zip(f["block"], f["file"], hs):
            part = slice(start, start + len(own))
            kept = own[keep[part]]
            if len(kept):
                rows.append((key[0], no, file, kept.tobytes() + many[part][keep[part]].tobytes()))
            start += len(own)
        return pd.DataFrame(rows, columns=["bucket", "block", "file", "data"])

    return run


def _wanted(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and hot flags of ``_repeated``'s rows, by hash."""
    sizes = [len(x) // 9 for x in blobs]
    hashes = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(blobs, sizes)]) if sizes else np.zeros(0, np.uint64)
    hot = np.concatenate([np.frombuffer(x, bool, offset=8 * n) for x, n in zip(blobs, sizes)]) if sizes else np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], hot[order]


def _window_hashes(buffer: bytes, start: np.ndarray, length: int) -> np.ndarray:
    words = np.ndarray((max(len(buffer) - 7, 0),), "<u8", buffer, strides=(1,))
    h = np.zeros(len(start), np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        h += words[start + at]
        h *= _ODD[1]
        h ^= h >> np.uint64(29)
    return h * _ODD[2]


class Stretches:
    """The distinct stretches of a block's repeated anchors, by bucket in order of first place.

    Hot anchors have a stretch for every window, in the window's bucket.
    """

    def __init__(self, folder: str, file: str, blobs, length: int, bits: int):
        self.block = block = Block(folder, file)
        a = anchors(block, length)
        hashes, hot = _wanted(blobs)
        if len(hashes):
            near = np.minimum(np.searchsorted(hashes, a["hash"]), len(hashes) - 1)
            keep = hashes[near] == a["hash"]
            hot = hot[near] & keep
        else:
            keep = hot = np.zeros(len(a["at"]), bool)
        even, odd = np.flatnonzero(keep & ~hot), np.flatnonzero(hot)
        windows = a["hi"][odd] - a["lo"][odd] + 1
        start = np.repeat(a["lo"][odd], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        place = np.concatenate([even, np.repeat(odd, windows)])
        lo, hi = np.concatenate([a["lo"][even], start]), np.concatenate([a["hi"][even], start])
        own = np.concatenate([a["hash"][even], _window_hashes(block.buffer, start, length)])
        bucket = (own >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.lo, self.hi, bucket = lo[order], hi[order], bucket[order]
        self.doc, at = a["doc"][place[order]], a["at"][place[order]]
        number: dict[bytes, int] = {}
        buffer = block.buffer
        index = [number.setdefault(buffer[x:y], len(number)) for x, y in zip(self.lo.tolist(), (self.hi + length).tolist())]
        self.index = np.array(index, np.int64)  # of each place: its distinct stretch
        self.texts = list(number)
        first = np.full(len(number), len(index), np.int64)
        np.minimum.at(first, self.index, np.arange(len(index)))
        self.bucket, self.anchor = bucket[first], (at - self.lo)[first]
        self.least = np.full(len(number), LAST)
        np.minimum.at(self.least, self.index, order_of(block)[self.doc])


def _sent(folder: str, length: int, bits: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        s = Stretches(folder, f["file"].iloc[0], f["data"], length, bits)
        rows = []
        edges = np.flatnonzero(np.concatenate([[True], s.bucket[1:] != s.bucket[:-1]])) if len(s.bucket) else []
        for x, y in zip(edges, np.append(edges[1:], len(s.bucket)) if len(edges) else []):
            texts = s.texts[x:y]
            sizes = np.array([len(t) for t in texts], np.int32)
            rows.append((int(s.bucket[x]), key[0], f["file"].iloc[0], packed(sizes, s.anchor[x:y].astype(np.int32), s.least[x:y], b"".join(texts))))
        return pd.DataFrame(rows, columns=["bucket", "block", "file", "data"])

    return run


def least_by_window(texts: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of every stretch, the smallest doc_id (``least`` by stretch) with that window.

    The radix sort: one pass per eight bytes, most significant first.
    """
    counts = np.array([len(t) - length + 1 for t in texts])
    first = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(texts)), counts)
    start = begin[owner] + np.arange(first[-1]) - first[owner]
    result = least[owner]
    data = b"".join(texts) + bytes(8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    row, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    ids = result.copy()
    for at in range(0, length, 8):
        if not len(row):
            break
        digit = words[start[row] + at].byteswap()
        if length - at < 8:
            digit >>= np.uint64(8 * (8 - (length - at)))
        order = np.lexsort((digit, group))
        row, group, digit = row[order], group[order], digit[order]
        cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]))
        size = np.diff(np.append(cut, len(row)))
        own = ids[row]
        several = np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut)
        group = np.repeat(np.arange(len(cut)), size)
        keep = np.repeat(several, size)
        row, group = row[keep], group[keep]
    if len(row):
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        result[row] = np.repeat(np.minimum.reduceat(ids[row], cut), np.diff(np.append(cut, len(row))))
    return np.split(result, first[1:-1])


def _sorted_bucket(length: int):
    k = anchor_size(length)

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        members, least, anchor = [], [], []
        for blob in f["data"]:
            sizes, at, own, data = unpacked(blob)
            cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32))]).tolist()
            members.append(np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(cuts[:-1], cuts[1:])], np.int64))
            least.append(np.frombuffer(own, np.int64))
            anchor.append(np.frombuffer(at, np.int32))
        texts, place = list(number), np.zeros(len(number), np.int64)
        low = np.full(len(texts), LAST)
        for u, own, at in zip(members, least, anchor):
            np.minimum.at(low, u, own)
            place[u] = at
        # a stretch whose anchor no other stretch has shares no window with another
        kmers: dict[bytes, int] = {}
        of = np.array([kmers.setdefault(t[p: p + k], len(kmers)) for t, p in zip(texts, place.tolist())], np.int64)
        shared = np.flatnonzero(np.bincount(of, minlength=len(kmers))[of] > 1)
        varied: dict[int, np.ndarray] = {}
        if len(shared):
            for u, v in zip(shared.tolist(), least_by_window([texts[u] for u in shared], low[shared], length)):
                if (v == v[0]).all():
                    low[u] = v[0]
                else:
                    varied[u] = v
        mixed = np.zeros(len(texts), np.uint8)
        mixed[list(varied)] = 1
        rows = []
        for no, file, u in zip(f["block"], f["file"], members):
            rest = [varied[x] for x in u[mixed[u] == 1].tolist()]
            rows.append((key[0], no, file, packed(mixed[u], low[u], np.concatenate(rest) if rest else np.zeros(0, np.int64))))
        return pd.DataFrame(rows, columns=["bucket", "block", "file", "data"])

    return run


def _marked(folder: str, length: int, bits: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        s = Stretches(folder, f["file"].iloc[0], f.loc[f["kind"] == 1, "data"], length, bits)
        block = s.block
        answers = f[f["kind"] == 2].sort_values("bucket")["data"]
        got = [unpacked(x) for x in answers]
        mixed = np.frombuffer(b"".join(g[0] for g in got), np.uint8).astype(bool)
        low = np.frombuffer(b"".join(g[1] for g in got), np.int64)
        flat = np.frombuffer(b"".join(g[2] for g in got), np.int64)
        n = len(block.buffer)
        cover = np.zeros(n, bool)
        if len(s.index):
            own = order_of(block)[s.doc]
            even = ~mixed[s.index] & (low[s.index] < own)
            windows = np.array([len(t) - length + 1 for t in s.texts], np.int64)
            begin = np.concatenate([[0], np.cumsum(np.where(mixed, windows, 0))[:-1]])
            odd = np.flatnonzero(mixed[s.index])
            many = windows[s.index[odd]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hit = flat[np.repeat(begin[s.index[odd]], many) + step] < np.repeat(own[odd], many)
            start = (np.repeat(s.lo[odd], many) + step)[hit]
            begins, ends = np.concatenate([s.lo[even], start]), np.concatenate([s.hi[even], start]) + length
            change = np.bincount(begins, minlength=n + 1)
            change -= np.bincount(ends, minlength=n + 1)
            cover = np.cumsum(change[:-1], out=change[:-1]) > 0
            del change
        # the runs of every document: a run ends where its document does
        edge = np.zeros(n + 1, bool)
        edge[block.starts] = True
        opens = np.flatnonzero(cover & (edge[:-1] | ~np.concatenate([[False], cover[:-1]]))) if n else np.zeros(0, np.int64)
        closes = np.flatnonzero(cover & (edge[1:] | ~np.concatenate([cover[1:], [False]]))) + 1 if n else np.zeros(0, np.int64)
        kept, begins, ends = [], [], []
        a = np.searchsorted(opens, block.starts)
        for i in range(len(block.ids)):
            x, y = int(block.starts[i]), int(block.starts[i + 1])
            o, c = opens[a[i]: a[i + 1]], closes[a[i]: a[i + 1]]
            begins.append(o - x)
            ends.append(c - x)
            cuts = [x, *np.column_stack([o, c]).ravel().tolist(), y]
            kept.append(b"".join(block.buffer[p:q] for p, q in zip(cuts[::2], cuts[1::2])))
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(block.ids.copy(), ~block.known), "n_bytes": np.diff(block.starts),
            "starts": begins, "ends": ends, "kept": kept, "extra": block.extra,
        })

    return run


def repeats(docs: DataFrame, length: int = LENGTH, extra: str | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept, extra) for every row: the maximal removed byte runs, and what is left."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffix-blocks")
    blocks = write_blocks(docs, folder, extra=extra)
    size = blocks.agg(F.sum("n_bytes").alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    total, tasks = size["n"] or 0, max(1, size["blocks"])  # a task per block: rows here stand for much work
    bits = max(LEAST_BITS, int(total // BUCKET_BYTES).bit_length())
    row = "bucket int, block long, file string, data binary"
    offered = blocks.repartition(tasks).mapInPandas(_offered(folder, length, bits), "bucket int, block long, file string, n long, data binary")
    again = stored(offered.repartition(1 << bits, "bucket").groupBy("bucket").applyInPandas(_repeated(hot), row), "anchors")
    sent = again.repartition(tasks, "block").groupBy("block").applyInPandas(_sent(folder, length, bits), row)
    answers = stored(sent.repartition(1 << bits, "bucket").groupBy("bucket").applyInPandas(_sorted_bucket(length), row), "answers")
    released(spark)
    all_blocks = blocks.select(F.lit(-1).alias("bucket"), "block", "file", F.lit(None).cast("binary").alias("data"), F.lit(0).alias("kind"))
    both = all_blocks.unionByName(again.withColumn("kind", F.lit(1))).unionByName(answers.withColumn("kind", F.lit(2)))
    out = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary, extra string"
    return both.repartition(tasks, "block").groupBy("block").applyInPandas(_marked(folder, length, bits), out)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its repeated passages cut out of ``text``; all columns as they were, n_chars (if there) counted anew.

    The cut bytes are decoded leniently: half a character at an end of a cut is dropped.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    types = docs.select(*rest).schema
    packed = docs.select("doc_id", "text", F.to_json(F.struct(*rest)).alias("extra")) if rest else docs
    found = repeats(packed, length, "extra" if rest else None)
    back = found.withColumn("r", F.from_json("extra", types)) if rest else found
    decoded = F.pandas_udf(lambda kept: kept.map(lambda b: b.decode("utf-8", "ignore")), "string")
    out = back.select("doc_id", decoded("kept").alias("text"), *[F.col(f"r.{c}").alias(c) for c in rest])
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(types["n_chars"].dataType))
    return out.select(*docs.columns)

