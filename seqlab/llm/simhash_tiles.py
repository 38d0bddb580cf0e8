"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are sorted by the bit counts of their four 16-bit lanes and packed into tiles.
The Hamming distance is at least the sum of the lanes' count differences, hence at least the difference
of the whole population counts: a pair of tiles whose count ranges lie further apart than the radius is
never compared. Every other pair is compared in full with numpy exclusive-or and bit counts, so no link
is lost. A pair of tiles emits a spanning forest of its links, never all of its pairs.

Defined cases: null and blank texts have fingerprint zero, linked like any other; repeated texts share
a fingerprint and so a component; a row without a doc_id gets the component of its fingerprint, or null
if no row of that fingerprint has one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import (
    checkpointed, components, fetch_pairs, local_forest, open_fs, packed_blocks, salted_join, stored, width_for,
)
from seqlab.runtime import scratch_path

SHINGLE = 3
RADIUS = 2
TILE = 2048
# of keep_one: words of a shingle, least Jaccard similarity, bits of 128 that two texts may differ by to be compared
WIDE_SHINGLE = 5
NEAR = 0.8
WIDE_RADIUS = 32
WIDE_TILE = 4096
SQUARE = 8  # tiles a side of the squares of tile pairs that are dealt to tasks
TILES_HELD = 2 * SQUARE + 2
WORDS_HELD = 100_000
HELD_BYTES = 48 << 20
_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.uint8)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    if shingle == 3:
        hashes = [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(shingle)))]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([simhash(t, shingle) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "fp": fp})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def lanes(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit lanes of each fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs within ``radius`` bits, comparing slabs of rows whose lane ranges can reach it."""
    left, right = [], []
    la, lb = lanes(a), lanes(b)
    step = 64
    low = np.array([lb[j: j + step].min(0) for j in range(0, len(b), step)])
    high = np.array([lb[j: j + step].max(0) for j in range(0, len(b), step)])
    for i in range(0, len(a), step):
        lo, hi = la[i: i + step].min(0), la[i: i + step].max(0)
        gap = np.maximum(0, np.maximum(low - hi, lo - high)).sum(1)
        near = np.flatnonzero(gap <= radius)
        if same:
            near = near[near >= i // step]
        if not len(near):
            continue
        cols = (near[:, None] * step + np.arange(step)).ravel()
        cols = cols[cols < len(b)]
        hit = np.bitwise_count(a[i: i + step, None] ^ b[None, cols]) <= radius
        x, y = np.nonzero(hit)
        left.append(x + i)
        right.append(cols[y])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    keep = (x < y) if same else np.ones(len(x), bool)
    return x[keep], y[keep]


def _pack(block: int, f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["pop", "l0", "l1", "l2", "l3", "fp"])
    fp = f["fp"].to_numpy(np.int64).view(np.uint64)
    n = lanes(np.ascontiguousarray(fp))
    return pd.DataFrame({"block": [block], "lo": [n.min(0).tolist()], "hi": [n.max(0).tolist()], "data": [fp.tobytes()], "data_id": [f["id"].to_numpy(np.int64).tobytes()]})


def lane_count(column: str, lane: int):
    return F.bit_count(F.shiftrightunsigned(column, 16 * lane).bitwiseAND(F.lit(0xFFFF)))


def near_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning links (u, v) between ids of (id, fp) rows, distinct in fp, within ``radius`` bits."""
    counts = [lane_count("fp", i).alias(f"l{i}") for i in range(4)]
    order = ["pop", "l0", "l1", "l2", "l3", "fp"]
    ranked = classes.select("id", "fp", F.bit_count("fp").alias("pop"), *counts)
    schema = "block long, lo array<int>, hi array<int>, data binary, data_id binary"
    tiles = packed_blocks(ranked, [F.col(c) for c in order], tile, "tiles", schema, _pack)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    # a tile covers a range of population counts; pairs of ranges further apart than the radius never meet
    pops = tiles.select("block", "lo", "hi").withColumn("p0", total("lo")).withColumn("p1", total("hi"))
    a = pops.select(F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.explode(F.sequence(F.col("p0"), F.col("p1") + radius)).alias("p"))
    b = pops.select(F.col("block").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.explode(F.sequence(F.col("p0"), F.col("p1") + radius)).alias("p"))
    gap = total(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.greatest(
        F.lit(0), F.get("b_lo", i) - F.get("a_hi", i), F.get("a_lo", i) - F.get("b_hi", i))))
    pairs = checkpointed(a.join(b, "p").where((F.col("a") <= F.col("b")) & (gap <= radius)).select("a", "b").distinct())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            us, vs = [], []
            for a, b, da, ia, db, ib in zip(f["a"], f["b"], f["a_data"], f["a_data_id"], f["b_data"], f["b_data_id"]):
                x, y = close_pairs(np.frombuffer(da, np.uint64), np.frombuffer(db, np.uint64), radius, a == b)
                u, v = local_forest(np.frombuffer(ia, np.int64)[x], np.frombuffer(ib, np.int64)[y])
                us.append(u)
                vs.append(v)
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    both = fetch_pairs(pairs, tiles, ["data", "data_id"]).select("a", "b", "a_data", "a_data_id", "b_data", "b_data_id")
    return both.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id linked through fingerprints."""
    fps = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("_n")))
    found = components(near_links(classes.select("id", "fp").where("id is not null"), radius, tile))
    named = classes.join(found, classes["id"] == found["node"], "left").select(
        "fp", "_n", F.coalesce("component", "id").alias("component_id")
    )
    return salted_join(fps, checkpointed(named), "fp", "_n", F.col("doc_id")).select("doc_id", "fp", "component_id")


# ---- one row of each group of near copies, by word shingles ---------------------------


def shingle_set(words: list[bytes], shingle: int) -> set[bytes]:
    if len(words) <= shingle:
        return {b" ".join(words)}
    return {b" ".join(t) for t in zip(*(words[i:] for i in range(shingle)))}


def alike_sets(a: int, b: int, both: int) -> bool:
    """Whether sets of these sizes with ``both`` members in common have a Jaccard similarity of NEAR at least."""
    return both >= NEAR * (a + b - both)


def similar(a: set[bytes], b: set[bytes]) -> bool:
    return alike_sets(len(a), len(b), len(a & b))


def shingle_hashes(words: list[bytes], shingle: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """(n, 2) hashes of the distinct shingles of a text, ascending by the first; ``known`` keeps hashes of words."""
    known = {} if known is None else known
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 42)
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    lanes_ = []
    for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        h = np.full(max(1, len(x) - size + 1), size, np.uint64)
        for k in range(size):
            h = (h ^ x[k: k + len(h)]) * factor
            h ^= h >> np.uint64(32)
        h *= factor
        lanes_.append(h ^ (h >> np.uint64(29)))
    first, at = np.unique(lanes_[0], return_index=True)
    return np.stack([first, lanes_[1][at]], 1)


def wide_simhash(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a text's shingle hashes as two signed longs: bit i is set if it is in over half of them."""
    h = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at: at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64).tolist())


def _word_rows(folder: str, shingle: int):
    """(row, doc_id, digest, fp, fp2, n, file, start, size): the words of each text lie in ``file`` from ``start`` on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, at, zip_ = f"{uuid.uuid4().hex}.words", 0, zstandard.ZstdCompressor(level=1)
        known: dict[bytes, int] = {}
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for f in frames:
                rows = []
                for t in f["text"]:
                    words = (t or "").encode("utf-8", "replace").lower().split()  # as simhash
                    joined = b" ".join(words)
                    data = zip_.compress(joined)
                    out.write(data)
                    hashes = shingle_hashes(words, shingle, known)
                    rows.append((xxhash.xxh128_digest(joined, 7), *wide_simhash(hashes), len(hashes), name, at, len(data)))
                    at += len(data)
                    if len(known) > WORDS_HELD:
                        known.clear()
                made = pd.DataFrame(rows, columns=["digest", "fp", "fp2", "n", "file", "start", "size"])
                made.insert(0, "row", f["_row"].to_numpy())
                made.insert(1, "doc_id", f["doc_id"].astype("Int64").array)
                yield made

    return run


class Words:
    """Shingles of texts by their place (file, start, size) in the shared folder; hashes are kept up to HELD_BYTES."""

    def __init__(self, folder: str, shingle: int):
        self.fs, self.base = open_fs(folder)
        self.shingle, self.open, self.held, self.bytes = shingle, {}, {}, 0

    def words(self, place: tuple[str, int, int]) -> list[bytes]:
        import zstandard

        file, start, size = place
        if file not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[file] = self.fs.open_input_file(f"{self.base}/{file}")
        return zstandard.ZstdDecompressor().decompress(self.open[file].read_at(size, start)).split()

    def hashes(self, place: tuple[str, int, int]) -> np.ndarray:
        if place not in self.held:
            made = np.ascontiguousarray(shingle_hashes(self.words(place), self.shingle)[:, 0])
            if self.bytes + made.nbytes > HELD_BYTES:
                self.held.clear()
                self.bytes = 0
            self.held[place] = made
            self.bytes += made.nbytes + 200
        return self.held[place]

    def similar(self, a: tuple[str, int, int], b: tuple[str, int, int]) -> bool:
        """Jaccard similarity of NEAR at least. Equal hashes of unlike shingles could tip a close case, which the texts decide."""
        x, y = self.hashes(a), self.hashes(b)
        if NEAR * max(len(x), len(y)) > min(len(x), len(y)) + 1:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        low, high = (alike_sets(len(x), len(y), both + k) for k in (-2, 2))
        if low == high:
            return high
        return similar(shingle_set(self.words(a), self.shingle), shingle_set(self.words(b), self.shingle))


def confirmed_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, alike) -> list[tuple[int, int]]:
    """Spanning links (row of a, row of b) of the pairs within ``radius`` bits for which ``alike(row, row)`` holds.

    a and b are (rows, 2) halves of fingerprints. A pair is left out only where other links join its rows already.
    """
    label = np.arange(len(a) + (0 if same else len(b)))
    shift, links, step = 0 if same else len(a), [], 64
    for i in range(0, len(a), step):
        first = i if same else 0
        far = np.bitwise_count(a[i: i + step, None, 0] ^ b[None, first:, 0]) + np.bitwise_count(a[i: i + step, None, 1] ^ b[None, first:, 1])
        x, y = np.nonzero(far <= radius)
        x, y = x + i, y + first
        while len(x):
            open_ = (label[x] != label[y + shift])
            x, y = x[open_], y[open_]
            _, one = np.unique(y, return_index=True)  # a try for each row of b; the next only where it isn't joined
            for k in one.tolist():
                u, v = int(x[k]), int(y[k])
                p, q = label[u], label[v + shift]
                if p != q and alike(u, v):
                    label[label == q] = p
                    links.append((u, v))
            x, y = np.delete(x, one), np.delete(y, one)
    return links


def _tile_writer(folder: str):
    """Write a tile's columns into a file of the shared folder; (block, lo, hi, tile) with the range of its set sizes."""

    def pack(block: int, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "fp", "fp2", "id"])
        files = sorted(set(f["file"]))
        at = {x: i for i, x in enumerate(files)}
        place = np.stack([f["file"].map(at).to_numpy(np.int64), f["start"].to_numpy(np.int64), f["size"].to_numpy(np.int64)], 1)
        out, name = io.BytesIO(), f"{uuid.uuid4().hex}.npz"
        fp = np.ascontiguousarray(f[["fp", "fp2"]].to_numpy(np.int64)).view(np.uint64)
        np.savez(out, fp=fp, id=f["id"].to_numpy(np.int64), place=place, files=np.array(files))
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as file:
            file.write(out.getvalue())
        return pd.DataFrame({"block": [block], "lo": [int(f["n"].min())], "hi": [int(f["n"].max())], "tile": [name]})

    return pack


class Tiles:
    """Tiles by file name; the latest TILES_HELD are kept."""

    def __init__(self, folder: str):
        self.fs, self.base = open_fs(folder)
        self.held: dict[str, dict[str, np.ndarray]] = {}

    def __getitem__(self, name: str) -> dict[str, np.ndarray]:
        if name in self.held:
            self.held[name] = self.held.pop(name)
        else:
            if len(self.held) >= TILES_HELD:
                self.held.pop(next(iter(self.held)))
            with self.fs.open_input_file(f"{self.base}/{name}") as f:
                self.held[name] = dict(np.load(io.BytesIO(f.read())))
        return self.held[name]


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """(a, b, a_tile, b_tile) of the pairs of tiles, itself included, whose set sizes can reach NEAR; dealt as squares.

    A set can only be NEAR to one of at least NEAR times its size, that is in the next step of a logarithmic scale at
    most; tiles are ordered by size, so few steps are spanned by one.
    """
    step = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / F.lit(-math.log(NEAR))).cast("int")
    side = lambda s: tiles.select(
        F.col("block").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), F.col("tile").alias(f"{s}_tile"),
        F.explode(F.sequence(step("lo"), step("hi") + 2)).alias("step"))
    near = F.lit(NEAR) * F.greatest("a_lo", "b_lo") <= F.least("a_hi", "b_hi") + 1
    met = side("a").join(side("b"), "step").where((F.col("a") <= F.col("b")) & near)
    pairs = checkpointed(met.select("a", "b", "a_tile", "b_tile").distinct())
    square = [F.expr(f"{s} div {SQUARE}") for s in "ab"]
    width = width_for(pairs.sparkSession, pairs.count())
    return pairs.repartition(width, *square).sortWithinPartitions(*square, "a", "b")


def similar_links(classes: DataFrame, folder: str, radius: int, shingle: int, tile: int) -> DataFrame:
    """Spanning links (u, v) between ids of texts within ``radius`` bits whose shingle sets are ``similar``.

    Tiles are files that tasks read by name; only pairs of names are shuffled.
    """
    tile_folder = scratch_path(classes.sparkSession, "tile-files")
    order = [F.col(c) for c in ("n", "fp", "fp2", "id")]
    tiles = packed_blocks(classes, order, tile, "wide-tiles", "block long, lo long, hi long, tile string", _tile_writer(tile_folder))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, tiles_ = Words(folder, shingle), Tiles(tile_folder)
        for f in frames:
            us, vs = [], []
            for a, b, a_tile, b_tile in zip(f["a"], f["b"], f["a_tile"], f["b_tile"]):
                x, y = tiles_[a_tile], tiles_[b_tile]

                def place(t: dict[str, np.ndarray], row: int) -> tuple[str, int, int]:
                    file, start, size = t["place"][row].tolist()
                    return str(t["files"][file]), start, size

                links = confirmed_links(x["fp"], y["fp"], radius, a == b, lambda u, v: words.similar(place(x, u), place(y, v)))
                us += [x["id"][u] for u, _ in links]
                vs += [y["id"][v] for _, v in links]
            yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return tile_pairs(tiles).mapInPandas(run, "u long, v long")


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """One row of ``docs`` of each group of near copies, as it was.

    Texts whose sets of word shingles have a Jaccard similarity of NEAR or more are linked; candidates are the pairs
    within ``radius`` of 128 bits, and links join groups. The row with the smallest doc_id stays, of rows with
    equal ids the first one; a row without a doc_id stays where no row of its group has one.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "words")
    own = "_row"
    while own in docs.columns:
        own += "_"
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    schema = "row long, doc_id long, digest binary, fp long, fp2 long, n long, file string, start long, size long"
    made = checkpointed(rows.select(F.col(own).alias("_row"), "doc_id", "text").mapInPandas(_word_rows(folder, shingle), schema))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    place = F.min_by(F.struct("fp", "fp2", "n", "file", "start", "size"), "row")
    classes = checkpointed(made.groupBy("digest").agg(F.min("row").alias("id"), best.alias("best"), place.alias("p")).select("id", "best", "p.*"))
    found = components(similar_links(classes.select("id", "fp", "fp2", "n", "file", "start", "size"), folder, radius, shingle, tile))
    group = F.coalesce("component", "id")
    kept = classes.join(found, classes["id"] == found["node"], "left").groupBy(group.alias("group")).agg(F.min("best").alias("best"))
    return rows.join(kept.select(F.col("best.row").alias(own)), own, "left_semi").select(*docs.columns)
