"""Conversation repair: damaged turns are found, and each conversation gets its cheapest edits.

Edits turn a conversation's roles into an optional system turn and pairs of user and assistant. The costs to go are
those of a Viterbi search over four states (nothing yet, after system, user, assistant), run from the last row to the
first. It is parallel by rank convergence: rows are sorted once over all tasks and packed into blocks, so a conversation
longer than what is left of a block is a chain of chunks. Every chunk but the last starts from a speculative cost vector;
then fix-up passes give each chunk the vector its successor came to, and rerun it backwards from there until its vectors
differ from the ones before by a constant only, from where on the old ones hold. Passes end when no chunk changes. On
the stitched costs to go an audit is traced from the front by the least letter that keeps the cost. Cost vectors less
their minimum are few, so their steps are looked up. A chunk's trace is a map from start to end state; the maps of a
chain are combined by doubling.

Only chunks of conversations that cross a block's edge take part in exchanges, with a byte or two a row; texts are read
from the block files again by the last pass. Repaired text of such conversations is written chunk by chunk and hashed
in order, one small row a chunk; a hash over a whole text can't be split further.

Defined cases: nulls count as one space (an order or a group of nulls stays null); rows of one turn are taken by the first
64 characters of role and text, then by hash; a repeated row is a duplicate of its first; a role that doesn't start with
s, u or a can't be kept; a conversation without rows has an empty audit, zeros and the hash of nothing; a null conv_id is
a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlab.llm.common import checkpointed, numbered, open_fs, released, stored, width_for
from seqlab.runtime import scratch_path

BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5  # costs
VISIBLE = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
SPACES = " \t\n\v\f\r"
PREFIX = 64

# ---- costs to go and edits of one row, looked up ---------------------------------------

NEVER = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what may follow besides a first system turn
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
FORCED = 8  # a row that has to go; other codes are initial (s, u, a, other) and truncated
INITIALS = ("s", "u", "a", "")


def with_inserts(base: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first; after two of them a state comes back."""
    out = list(base)
    for s in range(4):
        at = s
        for k in (1, 2):
            at = TURN[at]
            out[s] = min(out[s], INSERT * k + base[at])
    return out


def shape_of(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """The costs less their least, and that."""
    least = min(costs)
    return tuple(min(NEVER, c - least) for c in costs), least


ACCEPT = tuple(with_inserts([0, NEVER, NEVER, 0]))
FLAT = (0, 0, 0, 0)


def row_options(code: int, after: tuple[int, ...], s: int) -> list[tuple[str, int, int]]:
    """(edit, cost to go, next state) of a row in state ``s``, by letter."""
    out = [("D", DELETE + after[s], s)]
    if code != FORCED:
        more = TRUNCATED * (code & 1)
        to = KEEPS[INITIALS[code >> 1]].get(s)
        if to is not None:
            out.append(("K", more + after[to], to))
        out.append(("R", REROLE + more + after[TURN[s]], TURN[s]))
    return out


class Steps:
    """Steps of the search by (shape of the costs after the row, code of the row)."""

    def __init__(self):
        self.shapes: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.back: dict[tuple[int, int], tuple[int, int]] = {}
        self.edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    def no(self, shape: tuple[int, ...]) -> int:
        if shape not in self.number:
            self.number[shape] = len(self.shapes)
            self.shapes.append(shape)
        return self.number[shape]

    def before(self, shape: int, code: int) -> tuple[int, int]:
        """Shape of the costs before the row, and the constant they exceed the ones after by."""
        key = (shape, code)
        if key not in self.back:
            after = self.shapes[shape]
            costs = with_inserts([min(c for _, c, _ in row_options(code, after, s)) for s in range(4)])
            got, least = shape_of(costs)
            self.back[key] = (self.no(got), least)
        return self.back[key]

    def trace(self, shape: int, code: int, s: int) -> tuple[str, int]:
        """The least edits by letter that keep the cost: inserts, then the row's own edit; and the state they lead to."""
        key = (shape, code, s)
        if key not in self.edits:
            after, text, at = self.shapes[shape], "", s
            best = with_inserts([min(c for _, c, _ in row_options(code, after, x)) for x in range(4)])
            while True:
                options = row_options(code, after, at) + [("I", INSERT + best[TURN[at]], TURN[at])]
                edit, _, to = min(o for o in options if o[1] == best[at])
                text, at = text + edit, to
                if edit != "I":
                    break
            self.edits[key] = (text, at)
        return self.edits[key]


def end_inserts(s: int) -> str:
    """Inserts that end a conversation in state ``s``."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[s]


def costs_back(steps: Steps, codes: bytes, end: tuple[int, ...], old: list[tuple[int, ...]] | None = None) -> tuple[list[int], int, int]:
    """(shape before each row and after the last, constant, rows run), from the shape ``end`` after the last row.

    With the shapes ``old`` of an earlier run it stops where the costs differ by a constant only, that is in no shape.
    The constant covers the rows run.
    """
    out = [0] * (len(codes) + 1)
    now = out[-1] = steps.no(end)
    known = None if old is None else [steps.no(x) for x in old]
    total = 0
    for i in range(len(codes) - 1, -1, -1):
        now, more = steps.before(now, codes[i])
        total += more
        out[i] = now
        if known is not None and known[i] == now:
            out[:i] = known[:i]
            return out, total, len(codes) - i
    return out, total, len(codes)


def traced(steps: Steps, codes: bytes, shapes: list[int], s: int, last: bool) -> tuple[list[str], int]:
    """Edits by row (inserts before a row's own; the last item those after all rows) and the state they lead to."""
    out = []
    for i, code in enumerate(codes):
        text, s = steps.trace(shapes[i + 1], code, s)
        out.append(text)
    tail = end_inserts(s) if last else ""
    for _ in tail:
        s = TURN[s]
    return [*out, tail], s


def repaired_lines(roles: list[str], texts: list[str], edits: list[str], s: int) -> list[str]:
    """``role:text`` of the rows that edits from state ``s`` leave."""
    out = []
    for i, each in enumerate(edits):
        for e in each:
            if e == "D":
                continue
            if e == "K":
                s = KEEPS[roles[i][:1]][s]
                out.append(f"{roles[i]}:{texts[i]}")
                continue
            s = TURN[s]
            out.append(f"{NAMES[s]}:{texts[i] if e == 'R' else ''}")
    return out


# ---- damage and blocks ----------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a checksum of ``conv_id:turn`` assigns."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_kind"),
    ).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def row_code(role: str, text: str) -> tuple[int, bool]:
    """Code of a row that isn't forced to go, and whether it is blank."""
    seen = text.strip(SPACES)
    cut = bool(seen) and seen[-1] not in ENDS
    first = role[:1]
    return 2 * (INITIALS.index(first) if first in ("s", "u", "a") else 3) + cut, not seen


def digest(role: str, text: str) -> bytes:
    data = role.encode("utf-8", "replace")
    return xxhash.xxh128_digest(b"%d:%b%b" % (len(data), data, text.encode("utf-8", "replace")), 3)


class Block:
    """Rows of a block: roles and texts, and the segments of one conversation each."""

    def __init__(self, roles: list[str], texts: list[str], cuts: list[int]):
        self.roles, self.texts, self.cuts = roles, texts, cuts
        self.codes, self.blank = map(list, zip(*[row_code(r, t) for r, t in zip(roles, texts)])) if roles else ([], [])

    def segments(self) -> Iterator[tuple[int, int]]:
        return zip(self.cuts[:-1], self.cuts[1:])

    def repeated(self, known: set[int]) -> list[bool]:
        """Rows whose role and text are seen earlier in their segment, or are in ``known`` (rows seen in earlier blocks)."""
        out = []
        for a, b in self.segments():
            seen: set[tuple[str, str]] = set()
            for i in range(a, b):
                key = (self.roles[i], self.texts[i])
                out.append(key in seen or i in known)
                seen.add(key)
        return out


def packed_rows(roles: list[str], texts: list[str]) -> bytes:
    import pyarrow as pa
    import zstandard

    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(roles, pa.large_string()), pa.array(texts, pa.large_string())], ["role", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unpacked_rows(data: bytes) -> tuple[list[str], list[str]]:
    import pyarrow as pa
    import zstandard

    batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


class Files:
    """Reads pieces (file, start, size) of files in the shared folder."""

    def __init__(self, folder: str):
        self.fs, self.base = open_fs(folder)
        self.name, self.file = None, None

    def read(self, name: str, start: int, size: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.base}/{name}")
        return self.file.read_at(size, start)


class Writer:
    """Appends pieces to one new file of a task, opened when the first is written."""

    def __init__(self, folder: str):
        self.fs, self.base = open_fs(folder)
        self.name, self.at, self.out = f"{uuid.uuid4().hex}.rows", 0, None

    def write(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.out.write(data)
        place = (self.name, self.at, len(data))
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def sorted_blocks(rows: DataFrame, folder: str, block_rows: int, block_bytes: int) -> DataFrame:
    """Write sorted rows into block files; (convs, cuts, firsts, lasts, turns, lows, highs, file, start, size, block), one row a block.

    convs and cuts describe its segments; lows/highs/firsts/lasts are a segment's least, greatest, first and last turn, turns
    its number of distinct ones. Blocks are numbered in the order of the rows.
    """
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    tie = [F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX), F.xxhash64("role", "text")]
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *tie, F.col("_row")]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    conv, turn = (T.ArrayType(rows.schema[c].dataType) for c in ("conv_id", "turn"))
    schema = T.StructType([
        T.StructField("convs", conv), T.StructField("cuts", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, turn) for c in ("firsts", "lasts", "lows", "highs")], T.StructField("turns", T.ArrayType(T.IntegerType())),
        T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType()),
    ])

    def run(batches):
        import pyarrow as pa

        target = schema_arrow
        writer = Writer(folder)
        convs, turns, roles, texts, size = [], [], [], [], 0

        def flush():
            nonlocal convs, turns, roles, texts, size
            cuts = [0] + [i for i in range(1, len(convs)) if convs[i] != convs[i - 1]] + [len(convs)]
            own = [turns[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            known = [[t for t in x if t is not None] for x in own]
            place = writer.write(packed_rows(roles, texts))
            columns = [
                [convs[a] for a in cuts[:-1]], cuts, [x[0] for x in own], [x[-1] for x in own], [min(x, default=None) for x in known],
                [max(x, default=None) for x in known], [len(set(x)) for x in known], *place,
            ]
            convs, turns, roles, texts, size = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, target)], schema=target)

        for b in batches:
            for c, t, r, x in zip(*[b.column(k).to_pylist() for k in range(4)]):
                convs.append(c)
                turns.append(t)
                roles.append(r)
                texts.append(x)
                size += len(x) + len(r)
                if len(convs) >= block_rows or size >= block_bytes:
                    yield flush()
        if convs:
            yield flush()
        writer.close()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_arrow = to_arrow_schema(schema)
    return stored(numbered(ranged.select("conv_id", "turn", "role", "text").mapInArrow(run, schema), "block"), "turn-blocks")


# ---- chains of chunks -------------------------------------------------------------------


def chained(blocks: DataFrame) -> DataFrame:
    """Blocks with before/after: whether the first and the last segment go on in a neighbouring block."""
    ends = checkpointed(blocks.select("block", F.get("convs", F.lit(0)).alias("a"), F.element_at("convs", -1).alias("b")))
    left = ends.select((F.col("block") + 1).alias("block"), F.col("b").alias("_b"), F.lit(True).alias("_has_b"))
    right = ends.select((F.col("block") - 1).alias("block"), F.col("a").alias("_a"), F.lit(True).alias("_has_a"))
    met = ends.join(left, "block", "left").join(right, "block", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    marks = met.select(
        "block", known(F.col("_has_b") & F.col("a").eqNullSafe(F.col("_b"))).alias("before"),
        known(F.col("_has_a") & F.col("b").eqNullSafe(F.col("_a"))).alias("after"))
    return stored(blocks.join(marks, "block"), "chained")


def edge_segments(before: bool, after: bool, n: int) -> list[int]:
    """Numbers of a block's segments that go on in a neighbour."""
    return sorted({*([0] if before else []), *([n - 1] if after else [])})


def dealt(blocks: DataFrame) -> DataFrame:
    """Blocks over tasks by their number: a row is small, but stands for a block's texts."""
    return blocks.repartition(width_for(blocks.sparkSession, blocks.count()), "block")


PLACE = ("block", "cuts", "file", "start", "size", "before", "after")


def late_repeats(blocks: DataFrame, folder: str) -> DataFrame:
    """(block, rows): rows whose role and text an earlier block of their conversation has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Files(folder)
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                roles, texts = unpacked_rows(files.read(r["file"], r["start"], r["size"]))
                cuts = list(r["cuts"])
                for k in edge_segments(r["before"], r["after"], len(cuts) - 1):
                    seen = set()
                    for i in range(cuts[k], cuts[k + 1]):
                        key = digest(roles[i], texts[i])
                        if key not in seen:
                            seen.add(key)
                            out.append((r["block"], i, k, key))
            yield pd.DataFrame(out, columns=["block", "i", "k", "key"])

    edges = blocks.where("before OR after")
    rows = dealt(edges.select(*PLACE)).mapInPandas(run, "block long, i int, k int, key binary")
    name = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))
    convs = edges.select("block", F.posexplode("convs").alias("k", "conv")).withColumn("conv", name)
    named = checkpointed(rows.join(convs, ["block", "k"]))
    first = named.groupBy("conv", "key").agg(F.min("block").alias("block"))
    # a row is its conversation's first where its block is the least; (conv, key, block) occurs once
    late = named.join(first, ["conv", "key", "block"], "left_anti")
    return late.groupBy("block").agg(F.collect_list("i").alias("late"))


def block_codes(files: Files, r: dict) -> tuple[Block, list[int], list[bool]]:
    """The block's rows, their codes with forced rows, and which are repeats."""
    late = r.get("late")
    block = Block(*unpacked_rows(files.read(r["file"], r["start"], r["size"])), list(r["cuts"]))
    again = block.repeated(set() if late is None else set(late))
    again = [a and not b for a, b in zip(again, block.blank)]
    return block, [FORCED if a or b else c for a, b, c in zip(again, block.blank, block.codes)], again


SHAPE = "array<int>"


def chunk_chains(blocks: DataFrame, folder: str) -> DataFrame:
    """(block, k, codes, shapes, first, last) of the segments of chained blocks, run from speculative costs unless the last."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, steps = Files(folder), Steps()
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                cuts = list(r["cuts"])
                _, codes, _ = block_codes(files, r)
                for k in edge_segments(r["before"], r["after"], len(cuts) - 1):
                    last = not (r["after"] and k == len(cuts) - 2)
                    first = not (r["before"] and k == 0)
                    own = bytes(codes[cuts[k]: cuts[k + 1]])
                    got, _, _ = costs_back(steps, own, ACCEPT if last else FLAT)
                    out.append((r["block"], own, packed_shapes(steps, got), first, last, list(steps.shapes[got[0]]), True))
            yield pd.DataFrame(out, columns=["block", "codes", "shapes", "first", "last", "entry", "moved"])

    return dealt(blocks.where("before OR after").select(*PLACE, "late")).mapInPandas(run, CHUNKS)


CHUNKS = f"block long, codes binary, shapes binary, first boolean, last boolean, entry {SHAPE}, moved boolean"


def packed_shapes(steps: Steps, numbers: list[int]) -> bytes:
    return np.array([steps.shapes[n] for n in numbers], np.int32).tobytes()


def unpacked_shapes(data: bytes) -> list[tuple[int, ...]]:
    return list(map(tuple, np.frombuffer(data, np.int32).reshape(-1, 4).tolist()))


def settled(chunks: DataFrame) -> DataFrame:
    """Fix-up passes over the chunks until no vector changes but by a constant."""
    chunks = stored(chunks, "chunks")
    spark = chunks.sparkSession
    while chunks.where("moved AND NOT first").limit(1).count():
        # a chunk's successor is the chain's first segment of the next block
        coming = chunks.where("NOT first AND moved").select((F.col("block") - 1).alias("block"), F.lit(False).alias("last"), F.col("entry").alias("given"))
        met = chunks.join(coming, ["block", "last"], "left")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            steps = Steps()
            for f in frames:
                f["moved"] = False
                for i, given in zip(f.index, f["given"]):
                    if given is None:
                        continue
                    old = unpacked_shapes(f.at[i, "shapes"])
                    end = tuple(int(x) for x in given)
                    if old[-1] == end:
                        continue
                    got, _, _ = costs_back(steps, f.at[i, "codes"], end, old)
                    f.at[i, "shapes"] = packed_shapes(steps, got)
                    entry = steps.shapes[got[0]]
                    f.at[i, "moved"] = entry != old[0]
                    f.at[i, "entry"] = list(entry)
                yield f.drop(columns="given")

        chunks = stored(met.select(*chunks.columns, "given").mapInPandas(run, CHUNKS), "chunks")
        released(spark)
    return chunks


def start_states(chunks: DataFrame) -> DataFrame:
    """(block, last, state): the state each chunk starts in, from the maps of the chunks before it combined by doubling."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = Steps()
        for f in frames:
            maps = []
            for codes, shapes in zip(f["codes"], f["shapes"]):
                own = [steps.no(x) for x in unpacked_shapes(shapes)]
                maps.append([traced(steps, codes, own, s, False)[1] for s in range(4)])
            yield pd.DataFrame({"block": f["block"], "first": f["first"], "last": f["last"], "to": maps})

    # the chunk of a chain in a block that goes on is unique, as is the one that comes in
    maps = checkpointed(chunks.mapInPandas(run, "block long, first boolean, last boolean, to array<int>"))
    # reach: how many blocks a map covers, up to its chain's first chunk (done)
    now = checkpointed(maps.where("NOT last").select("block", "to", F.col("first").alias("done")))
    reach = 1
    while now.where("NOT done").limit(1).count():
        back = now.select((F.col("block") + reach).alias("block"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        met = now.where("NOT done").join(back, "block")
        longer = met.select("block", F.transform("_to", lambda s: F.get("to", s)).alias("to"), F.col("_done").alias("done"))
        now = checkpointed(now.where("done").unionByName(longer))
        reach *= 2
    ends = now.select((F.col("block") + 1).alias("block"), F.get("to", F.lit(0)).alias("state"))
    return maps.where("NOT first").select("block", "last").join(ends, "block").unionByName(
        maps.where("first").select("block", "last", F.lit(START).alias("state")))


# ---- results ---------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
PIECES = (
    "block long, k int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "sha string, file string, start long, size long, head string, tail string"
)
LEGAL = {"su", "ua", "au"}


def edit_cost(edits: list[str], codes: list[int]) -> int:
    total = 0
    for i, each in enumerate(edits):
        for e in each:
            total += {"D": DELETE, "K": 0, "R": REROLE, "I": INSERT}[e]
            if e in "KR" and codes[i] != FORCED and codes[i] & 1:
                total += TRUNCATED
    return total


def pieces(blocks: DataFrame, folder: str, out_folder: str) -> DataFrame:
    """One row per segment with its counts, audit and repaired text: hashed where it is the whole conversation, else written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, steps, writer = Files(folder), Steps(), Writer(out_folder)
        for f in frames:
            for r in f.to_dict("records"):
                block, codes, again = block_codes(files, r)
                cuts, out = block.cuts, []
                given = {bool(c["last"]): c for c in (r["chunks"] if r["chunks"] is not None else [])}
                whole = set(range(len(cuts) - 1)) - set(edge_segments(r["before"], r["after"], len(cuts) - 1))
                for k, (a, b) in enumerate(block.segments()):
                    own = bytes(codes[a:b])
                    goes_on = r["after"] and k == len(cuts) - 2
                    if k in whole:
                        state, shapes = START, costs_back(steps, own, ACCEPT)[0]
                    else:
                        chunk = given[not goes_on]
                        state, shapes = chunk["state"], [steps.no(x) for x in unpacked_shapes(chunk["shapes"])]
                    edits, _ = traced(steps, own, shapes, state, not goes_on)
                    roles, texts = block.roles[a:b], block.texts[a:b]
                    lines = repaired_lines(roles, texts, edits, state)
                    data = "\n".join(lines).encode("utf-8", "replace")
                    place = (None, None, None)
                    if k not in whole and lines:
                        place = writer.write(data)
                    cut = sum(c != FORCED and c & 1 for c in own)
                    illegal = sum(x[:1] + y[:1] not in LEGAL for x, y in zip(roles[:-1], roles[1:]))
                    out.append((
                        r["block"], k, sum(block.blank[a:b]), sum(again[a:b]), cut, illegal, edit_cost(edits, own), "".join(edits),
                        hashlib.sha256(data).hexdigest() if k in whole else None, *place, roles[0][:1], roles[-1][:1],
                    ))
                made = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                made[["start", "size"]] = made[["start", "size"]].astype("Int64")
                yield made
        writer.close()

    return dealt(blocks.select(*PLACE, "late", "chunks")).mapInPandas(run, PIECES)


def joined_chain(folder: str):
    """Merge the pieces of one conversation, in order; its repaired text is hashed as it is read."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        files, h, some = Files(folder), hashlib.sha256(), False
        for name, start, size in zip(f["file"], f["start"], f["size"]):
            if name is None or pd.isna(start):
                continue
            if some:
                h.update(b"\n")
            some = True
            for at in range(int(start), int(start) + int(size), 1 << 24):
                h.update(files.read(name, at, min(1 << 24, int(start) + int(size) - at)))
        first, last = list(f["first"]), list(f["last"])
        known = lambda x: x is not None and not pd.isna(x)
        shared = sum(known(x) and known(y) and x == y for x, y in zip(last[:-1], first[1:]))
        heads, tails = list(f["head"]), list(f["tail"])
        between = sum(x + y not in LEGAL for x, y in zip(tails[:-1], heads[1:]))
        lows, highs = [x for x in f["low"] if known(x)], [x for x in f["high"] if known(x)]
        gaps = int(max(highs)) - int(min(lows)) + 1 - (int(f["turns"].sum()) - shared) if lows else 0
        conv = pd.Series([key[0]]) if known(key[0]) else pd.Series([None], dtype=object)
        out = {"conv": conv, "gaps": [gaps], **{c: [int(f[c].sum())] for c in COUNTS}}
        out["illegal"] = [out["illegal"][0] + between]
        return pd.DataFrame({**out, "audit": ["".join(f["audit"])], "sha": [h.hexdigest()]})

    return run


def repaired(conversations: DataFrame, damage: bool = True, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    Without ``damage`` the rows are repaired as they are.
    """
    spark = conversations.sparkSession
    folder, out_folder = scratch_path(spark, "turns"), scratch_path(spark, "repaired")
    space = F.lit(" ")
    plain = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    blocks = chained(sorted_blocks(damaged(conversations) if damage else plain, folder, block_rows, block_bytes))
    late = late_repeats(blocks, folder)
    ready = stored(blocks.join(late, "block", "left"), "ready")
    chunks = settled(chunk_chains(ready, folder))
    states = start_states(chunks)
    given = chunks.join(states, ["block", "last"]).groupBy("block").agg(F.collect_list(F.struct("last", "state", "shapes")).alias("chunks"))
    found = stored(pieces(ready.join(given, "block", "left"), folder, out_folder), "pieces")
    of = ready.select("block", F.posexplode(F.arrays_zip("convs", "firsts", "lasts", "lows", "highs", "turns")).alias("k", "_s")).select(
        "block", "k", F.col("_s.convs").alias("conv"), F.col("_s.firsts").alias("first"), F.col("_s.lasts").alias("last"),
        F.col("_s.lows").alias("low"), F.col("_s.highs").alias("high"), F.col("_s.turns").alias("turns"))
    named = found.join(of, ["block", "k"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = named.where("sha IS NOT NULL").select("conv", gaps.alias("gaps"), *COUNTS, "audit", "sha")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", *COUNTS))
    parts = named.where("sha IS NULL").drop("sha", "k").groupBy("conv").applyInPandas(
        joined_chain(out_folder), f"conv {kind}, {counts}, audit string, sha string")
    all_ = whole.unionByName(parts)
    ids = conversations.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.join(all_, ids["conv_id"].eqNullSafe(all_["conv"]), "left").select(
        "conv_id", zero("gaps"), *[zero(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
