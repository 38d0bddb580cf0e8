"""Large JSON objects read in byte ranges, so that one file is the work of many tasks.

A range can't know by itself whether it starts inside a string, or how deep. A first pass sums up every range for
both cases (quotes, brackets outside and inside of strings); running sums over a file's ranges, a row each, settle the
case. A second pass then cuts out the items that begin in its range and reads on to the end of the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab import runtime

SPLIT_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
LEAST_MORE = 4096  # bytes read beyond a range at first
NO_KEY, UNREAD = -1, -2
QUOTE, SLASH, COMMA, COLON = b'"\\,:'
OPENING, CLOSING = np.zeros(256, bool), np.zeros(256, bool)
OPENING[list(b"{[")] = CLOSING[list(b"}]")] = True
MARKS = OPENING | CLOSING
MARKS[[COMMA, COLON]] = True


def _opened(path: str):
    fs, place = runtime.open_fs(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.open_input_file(place)


def _slashes_before(handle, at: int) -> int:
    """Length of the run of backslashes that ends before ``at``."""
    count = 0
    while at > 0:
        part = handle.read_at(min(at, 4096), max(0, at - 4096))
        rest = len(part.rstrip(b"\\"))
        count += len(part) - rest
        if rest:
            break
        at -= len(part)
    return count


def _quoted(codes: np.ndarray, slashes: int) -> tuple[np.ndarray, bool]:
    """Whether each byte lies behind an odd number of quotes that are not escaped (the opening quote included)."""
    at = np.arange(len(codes))
    last_other = np.maximum.accumulate(np.where(codes != SLASH, at, -1 - slashes))
    before = np.concatenate([[-1 - slashes], last_other[:-1]])  # the last byte before this one that is no backslash
    real = (codes == QUOTE) & ((at - 1 - before) % 2 == 0)
    odd = np.cumsum(real) % 2 == 1
    return odd, bool(odd[-1]) if len(odd) else False


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, at, end in zip(f["file"], f["at"], f["end"]):
            with _opened(path) as handle:
                data = handle.read_at(end - at, at)
                odd, turns = _quoted(np.frombuffer(data, np.uint8), _slashes_before(handle, at))
            codes = np.frombuffer(data, np.uint8)
            step = OPENING[codes].astype(np.int8) - CLOSING[codes].astype(np.int8)
            rows.append((path, at, end, turns, int(step[~odd].sum()), int(step[odd].sum()), at == 0 and data.lstrip()[:1] == b"{"))
        yield pd.DataFrame(rows, columns=["file", "at", "end", "turns", "outside", "inside", "opens"])


def _marks(data: bytes, inside: bool, slashes: int, depth: int):
    """Places, codes and depths (after them) of the marks outside of strings."""
    codes = np.frombuffer(data, np.uint8)
    odd, _ = _quoted(codes, slashes)
    place = np.flatnonzero(MARKS[codes] & (odd == inside))
    code = codes[place]
    return place, code, depth + np.cumsum(OPENING[code].astype(np.int64) - CLOSING[code])


def _items(size: int, limit: int, place, code, depth, level: int) -> list[tuple[int, int, bool, int]]:
    """(from, to, whole, colon) of the stretches that begin below ``limit`` between the marks that part the items of ``level``.

    The last may lack its end, then ``to`` is ``size``. ``colon`` ends the item's key; NO_KEY without one, UNREAD where it may follow.
    """
    starts = (OPENING[code] & (depth == level)) | ((code == COMMA) & (depth == level))
    stops = ((code == COMMA) & (depth == level)) | (CLOSING[code] & (depth == level - 1))
    at, ends = np.flatnonzero(starts & (place < limit)), np.flatnonzero(stops)
    j = np.searchsorted(ends, at, "right")
    whole = j < len(ends)
    to = np.append(place[ends], size)[j]
    after = np.minimum(at + 1, len(place) - 1)  # the mark behind an item's first one
    keyed = (at + 1 < len(place)) & (place[after] <= to) & (code[after] == COLON) & (depth[after] == level)
    colon = np.where(keyed, place[after], np.where(at + 1 < len(place), NO_KEY, UNREAD))
    return list(zip(place[at].tolist(), to.tolist(), whole.tolist(), colon.tolist()))


def _cut(level: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "range", "at", "key", "field", "body", "kind"]
        for f in frames:
            for path, at, end, inside, depth in zip(f["file"], f["at"], f["end"], f["inside_string"], f["depth"]):
                rows, size = [], 0
                with _opened(path) as handle:
                    slashes, total = _slashes_before(handle, at), handle.size()
                    limit = end - at
                    more = max(LEAST_MORE, limit // 16)  # in proportion: what is read beyond a range is read again by the next
                    while True:  # twice as far each time, until the items that begin here end
                        data = handle.read_at(min(limit + more, total - at), at)
                        found = _marks(data, bool(inside), slashes, int(depth))
                        cut = {n: _items(len(data), limit, *found, n) for n in {1, 2, level} if n <= level}
                        # of outer items only the name is needed
                        open_ends = any(not x[2] and (n == level or x[3] == UNREAD) for n, items in cut.items() for x in items)
                        if not open_ends or at + len(data) >= total:
                            break
                        more *= 2
                events = sorted((x[0], n, x) for n, items in cut.items() for x in items)
                key = field = None
                for begin, n, x in events:
                    text = data[x[0] + 1: x[1]]
                    if n == level:
                        if n > 1 and _name(data, x):
                            kind = None  # of an object, not of a list
                        elif not text.strip():
                            kind = "bad" if data[x[0]: x[0] + 1] == b"," or data[x[1]: x[1] + 1] == b"," else None
                            text = b""
                        else:
                            kind = "item" if x[2] and _parses(b"{%s}" % text if level == 1 else text) else "bad"
                        if kind:
                            rows.append((path, at, at + begin, key, field, text.decode("utf-8", "replace") if kind == "item" else None, kind))
                            size += len(text)
                    else:
                        name = _name(data, x)
                        if n == 1:
                            key, field = name or None, ""
                        else:
                            field = name
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                rows.append((path, at, end, key, field, None, "last"))
                yield pd.DataFrame(rows, columns=columns)

    return run


def _name(data: bytes, item: tuple[int, int, bool, int]) -> str | None:
    """An item's key as JSON text; empty where it has none, None where the key's end is not read yet."""
    if item[3] >= 0:
        return data[item[0] + 1: item[3]].decode("utf-8", "replace").strip()
    return "" if item[3] == NO_KEY else None


def _parses(text: bytes) -> bool:
    try:
        json.loads(text)
    except ValueError:  # also invalid UTF-8
        return False
    return True


def _ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """(file, at, end, inside_string, depth) of every range of well-formed files, in a checkpoint."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    steps = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    cuts = files.select(F.col("path").alias("file"), "length", F.explode(steps).alias("at"))
    cuts = cuts.select("file", "at", F.least(F.col("at") + split_bytes, "length").alias("end"))
    dealt = cuts.repartition(runtime.shuffle_width(spark), "file", "at")
    known = runtime.pin(dealt.mapInPandas(
        _summaries, "file string, at long, end long, turns boolean, outside long, inside long, opens boolean"
    ))
    order = Window.partitionBy("file").orderBy("at")  # a row per range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1
    placed = known.withColumn("inside_string", inside).withColumn("_step", F.when(F.col("inside_string"), F.col("inside")).otherwise(F.col("outside")))
    whole = Window.partitionBy("file")
    sound = (F.sum("_step").over(whole) == 0) & (F.sum(F.col("turns").cast("int")).over(whole) % 2 == 0)
    sound &= F.max("opens").over(whole)
    depth = F.coalesce(F.sum("_step").over(before), F.lit(0))
    return placed.select("file", "at", "end", "inside_string", depth.alias("depth"), sound.alias("_sound")).where("_sound").drop("_sound")


def json_items(spark: SparkSession, path: str, level: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, at, key, field, body) of the items of JSON objects, one object in each file.

    ``level`` 1: the entries of the object; ``body`` is ``"name": value``, key and field are null. An entry is read by
    one task. ``level`` 3: the elements of lists inside of entries (``{key: {field: [body, ..]}}``), however long the list; key and
    field are JSON text. ``at`` is the byte before an item, so (file, at) is their order. Repeated names come repeatedly.
    Empty files and objects give no rows, as does a file whose brackets or quotes don't match, that doesn't start with
    an object, or of which an item is not JSON. Objects that follow one another in a file are read as one.
    """
    if level not in (1, 3):
        raise ValueError("level is 1 or 3")
    dealt = _ranges(spark, path, split_bytes).repartition(runtime.shuffle_width(spark), "file", "at")
    schema = "file string, range long, at long, key string, field string, body string, kind string"
    found = runtime.stored(dealt.mapInPandas(_cut(level), schema), "json-items")
    bad = found.where("kind = 'bad'").select("file").distinct()
    items = found.where("kind = 'item'").join(bad, "file", "left_anti")
    if level == 1:
        return items.select("file", "at", "key", "field", "body")
    # the names that a range starts with are the last ones of the ranges before it; a new key ends the field before it
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = found.where("kind = 'last'").select(
        "file", "range", F.last("key", True).over(before).alias("_key"), F.last("field", True).over(before).alias("_field")
    )
    return items.join(lasts, ["file", "range"], "left").select(
        "file", "at", F.coalesce("key", "_key").alias("key"), F.coalesce("field", "_field").alias("field"), "body"
    )
