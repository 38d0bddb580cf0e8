"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record into archive files of the shared folder, a revisit
record for a payload that another record holds. ``build_index`` sorts the captures by key (reversed host,
path, time, id) over range partitions; each partition writes its captures as compressed blocks of LINES
lines into one file, followed by a sparse directory with the first key and the place of every block.
``lookup`` sends each wanted key to its partition, binary-searches that directory, range-reads one block
and binary-searches its lines. ``read_records`` then range-reads the records, in order of their place.

Only one row per index partition (its first key) is held by every task. Files of a lost attempt keep
their own names and are never referred to; what the next step needs is checkpointed.

Defined cases: a null html is an empty payload; a null or odd url is indexed under what it has (host empty);
equal urls, and rows equal in all columns, are separate captures; a row without page_id is not a capture
and is left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, open_fs, salted_join
from seqlab.runtime import scratch_path, shuffle_width

LINES = 300
FILE_BYTES = 128 << 20
MERGE_GAP = 64 << 10
READ_BYTES = 4 << 20
TASK_BYTES = 64 << 20
BLANK = b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Reversed host, then port and path, in lower case, free of spaces: ``com,example,www)/a?b``."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", (url or "").strip().lower())
    host, port, path = m.groups() if m else ("", "", (url or "").strip().lower())
    host = host.removeprefix("www.")
    return re.sub(r"[\s\x00-\x1f]", lambda x: f"%{ord(x[0]):02x}", f"{','.join(reversed(host.split('.')))}{port or ''}){path or '/'}")


def capture_key(url: str | None, stamp: str, number: int) -> str:
    """Key a capture is sorted by; the id makes it unique among captures of one url and time."""
    return f"{url_key(url)} {stamp} {number:020d}"


def _stamp(seconds: int) -> str:
    return pd.Timestamp(seconds % 253_402_300_800, unit="s").strftime("%Y%m%d%H%M%S")


def record_bytes(r: dict, payload: bytes) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if r["record_type"] == "response" else b"")
    t = r["stamp"]
    lines = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <urn:capture:{r['page_id']}>",
        f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", r["url"] or ""), f"WARC-Payload-Digest: sha1:{r['digest']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if r["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{r['refers_to']}>"]
    data = "\r\n".join(lines).encode("utf-8", "replace") + BLANK + body + BLANK
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse_record(member: bytes) -> dict:
    data = gzip.decompress(member)
    head, _, rest = data.partition(BLANK)
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8").split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(BLANK)
    full = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    revisit = fields["warc-type"] == "revisit"
    number = lambda x: int(re.search(r"capture:(-?\d+)", x)[1])
    return {
        "page_id": number(fields["warc-record-id"]), "payload_bytes": full, "record_type": fields["warc-type"],
        # a response's digest is that of what was read back; a revisit has no payload of its own
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else digest_of(payload),
        "refers_to": number(fields["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload, "url": fields["warc-target-uri"],
    }


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: the largest page_id with the same payload, null for that page itself and for payloads under ``least_bytes``."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where("page_id IS NOT NULL").select("page_id", "url", html.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    groups = checkpointed(
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    joined = salted_join(rows, groups, "sha", "_n", F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows; return (key, page_id, file, offset, length, record_type, digest)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for f in frames:
            rows = []
            for page, url, payload, to in zip(f["page_id"], f["url"], f["payload"], f["refers_to"].astype("Int64")):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                r = {"page_id": int(page), "url": url, "stamp": _stamp(int(page)), "digest": digest_of(payload)}
                r |= {"refers_to": to, "record_type": "response" if pd.isna(to) else "revisit"}
                data = record_bytes(r, payload)
                out.write(data)
                rows.append((capture_key(url, r["stamp"], r["page_id"]), r["page_id"], name, at, len(data), r["record_type"], r["digest"]))
                at += len(data)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length", "record_type", "digest"])
        if out is not None:
            out.close()

    schema = "key string, page_id long, file string, offset long, length long, record_type string, digest string"
    return checkpointed(pages.mapInPandas(run, schema))


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Write the index of ``captures``; return (first, file, directory): one row per index partition, in key order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        name = f"{uuid.uuid4().hex}.idx"
        out, at, directory, held = None, 0, [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(held).encode(), 6)
            out.write(data)
            directory.append([held[0].split("\t", 1)[0], at, len(data)])
            at += len(data)
            held.clear()

        for f in frames:
            for key, file, offset, length in zip(f["key"], f["file"], f["offset"], f["length"]):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                held.append(f"{key}\t{file}\t{offset}\t{length}")
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pd.DataFrame({"first": [directory[0][0]], "file": [name], "at": [at], "size": [len(data)]})

    ordered = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key")
    return checkpointed(ordered.mapInPandas(run, "first string, file string, at long, size long"))


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(key, file, offset, length) of every (key) row that the index holds.

    ``index`` has one row per index partition; those rows are held by every task.
    """
    parts = sorted((r["first"], r["file"], r["at"], r["size"]) for r in index.collect())
    firsts = [p[0] for p in parts]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = [bisect.bisect_right(firsts, k) - 1 for k in f["key"]]
            yield pd.DataFrame({"key": f["key"], "part": at})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        opened, handle, directory, heads, block = -1, None, [], [], (-1, [], [])
        for f in frames:
            rows = []
            for key, part in zip(f["key"], f["part"]):
                if part < 0:
                    continue
                if part != opened:
                    if handle is not None:
                        handle.close()
                    _, name, at, size = parts[part]
                    handle = fs.open_input_file(f"{base}/{name}")
                    directory = json.loads(zlib.decompress(handle.read_at(size, at)))
                    heads, opened, block = [d[0] for d in directory], part, (-1, [], [])
                # equal keys may lie in several blocks: from the last block that starts below the key, onward
                for b in range(max(0, bisect.bisect_left(heads, key) - 1), len(heads)):
                    if heads[b] > key:
                        break
                    if b != block[0]:
                        lines = zlib.decompress(handle.read_at(directory[b][2], directory[b][1])).decode().split("\n")
                        block = (b, [x.split("\t", 1)[0] for x in lines], lines)
                    i = bisect.bisect_left(block[1], key)
                    while i < len(block[1]) and block[1][i] == key:
                        _, file, offset, length = block[2][i].split("\t")
                        rows.append((key, file, int(offset), int(length)))
                        i += 1
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])
        if handle is not None:
            handle.close()

    placed = keys.select("key").where("key IS NOT NULL").distinct().mapInPandas(place, "key string, part int")
    # a task per index part at least: its rows stand for blocks to read, and Spark would join tasks by the bytes of rows
    tasks = max(len(parts), shuffle_width(keys.sparkSession))
    dealt = placed.repartitionByRange(tasks, "part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInPandas(run, "key string, file string, offset long, length long")


def read_records(places: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at (file, offset, length), read in order of place; neighbours share one range read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        for f in frames:
            rows = list(zip(f["file"], f["offset"], f["length"]))
            at, out = 0, []
            while at < len(rows):
                to, (name, start, size) = at + 1, rows[at]
                end = start + size
                while to < len(rows) and rows[to][0] == name and rows[to][1] <= end + MERGE_GAP and rows[to][1] + rows[to][2] - start <= READ_BYTES:
                    end = max(end, rows[to][1] + rows[to][2])
                    to += 1
                with fs.open_input_file(f"{base}/{name}") as handle:
                    data = handle.read_at(int(end - start), int(start))
                for _, o, n in rows[at:to]:
                    r = parse_record(data[o - start: o - start + n])
                    if not payloads:
                        r["payload"] = None
                    out.append(r)
                at = to
            got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
            yield got.assign(refers_to=got["refers_to"].astype("Int64"))

    # ``places`` is read twice; tasks by the bytes of the records, not of the rows that name them
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(shuffle_width(places.sparkSession), int(total // TASK_BYTES) + 1)
    dealt = places.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return dealt.mapInPandas(run, schema)


def archived(pages: DataFrame, least_bytes: int = 0, lines: int = LINES, payloads: bool = False) -> DataFrame:
    """Write every page, index the archives, find every capture again by its key and read its record."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    captures = write_archives(with_revisits(pages, least_bytes), f"{folder}/archives")
    index = build_index(captures, f"{folder}/index", lines)
    places = checkpointed(lookup(captures.select("key"), index, f"{folder}/index"))
    return read_records(places, f"{folder}/archives", payloads)
