import base64
import hashlib

from seqlab.llm import warc_index as op
from seqlab.llm.common import checkpointed


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, key string, offset int")


def test_round_trip(spark):
    html = [None, "", "a", "b\r\n\r\nc", "é" * 70_000, "a", "a", "", "b\r\n\r\nc", "WARC/1.1\r\n\r\n"]
    urls = [None, "", "http://x.org/p?q=1", "http://x.org/p?q=1", "http://WWW.a.b.c:80/ /é#f", "odd\nurl", "http://x.org/", "//y", "http://x.org/p", "z"]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(urls, html))] + [(50 + i, "http://hot.example.com/", f"body {i % 7}") for i in range(60)]
    for least in (0, 2):
        got = {r["page_id"]: tuple(r)[1:5] for r in op.archived(pages(spark, rows), least, lines=4).collect()}
        last = {}
        for i, _, h in rows:
            last[h or ""] = max(i, last.get(h or "", -1))
        want = {}
        for i, _, h in rows:
            data = (h or "").encode()
            to = last[h or ""] if last[h or ""] != i and len(data) >= least else None
            want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to)
        assert got == want


def test_lookup_finds_only_what_is_there(spark, tmp_path):
    rows = [(i, f"http://h{i % 5}.com/{i}", str(i)) for i in range(100)] + [(3, "http://h3.com/3", "3")] * 9
    caps = op.write_archives(op.with_revisits(pages(spark, rows)), f"{tmp_path}/a")
    index = op.build_index(caps, f"{tmp_path}/i", lines=3)
    known = op.capture_key("http://h3.com/3", op._stamp(3), 3)
    keys = spark.createDataFrame([(known,), ("",), ("zzz",), (known + "0",), (None,), (known,)], "key string")
    found = checkpointed(op.lookup(keys, index, f"{tmp_path}/i"))
    assert {r["key"] for r in found.collect()} == {known} and found.count() == 10
    got = op.read_records(found, f"{tmp_path}/a").collect()
    assert [r["page_id"] for r in got] == [3] * 10 and {bytes(r["payload"]) for r in got if r["payload"] is not None} == {b"3"}


def test_empty(spark):
    assert op.archived(pages(spark, [])).count() == 0
    assert op.archived(pages(spark, [(None, "u", "h")])).count() == 0


def test_keys_sort_by_host_from_the_right():
    assert op.url_key("http://www.B.example.com:8080/x?y") == "com,example,b:8080)/x?y"
    assert op.url_key(None) == ")/"
