import json
import os

import pytest
from pyspark.sql import functions as F

from seqlab.streaming import ingest


def _trace(*calls):
    return json.dumps({"behavior": {"processes": [{"calls": [{"api": c} for c in calls]}]}})


@pytest.fixture()
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def once(**options):
        files = ingest.stream_trace_files(spark, str(tmp_path / "in"), **options)
        ingest.ingest_traces(files, str(tmp_path / "store"), str(tmp_path / "log")).awaitTermination()

    def put(name, text):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    def rows():
        return {r["fname"]: r for r in ingest.ingested(spark, str(tmp_path / "store")).collect()}

    def counts():
        return {r["batch"]: r.asDict() for r in ingest.ingest_counts(spark, str(tmp_path / "store")).collect()}

    return once, put, rows, counts, tmp_path


def test_bad_files_are_set_aside(run):
    once, put, rows, counts, _ = run
    put("a.json", _trace("NtOpen", "NtClose"))
    put("b.json", '{"behavior":')
    put("c.json", _trace())
    put("d.json", b"")  # no bytes, no row
    put("e.json", _trace("x" * 5000))
    put("f.json", _trace("Nt").encode().replace(b"Nt", b"n\xff"))
    once(longest=2000)
    found = rows()
    states = {n: r["status"] for n, r in found.items()}
    assert states == {"a.json": "ok", "b.json": "unparsed", "c.json": "empty", "e.json": "too_long", "f.json": "ok"}
    assert list(found["a.json"]["sequence"]) == ["ntopen", "ntclose"] and list(found["f.json"]["sequence"]) == ["n�"]
    (only,) = counts().values()
    assert (only["files"], only["ok"], only["empty"], only["unparsed"], only["too_long"], only["calls"]) == (5, 2, 1, 1, 1, 3)


def test_a_second_run_reads_new_files_only(run):
    once, put, rows, counts, _ = run
    once()  # nothing there yet
    assert rows() == {} and counts() == {}
    for i in range(5):
        put(f"r{i}.json", _trace(f"c{i}"))
    once(files_per_batch=2)
    first = counts()
    assert sum(c["files"] for c in first.values()) == 5 and max(c["files"] for c in first.values()) == 2
    once()
    assert counts() == first
    put("r9.json", _trace("late"))
    put("again/r0.json", _trace("other"))  # a name that is stored keeps its first row
    put("r8.json", "{")
    once()
    new = {b: c for b, c in counts().items() if b not in first}
    assert sum(c["files"] for c in new.values()) == 3
    assert {n: list(r["sequence"]) for n, r in rows().items()} == {**{f"r{i}.json": [f"c{i}"] for i in range(5)}, "r9.json": ["late"], "r8.json": []}
    put("mended/r8.json", _trace("whole"))
    once()
    assert list(rows()["r8.json"]["sequence"]) == ["whole"]


def test_a_repeated_batch_replaces_itself(spark, run):
    once, put, rows, counts, base = run
    for i in range(4):
        put(f"r{i}.json", _trace(f"c{i}"))
    once()
    before, totals = rows(), counts()
    # as after a loss between the writing of a batch and its commit
    for mark in (base / "log" / "commits").iterdir():
        os.remove(mark)
    put("r7.json", _trace("new"))
    once()
    stored = spark.read.parquet(str(base / "store" / "rows"))
    assert stored.count() == 5 and stored.agg(F.count_distinct("path")).first()[0] == 5
    assert {n: rows()[n] for n in before} == before and counts()[0] == totals[0]


def test_report_files_are_written_by_tasks(spark, tmp_path):
    """One file per row in few folders, so neither the driver nor a folder has work for every file; a second write changes nothing."""
    from seqlab.sources import readers, writers

    texts = {f"{i}.json": None if i == 7 else _trace("é", str(i)) for i in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "fname string, text string").repartition(5)
    for _ in range(2):
        assert writers.write_text_files(rows, str(tmp_path / "files"), folders=4) == 60
    assert len(list((tmp_path / "files").iterdir())) == 4
    back = {r["fname"]: r["text"] for r in readers.read_trace_files(spark, str(tmp_path / "files")).collect()}
    assert back == {n: f"{t or ''}\n" for n, t in texts.items()}
    assert writers.write_text_files(rows.where("false"), str(tmp_path / "none")) == 0


def test_files_of_a_batch_are_looked_up_in_few_tasks(spark, tmp_path, monkeypatch):
    """More files than listing tasks: no task of its own for each file; a session's own bound stays."""
    from seqlab.sources import writers

    monkeypatch.setattr(ingest, "LISTING_TASKS", 1)
    spark.conf.set(ingest.LISTING, "10000")
    rows = spark.createDataFrame([(f"{i}.json", _trace("a")) for i in range(90)], "fname string, text string")
    writers.write_text_files(rows, str(tmp_path / "files"), folders=4)
    query = ingest.ingest_traces(ingest.stream_trace_files(spark, str(tmp_path / "files")), str(tmp_path / "store"), str(tmp_path / "log"))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) < 60  # the scan itself packs several files into a task
    assert ingest.ingested(spark, str(tmp_path / "store")).count() == 90
    spark.conf.set(ingest.LISTING, "77")
    ingest.few_listing_tasks(spark)
    assert spark.conf.get(ingest.LISTING) == "77"
    spark.conf.unset(ingest.LISTING)


def test_the_driver_holds_list_files_and_no_report_paths(run):
    """Tasks list folders of any depth; the source's own log, which the driver keeps in memory, names a few list files."""
    once, put, rows, counts, base = run
    for i in range(120):
        put(f"f{i % 3}/deep/r{i}.json", _trace(f"c{i}"))
    for hidden in (".part.json", "_tmp.json", "_gone/x.json", "r.json._COPYING_"):
        put(hidden, _trace("hidden"))
    once()
    assert set(rows()) == {f"r{i}.json" for i in range(120)} and rows()["r7.json"]["path"].endswith("/in/f1/deep/r7.json")
    handed = "".join(p.read_text() for p in (base / "log" / "sources" / "0").iterdir() if not p.name.startswith("."))
    lists = list((base / "log" / "listed").glob("*.parquet"))
    assert "deep" not in handed and handed.count('"path"') == len(lists) == 3
    once()
    assert len(list((base / "log" / "listed").glob("*.parquet"))) == 3
    os.utime(base / "in" / "f0" / "deep" / "r0.json", (2e9, 2e9))  # known by its path, whatever its time
    put("late.json", _trace("late"))
    once(files_per_batch=1, remembered="1d")
    assert sum(c["files"] for c in counts().values()) == 121
    put("old.json", _trace("old"))
    put("new.json", _trace("new"))
    newest = os.stat(base / "in" / "late.json").st_mtime
    os.utime(base / "in" / "old.json", (newest - 2 * 86400,) * 2)
    once(remembered="1d")
    assert {"late.json", "new.json"} <= set(rows()) and "old.json" not in rows()


def test_files_arrive_in_batches_in_order_of_age(run):
    once, put, rows, counts, base = run
    for i in range(7):
        put(f"r{i}.json", _trace(f"c{i}"))
        os.utime(base / "in" / f"r{i}.json", (1e9 - i, 1e9 - i))
    once(files_per_batch=3)
    found = {n: r["batch"] for n, r in rows().items()}
    assert [found[f"r{i}.json"] for i in range(7)] == [2, 1, 1, 1, 0, 0, 0] and len(counts()) == 3
