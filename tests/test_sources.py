import json

import pytest
from pyspark.sql import functions as F

from seqlab.operators import labels as lab
from seqlab.operators import traces
from seqlab.sources import json_ranges, readers, writers
from seqlab.sources.json_ranges import json_items

EXTRACTED = [
    ("h1", "redline", "Spyware", "", "ntclose ntopen"), ("h2", "noon", "Spyware", "Trojan", "a b c"), ("h3", "amadey", "Downloader", "Trojan,Spyware", "a"),
    ("h4", "qbot", "Trojan", "Spyware,Worms", "b"), ("h5", "stop", "Trojan", "", "c"), ("h6", "vbclone", "Worms", "Trojan", "d e"),
    ("h7", "odd", None, "", "x"), ("h8", "odd", "", "", "y"),
]


@pytest.fixture()
def extracted(spark, tmp_path):
    rows = [(s, f, None, None, p, [x for x in sec.split(",") if x], seq.split(), 2, len(seq.split()), 1) for s, f, p, sec, seq in EXTRACTED]
    schema = ("sha256 string, family_avclass string, family_cape string, family_consensus string, primary_class string, secondary_classes array<string>, "
              "api_sequence array<string>, num_processes int, sequence_length int, source_volume int")
    path = str(tmp_path / "extracted")
    writers.write_extracted(spark.createDataFrame(rows, schema).repartition(3), path)
    return path


def test_read_extracted(spark, extracted):
    rows = readers.read_extracted(spark, extracted, drop_trojan=False).collect()
    assert len(rows) == 6
    kept = {r["sample_id"]: r for r in readers.read_extracted(spark, extracted, max_len=2).collect()}
    assert set(kept) == {"h1", "h2", "h3", "h6"}
    assert list(kept["h2"]["sequence"]) == ["a", "b"] and list(kept["h3"]["secondary_classes"]) == ["Trojan", "Spyware"] and list(kept["h1"]["secondary_classes"]) == []
    assert spark.read.parquet(extracted).columns == writers.EXTRACTED_COLUMNS


def test_aligned_export_reads_back(spark, extracted, tmp_path):
    s, lbl = str(tmp_path / "s"), str(tmp_path / "l")
    assert writers.write_aligned_text(spark, extracted, s, lbl) == 6
    got = sorted((" ".join(r["sequence"]), r["label"]) for r in readers.read_aligned_text(spark, s, lbl).collect())
    assert got == sorted((seq, p) for _, _, p, _, seq in EXTRACTED if p)
    assert writers.write_aligned_text(spark, extracted, s + "2", lbl + "2", drop_trojan=True) == 4


def test_aligned_text(spark, tmp_path):
    seq, lab_ = tmp_path / "s.txt", tmp_path / "l.csv"
    seq.write_text("a b  c\n\n  d e \n   \nf\n")
    lab_.write_text("\nX\nY\n\n Z \n")
    rows = {r["sample_id"]: (list(r["sequence"]), r["label"]) for r in readers.read_aligned_text(spark, str(seq), str(lab_), 2).collect()}
    assert rows == {"1": (["a", "b"], "X"), "2": (["d", "e"], "Y"), "3": (["f"], "Z")}
    lab_.write_text("X\n")
    with pytest.raises(ValueError, match="sequence count"):
        readers.read_aligned_text(spark, str(seq), str(lab_))


def test_lines_keep_order_over_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
        rows = readers.numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["line_no"]: r["value"] for r in rows} == {i + 1: f"line{i}" for i in range(5000)}


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('sha256,labels,0,1,2\nh1,0, NtOpen ,,NtClose,Extra,More\nh2,1,"a,b","say ""x""",\nh3,1\n')
    rows = {r["sample_id"]: (list(r["sequence"]), r["label"]) for r in readers.read_wide_csv(spark, str(path)).collect()}
    assert rows == {"h1": (["NtOpen", "NtClose", "Extra", "More"], "Benign"), "h2": (["a,b", 'say "x"'], "Malware"), "h3": ([], "Malware")}


def test_wide_csv_rejects_odd_labels(spark, tmp_path):
    for no, label in enumerate(["", "1.0", "x"]):
        path = tmp_path / f"odd{no}.csv"
        path.write_text(f"sha256,labels,0\nh1,0,a\nh2,{label},b\n")
        with pytest.raises(Exception, match="not a whole number in line of h2"):
            readers.read_wide_csv(spark, str(path)).collect()


def test_coded_csv(spark, tmp_path):
    path = tmp_path / "coded.csv"
    path.write_text("hash,t_0,t_1,t_2,malware\n m1 ,0,9,2,1\nm2,2,2,0,0\n")
    rows = {r["sample_id"]: (list(r["sequence"]), r["label"]) for r in readers.read_coded_csv(spark, str(path), {0: "NtOpen", 2: "recv"}, 3).collect()}
    assert rows == {"m1": (["NtOpen", "9", "recv"], "Malware"), "m2": (["recv", "recv", "NtOpen"], "Benign")}


def test_trace_files(spark, tmp_path):
    good = {"behavior": {"processes": [{"calls": [{"api": "NtOpen"}]}]}}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps(good))
    (tmp_path / "t" / "b.json").write_bytes(b'{"note": "\xff\xfe", "behavior": {"processes": [{"calls": [{"api": "Send"}]}]}}')
    (tmp_path / "t" / "c.json").write_text("not json")
    docs = readers.read_trace_files(spark, str(tmp_path / "t"))
    rows = {r["fname"]: (list(r["sequence"]), r["status"]) for r in traces.parse_traces(docs).collect()}
    assert rows == {"a.json": (["ntopen"], "ok"), "b.json": (["send"], "ok"), "c.json": ([], "unparsed")}
    assert traces.outcome_counts(traces.parse_traces(docs)).count() == 2


def test_label_documents(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"n": 1, "Fam": {"reports": [{"report": "a.json"}]}}, indent=2))
    docs = readers.read_label_documents(spark, str(tmp_path / "l.json"))
    assert [tuple(r) for r in lab.primary_labels(docs).collect()] == [("a.json", "fam")]


def test_reports_store(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert readers.read_reports(spark, path).count() == 0
    writers.write_reports(spark.createDataFrame([("a", "{}"), ("b", None)], "hash string, response string"), path)
    assert {r["hash"]: r["response"] for r in readers.read_reports(spark, path).collect()} == {"a": "{}", "b": None}
    writers.write_reports(spark.createDataFrame([("a", "{~}"), ("c", "x")], "hash string, response string"), path)
    assert {r["hash"]: r["response"] for r in readers.read_reports(spark, path).collect()} == {"a": "{~}", "b": None, "c": "x"}
    (tmp_path / "map.json").write_text(json.dumps({"a": {"data": 1}, "b": None}))
    assert {r["hash"]: r["response"] for r in readers.read_report_map(spark, str(tmp_path / "map.json")).collect()} == {"a": '{"data":1}', "b": None}
    (tmp_path / "broken.json").write_text("{")
    assert readers.read_report_map(spark, str(tmp_path / "broken.json")).count() == 0


@pytest.mark.parametrize("split", [5, 64, 1 << 20])
def test_objects_in_ranges(spark, tmp_path, split):
    """Any range size gives the entries that the whole object has."""
    tricky = {"a\\": 'x \\" ,{', 'q"k': {"d": [1, {"e": "}]"}], "u": "\u00e9\u4e2d"}, "": [], "n": None, "e": {}, "t": "\\\\"}
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(tricky, indent=1, ensure_ascii=False))
    (folder / "b.json").write_text(json.dumps({"n": 5, "z": "last"}))
    for name, text in (("c", ""), ("d", " { } "), ("e", '{"a": 1,}'), ("f", '{"a": tru}'), ("g", '[{"a": 1}]'), ("h", '{"a": "}')):
        (folder / f"{name}.json").write_text(text)
    items = json_items(spark, str(folder), 1, split).orderBy("file", "at").collect()
    assert [json.loads("{%s}" % r["body"]) for r in items] == [{k: v} for k, v in tricky.items()] + [{"n": 5}, {"z": "last"}]
    back = {r["hash"]: r["response"] for r in readers.read_report_map(spark, str(folder), split).collect()}
    assert set(back) == {*tricky, "z"} and back["n"] == "5" and back["e"] == "{}" and back["t"] == "\\\\"


@pytest.mark.parametrize("split", [9, 1 << 20])
def test_label_lists_in_ranges(spark, tmp_path, split):
    """A list's elements keep their family in whichever range they begin; other shapes in the file add nothing."""
    reports = [{"report": f"{i}.json", "note": "]}, {["} for i in range(40)]
    files = {
        "a": {"n": 3, "Fam \"x\"": {"n": 40, "reports": reports, "other": [{"report": "no.json"}]}, "list": [[{"report": "no.json"}], {"reports": 1}], "Empty": {"reports": []}},
        "b": {"Late": {"reports": [{"report": "3.json"}, {"report": "z.json"}]}, "map": {"reports": {"report": "no.json"}}},
    }
    folder = tmp_path / "labels"
    folder.mkdir()
    for name, value in files.items():
        (folder / f"{name}.json").write_text(json.dumps(value))
    found = {r["fname"]: r["family"] for r in lab.primary_labels(readers.read_label_documents(spark, str(folder), split_bytes=split)).collect()}
    assert found == {**{f"{i}.json": 'fam "x"' for i in range(40)}, "3.json": "late", "z.json": "late"}


def test_ranges_read_little_beyond_their_end(spark, tmp_path, monkeypatch):
    """what a range reads of the ranges after it is in proportion to its size, and its items stay whole."""
    text = json.dumps({"Fam": {"reports": [{"report": f"{i}.json"} for i in range(20_000)]}})
    (tmp_path / "a.json").write_text(text)
    ranges = json_ranges._ranges(spark, str(tmp_path), 1 << 14).toPandas()
    read, real = [], json_ranges._opened

    class Counting:
        def __init__(self, path):
            self.handle = real(path)

        __enter__ = lambda self: self
        __exit__ = lambda self, *_: self.handle.close()
        size = lambda self: self.handle.size()

        def read_at(self, n, at):
            read.append(n)
            return self.handle.read_at(n, at)

    monkeypatch.setattr(json_ranges, "_opened", Counting)
    found = [x for f in json_ranges._cut(3)(iter([ranges])) for x in f.loc[f["kind"] == "item", "body"]]
    assert len(found) == 20_000 and len(ranges) > 20 and sum(read) < 2 * len(text)


def test_label_report(spark, tmp_path):
    df = spark.createDataFrame([("a", "Worms", "labelled", "Worms"), ("b", None, "dropped", None), ("c", "Benign", "benign", None)], "hash string, label string, status string, family string")
    writers.write_label_report(df, str(tmp_path / "r"))
    stats = spark.read.json(str(tmp_path / "r" / "stats")).first()
    assert (stats["total_labeled"], stats["total_dropped"]) == (2, 1) and stats["family_distribution"].asDict() == {"Worms": 1, "Benign": 1}
    assert spark.read.json(str(tmp_path / "r" / "samples")).count() == 2
    assert [r["hash"] for r in spark.read.json(str(tmp_path / "r" / "dropped_hashes")).collect()] == ["b"]


def test_reuse_and_append(spark, tmp_path):
    make = lambda n: spark.range(n).select(F.col("id").cast("string").alias("k"))
    path = str(tmp_path / "cache")
    assert writers.reuse_or_build(spark, path, lambda: make(3)).count() == 3
    assert writers.reuse_or_build(spark, path, lambda: make(9)).count() == 3
    assert writers.reuse_or_build(spark, path, lambda: make(9), use_cache=False).count() == 9
    make(2).write.parquet(str(tmp_path / "half"))
    (tmp_path / "half" / "_SUCCESS").unlink()
    assert writers.reuse_or_build(spark, str(tmp_path / "half"), lambda: make(7)).count() == 7
    out = str(tmp_path / "out")
    assert writers.append_new(make(4), out, "k").count() == 4
    assert writers.append_new(make(6), out, "k").count() == 6
    more = make(8).union(make(8)).union(spark.createDataFrame([(None,), (None,)], "k string"))
    assert writers.append_new(more, out, "k").count() == 9 and writers.append_new(more, out, "k").count() == 9
