import json

import pytest
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.operators import labels as lab
from seqlab.operators import traces, vote


def engines(*results):
    return {f"E{i}": {"category": "malicious", "result": r} for i, r in enumerate(results)}


WORMS = ["Worm.Python.Generic", "Worm.Agent.Win32", "Worm:Win32/Agent", "HEUR:Worm.Python.Generic", "Net-Worm.Agent", "W32/Agent.worm", "Worm.VBAgent"]
TROJANS = ["Trojan.Siggen", "Trojan.Win32.Agent", "Win32:Troj-gen", "Trojan.Generic.Agent", "Trojan.Win32.Vilsel", "Trojan.Vilsel",
           "TROJ_VILSEL.SMB", "Trojan.Win32.Copyself", "Trojan/Win32.Vilsel"]
CASES = {
    "trojan": (engines("Trojan.Emotet", "Win32/Trojan.Zbot", "Malware.Generic"), "Trojan"),
    "backdoor": (engines("Backdoor.Win32.Agent", "Backdoor/Meterpreter", "Backdoor.Generic"), "Backdoor"),
    "downloader": (engines("Downloader.Upatre", "TrojanDownloader.Agent", "Downloader.Generic"), "Downloader"),
    "worms": (engines("Worms.Win32.Conficker", "Net-Worms.Agent", "Worms/Autorun"), "Worms"),
    "spyware": (engines("Spyware.Keylogger", "Win32.Spyware.Zeus", "Spyware.Generic"), "Spyware"),
    "adware": (engines("Adware.BrowseFox", "not-a-virus:Adware.Win32", "Adware/Generic"), "Adware"),
    "dropper": (engines("Dropper.Win32.Agent", "TrojanDropper.Generic", "Dropper/Agent"), "Dropper"),
    "virus": (engines("Virus.Win32.Sality", "Virus.Ramnit", "Win32.Virus.Parite"), "Virus"),
    "weak": (engines("Trojan.Emotet", "Backdoor.Generic", "Trojan/Win32.Agent", "Trojan.Downloader"), "Trojan"),
    "strong": (engines(*WORMS, *TROJANS), "Worms"),
    "generic": (engines("Malware.Generic", "Suspicious.Cloud", None), None),
    "undetected": (engines(None, None), None),
    "case": (engines("TROJAN.Emotet", "trojan/zbot"), "Trojan"),
    "keyword": (engines("Win32.Padodor.A", "Gen:Variant.Graftor", "W32.Padodor"), "Backdoor"),
    "suppressed": (engines("Win-Trojan/Abc.123", "Trj/GdSda", "Trojan ( 0012ab )"), None),
    "kept": (engines("Win-Trojan/WormX"), "Worms"),
}


def test_vote_cases(spark):
    docs = [(k, json.dumps({"data": {"attributes": {"last_analysis_results": e}}})) for k, (e, _) in CASES.items()]
    docs += [("bad", "{"), ("null", None), ("empty", "{}"), ("shallow", '{"data":{}}'), ("none", json.dumps({"data": {"attributes": {"last_analysis_results": {}}}}))]
    df = spark.createDataFrame(docs, "hash string, response string")
    got = {r["hash"]: r["family"] for r in vote.vote_family(vote.report_rows(df)).collect()}
    assert got == {k: f for k, (_, f) in CASES.items() if f}
    schema = "hash string, results map<string, struct<category:string, result:string>>"
    maps = spark.createDataFrame([(k, e) for k, (e, _) in CASES.items()], schema)
    assert {r["hash"]: r["family"] for r in vote.vote_family(vote.rows_from_map(maps)).collect()} == got


def test_label_from_reports(spark):
    samples = spark.createDataFrame([("benign1", "Benign"), ("m1", "Malware"), ("m2", "Malware"), ("m3", "Malware")], "hash string, label string")
    reports = spark.createDataFrame([("m1", "A", "Backdoor.X"), ("m2", "A", "Malware.Generic")], "hash string, engine string, result string")
    out = lab.label_from_reports(samples, reports)
    assert {r["hash"]: r["label"] for r in lab.kept(out).collect()} == {"benign1": "Benign", "m1": "Backdoor"}
    assert {r["hash"] for r in lab.dropped(out).collect()} == {"m2", "m3"}
    t = lab.label_totals(out).first()
    assert (t["total_labeled"], t["benign"], t["malware"], t["total_dropped"]) == (2, 1, 1, 2)


def reports(*names):
    return {"n_reports": len(names), "reports": [{"report": n, "sha256": n[:-5], "md5": "m"} for n in names]}


@pytest.fixture(scope="module")
def files(spark):
    doc = lambda o: spark.createDataFrame([(json.dumps(o),)], "value string")
    primary = {"n_reports": 10, " RedLine": reports("aaa.json", "bbb.json"), "Berbew": reports("ccc.json", "aaa2.json"), "(n/a)": reports("ddd.json"), "None": reports("x.json"), "flat": 3, "odd": {"n": 1}}
    cape = {"n_reports": 5, "MetaStealer": reports("aaa.json"), "(n/a)": reports("ccc.json"), "Berbew": reports("aaa2.json")}
    consensus = {"reports_avclass_no_consensus": 1, "reports_cape_no_consensus": 2, "reports_both_no_consensus": 3,
                 "aaa": {"avclass": "Redline", "cape": "Metastealer"}, "bbb": {"avclass": " RedLine ", "cape": "redline"}, "ccc": {"avclass": "", "cape": None}, "zzz": 4}
    return doc(primary), doc(cape), doc(consensus)


def test_label_files(files):
    primary, cape, consensus = files
    assert {r["fname"]: r["family"] for r in lab.primary_labels(primary).collect()} == {"aaa.json": "redline", "bbb.json": "redline", "ccc.json": "berbew", "aaa2.json": "berbew"}
    assert {r["fname"]: r["family"] for r in lab.secondary_labels(cape).collect()}["ccc.json"] == "(n/a)"
    agreed = {r["fname"]: (r["avclass"], r["cape"]) for r in lab.consensus_labels(consensus).collect()}
    assert agreed == {"aaa.json": ("redline", "metastealer"), "bbb.json": ("redline", "redline"), "ccc.json": (None, None)}


def test_last_report_wins(spark):
    text = '{"A": {"reports":[{"report":"x.json"}]}, "B": {"reports":[{"report":"x.json"}]}}'
    assert lab.primary_labels(spark.createDataFrame([(text,)], "value string")).first()["family"] == "b"


def test_unify(files):
    primary, cape, consensus = files
    rows = lab.unify_labels(lab.primary_labels(primary), lab.secondary_labels(cape), lab.consensus_labels(consensus)).collect()
    got = {r["fname"]: (r["avclass"], r["cape"], r["consensus"], r["sha256"]) for r in rows}
    assert got == {
        "aaa.json": ("redline", "metastealer", None, "aaa"), "bbb.json": ("redline", None, "redline", "bbb"),
        "ccc.json": ("berbew", None, None, "ccc"), "aaa2.json": ("berbew", "berbew", None, "aaa2"),
    }


@pytest.fixture(scope="module")
def unified(spark):
    rows = [(f"{f}_{i:03d}.json", f) for f, n in (("a", 80), ("b", 60), ("c", 40), ("d", 20), ("e", 5)) for i in range(n)]
    return spark.createDataFrame(rows, "fname string, avclass string")


def test_targets(unified):
    plan = lambda **k: [(r["family"], r["raw_count"], r["capped_count"]) for r in lab.family_plan(unified, **k).orderBy("rank").collect()]
    assert plan(top_k=3, min_samples=1) == [("a", 80, 80), ("b", 60, 60), ("c", 40, 40)]
    assert [f for f, _, _ in plan(min_samples=10)] == ["a", "b", "c", "d"]
    assert plan(max_per_family=50) == [("a", 80, 50), ("b", 60, 50)]
    rows = lab.select_targets(unified, max_per_family=50).collect()
    assert sorted(r["fname"] for r in rows if r["avclass"] == "a") == [f"a_{i:03d}.json" for i in range(50)]
    t = lab.plan_totals(lab.family_plan(unified, 2, 70, 10), 2).first()
    assert (t["families"], t["total_raw"], t["total_capped"], t["count_at_rank_k"]) == (2, 140, 130, 60)


def test_class_preview(spark):
    plan = spark.createDataFrame([("redline", 90, 80, 1), ("strange", 60, 60, 2), ("noon", 50, 50, 3)], "family string, raw_count long, capped_count long, rank int")
    got = {r["class_name"]: r["projected"] for r in lab.class_preview(plan, lab.family_dimension(spark)).collect()}
    assert got == {**dict.fromkeys(V.PLAN_CLASSES, 0), "Spyware": 130, "unmapped": 60}


def trace(*processes):
    return json.dumps({"behavior": {"processes": [{"process_id": 1, "process_name": "p.exe", "calls": c} if isinstance(c, list) else c for c in processes]}})


def test_traces(spark):
    call = lambda n: {"api": n, "timestamp": "t", "category": "system"}
    docs = {
        "order": trace([call("NtOpen"), call("NtClose")], [call("Send")]),
        "dirty": trace([call("GoodCall"), {"category": "x"}, "bare", {"api": 5}, {"api": ""}, {"api": None}, call("AnotherCall")], "stray", {"calls": {"a": 1}}),
        "blank": trace([], [call("A")], []), "no_processes": json.dumps({"behavior": {"processes": []}}), "no_behavior": "{}",
        "list_behavior": json.dumps({"behavior": [1]}), "no_calls": trace([], []), "broken": '{"behavior":',
    }
    rows = {r["fname"]: r for r in traces.parse_traces(spark.createDataFrame(list(docs.items()), "fname string, text string")).collect()}
    assert list(rows["order"]["sequence"]) == ["ntopen", "ntclose", "send"] and rows["order"]["num_processes"] == 2
    assert list(rows["dirty"]["sequence"]) == ["goodcall", "anothercall"] and rows["dirty"]["num_processes"] == 3
    assert rows["blank"]["num_processes"] == 3 and list(rows["blank"]["sequence"]) == ["a"]
    assert {k: r["status"] for k, r in rows.items()} == {
        "order": "ok", "dirty": "ok", "blank": "ok", "no_processes": "empty", "no_behavior": "empty", "list_behavior": "empty", "no_calls": "empty", "broken": "unparsed"
    }


def test_add_classes(spark):
    df = spark.createDataFrame([("redline",), ("amadey",), ("strange",), (None,)], "avclass string")
    got = {r["avclass"]: (r["primary_class"], list(r["secondary_classes"])) for r in lab.add_classes(df, lab.family_dimension(spark)).collect()}
    assert got == {"redline": ("Spyware", []), "amadey": ("Downloader", ["Trojan", "Spyware"]), "strange": (None, []), None: (None, [])}
    assert lab.add_classes(df, lab.family_dimension(spark)).where(F.col("primary_class") == "Trojan").count() == 0
