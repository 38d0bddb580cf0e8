import re

from pyspark.sql import functions as F

from seqlab.llm import pii_surrogates as op

KEY = "k1"


def swap(docs, texts, key=KEY):
    return {r["doc_id"]: (r["text"], r["n_replaced"]) for r in op.replaced(docs(texts), key).collect()}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2] + [x * 2 - 9 if x > 4 else x * 2 for x in d[1::2]]) % 10


def test_formats_and_coreference(docs):
    texts = [
        "Mail Éva.09@Mail5.example.com, or ÉVA.09@MAIL5.EXAMPLE.COM!! call +1 (521) 555-2373.",
        "call +1 521 555 2373; card 4111 1111 1111 1111 and 4111111111111111, 4432507379035540",
        "ip 227.5.221.1. ssn 078-05-1120 iban DE89 3704 0044 0532 0130 00 key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
        "Mrs. Maria Keller met Herr Keller and James Stone; Госпожа Ольга Петрова", None, "", "nothing 12 here, 1.2.3 or a@b or 12345678", "  ",
        "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF!!",
    ]
    got = swap(docs, texts)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == (texts[6], 0) and got[7] == ("  ", 0)
    m = re.fullmatch(r"Mail ([\w.]+@m\w+\.example\.org), or ([\w.]+@M\w+\.EXAMPLE\.ORG)!! call (\+1 \(\d{3}\) \d{3}-\d{4})\.", got[0][0])
    assert m and m[1].upper() == m[2] and got[0][1] == 3 and re.match(r"[a-z]{3}\.\d\d@", m[1])
    digits = lambda s: re.sub(r"\D", "", s)
    c = re.fullmatch(r"call (\+1 \d{3} \d{3} \d{4}); card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}), (4\d{15})", got[1][0])
    assert c and digits(c[1]) == digits(m[3]) != "15215552373" and digits(c[2]) == c[3] != "4" + "1" * 15
    assert luhn(c[3]) == 0 and (luhn(c[4]) == 0) == (luhn("4432507379035540") == 0)
    assert re.fullmatch(r"ip (\d{1,3}\.){3}\d{1,3}\. ssn \d{3}-\d{2}-\d{4} iban DE\d\d( \d{4}){4} \d\d key [0-9a-f]{40}", got[2][0]) and got[2][1] == 4
    n = re.fullmatch(r"Mrs\. (\w+) (\w+) met Herr (\w+) and (\w+) (\w+); Госпожа (\w+) (\w+)", got[3][0])
    assert n and n[1] in op.NAMES["latin_f"] and n[1] != "Maria" and n[2] == n[3] != "Keller" and n[4] in op.NAMES["latin_m"]
    assert n[6] in op.NAMES["cyrillic_f"] and re.fullmatch("[А-я]+", n[7]) and len({n[2], n[5], n[7]}) == 3
    assert got[8][0][:-2].lower() == got[2][0][-40:] and got[8][0].isupper()
    assert swap(docs, texts) == got and swap(docs, texts, "k2")[1] != got[1]


def test_narrow_formats_stay_distinct(docs, spark):
    ssn = [f"{i:03d}-45-6789" for i in range(300)]
    mail = [f"{a}@x.org" for a in "abcdefghijklmnopqrstuvwxyz"]
    got = swap(docs, ssn + mail)
    assert len({t for t, _ in got.values()}) == 326 and not {t for t, _ in got.values()} & set(ssn + mail)


def test_draws_again_on_collision(spark, monkeypatch):
    def narrow(key, kind, canon, attempt):
        return F.when(attempt > 3, F.concat(F.lit("s"), canon)).otherwise(F.pmod(F.xxhash64(canon, attempt), F.lit(5)).cast("string"))

    monkeypatch.setattr(op, "candidate", narrow)
    entities = spark.createDataFrame([("ip", str(i), 1) for i in range(12)], "kind string, canon string, n int")
    got = [r["surrogate"] for r in op.surrogate_table(entities, KEY).collect()]
    assert len(got) == len(set(got)) == 12 and not set(got) & {str(i) for i in range(12)}


def test_columns_rows_and_empty(docs):
    df = docs([(3, "see 10.1.2.3 now"), (3, "see 10.1.2.3 now"), (None, "see 10.1.2.3 now"), (4, "x" * 50_000 + " 10.1.2.3")])
    out = op.replaced(df, KEY)
    rows = out.collect()
    assert out.columns == [*df.columns, "n_replaced"] and len(rows) == 4 and all(r["n_replaced"] == 1 and r["n_chars"] == len(r["text"]) for r in rows)
    assert len({r["text"].split()[1] for r in rows}) == 1 and op.replaced(docs([]), KEY).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
