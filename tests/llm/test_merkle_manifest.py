import hashlib
import zlib

import pytest

from seqlab.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int, idx string, path string, n int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in M.FIELDS))


def tree_of(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([h("".join(d[i:i + fanout])) for i in range(0, len(d), fanout)])
    return levels


def path_of(levels, i, fanout):
    out = []
    for d in levels[:-1]:
        first = i // fanout * fanout
        out.append(("".join(d[first:i]), "".join(d[i + 1:first + fanout])))
        i //= fanout
    return out


def brute(rows, fanout):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[name] = tree_of([leaf_of(r) for r in groups[name]], fanout)
    upper = tree_of([trees[name][-1][0] for name in names], fanout)
    root = upper[-1][0] if names else None
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = path_of(trees[name], i, fanout) + path_of(upper, k, fanout)
            own = leaf_of(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                own = leaf_of({**r, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])})
            for left, right in path:
                own = h(left + own + right)
            proof = h("".join(a + b for a, b in path))
            out.append((r["doc_id"], leaf_of(r), trees[name][-1][0], root, proof, own, own == root))
    return sorted(out, key=str)


def rows_of(spark, rows):
    """Rows with columns that clash with inner names."""
    return spark.createDataFrame([(*r, "d", 1, "i", "p", 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("fanout", [2, 3])
def test_against_a_plain_tree(spark, fanout):
    rows = [(i, f"Text {i} É", ("en", "de", None, "")[i % 4] if i < 90 else "en", f"s{i % 3}", i) for i in range(130)]
    rows += [(None, "no id", "en", None, None), (7, None, "fr", "x", 0), (3, "Again", "en", "y", 1), (3, "Again", "en", "y", 1)]
    df = rows_of(spark, rows)
    got = sorted(map(tuple, M.manifest(df, fanout=fanout).collect()), key=str)
    assert got == brute([r.asDict() for r in df.collect()], fanout)


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(1, "a", None, "s", 1), (2, "B" * 70_000, None, "s", 1)]], ids=["none", "one", "two"])
def test_small_tables(spark, rows):
    df = rows_of(spark, rows)
    got = sorted(map(tuple, M.manifest(df).collect()), key=str)
    assert got == brute([r.asDict() for r in df.collect()], 8)


def test_same_rows_however_dealt(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, M.manifest(df.repartition(13)).collect()), key=str)
    assert got == brute([r.asDict() for r in df.collect()], 8)
    assert {g[3] for g in got} == {got[0][3]} and 0 < sum(g[6] for g in got) < len(got)
