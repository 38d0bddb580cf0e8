import random

import pytest

from seqlab.llm import suffix_radix as op


def brute(rows, length):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s: s + length]
            least[w] = min(least.get(w, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if least[b[s: s + length]] < (1 << 61 if i is None else i):
                gone[s: s + length] = [True] * length
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((i, len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    words = ["ab", "aab", "é", "x", "yz", "the", "aaaa", "tion"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(3)) for _ in range(n))
    shared = [text(r.choice([8, 15, 40])) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(r.randrange(0, 30)) for _ in range(3)]
        if r.random() < 0.7:
            parts.insert(1, r.choice(shared)[r.randrange(5):])
        rows.append((r.randrange(1000), "".join(parts)))
    rows += [(i + 2000, t) for i, t in rows[:8]] + [(7, "a" * 300), (8, "a" * 120), (9, "b" + "a" * 60 + "c"), (3, "ab" * 100), (4, "ba" * 90)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (10, None), (11, ""), (12, "short"), rows[5], (5, "x" * 49), (6, "x" * 50), (13, "x" * 50 + "y" * 50)]
    return rows


@pytest.mark.parametrize("length,seed", [(50, 1), (50, 2), (20, 3)])
def test_against_brute_force(docs, length, seed):
    rows = made(seed)
    got = op.repeats(docs(rows).repartition(3), length).collect()
    out = sorted(((r["doc_id"], r["n_bytes"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), bytes(r["kept"])) for r in got), key=str)
    assert out == brute(rows, length)


@pytest.mark.parametrize("hot", [0, 40])
def test_hot_anchors_are_dealt_by_window(docs, hot):
    """Every third document has the passage, between words of its own: the same result with hot anchors cut into windows."""
    r = random.Random(8)
    own = lambda: " ".join(str(r.random()) for _ in range(6))
    passage = " ".join(f"word{r.randrange(50)}" for _ in range(30))
    rows = [(i, own() + passage + own() if i % 3 == 0 else own()) for i in range(150)] + made(5)
    got = op.repeats(docs(rows).repartition(3), hot=hot).collect()
    out = sorted(((r["doc_id"], r["n_bytes"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), bytes(r["kept"])) for r in got), key=str)
    assert out == brute(rows, 50)


def test_no_bucket_has_all_stretches_of_a_hot_anchor(tmp_path):
    """Stretches of one block at a passage's edges: in one bucket by anchor, spread when the anchor is hot."""
    import numpy as np
    r = random.Random(9)
    passage = " ".join(f"word{r.randrange(50)}" for _ in range(12))
    texts = [str(r.random()) + passage + str(r.random()) for _ in range(400)]

    class Fake:
        buffer = "".join(texts).encode()
        ids, known = np.arange(400), np.ones(400, bool)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    kept, op.Block = op.Block, lambda folder, file: Fake()
    try:
        hashes = np.unique(op.anchors(Fake, 50)["hash"])
        most = {}
        for hot in (False, True):
            s = op.Stretches("", "", [hashes.tobytes() + np.full(len(hashes), hot).tobytes()], 50, 7)
            most[hot] = np.bincount(s.bucket).max() / len(s.bucket)
    finally:
        op.Block = kept
    assert most[False] > 0.2 and most[True] < 0.05


def test_equal_windows_have_equal_anchors():
    class Fake:
        pass

    r = random.Random(4)
    b = Fake()
    texts = [bytes(r.choice(b"abc ") for _ in range(r.randrange(400))) for _ in range(30)]
    b.buffer, b.ids = b"".join(texts), list(range(30))
    import numpy as np
    b.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a = op.anchors(b, 50)
    seen, windows = {}, 0
    for h, at, d, lo, hi in zip(*(a[x].tolist() for x in ("hash", "at", "doc", "lo", "hi"))):
        for s in range(lo, hi + 1):
            windows += 1
            assert b.starts[d] <= s and s + 50 <= b.starts[d + 1] and s <= at and at + 24 <= s + 50
            assert seen.setdefault(b.buffer[s: s + 50], (h, at - s)) == (h, at - s)
    assert windows == sum(max(0, len(t) - 49) for t in texts)


def test_columns_are_kept(docs, spark):
    text = "The very same passage of more than fifty bytes, twice. "
    out = op.without_repeats(docs([(1, text + "é one"), (2, text + "é two"), (3, None)]))
    assert out.columns == docs([]).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["source"]) for r in out.collect()} == {1: (text + "é one", len(text) + 5, "src1"), 2: ("two", 3, "src2"), 3: ("", 0, "src0")}
    assert op.repeats(docs([])).count() == 0
