import random
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from seqlab.llm import mixture_packing as op
from seqlab.llm.word_ids import WordIds


def test_word_cache_gives_the_tokenizers_ids():
    texts = ["It's  A\tTest of é é <|endoftext|> ǅ Σ", "", None, "12 345 x'll!! \n\r\x0b", "a" * 5000, "́x <|end oftext|>", "\x1c\x85 z"]
    r = random.Random(1)
    letters = "abÀéßÿ×÷ØøµªºÞ's09!*.|<>²½Ǆ你🙂 \u0301İK"
    texts += ["".join(r.choice(letters) for _ in range(60)) for _ in range(300)] + ["<|ENDOFTEXT|> <|startoftext|>x"]
    words = WordIds(op.public_vocabulary())
    t = Tokenizer.from_file(op.public_vocabulary())
    for _ in range(2):
        got = [np.frombuffer(b, words.kind).tolist() for b in words.packed(texts)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def check(rows, docs, size):
    t = Tokenizer.from_file(op.public_vocabulary())
    of = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in docs}
    total, windows, pieces = 0, {}, {}
    for r in rows:
        ids = np.array(of[r["doc_id"]][r["start"]: r["start"] + r["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(of[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(of[i])
    assert pieces.keys() == of.keys()
    total = sum(map(len, of.values()))
    assert sorted(windows) == list(range(-(-total // size)))
    for w, p in windows.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == min(size, total - w * size)


def test_pieces_of_many_sources(spark, rng):
    sources = ["a"] * 60 + ["b"] * 30 + [None] * 8 + [f"s{i}" for i in range(20)]
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 90))) if i % 11 else None, s) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = op.pack(df, op.public_vocabulary(), size=256).collect()
    check(got, [(i, t) for i, t, _ in rows], 256)
    # every full window holds the sources' shares to a token
    own = {}
    for r in got:
        s = sources[r["doc_id"]]
        own.setdefault(s, {}).setdefault(r["sequence_id"], 0)
        own[s][r["sequence_id"]] += r["length"]
    all_tokens = sum(r["length"] for r in got)
    for s in ("a", "b"):
        share = sum(own[s].values()) / all_tokens * 256
        assert all(abs(own[s].get(w, 0) - share) < 2 for w in range(all_tokens // 256))


def test_small_and_empty(docs):
    assert op.pack(docs([]), op.public_vocabulary()).count() == 0
    texts = [None, "one", "", "x " * 9000]
    check(op.pack(docs(texts), op.public_vocabulary()).collect(), list(enumerate(texts)), 4096)
    full = op.packed_pieces(docs(texts), op.public_vocabulary()).collect()
    check(full, list(enumerate(texts)), 4096)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in full)


def test_huge_totals_stay_exact():
    total, own, below = 10**15, 4 * 10**14, 10**14
    at = 3 * 10**14 + 17
    a, n, w, off = op.pieces(at, 10_000, below, own, total, 4096)
    assert a[0] == at and n.sum() == 10_000 and (np.diff(a) == n[:-1]).all() and (off >= 0).all() and (off + n <= 4096).all()


def test_word_cache_on_odd_characters():
    r = random.Random(1)
    letters = "abÀéßÿ×÷ØøµªºÞ's09!*.|<>²½Ǆ你🙂 ́İK\x00\x1f\x85"
    texts = ["".join(r.choice(letters) for _ in range(60)) for _ in range(400)] + ["<|ENDOFTEXT|> <|startoftext|>x <|endoftext|>"]
    words, t = WordIds(op.public_vocabulary()), Tokenizer.from_file(op.public_vocabulary())
    words.words.most = words.runs.most = 50  # the generations change over and over
    got = [np.frombuffer(b, words.kind).tolist() for at in range(0, len(texts), 7) for b in words.packed(texts[at: at + 7])]
    for x, ids in zip(texts, got):
        assert ids == t.encode(x, add_special_tokens=False).ids, x


def test_few_windows_are_cut_as_many_are(monkeypatch):
    import random

    from seqlab.llm import mixture_packing as m

    draw = random.Random(5)
    for _ in range(300):
        below, own, after = draw.randrange(5000), draw.randrange(1, 5000), draw.randrange(5000)
        start = draw.randrange(own)
        case = (start, draw.randrange(1, own - start + 1), below, own, below + own + after, draw.choice([7, 64, 4096]))
        monkeypatch.setattr(m, "FEW", 0)
        many = m.pieces(*case)
        monkeypatch.setattr(m, "FEW", 1 << 30)
        few = m.pieces(*case)
        assert all(a.tolist() == b.tolist() for a, b in zip(many, few, strict=True))


def test_small_caches_give_the_same_pieces_and_are_left_empty(spark, docs, monkeypatch):
    """The pipeline's packing bounds a worker's token caches and leaves them empty to the stages after it."""
    texts = [" ".join(f"Word{(i * j) % 97}, x{j % 13}" for j in range(60)) for i in range(40)]
    rows = [sorted(map(tuple, op.pack(docs(texts), op.public_vocabulary(), 64, cache=most).collect())) for most in (None, 5)]
    assert rows[0] == rows[1] and len(rows[0]) > 40

    # the task's function, here
    here = SimpleNamespace(select=lambda *_: here, mapInPandas=lambda run, _: run)
    monkeypatch.setattr(op, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = op.tokenized(here, op.public_vocabulary(), cache=5)
    words, most = op.loaded(op.public_vocabulary()), []
    for _ in run(iter([pd.DataFrame({"doc_id": [i], "source": "=", "text": [t]}) for i, t in enumerate(texts)])):
        most.append(len(words.words.older))
    assert max(most) > 0  # generations end at the bound
    assert not any(len(part) for c in (words.words, words.runs) for part in (c.now, c.older))


def test_runs_are_encoded_without_offsets():
    """New runs go through the tokenizer's call without offsets and word numbers, cut at the tokens that close a word."""
    t, words = Tokenizer.from_file(op.public_vocabulary()), WordIds(op.public_vocabulary())
    letters = [chr(i) for i in range(0xDF, 0x100) if i != 0xF7]
    texts = [" ".join(a + b for a in letters for b in ["", "x", "ß", "í", "à", "x1", "."])]
    texts += ["".join(map(chr, range(33, 127))), " ".join(f"{w}{chr(c)}" for w in ("Ab", "ú", "9") for c in range(33, 127)), "a\x7f b\x1c c\x01"]
    encode, used = words.plain.encode_batch_fast, []
    words.plain = SimpleNamespace(encode_batch_fast=lambda *a, **k: used.append(1) or encode(*a, **k))  # it has no other
    for text in texts:
        assert np.frombuffer(words.packed([text])[0], words.kind).tolist() == t.encode(text, add_special_tokens=False).ids
    assert used


def test_vocabulary_without_closing_tokens_for_all_bytes():
    words, t = WordIds(op.public_vocabulary()), Tokenizer.from_file(op.public_vocabulary())
    words.closing[:] = False
    text = "the quick bröwn fox, 12 jumps."
    assert np.frombuffer(words.packed([text])[0], words.kind).tolist() == t.encode(text, add_special_tokens=False).ids
