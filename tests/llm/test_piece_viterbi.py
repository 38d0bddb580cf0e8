import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from seqlab.llm import piece_viterbi as op


@pytest.fixture(scope="module")
def model():
    return op.Pieces(op.public_model())


@pytest.fixture(scope="module")
def unigram():
    """The library's own best-score search over the same pieces."""
    m = sentencepiece_model_pb2.ModelProto()
    with open(op.public_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts():
    r = random.Random(2)
    letters = "abcdeé  ñüzß\n\t,.1你🙂"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(200)]
    return made + ["Hello  world\nab\té ", "", " ", "   lead and trail  ", "▁literal mark", "the quick brown fox " * 50, "a" * 3000]


def scores(model, ids):
    return sum(model.pieces[i][1] for i in ids)


def test_best_score_of_the_library(model, unigram):
    for t in texts():
        ids, total = model.encode(t)
        theirs = unigram.encode(t)
        # equal scores may be reached by different pieces, and the library sums in single precision
        assert scores(model, ids) >= scores(model, theirs) - 1e-3, t
        if len(t) < 50:
            assert scores(model, ids) == pytest.approx(scores(model, theirs), abs=1e-3), t


def test_best_of_all_ways_to_cut(model):
    known = {p: s for p, s, k in model.pieces if k == op.NORMAL}

    def best(text):
        if not text:
            return 0.0
        ways = [known[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in known]
        return max([*ways, model.lowest + best(text[1:])])

    for word in ["the", "▁thers", "▁▁▁▁▁", "▁naïve你", "xqzj▁", "ation", "🙂a"]:
        assert model.best(word)[1] == pytest.approx(best(word))


def test_words_alone_reach_the_best_of_the_whole(model):
    for t in texts():
        ids, total = model.encode(t)
        whole, best = model.best(model.normal(t))
        assert total == pytest.approx(best, abs=1e-6) and scores(model, ids) == pytest.approx(scores(model, whole), abs=1e-6)


def test_decode_gives_the_text_and_the_librarys_text(model, unigram):
    for t in texts():
        ids = model.encode(t)[0].tolist()
        assert model.decode(ids) == unigram.decode(ids)
        if MARKLESS(t):
            assert model.decode(ids) == t


def MARKLESS(t):
    return op.MARK not in t


def test_operators(docs):
    rows = ["one two", None, "", "é" * 500, "one two"]
    enc = op.encoded(docs(rows), op.public_model())
    assert {"component", "ids", "score", "text"} <= set(enc.columns)
    back = {r["doc_id"]: r["text"] for r in op.decoded(enc, op.public_model()).collect()}
    assert back == {i: t or "" for i, t in enumerate(rows)}
    got = op.round_trip(docs(rows), op.public_model()).collect()
    assert all(r["same_text"] for r in got) and {r["doc_id"]: r["n_bytes"] for r in got}[3] == 1000
    assert op.round_trip(docs([]), op.public_model()).count() == 0
