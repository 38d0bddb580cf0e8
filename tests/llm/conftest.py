import numpy as np
import pytest


@pytest.fixture()
def docs(spark):
    """Build documents from texts (doc_id = position) or (doc_id, text) pairs, with columns that clash with inner names."""

    def build(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "u", 7) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string, id int")

    return build


@pytest.fixture()
def vectors(spark):
    def build(arrays):
        rows = [(i, None if a is None else [None if x is None else float(x) for x in a], 0, "x") for i, a in enumerate(arrays)]
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string")

    return build


@pytest.fixture()
def rng():
    return np.random.default_rng(7)
