import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from seqlab.runtime import get_spark

    session = get_spark("tests")
    yield session
    session.stop()


@pytest.fixture()
def seqs(spark):
    """Build (sample_id, sequence[, label]) samples from Python lists."""

    def build(rows, labels=None):
        data = [(str(i), list(s), labels[i] if labels else "x") for i, s in enumerate(rows)]
        return spark.createDataFrame(data, "sample_id string, sequence array<string>, label string")

    return build


@pytest.fixture()
def one(seqs):
    """Apply a Column function to one sequence and return the value."""

    def run(seq, fn):
        from pyspark.sql import functions as F

        return seqs([seq]).select(fn(F.col("sequence")).alias("v")).first()["v"]

    return run
