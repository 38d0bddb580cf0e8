"""Row-local array building blocks (Column -> Column, no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Column collapsing may otherwise paste the producing expression into a
    lambda, where it would run once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """``[0, 1, .., n-1]``; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def run_counts(values: Column) -> Column:
    """Distinct values with their counts, as ``array<struct<item, n>>``.

    Sorts the array and measures the runs, so a row is counted where it is:
    nothing is exploded or shuffled.
    """

    def measure(s: Column) -> Column:
        starts = F.filter(
            indices(F.size(s)),
            lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda i, j: F.struct(
                    F.get(s, i).alias("item"),
                    (F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(values), measure)


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All ``low``..``high``-grams of one row, joined by one space."""

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        # element reads cost the same anywhere in the row; a slice copies the row
        return F.transform(
            indices(F.size(t) - F.lit(n - 1)), lambda i: F.concat_ws(" ", *[F.get(t, i + F.lit(k)) for k in range(n)])
        )

    return let(tokens, lambda t: F.flatten(F.array(*[of_size(t, n) for n in range(low, high + 1)])))


def pairs(values: Column) -> Column:
    """Consecutive pairs as ``array<struct<a, b>>``."""
    return let(
        values,
        lambda v: F.transform(
            indices(F.size(v) - F.lit(1)),
            lambda i: F.struct(F.get(v, i).alias("a"), F.get(v, i + 1).alias("b")),
        ),
    )


def total(values: Column) -> Column:
    """Sum of a numeric array as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def vector_cells(vector: Column) -> Column:
    """Stored cells of an ML vector as ``array<struct<i, x>>``; a sparse vector
    is never expanded to its full width."""
    raw = F.unwrap_udt(vector)
    at = F.coalesce(raw["indices"], indices(F.size(raw["values"])))
    return F.zip_with(at, raw["values"], lambda i, x: F.struct(i.alias("i"), x.alias("x")))
