"""Sequence cleaning, one array column in, one out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.arrays import let


def remove_sandbox_tokens(seq: Column) -> Column:
    return F.filter(seq, lambda x: ~F.startswith(x, F.lit(V.SANDBOX_PREFIX)))


def collapse_runs(seq: Column, max_repeats: int = V.MAX_CONSECUTIVE_DUPLICATES) -> Column:
    """Keep at most the first ``max_repeats`` tokens of every run: a token goes
    when it equals each of the ``max_repeats`` tokens before it."""

    def repeated(a: Column, x: Column, i: Column) -> Column:
        same = [F.get(a, i - F.lit(back)) == x for back in range(1, max_repeats + 1)]
        return F.coalesce(reduce(lambda p, q: p & q, same), F.lit(False))

    return let(seq, lambda a: F.filter(a, lambda x, i: ~repeated(a, x, i)))


def drop_repeats(seq: Column) -> Column:
    return collapse_runs(seq, 1)


def clean(seq: Column, max_repeats: int = V.MAX_CONSECUTIVE_DUPLICATES) -> Column:
    """Sandbox tokens go first: removing one can join two runs."""
    return collapse_runs(remove_sandbox_tokens(seq), max_repeats)


def truncate(seq: Column, n: int | None) -> Column:
    return seq if n is None else F.slice(seq, 1, n)


def short_trace(seq: Column, max_calls: int = V.SHORT_TRACE_CALLS) -> Column:
    """First ``max_calls`` calls after removing sandbox tokens and repeats."""
    return truncate(drop_repeats(remove_sandbox_tokens(seq)), max_calls)


def lowercase(seq: Column) -> Column:
    return F.transform(seq, F.lower)


def lowercase_without_sandbox(seq: Column) -> Column:
    return F.transform(remove_sandbox_tokens(seq), F.lower)


def external(seq: Column, max_repeats: int = V.MAX_CONSECUTIVE_DUPLICATES) -> Column:
    return clean(lowercase(seq), max_repeats)


def split_tokens(text: Column) -> Column:
    """Whitespace-separated tokens, Unicode-aware, no empties."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def parse_text(text: Column) -> Column:
    """Tokens of free text separated by whitespace, newlines or commas."""
    return split_tokens(F.translate(text, "\n,", "  "))


def long_enough(seq: Column, minimum: int = V.MIN_TEXT_CALLS) -> Column:
    return F.size(seq) >= minimum


def bare_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def hash_of_report(name: Column) -> Column:
    return F.replace(name, F.lit(".json"), F.lit(""))
