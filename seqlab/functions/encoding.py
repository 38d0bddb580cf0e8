"""Token encoding, padding and windows on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab import fixed_values as V
from seqlab.functions.arrays import indices, let


def decode_codes(codes: Column, names: dict[int, str] | None) -> Column:
    """Integer codes to names by position; unknown codes keep their digits."""
    if not names:
        return F.transform(codes, lambda c: c.cast("string"))
    table = F.array(*[F.lit(names.get(i)) for i in range(max(names) + 1)])
    return let(
        table,
        lambda t: F.transform(codes, lambda c: F.coalesce(F.when(c >= 0, F.get(t, c)), c.cast("string"))),
    )


def encode_literal(seq: Column, vocab: dict[str, int], unknown: int = V.UNK_INDEX) -> Column:
    """Encode with a small literal vocabulary; also valid on streams."""
    items: list[Column] = []
    for token, idx in vocab.items():
        items += [F.lit(token), F.lit(idx)]
    return let(
        F.create_map(*items),
        lambda m: F.transform(seq, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(unknown))),
    )


def pad(seq: Column, max_len: int, value: int = V.PAD_INDEX) -> Column:
    """Right-pad and right-truncate to ``max_len``."""
    return F.slice(F.concat(seq, F.array_repeat(F.lit(value), max_len)), 1, max_len)


def window_count(n: Column, width: int, stride: int) -> Column:
    return F.when(n <= width, F.lit(1)).otherwise(
        F.least(F.lit(1) + F.ceil((n - width) / F.lit(stride)), F.ceil(n / F.lit(stride))).cast("int")
    )


def windows(seq: Column, width: int, stride: int | None = None, value: int = V.PAD_INDEX) -> Column:
    """Padded windows of one encoded row as an array of arrays."""
    step = stride if stride and stride > 0 else width
    return let(
        seq,
        lambda s: F.transform(
            indices(window_count(F.size(s), width, step)),
            lambda i: F.transform(
                F.sequence(i * step, i * step + F.lit(width - 1)), lambda j: F.coalesce(F.get(s, j), F.lit(value))
            ),
        ),
    )


def unknown_count(encoded: Column, unknown: int = V.UNK_INDEX) -> Column:
    return F.size(F.filter(encoded, lambda x: x == unknown))


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def spelling_candidates(token: Column, aliases: dict[str, str] | None = None) -> Column:
    """Spellings to try against a vocabulary, best first; nulls mark rules that
    do not apply, so positions stay the rank of the rule."""
    aliases = V.CALL_ALIASES if aliases is None else aliases
    items: list[Column] = []
    for name, target in aliases.items():
        items += [F.lit(name), F.lit(target)]

    def without(suffix: str) -> Column:
        stem = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        return F.when(F.endswith(token, F.lit(suffix)), stem)

    tried: Sequence[Column] = [
        token,
        F.try_element_at(F.create_map(*items), token) if items else F.lit(None).cast("string"),
        without(V.CALLER_SUFFIX),
        F.concat(token, F.lit("w")),
        F.concat(token, F.lit("a")),
    ]
    for suffix in ("ex2", "ex"):
        tried = [*tried, without(suffix), F.concat(without(suffix), F.lit("w")), F.concat(without(suffix), F.lit("a"))]
    return F.array(*tried)
