"""Category, antivirus-label and display-name expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab import fixed_values as V

# Such a function may hold its Python form as ``in_python``: a list of tokens (null is None) to the list of their categories.
CategoryOf = Callable[[Column], Column]


def missing_table(token: Column) -> Column:
    """Stands where a caller has not passed a call-to-category table."""
    raise ValueError("pass category=category_from(table) with a call-to-category table")


def category_from(table: dict[str, str], default: str = "other") -> CategoryOf:
    """Category lookup over a caller's own table (bounded by the literal)."""

    def lookup(token: Column) -> Column:
        items = [F.lit(x) for entry in table.items() for x in entry]
        return F.coalesce(F.try_element_at(F.create_map(*items), token), F.lit(default))

    lookup.in_python = lambda tokens: [table.get(t, default) for t in tokens]
    return lookup


def families_in_label(label: Column) -> Column:
    """Distinct families one engine label votes for.

    A Trojan match is dropped when the label is a generic Trojan name or when
    a more specific family matches as well.
    """
    lowered = F.lower(label)

    def matches(family: str) -> Column:
        hit = label.rlike("(?i)" + "|".join(f"(?:{p})" for p in V.FAMILY_PATTERNS[family]))
        for word, target in V.FAMILY_KEYWORDS.items():
            if target == family:
                hit = hit | F.contains(lowered, F.lit(word))
        return hit

    specific = F.array_compact(
        F.array(*[F.when(matches(f), F.lit(f)) for f in V.FAMILIES if f != V.TROJAN])
    )
    generic = label.rlike("(?i)(?:" + V.GENERIC_TROJAN_PATTERN + ")")
    alone = F.when(matches(V.TROJAN) & ~generic, F.array(F.lit(V.TROJAN))).otherwise(F.array().cast("array<string>"))
    usable = label.isNotNull() & (label != "")
    return F.when(usable, F.when(F.size(specific) > 0, specific).otherwise(alone)).otherwise(
        F.array().cast("array<string>")
    )


def short_feature_name(name: Column, max_len: int = 35) -> Column:
    inner = F.replace(name, F.lit("bigram_"), F.lit(""))
    at = F.instr(inner, "_")
    bigram = F.when(
        at > 0,
        F.concat(F.lit("bi:"), F.substring(inner, F.lit(1), at - 1), F.lit(">"), F.substring(inner, at + 1, F.length(inner))),
    ).otherwise(name)
    cut = F.when(F.length(name) > max_len, F.concat(F.substring(name, 1, max_len - 2), F.lit(".."))).otherwise(name)
    return (
        F.when(F.startswith(name, F.lit("bigram_")), bigram)
        .when(F.startswith(name, F.lit("cat_")), name)
        .otherwise(cut)
    )
