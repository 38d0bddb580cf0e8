"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, and a proof for every row.

Nodes are numbered within their tree. Every level joins its nodes to themselves on computed sibling numbers (the
exclusive-or with one in a binary tree, otherwise each of the other slots of the run); a node thereby holds the
digests to its left and right in its run, and the node in slot zero emits the parent. Paths to the root are handed
down again level by level, so a row folds its own (or a tampered) digest up to the root by itself. Only digests
and numbers are shuffled, under keys that are all distinct; a group with most of the rows is no hot key.

Defined cases: a null value is hashed as ``-``; a null group is a group of its own, before all others; rows are
taken by doc_id (nulls first), rows of one doc_id by their digest; repeated rows are leaves of their own; a tree
of one leaf has that leaf as its root, and one group has its root as the root of all; a row without a doc_id is
never tampered with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import numbered, stored, union_all
from seqlab.operators.skew import lookup_join

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: tuple[str, ...] = FIELDS, **other: Column) -> Column:
    """Digest of a row; ``other`` gives fields a changed value."""
    return F.sha2(F.concat(*[field(other.get(c, F.col(c))) for c in fields]), 256)


def tampered_digest() -> Column:
    """Digest of the row with its capitals made small, where 3 divides the doc_id's checksum; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf_digest(text=F.translate("text", CAPITALS, SMALL)))


def leaves(docs: DataFrame, group: str = "lang") -> DataFrame:
    """(tree, idx, n, doc_id, digest, tampered): rows numbered from 0 within their tree of n leaves."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # sorts nulls first
    row = docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf_digest()).alias("digest"), F.unhex(tampered_digest()).alias("tampered"))
    rows = stored(row.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("tree", "doc_id", "digest", "row")]
    placed = numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row"), "no")
    trees = placed.groupBy("tree").agg(F.min("no").alias("_first"), F.count(F.lit(1)).alias("n"))
    return lookup_join(placed, trees, ["tree"]).withColumn("idx", F.col("no") - F.col("_first")).drop("no", "_first")


def sibling_numbers(fanout: int) -> Column:
    """Numbers of the other nodes of a node's run."""
    idx = F.col("idx")
    if fanout == 2:
        return F.array(idx.bitwiseXOR(F.lit(1)))
    slot = idx % fanout
    return F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda k: idx - slot + (slot + k) % fanout)


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, n, idx, digest, left, right): the digests before and after a node in its run, each packed in order."""
    wanted = nodes.select("tree", "n", "idx", "digest", F.explode(sibling_numbers(fanout)).alias("sibling"))
    known = nodes.select("tree", F.col("idx").alias("sibling"), F.col("digest").alias("_digest"))
    met = wanted.join(known, ["tree", "sibling"], "left")
    found = F.sort_array(F.collect_list(F.when(F.col("_digest").isNotNull(), F.struct("sibling", "_digest"))))
    runs = met.groupBy("tree", "n", "idx").agg(F.first("digest").alias("digest"), found.alias("_found"))
    packed = lambda side: F.aggregate(F.filter("_found", side), F.lit(b""), lambda a, x: F.concat(a, x["_digest"]))
    return runs.select(
        "tree", "n", "idx", "digest",
        packed(lambda x: x["sibling"] < F.col("idx")).alias("left"), packed(lambda x: x["sibling"] > F.col("idx")).alias("right"),
    )


def hex_of(packed: Column | str) -> Column:
    return F.lower(F.hex(packed))


def parent_digest(own: Column, left: Column | str, right: Column | str) -> Column:
    """Digest (hexadecimal) of a run, from one node's hexadecimal digest and those around it."""
    return F.sha2(F.concat(hex_of(left), own, hex_of(right)), 256)


def levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level from the lowest, and (tree, height, digest) of the roots.

    ``nodes`` is (tree, n, idx, digest). A tree takes part in a level while it has several nodes there.
    """
    runs, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(runs)).alias("height"), "digest"))
        if most <= 1:
            return runs, stored(union_all(tops), "roots")
        run = stored(with_siblings(nodes.where("n > 1"), fanout), "runs")
        runs.append(run)
        above = F.unhex(parent_digest(hex_of("digest"), "left", "right"))
        nodes = run.where(F.col("idx") % fanout == 0).select(
            "tree", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.expr(f"idx div {fanout}").alias("idx"), above.alias("digest"))
        most = -(-most // fanout)


def handed_down(runs: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, path) for the nodes of the lowest level: path holds (left, right) of every level, lowest first.

    ``tops`` is (tree, height, path, ..) with the path that starts at a tree's root; its other columns go along.
    """
    more = [c for c in tops.columns if c not in ("tree", "height", "path")]
    at = lambda h: tops.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("idx"), "path", *more)
    paths = at(len(runs))
    for h in range(len(runs) - 1, -1, -1):
        below = runs[h].withColumn("_up", F.expr(f"idx div {fanout}"))
        joined = below.join(paths.select("tree", F.col("idx").alias("_up"), "path", *more), ["tree", "_up"])
        step = F.concat(F.array(F.struct("left", "right")), F.col("path"))
        paths = joined.select("tree", "idx", step.alias("path"), *more).unionByName(at(h))
        if h:
            paths = stored(paths, "paths")
    return paths


NO_PATH = "cast(array() AS array<struct<left:binary,right:binary>>)"


def manifest(docs: DataFrame, group: str = "lang", fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    folded_root is recomputed from the tampered digest where there is one, and verified tells whether it still is the root.
    """
    rows = stored(leaves(docs, group), "numbered-leaves")
    runs, roots = levels(rows.select("tree", "n", "idx", "digest"), fanout)
    # the tree over the groups' roots, in the order of the groups
    order = F.col("tree").asc()
    base = numbered(roots.repartitionByRange(order).sortWithinPartitions(order), "idx")
    count = base.count()
    base = base.select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), "idx", "digest", F.col("tree").alias("group"), "height")
    upper, top = levels(base.select("tree", "n", "idx", "digest"), fanout)
    root = hex_of(F.lit(bytes(top.first()["digest"]))) if count else F.lit(None).cast("string")  # one row
    start = top.select("tree", "height", F.expr(NO_PATH).alias("path"))
    above = handed_down(upper, start, fanout).select("idx", "path")
    tops = base.select("idx", F.col("group").alias("tree"), "height", hex_of("digest").alias("subroot")).join(above, "idx").drop("idx")
    found = rows.join(handed_down(runs, stored(tops, "group-paths"), fanout), ["tree", "idx"])
    around = F.transform("path", lambda x: F.concat(hex_of(x["left"]), hex_of(x["right"])))
    changed = F.coalesce(hex_of("tampered"), hex_of("digest"))
    folded = F.aggregate("path", changed, lambda own, x: parent_digest(own, x["left"], x["right"]))
    return found.select(
        "doc_id", hex_of("digest").alias("leaf"), "subroot", root.alias("root"),
        F.sha2(F.array_join(around, ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
