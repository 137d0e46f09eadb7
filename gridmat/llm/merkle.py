"""Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups.

The rows of a group are its leaves, in the order of their ids. On each level
runs of ``arity`` consecutive nodes become one node, until one is left; the
last run may be shorter, even a single node, and is hashed like the others.

Levels are climbed with windows over rows in order: a node stands on the row of
its first leaf, lag and lead columns at fixed offsets (1 to arity - 1 nodes)
bring its siblings, masked by its slot in the run and by the run's length, and
the rows of first children hash the parents. A window never holds a group: it
covers ``arity ** STEPS`` rows, an aligned part of the group whose nodes meet
inside it, and what is left of each part are the rows of the next, smaller
table. Numbers of rows come from a range partitioning, its pieces counted first.

A row's path, the siblings from leaf to root, is put together downwards: its
own levels from the window, the rest from its part's row of the next table.
Everything is done with Spark's own expressions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmat.llm.common import stored

ARITY = 2
#: Levels that one table climbs: a window covers ARITY ** STEPS rows.
STEPS = 8
#: Ids with this divisor of their crc32 are tampered with in the query.
TAMPERED = 7
_STEP = "struct<left: string, right: string>"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value as hashed: its length in bytes, a colon and its text; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(value: Column) -> Column:
    """A text for each value of a grouping column, nulls first and a value of their own, in the order of bytes."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in their group, from 0, and the group's size ``n``; written out.

    Rows go to pieces by ranges of (group, order, a number of their own), so a
    group of any size is spread, and equal rows with it. Pieces are written
    before they are counted, so that a repeated task cannot cut them elsewhere.
    """
    pieces = rows.withColumn("_tie", F.monotonically_increasing_id())
    pieces = pieces.repartitionByRange(group, *order, "_tie").withColumn("_piece", F.spark_partition_id())
    pieces = stored(pieces, "merkle-pieces")
    counts = pieces.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_piece", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"), F.sum("_count").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order, "_tie")) - 1
    placed = pieces.withColumn("_inside", inside).join(starts, [group, "_piece"]).withColumn("pos", F.col("_start") + F.col("_inside"))
    return stored(placed.drop("_piece", "_tie", "_inside", "_start"), "merkle-rows")


def _climbed(nodes: DataFrame, arity: int, steps: int) -> DataFrame:
    """``nodes`` (grp, pos, n, h) with ``up`` = steps of the path below the part's root, and ``top`` on the row of that root."""
    part = F.floor(F.col("pos") / F.lit(arity**steps)).cast("long")
    out = nodes.withColumn("part", part).withColumn("_h", F.col("h"))
    window = Window.partitionBy("grp", "part").orderBy("pos")
    none = F.lit("")
    for level in range(steps):
        width = arity**level
        place = F.floor(F.col("pos") / F.lit(width)).cast("long")
        count = F.ceil(F.col("n") / F.lit(width)).cast("long")
        # Nodes stand on the rows of their first leaves; a single node is the root and is not hashed again.
        node = (F.col("pos") % width == 0) & (count > 1)
        slot = place % arity
        length = F.least(F.lit(arity).cast("long"), count - (place - slot))
        near = {f"_lag{d}": F.lag("_h", d * width).over(window) for d in range(1, arity)}
        near |= {f"_lead{d}": F.lead("_h", d * width).over(window) for d in range(1, arity)}
        left = F.concat(none, *[F.when(slot >= d, F.col(f"_lag{d}")).otherwise(none) for d in range(arity - 1, 0, -1)])
        right = F.concat(none, *[F.when(slot + d < length, F.col(f"_lead{d}")).otherwise(none) for d in range(1, arity)])
        parent = F.when(slot == 0, digest(F.col("_h"), F.col(f"_step{level}.right")))
        out = out.withColumns(near).withColumn(f"_step{level}", F.when(node, F.struct(left.alias("left"), right.alias("right"))))
        out = out.withColumn("_h", F.when(node, parent).when((F.col("pos") % width == 0) & (count == 1), F.col("_h"))).drop(*near)
    # The step of a node holds for all leaves below it, the rows up to the next node's.
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = [F.last(f"_step{level}", ignorenulls=True).over(so_far).alias(f"_step{level}") for level in range(steps)]
    out = out.select(*nodes.columns, "part", F.when(F.col("pos") % arity**steps == 0, F.col("_h")).alias("top"), *spread)
    up = F.filter(F.array(*[F.col(f"_step{level}") for level in range(steps)]), lambda s: s.isNotNull())
    return out.select(*nodes.columns, "part", "top", up.alias("up"))


class Tree(NamedTuple):
    """Tables of nodes (grp, pos, n, h) from the leaves up, and the roots (grp, root)."""

    tables: list[DataFrame]
    roots: DataFrame
    arity: int
    steps: int

    def with_paths(self, over: DataFrame | None = None, level: int = 0) -> DataFrame:
        """The rows of a table with ``path``, their siblings up to the root of their group.

        ``over`` goes on above the groups: (grp, path, others), whose path is
        appended and whose other columns are added. It meets the topmost table,
        which has at most arity ** steps rows of a group, and travels down by parts.
        """
        own = _climbed(self.tables[level], self.arity, self.steps).drop("top")
        if level + 1 < len(self.tables):
            above = self.with_paths(over, level + 1).drop("n", "h").withColumnsRenamed({"pos": "part", "path": "_above"})
            both = own.join(above, ["grp", "part"])
        elif over is not None:
            both = own.join(over.withColumnRenamed("path", "_above"), "grp")
        else:
            return own.withColumnRenamed("up", "path").drop("part")
        return both.withColumn("path", F.concat("up", "_above")).drop("up", "_above", "part")


def tree(leaves: DataFrame, arity: int = ARITY, steps: int = STEPS) -> Tree:
    """The tree over numbered leaves (grp, pos, n, h, others).

    The number of tables, the logarithm of the largest group, is all that the driver learns.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    tables = [leaves]
    while True:
        tops = _climbed(tables[-1].select("grp", "pos", "n", "h"), arity, steps).where(F.col("top").isNotNull())
        size = F.ceil(F.col("n") / F.lit(arity**steps)).cast("long")
        above = stored(tops.select("grp", F.col("part").alias("pos"), size.alias("n"), F.col("top").alias("h")), "merkle-nodes")
        most = -(-most // arity**steps)
        if most <= 1:
            return Tree(tables, above.select("grp", F.col("h").alias("root")), arity, steps)
        tables.append(above)


def proof(path: Column) -> Column:
    """Digest of the siblings of a path, from the leaf's level up, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def leaf_rows(docs: DataFrame, fields: list[str], group: str, order: str, tampered: Column, changed: dict[str, Column]) -> DataFrame:
    """grp, the ordering column as ``id``, the leaf ``h`` of each row, and ``other``, its leaf after tampering (null where there is none)."""
    leaf = digest(*[field(F.col(c)) for c in fields])
    other = digest(*[field(changed.get(c, F.col(c))) for c in fields])
    return docs.select(group_key(F.col(group)).alias("grp"), F.col(order).alias("id"), leaf.alias("h"), F.when(tampered, other).alias("other"))


def manifest(docs: DataFrame, arity: int = ARITY, steps: int = STEPS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Leaves are doc_id, source, lang, n_chars and text; groups are languages, a
    null one first; ids ascend, null ids first; rows of equal id follow each
    other by their digest, and repeated rows are leaves of their own. Empty
    texts have length 0, unlike nulls. An id whose crc32 is divisible by
    ``TAMPERED`` is checked with n_chars one higher; a null id or a null
    n_chars is checked as it is. A group of one leaf is its own subroot. An
    empty table gives no rows; other columns are not looked at.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    rows = leaf_rows(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", chosen, {"n_chars": F.col("n_chars") + 1})
    leaves = tree(numbered(rows, "grp", ["id", "h"]), arity, steps)
    # The subroots are the leaves of one more tree.
    subroots = leaves.roots.select(F.lit("").alias("all"), F.col("grp").alias("lang"), F.col("root").alias("h"))
    groups = tree(numbered(subroots, "all", ["lang"]).withColumnRenamed("all", "grp"), arity, steps)
    roots = groups.roots.select("grp", F.array().cast(f"array<{_STEP}>").alias("path"), "root")
    over = groups.with_paths(roots).select(F.col("lang").alias("grp"), F.col("h").alias("subroot"), "path", "root")
    path = F.col("path")
    out = leaves.with_paths(over).select(
        F.col("id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof(path).alias("proof_sha256"), folded(F.coalesce("other", "h"), path).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


__all__ = ["Tree", "folded", "leaf_rows", "manifest", "numbered", "proof", "tree"]
