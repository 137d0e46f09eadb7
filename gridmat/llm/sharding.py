"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. Every shard (leaf) makes a draw for a
key, exponential with the shard's weight as its rate, from a hash of key and
leaf; the draw of a rack is the smallest of its shards, that of a region the
smallest of its racks. A row descends from level to level to the child with
the smallest draw. The smallest of independent exponential draws is exponential
with the summed weight, so each level chooses in proportion to the weight below
a child, and a changed weight moves keys only into or out of its own subtree:
a new shard takes keys into itself and moves nothing between the others.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Region -> rack -> shard -> weight. 24 equal shards; a real cluster would hand over its capacities.
DEFAULT_TREE = {r: {k: {r * 12 + k * 4 + s: 1.0 for s in range(4)} for k in range(3)} for r in range(2)}
_RANGE = float(1 << 52)


def with_leaf(tree: dict, region: int, rack: int, shard: int, weight: float = 1.0) -> dict:
    """A copy of the tree with one more shard."""
    out = {r: {k: dict(leaves) for k, leaves in racks.items()} for r, racks in tree.items()}
    out.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    return out


def _draw(key: Column, leaf: int, weight: float) -> Column:
    """Exponential draw of a leaf from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(leaf)), key)), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(_RANGE)) / F.lit(float(weight))


def _smallest(options: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Smallest draw and what it stands for; ties go to the first."""
    if len(options) == 1:
        return options[0]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(options)]))
    return best["d"], best["v"]


def tree_draw(key: Column, tree: dict) -> Column:
    """(draw, shard) of the leaf that a key reaches by descending region, rack and shard."""
    leaves = {r: {k: {s: (_draw(key, s, w), F.lit(int(s))) for s, w in sorted(shards.items()) if w > 0} for k, shards in sorted(racks.items())} for r, racks in sorted(tree.items())}
    racks = {r: [_smallest(list(shards.values())) for shards in kinds.values() if shards] for r, kinds in leaves.items()}
    regions = [_smallest(kinds) for kinds in racks.values() if kinds]
    draw, shard = _smallest(regions)
    return F.struct(draw.alias("draw"), shard.alias("shard"))


def assign(df: DataFrame, key: Column, tree: dict = DEFAULT_TREE, grown: tuple[int, int, int, float] | None = None, shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """Add the shard of each row, and the shard it would have with one more leaf ``grown`` = (region, rack, shard, weight).

    ``key`` decides alone; a null key counts as its own value and repeated keys
    share a shard. The larger tree is not drawn anew: the new leaf wins a key
    where its draw is smaller than the smallest of all others.
    """
    text = F.coalesce(key.cast("string"), F.lit("\x00"))
    out = df.withColumn("_best", tree_draw(text, tree)).withColumn(shard, F.col("_best.shard").cast("int"))
    if grown is not None:
        _, _, leaf, weight = grown
        out = out.withColumn(grown_shard, F.when(_draw(text, leaf, weight) < F.col("_best.draw"), F.lit(int(leaf))).otherwise(F.col(shard)).cast("int"))
    return out.drop("_best")


def number_within(df: DataFrame, group: str, order: list[Column], name: str, pieces: int) -> DataFrame:
    """Number the rows of every group from 0 without gaps.

    A group is dealt into ``pieces`` by a hash of the ordering values; rows are
    numbered within a piece and each piece starts where the ones before it end,
    so that no task holds a whole group. The offsets are a table of at most
    groups x pieces rows.
    """
    from pyspark.sql import Window

    piece = F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int")
    dealt = df.withColumn("_piece", piece)
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n")).select(group, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(starts, [group, "_piece"]).withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_piece", "_inside", "_start")


def shard_documents(docs: DataFrame, tree: dict = DEFAULT_TREE, grown: tuple[int, int, int, float] = (1, 2, 24, 1.0), pieces: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Law ``key``: the doc_id and the tree decide. A null text has size 8 and the
    crc32 of no bytes (0); a null doc_id is a key of its own; repeated rows go
    to one shard and take a slot each; an empty table gives no rows. Columns
    other than doc_id and text are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = assign(rows, F.col("doc_id"), tree, grown)
    rows = number_within(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", pieces)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def totals(assigned: DataFrame) -> DataFrame:
    """Rows, bytes and rows leaving each shard when the tree grows."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum((F.col("shard") != F.col("grown_shard")).cast("long")).alias("leaving"))


__all__ = ["DEFAULT_TREE", "assign", "number_within", "shard_documents", "totals", "tree_draw", "with_leaf"]
