"""Ordered outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmat.functions.coords import block_of, n_blocks

# Keys per counting band: what one task sorts to number its rows.
BAND = 100_000
# Bytes of text that count as one entry of the sketch that cuts files.
ENTRY_BYTES = 16
# Without a number of files: no more files than there are pieces of this size.
LEAST_FILE_BYTES = 1 << 20
# Accuracy of the sketch: its rank error is about 0.2 percent of all bytes.
SKETCH_SIZE = 1600
# Tasks per slot where work units are placed by number.
TASKS_PER_SLOT = 4


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Global order by numeric keys."""
    return df.orderBy(*keys)


def slots(df: DataFrame) -> int:
    """Tasks that a shuffle of the session runs."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def file_cuts(df: DataFrame, key: str, weight: Column, files: int) -> DataFrame:
    """One row: the ``files - 1`` keys that cut the rows of ``df`` into runs of equal weight, and the whole weight: ``(cuts, total)``.

    A mergeable quantile sketch of the keys, one entry for every ENTRY_BYTES of
    a row's weight: summed up in the tasks, a few kilobytes leave each. What is
    left over makes one more entry with its share as probability, drawn by a hash
    of the key, so that light rows count in proportion too.
    """
    draw = (F.pmod(F.xxhash64(key), F.lit(1 << 20)) + F.lit(0.5)) / F.lit(float(1 << 20))
    entries = F.floor(weight / F.lit(float(ENTRY_BYTES)) + draw).cast("int")
    weighed = df.select(F.col(key).cast("bigint").alias("key"), weight.alias("weight"), entries.alias("entries"))
    # The weight itself goes with the first entry, or with one that is no key.
    copies = weighed.select("key", "weight", F.explode(F.sequence(F.lit(0), F.col("entries"))).alias("n"))
    counted = copies.agg(
        F.kll_sketch_agg_bigint(F.when(F.col("n") > 0, F.col("key")), F.lit(SKETCH_SIZE)).alias("sketch"),
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("weight"))), F.lit(0)).alias("total"),
    )
    ranks = F.array(*[F.lit(n / files) for n in range(1, files)])
    some = F.kll_sketch_get_n_bigint("sketch") > 0
    cuts = F.when(some, F.kll_sketch_get_quantile_bigint("sketch", ranks)) if files > 1 else F.lit(None).cast("array<bigint>")
    return counted.select(cuts.alias("cuts"), "total")


def _cuts_below(cuts: Column, key: Column, n: int) -> Column:
    """How many of ``n`` sorted cuts are at most the key: bisection, so many cuts cost a row little."""
    steps = [1 << b for b in reversed(range(max(n, 1).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at),
    )
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def with_file(
    df: DataFrame,
    key: str,
    n_keys: int,
    files: int | None = None,
    weight: Column | None = None,
    weigh: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """Rows with the number ``_file`` of the file they belong to, and how many files there are at most.

    File n holds smaller keys than file n+1. Without ``weight`` the keys are
    taken to be 0..n_keys-1, all there and all alike, so each goes straight to
    its file. With it, such as the bytes of a line, a sketch of the weight by key
    says where to cut, so that files are equally long however keys and weights
    are spread; it is part of the same plan and reads the shuffle that the rows
    come from. Another table with the key, ``weigh``, may be weighed instead, such
    as the lists that lines are made of, so that no line is made twice.
    ``files`` is the number of files; left out, one per slot, but with
    ``weight`` not more than the bytes are worth.
    """
    n_files = max(1, min(files or slots(df), n_keys))
    if weight is None:
        file = block_of(F.col(key), n_blocks(max(1, n_keys), n_files))
        return df.withColumn("_file", file.cast("int")), n_files
    known = file_cuts(weigh or df, key, weight, n_files).select(F.struct("cuts", "total").alias("known"))
    placed = df.withColumn("_known", known.scalar())
    file = _cuts_below(F.col("_known.cuts"), F.col(key), n_files - 1)
    if files is None:
        # Fewer files for little text: neighbouring runs share one.
        used = F.greatest(F.lit(1), F.least(F.lit(n_files), F.ceil(F.col("_known.total") / F.lit(LEAST_FILE_BYTES)).cast("int")))
        file = F.call_function("div", file * used, F.lit(n_files)).cast("int")
    return placed.withColumn("_file", file).drop("_known"), n_files


def sort_into_files(
    df: DataFrame,
    key: str,
    n_keys: int,
    *then: str,
    files: int | None = None,
    weight: Column | None = None,
    weigh: DataFrame | None = None,
) -> DataFrame:
    """Sorted, one partition for each file of ``with_file``.

    A range partitioning would run the whole input once more to sample it, and
    would count rows alike.
    """
    placed, n_files = with_file(df, key, n_keys, files, weight, weigh)
    return placed.repartitionById(n_files, "_file").sortWithinPartitions(key, *then).drop("_file")


def sort_rows(df: DataFrame, key: str = "i") -> DataFrame:
    """Sorted inside each output partition only, as a reducer's output would be."""
    return df.repartition(key).sortWithinPartitions(key)


def sort_blocks(df: DataFrame) -> DataFrame:
    """Lexicographic order on (bi, bj)."""
    return df.orderBy("bi", "bj")


def number_in_order(df: DataFrame, key: str, name: str = "pos", band: int = BAND) -> DataFrame:
    """Position of every row in the ascending order of a unique BIGINT key.

    Rows are numbered inside bands of keys, and the sizes of the bands before
    are added. Only one row per band meets in a single task.
    """
    banded = df.withColumn("_band", block_of(F.col(key), band))
    sizes = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_band")) - F.col("_n")
    offsets = sizes.select("_band", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_band").orderBy(key)) - 1
    numbered = banded.withColumn("_rank", rank).join(offsets, "_band")
    return numbered.withColumn(name, F.col("_before") + F.col("_rank")).drop(
        "_band", "_before", "_rank"
    )
