"""Matrices stored as text.

=============  ================================================
form           line
=============  ================================================
dense          ``v0 v1 ...``; the row number is the line number
dense with id  ``rowId v0 v1 ...``
CSR            ``rowId col val col val ...``
CSC            ``colId row val row val ...``
=============  ================================================

The reads with an id are narrow: no line leaves the task that read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmat.functions import arrays
from gridmat.functions.text import check_mode, parse_double, tokens
from gridmat.matrix import CellMatrix, Matrix, VectorMatrix, inside
from gridmat.sources import text_kernels

# Tasks get the kernels' code with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(text_kernels)

# Tasks of a scan up to which the line numbers of its splits are sent to all of them.
SENT_TASKS = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder with their position: ``(line_no, line)``.

    Files count in path order, lines in file order. Within one input split the
    ids of ``monotonically_increasing_id`` are consecutive, so a line's number
    is its id plus a shift that its split determines. The lines themselves are
    never shuffled or sorted: a first pass counts them by split, and the shifts,
    a few bytes for every split, are sent to all tasks (joined by a shuffle
    where the scan has more than ``SENT_TASKS`` tasks). Every line brings its
    own file and block; if the second scan was cut otherwise than the first,
    as after a change of settings or cluster size, the job fails.
    """
    mid = F.monotonically_increasing_id().alias("mid")
    text = spark.read.text(path)
    place = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    ]
    splits = (
        text.select(*place, mid)
        .groupBy("file", "start")
        .agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    before = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")
    # The upper bits of an id are the number of the task, which may read several splits.
    of_tasks = (
        splits.withColumn("shift", before - F.col("first"))
        .groupBy(_task_of("first").alias("task"))
        .agg(F.sort_array(F.collect_list(F.struct("first", "shift", "n", "file", "start"))).alias("splits"))
    )
    if text.rdd.getNumPartitions() <= SENT_TASKS:
        of_tasks = F.broadcast(of_tasks)
    lines = text.select(F.col("value").alias("line"), *place, mid)
    own = F.get(F.filter("splits", lambda s: (s["first"] <= F.col("mid")) & (F.col("mid") < s["first"] + s["n"])), F.lit(0))
    known = (own["file"] == F.col("file")) & (own["start"] == F.col("start"))
    moved = F.raise_error(F.lit("the input was split otherwise when its lines were counted")).cast("bigint")
    return lines.join(of_tasks, _task_of("mid") == F.col("task"), "left").select(
        F.when(known, F.col("mid") + own["shift"]).otherwise(moved).alias("line_no"), "line"
    )


def _task_of(mid: str) -> Column:
    return F.shiftright(mid, 33)


def _numbers(texts: Column, mode: str) -> Column:
    if mode == "strict":
        return texts.cast("array<double>")
    return F.transform(texts, lambda t: parse_double(t, mode))


def read_dense(
    spark: SparkSession, path: str, shape: tuple[int, int], mode: str = "strict"
) -> VectorMatrix:
    """Dense rows without an id; the line number is the row number.

    ``permissive`` reads an unreadable number as no value. A line that
    contradicts the shape, too long or one too many, fails in both modes.
    """
    check_mode(mode)
    values = _numbers(tokens(F.col("line")), mode)
    rows = numbered_lines(spark, path).select(F.col("line_no").alias("id"), values.alias("vec"))
    fitted = inside(arrays.fit(F.col("vec"), shape[1]), shape[0], i="id")
    return VectorMatrix(rows.select("id", fitted.alias("vec")), *shape)


def _id_and_rest(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(tokens(F.col("value")).alias("t"))
    return lines.filter(F.size("t") > 0).select(
        F.element_at("t", 1).cast("bigint").alias("id"),
        F.slice("t", 2, F.size("t")).alias("rest"),
    )


def read_dense_id(
    spark: SparkSession,
    path: str,
    shape: tuple[int, int],
    zero_test: str | None = None,
    mode: str = "strict",
) -> CellMatrix:
    """Dense rows that start with their row id, as cells; an unreadable number of the ``permissive`` mode is no cell.

    ``zero_test`` drops zeros while reading: ``"value"`` drops every number
    equal to zero, ``"literal"`` only tokens that are exactly ``0``.
    """
    check_mode(mode)
    if zero_test == "literal":  # before the line is spread into tokens, which are zeros nearly all
        cells = spark.read.text(path).mapInArrow(text_kernels.present_tokens, "id STRING, pos BIGINT, token STRING")
    else:
        numbered = F.transform("rest", lambda t, p: F.struct(p.alias("pos"), t.alias("token")))
        cells = _id_and_rest(spark, path).select("id", F.inline(numbered))
    cells = cells.select(
        F.col("id").cast("bigint").alias("i"),
        F.col("pos").cast("bigint").alias("j"),
        parse_double(F.col("token"), mode).alias("v"),
    )
    if zero_test == "value":
        cells = cells.filter(F.col("v") != 0.0)
    elif zero_test not in (None, "literal"):
        raise ValueError(f"zero_test must be 'value', 'literal' or None, not {zero_test!r}")
    return CellMatrix.of(cells, *shape)


def _read_pairs(spark: SparkSession, path: str, mode: str) -> DataFrame:
    check_mode(mode)
    n_pairs = F.floor(F.size("rest") / 2).cast("int")
    numbers = F.when(n_pairs > 0, F.sequence(F.lit(0), n_pairs - 1))
    unpaired = F.raise_error(F.lit("index without a value")).cast("array<int>")
    numbers = F.when(F.size("rest") % 2 == 1, unpaired).otherwise(numbers)
    entries = _id_and_rest(spark, path).select("id", "rest", F.explode(numbers).alias("p"))
    return entries.select(
        "id",
        F.get("rest", F.col("p") * 2).cast("bigint").alias("idx"),
        parse_double(F.get("rest", F.col("p") * 2 + 1), mode).alias("v"),
    )


def read_csr(
    spark: SparkSession, path: str, shape: tuple[int, int], mode: str = "strict"
) -> CellMatrix:
    entries = _read_pairs(spark, path, mode)
    cells = entries.select(F.col("id").alias("i"), F.col("idx").alias("j"), "v")
    return CellMatrix.of(cells, *shape)


def read_csc(
    spark: SparkSession, path: str, shape: tuple[int, int], mode: str = "strict"
) -> CellMatrix:
    entries = _read_pairs(spark, path, mode)
    cells = entries.select(F.col("idx").alias("i"), F.col("id").alias("j"), "v")
    return CellMatrix.of(cells, *shape)


def read_pair(
    spark: SparkSession,
    path_a: str,
    path_b: str,
    shape_a: tuple[int, int],
    shape_b: tuple[int, int],
    reader: Callable[..., Matrix] = read_dense,
    **options,
) -> tuple[Matrix, Matrix]:
    """Left and right operand of a product, bound by argument order."""
    return (
        reader(spark, path_a, shape_a, **options),
        reader(spark, path_b, shape_b, **options),
    )


def line_profile(spark: SparkSession, path: str) -> DataFrame:
    """Line count, longest line and total text width of a matrix file."""
    width = F.length("value")
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max(width).cast("bigint").alias("max_width"),
        F.sum(width.cast("bigint")).alias("total_width"),
    )
