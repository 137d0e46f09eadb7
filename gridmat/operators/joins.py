"""The pairings a product is made of.

Every pairing is one on equal keys; none is a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmat.functions.coords import block_of, n_blocks, square_edges
from gridmat.matrix import CellMatrix, Matrix, check_product_shape
from gridmat.operators.ordering import TASKS_PER_SLOT, slots

# Products that one k may form before it is spread over several tasks.
LIGHT_PRODUCTS = 4_000_000
# Parts of one k from which on smaller parts spread its work no better: a k is cut into no more, however many products it has.
BUSY_PARTS = 1024
# Largest work unit of the grid: so many rows or columns, so many values of k.
# One k of a unit forms at most LONGEST_EDGE**2 products, no more than LIGHT_PRODUCTS.
LONGEST_EDGE = 2000
LONGEST_DEPTH = 65_536
# Units per slot up to which shape alone may bound them.
SHORT_RUNS = 16
# Cut units are a table that is sent to every task: at most so many rows.
MOST_CUT_UNITS = 100_000


def _sides(a: Matrix, b: Matrix) -> tuple[DataFrame, DataFrame]:
    left = a.cells().df.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    right = b.cells().df.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return left, right


def heavy_cuts(
    a: Matrix, b: Matrix, light_products: int = LIGHT_PRODUCTS, rows_only: bool = False
) -> DataFrame:
    """The k whose products are too many for one task: ``(k, cuts_a, cuts_b)``.

    Column k of A is to be cut into ``cuts_a`` parts and row k of B into
    ``cuts_b``, so that no part of the work forms many more than
    ``light_products``, an absolute number. But a k is cut into no more parts than
    keep all tasks busy, BUSY_PARTS or some for each slot: each cut copies a side once
    more, and with parts of a fixed size the copies would grow with the products, not
    with the cells. A part then holds more cells, a share of those of its k. Lazy: counts
    by k, summed up before the shuffle, that become part of the plan they are used in.
    """
    check_product_shape(a, b)
    left, right = _sides(a, b)
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    parts = F.ceil(n_a * n_b / F.lit(light_products))
    parts = F.least(parts, F.lit(max(BUSY_PARTS, TASKS_PER_SLOT * slots(a.df))).cast("bigint"))
    cuts_a = parts if rows_only else F.greatest(F.lit(1), F.round(F.sqrt(parts * n_a / n_b)).cast("bigint"))
    cuts_b = F.lit(1).cast("bigint") if rows_only else F.least(F.col("n_b"), F.ceil(parts / F.col("cuts_a")))
    return (
        left.groupBy("k")
        .agg(F.count(F.lit(1)).alias("n_a"))
        .join(right.groupBy("k").agg(F.count(F.lit(1)).alias("n_b")), "k")
        .filter(n_a * n_b > F.lit(light_products))
        .withColumn("cuts_a", F.least(F.col("n_a"), cuts_a))
        .select("k", "cuts_a", cuts_b.alias("cuts_b"))
    )


def _cut_sides(left: DataFrame, right: DataFrame, cuts: DataFrame | None, i: str, j: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part ``(k, p, q)`` of the work they belong to, copied where a k is cut.

    Part p of A's column meets part q of B's row: A's part is repeated for every
    q and B's for every p. ``i`` and ``j`` decide the part of a row.
    """
    if cuts is None:
        zero = {"p": F.lit(0).cast("bigint"), "q": F.lit(0).cast("bigint")}
        return left.withColumns(zero), right.withColumns(zero)
    cuts_a, cuts_b = (F.coalesce(c, F.lit(1).cast("bigint")) for c in ("cuts_a", "cuts_b"))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    cut_left = left.join(cuts, "k", "left").select(*left.columns, F.pmod(F.xxhash64(i), cuts_a).alias("p"), every(cuts_b).alias("q"))
    cut_right = right.join(cuts, "k", "left").select(*right.columns, every(cuts_a).alias("p"), F.pmod(F.xxhash64(j), cuts_b).alias("q"))
    return cut_left, cut_right


def k_join(a: Matrix, b: Matrix, light_products: int = LIGHT_PRODUCTS, rows_only: bool = False) -> DataFrame:
    """Cells of A and B that share k: ``(i, k, j, a, b)``.

    Heavy k are cut on both sides: part p of A's column meets part q of B's
    row in the task for (k, p, q), with A's part repeated for every q and B's
    for every p, so each pair is formed exactly once. The cuts are joined like
    any other table, without a hint and without a list on the driver. Nothing
    is counted when the shape alone rules heavy k out. With ``rows_only`` A's
    columns alone are cut and only B's rows are copied.
    """
    check_product_shape(a, b)
    left, right = _sides(a, b)
    if a.n_rows * b.n_cols <= light_products:
        return left.join(right, "k").select("i", "k", "j", "a", "b")
    left, right = _cut_sides(left, right, heavy_cuts(a, b, light_products, rows_only), "i", "j")
    return left.join(right, ["k", "p", "q"]).select("i", "k", "j", "a", "b")


def grid_pairs(a: Matrix, b: Matrix, row_edge: int, depth: int, col_edge: int, light_products: int = LIGHT_PRODUCTS) -> DataFrame:
    """What meets in each unit of a grid, k by k: ``(bi, bj, bk, k, xs, ys)``.

    A unit ``(bi, bj, bk)`` is one output block and one run of ``depth`` values
    of k. ``xs`` are the cells of A in row block ``bi`` under one k, ``ys`` those
    of B in column block ``bj``: at most ``row_edge`` and ``col_edge`` cells,
    however they are spread. Cells of one k come together once; there they are
    gathered and paired in place, so only pieces that meet are ever copied. A k
    with many cells is dealt out by blocks, as ``k_join`` does by cells.
    """
    check_product_shape(a, b)
    left, right = _sides(a, b)
    left = left.withColumn("bi", block_of(F.col("i"), row_edge))
    right = right.withColumn("bj", block_of(F.col("j"), col_edge))
    light = a.n_rows * b.n_cols <= light_products
    left, right = _cut_sides(left, right, None if light else heavy_cuts(a, b, light_products), "bi", "bj")
    part = ["k"] if light else ["k", "p", "q"]
    # By number of partitions, so that light cells are not merged into few tasks: pairing them is the work.
    n = slots(a.df)
    xs = left.repartition(n, *part).groupBy(*part, "bi").agg(F.collect_list(F.struct("i", "a")).alias("xs"))
    ys = right.repartition(n, *part).groupBy(*part, "bj").agg(F.collect_list(F.struct("j", "b")).alias("ys"))
    return xs.join(ys, part).select("bi", "bj", block_of(F.col("k"), depth).alias("bk"), "k", "xs", "ys")


def unit_cuts(pairs: DataFrame, n_units: int, light_products: int = LIGHT_PRODUCTS) -> DataFrame:
    """Units with too many products for one task and the parts they are cut into: ``(bi, bj, bk, cuts)``.

    A part is to form about ``light_products``, an absolute number. The table
    has at most MOST_CUT_UNITS rows: a grid with more units than that cuts only
    those above one in MOST_CUT_UNITS of all products. Lazy: it becomes part of
    the plan it is used in.
    """
    units = pairs.groupBy("bi", "bj", "bk").agg(F.sum(F.size("xs").cast("bigint") * F.size("ys")).cast("double").alias("n"))
    most = F.lit(float(light_products))
    if n_units > MOST_CUT_UNITS:
        most = F.greatest(most, units.agg(F.sum("n") / MOST_CUT_UNITS).scalar())
    return units.select("bi", "bj", "bk", F.ceil(F.col("n") / most).alias("cuts")).where(F.col("cuts") > 1)


def grid_edges(a: Matrix, b: Matrix, light_products: int = LIGHT_PRODUCTS) -> tuple[int, int, int]:
    """Default ``(row_edge, depth, col_edge)``: about one output block per slot.

    Where a few runs of k for each block are enough to bound a unit by its shape
    alone, k is cut that way and nothing need be counted; else runs are long.
    """
    n = slots(a.df)
    rows, cols = square_edges(a.n_rows, b.n_cols, n, LONGEST_EDGE)
    short = max(1, light_products // (rows * cols))
    units = n_blocks(a.n_rows, rows) * n_blocks(b.n_cols, cols) * n_blocks(a.n_cols, short)
    return rows, short if units <= SHORT_RUNS * n else LONGEST_DEPTH, cols


def may_be_cut(a: Matrix, b: Matrix, edges: tuple[int, int, int], light_products: int = LIGHT_PRODUCTS) -> bool:
    """Whether the shape lets a unit have more products than one task is to form."""
    rows, depth, cols = edges
    return min(rows, a.n_rows) * min(depth, a.n_cols) * min(cols, b.n_cols) > light_products


def sent_edges(a: Matrix, b: Matrix, edges: tuple[int, int, int], tasks: int, light_products: int = LIGHT_PRODUCTS) -> tuple[int, int, int]:
    """Edges of what is sent to one task together: neighbouring blocks share the pieces that each of them needs.

    As long as there are more such units than tasks, and their shape alone keeps
    them below ``light_products``; else the edges themselves.
    """
    rows, depth, cols = edges
    strips = n_blocks(a.n_cols, depth)
    wide = cols * max(1, min(n_blocks(b.n_cols, cols), LONGEST_EDGE // cols))

    def fits(rows: int, cols: int) -> bool:
        units = n_blocks(a.n_rows, rows) * n_blocks(b.n_cols, cols) * strips
        return units >= tasks and not may_be_cut(a, b, (rows, depth, cols), light_products)

    if not fits(rows, cols):
        return edges
    while wide > cols and not fits(rows, wide):
        wide = cols * max(1, wide // cols // 2)
    high = rows
    while high * 2 <= LONGEST_EDGE and fits(high * 2, wide):
        high *= 2
    return high, depth, wide


def row_col_join(
    a: Matrix, b: Matrix, edges: tuple[int, int, int] | None = None, light_products: int = LIGHT_PRODUCTS
) -> DataFrame:
    """Rows of A against columns of B, output block by output block.

    Returns ``(task, bi, bj, bk, part, i, j, k, a, b)``, partitioned by ``task``:
    whatever is grouped by that and more columns afterwards stays in place.

    Pairs of pieces go to the task of their unit's number. A unit with more
    than ``light_products`` products is cut: its k are dealt into parts, which
    go to the tasks that follow. A part is thus bounded, whether a corner of the
    matrix is full, or one row, or one column; no other unit is cut with it.
    """
    edges = edges or grid_edges(a, b, light_products)
    tasks = TASKS_PER_SLOT * slots(a.df)
    sent = sent_edges(a, b, edges, tasks, light_products)
    n_bi, n_bj, n_bk = n_blocks(a.n_rows, sent[0]), n_blocks(b.n_cols, sent[2]), n_blocks(a.n_cols, sent[1])
    pairs = grid_pairs(a, b, *sent, light_products)
    part = F.lit(0).cast("bigint")
    if may_be_cut(a, b, sent, light_products):
        cuts = unit_cuts(pairs, n_bi * n_bj * n_bk, light_products)
        pairs = pairs.join(F.broadcast(cuts), ["bi", "bj", "bk"], "left")
        part = F.pmod(F.xxhash64("k"), F.coalesce("cuts", F.lit(1)))
    number = (F.col("bi") * F.lit(n_bj) + F.col("bj")) * F.lit(n_bk) + F.col("bk")
    unit = ["task", "bi", "bj", "bk", "part"]
    placed = pairs.withColumn("part", part).withColumn("task", F.pmod(number + F.col("part"), F.lit(tasks)).cast("int"))
    # Arrays of plain numbers take half the room of arrays of structs.
    flat = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side, name in (("xs", "i"), ("xs", "a"), ("ys", "j"), ("ys", "b"))]
    met = placed.select(*unit, "k", *flat).repartitionById(tasks, "task")
    xs, ys = (F.inline(F.arrays_zip(F.col(f"{s}_{n}").alias(n), F.col(f"{s}_{v}").alias(v))) for s, n, v in (("xs", "i", "a"), ("ys", "j", "b")))
    cells = met.select(*unit, "k", "ys_j", "ys_b", xs).select(*unit, "i", "k", "a", ys)
    own = {"bi": block_of(F.col("i"), edges[0]), "bj": block_of(F.col("j"), edges[2])}
    return cells.select(*[own.get(c, F.col(c)).alias(c) for c in unit], "i", "j", "k", "a", "b")


def sparse_intersect(a: Matrix, b: Matrix) -> DataFrame:
    """Positions present in both vectors of every row-column pair: ``(i, j, k, a, b)``."""
    return row_col_join(a, b).select("i", "j", "k", "a", "b")


def block_sizes(m: Matrix, row_edge: int, col_edge: int) -> DataFrame:
    """Cells per block: ``(br, bc, n)``."""
    return (
        m.cells()
        .df.groupBy(
            block_of(F.col("i"), row_edge).alias("br"), block_of(F.col("j"), col_edge).alias("bc")
        )
        .agg(F.count("v").alias("n"))
    )


def block_counts(a: Matrix, b: Matrix, row_edge: int, depth: int, col_edge: int) -> DataFrame:
    """Blocks that meet and their cells, without the blocks: ``(bi, bk, bj, n_a, n_b)``.

    The counts are matrices of blocks, paired on k like any others, so a strip
    with very many blocks on both sides is cut too.
    """
    check_product_shape(a, b)

    def counted(m: Matrix, rows: int, cols: int) -> CellMatrix:
        sizes = block_sizes(m, rows, cols).select(F.col("br").alias("i"), F.col("bc").alias("j"), F.col("n").alias("v"))
        return CellMatrix(sizes, n_blocks(m.n_rows, rows), n_blocks(m.n_cols, cols))

    pairs = k_join(counted(a, row_edge, depth), counted(b, depth, col_edge))
    return pairs.select(F.col("i").alias("bi"), F.col("k").alias("bk"), F.col("j").alias("bj"), F.col("a").alias("n_a"), F.col("b").alias("n_b"))


__all__ = [
    "block_counts",
    "block_sizes",
    "grid_edges",
    "grid_pairs",
    "heavy_cuts",
    "k_join",
    "may_be_cut",
    "row_col_join",
    "sparse_intersect",
    "unit_cuts",
]
