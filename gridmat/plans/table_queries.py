"""Registered queries: every operator over the driver's tables, with its SQL.

``QUERIES`` maps a name to a function of ``(spark, folder)``; ``ORACLES`` maps
the same name to the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmat import sinks, sources
from gridmat.functions import arrays, maps, text
from gridmat.operators import algebra, blocks, dense_product, joins, layout, ordering, profile
from gridmat.operators import estimate, row_product, sparse_product
from gridmat.operators.exact_sum import exact_sum
from gridmat.plans.matmul import matmul
from gridmat.plans.scratch import scratch_path
from gridmat.plans.tables import Tables, exact_sql, with_matrices
from gridmat.plans.text_product import multiply_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str):
    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        ORACLES[name] = oracle
        return build

    return register


def _product_sql(a: str, b: str, a_t: bool = False, b_t: bool = False) -> str:
    ai, ak = ("j", "i") if a_t else ("i", "j")
    bk, bj = ("j", "i") if b_t else ("i", "j")
    return with_matrices(
        dict.fromkeys(a + b),
        f"select a.{ai} as i, b.{bj} as j, sum(a.v * b.v) as v "
        f"from {a} a join {b} b on a.{ak} = b.{bk} group by 1, 2",
    )


# ---------------------------------------------------------------- products


@_query(_product_sql("Q", "M"))
def matmul_opb_sparse(t: Tables) -> DataFrame:
    return sparse_product.matmul_opb_sparse(t.quantities(), t.months()).df


@_query(_product_sql("H", "H", b_t=True))
def matmul_opb_sparse_empty_k(t: Tables) -> DataFrame:
    h = t.high_quantities()
    return sparse_product.matmul_opb_sparse(h, h.T).df


@_query(_product_sql("R", "R", b_t=True))
def matmul_opb_sparse_hot_k(t: Tables) -> DataFrame:
    r = t.flags()
    return sparse_product.matmul_opb_sparse(r, r.T, light_products=1000).df


@_query(_product_sql("Q", "M"))
def matmul_ipb_sparse(t: Tables) -> DataFrame:
    return sparse_product.matmul_ipb_sparse(t.quantities(), t.months()).df


@_query(_product_sql("Q", "M"))
def matmul_ipb_sparse_blocks(t: Tables) -> DataFrame:
    return sparse_product.matmul_ipb_sparse(t.quantities(), t.months(), edges=(64, 900, 5)).df


@_query(_product_sql("Q", "M"))
def matmul_naive_sparse(t: Tables) -> DataFrame:
    return sparse_product.matmul_naive_sparse(t.quantities(), t.months()).df


@_query(_product_sql("E", "E", a_t=True))
def matmul_naive_dense(t: Tables) -> DataFrame:
    e = t.embeddings()
    return dense_product.matmul_naive_dense(e.T, e).df


@_query(_product_sql("E", "E", a_t=True))
def matmul_ipb_dense(t: Tables) -> DataFrame:
    e = t.embeddings()
    return dense_product.matmul_ipb_dense(e.T, e, (48, 1000, 48)).cells().df


@_query(_product_sql("E", "E", a_t=True))
def matmul_opb_dense(t: Tables) -> DataFrame:
    e = t.embeddings()
    return dense_product.matmul_opb_dense(e.T, e, (64, 150, 64)).cells().df


@_query(_product_sql("E", "E", b_t=True))
def matmul_ipb_dense_wide(t: Tables) -> DataFrame:
    e = t.embeddings()
    return dense_product.matmul_ipb_dense(e, e.T).cells().df


@_query(_product_sql("Q", "N"))
def matmul_auto(t: Tables) -> DataFrame:
    """The result has a column without a cell, which no method may fill."""
    return matmul(t.quantities(), t.months_from_one(), method="auto").cells().df


@_query(_product_sql("E", "E", a_t=True))
def matmul_auto_dense(t: Tables) -> DataFrame:
    e = t.embeddings()
    return matmul(e.T, e, method="auto").cells().df


_LINES_OF_PRODUCT = with_matrices(
    "QM",
    "select c.i as line_id, concat(c.i, ' ', string_agg(coalesce(cast(p.v as varchar), '0'), ' ' "
    "order by c.j), ' ') as line from "
    "(select distinct Q.i, m.j from Q, (select distinct j from M) m) c left join "
    "(select a.i, b.j, sum(a.v * b.v) as v from Q a join M b on a.j = b.i group by 1, 2) p "
    "on p.i = c.i and p.j = c.j group by c.i",
)


@_query(_LINES_OF_PRODUCT)
def matmul_text_sparse(t: Tables) -> DataFrame:
    """From dense text with row ids, over sparse text, to result text."""
    spark = t.spark
    q, m = t.quantities(), t.months()
    root = scratch_path(spark, "matmul_text_sparse")
    # The text has every missing cell, rows times columns of them; packed, they take next to nothing.
    sinks.write_row_text(q, f"{root}/A", compression="gzip", level="BEST_SPEED")
    sinks.write_row_text(m, f"{root}/B", compression="gzip", level="BEST_SPEED")
    multiply_text(
        spark, f"{root}/A", f"{root}/B", f"{root}/C", (q.n_rows, q.n_cols), (m.n_rows, m.n_cols),
        method="OPB", sparsity=50,
    )
    line = F.col("value")
    return spark.read.text(f"{root}/C").select(
        F.element_at(text.tokens(line), 1).cast("bigint").alias("line_id"), line.alias("line")
    )


@_query(
    with_matrices(
        "E",
        "select i as line_no, string_agg(concat(cast(v as bigint), '.000'), ' ' order by j) || ' ' "
        "as line from (select a.j as i, b.j, sum(a.v * b.v) as v from E a join E b on a.i = b.i "
        "group by 1, 2) group by i",
    )
)
def matmul_text_dense(t: Tables) -> DataFrame:
    """From dense text without ids to result text; rows are known by position."""
    spark = t.spark
    e = t.embeddings()
    root = scratch_path(spark, "matmul_text_dense")
    sinks.write_dense_text(e.T, f"{root}/A")
    sinks.write_dense_text(e, f"{root}/B")
    multiply_text(
        spark, f"{root}/A", f"{root}/B", f"{root}/C", (e.n_cols, e.n_rows), (e.n_rows, e.n_cols), method="OPB"
    )
    return sources.numbered_lines(spark, f"{root}/C")


# ------------------------------------------------------- algebra on matrices


@_query(
    with_matrices(
        "QM", "select a.j as k, a.i as i, b.j as j, a.v * b.v as v from Q a join M b on a.j = b.i"
    )
)
def outer_product(t: Tables) -> DataFrame:
    return algebra.outer_product(t.quantities(), t.months())


@_query(with_matrices("Q", "select i, j, v * 2.5::double as v from Q"))
def scale(t: Tables) -> DataFrame:
    return algebra.scale(t.quantities(), 2.5).df


@_query(
    with_matrices(
        "QH", "select i, j, sum(v) as v from (from Q union all from H) group by 1, 2"
    )
)
def add(t: Tables) -> DataFrame:
    return algebra.add(t.quantities(), t.high_quantities()).df


@_query(
    with_matrices(
        "QM",
        "select sum(x.v * y.v) as v from (select j as k, sum(v) as v from Q group by 1) x "
        "join (select i as k, sum(v) as v from M group by 1) y on x.k = y.k",
    )
)
def dot(t: Tables) -> DataFrame:
    """Column sums of one matrix against row sums of another."""
    x = t.quantities().df.groupBy(F.col("j").alias("k")).agg(F.sum("v").alias("v"))
    y = t.months().df.groupBy(F.col("i").alias("k")).agg(F.sum("v").alias("v"))
    return algebra.dot(x, y)


@_query(with_matrices("E", "select i as id, sum(v * v) as v from E group by 1"))
def dot_arrays(t: Tables) -> DataFrame:
    vec = F.col("vec")
    return t.embeddings().df.select("id", arrays.dot(vec, vec).alias("v"))


@_query(with_matrices("Q", "select j as i, i as j, v from Q"))
def transpose(t: Tables) -> DataFrame:
    return layout.transpose(t.quantities()).df


@_query(
    "select l_partkey as i, cast(month(l_shipdate) - 1 as bigint) as j, sum(l_quantity) as v "
    "from lineitem group by 1, 2"
)
def row_merge_sum(t: Tables) -> DataFrame:
    partial = t.read("lineitem").select(
        F.col("l_partkey").alias("i"),
        (F.month("l_shipdate") - 1).cast("bigint").alias("j"),
        F.col("l_quantity").alias("v"),
    )
    return algebra.row_merge_sum(partial)


@_query(with_matrices("V", "select i, j, v from V"))
def row_merge_sum_exact(t: Tables) -> DataFrame:
    """Revenue by supplier and part: the double next to the true sum of each cell."""
    return algebra.row_merge_sum(t.revenue_lines(), exact=True)


@_query(
    with_matrices(
        "VM", f"select a.i, b.j, {exact_sql('(a.v * b.v)')} as v from V a join M b on a.j = b.i group by 1, 2"
    )
)
def matmul_opb_sparse_exact(t: Tables) -> DataFrame:
    return sparse_product.matmul_opb_sparse(t.revenues(), t.months(), exact=True).df


@_query(
    with_matrices(
        "V",
        f"select {exact_sql('(x.v * y.v)')} as v from "
        f"(select j as k, {exact_sql('v')} as v from V group by 1) x join "
        "(select p_partkey as k, p_retailprice as v from part) y on x.k = y.k",
    )
)
def dot_exact(t: Tables) -> DataFrame:
    """Revenue by part against the price of the part."""
    x = exact_sum(t.revenues().df.select(F.col("j").alias("k"), "v"), ["k"])
    y = t.read("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return algebra.dot(x, y, exact=True)


@_query(_product_sql("Q", "M"))
def matmul_opb_sparse_rows(t: Tables) -> DataFrame:
    """The product by records of whole rows."""
    return row_product.row_product(t.quantities(), t.months()).df


@_query(
    with_matrices(
        "QM",
        "select i, list(j order by j) as js, list(v order by j) as vs from "
        "(select a.i, b.j, sum(a.v * b.v) as v from Q a join M b on a.j = b.i group by 1, 2) group by 1",
    )
)
def row_records(t: Tables) -> DataFrame:
    """Partial rows of a product, merged record by record and listed again."""
    cells = row_product.merge_records(row_product.row_records(t.quantities(), t.months(), 1000))
    lists = F.sort_array(F.collect_list(F.struct("j", "v")))
    return cells.groupBy("i").agg(lists.alias("l")).select("i", F.col("l.j").alias("js"), F.col("l.v").alias("vs"))


@_query(
    with_matrices(
        "QM",
        "select cast(sum(p) as bigint) as products, count(*)::double as cells, count(distinct i) as rows from "
        "(select a.i, b.j, count(*) as p from Q a join M b on a.j = b.i group by 1, 2)",
    )
)
def product_size(t: Tables) -> DataFrame:
    """Rows of twelve columns, which a sketch counts exactly."""
    return estimate.product_size(t.quantities(), t.months())


@_query(
    with_matrices(
        "H",
        "select id, part, list(gap order by j) as gaps, list(v order by j) as vals, "
        "least(300, (select max(p_partkey) + 1 from part) - part * 300) - 1 - max(j - part * 300) as tail from "
        "(select i as id, j // 300 as part, j, v, "
        "j - coalesce(lag(j) over (partition by i, j // 300 order by j), j // 300 * 300 - 1) - 1 as gap from H) group by 1, 2",
    )
)
def row_runs(t: Tables) -> DataFrame:
    return layout.row_runs(t.high_quantities(), span=300)


@_query(
    with_matrices(
        "H",
        "select b.i, b.band, c.j, coalesce(H.v, 0) as v from (select distinct i, j // 300 as band from H) b join "
        "(select range as j from range((select max(p_partkey) + 1 from part))) c on c.j // 300 = b.band "
        "left join H on H.i = b.i and H.j = c.j",
    )
)
def densify_bands(t: Tables) -> DataFrame:
    bands = layout.densify_bands(t.high_quantities(), 300)
    spread = bands.select("i", "band", F.posexplode("vec").alias("pos", "v"))
    return spread.select("i", "band", (F.col("band") * 300 + F.col("pos")).alias("j"), "v")


# ------------------------------------------------------------------ pairings


@_query(
    with_matrices(
        "QM", "select a.i, a.j as k, b.j, a.v as a, b.v as b from Q a join M b on a.j = b.i"
    )
)
def k_join(t: Tables) -> DataFrame:
    return joins.k_join(t.quantities(), t.months())


@_query(
    with_matrices(
        "R", "select a.i, a.j as k, b.i as j, a.v as a, b.v as b from R a join R b on a.j = b.j"
    )
)
def k_join_hot(t: Tables) -> DataFrame:
    r = t.flags()
    return joins.k_join(r, r.T, light_products=1000)


@_query(
    with_matrices(
        "QM",
        "select a.i // 32 as bi, b.j // 5 as bj, a.i, b.j, count(*) as shared "
        "from Q a join M b on a.j = b.i group by all",
    )
)
def row_col_join(t: Tables) -> DataFrame:
    pairs = joins.row_col_join(t.quantities(), t.months(), edges=(32, 10_000_000, 5))
    parts = pairs.groupBy("task", "bi", "bj", "part", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("bi", "bj", "i", "j").agg(F.sum("n").alias("shared"))


@_query(
    with_matrices(
        "QM", "select a.i, b.j, a.j as k, a.v as a, b.v as b from Q a join M b on a.j = b.i"
    )
)
def sparse_intersect(t: Tables) -> DataFrame:
    return joins.sparse_intersect(t.quantities(), t.months())


def _checksum_sql(rows: int, cols: int) -> str:
    return f"sum(v * (i % {rows} + 1) * (j % {cols} + 1))"


_BLOCKS_OF_Q_AND_M = (
    f"ab as (select i // 16 as bi, j // 150 as bk, count(*) as n_a, {_checksum_sql(16, 150)} as sum_a from Q group by 1, 2), "
    f"bb as (select i // 150 as bk, j // 5 as bj, count(*) as n_b, {_checksum_sql(150, 5)} as sum_b from M group by 1, 2)"
)


@_query(
    with_matrices(
        "QM", "select bi, ab.bk, bj, n_a, n_b, sum_a, sum_b from ab join bb on ab.bk = bb.bk"
    ).replace(" select bi", f", {_BLOCKS_OF_Q_AND_M} select bi", 1)
)
def block_join_k(t: Tables) -> DataFrame:
    """Every pair of blocks with a checksum over the values and places of both."""
    pairs = blocks.block_join_k(t.quantities(), t.months(), 16, 150, 5, spread=False)
    return blocks.block_checksums(pairs).drop("unit")


@_query(
    with_matrices(
        "QM",
        "select bi, bj, count(*) as n_chunks, cast(sum(n_a) as bigint) as n_a, cast(sum(n_b) as bigint) as n_b, "
        "sum(sum_a * (ab.bk + 1)) as sum_a, sum(sum_b * (ab.bk + 1)) as sum_b from ab join bb on ab.bk = bb.bk group by 1, 2",
    ).replace(" select bi", f", {_BLOCKS_OF_Q_AND_M} select bi", 1)
)
def block_join_cross(t: Tables) -> DataFrame:
    """Output blocks, summed up where their chunks lie."""
    pairs = blocks.block_join_cross(t.quantities(), t.months(), 16, 150, 5, spread=False)
    sums = [F.sum(F.col(f"sum_{x}") * (F.col("bk") + 1)).alias(f"sum_{x}") for x in "ab"]
    counts = [F.count(F.lit(1)).alias("n_chunks"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")]
    return blocks.block_checksums(pairs).groupBy("bi", "bj").agg(*counts, *sums)


@_query(with_matrices("QM", "select Q.i // 16 as bi, bj, Q.j // 150 as bk, cast(Q.i % 16 as integer) as at, cast(Q.j % 150 as integer) as pos, Q.v from Q join (select distinct i // 150 as bk, j // 5 as bj from M) m on Q.j // 150 = m.bk"))
def block_join_cells(t: Tables) -> DataFrame:
    """The cells of A's block in every pair it is part of."""
    return blocks.block_cells(blocks.block_join_k(t.quantities(), t.months(), 16, 150, 5), "a")


# -------------------------------------------------------------- dense blocks


@_query(
    with_matrices(
        "E",
        "select a.i // 200 as bk, a.j as i, b.j, sum(a.v * b.v) as v "
        "from E a join E b on a.i = b.i group by 1, 2, 3",
    )
)
def block_multiply(t: Tables) -> DataFrame:
    e = t.embeddings()
    parts = dense_product.partial_blocks(e.T, e, 24, 200, 24)
    spread = parts.select("bk", "band", "i", F.posexplode("vec").alias("pos", "v"))
    j = F.col("band") * 24 + F.col("pos")
    return spread.select("bk", "i", j.alias("j"), "v").filter(F.col("j") < e.n_cols)


@_query(_product_sql("E", "E", a_t=True))
def block_sum(t: Tables) -> DataFrame:
    e = t.embeddings()
    summed = dense_product.block_sum(dense_product.partial_blocks(e.T, e, 24, 100, 32))
    spread = summed.select("band", "i", F.posexplode("vec").alias("pos", "v"))
    return spread.select("i", (F.col("band") * 32 + F.col("pos")).alias("j"), "v")


@_query(
    with_matrices(
        "E",
        "select i as id, string_agg(cast(cast(v as bigint) as varchar), ' ' order by j) as line "
        "from (select a.i, b.i as j, sum(a.v * b.v) as v from E a join E b on a.j = b.j "
        "group by 1, 2) group by 1",
    )
)
def band_regroup(t: Tables) -> DataFrame:
    e = t.embeddings()
    rows = layout.band_regroup(dense_product.matmul_ipb_dense(e, e.T, (200, 64, 120), whole_rows=True))
    numbers = F.transform("vec", lambda x: x.cast("bigint").cast("string"))
    return rows.df.select("id", F.array_join(numbers, " ").alias("line"))


# -------------------------------------------------------------------- layout

_NUMBER = "cast(cast(v as bigint) as varchar)"


def _lines_sql(matrix: str, line: str, along: str) -> str:
    return (
        f"select {line} as id, concat({line}, ' ', string_agg(concat({along}, ' ', {_NUMBER}, ' '), "
        f"'' order by {along})) as line from {matrix} group by {line}"
    )


def _whole(lists: DataFrame, n_along: int) -> DataFrame:
    """Whole lines, which are part 0 of their id."""
    return layout.whole_lines(lists, n_along).select("id", F.lit(0).cast("bigint").alias("part"), "line")


@_query(
    with_matrices(
        "Q",
        "select l.id, 0::bigint as part, l.line from (" + _lines_sql("Q", "i", "j") + ") l",
    )
)
def to_csr(t: Tables) -> DataFrame:
    """One line for every row, however many columns there are."""
    q = t.quantities()
    return _whole(layout.to_csr(q, empty_rows=False), q.n_cols)


@_query(
    with_matrices(
        "Q",
        "select l.id, 0::bigint as part, l.line from (" + _lines_sql("Q", "j", "i") + ") l",
    )
)
def to_csc(t: Tables) -> DataFrame:
    """One line for every column, however many rows there are."""
    q = t.quantities()
    return _whole(layout.to_csc(q), q.n_rows)


@_query(
    with_matrices(
        "Q",
        "select i as id, j // 500 as part, concat(i, ' ', string_agg(concat(j, ' ', "
        + _NUMBER
        + ", ' '), '' order by j)) as line from Q group by 1, 2",
    )
)
def to_csr_parts(t: Tables) -> DataFrame:
    """Long rows cut into several lines."""
    return layout.sparse_lines(layout.to_csr(t.quantities(), span=500, empty_rows=False))


@_query(
    with_matrices(
        "QM",
        "select 'A' as side, * from (" + _lines_sql("Q", "j", "i") + ") union all "
        "select 'B' as side, * from (" + _lines_sql("M", "i", "j") + ")",
    )
)
def to_sparse_pair(t: Tables) -> DataFrame:
    """Columns of A and rows of B, the pair that outer products read."""
    q, m = t.quantities(), t.months()
    a, b = layout.to_sparse_pair(q, m, "OPB")
    lines = [
        layout.whole_lines(side, n_along).select(F.lit(name).alias("side"), "id", "line")
        for name, side, n_along in (("A", a, q.n_rows), ("B", b, m.n_cols))
    ]
    return lines[0].unionByName(lines[1])


@_query(
    with_matrices(
        "M", "select i as id, row_number() over (partition by i order by j) - 1 as pos, j as idx, v from M"
    )
)
def collect_csr(t: Tables) -> DataFrame:
    rows = layout.to_csr(t.months(), empty_rows=False)
    spread = rows.select("id", F.posexplode("entries").alias("pos", "e"))
    return spread.select("id", F.col("pos").cast("bigint").alias("pos"), "e.idx", "e.v")


@_query(
    with_matrices(
        "Q", "select j as id, row_number() over (partition by j order by i) - 1 as pos, i as idx, v from Q"
    )
)
def collect_csc(t: Tables) -> DataFrame:
    columns = layout.to_csc(t.quantities())
    spread = columns.select("id", F.posexplode("entries").alias("pos", "e"))
    return spread.select("id", F.col("pos").cast("bigint").alias("pos"), "e.idx", "e.v")


_DENSE_ROWS_OF_M = (
    "select c.i, c.j, M.v from (select r.i, x.j from (select distinct i from M) r, "
    "(select range as j from range(12)) x) c left join M on M.i = c.i and M.j = c.j"
)


@_query(with_matrices("M", f"select i, j, coalesce(v, 0) as v from ({_DENSE_ROWS_OF_M})"))
def densify_rows(t: Tables) -> DataFrame:
    return layout.densify_rows(t.months()).cells().df


@_query(
    with_matrices(
        "M",
        "select i as id, concat(i, ' ', string_agg(coalesce(cast(v as varchar), '0'), ' ' order by j), "
        f"' ') as line from ({_DENSE_ROWS_OF_M}) group by i",
    )
)
def row_text(t: Tables) -> DataFrame:
    return layout.row_lines(t.months())


@_query(with_matrices("D", "select i, j, v from D where v <> 0"))
def drop_zeros(t: Tables) -> DataFrame:
    return layout.drop_zeros(t.discounts()).df


@_query(with_matrices("D", "select i, j, v from D"))
def drop_zeros_literal(t: Tables) -> DataFrame:
    """Only the token ``0`` is dropped; a cell that holds ``0.0`` stays."""
    d = t.discounts()
    path = scratch_path(t.spark, "drop_zeros_literal")
    sinks.write_row_text(d, path, compression="gzip", level="BEST_SPEED")  # the missing cells are most of the text
    return sources.read_dense_id(
        t.spark, path, (d.n_rows, d.n_cols), zero_test="literal"
    ).df


@_query(
    with_matrices(
        "Q", "select i // 30 as bi, j // 700 as bj, i % 30 as li, j % 700 as lj, v from Q"
    )
)
def block_coords(t: Tables) -> DataFrame:
    return layout.block_coords(t.quantities(), 30, 700)


@_query(with_matrices("Q", "select i % 18 as grp, i, j, v from Q"))
def cyclic_rows(t: Tables) -> DataFrame:
    return layout.cyclic_rows(t.quantities(), 18)


@_query(with_matrices("Q", "select i // 7 as band, i, j, v from Q"))
def row_bands(t: Tables) -> DataFrame:
    return layout.row_bands(t.quantities(), 7)


@_query(
    "select p_partkey as id, array_to_string(list_transform(range(1, 65), "
    "lambda x: case when x <= p_size then cast(x as varchar) else '0' end), ' ') as line from part"
)
def pad_rows(t: Tables) -> DataFrame:
    """Vectors of different lengths, filled with zeros to one width."""
    ragged = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda x: x.cast("double"))
    numbers = F.transform(
        arrays.pad_to(ragged, 64), lambda x: x.cast("bigint").cast("string")
    )
    return t.read("part").select(
        F.col("p_partkey").alias("id"), F.array_join(numbers, " ").alias("line")
    )


@_query(
    "select l_orderkey, concat(l_linenumber, ' ', l_partkey) as ks, "
    "concat(cast(l_quantity as bigint), ' ', l_suppkey) as vs from lineitem"
)
def split_pairs(t: Tables) -> DataFrame:
    line = F.concat_ws(
        " ", "l_linenumber", F.col("l_quantity").cast("bigint"), "l_partkey", "l_suppkey"
    )
    parts = text.tokens(line)
    return t.read("lineitem").select(
        "l_orderkey",
        F.array_join(arrays.pair_keys(parts), " ").alias("ks"),
        F.array_join(arrays.pair_values(parts), " ").alias("vs"),
    )


@_query(with_matrices("E", "select i as id, j // 24 as r, j % 24 as pos, v from E"))
def slice_rows(t: Tables) -> DataFrame:
    """A vector seen as a row-major block of width 24, cut into rows."""
    block_rows = F.posexplode(arrays.rows_of_block(F.col("vec"), 24)).alias("r", "row")
    spread = t.embeddings().df.select("id", block_rows).select(
        "id", "r", F.posexplode("row").alias("pos", "v")
    )
    return spread.withColumns({c: F.col(c).cast("bigint") for c in ("r", "pos")})


@_query(
    with_matrices(
        "E",
        "select 'middle' as piece, i as id, j - 10 as pos, v from E where j between 10 and 29 "
        "union all select 'tail', i, j - 48, v from E where j >= 48",
    )
)
def slice_vector(t: Tables) -> DataFrame:
    vec = F.col("vec")
    pieces = F.array(
        F.struct(F.lit("middle").alias("piece"), arrays.take(vec, 10, 20).alias("x")),
        F.struct(F.lit("tail").alias("piece"), arrays.take(vec, 48).alias("x")),
    )
    cut = t.embeddings().df.select("id", F.inline(pieces))
    spread = cut.select("piece", "id", F.posexplode("x").alias("pos", "v"))
    return spread.withColumn("pos", F.col("pos").cast("bigint"))


# ------------------------------------------------------------ text in and out


def _round_trip(t: Tables, m, label: str, write, read, **options) -> DataFrame:
    path = scratch_path(t.spark, label)
    write(m, path, **options)
    return read(t.spark, path, (m.n_rows, m.n_cols)).cells().df


@_query(with_matrices("E", "select i, j, v from E"))
def dense_text_round_trip(t: Tables) -> DataFrame:
    return _round_trip(
        t, t.embeddings(), "dense_text", sinks.write_dense_text, sources.read_dense
    )


@_query(
    with_matrices("M", f"select i, j, coalesce(v, 0) as v from ({_DENSE_ROWS_OF_M})")
)
def dense_id_round_trip(t: Tables) -> DataFrame:
    return _round_trip(t, t.months(), "dense_id", sinks.write_row_text, sources.read_dense_id)


@_query(with_matrices("Q", "select i, j, v from Q"))
def csr_round_trip(t: Tables) -> DataFrame:
    return _round_trip(t, t.quantities(), "csr", sinks.write_csr, sources.read_csr)


@_query(with_matrices("Q", "select i, j, v from Q"))
def csc_round_trip(t: Tables) -> DataFrame:
    return _round_trip(t, t.quantities(), "csc", sinks.write_csc, sources.read_csc)


@_query(with_matrices("Q", "select i, j, v from Q"))
def compressed_round_trip(t: Tables) -> DataFrame:
    return _round_trip(
        t, t.quantities(), "gzip", sinks.write_csr, sources.read_csr, compression="gzip"
    )


@_query(with_matrices("Q", "select i, j, v from Q"))
def overwrite(t: Tables) -> DataFrame:
    """A second write to the same folder replaces the first."""
    q = t.quantities()
    path = scratch_path(t.spark, "overwrite")
    sinks.write_csc(t.discounts(), path)
    sinks.write_csc(q, path)
    return sources.read_csc(t.spark, path, (q.n_rows, q.n_cols)).df


@_query(
    with_matrices(
        "QM",
        "select 'A' as side, i, j, v from Q union all select 'B', i, j, v from M",
    )
)
def pair_inputs(t: Tables) -> DataFrame:
    q, m = t.quantities(), t.months()
    root = scratch_path(t.spark, "pair_inputs")
    sinks.write_csr(q, f"{root}/A")
    sinks.write_csr(m, f"{root}/B")
    a, b = sources.read_pair(
        t.spark, f"{root}/A", f"{root}/B", (q.n_rows, q.n_cols), (m.n_rows, m.n_cols),
        sources.read_csr,
    )
    return a.df.select(F.lit("A").alias("side"), "*").unionByName(
        b.df.select(F.lit("B").alias("side"), "*")
    )


# DuckDB has the same doubles, so the same exact steps can be written in SQL.
_CEIL3_SQL = """
with x as (select l_orderkey, l_linenumber,
             l_extendedprice * (1::double - l_discount) - 30000::double as v from lineitem),
     y as (select *, cast(trunc(v) as bigint) as w, v - trunc(v) as f from x),
     z as (select *, f * 1000::double as p, f * 134217729::double as s from y),
     h as (select *, s - (s - f) as hi from z),
     e as (select *, (hi * 1000::double - p) + (f - hi) * 1000::double as err from h),
     k as (select *, cast(ceil(p) as bigint)
                     + case when ceil(p) = p and err > 0 then 1 else 0 end as q from e),
     u as (select *, abs(w + case when q = 1000 then 1 else 0 end) as units,
                  abs(q) % 1000 as thousandths from k)
select l_orderkey, l_linenumber,
       concat(case when v < 0 and (units > 0 or thousandths > 0) then '-' else '' end,
              units, '.', lpad(cast(thousandths as varchar), 3, '0')) as line
from u
"""


@_query(_CEIL3_SQL)
def ceil3_format(t: Tables) -> DataFrame:
    v = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) - F.lit(30000.0)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", text.ceil3(v).alias("line"))


@_query(
    with_matrices(
        "Q",
        "select count(*) as n_lines, max(length(line)) as max_width, "
        "cast(sum(length(line)) as bigint) as total_width from (" + _lines_sql("Q", "i", "j") + ")",
    )
)
def line_profile(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "line_profile")
    sinks.write_csr(t.quantities(), path)
    return sources.line_profile(t.spark, path)


@_query(
    "with g as (select p_partkey as i, j, (p_partkey % 1000003) * 7919 + (j % 1000003) * 104729 + 42 "
    "as x from part, (select range as j from range(12))), "
    "h as (select i, j, ((x % 1000003) * (x % 1000003)) % 1000003 as h from g) "
    "select i, j, cast(1 + (h // 100) % 9 as double) as v from h where h % 100 >= 30"
)
def matrix_generate(t: Tables) -> DataFrame:
    """A random matrix with one row per part."""
    ids = t.read("part").select(F.col("p_partkey").alias("i"))
    return sources.generate_on(ids, t.n_parts(), 12, sparsity=30, seed=42).df


# ------------------------------------------------------- counts and profiles


@_query(with_matrices("Q", "select count(*) as nnz from Q"))
def nnz(t: Tables) -> DataFrame:
    return profile.nnz(t.quantities())


@_query(
    with_matrices(
        "Q",
        "select s.n_rows, p.n_cols, n.nnz, "
        "cast(n.nnz as double) / (cast(s.n_rows as double) * p.n_cols) as density, "
        "r.used_rows, c.used_cols, r.max_row_nnz, c.max_col_nnz, r.avg_row_nnz, c.avg_col_nnz from "
        "(select max(s_suppkey) + 1 as n_rows from supplier) s, "
        "(select max(p_partkey) + 1 as n_cols from part) p, "
        "(select count(*) as nnz from Q) n, "
        "(select count(*) as used_rows, max(x) as max_row_nnz, "
        "cast(sum(x) as double) / count(*) as avg_row_nnz from (select count(*) as x from Q group by i)) r, "
        "(select count(*) as used_cols, max(x) as max_col_nnz, "
        "cast(sum(x) as double) / count(*) as avg_col_nnz from (select count(*) as x from Q group by j)) c",
    )
)
def matrix_profile(t: Tables) -> DataFrame:
    return profile.matrix_profile(t.quantities())


@_query(
    with_matrices(
        "QM",
        "select bi, ab.bk, bj, n_a, n_b, "
        "r * k + k * c + r * c as map_cells, r * c * strips as reduce_cells, "
        "(r * k + k * c + r * c) * 10 > 40000 or r * c * strips * 10 > 40000 as over_budget "
        "from ab join bb on ab.bk = bb.bk, "
        "(select max(s_suppkey) + 1 as n from supplier), (select max(p_partkey) + 1 as m from part), "
        "lateral (select least(16, n - bi * 16) as r, least(150, m - ab.bk * 150) as k, "
        "least(5, 12 - bj * 5) as c, (m + 149) // 150 as strips)",
    ).replace(" select bi", f", {_BLOCKS_OF_Q_AND_M} select bi", 1)
)
def block_load(t: Tables) -> DataFrame:
    return profile.block_load(t.quantities(), t.months(), 16, 150, 5, budget_bytes=40_000)


# -------------------------------------------------------------------- orders


@_query(
    with_matrices(
        "Q",
        "select row_number() over (order by id) - 1 as line_no, line from ("
        + _lines_sql("Q", "j", "i")
        + ")",
    )
)
def sort_by_key(t: Tables) -> DataFrame:
    """Column lines in the order of their ids, over all files."""
    path = scratch_path(t.spark, "sort_by_key")
    sinks.write_csc(t.quantities(), path)
    return sources.numbered_lines(t.spark, path)


@_query(
    with_matrices(
        "Q",
        "select i, sum(v) as total, row_number() over (order by i) - 1 as pos from Q group by i",
    )
)
def sort_rows(t: Tables) -> DataFrame:
    totals = t.quantities().df.groupBy("i").agg(F.sum("v").alias("total"))
    return ordering.number_in_order(ordering.sort_rows(totals), "i", band=40)


@_query(
    with_matrices(
        "Q",
        "select br, bc, n, row_number() over (order by br, bc) - 1 as pos from "
        "(select i // 9 as br, j // 130 as bc, count(*) as n from Q group by 1, 2)",
    )
)
def sort_blocks(t: Tables) -> DataFrame:
    """Blocks in lexicographic order of their coordinates."""
    q = t.quantities()
    blocks = joins.block_sizes(q, 9, 130)
    per_row = -(-q.n_cols // 130)
    keyed = blocks.withColumn("key", F.col("br") * per_row + F.col("bc"))
    return ordering.number_in_order(keyed, "key", band=50).drop("key")


@_query(
    "select cast(vec_id as varchar) as line, row_number() over (order by "
    "list_transform(embedding, lambda x: floor(cast(x as double) * 1000)), vec_id) - 1 "
    "as line_no from embeddings"
)
def sort_vectors(t: Tables) -> DataFrame:
    """Vectors in lexicographic order; written sorted, numbered by position."""
    path = scratch_path(t.spark, "sort_vectors")
    ordered = ordering.sort_by_key(t.embeddings().df, "vec", "id")
    ordered.select(F.col("id").cast("string")).write.text(path)
    return sources.numbered_lines(t.spark, path)


# ----------------------------------------------------------- scalar functions


@_query(
    "with f as (select vec_id as id, list_transform(embedding, lambda x: floor(cast(x as double) * 1000)) "
    "as v from embeddings) select id, "
    "coalesce(nullif(list_position(v[4:], v[33]), 0) + 2, 64) as found, "
    "coalesce(nullif(list_position(v, 1e9::double), 0) - 1, 64) as missing, "
    "list_sum(list_transform(v, lambda x, i: x * 3 * i)) as tripled, "
    "list_sum(list_transform(v, lambda x, i: case when i = 8 then 5 else x end * i)) as replaced, "
    "list_sum(list_transform(v, lambda x, i: case when i <= 32 then 2 * x else x end * i)) as added, "
    "len(v) + 3 as appended from f"
)
def vector_functions(t: Tables) -> DataFrame:
    vec = F.col("vec")

    def total(x):
        """A sum in which every place weighs differently, so that elements cannot change places."""
        weighed = F.transform(x, lambda y, p: y * (p + 1))
        return F.aggregate(weighed, F.lit(0.0), lambda s, y: s + y)

    return t.embeddings().df.select(
        "id",
        arrays.find(vec, F.get(vec, 32), start=3).alias("found"),
        arrays.find(vec, F.lit(1e9)).alias("missing"),
        total(arrays.scale(vec, F.lit(3.0))).alias("tripled"),
        total(arrays.set_at(vec, 7, F.lit(5.0))).alias("replaced"),
        total(arrays.add(vec, arrays.take(vec, 0, 32))).alias("added"),
        F.size(arrays.append(vec, F.lit(0.0), 3)).cast("bigint").alias("appended"),
    )


def _month_maps(t: Tables) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    return t.months().df.groupBy("i").agg(entries.alias("vec"))


@_query(
    with_matrices(
        "M",
        "select i, count(*) as n, coalesce(max(case when j = 3 then v end), 0) as at3 from M group by i",
    )
)
def map_lookup(t: Tables) -> DataFrame:
    vec = F.col("vec")
    at3 = maps.lookup(vec, F.lit(3).cast("bigint"))
    return _month_maps(t).select("i", maps.length(vec).alias("n"), at3.alias("at3"))


@_query(
    with_matrices(
        "M",
        "select i, j, sum(v) as v from (select i, j, v * 2 as v from M where j <> 5 union all "
        "select distinct i, 5, 100::double from M union all select i, j, v from M) group by 1, 2",
    )
)
def map_merge(t: Tables) -> DataFrame:
    """Twice each sparse vector with entry 5 replaced, merged with the vector itself."""
    vec = F.col("vec")
    five = F.lit(5).cast("bigint")
    changed = maps.put(maps.scale(vec, F.lit(2.0)), five, F.lit(100.0))
    merged = _month_maps(t).select("i", F.explode(maps.add(changed, vec)).alias("j", "v"))
    return merged
