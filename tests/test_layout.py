"""Layouts, vector and map functions, profiles, orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmat import sources
from gridmat.functions import arrays, coords, maps
from gridmat.operators import algebra, joins, layout, ordering, profile
from helpers import array_of, cells_of, random_pair, vectors_of


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


# ----------------------------------------------------------------- functions


def test_array_functions(spark):
    v, w = F.col("v"), F.col("w")
    row = one(
        spark,
        "v array<double>, w array<double>",
        ([1.0, 2.0, 3.0, 2.0, 5.0], [10.0, 20.0]),
        arrays.pad_to(w, 4),
        arrays.pad_to(v, 2),
        arrays.append(w, F.lit(7.0), 2),
        arrays.take(v, 1, 2),
        arrays.take(v, 3),
        arrays.take(v, 5),
        arrays.rows_of_block(v, 2),
        arrays.find(v, F.lit(2.0)),
        arrays.find(v, F.lit(2.0), 2),
        arrays.find(v, F.lit(9.0)),
        arrays.set_at(v, 0, F.lit(-1.0)),
        arrays.add(v, w),
        arrays.scale(w, F.lit(0.5)),
        arrays.dot(v, w),
    )
    assert [list(x) if isinstance(x, (list, tuple)) else x for x in row] == [
        [10, 20, 0, 0],
        [1, 2, 3, 2, 5],
        [10, 20, 7, 7],
        [2, 3],
        [2, 5],
        [],
        [[1, 2], [3, 2], [5]],
        1,
        3,
        5,
        [-1, 2, 3, 2, 5],
        [11, 22, 3, 2, 5],
        [5, 10],
        50,
    ]


def test_block_of_nothing_has_no_rows(spark):
    row = one(spark, "v array<double>", ([],), arrays.rows_of_block(F.col("v"), 3))
    assert row[0] == []


def test_pairs(spark):
    row = one(
        spark, "t array<string>", (["0", "5.6", "1", "4.5"],),
        arrays.pair_keys(F.col("t")), arrays.pair_values(F.col("t")),
    )
    assert list(row) == [["0", "1"], ["5.6", "4.5"]]


def test_map_functions(spark):
    m, two = F.col("m"), F.lit(2).cast("bigint")
    row = one(
        spark,
        "m map<bigint,double>, x map<bigint,double>",
        ({1: 1.5, 2: 2.5}, {2: 10.0, 4: 4.0}),
        maps.lookup(m, two),
        maps.lookup(m, F.lit(9).cast("bigint")),
        maps.put(m, two, F.lit(7.0)),
        maps.put(m, F.lit(3).cast("bigint"), F.lit(8.0)),
        maps.add(m, F.col("x")),
        maps.scale(m, F.lit(2.0)),
        maps.length(m),
    )
    assert list(row) == [
        2.5, 0.0, {1: 1.5, 2: 7.0}, {1: 1.5, 2: 2.5, 3: 8.0},
        {1: 1.5, 2: 12.5, 4: 4.0}, {1: 3.0, 2: 5.0}, 2,
    ]


@pytest.mark.parametrize("n, m, units, longest", [
    (1, 1, 8, 100), (1000, 12, 16, 1024), (12, 1000, 16, 1024), (5, 5, 400, 10),
    (10**9, 10**9, 2000, 1000), (64, 64, 16, 1000), (10**9, 3, 16, 1000),
])
def test_square_edges(n, m, units, longest):
    r, c = coords.square_edges(n, m, units, longest)
    assert 1 <= r <= min(n, longest) and 1 <= c <= min(m, longest)
    assert coords.n_blocks(n, r) * coords.n_blocks(m, c) >= min(units, n * m) / 2


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 25])
def test_every_number(spark, n):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    got = coords.with_each(df, "k", n, run=6)
    assert got.dtypes == [("x", "string"), ("k", "bigint")]
    assert {tuple(r) for r in got.collect()} == {(x, k) for x in "ab" for k in range(n)}
    assert got.count() == 2 * n


@pytest.mark.parametrize("n, k, m", [
    (64, 2000, 64), (2000, 64, 2000), (1, 1, 1), (10**9, 10**9, 10**9), (10**9, 5, 7), (3, 10**9, 3),
])
def test_cube_edges(n, k, m):
    r, d, c = coords.cube_edges(n, k, m, 16, 2000, 4000)
    assert 1 <= r <= min(n, 2000) and 1 <= d <= min(k, 4000) and 1 <= c <= min(m, 2000)
    units = coords.n_blocks(n, r) * coords.n_blocks(k, d) * coords.n_blocks(m, c)
    assert units >= min(8, n * k * m)


# -------------------------------------------------------------------- layouts


def test_forms_agree(spark):
    a, _ = random_pair(1)
    for m in (cells_of(spark, a), vectors_of(spark, a), vectors_of(spark, a, "col")):
        assert np.array_equal(array_of(m), a)
        assert np.array_equal(array_of(m.T), a.T)
        dense = layout.densify_rows(m, all_rows=True)
        got = {r["id"]: r["vec"] for r in dense.df.collect()}
        assert got == {i: row.tolist() for i, row in enumerate(a)}


def test_densify_without_empty_rows(spark):
    m = cells_of(spark, np.array([[0, 0.0], [3, 0.0]]))
    assert [tuple(r) for r in layout.densify_rows(m).df.collect()] == [(1, [3.0, 0.0])]


def test_coordinates(spark):
    m = cells_of(spark, np.ones((5, 7)))
    for r in layout.block_coords(m, 2, 3).collect():
        assert r["li"] < 2 and r["lj"] < 3
    placed = {(r["bi"] * 2 + r["li"], r["bj"] * 3 + r["lj"]) for r in layout.block_coords(m, 2, 3).collect()}
    assert placed == {(i, j) for i in range(5) for j in range(7)}
    assert {(r["grp"], r["i"]) for r in layout.cyclic_rows(m, 3).collect()} == {(i % 3, i) for i in range(5)}
    assert {(r["band"], r["i"]) for r in layout.row_bands(m, 3).collect()} == {(i // 3, i) for i in range(5)}


def test_drop_zeros(spark):
    a = np.array([[0.0, 1.0], [-0.0, 2.0]])
    m = cells_of(spark, a, keep=np.ones_like(a, dtype=bool))
    assert m.df.count() == 4
    assert {tuple(r) for r in layout.drop_zeros(m).df.collect()} == {(0, 1, 1.0), (1, 1, 2.0)}


@pytest.mark.parametrize("method, orders", [("OPB", "ca"), ("IPB", "ac"), ("naive", "ac")])
def test_sparse_pair(spark, method, orders):
    a, b = random_pair(2)
    left, right = layout.to_sparse_pair(cells_of(spark, a), cells_of(spark, b), method)
    by = {"OPB": ("col", "row")}.get(method, ("row", "col"))
    assert np.array_equal(array_of(layout.from_entries(left, a.shape, by[0])), a)
    assert np.array_equal(array_of(layout.from_entries(right, b.shape, by[1])), b)
    with pytest.raises(ValueError):
        layout.to_sparse_pair(None, None, "other")


def test_from_table_adds_shared_cells(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, 1.0)], "a int, b int, c double")
    m = sources.from_table(df, "a", "b", "c", (2, 2))
    assert array_of(m).tolist() == [[0, 5], [1, 0]]
    assert sources.shape_of(m.df) == (2, 2)
    assert sources.shape_of(m.df.filter("i < 0")) == (0, 0)


def test_generated_density(spark):
    for sparsity in (0, 50, 90, 100):
        m = sources.matrix_generate(spark, 200, 100, sparsity)
        kept = m.df.count() / 20_000
        assert abs(kept - (100 - sparsity) / 100) < 0.05
        assert m.df.filter("v < 1 or v > 9 or v <> floor(v)").count() == 0
    with pytest.raises(ValueError):
        sources.matrix_generate(spark, 2, 2, 101)


# ------------------------------------------------------------------- algebra


def test_scale_keeps_its_input(spark):
    """Scaling the same row again and again starts from the same values."""
    m = cells_of(spark, np.array([[1.0, 2.0]]))
    assert array_of(algebra.scale(m, 3)).tolist() == [[3, 6]]
    assert array_of(algebra.scale(m, 3)).tolist() == [[3, 6]]


def test_vectors_of_a_matrix(spark):
    a, b = random_pair(6)
    A, B = cells_of(spark, a), cells_of(spark, b)
    got = algebra.dot(algebra.row_vector(A, 3), algebra.col_vector(B, 4)).first()["v"]
    assert got == a[3] @ b[:, 4]
    empty = algebra.dot(algebra.col_vector(A, 2), algebra.col_vector(A, 0)).first()["v"]
    assert empty == 0.0


def test_rank_one_terms(spark):
    a, b = random_pair(7)
    terms = algebra.outer_product(cells_of(spark, a), cells_of(spark, b))
    for k in range(5):
        want = {
            (i, j, a[i, k] * b[k, j]) for i in range(7) for j in range(9) if a[i, k] and b[k, j]
        }
        assert {(r["i"], r["j"], r["v"]) for r in terms.filter(F.col("k") == k).collect()} == want


def test_intersection(spark):
    a, b = random_pair(10)
    got = {tuple(r) for r in joins.sparse_intersect(cells_of(spark, a), cells_of(spark, b)).collect()}
    assert got == {
        (i, j, k, a[i, k], b[k, j])
        for i in range(7) for j in range(9) for k in range(5) if a[i, k] and b[k, j]
    }


# ------------------------------------------------------------------ profiles


def test_profile(spark):
    a, _ = random_pair(12, n=20, k=15)
    row = profile.matrix_profile(cells_of(spark, a)).first()
    nz = a != 0
    assert row["nnz"] == nz.sum() and row["density"] == nz.sum() / nz.size
    assert row["max_row_nnz"] == nz.sum(1).max() and row["max_col_nnz"] == nz.sum(0).max()
    assert row["used_cols"] == (nz.sum(0) > 0).sum()
    assert profile.nnz(cells_of(spark, a)).first()[0] == nz.sum()


def test_profile_of_nothing(spark):
    row = profile.matrix_profile(cells_of(spark, np.zeros((3, 4)))).first()
    assert (row["nnz"], row["density"], row["max_row_nnz"]) == (0, 0.0, None)


def test_count_as_a_by_product(spark):
    a, _ = random_pair(13)
    df, seen = profile.observe_nnz(cells_of(spark, a))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["nnz"] == (a != 0).sum()


def test_block_load(spark):
    a, b = np.ones((5, 7)), np.ones((7, 3))
    units = profile.block_load(cells_of(spark, a), cells_of(spark, b), 2, 4, 2, budget_bytes=160)
    rows = {(r["bi"], r["bk"], r["bj"]): r for r in units.collect()}
    assert len(rows) == 3 * 2 * 2
    full, ragged = rows[0, 0, 0], rows[2, 1, 1]
    assert (full["map_cells"], full["reduce_cells"], full["over_budget"]) == (20, 8, True)
    assert (ragged["map_cells"], ragged["reduce_cells"], ragged["over_budget"]) == (7, 2, False)
    assert (ragged["n_a"], ragged["n_b"]) == (3, 3)


# -------------------------------------------------------------------- orders


def test_positions(spark):
    keys = [5, 900, 17, 3, 250, 251, 0, 10**12]
    df = spark.createDataFrame([(k,) for k in keys], "key bigint")
    got = {r["key"]: r["pos"] for r in ordering.number_in_order(df, "key", band=100).collect()}
    assert got == {k: p for p, k in enumerate(sorted(keys))}


def test_sorted_inside_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("i"))
    tagged = ordering.sort_rows(df).withColumn("p", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id()
    )
    by_part = {}
    for r in tagged.orderBy("at").collect():
        by_part.setdefault(r["p"], []).append(r["i"])
    assert len(by_part) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert all(v == sorted(v) for v in by_part.values())


def test_block_order(spark):
    df = spark.createDataFrame([(1, 0), (0, 2), (0, 10), (10, 1), (1, 1)], "bi bigint, bj bigint")
    assert [tuple(r) for r in ordering.sort_blocks(df).collect()] == [
        (0, 2), (0, 10), (1, 0), (1, 1), (10, 1),
    ]
