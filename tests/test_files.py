"""Files of equal length, in order, whatever the ids and the lengths of lines."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmat import sinks, sources
from gridmat.operators.ordering import file_cuts, sort_into_files
from gridmat.matrix import CellMatrix
from helpers import array_of, cells_of


def _files(path):
    """First ids, last ids and bytes of the part files in name order."""
    out = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name) as f:
            ids = [int(line.split(" ", 1)[0]) for line in f]
        if ids:
            assert ids == sorted(ids)
            out.append((ids[0], ids[-1], os.path.getsize(name)))
    return out


def _hot(spark, n_ids=100, cells=100_000, of=1_000_000):
    """Ids 0..99 of a million have all the cells."""
    df = spark.range(cells).select((F.col("id") % n_ids).alias("i"), F.call_function("div", F.col("id"), F.lit(n_ids)).alias("j"), F.lit(1.5).alias("v"))
    return CellMatrix(df, of, of)


def test_crowded_ids_are_spread_over_files(spark, tmp_path):
    m = _hot(spark)
    sinks.write_csc(m.T, str(tmp_path / "csc"), files=8)
    files = _files(tmp_path / "csc")
    sizes = [size for _, _, size in files]
    assert len(files) == 8 and max(sizes) <= 2 * sum(sizes) / 8
    assert all(a[1] < b[0] for a, b in zip(files, files[1:]))


def test_long_and_short_lines(spark, tmp_path):
    """One half of the ids has one cell, the other half 200: files are equal in bytes, not in lines."""
    a = np.zeros((400, 300))
    a[:, 0] = 1.0
    a[200:, :200] = 1.0
    sinks.write_csr(cells_of(spark, a), str(tmp_path / "csr"), files=5)
    files = _files(tmp_path / "csr")
    sizes = [size for _, _, size in files]
    assert len(files) == 5 and max(sizes) <= 2 * sum(sizes) / 5
    assert files[0][1] >= 200
    assert np.array_equal(array_of(sources.read_csr(spark, str(tmp_path / "csr"), a.shape)), a)


def test_files_follow_the_data(spark, tmp_path):
    """A few lines take one file; a number that is asked for is kept to."""
    a = np.eye(30)
    sinks.write_csr(cells_of(spark, a), str(tmp_path / "few"))
    sinks.write_csr(cells_of(spark, a), str(tmp_path / "asked"), files=3)
    assert len(_files(tmp_path / "few")) == 1
    assert 1 <= len(_files(tmp_path / "asked")) <= 3
    sinks.write_row_text(_hot(spark, 1000, 200_000, 5000), str(tmp_path / "many"), all_rows=False)
    assert len(_files(tmp_path / "many")) == 8


@pytest.mark.parametrize("files", [1, 2, 7, 64])
def test_every_row_is_in_one_file_and_files_are_in_order(spark, files):
    df = spark.range(5000).select((F.col("id") * F.col("id") % 4001).alias("id"), F.lit("x" * 40).alias("line"))
    out = sort_into_files(df, "id", 5000, files=files, weight=F.octet_length("line")).withColumn("p", F.spark_partition_id())
    runs = out.groupBy("p").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).orderBy("p").collect()
    assert sum(r.n for r in runs) == 5000 and len(runs) <= files
    assert all(a.hi < b.lo for a, b in zip(runs, runs[1:]))


def test_empty_input_and_one_giant_line(spark, tmp_path):
    sinks.write_csc(cells_of(spark, np.zeros((3, 3))), str(tmp_path / "none"))
    assert _files(tmp_path / "none") == []
    df = spark.createDataFrame([(1, "a"), (2, "b" * 3_000_000), (3, "c")], "id bigint, line string")
    cuts = file_cuts(df, "id", F.octet_length("line"), 4).first()
    assert cuts.total == 3_000_002 and set(cuts.cuts) == {2}


def test_the_sketch_reads_the_shuffle_of_the_rows(spark):
    from gridmat.operators import layout
    from gridmat.plans.tables import Tables

    lists = layout.to_csc(Tables(spark, "/root/testdata/sf0.001").quantities())
    df = sort_into_files(layout.whole_lines(lists, 10), "id", 200, weight=F.size("entries"), weigh=lists)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ReusedExchange" in plan


@pytest.mark.parametrize("method", ["OPB", "IPB"])
def test_both_forms_are_one_write(spark, tmp_path, method):
    rng = np.random.default_rng(2)
    a, b = ((rng.random((40, 30)) < 0.2) * rng.integers(1, 9, (40, 30)).astype(float) for _ in range(2))
    b = b.T
    A, B = cells_of(spark, a), cells_of(spark, b)
    paths = sinks.write_sparse_pair(A, B, str(tmp_path / "pair"), method, files=4)
    read = {"OPB": (sources.read_csc, sources.read_csr), "IPB": (sources.read_csr, sources.read_csc)}[method]
    singly = {"OPB": (sinks.write_csc, sinks.write_csr), "IPB": (sinks.write_csr, sinks.write_csc)}[method]
    for m, array, path, reader, write in zip((A, B), (a, b), paths, read, singly):
        assert np.array_equal(array_of(reader(spark, path, array.shape)), array)
        write(m, str(tmp_path / write.__name__), files=4)
        text = lambda p: "".join(open(x).read() for x in sorted(glob.glob(f"{p}/part-*")))
        assert text(path) == text(tmp_path / write.__name__)
    assert os.listdir(tmp_path / "pair").count("_SUCCESS") == 1


def test_an_operand_without_cells_can_be_read_back(spark, tmp_path):
    none, some = cells_of(spark, np.zeros((3, 4))), cells_of(spark, np.ones((4, 2)))
    csc, csr = sinks.write_sparse_pair(none, some, str(tmp_path / "pair"), "OPB", compression="gzip")
    assert sources.read_csc(spark, csc, (3, 4)).df.count() == 0
    assert sources.read_csr(spark, csr, (4, 2)).df.count() == 8


def test_a_pair_is_one_commit(spark, tmp_path):
    """One write for both forms: one mark of success above the two folders, none inside them."""
    A = cells_of(spark, np.eye(6))
    sinks.write_sparse_pair(A, A, str(tmp_path / "one"), "OPB")
    assert {p.name for p in (tmp_path / "one").iterdir() if not p.name.startswith(".")} == {"_SUCCESS", "form=CSC", "form=CSR"}
    assert not any((tmp_path / "one" / f / "_SUCCESS").exists() for f in ("form=CSC", "form=CSR"))
