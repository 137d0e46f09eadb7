"""Text in and out."""

import math
import os
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridmat import matmul, sinks, sources
from gridmat.functions.text import ceil3, dense_line, tokens
from gridmat.matrix import CellMatrix, VectorMatrix
from gridmat.operators import layout
from gridmat.plans.scratch import scratch_path
from helpers import array_of, cells_of, random_pair, vectors_of

A = np.array([[1, 0, 2], [0, 0, 3.0]])
B = np.array([[4, 5], [6, 7], [0, 8.0]])


def lines_in(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name)) as f:
                out += f.read().splitlines()
    return out


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


# ------------------------------------------------------------------- formats


def test_golden_sparse_lines(spark, tmp_path):
    sinks.write_csr(cells_of(spark, A), str(tmp_path / "a_csr"))
    sinks.write_csc(cells_of(spark, A), str(tmp_path / "a_csc"))
    sinks.write_csr(cells_of(spark, B), str(tmp_path / "b_csr"))
    assert lines_in(tmp_path / "a_csr") == ["0 0 1 2 2 ", "1 2 3 "]
    assert lines_in(tmp_path / "a_csc") == ["0 0 1 ", "2 0 2 1 3 "]
    assert lines_in(tmp_path / "b_csr") == ["0 0 4 1 5 ", "1 0 6 1 7 ", "2 1 8 "]


@pytest.mark.parametrize("method", ["naive", "IPB", "OPB"])
def test_golden_results(spark, tmp_path, method):
    a, b = cells_of(spark, A), cells_of(spark, B)
    sinks.write_dense_text(matmul(a, b, method, sparsity=0), str(tmp_path / "d"))
    sinks.write_row_text(matmul(a, b, method, sparsity=40), str(tmp_path / "s"))
    assert lines_in(tmp_path / "d") == ["4.000 21.000 ", "0.000 24.000 "]
    assert lines_in(tmp_path / "s") == ["0 4.0 21.0 ", "1 0 24.0 "]


def test_empty_row_keeps_its_csr_line(spark, tmp_path):
    m = cells_of(spark, np.array([[0, 0.0], [0, 5.0], [0, 0]]))
    sinks.write_csr(m, str(tmp_path / "r"))
    sinks.write_csc(m, str(tmp_path / "c"))
    assert lines_in(tmp_path / "r") == ["0 ", "1 1 5 ", "2 "]
    assert lines_in(tmp_path / "c") == ["1 1 5 "]


CEILINGS = {
    0.1: "0.101", 1.1: "1.101", 0.3: "0.300", 1.2345: "1.235", -1.2345: "-1.234",
    -0.0004: "0.000", 2.5: "2.500", 0.0: "0.000", -0.0: "0.000", -1.0: "-1.000",
    0.9999: "1.000", -0.9999: "-0.999", 5e-324: "0.001", -5e-324: "0.000",
    1e15: "1000000000000000.000", 123456789012.3456: "123456789012.346",
    float(2**62): f"{2**62}.000", float(2**63): f"{2**63}.000",
    -float(2**64): f"-{2**64}.000",
    1e20: "100000000000000000000.000", -1.2345e25: f"{int(-1.2345e25)}.000",
    float(2**114): f"{2**114}.000", 4503599627370496.0: "4503599627370496.000",
    4503599627370495.5: "4503599627370495.500", -4503599627370495.5: "-4503599627370495.500",
    2251799813685247.75: "2251799813685247.750", 9007199254740993.0: "9007199254740992.000",
    -9007199254740991.0: "-9007199254740991.000",
}


def texts(spark, values, **options):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double")
    return [r[0] for r in df.orderBy("k").select(ceil3(F.col("v"), **options)).collect()]


def test_ceiling_table(spark):
    assert texts(spark, CEILINGS) == list(CEILINGS.values())


def test_ceiling_is_exact(spark):
    rng = np.random.default_rng(1)
    values = [x for spread in (1, 1e9, 1e22) for x in rng.normal(0, spread, 1000)]
    values += list(rng.integers(-9999, 9999, 1500) / 1000)
    exact = [Decimal(float(v)).quantize(Decimal("0.001"), ROUND_CEILING) for v in values]
    want = [str(abs(d)) if d == 0 else str(d) for d in exact]
    assert texts(spark, values) == want
    df = spark.createDataFrame([([float(v) for v in values],)], "vec array<double>")
    assert df.select(dense_line(F.col("vec"))).first()[0] == "".join(w + " " for w in want)


def test_decimal_rounding_option(spark):
    assert texts(spark, [0.1, 1.1, 1.2345, -1.2345], rounding="decimal") == [
        "0.100", "1.100", "1.235", "-1.234",
    ]
    with pytest.raises(ValueError):
        ceil3(F.lit(1.0), "other")


def test_number_out_of_range_fails(spark):
    with pytest.raises(PySparkException):
        texts(spark, [1e300])
    with pytest.raises(PySparkException):
        texts(spark, [math.inf])
    with pytest.raises(PySparkException):
        texts(spark, [math.nan])


# -------------------------------------------------------------------- reading


def test_dense_tolerates_line_ends_and_spaces(spark, tmp_path):
    path = put(tmp_path, "m", "1 2 3\n4 5 6 \r\n7  8\n\n9 10 11")
    m = sources.read_dense(spark, path, (5, 3))
    assert array_of(m).tolist() == [[1, 2, 3], [4, 5, 6], [7, 8, 0], [0, 0, 0], [9, 10, 11]]


def test_dense_with_id(spark, tmp_path):
    path = put(tmp_path, "m", "1 0 0 3\n0 1 0 2 \n")
    m = sources.read_dense_id(spark, path, (2, 3))
    assert np.array_equal(array_of(m), A)
    assert m.df.count() == 6


def test_zero_tests_differ(spark, tmp_path):
    path = put(tmp_path, "m", "0 0 0.0 -0 5 00\n")
    count = lambda z: sources.read_dense_id(spark, path, (1, 5), zero_test=z).df.count()
    assert (count(None), count("literal"), count("value")) == (5, 4, 1)
    with pytest.raises(ValueError):
        count("other")


def test_sparse_text(spark, tmp_path):
    m = sources.read_csr(spark, put(tmp_path, "r", "0 0 1 2 2 \n1 2 3\n"), (2, 3))
    assert np.array_equal(array_of(m), A)
    m = sources.read_csc(spark, put(tmp_path, "c", "0 0 1 \n2 0 2 1 3 \n"), (2, 3))
    assert np.array_equal(array_of(m), A)


def test_empty_lines_of_sparse_text(spark, tmp_path):
    m = sources.read_csr(spark, put(tmp_path, "r", "0 \n1 1 5.5 \n2 \n"), (3, 2))
    assert [tuple(r) for r in m.df.collect()] == [(1, 1, 5.5)]


@pytest.mark.parametrize(
    "reader, text",
    [
        (sources.read_dense, "1 x 3\n"),
        (sources.read_dense, "1 2 3 4\n"),
        (sources.read_dense_id, "0 1 x 3\n"),
        (sources.read_csr, "0 1 x\n"),
        (sources.read_csr, "0 1 2.0 2\n"),
        (sources.read_csc, "0 1\n"),
    ],
)
def test_malformed_text_fails(spark, tmp_path, reader, text):
    m = reader(spark, put(tmp_path, "m", text), (1, 3))
    with pytest.raises(PySparkException):
        m.cells().df.collect()


def test_permissive_reading(spark, tmp_path):
    """An unreadable number is no cell; what contradicts the shape still fails."""
    m = sources.read_dense(spark, put(tmp_path, "d", "1 x 3\n"), (1, 3), mode="permissive")
    assert [(r["j"], r["v"]) for r in m.cells().df.orderBy("j").collect()] == [(0, 1.0), (2, 3.0)]
    m = sources.read_csr(spark, put(tmp_path, "s", "0 1 x 2 7\n"), (1, 4), mode="permissive")
    assert [(r["j"], r["v"]) for r in m.df.collect()] == [(2, 7.0)]
    for reader, text in ((sources.read_dense, "1 2 3 4\n"), (sources.read_dense, "1 2 3\n\n"), (sources.read_csr, "0 1 5 2\n")):
        with pytest.raises(PySparkException):
            reader(spark, put(tmp_path, "bad", text), (1, 3), mode="permissive").cells().df.collect()
    with pytest.raises(ValueError):
        sources.read_csr(spark, "x", (1, 1), mode="other")


@pytest.mark.parametrize("method", ["naive", "IPB", "OPB", "auto"])
@pytest.mark.parametrize("sparsity", [0, 50])
def test_cells_outside_the_shape_fail_under_every_method(spark, tmp_path, method, sparsity):
    a = vectors_of(spark, np.ones((2, 3)))
    outside = (
        sources.read_csr(spark, put(tmp_path, "s", "0 1 5 25 1\n"), (3, 3)),
        sources.read_dense_id(spark, put(tmp_path, "i", "3 1 1 1\n"), (3, 3)),
        sources.from_table(spark.createDataFrame([(0, 0, 1.0), (1, 7, 1.0)], "i long, j long, v double"), "i", "j", "v", (3, 3)),
    )
    for b in outside:
        with pytest.raises(PySparkException, match="outside the shape"):
            matmul(a, b, method, sparsity).cells().df.collect()


def test_one_line_for_a_row_of_any_length(spark, tmp_path):
    n = 1_500_000
    cells = CellMatrix(spark.createDataFrame([(0, 5, 1.0), (0, n - 1, 2.0), (1, 7, 3.0)], "i long, j long, v double"), 2, n)
    sinks.write_csr(cells, str(tmp_path / "wide"), files=1)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "wide")).collect()]
    assert lines == [f"0 5 1 {n - 1} 2 ", "1 7 3 "] or lines == [f"0 5 1.0 {n - 1} 2.0 ", "1 7 3.0 "]
    back = sources.read_csr(spark, str(tmp_path / "wide"), (2, n))
    assert sorted(map(tuple, back.df.collect())) == [(0, 5, 1.0), (0, n - 1, 2.0), (1, 7, 3.0)]


@pytest.mark.parametrize("method", ["naive", "IPB", "OPB"])
def test_unreadable_numbers_add_nothing(spark, tmp_path, method):
    path = put(tmp_path, "d", "1 x 3\n4 5 6\n")
    a = sources.read_dense(spark, path, (2, 3), mode="permissive")
    want = np.array([[1, 0, 3], [4, 5, 6.0]])
    b = vectors_of(spark, np.arange(6.0).reshape(3, 2))
    assert np.array_equal(array_of(matmul(a, b, method)), want @ np.arange(6).reshape(3, 2))


def test_a_line_of_a_split_that_was_not_counted_fails(spark, tmp_path, monkeypatch):
    """As if the second scan had been cut otherwise: its lines find no count, and none is lost in silence."""
    from gridmat.sources import text

    path = put(tmp_path, "lines", "".join(f"{k}\n" for k in range(50)))
    real = text._task_of
    monkeypatch.setattr(text, "_task_of", lambda c: real(c) + (1 if c == "mid" else 0))
    with pytest.raises(PySparkException, match="split otherwise"):
        sources.numbered_lines(spark, path).collect()


def test_line_numbers_over_many_splits(spark, tmp_path):
    """Splits inside a file, several files, and files packed into one task."""
    folder = tmp_path / "many"
    folder.mkdir()
    want, n = [], 0
    for part, size in enumerate([700, 1, 0, 2300, 40]):
        lines = [f"{n + k} {'x' * ((n + k) % 37)}" for k in range(size)]
        n += size
        want += lines
        (folder / f"part-{part:05d}").write_text("".join(f"{line}\n" for line in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = sources.numbered_lines(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        got = {r["line_no"]: r["line"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(want))


def test_pair_is_bound_by_argument_order(spark, tmp_path):
    pa, pb = put(tmp_path, "z", "1 2\n"), put(tmp_path, "a", "3\n4\n")
    a, b = sources.read_pair(spark, pa, pb, (1, 2), (2, 1))
    assert array_of(matmul(a, b, "IPB")).tolist() == [[11.0]]


# ----------------------------------------------------------------- round trips


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_round_trips(spark, tmp_path, compression):
    a, _ = random_pair(4, n=30, k=12)
    m = cells_of(spark, a)
    for name, write, read in (
        ("csr", sinks.write_csr, sources.read_csr),
        ("csc", sinks.write_csc, sources.read_csc),
        ("id", sinks.write_row_text, sources.read_dense_id),
        ("dense", sinks.write_dense_text, sources.read_dense),
    ):
        path = str(tmp_path / name)
        write(m, path, compression=compression)
        assert np.array_equal(array_of(read(spark, path, a.shape)), a)
        ends = {p.rsplit(".", 1)[-1] for p in os.listdir(path) if p.startswith("part-")}
        assert ends == ({"gz"} if compression else {"txt"})


def test_files_hold_runs_of_rows(spark, tmp_path):
    m = cells_of(spark, np.eye(50))
    for write in (sinks.write_csr, sinks.write_csc, sinks.write_row_text, sinks.write_dense_text):
        for files in (1, 3, 20):
            path = tmp_path / f"{write.__name__}-{files}"
            write(m, str(path), files=files)
            written = sum(p.startswith("part-") for p in os.listdir(path))
            # Dense rows are alike; sparse lines are cut by a sketch of their bytes, so a few cuts may meet.
            assert written == -(-50 // -(-50 // files)) if write is sinks.write_dense_text else files / 2 < written <= files
            lines = lines_in(path)
            if write is not sinks.write_dense_text:
                assert [int(line.split(" ")[0]) for line in lines] == list(range(50))
            else:
                assert [line.split(" ").index("1.000") for line in lines] == list(range(50))


def test_write_replaces_or_refuses(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csr(cells_of(spark, np.ones((4, 4))), path)
    sinks.write_csr(cells_of(spark, A), path)
    assert np.array_equal(array_of(sources.read_csr(spark, path, A.shape)), A)
    with pytest.raises(PySparkException):
        sinks.write_csr(cells_of(spark, A), path, mode="error")


def test_missing_rows_are_written_as_zeros(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (3, [3.0, 4.0])], "id bigint, vec array<double>")
    sinks.write_dense_text(VectorMatrix(df, 5, 2), str(tmp_path / "d"))
    assert lines_in(tmp_path / "d") == [
        "0.000 0.000 ", "1.000 2.000 ", "0.000 0.000 ", "3.000 4.000 ", "0.000 0.000 ",
    ]


def test_column_vectors_are_written_by_row(spark, tmp_path):
    sinks.write_dense_text(vectors_of(spark, A, "col"), str(tmp_path / "d"))
    assert lines_in(tmp_path / "d") == ["1.000 0.000 2.000 ", "0.000 0.000 3.000 "]


def test_row_lines_in_pieces(spark):
    """Pieces of a row, with and without cells, join to the same line."""
    a, _ = random_pair(5, n=9, k=23)
    a[2, :], a[3, 5:18] = 0, 0
    m = cells_of(spark, a)
    for all_rows in (False, True):
        whole = {tuple(r) for r in layout.row_lines(m, all_rows).collect()}
        for span in (1, 4, 7, 22, 23):
            assert {tuple(r) for r in layout.row_lines(m, all_rows, span).collect()} == whole
    assert len(whole) == 9


def test_row_that_cannot_be_a_line_fails_with_its_id(spark):
    """Only a line that is really too long; the width alone rules nothing out."""
    df = spark.createDataFrame([(0, 0, 1.0)], "i bigint, j bigint, v double")
    with pytest.raises(PySparkException, match="line too long for one string: id 0"):
        layout.row_lines(CellMatrix(df, 1, 2**31 - 10)).collect()


def test_line_profile(spark, tmp_path):
    path = put(tmp_path, "m", "1 2 3\n44 55\n")
    assert tuple(sources.line_profile(spark, path).first()) == (2, 5, 10)


def test_tokens(spark):
    df = spark.createDataFrame([("1  2 3 ",), ("",)], "s string")
    assert [r[0] for r in df.select(tokens(F.col("s"))).collect()] == [["1", "2", "3"], []]


def test_scratch_path_is_new_each_time(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


class _Session:
    """What scratch_path asks of a session."""

    def __init__(self, folder):
        self.conf = {"spark.sql.warehouse.dir": "hdfs:///warehouse"}
        if folder:
            self.conf["spark.checkpoint.dir"] = folder


def test_scratch_folder():
    assert scratch_path(_Session("hdfs:///shared/"), "x").startswith("hdfs:///shared/gridmat/x-")
    assert scratch_path(_Session(None), "x").startswith("hdfs:///warehouse/gridmat/x-")
