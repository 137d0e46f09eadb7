"""Dense text with ids is made and read without a token, a sent byte or a sorted byte for each missing cell."""

import pyarrow as pa
import pytest

from gridmat import sinks, sources
from gridmat.matrix import CellMatrix
from gridmat.operators import layout
from gridmat.sources.text_kernels import present_tokens
from pyspark.sql import functions as F
from test_plans import plan_of

LINES = [
    "0 0 0 5 0", "1 00 0 0.0 -0 0", "", "   ", "  7  0  0 1e3   0 ", "12", "100 0 0", "3 0 0 0", "0 0", "00 0 00", "5 x0 é 0 0x 0",
    "8 " + "0 " * 300 + "10 " + "0 " * 90 + "0.5", "9\t1 0 0\t0 2", "4 1234567890.12345678901234567890 0 1", "6 0 10", "0",
]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_tokens_that_are_no_zero(size):
    want = []
    for line in LINES:
        own = [t for t in line.split(" ") if t]
        want += [(own[0], n, t) for n, t in enumerate(own[1:]) if t != "0"]
    lines = pa.record_batch({"value": pa.array(["1 2 0", *LINES])}).slice(1)
    batches = [lines.slice(n, size) for n in range(0, len(LINES), size)]
    got = [tuple(r.values()) for b in present_tokens(iter(batches)) for r in b.to_pylist()]
    assert got == want


def test_reading_makes_no_token_of_a_zero(spark, tmp_path):
    (tmp_path / "m").write_text("0 0 1.5 0\n2 0.0 0 0 \n")
    cells = sources.read_dense_id(spark, str(tmp_path / "m"), (3, 3), zero_test="literal").df
    assert sorted(map(tuple, cells.collect())) == [(0, 1, 1.5), (2, 0, 0.0)]
    assert "split(" not in plan_of(cells)


@pytest.mark.parametrize("all_rows", [False, True])
@pytest.mark.parametrize("span", [3, 7, 100])
def test_text_is_made_after_rows_are_sent_and_sorted(spark, monkeypatch, all_rows, span):
    cells = [(0, 3, 1.0), (0, 19, 2.5), (4, 0, -1.0), (4, 1, 0.0), (2, 11, 3.0)]
    m = CellMatrix(spark.createDataFrame(cells, "i bigint, j bigint, v double"), 6, 20)
    lists = layout.to_csr(m, span, all_rows).withColumn("_file", (F.col("id") / 3).cast("int")).repartitionById(2, "_file")
    lines = layout.lines_in_place(lists, 20, span)
    assert {tuple(r) for r in lines.collect()} == {tuple(r) for r in layout.row_lines(m, all_rows, span).collect()}
    plan = plan_of(lines)
    assert plan.index("repeat(") < plan.index("Sort [id") < plan.index("shufflepartitionid")


def test_wider_rows_meet_as_text(spark, tmp_path, monkeypatch):
    from gridmat.sinks import text

    m = CellMatrix(spark.createDataFrame([(1, 4, 2.0), (0, 0, 1.0)], "i bigint, j bigint, v double"), 3, 6)
    got = []
    for n, most in enumerate((5, 6)):
        monkeypatch.setattr(text, "GATHERED_COLUMNS", most)
        sinks.write_row_text(m, str(tmp_path / str(n)), all_rows=True)
        got.append([r.value for r in spark.read.text(str(tmp_path / str(n))).collect()])
    assert sorted(got[0]) == sorted(got[1]) == ["0 1.0 0 0 0 0 0 ", "1 0 0 0 0 2.0 0 ", "2 0 0 0 0 0 0 "]
