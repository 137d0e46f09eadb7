"""Rows much wider than what they hold."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridmat import sinks
from gridmat.matrix import CellMatrix
from gridmat.operators import layout
from helpers import array_of, cells_of, random_pair


def _wide(spark, width, cells):
    return CellMatrix(spark.createDataFrame(cells, "i bigint, j bigint, v double"), 3, width)


@pytest.mark.parametrize("span", [1, 3, 7, 100])
@pytest.mark.parametrize("all_rows", [False, True])
def test_lines_and_runs_for_any_span(spark, span, all_rows):
    a, _ = random_pair(12, n=6, k=23)
    a[3, :] = 0
    A = cells_of(spark, a)
    want = {i: f"{i} " + "".join(("0" if x == 0 else str(float(x))) + " " for x in row) for i, row in enumerate(a) if all_rows or row.any()}
    assert {r.id: r.line for r in layout.row_lines(A, all_rows=all_rows, span=span).collect()} == want
    runs = layout.row_runs(A, span=span)
    assert np.array_equal(array_of(layout.from_runs(runs, a.shape, span)), a)
    widths = {r[0] for r in runs.select(F.aggregate("gaps", F.lit(0).cast("bigint"), lambda s, g: s + g) + F.size("vals") + F.col("tail") - F.least(F.lit(span), F.lit(23) - F.col("part") * span)).collect()}
    assert widths == {0}


def test_a_hundred_million_columns_and_ten_cells(spark, tmp_path):
    width = 100_000_000
    places = [0, 1, 999_999, 1_000_000, 5_000_001, 40_000_000, 40_000_001, 77_777_777, 99_000_000, width - 1]
    m = _wide(spark, width, [(1, j, float(n + 1)) for n, j in enumerate(places)])
    runs = layout.row_runs(m)
    assert runs.agg(F.sum(F.size("vals")), F.max(F.size("gaps"))).first() == (10, 3)
    sinks.write_row_text(m, str(tmp_path / "wide"))
    (path,) = [p for p in (tmp_path / "wide").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    text = path.read_bytes()
    assert text.startswith(b"1 1.0 2.0 0 ") and text.endswith(b"0 10.0 \n")
    assert len(text) == 2 + 2 * (width - 10) + sum(len(f"{float(n + 1)} ") for n in range(10)) + 1


def test_a_line_beyond_a_string_fails_with_its_id(spark, tmp_path):
    m = _wide(spark, 2_000_000_000, [(2, 5, 1.0)])
    with pytest.raises(PySparkException, match="line too long for one string: id 2"):
        layout.row_lines(m).collect()


def test_bands_hold_one_band_each(spark):
    a, _ = random_pair(5, n=4, k=20)
    bands = layout.densify_bands(cells_of(spark, a), 6).collect()
    out = np.zeros((4, 20))
    for r in bands:
        assert len(r.vec) == min(6, 20 - r.band * 6) and any(r.vec)
        out[r.i, r.band * 6 : r.band * 6 + 6] = r.vec
    assert np.array_equal(out, a)
    wide = layout.densify_bands(_wide(spark, 10**12, [(0, 10**12 - 1, 4.0), (0, 3, 2.0)]), 1000).collect()
    assert sorted((r.band, r.vec.index(max(r.vec))) for r in wide) == [(0, 3), (10**9 - 1, 999)]
