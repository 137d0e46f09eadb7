"""Products of many blocks: B is stored once, and no operand or result row is copied by a shuffle."""

import re

import numpy as np
import pytest

from gridmat.operators import dense_product as dense
from gridmat.operators import layout
from gridmat.plans.scratch import keep
from helpers import cells_of, vectors_of


def _exchanges(df) -> int:
    return len(re.findall(r"Exchange (hashpart|rangepart|shufflepart|SinglePart|RoundRobin)", df._jdf.queryExecution().executedPlan().toString()))


def _operands():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-9, 9, (23, 4)).astype(float), rng.integers(-9, 9, (4, 19)).astype(float)
    a[5:11], b[:, 3:9] = 0.0, 0.0
    return a, b


@pytest.mark.parametrize("form", [vectors_of, cells_of])
@pytest.mark.parametrize("whole_rows", [False, True])
def test_many_blocks(spark, form, whole_rows, monkeypatch):
    monkeypatch.setattr(dense, "ROW_NUMBERS", 50)
    a, b = _operands()
    c = dense.matmul_ipb_dense(form(spark, a), form(spark, b), (3, 10, 3), whole_rows)
    cells = {(r.i, r.j): r.v for r in c.cells().df.collect()}
    assert cells == {(i, j): v for (i, j), v in np.ndenumerate(a @ b)}
    rows = c.rows().df.collect()
    assert len(rows) == 23 and all(r.vec == list((a @ b)[r.id]) for r in rows)


def test_vectors_by_column(spark):
    a, b = _operands()
    c = dense.matmul_ipb_dense(vectors_of(spark, a.T).T, vectors_of(spark, b.T).T, (3, 10, 3), True)
    assert {r.id: r.vec for r in layout.band_regroup(c).df.collect()} == {i: list(v) for i, v in enumerate(a @ b)}


def test_operands_and_rows_are_sent_once(spark):
    a, b = _operands()
    for whole_rows in (False, True):
        c = dense.matmul_ipb_dense(vectors_of(spark, a), vectors_of(spark, b), (3, 10, 3), whole_rows)
        assert _exchanges(c.df) == 1
    assert _exchanges(layout.band_regroup(c).df) == 1
    # Read back from files, bands need not adjoin any more.
    kept = keep(c)
    assert not kept.adjoining and {r.id: r.vec for r in kept.rows().df.collect()} == {i: list(v) for i, v in enumerate(a @ b)}
