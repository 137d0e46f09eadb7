"""What the physical plans must and must not contain."""

import re

import numpy as np
import pytest

from gridmat.operators import dense_product as dense
from gridmat.operators import joins, layout
from gridmat.operators import sparse_product as sparse
from gridmat.plans.tables import Tables
from helpers import cells_of, vectors_of
from oracle import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpart|rangepart|shufflepart|SinglePart|RoundRobin)", plan))


@pytest.fixture()
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_inner_blocks_are_summed_in_place(spark, no_auto_broadcast):
    a = cells_of(spark, np.ones((6, 6)))
    # one for each operand brings its cells together by k; one brings the pairs to their unit, none sums them
    assert exchanges(plan_of(sparse.matmul_ipb_sparse(a, a, (2, 6, 2)).df)) == 3
    assert exchanges(plan_of(sparse.matmul_ipb_sparse(a, a, (2, 3, 2)).df)) == 4


def test_cell_products_are_summed_before_the_shuffle(spark, no_auto_broadcast):
    a = cells_of(spark, np.ones((6, 6)))
    plan = plan_of(sparse.matmul_opb_sparse(a, a).df)
    assert exchanges(plan) == 3
    assert "partial_sum" in plan


def test_dense_vectors_are_cut_without_a_shuffle(spark):
    a = vectors_of(spark, np.ones((6, 6)))
    assert exchanges(plan_of(dense.block_pieces(a, 2, 2))) == 0
    assert exchanges(plan_of(dense.matmul_ipb_dense(a, a, (2, 6, 2)).df)) == 2
    assert exchanges(plan_of(dense.matmul_opb_dense(a, a, (6, 2, 6)).df)) == 3


def test_naive_leaves_rows_where_a_small_operand_can_be_sent(spark):
    a = cells_of(spark, np.ones((6, 6)))
    df = sparse.matmul_naive_sparse(a, a).df
    df.collect()
    assert "BroadcastHashJoin" in plan_of(df)


def test_operands_that_are_counted_are_computed_once(spark, no_auto_broadcast):
    """The counts by k and the join read the same exchange of the operand."""
    t = Tables(spark, FOLDER)
    df = sparse.matmul_opb_sparse(t.quantities(), t.months(), light_products=10).df
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_no_row_for_every_scalar_product(spark):
    plan = plan_of(dense.matmul_naive_dense(vectors_of(spark, np.ones((6, 6))), vectors_of(spark, np.ones((6, 6)))).df)
    assert "Join" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(Tables(spark, FOLDER).high_quantities().df)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema == "l_partkey:bigint,l_suppkey:bigint,l_quantity:double"
    assert "GreaterThanOrEqual(l_quantity,46.0)" in plan


def test_one_rank_one_term_reads_one_key(spark):
    h = Tables(spark, FOLDER).high_quantities()
    pairs = joins.k_join(h, h.T).filter("k = 5")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Filter .*l_partkey#\d+L? = 5\)", plan)) == 2


def test_writers_do_not_sample(spark):
    lines = layout.sparse_lines(layout.to_csr(cells_of(spark, np.eye(4))))
    from gridmat.operators.ordering import sort_into_files

    plan = plan_of(sort_into_files(lines, "id", 4, "part"))
    assert "rangepartitioning" not in plan
