"""Scratch text with every missing cell in it is written packed."""

import glob

from gridmat.plans.table_queries import QUERIES
from oracle import TESTDATA


def test_dense_scratch_text_is_packed(spark):
    assert QUERIES["drop_zeros_literal"](spark, f"{TESTDATA}/sf0.001").count() > 0
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    parts = glob.glob(f"{root}/gridmat/drop_zeros_literal-*/part-*")
    assert parts and all(p.endswith(".gz") for p in parts)
