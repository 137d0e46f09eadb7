"""Queries over tables with more keys than one list of entries covers."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oracle import compare, open_tables

KEYS = [0, 7, 999_999, 1_000_000, 1_200_000]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("wide"))
    lines = [
        (at, i, j, 1, 1.0 + at, day)
        for at, (i, j) in enumerate((i, j) for i in KEYS for j in KEYS if (i + j) % 3 != 1)
        for day in (datetime.date(1995, 1 + at % 12, 3),)
    ]
    kind = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_shipdate date"
    tables = {
        "supplier": spark.createDataFrame([(k,) for k in KEYS], "s_suppkey bigint"),
        "part": spark.createDataFrame([(k,) for k in KEYS], "p_partkey bigint"),
        "lineitem": spark.createDataFrame(lines, kind).withColumn("l_discount", F.lit(0.05)),
    }
    for name, df in tables.items():
        df.toPandas().to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us")
    return folder


@pytest.mark.parametrize("name", ["to_csr", "to_csc"])
def test_a_line_is_whole_however_wide(spark, wide, name):
    assert compare(contract.queries()[name](spark, wide), open_tables(wide), contract.oracle_sql()[name]) is None
