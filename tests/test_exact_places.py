"""Digits added side by side: values of different highest places share places, and no row is made for each digit."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridmat.operators.exact_sum import exact_sum
from test_plans import plan_of


def test_places_shared_by_values_of_different_size(spark):
    rng = np.random.default_rng(8)
    groups = {g: [float(x) for x in rng.standard_normal(60) * 2.0 ** rng.integers(-70, 70, 60)] for g in range(12)}
    groups[12] = [1e300, 2.0**-1074, -1e300, 0.0, 2.0**-1060]
    groups[13] = [2.0**78 + 2.0**26, -(2.0**78), 1.0 + 2.0**-52, 2.0**-53, 0.0]
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, v double").repartition(5)
    assert {r.g: r.v for r in exact_sum(df, ["g"]).collect()} == {g: math.fsum(xs) for g, xs in groups.items()}


def test_a_value_is_one_row_until_it_is_summed(spark):
    df = spark.range(9).select(F.lit(1).alias("g"), (F.col("id") / 7).alias("v"))
    assert "Generate" not in plan_of(exact_sum(df, ["g"]))
