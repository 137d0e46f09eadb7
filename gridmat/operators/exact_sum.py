"""Sums of doubles that do not depend on the order or the partitioning.

A double is a sum of at most three whole digits to the base 2**26, at fixed
places of the number line: splitting it off loses nothing. Digits of one place
are whole numbers, so adding them is exact in any order, before the shuffle and
after it; a place holds 2**37 terms. The places of a sum are then put together
and rounded once, to the nearest double. The result is the double next to the
true sum (what ``math.fsum`` gives), the same on any number of partitions.
The three digits of a value are added side by side, by the highest place.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmat.operators import exact_kernels

cloudpickle.register_pickle_by_value(exact_kernels)

BASE_BITS = exact_kernels.BASE_BITS
# Values below 2**TINY are lifted by LIFT places first, so that no place lies below the smallest double.
TINY, LIFT = -900, 8


def _power(exponent: Column) -> Column:
    """2**exponent, exact for whole exponents."""
    return F.pow(F.lit(2.0), exponent.cast("double"))


def _with_three_digits(df: DataFrame, value: str) -> DataFrame:
    """Adds a finite double as three whole digits ``_d0, _d1, _d2`` at the places ``_high``, ``_high - 1`` and ``_high - 2``.

    Step by step in columns, which the engine compiles and computes once each.
    """
    v = F.col(value)
    lifted = F.abs(v) < F.lit(2.0**TINY)
    guess = F.when(F.col("_size") > 0, F.floor(F.log2("_size") / F.lit(float(BASE_BITS)))).otherwise(F.lit(0)).cast("int")
    # The logarithm is rounded: one comparison each way makes the place exact.
    place = F.when(F.col("_size") >= _power((F.col("_high") + 1) * BASE_BITS), F.col("_high") + 1)
    place = place.when((F.col("_size") > 0) & (F.col("_size") < F.col("_unit")), F.col("_high") - 1).otherwise(F.col("_high"))
    out = df.withColumn("_rest", F.when(lifted, v * F.lit(2.0 ** (BASE_BITS * LIFT))).otherwise(v)).withColumn("_size", F.abs("_rest"))
    out = out.withColumn("_high", guess).withColumn("_unit", _power(F.col("_high") * BASE_BITS)).withColumn("_high", place)
    out = out.withColumn("_unit", _power(F.col("_high") * BASE_BITS))
    low = F.lit(2.0**-BASE_BITS)
    for n in range(3):
        out = out.withColumn(f"_d{n}", (F.col("_rest") / F.col("_unit")).cast("bigint"))
        out = out.withColumn("_rest", F.col("_rest") - F.col(f"_d{n}").cast("double") * F.col("_unit")).withColumn("_unit", F.col("_unit") * low)
    return out.withColumn("_high", F.col("_high") - F.when(lifted, F.lit(LIFT)).otherwise(F.lit(0))).drop("_rest", "_size", "_unit")


def with_digits(df: DataFrame, value: str, name: str = "digits") -> DataFrame:
    """Adds a finite double as ``array<struct<place, digit>>``: v = sum of digit * 2**(26 * place). Zero has one digit, 0."""
    out = _with_three_digits(df, value)
    listed = [F.struct((F.col("_high") - n).alias("place"), F.col(f"_d{n}").alias("digit")) for n in range(3)]
    # Most doubles of everyday size have two digits or three; an array that holds no more is not filtered.
    two, one = F.col("_d2") == 0, F.col("_d1") == 0
    kept = F.when(~two, F.array(*listed)).when(one, F.array(listed[0])).otherwise(F.array(*listed[:2]))
    return out.withColumn(name, kept).drop("_high", "_d0", "_d1", "_d2")


def exact_sum(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys`` and the correctly rounded sum of ``value`` for every combination of keys.

    Nulls are left out; a group of nulls alone sums to null, as does an empty
    table without keys. Infinities and NaN add up as they do in any order.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_v"))
    wild = F.isnan("_v") | (F.abs("_v") == F.lit(float("inf")))
    none = F.lit(None).cast("array<struct<place:int,digit:bigint>>")
    tame = rows.select(*names, F.when(wild, F.col("_v")).alias("_wild"), (wild | F.isnull("_v")).alias("_not"), F.when(~wild, F.col("_v")).alias("_v"))
    split = _with_three_digits(tame, "_v")
    # Partial sums in the tasks, of all three digits of the values with one highest place; one row for each such place leaves them.
    digits = [F.when(~F.col("_not"), F.col(f"_d{n}")) for n in range(3)]
    high = F.when(~F.col("_not"), F.col("_high")).alias("_high")
    places = split.groupBy(*names, high).agg(*[F.sum(d).alias(f"_d{n}") for n, d in enumerate(digits)], F.sum("_wild").alias("_wild"))
    there = F.col("_high").isNotNull()
    listed = [F.struct((F.col("_high") - n).alias("place"), F.col(f"_d{n}").alias("digit")) for n in range(3)]
    gathered = places.groupBy(*names).agg(F.flatten(F.collect_list(F.when(there, F.array(*listed)))).alias("_d"), F.sum("_wild").alias("_wild"))
    lists = gathered.select(*names, F.col("_d.place").alias("places"), F.col("_d.digit").alias("digits"), "_wild")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields[: len(names)])
    rounded = lists.mapInArrow(exact_kernels.round_sums, f"{fields}{', ' if names else ''}v double")
    return rounded.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("v").alias(value))


__all__ = ["exact_sum", "with_digits"]
