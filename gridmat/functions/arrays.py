"""Column expressions on vectors held as ``ARRAY<DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to(vec: Column, width: int) -> Column:
    """Fill a short vector with zeros up to ``width``."""
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(vec))
    return F.concat(vec, F.array_repeat(F.lit(0.0), missing))


def fit(vec: Column, width: int) -> Column:
    """Bring a vector to the width of its matrix.

    Short ones are padded. A longer one contradicts the shape and fails the job.
    """
    too_long = F.raise_error(F.lit(f"vector holds more than {width} values"))
    return (
        F.when(F.size(vec) == width, vec)
        .when(F.size(vec) < width, pad_to(vec, width))
        .otherwise(too_long.cast("array<double>"))
    )


def append(vec: Column, value: Column, times: int = 1) -> Column:
    return F.concat(vec, F.array_repeat(value, times))


def take(vec: Column, start: int, length: int = -1) -> Column:
    """``length`` elements from 0-based ``start``; -1 means up to the end."""
    count = F.size(vec) if length == -1 else F.lit(length)
    return F.slice(vec, F.lit(start + 1), count)


def rows_of_block(block: Column, width: int) -> Column:
    """Cut a row-major block into its rows; a short last row is kept."""
    n_rows = F.ceil(F.size(block) / F.lit(width)).cast("int")
    starts = F.when(n_rows > 0, F.sequence(F.lit(0), n_rows - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda r: F.slice(block, r * F.lit(width) + 1, F.lit(width)))


def find(vec: Column, value: Column, start: int = 0) -> Column:
    """0-based position of the first ``value`` at or after ``start``.

    The vector's length is returned when there is none.
    """
    hit = F.array_position(F.slice(vec, F.lit(start + 1), F.size(vec)), value)
    return F.when(hit > 0, hit - 1 + start).otherwise(F.size(vec)).cast("bigint")


def set_at(vec: Column, index: int, value: Column) -> Column:
    return F.transform(vec, lambda x, p: F.when(p == index, value).otherwise(x))


def add(a: Column, b: Column) -> Column:
    """Elementwise sum; where one vector is shorter it counts as zero."""
    zero = F.lit(0.0)
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def scale(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda x: x * factor)


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, zero))
    return F.aggregate(products, zero, lambda total, x: total + x)


def pair_keys(tokens: Column) -> Column:
    """Keys of a ``k v k v ...`` list: the tokens at even positions."""
    return F.filter(tokens, lambda _, p: p % 2 == 0)


def pair_values(tokens: Column) -> Column:
    """Values of a ``k v k v ...`` list: the tokens at odd positions."""
    return F.filter(tokens, lambda _, p: p % 2 == 1)
