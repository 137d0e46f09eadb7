"""Column expressions on sparse vectors held as ``MAP<BIGINT, DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(vec: Column, key: Column) -> Column:
    """Value at ``key``, zero where the vector has no such entry."""
    return F.coalesce(F.try_element_at(vec, key), F.lit(0.0))


def put(vec: Column, key: Column, value: Column) -> Column:
    """The vector with ``key`` set to ``value``, replacing an entry that is there."""
    return F.map_zip_with(vec, F.create_map(key, value), lambda _, old, new: F.coalesce(new, old))


def add(a: Column, b: Column) -> Column:
    """Union of both key sets; values under the same key are added."""
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def scale(vec: Column, factor: Column) -> Column:
    return F.transform_values(vec, lambda _, x: x * factor)


def length(vec: Column) -> Column:
    return F.size(vec).cast("bigint")
