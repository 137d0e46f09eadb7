"""Number and row text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the result formats.
DECIMALS = 3
SEPARATOR = " "
MISSING = "0"

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves of 26 bits
_CHUNK = 4503599627370496.0  # 2**52, from where on every double is whole


def tokens(line: Column) -> Column:
    """Space-separated tokens of a line; trailing and doubled spaces give none."""
    return F.array_remove(F.split(line, SEPARATOR), "")


def parse_double(token: Column, mode: str = "strict") -> Column:
    """Strict parsing fails the job on a malformed number; permissive gives null."""
    check_mode(mode)
    return token.cast("double") if mode == "strict" else token.try_cast("double")


def check_mode(mode: str) -> None:
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode must be 'strict' or 'permissive', not {mode!r}")


def plain_number(v: Column) -> Column:
    """Whole numbers without a fraction part, others as shortest double text."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def ceil_thousandths(fraction: Column) -> Column:
    """Exact ``ceil(fraction * 1000)`` for ``|fraction| < 1``, as BIGINT.

    The product is rounded to the nearest double. That can only mislead where
    the rounded product is whole while the true one lies just above it; there
    ``lost`` recovers what the rounding took away (Dekker's two-product).
    """
    p = fraction * F.lit(1000.0)
    t = fraction * F.lit(_SPLIT)
    hi = t - (t - fraction)
    lost = (hi * F.lit(1000.0) - p) + (fraction - hi) * F.lit(1000.0)
    up = F.ceil(p)
    return F.when((up.cast("double") == p) & (lost > 0.0), up + 1).otherwise(up)


def _split_parts(v: Column) -> Column:
    """``v = high * 2**52 + whole + fraction``, every part exact.

    From 2**52 on doubles are whole, so ``high`` and ``fraction`` are never
    both needed. ``high`` leaves BIGINT, and the cast fails, from 2**115 on.
    """
    large = F.abs(v) >= _CHUNK
    high = F.when(large, (v / _CHUNK).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rest = F.when(large, v - high.cast("double") * _CHUNK).otherwise(v)
    whole = rest.cast("bigint")
    return F.struct(
        high.alias("high"), whole.alias("whole"), (rest - whole.cast("double")).alias("fraction")
    )


def _join_parts(parts: Column) -> Column:
    thousandths = ceil_thousandths(parts["fraction"]).cast("decimal(4,0)")
    step = F.lit("0.001").cast("decimal(4,3)")
    near = parts["whole"].cast("decimal(16,0)") + thousandths * step
    chunk = F.lit(str(int(_CHUNK))).cast("decimal(16,0)")
    far = parts["high"].cast("decimal(19,0)") * chunk + parts["whole"].cast("decimal(16,0)")
    return F.when(parts["high"] == 0, near.cast(f"decimal(20,{DECIMALS})").cast("string")).otherwise(
        far.cast(f"decimal(38,{DECIMALS})").cast("string")
    )


def _ceil3_decimal(v: Column) -> Column:
    # Scale 17 keeps every digit that can matter; the decimal type has 38 in all.
    scaled = F.ceil(v.cast("decimal(38,17)"), F.lit(DECIMALS))
    return scaled.cast(f"decimal(30,{DECIMALS})").cast("string")


def ceil3(v: Column, rounding: str = "exact") -> Column:
    """Text with three decimals, rounded toward +infinity.

    ``exact`` rounds the binary value itself (0.1 gives 0.101, because the
    double lies above one tenth); ``decimal`` rounds its shortest decimal
    text (0.1 gives 0.100). The whole part is split off first, which is exact,
    so any double up to 2**115 (4e34) in magnitude is handled; beyond, the job
    fails rather than print a number that is not exact.
    """
    _check_rounding(rounding)
    return _join_parts(_split_parts(v)) if rounding == "exact" else _ceil3_decimal(v)


def _check_rounding(rounding: str) -> None:
    if rounding not in ("exact", "decimal"):
        raise ValueError(f"rounding must be 'exact' or 'decimal', not {rounding!r}")


def dense_line(vec: Column, rounding: str = "exact") -> Column:
    """``v v v `` with three decimals each and a trailing space."""
    _check_rounding(rounding)
    if rounding == "exact":
        # In two steps, so that the parts are computed once per number.
        texts = F.transform(F.transform(vec, _split_parts), _join_parts)
    else:
        texts = F.transform(vec, _ceil3_decimal)
    return F.concat(F.array_join(texts, SEPARATOR), F.lit(SEPARATOR))
