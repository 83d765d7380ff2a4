"""Exact money: the result types of the reports' decimal arithmetic.

The database the reports were written for types every step: a sum has 38
digits and the scale of what it adds, a product the digits and scales of both
factors (cut to 38 digits, with at least 6 decimals kept), a union the wider
of both sides, an average at least 6 decimals.  These are the same rules
whatever the session says about precision loss, so results are cast to them;
doubles stay doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS, KEPT_SCALE = 38, 6
#: Whole numbers as decimals.
_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def as_decimal(kind: T.DataType) -> T.DecimalType | None:
    """The decimal a type counts as, None for doubles and other types."""
    if isinstance(kind, T.DecimalType):
        return kind
    return T.DecimalType(_WHOLE[type(kind)], 0) if type(kind) in _WHOLE else None


def _cut(precision: int, scale: int) -> T.DecimalType:
    """A type of at most 38 digits: decimals beyond the sixth give way to
    digits before the point."""
    if precision > DIGITS:
        scale = max(DIGITS - (precision - scale), min(scale, KEPT_SCALE))
    return T.DecimalType(min(precision, DIGITS), scale)


def sum_type(kind: T.DataType) -> T.DataType:
    return T.DecimalType(DIGITS, kind.scale) if isinstance(kind, T.DecimalType) else kind


def product_type(one: T.DataType, other: T.DataType) -> T.DataType:
    a, b = as_decimal(one), as_decimal(other)
    exact = isinstance(one, T.DecimalType) or isinstance(other, T.DecimalType)
    if a is None or b is None or not exact:
        return T.DoubleType() if a is None or b is None else T.LongType()
    return _cut(a.precision + b.precision + 1, a.scale + b.scale)


def union_type(one: T.DataType, other: T.DataType) -> T.DataType:
    a, b = as_decimal(one), as_decimal(other)
    if a is None or b is None:
        return T.DoubleType()
    if not (isinstance(one, T.DecimalType) or isinstance(other, T.DecimalType)):
        return T.LongType()
    scale = max(a.scale, b.scale)
    return _cut(max(a.precision - a.scale, b.precision - b.scale) + scale, scale)


def total(df: DataFrame, column: str) -> Column:
    """SUM: decimals are widened first, so that no partial sum overflows the
    column's own digits."""
    kind = df.schema[column].dataType
    return F.sum(F.col(column).cast(sum_type(kind))).cast(sum_type(kind)) if isinstance(kind, T.DecimalType) else F.sum(column)


def product(df: DataFrame, one: str, other: str) -> Column:
    """The product of two columns of ``df``."""
    kind = product_type(df.schema[one].dataType, df.schema[other].dataType)
    out = F.col(one) * F.col(other)
    return out.cast(kind) if isinstance(kind, T.DecimalType) else out
