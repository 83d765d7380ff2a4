"""Predicates whose shape depends on report parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ts_literal(df: DataFrame, column: str, value: str | dt.date | dt.datetime) -> Column:
    """A literal of the same timestamp flavour as ``df[column]``.

    Comparing a TIMESTAMP_NTZ column with a session-zone TIMESTAMP literal
    would shift by the session zone; casting the literal to the column's own
    type keeps the comparison zone-free and lets Parquet push it down."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            raise ValueError("report instants are local times without a time zone")
        text = value.isoformat(sep=" ", timespec="microseconds")
    elif isinstance(value, dt.date):
        text = value.isoformat()
    else:
        text = str(value)
    return F.lit(text).cast(df.schema[column].dataType)


def optional_eq(df: DataFrame, column: str, value) -> DataFrame:
    """equality with a parameter, and no predicate at all while the
    parameter is not set, so Catalyst never sees a tautology it must fold."""
    if value is None:
        return df
    return df.filter(F.col(column) == F.lit(value))


def equal_or_self(df: DataFrame, column: str, value) -> DataFrame:
    """equality with a parameter that falls back to the column itself, so
    rows whose column is NULL are dropped in either case."""
    if value is None:
        return df.filter(F.col(column).isNotNull())
    return df.filter(F.col(column) == F.lit(value))


def half_open_days(df: DataFrame, column: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """``col >= start AND col < end + 1 day`` (end day fully included)."""
    start_d = _as_date(start)
    stop_d = _as_date(end) + dt.timedelta(days=1)
    return df.filter(
        (F.col(column) >= ts_literal(df, column, start_d)) & (F.col(column) < ts_literal(df, column, stop_d))
    )


def in_list(df: DataFrame, column: str, values: Iterable | None) -> DataFrame:
    """Membership in a parameter list (``None`` = no filter).

    The list is a report parameter typed by a user, so it is inlined as
    ``IN (...)`` and pushed to the Parquet scan."""
    if values is None:
        return df
    return df.filter(F.col(column).isin(list(values)))


def _as_date(v: dt.date | str) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v).strip())
