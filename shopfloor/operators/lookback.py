"""Cumulative look-back windows without the range join.

The report joins every transaction to a 3-row table of window lengths with
``date BETWEEN end - days AND end`` and then pivots with
``MAX(CASE WHEN DaysBack = d THEN x ELSE 0 END)`` and ``AVG(cost)``.  Because
all windows end at the same instant they are nested, so the replicated rows
carry no information beyond two booleans per row.  This module computes the
same numbers from

* one range predicate on the fact table (pushed to the scan), and
* per-window ``max``/``min`` partials plus a per-row weight
  ``n = number of windows containing the row``.

The partials are algebraic, so they can be taken at a fine grain (e.g. per
part and location) *before* joining dimension tables, and finished after the
join at the report grain.  No row is replicated and no nested-loop join is
planned.

Floors that the ``ELSE 0`` branches create, for windows sorted ascending:

* every window except the widest always sees a 0 (each row also lands in
  the widest bucket, which is "else" for the narrower columns);
* the widest window sees a 0 only if some row lies in a narrower window;
* a single window has no floor.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.filters import ts_literal

WEIGHT = "__lb_weight"


def _max_name(m: str, d: int) -> str:
    return f"__lb_{m}_max_{d}"


def _min_name(m: str, d: int) -> str:
    return f"__lb_{m}_min_{d}"


def _in_name(d: int) -> str:
    return f"__lb_in_{d}"


def look_back_partials(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    measures: Sequence[str],
    end: dt.datetime | str,
    days: Sequence[int] = (30, 60, 90),
) -> DataFrame:
    """Filter to the widest window and aggregate partials per ``keys``.

    Output: keys, per measure and window ``max``/``min``, per non-widest
    window a ``bool_or`` membership flag, and the summed row weight."""
    days = sorted(set(days))
    widest = days[-1]
    end_lit = ts_literal(df, ts, end)
    start_lit = end_lit - F.make_dt_interval(F.lit(widest))
    fact = df.filter(F.col(ts).between(start_lit, end_lit))

    member = {d: F.col(ts) >= end_lit - F.make_dt_interval(F.lit(d)) for d in days[:-1]}
    weight = F.lit(1)
    for cond in member.values():
        weight = weight + cond.cast("int")

    aggs: list[Column] = []
    for m in measures:
        for d in days:
            val = F.col(m) if d == widest else F.when(member[d], F.col(m))
            aggs.append(F.max(val).alias(_max_name(m, d)))
            aggs.append(F.min(val).alias(_min_name(m, d)))
    for d in days[:-1]:
        aggs.append(F.bool_or(member[d]).alias(_in_name(d)))
    aggs.append(F.sum(weight).alias(WEIGHT))
    return fact.groupBy(*keys).agg(*aggs)


def scaled_bucket(measure: str, d: int, scale: Column | None = None) -> Column:
    """Largest ``scale * x`` over the rows of window ``d`` of one partial row.

    ``scale`` is constant within the partial's keys (e.g. a unit cost), so
    the maximum of the product is ``scale * max`` for a non-negative scale
    and ``scale * min`` for a negative one; NULL scale gives NULL like the
    per-row product would."""
    mx, mn = F.col(_max_name(measure, d)), F.col(_min_name(measure, d))
    if scale is None:
        return mx
    return F.when(scale >= 0, scale * mx).when(scale < 0, scale * mn)


def look_back_final(
    partial: DataFrame,
    group_keys: Sequence[str],
    outputs: Sequence[tuple[str, str, Column | None, int]],
    days: Sequence[int] = (30, 60, 90),
    weighted: Sequence[tuple[str, Column]] = (),
) -> DataFrame:
    """Finish the pivot at the report grain.

    ``outputs``: ``(alias, measure, scale, days)`` — the column
    ``MAX(CASE WHEN DaysBack = days THEN scale*measure ELSE 0 END)``.
    ``weighted``: ``(alias, value)`` — ``AVG(value)`` over the replicated
    rows, i.e. ``sum(value*n) / sum(n where value is not null)``."""
    days = sorted(set(days))
    widest = days[-1]
    narrower = days[-2] if len(days) > 1 else None
    aggs: list[Column] = []
    for alias, measure, scale, d in outputs:
        best = F.max(scaled_bucket(measure, d, scale))
        if d != widest:
            col = F.greatest(best, F.lit(0))
        elif narrower is not None:
            has_zero = F.bool_or(F.col(_in_name(narrower)))
            col = F.greatest(best, F.when(has_zero, F.lit(0)))
        else:
            col = best
        aggs.append(col.alias(alias))
    for alias, value in weighted:
        w = F.col(WEIGHT)
        aggs.append((F.sum(value * w) / F.sum(F.when(value.isNotNull(), w))).alias(alias))
    return partial.groupBy(*group_keys).agg(*aggs)
