"""Scalar settings from a key/value table (Parameter -> Value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def setting(general_setup: DataFrame, name: str, default: str | None = None) -> str | None:
    """Read one setting value, ``default`` when absent.

    The report assigns ``SELECT @v = Value ... WHERE Parameter = name`` —
    with several matching rows the value is arbitrary; we take ``max`` so
    the result is deterministic.  This is the only driver-side read in the
    package: one aggregated row, whatever the table size."""
    row = (
        general_setup.filter(F.col("Parameter") == name)
        .agg(F.max(F.col("Value").cast("string")).alias("v"))
        .first()
    )
    value = row["v"] if row is not None else None
    return default if value is None else value
