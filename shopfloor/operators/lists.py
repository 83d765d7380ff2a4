"""Delimited lists inside a string column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.text import trimmed_items


def split_positions(
    df: DataFrame, column: str, sep: str = ",", pos: str = "pos", item: str = "item"
) -> DataFrame:
    """One row per list item with its 0-based position, items trimmed.

    The position replaces ``ROW_NUMBER() OVER (ORDER BY (SELECT 1))``: it is
    produced by ``posexplode`` inside the task, with no window and no global
    sort.  NULL lists produce no rows; empty items are kept."""
    return df.select("*", F.posexplode(trimmed_items(column, sep)).alias(pos, item))
