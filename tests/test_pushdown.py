"""Report parameters reach the Parquet scan (PushedFilters)."""

import re

from shopfloor.plans.backlog import backlog_snapshot
from shopfloor.plans.usage import usage_by_period
from shopfloor.sources import testmap as TM
from shopfloor.sources.tables import LazyTables
SF = "/root/testdata/sf0.001"


def _formatted(df) -> str:
    """The text of ``df.explain("formatted")`` (scan nodes untruncated)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _pushed(plan: str, table: str) -> str:
    """PushedFilters of the formatted scan nodes reading ``table``."""
    out = []
    for block in plan.split("\n\n"):
        if "Scan parquet" in block and f"{table}.parquet" in block:
            out += re.findall(r"PushedFilters: \[.*\]", block)
    return " ".join(out)


def test_usage_date_range_reaches_orders_scan(spark):
    t = TM.inventory_tables(LazyTables(spark, SF))
    pushed = _pushed(_formatted(usage_by_period(t, TM.END_DATE)), "orders")
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThanOrEqual(o_orderdate" in pushed


def test_backlog_date_range_reaches_orders_scan(spark):
    t = TM.backlog_tables(LazyTables(spark, SF))
    pushed = _pushed(_formatted(backlog_snapshot(t, "1998-01-01", "1998-12-31")), "orders")
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
