"""Parameter objects: typed, read from texts, and the same report by both
faces."""

import datetime as dt

import pytest

from shopfloor.params import BacklogParameters, DemandParameters, LabelParameters, UsageParameters
from shopfloor.sources import testmap as TM
from shopfloor.sources.tables import LazyTables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_typed_and_read_from_texts():
    asked = BacklogParameters.from_text(start="2024-05-01", end=" 2024-08-05 ", location="MAIN", category="0")
    assert asked == BacklogParameters(dt.date(2024, 5, 1), dt.date(2024, 8, 5), "MAIN", 0)
    assert BacklogParameters.from_text(start="2024-05-01", end="2024-08-05", location="", category="NULL").category == 0
    assert UsageParameters.from_text(end="2024-08-01 12:00:00.5", categories="279, 311, 75").args()["categories"] == [279, 311, 75]
    assert LabelParameters().args() == {"session": None, "lite_attribute": "LITE", "logo_attribute": "LOGO"}
    for wrong in (
        lambda: BacklogParameters("2024-05-01", dt.date(2024, 8, 5)),
        lambda: BacklogParameters(dt.datetime(2024, 5, 1), dt.date(2024, 8, 5)),
        lambda: BacklogParameters.from_text(start="2024-05-01"),
        lambda: DemandParameters(part=7),
        lambda: DemandParameters.from_text(parts="P1"),
    ):
        with pytest.raises(TypeError):
            wrong()


def test_both_faces_give_the_same(spark):
    raw = LazyTables(spark, SF)
    demand, usage = TM.demand_tables(raw), TM.inventory_tables(raw)
    for asked in (DemandParameters(), DemandParameters(TM.PART, TM.SUFFIXES[0], "MAIN"), DemandParameters(suffix="0001")):
        rows = _rows(asked.run(demand))
        assert rows == _rows(asked.sql(spark, demand)) and rows
    end = dt.datetime(2001, 7, 1)
    for asked in (UsageParameters(end), UsageParameters(end, "MAIN", (2, 6), True), UsageParameters(end, categories=(), system_cost_method=1)):
        assert _rows(asked.run(usage)) == _rows(asked.sql(spark, usage))


def test_values_are_arguments_and_reach_the_scan(spark):
    raw = LazyTables(spark, SF)
    tables = TM.demand_tables(raw)
    quoted = DemandParameters(part="x' OR 1=1 --")
    assert quoted.sql(spark, tables).count() == 0
    usage = UsageParameters(dt.datetime(2001, 7, 1)).sql(spark, TM.inventory_tables(raw))
    plan = spark._jvm.PythonSQLUtils.explainString(usage._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


def test_reports_by_their_parameters(spark):
    raw = LazyTables(spark, SF)
    backlog = BacklogParameters(dt.date(1998, 1, 1), dt.date(2000, 12, 31)).run(TM.backlog_tables(raw))
    assert backlog.count() > 0
    assert LabelParameters(TM.SESSION).run(TM.label_tables(raw)).count() > 0
