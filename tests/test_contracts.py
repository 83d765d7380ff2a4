"""Injectable inputs: price table (D1), cost multiplier (D5), the
CostingMethod setting (S7) and the elided per-order frames (A12)."""

import datetime as dt

import pytest

from shopfloor.plans.backlog import backlog_snapshot
from shopfloor.plans.usage import usage_by_period
from tests.test_demand_backlog import _backlog_tables, _line, _order
from tests.test_usage import END, _tables


def test_usage_multiplier_and_setting(spark):
    d = END - dt.timedelta(days=5)
    t = _tables(
        spark, [(1, d, "MAIN")], [(1, "A", -2.0)], [("A", None, 1)], [("A", "MAIN", 1.0, 3.0, 7.0)]
    )
    t["general_setup"] = spark.createDataFrame([("CostingMethod", "1")], "Parameter string, Value string")
    t["part_multipliers"] = spark.createDataFrame([("A", "0000", 10.0)], "PartNo string, PartNoSuffix string, multiplier double")
    row = usage_by_period(t, END).first()
    assert row["CurrentCost"] == 3.0  # NULL cost method -> setting 1 -> average cost
    assert row["30 Days Total Cost"] == pytest.approx(60.0)  # 3 * 10 * 2
    t.pop("general_setup")
    assert usage_by_period(t, END).first()["CurrentCost"] == 1.0  # default 0 -> standard cost


def test_backlog_price_table_and_facts(spark):
    day = dt.datetime(2024, 5, 1)
    t = _backlog_tables(spark, [_order(1, day, mult=2.0), _order(2, day)], [_line(11, 1)],
                        [("SO1", dt.date(2024, 6, 1)), ("SO2", dt.date(2024, 6, 1))])
    t["order_prices"] = spark.createDataFrame([(1, 7.5)], "oKey long, TotalPrice double")
    t["order_facts"] = [
        spark.createDataFrame([(1, 3.0, "OPEN")], "oKey long, IncQuantity double, Status string"),
        spark.createDataFrame([(1, None, 99.0), (2, 5.0, 42.0)], "oKey long, InvoiceAmount double, Subtotal double"),
    ]
    t["orders"] = t["orders"].drop("TotalPrice")
    out = {r["oKey"]: r for r in backlog_snapshot(t, "2024-05-01", "2024-05-01").collect()}
    assert out[1]["TotalPrice"] == 15.0 and out[2]["TotalPrice"] is None
    assert out[1]["TotalIncQuantity"] == 3.0 and out[1]["CurrentStatus"] == "OPEN"
    assert out[1]["Subtotal"] == 99.0  # no invoice -> subtotal (C4)
    assert out[2]["Subtotal"] is None and out[2]["InvoiceAmount"] == 5.0
    assert out[1]["UOM"] is None  # absent fact columns are NULL


def _final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Contract tables as files, so that plans hold the reports' own joins and
    not the fixture's, and without broadcasts: sides too big for them."""
    from shopfloor.sources import testmap as TM
    from shopfloor.sources.tables import LazyTables

    raw = LazyTables(spark, "/root/testdata/sf0.001")
    folder, out = tmp_path_factory.mktemp("contracts"), {}
    for report, tables in (("labels", TM.label_tables(raw)), ("backlog", TM.backlog_tables(raw)), ("demand", TM.demand_tables(raw))):
        out[report] = {}
        for name, df in tables.items():
            path = f"file://{folder}/{report}/{name}"
            df.write.parquet(path)
            out[report][name] = spark.read.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield out
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_label_plan(spark, written):
    from shopfloor.plans.labels import work_cell_labels
    from shopfloor.sources import testmap as TM
    from shopfloor.sources.staging import Stage

    whole = work_cell_labels(written["labels"], session=TM.SESSION)
    plan = _final_plan(whole)
    assert plan.count("Exchange hashpartitioning") <= 23 and plan.count("FileScan") <= 12
    with Stage(spark) as stage:
        staged = work_cell_labels(written["labels"], session=TM.SESSION, stage=stage.keep)
        plan = _final_plan(staged)
        # the key set was made once, before; the attributes are read once
        assert plan.count("Exchange hashpartitioning") <= 19 and "SessionGUID#" not in plan
        assert plan.count("ParamText") and len([x for x in plan.split("FileScan")[1:] if "ParamValue2" in x.split("\n")[0]]) == 1
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert sorted(map(repr, staged.collect())) == sorted(map(repr, whole.collect()))
        folder = stage.folder
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_staging_needs_a_shared_folder():
    from types import SimpleNamespace

    from shopfloor.sources.staging import Stage

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Stage(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default)))


def test_backlog_plan(written):
    plan = _final_plan(backlog_snapshot(written["backlog"], "1995-01-01", "2001-08-01"))
    # every table is read once, but for the two roles of customers and employees
    assert plan.count("FileScan") <= 10 and plan.count("Exchange hashpartitioning") <= 18
    assert len([x for x in plan.split("FileScan")[1:] if "OrderContact" in x.split("\n")[0]]) == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_demand_plan_and_orders_of_results(written):
    from shopfloor.plans.demand import so_quantity_detail
    from shopfloor.sources import testmap as TM

    demand = so_quantity_detail(written["demand"], part=TM.PART, suffix="0000", location="MAIN")
    plan = _final_plan(demand)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    days = [r["PlanDate"] for r in so_quantity_detail(written["demand"]).collect()]  # O4
    assert len(days) > 100 and days == sorted(days)
    dates = [r["Date"] for r in backlog_snapshot(written["backlog"], "1995-01-01", "2001-08-01").collect()]  # O1
    assert len(dates) > 100 and dates == sorted(dates)
