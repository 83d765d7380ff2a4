"""Typed contracts, rejected rows, exact decimals, case-blind codes and the one
pass over two attributes."""

import datetime as dt
import decimal
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions import money
from shopfloor.operators.joins import attribute_pairs
from shopfloor.plans.backlog import backlog_snapshot
from shopfloor.plans.demand import so_quantity_detail
from shopfloor.plans.edgework import post_edge_lineal
from shopfloor.plans.labels import work_cell_labels
from shopfloor.plans.usage import usage_by_period
from shopfloor.plans.workflow import plan_date_workflow
from shopfloor.sources import testmap as TM
from shopfloor.sources.contracts import CASE_BLIND, ContractError, contracted, load, rejected_rows
from shopfloor.sources.schemas import CONTRACTS, KEYS, REPORT_INPUTS
from shopfloor.sources.tables import LazyTables
from tests.conftest import plan_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reports(spark):
    raw = LazyTables(spark, SF)
    return {
        "usage": (TM.inventory_tables(raw), lambda t: usage_by_period(t, TM.END_DATE), "inventory_trans_detail", "QuantityOnHandAdj"),
        "demand": (TM.demand_tables(raw), lambda t: so_quantity_detail(t), "inventory_results", "TotalQty"),
        "backlog": (TM.backlog_tables(raw), lambda t: backlog_snapshot(t, "1995-01-01", "2001-08-01"), "orders", "Status"),
        "labels": (TM.label_tables(raw), lambda t: work_cell_labels(t, session=TM.SESSION), "opti_report_lites", "Sequence"),
        "edge": (TM.edge_tables(raw), lambda t: post_edge_lineal(*t.values()), "item_attributes", "item_id"),
    }


def test_contracts_cover_every_input():
    for tables in REPORT_INPUTS.values():
        for table, columns in tables.items():
            assert {c.rstrip("?*") for c in columns.split()} <= set(CONTRACTS[table].names)
    assert all(set(k) <= set(CONTRACTS[t].names) for t, k in KEYS.items())


@pytest.mark.parametrize("report", ["usage", "demand", "backlog", "labels", "edge"])
def test_a_missing_column_is_named(reports, report):
    tables, run, table, column = reports[report]
    with pytest.raises(ContractError, match=f"{table} lacks {column}"):
        run({**tables, table: tables[table].drop(column)})
    if report != "edge":
        with pytest.raises(ContractError, match=table):
            run({k: v for k, v in tables.items() if k != table})


@pytest.mark.parametrize("report", ["usage", "demand", "backlog", "labels", "edge"])
def test_a_wrong_type_is_converted_and_bad_values_rejected(spark, reports, report):
    """The column as text gives the report of the rows that can be read; the
    others are told."""
    tables, run, table, column = reports[report]
    bad = F.crc32(F.to_json(F.struct(column)).cast("binary")) % 5 == 0
    text = tables[table].withColumn(column, F.when(bad, "? ").otherwise(F.concat(F.lit(" "), F.col(column).cast("string"))))
    got, wanted = run({**tables, table: text}), run({**tables, table: tables[table].filter(~bad)})
    round_ = lambda df: sorted(
        repr([round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v for v in r]) for r in df.collect()
    )
    assert round_(got) == round_(wanted)
    told = rejected_rows({**tables, table: text}, report).collect()
    assert len(told) == tables[table].filter(bad).count() > 0
    kind = CONTRACTS[table][column].dataType.simpleString()
    assert {(r["table"], tuple(r["reasons"])) for r in told} == {(table, (f"{column} is no {kind}",))}
    assert rejected_rows(tables, report).count() == 0


def test_frames_that_fit_are_plain_selections(reports):
    for report, (tables, *_) in reports.items():
        optional = ("general_setup", "part_multipliers", "order_prices", "translations", "orders_open_by_category")
        for name, df in contracted(tables, report, optional).items():
            assert "try_cast" not in df._jdf.queryExecution().optimizedPlan().toString().lower() or report == "edge", (report, name)


def test_load_types_keys_and_guids(spark):
    orders = spark.createDataFrame(
        [("1", "SO1", "{ab}", "", "12.5"), ("x", "SO2", "AB ", "2024-01-01", "1"), (None, "SO3", None, None, None), ("4", "SO4", "ab", "2024-13-01", "1e40")],
        "oKey string, OrderNumber string, ProjectGUID string, ClosedDate string, TaxAmount string",
    )
    got = load({"orders": orders})
    # in the contract's order
    assert got.tables["orders"].dtypes == [
        ("oKey", "bigint"), ("OrderNumber", "string"), ("ProjectGUID", "string"), ("TaxAmount", "decimal(19,4)"), ("ClosedDate", "timestamp_ntz"),
    ]
    row = got.tables["orders"].collect()
    assert [(r["oKey"], r["ProjectGUID"], r["ClosedDate"], r["TaxAmount"]) for r in row] == [(1, "AB", dt.datetime(1900, 1, 1), decimal.Decimal("12.5000"))]
    told = {r["row"][:30].split("SO")[1][0]: r["reasons"] for r in got.rejected.collect()}
    assert told == {"2": ["oKey is no bigint"], "3": ["oKey is null"], "4": ["TaxAmount is no decimal(19,4)", "ClosedDate is no timestamp_ntz"]}
    with pytest.raises(ContractError):
        load({"orders": orders.drop("oKey")})
    assert load({"orders": orders.limit(0)}).tables["orders"].count() == 0


# ------------------------------------------------------------------ decimals
def test_decimal_rules():
    d = T.DecimalType
    assert money.sum_type(d(18, 4)) == d(38, 4) and money.sum_type(T.DoubleType()) == T.DoubleType()
    assert money.product_type(d(19, 4), d(18, 6)) == d(38, 10)
    assert money.product_type(d(38, 10), d(18, 4)) == d(38, 6)
    assert money.product_type(d(10, 2), T.IntegerType()) == d(21, 2)
    assert money.product_type(d(10, 2), T.DoubleType()) == T.DoubleType()
    assert money.union_type(d(18, 4), d(38, 4)) == d(38, 4) and money.union_type(d(18, 2), T.LongType()) == d(22, 2)
    assert money.union_type(d(38, 0), d(20, 10)) == d(38, 6)
    assert money.union_type(T.LongType(), T.IntegerType()) == T.LongType()


def test_sums_and_products_are_exact_in_either_precision_mode(spark):
    rows = [(decimal.Decimal("99999999999999.9999"), decimal.Decimal("0.333333"))] * 50 + [(None, None), (decimal.Decimal("-0.0001"), decimal.Decimal("-2"))]
    df = spark.createDataFrame(rows, "a decimal(18,4), b decimal(18,6)")
    old = spark.conf.get("spark.sql.decimalOperations.allowPrecisionLoss")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", mode)
            out = df.agg(money.total(df, "a").alias("s"))
            assert out.schema["s"].dataType == T.DecimalType(38, 4)
            assert out.first()["s"] == sum(r[0] for r in rows if r[0] is not None)
            prod = df.select(money.product(df, "a", "b").alias("p"))
            assert prod.schema["p"].dataType == T.DecimalType(37, 10)
            assert [r["p"] for r in prod.collect()] == [None if a is None else a * b for a, b in rows]
    finally:
        spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", old)


def test_usage_in_decimals_by_hand(spark):
    from tests.test_usage import END, _tables

    d = lambda n: END - dt.timedelta(days=n)
    t = _tables(
        spark, [(1, d(1), "MAIN"), (2, d(50), "MAIN"), (3, d(80), "MAIN")],
        [(1, "A", -0.1), (2, "A", -0.2), (3, "A", 0.3)], [("A", 0, 1)], [("A", "MAIN", 0.0333, 1.0, 1.0)],
    )
    row = usage_by_period(load(t).tables, END).first()
    dec = decimal.Decimal
    assert (row["30 Days Quantity"], row["60 Days Quantity"], row["90 Days Quantity"]) == (dec("0.1"), dec("0.2"), dec("0.2"))
    assert row["60 Days Total Cost"] == dec("0.00666") and row["CurrentCost"] == dec("0.0333")
    assert isinstance(row["30 Days Total Cost"], dec)


# ---------------------------------------------------------------- case-blind
def test_cells_meet_stages_whatever_their_case(spark):
    cells = load({"work_cells": spark.createDataFrame([(1, "Cutting "), (2, "tEmp"), (3, "boxing-qc")], "ID int, Description string")}, nocase=True)
    cells = cells.tables["work_cells"]
    routes = spark.createDataFrame([(1, 0, "cut,Temp , BOXING"), (2, 0, "CUTTING")], "odKey long, ParentKey int, WorkFlow string")
    plans = spark.createDataFrame(
        [(1, 0, 1, dt.date(2024, 5, 1)), (1, 0, 2, dt.date(2024, 5, 2)), (1, 0, 3, dt.date(2024, 5, 3)), (2, 0, 1, dt.date(2024, 6, 1))],
        "odKey long, ParentKey int, WorkCellID int, PlanDate date",
    )
    out = plan_date_workflow(routes, plans, cells)
    assert {r["odKey"]: r["PlanDateWorkflow"] for r in out.collect()} == {
        1: "cut ( 05-01), Temp ( 05-02), BOXING ( 05-03)", 2: "CUTTING ( 06-01)",
    }
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_text(plan_date_workflow(routes, plans, cells))
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "collationkey(description" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plain = cells.withColumn("Description", F.col("Description").cast("string"))
    assert plan_date_workflow(routes, plans, plain).count() == 0


def test_case_blind_reports_keep_equi_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = load(TM.mixed_case(TM.backlog_tables(LazyTables(spark, SF))), exact=False, nocase=True).tables
        assert t["customers"].schema["CustomerID"].dataType == T.StringType(CASE_BLIND)
        plan = plan_text(backlog_snapshot(t, TM.BACKLOG_START, TM.BACKLOG_END, location="main"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "collationkey(CustomerID" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ---------------------------------------------------------------- attributes
def test_pairs_of_two_attributes_equal_two_joins(spark):
    rng = random.Random(7)
    values = [None, "", "a", "b", "c"]
    eav = [(rng.randrange(12), rng.choice(["LITE", "LOGO", "COLOR", None]), rng.choice(values), rng.choice(values)) for _ in range(80)]
    eav += [(None, "LITE", "x", "y"), (50, "LITE", "z", None)]
    eav += [(60, "LITE", f"v{k % 7}", None) for k in range(20)] + [(60, "LOGO", None, f"w{k}") for k in range(9)]
    keys = [(k,) for k in [*range(14), 60, None, 3]]
    df = spark.createDataFrame(keys, "k long")
    e = spark.createDataFrame(eav, "k long, ParamText string, ParamValue string, ParamValue2 string")

    def listed(name, at):
        return lambda k: {r[at] or "" for r in eav if r[1] == name and r[0] == k and k is not None} or {""}

    for one, two in ((("LITE", 2), ("LOGO", 3)), (("LITE", 2), ("LITE", 3)), (("NONE", 2), ("LOGO", 3))):
        got = attribute_pairs(df, e, ["k"], (one[0], "ParamValue", "x"), (two[0], "ParamValue2", "y"))
        wanted = sorted(
            ((k, x, y) for (k,) in set(keys) for x, y in itertools.product(listed(*one)(k), listed(*two)(k))), key=repr
        )
        assert sorted({tuple(r) for r in got.collect()}, key=repr) == wanted
    plan = plan_text(attribute_pairs(df, e, ["k"], ("LITE", "ParamValue", "x"), ("LOGO", "ParamValue2", "y")))
    assert plan.count("Exchange hashpartitioning(k#") <= 2  # the attributes once, the rows once


# ------------------------------------------------------------ S3 and D2
def test_open_orders_of_a_category_and_translations(spark):
    t = dict(TM.backlog_tables(LazyTables(spark, SF)))
    run = lambda tables, **more: backlog_snapshot(tables, "1995-01-01", "2001-08-01", **more)
    whole = run(t).count()
    by = {**t, "orders_open_by_category": TM.open_orders_by_category(t["orders_open"])}
    del by["orders_open"]
    with pytest.raises(ContractError, match="orders_open"):
        run(by)
    zero = run(t).filter(F.substring("OrderNumber", 3, 9).cast("long") % 4 == 0).count()
    assert sum(run(by, category=c).count() for c in (1, 2, 3)) == whole - zero
    shown = run({**t, "translations": TM.translations(spark)}).select("OrderType", "TotalPrice", "ActualPrice").collect()
    assert {r["OrderType"] for r in shown} == {"Verkauf", "Gutschrift"}
    assert all((r["ActualPrice"] < 0) == (r["OrderType"] == "Gutschrift") for r in shown)
