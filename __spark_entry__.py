"""

``entry(spark)`` runs the flagship report (inventory usage by look-back
period) on sf0.001; ``queries()`` registers one callable per implemented
operator (SURVEY §2); ``oracle_sql()`` gives the DuckDB statement that
computes the same result from the same parquet tables.

Every query derives the ERP input contracts from the *whole* test tables
(``shopfloor.sources.testmap``) and runs a package operator on them; the
oracle derives the same inputs in SQL (``sqlcheck.mapping``) and runs the
report's own statement shape.  Computed doubles are rounded to 4 places on
both sides; nothing else is post-processed.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shopfloor.sources import testmap as TM  # noqa: E402
from shopfloor.sources.tables import LazyTables  # noqa: E402
from sqlcheck import queries as SQ  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
ROUND = 4


def _round_doubles(df: DataFrame) -> DataFrame:
    """Round every floating column to ``ROUND`` places (same on the oracle)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), ROUND).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# ------------------------------------------------------------------ OP3
def q_usage_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopfloor.plans.usage import usage_by_period

    t = TM.inventory_tables(LazyTables(spark, sf_dir))
    return _round_doubles(usage_by_period(t, TM.END_DATE, categories="1, 2, 3, 4, 5, 6"))


def q_usage_param_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-tolerant category list (duplicates, spaces) and a
    location parameter."""
    from shopfloor.plans.usage import usage_by_period

    t = TM.inventory_tables(LazyTables(spark, sf_dir))
    return _round_doubles(usage_by_period(t, TM.END_DATE, location="MAIN", categories=" 2, 5 ,2, 6"))


def q_usage_cost_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System cost method 2 (last cost) for parts without their own."""
    from shopfloor.plans.usage import usage_by_period

    t = TM.inventory_tables(LazyTables(spark, sf_dir))
    return _round_doubles(
        usage_by_period(t, TM.END_DATE, location="EAST", categories=None, system_cost_method=2)
    )


def q_usage_wip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIP tracking on -> average cost everywhere."""
    from shopfloor.plans.usage import usage_by_period

    t = TM.inventory_tables(LazyTables(spark, sf_dir))
    return _round_doubles(usage_by_period(t, TM.END_DATE, tracking_enabled=True))


# ------------------------------------------------------------------ OP4
def q_so_quantity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts at location MAIN: three stacked sources, SOQty <> 0."""
    from shopfloor.plans.demand import so_quantity_detail

    t = TM.demand_tables(LazyTables(spark, sf_dir))
    return _round_doubles(so_quantity_detail(t, location="MAIN"))


def q_so_quantity_all_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopfloor.plans.demand import so_quantity_detail

    t = TM.demand_tables(LazyTables(spark, sf_dir))
    return _round_doubles(so_quantity_detail(t))


# ------------------------------------------------------------------ OP1
def q_backlog_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order date (1995-01-01 .. 2001-08-01), no location."""
    from shopfloor.plans.backlog import backlog_snapshot

    t = TM.backlog_tables(LazyTables(spark, sf_dir))
    return _round_doubles(backlog_snapshot(t, "1995-01-01", "2001-08-01"))


def q_backlog_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 date range + F1/J6/T9 location filter through the employee."""
    from shopfloor.plans.backlog import backlog_snapshot

    t = TM.backlog_tables(LazyTables(spark, sf_dir))
    return _round_doubles(backlog_snapshot(t, TM.BACKLOG_START, TM.BACKLOG_END, location="MAIN"))


# ------------------------------------------------------------- OP6 / OP2
def q_workflow_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP6: route strings for every distinct label route."""
    from shopfloor.plans.labels import route_strings

    return route_strings(TM.label_tables(LazyTables(spark, sf_dir)))


def q_work_cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP2: labels of every session (112 report columns + SessionGUID)."""
    from shopfloor.plans.labels import work_cell_labels
    from shopfloor.sources.staging import Steps

    steps = Steps(spark)
    return _round_doubles(work_cell_labels(TM.label_tables(LazyTables(spark, sf_dir), steps.keep), store=steps))


# ------------------------------------------------------------------ OP5
def q_edge_post_lineal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP5: post-lamination edge lineal inches for every order-as-item."""
    from shopfloor.plans.edgework import post_edge_lineal

    t = TM.edge_tables(LazyTables(spark, sf_dir))
    return _round_doubles(post_edge_lineal(t["item_attributes"], t["item_group_codes"], t["item_options"]))


# ---------------------------------------------- fine-grained operator checks
def q_backlog_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT EXISTS relation of type 2 as a left anti join, all orders."""
    from shopfloor.operators.joins import without_relation

    t = TM.backlog_tables(LazyTables(spark, sf_dir))
    return without_relation(t["orders"].select("oKey", "OrderNumber"), t["order_relations"], 2)


def q_backlog_in_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 + K1 + T10: orders matched to open-order rows with multiplicity."""
    from shopfloor.operators.joins import open_order_multiplicity

    t = TM.backlog_tables(LazyTables(spark, sf_dir))
    joined = open_order_multiplicity(t["orders"].select("oKey", "OrderNumber"), t["orders_open"])
    return joined.select("oKey", "TargetShipDate", F.col("__open_rows").alias("OpenRows"))


def q_backlog_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + J5: counted lines per order, 0 for orders without one."""
    from shopfloor.operators.joins import line_counts

    t = TM.order_tables(LazyTables(spark, sf_dir))
    counts = line_counts(t["order_detail"])
    return (
        t["orders"]
        .select("oKey")
        .join(counts, "oKey", "left")
        .select("oKey", F.coalesce(F.col("__lines"), F.lit(0)).alias("LineItems"))
    )


def q_backlog_status_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 + C3: status names and credit-signed prices for every order."""
    from shopfloor.functions import signed_price, status_name

    t = TM.backlog_tables(LazyTables(spark, sf_dir))
    types = t["order_types"].select("OrderType", F.col("Description").alias("TypeDescription"))
    df = t["orders"].join(types, "OrderType")
    total = F.col("TotalPrice") * F.col("CurrencyMultiplier")
    return _round_doubles(
        df.select(
            "oKey",
            status_name("Status").alias("statusName"),
            signed_price(total, "TypeDescription").alias("ActualPrice"),
        )
    )


def _demand_branch(spark: SparkSession, sf_dir: str, branch: int) -> DataFrame:
    from shopfloor.functions import format_part
    from shopfloor.plans import demand as D

    t = TM.demand_tables(LazyTables(spark, sf_dir))
    if branch == 1:
        df = D.demand_from_view(t, None, None, "MAIN")
    else:
        df = D.demand_from_serialized(t, None, None, "MAIN").filter(F.col("branch") == branch)
    return _round_doubles(D._project(df, format_part, F.col("SOQty")))


def q_so_view_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 branch 1: demand through the on-order quantity view."""
    return _demand_branch(spark, sf_dir, 1)


def q_serialized_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 / J3 branch 2: SUM of issued serialized quantity per line."""
    return _demand_branch(spark, sf_dir, 2)


def q_serialized_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 / J3 branch 3: COUNT of secondary-issued serialized rows per line."""
    return _demand_branch(spark, sf_dir, 3)


def q_label_sequence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + X2: MIN sequence per key of the regular classes UNION remakes."""
    from shopfloor.plans.labels import label_sequence

    return label_sequence(TM.label_tables(LazyTables(spark, sf_dir))["opti_report_lites"], None)


def q_label_remake_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remake flag of every label-part key."""
    from shopfloor.operators.joins import flag_by_keys
    from shopfloor.plans.labels import PART_KEYS, REMAKE_CLASS, session_keys

    t = TM.label_tables(LazyTables(spark, sf_dir))
    keys = t["label_parts"].select(*PART_KEYS).distinct()
    return flag_by_keys(keys, session_keys(t["opti_report_lites"], None, [REMAKE_CLASS]), PART_KEYS, "Remake")


def q_label_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LITE and LOGO attributes of every label part ('' if absent)."""
    from shopfloor.operators.joins import attribute_pairs
    from shopfloor.plans.labels import ATTR_KEYS

    t = TM.label_tables(LazyTables(spark, sf_dir))
    df = t["label_parts"].select(*ATTR_KEYS).distinct()
    lite, logo = ("LITE", "ParamValue", "LiteNumber"), ("LOGO", "ParamValue2", "LogoAttribute")
    return attribute_pairs(df, t["order_detail_attributes"], ATTR_KEYS, lite, logo)


def q_label_lite_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 / J5 for one attribute alone."""
    from shopfloor.operators.joins import attribute_values
    from shopfloor.plans.labels import ATTR_KEYS

    t = TM.label_tables(LazyTables(spark, sf_dir))
    df = t["label_parts"].select(*ATTR_KEYS).distinct()
    return attribute_values(df, t["order_detail_attributes"], ATTR_KEYS, "LITE", "ParamValue", "LiteNumber")


def q_label_plan_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with at least one plan row (left semi join)."""
    from shopfloor.operators.joins import exists_in

    t = TM.label_tables(LazyTables(spark, sf_dir))
    return exists_in(t["order_detail"].select("odKey"), t["order_detail_plans"], ["odKey"])


def q_workflow_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work-flow items with list positions."""
    from shopfloor.operators.lists import split_positions

    t = TM.label_tables(LazyTables(spark, sf_dir))
    routes = t["label_parts"].select("odKey", "ParentKey", "WorkFlow").filter(F.col("WorkFlow").isNotNull())
    return split_positions(routes.distinct(), "WorkFlow").select(
        "odKey", "ParentKey", "WorkFlow", F.col("pos").cast("int").alias("pos"), "item"
    )


def q_workflow_stage_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 + A11 + C13: distinct MM-dd per stage via alias/identity match."""
    from shopfloor.plans.workflow import stage_dates

    t = TM.label_tables(LazyTables(spark, sf_dir))
    df = stage_dates(t["label_parts"], t["order_detail_plans"], t["work_cells"])
    return df.select(
        "odKey", "ParentKey", "WorkFlow", F.col("pos").cast("int").alias("pos"), "item",
        F.array_join("dates", " & ").alias("Dates"),
    )


def q_edge_layer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post / pre / sgp / layer error of every gated item."""
    from shopfloor.plans.edgework import gated_items

    t = TM.edge_tables(LazyTables(spark, sf_dir))
    df = gated_items(t["item_attributes"], t["item_group_codes"], t["item_options"]).filter(F.col("gate"))
    return df.select("item_id", F.col("lite").alias("Lite"), "post", "pre", "sgp", "layer_error")


def q_edge_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums of every item's whole edge string (P true)."""
    from shopfloor.operators.edge import with_edge_totals

    t = TM.edge_tables(LazyTables(spark, sf_dir))
    a = t["item_attributes"]
    ew = a.groupBy("item_id").agg(F.max(F.when(F.col("name") == "EW-STRAIGHT", F.col("value"))).alias("ew"))
    df = with_edge_totals(ew.withColumn("c", F.lit(True)).withColumn("s", F.lit(False)), "ew", "c", "s")
    return _round_doubles(
        df.select(
            "item_id",
            F.col("total").cast("double").alias("total"),
            F.col("prepost").cast("double").alias("prepost"),
            "token_error",
        )
    )


def q_label_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct staged key set per session and pass."""
    from shopfloor.plans.labels import PART_KEYS, REGULAR_CLASSES, REMAKE_CLASS, session_keys

    lites = TM.label_tables(LazyTables(spark, sf_dir))["opti_report_lites"]
    keys = session_keys(lites, None, [*REGULAR_CLASSES, REMAKE_CLASS])
    return keys.select(
        "SessionGUID", *PART_KEYS, (F.col("ProdType") == REMAKE_CLASS).alias("IsRemake")
    ).distinct()


def q_labels_one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP2 with the report's own parameter: the labels of one session."""
    from shopfloor.plans.labels import work_cell_labels
    from shopfloor.sources.staging import Steps

    steps = Steps(spark)
    tables = TM.label_tables(LazyTables(spark, sf_dir), steps.keep)
    return _round_doubles(work_cell_labels(tables, session=TM.SESSION, store=steps))


def q_so_quantity_one_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP4 with the report's own parameters: part, suffix and location."""
    from shopfloor.plans.demand import so_quantity_detail

    t = TM.demand_tables(LazyTables(spark, sf_dir))
    return _round_doubles(so_quantity_detail(t, part=TM.PART, suffix=TM.SUFFIXES[0], location="MAIN"))


def q_usage_subsecond_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an end instant with a fraction of a second, over movements moved by
    a fraction that depends on the order."""
    import datetime as dt

    from shopfloor.plans.usage import usage_by_period

    t = dict(TM.inventory_tables(LazyTables(spark, sf_dir)))
    part = F.make_dt_interval(secs=(F.col("InvTransID") % 1000 / F.lit(1000)).cast("decimal(8, 6)"))
    t["inventory_trans"] = t["inventory_trans"].withColumn("InvTransDate", F.col("InvTransDate") + part)
    return _round_doubles(usage_by_period(t, dt.datetime(2001, 7, 31, 0, 0, 0, 500_000)))


def q_usage_setting_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost method from the settings table and a stock
    multiplier for each part."""
    from shopfloor.plans.usage import usage_by_period

    tables = LazyTables(spark, sf_dir)
    t = dict(TM.inventory_tables(tables))
    t["general_setup"] = TM.general_setup(tables)
    t["part_multipliers"] = t["inventory"].select(
        "PartNo", "PartNoSuffix", F.when(F.col("CategoryID") <= 3, 2.0).otherwise(0.5).alias("multiplier")
    )
    return _round_doubles(usage_by_period(t, TM.END_DATE))


def q_backlog_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from a table of their own."""
    from shopfloor.plans.backlog import backlog_snapshot

    t = dict(TM.backlog_tables(LazyTables(spark, sf_dir)))
    t["order_prices"] = t["orders"].select("oKey", (F.col("TotalPrice") + F.lit(10.0)).alias("TotalPrice"))
    t["orders"] = t["orders"].drop("TotalPrice")
    return _round_doubles(backlog_snapshot(t, TM.BACKLOG_START, TM.BACKLOG_END))


def q_label_display_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortcut's description, else the part's."""
    from shopfloor.functions.columns import display_description

    t = TM.label_tables(LazyTables(spark, sf_dir))
    sc = t["shortcuts"].select("odKey", "ShortcutDesc")
    df = t["label_parts"].select("odKey", "OverallPartDesc").join(sc, "odKey", "left")
    return df.select("odKey", display_description().alias("DisplayDesc")).distinct()


def q_backlog_subtotal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: Subtotal only where no invoice amount exists, every order."""
    from shopfloor.functions.columns import uninvoiced

    t = TM.backlog_tables(LazyTables(spark, sf_dir))
    df = t["orders"].select("oKey").join(t["order_facts"].select("oKey", "InvoiceAmount", "Subtotal"), "oKey", "left")
    return _round_doubles(df.select("oKey", "InvoiceAmount", uninvoiced("Subtotal").alias("Subtotal")))


# ---------------------------- contracts, exact decimals, case-blind codes
def _exact_text(df: DataFrame) -> DataFrame:
    """Decimals as text, digit by digit: nothing is rounded on the way to the
    comparison."""
    return df.select(
        *[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def q_usage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A6, C18 on decimal(18,4) quantities, decimal(19,4) costs and
    decimal(18,6) multipliers, unrounded."""
    from shopfloor.plans.usage import usage_by_period
    from shopfloor.sources.contracts import load

    t = dict(TM.inventory_tables(LazyTables(spark, sf_dir)))
    half = F.when(F.col("CategoryID") <= 3, 2.0).otherwise(0.5)
    t["part_multipliers"] = t["inventory"].select("PartNo", "PartNoSuffix", half.alias("multiplier"))
    return _exact_text(usage_by_period(load(t).tables, TM.END_DATE, system_cost_method=1))


def q_usage_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U:75-77 on movements and lines that carry their month: only the
    window's months meet."""
    from shopfloor.plans.usage import usage_by_period
    from shopfloor.sources.layout import with_month

    t = dict(TM.inventory_tables(LazyTables(spark, sf_dir)))
    t["inventory_trans"], t["inventory_trans_detail"] = with_month(t["inventory_trans"], t["inventory_trans_detail"])
    return _round_doubles(usage_by_period(t, "2000-03-15 12:00:00", days=(10, 45)))


def q_usage_sql_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage report as SQL with named arguments, from the texts of a
    report form; one of them is NULL."""
    from shopfloor.params import UsageParameters

    asked = UsageParameters.from_text(end=TM.END_DATE, location="NULL", categories=" 2, 5 ,2, 6", system_cost_method="2")
    return _round_doubles(asked.sql(spark, TM.inventory_tables(LazyTables(spark, sf_dir))))


def q_so_quantity_sql_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand report as SQL with named arguments, two of them NULL."""
    from shopfloor.params import DemandParameters

    asked = DemandParameters(location="EAST")
    return _round_doubles(asked.sql(spark, TM.demand_tables(LazyTables(spark, sf_dir))))


def q_usage_catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of another database, by qualified names."""
    from shopfloor.plans.usage import usage_by_period
    from shopfloor.sources.tables import catalog_tables

    for name, df in TM.inventory_tables(LazyTables(spark, sf_dir)).items():
        df.createOrReplaceGlobalTempView(f"erp_{name}")
    names = {n: f"global_temp.erp_{n}" for n in ("inventory_trans", "inventory_trans_detail", "inventory", "inventory_detail", "locations", "culture_currencies", "master_part_list", "categories")}
    return _round_doubles(usage_by_period(catalog_tables(spark, names), TM.END_DATE, location="EAST"))


def q_so_quantity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, X1 on decimal(18,4): the view's quantity, a SUM and a COUNT in one
    column, unrounded."""
    from shopfloor.plans.demand import so_quantity_detail
    from shopfloor.sources.contracts import load

    t = TM.demand_tables(LazyTables(spark, sf_dir))
    return _exact_text(so_quantity_detail(load(t).tables))


def q_backlog_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, C18 on decimal(19,4) prices times decimal(18,6) rates, unrounded."""
    from shopfloor.plans.backlog import backlog_snapshot
    from shopfloor.sources.contracts import load

    t = load(TM.backlog_tables(LazyTables(spark, sf_dir))).tables
    return _exact_text(backlog_snapshot(t, "1995-01-01", "2001-08-01"))


def _backlog_of_texts(spark: SparkSession, sf_dir: str):
    from shopfloor.sources.contracts import load

    t = dict(TM.backlog_tables(LazyTables(spark, sf_dir)))
    t["orders"] = TM.text_orders(t["orders"])
    return load(t)


def q_backlog_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts, held to their contract; rows with a value that is
    none of its column, or without a key, do not reach the report."""
    from shopfloor.plans.backlog import backlog_snapshot

    return _exact_text(backlog_snapshot(_backlog_of_texts(spark, sf_dir).tables, TM.BACKLOG_START, TM.BACKLOG_END))


def q_orders_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that were rejected, and why."""
    rejected = _backlog_of_texts(spark, sf_dir).rejected
    return rejected.select(
        "table", F.get_json_object("row", "$.OrderNumber").alias("OrderNumber"), F.array_join("reasons", "; ").alias("reasons")
    )


def q_backlog_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collation and GUID case: other spellings of customers, employees, order
    numbers, GUIDs and the location parameter meet all the same."""
    from shopfloor.plans.backlog import backlog_snapshot
    from shopfloor.sources.contracts import load, plain_text

    t = load(TM.mixed_case(TM.backlog_tables(LazyTables(spark, sf_dir))), exact=False, nocase=True).tables
    return _round_doubles(plain_text(backlog_snapshot(t, TM.BACKLOG_START, TM.BACKLOG_END, location="main")))


def q_labels_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collation and GUID case in the label report: cell ``Cutting`` meets the
    stage CUT, attribute ``lite`` is LITE, session ``{s1}`` is S1."""
    from shopfloor.plans.labels import work_cell_labels
    from shopfloor.sources.contracts import load, plain_text
    from shopfloor.sources.staging import Steps

    steps = Steps(spark)
    t = load(TM.mixed_case(TM.label_tables(LazyTables(spark, sf_dir), steps.keep)), exact=False, nocase=True).tables
    return _round_doubles(plain_text(work_cell_labels(t, session=TM.SESSION, store=steps)))


def q_usage_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collation in the usage report: part numbers, locations and cultures."""
    from shopfloor.plans.usage import usage_by_period
    from shopfloor.sources.contracts import load, plain_text

    t = load(TM.mixed_case(TM.inventory_tables(LazyTables(spark, sf_dir))), exact=False, nocase=True).tables
    return _round_doubles(plain_text(usage_by_period(t, TM.END_DATE, location="main", categories=" 2, 5 ,2, 6")))


def q_backlog_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the open orders of one category, from the other source."""
    from shopfloor.plans.backlog import backlog_snapshot

    t = dict(TM.backlog_tables(LazyTables(spark, sf_dir)))
    t["orders_open_by_category"] = TM.open_orders_by_category(t.pop("orders_open"))
    return _round_doubles(backlog_snapshot(t, TM.BACKLOG_START, TM.BACKLOG_END, category=TM.CATEGORY))


def q_backlog_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order types in another language, as they are where there is no
    translation; the sign of credits is told by the untranslated text."""
    from shopfloor.plans.backlog import backlog_snapshot

    t = {**TM.backlog_tables(LazyTables(spark, sf_dir)), "translations": TM.translations(spark)}
    return _round_doubles(backlog_snapshot(t, TM.BACKLOG_START, TM.BACKLOG_END, order_types=(1, 3, 4)))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "usage_by_period": q_usage_by_period,
    "usage_param_list": q_usage_param_list,
    "usage_cost_method": q_usage_cost_method,
    "usage_wip_tracking": q_usage_wip_tracking,
    "so_quantity_detail": q_so_quantity_detail,
    "so_quantity_all_locations": q_so_quantity_all_locations,
    "backlog_snapshot": q_backlog_snapshot,
    "backlog_location": q_backlog_location,
    "workflow_render": q_workflow_render,
    "work_cell_labels": q_work_cell_labels,
    "edge_post_lineal": q_edge_post_lineal,
    "backlog_not_exists": q_backlog_not_exists,
    "backlog_in_open": q_backlog_in_open,
    "backlog_line_count": q_backlog_line_count,
    "backlog_status_credit": q_backlog_status_credit,
    "so_view_branch": q_so_view_branch,
    "serialized_sum": q_serialized_sum,
    "serialized_count": q_serialized_count,
    "label_sequence_union": q_label_sequence_union,
    "label_remake_flag": q_label_remake_flag,
    "label_attributes": q_label_attributes,
    "label_plan_exists": q_label_plan_exists,
    "workflow_split": q_workflow_split,
    "workflow_stage_dates": q_workflow_stage_dates,
    "edge_layer_flags": q_edge_layer_flags,
    "edge_token_totals": q_edge_token_totals,
    "label_key_set": q_label_key_set,
    "labels_one_session": q_labels_one_session,
    "so_quantity_one_part": q_so_quantity_one_part,
    "usage_subsecond_end": q_usage_subsecond_end,
    "usage_setting_multiplier": q_usage_setting_multiplier,
    "backlog_price_table": q_backlog_price_table,
    "label_display_desc": q_label_display_desc,
    "backlog_subtotal_fallback": q_backlog_subtotal_fallback,
    "label_lite_attribute": q_label_lite_attribute,
    "usage_exact": q_usage_exact,
    "usage_months": q_usage_months,
    "usage_sql_face": q_usage_sql_face,
    "so_quantity_sql_face": q_so_quantity_sql_face,
    "usage_catalog_names": q_usage_catalog_names,
    "so_quantity_exact": q_so_quantity_exact,
    "backlog_exact": q_backlog_exact,
    "backlog_from_text": q_backlog_from_text,
    "orders_rejected": q_orders_rejected,
    "backlog_nocase": q_backlog_nocase,
    "labels_nocase": q_labels_nocase,
    "usage_nocase": q_usage_nocase,
    "backlog_by_category": q_backlog_by_category,
    "backlog_translated": q_backlog_translated,
}

_ORACLE: dict[str, str] = {
    "usage_by_period": SQ.usage_sql(),
    "usage_param_list": SQ.usage_sql(location="MAIN", categories=(2, 5, 6)),
    "usage_cost_method": SQ.usage_sql(location="EAST", system_method=2),
    "usage_wip_tracking": SQ.usage_sql(tracking=True),
    "so_quantity_detail": SQ.demand_sql(location="MAIN"),
    "so_quantity_all_locations": SQ.demand_sql(location=None),
    "backlog_snapshot": SQ.backlog_sql("1995-01-01", "2001-08-01"),
    "backlog_location": SQ.backlog_sql("1998-01-01", "2000-12-31", location="MAIN"),
    "workflow_render": SQ.routes_sql(),
    "work_cell_labels": SQ.labels_sql(),
    "edge_post_lineal": SQ.edge_sql(),
    "backlog_not_exists": SQ.backlog_not_exists_sql(),
    "backlog_in_open": SQ.backlog_in_open_sql(),
    "backlog_line_count": SQ.backlog_line_count_sql(),
    "backlog_status_credit": SQ.backlog_status_credit_sql(),
    "so_view_branch": SQ.demand_branch_sql(1),
    "serialized_sum": SQ.demand_branch_sql(2),
    "serialized_count": SQ.demand_branch_sql(3),
    "label_sequence_union": SQ.label_sequence_sql(),
    "label_remake_flag": SQ.label_remake_flag_sql(),
    "label_attributes": SQ.label_attributes_sql(),
    "label_plan_exists": SQ.label_plan_exists_sql(),
    "workflow_split": SQ.workflow_split_sql(),
    "workflow_stage_dates": SQ.workflow_stage_dates_sql(),
    "edge_layer_flags": SQ.edge_layer_flags_sql(),
    "edge_token_totals": SQ.edge_token_totals_sql(),
    "label_key_set": SQ.label_key_set_sql(),
    "labels_one_session": SQ.labels_sql(session=TM.SESSION),
    "so_quantity_one_part": SQ.demand_sql(part=TM.PART, suffix=TM.SUFFIXES[0], location="MAIN"),
    "usage_subsecond_end": SQ.usage_sql(
        end="TIMESTAMP '2001-07-31 00:00:00.5'",
        when="InvTransDate + to_milliseconds(InvTransID % 1000)",
    ),
    "usage_setting_multiplier": SQ.usage_sql(system_method=1, multiplier="if(CategoryID <= 3, 2.0::DOUBLE, 0.5::DOUBLE)"),
    "backlog_price_table": SQ.backlog_sql("1998-01-01", "2000-12-31", price="(TotalPrice + 10.0::DOUBLE)"),
    "label_display_desc": SQ.label_display_desc_sql(),
    "backlog_subtotal_fallback": SQ.backlog_subtotal_fallback_sql(),
    "label_lite_attribute": SQ.label_lite_sql(),
    "usage_exact": SQ.usage_sql(system_method=1, multiplier="if(CategoryID <= 3, 2.0, 0.5)", exact=True),
    "usage_months": SQ.usage_sql(end="TIMESTAMP '2000-03-15 12:00:00'", windows=(10, 45)),
    "usage_sql_face": SQ.usage_sql(categories=(2, 5, 6), system_method=2),
    "so_quantity_sql_face": SQ.demand_sql(location="EAST"),
    "usage_catalog_names": SQ.usage_sql(location="EAST"),
    "so_quantity_exact": SQ.demand_sql(location=None, exact=True),
    "backlog_exact": SQ.backlog_sql("1995-01-01", "2001-08-01", exact=True),
    "backlog_from_text": SQ.backlog_sql("1998-01-01", "2000-12-31", exact=True, only=SQ.READABLE_ORDERS),
    "orders_rejected": SQ.orders_rejected_sql(),
    "backlog_nocase": SQ.backlog_sql("1998-01-01", "2000-12-31", location="MAIN"),
    "labels_nocase": SQ.labels_sql(session=TM.SESSION),
    "usage_nocase": SQ.usage_sql(location="MAIN", categories=(2, 5, 6)),
    "backlog_by_category": SQ.backlog_sql(
        "1998-01-01", "2000-12-31", waiting=f"substr(OrderNumber, 3)::BIGINT % 4 = {TM.CATEGORY}"
    ),
    "backlog_translated": SQ.backlog_sql("1998-01-01", "2000-12-31", words=TM.TRANSLATIONS, types=(1, 3, 4)),
}


def entry(spark: SparkSession) -> DataFrame:
    return q_usage_by_period(spark, SMOKE_DIR)


def _importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with this folder on the import path of the Python workers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment, here = spark.sparkContext.environment, os.path.dirname(os.path.abspath(__file__))
        paths = environment.get("PYTHONPATH", "").split(os.pathsep)
        if here not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
        return query(spark, sf_dir)

    return run


# --------------------------------------------- training-text operators
# Present only where their subpackage is; nothing else in the library needs it.
try:
    import corpus_pipeline
    from shopfloor.llm import oracle as _llm_oracle
    from shopfloor.llm import queries as _llm_queries
except ModuleNotFoundError as absent:
    # only the subpackage itself may be absent, not what it needs
    if absent.name not in ("corpus_pipeline", "shopfloor.llm", "shopfloor.llm.oracle", "shopfloor.llm.queries"):
        raise
else:
    _QUERIES.update({k: _importable(q) for k, q in {**_llm_queries.QUERIES, "pipeline": corpus_pipeline.run}.items()})
    _ORACLE.update(_llm_oracle.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        _ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
