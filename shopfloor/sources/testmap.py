"""Derive the ERP input contracts from the driver's TPC-H-shaped test tables.

The test data has no ERP tables, so every contract table is *derived* from
``orders``, ``lineitem``, ``part``, ``customer`` and ``supplier`` with plain
column expressions (no sampling, no row caps: every derived table grows with
its source).  The DuckDB oracle (``sqlcheck/mapping.py``) derives the same
tables with the same rules, so both sides of the correctness check run the
report on identical inputs.

Mapping rules are fixed values of the test fixture, listed together here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---------------------------------------------------------------------------
# Fixed values of the test mapping.
END_DATE = "2001-08-01 00:00:00"  # usage report end instant (last order date)
BACKLOG_START = "1998-01-01"
BACKLOG_END = "2000-12-31"
SESSION = "S1"  # one of the label sessions
PART = "P3"  # one of the parts
SUFFIXES = ("0000", "0001")  # every part exists with two suffixes
# (LocationID, CurrencyCulture, cost offset)
LOCATIONS = (("MAIN", "en-US", 0.0), ("EAST", "en-CA", 10.0))
# part type -> category id
CATEGORIES = (
    (1, "ECONOMY"),
    (2, "LARGE"),
    (3, "MEDIUM"),
    (4, "PROMO"),
    (5, "SMALL"),
    (6, "STANDARD"),
)
# order type id -> description
ORDER_TYPES = ((1, "Sales"), (2, "Quote"), (3, "Credit"), (4, "Service"))
# order priority -> order type id
PRIORITY_ORDER_TYPE = (
    ("1-URGENT", 1),
    ("2-HIGH", 1),
    ("3-MEDIUM", 4),
    ("4-NOT SPECIFIED", 2),
    ("5-LOW", 3),
)
# ---------------------------------------------------------------------------


def _case(col: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _part_no(key: str) -> Column:
    return F.concat(F.lit("P"), F.col(key).cast("string"))


def _line_suffix() -> Column:
    return F.when(F.col("l_linestatus") == "O", F.lit(SUFFIXES[0])).otherwise(F.lit(SUFFIXES[1]))


def _literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small fixed table as a SQL VALUES relation: a LocalRelation whose
    size the optimizer knows, so joins against it broadcast statically."""
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]

    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS {t})"

    values = ", ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


# ---------------------------------------------------------------- inventory
def inventory_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Contracts of the usage report (OP3)."""
    orders, lineitem, part = raw["orders"], raw["lineitem"], raw["part"]
    spark = orders.sparkSession

    trans = orders.select(
        F.col("o_orderkey").alias("InvTransID"),
        F.col("o_orderdate").alias("InvTransDate"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("EAST"))
        .otherwise(F.lit("MAIN"))
        .alias("LocationID"),
    )
    detail = lineitem.select(
        F.col("l_orderkey").alias("InvTransID"),
        _part_no("l_partkey").alias("PartNo"),
        _line_suffix().alias("PartNoSuffix"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
        .when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(-F.col("l_quantity"))
        .alias("QuantityOnHandAdj"),
    )
    by_suffix = part.withColumn("PartNoSuffix", F.explode(F.array(*[F.lit(s) for s in SUFFIXES])))
    size_mod = F.col("p_size") % 5
    inventory = by_suffix.select(
        _part_no("p_partkey").alias("PartNo"),
        "PartNoSuffix",
        F.when(size_mod == 4, F.lit(None)).otherwise(size_mod).cast("int").alias("CostMethod"),
        F.lit("EA").alias("StockUOM"),
        F.when(F.col("p_size") > 25, F.lit("BOX")).otherwise(F.lit("EA")).alias("CostUOM"),
        _case(F.col("p_type"), [(name, cid) for cid, name in CATEGORIES]).alias("CategoryID"),
    )
    loc_struct = F.explode(
        F.array(
            *[
                F.struct(F.lit(loc).alias("LocationID"), F.lit(off).alias("offset"))
                for loc, _, off in LOCATIONS
            ]
        )
    ).alias("loc")
    price = F.col("p_retailprice")
    off = F.col("loc.offset")
    inventory_detail = by_suffix.select("p_partkey", "PartNoSuffix", "p_brand", "p_retailprice", loc_struct).select(
        _part_no("p_partkey").alias("PartNo"),
        "PartNoSuffix",
        F.col("loc.LocationID").alias("LocationID"),
        (price + off).alias("StdCost"),
        (price * F.lit(0.9) + off).alias("AvgCost"),
        F.when(F.col("p_brand") == "Brand#1", F.lit(None).cast("double"))
        .otherwise(price + F.lit(5.0) + off)
        .alias("LastCost"),
    )
    master_part_list = master_parts(part)
    locations = _literal_table(
        spark, [(loc, cult) for loc, cult, _ in LOCATIONS], "LocationID string, CurrencyCulture string"
    )
    cultures = _literal_table(spark, [(cult,) for _, cult, _ in LOCATIONS], "CultureInfo string")
    categories = _literal_table(spark, CATEGORIES, "ID int, Description string")
    return {
        "inventory_trans": trans,
        "inventory_trans_detail": detail,
        "inventory": inventory,
        "inventory_detail": inventory_detail,
        "locations": locations,
        "culture_currencies": cultures,
        "master_part_list": master_part_list,
        "categories": categories,
    }


def master_parts(part: DataFrame) -> DataFrame:
    by_suffix = part.withColumn("PartNoSuffix", F.explode(F.array(*[F.lit(s) for s in SUFFIXES])))
    return by_suffix.select(
        _part_no("p_partkey").alias("MasterPartNo"),
        "PartNoSuffix",
        F.concat(F.lit("G"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("PartNoSuffix")).alias("GUID"),
        F.col("p_name").alias("Description"),
    )


def general_setup(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Settings (S7): a row for each nation, and among them the cost method."""
    return raw["nation"].select(
        F.when(F.col("n_nationkey") == 7, "CostingMethod").otherwise(F.concat(F.lit("Setting"), "n_nationkey")).alias("Parameter"),
        F.when(F.col("n_nationkey") == 7, "1").otherwise(F.col("n_name")).alias("Value"),
    )


# ------------------------------------------------------------------- orders
def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


#: Room for an order's line positions in a line key.
LINE_ROOM = 256
#: A total order of an order's lines, over every column the mapping uses, so
#: that lines it cannot tell apart are equal.
LINE_ORDER = (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
)


def keyed_lines(li: DataFrame) -> DataFrame:
    """Lines with ``l_pos``, their position in the order from 1: line numbers
    repeat within an order of the test tables, positions do not."""
    return li.withColumn("l_pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long"))


def _odkey() -> Column:
    return F.expr(LINE_KEY)


def _serial() -> Column:
    return F.concat(F.lit("SN"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_pos").cast("string"))


def order_tables(raw: Mapping[str, DataFrame], lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Orders and order lines shared by the demand, backlog and label reports.
    ``lines``: the ``keyed_lines``, where the caller has them."""
    o, li = raw["orders"], keyed_lines(raw["lineitem"]) if lines is None else lines
    status, prio, key, cust = (F.col(c) for c in ("o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"))
    date = F.col("o_orderdate")
    orders = o.select(
        key.alias("oKey"),
        F.concat(F.lit("SO"), key.cast("string")).alias("OrderNumber"),
        date.alias("Date"),
        (date + _days(30)).alias("ShipDate"),
        F.when(status == "F", 3)
        .when(status == "O", 1)
        .when(prio == "5-LOW", 2)
        .when(prio == "4-NOT SPECIFIED", F.lit(None))
        .otherwise(0)
        .cast("int")
        .alias("Status"),
        _case(prio, PRIORITY_ORDER_TYPE).cast("int").alias("OrderType"),
        F.concat(F.lit("C"), cust.cast("string")).alias("CustomerID"),
        F.lit("0").alias("SiteID"),
        F.when(status == "F", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("G"), (cust + 1).cast("string")))
        .alias("ProjectGUID"),
        F.concat(F.lit("E"), (cust % 128).cast("string")).alias("EnteredBy"),
        F.concat(F.lit("E"), (key % 97).cast("string")).alias("SalesPersonID"),
        F.concat(F.lit("REF"), key.cast("string")).alias("CustomerRef"),
        F.concat(F.lit("PO"), cust.cast("string")).alias("PONumber"),
        F.concat(F.lit("Contact "), cust.cast("string")).alias("OrderContact"),
        F.when(prio == "2-HIGH", F.lit(1.25)).otherwise(F.lit(1.0)).alias("CurrencyMultiplier"),
        (F.col("o_totalprice") * F.lit(0.07)).alias("TaxAmount"),
        prio.alias("Notes"),
        F.lit("NET30").alias("Terms"),
        F.when(status == "F", date + _days(45)).alias("CompleteDate"),
        (date + _days(14)).alias("ReqDate"),
        F.when(status != "P", date + _days(1)).alias("AckDate"),
        F.when(status == "F", date + _days(60))
        .when(prio == "5-LOW", F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.lit("1900-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("ClosedDate"),
        ((prio == "4-NOT SPECIFIED") & (status == "P")).alias("Cancelled"),
        F.concat(F.lit("order "), key.cast("string")).alias("Comments"),
        F.concat(F.lit("ship "), cust.cast("string")).alias("ShpAddr_Comments"),
        F.col("o_totalprice").alias("TotalPrice"),
    )
    disc = F.col("l_discount")
    order_detail = li.select(
        _odkey().alias("odKey"),
        F.col("l_orderkey").alias("oKey"),
        F.when(disc >= F.lit(0.09), 5).when(disc == 0, F.lit(None)).otherwise(4).cast("int").alias("ItemType"),
        F.when(F.col("l_tax") == F.lit(0.08), F.col("l_orderkey") * LINE_ROOM).alias("AlternativeODKey"),
        _part_no("l_partkey").alias("PartNo"),
        _line_suffix().alias("PartNoSuffix"),
        F.col("l_shipdate").cast("date").alias("PlanDate"),
        F.col("l_linenumber").alias("LineItem"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("SubLineItem"),
        _serial().alias("SerialNumber"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("Comment"),
        F.concat(F.lit("LREF"), F.col("l_partkey").cast("string")).alias("CustomerRef"),
    )
    return {"orders": orders, "order_detail": order_detail}


# ------------------------------------------------------------------- demand
def _line_location() -> Column:
    return F.when(F.col("l_suppkey") % 2 == 0, F.lit("MAIN")).otherwise(F.lit("EAST"))


def demand_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Contracts of the sales-order demand report (OP4)."""
    li = keyed_lines(raw["lineitem"])
    flag = F.col("l_returnflag")
    view = li.filter(F.col("l_linestatus") == "O").select(
        _odkey().alias("odKey"),
        _part_no("l_partkey").alias("PartNo"),
        _line_suffix().alias("PartNoSuffix"),
        _line_location().alias("LocationID"),
        F.when(flag == "N", F.col("l_quantity"))
        .when(flag == "A", F.col("l_quantity") - 25)
        .alias("QuantityOnSalesOrder"),
    )
    serialized = li.select(
        _serial().alias("SerialNumber"),
        F.concat(F.lit("G"), F.col("l_suppkey").cast("string"), F.lit("-0000")).alias("IssuePartGUID"),
        F.when(flag == "R", F.concat(F.lit("G"), F.col("l_partkey").cast("string"), F.lit("-0001"))).alias(
            "SecondaryIssuePartGUID"
        ),
        F.col("l_quantity").alias("IssuePartQty"),
        F.when(F.col("l_tax") < F.lit(0.06), 1).otherwise(0).cast("int").alias("Status"),
        _line_location().alias("LocationID"),
    )
    results = li.select(
        _odkey().alias("odKey"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
        .otherwise(F.floor(F.col("l_quantity") / 2).cast("double"))
        .alias("CompleteQty"),
        F.col("l_quantity").alias("TotalQty"),
    )
    out = order_tables(raw)
    out.update(
        {
            "master_part_list": master_parts(raw["part"]),
            "inventory_order_detail_quantities": view,
            "inventory_detail_serialized": serialized,
            "inventory_results": results,
        }
    )
    return out


# ------------------------------------------------------------------ backlog
def backlog_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Contracts of the backlog snapshot (OP1)."""
    li, cust, supp = raw["lineitem"], raw["customer"], raw["supplier"]
    spark = li.sparkSession
    customers = cust.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("CustomerID"),
        F.lit("0").alias("SiteID"),
        F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("CustomerGUID"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("SiteName"),
    )
    employees = supp.select(
        F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("EmployeeID"),
        F.col("s_name").alias("LastName"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("FirstName"),
        F.when(F.col("s_nationkey") < 10, F.lit("MAIN")).otherwise(F.lit("EAST")).alias("LocationID"),
    )
    relations = li.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("ChildoKey"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > F.lit(0.05)), 2)
        .otherwise(1)
        .cast("int")
        .alias("RelationType"),
    )
    orders_open = li.filter((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).select(
        F.concat(F.lit("SO"), F.col("l_orderkey").cast("string")).alias("OrderNumber"),
        F.col("l_shipdate").cast("date").alias("TargetShipDate"),
    )
    facts = li.groupBy(F.col("l_orderkey").alias("oKey")).agg(
        F.sum("l_quantity").alias("IncQuantity"),
        F.max("l_linestatus").alias("Status"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("InvoiceAmount"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Subtotal"),
        F.sum(F.col("l_quantity") * F.lit(2.0)).alias("TotalDimensions"),
        F.sum("l_quantity").alias("QtyTotal"),
        F.count(F.lit(1)).alias("ItemTotal"),
        F.sum(F.col("l_quantity") * F.lit(1.5)).alias("OrderWeight"),
        F.lit(2).alias("DecimalPlaces"),
        F.lit("en-US").alias("CultureInfo"),
        F.lit("EA").alias("UOM"),
    )
    out = order_tables(raw)
    out.update(
        {
            "order_types": _literal_table(spark, ORDER_TYPES, "OrderType int, Description string"),
            "customers": customers,
            "employees": employees,
            "order_relations": relations,
            "orders_open": orders_open,
            "order_facts": facts,
        }
    )
    return out


# ------------------------------------------------------------------- labels
# The label fixture is wide (102 staged columns), so its derivation rules
# are written once as SQL expressions over ``lineitem`` that both Spark
# (``F.expr``) and DuckDB evaluate identically.
LINE_KEY = f"(l_orderkey * {LINE_ROOM} + l_pos)"
FIRST_LINE_KEY = f"(l_orderkey * {LINE_ROOM} + 1)"
LABEL_PARENT = "CAST((l_orderkey + l_linenumber) % 3 AS INT)"
WORKFLOWS = (
    (1, "CUT, TEMP,EDG-PST,BOXING"),
    (2, "CUT,EDG-PST, CUT"),
    (3, "TEMP, SLKSCREEN ,BOXING,BO-TEMP,BO-BEV-PST"),
    (4, "HTSOAK,DRL-PST,BO-BEVEL,CMSSS"),
    (6, "CUTTING,,BOXING-QC,SNDBLST"),
    (7, "BOXING,MTR-PST,TDRL-PST,BP-PST,D-SNDBLST"),
)  # line 5 has no work flow (NULL)
WORK_CELLS = tuple(
    enumerate(
        (
            "CUTTING", "CUT", "TEMP", "BOXING-QC", "EDGE-POST", "SILKSCREEN", "BUY OUT BEVEL", "CMS", "BUY OUT TEMP",
            "HEATSOAK", "BUY OUT BEVEL-POST", "MITER-POST", "DRILL-POST", "TOPDRILL-POST", "BKPNT-POST", "SANDBLAST",
            "DEEP SANDBLAST",
        ),
        1,
    )
)

_LABEL_OVERRIDES = {
    "ReportID": "'L-GLASS'",
    "DisplayFractions": "l_linestatus = 'O'",
    "BinSource": "CAST(l_linenumber AS SMALLINT)",
    "DisplayCallSize": "l_returnflag = 'R'",
    "SchedID": "CAST(l_suppkey AS INT)",
    "ScheduleDesc": "'Schedule ' || CAST(l_suppkey AS STRING)",
    "WorkRouteAttrValue": "l_returnflag || l_linestatus",
    "BatchID": "CAST(l_linenumber AS SMALLINT)",
    "oKey": "l_orderkey",
    "odKey": LINE_KEY,
    "Customer": "'Customer ' || CAST(l_orderkey % 50 AS STRING)",
    "OrderNumber": "'SO' || CAST(l_orderkey AS STRING)",
    "OrderItem": "CAST(l_linenumber AS SMALLINT)",
    "PONumber": "'PO' || CAST(l_orderkey AS STRING)",
    "CustomerRef": "'LREF' || CAST(l_partkey AS STRING)",
    "UnitID": "CAST(l_linenumber AS SMALLINT)",
    "MasterKey": "CAST(l_partkey AS INT)",
    "ParentKey": LABEL_PARENT,
    "Barcode": "'B' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "PartNo": "'P' || CAST(l_partkey AS STRING)",
    "PartNoSuffix": "CASE WHEN l_linestatus = 'O' THEN '0000' ELSE '0001' END",
    "Quantity": "CAST(l_quantity AS SMALLINT)",
    "Width": "CAST(l_extendedprice / 100 AS REAL)",
    "Height": "CAST(l_quantity * 2 AS REAL)",
    "Thickness": "CAST(l_tax * 100 AS REAL)",
    "Weight": "CAST(l_discount * 100 AS REAL)",
    "OverallPartNo": "'P' || CAST(l_partkey AS STRING)",
    "OverallPartDesc": "CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'IGU ' || CAST(l_partkey % 10 AS STRING) END",
    "OverallWidth": "CAST(l_extendedprice / 100 AS REAL)",
    "OverallHeight": "CAST(l_quantity * 2 AS REAL)",
    "WorkFlow": "CASE l_linenumber "
    + " ".join(f"WHEN {n} THEN '{wf}'" for n, wf in WORKFLOWS)
    + " END",
    "RackSort": "CAST(l_linenumber AS INT)",
    "RackID": "'R' || CAST(l_suppkey AS STRING)",
    "Slot": "CAST(l_linenumber AS INT)",
    "Notes": "l_returnflag",
    "SecondaryBin": "CAST(NULL AS STRING)",
    "MullContainerKey": "CAST(NULL AS INT)",
    "StartingSchedule": "CAST(l_suppkey AS INT)",
}
_TYPE_DEFAULTS = {
    "string": "'n/a'",
    "smallint": "CAST(0 AS SMALLINT)",
    "int": "CAST(0 AS INT)",
    "bigint": "CAST(0 AS BIGINT)",
    "float": "CAST(0 AS REAL)",
    "boolean": "FALSE",
    "timestamp_ntz": "l_shipdate",
}


def label_part_exprs() -> list[tuple[str, str]]:
    """(column, SQL expression over lineitem) for every staged label column
    except Thumbnail and Remake (never read by the report)."""
    from shopfloor.sources.schemas import LABEL_PART_COLUMNS

    out = []
    for name, dtype in LABEL_PART_COLUMNS:
        if name in ("Thumbnail", "Remake"):
            continue
        out.append((name, _LABEL_OVERRIDES.get(name, _TYPE_DEFAULTS[dtype.simpleString()])))
    return out


LITE_EXPRS = [
    ("SessionGUID", "'S' || CAST(l_suppkey % 7 AS STRING)"),
    ("ProdType", "CAST(CAST(l_quantity AS INT) % 12 AS SMALLINT)"),
    ("SchedID", "CAST(l_suppkey AS INT)"),
    ("UnitID", "CAST(l_linenumber AS SMALLINT)"),
    ("MasterKey", "CAST(l_partkey AS INT)"),
    ("ParentKey", LABEL_PARENT),
    ("ReleaseID", "CAST(l_linenumber AS INT)"),
    ("Sequence", "CAST(l_orderkey * 10 + l_linenumber AS INT)"),
]
# Extra remake rows (class 1) for returned, finished lines: same key, later
# sequence, so a key can carry a regular and a remake sequence.
REMAKE_FILTER = "l_returnflag = 'R' AND l_linestatus = 'F'"
REMAKE_OVERRIDES = {
    "ProdType": "CAST(1 AS SMALLINT)",
    "ReleaseID": "CAST(99 AS INT)",
    "Sequence": "CAST(l_orderkey * 10 + l_linenumber + 5 AS INT)",
}
ATTRIBUTE_EXPRS = [
    ("odKey", LINE_KEY),
    ("MasterKey", "CAST(l_partkey AS INT)"),
    ("ParentKey", LABEL_PARENT),
    ("ParamText", "CASE WHEN l_returnflag = 'A' THEN 'LITE' WHEN l_returnflag = 'N' THEN 'LOGO' ELSE 'COLOR' END"),
    ("ParamValue", "CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) END"),
    ("ParamValue2", "'LOGO-' || CAST(l_suppkey AS STRING)"),
]
# Second attribute row for finished lines: a LOGO (so a key can carry both
# names, or the same name twice).
EXTRA_ATTRIBUTE_FILTER = "l_linestatus = 'F'"
EXTRA_ATTRIBUTE_OVERRIDES = {"ParamText": "'LOGO'", "ParamValue2": "'F-LOGO'"}
PLAN_EXPRS = [
    ("ParentKey", "CAST(l_linenumber % 3 AS INT)"),
    (
        "WorkCellID",
        f"CAST((l_partkey + l_suppkey) % {len(WORK_CELLS)} + 1 AS INT)",
    ),
    ("PlanDate", "CAST(l_shipdate AS DATE)"),
]
SHORTCUT_FILTER = "l_returnflag = 'N' AND l_linestatus = 'O'"
SHORTCUT_EXPRS = [("odKey", LINE_KEY), ("ShortcutDesc", "'SC-' || CAST(l_partkey AS STRING)")]


def _select_exprs(df: DataFrame, exprs, overrides=None) -> DataFrame:
    overrides = overrides or {}
    return df.select(*[F.expr(overrides.get(n, e)).alias(n) for n, e in exprs])


def label_tables(
    raw: Mapping[str, DataFrame], store: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Contracts of the work-cell label report (OP2) and its route string
    (OP6).  Plans of every line are attached to the line itself (open lines
    only) and to line 1 of its order, so first lines carry multi-stage
    routes and some finished lines have no plan at all (J15).

    ``store`` writes a frame and reads it back: the lines then get their
    positions once, not once for every table made from them."""
    li = keyed_lines(raw["lineitem"])
    if store is not None:
        li = store(li)
    spark = li.sparkSession
    lites = _select_exprs(li, LITE_EXPRS).unionByName(
        _select_exprs(li.filter(F.expr(REMAKE_FILTER)), LITE_EXPRS, REMAKE_OVERRIDES)
    )
    attrs = _select_exprs(li, ATTRIBUTE_EXPRS).unionByName(
        _select_exprs(li.filter(F.expr(EXTRA_ATTRIBUTE_FILTER)), ATTRIBUTE_EXPRS, EXTRA_ATTRIBUTE_OVERRIDES)
    )
    plan_keys = F.explode(
        F.when(
            F.col("l_linestatus") == "O",
            F.array(F.expr(LINE_KEY), F.expr(FIRST_LINE_KEY)),
        ).otherwise(F.array(F.expr(FIRST_LINE_KEY)))
    ).alias("odKey")
    plans = li.select(plan_keys, *[F.expr(e).alias(n) for n, e in PLAN_EXPRS])
    out = order_tables(raw, li)
    out.update(
        {
            "label_parts": _select_exprs(li, label_part_exprs()),
            "opti_report_lites": lites,
            "order_detail_attributes": attrs,
            "order_detail_plans": plans,
            "work_cells": _literal_table(spark, WORK_CELLS, "ID int, Description string"),
            "shortcuts": _select_exprs(li.filter(F.expr(SHORTCUT_FILTER)), SHORTCUT_EXPRS),
        }
    )
    return out


# --------------------------------------------------------------- edge work
EDGE_LINES = range(1, 8)
EDGE_LITE = "CASE WHEN {k} % 5 = 0 THEN '2 B' ELSE '1' END"
EDGE_CODE = (
    "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'EFGPO' WHEN 'AO' THEN 'EFP' WHEN 'NF' THEN 'EFPCN' "
    "WHEN 'NO' THEN 'ESEAM' WHEN 'RF' THEN 'EBEV' ELSE 'EFGPO2' END"
)
EDGE_TOKEN = (
    f"CASE WHEN l_tax = 0.08 THEN '' WHEN l_discount = 0 AND l_tax = 0 THEN {EDGE_CODE} "
    f"ELSE {EDGE_CODE} || '=' || CAST(CAST(l_quantity AS INT) AS STRING) END"
)
ORDER_ATTRIBUTES = [
    ("LITE", EDGE_LITE.format(k="o_orderkey"), None),
    ("ANNLAMI", "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END", None),
    ("CP-BUY-OUT-BEV-POST", "CASE WHEN o_orderpriority = '5-LOW' THEN '1' ELSE '0' END",
     "o_orderpriority <> '4-NOT SPECIFIED'"),
    ("CP-EDGE-PREandPOST", "'0'", "o_orderstatus <> 'P'"),
]
GLASS_CODE = (
    "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'MONO' "
    "ELSE 'LAM' || CAST(o_custkey % 4 + 1 AS STRING) END"
)
# Per (order, line number) = one gap of the layer stack; rules over the
# aggregated line columns mn_qty, mx_disc, mn_flag, mn_status, mn_tax.
GAP_CODES = [
    ("INTERLAYERS", "CASE WHEN mx_disc = 0.1 THEN 'XPLY' ELSE CAST(CAST(mn_qty AS INT) % 3 + 1 AS STRING) || 'PLY' END"),
    ("PROCESS", "CASE WHEN mx_disc > 0.05 THEN 'AN' ELSE 'HS' END"),
    ("IL1 TYPE", "CASE mn_flag WHEN 'A' THEN 'ILPRT' WHEN 'N' THEN 'ILSGP' ELSE 'ILCLR' END"),
    ("IL2 TYPE", "CASE WHEN mn_status = 'F' THEN 'ILFAB' ELSE 'ILOTH' END"),
    ("IL3 TYPE", "'ILNAT'"),
    ("IL1", "CASE WHEN mn_tax > 0.04 THEN 'IMSCIPI' ELSE 'IMSTD' END"),
    ("IL2", "'IMSCIPI'"),
    ("IL3", "'IMOTHER'"),
]
GAP_OPTION = "CASE WHEN mn_tax = 0 THEN 'SHATOP' ELSE 'POLISH' END"


def _gap_lines(li: DataFrame) -> DataFrame:
    return li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").alias("mn_qty"),
        F.max("l_discount").alias("mx_disc"),
        F.min("l_returnflag").alias("mn_flag"),
        F.min("l_linestatus").alias("mn_status"),
        F.min("l_tax").alias("mn_tax"),
    )


def edge_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Contracts of the edge-work calculation (OP5): item = order."""
    o, li = raw["orders"], raw["lineitem"]
    # one token a line number, in their order: a fixed number of slots
    slots = [F.min(F.when(F.col("l_linenumber") == k, F.expr(EDGE_TOKEN))).alias(f"t{k}") for k in EDGE_LINES]
    ew = li.groupBy(F.col("l_orderkey").alias("item_id")).agg(*slots)
    ew = ew.select("item_id", F.lit("EW-STRAIGHT").alias("name"), F.concat_ws(",", *[f"t{k}" for k in EDGE_LINES]).alias("value"))
    attrs = ew
    for attr, expr, cond in ORDER_ATTRIBUTES:
        src = o.filter(F.expr(cond)) if cond else o
        attrs = attrs.unionByName(
            src.select(F.col("o_orderkey").alias("item_id"), F.lit(attr).alias("name"), F.expr(expr).alias("value"))
        )
    glass = o.select(
        F.col("o_orderkey").alias("item_id"),
        F.concat(F.lit("LITE "), F.expr(EDGE_LITE.format(k="o_orderkey")), F.lit(" GLASS")).alias("group_name"),
        F.expr(GLASS_CODE).alias("code"),
    )
    gaps = _gap_lines(li)
    prefix = F.concat(
        F.lit("LITE "), F.expr(EDGE_LITE.format(k="l_orderkey")), F.lit("."), F.col("l_linenumber").cast("string")
    )
    gap_codes = gaps.select(
        F.col("l_orderkey").alias("item_id"),
        prefix.alias("prefix"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.expr(e).alias("code")) for s, e in GAP_CODES])).alias("g"),
    ).select("item_id", F.concat("prefix", F.lit(" "), F.col("g.s")).alias("group_name"), F.col("g.code").alias("code"))
    options = gaps.select(
        F.col("l_orderkey").alias("item_id"),
        F.expr(GAP_OPTION).alias("option"),
        F.concat(prefix, F.lit(" OPTION")).alias("group_name"),
    )
    return {
        "item_attributes": attrs,
        "item_group_codes": glass.unionByName(gap_codes),
        "item_options": options,
    }


# ------------------------------------------- the same inputs, less well kept
# What is wrong with which order's text (column, text, divisor
# of the order key).
TEXT_FAULTS = (("Status", "n/a", 101), ("Date", "1997-13-40", 103), ("CurrencyMultiplier", "1,25", 107), ("oKey", None, 109))
CATEGORY = 2  # the open-order category asked for
TRANSLATIONS = (("Sales", "Verkauf"), ("Credit", "Gutschrift"))


def text_orders(orders: DataFrame) -> DataFrame:
    """Orders as an export of texts, some of which are no values of their
    column, and with empty closing dates."""
    out = []
    for name, kind in orders.dtypes:
        text = F.col(name).cast("string")
        if name == "ClosedDate":
            text = F.when(text == "1900-01-01 00:00:00", "").otherwise(text)
        for column, wrong, every in TEXT_FAULTS:
            if column == name:
                text = F.when(F.col("oKey") % every == 0, F.lit(wrong)).otherwise(text)
        out.append(text.alias(name))
    return orders.select(*out)


def mixed_case(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Codes and GUIDs as a case-blind database keeps them: other spellings on
    the side that a report looks up, blanks at the end, braces."""
    blind = lambda c: F.concat(F.lower(c), F.lit(" "))
    braces = lambda c: F.concat(F.lit("{"), F.lower(c), F.lit("}"))
    spelled = {
        "customers": {"CustomerID": blind, "CustomerGUID": braces},
        "employees": {"EmployeeID": blind, "LocationID": F.initcap},
        "orders_open": {"OrderNumber": blind},
        "work_cells": {"Description": lambda c: F.concat(F.initcap(c), F.lit("  "))},
        "order_detail_attributes": {"ParamText": lambda c: F.when(F.col("MasterKey") % 2 == 0, blind(c)).otherwise(c)},
        "opti_report_lites": {"SessionGUID": lambda c: F.when(F.col("Sequence") % 2 == 0, braces(c)).otherwise(c)},
        "inventory": {"PartNo": blind},
        "inventory_detail": {"PartNo": F.lower, "LocationID": blind},
        "locations": {"LocationID": F.initcap},
        "culture_currencies": {"CultureInfo": F.upper},
        "master_part_list": {"MasterPartNo": blind},
    }
    out = dict(tables)
    for table in set(tables) & set(spelled):
        out[table] = tables[table].withColumns({c: f(F.col(c)) for c, f in spelled[table].items()})
    return out


def open_orders_by_category(orders_open: DataFrame) -> DataFrame:
    """The other open-order source: every open order with a category."""
    number = F.substring("OrderNumber", 3, 20).cast("long")
    return orders_open.withColumn("CategoryID", (number % 4).cast("int"))


def translations(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, TRANSLATIONS, "Text string, Translation string")
