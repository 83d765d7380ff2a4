"""OP1 — backlog order snapshot: one row per open order entered in a date
range (and per distinct target ship date of its open-order rows).

Plan:

1. orders: type list and half-open date range pushed into the scan;
2. open orders: one inner join to open orders grouped by (OrderNumber,
   TargetShipDate) with a row count; the line count is multiplied by it (T10);
3. a relation of type 2 excludes an order: left anti join on oKey;
4. line counts (added up by order before the shuffle), prices and the
   per-order facts as left joins on oKey;
5. dimension lookups (order types, customer, project, employees); orders
   without a project or employee stay off the shuffle.

The report's 27-column GROUP BY collapses to the (order, target date) grain
because every other grouped column is a lookup by a unique key; the
dimension inputs must be unique on their keys (asserted in the tests).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.columns import format_employee, identity_text, month_name, signed_price, status_name, uninvoiced
from shopfloor.functions.money import product
from shopfloor.operators.filters import half_open_days, in_list
from shopfloor.operators.joins import left_join_known, line_counts, open_order_multiplicity, without_relation
from shopfloor.sources.contracts import contracted

# Fixed values of the report.
BACKLOG_ORDER_TYPES = (1, 3)
EXCLUDED_RELATION_TYPE = 2

FACT_COLUMNS = [
    ("IncQuantity", "TotalIncQuantity", "double"),
    ("Status", "CurrentStatus", "string"),  # the report's second 'Status' column (P1)
    ("InvoiceAmount", "InvoiceAmount", "double"),
    ("Subtotal", "__subtotal", "double"),
    ("TotalDimensions", "TotalDimensions", "double"),
    ("QtyTotal", "QtyTotal", "double"),
    ("ItemTotal", "ItemTotal", "long"),
    ("OrderWeight", "OrderWeight", "double"),
    ("DecimalPlaces", "DecimalPlaces", "int"),
    ("CultureInfo", "CultureInfo", "string"),
    ("UOM", "UOM", "string"),
]


def _facts(frames: Sequence[DataFrame]) -> list[DataFrame]:
    out = []
    present = set()
    for frame in frames:
        cols = [F.col("oKey")]
        for src, dst, _ in FACT_COLUMNS:
            if src in frame.columns and dst not in present:
                cols.append(F.col(src).alias(dst))
                present.add(dst)
        out.append(frame.select(*cols))
    return out


def backlog_snapshot(
    tables: Mapping[str, DataFrame],
    start: dt.date | str,
    end: dt.date | str,
    location: str | None = None,
    order_types: Sequence[int] = BACKLOG_ORDER_TYPES,
    employee_name: Callable[[Column, Column], Column] = format_employee,
    translate: Callable[[Column], Column] = identity_text,
    sort: bool = True,
    category: int = 0,
) -> DataFrame:
    """Run the backlog snapshot.

    ``category``: 0 takes the open orders of all categories (``orders_open``),
    any other one those of ``orders_open_by_category`` with that CategoryID
    (S3).

    ``tables``: orders, order_types, customers, order_detail, employees,
    order_relations, orders_open; optional ``order_prices`` (oKey,
    TotalPrice — else ``orders.TotalPrice`` is used), ``translations`` (Text,
    Translation: order types are shown translated, or as they are where there
    is none; credits are told by the untranslated text) and ``order_facts``
    (one DataFrame or a list, keyed by oKey, carrying any of IncQuantity,
    Status, InvoiceAmount, Subtotal, TotalDimensions, QtyTotal, ItemTotal,
    OrderWeight, DecimalPlaces, CultureInfo, UOM — the outputs of the
    report's elided CTEs; absent columns are NULL).
    """
    # the report asks one of two sources for the open orders
    source, other = ("orders_open", "orders_open_by_category")[:: 1 if category == 0 else -1]
    tables = contracted(tables, "backlog", ("order_prices", "order_facts", "translations", other))
    open_orders = tables[source]
    if category != 0:
        open_orders = open_orders.filter(F.col("CategoryID") == category).drop("CategoryID")
    orders = tables["orders"]
    orders = in_list(orders, "OrderType", order_types)
    orders = half_open_days(orders, "Date", start, end)
    price_in_orders = "order_prices" not in tables
    orders = orders.select(
        "oKey", "OrderNumber", "Date", "ShipDate", "Status", "OrderType", "CustomerID", "SiteID",
        "ProjectGUID", "EnteredBy", "SalesPersonID", "CustomerRef", "PONumber", "OrderContact",
        "CurrencyMultiplier", "TaxAmount", "Notes", "Terms", "CompleteDate",
        *(["TotalPrice"] if price_in_orders else []),
    )
    # oKey joins back to back (anti join, line counts, prices, per-order
    # facts): one partitioning of the orders side serves all of them.
    orders = open_order_multiplicity(orders, open_orders)
    orders = without_relation(orders, tables["order_relations"], EXCLUDED_RELATION_TYPE)
    # lines are counted by order in the map tasks, before the shuffle: the
    # orders are read once, not once more to choose lines
    df = orders.join(line_counts(tables["order_detail"]), "oKey", "left")
    if not price_in_orders:
        df = df.join(tables["order_prices"].select("oKey", "TotalPrice"), "oKey", "left")
    facts = tables.get("order_facts")
    if facts is not None:
        for frame in _facts(facts if isinstance(facts, (list, tuple)) else [facts]):
            df = df.join(frame, "oKey", "left")
    for _, dst, kind in FACT_COLUMNS:
        if dst not in df.columns:
            df = df.withColumn(dst, F.lit(None).cast(kind))

    types = tables["order_types"].select("OrderType", F.col("Description").alias("__type_desc"))
    shown = translate(F.col("__type_desc"))
    if "translations" in tables:
        words = tables["translations"].select(F.col("Text").alias("__type_desc"), "Translation")
        types = types.join(words, "__type_desc", "left")
        shown = F.coalesce(F.col("Translation"), shown)
    cust = tables["customers"].select("CustomerID", "SiteID", "Name", "SiteName")
    project = tables["customers"].select(
        F.col("CustomerGUID").alias("ProjectGUID"), F.col("SiteName").alias("__project_site")
    )
    emp = tables["employees"]
    entered = emp.select(
        F.col("EmployeeID").alias("EnteredBy"),
        F.col("LastName").alias("__e_last"),
        F.col("FirstName").alias("__e_first"),
        F.col("LocationID").alias("__e_loc"),
    )
    sales = emp.select(
        F.col("EmployeeID").alias("SalesPersonID"),
        F.col("LastName").alias("__sp_last"),
        F.col("FirstName").alias("__sp_first"),
    )
    df = df.join(types, "OrderType").join(cust, ["CustomerID", "SiteID"])
    for side, key in ((project, "ProjectGUID"), (entered, "EnteredBy"), (sales, "SalesPersonID")):
        df = left_join_known(df, side, key)
    if location is not None:
        # The WHERE on the right side turns the left join into an
        # inner join — orders without an entering employee disappear.
        df = df.filter(F.col("__e_loc") == F.lit(location))

    total = product(df, "TotalPrice", "CurrencyMultiplier")
    result = df.select(
        "oKey",
        "OrderNumber",
        F.year("Date").alias("year"),
        F.month("Date").alias("monthshort"),
        month_name("Date").alias("month"),
        "Date",
        "ShipDate",
        "Status",
        "TargetShipDate",
        status_name("Status").alias("statusName"),
        shown.alias("OrderType"),
        "Name",
        "SiteName",
        "CustomerRef",
        "PONumber",
        "OrderContact",
        total.alias("TotalPrice"),
        "TaxAmount",
        signed_price(total, F.col("__type_desc")).alias("ActualPrice"),
        (F.coalesce(F.col("__lines"), F.lit(0)) * F.col("__open_rows")).alias("LineItems"),
        employee_name(F.col("__e_last"), F.col("__e_first")).alias("EmployeeName"),
        employee_name(F.col("__sp_last"), F.col("__sp_first")).alias("SalesPersonName"),
        "Notes",
        "Terms",
        F.coalesce(F.col("__project_site"), F.lit("")).alias("ProjectName"),
        "CompleteDate",
        "TotalIncQuantity",
        "CurrentStatus",
        "InvoiceAmount",
        uninvoiced("__subtotal").alias("Subtotal"),
        "TotalDimensions",
        "QtyTotal",
        "ItemTotal",
        "OrderWeight",
        "DecimalPlaces",
        "CultureInfo",
        "UOM",
    )
    if sort:
        result = result.orderBy("Date")
    return result
