"""OP4 — demand on a part from three sources, stacked (sales-order detail).

Branch 1 (view):      order lines whose on-order quantity view matches the
                      part/location; quantity taken from the view.
Branch 2 (issue):     serialized inventory issued as the part -> SUM(qty)
                      per order line, open/uncancelled/incomplete orders only.
Branch 3 (secondary): the same with the secondary issued part -> COUNT(1).
The three are stacked, rows whose measure is 0 or NULL go, and the rest is
sorted by plan date.

Branches 2 and 3 differ only in which GUID column of the serialized row
names the part and in the measure, so the plan runs them as ONE pass: each
serialized row is exploded into ``(branch, guid)`` pairs, joined once to the
order/line/result tables, and aggregated once with both measures; the
branch picks its measure at the end.  One scan and one set of shuffles
instead of two.

Joins stay inner joins as in the report (T14: a second results row per line
doubles SUM and COUNT; T13: displayed part is the order line's part while
the filter is on the issued part).
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.columns import ack_label, format_part, is_open_closed_date, on_hold_label
from shopfloor.functions.money import total, union_type
from shopfloor.operators.filters import optional_eq
from shopfloor.sources.contracts import contracted

# Fixed values of the report.
DEMAND_ORDER_TYPES = (1, 4)  # note: the backlog report uses (1, 3) — trap T11
DEMAND_ITEM_TYPE = 4
ISSUED_STATUS = 1


def _project(df: DataFrame, part_format: Callable[[Column, Column], Column], qty: Column) -> DataFrame:
    return df.select(
        "PlanDate",
        "ReqDate",
        "OrderNumber",
        "LineItem",
        "SubLineItem",
        "CustomerRef",
        "PONumber",
        part_format(F.col("PartNo"), F.col("PartNoSuffix")).alias("Part"),
        "Description",
        qty.alias("SOQty"),
        on_hold_label("Status").alias("IsOnHold"),
        ack_label("AckDate").alias("IsAcknowledged"),
    )


def _orders(tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables["orders"].select(
        "oKey", "ReqDate", "OrderNumber", "CustomerRef", "PONumber", "Status", "AckDate",
        "ClosedDate", "Cancelled", "OrderType",
    )


def _line_parts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables["master_part_list"].select(
        F.col("MasterPartNo").alias("PartNo"), "PartNoSuffix", "Description"
    )


def demand_from_view(
    tables: Mapping[str, DataFrame], part: str | None, suffix: str | None, location: str | None
) -> DataFrame:
    """Branch 1 (X1): lines matched through the on-order quantity view."""
    view = tables["inventory_order_detail_quantities"]
    view = optional_eq(optional_eq(optional_eq(view, "PartNo", part), "PartNoSuffix", suffix), "LocationID", location)
    view = view.select("odKey", F.col("QuantityOnSalesOrder").alias("SOQty"))
    lines = (
        tables["order_detail"]
        .filter(F.col("AlternativeODKey").isNull())
        .select("odKey", "oKey", "PartNo", "PartNoSuffix", "PlanDate", "LineItem", "SubLineItem")
    )
    return (
        lines.join(view, "odKey")
        .join(_orders(tables).drop("ClosedDate", "Cancelled", "OrderType"), "oKey")
        .join(_line_parts(tables), ["PartNo", "PartNoSuffix"])
    )


def demand_from_serialized(
    tables: Mapping[str, DataFrame], part: str | None, suffix: str | None, location: str | None
) -> DataFrame:
    """Branches 2 and 3 (A2, A3, J3) in one pass; column ``branch`` is 2 or 3
    and ``SOQty`` is SUM(IssuePartQty) resp. COUNT(1)."""
    ser = tables["inventory_detail_serialized"].filter(F.col("Status") == ISSUED_STATUS)
    ser = optional_eq(ser, "LocationID", location)
    roles = ser.select(
        "SerialNumber",
        "IssuePartQty",
        F.explode(
            F.array(
                F.struct(F.lit(2).alias("branch"), F.col("IssuePartGUID").alias("guid")),
                F.struct(F.lit(3).alias("branch"), F.col("SecondaryIssuePartGUID").alias("guid")),
            )
        ).alias("r"),
    ).select("SerialNumber", "IssuePartQty", "r.branch", "r.guid")
    roles = roles.filter(F.col("guid").isNotNull())

    issued = tables["master_part_list"]
    issued = optional_eq(optional_eq(issued, "MasterPartNo", part), "PartNoSuffix", suffix)
    issued = issued.select(F.col("GUID").alias("guid"))

    orders = _orders(tables).filter(
        is_open_closed_date("ClosedDate")
        & (~F.col("Cancelled"))
        & F.col("OrderType").isin(list(DEMAND_ORDER_TYPES))
    )
    lines = (
        tables["order_detail"]
        .filter(F.col("ItemType") == DEMAND_ITEM_TYPE)
        .select("odKey", "oKey", "SerialNumber", "PartNo", "PartNoSuffix", "PlanDate", "LineItem", "SubLineItem")
    )
    results = tables["inventory_results"].filter(F.col("CompleteQty") < F.col("TotalQty")).select("odKey")

    # The report is asked for one part: the serialized rows of that part come
    # first, so every later join has only their lines on its left side.
    joined = (
        roles.join(issued, "guid")
        .join(lines, "SerialNumber")
        .join(results, "odKey")
        .join(orders, "oKey")
        .join(_line_parts(tables), ["PartNo", "PartNoSuffix"])
    )
    keys = [
        "branch", "PlanDate", "ReqDate", "OrderNumber", "LineItem", "SubLineItem", "CustomerRef",
        "PONumber", "PartNo", "PartNoSuffix", "Description", "Status", "AckDate",
    ]
    agg = joined.groupBy(*keys).agg(
        total(joined, "IssuePartQty").alias("__sum"), F.count(F.lit(1)).alias("__count")
    )
    # The measure has the type of a union of the sum and the count.
    kind = union_type(agg.schema["__sum"].dataType, agg.schema["__count"].dataType)
    return agg.withColumn(
        "SOQty", F.when(F.col("branch") == 2, F.col("__sum").cast(kind)).otherwise(F.col("__count").cast(kind))
    )


def so_quantity_detail(
    tables: Mapping[str, DataFrame],
    part: str | None = None,
    suffix: str | None = None,
    location: str | None = None,
    part_format: Callable[[Column, Column], Column] = format_part,
    sort: bool = True,
) -> DataFrame:
    """Run the demand report.

    ``part``/``suffix``/``location`` are the report parameters; ``None``
    means "all" (the report itself always receives values; with all three
    set the result is the report's).  ``tables`` needs orders, order_detail,
    master_part_list, inventory_order_detail_quantities,
    inventory_detail_serialized, inventory_results.
    """
    tables = contracted(tables, "demand")
    view = _project(demand_from_view(tables, part, suffix, location), part_format, F.col("SOQty"))
    serialized = _project(demand_from_serialized(tables, part, suffix, location), part_format, F.col("SOQty"))
    kind = union_type(view.schema["SOQty"].dataType, serialized.schema["SOQty"].dataType)
    stacked = [df.withColumn("SOQty", F.col("SOQty").cast(kind)) for df in (view, serialized)]
    result = stacked[0].unionByName(stacked[1]).filter(F.col("SOQty") != 0)
    if sort:
        result = result.orderBy("PlanDate")
    return result
