"""OP3 — inventory usage in cumulative look-back periods (30/60/90 days).

Per formatted part: the largest single transaction quantity and total cost
in each window, the average current cost, and unit/culture columns.

Plan (see operators/lookback.py for the algebra):

1. transactions: range predicate ``[end - 90d, end]`` and the location
   predicate, both pushed to the Parquet scan;
2. transaction lines: ``QuantityOnHandAdj <> 0`` (pushed), joined to (1) on
   the transaction id — the only fact-to-fact join, shuffled on that key;
3. partial aggregation per (PartNo, PartNoSuffix, LocationID) — the fact
   side shrinks to at most parts x locations rows *before* any dimension is
   touched (map-side partial aggregation absorbs a hot part);
4. inner joins to the dimensions (inventory filtered by the category list,
   costs per location, locations, cultures, master part list, categories);
   AQE broadcasts whichever side is small at run time;
5. final aggregation at the report grain and the report's sort.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.columns import format_part, unit_cost
from shopfloor.functions.text import parse_int_list
from shopfloor.operators.filters import equal_or_self, in_list
from shopfloor.operators.joins import never_broadcast
from shopfloor.operators.lookback import look_back_final, look_back_partials
from shopfloor.operators.settings import setting
from shopfloor.sources.contracts import contracted
from shopfloor.sources.layout import MONTH, in_months

COSTING_METHOD_SETTING = "CostingMethod"


def usage_by_period(
    tables: Mapping[str, DataFrame],
    end: dt.datetime | str,
    days: Sequence[int] = (30, 60, 90),
    location: str | None = None,
    categories: str | Sequence[int] | None = None,
    tracking_enabled: bool = False,
    system_cost_method: int | None = None,
    part_format: Callable[[Column, Column], Column] = format_part,
    sort: bool = True,
) -> DataFrame:
    """Run the usage report.

    ``tables`` needs inventory_trans, inventory_trans_detail, inventory,
    inventory_detail, locations, culture_currencies, master_part_list,
    categories; optional general_setup (CostingMethod setting, default 0)
    and part_multipliers (PartNo, PartNoSuffix, multiplier; default 1).
    ``categories`` is the report's comma list (``'279, 311'``) or a list of
    ints; ``None`` means every category.  Output columns are named as in the
    report for ``days=(30, 60, 90)``; other window lists get the same
    ``'<d> Days Quantity'`` / ``'<d> Days Total Cost'`` pattern.
    """
    tables = contracted(tables, "usage", ("general_setup", "part_multipliers"))
    days = sorted(set(days))
    if isinstance(categories, str):
        categories = parse_int_list(categories)
    if system_cost_method is None:
        gs = tables.get("general_setup")
        value = setting(gs, COSTING_METHOD_SETTING) if gs is not None else None
        system_cost_method = int(value) if value not in (None, "") else 0

    # Where both tables are kept by month (sources/layout.py), the window's
    # months are the only partitions read, of the lines too.
    movements = [tables["inventory_trans"], tables["inventory_trans_detail"]]
    by_month = [MONTH] if all(MONTH in df.columns for df in movements) else []
    if by_month:
        movements = [in_months(df, tables["inventory_trans"], "InvTransDate", end, days[-1]) for df in movements]
    trans = equal_or_self(movements[0], "LocationID", location).select("InvTransID", "InvTransDate", "LocationID", *by_month)
    lines = (
        movements[1]
        .filter(F.col("QuantityOnHandAdj") != 0)
        .select("InvTransID", "PartNo", "PartNoSuffix", (-F.col("QuantityOnHandAdj")).alias("Quantity"), *by_month)
    )
    if categories is not None:
        # only movements of the chosen categories' parts meet the transactions
        chosen = in_list(tables["inventory"], "CategoryID", categories).select("PartNo", "PartNoSuffix")
        lines = lines.join(never_broadcast(chosen), ["PartNo", "PartNoSuffix"], "left_semi")
    fact = lines.join(trans, ["InvTransID", *by_month])
    fine_keys = ["PartNo", "PartNoSuffix", "LocationID"]
    partial = look_back_partials(fact, fine_keys, "InvTransDate", ["Quantity"], end, days)

    inv = in_list(tables["inventory"], "CategoryID", categories).select(
        "PartNo", "PartNoSuffix", "CostMethod", "StockUOM", "CostUOM", "CategoryID"
    )
    costs = tables["inventory_detail"].select(
        "PartNo", "PartNoSuffix", "LocationID", "StdCost", "AvgCost", "LastCost"
    )
    locs = tables["locations"].select("LocationID", "CurrencyCulture")
    cultures = tables["culture_currencies"].select(F.col("CultureInfo").alias("CurrencyCulture"))
    parts = tables["master_part_list"].select(
        F.col("MasterPartNo").alias("PartNo"), "PartNoSuffix", "Description"
    )
    cats = in_list(tables["categories"], "ID", categories).select(
        F.col("ID").alias("CategoryID"), F.col("Description").alias("CategoryDescription")
    )

    # The partial result is hash-partitioned on the fine keys, so the cost
    # join on the same keys needs no new exchange of the fact side.
    # The code tables meet the small sides they describe, not the fact.
    stocked = inv.join(cats, "CategoryID").join(never_broadcast(parts), ["PartNo", "PartNoSuffix"])
    priced = costs.join(locs.join(cultures, "CurrencyCulture"), "LocationID")
    joined = partial.join(never_broadcast(priced), fine_keys).join(never_broadcast(stocked), ["PartNo", "PartNoSuffix"])
    multipliers = tables.get("part_multipliers")
    if multipliers is not None:
        joined = joined.join(
            never_broadcast(multipliers.select("PartNo", "PartNoSuffix", F.col("multiplier").alias("__mult"))),
            ["PartNo", "PartNoSuffix"],
            "left",
        ).withColumn("__mult", F.coalesce("__mult", F.lit(1)))
        mult = F.col("__mult")
    else:
        mult = F.lit(1)

    cost = unit_cost(tracking_enabled, "CostMethod", system_cost_method, "StdCost", "AvgCost", "LastCost")
    joined = joined.select(
        part_format(F.col("PartNo"), F.col("PartNoSuffix")).alias("Part"),
        "Description",
        F.coalesce(F.col("CategoryDescription"), F.lit("")).alias("InvCategory"),
        "StockUOM",
        F.col("CurrencyCulture").alias("CostingCultureInfo"),
        "CostUOM",
        "CategoryID",
        cost.alias("__cost"),
        (cost * mult).alias("__unit"),
        *[c for c in partial.columns if c.startswith("__lb_")],
    )

    outputs = []
    for d in days:
        outputs.append((f"{d} Days Quantity", "Quantity", None, d))
        outputs.append((f"{d} Days Total Cost", "Quantity", F.col("__unit"), d))
    group_keys = ["Part", "Description", "InvCategory", "StockUOM", "CostingCultureInfo", "CostUOM", "CategoryID"]
    result = look_back_final(
        joined, group_keys, outputs, days, weighted=[("CurrentCost", F.col("__cost"))]
    )
    measure_cols = [o[0] for o in outputs]
    result = result.select(
        "Part", "Description", "InvCategory", *measure_cols, "CurrentCost",
        "StockUOM", "CostingCultureInfo", "CostUOM", "CategoryID",
    )
    if sort:
        result = result.orderBy("InvCategory", "Part")
    return result
