"""Typed parameters of the reports (S11), and reports as SQL with named
arguments.

A parameter object holds what a report is asked for, checked when it is made:
dates are dates, lists are lists of numbers, a name that the report does not
know is an error.  ``from_text`` reads the texts of a report form (an empty
text or ``NULL`` is no value).  ``run`` is the DataFrame face.  ``sql`` is the
same report as one SQL statement over the contract tables: every parameter is a
named argument of ``spark.sql``, NULL included, so that no value is ever pasted
into the text; the optimizer folds ``:part IS NULL OR ...`` away either way and
the predicate that is left reaches the scan.
"""

from __future__ import annotations

import dataclasses as dc
import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from shopfloor.functions.text import parse_int_list
from shopfloor.operators.joins import never_broadcast
from shopfloor.sources.contracts import contracted

# ---------------------------------------------------------------- reading
def _no_value(text: str | None) -> bool:
    return text is None or text.strip() in ("", "NULL")


def _instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.strip())


def _day(text: str) -> dt.date:
    return _instant(text).date()


_KINDS = {"date": dt.date, "datetime": dt.datetime, "int": int, "str": str, "bool": bool, "tuple": tuple}
_READERS = {
    "date": _day, "datetime": _instant, "int": lambda t: int(t.strip()), "str": str,
    "bool": lambda t: t.strip() in ("1", "true"), "tuple": lambda t: tuple(parse_int_list(t)),
}


@dc.dataclass(frozen=True)
class Parameters:
    """What every report's parameters can do."""

    def __post_init__(self) -> None:
        for field in dc.fields(self):
            kind, value = field.type.split("[")[0].split(" ")[0], getattr(self, field.name)
            if value is None and "None" in field.type:
                continue
            fits = isinstance(value, _KINDS[kind]) and not (kind == "int" and isinstance(value, bool))
            if not fits or kind == "date" and isinstance(value, dt.datetime):
                raise TypeError(f"{type(self).__name__}.{field.name} must be {field.type}, not {value!r}")

    @classmethod
    def from_text(cls, **texts: str | None) -> Parameters:
        """From the texts of a form; names as in the class."""
        known = {f.name: f.type.split("[")[0].split(" ")[0] for f in dc.fields(cls)}
        unknown = sorted(set(texts) - set(known))
        if unknown:
            raise TypeError(f"{cls.__name__} has no {', '.join(unknown)}")
        values = {n: None if _no_value(t) else _READERS[known[n]](t) for n, t in texts.items()}
        needed = {f.name for f in dc.fields(cls) if "None" not in f.type}
        return cls(**{n: v for n, v in values.items() if v is not None or n not in needed})

    def args(self) -> dict:
        """The parameters as arguments of ``spark.sql``."""
        return {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in dc.fields(self)}


# ---------------------------------------------------------------- reports
@dc.dataclass(frozen=True)
class BacklogParameters(Parameters):
    start: date  # noqa: F821
    end: date  # noqa: F821
    location: str | None = None
    category: int = 0

    def run(self, tables: Mapping[str, DataFrame], **more) -> DataFrame:
        from shopfloor.plans.backlog import backlog_snapshot

        return backlog_snapshot(tables, self.start, self.end, self.location, category=self.category, **more)


@dc.dataclass(frozen=True)
class LabelParameters(Parameters):
    session: str | None = None
    lite_attribute: str = "LITE"
    logo_attribute: str = "LOGO"

    def run(self, tables: Mapping[str, DataFrame], **more) -> DataFrame:
        from shopfloor.plans.labels import work_cell_labels

        return work_cell_labels(tables, self.session, self.lite_attribute, self.logo_attribute, **more)


@dc.dataclass(frozen=True)
class DemandParameters(Parameters):
    part: str | None = None
    suffix: str | None = None
    location: str | None = None

    def run(self, tables: Mapping[str, DataFrame], **more) -> DataFrame:
        from shopfloor.plans.demand import so_quantity_detail

        return so_quantity_detail(tables, self.part, self.suffix, self.location, **more)

    def sql(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
        return spark.sql(DEMAND_SQL, args=self.args(), **contracted(tables, "demand"))


@dc.dataclass(frozen=True)
class UsageParameters(Parameters):
    end: datetime  # noqa: F821
    location: str | None = None
    categories: tuple[int, ...] | None = None
    tracking_enabled: bool = False
    system_cost_method: int = 0

    def run(self, tables: Mapping[str, DataFrame], **more) -> DataFrame:
        from shopfloor.plans.usage import usage_by_period

        return usage_by_period(
            tables, self.end, location=self.location, categories=self.categories, tracking_enabled=self.tracking_enabled,
            system_cost_method=self.system_cost_method, **more,
        )

    def sql(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
        frames = contracted(tables, "usage", ("general_setup", "part_multipliers"))
        frames |= {n: never_broadcast(frames[n]) for n in ("inventory", "inventory_detail", "master_part_list")}
        args = self.args()
        # the columns hold local times
        args["end"] = self.end.isoformat(sep=" ")
        return spark.sql(USAGE_SQL, args=args, **frames)


# --------------------------------------------------------------- statements
DEMAND_SQL = """
WITH parts AS (SELECT MasterPartNo AS PartNo, PartNoSuffix, Description, GUID FROM {master_part_list}),
asked AS (SELECT GUID FROM parts WHERE (:part IS NULL OR PartNo = :part) AND (:suffix IS NULL OR PartNoSuffix = :suffix)),
shown AS (
  SELECT odKey, SerialNumber, ItemType, AlternativeODKey, OrderType, ClosedDate, Cancelled, PlanDate, ReqDate, OrderNumber,
         LineItem, SubLineItem, o.CustomerRef, PONumber, concat_ws('-', d.PartNo, d.PartNoSuffix) AS Part, Description,
         CASE WHEN Status = 0 THEN 'On Hold' END AS IsOnHold,
         if(AckDate IS NOT NULL, 'Acknowledged', 'Unacknowledged') AS IsAcknowledged, Status, AckDate
  FROM {order_detail} d JOIN {orders} o USING (oKey) JOIN parts p ON p.PartNo = d.PartNo AND p.PartNoSuffix = d.PartNoSuffix),
viewed AS (
  SELECT shown.*, QuantityOnSalesOrder AS SOQty
  FROM shown JOIN {inventory_order_detail_quantities} v USING (odKey)
  WHERE AlternativeODKey IS NULL AND (:part IS NULL OR v.PartNo = :part)
    AND (:suffix IS NULL OR v.PartNoSuffix = :suffix) AND (:location IS NULL OR v.LocationID = :location)),
roles AS (
  SELECT SerialNumber, IssuePartQty, inline(array(struct(2 AS branch, IssuePartGUID AS GUID), struct(3 AS branch, SecondaryIssuePartGUID AS GUID)))
  FROM {inventory_detail_serialized} WHERE Status = 1 AND (:location IS NULL OR LocationID = :location)),
issued AS (
  SELECT branch, PlanDate, ReqDate, OrderNumber, LineItem, SubLineItem, CustomerRef, PONumber, Part, Description, IsOnHold,
         IsAcknowledged, if(branch = 2, sum(IssuePartQty), count(1)) AS SOQty
  FROM roles JOIN asked USING (GUID) JOIN shown USING (SerialNumber) JOIN {inventory_results} r USING (odKey)
  WHERE ItemType = 4 AND OrderType IN (1, 4) AND NOT Cancelled AND ClosedDate = TIMESTAMP_NTZ '1900-01-01 00:00:00'
    AND CompleteQty < TotalQty
  GROUP BY branch, PlanDate, ReqDate, OrderNumber, LineItem, SubLineItem, CustomerRef, PONumber, Part, Description, IsOnHold,
           IsAcknowledged, Status, AckDate)
SELECT * FROM (
  SELECT PlanDate, ReqDate, OrderNumber, LineItem, SubLineItem, CustomerRef, PONumber, Part, Description, SOQty, IsOnHold,
         IsAcknowledged FROM viewed
  UNION ALL
  SELECT PlanDate, ReqDate, OrderNumber, LineItem, SubLineItem, CustomerRef, PONumber, Part, Description, SOQty, IsOnHold,
         IsAcknowledged FROM issued)
WHERE SOQty <> 0 ORDER BY PlanDate
"""

USAGE_SQL = """
WITH moved AS (
  SELECT PartNo, PartNoSuffix, LocationID, -QuantityOnHandAdj AS quantity,
         InvTransDate >= :end::TIMESTAMP_NTZ - INTERVAL 30 DAYS AS in_30,
         InvTransDate >= :end::TIMESTAMP_NTZ - INTERVAL 60 DAYS AS in_60
  FROM {inventory_trans} JOIN {inventory_trans_detail} USING (InvTransID)
  WHERE QuantityOnHandAdj <> 0 AND LocationID IS NOT NULL AND (:location IS NULL OR LocationID = :location)
    AND InvTransDate BETWEEN :end::TIMESTAMP_NTZ - INTERVAL 90 DAYS AND :end::TIMESTAMP_NTZ),
priced AS (
  SELECT concat_ws('-', moved.PartNo, moved.PartNoSuffix) AS Part, m.Description, coalesce(g.Description, '') AS InvCategory, StockUOM,
         CurrencyCulture AS CostingCultureInfo, CostUOM, CategoryID, quantity, in_30, in_60,
         1 + in_30::INT + in_60::INT AS windows,
         CASE WHEN :tracking_enabled THEN AvgCost WHEN coalesce(CostMethod, :system_cost_method) = 0 THEN StdCost
              WHEN coalesce(CostMethod, :system_cost_method) = 1 THEN AvgCost ELSE LastCost END AS cost
  FROM moved JOIN {inventory} USING (PartNo, PartNoSuffix) JOIN {inventory_detail} USING (PartNo, PartNoSuffix, LocationID)
  JOIN {locations} USING (LocationID) JOIN {culture_currencies} c ON c.CultureInfo = CurrencyCulture
  JOIN {master_part_list} m ON m.MasterPartNo = moved.PartNo AND m.PartNoSuffix = moved.PartNoSuffix
  JOIN {categories} g ON g.ID = CategoryID
  WHERE :categories IS NULL OR array_contains(CAST(:categories AS ARRAY<INT>), CategoryID))
SELECT Part, Description, InvCategory,
       greatest(max(quantity) FILTER (WHERE in_30), 0) AS `30 Days Quantity`,
       greatest(max(cost * quantity) FILTER (WHERE in_30), 0) AS `30 Days Total Cost`,
       greatest(max(quantity) FILTER (WHERE in_60), 0) AS `60 Days Quantity`,
       greatest(max(cost * quantity) FILTER (WHERE in_60), 0) AS `60 Days Total Cost`,
       greatest(max(quantity), if(bool_or(in_60), 0, NULL)) AS `90 Days Quantity`,
       greatest(max(cost * quantity), if(bool_or(in_60), 0, NULL)) AS `90 Days Total Cost`,
       sum(cost * windows) / sum(windows) FILTER (WHERE cost IS NOT NULL) AS CurrentCost,
       StockUOM, CostingCultureInfo, CostUOM, CategoryID
FROM priced
GROUP BY Part, Description, InvCategory, StockUOM, CostingCultureInfo, CostUOM, CategoryID
ORDER BY InvCategory, Part
"""
