"""Input contracts (Spark types) of the reports, one for every input table.

Only the staged label parts and open orders have declared types in the
reference; every other type is inferred from use (FIXTURES.md).  Keys are
``long`` here where the ERP uses ``int``: at the target scale an int key
space overflows, and widening never changes join results.  How a frame is held
to its contract is in ``contracts.py``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, SH, L, F, B, TS, D, BIN = (
    T.StringType(),
    T.IntegerType(),
    T.ShortType(),
    T.LongType(),
    T.FloatType(),
    T.BooleanType(),
    T.TimestampNTZType(),
    T.DateType(),
    T.BinaryType(),
)

# The staged label-part columns in declaration order (the
# label report returns them in this order, minus Thumbnail and Remake).
LABEL_PART_COLUMNS: list[tuple[str, T.DataType]] = [
    ("ReportID", S), ("ReportDesc", S), ("DisplayFractions", B), ("BinSource", SH),
    ("DisplayCallSize", B), ("ReleaseDate", TS), ("SchedID", I), ("ScheduleDesc", S),
    ("WorkRouteAttrValue", S), ("WorkRouteDesc", S), ("BatchID", SH), ("BatchDesc", S),
    ("oKey", L), ("odKey", L), ("Customer", S), ("OrderNumber", S), ("OrderItem", SH),
    ("OrderItemSubLineItem", SH), ("PONumber", S), ("CustomerRef", S), ("ReqDate", TS),
    ("TargetShipDate", TS), ("PackingType", S), ("PackingNote", S), ("UnitID", SH),
    ("MasterKey", I), ("ParentKey", I), ("Barcode", S), ("PartNo", S), ("PartNoSuffix", S),
    ("PartDesc", S), ("Quantity", SH), ("Width", F), ("Height", F), ("Thickness", F), ("Weight", F),
    ("OverallPartNo", S), ("OverallPartNoSuffix", S), ("OverallPartDesc", S), ("OverallWidth", F),
    ("OverallHeight", F), ("OverallThickness", F), ("OverallCallSize", S), ("DisplayWidth", F),
    ("DisplayHeight", F), ("DisplayThickness", F), ("WorkFlow", S), ("RackSort", I), ("RackType", I),
    ("RackID", S), ("StackID", S), ("Slot", I), ("SubSlot", I), ("Bin", S), ("SecondaryBin", S),
    ("GlassID", SH), ("Options", S), ("Attributes", S), ("PartTypes", S), ("Notes", S), ("Notes1", S),
    ("CustomerID", S), ("SiteID", S), ("Name", S), ("SiteName", S), ("ShpAddr_CompanyName", S),
    ("Route", S), ("OrderItemQty", SH), ("OrderItemXofItemQty", SH), ("OrderItemXofOrderQty", SH),
    ("OrderQty", SH), ("Misc", S),
    ("OrdersUserDef1", S), ("OrdersUserDef2", S), ("OrdersUserDef3", S), ("OrdersUserDef4", S),
    ("OrdersUserDef5", S), ("OrdersUserDef6", S), ("OrdersUserDef7", S), ("OrdersUserDef8", S),
    ("OrdersUserDef9", S), ("OrdersUserDef10", S),
    ("CustomersUserDef1", S), ("CustomersUserDef2", S), ("CustomersUserDef3", S), ("CustomersUserDef4", S),
    ("CustomersUserDef5", S), ("CustomersUserDef6", S), ("CustomersUserDef7", S), ("CustomersUserDef8", S),
    ("CustomersUserDef9", S), ("CustomersUserDef10", S),
    ("InvLocation", S), ("PreShippingRack", S), ("PreShippingStackID", S), ("PreShippingSlot", SH),
    ("PreShippingSubSlot", SH), ("ShippingContainerID", S), ("MullContainerKey", I), ("ServerDate", TS),
    ("StartingSchedule", I), ("StartingUnit", SH), ("Thumbnail", BIN), ("Remake", I),
]

LABEL_PART_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in LABEL_PART_COLUMNS])

# Columns the label report passes through (declaration order).
LABEL_PASS_THROUGH = [n for n, _ in LABEL_PART_COLUMNS if n not in ("Thumbnail", "Remake")]


#: The types by the names used below (no session is needed to read them).
_TYPES = {
    "string": S, "int": I, "short": SH, "long": L, "boolean": B, "timestamp_ntz": TS, "date": D,
    "decimal(18,2)": T.DecimalType(18, 2), "decimal(18,4)": T.DecimalType(18, 4), "decimal(18,6)": T.DecimalType(18, 6),
    "decimal(19,4)": T.DecimalType(19, 4),
}


def _fields(columns: str) -> T.StructType:
    named = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


_MONEY, _QUANTITY, _FACTOR = "decimal(19,4)", "decimal(18,4)", "decimal(18,6)"

#: Every input table with its columns.
CONTRACTS: dict[str, T.StructType] = {
    "orders": _fields(
        "oKey long, OrderNumber string, Date timestamp_ntz, ShipDate timestamp_ntz, Status short, OrderType short,"
        " CustomerID string, SiteID string, ProjectGUID string, EnteredBy string, SalesPersonID string,"
        f" CustomerRef string, PONumber string, OrderContact string, CurrencyMultiplier {_FACTOR}, TaxAmount {_MONEY},"
        " Notes string, Terms string, CompleteDate timestamp_ntz, ReqDate timestamp_ntz, AckDate timestamp_ntz,"
        f" ClosedDate timestamp_ntz, Cancelled boolean, Comments string, ShpAddr_Comments string, TotalPrice {_MONEY}"
    ),
    "order_detail": _fields(
        "odKey long, oKey long, ItemType short, AlternativeODKey long, PartNo string, PartNoSuffix string,"
        " PlanDate date, LineItem short, SubLineItem short, SerialNumber string, Comment string, CustomerRef string"
    ),
    "order_types": _fields("OrderType short, Description string"),
    "customers": _fields("CustomerID string, SiteID string, CustomerGUID string, Name string, SiteName string"),
    "employees": _fields("EmployeeID string, LastName string, FirstName string, LocationID string"),
    "order_relations": _fields("ChildoKey long, RelationType short"),
    "orders_open": _fields(
        "OrderDate timestamp_ntz, OrderNumber string, CompleteDate timestamp_ntz, OrderType string, TargetShipDate date,"
        " ReqDate date, Customer string, SalesPerson string, OrderTotal decimal(18,2), CultureInfo string"
    ),
    "orders_open_by_category": _fields("OrderNumber string, TargetShipDate date, CategoryID int"),
    "order_prices": _fields(f"oKey long, TotalPrice {_MONEY}"),
    "order_facts": _fields(
        f"oKey long, IncQuantity {_QUANTITY}, Status string, InvoiceAmount {_MONEY}, Subtotal {_MONEY},"
        f" TotalDimensions {_QUANTITY}, QtyTotal {_QUANTITY}, ItemTotal long, OrderWeight {_QUANTITY}, DecimalPlaces int,"
        " CultureInfo string, UOM string"
    ),
    "translations": _fields("Text string, Translation string"),
    "label_parts": LABEL_PART_SCHEMA,
    "opti_report_lites": _fields(
        "SessionGUID string, ProdType short, SchedID int, UnitID short, MasterKey int, ParentKey int, ReleaseID int,"
        " Sequence int"
    ),
    "order_detail_attributes": _fields(
        "odKey long, MasterKey int, ParentKey int, ParamText string, ParamValue string, ParamValue2 string"
    ),
    "order_detail_plans": _fields("odKey long, ParentKey int, WorkCellID int, PlanDate date"),
    "work_cells": _fields("ID int, Description string"),
    "shortcuts": _fields("odKey long, ShortcutDesc string"),
    "inventory_trans": _fields("InvTransID long, InvTransDate timestamp_ntz, LocationID string, InvTransMonth date"),
    "inventory_trans_detail": _fields(
        f"InvTransID long, PartNo string, PartNoSuffix string, QuantityOnHandAdj {_QUANTITY}, InvTransMonth date"
    ),
    "inventory": _fields(
        "PartNo string, PartNoSuffix string, CostMethod short, StockUOM string, CostUOM string, CategoryID int"
    ),
    "inventory_detail": _fields(
        f"PartNo string, PartNoSuffix string, LocationID string, StdCost {_MONEY}, AvgCost {_MONEY}, LastCost {_MONEY}"
    ),
    "locations": _fields("LocationID string, CurrencyCulture string"),
    "culture_currencies": _fields("CultureInfo string"),
    "categories": _fields("ID int, Description string"),
    "master_part_list": _fields("MasterPartNo string, PartNoSuffix string, GUID string, Description string"),
    "general_setup": _fields("Parameter string, Value string"),
    "part_multipliers": _fields(f"PartNo string, PartNoSuffix string, multiplier {_FACTOR}"),
    "inventory_order_detail_quantities": _fields(
        f"odKey long, PartNo string, PartNoSuffix string, LocationID string, QuantityOnSalesOrder {_QUANTITY}"
    ),
    "inventory_detail_serialized": _fields(
        f"SerialNumber string, IssuePartGUID string, SecondaryIssuePartGUID string, IssuePartQty {_QUANTITY},"
        " Status short, LocationID string"
    ),
    "inventory_results": _fields(f"odKey long, CompleteQty {_QUANTITY}, TotalQty {_QUANTITY}"),
    "item_attributes": _fields("item_id long, name string, value string"),
    "item_group_codes": _fields("item_id long, group_name string, code string"),
    "item_options": _fields("item_id long, option string, group_name string"),
}

#: Columns that are never NULL (primary keys).
KEYS: dict[str, tuple[str, ...]] = {
    "orders": ("oKey",),
    "order_detail": ("odKey",),
    "order_types": ("OrderType",),
    "customers": ("CustomerID", "SiteID"),
    "employees": ("EmployeeID",),
    "order_prices": ("oKey",),
    "order_facts": ("oKey",),
    "translations": ("Text",),
    "work_cells": ("ID",),
    "inventory_trans": ("InvTransID",),
    "inventory": ("PartNo", "PartNoSuffix"),
    "inventory_detail": ("PartNo", "PartNoSuffix", "LocationID"),
    "locations": ("LocationID",),
    "culture_currencies": ("CultureInfo",),
    "categories": ("ID",),
    "master_part_list": ("MasterPartNo", "PartNoSuffix"),
    "general_setup": ("Parameter",),
    "part_multipliers": ("PartNo", "PartNoSuffix"),
    "item_attributes": ("item_id", "name"),
    "item_group_codes": ("item_id", "group_name"),
    "item_options": ("item_id",),
}

#: Columns holding GUIDs, which are equal whatever their case and braces.
GUIDS = {"ProjectGUID", "CustomerGUID", "SessionGUID", "GUID", "IssuePartGUID", "SecondaryIssuePartGUID"}

#: Text keys and codes that a case-blind database compares without regard to
#: case and blanks at the end.  Edge-work names are not among them: that
#: calculation compares its texts itself, by case.
CODES: dict[str, tuple[str, ...]] = {
    "orders": ("OrderNumber", "CustomerID", "SiteID", "EnteredBy", "SalesPersonID"),
    "order_detail": ("PartNo", "PartNoSuffix", "SerialNumber"),
    "order_types": ("Description",),
    "customers": ("CustomerID", "SiteID"),
    "employees": ("EmployeeID", "LocationID"),
    "orders_open": ("OrderNumber",),
    "orders_open_by_category": ("OrderNumber",),
    "translations": ("Text",),
    "label_parts": (),
    "order_detail_attributes": ("ParamText",),
    "work_cells": ("Description",),
    "inventory_trans": ("LocationID",),
    "inventory_trans_detail": ("PartNo", "PartNoSuffix"),
    "inventory": ("PartNo", "PartNoSuffix"),
    "inventory_detail": ("PartNo", "PartNoSuffix", "LocationID"),
    "locations": ("LocationID", "CurrencyCulture"),
    "culture_currencies": ("CultureInfo",),
    "master_part_list": ("MasterPartNo", "PartNoSuffix"),
    "general_setup": ("Parameter",),
    "part_multipliers": ("PartNo", "PartNoSuffix"),
    "inventory_order_detail_quantities": ("PartNo", "PartNoSuffix", "LocationID"),
    "inventory_detail_serialized": ("SerialNumber", "LocationID"),
}

#: What each report reads (``?``: a column it can do without, then NULL;
#: ``*``: one that it uses where there is one).
REPORT_INPUTS: dict[str, dict[str, str]] = {
    "usage": {
        "inventory_trans": "InvTransID InvTransDate LocationID InvTransMonth*",
        "inventory_trans_detail": "InvTransID PartNo PartNoSuffix QuantityOnHandAdj InvTransMonth*",
        "inventory": "PartNo PartNoSuffix CostMethod StockUOM CostUOM CategoryID",
        "inventory_detail": "PartNo PartNoSuffix LocationID StdCost AvgCost LastCost",
        "locations": "LocationID CurrencyCulture",
        "culture_currencies": "CultureInfo",
        "master_part_list": "MasterPartNo PartNoSuffix Description",
        "categories": "ID Description",
        "general_setup": "Parameter Value",
        "part_multipliers": "PartNo PartNoSuffix multiplier",
    },
    "demand": {
        "orders": "oKey ReqDate OrderNumber CustomerRef PONumber Status AckDate ClosedDate Cancelled OrderType",
        "order_detail": "odKey oKey ItemType AlternativeODKey SerialNumber PartNo PartNoSuffix PlanDate LineItem SubLineItem",
        "master_part_list": "MasterPartNo PartNoSuffix GUID Description",
        "inventory_order_detail_quantities": "odKey PartNo PartNoSuffix LocationID QuantityOnSalesOrder",
        "inventory_detail_serialized": "SerialNumber IssuePartGUID SecondaryIssuePartGUID IssuePartQty Status LocationID",
        "inventory_results": "odKey CompleteQty TotalQty",
    },
    "backlog": {
        "orders": "oKey OrderNumber Date ShipDate Status OrderType CustomerID SiteID ProjectGUID EnteredBy SalesPersonID"
        " CustomerRef PONumber OrderContact CurrencyMultiplier TaxAmount Notes Terms CompleteDate TotalPrice*",
        "order_types": "OrderType Description",
        "customers": "CustomerID SiteID CustomerGUID Name SiteName",
        "order_detail": "odKey oKey ItemType AlternativeODKey",
        "employees": "EmployeeID LastName FirstName LocationID",
        "order_relations": "ChildoKey RelationType",
        "orders_open": "OrderNumber TargetShipDate",
        "orders_open_by_category": "OrderNumber TargetShipDate CategoryID",
        "order_prices": "oKey TotalPrice",
        "order_facts": "oKey IncQuantity* Status* InvoiceAmount* Subtotal* TotalDimensions* QtyTotal* ItemTotal*"
        " OrderWeight* DecimalPlaces* CultureInfo* UOM*",
        "translations": "Text Translation",
    },
    "labels": {
        "label_parts": "SchedID UnitID MasterKey ParentKey oKey odKey WorkFlow OverallPartDesc"
        + "".join(
            f" {n}?"
            for n in LABEL_PASS_THROUGH
            if n not in "SchedID UnitID MasterKey ParentKey oKey odKey WorkFlow OverallPartDesc".split()
        ),
        "opti_report_lites": "SessionGUID ProdType SchedID UnitID MasterKey ParentKey ReleaseID Sequence",
        "order_detail_attributes": "odKey MasterKey ParentKey ParamText ParamValue ParamValue2",
        "orders": "oKey Comments CustomerRef ShpAddr_Comments",
        "order_detail": "odKey Comment CustomerRef",
        "order_detail_plans": "odKey ParentKey WorkCellID PlanDate",
        "work_cells": "ID Description",
        "shortcuts": "odKey ShortcutDesc",
    },
    "edge": {
        "item_attributes": "item_id name value",
        "item_group_codes": "item_id group_name code",
        "item_options": "item_id option group_name",
    },
}
