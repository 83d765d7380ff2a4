import datetime as dt

from shopfloor.plans.backlog import backlog_snapshot
from shopfloor.plans.demand import so_quantity_detail
from tests.conftest import plan_text

SENTINEL = dt.datetime(1900, 1, 1)
ORDER_COLS = (
    "oKey long, OrderNumber string, Date timestamp_ntz, ShipDate timestamp_ntz, Status int, OrderType int, "
    "CustomerID string, SiteID string, ProjectGUID string, EnteredBy string, SalesPersonID string, "
    "CustomerRef string, PONumber string, OrderContact string, CurrencyMultiplier double, TaxAmount double, "
    "Notes string, Terms string, CompleteDate timestamp_ntz, ReqDate timestamp_ntz, AckDate timestamp_ntz, "
    "ClosedDate timestamp_ntz, Cancelled boolean, TotalPrice double"
)


def _order(okey, date, status=1, otype=1, entered="E1", closed=SENTINEL, cancelled=False, price=10.0, mult=1.0,
           project=None, ack=None):
    return (okey, f"SO{okey}", date, date, status, otype, "C1", "0", project, entered, "E2", "ref", "po",
            "contact", mult, 1.0, "n", "t", None, date, ack, closed, cancelled, price)


def _detail(spark, rows):
    return spark.createDataFrame(
        rows,
        "odKey long, oKey long, ItemType int, AlternativeODKey long, PartNo string, PartNoSuffix string, "
        "PlanDate date, LineItem int, SubLineItem int, SerialNumber string, Comment string, CustomerRef string",
    )


def _line(od, ok, item_type=4, alt=None, part="P1", serial=None):
    return (od, ok, item_type, alt, part, "0000", dt.date(2024, 1, 1), 1, 0, serial or f"SN{od}", "c", "r")


def test_demand_three_sources_and_filters(spark):
    d = dt.datetime(2024, 1, 1)
    orders = spark.createDataFrame(
        [
            _order(1, d), _order(2, d, otype=4), _order(3, d, closed=d), _order(4, d, closed=None),
            _order(5, d, cancelled=True), _order(6, d, otype=3),
        ],
        ORDER_COLS,
    )
    detail = _detail(spark, [_line(10, 1), _line(20, 2), _line(30, 3), _line(40, 4), _line(50, 5), _line(60, 6),
                             _line(11, 1, alt=99)])
    mpl = spark.createDataFrame(
        [("P1", "0000", "G1", "part one"), ("P9", "0000", "G9", "issued part")],
        "MasterPartNo string, PartNoSuffix string, GUID string, Description string",
    )
    view = spark.createDataFrame(
        [(10, "P1", "0000", "MAIN", 5.0), (11, "P1", "0000", "MAIN", 7.0), (20, "P1", "0000", "MAIN", None),
         (30, "P1", "0000", "EAST", 3.0)],
        "odKey long, PartNo string, PartNoSuffix string, LocationID string, QuantityOnSalesOrder double",
    )
    ser = spark.createDataFrame(
        [
            ("SN20", "G9", "G9", 2.0, 1, "MAIN"), ("SN20", "G9", None, 3.0, 1, "MAIN"),  # issue sum 5, count 1
            ("SN30", "G9", None, 1.0, 1, "MAIN"),  # order closed -> dropped
            ("SN40", "G9", None, 1.0, 1, "MAIN"),  # closed date NULL -> dropped
            ("SN50", "G9", None, 1.0, 1, "MAIN"),  # cancelled -> dropped
            ("SN60", "G9", None, 1.0, 1, "MAIN"),  # order type 3 -> dropped (T11)
            ("SN10", "G9", None, -2.0, 1, "MAIN"), ("SN10", "G9", None, 2.0, 1, "MAIN"),  # sums to 0 -> dropped
        ],
        "SerialNumber string, IssuePartGUID string, SecondaryIssuePartGUID string, IssuePartQty double, "
        "Status int, LocationID string",
    )
    results = spark.createDataFrame(
        [(20, 1.0, 5.0), (20, 1.0, 5.0), (30, 0.0, 1.0), (40, 0.0, 1.0), (50, 0.0, 1.0), (60, 0.0, 1.0), (10, 0.0, 1.0)],
        "odKey long, CompleteQty double, TotalQty double",
    )
    t = {"orders": orders, "order_detail": detail, "master_part_list": mpl,
         "inventory_order_detail_quantities": view, "inventory_detail_serialized": ser, "inventory_results": results}
    out = so_quantity_detail(t, part="P9", suffix="0000", location="MAIN").collect()
    got = sorted((r["OrderNumber"], r["SOQty"], r["Description"]) for r in out)
    # results row doubled for line 20 (T14): SUM 10, COUNT 2; displayed part is the line's part
    assert got == [("SO2", 2.0, "part one"), ("SO2", 10.0, "part one")]
    view_only = so_quantity_detail(t, part="P1", suffix="0000", location="MAIN").collect()
    assert sorted((r["OrderNumber"], r["SOQty"]) for r in view_only) == [("SO1", 5.0)]  # alt line, NULL qty out


def _backlog_tables(spark, orders, details, open_rows, relations=()):
    return {
        "orders": spark.createDataFrame(orders, ORDER_COLS),
        "order_types": spark.createDataFrame([(1, "Sales"), (3, "Credit")], "OrderType int, Description string"),
        "customers": spark.createDataFrame([("C1", "0", "G1", "Cust", "Site")],
                                           "CustomerID string, SiteID string, CustomerGUID string, Name string, SiteName string"),
        "order_detail": _detail(spark, details),
        "employees": spark.createDataFrame([("E1", "Doe", "Jo", "MAIN"), ("E2", "Roe", "Al", "EAST")],
                                           "EmployeeID string, LastName string, FirstName string, LocationID string"),
        "order_relations": spark.createDataFrame(list(relations) or [(0, 0)], "ChildoKey long, RelationType int"),
        "orders_open": spark.createDataFrame(open_rows, "OrderNumber string, TargetShipDate date"),
    }


def test_backlog_semantics(spark):
    day = dt.datetime(2024, 5, 1)
    orders = [
        _order(1, day, status=0), _order(2, day, status=1, otype=3, price=10.0, mult=2.0),
        _order(3, day, status=2), _order(4, day.replace(hour=23, minute=59), status=3),
        _order(5, day, status=None, project="G1"), _order(6, dt.datetime(2024, 5, 2)),  # next day: out
        _order(7, day, entered=None), _order(8, day), _order(9, day),
    ]
    details = [_line(11, 1), _line(12, 1, item_type=5), _line(13, 1, alt=1), _line(14, 1, item_type=None),
               _line(21, 2), _line(91, 9), _line(92, 9)]
    d1, d2 = dt.date(2024, 6, 1), dt.date(2024, 6, 2)
    open_rows = [(f"SO{k}", d1) for k in (1, 2, 3, 4, 5, 6, 7, 8)] + [("SO9", d1), ("SO9", d1), ("SO8", d2)]
    t = _backlog_tables(spark, orders, details, open_rows, relations=[(3, 2), (4, 1)])
    out = {(r["oKey"], r["TargetShipDate"]): r for r in backlog_snapshot(t, "2024-05-01", "2024-05-01").collect()}
    assert (3, d1) not in out  # relation type 2 child dropped; type 1 kept
    assert (6, d1) not in out  # 00:00 next day dropped; 23:59 kept
    assert out[(1, d1)]["statusName"] == "On Hold" and out[(1, d1)]["LineItems"] == 1
    assert out[(2, d1)]["TotalPrice"] == 20.0 and out[(2, d1)]["ActualPrice"] == -20.0
    assert out[(4, d1)]["statusName"] == "Released"
    assert out[(5, d1)]["statusName"] == "Unknown" and out[(5, d1)]["ProjectName"] == "Site"
    assert out[(1, d1)]["ProjectName"] == ""
    assert out[(7, d1)]["EmployeeName"] is None and out[(1, d1)]["EmployeeName"] == "Doe, Jo"
    assert out[(9, d1)]["LineItems"] == 4  # two lines x two open rows (T10)
    assert (8, d1) in out and (8, d2) in out  # two target dates -> two rows
    assert out[(8, d1)]["month"] == "May" and out[(8, d1)]["year"] == 2024
    assert len(backlog_snapshot(t, "2024-05-01", "2024-05-01").columns) == 37
    located = {r["oKey"] for r in backlog_snapshot(t, "2024-05-01", "2024-05-01", location="MAIN").collect()}
    assert 7 not in located and 1 in located  # T9


def test_backlog_plan_uses_anti_join(spark):
    day = dt.datetime(2024, 5, 1)
    t = _backlog_tables(spark, [_order(1, day)], [_line(11, 1)], [("SO1", dt.date(2024, 6, 1))], [(1, 2)])
    plan = plan_text(backlog_snapshot(t, "2024-05-01", "2024-05-01"))
    assert "LeftAnti" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
