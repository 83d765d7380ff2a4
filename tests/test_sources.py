from shopfloor.operators.settings import setting
from shopfloor.sources.schemas import LABEL_PART_COLUMNS, LABEL_PASS_THROUGH
from shopfloor.sources.tables import catalog_tables


def test_setting_lookup_with_default(spark):
    gs = spark.createDataFrame([("CostingMethod", "1"), ("Other", "x")], "Parameter string, Value string")
    assert setting(gs, "CostingMethod") == "1"
    assert setting(gs, "Missing", default="0") == "0"
    assert setting(gs, "Missing") is None


def test_label_contract_shape():
    assert len(LABEL_PART_COLUMNS) == 104
    assert len(LABEL_PASS_THROUGH) == 102


def test_tables_by_qualified_name(spark):
    spark.createDataFrame([(1,)], "oKey long").createOrReplaceTempView("erp_orders")
    assert catalog_tables(spark, {"orders": "erp_orders"})["orders"].collect() == [(1,)]


def test_line_keys_are_unique(spark):
    from shopfloor.sources import testmap as TM
    from shopfloor.sources.tables import LazyTables

    lines = TM.order_tables(LazyTables(spark, "/root/testdata/sf0.001"))["order_detail"]
    n = lines.count()
    assert lines.select("odKey").distinct().count() == lines.select("SerialNumber").distinct().count() == n


def test_dimension_keys_are_unique(spark):
    from shopfloor.sources import testmap as TM
    from shopfloor.sources.tables import LazyTables

    t = TM.backlog_tables(LazyTables(spark, "/root/testdata/sf0.001"))
    for name, keys in (("order_types", ["OrderType"]), ("customers", ["CustomerID", "SiteID"]), ("customers", ["CustomerGUID"]), ("employees", ["EmployeeID"])):
        assert t[name].select(*keys).distinct().count() == t[name].count()
