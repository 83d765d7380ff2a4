"""What a report keeps on the driver, on disk and in one task as its tables
grow: read from the plans; the rows are made here."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shopfloor.operators.edge import item_layers, with_layer_flags
from shopfloor.operators.joins import attribute_pairs
from shopfloor.params import UsageParameters
from shopfloor.plans.labels import label_sequence, work_cell_labels
from shopfloor.plans.usage import usage_by_period
from shopfloor.plans.workflow import plan_date_workflow, stage_dates, with_plan_dates
from tests.conftest import plan_text

END = dt.datetime(2024, 8, 1)


@pytest.fixture
def stock(spark, tmp_path):
    """Usage tables whose files are small, as packed files are."""
    rows = {
        "inventory_trans": ([(1, END, "MAIN")], "InvTransID long, InvTransDate timestamp_ntz, LocationID string"),
        "inventory_trans_detail": ([(1, "A", "0", -5.0)], "InvTransID long, PartNo string, PartNoSuffix string, QuantityOnHandAdj double"),
        "inventory": ([("A", "0", 0, "EA", "EA", 1)], "PartNo string, PartNoSuffix string, CostMethod int, StockUOM string, CostUOM string, CategoryID int"),
        "inventory_detail": ([("A", "0", "MAIN", 1.0, 2.0, 3.0)], "PartNo string, PartNoSuffix string, LocationID string, StdCost double, AvgCost double, LastCost double"),
        "locations": ([("MAIN", "en-US")], "LocationID string, CurrencyCulture string"),
        "culture_currencies": ([("en-US",)], "CultureInfo string"),
        "master_part_list": ([("A", "0", "G", "a part")], "MasterPartNo string, PartNoSuffix string, GUID string, Description string"),
        "categories": ([(1, "Glass")], "ID int, Description string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in rows}


def test_no_table_of_parts_is_collected_on_the_driver(spark, stock):
    """Codes are broadcast; parts, which the business grows, are not, however
    small their files look."""
    for df in (UsageParameters(END, categories=(1,)).sql(spark, stock), usage_by_period(stock, END, categories=[1])):
        broadcast = re.findall(r"BroadcastHashJoin \[(.*?)\],", plan_text(df))
        assert broadcast and not [keys for keys in broadcast if "PartNo" in keys or "InvTransID" not in keys and "Part" in keys]
        assert [(r["Part"], r["30 Days Quantity"], r["CurrentCost"]) for r in df.collect()] == [("A-0", 5.0, 1.0)]


def _routes(spark):
    routes = spark.createDataFrame(
        [(1, 1, "CUT, TEMP,CUT"), (1, 1, "CUT, TEMP,CUT"), (1, 2, "CUT"), (2, None, "TEMP"), (3, 1, None), (None, 1, "CUT")],
        "odKey long, ParentKey int, WorkFlow string",
    )
    day = lambda m, d: dt.date(2024, m, d)
    plans = spark.createDataFrame(
        [(1, 0, 1, day(5, 2)), (1, 0, 1, day(5, 2)), (1, 1, 2, day(5, 1)), (1, 2, 1, day(4, 9)), (1, 1, 3, day(6, 1)),
         (2, 0, 3, day(7, 1)), (2, 1, 3, day(7, 2)), (2, None, 3, day(7, 3)), (None, 0, 1, day(8, 1))],
        "odKey long, ParentKey int, WorkCellID int, PlanDate date",
    )
    return routes, plans, spark.createDataFrame([(1, "CUT"), (2, "CUTTING"), (3, "TEMP")], "ID int, Description string")


def test_a_route_travels_once_before_its_stages_are_made(spark):
    routes, plans, cells = _routes(spark)
    for df in (stage_dates(routes, plans, cells), plan_date_workflow(routes, plans, cells)):
        dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_text(df))
        keys = [k for d in dealt if (k := re.sub(r"#\d+L?", "", d)) not in ("WorkCellID", "ID")]
        assert keys == ["odKey", "odKey"], dealt
    df = stage_dates(routes, plans, cells)
    found = {(r["odKey"], r["ParentKey"], r["pos"], r["item"]): r["dates"] for r in df.collect()}
    assert found == {
        (1, 1, 0, "CUT"): ["05-01", "05-02"], (1, 1, 1, "TEMP"): ["06-01"], (1, 1, 2, "CUT"): ["05-01", "05-02"],
        (1, 2, 0, "CUT"): ["04-09", "05-02"], (2, None, 0, "TEMP"): ["07-01"],
    }


def test_rows_lying_by_line_get_their_route_strings_where_they_are(spark):
    routes, plans, cells = _routes(spark)
    routes = routes.union(spark.createDataFrame([(1, None, "CUT"), (1, 1, "BOXING"), (9, 1, "CUT"), (1, 1, "")], routes.schema))
    cells = cells.union(spark.createDataFrame([(4, None), (2, "CUT")], cells.schema))
    plans = plans.union(spark.createDataFrame([(1, 0, 4, dt.date(2024, 9, 9)), (1, 1, 1, None)], plans.schema))
    for blind in (False, True):
        named = cells.withColumn("Description", F.collate(F.initcap("Description"), "UTF8_LCASE_RTRIM")) if blind else cells
        lying = routes.repartition("odKey")
        df = with_plan_dates(lying, plans, named)
        dealt = [re.sub(r"#\d+L?", "", d) for d in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_text(df))]
        assert [k for k in dealt if k not in ("WorkCellID", "ID")] == ["odKey", "odKey"], dealt
        texts = {tuple(r[:3]): r[3] for r in plan_date_workflow(routes, plans, named).collect()}
        assert texts[1, 1, "CUT, TEMP,CUT"] == "CUT ( 05-01 & 05-02), TEMP ( 06-01), CUT ( 05-01 & 05-02)"
        got = sorted(map(repr, (tuple(r) for r in df.collect())))
        assert got == sorted(repr((*r, texts.get(tuple(r)))) for r in routes.collect()), got


def test_label_keys_travel_by_line_once(spark):
    """The lines' derived tables share one exchange, and route strings none of
    their own."""
    from shopfloor.sources import testmap as TM
    from shopfloor.sources.tables import LazyTables

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(work_cell_labels(TM.label_tables(LazyTables(spark, "/root/testdata/sf0.001"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = [re.sub(r"#\d+L?", "", d) for d in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]
    assert not [d for d in dealt if "WorkFlow" in d], dealt
    filtered = {bool(re.search(r"isnotnull\(l_orderkey", scan.split("\n")[0])) for scan in plan.split("FileScan")[1:] if "l_shipdate" in scan.split("\n")[0]}
    assert filtered == {False}, plan


def test_a_gap_is_a_few_numbers(spark):
    """Films at two interlayers, codes, a stop; each flag is one bit set."""
    codes = [(1, "LITE 1 GLASS", "LAM4"), (2, "LITE 1 GLASS", "LAM3")]
    gap = lambda item, i, s, code: codes.append((item, f"LITE 1.{i} {s}", code))
    for s, code in (("INTERLAYERS", "3PLY"), ("PROCESS", "AN"), ("IL2 TYPE", "ILSGP"), ("IL2", "IMSCIPI"), ("IL3 TYPE", "ILPRT"), ("IL12 TYPE", "ILPRT")):
        gap(1, 1, s, code)
    for s, code in (("INTERLAYERS", "1PLY"), ("IL2 TYPE", "ILFAB")):  # a film beyond the count
        gap(1, 2, s, code)
    for s, code in (("INTERLAYERS", "XPLY"), ("IL1 TYPE", "ILFAB")):
        gap(1, 3, s, code)
    for s, code in (("INTERLAYERS", "9PLY"), ("IL9 TYPE", "ILNAT")):
        gap(2, 9, s, code)
    gap(2, 1, "INTERLAYERS", "0PLY")
    groups = spark.createDataFrame(codes, "item_id long, group_name string, code string")
    options = spark.createDataFrame([(2, "SHATOP", "LITE 1.2 OPTION")], "item_id long, option string, group_name string")
    layers = item_layers(groups, options)
    got = {(r["item_id"], r["lite"]): r.asDict() for r in layers.collect()}
    flags = ("glass_digit", "ok_gaps", "stop_gaps", "post_gaps", "pre_gaps", "sgp_gaps")
    assert len(layers.columns) == 2 + len(flags)
    assert [got[1, "1"][f] for f in flags] == [4, 0b110, 0, 0b10, 0, 0b10]
    assert [got[2, "1"][f] for f in flags] == [3, 0b1000000010, 0b100, 0, 1 << 9, 0]
    flagged = with_layer_flags(layers.withColumn("layers", F.col("glass_digit")))
    by_item = {r["item_id"]: (r["post"], r["pre"], r["sgp"], r["layer_error"]) for r in flagged.collect()}
    assert by_item[1] == (True, False, True, True)  # gap 3's count is unreadable
    assert by_item[2] == (True, False, False, True)  # the stop gap has no count


def test_label_sequences_keep_one_sort_and_no_map(spark):
    lites = spark.createDataFrame(
        [("S", 0, 1, 1, 1, 0, 5, 50), ("S", 2, 1, 1, 1, 0, 4, 60), ("S", 1, 1, 1, 1, 0, 4, 50), ("S", 1, 1, 1, 1, 0, 9, 90), ("S", 1, 1, 1, 1, 0, 9, 90),
         ("S", 0, 1, 1, 2, 0, None, None), ("S", 1, 1, 1, 2, 0, None, None), ("S", 1, 1, 1, 2, 0, None, 7), ("S", 1, 1, 1, 3, None, 1, 1), ("S", 0, 1, 1, 3, None, 1, 1), ("S", 7, 1, 1, 4, 0, 1, 1)],
        "SessionGUID string, ProdType short, SchedID int, UnitID short, MasterKey int, ParentKey int, ReleaseID int, Sequence int",
    )
    df = label_sequence(lites, None)
    plan = plan_text(df)
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1 and plan.count(" Sort [") == 1, plan
    got = sorted((tuple(r[c] for c in ("MasterKey", "ReleaseID", "Sequence")) for r in df.collect()), key=str)
    assert got == sorted([(1, 4, 50), (1, 9, 90), (2, None, None), (2, None, 7), (3, 1, 1)], key=str)


def test_attribute_pairs_keep_no_map(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    rows = [(1, "LITE", "a", None), (1, "LITE", "a", None), (1, "LITE", "b", None), (1, "LOGO", None, "x"), (1, "LOGO", None, "x"), (2, "LOGO", None, None), (2, "COLOR", "c", "c")]
    eav = spark.createDataFrame(rows, "k long, ParamText string, ParamValue string, ParamValue2 string")
    out = attribute_pairs(df, eav, ["k"], ("LITE", "ParamValue", "Lite"), ("LOGO", "ParamValue2", "Logo"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "x"), (1, "b", "x"), (2, "", ""), (3, "", "")]
    assert "HashAggregate" not in plan_text(out)
