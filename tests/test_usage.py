import datetime as dt
import random

import pytest

from shopfloor.plans.usage import usage_by_period
from tests.conftest import plan_text

END = dt.datetime(2024, 8, 1, 12, 0)


def _tables(spark, trans, detail, parts, costs):
    """parts: (PartNo, CostMethod, CategoryID); costs: (PartNo, Loc, std, avg, last)."""
    return {
        "inventory_trans": spark.createDataFrame(trans, "InvTransID long, InvTransDate timestamp_ntz, LocationID string"),
        "inventory_trans_detail": spark.createDataFrame(
            [(t, p, "0000", q) for t, p, q in detail],
            "InvTransID long, PartNo string, PartNoSuffix string, QuantityOnHandAdj double",
        ),
        "inventory": spark.createDataFrame(
            [(p, "0000", m, "EA", "EA", c) for p, m, c in parts],
            "PartNo string, PartNoSuffix string, CostMethod int, StockUOM string, CostUOM string, CategoryID int",
        ),
        "inventory_detail": spark.createDataFrame(
            [(p, "0000", loc, s, a, la) for p, loc, s, a, la in costs],
            "PartNo string, PartNoSuffix string, LocationID string, StdCost double, AvgCost double, LastCost double",
        ),
        "locations": spark.createDataFrame([("MAIN", "en-US"), ("EAST", "en-US")], "LocationID string, CurrencyCulture string"),
        "culture_currencies": spark.createDataFrame([("en-US",)], "CultureInfo string"),
        "master_part_list": spark.createDataFrame(
            [(p, "0000", f"G{p}", f"desc {p}") for p, _, _ in parts],
            "MasterPartNo string, PartNoSuffix string, GUID string, Description string",
        ),
        "categories": spark.createDataFrame([(1, "Glass"), (2, "Film")], "ID int, Description string"),
    }


def _by_part(df):
    return {r["Part"]: r for r in df.collect()}


def test_golden_windows(spark):
    d = lambda days: END - dt.timedelta(days=days)
    trans = [
        (1, d(10), "MAIN"), (2, d(45), "MAIN"), (3, d(80), "MAIN"),  # part A
        (4, d(80), "MAIN"),  # part B only old
        (5, d(10), "MAIN"),  # part C only recent positive adj
        (6, d(10), "MAIN"), (7, d(80), "EAST"),  # part D two locations
        (8, END, "MAIN"), (9, d(90), "MAIN"),  # bounds (part F)
        (10, d(5), "MAIN"), (11, d(5), None),  # zero adj and NULL location (part F)
        (12, d(80), "MAIN"),  # part E NULL cost
        (13, d(91), "MAIN"),  # outside
    ]
    detail = [
        (1, "A", -5.0), (2, "A", -7.0), (3, "A", -9.0),
        (4, "B", 4.0), (5, "C", 4.0),
        (6, "D", -1.0), (7, "D", -1.0),
        (8, "F", -2.0), (9, "F", -3.0), (10, "F", 0.0), (11, "F", -50.0), (13, "F", -70.0),
        (12, "E", -6.0),
    ]
    parts = [("A", 0, 1), ("B", 0, 1), ("C", 0, 1), ("D", 0, 1), ("E", 2, 1), ("F", 0, 2)]
    costs = [
        ("A", "MAIN", 2.0, 2.0, 2.0), ("B", "MAIN", 2.0, 2.0, 2.0), ("C", "MAIN", 2.0, 2.0, 2.0),
        ("D", "MAIN", 1.0, 1.0, 1.0), ("D", "EAST", 3.0, 3.0, 3.0), ("E", "MAIN", 1.0, 1.0, None),
        ("F", "MAIN", 1.0, 1.0, 1.0),
    ]
    out = _by_part(usage_by_period(_tables(spark, trans, detail, parts, costs), END, categories="1, 2"))
    a = out["A-0000"]
    assert (a["30 Days Quantity"], a["60 Days Quantity"], a["90 Days Quantity"]) == (5.0, 7.0, 9.0)  # T4
    assert (a["30 Days Total Cost"], a["90 Days Total Cost"]) == (10.0, 18.0)
    b = out["B-0000"]
    assert (b["30 Days Quantity"], b["60 Days Quantity"], b["90 Days Quantity"]) == (0.0, 0.0, -4.0)  # T5
    c = out["C-0000"]
    assert (c["30 Days Quantity"], c["60 Days Quantity"], c["90 Days Quantity"]) == (0.0, 0.0, 0.0)
    assert out["D-0000"]["CurrentCost"] == pytest.approx(1.5)  # T6: (3*1 + 1*3) / 4
    e = out["E-0000"]
    assert e["90 Days Total Cost"] is None and e["90 Days Quantity"] == 6.0
    f = out["F-0000"]
    assert f["InvCategory"] == "Film"
    assert f["30 Days Quantity"] == 2.0 and f["90 Days Quantity"] == 3.0  # T8 both bounds, zero/NULL excluded
    assert out["A-0000"]["InvCategory"] == "Glass"


def _by_rule(trans, detail, parts, costs, end, days):
    """The rules in plain Python: every movement stands once in each window
    that holds it; a window's largest value counts entries of other windows as
    0; the cost is averaged over the entries."""
    method = {p: m or 0 for p, m, _ in parts}
    cost = {(p, loc): (std, avg, last)[min(method[p], 2)] for p, loc, std, avg, last in costs}
    when = {t: (ts, loc) for t, ts, loc in trans}
    entries = {}
    for t, part, moved in detail:
        ts, loc = when[t]
        if moved == 0 or (part, loc) not in cost:
            continue
        for d in days:
            if end - dt.timedelta(days=d) <= ts <= end:
                entries.setdefault(part, []).append((d, -moved, cost[part, loc]))
    out = {}
    for part, own in entries.items():
        row = out[f"{part}-0000"] = {"Part": f"{part}-0000"}
        for d in days:
            worth = [(None if c is None else c * q) if w == d else 0 for w, q, c in own]
            row[f"{d} Days Quantity"] = max(q if w == d else 0 for w, q, _ in own)
            row[f"{d} Days Total Cost"] = max((x for x in worth if x is not None), default=None)
        known = [c for _, _, c in own if c is not None]
        row["CurrentCost"] = sum(known) / len(known) if known else None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_rules(spark, seed):
    rnd = random.Random(seed)
    trans, detail = [], []
    for tid in range(300):
        trans.append((tid, END - dt.timedelta(days=rnd.randint(0, 120), hours=rnd.randint(0, 23)),
                      rnd.choice(["MAIN", "EAST", None])))
        for _ in range(rnd.randint(1, 3)):
            detail.append((tid, rnd.choice("ABCDEFGH"), float(rnd.randint(-20, 20))))
    parts = [(p, rnd.choice([0, 1, 2, None]), 1) for p in "ABCDEFGH"]
    costs = [
        (p, loc, float(rnd.randint(1, 9)), rnd.choice([None, 2.5]), float(rnd.randint(-3, 5)))
        for p in "ABCDEFGH" for loc in ("MAIN", "EAST")
    ]
    t = _tables(spark, trans, detail, parts, costs)
    for days in [(30, 60, 90), (7,), (15, 45)]:
        fast = usage_by_period(t, END, days=days).drop(
            "Description", "InvCategory", "StockUOM", "CostingCultureInfo", "CostUOM", "CategoryID"
        )
        f = {r["Part"]: r.asDict() for r in fast.collect()}
        s = _by_rule(trans, detail, parts, costs, END, days)
        assert f.keys() == s.keys()
        for part in f:
            for k, v in s[part].items():
                assert f[part][k] == pytest.approx(v), (days, part, k)


def test_plan_has_no_nested_loop_and_pushes_range(spark):
    d = lambda days: END - dt.timedelta(days=days)
    t = _tables(spark, [(1, d(1), "MAIN")], [(1, "A", -1.0)], [("A", 0, 1)], [("A", "MAIN", 1.0, 1.0, 1.0)])
    plan = plan_text(usage_by_period(t, END))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_instants_keep_their_fraction(spark):
    """Both bounds count microseconds: a row inside the range by less than a
    second stays, one outside it by less than a second goes."""
    end = dt.datetime(2024, 8, 1, 12, 0, 0, 900_000)
    start = end - dt.timedelta(days=90)
    tick = dt.timedelta(microseconds=1)
    trans = [(1, end - dt.timedelta(milliseconds=400), "MAIN"), (2, end + tick, "MAIN"), (3, start, "MAIN"), (4, start - tick, "MAIN")]
    detail = [(1, "A", -1.0), (2, "A", -10.0), (3, "A", -3.0), (4, "A", -100.0)]
    t = _tables(spark, trans, detail, [("A", 0, 1)], [("A", "MAIN", 1.0, 1.0, 1.0)])
    row = usage_by_period(t, end).collect()[0]
    assert (row["30 Days Quantity"], row["90 Days Quantity"]) == (1.0, 3.0)


def test_sorted_by_category_and_part(spark):
    parts = [("B", 0, 1), ("A", 0, 1), ("C", 0, 2)]
    t = _tables(spark, [(1, END, "MAIN")], [(1, p, -1.0) for p, _, _ in parts], parts, [(p, "MAIN", 1.0, 1.0, 1.0) for p, _, _ in parts])
    got = [(r["InvCategory"], r["Part"]) for r in usage_by_period(t, END).collect()]
    assert got == [("Film", "C-0000"), ("Glass", "A-0000"), ("Glass", "B-0000")]
