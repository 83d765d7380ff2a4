import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopfloor.functions import (
    format_employee,
    is_open_closed_date,
    parse_int_list,
    render_stage,
    signed_price,
    status_name,
    unit_cost,
)


def test_parse_int_list_tolerates_blanks_and_dupes():
    assert parse_int_list("279, 311, 75, 270, 271") == [279, 311, 75, 270, 271]
    assert parse_int_list(" 2, 5 ,2, 6") == [2, 5, 6]
    assert parse_int_list("1,,2") == [1, 0, 2]  # trap: an empty token is 0
    assert parse_int_list("") == [0]
    assert parse_int_list(None) is None
    with pytest.raises(ValueError):
        parse_int_list("1,x")


def test_status_and_sign(spark):
    df = spark.createDataFrame(
        [(0, "Credit", 10.0), (1, "Sales", 10.0), (2, "CREDIT", 5.0), (3, "credit", 1.0), (None, None, 2.0)],
        "s int, d string, p double",
    )
    out = df.select(status_name("s").alias("n"), signed_price("p", "d").alias("v")).collect()
    assert [r["n"] for r in out] == ["On Hold", "Available", "Unknown", "Released", "Unknown"]
    assert [r["v"] for r in out] == [-10.0, 10.0, -5.0, -1.0, 2.0]


def test_unit_cost_methods(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "m int").withColumns(
        {"std": F.lit(1.0), "avg": F.lit(2.0), "last": F.lit(3.0)}
    )
    got = [r[0] for r in df.select(unit_cost(False, "m", 0, "std", "avg", "last")).collect()]
    assert got == [1.0, 2.0, 3.0, 1.0]
    got = [r[0] for r in df.select(unit_cost(False, "m", 2, "std", "avg", "last")).collect()]
    assert got == [1.0, 2.0, 3.0, 3.0]
    got = [r[0] for r in df.select(unit_cost(True, "m", 0, "std", "avg", "last")).collect()]
    assert got == [2.0, 2.0, 2.0, 2.0]


def test_render_stage_and_stuff(spark):
    df = spark.createDataFrame([("CUT", ["05-01", "05-02"]), ("TEMP", []), ("X", None)], "i string, d array<string>")
    got = [r[0] for r in df.select(render_stage("i", "d")).collect()]
    assert got == ["CUT ( 05-01 & 05-02)", None, None]


def test_employee_name_and_sentinel(spark):
    df = spark.createDataFrame(
        [("Doe", "Jo", dt.datetime(1900, 1, 1)), (None, None, None), ("Doe", None, dt.datetime(2001, 1, 1))],
        "l string, f string, c timestamp_ntz",
    )
    out = df.select(format_employee("l", "f").alias("n"), is_open_closed_date("c").alias("o")).collect()
    assert [r["n"] for r in out] == ["Doe, Jo", None, "Doe"]
    assert [r["o"] for r in out] == [True, None, False]
