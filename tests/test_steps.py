"""The label report in steps: what stays on disk, what travels, and the same
rows; the tables are made here."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shopfloor.operators.joins import key_bits, may_occur
from shopfloor.plans.labels import work_cell_labels
from shopfloor.sources import testmap as TM
from shopfloor.sources.staging import Steps
from shopfloor.sources.tables import LazyTables

ORDERS, LINES = 2_000, 4


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Orders and lines with repeated lines, an order of very many lines and
    nulls."""
    folder = f"file://{tmp_path_factory.mktemp('raw')}"
    r = lambda n: F.pmod(F.xxhash64("i", F.lit(n)), F.lit(1_000_003)).cast("long")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (r(n) % len(v) + 1).cast("int"))
    day = lambda n: F.lit("1996-01-01").cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))
    lines = spark.range(ORDERS * LINES).withColumnRenamed("id", "i").select(
        F.when(F.col("i") % 997 == 5, None).when(F.col("i") % 40 == 0, 7).otherwise((F.col("i") / LINES).cast("long")).alias("l_orderkey"),
        F.when(F.col("i") % 991 == 3, None).otherwise(r(1) % 300).alias("l_partkey"), F.when(F.col("i") % 983 == 2, None).otherwise(r(2) % 50).alias("l_suppkey"),
        (r(3) % 7 + 1).cast("int").alias("l_linenumber"), (r(4) % 50 + 1).cast("double").alias("l_quantity"), (r(5) / 10).alias("l_extendedprice"),
        (r(6) % 11 / 100).alias("l_discount"), (r(7) % 9 / 100).alias("l_tax"), pick(8, "A", "N", "R").alias("l_returnflag"), pick(9, "O", "F").alias("l_linestatus"),
        F.when(F.col("i") % 977 == 1, None).otherwise(day(r(10) % 2000)).alias("l_shipdate"),
    )
    lines.union(lines.filter("l_extendedprice < 3000")).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    orders = spark.range(ORDERS).withColumnRenamed("id", "i").select(
        F.col("i").alias("o_orderkey"), (r(1) % 200).alias("o_custkey"), pick(2, "O", "F", "P").alias("o_orderstatus"), (r(3) / 10).alias("o_totalprice"),
        day(r(4) % 2000).alias("o_orderdate"), pick(5, "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW").alias("o_orderpriority"),
    )
    orders.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def _shuffled(spark) -> dict[str, int]:
    """The shuffle files on disk, with their bytes."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: os.path.getsize(f"{d}/{f}") for top in local for d, _, files in os.walk(str(top)) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def _dealt_out(spark, run):
    """``run`` where no table is small enough to be sent whole by itself."""
    name, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        return run()
    finally:
        spark.conf.set(name, old)


@pytest.mark.parametrize("name", ["work_cell_labels", "labels_one_session", "labels_nocase"])
def test_a_label_query_leaves_the_files_of_its_order_only(spark, made, tmp_path, name):
    """Before, those of every exchange stayed, the payload of all parts among
    them."""
    before = _shuffled(spark)
    out = f"file://{tmp_path}/out"
    _dealt_out(spark, lambda: E.queries()[name](spark, made).write.parquet(out))
    left = {f: n for f, n in _shuffled(spark).items() if f not in before}
    assert len({f.split("_")[1] for f in left}) <= 1, left
    rows = spark.read.parquet(out).count()
    assert rows > 100 and sum(left.values()) < 700 * rows


def test_the_steps_give_the_rows_of_the_report(spark, made):
    raw = LazyTables(spark, made)
    for session, more in ((None, {"include_extra": True}), (TM.SESSION, {})):
        steps = Steps(spark)
        whole = work_cell_labels(TM.label_tables(raw), session=session, **more)
        stepped = _dealt_out(spark, lambda s=session, m=more, t=steps: work_cell_labels(TM.label_tables(raw, t.keep), session=s, store=t, **m))
        got = stepped.collect()
        assert stepped.columns == whole.columns and len(got) > 100
        assert sorted(map(repr, got)) == sorted(map(repr, whole.collect()))
        assert [r["Sequence"] for r in got] == sorted(r["Sequence"] for r in got)
        # what the result was made from is gone
        assert steps.kept == [] and "scratch" not in "".join(stepped.inputFiles())


def test_stored_lines_get_their_positions_once(spark, made):
    """Every table of the labels is then read from them, without a window."""
    from tests.conftest import plan_text

    steps, raw = Steps(spark), LazyTables(spark, made)
    tables, lazy = TM.label_tables(raw, steps.keep), TM.label_tables(raw)
    plans = {name: plan_text(df) for name, df in tables.items()}
    assert not [name for name, plan in plans.items() if "Window" in plan or "Exchange" in plan]
    for name in ("label_parts", "order_detail", "order_detail_plans"):
        assert sorted(map(repr, tables[name].collect())) == sorted(map(repr, lazy[name].collect()))
    steps.last(tables["orders"].limit(0))


def test_marked_bits_lose_no_key_and_keep_few_others(spark):
    steps = Steps(spark)
    keys = spark.range(0, 300_000, 6).select(F.when(F.col("id") % 30 != 0, F.col("id") * 7919).alias("k"))
    keys = steps.keep(keys.union(keys.limit(1000)))
    found = key_bits(keys, ["k"], steps.keep)
    rows = spark.range(300_000).select((F.col("id") * 7919).cast("decimal(20,0)").cast("long").alias("k"), F.col("id").alias("v"))
    kept = may_occur(rows, found, ["k"])
    assert kept.columns == rows.columns
    wanted = rows.join(keys.distinct(), "k")
    assert kept.join(wanted, "k", "left_semi").count() == wanted.count() == 40_000
    assert kept.count() < 40_000 + 0.15 * 260_000
    # a shorter whole number is the same key; nothing is found among no keys
    short = spark.createDataFrame([(6 * 7919, "a")], "k int, v string")
    assert may_occur(short, found, ["k"]).count() == 1
    assert may_occur(rows, key_bits(steps.keep(keys.limit(0)), ["k"], steps.keep), ["k"]).count() == 0
    steps.last(keys.limit(0))
