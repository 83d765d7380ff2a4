"""Tables by month and by key: what is read, and what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from shopfloor.plans.labels import work_cell_labels
from shopfloor.plans.usage import usage_by_period
from shopfloor.sources import testmap as TM
from shopfloor.sources.layout import MONTH, write_by_key, write_by_month
from shopfloor.sources.tables import LazyTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inventory(spark, tmp_path_factory):
    t = dict(TM.inventory_tables(LazyTables(spark, SF)))
    folder = f"file://{tmp_path_factory.mktemp('months')}"
    return t, {**t, **write_by_month(t["inventory_trans"], t["inventory_trans_detail"], folder)}


def _metric(df, node: str, metric: str) -> list[int]:
    """A metric of the executed plan's nodes whose text holds ``node``."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if hasattr(p, "plan") and name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if node in p.simpleString(1000) and p.metrics().contains(metric):
            found.append(p.metrics().apply(metric).value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def _rows_of(df, *args):
    return sorted(map(repr, df.collect()))


def test_only_the_windows_months_are_read(inventory):
    plain, by_month = inventory
    read = {}
    for days in ((10,), (30, 60, 90), (700,)):
        got = usage_by_period(by_month, "2000-03-15 12:00:00", days=days)
        assert _rows_of(got) == _rows_of(usage_by_period(plain, "2000-03-15 12:00:00", days=days))
        read[days] = sum(_metric(got, "PartitionFilters: [isnotnull(InvTransMonth", "numOutputRows"))
        plan = got.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        assert len(re.findall(r"PartitionFilters: \[isnotnull\(InvTransMonth#\d+\), \(InvTransMonth", plan)) >= 2
    lines = plain["inventory_trans_detail"].count()
    assert 0 < read[(10,)] < read[(30, 60, 90)] < read[(700,)] < 1.25 * lines
    assert read[(10,)] < lines / 20


def test_lines_without_months_get_a_runtime_filter(spark, inventory, tmp_path):
    """On plain tables too big to broadcast, Spark builds a Bloom filter of the
    window's movements and sifts the lines before their shuffle."""
    plain = {}
    for name, df in inventory[0].items():
        df.write.parquet(f"file://{tmp_path}/{name}")
        plain[name] = spark.read.parquet(f"file://{tmp_path}/{name}")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        shuffled = {}
        for days in ((10,), (700,)):
            got = usage_by_period(plain, "2000-03-15 12:00:00", days=days, location="MAIN")
            assert "might_contain" in got._jdf.queryExecution().optimizedPlan().toString()
            got.collect()
            shuffled[days] = max(_metric(got, "hashpartitioning(InvTransID", "shuffleRecordsWritten"))
        assert shuffled[(10,)] < shuffled[(700,)] / 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_labels_on_buckets_shuffle_no_stored_table_by_line(spark):
    raw = TM.label_tables(LazyTables(spark, SF))
    names = {t: f"bucketed_{t}" for t in ("label_parts", "order_detail", "order_detail_attributes", "order_detail_plans", "shortcuts")}
    tables = write_by_key(raw, names, 8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "4000", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)

        def by_line(df):  # the staged keys lie by line as well
            df.repartition(8, "odKey").write.bucketBy(8, "odKey").sortBy("odKey").mode("overwrite").saveAsTable("bucketed_keys")
            return spark.table("bucketed_keys")

        staged = work_cell_labels(tables, session=TM.SESSION, stage=by_line)
        plan = staged._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
        # no stored table is shuffled by its line; the narrow keys are once,
        # on their way back from the orders
        by_lines = [e for e in exchanges if "odKey" in e and "description" not in e]
        assert len(by_lines) <= 1, exchanges
        scans = plan.split("FileScan")[1:]
        assert all("Bucketed: true" in x for x in scans if re.search(r"odKey#\d+", x.split("\n")[0])), plan
        assert _rows_of(staged) == _rows_of(work_cell_labels(raw, session=TM.SESSION))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        for name in (*names.values(), "bucketed_keys"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_month_column_is_the_first_day(inventory):
    t = inventory[1]["inventory_trans"]
    assert t.filter(F.col(MONTH) != F.trunc("InvTransDate", "MM")).count() == 0
