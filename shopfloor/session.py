"""SparkSession helpers shared by tests, bench and the driver entry point."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every plan in this package relies on.  AQE re-plans joins from
# runtime sizes (shuffle join -> broadcast when a side turns out small,
# skewed partitions split), so operators never force a broadcast of a side
# whose size is not bounded by construction.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "shopfloor",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package's base configuration.

    On a cluster ``master`` stays None so spark-submit decides; in tests and
    the bench a ``local[N]`` master is passed explicitly.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
