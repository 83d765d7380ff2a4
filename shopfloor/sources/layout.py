"""How the big tables lie on disk, so that reports read and move less.

* By month: inventory movements and their lines in partitions of the
  movement's month.  The lines have no date of their own; given the month once,
  when they are written, a look-back report reads the months of its window and
  nothing else.
* By key: tables in buckets of ``odKey`` (or ``oKey``).  Joins, windows and
  aggregations on the key, or on more columns than the key, then need no
  shuffle of them.  Joins on more columns take buckets as they are only where
  ``spark.sql.requireAllClusterKeysForCoPartition`` is off: one key with very
  many rows then stays in one task, so it is the caller's choice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.filters import ts_literal

MONTH = "InvTransMonth"
#: The key that each table lies by.
BUCKET_KEYS = {
    "label_parts": "odKey", "order_detail": "odKey", "order_detail_attributes": "odKey", "order_detail_plans": "odKey",
    "shortcuts": "odKey", "inventory_order_detail_quantities": "odKey", "inventory_results": "odKey", "orders": "oKey",
    "order_relations": "ChildoKey", "order_prices": "oKey", "order_facts": "oKey",
}


def with_month(trans: DataFrame, detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Movements and lines with the movement's month (its first day); lines
    without a movement are in no report and go."""
    trans = trans.withColumn(MONTH, F.trunc("InvTransDate", "MM"))
    return trans, detail.join(trans.select("InvTransID", MONTH), "InvTransID")


def write_by_month(trans: DataFrame, detail: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Write both tables in partitions by month and read them back.  Rows of a
    month are dealt over tasks by movement, so that a month holding very many
    rows is written by many."""
    out = {}
    names = ("inventory_trans", "inventory_trans_detail")
    for name, df in zip(names, with_month(trans, detail), strict=True):
        path = f"{folder.rstrip('/')}/{name}"
        spread = F.pmod(F.xxhash64("InvTransID"), F.lit(8))
        df.repartition(MONTH, spread).write.partitionBy(MONTH).parquet(path)
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


def in_months(df: DataFrame, dated: DataFrame, date: str, end: dt.datetime | str, days: int) -> DataFrame:
    """The rows of the months that the ``days`` before ``end`` touch: constants
    when the report is planned, so other partitions are never listed or read."""
    last = ts_literal(dated, date, end)
    first = last - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(MONTH).between(F.trunc(first, "MM"), F.trunc(last, "MM")))


def write_by_key(tables: Mapping[str, DataFrame], names: Mapping[str, str], buckets: int) -> dict[str, DataFrame]:
    """Save the tables that have a key in ``BUCKET_KEYS`` as catalog tables
    (``names``: contract -> table name) in that many sorted buckets; the others
    stay as they are."""
    out = dict(tables)
    for table, name in names.items():
        key = BUCKET_KEYS[table]
        df = tables[table]
        # one file a bucket, not one a task and bucket
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
        out[table] = df.sparkSession.table(name)
    return out
