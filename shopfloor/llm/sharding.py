"""Sharding: a reproducible shuffle into shards whose place is computable.

Rows get global numbers 0..n-1 in the order of (id, CRC-32, size, copy); a
keyed Feistel network permutes a power-of-two domain around n, and cycle
walking keeps the result inside [0, n).  The permuted number p gives shard
``p % shards`` and slot ``p // shards``, so shard counts differ by one at
most, slots have no gaps, and any row's place follows from its number, n,
the shard count and the key alone.

Numbering needs no single task: rows are range-partitioned and sorted, the
numbered rows (four small columns, no text) are written once, and the sizes
of the partitions, one number each, give the offsets.

Defined cases: a null text is an empty text; null ids sort first; repeated
rows are told apart by a copy number; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shopfloor.llm.tables import materialise

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on uint64 arrays (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    b = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(b)) - 1)
    left, right = x >> b, x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right + k) & mask)
    return (left << b) | right


def _network_back(y: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    b = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(b)) - 1)
    left, right = y >> b, y & mask
    for k in keys[::-1]:
        left, right = right ^ (_mix(left + k) & mask), left
    return (left << b) | right


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    out = step(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = step(out[far])
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The shuffled place in [0, n) of each row number in [0, n)."""
    return _walk(np.asarray(rows), n, lambda x: _network(x, n, _keys(seed)))


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each shuffled place; undoes ``permute``."""
    return _walk(np.asarray(places), n, lambda x: _network_back(x, n, _keys(seed)))


def number_rows(rows: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """``rows`` with ``row``, their number from 0 in the order of the columns
    ``order``, which must tell all rows apart."""
    local = (
        rows.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    local = materialise(local.withColumn("part", F.shiftright("at", 33)))
    sizes = {r["part"]: r["n"] for r in local.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    spark = rows.sparkSession
    start = spark.createDataFrame(offsets, "part long, start long")
    numbered = local.join(F.broadcast(start), "part")  # one row a range partition
    return numbered.withColumn("row", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn(
        "total", F.lit(total).cast("long")
    ).drop("at", "part", "start")


def assign_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    seed: int = 0,
    partitions: int = 64,
) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus ``overhead``),
    text_crc32, row (global number), shard and slot.  ``partitions`` is how
    many ranges the numbering is dealt over."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = (
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
        )
        .groupBy("id", "crc", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("id", "crc", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    )
    numbered = number_rows(keyed, ["id", "crc", "size", "copy"], partitions)

    @F.pandas_udf(LongType())
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for row, total in parts:
            yield pd.Series(permute(row.to_numpy(), int(total.iloc[0]), seed) if len(row) else row, dtype="int64")

    return numbered.withColumn("p", place("row", "total")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "row",
        F.pmod("p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"p div {int(shards)}").cast("long").alias("slot"),
    )
