"""Connected components by alternating large and small stars.

Every round is a minimum per vertex and a join; the edges are written to the
shared folder between rounds, so that neither lineage nor a single task
grows, and a vertex with very many edges is only ever a join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.tables import materialise


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges with u > v: each vertex's smaller neighbours move to the least."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(u, v): every vertex u that has an edge and is not the least of its
    component, with that least vertex v.  ``edges`` has two long columns;
    loops are ignored.  The rounds' tables are written to ``folder``."""
    a, b = edges.columns
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        folder,
    )

    def state(df: DataFrame) -> tuple:
        s = df.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(s)

    seen = state(now)
    while True:
        now = materialise(_small(_large(now)), folder)
        then, seen = seen, state(now)
        if then == seen:
            return now
