"""The cleaning pipeline over ``documents``: each stage calls one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs.  All stages but the last
return the columns they were given; columns beyond id and text pass through,
whatever their names.  The shuffle files of a stage may go once the next one
begins.

Defined cases: null texts are empty texts and go with the quality rules; of
rows that repeat a doc_id one stays; rows with a null doc_id are no copies of
anything and cannot be told apart as leaks, so both stages keep them; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm.bpe import encode_documents
from shopfloor.llm.decontaminate import find_leaks
from shopfloor.llm.line_dedup import dedup_lines
from shopfloor.llm.quality_rules import quality_rules
from shopfloor.llm.shingle_join import near_duplicates
from shopfloor.llm.tables import free_prefix, materialise, only, read, release


def _as(docs: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with the text taken from ``text``."""
    return done.select(*[F.col(f"`{text}`").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and failing lines of those that stay."""
    p = free_prefix(docs)
    judged = quality_rules(docs, prefix=p)
    return _as(docs, judged.where(F.col(f"`{p}kept`")), f"{p}clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = free_prefix(docs)
    done = dedup_lines(docs, kept_col=f"{p}kept", lines_col=f"{p}lines", dropped_col=f"{p}dropped")
    return _as(docs, done, f"{p}kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    p = free_prefix(docs)
    release(spark)
    labels = materialise(near_duplicates(only(docs, ["doc_id", "text"])))
    release(spark)
    first = labels.where(F.col("doc") == F.col("component_id")).groupBy("doc").agg(F.count(F.lit(1)).alias("rows"))
    first = first.select(F.col("doc").alias(f"{p}doc"), F.col("rows").alias(f"{p}rows"))
    kept = docs.join(first, docs["doc_id"] == first[f"{p}doc"])
    single = kept.where(F.col(f"`{p}rows`") == 1).select(docs["*"])
    # of rows that repeat an id the one whose JSON has the least digest (columns
    # of any type, maps included); there are none in a sound table
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    least = F.min_by(row, F.sha2(F.to_json(row), 256)).alias(f"{p}row")
    several = kept.where(F.col(f"`{p}rows`") > 1).groupBy(f"`{p}doc`").agg(least).select(f"`{p}row`.*")
    return single.union(several).union(docs.where(F.col("doc_id").isNull()))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    release(spark)
    leaks = find_leaks(only(docs, ["doc_id", "text"]), read(spark, sf_dir, "benchmark"))
    p = free_prefix(docs)
    # stored, so that Spark knows its size before it deals out the documents
    bad = materialise(leaks.select(F.col("doc").alias(f"{p}doc")).distinct())
    release(spark)
    return docs.join(bad, docs["doc_id"] == bad[f"{p}doc"], "left_anti")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and digests of them and of their decoding."""
    release(spark)
    taken = {c.lower() for c in docs.columns} & {"n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), prefix=free_prefix(docs) if taken else "")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", leak_stage),
    ("bpe_encoding", encode_stage),
]
#: The near-duplicate, retrieval and encoding stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage is written and reread."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
