"""Line dedup: drop lines that many documents hold.

Lines are exploded with their position, normalised and hashed to 128 bits;
documents per hash are counted on distinct (hash, document) rows, so a line
that a third of all documents hold is combined before it is shuffled; the
positions to drop come back to their document by one join and the kept lines
are reassembled in order.  Everything is a built-in function.

Defined cases: a null text is an empty text, which has one empty line; rows
that repeat a doc_id are one document, each row keeping its own text; a null
doc_id counts as one document smaller than every other; an empty table gives
an empty table; columns other than the id and the text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.tables import SPACE, lower_ascii, spare_name


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, t1, t2, drop): the line positions each distinct document text
    loses; (t1, t2) is the text's 128-bit hash."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    lines = lines.where(F.char_length(key) >= min_chars).select(
        "doc", "t1", "t2", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")
    )
    counted = (
        lines.groupBy("k1", "k2", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2")
        .agg(F.count("one").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("k1", "k2", "keeper")
    )
    hit = lines.join(counted, ["k1", "k2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return hit.groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias("drop"))


def without(lines: Column, drop: Column) -> Column:
    """The lines whose position is not in ``drop``, joined by a line feed.
    The array is bound once, and the set difference is linear."""
    kept = F.transform(
        F.array(lines),
        lambda ls: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop), lambda i: F.get(ls, i)
            ),
            "\n",
        ),
    )
    return F.get(kept, F.lit(0))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    kept_col: str = "kept_text",
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the text left after dropping, the line count before and
    the number of lines dropped.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses its lines in all of them but the one with the
    largest id.  The added columns must not be columns of ``docs``.
    """
    t1, t2, drop = (spare_name(docs, n) for n in ("__t1", "__t2", "__drop"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), text)})
    lost = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    joined = base.alias("b").join(
        lost.alias("d").hint("shuffle_hash"),
        F.col(f"b.`{id_col}`").eqNullSafe(F.col("d.doc"))
        & (F.col(f"b.`{t1}`") == F.col("d.t1"))
        & (F.col(f"b.`{t2}`") == F.col("d.t2")),
        "left",
    )
    lines = F.split(F.coalesce(F.col(f"b.`{text_col}`"), F.lit("")), "\n")
    gone = F.col("d.drop")
    return joined.select(
        *[F.col(f"b.`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(lines_col),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(dropped_col),
        F.when(gone.isNull(), F.coalesce(F.col(f"b.`{text_col}`"), F.lit(""))).otherwise(without(lines, gone)).alias(kept_col),
    )
