"""Join-shaped operators: existence (semi), non-existence (anti), flags,
pre-aggregated counts, and entity-attribute-value lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits for each key of a ``KeyBits``, and the most bits of all keys (64 MB):
#: beyond them the test lets more rows by, and loses none.
BITS_A_KEY, MOST_BITS = 8, 1 << 29
#: Bits in a row of them: those of a ``bitmap_construct_agg``.
ROW_BITS = 1 << 15


def never_broadcast(df: DataFrame) -> DataFrame:
    """A table that grows with the business.  The size of its files, packed
    and before an explode, says little of its rows in memory, yet by it the
    planner would collect them on the driver; so its joins are dealt out."""
    return df.hint("merge")


def without_relation(
    orders: DataFrame, relations: DataFrame, relation_type: int, key: str = "oKey", child: str = "ChildoKey"
) -> DataFrame:
    """Orders that are no child of a relation of the given type, as a left
    anti join (duplicate matches do not matter to it)."""
    rel = relations.filter(F.col("RelationType") == relation_type).select(F.col(child).alias(key))
    return orders.join(rel, key, "left_anti")


def open_order_multiplicity(
    orders: DataFrame, open_orders: DataFrame, key: str = "OrderNumber", carry: Sequence[str] = ("TargetShipDate",)
) -> DataFrame:
    """J9 + the left join to the staged open orders (K1, T10) in one join.

    ``key IN (SELECT key FROM open_orders)`` guarantees at least one match,
    so the semi join and the later left join collapse into one inner join
    against open orders grouped by (key, carried columns) with their row
    count ``__open_rows``: an order with two open rows on the same date
    keeps one row whose line count is later multiplied by 2; two dates give
    two rows — exactly what the report's GROUP BY produces."""
    grouped = open_orders.groupBy(key, *carry).agg(F.count(F.lit(1)).alias("__open_rows"))
    return orders.join(grouped, key)


def line_counts(details: DataFrame, key: str = "oKey", excluded_item_type: int = 5) -> DataFrame:
    """A1 + J5: lines per order, without alternatives, without lines of the
    excluded type and without lines of no type; aggregated before the join."""
    kept = details.filter((F.col("ItemType") != excluded_item_type) & F.col("AlternativeODKey").isNull())
    return kept.groupBy(key).agg(F.count("odKey").alias("__lines"))


def left_join_known(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """A left join on a key that may be NULL for very many rows: a NULL key
    meets nothing, so its rows get a key of their own (their number in the
    partition) and are dealt over all partitions instead of into one."""
    spread = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    left = df.withColumn("__spread", spread)
    right = side.withColumn("__none", F.lit(None).cast("long"))
    keys = (left[key].eqNullSafe(right[key])) & (left["__spread"].eqNullSafe(right["__none"]))
    return left.join(right.filter(F.col(key).isNotNull()), keys, "left").drop(right[key]).drop("__spread", "__none")


def flag_by_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """``UPDATE ... SET flag = 1 FROM df JOIN keys`` — 1 when the row's
    keys occur in ``keys_df``, else 0 (duplicates in ``keys_df`` do not
    multiply rows: the key set is de-duplicated first)."""
    marks = keys_df.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return df.join(marks, list(keys), "left").withColumn(flag, F.coalesce("__hit", F.lit(0))).drop("__hit")


def exists_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join whose columns are never projected, under DISTINCT,
    is an existence test — a left semi join (no row multiplication)."""
    return df.join(other.select(*keys), list(keys), "left_semi")


@dataclass(frozen=True)
class KeyBits:
    """Which keys a frame has, as marked bits: rows (__row, __words), one for
    ``ROW_BITS`` bits, of a size bounded by ``MOST_BITS`` however many keys."""

    rows: DataFrame
    bits: int

    def place(self, keys: Sequence[str]) -> tuple[Column, Column]:
        """The row and the bit in it that stand for a key."""
        at = F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in keys]), F.lit(self.bits))
        return F.shiftright(at, 15), at.bitwiseAND(F.lit(ROW_BITS - 1))


def key_bits(df: DataFrame, keys: Sequence[str], store: Callable[[DataFrame], DataFrame]) -> KeyBits:
    """The bits of the keys of ``df``, a stored frame with whole numbers as
    ``keys``."""
    bits, wanted = ROW_BITS, min(MOST_BITS, BITS_A_KEY * df.count())
    while bits < wanted:
        bits *= 2
    row, bit = KeyBits(df, bits).place(keys)
    # Eight bytes of the bitmap are read as one number, the first as its
    # highest: so the bits go with their bytes in the other order.
    placed = df.select(row.alias("__row"), bit.bitwiseXOR(F.lit(56)).alias("__bit")).repartition("__row")
    marked = placed.groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__marks"))
    number = lambda i: F.conv(F.hex(F.substring("__marks", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), number)
    return KeyBits(store(marked.select("__row", words.alias("__words"))), bits)


def may_occur(df: DataFrame, found: KeyBits, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key's bit is marked: all whose key occurs, and
    few others, told where the rows are read, before they travel to a join.
    The bits go to every task, which their bounded size allows."""
    row, bit = found.place(keys)
    word = F.get("__words", F.shiftright(bit, 6).cast("int"))
    met = df.join(F.broadcast(found.rows), row == F.col("__row"))
    return met.filter(F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def attribute_values(
    df: DataFrame,
    eav: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    out: str,
    name_col: str = "ParamText",
) -> DataFrame:
    """The value of the attribute ``name`` as ``out``, an empty
    text where the row has none.

    The EAV side is reduced to its distinct (keys, value) rows first (a hash
    aggregation, no collection): under the report's DISTINCT this yields the
    same rows as the plain left join, without multiplying duplicates."""
    values = (
        eav.filter(F.col(name_col) == F.lit(name))
        .select(*keys, F.coalesce(F.col(value), F.lit("")).alias(out))
        .distinct()
    )
    return df.join(values, list(keys), "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def attribute_pairs(
    df: DataFrame,
    eav: DataFrame,
    keys: Sequence[str],
    first: tuple[str, str, str],
    second: tuple[str, str, str],
    name_col: str = "ParamText",
) -> DataFrame:
    """S9 / J5 / C1 for two attributes in one pass over the EAV rows; each is
    (name, value column, output column).

    Two left joins, one for each name, give a row of ``df`` every pair of its
    values.  Here the rows of both names go through one shuffle on the keys.
    The m distinct values of the first name and the n of the second are
    numbered; value i of the first stands in the cells (i, 1..n), value j of
    the second in (1..m, j), and an aggregation by cell puts the pairs
    together.  Nothing is collected, and a name without a value has one cell
    with an empty text."""
    keys, name = list(keys), F.col(name_col)
    (one, one_value, one_out), (two, two_value, two_out) = first, second
    role = lambda tag, wanted, value: F.when(
        name == F.lit(wanted), F.struct(F.lit(tag).alias("tag"), F.coalesce(F.col(value), F.lit("")).alias("value"))
    )
    roles = F.array_compact(F.array(role(1, one, one_value), role(2, two, two_value)))
    tagged = eav.filter(name.isin(one, two)).select(*keys, F.explode(roles).alias("r")).select(*keys, "r.tag", "r.value")
    # One exchange, made for the first window (none where the rows lie by key
    # already): the distinct rows, the counts and the cells need no other.
    # A value that repeats the one before it goes, in the order of that window.
    by_key, place = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("tag", "value")
    values = tagged.withColumns({"at": F.dense_rank().over(place), "before": F.lag(F.struct("tag", "value")).over(place)})
    values = values.filter(~F.col("before").eqNullSafe(F.struct("tag", "value"))).drop("before")
    count = lambda tag: F.count(F.when(F.col("tag") == tag, 1)).over(by_key)
    values = values.select(*keys, "tag", "value", "at", count(1).alias("m"), count(2).alias("n"))
    own = F.when(F.col("tag") == 1, F.col("at")).otherwise(F.col("at") - F.col("m"))
    across = F.greatest(F.when(F.col("tag") == 1, F.col("n")).otherwise(F.col("m")), F.lit(1))
    cells = values.select(*keys, "tag", "value", own.alias("own"), F.explode(F.sequence(F.lit(1).cast("long"), across)).alias("other"))
    is_one = F.col("tag") == 1
    cells = cells.select(
        *keys,
        F.when(is_one, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(is_one, F.col("other")).otherwise(F.col("own")).alias("j"),
        F.when(is_one, F.col("value")).alias(one_out),
        F.when(~is_one, F.col("value")).alias(two_out),
    )
    pairs = cells.groupBy(*keys, "i", "j").agg(F.max(one_out).alias(one_out), F.max(two_out).alias(two_out)).drop("i", "j")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return df.join(pairs, keys, "left").select(*df.columns, text(one_out), text(two_out))
