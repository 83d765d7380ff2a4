"""OP5 — post-lamination edge lineal inches per glass item.

The reference is a per-item Visual Basic function called once per item by
the host application.  Here one batch computes it for every item:

1. pivot the item attributes (EW-STRAIGHT, LITE, ANNLAMI,
   CP-BUY-OUT-BEV-POST, CP-EDGE-PREandPOST) with conditional aggregates —
   partial aggregation, no collection;
2. fold the group codes and options into per-(item, lite) layer stacks
   (``operators.edge.item_layers``: one classify pass, two bounded
   aggregations) and join them to the attributes on (item, lite);
3. gate: non-empty edge string and a digit as last character of the
   ``LITE <lite> GLASS`` code (the number of layers);
4. flags post / pre / sgp and the layer error from the gap structs;
5. condition P = post OR ((ANNLAMI = 1 OR string contains EFGPO) AND
   CP-BUY-OUT-BEV-POST <> 1 AND NOT pre) — blank/non-numeric attribute
   values compare like VB Variants: ``= 1`` false, ``<> 1`` true;
6. token sums over the whole edge string with Single (float) accumulation
   in token order.

Output per item: ``AttributeValue`` (lineal inches, NULL when not > 0 —
the VB blank), ``PrePostWritten`` (the value written to CP-EDGE-PREandPOST
when that attribute exists and the amount is > 0, else NULL),
``PrePostValue`` (that attribute's value afterwards: the written amount, or
the one it had) and
``EdgeError`` (true where the VB code would raise: unreadable interlayer
count or a counted token without a numeric ``=length``; such items get NULL
results instead of failing the batch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.edge import PREPOST_TOKEN, is_number, item_layers, with_edge_totals, with_layer_flags
from shopfloor.sources.contracts import contracted

# Fixed attribute names of the calculation.
EW_ATTR = "EW-STRAIGHT"
LITE_ATTR = "LITE"
ANNLAMI_ATTR = "ANNLAMI"
BUYOUT_ATTR = "CP-BUY-OUT-BEV-POST"
PREPOST_ATTR = "CP-EDGE-PREandPOST"


def _variant_eq_one(c):
    return F.coalesce(is_number(c) & (c.try_cast("double") == 1), F.lit(False))


def _variant_ne_one(c):
    return ~_variant_eq_one(c)


def gated_items(attributes: DataFrame, group_codes: DataFrame, options: DataFrame) -> DataFrame:
    """Steps 1 to 4: each item's attributes, ``gate``, ``layers`` and flags."""
    name, value = F.col("name"), F.col("value")
    attrs = (
        attributes.filter(name.isin(EW_ATTR, LITE_ATTR, ANNLAMI_ATTR, BUYOUT_ATTR, PREPOST_ATTR))
        .groupBy("item_id")
        .agg(
            F.max(F.when(name == EW_ATTR, value)).alias("ew"),
            F.max(F.when(name == LITE_ATTR, value)).alias("lite"),
            F.max(F.when(name == ANNLAMI_ATTR, value)).alias("annlami"),
            F.max(F.when(name == BUYOUT_ATTR, value)).alias("buyout"),
            F.bool_or(name == PREPOST_ATTR).alias("prepost_exists"),
            F.max(F.when(name == PREPOST_ATTR, value)).alias("prepost_value"),
        )
    )
    layers = item_layers(group_codes, options).withColumnRenamed("item_id", "__item").withColumnRenamed(
        "lite", "__lite"
    )
    # Null-safe on lite: a plain equality makes Catalyst infer
    # ``lite IS NOT NULL`` and push it into the group-name parse, which
    # would re-evaluate the parse inside the scan filter.  A NULL lite only
    # meets the group of unparseable names, which has no glass code and no
    # gaps, so the gate fails exactly as with no match.
    df = attrs.join(
        layers, (F.col("item_id") == F.col("__item")) & F.col("lite").eqNullSafe(F.col("__lite")), "left"
    ).drop("__item", "__lite")
    digit = F.col("glass_digit")
    gate = (F.coalesce(F.col("ew"), F.lit("")) != "") & F.coalesce(digit >= 0, F.lit(False))
    df = df.withColumn("gate", gate).withColumn("layers", F.when(F.col("gate"), digit))
    return with_layer_flags(df, "layers")


def post_edge_lineal(attributes: DataFrame, group_codes: DataFrame, options: DataFrame) -> DataFrame:
    """``attributes`` (item_id, name, value), ``group_codes`` (item_id,
    group_name, code), ``options`` (item_id, option, group_name)."""
    t = {"item_attributes": attributes, "item_group_codes": group_codes, "item_options": options}
    t = contracted(t, "edge")
    df = gated_items(t["item_attributes"], t["item_group_codes"], t["item_options"])
    cond = F.coalesce(F.col("post"), F.lit(False)) | (
        (_variant_eq_one(F.col("annlami")) | F.coalesce(F.col("ew").contains(PREPOST_TOKEN), F.lit(False)))
        & _variant_ne_one(F.col("buyout"))
        & ~F.coalesce(F.col("pre"), F.lit(False))
    )
    df = df.withColumn("cond", cond).withColumn("sgp", F.coalesce(F.col("sgp"), F.lit(False)))
    df = with_edge_totals(df, "ew", "cond", "sgp")
    err = F.coalesce(F.col("layer_error"), F.lit(False)) | F.col("token_error")
    ok = F.col("gate") & ~err
    writes = ok & F.col("prepost_exists") & (F.col("prepost") > 0)
    return df.select(
        "item_id",
        F.col("lite").alias("Lite"),
        F.when(ok & (F.col("total") > 0), F.col("total").cast("double")).alias("AttributeValue"),
        F.when(writes, F.col("prepost").cast("double")).alias("PrePostWritten"),
        F.when(writes, F.col("prepost").cast("string")).otherwise(F.col("prepost_value")).alias("PrePostValue"),
        (F.col("gate") & err).alias("EdgeError"),
    )
