"""Edge-work building blocks (E1-E11): layer flags from group codes and
token arithmetic on the ``CODE=length,CODE=length`` edge string.

The per-item Visual Basic loop becomes set operations:

* group names (``LITE <lite> GLASS``, ``LITE <lite>.<i> INTERLAYERS``,
  ``... PROCESS``, ``... IL<j> TYPE``, ``... IL<j>``, option group
  ``... OPTION``) are classified in ONE pass, from the right (no regex);
* rows are aggregated per gap ``(item, lite, i)`` into a few ints: interlayer
  count, process, SHATOP option and, as bit sets over the interlayers j, where
  a film, an SGP film and the film code stand — only ``i, j <= 9`` can matter
  because the loop bounds are single digits, so both aggregations are plain
  hash aggregations over ints, a narrow row a group, and nothing is collected;
* the first film interlayer is the lowest bit j <= count of the films;
* gaps are folded per ``(item, lite)`` into one bit set per flag; the "scan in
  order, stop at the first SHATOP gap" rule becomes the lowest bit of the
  SHATOP gaps, and the flags are tests of the bits below it.  The stop gap
  still has its interlayer count read, so an unreadable count there is an
  error, as in the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the calculation.
FILM_TYPES = ("ILPRT", "ILFAB", "ILNAT", "ILSGP")
SGP_TYPE = "ILSGP"
POST_FILM_CODE = "IMSCIPI"
POST_PROCESS = "AN"
STOP_OPTION = "SHATOP"
EXCLUDED_TOKENS = ("EFPCN", "ESEAM")
LITE_WORD = "LITE "
PREPOST_TOKEN = "EFGPO"
NUMBER_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
MAX_DIGIT = 9  # layer and interlayer counts are single characters


def _canonical_int(s: Column) -> Column:
    """Integer value of ``s`` when it is written exactly as VB's ``& i``
    renders an integer (no sign, blanks or leading zeros), else NULL."""
    v = s.try_cast("int")
    return F.when(v.cast("string") == s, v)


def _is_digit(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]$"), F.lit(False))


def classify_codes(group_codes: DataFrame, options: DataFrame) -> DataFrame:
    """(item_id, lite, i, j, kind, code) for every relevant group code and
    every SHATOP option; kind in GLASS, INTERLAYERS, PROCESS, FTYPE, FCODE,
    SHATOP.  Rows of other shapes are dropped.

    Each derived value is its own column, referenced by name, so no string
    function is evaluated twice per row.  Rows of other shapes get kind
    NULL."""
    opts = options.filter(F.col("option") == STOP_OPTION).select(
        "item_id", "group_name", F.lit(None).cast("string").alias("code"), F.lit(True).alias("is_option")
    )
    rows = group_codes.select("item_id", "group_name", "code", F.lit(False).alias("is_option")).unionByName(opts)
    # The last word tells the kind; everything between LITE and the kind's
    # own words is the lite (and gap), whatever characters it holds.
    rows = rows.withColumn("__last", F.substring_index("group_name", " ", -1)).withColumn(
        "__rest", F.expr("left(group_name, length(group_name) - length(__last) - 1)")
    )
    rows = rows.withColumn("__il", F.when(F.col("__last") == "TYPE", F.substring_index("__rest", " ", -1)).otherwise(F.col("__last")))
    rows = rows.withColumn(
        "__stem",
        F.when(F.col("__last") == "TYPE", F.expr("left(__rest, length(__rest) - length(__il) - 1)")).otherwise(F.col("__rest")),
    )
    rows = rows.withColumn("__j", F.when(F.col("__il").startswith("IL"), _canonical_int(F.expr("substring(__il, 3)"))))
    last, is_opt, j = F.col("__last"), F.col("is_option"), F.col("__j")
    kind = (
        F.when(~F.col("group_name").startswith(LITE_WORD), F.lit(None))
        .when(is_opt, F.when(last == "OPTION", F.lit("SHATOP")))
        .when(last.isin("GLASS", "INTERLAYERS", "PROCESS"), last)
        .when((last == "TYPE") & j.isNotNull(), F.lit("FTYPE"))
        .when(j.isNotNull(), F.lit("FCODE"))
    )
    rows = rows.withColumn("kind", kind).withColumn("__name", F.expr(f"substring(__stem, {len(LITE_WORD) + 1})"))
    rows = rows.withColumn("__i_txt", F.substring_index("__name", ".", -1))
    glass, dotted = F.col("kind") == "GLASS", F.instr("__name", ".") > 0
    out = rows.select(
        "item_id",
        F.when(glass, F.col("__name"))
        .when(dotted, F.expr("left(__name, length(__name) - length(__i_txt) - 1)"))
        .alias("lite"),
        F.when(~glass & dotted, _canonical_int(F.col("__i_txt"))).alias("i"),
        F.when(F.col("kind").isin("FCODE", "FTYPE"), j).alias("j"),
        "kind",
        "code",
    )
    # No filter here: a predicate on these derived columns would be pushed
    # below the projections and re-evaluate the whole parse per reference.
    # Rows of no interest carry kind NULL and are ignored by the
    # conditional aggregates of ``item_layers``.
    return out


def _digit_or_minus_one(c: Column) -> Column:
    """int of a one-character digit string, -1 for any other text."""
    return F.when(_is_digit(c), c.cast("int")).otherwise(F.lit(-1))


def _bit(k: Column) -> Column:
    """The bit of a gap or an interlayer number."""
    return F.call_function("shiftleft", F.lit(1), k)


def _bits_to(k: Column) -> Column:
    """The bits of the numbers 1 to ``k``, a digit or less than one."""
    return F.call_function("shiftleft", F.lit(2), F.greatest(k, F.lit(0))) - 2


def _bits(where: Column, k: Column) -> Column:
    """The set of the ``k`` of a group's rows ``where`` holds, as bits."""
    return F.coalesce(F.bit_or(F.when(where, _bit(k))), F.lit(0))


def _lowest(bits: Column) -> Column:
    return bits.bitwiseAND(-bits)


def item_layers(group_codes: DataFrame, options: DataFrame) -> DataFrame:
    """Per (item_id, lite): ``glass_digit`` (last character of the GLASS
    code as int, -1 when not a digit, NULL when the code is missing) and the
    gaps k = 1..9, as bit k of an int, that are ``ok_gaps`` (interlayer count
    readable), ``stop_gaps`` (SHATOP), ``post_gaps`` / ``pre_gaps`` /
    ``sgp_gaps`` (first film of the gap).

    Only single-digit gap and interlayer numbers can be reached by the
    loop, so every value has a bit: both aggregations are plain hash
    aggregations over a few ints — nothing is collected, whatever the data."""
    c = classify_codes(group_codes, options)
    kind, code, j = F.col("kind"), F.col("code"), F.col("j")
    in_gap = F.coalesce(F.col("i").between(1, MAX_DIGIT), F.lit(False))
    film = (kind == "FTYPE") & in_gap & j.between(1, MAX_DIGIT)
    film_code = (kind == "FCODE") & in_gap & j.between(1, MAX_DIGIT)
    per_gap = c.groupBy("item_id", "lite", "i").agg(
        F.max(F.when(kind == "GLASS", _digit_or_minus_one(F.substring(code, -1, 1)))).alias("glass_digit"),
        F.max(F.when((kind == "INTERLAYERS") & in_gap, _digit_or_minus_one(F.substring(code, 1, 1)))).alias("nf"),
        F.max(F.when((kind == "PROCESS") & in_gap, (code == POST_PROCESS).cast("int"))).alias("proc_an"),
        F.max(F.when((kind == "SHATOP") & in_gap, 1)).alias("shatop"),
        F.max(F.when(kind.isNotNull() & in_gap, 1)).alias("is_gap"),
        _bits(film & code.isin(list(FILM_TYPES)), j).alias("films"),
        _bits(film & (code == SGP_TYPE), j).alias("sgps"),
        _bits(film_code & (code == POST_FILM_CODE), j).alias("codes"),
    )

    # First film interlayer j <= count of each gap, as its bit (0 = none).
    nf = F.col("nf")
    per_gap = per_gap.withColumn("first", _lowest(F.col("films").bitwiseAND(F.coalesce(_bits_to(nf), F.lit(0)))))
    first = F.col("first")
    has_film = first > 0
    post = has_film & (first.bitwiseAND(F.col("codes")) > 0) & (F.coalesce(F.col("proc_an"), F.lit(0)) == 1)
    per_gap = per_gap.select(
        "item_id",
        "lite",
        "i",
        "glass_digit",
        "is_gap",
        (nf >= 0).alias("ok"),
        (F.col("shatop") == 1).alias("stop"),
        post.alias("post"),
        (has_film & ~post).alias("pre"),
        (has_film & (first.bitwiseAND(F.col("sgps")) > 0)).alias("sgp"),
    )
    gap = F.coalesce(F.col("is_gap"), F.lit(0)) == 1
    flags = [_bits(gap & F.col(name), F.col("i")).alias(f"{name}_gaps") for name in ("ok", "stop", "post", "pre", "sgp")]
    return per_gap.groupBy("item_id", "lite").agg(F.max("glass_digit").alias("glass_digit"), *flags)


def with_layer_flags(df: DataFrame, layers: str = "layers") -> DataFrame:
    """Add post, pre, sgp, layer_error from the layer count and the
    gap sets of :func:`item_layers`."""
    n = F.col(layers)
    sets = [f"{name}_gaps" for name in ("ok", "stop", "post", "pre", "sgp")]
    ok, stop, post, pre, sgp = (F.coalesce(F.col(c), F.lit(0)) for c in sets)
    df = df.withColumn("__gaps", F.coalesce(_bits_to(n - 1), F.lit(0)))
    gaps, at = F.col("__gaps"), F.col("__stop")
    df = df.withColumn("__stop", _lowest(gaps.bitwiseAND(stop)))
    # the gaps before the stop, and those whose count is read: the stop's, too
    df = df.withColumn("__scanned", F.when(at > 0, gaps.bitwiseAND(at - 1)).otherwise(gaps))
    scanned = F.col("__scanned")
    read = scanned.bitwiseOR(at)
    return df.select(
        "*",
        ((at > 0) | (scanned.bitwiseAND(post) > 0)).alias("post"),
        (scanned.bitwiseAND(pre) > 0).alias("pre"),
        (scanned.bitwiseAND(sgp) > 0).alias("sgp"),
        (read.bitwiseAND(F.bitwise_not(ok)) > 0).alias("layer_error"),
    ).drop("__gaps", "__stop", "__scanned", *sets)


def is_number(c: Column) -> Column:
    """Whether a text is a plain decimal number, with blanks around it at
    most: no type suffixes and no words such as NaN."""
    return F.coalesce(c.rlike(NUMBER_RE), F.lit(False))


def edge_tokens(ew: str | Column) -> Column:
    """The comma tokens of the edge string (array<string>)."""
    c = F.col(ew) if isinstance(ew, str) else ew
    return F.split(c, ",")


def _kept(t: Column) -> Column:
    cond = F.lit(True)
    for bad in EXCLUDED_TOKENS:
        cond = cond & ~t.contains(bad)
    return cond


def _token_value(t: Column) -> Column:
    """The number after the token's first equals sign, NULL when there is none
    or it is not written as a plain number (the calculation raises there)."""
    text = F.try_element_at(F.split(t, "="), F.lit(2))
    return F.when(is_number(text), text.try_cast("float"))


def _sum_float(arr: Column) -> Column:
    """Left-to-right float (VB Single) accumulation."""
    return F.aggregate(arr, F.lit(0.0).cast("float"), lambda acc, x: acc + x)


def with_edge_totals(df: DataFrame, ew: str, post_condition: str, sgp: str) -> DataFrame:
    """Add ``total``, ``prepost`` and ``token_error``.

    ``post_condition`` true: every kept non-empty token counts; tokens
    containing EFGPO also count towards pre-and-post.  Otherwise, with an
    SGP film: only kept non-empty EFGPO tokens count, towards both."""
    kept = F.filter(edge_tokens(ew), lambda t: _kept(t) & (t != ""))
    df = df.withColumn("__kept", F.transform(kept, lambda t: F.struct(t.alias("t"), _token_value(t).alias("v"))))
    df = df.withColumn("__pp", F.filter("__kept", lambda e: e["t"].contains(PREPOST_TOKEN)))
    cond, sgp_c = F.col(post_condition), F.col(sgp)
    zero = F.lit(0.0).cast("float")
    kept_sum = _sum_float(F.transform("__kept", lambda e: e["v"]))
    pp_sum = _sum_float(F.transform("__pp", lambda e: e["v"]))
    bad_kept = F.exists("__kept", lambda e: e["v"].isNull())
    bad_pp = F.exists("__pp", lambda e: e["v"].isNull())
    return df.select(
        "*",
        F.when(cond, kept_sum).when(sgp_c, pp_sum).otherwise(zero).alias("total"),
        F.when(cond | sgp_c, pp_sum).otherwise(zero).alias("prepost"),
        F.when(cond, bad_kept).when(sgp_c, bad_pp).otherwise(F.lit(False)).alias("token_error"),
    ).drop("__kept", "__pp")
