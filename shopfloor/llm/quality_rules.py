"""Quality rules, line first.

Each line is judged by itself: it must end like a sentence, and must be
neither navigation (cells between bars, arrows and other marks) nor
boilerplate (notices that sites repeat).  Failing lines are removed, and a
document that loses too large a share of its characters is rejected.
Beside this the counts of the usual document rules are returned.  Only
built-in functions are used, each document is judged within its own row, and
nothing is shuffled.

Defined cases: a null text is an empty text; it has no words and is
rejected; repeated rows are judged one by one; an empty table gives an empty
table; columns other than the text pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.tables import GAP_RE, SPACE

SYMBOLS = "[#*$%&|<>]"
#: A line passes the punctuation rule if it ends so; closing quotes and
#: brackets may follow.
SENTENCE_ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？")
CLOSERS = "\"'”’»)]"
#: A line with at least ``MIN_MARKS`` bars, arrows and other marks, one or
#: more to ``MARK_SPACING`` code points, is a menu, a table row or debris.
MARKS = "[|»›·•#*$%&<>{}]"
MIN_MARKS, MARK_SPACING = 3, 20
#: Notices that sites repeat; a line of at most ``NOTICE_CHARS`` code points
#: that holds one of them (lower-cased) is boilerplate.
NOTICES = (
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
    "cookie", "privacy policy", "terms of use", "terms of service", "subscribe to our", "newsletter",
    "enable javascript", "requires javascript", "lorem ipsum", "click here", "share this", "log in to", "sign up",
)
NOTICE_CHARS = 400


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The array of the text's words."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_RE))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words stand in a ``width``-word window that occurs twice or
    more in the array.

    Each window's start is packed under its hash into one long, so that after
    sorting, windows that may be equal are neighbours; those few are then
    compared word by word, and each repeat covers the words after the end of
    the one before it.
    """

    def covered(w: Column) -> Column:
        last = F.size(w) - width
        # the high bits, which a hash has; positions need the low ones
        high = -F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(last, F.lit(1)).cast("long")))
        )

        def packed(mask: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), last),
                    lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]).bitwiseAND(mask).bitwiseOR(i.cast("long")),
                )
            )

        def candidates(mask: Column) -> Column:
            def near(s: Column) -> Column:
                pair = F.filter(
                    F.sequence(F.lit(0), last - 1),
                    lambda j: F.get(s, j).bitwiseXOR(F.get(s, j + 1)).bitwiseAND(mask) == 0,
                )
                at = lambda j: F.get(s, j).bitwiseAND(F.bitwise_not(mask)).cast("int")
                return F.array_distinct(F.flatten(F.transform(pair, lambda j: F.array(at(j), at(j + 1)))))

            return bind(packed(mask), near)

        def exact(starts: Column) -> Column:
            windows = F.sort_array(
                F.transform(
                    starts, lambda p: F.struct(*[F.get(w, p + k).alias(f"w{k}") for k in range(width)], p.alias("p"))
                )
            )

            def twins(s: Column) -> Column:
                alike = lambda a, b: F.coalesce(
                    reduce(and_, (F.get(s, a)[f"w{k}"] == F.get(s, b)[f"w{k}"] for k in range(width))), F.lit(False)
                )
                twin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: alike(j, j - 1) | alike(j, j + 1))
                return F.array_sort(F.transform(twin, lambda j: F.get(s, j)["p"]))

            return F.when(F.size(starts) > 0, bind(windows, twins)).otherwise(F.array().cast("array<int>"))

        total = F.aggregate(
            bind(bind(high, candidates), exact),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("end")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["end"])).alias("n"), p.alias("end")),
            lambda acc: acc["n"],
        )
        return F.when(last >= 1, total).otherwise(F.lit(0))

    return bind(words, covered)


def ends_sentence(line: Column) -> Column:
    return bind(
        F.rtrim(line, F.lit(SPACE + CLOSERS)), lambda x: reduce(or_, (F.endswith(x, F.lit(e)) for e in SENTENCE_ENDS))
    )


def is_navigation(line: Column) -> Column:
    return bind(F.regexp_count(line, F.lit(MARKS)), lambda n: (n >= MIN_MARKS) & (n * MARK_SPACING >= F.char_length(line)))


def is_notice(line: Column) -> Column:
    return (F.char_length(line) <= NOTICE_CHARS) & bind(F.lower(line), lambda x: reduce(or_, (F.contains(x, F.lit(n)) for n in NOTICES)))


def blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) == ""


def good_line(line: Column) -> Column:
    return ends_sentence(line) & ~is_navigation(line) & ~is_notice(line)


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    max_lost: float = 0.4,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``clean_text`` (the lines that pass, joined by a line
    feed; lines without words pass), ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``lost`` (the share of the text's code points that went with removed lines) and ``kept``.

    Every added name gets ``prefix``; none may be a column of ``docs``.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = words_of(text)
    name = lambda n: prefix + n
    counts = bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    measured = docs.withColumns(
        {
            name("__count"): counts,
            name("n_symbols"): F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            name("__line"): bind(
                F.split(text, "\n"),
                lambda ls: F.struct(
                    F.array_join(F.filter(ls, lambda x: blank(x) | good_line(x)), "\n").alias("clean_text"),
                    bind(
                        F.filter(ls, lambda x: ~blank(x)), lambda ws: F.size(ws) - F.size(F.array_distinct(ws))
                    ).cast("long").alias("n_dup_lines"),
                ),
            ),
        }
    )
    line = F.col(f"`{name('__line')}`")
    measured = measured.withColumns({name(n): line[n] for n in ("clean_text", "n_dup_lines")})
    count = F.col(f"`{name('__count')}`")
    left = F.char_length(F.col(f"`{name('clean_text')}`"))
    out = measured.withColumns(
        {
            **{name(n): count[n] for n in ("n_words", "word_chars", "n_repeat_words")},
            name("lost"): F.when(text == "", F.lit(0.0)).otherwise(1 - left / F.char_length(text)),
        }
    )
    failed = (F.col(f"`{name('n_words')}`") < min_words) | (
        100 * F.col(f"`{name('n_repeat_words')}`") > max_repeat_percent * F.col(f"`{name('n_words')}`")
    )
    out = out.withColumn(name("base_failed"), failed)
    return out.withColumn(
        name("kept"), ~F.col(f"`{name('base_failed')}`") & (F.col(f"`{name('lost')}`") <= max_lost)
    ).drop(name("__count"), name("__line"))
