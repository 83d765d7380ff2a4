"""String helpers: delimited lists, MM-dd dates and the route-string pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopfloor.functions.columns import col_

# Fixed rendering pieces of the plan-date route string.
STAGE_SEPARATOR = ", "  # between stages, removed cleanly in front
DATE_SEPARATOR = " & "  # between dates; the report removes only 2 of its 3 chars


def parse_int_list(text: str | None, sep: str = ",") -> list[int] | None:
    """``'279, 311, 75'`` -> ``[279, 311, 75]``.

    Surrounding blanks are tolerated like the XML ``.value('.', 'INT')``
    conversion does; duplicates are removed (the reports only use the list
    for membership, J16).  An empty token is the number 0, as an empty text
    converted to a number is in T-SQL; an empty list text is one such token.  ``None`` stays ``None``.
    """
    if text is None:
        return None
    out: list[int] = []
    for token in text.split(sep):
        token = token.strip()
        value = int(token) if token else 0  # non-numeric input is an error, as in T-SQL
        if value not in out:
            out.append(value)
    return out


def trimmed_items(c: str | Column, sep: str = ",") -> Column:
    """Split a delimited string and trim blanks of every item.

    Empty items between two separators are kept (as ``''``), exactly like
    the XML-node split they replace."""
    return F.transform(F.split(col_(c), sep), lambda t: F.trim(t))


def mmdd(d: str | Column) -> Column:
    """FORMAT(date, 'MM-dd') — built from month/day with lpad, which
    stays in generated code (``date_format`` goes through a formatter
    object per value and is several times slower)."""
    c = col_(d)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.month(c)), F.lit("-"), two(F.dayofmonth(c)))


def render_stage(item: str | Column, sorted_dates: str | Column) -> Column:
    """One stage of the route string: ``ITEM ( d1 & d2)``.

    The dates were concatenated as `` & d1 & d2`` and only two characters
    were deleted in front (trap T1), so the text after ``(`` starts with a
    blank.  An empty/NULL date list gives NULL: the stage disappears (T2).
    """
    dates = col_(sorted_dates)
    joined = F.concat(F.lit(" "), F.array_join(dates, DATE_SEPARATOR))
    return F.when(F.size(dates) > 0, F.concat(col_(item), F.lit(" ("), joined, F.lit(")")))
