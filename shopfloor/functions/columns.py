"""Column expressions for the CASE labels, cost rules and formatting used by
the reports.  All are built-in Spark SQL expressions (codegen'd, no UDF)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnFn = Callable[..., Column]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reports' literals.
# Order status codes -> display name; any other code (2, NULL, ...) -> Unknown.
STATUS_NAMES = {0: "On Hold", 1: "Available", 3: "Released"}
STATUS_UNKNOWN = "Unknown"
# Order-type description that flips the sign of the price (compared upper-case).
CREDIT_TYPE = "CREDIT"
# Demand report labels.
ON_HOLD_LABEL = "On Hold"
ACKNOWLEDGED = "Acknowledged"
UNACKNOWLEDGED = "Unacknowledged"
# Sentinel stored by the ERP for "no closed date" (T-SQL converts '' to it).
OPEN_SENTINEL_DATE = "1900-01-01 00:00:00"
# ---------------------------------------------------------------------------


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_name(status: str | Column) -> Column:
    """Status code -> label, else 'Unknown' (NULL and 2 included)."""
    s = col_(status)
    expr = None
    for code, label in STATUS_NAMES.items():
        expr = F.when(s == code, F.lit(label)) if expr is None else expr.when(s == code, F.lit(label))
    return expr.otherwise(F.lit(STATUS_UNKNOWN))


def signed_price(price: str | Column, type_description: str | Column) -> Column:
    """Negate the price for credit orders (case-insensitive match)."""
    p = col_(price)
    return F.when(F.upper(col_(type_description)) == CREDIT_TYPE, -p).otherwise(p)


def unit_cost(
    tracking_enabled: bool,
    cost_method: str | Column,
    system_method: int,
    std: str | Column,
    avg: str | Column,
    last: str | Column,
) -> Column:
    """Cost column chosen by WIP tracking, else by the part's cost method
    (NULL -> the system-wide method): 0 standard, 1 average, other last."""
    if tracking_enabled:
        return col_(avg)
    m = F.coalesce(col_(cost_method), F.lit(system_method))
    return F.when(m == 0, col_(std)).when(m == 1, col_(avg)).otherwise(col_(last))


def format_part(part: str | Column, suffix: str | Column) -> Column:
    """D4 default for the ERP's part formatter (body not in the reference):
    ``PartNo-Suffix``.  Callers with the real rule pass their own function."""
    return F.concat_ws("-", col_(part), col_(suffix))


def format_employee(last: str | Column, first: str | Column) -> Column:
    """D3 default for the ERP's employee-name formatter (body not in the
    reference): ``Last, First``; NULL when both parts are NULL (no match)."""
    last_c, first_c = col_(last), col_(first)
    return F.when(last_c.isNull() & first_c.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat_ws(", ", last_c, first_c)
    )


def identity_text(c: str | Column) -> Column:
    """D2 default for the ERP's text translation function: identity."""
    return col_(c)


def on_hold_label(status: str | Column) -> Column:
    """C5: 'On Hold' for status 0, else NULL."""
    return F.when(col_(status) == 0, F.lit(ON_HOLD_LABEL))


def ack_label(ack_date: str | Column) -> Column:
    """Acknowledgement label by a NULL test."""
    return F.when(col_(ack_date).isNotNull(), F.lit(ACKNOWLEDGED)).otherwise(F.lit(UNACKNOWLEDGED))


def display_description(shortcut: str | Column = "ShortcutDesc", part: str | Column = "OverallPartDesc") -> Column:
    """The shortcut's description, else the part's own."""
    return F.coalesce(col_(shortcut), col_(part))


def uninvoiced(amount: str | Column, invoiced: str | Column = "InvoiceAmount") -> Column:
    """C4: the amount of an order that has no invoiced amount, else NULL."""
    return F.when(col_(invoiced).isNull(), col_(amount))


def is_open_closed_date(closed: str | Column) -> Column:
    """F9 / §1.3(2): the T-SQL test ``ClosedDate = ''`` on a datetime column
    is true exactly for the 1900-01-01 sentinel; NULL stays NULL (not open)."""
    return col_(closed) == F.lit(OPEN_SENTINEL_DATE).cast("timestamp_ntz")


def month_name(ts: str | Column) -> Column:
    """Full English month name (DATENAME(m, ...))."""
    return F.date_format(col_(ts), "MMMM")
