"""Holding input frames to their contracts (``schemas.CONTRACTS``).

Two doors, one rule.  ``load`` is for data as it comes (text files, exports, a
case-blind database): it types every table, rejects rows that do not fit, and
normalises GUIDs and, if asked, codes.  ``contracted`` is what every report
calls on its tables: it selects the columns the report reads and types those
that are not typed yet, so that no plan reads a frame outside its contract; for
frames that fit it is a plain column selection, and predicates still reach the
scan.

A column fits if it has the contract's type or a wider one of its kind (an
integer key as ``long``), since widening never changes a join or a comparison;
money and quantities may also come as doubles, and then the report computes in
doubles (``load`` with ``exact`` makes them the contract's decimals).  Any other type is
converted by ``try_cast``, and a row with a value that cannot be converted is
rejected, as is a row without its primary key.  An empty text in a date column
is 1900-01-01, as the reports' database reads it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.sources.schemas import CODES, CONTRACTS, GUIDS, KEYS, REPORT_INPUTS

#: Equal but for case and blanks at the end.
CASE_BLIND = "UTF8_LCASE_RTRIM"
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4}
EMPTY_DATE = "1900-01-01"


class ContractError(ValueError):
    """A frame lacks a table or columns that its contract asks for."""


@dataclass(frozen=True)
class Admitted:
    """The rows that fit, with the contract's types, and the others: table,
    reasons, row (as JSON)."""

    rows: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class Loaded:
    tables: dict[str, DataFrame]
    rejected: DataFrame


def _fits(own: T.DataType, asked: T.DataType, exact: bool) -> bool:
    """Whether a column can be used as it is."""
    if isinstance(asked, T.DecimalType):
        return own == asked if exact else isinstance(own, (T.NumericType,))
    if isinstance(asked, T.FloatType):
        return isinstance(own, (T.FloatType, T.DoubleType))
    if type(own) in _WIDTH and type(asked) in _WIDTH:
        return _WIDTH[type(own)] >= _WIDTH[type(asked)]
    if isinstance(asked, T.TimestampNTZType) and isinstance(own, T.TimestampType):
        return True  # comparisons take the column's own kind (operators/filters.py)
    return type(own) is type(asked)


def _typed(column: Column, own: T.DataType, asked: T.DataType) -> Column:
    if isinstance(own, T.StringType) and isinstance(asked, (T.DateType, T.TimestampNTZType)):
        column = F.when(F.trim(column) == "", F.lit(EMPTY_DATE)).otherwise(column)
    return column.try_cast(asked)


def same_guid(column: Column) -> Column:
    """One spelling of a GUID: upper case, without braces and blanks."""
    return F.upper(F.translate(F.trim(column), "{}", ""))


def _columns(table: str, df: DataFrame, asked: str | None) -> list[tuple[T.StructField, bool]]:
    """The contract's fields that are asked for (default: those that the frame
    has), and whether they must be there."""
    contract = CONTRACTS[table]
    if asked is None:
        return [(f, False) for f in contract.fields if f.name in df.columns]
    names = [n for n in asked.split() if not n.endswith("*") or n[:-1] in df.columns]
    return [(contract[n.rstrip("?*")], n[-1] not in "?*") for n in names]


def _check(table: str, df: DataFrame, fields: Iterable[tuple[T.StructField, bool]]) -> None:
    missing = [f.name for f, needed in fields if needed and f.name not in df.columns]
    if missing:
        raise ContractError(f"table {table} lacks {', '.join(missing)}")


def admit(table: str, df: DataFrame, asked: str | None = None, exact: bool = False, nocase: bool = False, load: bool = False) -> Admitted:
    """Hold one frame to its contract.  ``asked`` are the columns wanted
    (default: all of the contract's that the frame has, in its order)."""
    fields = _columns(table, df, asked)
    _check(table, df, [*fields, *((CONTRACTS[table][k], True) for k in KEYS.get(table, ()) if load)])
    types = {f.name: f.dataType for f in df.schema.fields}
    out, faults = [], []
    for field, _ in fields:
        name = field.name
        if name not in types:
            out.append(F.lit(None).cast(field.dataType).alias(name))
            continue
        column, kind = F.col(f"`{name}`"), types[name]
        value = column
        if not _fits(kind, field.dataType, exact):
            value = _typed(column, kind, field.dataType)
            faults.append(F.when(column.isNotNull() & value.isNull(), F.lit(f"{name} is no {field.dataType.simpleString()}")))
        if load and name in GUIDS:
            value = same_guid(value)
        if nocase and name in CODES.get(table, ()):
            value = F.collate(value, CASE_BLIND)
        out.append(value if value is column else value.alias(name))
    if load:
        for name in KEYS.get(table, ()):
            faults.append(F.when(F.col(f"`{name}`").isNull(), F.lit(f"{name} is null")))
    if not faults:
        none = df.limit(0).select(F.lit(table).alias("table"), F.array(F.lit("")).alias("reasons"), F.lit("").alias("row"))
        return Admitted(df.select(*out), none)
    fine = reduce(lambda a, b: a & b, [f.isNull() for f in faults])
    rejected = df.filter(~fine).select(
        F.lit(table).alias("table"), F.array_compact(F.array(*faults)).alias("reasons"), F.to_json(F.struct("*")).alias("row")
    )
    return Admitted(df.filter(fine).select(*out), rejected)


def load(frames: Mapping[str, DataFrame], exact: bool = True, nocase: bool = False) -> Loaded:
    """Every frame held to its contract, with the rejected rows of all.

    ``exact``: money and quantities become the contract's decimals.
    ``nocase``: text keys and codes compare without regard to case and blanks
    at the end (a collated type; joins on them stay hash or sort-merge joins).
    """
    admitted = {t: admit(t, df, exact=exact, nocase=nocase, load=True) for t, df in frames.items()}
    rejected = reduce(DataFrame.unionByName, [a.rejected for a in admitted.values()])
    return Loaded({t: a.rows for t, a in admitted.items()}, rejected)


def _report_frames(tables: Mapping, report: str):
    for table, asked in REPORT_INPUTS[report].items():
        found = tables.get(table)
        for df in found if isinstance(found, (list, tuple)) else [] if found is None else [found]:
            yield table, df, asked


def contracted(tables: Mapping, report: str, optional: Iterable[str] = ()) -> dict:
    """The report's tables with the columns it reads, typed.  Tables named in
    ``optional`` may be absent; a list of frames stays a list."""
    lacking = [t for t in REPORT_INPUTS[report] if t not in tables and t not in optional]
    if lacking:
        raise ContractError(f"the {report} report needs the tables {', '.join(lacking)}")
    out: dict = {}
    for table, df, asked in _report_frames(tables, report):
        rows = admit(table, df, asked).rows
        if isinstance(tables[table], (list, tuple)):
            out.setdefault(table, []).append(rows)
        else:
            out[table] = rows
    return out


def rejected_rows(tables: Mapping, report: str) -> DataFrame:
    """The rows that ``contracted`` leaves out: table, reasons, row."""
    frames = [admit(t, df, " ".join(n for n in asked.split() if n.rstrip("?*") in df.columns)).rejected for t, df, asked in _report_frames(tables, report)]
    return reduce(DataFrame.unionByName, frames)


def plain_text(df: DataFrame) -> DataFrame:
    """Collated texts as plain strings, for results that leave the library."""
    plain = lambda f: isinstance(f.dataType, T.StringType) and f.dataType != T.StringType()
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if plain(f) else F.col(f"`{f.name}`") for f in df.schema.fields])
