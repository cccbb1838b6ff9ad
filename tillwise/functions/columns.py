"""Column expressions used by several operators; all run inside generated code."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column | str) -> Column:
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def month(ts: Column | str) -> Column:
    """First day of the calendar month: the cheap key to group facts by."""
    return F.trunc(day(ts), "month")


def period(on: Column | str) -> Column:
    """Calendar month as ``yyyy-MM`` text, which sorts by time."""
    return F.date_format(on, "yyyy-MM")


def on_days(ts: Column | str, start: date, end: date) -> Column:
    """Dated from ``start`` to ``end``, both included.

    Comparing with DATE literals lets Spark turn the test into bounds on the stored timestamp
    and push them into the scan.
    """
    return day(ts).between(F.lit(start), F.lit(end))


def channel_flag(note: Column | str, pattern: str) -> Column:
    """Case-sensitive LIKE on a free-text note; a missing note belongs to the other channel."""
    note = F.col(note) if isinstance(note, str) else note
    return F.coalesce(note, F.lit("")).like(pattern)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is zero."""
    return part / F.nullif(whole, F.lit(0))


def first_id(primary: str, fallback: str, strict: bool = True) -> Column:
    """One 64-bit id out of two physical columns.

    ``strict`` raises on text that is no number; otherwise such text counts as missing.
    """
    if strict:
        return F.coalesce(F.col(primary).cast("bigint"), F.col(fallback).cast("bigint"))
    return F.coalesce(F.col(primary).try_cast("bigint"), F.col(fallback).try_cast("bigint"))


def churned(disabled: str, name: str, pattern: str) -> Column:
    """Disabled, or marked in the name; NULL when neither is known to hold."""
    return (F.col(disabled) == 1) | F.col(name).like(pattern)


def named(name: str, names: Iterable[str] | None) -> Column:
    return F.lit(True) if names is None else F.col(name).isin(list(names))


def exact_sum(value: Column | str, places: int = 8) -> Column:
    """Sum in decimals of ``places`` places, so that it does not depend on the order of the rows.

    The sum stays a decimal: cast it to double once, after the last sum.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast(f"decimal(28,{places})"))


def exact_mean(value: str, places: int = 15) -> Column:
    """Mean of a double by an exact sum of ``places`` places; NULLs are left out."""
    return exact_sum(value, places).cast("double") / F.count(value)
