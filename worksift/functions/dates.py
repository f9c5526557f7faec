"""Calendar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portal_date(c: Column) -> Column:
    """``9-Jul-2024`` to a date; empty, ``NA``, ``-`` and anything unreadable to null."""
    return F.try_to_date(F.trim(c), "d-MMM-yyyy")


def portal_date_supplied(c: Column) -> Column:
    """True where the portal wrote something that ought to be a date."""
    return F.coalesce(~clean_blank(c).isin("NA", "-"), F.lit(False))


def clean_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def tenure_range(start: Column, end: Column) -> Column:
    """Two free-form timestamps to ``2024-2029``; null when either year is missing."""
    first, last = (F.regexp_extract(c, r"\b(\d{4})\b", 1) for c in (start, end))
    return F.when((first != "") & (last != ""), F.concat_ws("-", first, last))


def financial_year(sanction: Column, last_updated: Column) -> Column:
    """April-to-March label such as ``2023-24``, from the sanction date or, failing that,
    the last update."""
    shifted = F.year(F.add_months(F.coalesce(sanction, last_updated), -3))
    return F.when(
        shifted.isNotNull(), F.format_string("%d-%02d", shifted, F.pmod(shifted + 1, F.lit(100)))
    )


def calendar_months(start: Column, end: Column) -> Column:
    """Difference of year*12+month; days of the month play no part."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))


def months_elapsed(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), calendar_months(start, end))


def days_stale(last_updated: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(as_of, last_updated))
