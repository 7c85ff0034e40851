"""Lenient dates and months."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressgrid.functions.binding import let

# The spellings accepted for a date, tried in this order.
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd MMM yyyy", "d MMM yyyy",
    "MMM d, yyyy", "dd/MM/yyyy",
]


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """First format that fits, as a timestamp; NULL when none does."""
    def read(text: Column) -> Column:
        tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats or DATE_FORMATS]
        return F.when(text != "", F.coalesce(*tries))

    return let(F.trim(c), read)


def month_start(publish_date: Column, as_of: Column) -> Column:
    """First day of the month of publication, of `as_of` where the date is missing."""
    return F.trunc(F.coalesce(publish_date.cast("date"), as_of.cast("date")), "MM")
