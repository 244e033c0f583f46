"""Timestamps in the formats of the datasets. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spoken(text: Column) -> Column:
    """'1:56 pm on 8 May, 2023', or without the time."""
    both = F.try_to_timestamp(F.upper(text), F.lit("h:mm a 'ON' d MMMM, yyyy"))
    return F.coalesce(F.try_to_timestamp(text, F.lit("h:mm a 'on' d MMMM, yyyy")), both, F.try_to_timestamp(text, F.lit("d MMMM, yyyy")), F.try_to_timestamp(text, F.lit("d MMMM yyyy")))


def numbered(text: Column) -> Column:
    """'2023/05/01 (Mon) 21:05'."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "\\([A-Za-z]+\\)", ""), " +", " "))
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(plain, F.lit("yyyy/MM/dd")))


def iso_utc(text: Column) -> Column:
    """ISO text in UTC if it has a zone; otherwise as it is."""
    zoned = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$") & text.contains("T")
    return F.when(zoned, F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(text)


def run_stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss"))


def age_days(ts: Column, now: Column) -> Column:
    """Days from ts to now, 0 at least; a missing time counts as now."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000.0), F.lit(0.0))
