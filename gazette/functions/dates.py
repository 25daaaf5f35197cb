"""Weeks, batches and date labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ZONE

WEEK_ID = r"^\s*-?\d+-W\s*-?\d+\s*$"
#: Formats tried in turn by parsed_date.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss Z"]


def week_id(date: Column) -> Column:
    """ISO week like 2026-W05."""
    return F.when(date.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date)))


def is_week_id(text: Column) -> Column:
    """Whether a text is two whole numbers around -W; null isn't."""
    return F.coalesce(F.rlike(text, F.lit(WEEK_ID)), F.lit(False))


def week_start(week: Column) -> Column:
    """Monday of a week id; week numbers beyond a year's roll over."""
    year, number = F.substring(week, 1, 4).try_cast("int"), F.substring(week, 7, 10).try_cast("int")
    return F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), ((number - 1) * 7).cast("int"))


def week_end(week: Column) -> Column:
    return F.date_add(week_start(week), 6)


def in_week(date: Column, week: Column, whole_sunday: bool = False) -> Column:
    """By default only the first instant of Sunday counts, as a timestamp is compared with a bare date."""
    last = F.date_add(week_end(week), 1).cast("timestamp_ntz") if whole_sunday else week_end(week).cast("timestamp_ntz")
    d = date.cast("timestamp_ntz")
    return (d >= week_start(week).cast("timestamp_ntz")) & ((d < last) if whole_sunday else (d <= last))


def local_time(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def queue_batch(ts: Column, zone: str = ZONE) -> Column:
    """The day a notification is queued on."""
    return F.date_format(local_time(ts, zone), "yyyy-MM-dd")


def daily_batch(ts: Column, zone: str = ZONE) -> Column:
    """The batch a digest run takes up: yesterday's."""
    return F.date_format(F.date_sub(local_time(ts, zone), 1), "yyyy-MM-dd")


def weekly_batch(ts: Column, zone: str = ZONE) -> Column:
    """The week before."""
    return week_id(F.date_sub(local_time(ts, zone), 7))


def week_label(week: Column) -> Column:
    """January 26 - February 01, 2026, or January 05 - 11, 2026 within a month; anything that is no week id as it is."""
    a, b = week_start(week), week_end(week)
    last = F.when(F.month(a) == F.month(b), F.date_format(b, "dd, yyyy")).otherwise(F.date_format(b, "MMMM dd, yyyy"))
    return F.when(F.rlike(week, F.lit(r"^\d{4}-W\d{1,2}$")), F.concat(F.date_format(a, "MMMM dd"), F.lit(" - "), last)).otherwise(week)


def date_label(text: Column) -> Column:
    """January 24, 2026; the first ten characters of what is no date; Unknown date for nothing."""
    at = F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
    return F.when(F.coalesce(text, F.lit("")) == "", "Unknown date").otherwise(F.coalesce(F.date_format(at, "MMMM dd, yyyy"), F.substring(text, 1, 10)))


def parsed_date(text: Column) -> Column:
    """A timestamp out of a text with a date in one of several forms; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}(?:[T ]\d[\d:]*\S*)?|\d{1,2}/\d{1,2}/\d{4}|[A-Z][a-z]{2,8}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4}|\d{1,2} [A-Z][a-z]{2,8} \d{4})", 1), r"(\d)(st|nd|rd|th)\b", "$1")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for t in (F.regexp_replace(F.trim(text), "^[A-Z][a-z]{2}, ", ""), F.trim(found)) for f in FORMATS))
