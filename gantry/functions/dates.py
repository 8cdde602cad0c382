"""Day keys, calendar attributes and elapsed time. Columns are given by name."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: str) -> date:
    """Strict YYYY-MM-DD; raises ValueError on anything else."""
    return datetime.strptime(text, "%Y-%m-%d").date()


def day_key(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def key_day(key: int) -> date:
    return date(key // 10000, key // 100 % 100, key % 100)


def yesterday_utc() -> date:
    return datetime.now(timezone.utc).date() - timedelta(days=1)


def date_id(ts: str) -> Column:
    """yyyymmdd as INT by arithmetic: no string formatting per row."""
    return F.expr(f"year({ts}) * 10000 + month({ts}) * 100 + dayofmonth({ts})")


def is_weekend(day: str) -> Column:
    # Spark counts Sunday as 1 and Saturday as 7.
    return F.expr(f"CAST(dayofweek({day}) IN (1, 7) AS SMALLINT)")


def seconds_between(start: str, end: str) -> Column:
    """Second boundaries crossed, not elapsed seconds rounded down."""
    return F.expr(f"unix_seconds({end}) - unix_seconds({start})")


def days_before(as_of: date, days: int) -> Column:
    return F.date_sub(F.lit(as_of), days)


def event_hour_columns(ts: str) -> dict[str, Column]:
    parts = {"year": "year", "month": "month", "day": "dayofmonth", "hour": "hour"}
    return {name: F.expr(f"{function}({ts})") for name, function in parts.items()}
