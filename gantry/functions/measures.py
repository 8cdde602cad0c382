"""Aggregate columns with fixed money and ratio semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(amount: str = "amount") -> Column:
    return F.sum(amount)


def total_or_zero(amount: str = "amount") -> Column:
    return F.coalesce(F.sum(amount), F.lit(0).cast("decimal(20,2)"))


def mean_money(amount: str = "amount") -> Column:
    """Mean rounded half up once: AVG would first round to six places."""
    return F.round(F.sum(amount) / F.count(amount), 2)


def count_where(condition: Column) -> Column:
    """Rows that satisfy the condition; 0, not null, on empty input."""
    return F.count_if(condition)


def percent(part: Column, whole: Column) -> Column:
    ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.round(ratio, 2)
