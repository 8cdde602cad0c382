"""Exact interpolated percentile from a histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_and_percentile(rows: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Per group: row count `n`, `mean` and the continuous percentile `pct`.

    Rows are first counted per (group, value), combined before the shuffle.
    """
    return of_histogram(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value, q)


def of_histogram(histogram: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """The same from one row per (group, value) with the number `n` of rows that have it.

    The ranks are found by a running count over distinct values, a window that
    sorts and spills, so no group's rows are ever held in one buffer.
    """
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = histogram.withColumns({"_upto": upto, "_all": F.sum("n").over(group)})
    position = F.lit(q) * (F.col("_all") - 1)

    def value_at(rank):
        inside = (rank >= F.col("_upto") - F.col("n")) & (rank < F.col("_upto"))
        return F.max(F.when(inside, F.col(value))).cast("double")

    below, above = value_at(F.floor(position)), value_at(F.ceil(position))
    weight = F.max(position - F.floor(position))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).cast("double").alias("mean"),
        (below + weight * (above - below)).alias("pct"),
    )
