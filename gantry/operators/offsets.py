"""Which message offsets have arrived: ranges kept with every trigger, and an audit of all of them.

A source that may lose messages (retention, a topic made anew) says nothing when it does. The
offsets that were read do: consecutive ones become one row, and the rows of all triggers together
show what is missing and what was read twice. Ranges end at multiples of SPAN, so that every sort
and every running sum is over one span of one topic partition, however many offsets that has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Offsets that one task may have to order.
SPAN = 1 << 20
SOURCE = ("topic", "partition")


def offset_ranges(messages: DataFrame, keys: Sequence[str] = SOURCE, span: int = SPAN) -> DataFrame:
    """(keys, span, first, last, copies): consecutive offsets that came equally often.

    `keys` tell apart what has offsets of its own, and may name the load as well. Messages
    without an offset are left out; keys may be null.
    """
    counted = messages.where("offset IS NOT NULL").groupBy(*keys, "offset").agg(F.count("*").alias("copies"))
    own = [*keys, "span", "copies"]
    placed = counted.withColumn("span", F.expr(f"offset DIV {span}"))
    # Along consecutive offsets the difference to the rank stays the same.
    run = F.col("offset") - F.row_number().over(Window.partitionBy(*own).orderBy("offset"))
    return placed.withColumn("_run", run).groupBy(*own, "_run").agg(
        F.min("offset").alias("first"), F.max("offset").alias("last")).select(*keys, "span", "first", "last", "copies")


def coverage(ranges: DataFrame, keys: Sequence[str] = SOURCE, span: int = SPAN) -> DataFrame:
    """(keys, first, last, copies): every offset between a source's first and last one, by how often it came.

    `ranges` are rows of `offset_ranges` from any number of loads, with the same `span`. Neighbours
    differ in `copies`; 0 is a hole.
    """
    reach = ranges.groupBy(*keys).agg(F.min("first").alias("_from"), F.max("last").alias("_to"))
    steps = ranges.select(*keys, "span", F.explode(F.array(
        F.struct(F.col("first").alias("at"), F.col("copies").alias("step")),
        F.struct((F.col("last") + 1).alias("at"), (-F.col("copies")).alias("step")))).alias("_s")).select(*keys, "span", "_s.*")
    steps = steps.groupBy(*keys, "span", "at").agg(F.sum("step").alias("step")).where("step <> 0")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    spans = ranges.select(*keys, "span").distinct().alias("a").join(reach.alias("b"), same).select(
        *[F.col(f"a.{key}").alias(key) for key in keys], "span",
        F.greatest(F.col("span") * span, "_from").alias("low"), F.least((F.col("span") + 1) * span - 1, F.col("_to")).alias("high"))
    edges = spans.select(*keys, "span", F.explode(F.array("low", F.col("high") + 1)).alias("at"), F.lit(0).cast("bigint").alias("step"))
    points = steps.unionByName(edges).groupBy(*keys, "span", "at").agg(F.sum("step").alias("step"))
    along = Window.partitionBy(*keys, "span").orderBy("at")
    pieces = points.withColumns({
        "copies": F.sum("step").over(along), "last": F.lead("at").over(along) - 1,
    }).where("last IS NOT NULL").select(*keys, F.col("at").alias("first"), "last", "copies")
    # One row for each span of a source: those that no range touches are holes from end to end.
    following = F.lead("low").over(Window.partitionBy(*keys).orderBy("span"))
    between = spans.withColumn("_next", following).where("_next > high + 1").select(
        *keys, (F.col("high") + 1).alias("first"), (F.col("_next") - 1).alias("last"), F.lit(0).cast("bigint").alias("copies"))
    return _joined_at_borders(pieces.unionByName(between), keys, span)


def _joined_at_borders(pieces: DataFrame, keys: Sequence[str], span: int) -> DataFrame:
    """Pieces that meet at the end of a span as one: at most two for each span take part."""
    at_border = (F.pmod("first", F.lit(span)) == 0) | (F.pmod(F.col("last") + 1, F.lit(span)) == 0)
    border = pieces.where(at_border)
    order = Window.partitionBy(*keys).orderBy("first")
    goes_on = (F.lag("last").over(order) == F.col("first") - 1) & (F.lag("copies").over(order) == F.col("copies"))
    begun = F.sum(F.when(F.coalesce("_goes_on", F.lit(False)), 0).otherwise(1)).over(order)
    joined = border.withColumn("_goes_on", goes_on).withColumn("_piece", begun).groupBy(*keys, "copies", "_piece").agg(
        F.min("first").alias("first"), F.max("last").alias("last"))
    return pieces.where(~at_border).unionByName(joined.select(*pieces.columns))


def audit(ranges: DataFrame, keys: Sequence[str] = SOURCE, span: int = SPAN) -> DataFrame:
    """(keys, first, last, n_offsets, copies, problem): offsets that are `missing` or `repeated`, whole stretches of them.

    What lies before a source's first offset or after its last one is not known to be missing.
    """
    wrong = coverage(ranges, keys, span).where("copies <> 1")
    return wrong.select(*keys, "first", "last", (F.col("last") - F.col("first") + 1).alias("n_offsets"), "copies",
                        F.when(F.col("copies") == 0, "missing").otherwise("repeated").alias("problem"))
