"""Range, as-of and spatial joins as equi-joins on cells, so that none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cells(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, key: str = "device_id", t: str = "t", start: str = "start_t", end: str = "end_t", width: int = 3600, strict: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of a point and an interval that holds it, by ``key`` and hour-wide cells of time. Intervals are closed, or open if ``strict``.

    ``width`` should be near the usual length of an interval: a long one is repeated in each of its cells.
    """
    i = intervals.withColumnRenamed(key, "_key").withColumn("_cell", cells(F.col(start), F.col(end), width))
    p = points.withColumn("_at", F.floor(F.col(t) / width))
    inside = (F.col(t) > F.col(start)) & (F.col(t) < F.col(end)) if strict else F.col(t).between(F.col(start), F.col(end))
    return p.join(i, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_cell")) & inside, how).drop("_key", "_cell", "_at")


def overlaps(a: DataFrame, b: DataFrame, *, key: str = "device_id", width: int = 3600) -> DataFrame:
    """Pairs of intervals (a_start, a_end) and (b_start, b_end) that overlap, each once: in the first cell both have."""
    x = a.withColumn("_x", cells(F.col("a_start"), F.col("a_end"), width))
    y = b.withColumnRenamed(key, "_key").withColumn("_y", cells(F.col("b_start"), F.col("b_end"), width))
    first = F.greatest(F.floor(F.col("a_start") / width), F.floor(F.col("b_start") / width))
    on = (F.col(key) == F.col("_key")) & (F.col("_x") == F.col("_y")) & (F.col("_x") == first) & (F.col("b_end") > F.col("a_start")) & (F.col("b_start") < F.col("a_end"))
    return x.join(y, on).drop("_x", "_y", "_key")


def as_of(left: DataFrame, right: DataFrame, values: list[str], *, key: str = "device_id", t: str = "t", strict: bool = True) -> DataFrame:
    """Each left row with the ``values`` of the latest right row before it (or at it, unless ``strict``), by a union and a running last.

    Of right rows at one time the one with the greatest ``values`` counts as the latest.
    """
    marked = left.select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"right_{v}") for v in values], F.lit(0 if strict else 1).alias("_side"))
    other = right.select(key, t, *[F.col(v).alias(f"right_{v}") for v in values], F.lit(1 if strict else 0).alias("_side"))
    both = marked.unionByName(other, allowMissingColumns=True).withColumn("_left", F.col("_side") == F.lit(0 if strict else 1))
    over = W.partitionBy(key).orderBy(t, "_side", *[f"right_{v}" for v in values]).rowsBetween(W.unboundedPreceding, 0)
    filled = {f"right_{v}": F.last(F.when(~F.col("_left"), F.struct(F.col(f"right_{v}").alias("v"))), ignorenulls=True).over(over)["v"] for v in values}
    return both.withColumns(filled).filter("_left").drop("_side", "_left")


def nearest(left: DataFrame, right: DataFrame, value: str, *, key: str = "device_id", t: str = "t") -> DataFrame:
    """Each left row with the right row nearest in whole seconds (near_t, near_<value>), the earlier of two, by a union and two running values. Of right rows at one time the greatest value counts before a left row, the least after it."""
    marked = left.select("*", F.lit(None).cast("struct<t:bigint,v:bigint>").alias("_r"))
    other = right.select(key, t, F.struct(F.col(t).alias("t"), F.col(value).cast("bigint").alias("v")).alias("_r"))
    both = marked.unionByName(other, allowMissingColumns=True)
    # looking ahead is a running value in the opposite order; rows of one time see each other both ways
    back, ahead = (W.partitionBy(key).orderBy(by).rangeBetween(W.unboundedPreceding, 0) for by in (F.asc(t), F.desc(t)))
    both = both.withColumns({"_b": F.max("_r").over(back), "_a": F.min("_r").over(ahead)})
    before = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col(t) - F.col("_b.t") <= F.col("_a.t") - F.col(t)))
    best = F.when(before, F.col("_b")).otherwise(F.col("_a"))
    return both.filter("_r is null").withColumns({"near_t": best["t"], f"near_{value}": best["v"]}).drop("_r", "_a", "_b")
