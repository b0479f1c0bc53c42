"""The store's surface: parameterised SQL, interval filters, upserts, deletions and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def select(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A query over registered views with named arguments (``:name``)."""
    return spark.sql(sql, args=args)


def overlapping(items: DataFrame, start: int, end: int) -> DataFrame:
    return items.filter((F.col("end_t") > start) & (F.col("start_t") < end))


def within(items: DataFrame, start: int, end: int) -> DataFrame:
    return items.filter((F.col("start_t") >= start) & (F.col("end_t") <= end))


def in_box(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east) & ~((lat == 0) & (lng == 0))


def broken_edges(items: DataFrame) -> DataFrame:
    """Live items without a previous item, and without a next one unless they are current."""
    return items.withColumns({"broken_previous": ~F.col("gone") & F.col("previous").isNull(), "broken_next": ~F.col("gone") & F.col("next").isNull() & ~F.col("current")})


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: what repeated upserts leave. Reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*")


def without_old_deleted(rows: DataFrame, time: str, before: int) -> DataFrame:
    return rows.filter(~(F.col("deleted") & (F.col(time) < before)))


def delete_items(items: DataFrame, samples: DataFrame, keys: Sequence[str] = ("device_id", "item_no")) -> DataFrame:
    """``items`` (keys, previous, next, locked) after all were asked to go: with ``deleted``, true for those that were, whose links are gone.

    Locked items, and items that still hold a sample of ``samples`` that isn't deleted, refuse and stay as they are.
    """
    held = samples.filter(~F.col("deleted")).select(*keys).distinct().withColumn("_held", F.lit(True))
    out = items.join(held, list(keys), "left").withColumn("deleted", ~F.col("locked") & F.col("_held").isNull()).drop("_held")
    return out.withColumns({c: F.when(~F.col("deleted"), F.col(c)) for c in ("previous", "next")})


def without_old_deleted_items(items: DataFrame, before: int) -> DataFrame:
    """Items but those deleted whose end is before ``before`` or unknown."""
    return items.filter(~(F.col("deleted") & F.coalesce(F.col("end_t") < before, F.lit(True))))


def flag_events(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each flag that is true."""
    set_names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return rows.withColumn("name", F.explode(set_names))


def nested_json(items: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON text an item, its samples nested in the order of time; nulls are left out."""
    nested = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "sample_id", "latitude", "longitude", "moving_state", "recording_state"))).alias("samples"))
    return items.join(nested, list(keys)).select(*keys, F.to_json(F.struct(*items.columns, "samples")).alias("json"))


def export_name(start: Column, end: Column) -> Column:
    """The file name of a range: its day, month or year, whichever it lies in but for a second at each side."""
    at = lambda x, form: F.date_format(F.timestamp_seconds(x), form)
    middle = F.floor((start + end) / 2)
    day = at(start + 1, "yyyy-MM-dd") == at(end - 1, "yyyy-MM-dd")
    month = at(start + 1, "yyyy-MM") == at(end - 1, "yyyy-MM")
    return F.when(day, at(middle, "yyyy-MM-dd")).when(month, at(middle, "yyyy-MM")).otherwise(at(middle, "yyyy"))
