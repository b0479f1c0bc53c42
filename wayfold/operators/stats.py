"""Grouped statistics of samples and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo


def weighted_fixes(fixes: DataFrame, *keys: str) -> DataFrame:
    """Centre of usable fixes, weight 1 - accuracy / (worst + 1), with time, altitude and accuracy weighted alike."""
    u = fixes.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))
    u = u.join(u.groupBy(*keys).agg(F.max("h_acc").alias("_worst")), list(keys))
    w = 1 - F.col("h_acc") / (F.col("_worst") + 1)
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    g = u.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * z).alias("z"), *[F.sum(w * F.col(c)).alias(f"_{c}") for c in ("t", "altitude", "h_acc")])
    return g.select(*keys, geo.lat_of(F.col("x"), F.col("y"), F.col("z")).alias("latitude"), geo.lng_of(F.col("x"), F.col("y")).alias("longitude"), *[(F.col(f"_{c}") / F.col("w")).alias(c) for c in ("t", "altitude", "h_acc")])


def weighted_altitude(fixes: DataFrame, *keys: str) -> DataFrame:
    u = fixes.filter("v_acc > 0")
    u = u.join(u.groupBy(*keys).agg(F.max("v_acc").alias("_worst")), list(keys))
    w = 1 - F.col("v_acc") / (F.col("_worst") + 1)
    return u.groupBy(*keys).agg((F.sum(w * F.col("altitude")) / F.sum(w)).alias("altitude"))


def course_variance(fixes: DataFrame, *keys: str) -> DataFrame:
    """1 - the mean resultant length of bearings between consecutive places; 1 where there are too few, equal ones aside."""
    o = W.partitionBy(*keys).orderBy("t", "sample_id")
    b = F.radians(geo.bearing(F.lag("latitude").over(o), F.lag("longitude").over(o), F.col("latitude"), F.col("longitude")))
    few = (F.count(F.lit(1)) <= 2) | (F.count("_b") < 4)
    spread = 1 - F.sqrt(F.pow(F.avg(F.sin("_b")), 2) + F.pow(F.avg(F.cos("_b")), 2))
    return fixes.withColumn("_b", b).groupBy(*keys).agg(F.when(few, 1.0).otherwise(spread).alias("course_variance"))


def speed_estimate(fixes: DataFrame, *keys: str) -> DataFrame:
    """Mean of the speeds that are known, else distance over duration, else -1."""
    o = W.partitionBy(*keys).orderBy("t", "sample_id")
    d = F.coalesce(geo.distance(F.lag("latitude").over(o), F.lag("longitude").over(o), F.col("latitude"), F.col("longitude")), F.lit(0.0))
    known = F.avg(F.when(F.col("speed") >= 0, F.col("speed")))
    return fixes.withColumn("_d", d).groupBy(*keys).agg(F.coalesce(known, F.try_divide(F.sum("_d"), F.nullif(F.max("t") - F.min("t"), F.lit(0))), F.lit(-1.0)).alias("speed"))


def coordinate_trust(samples: DataFrame, most: int = 2000) -> DataFrame:
    """Trust of each device in 4-digit places, from its ``most`` confirmed stationary samples that were saved last: 1 less a fifth of their mean km/h.

    Samples without a usable place count among the ``most``, as they were fetched, but trust nothing.
    """
    newest = F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("last_saved"), F.desc("sample_id")))
    top = samples.filter(F.col("confirmed_type") == "stationary").withColumn("_n", newest).filter(F.col("_n") <= most)
    top = top.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))
    kmh = F.avg(F.greatest(F.col("speed"), F.lit(0.0))) * 3.6
    return top.groupBy("device_id", *_place()).agg((1 - geo.clamp(kmh / 5, 0.0, 1.0)).alias("trust"))


def _place() -> list:
    return [geo.round_half_away(F.col("latitude"), 4).alias("lat4"), geo.round_half_away(F.col("longitude"), 4).alias("lng4")]


def trusted(samples: DataFrame, trust: DataFrame) -> DataFrame:
    """Samples with the ``trust`` (device_id, lat4, lng4, trust) in their place, 1 where nothing is known; any table of that form will do."""
    place = ["device_id", "lat4", "lng4"]
    return samples.select("*", *_place()).join(trust.select(*place, "trust"), place, "left").withColumn("trust", F.coalesce("trust", F.lit(1.0))).drop("lat4", "lng4")


def worsened(samples: DataFrame, trust: DataFrame) -> DataFrame:
    """Samples whose accuracy is worse by up to 100 m in places that aren't trusted, for the filter to follow them less."""
    t = trusted(samples, trust)
    return t.withColumn("h_acc", F.col("h_acc") + F.when(F.col("trust") < 1, 100 * (1 - F.col("trust"))).otherwise(0.0)).drop("trust")


def edges(samples: DataFrame, *keys: str) -> DataFrame:
    """Ids of each group's first two and last two samples; bounded heaps, no sort of the group."""
    at = F.struct("t", "sample_id")
    ends = samples.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("z"))
    s = samples.join(ends, list(keys)).withColumn("_at", at)
    inner = s.groupBy(*keys).agg(F.min(F.when(F.col("_at") > F.col("a"), F.col("_at"))).alias("b"), F.max(F.when(F.col("_at") < F.col("z"), F.col("_at"))).alias("y"), F.first("a").alias("a"), F.first("z").alias("z"))
    return inner.select(*keys, F.col("a.sample_id").alias("first_id"), F.col("b.sample_id").alias("second_id"), F.col("y.sample_id").alias("second_last_id"), F.col("z.sample_id").alias("last_id"))
