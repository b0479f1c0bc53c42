"""Timeline items: from samples to visits, paths and gaps, and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.folds import fold
from wayfold.schemas import LIMITS, TYPES, Thresholds

BY_TIME = ("t", "sample_id")


def per_device() -> W:
    return W.partitionBy("device_id").orderBy(*BY_TIME)


def moving(state: Column | None = None) -> Column:
    """Whatever isn't stationary counts as moving, uncertain too."""
    return (F.col("moving_state") if state is None else state) != "stationary"


def islands(df: DataFrame, over: W, name: str, *keys: Column) -> DataFrame:
    """Numbers runs of rows whose ``keys`` stay the same (null equals null), from 1 in each window partition."""
    same = F.lit(True)
    for k in keys:
        same = same & k.eqNullSafe(F.lag(k).over(over))
    first = F.row_number().over(over) == 1
    return df.withColumn(name, F.sum((first | ~same).cast("int")).over(over.rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def number_items(samples: DataFrame) -> DataFrame:
    """Adds item_no: a new item begins where moving or stationary flips and where a gap begins or ends."""
    return islands(samples, per_device(), "item_no", moving(), moving() & (F.col("recording_state") == "off"))


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), kind)


def mode_type(samples: DataFrame, *keys: str, name: str = "mode_type") -> DataFrame:
    """Each group's commonest activity type; ties go to the earlier in the order of types, a null type last."""
    counts = samples.groupBy(*keys, "activity_type").count()
    best = F.max_by("activity_type", F.struct("count", -F.coalesce(type_rank(F.col("activity_type")), F.lit(1000))))
    return counts.groupBy(*keys).agg(best.alias(name))


def centres(samples: DataFrame, *keys: str) -> DataFrame:
    """Weighted centre of each group's usable samples: weight 1 - accuracy / (worst + 1), three times that if stationary.

    A mean on the unit sphere; one usable sample is its own centre; none gives null.
    """
    u = samples.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))
    # the worst accuracy is one number a group: the sums need it, so groups are met twice, without a sort
    worst = u.groupBy(*keys).agg(F.max("h_acc").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    u = u.join(worst, list(keys))
    weight = (1 - F.col("h_acc") / (F.col("_worst") + 1)) * F.when(F.col("activity_type") == "stationary", 3.0).otherwise(1.0)
    u = u.withColumn("_w", weight)
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    g = u.groupBy(*keys).agg(
        F.sum(F.col("_w") * x).alias("x"), F.sum(F.col("_w") * y).alias("y"), F.sum(F.col("_w") * z).alias("z"), F.sum("_w").alias("w"),
        F.max("_n").alias("n_usable"), F.max("latitude").alias("one_lat"), F.max("longitude").alias("one_lng"),
    )
    one = F.col("n_usable") == 1
    return g.select(
        *keys,
        "n_usable",
        F.when(one, F.col("one_lat")).otherwise(geo.lat_of(F.col("x") / F.col("w"), F.col("y") / F.col("w"), F.col("z") / F.col("w"))).alias("latitude"),
        F.when(one, F.col("one_lng")).otherwise(geo.lng_of(F.col("x") / F.col("w"), F.col("y") / F.col("w"))).alias("longitude"),
    )


def radii(samples: DataFrame, centre: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of distances to the centre; of one usable sample (accuracy, 0)."""
    c = centre.select(*keys, F.col("latitude").alias("_clat"), F.col("longitude").alias("_clng"), "n_usable")
    u = samples.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))).join(c, list(keys))
    d = geo.distance(F.col("latitude"), F.col("longitude"), F.col("_clat"), F.col("_clng"))
    one = F.max("n_usable") == 1
    return u.groupBy(*keys).agg(F.when(one, F.max("h_acc")).otherwise(F.avg(d)).alias("radius_mean"), F.when(one, F.lit(0.0)).otherwise(F.stddev_pop(d)).alias("radius_sd"))


def exact_circles(samples: DataFrame) -> DataFrame:
    """(device_id, item_no, latitude, longitude, mean, sd): centres() and radii() summed one by one in the order of time, with C's sines.

    This is what a database on one machine does, to the last digit; it settles whether a place that makes the radius is within it. Folds
    with bounded state: the first finds the centres, the second the mean and the deviation (Welford's way) of the distances to them.
    """
    keys, at = ["device_id", "item_no"], ["t", "sample_id"]
    u = samples.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))
    weight = (1 - F.col("h_acc") / (F.max("h_acc").over(W.partitionBy(*keys)) + 1)) * F.when(F.col("activity_type") == "stationary", 3.0).otherwise(1.0)
    u = u.select(*keys, *at, "latitude", "longitude", "h_acc", weight.alias("w"))

    def centre(state: dict, r: tuple):
        if state.get("own") != r[1]:
            state.update(own=r[1], n=0, sums=(0.0, 0.0, 0.0, 0.0))
        a, b, w = geo.exact_radians(r[4]), geo.exact_radians(r[5]), r[7]
        terms = (w * math.cos(a) * math.cos(b), w * math.cos(a) * math.sin(b), w * math.sin(a), w)
        state.update(n=state["n"] + 1, sums=tuple(s + x for s, x in zip(state["sums"], terms)))
        if state["n"] == 1:
            return (*r[:4], 1, r[4], r[5])
        x, y, z = (s / state["sums"][3] for s in state["sums"][:3])
        return (*r[:4], state["n"], math.atan2(z, math.sqrt(x * x + y * y)) * (180 / math.pi), math.atan2(y, x) * (180 / math.pi))

    def radius(state: dict, r: tuple):
        if state.get("own") != r[1]:
            state.update(own=r[1], n=0, total=0.0, mean=0.0, squares=0.0)
        if r[9] == 1:
            return (*r[:4], r[6], 0.0)
        d = geo.exact_distance(r[4], r[5], r[7], r[8])
        n, before = state["n"] + 1, state["mean"]
        mean = before + (d - before) / n
        state.update(n=n, total=state["total"] + d, mean=mean, squares=(d - mean) * (d - before) + state["squares"])
        return (*r[:4], state["total"] / n, math.sqrt(state["squares"] / n))

    types = "device_id bigint, item_no bigint, t bigint, sample_id bigint, "
    last = lambda df, *names: df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*at)).alias("_l")).select(*keys, "_l.*")
    order = ("item_no", *at)
    c = last(fold(u, dict, centre, types + "n bigint, clat double, clng double", order=order), "clat", "clng", "n")
    met = u.drop("w").join(c, keys).select(*keys, *at, "latitude", "longitude", "h_acc", "clat", "clng", "n")
    return c.join(last(fold(met, dict, radius, types + "mean double, sd double", order=order), "mean", "sd"), keys).select(*keys, F.col("clat").alias("latitude"), F.col("clng").alias("longitude"), "mean", "sd")


def distances(samples: DataFrame, *keys: str) -> DataFrame:
    """Metres along each group's usable samples in the order of time."""
    u = samples.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))
    over = W.partitionBy(*keys).orderBy(*BY_TIME)
    step = geo.distance(F.lag("latitude").over(over), F.lag("longitude").over(over), F.col("latitude"), F.col("longitude"))
    return u.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy(*keys).agg(F.sum("_d").alias("distance"))


def validity(limits: Thresholds = LIMITS) -> tuple[Column, Column]:
    """(valid, keeper) of rows with is_visit, is_gap, n_samples, n_usable, duration and distance."""
    nolo = ~F.col("is_gap") & (F.col("n_usable") == 0)
    d, m = F.col("duration"), F.col("distance")
    visit_valid = (F.col("n_samples") >= 1) & ~nolo & (d >= limits.visit_valid_s)
    path_valid = (F.col("n_samples") >= limits.path_valid_samples) & (d >= limits.path_valid_s) & (nolo | (m >= limits.path_valid_m))
    valid = F.when(F.col("is_visit"), visit_valid).when(F.col("is_gap"), d >= limits.gap_valid_s).otherwise(path_valid)
    keeper = (
        F.when(F.col("is_visit"), visit_valid & (d >= limits.visit_keeper_s))
        .when(F.col("is_gap"), d >= limits.gap_keeper_s)
        .otherwise(path_valid & (d >= limits.path_keeper_s) & (m >= limits.path_keeper_m))
    )
    return valid, keeper


def summarize(samples: DataFrame, limits: Thresholds = LIMITS, following: str | None = None) -> DataFrame:
    """One row an item of numbered samples: range, centre, radius, distance, kind, validity and keepness (2, 1, 0).

    The end is the next item's start where that is later than the item's own, else its last sample. Where only some items of a device
    are at hand, ``following`` names a column with that start.
    """
    keys = ("device_id", "item_no")
    s = samples.withColumn("activity_type", F.coalesce("confirmed_type", "classified_type"))
    base = s.groupBy(*keys).agg(
        F.min("t").alias("start_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_samples"),
        F.min_by(moving(), F.struct(*BY_TIME)).alias("_moving"), F.bool_and(F.col("recording_state") == "off").alias("_off"),
        *([] if following is None else [F.first(following).alias("_next")]),
    )
    c = centres(s, *keys)
    items = base.join(c, list(keys), "left").join(radii(s, c, *keys), list(keys), "left").join(distances(s, *keys), list(keys), "left")
    start = F.lead("start_t").over(W.partitionBy("device_id").orderBy("item_no")) if following is None else F.col("_next")
    return completed(items, start, limits)


def completed(items: DataFrame, start: Column, limits: Thresholds = LIMITS) -> DataFrame:
    """Sums of items with what follows from them; ``start`` is the next item's."""
    items = items.withColumns(
        {
            "is_visit": ~F.col("_moving"),
            "is_gap": F.col("_moving") & F.col("_off"),
            "end_t": F.when(start > F.col("start_t"), start).otherwise(F.col("last_t")),
            "n_usable": F.coalesce("n_usable", F.lit(0)),
            "distance": F.coalesce("distance", F.lit(0.0)),
            "radius_mean": F.coalesce("radius_mean", F.lit(0.0)),
            "radius_sd": F.coalesce("radius_sd", F.lit(0.0)),
        }
    ).withColumn("duration", (F.col("end_t") - F.col("start_t")).cast("double"))
    valid, keeper = validity(limits)
    items = items.withColumns({"valid": valid, "keeper": keeper}).withColumn("keepness", F.when(F.col("keeper"), 2).when(F.col("valid"), 1).otherwise(0))
    return items.drop("_moving", "_off", "_next")
