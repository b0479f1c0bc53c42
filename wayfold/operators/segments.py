"""Segments within items, and gaps between items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.items import BY_TIME, islands
from wayfold.schemas import LIMITS


def segments(samples: DataFrame, states: bool = True) -> DataFrame:
    """Adds segment_no: runs of one activity type (null equals null) and, with ``states``, one recording state."""
    over = W.partitionBy("device_id", "item_no").orderBy(*BY_TIME)
    keys = [F.col("activity_type")] + ([F.col("recording_state")] if states else [])
    return islands(samples, over, "segment_no", *keys)


def summarize(segmented: DataFrame) -> DataFrame:
    """One row a segment; it ends where the next one begins, the last at its last sample."""
    s = segmented.groupBy("device_id", "item_no", "segment_no").agg(
        F.min("activity_type").alias("activity_type"), F.min("recording_state").alias("recording_state"), F.min("t").alias("start_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_samples")
    )
    after = F.lead("start_t").over(W.partitionBy("device_id", "item_no").orderBy("segment_no"))
    return s.withColumn("end_t", F.coalesce(after, F.col("last_t")))


def data_gaps(items: DataFrame, seconds: float = LIMITS.data_gap_s) -> DataFrame:
    """Items followed by another after more than ``seconds`` without samples, neither a gap itself."""
    o = W.partitionBy("device_id").orderBy("item_no")
    d = items.withColumns({"gap": F.lead("start_t").over(o) - F.col("last_t"), "next_gap": F.lead("is_gap").over(o), "next_no": F.lead("item_no").over(o), "next_start": F.lead("start_t").over(o)})
    return d.filter((F.col("gap") > seconds) & ~F.col("is_gap") & ~F.col("next_gap"))


def path_contains(samples: DataFrame, lat: float, lng: float, least: float = 10.0) -> DataFrame:
    """Whether each path holds a place: within the larger distance to the sample before and after, ``least`` or more. The last sample isn't asked."""
    o = W.partitionBy("device_id", "item_no").orderBy(*BY_TIME)
    here = (F.col("latitude"), F.col("longitude"))
    before = F.coalesce(geo.distance(F.lag("latitude").over(o), F.lag("longitude").over(o), *here), F.lit(0.0))
    after = geo.distance(*here, F.lead("latitude").over(o), F.lead("longitude").over(o))
    d = samples.withColumns({"_near": geo.distance(*here, lat, lng), "_before": before, "_after": after})
    holds = F.col("_after").isNotNull() & (F.col("_near") <= F.greatest("_before", "_after", F.lit(least)))
    return d.groupBy("device_id", "item_no").agg(F.bool_or(holds).alias("has_place"))
