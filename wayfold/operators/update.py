"""Updates of a finished timeline: from changed samples to the items that differ, without a look at the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import classifier, merging
from wayfold.operators.tables import staged
from wayfold.schemas import LIMITS, Thresholds

KEYS = merging.KEYS


def reclassified(samples: DataFrame, current: DataFrame, items: DataFrame, models: DataFrame, names: tuple[str, ...], trained: DataFrame) -> DataFrame:
    """Samples of ``items`` (device_id, into) with the type that their item's chain gives those without a confirmed one; an unknown type is none."""
    wanted = staged(current.select(*KEYS, "into").join(items, ["device_id", "into"], "left_semi"), "wanted")
    own = staged(samples.join(merging.handed(wanted, wanted.count()), KEYS), "own")
    chain = classifier.chained(own.drop("item_no").withColumnRenamed("into", "item_no"), models, names, trained)
    told = chain.select("device_id", "sample_id", F.when(F.col("name") != "unknown", F.col("name")).alias("_told"))
    out = own.join(told, ["device_id", "sample_id"], "left").withColumn("classified_type", F.when(F.col("confirmed_type").isNull(), F.col("_told")).otherwise(F.col("classified_type")))
    return out.drop("into", "_told")


def segment_update(samples: DataFrame, current: DataFrame, edited: DataFrame, models: DataFrame, names: tuple[str, ...], trained: DataFrame, limits: Thresholds = LIMITS) -> tuple[DataFrame, DataFrame, list[dict]]:
    """What an edit changes: (samples with new types, items with a new place (device_id, item_no, into, kind_visit), what each round did).

    ``samples`` are all numbered samples as they are now, ``current`` what merging.process() said before, ``edited`` (device_id, sample_id,
    item_no) those that changed. The items that hold edited samples are classified anew, each as one chain in which the previous type is a factor; then
    merging goes on from them and their neighbours until nothing is possible. Only rows that differ come out, for the
    caller to write; no other item is summed up. Samples of new items have no place in ``current`` yet and begin as items of their own.
    """
    placed = edited.select(*KEYS).distinct().join(current.select(*KEYS, "into"), KEYS, "left")
    items = staged(placed.select("device_id", F.coalesce("into", "item_no").alias("into")).distinct(), "edited")
    known = current.select(*KEYS, "into", "kind_visit").unionByName(placed.filter("into is null").select(*KEYS, F.col("item_no").alias("into"), F.lit(None).cast("boolean").alias("kind_visit")))
    typed = staged(reclassified(samples, known, items, models, names, trained).select("device_id", "sample_id", "item_no", "classified_type"), "typed")
    before = samples.select("device_id", "sample_id", F.col("classified_type").alias("_before"))
    n = typed.count()
    retyped = merging.handed(typed, n).join(before, ["device_id", "sample_id"]).filter(~F.col("classified_type").eqNullSafe(F.col("_before"))).select("device_id", "sample_id", "item_no", "classified_type")
    new = typed.select("device_id", "sample_id", F.col("classified_type").alias("_new"), F.lit(True).alias("_typed"))
    now = samples.join(merging.handed(new, n), ["device_id", "sample_id"], "left").withColumn("classified_type", F.when(F.col("_typed"), F.col("_new")).otherwise(F.col("classified_type"))).drop("_new", "_typed")
    _, changed, history = merging.updated(now, current, edited, limits)
    return retyped, changed, history
