"""Folds as table functions of SQL: ``SELECT * FROM kalman(TABLE(SELECT ...) PARTITION BY device_id ORDER BY (t, sample_id))``.

Each partition is one device's rows in order, which Spark shuffles and sorts; a function holds a few numbers of it. Rows
need the named columns and may have others. Besides, an Arrow aggregate, for grouped queries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import Row

from wayfold.operators.brain import Brain
from wayfold.operators.folds import Kalman


@udtf(returnType="sample_id bigint, device_id bigint, t bigint, latitude double, longitude double, variance double")
class KalmanTable:
    """The coordinate filter: usable fixes that are newer than the last."""

    def __init__(self):
        self.k = Kalman(4.0)

    def eval(self, r: Row):
        if r["latitude"] is None or r["longitude"] is None or r["h_acc"] is None or r["h_acc"] < 0 or (r["latitude"] == 0 and r["longitude"] == 0):
            return
        if self.k.t is not None and r["t"] <= self.k.t:
            return
        lat, lng = self.k.update(r["t"], r["h_acc"], (r["latitude"], r["longitude"]))
        yield r["sample_id"], r["device_id"], r["t"], lat, lng, self.k.variance


@udtf(returnType="sample_id bigint, device_id bigint, t bigint")
class ThrottleTable:
    """Fixes less than ``seconds`` after the last kept one, and no more accurate than it, are left out."""

    def __init__(self):
        self.kept = None

    def eval(self, r: Row, seconds: float):
        if self.kept is None or r["t"] - self.kept[0] >= float(seconds) or r["h_acc"] < self.kept[1]:
            self.kept = r["t"], r["h_acc"]
            yield r["sample_id"], r["device_id"], r["t"]


@udtf(returnType="sample_id bigint, device_id bigint, t bigint, n_present bigint, n_past bigint, state string")
class MovingTable:
    """The moving state at each usable fix, by the present and past windows."""

    def __init__(self):
        self.brain = Brain()

    def eval(self, r: Row):
        if r["latitude"] is None or r["longitude"] is None or r["h_acc"] is None or r["h_acc"] < 0 or (r["latitude"] == 0 and r["longitude"] == 0):
            return
        made = self.brain.take(r["t"], r["latitude"], r["longitude"], r["h_acc"], r["speed"])
        if made:
            yield r["sample_id"], r["device_id"], r["t"], made[0], made[1], made[5]


def mean_course(course: pd.Series) -> float:
    """The circular mean of courses from 0 on, in degrees; -1 if there is none. Takes a group's values in Arrow batches at once."""
    import numpy as np

    known = np.radians(course[course >= 0])
    if not len(known):
        return -1.0
    return float(np.degrees(np.arctan2(np.sin(known).mean(), np.cos(known).mean())) % 360)


def register(spark: SparkSession) -> None:
    """Makes kalman, throttle, moving and mean_course callable from this session's SQL."""
    spark.udtf.register("kalman", KalmanTable)
    spark.udtf.register("throttle", ThrottleTable)
    spark.udtf.register("moving", MovingTable)
    spark.udf.register("mean_course", pandas_udf(mean_course, "double"))
