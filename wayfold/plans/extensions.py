"""What users plug in: table functions and aggregates called from SQL, and hooks that take another's judgement."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import tables
from wayfold.operators import classifier, folds, stats
from wayfold.plans.basics import THROTTLED
from wayfold.plans.sqltext import USABLE, S
from wayfold.plans.statistics import TRUST
from wayfold.plans.timeline import KALMAN
from wayfold.registry import query
from wayfold.sources.samples import samples


def view(spark, sf):
    tables.register(spark)
    samples(spark, sf).createOrReplaceTempView("wayfold_samples")


@query("ux08", KALMAN + " SELECT sample_id, round(lat, 6) AS latitude, round(lng, 6) AS longitude FROM k")
def ux08(spark, sf):
    """The coordinate filter as a table function of SQL."""
    view(spark, sf)
    return spark.sql("SELECT sample_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM kalman(TABLE(SELECT device_id, t, sample_id, latitude, longitude, h_acc FROM wayfold_samples) PARTITION BY device_id ORDER BY (t, sample_id))")


@query("ux08_throttle", THROTTLED + " SELECT sample_id FROM k WHERE keep")
def ux08_throttle(spark, sf):
    view(spark, sf)
    return spark.sql("SELECT sample_id FROM throttle(TABLE(SELECT device_id, t, sample_id, h_acc FROM wayfold_samples WHERE latitude IS NOT NULL) PARTITION BY device_id ORDER BY (t, sample_id), 41.0)")


@query(
    "ux08_aggregate",
    S + " SELECT device_id, round(CASE WHEN count(*) FILTER (course >= 0) = 0 THEN -1 ELSE (degrees(atan2(avg(sin(radians(course))) FILTER (course >= 0), avg(cos(radians(course))) FILTER (course >= 0))) + 360) % 360 END, 4) AS course FROM samples GROUP BY 1",
)
def ux08_aggregate(spark, sf):
    """The circular mean of each device's courses by an Arrow aggregate."""
    view(spark, sf)
    return spark.sql("SELECT device_id, round(mean_course(course), 4) AS course FROM wayfold_samples GROUP BY device_id")


# the filter over fixes whose accuracy is worsened where a device's standstills say so
_FUDGED = (
    "WITH trust AS (" + TRUST + f"), sk AS ({S} SELECT *, sign(latitude) * floor(abs(latitude) * 10000 + 0.5) / 10000 AS lat4, sign(longitude) * floor(abs(longitude) * 10000 + 0.5) / 10000 AS lng4 FROM samples), "
    "fudged AS (SELECT sk.* REPLACE (h_acc + CASE WHEN trust < 1 THEN 100 * (1 - trust) ELSE 0 END AS h_acc) FROM sk LEFT JOIN trust USING (device_id, lat4, lng4))"
)
_TAIL = KALMAN[KALMAN.index("samples AS (") :]


@query("ux03", _FUDGED.replace("WITH trust", "WITH RECURSIVE trust", 1).replace("round(1 - greatest", "(1 - greatest").replace(", 6) AS trust", ") AS trust") + "," + _TAIL[_TAIL.index(") z\n)") + len(") z\n)") + 1 :].replace("FROM samples", "FROM fudged") + " SELECT sample_id, round(lat, 6) AS latitude, round(lng, 6) AS longitude FROM k")
def ux03(spark, sf):
    """The coordinate filter with trust in places as a hook: here each device's own coordinate_trust()."""
    s = samples(spark, sf)
    return folds.kalman(s, trust=stats.coordinate_trust(s)).select("sample_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(
    "ux04",
    S
    + f""", m AS (SELECT confirmed_type AS name, count(*) AS n, coalesce(count(*) FILTER (moving_state = 'moving') / nullif(count(*) FILTER (moving_state <> 'uncertain'), 0)::DOUBLE, 0.5) AS p
  FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE} GROUP BY 1)
SELECT sample_id, name, round(n / (1 + (SELECT sum(n) FROM m)) * CASE moving_state WHEN 'moving' THEN p WHEN 'stationary' THEN 1 - p ELSE 1 END, 9) AS score FROM samples CROSS JOIN m""",
)
def ux04(spark, sf):
    """Classification with another model as a hook: here one that knows a type's share of moving samples and nothing else."""

    def by_motion(m, depth, place):
        return F.when(F.col("moving_state") == "moving", m["moving_pct"]).when(F.col("moving_state") == "stationary", 1 - m["moving_pct"]).otherwise(1.0)

    return classifier.world(samples(spark, sf), model=by_motion, features=()).select("sample_id", "name", F.round("score", 9).alias("score"))
