"""Location samples: the fixture view over the events table, in SQL that Spark and DuckDB both run, and typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.schemas import ACTIVE_STATES

#: {events} is the table. t is the time in seconds since 1970. Every column follows from event_id, user_id, value and order.
SAMPLES_SQL = """
SELECT e AS sample_id, u AS device_id, 1704067200 + 60 * u + 20 * seq + 900 * leg AS t, leg, idx,
       CASE WHEN e % 23 = 0 THEN NULL WHEN still THEN a_lat + (e % 7 - 3) * 2e-5 ELSE a_lat + (b_lat - a_lat) * (idx - 11) / 13e0 END AS latitude,
       CASE WHEN e % 23 = 0 THEN NULL WHEN still THEN a_lng + (e % 5 - 2) * 2e-5 ELSE a_lng + (b_lng - a_lng) * (idx - 11) / 13e0 END AS longitude,
       value AS altitude, 5e0 + e % 60 AS h_acc, CASE WHEN e % 10 = 0 THEN -1e0 ELSE 3e0 + e % 20 END AS v_acc,
       CASE WHEN e % 17 = 0 THEN -1e0 WHEN still THEN 1e-1 * (e % 5) ELSE 1e0 + value / 10 END AS speed,
       CASE WHEN still THEN -1e0 ELSE 1e0 * (37 * e % 360) END AS course,
       CASE WHEN e % 29 = 0 THEN 'uncertain' WHEN still THEN 'stationary' ELSE 'moving' END AS moving_state,
       CASE WHEN leg % 3 = 1 AND NOT still THEN 'off' WHEN leg % 3 = 2 AND still THEN 'sleeping' ELSE 'recording' END AS recording_state,
       CASE WHEN e % 3 = 0 THEN NULL WHEN still THEN 'stationary' WHEN leg % 3 = 0 THEN 'walking' WHEN leg % 3 = 1 THEN 'car' ELSE 'cycling' END AS confirmed_type,
       CASE WHEN e % 19 = 0 THEN NULL WHEN e % 11 = 0 THEN 'bus' WHEN still THEN 'stationary' WHEN leg % 3 = 0 THEN 'walking' WHEN leg % 3 = 1 THEN 'car' ELSE 'cycling' END AS classified_type,
       CASE WHEN e % 6 = 0 THEN NULL ELSE 1e-1 * (e % 25) END AS step_hz, CASE WHEN e % 8 = 0 THEN NULL ELSE 1e-2 * (e % 101) END AS course_variance,
       CASE WHEN e % 9 = 0 THEN NULL ELSE 2e-2 * (e % 37) END AS xy_acc, CASE WHEN e % 9 = 0 THEN NULL ELSE 3e-2 * (e % 31) END AS z_acc,
       e % 31 = 0 AS deleted, 1704067200 + 60 * u + 20 * seq + 900 * leg + e % 400 AS last_saved, CAST(3600 * (u % 5 - 2) AS BIGINT) AS seconds_from_gmt
FROM (
  SELECT *, idx < 12 AS still,
         137e-1 + 1e-2 * ((7 * u + 3 * leg) % 11) AS a_lat, 1005e-1 + 1e-2 * ((5 * u + 4 * leg) % 13) AS a_lng,
         137e-1 + 1e-2 * ((7 * u + 3 * (leg + 1)) % 11) AS b_lat, 1005e-1 + 1e-2 * ((5 * u + 4 * (leg + 1)) % 13) AS b_lng
  FROM (
    SELECT e, u, value, seq, CAST(floor(seq / 24e0) AS BIGINT) AS leg, seq % 24 AS idx
    FROM (SELECT event_id AS e, user_id AS u, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM {events}) x) y) z
"""
SAMPLES = SAMPLES_SQL.replace("{events}", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLES_SQL, events=table(spark, sf_dir, "events"))


def live_fixes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of fixes from files; rows outside the active recording states are left out as they arrive."""
    fixes = spark.readStream.schema(schema).parquet(path)
    return fixes.filter(fixes.recording_state.isin(*ACTIVE_STATES))
