"""Further operators: segment validity, path containment, model sets, live filters and blended classification."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import classifier as C
from wayfold.operators import folds, segments
from wayfold.operators import items as I
from wayfold.operators import models as M
from wayfold.operators.brain import states
from wayfold.operators.tables import staged
from wayfold.plans.basics import AS_OF, usable
from wayfold.plans.classify import CELLS, SCORES
from wayfold.plans.sqltext import I as ITEMS
from wayfold.plans.sqltext import USABLE, S, hav
from wayfold.plans.statistics import SEG, numbered
from wayfold.registry import query
from wayfold.schemas import LIMITS
from wayfold.sources.samples import samples


def r(c, n):
    return F.round(c, n)


#: Seconds of units, a month being 30 days and a year 365.
UNITS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}

SEG_STAT = SEG + f""", su AS (SELECT *, {hav('lag(latitude) OVER k', 'lag(longitude) OVER k', 'latitude', 'longitude')} AS d FROM segs WHERE {USABLE} WINDOW k AS (PARTITION BY device_id, item_no, segment_no ORDER BY t, sample_id)),
  sdist AS (SELECT device_id, item_no, segment_no, sum(coalesce(d, 0)) AS distance FROM su GROUP BY ALL),
  se AS (SELECT *, coalesce(lead(start_t) OVER (PARTITION BY device_id, item_no ORDER BY segment_no), last_t) - start_t AS duration FROM sums),
  sv AS (SELECT device_id, item_no, segment_no, CASE WHEN activity_type = 'stationary' THEN duration >= 10 ELSE n_samples >= 2 AND duration >= 10 AND coalesce(distance, 0) >= 10 END AS valid, activity_type, duration, coalesce(distance, 0) AS distance FROM se LEFT JOIN sdist USING (device_id, item_no, segment_no))"""


@query("prd15", SEG_STAT + " SELECT device_id, item_no, segment_no, coalesce(valid, false) AS valid, coalesce(valid AND CASE WHEN activity_type = 'stationary' THEN duration >= 120 ELSE duration >= 60 AND distance >= 20 END, false) AS keeper FROM sv")
def prd15(spark, sf):
    keys = ["device_id", "item_no", "segment_no"]
    s = segments.segments(numbered(spark, sf))
    d = segments.summarize(s).join(I.distances(s, *keys), keys, "left").withColumns({"duration": F.col("end_t") - F.col("start_t"), "distance": F.coalesce("distance", F.lit(0.0))})
    still = F.coalesce(F.col("activity_type") == "stationary", F.lit(False))
    valid = F.when(still, F.col("duration") >= LIMITS.visit_valid_s).otherwise((F.col("n_samples") >= LIMITS.path_valid_samples) & (F.col("duration") >= LIMITS.path_valid_s) & (F.col("distance") >= LIMITS.path_valid_m))
    keeper = valid & F.when(still, F.col("duration") >= LIMITS.visit_keeper_s).otherwise((F.col("duration") >= LIMITS.path_keeper_s) & (F.col("distance") >= LIMITS.path_keeper_m))
    return d.select(*keys, valid.alias("valid"), keeper.alias("keeper"))


PATH = ITEMS + f""", p AS (SELECT device_id, item_no, t, sample_id, {hav('latitude', 'longitude', '13.75', '100.55')} AS d, {hav('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')} AS dp, {hav('latitude', 'longitude', 'lead(latitude) OVER o', 'lead(longitude) OVER o')} AS dn
  FROM numbered WHERE latitude IS NOT NULL AND m WINDOW o AS (PARTITION BY device_id, item_no ORDER BY t, sample_id))"""


@query("prd20", PATH + " SELECT device_id, item_no, coalesce(bool_or(d <= greatest(coalesce(dp, 0), dn, 10)) FILTER (dn IS NOT NULL), false) AS has_place FROM p GROUP BY ALL")
def prd20(spark, sf):
    n = numbered(spark, sf).filter("latitude is not null and moving_state <> 'stationary'")
    return segments.path_contains(n, 13.75, 100.55)


@query("prd24", S + f", m AS (SELECT device_id, list(DISTINCT classified_type) AS have, avg(least(1.0, 1e0 * leg / 2)) AS c, max(last_saved) AS u, max(t) AS fetched FROM samples GROUP BY 1) SELECT device_id, CASE WHEN len(list_filter(['stationary', 'walking', 'car', 'cycling'], lambda x: NOT coalesce(list_contains(have, x), false))) > 0 THEN true WHEN {AS_OF} - fetched < 3600 THEN false WHEN {AS_OF} - u < 5184000 * c THEN false WHEN {AS_OF} - fetched < 604800 * c THEN false ELSE true END AS stale FROM m")
def prd24(spark, sf):
    m = samples(spark, sf).groupBy("device_id").agg(F.collect_set("classified_type").alias("have"), F.avg(F.least(F.lit(1.0), F.col("leg") / 2)).alias("c"), F.max("last_saved").alias("u"), F.max("t").alias("f"))
    return m.select("device_id", M.stale(F.col("have"), ("stationary", "walking", "car", "cycling"), F.col("c"), AS_OF - F.col("u"), AS_OF - F.col("f")).alias("stale"))


MODELS = S + ", m AS (SELECT classified_type AS name, count(*) AS n, max(last_saved) AS updated, count(*) % 3 AS version FROM samples WHERE classified_type IS NOT NULL GROUP BY 1)"


def model_rows(spark, sf):
    n = F.count(F.lit(1))
    return samples(spark, sf).filter("classified_type is not null").groupBy(F.col("classified_type").alias("name")).agg(n.alias("n"), F.max("last_saved").alias("updated"), (n % 3).alias("version"))


@query("snk09", MODELS + f" SELECT name FROM m WHERE NOT (version = 0 OR updated IS NULL OR updated < {AS_OF} - 5184000)")
def snk09(spark, sf):
    return model_rows(spark, sf).filter(~((F.col("version") == 0) | F.col("updated").isNull() | (F.col("updated") < AS_OF - 5184000))).select("name")


@query("src09", MODELS + " SELECT name, n FROM m WHERE n > 100 ORDER BY n DESC")
def src09(spark, sf):
    from wayfold.operators import store

    model_rows(spark, sf).createOrReplaceTempView("ActivityTypeModel")
    return store.select(spark, "SELECT name, n FROM ActivityTypeModel WHERE n > :n ORDER BY n DESC", n=100)


@query("snk11")
def snk11(spark, sf):
    m = M.train(samples(spark, sf))
    return m.select("confirmed_type", F.to_json(F.struct("total_samples", "moving_pct", "accuracy", "speed", "altitude")).alias("stats"))


@query("snk02", S + " SELECT sample_id, t, last_saved FROM samples")
def snk02(spark, sf):
    """Saves all samples to a table in the shared folder and reads them back."""
    return staged(samples(spark, sf).select("sample_id", "t", "last_saved"), "saved")


@query("fn20", S + f", c AS (SELECT confirmed_type, latitude, longitude, {CELLS} FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE}), b AS (SELECT confirmed_type, la, lo, trunc((latitude - la) / 0.0005e0)::BIGINT AS x, trunc((longitude - lo) / 0.0005e0)::BIGINT AS y FROM c), n AS (SELECT confirmed_type, la, lo, x, y, least(count(*), 65535) AS n FROM b WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 199 GROUP BY ALL) SELECT confirmed_type, round(la, 4) AS cell_lat, round(lo, 4) AS cell_lng, '200,200,0;' || string_agg(x || ',' || y || ',' || n, ';' ORDER BY x, y) AS bins FROM n GROUP BY confirmed_type, la, lo")
def fn20(spark, sf):
    m = M.matrix(samples(spark, sf).filter(F.col("confirmed_type").isNotNull() & usable()), 2, "confirmed_type")
    return M.serialise_matrix(m, 2, "confirmed_type").select("confirmed_type", r("cell_lat", 4).alias("cell_lat"), r("cell_lng", 4).alias("cell_lng"), "bins")


@query("fn30", ITEMS + " SELECT device_id, item_no, " + ", ".join(f"round(duration / {n}e0, 9) AS {unit}s" for unit, n in UNITS.items()) + " FROM items")
def fn30(spark, sf):
    """Each item's duration in every unit."""
    i = I.summarize(numbered(spark, sf).drop("activity_type"))
    return i.select("device_id", "item_no", *[r(F.col("duration") / float(n), 9).alias(f"{unit}s") for unit, n in UNITS.items()])


@query("src01", S + " SELECT sample_id FROM samples WHERE recording_state IN ('recording', 'wakeup', 'sleeping', 'deepSleeping')")
def src01(spark, sf):
    from wayfold.schemas import ACTIVE_STATES

    return samples(spark, sf).filter(F.col("recording_state").isin(*ACTIVE_STATES)).select("sample_id")


@query("src04", S + " SELECT device_id, t AS start_t, t + 20 AS end_t, sample_id % 40 AS steps FROM samples WHERE sample_id % 4 = 0")
def src04(spark, sf):
    return samples(spark, sf).filter("sample_id % 4 = 0").select("device_id", F.col("t").alias("start_t"), (F.col("t") + 20).alias("end_t"), (F.col("sample_id") % 40).alias("steps"))


@query("src05", S + " SELECT sample_id, unnest([t * 4, t * 4 + 1, t * 4 + 2, t * 4 + 3]) AS quarter FROM samples WHERE xy_acc IS NOT NULL")
def src05(spark, sf):
    return samples(spark, sf).filter("xy_acc is not null").select("sample_id", F.explode(F.sequence(F.col("t") * 4, F.col("t") * 4 + 3)).alias("quarter"))


@query("src13", S + " SELECT sample_id, t, latitude, longitude, moving_state, 'wayfold' AS source FROM samples")
def src13(spark, sf):
    s = samples(spark, sf)
    text = F.to_json(F.struct("sample_id", "t", "latitude", "longitude", "moving_state"))
    back = F.from_json(text, "sample_id bigint, t bigint, latitude double, longitude double, moving_state string, source string")
    return s.select(back.alias("x")).select("x.*").withColumn("source", F.coalesce("source", F.lit("wayfold")))


LATE = S + f", f AS (SELECT *, max(t) OVER (PARTITION BY device_id ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM samples WHERE {USABLE})"


@query("st06", LATE + " SELECT sample_id FROM f WHERE seen IS NULL OR (t > seen AND t >= seen - 60)")
def st06(spark, sf):
    """Fixes in the order of arrival, here of ids: late and out-of-order ones are left out."""
    before = F.max("t").over(W.partitionBy("device_id").orderBy("sample_id").rowsBetween(W.unboundedPreceding, -1))
    return samples(spark, sf).filter(usable()).withColumn("seen", before).filter("seen is null or (t > seen and t >= seen - 60)").select("sample_id")


@query("st08")
def st08(spark, sf):
    """The present window's weighted centre and accuracy at each fix."""
    return states(samples(spark, sf)).select("sample_id", r("latitude", 7).alias("latitude"), r("longitude", 7).alias("longitude"), r("accuracy", 4).alias("accuracy"))


@query("st09")
def st09(spark, sf):
    """The moving state at each fix, and since when a device stands still."""
    return states(samples(spark, sf)).select("sample_id", "state", "since")


@query("st10")
def st10(spark, sf):
    """The windows of devices whose past freezes when they fall asleep, until ten fixes are there again."""
    return states(samples(spark, sf), sleeps=True).select("sample_id", "n_present", "n_past", "state", "frozen")


def recorder_events(spark, sf):
    """Each device's first sample starts the recorder; samples in standby or a wakeup aren't commands, all give fixes with their moving state; sleep of a leg that is off is deep."""
    s = samples(spark, sf)
    first = F.row_number().over(I.per_device()) == 1
    fix = F.struct(F.lit("fix").alias("kind"), F.col("moving_state").alias("moving"), F.lit(None).cast("double").alias("until"))
    none = F.lit(None).cast("string")
    command = F.when(first, F.struct(F.lit("start").alias("kind"), none.alias("moving"), F.lit(None).cast("double").alias("until"))).when(
        (F.col("idx") == 23) & (F.col("recording_state") == "off"), F.struct(F.lit("deep").alias("kind"), none.alias("moving"), (F.col("t") + 900).cast("double").alias("until"))
    )
    e = s.withColumn("_c", command).withColumn("_e", F.explode(F.array_compact(F.array("_c", fix))))
    return e.select("device_id", F.col("t").cast("double").alias("t"), (2 * F.col("sample_id") + (F.col("_e.kind") == "fix").cast("int")).alias("event_id"), "_e.*")


@query("st13")
def st13(spark, sf):
    from wayfold.operators.recorder import transitions

    return transitions(recorder_events(spark, sf))


@query("st21", S + """, f AS (SELECT *, CASE WHEN last_saved - lag(last_saved) OVER o <= 40 THEN 0 ELSE 1 END AS f FROM samples WINDOW o AS (PARTITION BY device_id ORDER BY last_saved, sample_id)),
  g AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY last_saved, sample_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
  SELECT device_id, min(last_saved) AS since, max(last_saved) AS until, count(*) AS n_changes, count(DISTINCT sample_id % 50) AS n_changed FROM g GROUP BY device_id, k""")
def st21(spark, sf):
    """Saves of samples, by which of 50 objects they change, told once 40 seconds without a change have passed."""
    from wayfold.streaming.live import debounced

    d = samples(spark, sf).select("device_id", F.timestamp_seconds("last_saved").alias("date"), (F.col("sample_id") % 50).alias("object"))
    out = debounced(d, "40 seconds", id_col="object")
    return out.select("device_id", F.unix_timestamp("since").alias("since"), F.unix_timestamp("until").alias("until"), "n_changes", F.size("changed").cast("bigint").alias("n_changed"))


@query("st16")
def st16(spark, sf):
    return folds.recorded_items(samples(spark, sf)).select("sample_id", "item_no", "is_visit")


@query("st19")
def st19(spark, sf):
    s = numbered(spark, sf)
    return folds.pruned_sleep(s.join(I.summarize(s.drop("activity_type")).select("device_id", "item_no", "end_t"), ["device_id", "item_no"])).select("sample_id")


@query("st20", S + ", n AS (SELECT device_id, max(t) AS now FROM samples GROUP BY 1) SELECT sample_id FROM samples JOIN n USING (device_id) WHERE t >= now - 600")
def st20(spark, sf):
    s = samples(spark, sf)
    now = s.groupBy("device_id").agg(F.max("t").alias("now"))
    return s.join(now, "device_id").filter("t >= now - 600").select("sample_id")


@query("ml03", S + ", p AS (SELECT sample_id, confirmed_type, lag(confirmed_type) OVER (PARTITION BY device_id ORDER BY t, sample_id) AS prev FROM samples), c AS (SELECT confirmed_type AS k, prev, count(*) + 1 AS n FROM p WHERE confirmed_type IS NOT NULL AND prev IS NOT NULL GROUP BY ALL), m AS (SELECT k, max(n) AS m FROM c GROUP BY 1) SELECT p.sample_id, round(coalesce(n, 1) / m::DOUBLE, 9) AS factor FROM p JOIN m ON p.confirmed_type = m.k LEFT JOIN c ON c.k = p.confirmed_type AND c.prev = p.prev WHERE p.prev IS NOT NULL")
def ml03(spark, sf):
    p = samples(spark, sf).withColumn("prev", F.lag("confirmed_type").over(I.per_device())).filter("confirmed_type is not null and prev is not null")
    c = p.groupBy("confirmed_type", "prev").agg((F.count(F.lit(1)) + 1).alias("n"))
    top = c.groupBy("confirmed_type").agg(F.max("n").alias("m"))
    return p.join(top, "confirmed_type").join(c, ["confirmed_type", "prev"], "left").select("sample_id", r(F.coalesce("n", F.lit(1)) / F.col("m"), 9).alias("factor"))


@query("ml08", SCORES + f""", i AS ({ITEMS} SELECT n.sample_id, i.device_id, i.item_no, greatest(10.0, least(150.0, radius_mean + 3 * radius_sd)) >= 150 AS wide FROM numbered n JOIN items i USING (device_id, item_no)),
  a AS (SELECT i.device_id, i.item_no, name, CASE WHEN name = 'stationary' AND bool_or(wide) THEN 0 ELSE avg(score) END AS score FROM sc JOIN i USING (sample_id) GROUP BY i.device_id, i.item_no, name) SELECT device_id, item_no, name, round(score, 9) AS score FROM a""")
def ml08(spark, sf):
    s = samples(spark, sf)
    n = numbered(spark, sf)
    i = I.summarize(n.drop("activity_type")).select("device_id", "item_no", (geo.clamp(F.col("radius_mean") + 3 * F.col("radius_sd"), 10.0, 150.0) >= 150).alias("wide"))
    member = n.select("sample_id", "device_id", "item_no").join(i, ["device_id", "item_no"])
    a = C.world(s).join(member, "sample_id").groupBy("device_id", "item_no", "name").agg(F.avg("score").alias("s"), F.bool_or("wide").alias("wide"))
    return a.select("device_id", "item_no", "name", r(F.when((F.col("name") == "stationary") & F.col("wide"), 0.0).otherwise(F.col("s")), 9).alias("score"))


CAPPED = S + f", c AS (SELECT sample_id, confirmed_type, {CELLS}, latitude, longitude FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE}), b AS (SELECT *, trunc((latitude - la) / 0.0005e0)::BIGINT AS x, trunc((longitude - lo) / 0.0005e0)::BIGINT AS y FROM c), n AS (SELECT confirmed_type, la, lo, x, y, least(count(*), 65535) AS n FROM b WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 199 GROUP BY ALL), m AS (SELECT confirmed_type, la, lo, least(max(n), 80) AS m FROM n GROUP BY ALL)"


@query("ml05", CAPPED + " SELECT b.sample_id, m.confirmed_type AS name, round(least(1e0, coalesce(n.n, 0) / m::DOUBLE), 9) AS factor FROM b JOIN m ON m.la = b.la AND m.lo = b.lo LEFT JOIN n ON n.confirmed_type = m.confirmed_type AND n.la = b.la AND n.lo = b.lo AND n.x = b.x AND n.y = b.y")
def ml05(spark, sf):
    """How well each sample's place fits each type known in its cell, bins being full from a cap on."""
    s = samples(spark, sf).filter(F.col("confirmed_type").isNotNull() & usable())
    f = M.place_factor(s, M.matrix(s, 2, "confirmed_type"), 2, "confirmed_type")
    return f.select("sample_id", F.col("confirmed_type").alias("name"), r("factor", 9).alias("factor"))
