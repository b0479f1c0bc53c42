"""Aggregations over samples and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import items as I
from wayfold.operators import stats
from wayfold.plans.basics import items, usable
from wayfold.plans.sqltext import I as ITEMS
from wayfold.plans.sqltext import N, RANK, USABLE, S, hav
from wayfold.registry import query
from wayfold.sources.samples import samples

LEG = ["device_id", "leg"]


def numbered(spark, sf):
    s = I.number_items(samples(spark, sf).filter("not deleted"))
    return s.withColumn("activity_type", F.coalesce("confirmed_type", "classified_type"))


def r(c, n):
    return F.round(c, n)


@query("ag01", S + " SELECT device_id, leg, sum(altitude) AS total, avg(altitude) AS mean, round(var_pop(altitude), 6) AS variance, round(stddev_pop(altitude), 6) AS sd, coalesce(avg(CASE WHEN speed > 40 THEN speed END), 0.0) AS mean_fast FROM samples GROUP BY ALL".replace("sum(altitude) AS total, avg(altitude) AS mean", "round(sum(altitude), 6) AS total, round(avg(altitude), 6) AS mean").replace("coalesce(avg(CASE WHEN speed > 40 THEN speed END), 0.0)", "round(coalesce(avg(CASE WHEN speed > 40 THEN speed END), 0.0), 6)"))
def ag01(spark, sf):
    a = F.col("altitude")
    return samples(spark, sf).groupBy(*LEG).agg(
        r(F.sum(a), 6).alias("total"), r(F.avg(a), 6).alias("mean"), r(F.var_pop(a), 6).alias("variance"), r(F.stddev_pop(a), 6).alias("sd"), r(F.coalesce(F.avg(F.when(F.col("speed") > 40, F.col("speed"))), F.lit(0.0)), 6).alias("mean_fast")
    )


@query("ag02", S + " SELECT device_id, leg, min(altitude) AS low, max(altitude) AS high FROM samples GROUP BY ALL")
def ag02(spark, sf):
    return samples(spark, sf).groupBy(*LEG).agg(F.min("altitude").alias("low"), F.max("altitude").alias("high"))


FIXES = S + f", u AS (SELECT *, max(h_acc) OVER (PARTITION BY device_id, leg) AS worst FROM samples WHERE {USABLE}), w AS (SELECT *, 1 - h_acc / (worst + 1) AS w FROM u)"


@query("ag03", FIXES + """ SELECT device_id, leg, round(degrees(atan2(sum(w * sin(radians(latitude))), sqrt(sum(w * cos(radians(latitude)) * cos(radians(longitude))) ^ 2 + sum(w * cos(radians(latitude)) * sin(radians(longitude))) ^ 2))), 6) AS latitude,
  round(degrees(atan2(sum(w * cos(radians(latitude)) * sin(radians(longitude))), sum(w * cos(radians(latitude)) * cos(radians(longitude))))), 6) AS longitude, round(sum(w * t) / sum(w), 3) AS t, round(sum(w * altitude) / sum(w), 3) AS altitude, round(sum(w * h_acc) / sum(w), 3) AS h_acc FROM w GROUP BY ALL""")
def ag03(spark, sf):
    c = stats.weighted_fixes(samples(spark, sf), *LEG)
    return c.select(*LEG, r("latitude", 6).alias("latitude"), r("longitude", 6).alias("longitude"), r("t", 3).alias("t"), r("altitude", 3).alias("altitude"), r("h_acc", 3).alias("h_acc"))


@query("ag04", ITEMS + " SELECT device_id, item_no, n_usable, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM centre")
def ag04(spark, sf):
    return I.centres(numbered(spark, sf), "device_id", "item_no").select("device_id", "item_no", "n_usable", r("latitude", 6).alias("latitude"), r("longitude", 6).alias("longitude"))


@query("ag05", S + f""", m AS (SELECT device_id, leg, avg(cos(radians(latitude)) * cos(radians(longitude))) AS x, avg(cos(radians(latitude)) * sin(radians(longitude))) AS y, avg(sin(radians(latitude))) AS z FROM samples WHERE {USABLE} GROUP BY ALL)
  SELECT device_id, leg, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS latitude, round(degrees(atan2(y, x)), 6) AS longitude FROM m""")
def ag05(spark, sf):
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    g = samples(spark, sf).filter(usable()).groupBy(*LEG).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))
    return g.select(*LEG, r(geo.lat_of(F.col("x"), F.col("y"), F.col("z")), 6).alias("latitude"), r(geo.lng_of(F.col("x"), F.col("y")), 6).alias("longitude"))


@query("ag06", ITEMS + " SELECT device_id, item_no, round(radius_mean, 3) AS radius_mean, round(radius_sd, 3) AS radius_sd FROM items")
def ag06(spark, sf):
    return items(spark, sf).select("device_id", "item_no", r("radius_mean", 3).alias("radius_mean"), r("radius_sd", 3).alias("radius_sd"))


@query("ag07", ITEMS + " SELECT device_id, item_no, " + ", ".join(f"round(greatest(10.0, least(150.0, radius_mean + {k} * radius_sd)), 3) AS radius{k}sd" for k in range(4)) + " FROM items")
def ag07(spark, sf):
    return items(spark, sf).select("device_id", "item_no", *[r(geo.clamp(F.col("radius_mean") + k * F.col("radius_sd"), 10.0, 150.0), 3).alias(f"radius{k}sd") for k in range(4)])


@query("ag08", S + " SELECT device_id, leg, round(coalesce(avg(h_acc) FILTER (h_acc >= 0), -1), 6) AS h, round(coalesce(avg(v_acc) FILTER (v_acc >= 0), -1), 6) AS v FROM samples GROUP BY ALL")
def ag08(spark, sf):
    mean = lambda c: r(F.coalesce(F.avg(F.when(F.col(c) >= 0, F.col(c))), F.lit(-1.0)), 6)
    return samples(spark, sf).groupBy(*LEG).agg(mean("h_acc").alias("h"), mean("v_acc").alias("v"))


@query("ag09", S + " SELECT device_id, leg, min(h_acc) FILTER (h_acc >= 0) AS h_low, max(h_acc) FILTER (h_acc >= 0) AS h_high, min(v_acc) FILTER (v_acc > 0) AS v_low, max(v_acc) FILTER (v_acc > 0) AS v_high FROM samples GROUP BY ALL")
def ag09(spark, sf):
    h, v = F.when(F.col("h_acc") >= 0, F.col("h_acc")), F.when(F.col("v_acc") > 0, F.col("v_acc"))
    return samples(spark, sf).groupBy(*LEG).agg(F.min(h).alias("h_low"), F.max(h).alias("h_high"), F.min(v).alias("v_low"), F.max(v).alias("v_high"))


@query("ag10", S + " , u AS (SELECT *, max(v_acc) OVER (PARTITION BY device_id, leg) AS worst FROM samples WHERE v_acc > 0) SELECT device_id, leg, round(sum((1 - v_acc / (worst + 1)) * altitude) / sum(1 - v_acc / (worst + 1)), 9) AS altitude FROM u GROUP BY ALL")
def ag10(spark, sf):
    return stats.weighted_altitude(samples(spark, sf), *LEG).select(*LEG, r("altitude", 9).alias("altitude"))


def brg(a, b, c, d):
    x = f"degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))))"
    return f"(CASE WHEN {a} = {c} AND {b} = {d} THEN NULL WHEN {x} < 0 THEN {x} + 360 ELSE {x} END)"


@query("ag11", S + f""", u AS (SELECT device_id, leg, {brg('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')} AS b FROM samples WHERE {USABLE} WINDOW o AS (PARTITION BY device_id, leg ORDER BY t, sample_id))
  SELECT device_id, leg, round(CASE WHEN count(*) <= 2 OR count(b) < 4 THEN 1.0 ELSE 1 - sqrt(avg(sin(radians(b))) ^ 2 + avg(cos(radians(b))) ^ 2) END, 6) AS course_variance FROM u GROUP BY ALL""")
def ag11(spark, sf):
    return stats.course_variance(samples(spark, sf).filter(usable()), *LEG).select(*LEG, r("course_variance", 6).alias("course_variance"))


@query("ag12", S + """, c AS (SELECT device_id, leg, sum(sin(radians(course))) AS s, sum(cos(radians(course))) AS c, count(*) AS n FROM samples WHERE course >= 0 GROUP BY ALL), a AS (SELECT DISTINCT device_id, leg FROM samples)
  SELECT device_id, leg, round(CASE WHEN n IS NULL THEN -1.0 WHEN abs(s) + abs(c) < 1e-6 THEN -1.0 WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 4) AS course FROM a LEFT JOIN c USING (device_id, leg)""")
def ag12(spark, sf):
    c = F.when(F.col("course") >= 0, F.radians("course"))
    g = samples(spark, sf).groupBy(*LEG).agg(F.sum(F.sin(c)).alias("s"), F.sum(F.cos(c)).alias("c"))
    none = F.col("s").isNull() | (F.abs("s") + F.abs("c") < 1e-6)
    return g.select(*LEG, r(F.when(none, -1.0).otherwise(geo.positive_degrees(F.degrees(F.atan2("s", "c")))), 4).alias("course"))


@query("ag13", S + " SELECT device_id, leg, (max(t) - min(t))::DOUBLE AS duration FROM samples GROUP BY ALL")
def ag13(spark, sf):
    return samples(spark, sf).groupBy(*LEG).agg((F.max("t") - F.min("t")).cast("double").alias("duration"))


@query("ag14", ITEMS + " SELECT device_id, item_no, round(distance, 3) AS distance FROM items")
def ag14(spark, sf):
    return items(spark, sf).select("device_id", "item_no", r("distance", 3).alias("distance"))


@query("ag15", S + f""", d AS (SELECT *, {hav('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')} AS d FROM samples WHERE {USABLE} WINDOW o AS (PARTITION BY device_id, leg ORDER BY t, sample_id))
  SELECT device_id, leg, round(coalesce(avg(speed) FILTER (speed >= 0), CASE WHEN max(t) > min(t) THEN sum(coalesce(d, 0)) / (max(t) - min(t)) END, -1), 9) AS speed FROM d GROUP BY ALL""")
def ag15(spark, sf):
    return stats.speed_estimate(samples(spark, sf).filter(usable()), *LEG).select(*LEG, r("speed", 9).alias("speed"))


@query("ag16", S + " SELECT device_id, leg, round(coalesce(avg(abs(xy_acc)) + 3 * stddev_pop(abs(xy_acc)), 0), 6) AS xy_wiggle, round(coalesce(avg(abs(z_acc)) + 3 * stddev_pop(abs(z_acc)), 0), 6) AS z_wiggle FROM samples GROUP BY ALL")
def ag16(spark, sf):
    w = lambda c: r(F.coalesce(F.avg(F.abs(c)) + 3 * F.stddev_pop(F.abs(c)), F.lit(0.0)), 6)
    return samples(spark, sf).groupBy(*LEG).agg(w("xy_acc").alias("xy_wiggle"), w("z_acc").alias("z_wiggle"))


@query("ag18", S + " SELECT sample_id, (sample_id % 40) / 20e0 AS step_hz FROM samples WHERE sample_id % 4 = 0")
def ag18(spark, sf):
    return samples(spark, sf).filter("sample_id % 4 = 0").select("sample_id", ((F.col("sample_id") % 40) / F.lit(20.0)).alias("step_hz"))


MODE = N + f""", counted AS (SELECT device_id, item_no, activity_type, count(*) AS n, coalesce({RANK}, 1000) AS k FROM numbered GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, item_no ORDER BY n DESC, k) AS p FROM counted) WHERE p = 1),
moved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, item_no ORDER BY n DESC, k) AS p FROM counted WHERE activity_type IS DISTINCT FROM 'stationary') WHERE p = 1)"""


@query("ag19", MODE + " SELECT b.device_id, b.item_no, b.activity_type AS mode_type, m.activity_type AS mode_moving FROM best b LEFT JOIN moved m ON b.device_id = m.device_id AND b.item_no = m.item_no")
def ag19(spark, sf):
    n = numbered(spark, sf)
    keys = ["device_id", "item_no"]
    return I.mode_type(n, *keys).join(I.mode_type(n.filter("not activity_type <=> 'stationary'"), *keys, name="mode_moving"), keys, "left")


@query("ag20", MODE + ", v AS (SELECT device_id, item_no, NOT arg_min(m, (t, sample_id)) AS is_visit FROM numbered GROUP BY ALL) SELECT b.device_id, b.item_no, CASE WHEN is_visit THEN 'stationary' ELSE coalesce(m.activity_type, b.activity_type) END AS activity_type FROM best b JOIN v ON b.device_id = v.device_id AND b.item_no = v.item_no LEFT JOIN moved m ON b.device_id = m.device_id AND b.item_no = m.item_no")
def ag20(spark, sf):
    n = numbered(spark, sf)
    keys = ["device_id", "item_no"]
    kind = n.groupBy(*keys).agg(F.min_by(~I.moving(), F.struct("t", "sample_id")).alias("is_visit"))
    d = kind.join(I.mode_type(n, *keys), keys).join(I.mode_type(n.filter("not activity_type <=> 'stationary'"), *keys, name="mode_moving"), keys, "left")
    return d.select(*keys, F.when(F.col("is_visit"), "stationary").otherwise(F.coalesce("mode_moving", "mode_type")).alias("activity_type"))


@query("ag21", S + " SELECT count(*) AS n_samples, count(*) FILTER (NOT deleted) AS n_live, count(*) FILTER (confirmed_type IS NOT NULL) AS n_confirmed FROM samples")
def ag21(spark, sf):
    return samples(spark, sf).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(~F.col("deleted")).alias("n_live"), F.count("confirmed_type").alias("n_confirmed"))


@query("ag22", ITEMS + """ SELECT device_id, item_no, start_t, end_t, last_t, n_samples, n_usable, is_visit, is_gap, duration, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  round(radius_mean, 3) AS radius_mean, round(radius_sd, 3) AS radius_sd, round(distance, 3) AS distance, valid, keeper, keepness FROM items""")
def ag22(spark, sf):
    return items(spark, sf).withColumns({"latitude": r("latitude", 6), "longitude": r("longitude", 6), "radius_mean": r("radius_mean", 3), "radius_sd": r("radius_sd", 3), "distance": r("distance", 3)})


@query("ag23", ITEMS + " SELECT device_id, item_no, round(CASE WHEN duration > 0 THEN distance / duration ELSE 0 END, 4) AS mps, round(CASE WHEN duration > 0 THEN distance / duration ELSE 0 END * 3.6, 4) AS kmh, round(CASE WHEN duration > 0 THEN distance / duration ELSE 0 END * 3.6 / 1.609344, 4) AS mph FROM items WHERE NOT is_visit")
def ag23(spark, sf):
    v = F.when(F.col("duration") > 0, F.col("distance") / F.col("duration")).otherwise(0.0)
    return items(spark, sf).filter("not is_visit").select("device_id", "item_no", r(v, 4).alias("mps"), r(v * 3.6, 4).alias("kmh"), r(v * 3.6 / 1.609344, 4).alias("mph"))


TRUST = S + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY last_saved DESC, sample_id DESC) AS newest FROM samples WHERE confirmed_type = 'stationary') x WHERE newest <= 2000 AND {USABLE})
 SELECT device_id, sign(latitude) * floor(abs(latitude) * 10000 + 0.5) / 10000 AS lat4, sign(longitude) * floor(abs(longitude) * 10000 + 0.5) / 10000 AS lng4, round(1 - greatest(0, least(1, avg(greatest(speed, 0)) * 3.6 / 5)), 6) AS trust FROM top GROUP BY ALL"""


@query("ag25", TRUST)
def ag25(spark, sf):
    t = stats.coordinate_trust(samples(spark, sf))
    return t.withColumn("trust", r("trust", 6))


@query("ag34", N + " SELECT device_id, item_no, CASE WHEN count(DISTINCT confirmed_type) = 1 AND count(confirmed_type) = count(*) THEN min(confirmed_type) END AS confirmed FROM numbered GROUP BY ALL")
def ag34(spark, sf):
    one = (F.min("confirmed_type") == F.max("confirmed_type")) & (F.count("confirmed_type") == F.count(F.lit(1)))
    return numbered(spark, sf).groupBy("device_id", "item_no").agg(F.when(one, F.min("confirmed_type")).alias("confirmed"))


@query("ag35", N + ", p AS (SELECT *, row_number() OVER (PARTITION BY device_id, item_no ORDER BY t, sample_id) AS a, row_number() OVER (PARTITION BY device_id, item_no ORDER BY t DESC, sample_id DESC) AS z FROM numbered) SELECT device_id, item_no, max(sample_id) FILTER (a = 1) AS first_id, max(sample_id) FILTER (a = 2) AS second_id, max(sample_id) FILTER (z = 2) AS second_last_id, max(sample_id) FILTER (z = 1) AS last_id FROM p GROUP BY ALL")
def ag35(spark, sf):
    return stats.edges(numbered(spark, sf), "device_id", "item_no")


SEG = N + """, sf AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR activity_type IS DISTINCT FROM lag(activity_type) OVER o OR recording_state IS DISTINCT FROM lag(recording_state) OVER o THEN 1 ELSE 0 END AS sflag FROM numbered WINDOW o AS (PARTITION BY device_id, item_no ORDER BY t, sample_id)),
segs AS (SELECT *, (sum(sflag) OVER (PARTITION BY device_id, item_no ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_no FROM sf),
sums AS (SELECT device_id, item_no, segment_no, min(activity_type) AS activity_type, min(recording_state) AS recording_state, min(t) AS start_t, max(t) AS last_t, count(*) AS n_samples FROM segs GROUP BY ALL)"""


@query("ag36", SEG + " SELECT *, coalesce(lead(start_t) OVER (PARTITION BY device_id, item_no ORDER BY segment_no), last_t) AS end_t FROM sums")
def ag36(spark, sf):
    from wayfold.operators.segments import segments, summarize

    return summarize(segments(numbered(spark, sf)))


@query("ag38", S + " SELECT recording_state, moving_state, count(*) AS n, round(avg(step_hz), 6) AS step_hz, count(latitude) AS locations FROM samples GROUP BY ALL")
def ag38(spark, sf):
    return samples(spark, sf).groupBy("recording_state", "moving_state").agg(F.count(F.lit(1)).alias("n"), r(F.avg("step_hz"), 6).alias("step_hz"), F.count("latitude").alias("locations"))


# windows


@query("wn01", SEG + " SELECT sample_id, item_no, segment_no FROM segs")
def wn01(spark, sf):
    from wayfold.operators.segments import segments

    return segments(numbered(spark, sf)).select("sample_id", "item_no", "segment_no")


@query("wn02", SEG.replace("OR recording_state IS DISTINCT FROM lag(recording_state) OVER o", "") + " SELECT sample_id, item_no, segment_no FROM segs")
def wn02(spark, sf):
    from wayfold.operators.segments import segments

    return segments(numbered(spark, sf), states=False).select("sample_id", "item_no", "segment_no")


@query("wn03", S + " SELECT sample_id, lag(confirmed_type) OVER (PARTITION BY device_id ORDER BY t, sample_id) AS previous_type FROM samples")
def wn03(spark, sf):
    return samples(spark, sf).select("sample_id", F.lag("confirmed_type").over(I.per_device()).alias("previous_type"))


@query("wn04", S + f" SELECT sample_id, round({brg('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')}, 3) AS bearing, round({hav('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')}, 3) AS step FROM samples WHERE {USABLE} WINDOW o AS (PARTITION BY device_id ORDER BY t, sample_id)")
def wn04(spark, sf):
    o = I.per_device()
    p = (F.lag("latitude").over(o), F.lag("longitude").over(o), F.col("latitude"), F.col("longitude"))
    return samples(spark, sf).filter(usable()).select("sample_id", r(geo.bearing(*p), 3).alias("bearing"), r(geo.distance(*p), 3).alias("step"))


@query("wn05", S + """, f AS (SELECT *, CASE WHEN moving_state IS DISTINCT FROM lag(moving_state) OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS f FROM samples WINDOW o AS (PARTITION BY device_id ORDER BY t, sample_id)),
  g AS (SELECT *, (sum(f) OVER (PARTITION BY device_id ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING))::BIGINT AS group_no, lead(t) OVER (PARTITION BY device_id ORDER BY t, sample_id) AS nt FROM f)
  SELECT device_id, group_no, min(moving_state) AS moving_state, min(t) AS start_t, max(coalesce(nt, t)) AS end_t, count(*) AS n FROM g GROUP BY ALL""")
def wn05(spark, sf):
    o = I.per_device()
    g = I.islands(samples(spark, sf), o, "group_no", F.col("moving_state")).withColumn("nt", F.coalesce(F.lead("t").over(o), F.col("t")))
    return g.groupBy("device_id", "group_no").agg(F.min("moving_state").alias("moving_state"), F.min("t").alias("start_t"), F.max("nt").alias("end_t"), F.count(F.lit(1)).alias("n"))


@query("wn06", ITEMS + " SELECT device_id, item_no, end_t FROM items")
def wn06(spark, sf):
    return items(spark, sf).select("device_id", "item_no", "end_t")


@query("wn07", N + " SELECT sample_id, item_no FROM numbered")
def wn07(spark, sf):
    return numbered(spark, sf).select("sample_id", "item_no")


@query("wn08", ITEMS + ", n AS (SELECT *, lead(start_t) OVER o - last_t AS gap, lead(is_gap) OVER o AS next_gap, lead(item_no) OVER o AS next_no FROM items WINDOW o AS (PARTITION BY device_id ORDER BY item_no)) SELECT device_id, item_no, next_no, gap FROM n WHERE gap > 300 AND NOT is_gap AND NOT next_gap")
def wn08(spark, sf):
    from wayfold.operators.segments import data_gaps

    return data_gaps(items(spark, sf)).select("device_id", "item_no", "next_no", "gap")


@query("wn09", """WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER o + INTERVAL 6 HOURS OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def wn09(spark, sf):
    from wayfold.sources.samples import table

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")

