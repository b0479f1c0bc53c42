"""Scalar functions over samples and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo, text
from wayfold.plans.basics import items, usable
from wayfold.plans.sqltext import I as ITEMS
from wayfold.plans.sqltext import USABLE, S, hav
from wayfold.plans.statistics import brg
from wayfold.registry import query
from wayfold.sources.samples import samples



def r(c, n):
    return F.round(c, n)


@query("fn01", S + " SELECT sample_id, round(radians(course), 9) AS rad, round(degrees(radians(course)), 6) AS deg, CASE WHEN course - 200 < 0 THEN course + 160 ELSE course - 200 END AS positive FROM samples")
def fn01(spark, sf):
    c = F.col("course")
    return samples(spark, sf).select("sample_id", r(F.radians(c), 9).alias("rad"), r(F.degrees(F.radians(c)), 6).alias("deg"), geo.positive_degrees(c - 200).alias("positive"))


@query("fn02", S + f" SELECT sample_id, round({hav('latitude', 'longitude', '13.75', '100.55')}, 3) AS metres FROM samples WHERE latitude IS NOT NULL")
def fn02(spark, sf):
    return samples(spark, sf).filter("latitude is not null").select("sample_id", r(geo.distance(F.col("latitude"), F.col("longitude"), 13.75, 100.55), 3).alias("metres"))


@query("fn03", S + f" SELECT sample_id, round({brg('latitude', 'longitude', '13.75', '100.55')}, 4) AS bearing FROM samples WHERE latitude IS NOT NULL")
def fn03(spark, sf):
    return samples(spark, sf).filter("latitude is not null").select("sample_id", r(geo.bearing(F.col("latitude"), F.col("longitude"), 13.75, 100.55), 4).alias("bearing"))


@query("fn04", S + " SELECT sample_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM samples WHERE latitude IS NOT NULL")
def fn04(spark, sf):
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    return samples(spark, sf).filter("latitude is not null").select("sample_id", r(geo.lat_of(x, y, z), 6).alias("latitude"), r(geo.lng_of(x, y), 6).alias("longitude"))


@query("fn05", S + f" SELECT sample_id, round(1 - h_acc / (max(h_acc) OVER (PARTITION BY device_id, leg) + 1), 9) AS weight FROM samples WHERE {USABLE}")
def fn05(spark, sf):
    u = samples(spark, sf).filter(usable())
    worst = u.groupBy("device_id", "leg").agg(F.max("h_acc").alias("worst"))
    return u.join(worst, ["device_id", "leg"]).select("sample_id", r(1 - F.col("h_acc") / (F.col("worst") + 1), 9).alias("weight"))


@query("fn06", S + " SELECT sample_id, round(speed * 3.6, 6) AS kmh, round(speed * 3.6 / 1.609344, 6) AS mph, round(altitude * 3.28084, 6) AS feet FROM samples")
def fn06(spark, sf):
    v = F.col("speed")
    return samples(spark, sf).select("sample_id", r(v * 3.6, 6).alias("kmh"), r(v * 3.6 / 1.609344, 6).alias("mph"), r(F.col("altitude") * 3.28084, 6).alias("feet"))


@query("fn07", S + " SELECT sample_id, greatest(10, least(40, h_acc)) AS clamped FROM samples")
def fn07(spark, sf):
    return samples(spark, sf).select("sample_id", geo.clamp(F.col("h_acc"), 10.0, 40.0).alias("clamped"))


@query("fn08", ITEMS + " SELECT device_id, item_no, round(radius_mean + 2 * radius_sd, 3) AS radius FROM items")
def fn08(spark, sf):
    return items(spark, sf).select("device_id", "item_no", r(F.col("radius_mean") + 2 * F.col("radius_sd"), 3).alias("radius"))


@query("fn09", S + " SELECT sample_id, sign(latitude) * floor(abs(latitude) * 10000 + 0.5) / 10000 AS lat4, sign(longitude) * floor(abs(longitude) * 10000 + 0.5) / 10000 AS lng4 FROM samples")
def fn09(spark, sf):
    return samples(spark, sf).select("sample_id", geo.round_half_away(F.col("latitude"), 4).alias("lat4"), geo.round_half_away(F.col("longitude"), 4).alias("lng4"))


@query("fn10", "SELECT * FROM (VALUES (0, 10.0::DOUBLE), (1, 0.1::DOUBLE), (2, 0.0005::DOUBLE)) t(depth, degrees)")
def fn10(spark, sf):
    return spark.createDataFrame([(0, 10.0), (1, 0.1), (2, 0.0005)], "depth int, degrees double")




def cell_sql(x, low, size):
    return f"({low} + trunc(({x} - {low}) / {size}) * {size})"


@query("fn11", S + f" SELECT sample_id, round({cell_sql('latitude', '-90e0', '10e0')}, 4) AS lat1, round({cell_sql('longitude', '-180e0', '10e0')}, 4) AS lng1, round({cell_sql('latitude', '-90e0', '0.1e0')}, 4) AS lat2, round({cell_sql('longitude', '-180e0', '0.1e0')}, 4) AS lng2 FROM samples WHERE latitude IS NOT NULL")
def fn11(spark, sf):
    s = samples(spark, sf).filter("latitude is not null")
    cells = [r(geo.cell_min(F.col(c), d, low), 4).alias(f"{name}{d}") for d in (1, 2) for c, name, low in (("latitude", "lat", -90.0), ("longitude", "lng", -180.0))]
    return s.select("sample_id", *cells)


@query("fn12", S + f" SELECT sample_id, printf('GD2 %s %.2f,%.2f', confirmed_type, {cell_sql('latitude', '-90e0', '0.1e0')} + 0.05, {cell_sql('longitude', '-180e0', '0.1e0')} + 0.05) AS geo_key FROM samples WHERE latitude IS NOT NULL AND confirmed_type IS NOT NULL")
def fn12(spark, sf):
    from wayfold.operators.models import geo_key

    s = samples(spark, sf).filter("latitude is not null and confirmed_type is not null")
    return s.select("sample_id", geo_key(F.col("confirmed_type"), F.col("latitude"), F.col("longitude"), 2).alias("geo_key"))


@query("fn14", S + ", n AS (SELECT classified_type AS name, count(*) AS n, avg(CASE WHEN classified_type = confirmed_type THEN 1.0 ELSE 0.0 END) AS a FROM samples WHERE classified_type IS NOT NULL GROUP BY 1) SELECT name, round(least(1.0, n / 1800e0), 9) AS completeness, round(a * least(1.0, n / 1800e0), 9) AS coverage FROM n")
def fn14(spark, sf):
    from wayfold.operators.models import completeness

    right = F.avg(F.when(F.col("classified_type") == F.col("confirmed_type"), 1.0).otherwise(0.0))
    n = samples(spark, sf).filter("classified_type is not null").groupBy(F.col("classified_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), right.alias("a"))
    return n.select("name", r(completeness(F.col("n"), 2), 9).alias("completeness"), r(F.col("a") * completeness(F.col("n"), 2), 9).alias("coverage"))


@query("fn22", S + " SELECT sample_id, round(0.8 * xy_acc - 0.6 * z_acc, 6) AS x, round(0.6 * xy_acc + 0.8 * z_acc, 6) AS y, z_acc AS z FROM samples WHERE xy_acc IS NOT NULL")
def fn22(spark, sf):
    m = ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0))
    v = (F.col("xy_acc"), F.col("z_acc"), F.col("z_acc"))
    out = [sum(a * x for a, x in zip(row, v)) for row in m]
    return samples(spark, sf).filter("xy_acc is not null").select("sample_id", r(out[0], 6).alias("x"), r(out[1], 6).alias("y"), F.col("z_acc").alias("z"))


CONF = "greatest(0, CASE sample_id % 3 WHEN 0 THEN 0.33 WHEN 1 THEN 0.66 ELSE 1.0 END - CASE WHEN moving_state = 'stationary' THEN 0.01 ELSE 0 END - (now - t) / 30e0)"


def confidence(level, kind, age):
    """Confidence of a motion event: by its level, a little less for stationary, gone within half a minute."""
    start = F.when(level == 0, 0.33).when(level == 1, 0.66).otherwise(1.0) - F.when(kind == "stationary", 0.01).otherwise(0.0)
    return F.greatest(F.lit(0.0), start - age / 30)


@query("fn23", S + f", n AS (SELECT *, max(t) OVER (PARTITION BY device_id, leg) AS now FROM samples) SELECT sample_id, round({CONF}, 6) AS confidence FROM n")
def fn23(spark, sf):
    s = samples(spark, sf)
    now = s.groupBy("device_id", "leg").agg(F.max("t").alias("now"))
    c = confidence(F.col("sample_id") % 3, F.col("moving_state"), F.col("now") - F.col("t"))
    return s.join(now, ["device_id", "leg"]).select("sample_id", r(c, 6).alias("confidence"))


@query("fn24", S + f""", n AS (SELECT *, max(t) OVER (PARTITION BY device_id, leg) AS now FROM samples), l AS (SELECT *, {CONF} AS c, row_number() OVER (PARTITION BY device_id, leg, moving_state ORDER BY t DESC, sample_id DESC) AS p FROM n),
  b AS (SELECT *, row_number() OVER (PARTITION BY device_id, leg ORDER BY c DESC, moving_state) AS q FROM l WHERE p = 1) SELECT device_id, leg, moving_state AS name, round(c, 6) AS confidence FROM b WHERE q = 1""")
def fn24(spark, sf):
    s = samples(spark, sf)
    keys = ["device_id", "leg"]
    last = s.groupBy(*keys, "moving_state").agg(F.max(F.struct("t", "sample_id")).alias("m"))
    now = s.groupBy(*keys).agg(F.max("t").alias("now"))
    c = confidence(F.col("m.sample_id") % 3, F.col("moving_state"), F.col("now") - F.col("m.t"))
    best = last.join(now, keys).withColumn("c", c).groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "moving_state")).alias("b"))
    return best.select(*keys, F.col("b.moving_state").alias("name"), r(-F.col("b.c"), 6).alias("confidence"))


@query("fn25", S + """, c AS (SELECT device_id, classified_type AS name, count(*) AS n FROM samples WHERE classified_type IS NOT NULL GROUP BY ALL), s AS (SELECT *, n / (sum(n) OVER (PARTITION BY device_id))::DOUBLE AS s FROM c)
  SELECT device_id, name, round(s, 9) AS share, CASE WHEN floor(s * 100 + 0.5) >= 100 THEN 100 WHEN floor(s * 100 + 0.5) >= 80 THEN 80 WHEN floor(s * 100 + 0.5) >= 50 THEN 50 WHEN floor(s * 100 + 0.5) >= 20 THEN 20 WHEN floor(s * 100 + 0.5) >= 1 THEN 1 ELSE 0 END AS score_group FROM s""")
def fn25(spark, sf):
    c = samples(spark, sf).filter("classified_type is not null").groupBy("device_id", F.col("classified_type").alias("name")).count()
    total = c.groupBy("device_id").agg(F.sum("count").alias("total"))
    s = F.col("count") / F.col("total")
    whole = F.floor(s * 100 + 0.5)
    group = F.lit(0)
    for g in (1, 20, 50, 80, 100):
        group = F.when(whole >= g, g).otherwise(group)
    return c.join(total, "device_id").select("device_id", "name", r(s, 9).alias("share"), group.alias("score_group"))


@query("fn26", S + ", x AS (SELECT device_id, avg(CASE WHEN classified_type = confirmed_type THEN 1.0 ELSE 0.0 END) AS s FROM samples GROUP BY 1) SELECT device_id, CASE WHEN trunc(s * 10) >= 8 THEN 'Excellent' WHEN trunc(s * 10) >= 5 THEN 'Very Good' WHEN trunc(s * 10) >= 3 THEN 'Good' WHEN trunc(s * 10) >= 1 THEN 'Low' ELSE 'Very Low' END AS words FROM x")
def fn26(spark, sf):
    s = samples(spark, sf).groupBy("device_id").agg(F.avg(F.when(F.col("classified_type") == F.col("confirmed_type"), 1.0).otherwise(0.0)).alias("s"))
    n = geo.clamp(geo.truncated(F.col("s") * 10), 0, 10)
    words = F.when(n >= 8, "Excellent").when(n >= 5, "Very Good").when(n >= 3, "Good").when(n >= 1, "Low").otherwise("Very Low")
    return s.select("device_id", words.alias("words"))


@query("fn27", S + " SELECT sample_id, CASE WHEN floor(altitude) >= 75 THEN 5 WHEN floor(altitude) >= 50 THEN 4 WHEN floor(altitude) >= 25 THEN 3 WHEN floor(altitude) >= 10 THEN 2 ELSE 1 END AS score FROM samples")
def fn27(spark, sf):
    from wayfold.operators.merging import type_score

    return samples(spark, sf).select("sample_id", type_score(F.col("altitude") / 1000).alias("score"))


@query("fn28", S + " SELECT sample_id, CASE WHEN speed < 0 THEN 10 ELSE greatest(10, least(60, trunc(h_acc + greatest(0, least(10, 10 - speed * 3.6)))))::INT END AS required FROM samples")
def fn28(spark, sf):
    n = geo.clamp(geo.truncated(F.col("h_acc") + geo.clamp(10 - F.col("speed") * 3.6, 0.0, 10.0)), 10, 60)
    return samples(spark, sf).select("sample_id", F.when(F.col("speed") < 0, 10).otherwise(n).cast("int").alias("required"))


@query("fn29", S + " SELECT sample_id, t - t % 86400 AS day_start, t % 86400 AS second_of_day, (t - t % 86400) = (last_saved - last_saved % 86400) AS same_day FROM samples")
def fn29(spark, sf):
    at, saved = F.timestamp_seconds("t"), F.timestamp_seconds("last_saved")
    start = F.unix_seconds(F.date_trunc("day", at))
    return samples(spark, sf).select("sample_id", start.alias("day_start"), (F.col("t") - start).alias("second_of_day"), (F.to_date(at) == F.to_date(saved)).alias("same_day"))


@query("fn31", ITEMS + """, d AS (SELECT device_id, item_no, floor(duration)::BIGINT AS s FROM items), p AS (SELECT *, s // 2592000 AS mo, s % 2592000 // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS mi, s % 60 AS se FROM d),
  w AS (SELECT *, list_filter([CASE WHEN mo > 0 THEN mo || ' month' || CASE WHEN mo = 1 THEN '' ELSE 's' END END, CASE WHEN d > 0 THEN d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END END, CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END END,
   CASE WHEN mi > 0 THEN mi || ' minute' || CASE WHEN mi = 1 THEN '' ELSE 's' END END, CASE WHEN se > 0 AND s < 180 THEN se || ' second' || CASE WHEN se = 1 THEN '' ELSE 's' END END], lambda x: x IS NOT NULL) AS l FROM p)
  SELECT device_id, item_no, CASE WHEN len(l) = 0 THEN CASE WHEN s < 180 THEN '0 seconds' ELSE '0 minutes' END ELSE array_to_string(l[1:2], ', ') END AS shown FROM w""")
def fn31(spark, sf):
    return items(spark, sf).select("device_id", "item_no", text.duration(F.col("duration")).alias("shown"))


@query("fn32", ITEMS + " SELECT device_id, item_no, CASE WHEN m < 1000 THEN printf('%.0f m', m) WHEN m <= 20000 THEN printf('%.1f km', m / 1000) ELSE printf('%.0f km', m / 1000) END AS shown FROM (SELECT *, round(distance, 1) + 0.01 AS m FROM items)")
def fn32(spark, sf):
    return items(spark, sf).select("device_id", "item_no", text.metres(r("distance", 1) + 0.01).alias("shown"))


@query("fn33", S + " SELECT sample_id, CASE WHEN speed * 3.6 < 10 THEN printf('%.1f km/h', speed * 3.6) ELSE printf('%.0f km/h', speed * 3.6) END AS shown FROM (SELECT sample_id, speed + 1e-6 AS speed FROM samples WHERE speed >= 0)")
def fn33(spark, sf):
    return samples(spark, sf).filter("speed >= 0").select("sample_id", text.speed(F.col("speed") + 1e-6).alias("shown"))


@query("fn34", "SELECT event_id, CASE WHEN starts_with(event_type, 'sign') THEN substr(event_type, 5) ELSE event_type END AS short, printf('%x', event_id) AS hex FROM events")
def fn34(spark, sf):
    from wayfold.sources.samples import table

    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.when(kind.startswith("sign"), F.substring(kind, 5, 100)).otherwise(kind).alias("short"), F.lower(F.hex("event_id")).alias("hex"))


@query("fn35", ITEMS + " SELECT device_id, item_no, CASE WHEN is_visit THEN CASE WHEN keeper THEN 'Visit' ELSE 'Brief Stop' END WHEN is_gap THEN 'Data Gap' ELSE 'Unknown' END AS title FROM items")
def fn35(spark, sf):
    return items(spark, sf).select("device_id", "item_no", text.title(F.col("is_visit"), F.col("is_gap"), F.col("keeper"), F.lit(None).cast("string")).alias("title"))


@query("fn36", ITEMS + " SELECT device_id, item_no, CASE keepness WHEN 2 THEN 'keeper' WHEN 1 THEN 'valid' ELSE 'invalid' END || ' ' || CASE WHEN is_visit THEN 'visit' WHEN is_gap THEN 'datagap' ELSE 'path' END || ' ' || n_samples AS description FROM items")
def fn36(spark, sf):
    label = F.when(F.col("keepness") == 2, "keeper").when(F.col("keepness") == 1, "valid").otherwise("invalid")
    kind = F.when(F.col("is_visit"), "visit").when(F.col("is_gap"), "datagap").otherwise("path")
    return items(spark, sf).select("device_id", "item_no", F.concat_ws(" ", label, kind, F.col("n_samples").cast("string")).alias("description"))


@query("fn43", S + " SELECT sample_id, t + seconds_from_gmt AS local_t FROM samples")
def fn43(spark, sf):
    return samples(spark, sf).select("sample_id", (F.col("t") + F.col("seconds_from_gmt")).alias("local_t"))

