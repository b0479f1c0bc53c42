"""Scans, sinks, predicates, orders and set operations over samples and items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import items as I
from wayfold.operators import store
from wayfold.plans.sqltext import I as ITEMS
from wayfold.plans.sqltext import USABLE, N, S, hav
from wayfold.registry import query
from wayfold.schemas import ACTIVE_STATES, BASE_TYPES, SLEEP_STATES, STEP_TYPES
from wayfold.sources.samples import samples, table

AS_OF = 1704067200 + 9 * 86400


def items(spark, sf):
    return I.summarize(I.number_items(samples(spark, sf).filter("not deleted")))


def usable():
    return geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))


# predicates on samples


@query("prd01", S + f" SELECT sample_id, {USABLE} AS usable FROM samples")
def prd01(spark, sf):
    return samples(spark, sf).select("sample_id", usable().alias("usable"))


@query("prd02", S + f", s AS (SELECT *, CASE WHEN sample_id % 37 = 0 THEN 'bogus' ELSE confirmed_type END AS ct FROM samples) SELECT sample_id, {USABLE} AND coalesce(ct, '') <> 'bogus' AS usable FROM s")
def prd02(spark, sf):
    kind = F.when(F.col("sample_id") % 37 == 0, "bogus").otherwise(F.col("confirmed_type"))
    return samples(spark, sf).select("sample_id", (usable() & (F.coalesce(kind, F.lit("")) != "bogus")).alias("usable"))


@query("prd03", S + f" SELECT device_id, leg, bool_or({USABLE}) AS any_usable, count(*) FILTER (NOT {USABLE})::BIGINT AS n_nolo FROM samples GROUP BY ALL")
def prd03(spark, sf):
    return samples(spark, sf).groupBy("device_id", "leg").agg(F.bool_or(usable()).alias("any_usable"), F.count_if(~usable()).alias("n_nolo"))


@query("prd04", ITEMS + f" SELECT device_id, item_no, start_t FROM items WHERE end_t > {AS_OF - 800000} AND start_t < {AS_OF - 770000}")
def prd04(spark, sf):
    return store.overlapping(items(spark, sf), AS_OF - 800000, AS_OF - 770000).select("device_id", "item_no", "start_t")


@query("prd05", ITEMS + f" SELECT device_id, item_no FROM items WHERE start_t >= {AS_OF - 800000} AND end_t <= {AS_OF - 770000}")
def prd05(spark, sf):
    return store.within(items(spark, sf), AS_OF - 800000, AS_OF - 770000).select("device_id", "item_no")


@query("prd06", S + ", m AS (SELECT max(t) AS now FROM samples) SELECT sample_id FROM samples, m WHERE t > now - 86400")
def prd06(spark, sf):
    s = samples(spark, sf)
    now = s.agg(F.max("t").alias("now"))  # one row
    return s.join(F.broadcast(now), F.col("t") > F.col("now") - 86400).select("sample_id")


@query("prd07", S + " SELECT sample_id FROM samples WHERE latitude BETWEEN 13.71 AND 13.75 AND longitude BETWEEN 100.52 AND 100.58 AND NOT (latitude = 0 AND longitude = 0)")
def prd07(spark, sf):
    return samples(spark, sf).filter(store.in_box(F.col("latitude"), F.col("longitude"), 13.71, 13.75, 100.52, 100.58)).select("sample_id")


@query("prd08", S + " SELECT sample_id, confirmed_type FROM samples WHERE confirmed_type IN ('car', 'cycling')")
def prd08(spark, sf):
    return samples(spark, sf).filter(F.col("confirmed_type").isin("car", "cycling")).select("sample_id", "confirmed_type")


@query("prd09", S + " SELECT sample_id FROM samples WHERE sample_id % 13 = 0 AND NOT deleted")
def prd09(spark, sf):
    s = samples(spark, sf).withColumn("item_id", F.when(F.col("sample_id") % 13 != 0, F.col("leg")))
    return s.filter(F.col("item_id").isNull() & ~F.col("deleted")).select("sample_id")


LINKS = ITEMS + """, linked AS (SELECT *, item_no % 7 = 0 AS gone, CASE WHEN item_no % 5 <> 0 THEN lag(item_no) OVER o END AS previous, CASE WHEN item_no % 6 <> 0 THEN lead(item_no) OVER o END AS next,
  item_no = max(item_no) OVER (PARTITION BY device_id) AS current FROM items WINDOW o AS (PARTITION BY device_id ORDER BY item_no))"""


def linked(spark, sf):
    """Items with links of which some are broken, and some items deleted: by number."""
    o = W.partitionBy("device_id").orderBy("item_no")
    return items(spark, sf).withColumns(
        {
            "gone": F.col("item_no") % 7 == 0,
            "previous": F.when(F.col("item_no") % 5 != 0, F.lag("item_no").over(o)),
            "next": F.when(F.col("item_no") % 6 != 0, F.lead("item_no").over(o)),
            "current": F.col("item_no") == F.max("item_no").over(W.partitionBy("device_id")),
        }
    )


@query("prd10", LINKS + " SELECT device_id, item_no FROM linked WHERE gone AND (previous IS NOT NULL OR next IS NOT NULL)")
def prd10(spark, sf):
    return linked(spark, sf).filter(F.col("gone") & (F.col("previous").isNotNull() | F.col("next").isNotNull())).select("device_id", "item_no")


@query("prd11", ITEMS + " SELECT device_id, item_no, is_gap FROM items")
def prd11(spark, sf):
    return items(spark, sf).select("device_id", "item_no", "is_gap")


@query("prd12", ITEMS + " SELECT device_id, item_no, NOT is_gap AND n_usable = 0 AS is_nolo FROM items")
def prd12(spark, sf):
    return items(spark, sf).select("device_id", "item_no", (~F.col("is_gap") & (F.col("n_usable") == 0)).alias("is_nolo"))


@query("prd13", ITEMS + " SELECT device_id, item_no, valid, keeper FROM items WHERE is_visit")
def prd13(spark, sf):
    return items(spark, sf).filter("is_visit").select("device_id", "item_no", "valid", "keeper")


@query("prd14", ITEMS + " SELECT device_id, item_no, is_gap, valid, keeper FROM items WHERE NOT is_visit")
def prd14(spark, sf):
    return items(spark, sf).filter("not is_visit").select("device_id", "item_no", "is_gap", "valid", "keeper")


@query("prd16", ITEMS + " SELECT device_id, item_no, keepness, CASE keepness WHEN 2 THEN 'keeper' WHEN 1 THEN 'valid' ELSE 'invalid' END AS keepness_label FROM items")
def prd16(spark, sf):
    label = F.when(F.col("keepness") == 2, "keeper").when(F.col("keepness") == 1, "valid").otherwise("invalid")
    return items(spark, sf).select("device_id", "item_no", "keepness", label.alias("keepness_label"))


@query("prd17", LINKS + " SELECT device_id, item_no, NOT gone AND previous IS NULL AS broken_previous, NOT gone AND next IS NULL AND NOT current AS broken_next FROM linked")
def prd17(spark, sf):
    return store.broken_edges(linked(spark, sf)).select("device_id", "item_no", "broken_previous", "broken_next")


@query("prd18", LINKS + " SELECT device_id, item_no, current AND keepness < 2 AS locked FROM linked")
def prd18(spark, sf):
    return linked(spark, sf).select("device_id", "item_no", (F.col("current") & (F.col("keepness") < 2)).alias("locked"))


@query(
    "prd19",
    ITEMS + f" SELECT n.sample_id, {hav('n.latitude', 'n.longitude', 'i.latitude', 'i.longitude')} <= greatest(10, least(150, radius_mean + 4 * radius_sd)) AS inside"
    f" FROM numbered n JOIN items i USING (device_id, item_no) WHERE is_visit AND {USABLE.replace('h_acc', 'n.h_acc').replace('latitude', 'n.latitude').replace('longitude', 'n.longitude')}",
)
def prd19(spark, sf):
    s = I.number_items(samples(spark, sf).filter("not deleted")).filter(usable())
    i = I.summarize(I.number_items(samples(spark, sf).filter("not deleted"))).filter("is_visit").select("device_id", "item_no", F.col("latitude").alias("la"), F.col("longitude").alias("lo"), "radius_mean", "radius_sd")
    d = geo.distance(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    return s.join(i, ["device_id", "item_no"]).select("sample_id", (d <= geo.clamp(F.col("radius_mean") + 4 * F.col("radius_sd"), 10.0, 150.0)).alias("inside"))


@query("prd21", ITEMS + f" SELECT device_id, item_no, start_t + (end_t - start_t) / 2 AS middle_t, start_t <= {AS_OF - 790000} AND end_t >= {AS_OF - 790000} AS has_now FROM items")
def prd21(spark, sf):
    return items(spark, sf).select(
        "device_id", "item_no", (F.col("start_t") + (F.col("end_t") - F.col("start_t")) / 2).alias("middle_t"), F.lit(AS_OF - 790000).between(F.col("start_t"), F.col("end_t")).alias("has_now")
    )


@query("prd22", S + " SELECT sample_id, recording_state IN ('wakeup', 'sleeping', 'deepSleeping') AS asleep, recording_state IN ('recording', 'wakeup', 'sleeping', 'deepSleeping') AS active FROM samples")
def prd22(spark, sf):
    state = F.col("recording_state")
    return samples(spark, sf).select("sample_id", state.isin(*SLEEP_STATES).alias("asleep"), state.isin(*ACTIVE_STATES).alias("active"))


@query("prd23", S + " SELECT sample_id, classified_type IN ('stationary', 'walking', 'running', 'cycling', 'car', 'airplane') AS is_base, classified_type IN ('walking', 'running', 'cycling', 'golf', 'rowing', 'kayaking') AS has_steps FROM samples WHERE classified_type IS NOT NULL")
def prd23(spark, sf):
    kind = F.col("classified_type")
    return samples(spark, sf).filter(kind.isNotNull()).select("sample_id", kind.isin(*BASE_TYPES).alias("is_base"), kind.isin(*STEP_TYPES).alias("has_steps"))


@query("prd25", S + f" SELECT sample_id FROM samples WHERE confirmed_type IS NULL AND (classified_type IS NULL OR last_saved <= {AS_OF} - 180 * 86400)")
def prd25(spark, sf):
    old = F.col("last_saved") <= AS_OF - 180 * 86400
    return samples(spark, sf).filter(F.col("confirmed_type").isNull() & (F.col("classified_type").isNull() | old)).select("sample_id")


@query("prd26", S + " SELECT sample_id, t FROM samples WHERE device_id = 3 AND recording_state = 'off' ORDER BY t")
def prd26(spark, sf):
    samples(spark, sf).createOrReplaceTempView("LocomotionSample")
    return store.select(spark, "SELECT sample_id, t FROM LocomotionSample WHERE device_id = :device AND recording_state = :state ORDER BY t", device=3, state="off")


@query("prd27", ITEMS + " SELECT device_id, item_no, start_t, end_t FROM items")
def prd27(spark, sf):
    return items(spark, sf).select("device_id", "item_no", "start_t", "end_t")


@query("prd28", S + " SELECT device_id, max(last_saved) <> 1704070000 OR count(*) <> 60 AS has_changed FROM samples GROUP BY device_id")
def prd28(spark, sf):
    return samples(spark, sf).groupBy("device_id").agg(((F.max("last_saved") != 1704070000) | (F.count(F.lit(1)) != 60)).alias("has_changed"))


# scans


THROTTLED = (S + """, f AS (SELECT device_id, sample_id, t, h_acc, row_number() OVER (PARTITION BY device_id ORDER BY t, sample_id) AS n FROM samples WHERE latitude IS NOT NULL),
k AS (SELECT device_id, sample_id, n, t AS kept, h_acc AS acc, true AS keep FROM f WHERE n = 1 UNION ALL
  SELECT f.device_id, f.sample_id, f.n, CASE WHEN f.t - kept < 41 AND acc <= f.h_acc THEN kept ELSE f.t END, CASE WHEN f.t - kept < 41 AND acc <= f.h_acc THEN acc ELSE f.h_acc END, NOT (f.t - kept < 41 AND acc <= f.h_acc)
  FROM k JOIN f ON f.device_id = k.device_id AND f.n = k.n + 1)""").replace("WITH samples", "WITH RECURSIVE samples", 1)


@query("src02", THROTTLED + " SELECT sample_id FROM k WHERE keep")
def src02(spark, sf):
    from wayfold.operators.folds import throttled

    return throttled(samples(spark, sf).filter("latitude is not null"), seconds=41.0).select("sample_id")


@query("src03", S + """, flags AS (SELECT sample_id, t, unnest([{'n': 'stationary', 'f': sample_id % 2 = 0}, {'n': 'walking', 'f': sample_id % 3 = 0}, {'n': 'automotive', 'f': sample_id % 5 = 0}]) AS x FROM samples)
  SELECT sample_id, t, x.n AS name FROM flags WHERE x.f""")
def src03(spark, sf):
    s = samples(spark, sf).withColumns({"stationary": F.col("sample_id") % 2 == 0, "walking": F.col("sample_id") % 3 == 0, "automotive": F.col("sample_id") % 5 == 0})
    return store.flag_events(s, ["stationary", "walking", "automotive"]).select("sample_id", "t", "name")


@query("src07", ITEMS + " SELECT device_id, item_no, start_t FROM items WHERE is_visit AND duration > 200")
def src07(spark, sf):
    items(spark, sf).createOrReplaceTempView("TimelineItem")
    return store.select(spark, "SELECT device_id, item_no, start_t FROM TimelineItem WHERE is_visit AND duration > :d", d=200)


@query("src08", S + " SELECT * EXCLUDE (leg, idx) FROM samples WHERE speed > 5.0 AND moving_state = 'moving'")
def src08(spark, sf):
    samples(spark, sf).createOrReplaceTempView("LocomotionSample")
    return store.select(spark, "SELECT * FROM LocomotionSample WHERE speed > :v AND moving_state = :m", v=5.0, m="moving").drop("leg", "idx")


@query("src10", S + " SELECT sample_id, device_id, t FROM samples WHERE sample_id = 42")
def src10(spark, sf):
    return samples(spark, sf).filter(F.col("sample_id") == 42).select("sample_id", "device_id", "t")


@query("src11", ITEMS + " SELECT device_id, item_no FROM items WHERE NOT is_visit AND distance > 500")
def src11(spark, sf):
    return items(spark, sf).filter(~F.col("is_visit") & (F.col("distance") > 500)).select("device_id", "item_no")


@query("src12", "SELECT event_id AS sample_id, epoch_us(ts)::BIGINT AS date_us, event_type = 'view' AS flag FROM events")
def src12(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("sample_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date_us"), (F.col("event_type") == "view").alias("flag"))


@query("src14", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k FROM events")
def src14(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).alias("k"))


@query("src16", S + f""", ped AS (SELECT device_id, t AS s, t + 20 AS e, sample_id % 40 AS steps, sample_id % 3 AS floors FROM samples WHERE sample_id % 4 = 0)
  SELECT device_id, sum(steps)::BIGINT AS steps, sum(floors)::BIGINT AS floors FROM ped WHERE s >= {AS_OF - 800000} AND e <= {AS_OF - 700000} GROUP BY device_id""")
def src16(spark, sf):
    p = samples(spark, sf).filter("sample_id % 4 = 0").select("device_id", F.col("t").alias("s"), (F.col("t") + 20).alias("e"), (F.col("sample_id") % 40).alias("steps"), (F.col("sample_id") % 3).alias("floors"))
    return p.filter((F.col("s") >= AS_OF - 800000) & (F.col("e") <= AS_OF - 700000)).groupBy("device_id").agg(F.sum("steps").alias("steps"), F.sum("floors").alias("floors"))


@query("src18", S + " SELECT device_id, max(t) + 1 AS t, 'off' AS recording_state, NULL::DOUBLE AS latitude FROM samples GROUP BY device_id")
def src18(spark, sf):
    return samples(spark, sf).groupBy("device_id").agg((F.max("t") + 1).alias("t")).select("device_id", "t", F.lit("off").alias("recording_state"), F.lit(None).cast("double").alias("latitude"))


@query("src19", S + " SELECT sample_id, coalesce(step_hz, 0) AS step_hz FROM samples")
def src19(spark, sf):
    return samples(spark, sf).select("sample_id", F.coalesce("step_hz", F.lit(0.0)).alias("step_hz"))


# sinks


UPSERT = S + ", u AS (SELECT sample_id % 500 AS id, last_saved, sample_id, altitude FROM samples), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_saved DESC, sample_id DESC) AS n FROM u)"


@query("snk01", UPSERT + " SELECT id, last_saved, altitude FROM r WHERE n = 1")
def snk01(spark, sf):
    rows = samples(spark, sf).select((F.col("sample_id") % 500).alias("id"), "last_saved", "sample_id", "altitude")
    return store.latest(rows, ["id"], ["last_saved", "sample_id"]).select("id", "last_saved", "altitude")


@query("snk03", S + " SELECT sample_id FROM samples WHERE last_saved < t + 200")
def snk03(spark, sf):
    return samples(spark, sf).filter(F.col("last_saved") < F.col("t") + 200).select("sample_id")


@query("snk04", None)
def snk04(spark, sf):
    s = I.number_items(samples(spark, sf).filter("not deleted"))
    return store.nested_json(items(spark, sf), s, ["device_id", "item_no"])


@query("snk05", ITEMS + """ SELECT device_id, item_no, CASE WHEN CAST(make_timestamp((start_t + 1) * 1000000) AS DATE) = CAST(make_timestamp((end_t - 1) * 1000000) AS DATE)
  THEN strftime(make_timestamp(((start_t + end_t) // 2) * 1000000), '%Y-%m-%d') WHEN strftime(make_timestamp((start_t + 1) * 1000000), '%Y-%m') = strftime(make_timestamp((end_t - 1) * 1000000), '%Y-%m') THEN strftime(make_timestamp(((start_t + end_t) // 2) * 1000000), '%Y-%m') ELSE strftime(make_timestamp(((start_t + end_t) // 2) * 1000000), '%Y') END AS filename FROM items""")
def snk05(spark, sf):
    return items(spark, sf).select("device_id", "item_no", store.export_name(F.col("start_t"), F.col("end_t")).alias("filename"))


@query("snk06", ITEMS + " SELECT device_id * 100000 + item_no AS item_id, is_visit, start_t, end_t, round(coalesce(latitude, 0), 6) AS latitude, round(coalesce(longitude, 0), 6) AS longitude, round(radius_mean, 3) AS radius_mean, round(radius_sd, 3) AS radius_sd FROM items")
def snk06(spark, sf):
    r = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n).alias(c)
    return items(spark, sf).select((F.col("device_id") * 100000 + F.col("item_no")).alias("item_id"), "is_visit", "start_t", "end_t", r("latitude", 6), r("longitude", 6), r("radius_mean", 3), r("radius_sd", 3))


@query("snk07", S + " SELECT sample_id, deleted OR sample_id % 4 = 0 AS deleted FROM samples")
def snk07(spark, sf):
    return samples(spark, sf).select("sample_id", (F.col("deleted") | (F.col("sample_id") % 4 == 0)).alias("deleted"))


@query("snk08", S + f" SELECT sample_id FROM samples WHERE NOT (deleted AND t < {AS_OF} - 3600)")
def snk08(spark, sf):
    return store.without_old_deleted(samples(spark, sf), "t", AS_OF - 3600).select("sample_id")


#: Items of all samples, deleted ones too; some are left without a live sample. Every 11th is locked.
HELD = N.replace(" WHERE NOT deleted", "", 1) + """, it AS (SELECT device_id, item_no, max(t) FILTER (NOT g) AS end_t, count(*) FILTER (NOT deleted) AS n_live FROM numbered GROUP BY ALL),
  asked AS (SELECT *, n_live = 0 AND item_no % 11 <> 0 AS deleted, lag(item_no) OVER o AS p, lead(item_no) OVER o AS x FROM it WINDOW o AS (PARTITION BY device_id ORDER BY item_no))"""


def asked_items(spark, sf):
    s = I.number_items(samples(spark, sf))
    end = F.max(F.when(~(I.moving() & (F.col("recording_state") == "off")), F.col("t"))).alias("end_t")
    o = W.partitionBy("device_id").orderBy("item_no")
    i = s.groupBy("device_id", "item_no").agg(end).withColumns({"previous": F.lag("item_no").over(o), "next": F.lead("item_no").over(o), "locked": F.col("item_no") % 11 == 0})
    return store.delete_items(i, s)


@query("snk07_items", HELD + " SELECT device_id, item_no, deleted, CASE WHEN NOT deleted THEN p END AS previous, CASE WHEN NOT deleted THEN x END AS next FROM asked")
def snk07_items(spark, sf):
    """All items asked to go: those that are locked or hold live samples refuse."""
    return asked_items(spark, sf).select("device_id", "item_no", "deleted", "previous", "next")


@query("snk08_items", HELD + ", d AS (SELECT quantile_disc(end_t, 0.5) AS before FROM it) SELECT device_id, item_no, deleted FROM asked, d WHERE NOT (deleted AND coalesce(end_t < before, true))")
def snk08_items(spark, sf):
    """Items after a purge of those deleted that ended before the middle of all ends, or have none."""
    i = asked_items(spark, sf)
    before = i.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY end_t)")).first()[0]
    return store.without_old_deleted_items(i, before).select("device_id", "item_no", "deleted")


# orders


@query("ord01", S + " SELECT device_id, sample_id, row_number() OVER (PARTITION BY device_id ORDER BY t DESC, sample_id) AS place FROM samples")
def ord01(spark, sf):
    return samples(spark, sf).select("device_id", "sample_id", F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("t"), "sample_id")).alias("place"))


@query("ord02", ITEMS + " SELECT device_id, item_no, end_t FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY end_t DESC, item_no DESC) AS n FROM items) WHERE n = 1")
def ord02(spark, sf):
    return store.latest(items(spark, sf), ["device_id"], ["end_t", "item_no"]).select("device_id", "item_no", "end_t")


@query("ord03", S + " SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY device_id ORDER BY last_saved DESC, sample_id DESC) AS n FROM samples WHERE confirmed_type = 'stationary') x WHERE n <= 2000")
def ord03(spark, sf):
    """The 2,000 confirmed stationary samples of each device that were saved last."""
    newest = F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("last_saved"), F.desc("sample_id")))
    return samples(spark, sf).filter("confirmed_type = 'stationary'").withColumn("n", newest).filter("n <= 2000").select("sample_id")


@query("ord06", S + " SELECT classified_type AS name, count(*) AS total_samples FROM samples WHERE classified_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def ord06(spark, sf):
    return samples(spark, sf).filter("classified_type is not null").groupBy(F.col("classified_type").alias("name")).agg(F.count(F.lit(1)).alias("total_samples")).orderBy(F.desc("total_samples"), "name")


@query("ord09", ITEMS + " SELECT device_id, item_no, rank() OVER (PARTITION BY device_id ORDER BY end_t) AS place FROM items")
def ord09(spark, sf):
    return items(spark, sf).select("device_id", "item_no", F.rank().over(W.partitionBy("device_id").orderBy("end_t")).alias("place"))


# sets


@query("set01", S + " SELECT sample_id, min(t) AS t FROM (SELECT sample_id, t FROM samples WHERE idx < 14 UNION ALL SELECT sample_id, t FROM samples WHERE idx > 8) GROUP BY 1")
def set01(spark, sf):
    s = samples(spark, sf).select("sample_id", "t", "idx")
    return s.filter("idx < 14").unionByName(s.filter("idx > 8")).dropDuplicates(["sample_id"]).select("sample_id", "t")


@query("set02", S + " SELECT sample_id FROM samples WHERE idx < 14 EXCEPT SELECT sample_id FROM samples WHERE idx > 8")
def set02(spark, sf):
    s = samples(spark, sf)
    return s.filter("idx < 14").join(s.filter("idx > 8").select("sample_id"), "sample_id", "left_anti").select("sample_id")


@query("set03", S + " SELECT device_id, bool_or(idx < 14 AND idx > 8) AS meets FROM samples GROUP BY device_id")
def set03(spark, sf):
    ids = lambda c: F.collect_set(F.when(c, F.col("sample_id")))
    g = samples(spark, sf).groupBy("device_id", "leg").agg(ids(F.col("idx") < 14).alias("a"), ids(F.col("idx") > 8).alias("b"))
    return g.groupBy("device_id").agg(F.bool_or(F.size(F.array_intersect("a", "b")) > 0).alias("meets"))


@query("set05", S + ", h AS (SELECT device_id, list(DISTINCT confirmed_type) AS have FROM samples WHERE confirmed_type IS NOT NULL GROUP BY 1) SELECT device_id, array_to_string(list_filter(['stationary', 'walking', 'running', 'cycling', 'car', 'airplane'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM h")
def set05(spark, sf):
    g = samples(spark, sf).filter("confirmed_type is not null").groupBy("device_id").agg(F.collect_set("confirmed_type").alias("have"))
    return g.select("device_id", F.array_join(F.array_except(F.array(*map(F.lit, BASE_TYPES)), "have"), ",").alias("missing"))


@query("set06", S + " SELECT DISTINCT device_id, latitude, longitude FROM samples WHERE latitude IS NOT NULL")
def set06(spark, sf):
    return samples(spark, sf).filter("latitude is not null").select("device_id", "latitude", "longitude").distinct()
