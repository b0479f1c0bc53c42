"""Histograms, matrices, trained models and classification."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.operators import classifier as C
from wayfold.operators import models as M
from wayfold.plans.basics import usable
from wayfold.plans.geography import cell_sql
from wayfold.plans.sqltext import USABLE, S
from wayfold.registry import query
from wayfold.sources.samples import samples


def r(c, n):
    return F.round(c, n)


def hist_sql(name: str, value: str, where: str, trim: bool, low: float | None, pseudo: int = 1, key: str = "confirmed_type", source: str = "samples", high: float | None = None) -> str:
    """CTEs that end in ``name``_h: (k, bins, lo, hi)."""
    v = f"{name}_v AS (SELECT {key} AS k, {value}::DOUBLE AS v FROM {source} WHERE confirmed_type IS NOT NULL AND {USABLE} AND {where})"
    t = f"{name}_t AS (SELECT x.* FROM {name}_v x JOIN (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM {name}_v GROUP BY k) y USING (k) WHERE {'v BETWEEN m - 4 * s AND m + 4 * s' if trim else 'true'} {'AND v >= %r' % low if low is not None else ''} {'AND v <= %r' % high if high is not None else ''})"
    q = f"{name}_q AS (SELECT k, count(*) AS n, min(v) AS lo, max(v) AS hi, list_sort(list(v))[floor(count(*) / 4)::INT + 1] AS q1, list_sort(list(v))[floor(count(*) * 3 / 4)::INT + 1] AS q3 FROM {name}_t GROUP BY k)"
    b = f"{name}_b AS (SELECT *, CASE WHEN hi <= lo THEN 1 WHEN 2 * (q3 - q1) * pow(n, -1.0 / 3) <= (hi - lo) / n THEN 10 ELSE ceil((hi - lo) / (2 * (q3 - q1) * pow(n, -1e0 / 3e0))) END::INT AS nb FROM {name}_q)"
    c = f"{name}_c AS (SELECT k, CASE WHEN nb = 1 THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / nb)), nb - 1) END::INT AS i, count(*) AS c FROM {name}_t JOIN {name}_b USING (k) GROUP BY ALL)"
    h = f"{name}_h AS (SELECT k, lo, hi, list(({pseudo} + coalesce(c, 0))::INT ORDER BY g.i) AS bins FROM (SELECT k, lo, hi, unnest(generate_series(0, nb - 1)) AS i FROM {name}_b) g LEFT JOIN {name}_c USING (k, i) GROUP BY ALL)"
    return ", ".join((v, t, q, b, c, h)).replace("pow(n, -1.0 / 3)", "pow(n, -1e0 / 3e0)")


SPEED = hist_sql("speed", "speed", "speed >= 0 AND speed < 277.77", True, 0.0)
ALTITUDE = hist_sql("altitude", "altitude", "v_acc >= 0 AND altitude <> -1000", True, None)


def speed_histograms(spark, sf):
    s = samples(spark, sf).filter(F.col("confirmed_type").isNotNull() & usable()).filter("speed >= 0 and speed < 277.77")
    return M.histograms(s.select("confirmed_type", F.col("speed").alias("value")), "confirmed_type", trim=True, low=0.0)


@query("ag26", S + ", " + SPEED + " SELECT k AS confirmed_type, round(lo, 6) AS low, round(hi, 6) AS high, array_to_string(bins, ',') AS bins FROM speed_h")
def ag26(spark, sf):
    return speed_histograms(spark, sf).select("confirmed_type", r("min", 6).alias("low"), r("max", 6).alias("high"), F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"))


@query("ag27", S + ", " + ALTITUDE + " SELECT k AS confirmed_type, len(bins)::INT AS n_bins FROM altitude_h")
def ag27(spark, sf):
    s = samples(spark, sf).filter(F.col("confirmed_type").isNotNull() & usable()).filter("v_acc >= 0 and altitude <> -1000")
    h = M.histograms(s.select("confirmed_type", F.col("altitude").alias("value")), "confirmed_type", trim=True)
    return h.select("confirmed_type", F.size("bins").alias("n_bins"))


CELLS = f"{cell_sql('latitude', '-90e0', '0.1e0')} AS la, {cell_sql('longitude', '-180e0', '0.1e0')} AS lo"


@query("ag28", S + f", c AS (SELECT confirmed_type, latitude, longitude, {CELLS} FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE}), b AS (SELECT confirmed_type, la, lo, trunc((latitude - la) / 0.0005e0)::BIGINT AS lat_bin, trunc((longitude - lo) / 0.0005e0)::BIGINT AS lng_bin FROM c) SELECT confirmed_type, round(la, 4) AS cell_lat, round(lo, 4) AS cell_lng, lat_bin, lng_bin, least(count(*), 65535) AS n FROM b WHERE lat_bin BETWEEN 0 AND 199 AND lng_bin BETWEEN 0 AND 199 GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY confirmed_type, la, lo, lat_bin, lng_bin"))
def ag28(spark, sf):
    m = M.matrix(samples(spark, sf).filter(F.col("confirmed_type").isNotNull() & usable()), 2, "confirmed_type")
    return m.select("confirmed_type", r("cell_lat", 4).alias("cell_lat"), r("cell_lng", 4).alias("cell_lng"), "lat_bin", "lng_bin", "n")


@query("ag29", S + ", p AS (SELECT confirmed_type, lag(confirmed_type) OVER (PARTITION BY device_id ORDER BY t, sample_id) AS prev FROM samples), c AS (SELECT confirmed_type AS name, prev, count(*) AS n FROM p WHERE confirmed_type IS NOT NULL AND prev IS NOT NULL GROUP BY ALL) SELECT name, prev, round((n + 1) / (sum(n) OVER (PARTITION BY name) + 32), 9) AS share FROM c")
def ag29(spark, sf):
    from wayfold.operators.items import per_device

    p = samples(spark, sf).withColumn("prev", F.lag("confirmed_type").over(per_device())).filter("confirmed_type is not null and prev is not null")
    c = p.groupBy(F.col("confirmed_type").alias("name"), "prev").count()
    return c.select("name", "prev", r((F.col("count") + 1) / (F.sum("count").over(W.partitionBy("name")) + 32), 9).alias("share"))


@query("ag30", S + f", ok AS (SELECT * FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE}) SELECT confirmed_type, count(*) AS total_samples, round(coalesce(count(*) FILTER (moving_state = 'moving') / nullif(count(*) FILTER (moving_state <> 'uncertain'), 0)::DOUBLE, 0.5), 9) AS moving_pct, round(count(*) FILTER (classified_type = confirmed_type) / count(classified_type)::DOUBLE, 9) AS accuracy FROM ok GROUP BY 1")
def ag30(spark, sf):
    return M.train(samples(spark, sf)).select("confirmed_type", "total_samples", r("moving_pct", 9).alias("moving_pct"), r("accuracy", 9).alias("accuracy"))


@query("ag31", S + ", m AS (SELECT classified_type AS name, count(*) AS n, avg(CASE WHEN classified_type = confirmed_type THEN 1.0 ELSE 0.0 END) AS a, max(last_saved) AS u FROM samples WHERE classified_type IS NOT NULL GROUP BY 1) SELECT round(avg(least(1.0, n / 1800e0)), 9) AS completeness, round(sum(a * n) / sum(n), 9) AS accuracy, max(u) AS last_updated FROM m")
def ag31(spark, sf):
    right = F.avg(F.when(F.col("classified_type") == F.col("confirmed_type"), 1.0).otherwise(0.0))
    m = samples(spark, sf).filter("classified_type is not null").groupBy(F.col("classified_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), right.alias("a"), F.max("last_saved").alias("u"))
    return m.agg(r(F.avg(M.completeness(F.col("n"), 2)), 9).alias("completeness"), r(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 9).alias("accuracy"), F.max("u").alias("last_updated"))


@query("ag37", S + ", " + SPEED + " SELECT k AS confirmed_type, list_max(bins)::INT AS top, round(list_max(bins) / list_sum(bins)::DOUBLE, 9) AS top_share FROM speed_h")
def ag37(spark, sf):
    total = F.aggregate("bins", F.lit(0), lambda a, x: a + x)
    return speed_histograms(spark, sf).select("confirmed_type", F.array_max("bins").alias("top"), r(F.array_max("bins") / total, 9).alias("top_share"))


PROB = "CASE WHEN len(bins) = 1 THEN CASE WHEN v = lo THEN 1.0 ELSE 0.0 END WHEN v = hi THEN bins[len(bins)] / list_max(bins)::DOUBLE WHEN floor((v - lo) / ((hi - lo) / len(bins))) BETWEEN 0 AND len(bins) - 1 THEN bins[floor((v - lo) / ((hi - lo) / len(bins)))::INT + 1] / list_max(bins)::DOUBLE ELSE 0.0 END"


@query("fn15", S + ", " + SPEED + f" SELECT sample_id, round({PROB}, 9) AS p FROM (SELECT sample_id, confirmed_type AS k, speed AS v FROM samples) s JOIN speed_h USING (k)")
def fn15(spark, sf):
    h = speed_histograms(spark, sf).select("confirmed_type", F.struct("bins", "min", "max", "pseudo").alias("h"))
    return samples(spark, sf).join(h, "confirmed_type").select("sample_id", r(M.probability(F.col("h"), F.col("speed")), 9).alias("p"))


@query("fn16", S + ", " + SPEED + " SELECT k AS confirmed_type, round(lo + (hi - lo) / len(bins) * 1, 6) AS bottom, round(lo + (hi - lo) / len(bins) * 1.5, 6) AS middle, round(lo + (hi - lo) / len(bins) * 2, 6) AS top FROM speed_h")
def fn16(spark, sf):
    width = (F.col("max") - F.col("min")) / F.size("bins")
    return speed_histograms(spark, sf).select("confirmed_type", *[r(F.col("min") + width * k, 6).alias(n) for k, n in ((1, "bottom"), (1.5, "middle"), (2, "top"))])


@query("fn17", S + ", " + SPEED + " SELECT k AS confirmed_type, array_to_string(list_filter(list_transform(bins, lambda x, i: CASE WHEN x = list_max(bins) THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS peaks FROM speed_h")
def fn17(spark, sf):
    peaks = F.array_compact(F.transform("bins", lambda x, i: F.when(x == F.array_max("bins"), i.cast("string"))))
    return speed_histograms(spark, sf).select("confirmed_type", F.array_join(peaks, ",").alias("peaks"))


@query("fn18", S + f", c AS (SELECT sample_id, confirmed_type, {CELLS}, latitude, longitude FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE}), b AS (SELECT *, trunc((latitude - la) / 0.0005e0)::BIGINT AS x, trunc((longitude - lo) / 0.0005e0)::BIGINT AS y FROM c), n AS (SELECT confirmed_type, la, lo, x, y, count(*) AS n FROM b WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 199 GROUP BY ALL), m AS (SELECT confirmed_type, la, lo, max(n) AS m FROM n GROUP BY ALL) SELECT sample_id, round(coalesce(n.n, 0) / m::DOUBLE, 9) AS p FROM b JOIN m USING (confirmed_type, la, lo) LEFT JOIN n USING (confirmed_type, la, lo, x, y)")
def fn18(spark, sf):
    from wayfold.functions import geo

    s = samples(spark, sf).filter(F.col("confirmed_type").isNotNull() & usable())
    n = M.matrix(s, 2, "confirmed_type")
    cell = ["confirmed_type", "cell_lat", "cell_lng"]
    top = n.groupBy(*cell).agg(F.max("n").alias("m"))
    b = s.withColumns({"cell_lat": geo.cell_min(F.col("latitude"), 2, -90.0), "cell_lng": geo.cell_min(F.col("longitude"), 2, -180.0)})
    b = b.withColumns({"lat_bin": geo.truncated((F.col("latitude") - F.col("cell_lat")) / 0.0005), "lng_bin": geo.truncated((F.col("longitude") - F.col("cell_lng")) / 0.0005)})
    j = b.join(top, cell).join(n, [*cell, "lat_bin", "lng_bin"], "left")
    return j.select("sample_id", r(F.coalesce("n", F.lit(0)) / F.col("m"), 9).alias("p"))


@query("fn19", S + ", " + SPEED + " SELECT k AS confirmed_type, true AS round_trip, len(list_filter(bins, lambda x: x > 1))::INT AS stored FROM speed_h")
def fn19(spark, sf):
    h = speed_histograms(spark, sf).select("confirmed_type", F.struct("bins", "min", "max", "pseudo").alias("h")).withColumn("text", M.serialise(F.col("h")))
    back = M.deserialise(F.col("text"))
    stored = F.size(F.split("text", ";")) - 2
    return h.select("confirmed_type", ((back["bins"] == F.col("h.bins")) & (back["min"] == F.col("h.min"))).alias("round_trip"), stored.alias("stored"))


@query("fn21", S + ", c AS (SELECT device_id, confirmed_type AS k, count(*) AS n FROM samples WHERE confirmed_type IS NOT NULL GROUP BY ALL) SELECT device_id, string_agg(k || ',' || n, ';' ORDER BY k) AS text, max(n) AS top FROM c GROUP BY 1")
def fn21(spark, sf):
    c = samples(spark, sf).filter("confirmed_type is not null").groupBy("device_id", F.col("confirmed_type").alias("k")).count()
    g = c.groupBy("device_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "k", F.col("count").cast("string")))), ";").alias("text"))
    back = F.str_to_map("text", F.lit(";"), F.lit(","))
    return g.select("device_id", "text", F.array_max(F.transform(F.map_values(back), lambda x: x.cast("bigint"))).alias("top"))


@query("ml02", S + f", m AS (SELECT confirmed_type AS k, coalesce(count(*) FILTER (moving_state = 'moving') / nullif(count(*) FILTER (moving_state <> 'uncertain'), 0)::DOUBLE, 0.5) AS p FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE} GROUP BY 1) SELECT sample_id, round(CASE moving_state WHEN 'moving' THEN p / greatest(p, 1 - p) WHEN 'stationary' THEN (1 - p) / greatest(p, 1 - p) END, 9) AS factor FROM samples JOIN m ON confirmed_type = k")
def ml02(spark, sf):
    s = samples(spark, sf)
    ok = s.filter(F.col("confirmed_type").isNotNull() & usable())
    m = ok.groupBy("confirmed_type").agg(F.coalesce(F.try_divide(F.count_if(F.col("moving_state") == "moving"), F.count_if(F.col("moving_state") != "uncertain")), F.lit(0.5)).alias("p"))
    larger = F.greatest(F.col("p"), 1 - F.col("p"))
    factor = F.when(F.col("moving_state") == "moving", F.col("p") / larger).when(F.col("moving_state") == "stationary", (1 - F.col("p")) / larger)
    return s.join(m, "confirmed_type").select("sample_id", r(factor, 9).alias("factor"))


HISTS = ", ".join(
    (
        SPEED,
        ALTITUDE,
        hist_sql("step", "step_hz", "step_hz IS NOT NULL AND (confirmed_type <> 'walking' OR step_hz > 0)", True, 0.0),
        hist_sql("xy", "xy_acc", "xy_acc IS NOT NULL", True, 0.0),
        hist_sql("z", "z_acc", "z_acc IS NOT NULL", True, 0.0),
        hist_sql("cv", "course_variance", "course_variance IS NOT NULL", False, 0.0),
    )
)


def factor_sql(h: str, v: str, when: str, weight: str = "1e0") -> str:
    body = (
        f"CASE WHEN len({h}.bins) = 1 THEN CASE WHEN {v} = {h}.lo THEN 1.0 ELSE 0.0 END WHEN {v} = {h}.hi THEN {h}.bins[len({h}.bins)] / list_max({h}.bins)::DOUBLE "
        f"WHEN floor(({v} - {h}.lo) / (({h}.hi - {h}.lo) / len({h}.bins))) BETWEEN 0 AND len({h}.bins) - 1 THEN {h}.bins[floor(({v} - {h}.lo) / (({h}.hi - {h}.lo) / len({h}.bins)))::INT + 1] / list_max({h}.bins)::DOUBLE ELSE 0.0 END"
    )
    return f"CASE WHEN {when} THEN coalesce({body}, 0) * {weight} ELSE 1 END"


SCORES = (
    S
    + ", "
    + HISTS
    + f""", m AS (SELECT confirmed_type AS k, count(*) AS n, coalesce(count(*) FILTER (moving_state = 'moving') / nullif(count(*) FILTER (moving_state <> 'uncertain'), 0)::DOUBLE, 0.5) AS p FROM samples WHERE confirmed_type IS NOT NULL AND {USABLE} GROUP BY 1),
  sc AS (SELECT s.sample_id, m.k AS name, greatest(0, least(1, CASE moving_state WHEN 'moving' THEN p / greatest(p, 1 - p) WHEN 'stationary' THEN (1 - p) / greatest(p, 1 - p) ELSE 1 END
    * {factor_sql('speed_h', 's.speed', 's.speed >= 0')} * {factor_sql('step_h', 's.step_hz', 's.step_hz IS NOT NULL')} * {factor_sql('cv_h', 's.course_variance', 's.course_variance IS NOT NULL')}
    * {factor_sql('xy_h', 's.xy_acc', "m.k <> 'stationary' AND s.xy_acc IS NOT NULL")} * {factor_sql('z_h', 's.z_acc', "m.k <> 'stationary' AND s.z_acc IS NOT NULL")} * {factor_sql('altitude_h', 's.altitude', 's.altitude <> -1000')}))
    * m.n / (1 + (SELECT sum(n) FROM m)) AS score
  FROM samples s CROSS JOIN m LEFT JOIN speed_h ON speed_h.k = m.k LEFT JOIN step_h ON step_h.k = m.k LEFT JOIN cv_h ON cv_h.k = m.k LEFT JOIN xy_h ON xy_h.k = m.k LEFT JOIN z_h ON z_h.k = m.k LEFT JOIN altitude_h ON altitude_h.k = m.k)"""
)


def scores(spark, sf):
    return C.world(samples(spark, sf))


@query("ml01", SCORES + " SELECT sample_id, name, round(score, 9) AS score FROM sc")
def ml01(spark, sf):
    return scores(spark, sf).select("sample_id", "name", r("score", 9).alias("score"))


@query("ord04", SCORES + ", b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 12) DESC, name) AS n FROM sc) SELECT sample_id, CASE WHEN score > 0 THEN name ELSE 'unknown' END AS name FROM b WHERE n = 1")
def ord04(spark, sf):
    return M.best(scores(spark, sf).withColumn("score", r("score", 12))).select("sample_id", "name")


@query("ag32", SCORES + ", a AS (SELECT device_id, leg, name, avg(CASE WHEN confirmed_type IS NULL THEN sc.score WHEN confirmed_type = name THEN 1.0 ELSE 0.0 END) AS score FROM sc JOIN samples USING (sample_id) GROUP BY ALL) SELECT device_id, leg, name, round(score, 9) AS score FROM a")
def ag32(spark, sf):
    s = samples(spark, sf)
    known = F.when(F.col("confirmed_type").isNull(), F.col("score")).when(F.col("confirmed_type") == F.col("name"), 1.0).otherwise(0.0)
    return scores(spark, sf).join(s.select("sample_id", "device_id", "leg", "confirmed_type"), "sample_id").groupBy("device_id", "leg", "name").agg(r(F.avg(known), 9).alias("score"))


@query("ml09", S + " SELECT sample_id, coalesce(confirmed_type, classified_type) AS activity_type FROM samples")
def ml09(spark, sf):
    return samples(spark, sf).select("sample_id", F.coalesce("confirmed_type", "classified_type").alias("activity_type"))


@query("ml10", S + " SELECT sample_id, confirmed_type || '=1' AS best, 5 AS zeros FROM samples WHERE confirmed_type IS NOT NULL")
def ml10(spark, sf):
    from wayfold.schemas import BASE_TYPES

    results = F.transform(F.array(*map(F.lit, BASE_TYPES)), lambda n: F.struct((n == F.col("confirmed_type")).cast("int").alias("s"), n.alias("n")))
    s = samples(spark, sf).filter("confirmed_type is not null").withColumn("r", results)
    top = F.element_at(F.filter("r", lambda x: x["s"] == 1), 1)
    return s.select("sample_id", F.concat(top["n"], F.lit("=1")).alias("best"), F.size(F.filter("r", lambda x: x["s"] == 0)).alias("zeros"))


@query("set04", S + ", c AS (SELECT device_id, classified_type AS n, count(*) AS c FROM samples WHERE classified_type IS NOT NULL AND classified_type <> 'bus' GROUP BY ALL) SELECT device_id, string_agg(n, ',' ORDER BY c DESC, n) AS ranked FROM c GROUP BY 1")
def set04(spark, sf):
    c = samples(spark, sf).filter("classified_type is not null").groupBy("device_id", F.col("classified_type").alias("n")).count()
    g = c.groupBy("device_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "n"))).alias("r"))
    return g.select("device_id", F.array_join(F.transform(F.filter("r", lambda x: x["n"] != "bus"), lambda x: x["n"]), ",").alias("ranked"))
