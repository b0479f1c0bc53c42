"""Timeline graph operators and the stateful filters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.operators import classifier, folds, merging, segments, stats
from wayfold.operators import items as I
from wayfold.plans.basics import items, linked
from wayfold.plans.classify import SCORES
from wayfold.plans.sqltext import I as ITEMS
from wayfold.plans.sqltext import USABLE, S, hav
from wayfold.plans.statistics import MODE, TRUST, numbered
from wayfold.registry import query
from wayfold.sources.samples import samples


def r(c, n):
    return F.round(c, n)


# modes and edges next to items
FACTS = (
    ITEMS
    + MODE[MODE.index(", counted AS") :]
    + f""", ends AS (SELECT device_id, item_no, arg_min({{'ok': {USABLE}, 'lat': latitude, 'lng': longitude}}, (t, sample_id)) AS f, arg_max({{'ok': {USABLE}, 'lat': latitude, 'lng': longitude}}, (t, sample_id)) AS l FROM numbered GROUP BY ALL),
facts AS (
  SELECT i.*, f, l, coalesce(m.activity_type, b.activity_type) AS kind, CASE WHEN duration > 0 THEN distance / duration ELSE 0 END AS mps, greatest(10.0, least(150.0, radius_mean + radius_sd)) AS r1, NOT is_gap AND n_usable = 0 AS nolo
  FROM items i JOIN ends USING (device_id, item_no) JOIN best b USING (device_id, item_no) LEFT JOIN moved m USING (device_id, item_no)),
duo AS (SELECT a.device_id, a, b FROM facts a JOIN facts b ON a.device_id = b.device_id AND b.item_no = a.item_no + 1),
two AS (SELECT device_id, a, b FROM duo UNION ALL SELECT device_id, b AS a, a AS b FROM duo),
measured AS (
  SELECT *, (greatest(a.start_t, b.start_t) - least(a.end_t, b.end_t))::DOUBLE AS gap,
    CASE WHEN a.is_visit AND b.is_visit THEN {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} - a.r1 - b.r1
         WHEN a.is_visit THEN CASE WHEN (CASE WHEN a.start_t < b.start_t THEN b.f ELSE b.l END).ok THEN {hav('a.latitude', 'a.longitude', '(CASE WHEN a.start_t < b.start_t THEN b.f ELSE b.l END).lat', '(CASE WHEN a.start_t < b.start_t THEN b.f ELSE b.l END).lng')} - a.r1 END
         WHEN b.is_visit THEN CASE WHEN (CASE WHEN a.start_t < b.start_t THEN a.l ELSE a.f END).ok THEN {hav('b.latitude', 'b.longitude', '(CASE WHEN a.start_t < b.start_t THEN a.l ELSE a.f END).lat', '(CASE WHEN a.start_t < b.start_t THEN a.l ELSE a.f END).lng')} - b.r1 END
         ELSE {hav('(CASE WHEN a.start_t < b.start_t THEN a.l ELSE a.f END).lat', '(CASE WHEN a.start_t < b.start_t THEN a.l ELSE a.f END).lng', '(CASE WHEN a.start_t < b.start_t THEN b.f ELSE b.l END).lat', '(CASE WHEN a.start_t < b.start_t THEN b.f ELSE b.l END).lng')} END AS dist
  FROM two),
limited AS (
  SELECT *, CASE WHEN a.is_visit AND b.is_visit THEN 1.7976931348623157e308 WHEN a.is_visit THEN greatest(b.mps * gap * 4, 150) WHEN b.is_visit THEN greatest(a.mps * gap * 4, 150)
    ELSE CASE WHEN a.mps > 0 AND b.mps > 0 THEN (a.mps + b.mps) / 2 ELSE a.mps + b.mps END * gap * 4 END AS most FROM measured),
judged AS (SELECT *, a.nolo OR b.nolo OR coalesce(dist <= most, false) OR gap >= 0 AS near FROM limited),
pin AS (SELECT j.device_id, j.a.item_no AS a_no, j.b.item_no AS b_no, j.b.n_samples AS bn, j.b.duration AS bs, j.b.distance AS bm, n.t, n.sample_id, n.latitude, n.longitude
  FROM judged j JOIN numbered n ON n.device_id = j.device_id AND n.item_no = j.b.item_no
  WHERE j.a.is_visit AND j.a.valid AND NOT j.b.is_visit AND NOT j.b.valid AND {USABLE.replace('h_acc', 'n.h_acc').replace('latitude', 'n.latitude').replace('longitude', 'n.longitude')} AND {hav('n.latitude', 'n.longitude', 'j.a.latitude', 'j.a.longitude')} <= j.a.r1),
pst AS (SELECT *, {hav('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')} AS s FROM pin WINDOW o AS (PARTITION BY device_id, a_no, b_no ORDER BY t, sample_id)),
psh AS (SELECT device_id, a_no, b_no, (count(*) / max(bn)::DOUBLE + CASE WHEN max(bs) > 0 THEN (max(t) - min(t)) / max(bs) ELSE 0 END + CASE WHEN max(bm) > 0 THEN sum(coalesce(s, 0)) / max(bm) ELSE 0 END) / 3 AS share FROM pst GROUP BY ALL),
scores AS (
  SELECT judged.*, CASE WHEN a.is_gap THEN CASE WHEN b.is_gap THEN 5 ELSE 0 END WHEN b.is_gap THEN CASE WHEN NOT b.valid THEN 3 ELSE 0 END WHEN a.nolo THEN CASE WHEN b.nolo THEN 5 ELSE 0 END WHEN b.nolo AND NOT b.valid THEN 3 WHEN NOT near THEN 0
    WHEN a.is_visit THEN CASE WHEN b.is_visit THEN CASE WHEN coalesce(dist < 0, false) THEN CASE WHEN a.duration > b.duration THEN 5 ELSE 4 END ELSE 0 END WHEN a.valid AND NOT b.valid THEN CASE WHEN coalesce(floor(round(share * 10, 9)) = 10, false) THEN 2 ELSE 1 END ELSE 0 END
    WHEN NOT a.valid THEN CASE WHEN NOT b.valid THEN 1 ELSE 0 END
    WHEN b.is_visit THEN CASE WHEN b.keeper THEN 0 WHEN a.keeper THEN CASE WHEN NOT b.valid THEN 3 ELSE 2 END WHEN NOT b.valid THEN 2 ELSE 1 END
    WHEN a.kind IS NULL AND b.kind IS NULL THEN 3 WHEN a.kind IS NOT DISTINCT FROM b.kind THEN 5 ELSE 0 END AS score FROM judged LEFT JOIN psh ON psh.device_id = judged.device_id AND a_no = a.item_no AND b_no = b.item_no)"""
)


def pairs(spark, sf):
    """Each item (a) with its neighbours (b), both ways."""
    n = numbered(spark, sf)
    f = merging.facts(I.summarize(n.drop("activity_type")), n)
    o = W.partitionBy("device_id").orderBy("item_no")
    s = f.select("device_id", "item_no", merging.as_struct("a"))
    s = s.withColumns({"p": F.lag("a").over(o), "n": F.lead("a").over(o)})
    return s.select("device_id", "a", F.explode(F.array_compact(F.array("p", "n"))).alias("b"))


def inside(spark, sf, p):
    return merging.with_inside(p, numbered(spark, sf), "a", "b")


A, B = (lambda: F.col("a")), (lambda: F.col("b"))
PAIR = "device_id, a.item_no AS a_no, b.item_no AS b_no"


def pair_ids():
    return "device_id", F.col("a.item_no").alias("a_no"), F.col("b.item_no").alias("b_no")


@query("fn37", FACTS + f" SELECT {PAIR}, gap FROM measured")
def fn37(spark, sf):
    return pairs(spark, sf).select(*pair_ids(), merging.time_gap(A(), B()).alias("gap"))


@query("fn38", FACTS + f" SELECT {PAIR}, round(dist, 3) AS metres FROM measured")
def fn38(spark, sf):
    return pairs(spark, sf).select(*pair_ids(), r(merging.item_distance(A(), B()), 3).alias("metres"))


@query("fn39", FACTS + f" SELECT {PAIR}, round(least(most, 1e12), 3) AS most FROM limited")
def fn39(spark, sf):
    return pairs(spark, sf).select(*pair_ids(), r(F.least(merging.max_mergeable(A(), B()), F.lit(1e12)), 3).alias("most"))


@query("fn40", FACTS + f" SELECT {PAIR}, near FROM judged")
def fn40(spark, sf):
    return pairs(spark, sf).select(*pair_ids(), merging.within_mergeable(A(), B()).alias("near"))


@query("fn41", ITEMS + f", v AS (SELECT *, greatest(10.0, least(150.0, radius_mean + radius_sd)) AS r1, row_number() OVER (PARTITION BY device_id ORDER BY item_no) AS k FROM items WHERE is_visit) SELECT a.device_id, a.item_no AS a_no, b.item_no AS b_no, coalesce({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} - a.r1 - b.r1 < 0, false) AS overlap FROM v a JOIN v b ON a.device_id = b.device_id AND b.k = a.k + 1")
def fn41(spark, sf):
    n = numbered(spark, sf)
    f = merging.facts(I.summarize(n.drop("activity_type")), n).filter("is_visit")
    o = W.partitionBy("device_id").orderBy("item_no")
    s = f.select("device_id", "item_no", merging.as_struct("a")).withColumn("b", F.lead("a").over(o)).filter("b is not null")
    return s.select(*pair_ids(), F.coalesce(merging.item_distance(A(), B()) < 0, F.lit(False)).alias("overlap"))


ROOT = "CASE WHEN a.item_no % 11 = 0 OR b.item_no % 11 = 0 OR a.item_no % 13 = 0 THEN 0 WHEN b.item_no % 17 = 0 THEN 5 WHEN a.item_no % 17 = 0 THEN 0 ELSE score END"


@query("tl05", FACTS + f" SELECT {PAIR}, {ROOT} AS score FROM scores")
def tl05(spark, sf):
    """Scores with the root rules; in the fixture, every 11th item is locked, every 13th deleted, every 17th empty."""
    nth = lambda x, k: x["item_no"] % k == 0
    root = merging.root_score(merging.consumption(A(), B(), inside=F.col("inside")), locked=nth(A(), 11) | nth(B(), 11), consumer_deleted=nth(A(), 13), consumee_empty=nth(B(), 17), consumer_empty=nth(A(), 17))
    return inside(spark, sf, pairs(spark, sf)).select(*pair_ids(), root.alias("score"))


# paths of differing types are marked by -1 for the classifier to judge
FITTED = (
    SCORES
    + f""", member AS ({ITEMS} SELECT sample_id, device_id, item_no FROM numbered), fits AS (SELECT device_id, item_no, name, avg(score) AS fit FROM sc JOIN member USING (sample_id) GROUP BY ALL),
  judged AS ({FACTS.replace("WHEN a.kind IS NOT DISTINCT FROM b.kind THEN 5 ELSE 0 END AS score", "WHEN a.kind IS NOT DISTINCT FROM b.kind THEN 5 ELSE -1 END AS score")} SELECT device_id, a.item_no AS a_no, b.item_no AS b_no, a.kind AS kind, b.keeper AS kept, score FROM scores WHERE NOT a.is_visit AND NOT a.is_gap)
  SELECT j.device_id, a_no, b_no, CASE WHEN score >= 0 THEN score WHEN kept OR kind IS NULL OR fit IS NULL THEN 0 ELSE CASE WHEN floor(fit * 1000) >= 75 THEN 5 WHEN floor(fit * 1000) >= 50 THEN 4 WHEN floor(fit * 1000) >= 25 THEN 3 WHEN floor(fit * 1000) >= 10 THEN 2 ELSE 1 END END AS score
  FROM judged j LEFT JOIN fits f ON f.device_id = j.device_id AND f.item_no = j.b_no AND f.name = j.kind"""
)


@query("tl06", FITTED)
def tl06(spark, sf):
    """Paths taking their neighbours; those of another type by the classifier's mean score over their samples."""
    # scored with their items at hand: scores meet no items by a join
    told = classifier.world(samples(spark, sf), of=numbered(spark, sf), kept=("device_id", "item_no"))
    fits = told.groupBy("device_id", F.col("item_no").alias("_i"), F.col("name").alias("_n")).agg(F.avg("score").alias("fit"))
    p = pairs(spark, sf).filter("not a.is_visit and not a.is_gap").withColumns({"_i": F.col("b.item_no"), "_n": F.col("a.kind")})
    p = p.join(fits, ["device_id", "_i", "_n"], "left")
    return p.select(*pair_ids(), merging.consumption(A(), B(), fit=F.col("fit")).alias("score"))


@query("tl07", FACTS + f" SELECT {PAIR}, score FROM scores WHERE a.is_visit")
def tl07(spark, sf):
    p = inside(spark, sf, pairs(spark, sf).filter("a.is_visit"))
    return p.select(*pair_ids(), merging.consumption(A(), B(), inside=F.col("inside")).alias("score"))


CAND = ITEMS + """, nb AS (SELECT device_id, item_no AS w, keepness AS kw, is_gap AS gw, lag(item_no, 2) OVER o AS p2, lag(item_no) OVER o AS p1, lead(item_no) OVER o AS n1, lead(item_no, 2) OVER o AS n2,
   lag(keepness, 2) OVER o AS kp2, lag(keepness) OVER o AS kp1, lead(keepness) OVER o AS kn1, lead(keepness, 2) OVER o AS kn2, lag(is_gap, 2) OVER o AS gp2, lag(is_gap) OVER o AS gp1, lead(is_gap) OVER o AS gn1, lead(is_gap, 2) OVER o AS gn2
   FROM items WINDOW o AS (PARTITION BY device_id ORDER BY item_no)),
 c AS (SELECT device_id, w AS k, NULL::BIGINT AS b, n1 AS d FROM nb WHERE n1 IS NOT NULL UNION SELECT device_id, n1, NULL, w FROM nb WHERE n1 IS NOT NULL
   UNION SELECT device_id, w, n1, n2 FROM nb WHERE n2 IS NOT NULL AND NOT gw AND kn1 < kw AND NOT gn2 AND kn2 > kn1 UNION SELECT device_id, n2, n1, w FROM nb WHERE n2 IS NOT NULL AND NOT gw AND kn1 < kw AND NOT gn2 AND kn2 > kn1
   UNION SELECT device_id, w, p1, p2 FROM nb WHERE p2 IS NOT NULL AND NOT gw AND kp1 < kw AND NOT gp2 AND kp2 > kp1 UNION SELECT device_id, p2, p1, w FROM nb WHERE p2 IS NOT NULL AND NOT gw AND kp1 < kw AND NOT gp2 AND kp2 > kp1
   UNION SELECT device_id, p1, w, n1 FROM nb WHERE p1 IS NOT NULL AND n1 IS NOT NULL AND kp1 > kw AND kn1 > kw AND NOT gp1 AND NOT gn1 UNION SELECT device_id, n1, w, p1 FROM nb WHERE p1 IS NOT NULL AND n1 IS NOT NULL AND kp1 > kw AND kn1 > kw AND NOT gp1 AND NOT gn1)"""


def candidate_rows(spark, sf):
    n = numbered(spark, sf)
    return merging.facts(I.summarize(n.drop("activity_type")), n)


@query("tl02", CAND + " SELECT * FROM c")
def tl02(spark, sf):
    return merging.candidates(candidate_rows(spark, sf)).select("device_id", "k", "b", "d")


@query("tl03", CAND + " SELECT device_id, count(*) AS n, bool_and(k <> d AND (b IS NULL OR (b <> k AND b <> d AND abs(k - d) = 2)) AND (b IS NOT NULL OR abs(k - d) = 1)) AS all_valid FROM c GROUP BY 1")
def tl03(spark, sf):
    c = merging.candidates(candidate_rows(spark, sf))
    apart = F.abs(F.col("k") - F.col("d"))
    ok = F.when(F.col("b").isNull(), apart == 1).otherwise((apart == 2) & (F.col("b") != F.col("k")) & (F.col("b") != F.col("d")))
    return c.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("all_valid"))


# every candidate, with the item between, if any
BRIDGED = FACTS[: FACTS.index("duo AS (")] + CAND[len(ITEMS) + 2 :] + ",\ntwo AS (SELECT c.device_id, bt AS between_no, a, b FROM (SELECT device_id, k, b AS bt, d FROM c) c JOIN facts a ON a.device_id = c.device_id AND a.item_no = c.k JOIN facts b ON b.device_id = c.device_id AND b.item_no = c.d),\n" + FACTS[FACTS.index("measured AS (") :]


@query("tl04", BRIDGED + " SELECT device_id, a.item_no AS k, between_no AS b, b.item_no AS d, score FROM scores")
def tl04(spark, sf):
    """The score of each candidate: of the keeper taking the deadman, next to it or beyond a betweener."""
    return merging.scored(candidate_rows(spark, sf), numbered(spark, sf)).select("device_id", "k", "b", "d", "score")


@query("ord05", BRIDGED + " SELECT device_id, k, b, d, score, row_number() OVER (PARTITION BY device_id ORDER BY score DESC, g, ks, k, d, b) AS place FROM (SELECT device_id, a.item_no AS k, between_no AS b, b.item_no AS d, score, abs(gap) AS g, a.start_t AS ks FROM scores WHERE score > 0)")
def ord05(spark, sf):
    """Possible merges of each device from the best on: by score, then gap, then the keeper's start and the items."""
    c = merging.scored(candidate_rows(spark, sf), numbered(spark, sf)).filter("score > 0")
    place = F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("score"), "gap", "start", "k", "d", F.asc_nulls_last("b")))
    return c.select("device_id", "k", "b", "d", "score", place.alias("place"))


@query("tl09")
def tl09(spark, sf):
    """The timeline when no merge is left: each sample's item."""
    merged = merging.merge_rounds(numbered(spark, sf).select(*merging.SAMPLE))
    return merged.select("sample_id", "device_id", "item_no", "kind_visit")


@query("tl17", ITEMS + ", n AS (SELECT *, lead(start_t) OVER o AS ns, lead(is_gap) OVER o AS ng FROM items WINDOW o AS (PARTITION BY device_id ORDER BY item_no)) SELECT device_id, t, 'off' AS recording_state FROM (SELECT device_id, unnest([last_t + 1, ns - 1]) AS t FROM n WHERE ns - last_t > 300 AND NOT is_gap AND NOT ng)")
def tl17(spark, sf):
    gaps = segments.data_gaps(items(spark, sf))
    return gaps.select("device_id", F.explode(F.array(F.col("last_t") + 1, F.col("next_start") - 1)).alias("t"), F.lit("off").alias("recording_state"))


@query("tl18", ITEMS + ", dead AS (SELECT device_id, item_no FROM items WHERE item_no % 7 = 0), orphan AS (SELECT n.* FROM numbered n JOIN dead USING (device_id, item_no)), alive AS (SELECT * FROM items WHERE item_no % 7 <> 0), j AS (SELECT o.sample_id, a.item_no, row_number() OVER (PARTITION BY o.sample_id ORDER BY a.start_t, a.item_no) AS n FROM orphan o LEFT JOIN alive a ON o.device_id = a.device_id AND o.t BETWEEN a.start_t AND a.end_t) SELECT sample_id, item_no AS adopted_by FROM j WHERE n = 1")
def tl18(spark, sf):
    from wayfold.operators.joins import points_in_intervals

    i = items(spark, sf)
    orphans = numbered(spark, sf).join(i.filter("item_no % 7 = 0").select("device_id", "item_no"), ["device_id", "item_no"], "left_semi").select("sample_id", "device_id", "t")
    alive = i.filter("item_no % 7 <> 0").select("device_id", "item_no", "start_t", "end_t")
    found = points_in_intervals(orphans, alive, how="left")
    best = found.groupBy("sample_id").agg(F.min(F.when(F.col("item_no").isNotNull(), F.struct("start_t", "item_no"))).alias("m"))
    return best.select("sample_id", F.col("m.item_no").alias("adopted_by"))


@query("tl19", ITEMS + ", a AS (SELECT * FROM items WHERE item_no % 7 <> 0) SELECT device_id, item_no, lag(item_no) OVER o AS previous, lead(item_no) OVER o AS next FROM a WINDOW o AS (PARTITION BY device_id ORDER BY start_t, item_no)")
def tl19(spark, sf):
    o = W.partitionBy("device_id").orderBy("start_t", "item_no")
    return items(spark, sf).filter("item_no % 7 <> 0").select("device_id", "item_no", F.lag("item_no").over(o).alias("previous"), F.lead("item_no").over(o).alias("next"))


@query("tl21", S + " SELECT device_id, leg, count(*) AS n, min(t) AS start_t, max(t) AS end_t, bool_and(moving_state = 'stationary') AS is_visit FROM samples GROUP BY ALL")
def tl21(spark, sf):
    return samples(spark, sf).groupBy("device_id", "leg").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.bool_and(F.col("moving_state") == "stationary").alias("is_visit"))


@query("tl22", ITEMS + ", l AS (SELECT item_no, lag(item_no) OVER o AS p, lead(item_no) OVER o AS n FROM items WINDOW o AS (PARTITION BY device_id ORDER BY item_no)) SELECT count(*) FILTER (p = item_no OR n = item_no OR p = n) AS n_broken FROM l")
def tl22(spark, sf):
    bad = (F.col("previous") == F.col("item_no")) | (F.col("next") == F.col("item_no")) | (F.col("previous") == F.col("next"))
    return linked(spark, sf).agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n_broken"))


KALMAN = S + f""", f AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, sample_id) AS n FROM samples WHERE {USABLE}),
k AS (
  SELECT device_id, sample_id, t, n, latitude AS lat, longitude AS lng, h_acc * h_acc AS variance FROM f WHERE n = 1
  UNION ALL
  SELECT f.device_id, f.sample_id, f.t, f.n, k.lat + g * (f.latitude - k.lat), k.lng + g * (f.longitude - k.lng), (1 - g) * v
  FROM (SELECT k.*, k.variance + (x.t - k.t) * 16e0 AS v, (k.variance + (x.t - k.t) * 16e0) / (k.variance + (x.t - k.t) * 16e0 + x.h_acc * x.h_acc) AS g, x.n AS xn FROM k JOIN f x ON x.device_id = k.device_id AND x.n = k.n + 1) k
  JOIN f ON f.device_id = k.device_id AND f.n = k.xn)"""
KALMAN = KALMAN.replace("WITH samples", "WITH RECURSIVE samples", 1)


@query("st02", KALMAN + " SELECT sample_id, round(lat, 6) AS latitude, round(lng, 6) AS longitude FROM k")
def st02(spark, sf):
    return folds.kalman(samples(spark, sf)).select("sample_id", r("latitude", 6).alias("latitude"), r("longitude", 6).alias("longitude"))


@query("st01", KALMAN + " SELECT sample_id, round(variance, 4) AS variance FROM k")
def st01(spark, sf):
    return folds.kalman(samples(spark, sf)).select("sample_id", r("variance", 4).alias("variance"))


# heights by themselves, then the last one up to each fix
HEIGHTS = (S + f""", f AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, sample_id) AS n FROM samples WHERE v_acc > 0 AND altitude IS NOT NULL),
k AS (
  SELECT device_id, sample_id, t, n, altitude AS height, v_acc * v_acc AS variance FROM f WHERE n = 1
  UNION ALL
  SELECT f.device_id, f.sample_id, f.t, f.n, k.height + g * (f.altitude - k.height), (1 - g) * v
  FROM (SELECT k.*, k.variance + (x.t - k.t) * 9e0 AS v, (k.variance + (x.t - k.t) * 9e0) / (k.variance + (x.t - k.t) * 9e0 + x.v_acc * x.v_acc) AS g, x.n AS xn FROM k JOIN f x ON x.device_id = k.device_id AND x.n = k.n + 1) k
  JOIN f ON f.device_id = k.device_id AND f.n = k.xn),
fixes AS (SELECT device_id, sample_id, t FROM samples WHERE {USABLE}),
heights AS (SELECT x.sample_id, x.device_id, x.t, coalesce(height, 0e0) AS altitude, coalesce(sqrt(variance), -1e0) AS v_acc FROM fixes x ASOF LEFT JOIN k ON k.device_id = x.device_id AND k.t <= x.t)""").replace("WITH samples", "WITH RECURSIVE samples", 1)


@query("st03", HEIGHTS + " SELECT sample_id, round(altitude, 4) AS altitude FROM heights")
def st03(spark, sf):
    return folds.kalman(samples(spark, sf)).select("sample_id", r("altitude", 4).alias("altitude"))


@query("st04", "WITH trust AS (" + TRUST + f"), s AS ({S} SELECT *, sign(latitude) * floor(abs(latitude) * 10000 + 0.5) / 10000 AS lat4, sign(longitude) * floor(abs(longitude) * 10000 + 0.5) / 10000 AS lng4 FROM samples) SELECT sample_id, round(h_acc + CASE WHEN trust < 1 THEN 100 * (1 - trust) ELSE 0 END, 4) AS h_acc FROM s LEFT JOIN trust USING (device_id, lat4, lng4)")
def st04(spark, sf):
    """Accuracies worsened by what each device's standstills say of a place."""
    s = samples(spark, sf)
    return stats.worsened(s, stats.coordinate_trust(s)).select("sample_id", r("h_acc", 4).alias("h_acc"))


@query("st05", HEIGHTS + " SELECT sample_id, device_id, t, round(altitude, 4) AS altitude, round(v_acc, 4) AS v_acc FROM heights")
def st05(spark, sf):
    return folds.kalman(samples(spark, sf)).select("sample_id", "device_id", "t", r("altitude", 4).alias("altitude"), r("v_acc", 4).alias("v_acc"))


@query("st07")
def st07(spark, sf):
    from wayfold.operators.brain import states

    return states(samples(spark, sf)).select("sample_id", "n_present", "n_past", "state")


RATE = (S + """, f AS (SELECT device_id, sample_id, t, row_number() OVER (PARTITION BY device_id ORDER BY t, sample_id) AS n FROM samples),
k AS (SELECT device_id, sample_id, n, t AS kept, true AS keep FROM f WHERE n = 1 UNION ALL
  SELECT f.device_id, f.sample_id, f.n, CASE WHEN f.t - k.kept >= 50 THEN f.t ELSE k.kept END, f.t - k.kept >= 50 FROM k JOIN f ON f.device_id = k.device_id AND f.n = k.n + 1)""").replace("WITH samples", "WITH RECURSIVE samples", 1)


@query("st15", RATE + " SELECT sample_id FROM k WHERE keep")
def st15(spark, sf):
    return folds.rate_limited(samples(spark, sf), per_minute=1.2).select("sample_id")


@query("st12", S + """, f AS (SELECT *, CASE WHEN (moving_state = 'stationary') IS DISTINCT FROM lag(moving_state = 'stationary') OVER o OR row_number() OVER o = 1 THEN 1 ELSE 0 END AS f FROM samples WINDOW o AS (PARTITION BY device_id ORDER BY t, sample_id)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT device_id, min(t) AS since, max(t) - min(t) >= 180 AS sleeps FROM g WHERE moving_state = 'stationary' GROUP BY device_id, k""")
def st12(spark, sf):
    g = I.islands(samples(spark, sf), I.per_device(), "k", F.col("moving_state") == "stationary").filter("moving_state = 'stationary'")
    return g.groupBy("device_id", "k").agg(F.min("t").alias("since"), (F.max("t") - F.min("t") >= 180).alias("sleeps")).drop("k")


@query("st18", S + ", n AS (SELECT device_id, t, recording_state, lead(t) OVER (PARTITION BY device_id ORDER BY t, sample_id) AS nt FROM samples) SELECT device_id, unnest([t, nt]) AS t, 'off' AS recording_state FROM n WHERE nt - t >= 60 AND recording_state <> 'off'")
def st18(spark, sf):
    n = samples(spark, sf).withColumn("nt", F.lead("t").over(I.per_device())).filter("nt - t >= 60 and recording_state <> 'off'")
    return n.select("device_id", F.explode(F.array("t", "nt")).alias("t"), F.lit("off").alias("recording_state"))
