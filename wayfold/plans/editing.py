"""Edits of a timeline next to their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import editing
from wayfold.operators import items as I
from wayfold.operators import merging
from wayfold.plans.basics import items, linked
from wayfold.plans.sqltext import I as ITEMS
from wayfold.plans.sqltext import USABLE, N, S, hav
from wayfold.plans.statistics import numbered
from wayfold.plans.timeline import FACTS, candidate_rows
from wayfold.registry import query
from wayfold.sources.samples import samples

# keepers between two items, by running counts
NEAR = ITEMS + """, p AS (SELECT device_id, item_no, keeper::INT AS k, row_number() OVER o AS pos, sum(keeper::INT) OVER (o ROWS UNBOUNDED PRECEDING) AS kc FROM items WINDOW o AS (PARTITION BY device_id ORDER BY start_t, item_no)),
 c AS (SELECT a.device_id, a.item_no, count(*) FILTER (b.pos < a.pos AND a.kc - a.k - b.kc < 2) AS n_before, count(*) FILTER (b.pos > a.pos AND b.kc - b.k - a.kc < 2) AS later FROM p a JOIN p b ON a.device_id = b.device_id GROUP BY ALL)
 SELECT device_id, item_no, n_before, least(later, greatest(0, 8 - n_before)) AS n_after FROM c"""


@query("tl01", NEAR)
def tl01(spark, sf):
    """The items that are processed with each: at most nine, unless more lie before it up to the second keeper."""
    return editing.neighbourhoods(items(spark, sf))


DELETE = (
    FACTS[: FACTS.index("duo AS (")]
    + """nbr AS (SELECT device_id, item_no AS w, lag(item_no) OVER o AS p, lead(item_no) OVER o AS n FROM items WINDOW o AS (PARTITION BY device_id ORDER BY start_t, item_no)),
opt AS (SELECT device_id, w, 0 AS way, n AS kn, w AS bt, p AS dn FROM nbr WHERE p IS NOT NULL AND n IS NOT NULL UNION ALL SELECT device_id, w, 1, p, w, n FROM nbr WHERE p IS NOT NULL AND n IS NOT NULL
  UNION ALL SELECT device_id, w, 2, p, NULL, w FROM nbr WHERE p IS NOT NULL UNION ALL SELECT device_id, w, 3, n, NULL, w FROM nbr WHERE n IS NOT NULL),
two AS (SELECT o.device_id, w AS doomed, way, bt, a, b FROM opt o JOIN facts a ON a.device_id = o.device_id AND a.item_no = kn JOIN facts b ON b.device_id = o.device_id AND b.item_no = dn),
"""
    + FACTS[FACTS.index("measured AS (") :]
    + " SELECT device_id, doomed AS item_no, k, b, d, score FROM (SELECT device_id, doomed, a.item_no AS k, bt AS b, b.item_no AS d, score, row_number() OVER (PARTITION BY device_id, doomed ORDER BY score DESC, way) AS i FROM scores) WHERE i = 1"
)


@query("tl13", DELETE)
def tl13(spark, sf):
    """Of each item, were it deleted: the merge that is made."""
    return editing.safe_deletes(candidate_rows(spark, sf), numbered(spark, sf))


# the two outermost samples at the edge that faces the other item
FACING = FACTS + f""", seq AS (SELECT device_id, item_no, {{'id': sample_id, 't': t, 'ok': {USABLE}, 'lat': latitude, 'lng': longitude, 'speed': speed, 'kind': activity_type}} AS e,
  row_number() OVER (PARTITION BY device_id, item_no ORDER BY t, sample_id) AS i, row_number() OVER (PARTITION BY device_id, item_no ORDER BY t DESC, sample_id DESC) AS j FROM numbered),
tips AS (SELECT device_id, item_no, any_value(e) FILTER (i = 1) AS f1, any_value(e) FILTER (i = 2) AS f2, any_value(e) FILTER (j = 1) AS l1, any_value(e) FILTER (j = 2) AS l2 FROM seq GROUP BY ALL),
faced AS (SELECT j.device_id, a, b, CASE WHEN a.start_t < b.start_t THEN x.l1 ELSE x.f1 END AS a1, CASE WHEN a.start_t < b.start_t THEN x.l2 ELSE x.f2 END AS a2, CASE WHEN a.start_t < b.start_t THEN y.f1 ELSE y.l1 END AS b1, CASE WHEN a.start_t < b.start_t THEN y.f2 ELSE y.l2 END AS b2
  FROM judged j JOIN tips x ON x.device_id = j.device_id AND x.item_no = j.a.item_no JOIN tips y ON y.device_id = j.device_id AND y.item_no = j.b.item_no WHERE near AND gap < 600 AND NOT a.is_gap AND NOT b.is_gap)"""
IN = [f"({hav('a.latitude', 'a.longitude', f'{e}.lat', f'{e}.lng')} <= a.r1)" for e in ("b1", "b2")]
BY_VISIT = FACING + f""", s AS (SELECT device_id, a, b, a1, b1, {IN[0]} AND {IN[1]} AS take, NOT {IN[0]} AND abs(a1.t - a2.t) <= 120 AS give FROM faced WHERE a.is_visit AND NOT b.is_visit AND b.n_samples > 2 AND a1.ok AND a2.ok AND b1.ok AND b2.ok)
 SELECT device_id, CASE WHEN take THEN b1.id ELSE a1.id END AS sample_id, CASE WHEN take THEN b.item_no ELSE a.item_no END AS from_no, CASE WHEN take THEN a.item_no ELSE b.item_no END AS to_no FROM s WHERE take OR give"""
BY_PATH = FACING + """, s AS (SELECT device_id, a, b, b1, row_number() OVER (PARTITION BY device_id, least(a.item_no, b.item_no) ORDER BY a.start_t) AS i FROM faced
  WHERE NOT a.is_visit AND NOT b.is_visit AND a1.ok AND b1.ok AND a.kind <> b.kind AND (a1.speed < 2 / 3.6e0) = (b1.speed < 2 / 3.6e0) AND b1.kind = a.kind)
 SELECT device_id, b1.id AS sample_id, b.item_no AS from_no, a.item_no AS to_no FROM s WHERE i = 1"""


def moves(spark, sf, cut=None):
    n = numbered(spark, sf) if cut is None else cut
    rows = merging.facts(I.summarize(n.drop("activity_type")), n)
    return editing.edge_moves(rows, editing.tips(n))


@query("tl11", BY_VISIT)
def tl11(spark, sf):
    return moves(spark, sf).filter("not paths").select("device_id", "sample_id", "from_no", "to_no")


# recorded types flip at each leg: paths that follow each other, by the type of samples, without visits between
TYPED = """, numbered AS (SELECT *, (sum(f2) OVER (PARTITION BY device_id ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING))::BIGINT AS item_no FROM (SELECT * EXCLUDE (f), CASE WHEN row_number() OVER o = 1 OR cell IS DISTINCT FROM lag(cell) OVER o THEN 1 ELSE 0 END AS f2
  FROM (SELECT *, floor(idx / 5e0) AS cell FROM flagged WHERE m) x WINDOW o AS (PARTITION BY device_id ORDER BY t, sample_id)) y)"""


@query("tl12", BY_PATH.replace(N[N.index(",\nnumbered AS (") :], TYPED.replace(", numbered", ",\nnumbered", 1), 1))
def tl12(spark, sf):
    """Neighbouring paths; in the fixture, the moving samples alone, a path for every few of a leg."""
    s = samples(spark, sf).filter("not deleted").filter(I.moving()).withColumn("activity_type", F.coalesce("confirmed_type", "classified_type"))
    n = I.islands(s, I.per_device(), "item_no", F.floor(F.col("idx") / 5))
    return moves(spark, sf, n).filter("paths").select("device_id", "sample_id", "from_no", "to_no")


@query("tl10")
def tl10(spark, sf):
    """Each sample's item once no edge gives a sample to its neighbour."""
    return editing.sanitise_edges(numbered(spark, sf).select(*merging.SAMPLE, "speed")).select("sample_id", "device_id", "item_no", "kind_visit", "moved")


CUT = ITEMS + """, legs AS (SELECT device_id, leg AS seg_no, min(t) + 100 AS x, min(t) + 340 AS y, leg % 8 = 1 AS to_visit FROM samples WHERE leg % 4 = 1 GROUP BY ALL),
 free AS (SELECT * FROM legs l WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.device_id = l.device_id AND i.item_no % 11 = 0 AND i.end_t > x AND i.start_t < y)),
 held AS (SELECT n.sample_id, n.device_id, n.t, seg_no, CASE WHEN seg_no IS NULL THEN n.item_no END AS old, coalesce(to_visit, i.is_visit) AS kind_visit FROM numbered n JOIN items i USING (device_id, item_no) LEFT JOIN free f ON f.device_id = n.device_id AND n.t BETWEEN x AND y),
 flips AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR seg_no IS DISTINCT FROM lag(seg_no) OVER o OR old IS DISTINCT FROM lag(old) OVER o THEN 1 ELSE 0 END AS f FROM held WINDOW o AS (PARTITION BY device_id ORDER BY t, sample_id))
 SELECT sample_id, (sum(f) OVER (PARTITION BY device_id ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING))::BIGINT AS item_no, kind_visit FROM flips"""


@query("tl14", CUT)
def tl14(spark, sf):
    """Ranges cut out of the timeline; in the fixture, four minutes of every fourth leg, with every 11th item locked."""
    legs = samples(spark, sf).filter("leg % 4 = 1").groupBy("device_id", F.col("leg").alias("seg_no")).agg((F.min("t") + 100).alias("a_start"), (F.min("t") + 340).alias("a_end"))
    locked = items(spark, sf).filter("item_no % 11 = 0").select("device_id", F.col("start_t").alias("b_start"), F.col("end_t").alias("b_end"))
    cut = editing.extracted(numbered(spark, sf), legs.withColumn("to_visit", F.col("seg_no") % 8 == 1), locked)
    return cut.select("sample_id", "item_no", "kind_visit")


BETWEEN = ITEMS + """, kept AS (SELECT n.*, i.is_visit FROM numbered n JOIN items i USING (device_id, item_no) WHERE item_no % 4 <> 2),
 marked AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR activity_type IS DISTINCT FROM lag(activity_type) OVER o THEN 1 ELSE 0 END AS f3 FROM kept WINDOW o AS (PARTITION BY device_id, item_no ORDER BY t, sample_id)),
 runs AS (SELECT device_id, item_no, is_visit, run, min(t) AS x, max(t) AS y, any_value(activity_type) AS kind FROM (SELECT *, sum(f3) OVER (PARTITION BY device_id, item_no ORDER BY t, sample_id ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY ALL),
 tip AS (SELECT device_id, item_no, is_visit, arg_min({'x': x, 'y': y, 'kind': kind}, run) AS f, arg_max({'x': x, 'y': y, 'kind': kind}, run) AS l FROM runs GROUP BY ALL),
 two AS (SELECT device_id, item_no, is_visit, f, lag(is_visit) OVER o AS pv, lag(l) OVER o AS pl FROM tip WINDOW o AS (PARTITION BY device_id ORDER BY item_no))
 SELECT device_id, item_no AS seg_no, CASE WHEN f.kind IS DISTINCT FROM 'stationary' THEN f.x ELSE pl.x END AS a_start, CASE WHEN f.kind IS DISTINCT FROM 'stationary' THEN f.y ELSE pl.y END AS a_end
 FROM two WHERE is_visit AND pv AND (f.kind IS DISTINCT FROM 'stationary' OR pl.kind IS DISTINCT FROM 'stationary')"""


@query("tl15", BETWEEN)
def tl15(spark, sf):
    """What becomes a path between visits; in the fixture, every second path is missing."""
    return editing.paths_between(numbered(spark, sf).filter("item_no % 4 <> 2")).select("device_id", "seg_no", "a_start", "a_end")


GAP = "abs(greatest({a}.start_t, {b}.start_t) - least({a}.end_t, {b}.end_t))"


def _wishes(side: str, back: str, own: str, theirs: str) -> str:
    rank = f"row_number() OVER (PARTITION BY b.device_id, b.item_no ORDER BY abs(i.{theirs} - b.{own}), i.{theirs}, i.item_no)"
    return f"""n_{side} AS (SELECT * FROM (SELECT b.device_id, b.item_no, i.item_no AS near, {rank} AS rk FROM broken b JOIN told i ON i.device_id = b.device_id AND i.item_no <> b.item_no WHERE no_{side}) WHERE rk = 1),
 w_{side} AS (SELECT *, row_number() OVER (PARTITION BY device_id, near ORDER BY gap, item_no) AS wr FROM (SELECT w.device_id, w.item_no, near, {GAP.format(a="x", b="b")} AS gap FROM n_{side} w JOIN broken b ON b.device_id = w.device_id AND b.item_no = w.item_no JOIN told x ON x.device_id = w.device_id AND x.item_no = near
   LEFT JOIN told h ON h.device_id = x.device_id AND h.item_no = x.{back} JOIN spans s ON s.device_id = w.device_id AND s.item_no = w.item_no
   WHERE over IS NULL AND NOT x.locked AND x.{back} IS DISTINCT FROM w.item_no AND b.{back} IS DISTINCT FROM near AND (h.item_no IS NULL OR {GAP.format(a="x", b="b")} < {GAP.format(a="x", b="h")})))"""


#: Every 4th item lasts 1,500 s longer, every 11th is locked.
HEAL = ITEMS + f""", base0 AS (SELECT device_id, item_no, start_t, end_t + CASE WHEN item_no % 4 = 0 THEN 1500 ELSE 0 END AS end_t, is_visit, item_no % 11 = 0 AS locked, item_no % 7 = 0 AS gone, CASE WHEN item_no % 5 <> 0 THEN lag(item_no) OVER o END AS previous, CASE WHEN item_no % 6 <> 0 THEN lead(item_no) OVER o END AS next,
  item_no = max(item_no) OVER (PARTITION BY device_id) AS current FROM items WINDOW o AS (PARTITION BY device_id ORDER BY item_no)),
 told AS (SELECT * EXCLUDE (previous, next), CASE WHEN previous % 7 <> 0 THEN previous END AS previous, CASE WHEN next % 7 <> 0 THEN next END AS next FROM base0 WHERE NOT gone),
 broken AS (SELECT * FROM (SELECT *, previous IS NULL AS no_previous, next IS NULL AND NOT current AS no_next FROM told WHERE NOT locked) WHERE no_previous OR no_next),
 op AS (SELECT b.device_id, b.item_no, arg_min(i.item_no, (i.start_t, i.item_no)) AS over FROM broken b JOIN told i ON i.device_id = b.device_id AND i.item_no <> b.item_no AND NOT i.locked AND i.is_visit = b.is_visit AND i.start_t < b.start_t AND i.end_t > b.start_t WHERE no_previous GROUP BY ALL),
 ox AS (SELECT b.device_id, b.item_no, arg_min(i.item_no, (i.start_t, i.item_no)) AS over FROM broken b JOIN told i ON i.device_id = b.device_id AND i.item_no <> b.item_no AND NOT i.locked AND i.is_visit = b.is_visit AND i.start_t < b.end_t AND i.end_t > b.end_t WHERE no_next GROUP BY ALL),
 hold AS (SELECT b.device_id, b.item_no, arg_min(i.item_no, (i.start_t, i.item_no)) AS holder FROM broken b JOIN told i ON i.device_id = b.device_id AND i.item_no <> b.item_no AND NOT i.locked AND i.start_t <= b.start_t AND i.end_t >= b.end_t GROUP BY ALL),
 spans AS (SELECT b.device_id, b.item_no, coalesce(op.over, ox.over) AS over, holder FROM broken b LEFT JOIN op USING (device_id, item_no) LEFT JOIN ox USING (device_id, item_no) LEFT JOIN hold USING (device_id, item_no)),
 {_wishes("previous", "next", "start_t", "end_t")}, {_wishes("next", "previous", "end_t", "start_t")}
 SELECT b.device_id, b.item_no, CASE WHEN s.over IS NOT NULL THEN s.over WHEN no_previous AND no_next AND p.near IS NULL AND x.near IS NULL THEN holder END AS absorbed_by, coalesce(b.previous, p.near) AS previous, coalesce(b.next, x.near) AS next
 FROM broken b JOIN spans s USING (device_id, item_no) LEFT JOIN (SELECT * FROM w_previous WHERE wr = 1) p USING (device_id, item_no) LEFT JOIN (SELECT * FROM w_next WHERE wr = 1) x USING (device_id, item_no)"""


@query("tl16", HEAL)
def tl16(spark, sf):
    """Broken edges healed; in the fixture, links are missing or lead to deleted items, every 4th item lasts longer, every 11th is locked."""
    x = linked(spark, sf).withColumn("end_t", F.col("end_t") + F.when(F.col("item_no") % 4 == 0, 1500).otherwise(0))
    return editing.healed(x.withColumn("locked", F.col("item_no") % 11 == 0))
