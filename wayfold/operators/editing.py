"""Edits of a timeline: neighbourhoods, samples that change sides at edges, deletion into a neighbour, extraction of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import items as I
from wayfold.operators import joins, merging
from wayfold.operators.tables import Scratch, staged
from wayfold.schemas import LIMITS, Thresholds

KEYS = merging.KEYS


def neighbourhoods(items: DataFrame, most: int = 9) -> DataFrame:
    """How many items before and after each are processed with it: back to the second keeper, on to the second keeper or ``most`` items in all."""
    o = W.partitionBy("device_id").orderBy("start_t", "item_no")
    back = W.partitionBy("device_id").orderBy(F.desc("start_t"), F.desc("item_no"))
    # a window in the opposite order looks ahead with a running value instead of a sum over the rest at each row
    before, after = o.rowsBetween(W.unboundedPreceding, -1), back.rowsBetween(W.unboundedPreceding, -1)
    x = items.select(*KEYS, "start_t", "keeper").withColumns({"pos": F.row_number().over(o), "n": F.count(F.lit(1)).over(W.partitionBy("device_id"))})
    x = x.withColumns({"b1": F.max(F.when(F.col("keeper"), F.col("pos"))).over(before), "a1": F.min(F.when(F.col("keeper"), F.col("pos"))).over(after)})
    x = x.withColumns({"b2": F.max(F.when(F.col("keeper"), F.col("b1"))).over(before), "a2": F.min(F.when(F.col("keeper"), F.col("a1"))).over(after)})
    n_before = F.col("pos") - F.coalesce("b2", F.lit(1))
    n_after = F.least(F.coalesce("a2", "n") - F.col("pos"), F.greatest(F.lit(0), most - 1 - n_before))
    return x.select(*KEYS, n_before.cast("long").alias("n_before"), n_after.cast("long").alias("n_after"))


def safe_deletes(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """For each item of facts(): the merge (k, b, d, score) by which it is deleted, the best of four, be it an impossible one of score 0.

    Its neighbours may merge over it, either way, or one of them takes it; ties go in that order. An item without neighbours has none.
    ``samples`` of the items tell what lies inside visits.
    """
    o = W.partitionBy("device_id").orderBy("start_t", "item_no")
    s = rows.select("device_id", "start_t", "item_no", merging.as_struct("w"))
    s = s.select("device_id", "item_no", "w", F.lag("w").over(o).alias("p"), F.lead("w").over(o).alias("n"))
    w, p, n = F.col("w"), F.col("p"), F.col("n")
    nobody = F.lit(None).cast("long")

    def way(number: int, when: Column, keeper: Column, between: Column, dead: Column) -> Column:
        return F.when(when, F.struct(F.lit(number).alias("way"), keeper.alias("keeper"), between.alias("b"), dead.alias("deadman")))

    both = p.isNotNull() & n.isNotNull()
    ways = [way(0, both, n, w["item_no"], p), way(1, both, p, w["item_no"], n), way(2, p.isNotNull(), p, nobody, w), way(3, n.isNotNull(), n, nobody, w)]
    s = s.select("device_id", "item_no", F.explode(F.array_compact(F.array(*ways))).alias("m")).select("device_id", "item_no", "m.*")
    s = merging.with_inside(s, samples, "keeper", "deadman").withColumn("score", merging.consumption(F.col("keeper"), F.col("deadman"), inside=F.col("inside")))
    made = F.struct(F.col("keeper.item_no").alias("k"), "b", F.col("deadman.item_no").alias("d"), "score")
    return s.groupBy("device_id", "item_no").agg(F.min_by(made, F.struct(-F.col("score"), "way")).alias("m")).select("device_id", "item_no", "m.*")


def tips(samples: DataFrame) -> DataFrame:
    """Each item's two outermost samples at either end: (head.e, head.next) and (tail.e, tail.next); of a single one, next is null.

    ``samples`` may have a column ``moved``: samples that changed sides already.
    """
    return _beside(samples).groupBy(*KEYS).agg(*_tips())


def _beside(samples: DataFrame) -> DataFrame:
    """Samples as ``e``, with those before and after each in its item."""
    moved = F.col("moved") if "moved" in samples.columns else F.lit(False)
    ok = geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))
    e = F.struct("sample_id", "t", ok.alias("ok"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), "speed", F.coalesce("confirmed_type", "classified_type").alias("kind"), moved.alias("moved"))
    o = W.partitionBy(*KEYS).orderBy(*I.BY_TIME)
    return samples.withColumn("e", e).withColumns({"after": F.lead("e").over(o), "before": F.lag("e").over(o)})


def _tips() -> list[Column]:
    at = F.struct(*I.BY_TIME)
    return [F.min_by(F.struct("e", F.col("after").alias("next")), at).alias("head"), F.max_by(F.struct("e", F.col("before").alias("next")), at).alias("tail")]


def edge_moves(rows: DataFrame, ends: DataFrame | None = None, limits: Thresholds = LIMITS) -> DataFrame:
    """(device_id, sample_id, t, from_no, from_n, to_no, to_visit, paths) of samples that neighbouring items would hand over: at most one an edge.

    A visit takes the path's outermost sample if that and the next lie inside its radius, and gives its own, if near the next in
    time, where the path's lies outside. A path takes the outermost sample of a path of another type if that sample is of its own
    type and both are on one side of the speed that parts walking from riding; the earlier path comes first. Gaps, items too far
    apart, missing places and paths of few samples (towards visits) leave an edge as it is. Moved samples stay where they are.
    ``ends`` are tips(), which ``rows`` may have by themselves.
    """
    x = rows if ends is None else rows.join(ends, KEYS)
    o = W.partitionBy("device_id").orderBy("start_t", "item_no")
    x = x.select("device_id", "start_t", "item_no", F.struct(*merging.FACTS, "head", "tail").alias("a"))
    x = x.withColumn("b", F.lead("a").over(o)).filter("b is not null and not a.is_gap and not b.is_gap and not (a.is_visit and b.is_visit)")
    a, b = F.col("a"), F.col("b")
    x = x.filter(merging.within_mergeable(a, b) & (merging.time_gap(a, b) < limits.edge_gap_s))
    ok = lambda *es: F.coalesce(*[F.array_min(F.array(*[F.coalesce(e["ok"], F.lit(False)) for e in es]))])

    def move(e: Column, giver: Column, taker: Column) -> Column:
        return F.struct(e["sample_id"].alias("sample_id"), e["t"].alias("t"), giver["item_no"].alias("from_no"), giver["n_samples"].alias("from_n"), taker["item_no"].alias("to_no"), taker["is_visit"].alias("to_visit"))

    def by_visit(v: Column, ve: Column, p: Column, pe: Column) -> Column:
        inside = lambda e: geo.within(geo.distance(v["latitude"], v["longitude"], e["lat"], e["lng"]), v["radius1sd"])
        take = inside(pe["e"]) & inside(pe["next"]) & ~pe["e"]["moved"]
        give = ~inside(pe["e"]) & (F.abs(ve["e"]["t"] - ve["next"]["t"]) <= 120) & ~ve["e"]["moved"]
        fit = ok(ve["e"], ve["next"], pe["e"], pe["next"]) & (p["n_samples"] > limits.path_valid_samples)
        return F.when(fit, F.when(take, move(pe["e"], p, v)).when(give, move(ve["e"], v, p)))

    ea, eb = a["tail"], b["head"]
    slow = lambda e: e["speed"] < limits.mode_shift_kmh / 3.6
    takes = lambda e, kind: (e["kind"] == kind) & ~e["moved"]
    alike = ok(ea["e"], eb["e"]) & (a["kind"] != b["kind"]) & (slow(ea["e"]) == slow(eb["e"]))
    by_path = F.when(alike, F.when(takes(eb["e"], a["kind"]), move(eb["e"], b, a)).when(takes(ea["e"], b["kind"]), move(ea["e"], a, b)))
    m = F.when(a["is_visit"], by_visit(a, ea, b, eb)).when(b["is_visit"], by_visit(b, eb, a, ea)).otherwise(by_path)
    return x.select("device_id", m.alias("m"), (~a["is_visit"] & ~b["is_visit"]).alias("paths")).filter("m is not null").select("device_id", "m.*", "paths")


def sanitise_edges(samples: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Samples with the items they are in after edge_moves() were made, at all edges together, until none is left.

    A sample moves once, so it ends. A path that would fall to ``path_valid_samples`` or less by losing one at both ends loses the earlier alone.
    """
    s = samples.withColumns({"kind_visit": F.first(~I.moving()).over(W.partitionBy(*KEYS).orderBy(*I.BY_TIME)), "moved": F.lit(False)})
    scratch = Scratch(samples.sparkSession)
    whole = s = scratch.dealt(s, "edges", "device_id")
    made = None
    while True:
        plain = s.withColumn("moving_state", F.when(F.col("kind_visit"), "stationary").otherwise("moving"))
        moves = edge_moves(merging.told(_beside(plain), limits, None, *_tips()), limits=limits)
        first = F.row_number().over(W.partitionBy("device_id", "from_no").orderBy("t", "sample_id", "to_no"))
        moves = moves.withColumn("i", first).filter((F.col("i") == 1) | (F.col("from_n") > limits.path_valid_samples + 1))
        moves = scratch.staged(moves.dropDuplicates(["device_id", "sample_id"]).select("device_id", "sample_id", "to_no", "to_visit"), "moves")
        n = moves.count()
        if not n:
            return whole if made is None else _moved(whole, made)
        # a sample moves once, so what moved is a table to add to; a device in which nothing moved is done
        made = moves if made is None else scratch.staged(made.unionByName(moves), "made")
        few = merging.handed(moves, n)
        s = scratch.dealt(_moved(s.join(few.select("device_id").distinct(), "device_id", "left_semi"), few), "edges", "device_id")
        scratch.drop(but=(whole, s, made))  # the round before


def _moved(samples: DataFrame, moves: DataFrame) -> DataFrame:
    """Samples where ``moves`` (device_id, sample_id, to_no, to_visit) put them; their kind is that of the taker."""
    s = samples.join(moves, ["device_id", "sample_id"], "left")
    now = {"item_no": F.coalesce("to_no", "item_no"), "kind_visit": F.coalesce("to_visit", "kind_visit"), "moved": F.col("moved") | F.col("to_no").isNotNull()}
    return s.withColumns(now).drop("to_no", "to_visit")


def extracted(samples: DataFrame, segments: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """Numbered samples with the items after ``segments`` (device_id, seg_no, a_start, a_end, to_visit) became items of their own.

    Samples in a segment's closed range, from whatever items, are one item, a visit or a path as the segment says; what an item
    has before and after becomes two. Segments of a device mustn't overlap. One that overlaps a ``locked`` item
    (device_id, b_start, b_end) is left out. Numbers run anew by time.
    """
    if locked is not None:
        held = joins.overlaps(segments, locked).select("device_id", "seg_no").distinct()
        segments = segments.join(held, ["device_id", "seg_no"], "left_anti")
    s = samples.withColumn("kind_visit", F.first(~I.moving()).over(W.partitionBy(*KEYS).orderBy(*I.BY_TIME)))
    s = joins.points_in_intervals(s, segments, start="a_start", end="a_end", how="left")
    s = I.islands(s, I.per_device(), "_new", F.col("seg_no"), F.when(F.col("seg_no").isNull(), F.col("item_no")))
    return s.withColumns({"item_no": F.col("_new"), "kind_visit": F.coalesce("to_visit", "kind_visit")}).drop("_new", "seg_no", "a_start", "a_end", "to_visit")


def paths_between(samples: DataFrame) -> DataFrame:
    """Segments for extracted(): between visits that follow each other, the next one's first run of one type, if not stationary, else the other's last.

    ``samples`` have an ``activity_type``; (device_id, seg_no, a_start, a_end, to_visit), seg_no being the next visit's number.
    """
    runs = I.islands(samples, W.partitionBy(*KEYS).orderBy(*I.BY_TIME), "run", F.col("activity_type"))
    r = runs.groupBy(*KEYS, "run").agg(F.min("t").alias("a_start"), F.max("t").alias("a_end"), F.first("activity_type").alias("kind"))
    at = F.struct("a_start", "a_end", "kind")
    ends = r.groupBy(*KEYS).agg(F.min_by(at, "run").alias("first"), F.max_by(at, "run").alias("last"), F.min("a_start").alias("start_t"))
    visit = samples.groupBy(*KEYS).agg(F.min_by(~I.moving(), F.struct(*I.BY_TIME)).alias("is_visit"))
    o = W.partitionBy("device_id").orderBy("start_t", "item_no")
    x = ends.join(visit, KEYS)
    x = x.withColumn("before", F.lag(F.struct("is_visit", "last")).over(o)).filter("is_visit and before.is_visit")
    path = lambda c: ~c["kind"].eqNullSafe("stationary")
    x = x.withColumn("s", F.when(path(F.col("first")), F.col("first")).when(path(F.col("before.last")), F.col("before.last"))).filter("s is not null")
    return x.select("device_id", F.col("item_no").alias("seg_no"), "s.a_start", "s.a_end", F.lit(False).alias("to_visit"))


def _near(items: DataFrame, edges: DataFrame, t: str) -> DataFrame:
    """(device_id, item_no, near): of each edge (device_id, item_no, at) the other item whose time ``t`` is nearest; the earlier of two, then the lesser number."""
    w = W.partitionBy("device_id")
    rising, falling = ("at", F.col("r").isNull(), F.desc("item_no")), (F.desc("at"), F.col("r").isNull(), F.desc("item_no"))
    one = items.select("device_id", F.col(t).alias("at"), "item_no").withColumn("r", F.struct("at", "item_no"))
    # an item isn't near itself: its neighbour in this order stands in
    one = one.withColumn("r", F.struct("r.*", F.lag("r").over(w.orderBy(*rising)).alias("prior"), F.lag("r").over(w.orderBy(*falling)).alias("later")))
    both = one.unionByName(edges.withColumn("r", F.lit(None).cast(one.schema["r"].dataType)))
    up, down = (w.orderBy(*by).rowsBetween(W.unboundedPreceding, 0) for by in (rising, falling))
    both = both.withColumns({"b": F.last("r", True).over(up), "a": F.last("r", True).over(down)}).filter("r is null")
    other = lambda c, side: F.when(c["item_no"] == F.col("item_no"), c[side]).otherwise(F.struct(c["at"].alias("at"), c["item_no"].alias("item_no")))
    b, a = other(F.col("b"), "prior"), other(F.col("a"), "later")
    # a struct of nulls isn't null: whether there is one, its time tells
    nearer = b["at"].isNotNull() & (a["at"].isNull() | (F.col("at") - b["at"] <= a["at"] - F.col("at")))
    return both.select("device_id", "item_no", F.when(nearer, b["item_no"]).otherwise(a["item_no"]).alias("near"))


def healed(items: DataFrame) -> DataFrame:
    """What becomes of items with broken edges: (device_id, item_no, absorbed_by, previous, next), a row each.

    ``items`` have device_id, item_no, start_t, end_t, is_visit, previous, next, current, gone and locked. An edge is broken if it
    leads to no live item; that of the current item ahead isn't. At a broken edge, an item of the same kind that spans the edge's
    time absorbs the item; else the item nearest to it is linked, if it isn't linked to this one already and has no live item on
    that side or one that is farther. Of several that want one side, the nearest gets it, then the lesser number. An item whose
    edges both stay broken is absorbed by one that contains it. Locked items stay as they are. All edges are judged as they were before.
    """
    alive = staged(items.filter("not gone").select(*KEYS, "start_t", "end_t", "is_visit", "locked", "current", "previous", "next"), "alive")  # read a dozen times below
    told = alive.select("device_id", "item_no", "start_t", "end_t", "is_visit", "locked", "current", "previous", "next")
    for side in ("previous", "next"):  # a link to a dead item is none
        seen = alive.select("device_id", F.col("item_no").alias(side), F.struct("start_t", "end_t").alias(f"{side}_at"))
        told = told.join(seen, ["device_id", side], "left").withColumn(side, F.when(F.col(f"{side}_at").isNotNull(), F.col(side)))
    told = staged(told, "told")
    broken = told.filter("not locked").withColumns({"no_previous": F.col("previous").isNull(), "no_next": F.col("next").isNull() & ~F.col("current")}).filter("no_previous or no_next")
    takers = told.filter("not locked").select("device_id", F.col("item_no").alias("taker"), F.col("is_visit").alias("kind"), "start_t", "end_t")
    least = F.min(F.struct(F.col("taker_start"), "taker"))["taker"]

    def spanning(b: DataFrame, t: str, keep: Column, strict: bool, name: str) -> DataFrame:
        b = b.select("device_id", "item_no", "is_visit", F.col("start_t").alias("s"), F.col("end_t").alias("e"))
        found = joins.points_in_intervals(b, takers, t=t, strict=strict).filter(keep & (F.col("taker") != F.col("item_no"))).withColumn("taker_start", F.col("start_t"))
        return found.groupBy("device_id", "item_no").agg(least.alias(name))

    same = F.col("kind") == F.col("is_visit")
    x = broken.join(spanning(broken.filter("no_previous"), "s", same, True, "over_previous"), KEYS, "left")
    x = x.join(spanning(broken.filter("no_next"), "e", same, True, "over_next"), KEYS, "left")
    x = x.join(spanning(broken, "s", F.col("end_t") >= F.col("e"), False, "holder"), KEYS, "left")
    gap = lambda a, b: F.abs(F.greatest(a["start_t"], b["start_t"]) - F.least(a["end_t"], b["end_t"]))
    me = F.struct("start_t", "end_t")
    for side, back, own, theirs in (("previous", "next", "start_t", "end_t"), ("next", "previous", "end_t", "start_t")):
        edges = broken.filter(f"no_{side}").select("device_id", F.col(own).alias("at"), "item_no")
        near = told.select("device_id", F.col("item_no").alias("near"), F.struct("start_t", "end_t").alias("it"), F.col("locked").alias("shut"), F.col(back).alias("has"), F.col(f"{back}_at").alias("has_at"))
        wish = x.filter(F.col("over_previous").isNull() & F.col("over_next").isNull()).select(*KEYS, me.alias("me"), F.col(back).alias("mine"))
        wish = wish.join(_near(alive, edges, theirs), KEYS).join(near, ["device_id", "near"]).withColumn("gap", gap(F.col("it"), F.col("me")))
        free = F.col("has").isNull() | (F.col("gap") < gap(F.col("it"), F.col("has_at")))
        wish = wish.filter(~F.col("shut") & ~F.col("has").eqNullSafe(F.col("item_no")) & ~F.col("mine").eqNullSafe(F.col("near")) & free)
        won = wish.groupBy("device_id", "near").agg(F.min(F.struct("gap", "item_no"))["item_no"].alias("item_no"))
        x = x.join(won.select(*KEYS, F.col("near").alias(f"{side}_found")), KEYS, "left")
    absorbed = F.coalesce("over_previous", "over_next")
    lost = F.col("no_previous") & F.col("no_next") & F.col("previous_found").isNull() & F.col("next_found").isNull()
    absorbed = F.when(absorbed.isNull() & lost, F.col("holder")).otherwise(absorbed)
    return x.select(*KEYS, absorbed.alias("absorbed_by"), F.coalesce("previous", "previous_found").alias("previous"), F.coalesce("next", "next_found").alias("next"))
