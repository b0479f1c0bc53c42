"""Merging neighbouring items: distances, candidates, scores, and rounds of merges until none is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import items as I
from wayfold.operators.tables import Scratch
from wayfold.schemas import LIMITS, Thresholds

KEYS = ["device_id", "item_no"]


def type_score(score: Column) -> Column:
    """How well a path fits another's type, from 5 to 1, by thousandths of a classifier's score."""
    n = F.floor(score * 1000)
    return F.when(n >= 75, 5).when(n >= 50, 4).when(n >= 25, 3).when(n >= 10, 2).otherwise(1)


def facts(items: DataFrame, samples: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Items with what merging looks at: mode types, edge places, speed and the 1 sd radius."""
    s = samples.withColumn("activity_type", F.coalesce("confirmed_type", "classified_type"))
    ok = geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))
    place = F.struct(ok.alias("ok"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    ends = s.groupBy(*KEYS).agg(F.min_by(place, F.struct("t", "sample_id")).alias("first"), F.max_by(place, F.struct("t", "sample_id")).alias("last"))
    mode = I.mode_type(s, *KEYS).join(I.mode_type(s.filter("not activity_type <=> 'stationary'"), *KEYS, name="mode_moving"), KEYS, "left")
    return _looked_at(items.join(ends, KEYS).join(mode, KEYS), limits)


def _looked_at(rows: DataFrame, limits: Thresholds) -> DataFrame:
    mps = F.when(F.col("duration") > 0, F.col("distance") / F.col("duration")).otherwise(0.0)
    return rows.withColumns(
        {
            "kind": F.coalesce("mode_moving", "mode_type"),
            "mps": mps,
            "radius1sd": geo.clamp(F.col("radius_mean") + F.col("radius_sd"), limits.radius_min_m, limits.radius_max_m),
            "nolo": ~F.col("is_gap") & (F.col("n_usable") == 0),
        }
    )


#: What told() reads of samples.
SAMPLE = ["sample_id", *KEYS, "t", "latitude", "longitude", "h_acc", "moving_state", "recording_state", "confirmed_type", "classified_type"]


def told(samples: DataFrame, limits: Thresholds = LIMITS, following: str | None = None, *also: Column) -> DataFrame:
    """facts() of summarize() in one pass: windows and sums by item, all on one dealing out of the samples, or on none if they are dealt out by device or item.

    ``also`` are further aggregates of an item's samples.
    """
    s = samples.withColumns({"_ok": geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")), "_kind": F.coalesce("confirmed_type", "classified_type"), "_still": ~I.moving()})
    o = W.partitionBy(*KEYS).orderBy(*I.BY_TIME)
    whole = o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    usable = lambda x: F.when(F.col("_ok"), x)
    place = F.struct(F.col("_ok").alias("ok"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    before = F.last(usable(place), True).over(o.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumns({"_worst": F.max(usable(F.col("h_acc"))).over(whole), "_n": F.count(usable(F.lit(1))).over(whole), "_before": before})
    weight = (1 - F.col("h_acc") / (F.col("_worst") + 1)) * F.when(F.col("_kind") == "stationary", 3.0).otherwise(1.0)
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    total = lambda x: F.sum(usable(x)).over(whole)
    s = s.withColumns({"_w": total(weight), "_x": total(weight * x), "_y": total(weight * y), "_z": total(weight * z)})
    mean = {c: F.col(c) / F.col("_w") for c in ("_x", "_y", "_z")}
    s = s.withColumns({"_lat": F.when(F.col("_n") > 1, geo.lat_of(*mean.values())), "_lng": F.when(F.col("_n") > 1, geo.lng_of(mean["_x"], mean["_y"]))})
    here = (F.col("latitude"), F.col("longitude"))
    s = s.withColumns({"_d": usable(geo.distance(*here, F.col("_lat"), F.col("_lng"))), "_step": usable(F.coalesce(geo.distance(F.col("_before.lat"), F.col("_before.lng"), *here), F.lit(0.0)))})
    # the order of types comes last, so that the items' own comes first and deals out
    s = s.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy(*KEYS, "_kind")))
    at, often = F.struct(*I.BY_TIME), F.struct("_same", -F.coalesce(I.type_rank(F.col("_kind")), F.lit(1000)))
    one = F.first("_n") == 1
    items = s.groupBy(*KEYS).agg(
        F.min("t").alias("start_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_samples"),
        F.min_by(~F.col("_still"), at).alias("_moving"), F.bool_and(F.col("recording_state") == "off").alias("_off"),
        *([] if following is None else [F.first(following).alias("_next")]),
        F.first("_n").alias("n_usable"),
        F.when(one, F.max(usable(F.col("latitude")))).otherwise(F.first("_lat")).alias("latitude"),
        F.when(one, F.max(usable(F.col("longitude")))).otherwise(F.first("_lng")).alias("longitude"),
        F.when(one, F.first("_worst")).otherwise(F.avg("_d")).alias("radius_mean"), F.when(one, 0.0).otherwise(F.stddev_pop("_d")).alias("radius_sd"), F.sum("_step").alias("distance"),
        F.min_by(place, at).alias("first"), F.max_by(place, at).alias("last"),
        F.max_by("_kind", often).alias("mode_type"), F.max_by("_kind", F.when(~F.col("_kind").eqNullSafe("stationary"), often)).alias("mode_moving"), *also,
    )
    start = F.lead("start_t").over(W.partitionBy("device_id").orderBy("item_no")) if following is None else F.col("_next")
    return _looked_at(I.completed(items, start, limits), limits)


FACTS = ["item_no", "start_t", "end_t", "n_samples", "is_visit", "is_gap", "nolo", "valid", "keeper", "keepness", "duration", "distance", "latitude", "longitude", "radius1sd", "first", "last", "kind", "mps"]


def as_struct(name: str) -> Column:
    return F.struct(*FACTS).alias(name)


def time_gap(a: Column, b: Column) -> Column:
    """Seconds between two items; negative if they overlap, 0 if they touch."""
    return (F.greatest(a["start_t"], b["start_t"]) - F.least(a["end_t"], b["end_t"])).cast("double")


def item_distance(a: Column, b: Column) -> Column:
    """Metres between two items; null where a place is missing. The earlier item's end faces the later one's start."""
    earlier = a["start_t"] < b["start_t"]
    edge = lambda x, first: F.when(first, x["last"]).otherwise(x["first"])
    ea, eb = edge(a, earlier), edge(b, ~earlier)
    path_path = geo.distance(ea["lat"], ea["lng"], eb["lat"], eb["lng"])
    visit_path = lambda v, e: F.when(e["ok"], geo.distance(v["latitude"], v["longitude"], e["lat"], e["lng"]) - v["radius1sd"])
    visit_visit = geo.distance(a["latitude"], a["longitude"], b["latitude"], b["longitude"]) - a["radius1sd"] - b["radius1sd"]
    return F.when(a["is_visit"] & b["is_visit"], visit_visit).when(a["is_visit"], visit_path(a, eb)).when(b["is_visit"], visit_path(b, ea)).otherwise(path_path)


def max_mergeable(a: Column, b: Column) -> Column:
    """How far two items may lie apart: mean speed times gap times 4, at least 150 m by a visit, any distance for two visits."""
    gap = time_gap(a, b)
    fast = lambda x: F.when(x["mps"] > 0, x["mps"])
    n = F.when(a["mps"] > 0, 1).otherwise(0) + F.when(b["mps"] > 0, 1).otherwise(0)
    mean = F.when(n == 0, 0.0).otherwise((F.coalesce(fast(a), F.lit(0.0)) + F.coalesce(fast(b), F.lit(0.0))) / n)
    path = F.when(a["is_visit"], b["mps"]).otherwise(a["mps"])
    return F.when(a["is_visit"] & b["is_visit"], F.lit(1.7976931348623157e308)).when(a["is_visit"] | b["is_visit"], F.greatest(path * gap * 4, F.lit(150.0))).otherwise(mean * gap * 4)


def within_mergeable(a: Column, b: Column) -> Column:
    """Only items that overlap in time can be too far apart."""
    near = F.coalesce(item_distance(a, b) <= max_mergeable(a, b), F.lit(False))
    return a["nolo"] | b["nolo"] | near | (time_gap(a, b) >= 0)


def consumption(a: Column, b: Column, inside: Column | None = None, fit: Column | None = None) -> Column:
    """Score from 0 (impossible) to 5 of item ``a`` taking item ``b``.

    ``inside``: b's share inside a, for a visit and a path. ``fit``: the classifier's score of b for a's type, null if it
    has none; without it, paths of differing types don't merge.
    """
    overlap = F.coalesce(item_distance(a, b) < 0, F.lit(False))
    # sums of metres may differ in their last digits by the order they are added in
    all_inside = F.lit(False) if inside is None else F.coalesce(F.floor(F.round(inside * 10, 9)) == 10, F.lit(False))
    path_visit = F.when(b["keeper"], 0).when(a["keeper"], F.when(~b["valid"], 3).otherwise(2)).otherwise(F.when(~b["valid"], 2).otherwise(1))
    path_path = F.when(a["kind"].isNull() & b["kind"].isNull(), 3).when(a["kind"].eqNullSafe(b["kind"]), 5).otherwise(
        0 if fit is None else F.when(b["keeper"] | a["kind"].isNull() | fit.isNull(), 0).otherwise(type_score(fit))
    )
    visit = F.when(b["is_visit"], F.when(overlap, F.when(a["duration"] > b["duration"], 5).otherwise(4)).otherwise(0)).otherwise(
        F.when(a["valid"] & ~b["valid"], F.when(all_inside, 2).otherwise(1)).otherwise(0)
    )
    return (
        F.when(a["is_gap"], F.when(b["is_gap"], 5).otherwise(0))
        .when(b["is_gap"], F.when(~b["valid"], 3).otherwise(0))
        .when(a["nolo"], F.when(b["nolo"], 5).otherwise(0))
        .when(b["nolo"] & ~b["valid"], 3)
        .when(~within_mergeable(a, b), 0)
        .when(a["is_visit"], visit)
        .when(~a["valid"], F.when(~b["valid"], 1).otherwise(0))
        .when(b["is_visit"], path_visit)
        .otherwise(path_path)
    )


def root_score(score: Column, *, locked: Column, consumer_deleted: Column, consumee_empty: Column, consumer_empty: Column) -> Column:
    """What comes before any consumption() score: locked items and deleted or empty consumers take nothing, an empty item is taken at once."""
    return F.when(locked | consumer_deleted, 0).when(consumee_empty, 5).when(consumer_empty, 0).otherwise(score)


def _proposed(rows: DataFrame, *fields: Column) -> DataFrame:
    """(device_id, keeper, b, deadman), two items as structs of ``fields`` and the number of the one between: neighbours both ways, and over a lesser item both ways.

    Each is proposed by the earlier of its items alone, so that none comes twice; one over a lesser item is also the bridge that this item would propose.
    """
    o = W.partitionBy("device_id").orderBy("start_t", "item_no")
    s = rows.select("device_id", "start_t", "item_no", F.struct(*fields).alias("w"))
    s = s.select("device_id", "w", F.lead("w", 1).over(o).alias("x"), F.lead("w", 2).over(o).alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")

    def m(when: Column, keeper: Column, between: Column, dead: Column) -> Column:
        return F.when(when, F.struct(keeper.alias("keeper"), between.alias("b"), dead.alias("deadman")))

    nobody = F.lit(None).cast("long")
    beyond = y.isNotNull() & ~w["is_gap"] & (x["keepness"] < w["keepness"]) & ~y["is_gap"] & (y["keepness"] > x["keepness"])
    made = [m(x.isNotNull(), w, nobody, x), m(x.isNotNull(), x, nobody, w), m(beyond, w, x["item_no"], y), m(beyond, y, x["item_no"], w)]
    return s.select("device_id", F.inline(F.array_compact(F.array(*made))))


def candidates(rows: DataFrame) -> DataFrame:
    """(device_id, k, b, d), keeper, betweener and deadman: neighbours both ways, two steps over a lesser item, and bridges."""
    c = _proposed(rows, *map(F.col, ("item_no", "keepness", "is_gap")))
    return c.select("device_id", F.col("keeper.item_no").alias("k"), "b", F.col("deadman.item_no").alias("d"))


def with_inside(pairs: DataFrame, samples: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with ``inside``: how much of path ``b`` lies in the circle of visit ``a``, the mean of its shares of samples, time and metres.

    Worked out where it decides a score: for a valid visit and a path that isn't, so few samples are met again. Null elsewhere, and where none lies inside.
    """
    v, p = F.col(a), F.col(b)
    ids = ["device_id", "_a", "_b"]
    named = pairs.withColumns({"_a": v["item_no"], "_b": p["item_no"]})
    circle = F.struct(v["latitude"].alias("lat"), v["longitude"].alias("lng"), v["radius1sd"].alias("r"), *[p[c].alias(c) for c in ("n_samples", "duration", "distance")]).alias("c")
    may = F.coalesce(v["is_visit"] & v["valid"] & ~p["is_visit"] & ~p["valid"], F.lit(False))
    asked = named.filter(may).select(*ids, circle).dropDuplicates(ids)
    ok = geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))
    near = geo.within(geo.distance(F.col("latitude"), F.col("longitude"), F.col("c.lat"), F.col("c.lng")), F.col("c.r"))
    x = samples.filter(ok).select("device_id", F.col("item_no").alias("_b"), "t", "sample_id", "latitude", "longitude", "h_acc").join(asked, ["device_id", "_b"]).filter(near)
    o = W.partitionBy(*ids).orderBy("t", "sample_id")
    step = geo.distance(F.lag("latitude").over(o), F.lag("longitude").over(o), F.col("latitude"), F.col("longitude"))
    g = x.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("s"), F.sum("_d").alias("m"), F.first("c").alias("c"))
    part = lambda x, whole: F.when(whole > 0, x / whole).otherwise(0.0)
    share = (part(F.col("n"), F.col("c.n_samples")) + part(F.col("s"), F.col("c.duration")) + part(F.col("m"), F.col("c.distance"))) / 3
    # pairs are wide: only those that are asked for meet the shares
    met = named.filter(may).join(g.select(*ids, share.alias("inside")), ids, "left")
    return met.unionByName(named.filter(~may).withColumn("inside", F.lit(None).cast("double"))).drop("_a", "_b")


def with_fit(pairs: DataFrame, fits: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with ``fit``: the mean score that ``fits`` (device_id, item_no, name, fit) give item ``b`` for the type of ``a``."""
    f = fits.select("device_id", F.col("item_no").alias("_b"), F.col("name").alias("_kind"), "fit")
    return pairs.withColumns({"_b": F.col(f"{b}.item_no"), "_kind": F.col(f"{a}.kind")}).join(f, ["device_id", "_b", "_kind"], "left").drop("_b", "_kind")


def scored(rows: DataFrame, samples: DataFrame | None = None, fits: DataFrame | None = None, score=consumption) -> DataFrame:
    """Candidates of facts() with their scores. ``samples`` of the items tell what lies inside visits, ``fits`` how paths of differing types fit.

    ``score`` is a hook: a function of (keeper, deadman, inside=, fit=) that gives another score column.
    """
    c = _proposed(rows, *map(F.col, FACTS)).withColumns({"k": F.col("keeper.item_no"), "d": F.col("deadman.item_no")})
    if samples is not None:
        c = with_inside(c, samples, "keeper", "deadman")
    if fits is not None:
        c = with_fit(c, fits, "keeper", "deadman")
    given = {"inside": None if samples is None else F.col("inside"), "fit": None if fits is None else F.col("fit")}
    told = {"score": score(F.col("keeper"), F.col("deadman"), **given), "gap": F.abs(time_gap(F.col("keeper"), F.col("deadman"))), "start": F.col("keeper.start_t"), "visit": F.col("keeper.is_visit")}
    return c.withColumns(told)


def ranked(scores: DataFrame) -> DataFrame:
    """Possible merges as (device_id, k, b, d, score, rank, visit): the rank settles which is better, visit is the keeper's kind.

    Order: score, smallest gap, a hash of the items, the keeper's start, ids. In a round many merges that don't touch each other
    are made at once: by the hash also within a run of items whose merges are all alike, which start times would let merge only from one end.
    """
    items = F.xxhash64(F.least("k", "d"), F.greatest("k", "d"), F.col("b"))
    rank = F.struct((-F.col("score")).alias("s"), F.col("gap").alias("g"), items.alias("h"), F.col("start").alias("t"), "k", "d")
    return scores.filter("score > 0").select("device_id", "k", "b", "d", "score", rank.alias("rank"), "visit")


def chosen(ranks: DataFrame) -> DataFrame:
    """Of a device's possible merges, those that are better than every other that shares an item with them."""
    touched = ranks.repartition("device_id").withColumn("i", F.explode(F.array_compact(F.array("k", "b", "d"))))
    best = F.min("rank").over(W.partitionBy("device_id", "i"))
    told = touched.withColumn("_wins", F.col("rank") == best).groupBy("device_id", "k", "d").agg(F.bool_and("_wins").alias("_wins"), *[F.first(c).alias(c) for c in ("b", "score", "rank", "visit")])
    return told.filter("_wins").select(*ranks.columns)


#: Rows of a table of merges or moves that each task may hold.
FEW = 100_000


def handed(df: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows for a join: to each task, if they are few, else neither side is (samples look small, for they are few bytes of a table)."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def process(samples: DataFrame, limits: Thresholds = LIMITS, *, fits: DataFrame | None = None, current: DataFrame | None = None, changed: DataFrame | None = None, score=consumption) -> tuple[DataFrame, list[dict]]:
    """Merges neighbouring items until no merge is possible: ((device_id, item_no, into, kind_visit), what each round did).

    The result says for each item of ``samples`` which item it is part of now, and that item's kind. A round makes all merges that are
    locally best. Samples are never rewritten, and after the first round only items next to a merge are summed up again: scores of
    possible merges are kept, those that touch a changed item are replaced. ``current`` is the result of an earlier run to start from;
    with ``changed`` (device_id, item_no) only what touches these of its items is scored at first, which is enough where nothing else was possible.
    ``fits`` are sums of classifier scores by item (device_id, item_no, name, total, n), which add up when items merge. ``score`` as in scored().
    """
    scratch = Scratch(samples.sparkSession)
    return _process(scratch, scratch.dealt(samples.select(*SAMPLE), "merge", *KEYS), limits, fits, current, changed, score)


def _process(scratch: Scratch, s: DataFrame, limits: Thresholds = LIMITS, fits=None, current=None, changed=None, score=consumption) -> tuple[DataFrame, list[dict]]:
    """process() of samples that are dealt out by item."""
    first = s.groupBy(*KEYS).agg(F.min("t").alias("start_t"), F.min_by(~I.moving(), F.struct(*I.BY_TIME)).alias("own_kind"))
    fresh = current is None
    if fresh:
        parts = first.withColumns({"into": F.col("item_no"), "kind_visit": F.col("own_kind")}).drop("own_kind")
    else:
        known = current.select(*KEYS, "into", "kind_visit")
        parts = first.join(known, KEYS, "left").withColumns({"into": F.coalesce("into", "item_no"), "kind_visit": F.coalesce("kind_visit", "own_kind")}).drop("own_kind")
    active = None
    if changed is None:
        parts = parts.withColumn("hit", F.lit(None).cast("int"))
    else:
        touched = scratch.staged(changed.select("device_id", F.col("item_no").alias("into")).distinct(), "touched")
        active = touched.select("device_id").distinct()
        parts = parts.join(touched.withColumn("hit", F.lit(1)), ["device_id", "into"], "left")
    parts = scratch.staged(parts.select(*KEYS, "start_t", "into", "kind_visit", "hit"), "parts")
    live, history = None, []
    o = W.partitionBy("device_id").orderBy("start_t", "into")
    ids = ["device_id", "k", "d"]
    every_id = F.explode(F.array_compact(F.array("k", "b", "d"))).alias("i")
    of = lambda df, those: df.select(*ids, every_id).join(those, ["device_id", "i"], "left_semi").select(*ids).distinct()
    while True:
        # a device in which nothing was merged is done
        p = parts if active is None else parts.join(active, "device_id", "left_semi")
        items = p.repartition("device_id").groupBy("device_id", "into").agg(F.min("start_t").alias("start_t"), F.max("hit").alias("hit")).withColumn("next_start", F.lead("start_t").over(o))
        if active is not None:
            # the item before a changed one ends where that begins
            items = items.withColumn("hit", F.greatest(F.col("hit"), F.lead("hit").over(o)))
            items = items.withColumn("near", F.max("hit").over(o.rowsBetween(-4, 4))).filter("near is not null")
        own = p.drop("hit").join(items.select("device_id", "into", "next_start", "hit"), ["device_id", "into"])
        own = scratch.staged(own.select(*KEYS, "into", "kind_visit", "next_start", "hit"), "own")
        held = lambda own: s.join(own, KEYS).withColumn("moving_state", F.when(F.col("kind_visit"), "stationary").otherwise("moving"))
        # samples lie dealt out by the items they began in
        x = held(own) if fresh else held(own).withColumn("item_no", F.col("into")).repartition(*KEYS)
        given = None
        if fits is not None:
            given = fits.join(own.select(*KEYS, "into"), KEYS).groupBy("device_id", F.col("into").alias("item_no"), "name").agg((F.sum("total") / F.sum("n")).alias("fit"))
        # written before it is filtered, or the plan would spell the score out three times
        rows = scratch.staged(told(x, limits, "next_start").select("device_id", *FACTS), "rows")
        # only what lies inside of paths that aren't valid is asked for
        lesser = rows.filter("not is_visit and not valid").select("device_id", F.col("item_no").alias("into"))
        lesser = held(own.join(lesser, ["device_id", "into"], "left_semi")).withColumn("item_no", F.col("into"))
        every = scored(rows, lesser, given, score)
        found = ranked(scratch.staged(every.select("device_id", "k", "b", "d", "score", "gap", "start", "visit"), "scored"))
        if active is not None:
            hit = own.filter("hit is not null").select("device_id", F.col("into").alias("i"))
            found = found.join(of(found, hit), ids, "left_semi")
            if live is not None:
                found = found.unionByName(live.join(of(live, hit.unionByName(moves.select("device_id", "i"))), ids, "left_anti"))
        live = scratch.staged(found, "live")
        moves = chosen(live).select("device_id", F.col("k").alias("to"), "visit", F.explode(F.array_compact(F.array("b", "d"))).alias("i"))
        moves = scratch.staged(moves, "moves")
        n = moves.agg(F.countDistinct("device_id", "to"), F.count("*")).first()
        history.append({"scored": rows.count(), "possible": live.count(), "merges": n[0], "taken": n[1]})
        if not n[1]:
            scratch.drop(but=(parts, s))
            return parts.select(*KEYS, "into", "kind_visit"), history
        keepers = moves.select("device_id", F.col("to").alias("into"), "to", F.lit(None).cast("boolean").alias("visit")).distinct()
        into = handed(moves.select("device_id", F.col("i").alias("into"), "to", "visit").unionByName(keepers), 2 * n[1])
        merged = parts.drop("hit").join(into, ["device_id", "into"], "left")
        merged = merged.select(*KEYS, "start_t", F.coalesce("to", "into").alias("into"), F.coalesce("visit", "kind_visit").alias("kind_visit"), F.when(F.col("to").isNotNull(), 1).alias("hit"))
        parts, fresh = scratch.staged(merged, "parts"), False
        active = handed(moves.select("device_id").distinct(), n[0])
        scratch.drop(but=(s, parts, live, moves))  # the round before


def merge_rounds(samples: DataFrame, limits: Thresholds = LIMITS, **options) -> DataFrame:
    """Samples with the item numbers and kinds that remain after process(); the kept item's number goes to the samples of the others."""
    scratch = Scratch(samples.sparkSession)
    s = scratch.dealt(samples, "merge", *KEYS)
    parts, _ = _process(scratch, s, limits, **options)
    return s.join(parts, KEYS).withColumn("item_no", F.col("into")).drop("into")


def updated(samples: DataFrame, current: DataFrame, edited: DataFrame, limits: Thresholds = LIMITS, **options) -> tuple[DataFrame, DataFrame, list[dict]]:
    """A finished timeline after an edit: (its items after, the rows of these that changed, what each round did).

    ``current`` is what process() said before; ``samples`` are all samples as they are now, ``edited`` (sample_id, device_id, item_no) those
    that changed, by their item of ``samples``. Their items and the neighbours of these are scored again, and what merges with them in
    turn; everything else stays, and isn't summed up. Nothing but rows that differ is to be written.
    """
    held = edited.select(*KEYS).distinct().join(current, KEYS)
    after, history = process(samples, limits, current=current, changed=held.select("device_id", F.col("into").alias("item_no")), **options)
    before = current.select(*KEYS, F.col("into").alias("_into"), F.col("kind_visit").alias("_kind"))
    both = after.join(before, KEYS, "left")
    return after, both.filter(~(F.col("into").eqNullSafe(F.col("_into")) & F.col("kind_visit").eqNullSafe(F.col("_kind")))).drop("_into", "_kind"), history
