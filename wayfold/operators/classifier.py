"""Classification by models of three depths, and chains in which each sample's previous type is a factor of its scores.

A set is all models of a cell, one row: at most one model a type, in the order of ``names``. Samples meet the sets of their
cells by equality joins, so a hot cell is one row that many tasks read, and never the models of other cells. A set that is complete
settles a sample by itself; otherwise it counts by how complete it is, and the rest of the weight goes to the set of the wider cell.

In a chain the best type of a sample depends on that of the sample before. Each sample is therefore a table: the best type for
each previous one. Tables of an hour are composed where they lie; a fold over hours alone, a row each, finds the type that
enters each hour; the hour's samples then follow from it. No task holds a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import models as M
from wayfold.operators.folds import fold
from wayfold.operators.tables import staged
from wayfold.schemas import BASE_TYPES, TYPES

CELL = ["depth", "cell_lat", "cell_lng"]
MARKOV_PRIOR = 1  # of each type


def cell(depth: int) -> dict[str, Column]:
    """The corner of a sample's cell at a depth; of the world for any sample, else null without a coordinate."""
    if depth == 0:
        return {"cell_lat": F.lit(-90.0), "cell_lng": F.lit(-180.0)}
    return {"cell_lat": geo.cell_min(F.col("latitude"), depth, -90.0), "cell_lng": geo.cell_min(F.col("longitude"), depth, -180.0)}


def spread(samples: DataFrame, depths: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Confirmed samples once a depth, with the cell: below depth 2 base types alone have models."""
    cells = [F.struct(F.lit(d).alias("depth"), *[c.alias(n) for n, c in cell(d).items()]) for d in depths]
    out = samples.filter(F.col("confirmed_type").isNotNull()).withColumn("_cell", F.explode(F.array(*cells)))
    out = out.select("*", "_cell.*").drop("_cell")
    return out.filter((F.col("depth") == 2) | F.col("confirmed_type").isin(*BASE_TYPES))


def train(samples: DataFrame, depths: tuple[int, ...] = (0, 1, 2), cells: DataFrame | None = None, features: tuple[str, ...] = tuple(M.FEATURES)) -> DataFrame:
    """Models by (depth, cell_lat, cell_lng, confirmed_type): histograms, shares, and counts of previous types as a map ``previous``.

    ``samples`` may have a column ``previous_type``, the confirmed type of the sample before; without it the map is empty.
    With ``cells`` (depth, cell_lat, cell_lng) only these are trained. Samples without a usable coordinate train nothing. ``top`` is the fullest bin of the model's places (0 at depth 0).
    """
    s = spread(M.taught(samples), depths)
    if cells is not None:
        s = s.join(cells, CELL, "left_semi")
    keys = [*CELL, "confirmed_type"]
    out = M.trained(s, *CELL, features=features)
    if "previous_type" in s.columns:
        c = s.filter("previous_type is not null").groupBy(*keys, "previous_type").count()
        c = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("previous_type", F.col("count")))).alias("previous"))
        out = out.join(c, keys, "left").withColumn("previous", F.coalesce("previous", F.create_map().cast("map<string,bigint>")))
    else:
        out = out.withColumn("previous", F.lit(None).cast("map<string,bigint>"))
    top = places(s).groupBy(*keys).agg(F.max("n").alias("top"))
    return out.join(top, keys, "left").withColumn("top", F.coalesce("top", F.lit(0).cast("bigint")))


#: Seconds that a complete set stays fresh (a fixed value); one that is half complete, half as long.
PATIENCE = 60 * 86400.0


def due(models: DataFrame, new: DataFrame, now: float, patience: float = PATIENCE) -> DataFrame:
    """(depth, cell_lat, cell_lng) of the sets that ``new`` samples call for: those with new confirmed samples that don't exist yet or are stale.

    ``models`` have ``updated``, the seconds of their training; a set is as old as its newest model.
    """
    touched = spread(new.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))).select(*CELL).distinct()
    have = models.groupBy(*CELL).agg(F.max("updated").alias("_updated"), F.avg(F.when(F.col("confirmed_type") != "bogus", _complete(F.col("total_samples"), F.col("depth")))).alias("_complete"))
    stale = F.col("_updated").isNull() | (now - F.col("_updated") >= patience * F.coalesce("_complete", F.lit(0.0)))
    return touched.join(have, CELL, "left").filter(stale).select(*CELL)


def refreshed(models: DataFrame, samples: DataFrame, new: DataFrame, now: float, patience: float = PATIENCE) -> tuple[DataFrame, DataFrame]:
    """(models of the sets that are due, trained anew on ``samples``, and models that stay): together the table as it is now.

    Only samples in cells that are due are read into training; a user writes the first and leaves the second where it lies.
    """
    cells = staged(due(models, new, now, patience), "due")
    made = train(samples, cells=cells).withColumn("updated", F.lit(float(now)))
    return made.select(*models.columns), models.join(cells, CELL, "left_anti").select(*models.columns)


def places(spread_samples: DataFrame) -> DataFrame:
    """Counts of samples by model and bin of its place, for depths 1 and 2; only filled bins have a row."""
    s = spread_samples.filter("depth > 0")
    return s.withColumns(_bins(F.col("depth"))).filter(_inside(F.col("depth"))).groupBy(*CELL, "confirmed_type", "lat_bin", "lng_bin").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("n"))


def _by_depth(depth: Column, values: dict[int, float]) -> Column:
    return F.when(depth == 1, F.lit(values[1])).otherwise(F.lit(values[2]))


def _bins(depth: Column, lat: str = "cell_lat", lng: str = "cell_lng") -> dict[str, Column]:
    size = {d: (geo.CELL_DEGREES[d] / M.MATRIX[d][0], geo.CELL_DEGREES[d] / M.MATRIX[d][1]) for d in (1, 2)}
    at = lambda x, low, k: geo.truncated((F.col(x) - F.col(low)) / _by_depth(depth, {d: size[d][k] for d in size}))
    return {"lat_bin": at("latitude", lat, 0), "lng_bin": at("longitude", lng, 1)}


def _inside(depth: Column) -> Column:
    rows, cols = (_by_depth(depth, {d: M.MATRIX[d][k] for d in (1, 2)}) for k in (0, 1))
    return F.col("lat_bin").between(0, rows - 1) & F.col("lng_bin").between(0, cols - 1)


def _chances(feature: str) -> Column:
    """A histogram with the chances of its bins instead of their counts: divided once a model, not once a sample."""
    top = F.array_max(f"{feature}.bins")
    return F.when(F.col(feature).isNotNull(), F.struct(F.transform(f"{feature}.bins", lambda x: x / top).alias("p"), f"{feature}.min", f"{feature}.max")).alias(feature)


def _chance(h: Column, value: Column) -> Column:
    """What models.probability() says, of a histogram with chances."""
    n = F.size(h["p"])
    width = (h["max"] - h["min"]) / n
    place = F.when(value == h["max"], n - 1).otherwise(F.greatest(F.lit(-1), F.least(n, F.floor((value - h["min"]) / F.nullif(width, F.lit(0.0))))))
    many = F.get(h["p"], place.cast("int"))  # null beyond the ends
    return F.coalesce(F.when(n == 1, F.when(value == h["min"], 1.0)).otherwise(many), F.lit(0.0))


def sets(models: DataFrame, names: tuple[str, ...] = TYPES) -> DataFrame:
    """A row a cell: ``models`` as an array in the order of ``names``, null where there is none, their samples in all, and how complete they are."""
    held = [c for c in models.columns if c not in (*CELL, "confirmed_type", *M.FEATURES)] + [_chances(f) for f in M.FEATURES if f in models.columns]
    full = F.when(F.col("confirmed_type") != "bogus", _complete(F.col("total_samples"), F.col("depth")))
    g = models.groupBy(*CELL).agg(
        F.map_from_entries(F.collect_list(F.struct("confirmed_type", F.struct(F.col("confirmed_type").alias("name"), *held)))).alias("_m"),
        F.sum("total_samples").alias("total"),
        F.coalesce(F.avg(full), F.lit(0.0)).alias("complete"),
    )
    return g.select(*CELL, F.transform(F.array(*map(F.lit, names)), lambda n: F.element_at("_m", n)).alias("models"), "total", "complete")


def _complete(n: Column, depth: Column) -> Column:
    return F.when(depth == 0, 1.0).otherwise(F.least(F.lit(1.0), n / _by_depth(depth, {1: M.CAPS[0], 2: M.CAPS[1]})))


def unsettled(samples: DataFrame, trained: DataFrame) -> DataFrame:
    """Samples that their cells' sets leave to the world's: those where neither is complete. It takes counts alone, no models."""
    s = samples
    counts = spread(trained.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))), (1, 2)).filter("confirmed_type <> 'bogus'").groupBy(*CELL, "confirmed_type").count()
    full = staged(counts.groupBy(*CELL).agg(F.avg(_complete(F.col("count"), F.col("depth"))).alias("complete")), "complete")
    for d in (1, 2):
        own = full.filter(F.col("depth") == d).select(F.col("complete").alias("_full"), *[F.col(c).alias(f"_{c}") for c in CELL[1:]])
        s = s.withColumns({f"_{n}": c for n, c in cell(d).items()}).join(own, [f"_{c}" for c in CELL[1:]], "left")
        s = s.filter(F.coalesce("_full", F.lit(0.0)) < 1).drop("_full", *[f"_{c}" for c in CELL[1:]])
    return s


def known_names(models: DataFrame) -> tuple[str, ...]:
    """Types that have a model, in the order of types: 32 at most."""
    found = {r[0] for r in models.select("confirmed_type").distinct().collect()}
    return tuple(t for t in TYPES if t in found)


def raw_score(m: Column, depth: int, place: Column | None = None) -> Column:
    """The product of a model's factors for which a sample has the inputs, not yet held within 0 and 1; ``place`` is its place's factor."""
    name, weight = m["name"], (lambda w: w if depth == 2 else 1.0)
    pct = m["moving_pct"]
    larger = F.greatest(pct, 1 - pct)
    p = lambda feature, column: _chance(m[feature], F.col(column).cast("double"))
    still = name.isin("stationary", "bogus")
    factors = [
        F.when(F.col("moving_state") == "moving", pct / larger).when(F.col("moving_state") == "stationary", (1 - pct) / larger),
        F.when(F.col("speed") >= 0, p("speed", "speed") * weight(2.0)),
        F.when(F.col("step_hz").isNotNull(), p("step_hz", "step_hz") * weight(1.2)),
        F.when(F.col("course_variance").isNotNull(), p("variance", "course_variance") * weight(1.2)),
        F.when(~still & F.col("xy_acc").isNotNull(), p("xy", "xy_acc") * weight(1.2)),
        F.when(~still & F.col("z_acc").isNotNull(), p("z", "z_acc") * weight(1.2)),
        F.when(F.col("altitude") != -1000, p("altitude", "altitude")),
    ]
    if depth > 0:
        factors.append(F.when((name != "stationary") & (F.col("course") >= 0), p("course", "course")))
        factors.append(F.when(~name.isin("stationary", "walking", "running"), _chance(m["time_of_day"], (F.col("t") % 86400).cast("double"))))
        if place is not None:
            factors.append(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place * weight(10.0)))
    if depth == 2:
        factors.append(F.when(F.col("h_acc") >= 0, p("h_acc", "h_acc")))
    out = F.lit(1.0)
    for f in factors:
        out = out * F.coalesce(f, F.lit(1.0))
    return out


def _place(m: Column, bins: Column, depth: int) -> Column:
    """The share of the fullest bin (of the depth's cap at most) that the sample's bin has; base types have one more in each bin."""
    prior = F.when(m["name"].isin(*BASE_TYPES), 1).otherwise(0)
    full = F.least(m["top"] + prior, F.lit(M.CAPS[depth]))
    return F.when(full > 0, F.least(F.lit(1.0), (F.coalesce(F.element_at(bins, m["name"]), F.lit(0)) + prior) / full)).otherwise(0.0)


def weighed(samples: DataFrame, models: DataFrame, names: tuple[str, ...], depths: tuple[int, ...] = (0, 1, 2), made=None) -> DataFrame:
    """Samples with how much the set of each depth counts: w0, w1, w2, and the corners of their cells.

    A complete set leaves nothing to the wider ones. A sample whose tenth-degree cell has no set begins with ten degrees, then with the world.
    Sets are wide, so each, c0 to c2 (models, total, complete), is at hand for its own join alone: ``made``, a function of the depth, says what
    columns are kept of it. From the finest on: what is left to wider sets is known then, and no row carries a set to the next join.
    """
    s, by = samples, sets(models, names)
    left = F.lit(1.0)
    for d in sorted(depths, reverse=True):
        own = by.filter(F.col("depth") == d).select(F.struct("models", "total", "complete").alias(f"c{d}"), *[F.col(c).alias(f"{c}{d}") for c in CELL[1:]])
        if d == 0:
            s = s.withColumn("c0", own.select("c0").scalar())  # the world's set is one row
            share = F.lit(1.0)
        else:
            missing = {f"{n}{d}": c for n, c in cell(d).items() if f"{n}{d}" not in s.columns}
            s = s.withColumns(missing).join(own, [f"cell_lat{d}", f"cell_lng{d}"], "left")
            share = F.when(F.col(f"c{d}").isNotNull(), F.col(f"c{d}.complete")).otherwise(0.0)
        s = s.withColumns({f"w{d}": left * share, "_left": left * (1 - share)})
        left = F.col("_left")
        s = s.withColumns({} if made is None else made(d)).drop(f"c{d}")
    return s.drop("_left")


def _terms(d: int, names: tuple[str, ...], bins: Column | None, model=raw_score):
    """The term of a model at a depth, null for no model or a depth that doesn't count."""

    def of(m: Column) -> Column:
        most = F.coalesce(F.array_max(F.map_values(m["previous"])), F.lit(0))
        moves = F.transform(F.array(*map(F.lit, names)), lambda n: (F.coalesce(F.element_at(m["previous"], n), F.lit(0)) + MARKOV_PRIOR) / (most + MARKOV_PRIOR))
        weight = F.col(f"w{d}") * m["total_samples"] / (1 + F.col(f"c{d}.total"))
        raw = model(m, d, _place(m, bins, d) if bins is not None else None)
        known = m.isNotNull() & (F.col(f"w{d}") > 0)
        return F.when(known, F.struct(F.lit(d).alias("depth"), raw.alias("raw"), weight.alias("weight"), F.when((m["name"] != "bogus") & m["previous"].isNotNull(), moves).alias("moves")))

    return of


def _filled(trained: DataFrame, depth: int) -> DataFrame:
    """Counts of confirmed samples by bin of a place, a map by type as b1 or b2: a table, as small as the places are few."""
    usable = trained.filter(geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc")))
    bins = ("cell_lat", "cell_lng", "lat_bin", "lng_bin")
    filled = places(spread(usable, (depth,))).groupBy(*bins).agg(F.map_from_entries(F.collect_list(F.struct("confirmed_type", "n"))).alias(f"b{depth}"))
    return staged(filled.select(*[F.col(c).alias(f"{c}{depth}") for c in bins], f"b{depth}"), "places")


def parts(samples: DataFrame, models: DataFrame, names: tuple[str, ...], kept: list[str], depths: tuple[int, ...] = (0, 1, 2), trained: DataFrame | None = None, model=raw_score) -> DataFrame:
    """``kept`` columns and ``parts``: for each of ``names`` the terms of its score, from the sample's set of each depth that counts.

    A term is (depth, raw, weight, moves): weight is how much the depth counts times the model's share of its set's samples, moves are factors by
    the previous type's place in ``names`` (null where the model knows none). ``trained`` are the confirmed samples that made the models, for the places' bins.
    ``model`` is a hook, a function of (a model's columns, depth, its place's factor) that gives another score of a sample by a model, from
    whatever columns both have; null is as good as 1.
    """
    s, bins = samples, {}
    for d in depths:
        if d and trained is not None:
            # narrow rows meet the places first, before any set
            on = {f"{n}{d}": c for n, c in cell(d).items()}
            s = s.withColumns(on)
            where = {f"{n}{d}": c for n, c in _bins(F.lit(d), *on).items()}
            s = s.withColumns(where).join(_filled(trained, d), [*on, *where], "left").drop(*where)
            bins[d] = F.col(f"b{d}")
    none = F.array_repeat(F.lit(None).cast("struct<depth:int,raw:double,weight:double,moves:array<double>>"), len(names))
    s = weighed(s, models, names, depths, lambda d: {f"p{d}": F.coalesce(F.transform(f"c{d}.models", _terms(d, names, bins.get(d), model)), none)})
    joined = F.transform(f"p{depths[0]}", lambda a: F.array(a))
    for d in depths[1:]:
        joined = F.zip_with(joined, f"p{d}", lambda a, b: F.concat(a, F.array(b)))
    return s.select(*kept, F.transform(joined, F.array_compact).alias("parts"))


def at_depths(terms: Column, *depths: int) -> Column:
    """Of a type's terms those of these depths."""
    return F.filter(terms, lambda x: x["depth"].isin(*depths))


def score_of(terms: Column, before: Column | None = None) -> Column:
    """The score of a type's terms, null if it has none; ``before`` is the previous type's place, null or absent for none."""

    def value(x: Column) -> Column:
        move = F.lit(1.0) if before is None else F.coalesce(F.get(x["moves"], before), F.lit(1.0))
        return x["weight"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["raw"] * move))

    return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + value(x)))


def scores(table: DataFrame, names: tuple[str, ...], kept: list[str], before: Column | None = None) -> DataFrame:
    """(kept, name, score) of the types that have terms."""
    named = F.transform("parts", lambda x, i: F.struct(F.get(F.array(*map(F.lit, names)), i).alias("name"), score_of(x, before).alias("score")))
    return table.select(*kept, F.explode(F.filter(named, lambda x: x["score"].isNotNull())).alias("_s")).select(*kept, "_s.*")


#: What raw_score() looks at in a model of the world.
WORLD = ("speed", "step_hz", "variance", "xy", "z", "altitude")


def world(samples: DataFrame, model=raw_score, features: tuple[str, ...] = WORLD, of: DataFrame | None = None, kept: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """(kept, name, score) by the models of the world alone, of all types that have confirmed samples; ``model`` as in parts().

    Only histograms of ``features`` are made, those that the model looks at. The samples of ``of`` are scored, by default those that train.
    """
    m = M.train(samples, features=features).withColumns({"depth": F.lit(0), **cell(0), "previous": F.lit(None).cast("map<string,bigint>"), "top": F.lit(0).cast("bigint")})
    m = staged(m, "models")
    names = known_names(m)
    return scores(parts(samples if of is None else of, m, names, list(kept), depths=(0,), model=model), names, list(kept))


def classify(samples: DataFrame, models: DataFrame, names: tuple[str, ...], trained: DataFrame, model=raw_score) -> DataFrame:
    """(sample_id, name, score) by all three depths, each sample for itself; ``model`` as in parts()."""
    return scores(parts(samples, models, names, ["sample_id"], trained=trained, model=model), names, ["sample_id"])


def best_place(parts_: Column, before: Column | None, digits: int = 12) -> Column:
    """(at, score): where in ``names`` the highest score is, the earlier of equals to ``digits`` decimals; -1 if no type has a score."""
    found = F.transform(parts_, lambda x, i: F.struct(F.round(score_of(x, before), digits).alias("score"), (-i).alias("at")))
    top = F.array_max(F.filter(found, lambda x: x["score"].isNotNull()))
    return F.struct(F.coalesce(-top["at"], F.lit(-1)).alias("at"), top["score"].alias("score"))


def chained(samples: DataFrame, models: DataFrame, names: tuple[str, ...], trained: DataFrame, keys: tuple[str, ...] = ("device_id", "item_no"), seconds: int = 3600, model=raw_score) -> DataFrame:
    """(keys, sample_id, t, previous, name, score): the best type of each sample, a factor of which is the best type of the sample before in its chain.

    A chain is the samples of ``keys`` in the order of (t, sample_id); its first has no previous type, nor has one after a
    sample that no model scores. ``seconds`` is the span composed at a time; it changes no result. ``model`` as in parts().
    """
    kept = [*keys, "sample_id", "t"]
    table = parts(samples, models, names, kept, trained=trained, model=model)
    k = len(names)
    # place k stands for no previous type; parts are named k + 1 times, so they are worked out once
    row = F.array(*[best_place(F.col("parts"), F.lit(p)) for p in range(k)], best_place(F.col("parts"), None))
    table = table.select(*kept, F.transform(row, lambda x: F.struct(F.when(x["at"] < 0, k).otherwise(x["at"]).alias("at"), x["score"].alias("score"))).alias("row"))
    span = F.floor(F.col("t") / seconds).alias("span")
    spans = table.groupBy(*keys, span).agg(F.sort_array(F.collect_list(F.struct("t", "sample_id", "row"))).alias("run"))
    all_places = F.sequence(F.lit(0), F.lit(k))
    whole = F.aggregate("run", all_places, lambda acc, x: F.transform(acc, lambda p: F.get(x["row"], p)["at"]))
    lead, rest = keys[0], list(keys[1:])
    order = [*rest, "span"]
    held = spans.select(lead, *order, whole.alias("whole"))
    types = dict(held.dtypes)

    def step(state: dict, r: tuple):
        own = r[1 : 1 + len(rest)]
        if state.get("own") != own:
            state.update(own=own, at=k)
        enters = state["at"]
        state["at"] = int(r[-1][enters])
        return (*r[:-1], enters)

    schema = ", ".join(f"{c} {types[c]}" for c in (lead, *order)) + ", enters int"
    entered = fold(held, dict, step, schema, order=tuple(order), key=lead)
    start = F.struct(F.col("enters").alias("at"), F.array().cast("array<struct<sample_id:bigint,t:bigint,before:int,at:int,score:double>>").alias("out"))

    def follow(a: Column, x: Column) -> Column:
        found = F.get(x["row"], a["at"])
        made = F.struct(x["sample_id"].cast("bigint").alias("sample_id"), x["t"].cast("bigint").alias("t"), a["at"].alias("before"), found["at"].alias("at"), found["score"].alias("score"))
        return F.struct(found["at"].alias("at"), F.array_append(a["out"], made).alias("out"))

    run = F.aggregate("run", start, follow, lambda a: a["out"])
    out = spans.join(entered, [*keys, "span"]).select(*keys, F.explode(run).alias("x")).select(*keys, "x.*")
    name = lambda c: F.get(F.array(*map(F.lit, names)), F.when(F.col(c) < k, F.col(c)))
    return out.select(*keys, "sample_id", "t", name("before").alias("previous"), F.when(F.col("score") > 0, name("at")).otherwise("unknown").alias("name"), "score")
