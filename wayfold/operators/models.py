"""Histogram models of activity types: training, serialisation and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.tables import staged

#: Samples that fill a model, by the depth of its parent, and latitude by longitude bins of places by depth.
CAPS = {0: 7200, 1: 1800, 2: 80}
MATRIX = {0: (18, 36), 1: (100, 100), 2: (200, 200)}


def completeness(n: Column, depth: int) -> Column:
    return F.lit(1.0) if depth == 0 else F.least(F.lit(1.0), n / CAPS[depth - 1])


def geo_key(name: Column, lat: Column, lng: Column, depth: int) -> Column:
    """GD<depth> <name> <centre of the cell>."""
    half = {0: (90.0, 180.0), 1: (5.0, 5.0), 2: (0.05, 0.05)}[depth]
    return F.format_string(f"GD{depth} %s %.2f,%.2f", name, geo.cell_min(lat, depth, -90.0) + half[0], geo.cell_min(lng, depth, -180.0) + half[1])


def _ranges(values: DataFrame, keys: list[str], low: Column, high: Column, bins: int) -> DataFrame:
    """(keys, ranges): the values from ``low`` to ``high`` counted by equal ranges, as sorted (bin, n, lo, hi) of the filled ones, ``bins`` at most."""
    place = F.when(high > low, F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0)
    counts = values.filter(F.col("value").between(low, high)).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("ranges"))


def _holding(ranges: Column, rank: Column) -> Column:
    """(lo, hi, rank) of the range that holds the value of a rank from 0, and the rank within it."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), rank.cast("bigint").alias("rank"))

    def step(a: Column, x: Column) -> Column:
        here = a["lo"].isNull() & (a["before"] + x["n"] > rank)
        pick = lambda name, new: F.when(here, new).otherwise(a[name]).alias(name)
        return F.struct((a["before"] + x["n"]).alias("before"), pick("lo", x["lo"]), pick("hi", x["hi"]), pick("rank", rank - a["before"]))

    return F.aggregate(ranges, start, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), a["rank"].alias("rank")))


def _met(values: DataFrame, state: DataFrame, keys: list[str], held: Column) -> DataFrame:
    """Values with what ``state`` knows of their key, where ``held`` (a condition on both). ``state`` is a table, so its size is known, and the join is
    an outer one, since values, many in few bytes of a table, look small: of an inner join they could be the side that is broadcast.
    """
    return values.join(state, keys, "left").filter(F.coalesce(held, F.lit(False)))


def quartiles(values: DataFrame, state: DataFrame, keys: list[str], kept: list[str], bins: int = 1024, rounds: int = 1) -> DataFrame:
    """(keys, kept, q1, q3): exact order statistics by selection, without a sort of a key's values.

    ``state`` has the ranges q1 and q3 (lo, hi, rank) that hold both. Each round counts the values in these by ``bins`` finer ranges, with
    map-side sums, so that a task sends a few numbers a key; what is left after the rounds is a sliver of the range, gathered by
    distinct values. What the state knows of a key goes along in the groups, so that nothing is computed twice.
    """
    by = [*keys, "s"]
    for k in range(rounds + 1):
        last = k == rounds
        v = F.col("value")
        held = lambda q: v.between(F.col(f"{q}.lo"), F.col(f"{q}.hi"))  # noqa: B023, E731
        own = [F.when(held(q), F.struct(F.lit(q).alias("q"), *[F.col(f"{q}.{x}").alias(x) for x in ("lo", "hi", "rank")], *kept)) for q in ("q1", "q3")]
        x = _met(values, staged(state, "ranges"), keys, held("q1") | held("q3")).select(*keys, v, F.explode(F.array_compact(F.array(*own))).alias("s"))
        lo, hi = F.col("s.lo"), F.col("s.hi")
        place = v if last else F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
        x = x.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        x = x.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("ranges"))
        x = x.select(*keys, "s", _holding(F.col("ranges"), F.col("s.rank")).alias("h"))
        one = lambda q: F.max(F.when(F.col("s.q") == q, F.col("h"))).alias(q)
        state = x.groupBy(*keys, *[F.col(f"s.{c}").alias(c) for c in kept]).agg(one("q1"), one("q3"))
    return state.select(*keys, *kept, F.col("q1.lo").alias("q1"), F.col("q3.lo").alias("q3"))


def histograms(values: DataFrame, *keys: str, trim: Column | bool = False, low: Column | float | None = None, high: Column | float | None = None, pseudo: Column | int = 1, snap: bool = False) -> DataFrame:
    """One histogram a key over column ``value``: (keys, bins, min, max, pseudo).

    Values beyond four deviations are trimmed on request, then the bounds hold; both may depend on the keys. Bins follow
    Freedman and Diaconis with quartiles by index, ten bins where that width is no more than the spread over the count.
    Values are met by a few scans with map-side sums and never sorted or shuffled: a hot key costs what its rows cost, spread over all tasks.
    """
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = list(keys)
    v = values.filter(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    near = lambda sign: F.when(col(trim), F.avg("value") + sign * 4 * F.stddev_pop("value"))
    ends = v.groupBy(*keys).agg(F.min("value").alias("_min"), F.max("value").alias("_max"), *([] if trim is False else [near(-1).alias("_near"), near(1).alias("_far")]))
    none = F.lit(None).cast("double")
    side = lambda name: none if trim is False else F.col(name)
    ends = ends.select(*keys, F.greatest("_min", side("_near"), none if low is None else col(low)).alias("_from"), F.least("_max", side("_far"), none if high is None else col(high)).alias("_to"))
    v = _met(v, staged(ends, "ends"), keys, F.col("value").between(F.col("_from"), F.col("_to")))
    stat = _ranges(v, [*keys, "_from", "_to"], F.col("_from"), F.col("_to"), 1024)
    every = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    stat = stat.select(*keys, every.alias("_all"), F.get("ranges", F.lit(0))["lo"].alias("_lo"), F.element_at("ranges", -1)["hi"].alias("_hi"), "ranges")
    at = lambda q: _holding(F.col("ranges"), F.floor(F.col("_all") * q))
    kept = ["_all", "_lo", "_hi"]
    stat = quartiles(v.select(*keys, "value"), stat.select(*keys, *kept, at(0.25).alias("q1"), at(0.75).alias("q3")), keys, kept)
    spread = F.col("_hi") - F.col("_lo")
    width = 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("_all").cast("double"), F.lit(-1.0) / 3.0)
    n_bins = F.when(spread <= 0, 1).when(width <= spread / F.col("_all"), 10).otherwise(F.ceil(F.try_divide(spread, width))).cast("int")
    lo, hi = F.col("_lo"), F.col("_hi")
    if snap and low is not None and high is not None:
        low, high = col(low), col(high)
        lo = F.when(lo - low < (high - low) * 0.02, low).otherwise(lo)
        hi = F.when(high - hi < (high - low) * 0.02, high).otherwise(hi)
    stat = stat.select(*keys, "_all", lo.alias("min"), hi.alias("max"), n_bins.alias("_bins"))
    b = _met(v.select(*keys, "value"), staged(stat, "stat"), keys, F.col("value").between(F.col("min"), F.col("max")))
    place = (F.col("value") - F.col("min")) / ((F.col("max") - F.col("min")) / F.col("_bins"))
    place = F.when(F.col("_bins") == 1, F.lit(0)).otherwise(F.least(F.floor(place), F.col("_bins") - 1)).cast("int")
    bound = ["min", "max", "_bins"]
    filled = b.groupBy(*keys, *bound, place.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    out = filled.groupBy(*keys, *bound).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_m"))
    one = F.col("min") >= F.col("max")
    many = F.transform(F.sequence(F.lit(0), F.col("_bins") - 1), lambda i: (F.coalesce(F.element_at("_m", i), F.lit(0)) + col(pseudo)).cast("int"))
    return out.select(*keys, F.when(one, F.array((col(pseudo) + 1).cast("int"))).otherwise(many).alias("bins"), "min", "max", col(pseudo).cast("int").alias("pseudo"))


def probability(h: Column, value: Column) -> Column:
    """Of a histogram struct: the value's bin over the largest; one bin says 1 only for its very minimum; outside is 0, an absent histogram too."""
    n = F.size(h["bins"])
    width = (h["max"] - h["min"]) / n
    place = F.when(value == h["max"], n - 1).otherwise(F.floor((value - h["min"]) / F.nullif(width, F.lit(0.0))))
    many = F.when(place.between(0, n - 1), F.get(h["bins"], place.cast("int")) / F.array_max(h["bins"])).otherwise(0.0)
    return F.coalesce(F.when(n == 1, F.when(value == h["min"], 1.0).otherwise(0.0)).otherwise(many), F.lit(0.0))


def serialise(h: Column) -> Column:
    """n,pseudo;min,max;i,v;...: only bins above the pseudo count."""
    bins = F.filter(F.transform(h["bins"], lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > h["pseudo"])
    tail = F.transform(bins, lambda s: F.concat_ws(",", s["i"].cast("string"), s["x"].cast("string")))
    head = F.concat_ws(";", F.concat_ws(",", F.size(h["bins"]).cast("string"), h["pseudo"].cast("string")), F.concat_ws(",", h["min"].cast("string"), h["max"].cast("string")))
    return F.concat_ws(";", head, F.array_join(tail, ";"))


def deserialise(text: Column) -> Column:
    """The struct that serialise() made."""
    parts = F.split(text, ";")
    n, pseudo = F.split(F.get(parts, F.lit(0)), ",")[0].cast("int"), F.split(F.get(parts, F.lit(0)), ",")[1].cast("int")
    ends = F.split(F.get(parts, F.lit(1)), ",")
    pairs = F.transform(F.filter(F.slice(parts, F.lit(3), F.size(parts)), lambda p: p != ""), lambda p: F.struct(F.split(p, ",")[0].cast("int").alias("k"), F.split(p, ",")[1].cast("int").alias("v")))
    m = F.map_from_entries(pairs)
    bins = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(m, i), pseudo))
    return F.struct(bins.alias("bins"), ends[0].cast("double").alias("min"), ends[1].cast("double").alias("max"), pseudo.alias("pseudo"))


def matrix(places: DataFrame, depth: int, *keys: str) -> DataFrame:
    """Counts of latitude by longitude bins within each cell at a depth, 65,535 at most, as rows (keys, cell, bins, n)."""
    rows, cols = MATRIX[depth]
    size = {0: (180.0, 360.0), 1: (10.0, 10.0), 2: (0.1, 0.1)}[depth]
    la, lo = geo.cell_min(F.col("latitude"), depth, -90.0), geo.cell_min(F.col("longitude"), depth, -180.0)
    p = places.withColumns({"cell_lat": la, "cell_lng": lo})
    bins = {"lat_bin": geo.truncated((F.col("latitude") - F.col("cell_lat")) / (size[0] / rows)), "lng_bin": geo.truncated((F.col("longitude") - F.col("cell_lng")) / (size[1] / cols))}
    p = p.withColumns(bins).filter(F.col("lat_bin").between(0, rows - 1) & F.col("lng_bin").between(0, cols - 1))
    return p.groupBy(*keys, "cell_lat", "cell_lng", "lat_bin", "lng_bin").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("n"))


def place_factor(samples: DataFrame, cells: DataFrame, depth: int, *keys: str) -> DataFrame:
    """(sample_id, keys, factor) of each sample and matrix of its cell: its bin's count over the largest, that one CAPS of the depth at most, within 0 and 1.

    Cells are joined by their corner, bins by the cell and their place; counts are far fewer than samples.
    """
    rows, cols = MATRIX[depth]
    size = {0: (180.0, 360.0), 1: (10.0, 10.0), 2: (0.1, 0.1)}[depth]
    la, lo = geo.cell_min(F.col("latitude"), depth, -90.0), geo.cell_min(F.col("longitude"), depth, -180.0)
    s = samples.select("sample_id", "latitude", "longitude").withColumns({"cell_lat": la, "cell_lng": lo})
    bins = {"lat_bin": geo.truncated((F.col("latitude") - F.col("cell_lat")) / (size[0] / rows)), "lng_bin": geo.truncated((F.col("longitude") - F.col("cell_lng")) / (size[1] / cols))}
    top = cells.groupBy("cell_lat", "cell_lng", *keys).agg(F.least(F.max("n"), F.lit(CAPS[depth])).alias("_top"))
    found = s.withColumns(bins).join(top, ["cell_lat", "cell_lng"]).join(cells, ["cell_lat", "cell_lng", *keys, "lat_bin", "lng_bin"], "left")
    return found.select("sample_id", *keys, F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("_top")).alias("factor"))


#: Features of a model: column, trim, lower and upper bound, pseudo count, filter.
FEATURES = {
    "speed": ("speed", True, 0.0, None, 1, "speed >= 0 AND speed < 277.77"),
    "step_hz": ("step_hz", True, 0.0, None, 1, "step_hz IS NOT NULL AND (confirmed_type <> 'walking' OR step_hz > 0)"),
    "xy": ("xy_acc", True, 0.0, None, 1, "xy_acc IS NOT NULL"),
    "z": ("z_acc", True, 0.0, None, 1, "z_acc IS NOT NULL"),
    "variance": ("course_variance", False, 0.0, 1.0, 1, "course_variance IS NOT NULL"),
    "altitude": ("altitude", True, None, None, 1, "v_acc >= 0 AND altitude <> -1000"),
    "course": ("course", False, 0.0, 360.0, 1, "course >= 0"),
    "time_of_day": ("time_of_day", False, 0.0, 86400.0, 100, "true"),
    "h_acc": ("h_acc", True, 0.0, None, 1, "h_acc >= 0"),
}


def taught(samples: DataFrame) -> DataFrame:
    """Usable confirmed samples with what models learn from, as a table: each step of the histograms reads it again."""
    columns = ["confirmed_type", "classified_type", "previous_type", "moving_state", "t", "latitude", "longitude", *dict.fromkeys(f[0] for f in FEATURES.values()), "v_acc"]
    ok = geo.usable(F.col("latitude"), F.col("longitude"), F.col("h_acc"))
    s = samples.filter(F.col("confirmed_type").isNotNull() & ok).withColumn("time_of_day", (F.col("t") % 86400).cast("double"))
    return staged(s.select(*[c for c in columns if c in s.columns]), "taught")


def train(samples: DataFrame, *cell: str, features: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """A model for each confirmed type (and cell): total_samples, moving_pct, accuracy, and a histogram for each of ``features``."""
    return trained(taught(samples), *cell, features=features)


def trained(s: DataFrame, *cell: str, features: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """train() on what taught() gave."""
    keys = ["confirmed_type", *cell]
    known = F.count(F.when(F.col("classified_type").isNotNull(), 1))
    right = F.count_if(F.col("classified_type") == F.col("confirmed_type"))
    base = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.try_divide(F.count_if(F.col("moving_state") == "moving"), F.count_if(F.col("moving_state") != "uncertain")), F.lit(0.5)).alias("moving_pct"),
        F.try_divide(right, known).alias("accuracy"),
    )
    # all features in one pass: a row for each that a sample has
    if not features:
        return base
    used = {name: FEATURES[name] for name in features}
    given = [F.when(F.expr(where), F.struct(F.lit(name).alias("feature"), F.col(column).cast("double").alias("value"))) for name, (column, *_, where) in used.items()]
    rows = s.select(*keys, F.explode(F.array_compact(F.array(*given))).alias("x")).select(*keys, "x.*")

    def of(k: int) -> Column:
        out = F.lit(None)
        for name, f in used.items():
            out = F.when(F.col("feature") == name, F.lit(f[k])).otherwise(out)
        return out

    h = histograms(rows, *keys, "feature", trim=of(1), low=of(2).cast("double"), high=of(3).cast("double"), pseudo=of(4).cast("int"))
    wide = h.groupBy(*keys).agg(*[F.first(F.when(F.col("feature") == name, F.struct("bins", "min", "max", "pseudo")), ignorenulls=True).alias(name) for name in used])
    return base.join(wide, keys, "left")


def best(scores: DataFrame) -> DataFrame:
    """The name of the highest score above 0 of each sample, unknown if there is none; ties by name."""
    top = scores.groupBy("sample_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return top.select("sample_id", F.when(F.col("b.s") < 0, F.col("b.name")).otherwise("unknown").alias("name"), (-F.col("b.s")).alias("score"))


def stale(have: Column, wanted: tuple[str, ...], complete: Column, updated_age: Column, fetched_age: Column) -> Column:
    """Whether a set of models is due: a type is missing, or it was neither fetched nor updated lately for how complete it is."""
    missing = F.size(F.array_except(F.array(*map(F.lit, wanted)), have)) > 0
    return F.when(missing, True).when(fetched_age < 3600, False).when(updated_age < 60 * 86400 * complete, False).when(fetched_age < 7 * 86400 * complete, False).otherwise(True)


def serialise_matrix(cells: DataFrame, depth: int, *keys: str) -> DataFrame:
    """A text for each matrix: rows,columns,pseudo;x,y,n;... with filled bins alone."""
    rows, cols = MATRIX[depth]
    bins = F.array_sort(F.collect_list(F.struct("lat_bin", "lng_bin", "n")))
    text = F.transform(bins, lambda b: F.concat_ws(",", b["lat_bin"].cast("string"), b["lng_bin"].cast("string"), b["n"].cast("string")))
    return cells.groupBy(*keys, "cell_lat", "cell_lng").agg(F.concat(F.lit(f"{rows},{cols},0;"), F.array_join(text, ";")).alias("bins"))
