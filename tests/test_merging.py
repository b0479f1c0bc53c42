"""Merging in incremental rounds against rounds that score everything anew; updates after edits; hooks."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.operators import items as I
from wayfold.operators import classifier, merging, update
from wayfold.operators.tables import staged
from wayfold.sources.samples import samples

SCHEMA = "sample_id long, device_id long, t long, latitude double, longitude double, h_acc double, speed double, moving_state string, recording_state string, confirmed_type string, classified_type string, item_no long"


def every_round_anew(numbered):
    """The loop without any memory: all items are summed up and all candidates scored in each round."""
    s = numbered.withColumn("kind_visit", F.first(~I.moving()).over(W.partitionBy("device_id", "item_no").orderBy("t", "sample_id")))
    rows = {(r.device_id, r.sample_id): [r.item_no, r.kind_visit] for r in s.collect()}
    while True:
        now = numbered.sparkSession.createDataFrame([(d, i, n, k) for (d, i), (n, k) in rows.items()], "device_id long, sample_id long, item_no long, kind_visit boolean")
        x = numbered.drop("item_no").join(now, ["device_id", "sample_id"]).withColumn("moving_state", F.when(F.col("kind_visit"), "stationary").otherwise("moving"))
        # ends are those of the next item by time
        starts = x.groupBy("device_id", "item_no").agg(F.min("t").alias("a")).withColumn("next_start", F.lead("a").over(W.partitionBy("device_id").orderBy("a", "item_no"))).drop("a")
        x = x.join(starts, ["device_id", "item_no"])
        facts = staged(merging.facts(I.summarize(x, following="next_start"), x), "facts")
        scores = staged(merging.scored(facts, x).drop("keeper", "deadman"), "scores")
        moves = merging.chosen(merging.ranked(scores)).collect()
        if not moves:
            return {k: tuple(v) for k, v in rows.items()}
        to = {(m.device_id, i): (m.k, m.visit) for m in moves for i in (m.b, m.d) if i is not None}
        rows = {k: list(to.get((k[0], v[0]), v)) for k, v in rows.items()}


@pytest.fixture(scope="module")
def some(spark, sf):
    devices = samples(spark, sf).filter("not deleted and device_id in (1, 3)").drop("kind_visit")
    return I.number_items(devices)


def test_same_as_rounds_that_score_everything(spark, some):
    parts, history = merging.process(some)
    got = {(r.device_id, r.sample_id): (r.into, r.kind_visit) for r in some.join(parts, ["device_id", "item_no"]).collect()}
    assert got == every_round_anew(some)
    assert len(history) > 1 and history[-1]["merges"] == 0
    assert all(h["scored"] < history[0]["scored"] for h in history[1:])


def test_update_equals_a_full_run_and_touches_few(spark, some):
    parts, history = merging.process(some)
    # one item's samples are now of another type and kind of movement
    item = some.filter("device_id = 3").groupBy("item_no").count().filter("count > 3").orderBy("item_no").first().item_no
    hit = (F.col("device_id") == 3) & (F.col("item_no") == item)
    after = some.withColumns({"confirmed_type": F.when(hit, "walking").otherwise(F.col("confirmed_type")), "speed": F.when(hit, 1.0).otherwise(F.col("speed"))})
    told, changed, steps = merging.updated(after, parts, after.filter(hit))
    full, _ = merging.process(after, current=parts)
    rows = lambda df: {(r.device_id, r.item_no): (r.into, r.kind_visit) for r in df.collect()}
    assert rows(told) == rows(full)
    assert steps[0]["scored"] <= 10 < history[0]["scored"]
    before = rows(parts)
    assert rows(changed) == {k: v for k, v in rows(told).items() if before[k] != v}
    # nothing edited, nothing done
    told, changed, steps = merging.updated(some, parts, some.limit(0))
    assert changed.count() == 0 and steps == [{"scored": 0, "possible": 0, "merges": 0, "taken": 0}] and rows(told) == before


def line(no, start, places, still, step=20, first=0):
    return [(first + k, 1, start + step * k, 10 + m / 111_195, 20.0, 5.0, 1.0, "stationary" if still else "moving", "recording", "stationary" if still else "walking", None, no) for k, m in enumerate(places)]


def test_short_path_inside_a_visit_is_taken_at_two(spark):
    # the last item of a device ends with its last sample: all of its samples, time and metres lie inside the visit
    inside = line(1, 0, [0, 20, -20, 0, 15, -15, 0, 0], True) + line(2, 160, [1, 4, 6], False, first=100)
    outside = line(1, 0, [0] * 8, True) + line(2, 160, [900, 903, 906], False, first=100)
    for rows, want in ((inside, 2), (outside, 1)):
        s = spark.createDataFrame(rows, SCHEMA)
        c = merging.scored(merging.facts(I.summarize(s), s), s).filter("k = 1 and d = 2").first()
        assert c.score in (want, 0) and (want == 1 or c.score == 2), c
        assert (c.inside == 1.0) if want == 2 else c.inside is None


def test_score_is_a_hook(spark, some):
    plain, _ = merging.process(some)
    none, history = merging.process(some, score=lambda a, b, inside=None, fit=None: F.lit(0))
    assert len(history) == 1 and none.filter("into <> item_no").count() == 0 < plain.filter("into <> item_no").count()


def test_fits_let_paths_of_two_types_merge(spark):
    rows = line(1, 0, range(0, 4000, 100), False) + [(*r[:9], "car", *r[10:]) for r in line(2, 800, [4000, 4040], False, first=100)]
    s = spark.createDataFrame(rows, SCHEMA)
    fits = spark.createDataFrame([(1, 2, "walking", 0.16, 2)], "device_id long, item_no long, name string, total double, n long")
    assert merging.process(s)[0].filter("into <> item_no").count() == 0
    assert [r.into for r in merging.process(s, fits=fits)[0].orderBy("item_no").collect()] == [1, 1]


def test_segment_update_reclassifies_and_merges_what_was_edited(spark, sf):
    s = samples(spark, sf).filter("device_id < 6").withColumn("previous_type", F.lag("confirmed_type").over(I.per_device()))
    models = staged(classifier.train(s), "models")
    names = classifier.known_names(models)
    n = staged(I.number_items(s.filter("not deleted")), "numbered")
    current, _ = merging.process(n)
    item = n.filter("device_id = 3").groupBy("item_no").count().filter("count > 3").orderBy("item_no").first().item_no
    hit = (F.col("device_id") == 3) & (F.col("item_no") == item)
    after = n.withColumn("confirmed_type", F.when(hit & (F.col("sample_id") % 2 == 0), "walking").when(~hit, F.col("confirmed_type")))
    retyped, changed, steps = update.segment_update(after, current, after.filter(hit), models, names, s)
    into = current.filter(hit).first().into
    own = after.join(current.filter((F.col("device_id") == 3) & (F.col("into") == into)).select("device_id", "item_no"), ["device_id", "item_no"])
    chain = {r.sample_id: r.name for r in classifier.chained(own.withColumn("item_no", F.lit(into)), models, names, s).collect()}
    want = {r.sample_id: chain[r.sample_id] for r in own.filter("confirmed_type is null").collect() if chain[r.sample_id] != (r.classified_type or "unknown")}
    assert {r.sample_id: r.classified_type or "unknown" for r in retyped.collect()} == want
    typed = after.join(retyped.select("device_id", "sample_id", F.col("classified_type").alias("_n"), F.lit(1).alias("_r")), ["device_id", "sample_id"], "left")
    typed = typed.withColumn("classified_type", F.when(F.col("_r") == 1, F.col("_n")).otherwise(F.col("classified_type"))).drop("_n", "_r")
    full, _ = merging.process(typed, current=current)
    before = {(r.device_id, r.item_no): (r.into, r.kind_visit) for r in current.collect()}
    moved = {k: v for k, v in ((((r.device_id, r.item_no)), (r.into, r.kind_visit)) for r in full.collect()) if before[k] != v}
    assert {(r.device_id, r.item_no): (r.into, r.kind_visit) for r in changed.collect()} == moved
    assert steps[0]["scored"] <= 10


def test_a_place_on_the_border_of_a_visit_is_inside_whatever_the_last_digit(spark):
    import math

    from pyspark.sql import functions as F

    from wayfold.functions import geo

    # the radius of two fixes is the farther one's distance, but for the last digit of a mean and a deviation
    d = spark.range(1).select(geo.distance(F.lit(13.7), F.lit(100.5), F.lit(13.7001), F.lit(100.5))).first()[0]
    sample = spark.createDataFrame([(1, 2, 0, 7, 13.7001, 100.5, 5.0)], "device_id long, item_no long, t long, sample_id long, latitude double, longitude double, h_acc double")
    for radius, share in ((math.nextafter(d, 0), 1 / 3), (d, 1 / 3), (d - 1e-3, None)):
        pair = spark.sql(f"SELECT 1L AS device_id, struct(1L AS item_no, true AS is_visit, true AS valid, 13.7D AS latitude, 100.5D AS longitude, {radius!r}D AS radius1sd) AS a, struct(2L AS item_no, false AS is_visit, false AS valid, 1L AS n_samples, 0D AS duration, 0D AS distance) AS b")
        assert merging.with_inside(pair, sample, "a", "b").first()["inside"] == share


def test_facts_in_one_pass_are_those_of_summaries(spark, some):
    from tests.compare import norm

    rows = lambda df: {(r.device_id, r.item_no): tuple(norm(r[c]) for c in merging.FACTS) for r in df.collect()}
    got = rows(merging.told(some))
    assert got == rows(merging.facts(I.summarize(some), some)) and len(got) > 10


def test_samples_are_not_shuffled_again_for_facts(spark, some):
    from wayfold.operators.tables import Scratch

    s = Scratch(spark).dealt(some.select(*merging.SAMPLE, F.lit(0).alias("next_start")), "test", *merging.KEYS)
    plan = merging.told(s, following="next_start")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan


def test_an_update_stages_types_alone(spark, some, monkeypatch):
    class Seen(Exception):
        pass

    def stop(df, tag):
        if tag == "typed":
            raise Seen(sorted(df.columns))
        return df

    monkeypatch.setattr(update, "staged", stop)
    monkeypatch.setattr(update, "reclassified", lambda samples, *_: samples)
    current = some.select("device_id", "item_no", F.col("item_no").alias("into"), F.lit(True).alias("kind_visit")).distinct()
    with pytest.raises(Seen) as seen:
        update.segment_update(some, current, some.limit(1), None, (), None)
    assert seen.value.args[0] == ["classified_type", "device_id", "item_no", "sample_id"]


def test_a_small_edit_broadcasts_no_samples(spark, sf):
    from tests.test_classifier import broadcast_rows

    s = samples(spark, sf).withColumn("previous_type", F.lag("confirmed_type").over(I.per_device()))
    models = staged(classifier.train(s), "models")
    names = classifier.known_names(models)
    n = staged(I.number_items(s.filter("not deleted")), "numbered")
    current = staged(n.select("device_id", "item_no", F.col("item_no").alias("into"), F.lit(True).alias("kind_visit")).distinct(), "current")
    hit = "device_id = 3 and item_no = 1"
    after = n.withColumn("confirmed_type", F.when(F.expr(hit) & (F.col("sample_id") % 2 == 0), "walking").otherwise(F.col("confirmed_type")))
    made = []
    rows = broadcast_rows(spark, lambda: made.extend(update.segment_update(after, current, after.filter(hit), models, names, s)[0].select("sample_id").collect()))
    assert {r.sample_id for r in made} <= {r.sample_id for r in n.filter(hit).collect()}
    assert rows and max(rows) < n.count(), (max(rows), n.count())
