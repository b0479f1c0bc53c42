"""Model tables kept across runs, selection of quartiles, and chains cut into spans."""

import random

from pyspark.sql import functions as F

from wayfold.operators import classifier as C
from wayfold.operators import items as I
from wayfold.operators import models as M
from wayfold.operators.tables import staged
from wayfold.sources.samples import samples


def table(df):
    return {(r.depth, round(r.cell_lat, 4), round(r.cell_lng, 4), r.confirmed_type): (r.total_samples, round(r.moving_pct, 9), r.top, r.speed and list(r.speed.bins), r.altitude and list(r.altitude.bins)) for r in df.collect()}


def test_few_new_rows_retrain_few_cells_and_equal_training_from_scratch(spark, sf):
    s = staged(samples(spark, sf), "samples")
    usable = s.filter("confirmed_type is not null and latitude is not null")
    place = usable.orderBy(F.desc("sample_id")).first()
    new = usable.filter((F.abs(F.col("latitude") - place.latitude) < 1e-3) & (F.abs(F.col("longitude") - place.longitude) < 1e-3)).limit(5)
    new = staged(new, "new")
    old = s.join(new.select("sample_id"), "sample_id", "left_anti")
    models = staged(C.train(old).withColumn("updated", F.lit(0.0)), "models")
    made, kept = C.refreshed(models, s, new, now=1e9)
    scratch, made, kept = table(C.train(s)), table(made), table(kept)
    assert made.keys().isdisjoint(kept.keys()) and made | kept == scratch
    assert 0 < len({k[:3] for k in made}) < len({k[:3] for k in scratch})
    # a set that is fresh stays, whatever is new; one that isn't there is trained
    assert C.due(models, new, now=1.0).filter("depth = 0").count() == 0
    assert C.due(models.limit(0), new, now=1.0).count() == len({k[:3] for k in made})


def test_quartiles_are_exact(spark):
    rng = random.Random(3)
    groups = {"even": [float(k) for k in range(5000)], "far": [rng.random() for _ in range(3000)] + [1e12], "same": [7.0] * 900, "two": [1.0, 2.0], "one": [3.5], "skew": [2.0 ** -rng.randrange(900) for _ in range(2000)], "signs": [rng.gauss(0, 1) for _ in range(4000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    v = spark.createDataFrame(rows, "k string, value double")
    ends = v.groupBy("k").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_all"))
    whole = lambda q: F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.floor(F.col("_all") * q).alias("rank")).alias(f"q{1 if q < 0.5 else 3}")
    got = {r.k: (r.q1, r.q3) for r in M.quartiles(v, ends.select("k", "_all", whole(0.25), whole(0.75)), ["k"], ["_all"], bins=16, rounds=2).collect()}
    assert got == {k: (sorted(x)[len(x) // 4], sorted(x)[len(x) * 3 // 4]) for k, x in groups.items()}


def test_spans_change_no_chain(spark, sf):
    s = samples(spark, sf).filter("device_id < 4").withColumn("previous_type", F.lag("confirmed_type").over(I.per_device()))
    models = staged(C.train(s), "models")
    names = C.known_names(models)
    n = staged(I.number_items(s), "numbered")
    rows = lambda seconds: {(r.sample_id, r.previous, r.name, r.score) for r in C.chained(n, models, names, s, seconds=seconds).collect()}
    assert rows(40) == rows(86400)
    assert C.chained(n.limit(0), models, names, s).count() == 0


def test_samples_of_complete_cells_ask_no_model_of_the_world(spark):
    def asked(n):
        s = spark.range(n + 1).select(F.col("id").alias("sample_id"), F.when(F.col("id") < n, 13.75).alias("latitude"), F.lit(100.55).alias("longitude"), F.lit(5.0).alias("h_acc"), F.lit("walking").alias("confirmed_type"))
        return C.unsettled(s, s).count()

    assert asked(M.CAPS[0]) == 1  # the one without a place
    assert asked(M.CAPS[1] - 1) == M.CAPS[1]


def test_no_sample_carries_a_set_of_models_through_a_shuffle(spark, sf):
    s = samples(spark, sf).withColumn("previous_type", F.lag("confirmed_type").over(I.per_device()))
    models = staged(C.train(s), "models")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        table = C.parts(s, models, C.known_names(models), ["sample_id"], trained=s)
        plan = table._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    moved = [block for block in plan.split("\n\n") if "Exchange\n" in block and "sample_id#" in block and "h_acc#" in block]
    assert moved
    assert not [block for block in moved if any(f"{c}#" in block.replace("[", " ").replace(",", " ").split("Arguments")[0] for c in (" c0", " c1", " c2"))], moved


def broadcast_rows(spark, run):
    """The rows of each broadcast that ``run`` makes."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = spark._jsc.sc().listenerBus().waitUntilEmpty
    wait()
    listed = lambda seq: [seq.apply(k) for k in range(seq.size())]
    before = {x.executionId() for x in listed(store.executionsList())}
    run()
    wait()
    rows = []
    for i in {x.executionId() for x in listed(store.executionsList())} - before:
        values, it = {}, store.executionMetrics(i).iterator()
        while it.hasNext():
            pair = it.next()
            values[pair._1()] = pair._2()
        for node in listed(store.planGraph(i).allNodes().toSeq()):
            if node.name() == "BroadcastExchange":
                counts = [values.get(m.accumulatorId()) for m in listed(node.metrics().toSeq()) if m.name() == "number of output rows"]
                rows += [int(n.replace(",", "")) for n in counts if n]
    return rows


def test_training_broadcasts_what_is_known_of_keys_and_never_the_values(spark):
    n, keys = 20_000, 5
    values = staged(spark.range(n).select((F.col("id") % keys).alias("k"), F.sqrt(F.col("id").cast("double")).alias("value")), "values")
    made = []
    rows = broadcast_rows(spark, lambda: made.extend(M.histograms(values, "k", trim=True, low=0.0).collect()))
    assert sorted(r.k for r in made) == list(range(keys)) and all(sum(r.bins) == n / keys + len(r.bins) for r in made)
    assert rows and max(rows) <= keys, rows
