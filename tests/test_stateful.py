"""Sequential and streaming operators: against plain loops, and streams against batches."""

import tempfile

import pytest
from pyspark.sql import functions as F

from wayfold.operators import folds, merging
from wayfold.operators import items as I
from wayfold.operators.brain import states
from wayfold.operators.recorder import transitions
from wayfold.sources.samples import live_fixes, samples
from wayfold.streaming import live


def test_throttle_depends_on_what_was_accepted(spark):
    rows = [(1, t, i, a) for i, (t, a) in enumerate([(0, 10.0), (1, 20.0), (2, 30.0), (3, 5.0), (10, 50.0), (11, 40.0)])]
    df = spark.createDataFrame(rows, "device_id long, t long, sample_id long, h_acc double")
    assert sorted(r.sample_id for r in folds.throttled(df, 5.0).collect()) == [0, 3, 4, 5]


def test_kalman_rejects_old_and_unusable(spark):
    rows = [(1, 10, 1, 10.0, 20.0, 5.0, 7.0, 3.0), (1, 10, 2, 11.0, 20.0, 5.0, None, -1.0), (1, 20, 3, 0.0, 0.0, 5.0, 9.0, 3.0), (1, 30, 4, 10.0, 20.0, -1.0, 9.0, 3.0), (1, 40, 5, 10.1, 20.0, 5.0, 9.0, -1.0)]
    df = spark.createDataFrame(rows, "device_id long, t long, sample_id long, latitude double, longitude double, h_acc double, altitude double, v_acc double")
    got = {r.sample_id: r for r in folds.kalman(df).collect()}
    assert set(got) == {1, 5} and got[1].latitude == 10.0 and 10.0 < got[5].latitude < 10.1 and got[1].altitude == 7.0


def test_windows_settle_on_a_standstill(spark):
    rows = [(1, 10 * i, i, 13.7 + 1e-6 * (i % 3), 100.5, 10.0, 0.0) for i in range(60)] + [(1, 600 + 10 * i, 100 + i, 13.7 + 2e-3 * i, 100.5, 10.0, 20.0) for i in range(40)]
    df = spark.createDataFrame(rows, "device_id long, t long, sample_id long, latitude double, longitude double, h_acc double, speed double")
    got = {r.sample_id: r.state for r in states(df).collect()}
    assert got[50] == "stationary" and got[139] == "moving"
    assert all(r.n_present <= 60 for r in states(df).collect())


@pytest.fixture(scope="module")
def merged(spark, sf):
    s = I.number_items(samples(spark, sf).filter("not deleted"))
    return s, merging.merge_rounds(s)


def test_merging_keeps_every_sample_and_ends(spark, merged):
    before, after = merged
    assert after.count() == before.count() == after.select("sample_id").distinct().count()
    assert after.select("device_id", "item_no").distinct().count() < before.select("device_id", "item_no").distinct().count()
    plain = after.withColumn("moving_state", F.when(F.col("kind_visit"), "stationary").otherwise("moving"))
    left = merging.scored(merging.facts(I.summarize(plain), plain)).filter("score > 0")
    assert left.count() == 0


def test_merging_of_a_long_run_of_like_items_ends(spark):
    schema = "sample_id long, device_id long, t long, latitude double, longitude double, h_acc double, moving_state string, recording_state string, confirmed_type string, classified_type string"
    rows = [(i, 1, 10 * i, None, None, 5.0, ("moving", "stationary")[i // 2 % 2], "recording", None, None) for i in range(108)]
    s = I.number_items(spark.createDataFrame(rows, schema))
    assert s.select("item_no").distinct().count() == 54
    after = merging.merge_rounds(s)
    assert after.count() == 108 and after.select("item_no").distinct().count() == 1


def test_edge_items(spark):
    schema = "sample_id long, device_id long, t long, latitude double, longitude double, h_acc double, moving_state string, recording_state string, confirmed_type string, classified_type string"
    rows = [(1, 1, 0, None, None, 5.0, "stationary", "recording", None, None), (2, 2, 0, 0.0, 0.0, 5.0, "moving", "off", None, None), (3, 3, 0, 90.0, 180.0, 7.0, "moving", "recording", "car", None), (4, 3, 20, 90.0, 180.0, 7.0, "moving", "recording", "bus", None)]
    s = I.number_items(spark.createDataFrame(rows, schema))
    got = {r.device_id: r for r in I.summarize(s).collect()}
    assert not got[1].valid and got[1].n_usable == 0 and got[1].latitude is None
    assert got[2].is_gap and got[2].keepness == 0
    assert got[3].distance == 0 and got[3].duration == 20 and not got[3].valid
    assert I.summarize(s.limit(0)).count() == 0


def run(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def seen(spark, stream, rows, name, folder, records=10_000):
    """What a stream says of files of ``rows`` read one by one, and the watermark at its end."""
    for k, part in enumerate(rows):
        part.coalesce(1).write.parquet(f"{folder}/{name}/in{k}")
    source = spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}/in*")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        run(stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}/c").start())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return spark.table(name).collect()


@pytest.mark.parametrize("records", [2, 10_000])
def test_stream_equals_batch(spark, sf, records):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fixes = samples(spark, sf).withColumn("date", F.timestamp_seconds("t"))
    last = fixes.agg(F.max("t")).first()[0]
    # a far later fix of another device moves the watermark past all others
    late = fixes.limit(1).withColumns({"device_id": F.lit(-1).cast("long"), "t": F.lit(last + 1000).cast("long"), "date": F.timestamp_seconds(F.lit(last + 1000)), "latitude": F.lit(1.0), "longitude": F.lit(1.0)})
    parts = [fixes.orderBy(F.desc("t")), late]
    got = {r.sample_id: (round(r.latitude, 9), round(r.longitude, 9)) for r in seen(spark, live.filtered, parts, f"filtered{records}", folder, records) if r.device_id >= 0}
    want = {r.sample_id: (round(r.latitude, 9), round(r.longitude, 9)) for r in folds.kalman(fixes).collect()}
    assert got == want


def test_forgotten_keys_leave_the_state(spark, sf):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    row = "device_id long, t long, sample_id long, latitude double, longitude double, h_acc double"
    parts = [spark.createDataFrame([(1, 100, 1, 10.0, 20.0, 5.0)], row), spark.createDataFrame([(2, 5000, 2, 1.0, 1.0, 5.0)], row), spark.createDataFrame([(1, 9000, 3, 11.0, 20.0, 50.0), (2, 9000, 4, 1.0, 1.0, 5.0)], row), spark.createDataFrame([(2, 20000, 5, 1.0, 1.0, 5.0)], row)]
    parts = [p.withColumn("date", F.timestamp_seconds("t")) for p in parts]
    got = {r.sample_id: r.latitude for r in seen(spark, lambda s: live.filtered(s, forget=600), parts, "forgotten", folder)}
    assert got[3] == 11.0  # taken as it is: the filter began anew


def test_other_streams(spark, sf):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fixes = samples(spark, sf).filter("latitude is not null").withColumn("date", F.timestamp_seconds("t"))
    fixes.coalesce(1).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    run(live.windowed(stream).writeStream.format("memory").outputMode("append").queryName("windowed").option("checkpointLocation", f"{folder}/c2").start())
    assert spark.table("windowed").count() > 0
    changes = stream.withColumn("id", F.col("sample_id") % 50)
    live.upserts(changes, f"{folder}/out", ["id"], ["last_saved", "sample_id"], f"{folder}/c3").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 50
    active = live_fixes(spark, f"{folder}/in", schema.simpleString()[7:-1].replace(":", " "))
    assert active.isStreaming


EVENTS = "device_id long, t double, event_id long, kind string, moving string, until double"


def story():
    """A device that records, stands still, sleeps, is woken by a timer, moves again, and sleeps deeply; and one that stays in standby."""
    e = [(0, "start", None, None)] + [(t, "fix", "moving", None) for t in (10, 20)] + [(t, "fix", "stationary", None) for t in range(30, 250, 10)]
    e += [(305, "fix", "uncertain", None), (309, "fix", "moving", None), (320, "deep", None, 900.0), (330, "deep", None, 2000.0), (2010, "fix", "stationary", None), (2300, "fix", "moving", None), (2310, "stop", None, None), (2320, "fix", "moving", None)]
    rows = [(1, float(t), k, kind, moving, until) for k, (t, kind, moving, until) in enumerate(e)]
    return rows + [(2, 0.0, 100, "standby", None, None), (2, 50.0, 101, "fix", "moving", None), (2, 60.0, 102, "wakeup", None, None), (2, 61.0, 103, "fix", "stationary", None)]


def test_recorder_follows_events_and_timers(spark):
    got = [(r.t, r.state_before, r.state, r.cause) for r in transitions(spark.createDataFrame(story(), EVENTS)).filter("device_id = 1").orderBy("t").collect()]
    want = [(0, "off", "recording", "start"), (220, "recording", "sleeping", "fix"), (280, "sleeping", "wakeup", "timer"), (309, "wakeup", "recording", "fix"), (330, "recording", "deepSleeping", "deep"), (2000, "deepSleeping", "wakeup", "timer"), (2010, "wakeup", "sleeping", "fix")]
    assert got[:7] == [(float(t), *x) for t, *x in want]
    # asleep, it wakes each minute for half a minute, as long as nothing comes
    assert [(t, s) for t, _, s, _ in got[7:13]] == [(2070.0, "wakeup"), (2100.0, "sleeping"), (2160.0, "wakeup"), (2190.0, "sleeping"), (2250.0, "wakeup"), (2280.0, "sleeping")]
    assert got[-2:] == [(2300.0, "sleeping", "recording", "fix"), (2310.0, "recording", "off", "stop")]
    assert [(r.state, r.cause) for r in transitions(spark.createDataFrame(story(), EVENTS)).filter("device_id = 2").orderBy("t").collect()] == [("standby", "standby"), ("recording", "wakeup")]


def test_recorder_stream_equals_batch_and_timers_need_no_event(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    base = 10_000.0  # at time 0 a first event would be behind the first watermark
    events = [(d, t + base, *x) for d, t, *x in story() if not (d == 1 and t > 250)]
    files = (events[::-1], [(3, base + 1000, 900, "start", None, None)], [(3, base + 1100, 901, "stop", None, None)])
    parts = [spark.createDataFrame(x, EVENTS).withColumn("date", F.timestamp_seconds("t")) for x in files]
    told = lambda found: {(r.device_id, r.t - base, r.state) for r in found}
    got = told(seen(spark, live.recording, parts, "recording", folder))
    batch = told(transitions(spark.createDataFrame([*events, (1, base + 1040, 999, "fix", "uncertain", None)], EVENTS)).collect())
    mine = {x for x in got if x[0] == 1}
    assert mine == {x for x in batch if x[0] == 1 and x[1] <= 1040} and (1, 280.0, "wakeup") in mine and (1, 310.0, "sleeping") in mine
    assert {x for x in got if x[0] == 2} == {x for x in batch if x[0] == 2}


def test_debounced_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(1, 10.0, 5), (1, 10.4, 6), (1, 11.3, 5), (1, 12.4, 7), (2, 10.0, 1), (2, 12.0, 1)]
    make = lambda x: spark.createDataFrame(x, "device_id long, t double, sample_id long").withColumn("date", F.timestamp_millis((F.col("t") * 1000).cast("long")))
    told = lambda found: sorted((r.device_id, r.n_changes, tuple(r.changed)) for r in found)
    want = [(1, 1, (7,)), (1, 3, (5, 6)), (2, 1, (1,)), (2, 1, (1,))]
    assert told(live.debounced(make(rows)).collect()) == want
    parts = [make(rows[3:]), make(rows[:3]), make([(9, 500.0, 1)])]
    assert told(r for r in seen(spark, lambda s: live.debounced(s, late="60 seconds"), parts, "debounced", folder) if r.device_id < 9) == want


def plain_windows(fixes):
    """The windows once more, by lists and a mark for sleep, written apart from the operator."""
    out, now, past, frozen, v, last, at = [], [], [], False, -1.0, None, None
    asleep_before = False
    for t, lat, lng, acc, asleep in fixes:
        if asleep and not asleep_before:
            now, frozen = [], True
            v = 90000.0 if last is not None else v
        asleep_before = asleep
        if v < 0:
            v, at = acc * acc, (lat, lng)
        else:
            v += (t - last) * 16
            k = v / (v + acc * acc)
            at = (at[0] + k * (lat - at[0]), at[1] + k * (lng - at[1]))
            v *= 1 - k
        last = t
        now.append((*at, acc))
        while len(now) > max(10, min(60, int(v**0.5 + 10))) or (not frozen and len(now) > max(1, len(past) + 4)):
            if not frozen:
                past.append(now[0])
            now = now[1:]
        if not frozen:
            past = past[-max(2, len(now)) :]
        out.append((len(now), len(past), frozen))
        frozen = frozen and len(now) < 10
    return out


def test_frozen_windows_same_as_plain_lists(spark):
    rows = [(1, 10 * k, k, 13.7 + 1e-5 * (k % 4), 100.5, 5.0 + k % 30, 0.0, "sleeping" if 40 <= k < 44 or 60 <= k < 62 else "recording") for k in range(120)]
    df = spark.createDataFrame(rows, "device_id long, t long, sample_id long, latitude double, longitude double, h_acc double, speed double, recording_state string")
    got = states(df, sleeps=True).orderBy("t").collect()
    assert [(r.n_present, r.n_past, r.frozen) for r in got] == plain_windows([(r[1], r[3], r[4], r[5], r[7] == "sleeping") for r in rows])
    assert any(r.frozen for r in got) and not got[-1].frozen and got[40].n_present == 1 and got[39].n_past == got[45].n_past
    assert [r.frozen for r in states(df).collect()] == [False] * 120


def test_nearest_is_linear_and_settles_ties(spark):
    import time

    from wayfold.operators import joins

    left = spark.range(40_000).select(F.lit(1).cast("long").alias("device_id"), (F.col("id") * 3).alias("t"))
    right = spark.range(40_000).select(F.lit(1).cast("long").alias("device_id"), (F.col("id") * 2).alias("t"), F.col("id").alias("v"))
    began = time.time()
    got = {r.t: (r.near_t, r.near_v) for r in joins.nearest(left, right, "v").filter("t < 12").collect()}
    assert got == {0: (0, 0), 3: (2, 1), 6: (6, 3), 9: (8, 4)} and time.time() - began < 30
    tied = spark.createDataFrame([(1, 5, 7), (1, 5, 9), (1, 9, 3), (1, 9, 1)], "device_id long, t long, v long")
    asked = spark.createDataFrame([(1, 6), (1, 8)], "device_id long, t long")
    assert {(r.t, r.near_t, r.near_v) for r in joins.nearest(asked, tied, "v").collect()} == {(6, 5, 9), (8, 9, 1)}
    assert {(r.t, r.right_v) for r in joins.as_of(asked, tied, ["v"]).collect()} == {(6, 9), (8, 9)}


def test_trust_is_a_hook_of_the_filter(spark, sf):
    s = samples(spark, sf)
    plain = {r.sample_id: r.latitude for r in folds.kalman(s).collect()}
    place = s.filter("latitude is not null").select("device_id", F.lit(0.0).alias("trust"), "latitude", "longitude")
    distrust = place.select("device_id", "trust", F.round("latitude", 4).alias("lat4"), F.round("longitude", 4).alias("lng4")).distinct()
    worse = {r.sample_id: r.latitude for r in folds.kalman(s, trust=distrust).collect()}
    assert worse.keys() == plain.keys() and sum(worse[k] != plain[k] for k in plain) > len(plain) / 2
    none = {r.sample_id: r.latitude for r in folds.kalman(s, trust=distrust.limit(0)).collect()}
    assert none == plain


def test_trust_is_by_device(spark):
    from wayfold.operators import stats

    row = "device_id long, t long, sample_id long, last_saved long, latitude double, longitude double, h_acc double, speed double, confirmed_type string"
    rows = [(d, k, 10 * d + k, k, None if k == 3 else 10.0, 20.0, 5.0, float(d), "stationary") for d in (1, 2) for k in range(4)]
    got = {r.device_id: (round(r.trust, 6)) for r in stats.coordinate_trust(spark.createDataFrame(rows, row), most=2).collect()}
    assert got == {1: 0.28, 2: 0.0}
