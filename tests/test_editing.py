"""Samples that change sides at the edges of a visit, worked out by hand."""

from wayfold.operators import editing, merging
from wayfold.operators import items as I

COLUMNS = "sample_id long, device_id long, t long, latitude double, longitude double, h_acc double, speed double, moving_state string, recording_state string, confirmed_type string, classified_type string, item_no long"


def rows(spark, *items):
    """Items of (still, [latitude offsets in metres]), 20 seconds a sample."""
    out = []
    for no, (still, places) in enumerate(items, 1):
        for m in places:
            n = len(out)
            kind = "stationary" if still else "walking"
            out.append((n, 1, 20 * n, 10 + m / 111_195, 20.0, 5.0, 1.0, "stationary" if still else "moving", "recording", kind, kind, no))
    return spark.createDataFrame(out, COLUMNS)


def test_edges_of_a_visit(spark):
    # the first path ends outside, so it gets the visit's first sample; the second begins inside, and its fifth sample's next is outside
    s = rows(spark, (False, [3000, 2000, 1000]), (True, [0] * 10), (False, [3, 3, 3, 3, 3, 1000, 2000, 3000]))
    got = {r.sample_id: (r.item_no, r.kind_visit, r.moved) for r in editing.sanitise_edges(s).collect()}
    want = {n: (1, False, False) for n in range(3)} | {3: (1, False, True)} | {n: (2, True, False) for n in range(4, 13)}
    want |= {n: (2, True, True) for n in range(13, 17)} | {n: (3, False, False) for n in range(17, 21)}
    assert got == want


def test_short_paths_keep_their_samples(spark):
    # a path of three between two visits loses one of its two edges, then none
    s = rows(spark, (True, [0] * 6), (False, [1, 1, 1]), (True, [0] * 6))
    got = [r.item_no for r in editing.sanitise_edges(s).orderBy("sample_id").collect()]
    assert got == [1] * 7 + [2] * 2 + [3] * 6


def test_nothing_to_do(spark):
    assert editing.sanitise_edges(rows(spark, (True, [0] * 3)).limit(0)).count() == 0
    alone = rows(spark, (True, [0] * 3))
    assert {r.item_no for r in editing.sanitise_edges(alone).collect()} == {1}


def test_an_item_that_ends_after_all_others_begin_is_linked_on(spark):
    # no item begins at or after the broken edge's time, so the nearest one lies before it
    columns = "device_id long, item_no long, start_t long, end_t long, is_visit boolean, previous long, next long, current boolean, gone boolean, locked boolean"
    items = spark.createDataFrame([(1, 1, 0, 500, False, None, None, False, False, False), (1, 2, 100, 140, True, None, None, True, False, False)], columns)
    got = {r.item_no: (r.absorbed_by, r.previous, r.next) for r in editing.healed(items).collect()}
    assert got == {1: (None, 2, 2), 2: (None, 1, None)}


def test_a_path_that_lies_in_the_visit_is_deleted_into_it_with_a_higher_score(spark):
    def score(*path):
        s = rows(spark, (True, [0] * 10), (False, path))
        return {r.item_no: (r.k, r.b, r.d, r.score) for r in editing.safe_deletes(merging.facts(I.summarize(s), s), s).collect()}[2]

    assert score(0, 1, 2) == (1, None, 2, 2)
    assert score(500, 501, 502) == (1, None, 2, 1)  # none inside


def test_edges_are_judged_where_the_samples_lie(spark):
    from wayfold.operators.tables import Scratch

    s = Scratch(spark).dealt(rows(spark, (False, [3000, 2000, 1000]), (True, [0] * 10)), "test", "device_id")
    moves = editing.edge_moves(merging.told(editing._beside(s), merging.LIMITS, None, *editing._tips()))
    assert "Exchange" not in moves._jdf.queryExecution().executedPlan().toString()
    assert [(r.sample_id, r.from_no, r.to_no, r.to_visit) for r in moves.collect()] == [(3, 2, 1, False)]
