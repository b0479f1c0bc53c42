import random
from collections import Counter

import numpy as np
from pyspark.sql import Row

from wayfold.llm import common, neardup
from wayfold.llm.components import components, joined
from wayfold.llm.queries import QUERIES


def brute(rows, width=5, least=0.8):
    """Classes by comparing all texts: {index: class}."""
    sets = []
    for _, t in rows:
        w = "".join(" " if c in common.SPACES else c for c in t or "").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, (_, t) in enumerate(rows):
        by.setdefault(t or "", []).append(i)
    for g in by.values():
        for i in g[1:]:
            up[top(i)] = top(g[0])
    heads = [g[0] for g in by.values()]
    index = {}
    for i in heads:
        shared = Counter(j for s in sets[i] for j in index.get(s, ()))
        for j, n in shared.items():
            if n >= least * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    return [top(i) for i in range(len(rows))]


def partition(ids, classes):
    by = {}
    for i, c in zip(ids, classes):
        by.setdefault(c, []).append(i)
    return sorted(tuple(sorted(x)) for x in by.values())


def test_same_classes_as_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op1_minhash_near_dedup"](spark, sf).collect()
    assert partition([r.doc_id for r in got], [r.class_id for r in got]) == partition([r[0] for r in rows], brute(rows))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[int(rng.integers(0, 150))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{x}" for x in rng.integers(0, 10**6, 80))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.classes(df).collect()
    assert partition([r.id for r in got], [r.class_id for r in got]) == partition([r[0] for r in rows], brute(rows))


def test_large_group_of_texts_somewhat_alike(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 150))] = f"x{rng.integers(0, 3000)}"
        rows.append((i, " ".join(w)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = partition([r[0] for r in rows], brute(rows))
    assert len(want) > 20 and partition([r.id for r in got], [r.class_id for r in got]) == want


def test_edges(spark):
    rows = [Row(doc_id=1, text=None, v=1, root="a"), Row(doc_id=2, text="", v=1, root="a"), Row(doc_id=3, text="a b", v=2, root="b"), Row(doc_id=4, text="a  b", v=3, root="c"), Row(doc_id=4, text="a  b", v=3, root="c"), Row(doc_id=None, text="q r s t u v", v=None, root=None), Row(doc_id=9, text="x " * 30000, v=4, root="d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, v long, root string")
    got = {(r.id, r.class_id, r.class_size) for r in neardup.classes(df).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (None, None, 1), (9, 9, 1)}
    kept = neardup.dedup(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "9", "None"]
    assert neardup.classes(df.limit(0)).count() == 0


def test_signature_estimates_weighted_jaccard():
    a = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    weight = np.concatenate([np.full(100, 3.0), np.ones(100), np.full(100, 1.5), np.full(100, 2.0)])
    agree = []
    for s in range(30):
        sig = neardup.signatures(common.mix(np.concatenate([a, a]) + np.uint64(s)), weight, np.array([0, 200, 400]), 192)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - 0.5) < 0.03


def test_texts_and_their_repeated_selves(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(8):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        rows += [(10 * i + n, " ".join(base * n)) for n in (1, 2, 3, 4)]
    rows += [(1000 + i, " ".join(f"y{x}" for x in rng.integers(0, 10**6, 80))) for i in range(20)] + [(2000, None), (2001, "one two")]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = partition([r[0] for r in rows], brute(rows))
    assert len(want) == 30 and partition([r.id for r in got], [r.class_id for r in got]) == want


def test_components_joined_by_further_edges(spark):
    rng = random.Random(4)
    for n in (3, 40, 120):
        first = [(rng.randrange(80), rng.randrange(80)) for _ in range(n)]
        more = [(rng.randrange(120), rng.randrange(120)) for _ in range(n // 3)]
        one, two, both = (spark.createDataFrame([e for e in x if e[0] != e[1]], "a long, b long") for x in (first, more, first + more))
        scratch = common.Scratch(spark)
        got = joined(components(one, scratch), two, scratch)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components(both, scratch).collect()))
        assert sorted(map(tuple, joined(components(one, scratch), two.limit(0), scratch).collect())) == sorted(map(tuple, components(one, scratch).collect()))
