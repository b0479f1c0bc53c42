"""Patterns against plain regular expressions, the lattice against all segmentations, and held-out forms."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import pii
from wayfold.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    d = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        twice = [(int(c) * (1 + k % 2)) for k, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if holds(kind, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "..", "-", " ", "+", "(", ")", "1", "25", "256", "007", "4111", "1111", "x.y", "\n", "é", "٣", "+1 (555) 123-4567", "4111 1111 1111 1111", "1.2.3.4"]), max_size=14).map("".join))
def test_patterns_same_as_regular_expressions(text):
    assert pii.patterns(text) == plain(text)


def test_patterns_are_linear():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 5 * 10**5, "a@" * 3 * 10**5, "+1" * 3 * 10**5, "(" * 10**6, "+1" + "-" * 10**6):
        assert pii.patterns(text) == [] or text.startswith("1.")


def test_lattice_sums_and_bests_all_segmentations():
    rng = np.random.default_rng(0)
    n, most, kinds = 5, 3, 2
    s = rng.normal(size=(1, n, most, kinds))
    s[0, 1, 2, 0] = pii.LOW
    s[0][np.add.outer(np.arange(n), np.arange(1, most + 1)) > n] = pii.LOW  # no candidate runs over the end
    moves = rng.normal(size=(kinds + 1, kinds + 1))

    def ways(t):
        if t == n:
            yield []
            return
        for tail in ways(t + 1):
            yield [(t, 1, kinds), *tail]
        for m, k in itertools.product(range(1, most + 1), range(kinds)):
            if t + m <= n:
                for tail in ways(t + m):
                    yield [(t, m, k), *tail]

    def value(way):
        return sum(s[0, t, m - 1, k] for t, m, k in way if k < kinds) + sum(moves[a[2], b[2]] for a, b in zip(way, way[1:]))

    every = [(value(w), w) for w in ways(0)]
    z = np.logaddexp.reduce([v for v, _ in every])
    want, want_moves = np.zeros_like(s), np.zeros_like(moves)
    for v, w in every:
        p = np.exp(v - z)
        for t, m, k in w:
            if k < kinds:
                want[0, t, m - 1, k] += p
        for a, b in zip(w, w[1:]):
            want_moves[a[2], b[2]] += p
    best = max(every, key=lambda x: x[0])[1]
    lattice = pii.Lattice(s, np.array([n]), moves)
    chance, moved = lattice.expected()
    assert np.allclose(chance, want) and np.allclose(moved, want_moves)
    assert lattice.best()[::-1] == [(0, *x) for x in best if x[2] < kinds]


@pytest.fixture(scope="module")
def model():
    return pii.fit(pii.made_lines(["river", "stone", "window", "the", "paper", "garden", "letter", "cloud"], 500))


def test_held_out_forms(model):
    made = pii.made_lines(["maison", "route", "soleil", "und", "strasse", "el", "camino"], 300, seed=5)
    got = model.spans([x for x, _ in made])
    right = sum(len(set(g) & set(w)) for g, (_, w) in zip(got, made))
    assert right >= 0.9 * sum(len(w) for _, w in made) and right >= 0.9 * sum(map(len, got))
    more = sum(len(set(w) - set(pii.patterns(x))) for x, w in made)
    found = sum(len((set(g) & set(w)) - set(pii.patterns(x))) for g, (x, w) in zip(got, made))
    assert found >= 0.8 * more > 40  # forms that the patterns don't know


def test_query_same_as_regular_expressions(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = list(PLAIN)
    got = QUERIES["op12_pii"](spark, sf).collect()
    assert len(got) == len(docs)
    added = 0
    for r in got:
        want = plain(docs[r.doc_id])
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in want) for k in range(4)]
        spans = set(filter(None, r.spans.split(",")))
        assert set(filter(None, text.split(","))) <= spans
        added += len(spans) - len(want)
    assert added <= 0.01 * len(docs)


def test_odd_rows(spark, model):
    card = "4111 1111 1111 1111"
    odd = [(1, None), (2, ""), (3, f"pay {card} now"), (3, f"pay {card} now"), (None, "x " * 30000 + "a@b.co"), (4, "one river (at) stone (dot) com two"), (5, "1 " * 3000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"id": F.lit("x"), "spans": F.lit(1), "base": F.lit(2)})
    got = {(r.id, r.redacted): [(x.kind, x.start, x.end, x.base) for x in r.spans] for r in pii.find(docs, model, redact=True).collect()}
    assert got[1, None] == [] and got[2, ""] == [] and got[3, "pay [CARD] now"] == [("card", 4, 23, True)]
    assert got[None, "x " * 30000 + "[EMAIL]"] == [("email", 60000, 60006, True)]
    assert got[4, "one [EMAIL] two"] == [("email", 4, 30, False)]
    assert pii.find(docs.limit(0), model).count() == 0
    assert pii.train(docs.limit(0), made=20).weights.any()
    assert pii.merged([(0, 1, 5), (9, 3, 12)], [(4, 2, 6), (5, 2, 9), (11, 0, 20), (12, 0, 20)]) == [(0, 1, 5, True), (5, 2, 9, False), (9, 3, 12, True), (12, 0, 20, False)]
