"""Importance resampling against plain Python over all of sf0.001, and odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayfold.llm import resample
from wayfold.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    d, t = [(i, *features(x)) for i, x in docs], [b for x in target for b in features(x)[1]]
    s = [0] * 10000
    for _, _, f in d:
        for b in f:
            s[b] += 1
    u = [0] * 10000
    for b in t:
        u[b] += 1
    big_s, big_t = sum(s), sum(u)
    gain = [math.floor(1000 * math.log((u[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in d:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def rows(df):
    return sorted(((r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_query_same_as_plain_python(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert rows(resample.resample(docs, target)) == want
    got = QUERIES["op11_resample"](spark, sf)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str) == want
    assert {c: t for c, t in got.dtypes if c != "doc_id"} == dict.fromkeys(("n_features", "weight", "score", "rank", "n_words"), "bigint")


def test_odd_rows(spark):
    long = "Ünï x" + "y" * 3000 + " a-b_C " * 40000
    odd = [(1, None), (2, ""), (3, "!!"), (None, "w " * 50), (4, long), (5, "q r s " * 20), (5, "q r s " * 20), (6, "été Q1 " * 30), (7, "x" * 30 + " a")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"id": F.lit("x"), "Weight": F.lit(1), "rank": F.lit(2), "part": F.lit(3)})
    target = spark.createDataFrame([(1, "q r s t"), (2, None), (3, "")], "item_id long, text string")
    for percent in (5, 60, 100):
        assert rows(resample.resample(docs, target, percent=percent)) == brute(odd, ["q r s t"], percent)
    assert resample.resample(docs.limit(0), target).count() == 0
    assert rows(resample.resample(docs, target.limit(0), percent=50)) == brute(odd, [], 50)


def test_blocks_and_long_words(monkeypatch):
    text = " ".join(f"w{k % 7}" + "z" * (k % 40) for k in range(500))
    column = pa.array([text, None, "a b", text])
    found = list(resample.features(column, block=13))
    got = [[], [], [], []]
    for row, bucket in found[1:]:
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r].append(b)
    assert found[0].tolist() == [500, 0, 2, 500]
    assert [sorted(g) for g in got] == [sorted(features(t)[1]) for t in column.to_pylist()]
    assert int(resample._appended(np.array([zlib.crc32(b"abc")], np.uint32), np.array([70000]))[0]) ^ zlib.crc32(b"\0" * 70000) == zlib.crc32(b"abc" + b"\0" * 70000)
