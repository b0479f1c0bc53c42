"""Thresholds of languages, on tables much larger than the sample the model is fitted on."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    """Texts with a vile word are toxic, one in five of those with a doubtful word are; "fr" has one row in fifty."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(12000):
        word, toxic = ("vile", 1) if i % 20 == 0 else ("doubtful", int(i % 25 == 1)) if i % 5 == 1 else ("mild", 0)
        docs.append((i, " ".join([word] * 3 + ["w%d" % rng.randrange(50) for _ in range(8)]), "fr" if rng.randrange(50) == 0 else "en"))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_thresholds_see_the_corpus_not_the_sample(tables):
    docs, labels = tables
    got = toxicity.classify(docs, labels, sample=400).join(docs.select("doc_id", F.element_at(F.split("text", " "), 1).alias("word")), "doc_id").groupBy("lang", "word").agg(F.avg(F.col("flagged").cast("int")).alias("share")).collect()
    share = {(r.lang, r.word): r.share for r in got}
    assert share["en", "vile"] > 0.95 and share["en", "doubtful"] < 0.05 and share["en", "mild"] < 0.05


def test_rare_languages_have_thresholds(tables):
    docs, labels = tables
    assert set(toxicity.train(docs, labels, sample=400)[1]) == {"en", "fr"}


def test_long_texts_count_for_thresholds(tables):
    docs, labels = tables
    longer = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.repeat(F.lit(" w1"), 8000))).otherwise(F.col("text")))
    assert set(toxicity.train(longer, labels, sample=400)[1]) == {"en", "fr"}


def test_best_cutoffs(spark):
    rows = [("a", 0.9, 1, False)] * 10 + [("a", 0.62, 0, False)] * 30 + [("a", 0.62, 1, False)] * 2 + [("b", 0.9, 1, False)] * 19 + [("c", 0.1, 0, False)] * 40 + [("c", 0.9, 1, True)] * 5 + [(None, 0.9, 1, False)] * 30
    known = spark.createDataFrame(rows, "lang string, score double, toxic int, fitted boolean")
    found = toxicity.best_cutoffs(known)
    assert found["a"] == 0.65 and set(found) == {"a", "b", "c"}  # few rows or one class: the other languages tell
    # of 100 toxic rows 90 were fitted on: the 10 left stand for all
    rows = [("a", 0.9, 1, False)] * 5 + [("a", 0.4, 1, False)] * 5 + [("a", 0.9, 1, True)] * 90 + [("a", 0.4, 0, False)] * 20
    assert toxicity.best_cutoffs(spark.createDataFrame(rows, "lang string, score double, toxic int, fitted boolean")) == {"a": 0.3}
