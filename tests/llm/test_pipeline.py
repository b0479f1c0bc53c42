"""The pipeline, a stage at a time, against brute force on the stage's own input."""

import corpus_pipeline
from tests.llm.test_neardup import brute
from wayfold.llm import decontaminate, mixing, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        rows[name] = docs.count()
        if name == "toxicity":
            flags = {r.doc_id: r.flagged for r in toxicity.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, f in flags.items() if not f}
        elif name == "near_dedup":
            texts = sorted((r.doc_id, r.text) for r in before.collect())
            classes = brute(texts)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c: d for (d, _), c in reversed(list(zip(texts, classes)))}.values())
        elif name == "decontamination":
            bad = {r.id for r in decontaminate.leaks(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert bad and {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        elif name == "mixing":
            want = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(before).collect() if r.size}
            got = {}
            for r in docs.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == {d: n for d, n in want.items() if n}
        else:
            assert rows[name] == rows["mixing"]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
