"""The corpus pipeline: documents through toxicity, near-dedup, decontamination, mixing and token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each stage's result as
Parquet in the shared folder and reads it for the next. The last returns what was read back from the token shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import common, decontaminate, mixing, neardup, sstable, toxicity
from wayfold.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, common.read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.digest(sstable.write(docs, tokenizer=tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_shards", write_shards),
]

#: SQL can't express a trained network, hashed darts or tokenizers; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = common.read(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES:
        made = scratch.staged(stage(spark, docs, sf_dir), name)
        scratch.drop(but=(made,))  # what the stage read
        docs = made
    return docs
