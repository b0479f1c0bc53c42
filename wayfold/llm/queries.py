"""The corpus operators as queries over the driver's tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, editcount, linededup, mixing, neardup, pages, pii, quality, resample, sstable, tiered, toxicity
from .common import read, staged


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("first").alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "flagged",
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations parsed again; the model learns from three quarters of them, by crc32 of the id."""
    made = chat.transcribe(read(spark, sf_dir, "conversations"))
    made = staged(made.withColumn("id", F.struct("conv_id", "part", "n_turns", "roles", F.col("states").alias("truth"))), "transcripts")
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    model = chat.fit(made.filter(~F.coalesce(held, F.lit(False))))
    found = chat.parse(made, model, series=F.col("conv_id"), part=F.col("part"))
    right = F.aggregate(F.zip_with("states", "id.truth", lambda a, b: (F.floor(a / 2) == F.floor(b / 2)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "id.conv_id",
        "id.part",
        F.coalesce(F.crc32(F.col("id.conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
        "id.n_turns",
        F.size("turns").cast("long").alias("n_found"),
        F.size("states").cast("long").alias("n_lines"),
        right.alias("n_right"),
        F.array_join("turns.role", " ").alias("roles"),
        "rendered",
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(sstable.write(read(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json")))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of each document, from its kept tree; only touched leaves are encoded for the latter."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    trees = editcount.build(read(spark, sf_dir, "documents"), tokenizer_path=path)
    after = editcount.edit(trees, editcount.sample_edits(F.col("n_chars"), F.get("leaves", F.lit(0))), tokenizer_path=path)
    return after.select(
        "doc_id",
        F.col("n_before").alias("n_tokens"),
        F.size("leaves").cast("long").alias("n_leaves"),
        "n_edits",
        "n_encoded",
        F.col("n_tokens").alias("n_tokens_after"),
        F.col("n_chars").alias("n_chars_after"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiered.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score", "tier")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_rules, op3_toxicity, op4_chat_formatting, op5_line_dedup, op6_html_extraction, op7_sstable, op8_mixing, op9_edit_counts, op10_decontamination, op11_resample, op12_pii, op13_tiered_search)}
ORACLES = {"op2_quality_rules": quality.ORACLE, "op5_line_dedup": linededup.ORACLE, "op8_mixing": mixing.ORACLE}
