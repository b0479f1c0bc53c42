"""Importance resampling towards a target text, with hashed n-gram features, in two Arrow passes.

The first pass counts features: a task adds up its batches' bucket counts with ``np.bincount`` into one vector of
``BUCKETS`` numbers, and the tasks' vectors are merged by ``treeReduce``, so the driver adds up a few vectors however
many tasks there are. The vectors of corpus and target give each bucket's gain, a whole number. The second pass looks
the gains up, which are broadcast (80 kB), and sums them by document with ``np.bincount`` weights. Both passes read the
text where it lies; no feature is shuffled.

A feature's bucket is the CRC-32 of its words joined by spaces. A word's CRC is worked out once; that of a run is put
together from its words' (CRCs are linear, so appending n bytes is a fixed map of 32 bits, looked up by bytes).

The draw adds noise to weights (the Gumbel trick: the k highest sums are a weighted sample without replacement), and
takes an exact share: a percentile sketch's lower bound keeps a little more than that, which is sorted by ranges over
all tasks and numbered by the ranges' sizes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, terms

BUCKETS = 10000
LONGEST = 3
_POLY = 0xEDB88320


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(_POLY), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][x >> np.uint32(8 * k) & np.uint32(255)]
    return out


def _shifts(powers: int = 40) -> list[np.ndarray]:
    """For each k the map of a CRC when 2 ** k bytes are appended, as a look-up for each of its four bytes."""
    bytes_ = np.arange(256, dtype=np.uint32)
    basis = np.stack([bytes_ << np.uint32(8 * k) for k in range(4)])
    step = np.stack([(b >> np.uint32(8)) ^ _CRC[b & np.uint32(255)] for b in basis])
    out = [step]
    for _ in range(powers - 1):
        out.append(np.stack([_apply(out[-1], t) for t in out[-1]]))
    return out


_SHIFT = _shifts()


def _appended(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What remains of ``crc`` when ``size`` bytes follow; xor-ed with their own CRC it is the whole's."""
    out = crc.copy()
    k = 0
    while len(size) and int(size.max()) >> k:
        on = np.flatnonzero(size >> k & 1)
        out[on] = _apply(_SHIFT[k], out[on])
        k += 1
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, common_size: int = 24) -> np.ndarray:
    """CRC-32 of each word: byte after byte over all words at once; the few long words one by one."""
    size = ends - starts
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    long = np.flatnonzero(size > common_size)
    on = np.flatnonzero(size <= common_size)
    k = 0
    while len(on):
        x = crc[on]
        crc[on] = _CRC[(x ^ raw[starts[on] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
        k += 1
        on = on[size[on] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in long.tolist():
        crc[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return crc


def features(column, block: int = 1 << 17):
    """Yields (row, bucket) arrays of all features of an Arrow string column, ``block`` words at a time, and their word counts first."""
    raw, starts, ends, first = common.word_places(terms.folded(column))
    yield np.diff(first)
    space = np.uint32(zlib.crc32(b" "))
    for a in range(0, len(starts), block):
        b = min(len(starts), a + block + LONGEST - 1)
        head = min(block, len(starts) - a)
        size = ends[a:b] - starts[a:b]
        crc = word_crcs(raw, starts[a:b], ends[a:b])
        kinds, which = np.unique(size, return_inverse=True)
        spaced = _appended(np.full(len(kinds), space, np.uint32), kinds)[which] ^ crc  # the word with a space before it
        row = np.searchsorted(first, np.arange(a, b), side="right") - 1
        run = crc[:head]
        yield row[:head], (run % np.uint32(BUCKETS)).astype(np.int64)
        for n in range(2, LONGEST + 1):
            last = b - a - n + 1
            run = run[:last]
            run = _appended(run, size[n - 1 : n - 1 + len(run)] + 1) ^ spaced[n - 1 : n - 1 + len(run)]
            inside = row[: len(run)] == row[n - 1 : n - 1 + len(run)]
            yield row[: len(run)][inside], (run[inside] % np.uint32(BUCKETS)).astype(np.int64)


def _counted(batches):
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for part in common.slices(whole, "text"):
            found = features(part.column(0))
            next(found)
            for _, bucket in found:
                total += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket: one vector a task, merged as a tree."""
    vectors = common.arrow_map(texts.select(F.col(text_col).cast("string").alias("text")), _counted, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of a bucket's share in the target by its share in the corpus), both with one added to each bucket."""
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(batches, shared):
    import pyarrow as pa

    gain = shared.value.astype(np.float64)
    for whole in batches:
        for part in common.slices(whole, "text"):
            found = features(part.column(1))
            n_words = next(found)
            n, weight = np.zeros(len(part), np.int64), np.zeros(len(part))
            for row, bucket in found:
                n += np.bincount(row, minlength=len(part))
                weight += np.bincount(row, weights=gain[bucket], minlength=len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n_words, n, weight.astype(np.int64)))], ["id", "n_words", "n_features", "weight"])


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln u)), u in (0, 1) from the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank is null for rows not drawn.

    Drawn are floor(``percent`` * N / 100) of the N rows with ``least_words`` words or more: the highest scores, ties to
    the smaller id. Null and empty texts have no words, no features and weight 0. A null id is hashed as an empty text
    and comes after all others among ties; rows of one id are rows each, and share their noise. With an empty target all buckets count 1 there;
    an empty ``docs`` gives an empty result. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(d.dtypes)["id"]
    shared = spark.sparkContext.broadcast(gains(counts(docs, text_col), counts(target)))
    made = common.arrow_map(d, lambda it: _weighed(it, shared), f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    # rows alike in id and score are parted by chance, written once
    scored = scratch.staged(made.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), F.rand(seed).alias("tie")), "scored")
    shared.destroy()

    fit = scored.filter(F.col("n_words") >= least_words)
    share = 1 - percent / 100 - 0.002  # the sketch is off by n / 1000 at most
    n, cut = fit.agg(F.count("*"), F.percentile_approx("score", share, 1000) if share > 0 else F.min("score")).first()
    drawn, cut = percent * n // 100, cut or 0
    order = [F.desc("score"), F.asc_nulls_last("id"), "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    high = fit.filter(F.col("score") >= cut).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    high = scratch.staged(high, "high")
    sizes = high.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = high.join(F.broadcast(before), "part").withColumn("rank", F.when(place <= drawn, place).cast("long"))
    rest = scored.filter(~((F.col("n_words") >= least_words) & (F.col("score") >= cut))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))
