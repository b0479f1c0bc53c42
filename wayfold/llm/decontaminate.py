"""Benchmark decontamination by greedy string tiling with running Karp-Rabin (Wise, 1993).

Words are lower-cased and stripped of punctuation. Runs of ``seed`` words are seeds. Of a document only the stretches
of words that lie in seeds of the benchmark matter, since every tile consists of such: a first map keeps these, with a
bitmap of the benchmark's seed hashes of a fixed size, so that nearly all text stays where it is. Spark joins the
stretches' seeds with the items' seeds by hash, and counts how many of an item's words the seeds that it shares with a
document cover: tiles can't cover more. A pair that reaches the threshold shares more than any seeds that cover less of
the item; so the item's most frequent seeds, as long as together they cover less, need not find candidates: a passage that
many documents and many items share makes no pairs by itself. The pairs that may reach the threshold are tiled: the longest run of
words that both have, unmarked, is marked in both, again and again, until none of ``seed`` words is left. The share of the item's
words under tiles is its coverage: passages that were cut up and reordered count as much as whole ones.

Neither the benchmark nor anything of the documents passes through the driver, but for the bitmap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The bitmap has 2 ** BITS bits: 4 MB.
BITS = 25


def plain(text: Column) -> Column:
    """A text's words as they are compared, apart by one space: lower case, letters and digits alone."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


class _Rolling:
    """Karp-Rabin hashes of all runs of words of one text, any length, from sums of powers (modulo 2 ** 64)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
        self.marks = np.zeros(n + 1, np.int64)  # marked words before each place
        self.free = np.ones(n, bool)

    def mark(self, at: int, n: int) -> None:
        self.free[at : at + n] = False

    def settle(self) -> None:
        self.marks[1:] = np.cumsum(~self.free)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked runs of n words."""
        at = np.flatnonzero(self.marks[n:] == self.marks[: len(self.marks) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tile(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """How many words of ``b`` lie under tiles of ``a`` and ``b``: greedy string tiling, tiles of ``least`` words or more.

    The length of the longest unmarked run that both have is found by halving, each time hashing all runs of that
    length (running Karp-Rabin): time grows with the texts' lengths, also where one word is repeated throughout. Runs of that
    length are marked in the order of their place in b, then in a, as long as both sides are free.
    """
    ra, rb = _Rolling(a), _Rolling(b)
    top, covered = min(len(a), len(b)), 0

    def both(n: int) -> bool:
        return n == 0 or bool(np.isin(rb.runs(n)[1], ra.runs(n)[1]).any())

    while top >= least and both(least):
        low, high = least, top
        while low < high:  # the longest common run
            mid = (low + high + 1) // 2
            low, high = (mid, high) if both(mid) else (low, mid - 1)
        (pa, ha), (pb, hb) = ra.runs(low), rb.runs(low)
        order = np.argsort(ha, kind="stable")
        ha, pa = ha[order], pa[order]
        here = np.searchsorted(ha, hb, "left")
        till = np.searchsorted(ha, hb, "right")
        next_of: dict[int, int] = {}
        for j, first, end in zip(pb.tolist(), here.tolist(), till.tolist()):
            if first == end or not rb.free[j : j + low].all():
                continue
            k = next_of.get(first, first)
            while k < end and not ra.free[pa[k] : pa[k] + low].all():
                k += 1
            next_of[first] = k
            if k < end and np.array_equal(a[pa[k] : pa[k] + low], b[j : j + low]):
                ra.mark(int(pa[k]), low)
                rb.mark(j, low)
                covered += low
        ra.settle()
        rb.settle()
        top = low - 1
    return covered


def _runs(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes, each row's first one) for seeds of ``size`` words; a size has hashes of its own."""
    h, runs = common.shingle_hashes(words, first, size)
    return common.mix(h ^ np.uint64(size)), runs


def _seeded(batches, seed: int):
    """Items as word hashes with their seeds and the bitmap's places; an item of fewer words has one seed of them all."""
    import pyarrow as pa

    for whole in batches:
        for b in common.slices(whole, "text"):
            words, first = common.text_words(b.column(b.schema.get_field_index("text")))
            size = np.minimum(np.diff(first), seed)
            out, starts = [np.zeros(0, np.uint64)], np.zeros(len(b) + 1, np.int64)
            for k in range(len(b)):
                h = _runs(words[first[k] : first[k + 1]], np.array([0, first[k + 1] - first[k]]), int(size[k]))[0]
                out.append(h)
                starts[k + 1] = starts[k] + len(h)
            cols = b.column(b.schema.get_field_index("item_id")), common.list_array(words, first), pa.array(size), common.list_array(np.concatenate(out), starts)
            yield pa.RecordBatch.from_arrays(list(cols), ["item_id", "b", "size", "seeds"])


def _stretches(batches, shared, sizes: list[int]):
    """Of each document the words in seeds that the bitmap may have, with a word of its own between stretches, and these seeds."""
    import pyarrow as pa

    bits = shared.value
    shift = np.uint64(64 - BITS)
    for whole in batches:
        for part in common.slices(whole, "text"):
            words, first = common.text_words(part.column(part.schema.get_field_index("text")))
            inside = np.zeros(len(words) + 1, np.int64)
            seeds, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for size in sizes:
                h, runs = _runs(words, first, size)
                place = (h >> shift).astype(np.int64)
                hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                row = np.searchsorted(runs, hit, side="right") - 1
                at = hit - runs[row] + first[row]
                np.add.at(inside, at, 1)
                np.add.at(inside, at + size, -1)
                seeds.append(h[hit])
                rows.append(row)
            seeds, rows = np.concatenate(seeds), np.concatenate(rows)
            if not len(rows):
                continue
            # what is outside is one odd word, however long: its row's own number makes tiles end there
            covered = np.cumsum(inside[:-1]) > 0
            edge = np.ones(len(words), bool)
            edge[1:] = covered[1:] != covered[:-1]
            edge[first[:-1][first[:-1] < len(words)]] = True
            kept = covered | edge
            own = np.where(covered, words, common.mix(np.arange(len(words), dtype=np.uint64) + _ODD))[kept]
            upto = np.concatenate([[0], np.cumsum(kept)])[first]
            # each seed of a row once
            order = np.lexsort((seeds, rows))
            seeds, rows = seeds[order], rows[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (seeds[1:] != seeds[:-1])
            seeds, rows = seeds[new], rows[new]
            of = np.searchsorted(rows, np.arange(len(part) + 1))
            some = np.flatnonzero(np.diff(of))
            a = common.list_array(own, upto).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), part.column(1).take(pa.array(some)), a, common.list_array(seeds, of).take(pa.array(some))], ["id", "v", "a", "seeds"])


def _telling(batches, threshold: float):
    """Of each item the places of seeds that every document reaching the threshold shares one of.

    Left out are the seeds found in most stretches, the most frequent first, while all those left out cover less of
    the item than the threshold asks.
    """
    import pyarrow as pa

    for b in batches:
        n = b.schema.names.index
        out = []
        for words, size, places, counts in zip(*(b.column(n(c)).to_pylist() for c in ("words", "size", "places", "counts"))):
            under, left, covered = np.zeros(words, bool), set(places), 0
            for count, pos in sorted(zip(counts, places), key=lambda x: (-x[0], x[1])):
                more = size - int(under[pos : pos + size].sum())
                if count < 2 or covered + more >= threshold * words:
                    break
                under[pos : pos + size] = True
                covered += more
                left.discard(pos)
            out.append(sorted(left))
        yield pa.RecordBatch.from_arrays([b.column(n("k")), pa.array(out, pa.list_(pa.int64()))], ["k", "places"])


def _tiled(batches):
    import pyarrow as pa

    for b in batches:
        covered = [tile(np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64), n) for x, y, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist())]
        words = [len(y) for y in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(covered, pa.int64()), pa.array(words, pa.int64())], ["id", "v", "item_id", "covered", "item_words"])


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bitmap of seed hashes: at most 2 ** (BITS - 6) whole numbers reach the driver, whatever the benchmark's size."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    parts = seeds.groupBy(F.shiftright(place, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITS}) & 63))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[parts["k"].to_numpy()] = parts["bits"].to_numpy()
    return out.view(np.uint8)


def leaks(docs: DataFrame, benchmark: DataFrame, *, seed: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v, item_id, covered, item_words) of documents with at least ``threshold`` of an item's words under tiles; v is the text's hash.

    Null and empty texts and items have no words and no leaks; items of fewer words than ``seed`` are sought by all
    their words. Rows alike in id and text are reported once, and so are items; items of one id with different texts are
    items each. Of equal tiles the one first in the item, then first in the document, is taken. An empty table on either
    side gives an empty result. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    items = benchmark.select(F.col("item_id").alias("item_id"), plain(F.col("text")).alias("text")).filter("text <> ''").distinct()
    kinds = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"], dict(items.dtypes)["item_id"]
    items = common.arrow_map(items, lambda it: _seeded(it, seed), f"item_id {kinds[1]}, b array<bigint>, size bigint, seeds array<bigint>")
    items = scratch.staged(items.withColumn("k", F.xxhash64("b", "item_id")), "items")
    placed = items.select("k", "size", F.posexplode("seeds").alias("pos", "h"))
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # ``seed`` numbers at most
    shared = spark.sparkContext.broadcast(_bitmap(placed.select("h").distinct()))

    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), plain(F.col(text_col)).alias("text")).filter("text <> ''")
    found = common.arrow_map(d, lambda it: _stretches(it, shared, sizes), f"id {kinds[0]}, v bigint, a array<bigint>, seeds array<bigint>")
    found = scratch.staged(found.withColumn("r", F.xxhash64("id", "v", "a")), "stretches")
    held = found.select("r", F.explode("seeds").alias("h"))
    # no row of a document is needed for the counts but its seeds, added up where they lie
    often = placed.join(held.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", "left").select("k", "size", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    often = often.groupBy("k", "size").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), "n"))).alias("x"))
    often = often.join(items.select("k", F.size("b").alias("words")), "k").select("k", "size", "words", F.col("x.pos").alias("places"), F.col("x.n").alias("counts"))
    telling = common.arrow_map(often, lambda it: _telling(it, threshold), "k bigint, places array<bigint>").select("k", F.explode("places").alias("pos"))
    telling = placed.join(telling, ["k", "pos"]).select("k", "h").distinct()
    pairs = scratch.staged(held.join(telling, "h").select("r", "k").distinct(), "candidates")
    # all seeds that a candidate pair shares
    hits = pairs.join(placed, "k").join(held, ["r", "h"], "left_semi")
    pairs = hits.groupBy("r", "k", "size").agg(F.array_sort(F.collect_set(F.col("pos").cast("bigint"))).alias("at"))
    # words of an item in the seeds it shares: each adds those that the seed before doesn't have
    reach = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-(10**9)).cast("bigint").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.col("size"), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    pairs = pairs.select("r", "k", reach.alias("reach")).join(items.select("k", "item_id", "b", "size"), "k").filter(F.col("reach") >= threshold * F.size("b"))
    texts = found.select("r", "id", "v", "a").dropDuplicates(["r"])
    tiled = common.arrow_map(pairs.join(texts, "r").select("id", "v", "item_id", "a", "b", "size"), _tiled, f"id {kinds[0]}, v bigint, item_id {kinds[1]}, covered bigint, item_words bigint")
    out = scratch.staged(tiled.filter(F.col("covered") >= threshold * F.col("item_words")), "leaks")
    scratch.drop(but=(out,))
    shared.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a benchmark item. Other columns may have any names."""
    gone = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("id", "v").distinct()
    on = docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(docs[text_col]) == gone["v"])
    return docs.join(gone, on, "left_anti")
