"""Near-duplicate documents by DartMinHash (Christiani, 2020) over five-word shingles.

A document is a weighted set: each distinct shingle weighs 1 + log2 of its number of occurrences. Imagine a strip of
the plane for each possible shingle, weight along one side and rank along the other, with darts thrown at random, one
a unit of area, the same for all documents. A document owns in each of its shingles' strips the region below its
weight. Every dart belongs to one of ``k`` coordinates by a hash; a document's signature has in each coordinate its
dart of lowest rank. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Darts come from hashed cells of area one: level (nu, rho) has weights from 2^nu - 1 to 2^(nu+1) - 1 and ranks from
2^rho - 1 to 2^(rho+1) - 1, cut into 2^rho by 2^nu cells, each with a Poisson(1) number of darts. A document looks at
its cells up to the rank where about k ln k + 3 k darts are expected in all, so the time is sparse: it does not grow
with shingles times k. If a coordinate is still empty, it looks half as far again.

Links are judged by sets, whose similarity is above the weighted one where shingles recur in one document only (a text
and the same text written twice). So a document with recurring shingles also has a signature with all weights 1; for
others it is the same one. Any two documents thus meet with the probability of their set similarity at least.

Bands of ``rows`` coordinates bucket the documents by both signatures. Within a bucket, each is compared with a pivot, not with all;
links are exact (Jaccard of the shingle sets at least 0.8). Components follow. In buckets that still hold several
components, each document outside the largest one meets those documents of such buckets with which it shares one of its rarest shingles:
with shingles in the order of their frequency, sets of that similarity must meet in a short prefix, at ranks that
leave room for the overlap (Chaudhuri et al. 2006; Xiao et al. 2008). That loses no link and makes few pairs even among thousands of texts that are
all somewhat alike. So a huge group of copies costs its own size, and a link between different texts is missed only
if no band agrees (about 1 in 16,000 at 0.8).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix
from .components import components, joined

_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the index of each unit's owner, and its number within the owner."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def darts(shingle: np.ndarray, weight: np.ndarray, rank: np.ndarray):
    """Darts below ``weight`` and ``rank`` in each shingle's strip: (index of shingle, dart's hash, dart's rank)."""
    found = []
    for nu in range(int(np.log2(weight.max() + 1)) + 1):
        for rho in range(int(np.log2(rank.max() + 1)) + 1):
            w0, r0 = 2.0**nu - 1, 2.0**rho - 1
            wide, high = 2.0 ** (nu - rho), 2.0 ** (rho - nu)
            at = np.flatnonzero((weight > w0) & (rank > r0))
            if not len(at):
                continue
            nw = np.ceil((np.minimum(weight[at], 2 * w0 + 1) - w0) / wide).astype(np.int64)
            nr = np.ceil((np.minimum(rank[at], 2 * r0 + 1) - r0) / high).astype(np.int64)
            owner, cell = _spread(nw * nr)
            owner_nr = nr[owner]
            cw, cr = cell // owner_nr, cell % owner_nr
            level = mix(np.array([nu << 8 | rho | 1 << 20], np.uint64))[0]
            h = mix((shingle[at][owner] ^ level) + (cw.astype(np.uint64) << np.uint64(32) | cr.astype(np.uint64)) * _ODD)
            who, q = _spread(np.searchsorted(_POISSON, _unit(h), side="right"))
            z = mix(h[who] + (q.astype(np.uint64) + np.uint64(1)) * _ODD)
            own = at[owner[who]]
            w, r = w0 + wide * (cw[who] + _unit(z)), r0 + high * (cr[who] + _unit(mix(z + _ODD)))
            ok = (w < weight[own]) & (r < rank[own])
            found.append((own[ok], mix(z ^ _ODD)[ok], r[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A row of k dart hashes for each document; document d has elements first[d]:first[d + 1]. Empty ones get zeros."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(row, weight, n)
    out, todo = np.zeros((n, k), np.uint64), np.flatnonzero(total > 0)
    far = k * (math.log(k) + 3)
    while len(todo):
        pick = np.flatnonzero(np.isin(row, todo)) if len(todo) < n else np.arange(len(row))
        rank = far / total[row[pick]]
        own, dart, r = darts(shingle[pick], weight[pick], rank)
        slot = row[pick][own] * k + (dart % np.uint64(k)).astype(np.int64)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, slot, r)
        first_of = r == best[slot]
        out.reshape(-1)[slot[first_of]] = dart[first_of]
        todo = todo[~np.isfinite(best.reshape(n, k)[todo]).all(axis=1)]
        far *= 1.5
    return out


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int):
    """Distinct shingles of each row, sorted, with counts. A row of fewer words, but some, has one of all its words."""
    h, runs = common.shingle_hashes(words, first, width)
    row = np.repeat(np.arange(len(first) - 1), np.diff(runs))
    n = np.diff(first)
    for d in np.flatnonzero((n > 0) & (n < width)):
        x = np.uint64(n[d])
        for w in words[first[d] : first[d + 1]]:
            x = mix(np.array([x ^ w], np.uint64))[0]
        h, row = np.append(h, x), np.append(row, d)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    return h[at], counts, np.searchsorted(row[at], np.arange(len(first)))


def _signed(batches, k: int, bands: int, width: int):
    import pyarrow as pa

    rows = k // bands
    for whole in batches:
        for b in common.slices(whole, "text"):
            words, first = common.text_words(b.column(b.schema.get_field_index("text")))
            h, counts, start = shingle_sets(words, first, width)
            size = np.diff(start)
            row = np.repeat(np.arange(len(b)), size)
            some = size > 0
            recur = np.bincount(row[counts > 1], minlength=len(b)) > 0
            plain = signatures(h[recur[row]], np.ones(recur[row].sum()), np.concatenate([[0], np.cumsum(size[recur])]), k)
            s = np.concatenate([signatures(h, 1 + np.log2(counts), start, k)[some], plain]).reshape(-1, bands, rows)
            key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64)), s.shape[:2])
            for j in range(rows):
                key = mix(key ^ s[:, :, j])
            key = key[np.argsort(np.concatenate([np.flatnonzero(some), np.flatnonzero(recur)]), kind="stable")]
            first_band = np.concatenate([[0], np.cumsum((some + recur.astype(int)) * bands)])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("v")), b.column(b.schema.get_field_index("id")), common.list_array(key.reshape(-1), first_band)], ["v", "id", "bands"])


def _sets(batches, width: int):
    import pyarrow as pa

    for whole in batches:
        for b in common.slices(whole, "text"):
            words, first = common.text_words(b.column(b.schema.get_field_index("text")))
            h, _, start = shingle_sets(words, first, width)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("v")), common.list_array(h, start)], ["v", "s"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b): those whose shingle sets have that Jaccard similarity."""
    a, b = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = both >= similarity * (F.size("sa") + F.size("sb") - both)
    return pairs.join(a, "a").join(b, "b").filter(near).select("a", "b")


def _meeting(sets: DataFrame, strays: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame:
    """Pairs (a, b) of a stray and another of ``sets`` (v, s, root), of different roots, that may have that similarity."""
    shingles = sets.select("v", "root", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    ranked = shingles.join(often, "h").groupBy("v", "root", "n").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("x"))
    prefix = F.slice("x", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    ranked = scratch.staged(ranked.select("v", "root", "n", F.posexplode(prefix).alias("i", "e")).filter("e.often > 1").select("v", "root", "n", "i", "e.h"), "ranked")
    ranked = ranked.join(strays.withColumn("stray", F.lit(True)), "v", "left").withColumn("stray", F.coalesce("stray", F.lit(False)))
    left = ranked.filter("stray").drop("stray")
    right = ranked.select(F.col("v").alias("w"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), "h", "stray")
    once = ~F.col("stray") | (F.col("v") < F.col("w"))  # two strays meet once
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * (1 + similarity) >= similarity * (F.col("n") + F.col("m")) - 1e-6
    pairs = left.join(right, "h").filter((F.col("root") != F.col("other")) & once & room)
    return pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def _mixed(keyed: DataFrame, roots: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (h, v, root) of buckets with several components, and each such bucket's largest one (h, main)."""
    now = keyed.join(roots, "v", "left").select("h", "v", F.coalesce("root", "v").alias("root"))
    mixed = now.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h")
    now = scratch.staged(now.join(mixed, "h"), "mixed")
    return now, now.groupBy("h", "root").count().groupBy("h").agg(F.max(F.struct("count", "root")).alias("m")).select("h", F.col("m.root").alias("main"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, k: int = 192, bands: int = 32) -> DataFrame:
    """Of each row: (id, v, class_id, class_size, first): its text's md5, its class, and whether it stands for it.

    Two rows are linked if their texts are equal, or if their sets of ``width``-word shingles have a Jaccard
    similarity of ``similarity`` or more; classes are the components. class_id is the least id of the class (null only
    if all ids are), class_size its number of rows; ``first`` marks rows with the class_id and the least md5 among them: one, unless a
    row is repeated. Texts without words, null ones too, are each only like their equals. A text of fewer than
    ``width`` words has one shingle of them all. An empty table gives an empty result; other columns don't matter.
    """
    scratch = common.Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select(F.unhex(F.md5("text")).alias("v"), "id", "text")
    kind = dict(docs.dtypes)["id"]
    signed = scratch.staged(common.arrow_map(docs, lambda it: _signed(it, k, bands, width), f"v binary, id {kind}, bands array<bigint>"), "signed")
    texts = signed.filter(F.size("bands") > 0).groupBy("v").agg(F.first("bands").alias("bands"))
    keyed = texts.select("v", F.explode(F.array_distinct("bands")).alias("h"))
    shared = keyed.groupBy("h").agg(F.min("v").alias("x"), F.max("v").alias("y")).filter("x <> y").select("h")
    keyed = scratch.staged(keyed.join(shared, "h").select("h", "v"), "buckets")
    involved = keyed.select("v").distinct()
    # of equal texts, one row's text moves: keyed by its id too, so that many copies aren't one task's
    one = signed.groupBy("v").agg(F.min("id").alias("one")).join(involved, "v", "left_semi").withColumnRenamed("v", "w")
    once = docs.join(one, (F.col("v") == F.col("w")) & F.col("id").eqNullSafe(F.col("one")), "left_semi").groupBy("v").agg(F.first("text").alias("text"))
    sets = scratch.staged(common.arrow_map(once, lambda it: _sets(it, width), "v binary, s array<bigint>"), "sets")

    pivots = keyed.groupBy("h").agg(F.min(F.struct(F.xxhash64("v").alias("o"), "v")).alias("p")).select("h", F.col("p.v").alias("w"))
    pivots = scratch.staged(pivots, "pivots")
    pairs = keyed.join(pivots, "h").filter("v <> w").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    links = scratch.staged(_verified(pairs, sets, similarity), "links")
    roots = components(links, scratch)

    # strays meet the member of their bucket's main component that has most links so far: it is near the middle
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
    now, sizes = _mixed(keyed, roots, scratch)
    main = now.join(sizes, "h").join(ends, "v", "left").filter("root = main")
    hubs = main.groupBy("h").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "v")).alias("p")).select("h", F.col("p.v").alias("w"))
    pairs = now.join(sizes, "h").filter("root <> main").join(hubs, "h").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    roots = joined(roots, scratch.staged(_verified(pairs, sets, similarity), "links"), scratch)

    now, sizes = _mixed(keyed, roots, scratch)
    strays = now.join(sizes, "h").filter("root <> main").select("v").distinct()
    pairs = _meeting(sets.join(now.select("v", "root").distinct(), "v"), strays, similarity, scratch)
    roots = joined(roots, scratch.staged(_verified(pairs, sets, similarity), "links"), scratch)

    members = signed.join(roots, "v", "left").select("id", "v", F.coalesce("root", "v").alias("root"))
    members = scratch.staged(members, "members")
    # a table of its own: a join of two plain shuffles is one whose hot roots Spark splits
    heads = members.groupBy("root").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "v"))).alias("m"), F.min("v").alias("mv"), F.count(F.lit(1)).alias("class_size"))
    heads = heads.select("root", F.col("m.id").alias("class_id"), F.coalesce(F.col("m.v"), F.col("mv")).alias("head"), "class_size")
    heads = scratch.staged(heads, "heads")
    scratch.drop(but=(members, heads))
    return members.join(heads, "root").select("id", "v", "class_id", "class_size", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("v") == F.col("head"))).alias("first"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that stand for their class; of rows alike in id and text, one."""
    found = classes(docs, id_col=id_col, text_col=text_col, **options)
    i, v = common.unused(docs, "id", "v")
    heads = found.filter("first").select(F.col("id").alias(i), F.col("v").alias(v)).distinct()
    d = docs.withColumn(v, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    d = d.join(heads, F.col(id_col).eqNullSafe(heads[i]) & (d[v] == heads[v]), "left_semi")
    return d.dropDuplicates([id_col, v]).drop(v)
