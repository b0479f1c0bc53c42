"""Ranked lexical search over a tiered impact index.

Documents become rows of (term, occurrences), kept to terms that a query may have by a bitmap of fixed size; Spark counts
the terms' documents. For each block of queries the rows are then indexed in shards of some hundred thousand postings.
In a shard a term's postings lie in tiers, those with high impact (the term's weight times what the occurrences are worth
in a document of that length) first, and each term has for each tier the greatest impact that is left below it.

A search reads the first tier alone. The best ``k`` sums so far, over all shards, bound the score that a result needs from
below; what a document that was not met can reach is bounded by its shard's rests. Where the second bound is under the first, the
query is proven: its results are among the documents met whose own bound reaches that score, and only these are
completed from lower tiers. Queries without proof fall through to the next tier; the last has no rest. Every
score that is returned is exact.

Through the driver go a block's terms and weights and two numbers a query, bounded by ``block`` terms.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, terms

#: The bitmap of the queries' terms has 2 ** BITS bits: 4 MB.
BITS = 25
#: Shares of the postings that the tiers down to each hold, about; the last tier has the rest.
TIERS = (1 / 4, 2 / 3)
#: Postings in a shard, about: what a task holds at a time.
SHARD = 1 << 17


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    return common.text_words(terms.folded(column))


def _of_items(batches):
    import pyarrow as pa

    for whole in batches:
        for part in common.slices(whole, "text"):
            h, first = _words(part.column(1))
            own = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
            upto = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays([part.column(0), common.list_array(np.concatenate([np.zeros(0, np.uint64), *own]), upto)], ["item_id", "terms"])


def _of_docs(batches, shared):
    """(id, n, terms, tfs): a document's number of terms, and how often it has each that the bitmap may have; none for texts without terms."""
    import pyarrow as pa

    bits = shared.value
    for whole in batches:
        for part in common.slices(whole, "text"):
            h, first = _words(part.column(1))
            row = np.repeat(np.arange(len(part)), np.diff(first))
            place = (h >> np.uint64(64 - BITS)).astype(np.int64)
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            h, row = h[hit], row[hit]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(h)))
            upto = np.searchsorted(row[at], np.arange(len(part) + 1))
            n = np.diff(first)
            some = pa.array(np.flatnonzero(n))
            cols = part.column(0), pa.array(n), common.list_array(h[at], upto), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(tf.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([c.take(some) for c in cols], ["id", "n", "terms", "tfs"])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list column."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _shard(ids: list, doc, term, impact, tier, n_tiers: int):
    """One shard as a row: its documents and terms, and for each tier where terms begin, documents, impacts, and the rests below."""
    import pyarrow as pa

    own, term = np.unique(term, return_inverse=True)
    row = {"ids": pa.concat_arrays(ids), "terms": own}
    for t in range(n_tiers):
        at = np.flatnonzero(tier == t)
        at = at[np.lexsort((doc[at], term[at]))]
        row[f"at{t}"] = np.searchsorted(term[at], np.arange(len(own) + 1))
        row[f"doc{t}"], row[f"hit{t}"] = doc[at], impact[at]
        rest = np.zeros(len(own), np.int64)
        below = np.flatnonzero(tier > t)
        np.maximum.at(rest, term[below], impact[below])
        row[f"rest{t}"] = rest
    names = list(row)
    as_list = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v.astype(np.int32)))
    return pa.RecordBatch.from_arrays([as_list(row[x]) for x in names], names)


def _indexed(batches, shared):
    hashes, weights, limits, n_docs, n_terms = shared.value
    held: list = []
    size = docs = 0

    def flush():
        ids = [x[0] for x in held]
        return _shard(ids, *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4)), len(limits) + 1)

    for b in batches:
        h, upto = _flat(b.column(2))
        tf = _flat(b.column(3))[0]
        n = b.column(1).to_numpy()
        h = h.view(np.uint64)
        m = 50 + (50 * n * n_docs) // n_terms
        a = 0
        while a < len(b):
            z = max(a + 1, int(np.searchsorted(upto, upto[a] + SHARD, side="right")) - 1)
            s = slice(upto[a], upto[z])
            at = np.minimum(np.searchsorted(hashes, h[s]), len(hashes) - 1)
            doc = np.repeat(np.arange(z - a), np.diff(upto[a : z + 1]))
            ok = hashes[at] == h[s]
            at, doc, f = at[ok], doc[ok], tf[s][ok]
            impact = (1000000000 * f) // (1000 * f + 20 * m[a:z][doc])
            tier = np.searchsorted(-limits, -(weights[at] * impact), side="left") if len(limits) else np.zeros(len(at), np.int64)
            held.append((b.column(0).slice(a, z - a), doc + docs, at, impact, tier))
            size, docs, a = size + len(at), docs + z - a, z
            if size >= SHARD:
                yield flush()
                held, size, docs = [], 0, 0
    if held:
        yield flush()


class _Rows:
    """A shard of a batch, with what the tiers say of one query at a time."""

    def __init__(self, batch, k: int, upto: int, n_terms: int):
        one = lambda name: _flat(batch.column(batch.schema.get_field_index(name)).slice(k, 1))[0]
        self.ids = batch.column(batch.schema.get_field_index("ids")).slice(k, 1).flatten()
        self.size = len(self.ids)
        own = one("terms")
        self.place = np.full(n_terms, -1, np.int64)
        self.place[own] = np.arange(len(own))
        self.tiers = [(one(f"at{t}"), one(f"doc{t}"), one(f"hit{t}")) for t in range(upto + 1)]
        self.rests = {int(x.name[4:]): one(x.name) for x in batch.schema if x.name.startswith("rest")}

    def sums(self, query: np.ndarray, weights: np.ndarray, depth: int):
        """(sum, seen, rest, terms): each document's sum over tiers 0..depth, the rests of terms it was met in, and all rests together."""
        own = self.place[query]
        w = weights[query[own >= 0]]
        own = own[own >= 0]
        rests = w * self.rests[depth][own]
        total, seen = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for at, doc, hit in self.tiers[: depth + 1]:
            for o, x, r in zip(own.tolist(), w.tolist(), rests.tolist()):
                a, z = at[o], at[o + 1]
                if a < z:
                    total[doc[a:z]] += x * hit[a:z].astype(np.int64)
                    if r:
                        seen[doc[a:z]] += r
        return total, seen, int(rests.sum()), list(zip(own.tolist(), w.tolist()))


def _bounds(batches, shared, depth: int, k: int):
    """(q, best, bound): of each query the k best sums over tiers 0..depth in this task's shards, and what unmet documents may reach."""
    import pyarrow as pa

    queries, weights, n_terms = shared.value
    best = {q: np.zeros(0, np.int64) for q in queries}
    bound = dict.fromkeys(queries, 0)
    for b in batches:
        for i in range(len(b)):
            rows = _Rows(b, i, depth, n_terms)
            for q, query in queries.items():
                total, _, rest, _ = rows.sums(query, weights, depth)
                bound[q] = max(bound[q], rest)
                both = np.concatenate([best[q], total[total > 0]])
                best[q] = np.partition(both, len(both) - k)[-k:] if len(both) > k else both
    if queries:
        yield pa.RecordBatch.from_arrays([pa.array(list(queries), pa.int64()), pa.array([x.tolist() for x in best.values()], pa.list_(pa.int64())), pa.array(list(bound.values()), pa.int64())], ["q", "best", "bound"])


def _completed(batches, shared, n_tiers: int, k: int):
    """(q, id, score): this task's k best documents of each query with their exact scores, if these reach the query's least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    queries, weights, n_terms, least, proven = shared.value
    found: dict[int, pa.Table] = {}
    for b in batches:
        for i in range(len(b)):
            rows = _Rows(b, i, n_tiers - 1, n_terms)
            for q, query in queries.items():
                depth = proven[q]
                total, seen, rest, own = rows.sums(query, weights, depth)
                some = np.flatnonzero((total > 0) & (total + rest - seen >= least[q]))
                score = total[some]
                for at, doc, hit in rows.tiers[depth + 1 :] if len(some) else ():
                    for o, x in own:
                        a, z = at[o], at[o + 1]
                        if a < z:
                            there = np.minimum(np.searchsorted(doc[a:z], some), z - a - 1)
                            score += np.where(doc[a:z][there] == some, x * hit[a:z][there].astype(np.int64), 0)
                ok = score >= max(1, least[q])
                if not ok.any():
                    continue
                new = pa.table({"id": rows.ids.take(pa.array(some[ok])), "score": score[ok]})
                new = pa.concat_tables([found[q], new]) if q in found else new
                if len(new) > k:
                    new = new.take(pc.sort_indices(new, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")[:k])
                found[q] = new
    for q, t in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), q)), t["id"].combine_chunks(), t["score"].combine_chunks()], ["q", "id", "score"])


def _blocks(items: DataFrame, most: int):
    """Queries with terms in blocks of about ``most`` terms: lists of (q, terms)."""
    block, size = [], 0
    for r in items.select("q", "terms").toLocalIterator():
        block.append((r["q"], np.array(r["terms"], np.int64).view(np.uint64)))
        size += len(r["terms"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, *, k: int = 50, tiers: tuple[float, ...] = TIERS, block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, id, score, tier): each query's ``k`` best documents by exact score, highest first, and the tier that proved them (1, 2, ...).

    Equal scores go by ascending id, a null id last; rows alike in both are interchangeable, and each row of ``docs`` is a
    document. Texts without a term (null, empty) neither count nor are found. Queries alike in id and text are one; those
    of one id with different texts are ranked each for itself. A query without terms has no rows, nor has one
    whose terms no document has. An empty table on either side gives an empty result. Other columns don't matter, whatever their names.
    Terms are told apart by 64-bit hashes: with a million terms in queries and a billion in documents the chance of any mix-up is 1 in 18,000.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = queries.select(F.col(query_id).alias("item_id"), F.col(query_text).cast("string").alias("text")).distinct()
    kind, item_kind = dict(d.dtypes)["id"], dict(items.dtypes)["item_id"]
    items = common.arrow_map(items, _of_items, f"item_id {item_kind}, terms array<bigint>").filter("size(terms) > 0")
    items = scratch.staged(items.withColumn("q", F.monotonically_increasing_id()), "queries")

    bits = spark.sparkContext.broadcast(_bitmap(items))
    forward = common.arrow_map(d, lambda it: _of_docs(it, bits), f"id {kind}, n bigint, terms array<bigint>, tfs array<bigint>")
    forward = scratch.staged(forward, "forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    counts = scratch.staged(forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")

    found = []
    for part in _blocks(items, block) if n_docs else ():
        found.append(_search(scratch, forward, counts, part, int(n_docs), int(n_terms), k, tiers, kind))
    schema = f"q bigint, id {kind}, score bigint, tier int"
    best = spark.createDataFrame([], schema) if not found else found[0]
    for other in found[1:]:
        best = best.unionByName(other)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = scratch.staged(best.join(items.select("q", "item_id"), "q").select("item_id", "rank", "id", "score", "tier"), "ranked")
    scratch.drop(but=(out,))
    bits.destroy()
    return out


def _bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap of the queries' terms: at most 2 ** (BITS - 6) whole numbers reach the driver."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITS}) & 63))")
    parts = items.select(F.explode("terms").alias("h")).groupBy(F.shiftright(place, 6).alias("k")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[parts["k"].to_numpy()] = parts["bits"].to_numpy()
    return out.view(np.uint8)


def _limits(weights: np.ndarray, df: np.ndarray, tiers: tuple[float, ...]) -> np.ndarray:
    """The least impact of each tier but the last: that of one occurrence, in a text of average length, of the term where the share of postings is reached."""
    order = np.argsort(-weights, kind="stable")
    upto = np.cumsum(df[order])
    at = np.searchsorted(upto, np.array(tiers) * upto[-1])
    return weights[order][np.minimum(at, len(order) - 1)] * 333333


def _search(scratch: common.Scratch, forward: DataFrame, counts: DataFrame, part: list, n_docs: int, n_terms: int, k: int, tiers: tuple[float, ...], kind: str) -> DataFrame:
    """(q, id, score, tier): for a block of queries a superset of each one's k best, exact scores."""
    import pyarrow as pa

    spark = forward.sparkSession
    asked = np.unique(np.concatenate([t for _, t in part]))
    known = counts.join(F.broadcast(spark.createDataFrame(pa.table({"term": asked.view(np.int64)}))), "term").toArrow()  # a row a term of the block
    hashes, df = known["term"].to_numpy().view(np.uint64), known["df"].to_numpy()
    order = np.argsort(hashes)
    hashes, df = hashes[order], df[order]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    if not len(hashes):
        return spark.createDataFrame([], f"q bigint, id {kind}, score bigint, tier int")
    place = {int(h): i for i, h in enumerate(hashes.tolist())}
    pending = {q: np.array([place[x] for x in t.tolist() if x in place], np.int64) for q, t in part}
    pending = {q: t for q, t in pending.items() if len(t)}

    shared = spark.sparkContext.broadcast((hashes, weights, _limits(weights, df, tiers), n_docs, n_terms))
    n_tiers = len(tiers) + 1
    lists = "".join(f", at{t} array<int>, doc{t} array<int>, hit{t} array<int>, rest{t} array<int>" for t in range(n_tiers))
    index = scratch.staged(common.arrow_map(forward, lambda it: _indexed(it, shared), f"ids array<{kind}>, terms array<int>{lists}"), "tiers")
    every, least, proven = dict(pending), dict.fromkeys(pending, 0), dict.fromkeys(pending, n_tiers - 1)
    for depth in range(n_tiers - 1):
        if not pending:
            break
        asked_now = spark.sparkContext.broadcast((pending, weights, len(hashes)))
        read = index.select("ids", "terms", *(f"{x}{t}" for t in range(depth + 1) for x in ("at", "doc", "hit")), f"rest{depth}")
        bounds = common.arrow_map(read, lambda it, a=asked_now, n=depth: _bounds(it, a, n, k), "q bigint, best array<bigint>, bound bigint")
        top = F.get(F.sort_array(F.flatten(F.collect_list("best")), asc=False), F.lit(k - 1))
        for r in bounds.groupBy("q").agg(F.coalesce(top, F.lit(0)).alias("least"), F.max("bound").alias("bound")).collect():  # a row a query of the block
            least[r["q"]] = max(least[r["q"]], r["least"])
            if r["bound"] < r["least"] or r["bound"] == 0:
                proven[r["q"]] = depth
                del pending[r["q"]]
        asked_now.destroy()
    asked_last = spark.sparkContext.broadcast((every, weights, len(hashes), least, proven))
    done = common.arrow_map(index, lambda it: _completed(it, asked_last, n_tiers, k), f"q bigint, id {kind}, score bigint")
    tier = spark.createDataFrame([(int(q), t + 1) for q, t in proven.items()], "q bigint, tier int")
    return scratch.staged(done.join(F.broadcast(tier), "q").select("q", "id", "score", "tier"), "found")
