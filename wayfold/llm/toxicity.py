"""Toxicity by a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word is known by hashes of its lower-cased letters and of its first 4, 5, 6 and 7 bytes; its embedding is the sum of
theirs. Filters of widths 1, 2 and 3 run over the embeddings, each filter's largest value in the text is kept (max
pooling), and a logistic layer makes the score. Language, source, ids and labels are never inputs of a score.

Training takes a bounded sample of labelled rows (``sample`` of each class, by a hash of the id; texts of over
``max_chars`` aren't drawn), so its cost doesn't grow with the corpus. Scoring is a map over all rows and whole texts.
The thresholds of the languages come from the scores of all labelled rows that the model wasn't fitted on, counted in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIXES = (4, 5, 6, 7)
WIDTHS = (1, 2, 3)
#: Cutoffs of a score of which one is a language's threshold.
CUTOFFS = tuple(round(0.05 * k, 2) for k in range(1, 20))
_TABLE = 20


def featurize(column) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string column: (features, first): a row of 1 + len(PREFIXES) hashes a word (0: none), and each text's first word."""

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    gaps = np.unique(offsets[1:-1])
    raw = np.insert(raw, gaps, 32)
    rows = offsets + np.searchsorted(gaps, offsets, side="right")
    upper = (raw >= 65) & (raw <= 90)
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)  # Latin letters of two bytes
    raw = raw + (upper.astype(np.uint8) << 5)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    if len(starts):
        size = ends - starts
        at = np.flatnonzero(inside[1:-1])
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw[at].astype(np.uint64) + np.uint64(1)) * common._power(at - np.repeat(starts, size)))])
        begin = np.cumsum(size) - size
        out[:, 0] = common.mix(sums[begin + size] - sums[begin])
        for k, n in enumerate(PREFIXES, 1):
            long = size > n
            b = begin[long]
            out[long, k] = common.mix((sums[b + n] - sums[b]) ^ np.uint64(n << 40))
    return out, np.searchsorted(starts, rows)


class Model:
    """Embeddings of chosen hashes, filters and the last layer."""

    def __init__(self, hashes: np.ndarray, dim: int = 8, filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.slot = np.zeros(1 << _TABLE, np.int32)
        self.mark = np.zeros(1 << _TABLE, np.uint32)
        at = (hashes >> np.uint64(64 - _TABLE)).astype(np.int64)
        self.slot[at[::-1]] = np.arange(len(hashes), 0, -1)  # of two in a place the earlier stays
        self.mark[at[::-1]] = hashes[::-1].astype(np.uint32)
        p = self.p = {"E": rng.normal(0, 0.1, (len(hashes) + 1, dim)), "v": rng.normal(0, 0.3, filters * len(WIDTHS)), "c": np.zeros(1)}
        p["E"][0] = 0
        for w in WIDTHS:
            p[f"W{w}"] = rng.normal(0, 0.5 / w**0.5, (w * dim, filters))
            p[f"b{w}"] = np.zeros(filters)
        self.p = {k: x.astype(np.float32) for k, x in p.items()}

    def lookup(self, features: np.ndarray) -> np.ndarray:
        at = (features >> np.uint64(64 - _TABLE)).astype(np.int64)
        return np.where(self.mark[at] == features.astype(np.uint32), self.slot[at], 0)

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """Each text's largest value of each filter; with ``where`` also the word at which it is."""
        p, pad, n = self.p, max(WIDTHS) - 1, len(first) - 1
        dim = p["E"].shape[1]
        size = np.diff(first)
        start = first[:-1] + pad * np.arange(n)
        x = np.zeros((len(ids) + pad * (n + 1), dim), np.float32)
        place = np.arange(len(ids)) + np.repeat(start - first[:-1], size)
        e = p["E"][ids[:, 0]]
        for k in range(1, ids.shape[1]):
            e += p["E"][ids[:, k]]
        x[place] = e
        tops, spots = [], []
        length = size + pad
        total = int(length.sum())
        for w in WIDTHS:
            y = x[:total] @ p[f"W{w}"][:dim]
            for j in range(1, w):
                y += x[j : total + j] @ p[f"W{w}"][j * dim : (j + 1) * dim]
            # the last w - 1 places of a text would reach into the next: they see its padding only
            tops.append(np.maximum(np.maximum.reduceat(y, start, axis=0) + p[f"b{w}"], 0))
            if where:
                spots.append(np.stack([s + y[s : s + m].argmax(axis=0) for s, m in zip(start, length)]))
        return np.concatenate(tops, axis=1), x, start, place, spots

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = self.pooled(ids, first)[0]
        return 1 / (1 + np.exp(-np.clip(top @ self.p["v"] + self.p["c"][0], -30, 30)))


def fit(features: np.ndarray, first: np.ndarray, toxic: np.ndarray, *, most: int = 8192, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """A model of texts featurize() made, by Adam on the log loss.

    Embeddings are kept for hashes found in three texts or more, at most ``most``, those whose presence tells most
    about the label (by chi-square) first.
    """
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    flat, who = features.reshape(-1), np.repeat(row, features.shape[1])
    some = flat != 0
    hashes, inverse = np.unique(flat[some], return_inverse=True)
    seen = np.unique(inverse.astype(np.int64) * n + who[some])
    h, d = seen // n, seen % n
    with_h, with_both = np.bincount(h, minlength=len(hashes)), np.bincount(h, toxic[d], len(hashes))
    share = toxic.mean()
    chi = (with_both - with_h * share) ** 2 / (with_h * share * (1 - share) + 1e-9)
    order = np.lexsort((hashes, -chi))
    chosen = order[with_h[order] >= 3][:most]
    model = Model(hashes[chosen], seed=seed)
    # start from what presence alone tells: one dimension of the embedding carries the smoothed log odds
    model.p["E"][1:, 0] = 0.3 * np.clip(np.log((with_both[chosen] + 0.5) / (toxic.sum() + 1)) - np.log((with_h - with_both)[chosen] + 0.5) + np.log((1 - toxic).sum() + 1), -3, 3) * (chi[chosen] > 6)
    ids = model.lookup(features)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(x) for k, x in model.p.items()}
    s = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    dim = model.p["E"].shape[1]
    for epoch in range(epochs):
        deal = rng.permutation(n)
        for at in range(0, n, batch):
            docs = deal[at : at + batch]
            size = np.diff(first)[docs]
            start = np.concatenate([[0], np.cumsum(size)])
            own = ids[np.arange(start[-1]) + np.repeat(first[docs] - start[:-1], size)]
            drop = rng.random(own.shape) < 0.2  # a word is also to be known without some of its hashes
            own = np.where(drop, 0, own)
            p = model.p
            top, x, begin, place, spots = model.pooled(own, start, where=True)
            z = top @ p["v"] + p["c"][0]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[docs]) / len(docs)
            g = {"v": top.T @ err + 1e-4 * p["v"], "c": np.array([err.sum()])}
            back = err[:, None] * p["v"] * (top > 0)
            gx = np.zeros_like(x)
            f = p["b1"].size
            for k, w in enumerate(WIDTHS):
                d = back[:, k * f : (k + 1) * f]
                g[f"b{w}"] = d.sum(axis=0)
                gw = np.zeros_like(p[f"W{w}"])
                for j in range(w):
                    gw[j * dim : (j + 1) * dim] = np.einsum("dfe,df->ef", x[spots[k] + j], d)
                    np.add.at(gx, spots[k] + j, d[:, :, None] * p[f"W{w}"][j * dim : (j + 1) * dim].T[None])
                g[f"W{w}"] = gw + 1e-4 * p[f"W{w}"]
            ge = np.zeros_like(p["E"])
            hit = np.flatnonzero(np.abs(gx[place]).sum(axis=1))
            for k in range(own.shape[1]):
                np.add.at(ge, own[hit, k], gx[place[hit]])
            ge[0] = 0
            g["E"] = ge
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            p["E"][0] = 0
    return model


def held_out(id_col: Column) -> Column:
    """The rows whose labels are kept for measuring: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 1500, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> tuple[Model, dict[str, float]]:
    """A model from at most ``sample`` labelled rows of each class, and the threshold of each language.

    Labels of held_out() ids are never read. A document with several labels counts as toxic if one says so; of several
    rows with one id, one is taken for fitting. A fifth of the sample isn't fitted on: with all labelled rows outside the
    sample it sets the thresholds, see best_cutoffs(). Without labels of both classes, no word counts.
    """

    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(11), F.col("_id"))
    picked = chosen.filter("toxic = 1").orderBy(order).limit(sample).union(chosen.filter("toxic = 0").orderBy(order).limit(sample))
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("lang"))
    # the broadcast side has at most 2 * sample rows
    rows = named.filter(F.length("text") <= max_chars).join(F.broadcast(picked), "_id").groupBy("_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(5)) != 0)
    rows = rows.select("_id", "text", "toxic", F.xxhash64(F.lit(11), "_id").alias("o")).toArrow().sort_by([("o", "ascending"), ("text", "ascending")])
    toxic = rows["toxic"].to_numpy().astype(float)
    if len(set(toxic)) < 2:
        return Model(np.zeros(0, np.uint64)), {}
    model = fit(*featurize(pa.concat_arrays(rows["text"].chunks)), toxic)
    fitted = F.broadcast(docs.sparkSession.createDataFrame(rows.select(["_id"])).withColumn("fitted", F.lit(True)))
    # scores are joined, not texts
    known = scored(named, model).select("_id", "lang", "score").join(chosen, "_id").join(fitted, "_id", "left")
    return model, best_cutoffs(known.withColumn("fitted", F.coalesce("fitted", F.lit(False))))


def best_cutoffs(known: DataFrame, *, prior: float = 20.0, default: float = 0.3) -> dict[str, float]:
    """Of rows (lang, score, toxic, fitted): each language's cutoff of best F1, of equals the one nearest to ``default``.

    Only rows not fitted on say what share of a class a cutoff flags; these shares apply to all of the class's rows, as
    fitting takes rows of one class more often than of the other. Each language also gets ``prior`` rows of a class
    that are as all languages together, and these as many that ``default`` parts rightly: they settle where rows are few. A few numbers a language come to the driver.
    """
    level = sum((F.col("score") >= t).cast("int") for t in CUTOFFS)
    counts = known.filter("lang IS NOT NULL").groupBy("lang", F.col("toxic").cast("int").alias("toxic"), "fitted", level.alias("level")).count().collect()
    names = sorted({r.lang for r in counts})
    seen, whole = np.zeros((len(names), 2, len(CUTOFFS) + 1)), np.zeros((len(names), 2))
    for r in counts:
        at, y = names.index(r.lang), int(r.toxic == 1)
        whole[at, y] += r["count"]
        if not r.fitted:
            seen[at, y, r.level] += r["count"]
    if not names:
        return {}
    every, at = seen.sum(axis=0), CUTOFFS.index(default)
    every[1, at + 1] += prior  # toxic rows that just reach it
    every[0, at] += prior  # others that just don't
    seen += prior * every / every.sum(axis=1, keepdims=True)
    whole += prior * whole.sum(axis=0) / whole.sum()
    # a row of level k reaches the first k cutoffs
    share = (seen[..., ::-1].cumsum(axis=2)[..., ::-1] / seen.sum(axis=2, keepdims=True))[..., 1:]
    flagged = share * whole[:, :, None]
    f1 = 2 * flagged[:, 1] / (flagged.sum(axis=1) + whole[:, 1:])
    return {x: min((t for t, f in zip(CUTOFFS, row) if f >= row.max() - 1e-12), key=lambda t: abs(t - default)) for x, row in zip(names, f1)}


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each text as column ``name``; null counts as empty. Repeated rows are scored alike."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most`` words of 8 numbers and a table of 8 MB

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for part in common.slices(pa.record_batch([texts], ["t"]), "t"):
            f, first = featurize(part.column(0))
            out.append(m.score(m.lookup(f), first).astype(np.float64))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score(F.col(text_col)))


def _judged(docs: DataFrame, labels: DataFrame, names: list[str], *, id_col: str, text_col: str, stratum_col: str, default: float, **options) -> DataFrame:
    score, flagged = names
    model, thresholds = train(docs, labels, id_col=id_col, text_col=text_col, stratum_col=stratum_col, **options)
    limit = F.lit(default)
    for lang, t in thresholds.items():
        limit = F.when(F.col(stratum_col) == lang, t).otherwise(limit)
    return scored(docs, model, text_col=text_col, name=score).withColumn(flagged, F.col(score) >= limit)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", default: float = 0.3, **options) -> DataFrame:
    """(doc_id, lang, score, flagged) of each row: whether the score reaches its language's threshold, or ``default`` where there is none.

    Null and empty texts are scored as texts without words; a null language has the default threshold; repeated rows are
    scored alike. Without labels of both classes no word counts and all scores are 0.5 or so. An empty table gives an
    empty result. Other columns don't matter, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("lang"))
    found = _judged(d, labels, ["score", "flagged"], id_col="doc_id", text_col="text", stratum_col="lang", default=default, **options)
    return found.select("doc_id", "lang", "score", "flagged")


def clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", default: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that classify() doesn't flag, all columns, whatever their names."""
    names = common.unused(docs, "score", "flagged")
    found = _judged(docs, labels, names, id_col=id_col, text_col=text_col, stratum_col=stratum_col, default=default, **options)
    return found.filter(~F.col(names[1])).drop(*names)
