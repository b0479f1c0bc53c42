"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Every document draws an exponential key, -ln(u) / quality weight, with u from a hash of its id (of its text where that is
null): the same row has the same key in every run. In the order of these keys, a prefix of a source is a weighted sample without replacement.
A source takes whole epochs of itself first and fills the rest of its target with such a prefix.

The order within a source is found in two steps, so that no task holds a whole source: keys are dealt
into ranges of about as many documents each, the ranges' sums are added up along the source, and each range within.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

_TOP = float(2**52)


def quality_weight(text: Column) -> Column:
    """An integer from 10 to 100 that falls with the share of markup-like symbols among a text's characters."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return F.greatest(F.lit(10), 100 - F.floor(common.symbol_count(text) * 500 / F.greatest(n, F.lit(1)))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Of (source, source_size), one row a source: the target of each source, adding a column ``target``.

    Sources by code point, null last, get ``weights`` in turn. A source's target stops at max_epochs times its size;
    what it can't take goes to the others by weight. With sources by cap / weight, those that stop come first, and
    the level of the rest is what is left for a unit of weight at the first that doesn't.
    """
    everything = W.partitionBy()
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    up = W.orderBy(F.col("_cap") / F.col("_w"), "_n")
    s = sizes.withColumn("_n", F.row_number().over(by_source))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    s = s.withColumn("_w", F.element_at(turn, ((F.col("_n") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.col("source_size") * max_epochs)
    s = s.withColumns(
        {
            "_before": F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "_left": F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing)),
            "_all": F.sum("source_size").over(everything),
        }
    )
    level = (F.col("_all") - F.col("_before")) / F.col("_left")
    s = s.withColumn("_level", level).withColumn("_stops", F.col("_level") * F.col("_w") >= F.col("_cap"))
    s = s.withColumn("_level", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everything))
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("_w"))
    return s.withColumn("target", target).drop("_n", "_w", "_cap", "_before", "_left", "_all", "_level", "_stops")


def _taken(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
) -> DataFrame:
    """mix() with the hash of each text, _tie."""
    text, size = F.col(text_col), common.word_count(F.col(text_col))
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))), 1, 13), 16, 10).cast("double") + 1) / _TOP
    base = common.staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            (-F.log(u) / quality_weight(text)).alias("_key"),
            F.xxhash64(text).alias("_tie"),
            F.rand(7).alias("_salt"),  # parts rows alike in all else; written once
        ),
        "mix",
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    goal = targets(sizes, weights, max_epochs).select(F.col("source").alias("_source"), "source_size", "target")
    b = base.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # ranges of keys over all sources, about alike in rows whatever the weights, ids and repeats: each is sorted by itself
    order = ["source", "_key", "doc_id", "_tie", "_salt"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = common.staged(b.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = b.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    along = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    sums = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_b"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("source", "_part").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("_run", F.sum("size").over(inside) - F.col("size"))
    b = b.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_b")))
    goal_words = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal_words - epochs * F.col("source_size") - F.col("_offset") - F.col("_run")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return b.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "_tie")


def mix(docs: DataFrame, **options) -> DataFrame:
    """How much of each document the mix takes: (doc_id, source, size, source_size, target, taken).

    size: words of the text (null and empty: 0). taken: words taken, repeats counted; the document at the edge of a
    source's budget gives just the words that fill it, so a source's taken words are its target rounded down.
    A null id, source or text is a value like others. Rows with the same id share a key and are taken in the order of
    their text's hash; rows alike in both are alike in the result but for which of them fills the edge. An empty table
    gives an empty result. Other columns, whatever their names, don't matter.
    """
    return _taken(docs, **options).drop("_tie")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    The document at the edge of a budget comes once more if at least half of it is taken; documents without words are
    never taken. Rows alike in id, text and source come alike, by the mean of what they take, so that
    a source's words can differ from its target by half a document for the edge and half a copy for each such group of rows.
    Columns may have any names.
    """
    plan = _taken(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)
    i, s, t, n, copy = common.unused(docs, "i", "s", "t", "n", "copy")
    times = plan.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("_tie").alias(t)).agg(F.round(F.avg(share)).cast("int").alias(n))
    times = times.filter(F.col(n) > 0)
    on = docs[id_col].eqNullSafe(times[i]) & docs[source_col].eqNullSafe(times[s]) & (F.xxhash64(docs[text_col]) == times[t])
    out = docs.join(times, on).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return out.drop(i, s, t, n, copy)


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496)
           / greatest(10, 100 - (len(regexp_extract_all(text, '[#*$%&|<>]')) * 500) // greatest(length(text), 1)) AS key,
         text
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sizes),
weighed AS (SELECT *, (n - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM numbered),
summed AS (
  SELECT *, coalesce(sum(cap) OVER up_before, 0)::BIGINT AS before, (sum(w) OVER up_after)::BIGINT AS left_w, (sum(source_size) OVER ())::BIGINT AS total
  FROM weighed WINDOW up_before AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      up_after AS (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
leveled AS (SELECT *, (total - before) / left_w AS level, (total - before) / left_w * w >= cap AS stops FROM summed),
goals AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE max(CASE WHEN NOT stops THEN level END) OVER () * w END AS target FROM leveled),
run AS (
  SELECT b.doc_id, b.source, b.size, g.source_size, g.target, floor(g.target)::BIGINT AS goal,
         (sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - b.size AS before
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
        + greatest(0, least(size, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM run
"""
