"""Line dedup by overlapping windows of three lines, in DataFrame functions alone.

Each three consecutive lines of a document (blank lines aside) make a window, known by two 64-bit hashes. A window
that is found more than once in the corpus stays where it is found first, by (doc_id, place); all its later places
are covered, and the lines of covered windows are removed, overlapping windows as one passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def _lines(text: Column) -> Column:
    """A text's lines that aren't blank, each with its place among all lines."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(common.SPACES)).alias("x")))
    return F.filter(every, lambda s: s["x"] != "")


def windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(_id, _row, h, k, lines): a hash for each window of a row, its place, and the places of its lines."""
    rows = docs.select("_id", "_row", _lines(F.col("_text")).alias("_l"))
    made = F.transform(
        F.sequence(F.lit(1), F.size("_l") - (width - 1)),
        lambda k: F.struct(
            F.xxhash64(F.transform(F.slice("_l", k, width), lambda s: s["x"])).alias("h"),
            F.hash(F.transform(F.slice("_l", k, width), lambda s: s["x"])).alias("g"),
            k.alias("k"),
            F.element_at("_l", k)["i"].alias("first"),
            F.element_at("_l", k + (width - 1))["i"].alias("last"),
        ),
    )
    made = F.when(F.size("_l") >= width, made)
    return rows.select("_id", "_row", F.explode(made).alias("w")).select("_id", "_row", "w.*")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of each row, its text without the lines of windows seen before.

    Lines are compared without white space at their ends; blank lines don't part a window, and go with a passage
    that runs over them.
    Texts of fewer than three such lines stay as they are; null stays null. The first place is the lowest by
    (id, hash of the text, place), a null id first; rows alike in both count as one, so that all of them stay or lose the same lines.
    Other columns don't matter, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    found = common.staged(windows(d, width), "windows")
    # the first place of each window that has more than one; a hot window is reduced before the shuffle
    firsts = found.groupBy("h", "g").agg(F.min(F.struct("_id", "_row", "k")).alias("f"), F.max(F.struct("_id", "_row", "k")).alias("z"))
    firsts = firsts.filter(F.col("f") != F.col("z")).select(F.col("h").alias("_h"), F.col("g").alias("_g"), "f")
    later = found.join(firsts, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).filter(F.struct("_id", "_row", "k") != F.col("f"))
    covered = later.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_set(F.struct("first", "last")).alias("c"))
    d = d.join(covered, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    return apply_cover(d.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), "c"))


def apply_cover(d: DataFrame) -> DataFrame:
    """Removes covered lines: overlapping windows are merged into one set of places."""
    gone = F.array_distinct(F.flatten(F.transform("c", lambda s: F.sequence(s["first"], s["last"]))))
    d = d.withColumn("_all", F.split("text", "\n"))
    d = d.withColumn("_left", F.when(F.col("c").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), gone)))
    kept = F.array_join(F.transform("_left", lambda i: F.get("_all", i)), "\n")
    return d.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("n_lines"),
        F.when(F.col("_left").isNull(), 0).otherwise(F.size("_all") - F.size("_left")).cast("long").alias("n_removed"),
        F.when(F.col("_left").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE x <> ''),
win AS (
  SELECT doc_id, k, i AS first, lead(i, 2) OVER d AS last, x AS a, lead(x) OVER d AS b, lead(x, 2) OVER d AS c
  FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS n FROM win WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i FROM ranked WHERE n > 1),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(p.x, chr(10) ORDER BY p.i) AS text
  FROM (SELECT doc_id, i - 1 AS i, parts[i] AS x
        FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed,
       CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
