"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

A rule compares one rate of a text with a cutoff. The rules are made stricter together, step by step along a fixed
grid, and a step rejects a text if any rule does. For each stratum (language) and step, the labelled good documents say
how many the step would reject by mistake; it is certified if the exact binomial tail P(Bin(n, alpha) <= errors) is at
most the stratum's share of delta. Steps are tested from the loosest on, and testing stops at the first that fails:
within a stratum this fixed sequence needs no correction, whatever the number of rules and steps; over strata the
correction is Bonferroni's. So, but for a chance of delta over all strata, a stratum's rules reject at most ``alpha`` of
its good documents. Of the certified steps the one is taken that parts the labelled bad from the good ones best.

A stratum with too few good labels to certify anything, even without an error, joins the other such strata in a pool,
which is tested as one: its guarantee is for the good documents of the pool together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Rules: a text's rate, and the grid of cutoffs from the loosest on; a text fails if its rate is above the cutoff.
GRIDS = {
    "symbols": (400, 300, 250, 200, 150, 120, 100, 80, 60, 40),  # per 1000 characters in words
    "lines": (900, 800, 700, 600, 500, 400, 350, 300, 275, 250),  # repeated lines, per 1000 lines
    "long": (2000, 1800, 1600, 1500, 1400, 1300, 1200, 1100, 1000, 950),  # characters per 100 words
    "short": (500, 450, 400, 370, 350, 330, 310, 290, 270, 250),  # words per 1000 characters in words
}
STEPS = 10


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in runs of ``width`` words that are found twice or more among ``words``.

    Runs are compared by 64-bit hashes. Places of runs whose hash recurs, in order, each cover the words up to the
    next such place, ``width`` at most.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.struct(F.xxhash64(F.slice(words, i, width)).alias("h"), i.alias("i")))
    ordered = F.array_sort(hashes)

    def again(s: Column) -> Column:
        def found(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return F.when((x["h"] == before) | (x["h"] == after), x["i"])

        return F.array_sort(F.array_compact(F.transform(s, found)))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-(10**6)).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )

    # an array of one, unfolded by transform: the sorted runs are made once, not at each mention
    once = F.transform(F.array(ordered), lambda s: covered(again(s)))
    return F.when(F.size(words) >= width + 1, F.element_at(once, 1)).otherwise(0).cast("long")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of each row."""
    text = F.col("_text")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("_text"))
    d = d.withColumns({"_words": common.words_of(text), "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != "")})
    lines = F.coalesce(F.col("_lines"), F.array().cast("array<string>"))
    return d.select(
        "doc_id",
        "stratum",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        common.symbol_count(text).alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Of rows of features(): too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Of rows of features(): each rule's rate, compared as value > cutoff * per."""
    return {
        "symbols": (F.col("n_symbols") * 1000, F.col("word_chars")),
        "lines": (F.col("n_dup_lines") * 1000, F.col("n_lines")),
        "long": (F.col("word_chars") * 100, F.col("n_words")),
        "short": (F.col("n_words") * 1000, F.col("word_chars")),
    }


def level() -> Column:
    """Of rows of features(): at how many of the steps some rule rejects the text; these are the last ones."""
    return F.greatest(*[sum((value > c * per).cast("int") for c in GRIDS[name]) for name, (value, per) in rates().items()])


def binomial_tail(n: Column, errors: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= errors), exactly: terms by their ratio, added up as logarithms."""
    odds = risk / (1 - risk)
    start = n * F.log1p(F.lit(-risk))
    total = F.aggregate(
        F.when(errors >= 1, F.sequence(F.lit(1).cast("long"), errors)).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.cast("double").alias("term"), start.cast("double").alias("sum")),
        lambda a, k: _add(a, a["term"] + F.log((n - k + 1) / k * odds)),
        lambda a: a["sum"],
    )
    return F.exp(F.least(total, F.lit(0.0)))


def _add(a: Column, term: Column) -> Column:
    high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
    return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))


def thresholds(rows: DataFrame, labels: DataFrame, *, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The step of each stratum with a certified one: (stratum, pooled, step, n_good, n_errors, n_bad, n_caught, p_value).

    ``labels``: (doc_id, quality), 1 for good; a document with several labels counts once, by its lowest. Counts of a
    pooled stratum are the pool's. Strata without labels have no row, nor have those whose first step fails.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), "quality").groupBy("_id").agg(F.min("quality").alias("_q"))
    held = rows.filter(~base_failed()).join(marked, F.col("doc_id") == F.col("_id"))
    count = lambda q: F.count_if(F.col("_q") == q)
    counts = held.groupBy("stratum", level().alias("level")).agg(count(1).alias("good"), count(0).alias("bad"))
    # from here on a few rows a stratum
    every = W.partitionBy()
    strata = counts.groupBy("stratum").agg(F.sum("good").alias("_n")).filter("_n > 0").withColumn("_level", F.lit(delta) / F.count(F.lit(1)).over(every))
    least = F.ceil(F.log("_level") / F.log(F.lit(1 - alpha)))
    strata = strata.select(F.col("stratum").alias("_s"), "_level", (F.col("_n") < least).alias("pooled"), F.when(F.col("_n") >= least, F.col("stratum")).alias("group"))
    mine = counts.join(strata, F.col("stratum").eqNullSafe(F.col("_s")))
    steps = mine.select("pooled", "group", "_level", "level", "good", "bad", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    fails = F.col("level") >= STEPS - F.col("step")
    some = lambda c: F.sum(F.when(fails, F.col(c)).otherwise(0))
    tests = steps.groupBy("pooled", "group", "_level", "step").agg(F.sum("good").alias("n_good"), some("good").alias("n_errors"), F.sum("bad").alias("n_bad"), some("bad").alias("n_caught"))
    p = F.when(F.col("n_errors") <= F.col("n_good") * alpha, binomial_tail(F.col("n_good"), F.col("n_errors"), alpha)).otherwise(1.0)
    on = W.partitionBy("pooled", "group").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    sound = tests.withColumn("p_value", p).withColumn("_sound", F.min(F.col("p_value") <= F.col("_level")).over(on)).filter("_sound")
    # share of bad texts caught less the share of good ones lost, in whole numbers; of equals the loosest
    worth = F.col("n_caught") * F.greatest("n_good", F.lit(1)) - F.col("n_errors") * F.greatest("n_bad", F.lit(1))
    best = F.min_by(F.struct("step", "n_good", "n_errors", "n_bad", "n_caught", "p_value"), F.struct(-worth, "step"))
    cut = sound.groupBy(F.col("pooled").alias("_p"), F.col("group").alias("_g")).agg(best.alias("x"))
    return strata.join(cut, (F.col("pooled") == F.col("_p")) & F.col("group").eqNullSafe(F.col("_g"))).select(F.col("_s").alias("stratum"), "pooled", "x.*")


def judge(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.04, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """features() of each row with base_failed and kept.

    kept: passes the base rules and isn't rejected at its stratum's certified step. Null and empty texts have no
    words and fail; a null language is a stratum of its own; repeated rows are judged alike; without labels, or with
    too few to certify a step, only the base rules reject. An empty table gives an empty result. Other columns don't
    matter, whatever their names.
    """
    rows = common.staged(features(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "quality")
    cut = thresholds(rows, labels, alpha=alpha, delta=delta).select(F.col("stratum").alias("_stratum"), F.col("step").alias("_step"))
    d = rows.join(cut, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.coalesce(level() >= STEPS - F.col("_step"), F.lit(False))
    d = d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return d.drop("_stratum", "_step")


_GRID_ROWS = ", ".join(f"('{name}', {k}, {c})" for name, g in GRIDS.items() for k, c in enumerate(g))
ORACLE = rf"""
WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS parts FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS run
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS i FROM again) GROUP BY doc_id),
full_lines AS (SELECT doc_id, list_filter(parts, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (
  SELECT w.doc_id, w.lang AS stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN full_lines USING (doc_id) LEFT JOIN covered c ON c.doc_id = w.doc_id),
b AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
grid(rule, step, cutoff) AS (VALUES {_GRID_ROWS}),
rated AS (
  SELECT doc_id, rule, CASE rule WHEN 'symbols' THEN n_symbols * 1000 WHEN 'lines' THEN n_dup_lines * 1000 WHEN 'long' THEN word_chars * 100 ELSE n_words * 1000 END AS v,
         CASE rule WHEN 'lines' THEN n_lines WHEN 'long' THEN n_words ELSE word_chars END AS per
  FROM b, (SELECT DISTINCT rule FROM grid)),
levels AS MATERIALIZED (SELECT doc_id, max(k) AS level FROM (SELECT doc_id, r.rule, count(*) FILTER (v > cutoff * per) AS k FROM rated r JOIN grid g ON r.rule = g.rule GROUP BY ALL) GROUP BY doc_id),
marked AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id),
held AS MATERIALIZED (SELECT stratum, level, q FROM b JOIN marked USING (doc_id) JOIN levels USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT stratum, count(*) AS n, 0.05 / count(*) OVER () AS risk FROM held WHERE q = 1 GROUP BY stratum),
grouped AS (SELECT stratum, risk, n < ceil(ln(risk) / ln(0.96)) AS pooled, CASE WHEN n >= ceil(ln(risk) / ln(0.96)) THEN stratum END AS g FROM strata),
tests AS (
  SELECT pooled, g, risk, step, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 0) AS bad, count(*) FILTER (q = 1 AND level >= 10 - step) AS x, count(*) FILTER (q = 0 AND level >= 10 - step) AS caught
  FROM held JOIN grouped ON held.stratum IS NOT DISTINCT FROM grouped.stratum CROSS JOIN range(10) s(step) GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN x > n * 0.04 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.04) + (n - k) * ln(0.96))) FROM generate_series(0, x) t(k)) END AS p FROM tests),
passed AS (SELECT *, bool_and(p <= risk) OVER (PARTITION BY pooled, g ORDER BY step) AS ok FROM tails),
cut AS (SELECT pooled, g, arg_min(step, (x * greatest(bad, 1) - caught * greatest(n, 1), step)) AS step FROM passed WHERE ok GROUP BY ALL),
mine AS (SELECT stratum, step FROM grouped r JOIN cut c ON r.pooled = c.pooled AND r.g IS NOT DISTINCT FROM c.g)
SELECT b.doc_id, b.stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(level >= 10 - step, false) AS kept
FROM b JOIN levels USING (doc_id) LEFT JOIN mine ON b.stratum IS NOT DISTINCT FROM mine.stratum
"""
