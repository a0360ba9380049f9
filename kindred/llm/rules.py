"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Eight levels, fixed in advance, tighten all rules together. On labelled good documents, which no cutoff
was fitted to, each level's share of false rejections gets an exact (Clopper-Pearson) binomial upper
bound in each stratum. Levels are tested from the most lenient on and stop at the first failure (a
fixed sequence needs no correction within a stratum); the confidence is divided by the number of
strata (Bonferroni). With probability 1 - DELTA, no stratum loses more than ALPHA of its good
documents to the rules. A stratum with too few labels to prove anything keeps every document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import table, written
from kindred.llm.textstats import with_stats

ALPHA, DELTA = 0.05, 0.05
#: numerator, denominator, sign (1: reject above, -1: reject below), cutoffs in thousandths from lenient to strict.
RULES = (
    ("n_symbols", "n_words", 1, (1000, 500, 300, 200, 100, 50, 20, 10)),
    ("n_dup_lines", "n_lines", 1, (700, 600, 500, 400, 350, 300, 250, 200)),
    ("n_repeat_words", "n_words", 1, (450, 400, 350, 300, 250, 200, 150, 100)),
    ("word_chars", "n_words", 1, (12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500)),
    ("word_chars", "n_words", -1, (2000, 2500, 2800, 3000, 3200, 3400, 3600, 3800)),
)
LEVELS = len(RULES[0][3])
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejected(level: int) -> Column:
    """Whether any rule rejects at this level (from 1)."""
    out = F.lit(False)
    for num, den, sign, cuts in RULES:
        out |= sign * 1000 * F.col(num) > sign * cuts[level - 1] * F.col(den)
    return out


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial(n, p), summed exactly in logarithms."""
    first, odds = n * math.log1p(-p), math.log(p) - math.log1p(-p)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step)["total"]).otherwise(first)


#: Strata (a row of a name and a number each) up to which their levels are broadcast, so that rows needn't move to a few keys.
STRATA = 100_000


def certified(good: DataFrame, stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, level): the strictest certified level of each stratum, 0 for none, from good documents' statistics."""
    counts = good.groupBy(stratum).agg(F.count("*").alias("n"), F.array(*(F.sum(rejected(i).cast("long")) for i in range(1, LEVELS + 1))).alias("ks"))
    strata = good.select(stratum).distinct().agg(F.count("*").alias("m"))
    tests = counts.join(F.broadcast(strata)).select(stratum, "n", "m", F.posexplode("ks").alias("i", "k"))  # m is one row
    passed = F.when(F.col("k") < alpha * F.col("n"), log_binomial_cdf(F.col("n"), F.col("k"), alpha) <= F.log(F.lit(delta) / F.col("m"))).otherwise(F.lit(False))
    held = F.min(passed.cast("int")).over(Window.partitionBy(stratum).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return tests.select(stratum, held.alias("held")).groupBy(stratum).agg(F.sum("held").cast("int").alias("level"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, BASE, base_failed, kept) of every row of `docs`.

    Null texts count as empty ones (and fail the base rules), null strata form one stratum. A document is good if
    its id is labelled and every label of it has quality 1; null ids and null qualities are no labels. Repeated
    rows each count; an empty table gives no rows, empty labels certify nothing; further columns are ignored.
    """
    stats = with_stats(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text")), "text", ("id", "stratum"))
    s = written(stats.select("id", "stratum", *BASE, "n_lines", base_failed().alias("base_failed")), "rule-stats")
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q")).where("q = 1")
    levels = certified(s.where("not base_failed").join(good, "id", "left_semi"), alpha=alpha, delta=delta)
    levels = written(levels, "rule-levels")
    levels = F.broadcast(levels) if levels.count() <= STRATA else levels
    at = F.coalesce(F.col("level"), F.lit(0))
    bad = F.lit(False)
    for i in range(1, LEVELS + 1):
        bad |= (at >= i) & rejected(i)
    return s.join(levels, "stratum", "left").select("id", *BASE, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts of all documents."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def _sql_reject(level: int) -> str:
    return "(" + " OR ".join(f"{sign} * 1000 * {num} > {sign * cuts[level - 1]} * {den}" for num, den, sign, cuts in RULES) + ")"


ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT row, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s
  FROM (SELECT row_number() OVER () AS row, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT w FROM w ORDER BY doc_id))
), twice AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY row
), s AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, row_number() OVER () AS row FROM (SELECT * FROM w ORDER BY doc_id)) d LEFT JOIN rep USING (row)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
), good AS (
  SELECT b.* FROM b JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)
  WHERE NOT base_failed
), tests AS (
  SELECT stratum, unnest(range(1, {LEVELS + 1})) AS i, n, m, unnest(ks) AS k FROM (
    SELECT stratum, count(*) AS n, [{", ".join(f"count_if({_sql_reject(i)})" for i in range(1, LEVELS + 1))}] AS ks,
           (SELECT count(DISTINCT stratum) FROM good) AS m
    FROM good GROUP BY stratum)
), passed AS (
  SELECT stratum, i, CASE WHEN k < {ALPHA} * n THEN list_sum(list_transform(range(0, k::BIGINT + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) <= {DELTA} / m ELSE false END AS ok
  FROM tests
), levels AS (
  SELECT stratum, coalesce(min(i) FILTER (WHERE NOT ok) - 1, {LEVELS}) AS level FROM passed GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"(coalesce(level, 0) >= {i} AND {_sql_reject(i)})" for i in range(1, LEVELS + 1))}) AS kept
FROM b LEFT JOIN levels USING (stratum)
"""
