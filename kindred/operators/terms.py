"""Pairs of notes by the cosine of their weighted tags and authors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import Thresholds
from kindred.functions.scalars import idf
from kindred.operators import termblocks

# Tag namespaces that count, and those that never do.
KEEP = ("Survey/", "Method/", "Concept/", "Dataset/", "FoS/Primary/", "FoS/Second/", "FoS/Secondary/", "Venue/")
EXCLUDE = ("学術論文",)
EXCLUDE_PREFIXES = ("Year/", "Lang/", "Cite/", "Type/")


def keep_tag(tag: Column) -> Column:
    starts = lambda ps: reduce(or_, (tag.startswith(p) for p in ps))
    return starts(KEEP) & ~tag.isin(*EXCLUDE) & ~starts(EXCLUDE_PREFIXES)


def doc_terms(tags: DataFrame, authors: DataFrame) -> DataFrame:
    """(idx, term): kept tags, and authors under a prefix of their own."""
    a = authors.select("idx", F.concat(F.lit("author::"), "name").alias("term"))
    t = tags.where(keep_tag(F.col("tag"))).select("idx", F.col("tag").alias("term"))
    return t.distinct().union(a.distinct())  # no kept tag looks like an author; Catalyst drops a distinct over distinct rows


def term_df(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def all_weights(terms: DataFrame, n: int) -> DataFrame:
    """(idx, term, df, w, first): weights max(0, ln(n / df)) of all terms; `first` in one row of each term."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"), F.min("idx").alias("least")).withColumn("w", idf(F.lit(float(n)), F.col("df")))
    return terms.join(df, "term").select("idx", "term", "df", "w", (F.col("idx") == F.col("least")).alias("first"))


def term_weights(terms: DataFrame, n: int) -> DataFrame:
    """(idx, term, df, w) of terms with a positive weight."""
    return all_weights(terms, n).where("w > 0").drop("first")


def doc_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def pair_dots(weights: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """(i, j, dot) of pairs that share a specific term, over all terms they share.

    Pairs come from specific terms alone, at most df**2 / 2 for each, so no common term is ever joined with
    itself; what common terms add is looked up in the two notes' maps of them.
    """
    some = weights.where(F.col("df") <= limits.a_specific_df)
    x, y = (some.select(F.col("idx").alias(k), "term", F.col("w").alias(f"w{k}")) for k in "ij")
    specific = x.join(y, "term").where("i < j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("dot"))
    maps = weights.where(F.col("df") > limits.a_specific_df).groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    both = specific.join(maps.toDF("i", "mi"), "i", "left").join(maps.toDF("j", "mj"), "j", "left")
    common = F.map_keys(F.map_filter("mi", lambda k, _: F.map_contains_key("mj", k)))
    more = F.aggregate(F.array_sort(common), F.lit(0.0), lambda s, k: s + F.col("mi")[k] * F.col("mj")[k])
    return both.select("i", "j", (F.col("dot") + F.when(F.col("mi").isNotNull() & F.col("mj").isNotNull(), more).otherwise(F.lit(0.0))).alias("dot"))


def postings(weights: DataFrame, limits: Thresholds = Thresholds()) -> termblocks.Postings:
    return termblocks.postings(weights)


def scored_pairs(posted: termblocks.Postings, limits: Thresholds = Thresholds()) -> DataFrame:
    """(s, l, dot, need) of pairs that meet: s the note with the smaller norm, dot over its heads, which must reach `need`."""
    return termblocks.met(posted, limits, lambda block, notes: block.scored(*notes), "s long, l long, dot double, need double")


def candidates(weights: DataFrame, limits: Thresholds = Thresholds(), block: int | None = None) -> DataFrame:
    """(i, j, cos), i < j, at the threshold or above, of notes that share a specific term.

    Notes meet in blocks, of `block` terms each if given. There pairs that can reach the threshold meet their other terms.
    """
    both = termblocks.met(postings(weights, limits), limits, lambda block, notes: _at_least(limits.a_min, block.cosines(*notes)), "s long, l long, cos double", block)
    return both.select(F.least("s", "l").alias("i"), F.greatest("s", "l").alias("j"), "cos")


def _at_least(floor: float, pairs: Iterator[tuple]) -> Iterator[tuple]:
    for s, l, cos in pairs:
        yield tuple(x[cos >= floor] for x in (s, l, cos))


def directed(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair, from one reading of them: a union would find all pairs twice."""
    ways = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ij", "ji"))
    return pairs.select(F.explode(F.array(*ways)).alias("e"), "cos").select("e.src", "e.dst", "cos")


def ranked(edges: DataFrame, rank: Column, k: int) -> DataFrame:
    """The k best edges of each source with their `place`, from 1; ties go to the smaller target."""
    w = Window.partitionBy("src").orderBy(rank.desc(), "dst")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def best(edges: DataFrame, rank: Column, k: int) -> DataFrame:
    return ranked(edges, rank, k).drop("place")


def ranked_a_edges(weights: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """(src, dst, cos, place)"""
    return ranked(directed(candidates(weights, limits)), F.round("cos", 9), limits.top_k)


def a_edges(weights: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    return ranked_a_edges(weights, limits).drop("place")


def undirected(edges: DataFrame) -> DataFrame:
    """(i, j, cos) once for each pair, with the larger cosine."""
    return edges.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.max("cos").alias("cos"))
