"""The merged graph: decisions on pairs, the best edges of each note, and the degree cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import Thresholds
from kindred.functions.scalars import at_least
from kindred.operators.terms import undirected
from kindred.operators.vectors import with_cosine


def merge_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, a_cos, b_cos, is_a, is_b) of pairs that either kind of directed edges has."""
    x = undirected(a).select("i", "j", F.col("cos").alias("a_cos"), F.lit(True).alias("is_a"))
    y = undirected(b).select("i", "j", F.col("cos").cast("float").alias("b_cos"), F.lit(True).alias("is_b"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return x.join(y, ["i", "j"], "full").select("i", "j", "a_cos", "b_cos", flag("is_a"), flag("is_b"))


def decide(pairs: DataFrame, vectors: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """pairs with emb_cos, decision and src (null unless kept). Only pairs without a b_cos meet their vectors again."""
    c, is_a = F.col("emb_cos"), F.col("is_a")
    b, a = at_least(c, limits.b_min), at_least(c.cast("double"), limits.a_veto, "double")
    decision = F.when(c.isNull(), "drop-no-vec").when(b | (is_a & a), "keep").when(is_a, "veto-A").otherwise("below-B")
    src = F.when(c.isNull(), None).when(b, F.when(is_a, "AB").otherwise("B")).when(is_a & a, "A")
    known = pairs.where("b_cos is not null").withColumn("emb_cos", F.col("b_cos"))
    scored = known.unionByName(with_cosine(pairs.where("b_cos is null"), vectors))
    return scored.select("i", "j", "a_cos", "emb_cos", "is_a", "is_b", decision.alias("decision"), src.alias("src"))


def kept_edges(decisions: DataFrame) -> DataFrame:
    return decisions.where("src is not null").select("i", "j", F.col("emb_cos").alias("w"), "src")


def _ranked(edges: DataFrame) -> DataFrame:
    """Each edge at either end, with its rank there: by weight, then by the pair, the same order at both ends."""
    both = edges.select(F.col("i").alias("node"), "i", "j", "w", "src").union(edges.select("j", "i", "j", "w", "src"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.col("w").desc(), "i", "j")))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k best of at least one end."""
    return _ranked(edges).where(F.col("rank") <= k).select("i", "j", "w", "src").distinct()


def capped(edges: DataFrame, cap: int) -> DataFrame:
    """Edges left when, as long as a note has more than `cap`, the weakest edge of any such note goes.

    As all ends rank edges in one order, these are exactly the edges among the `cap` best at both ends.
    """
    return _ranked(edges).where(F.col("rank") <= cap).groupBy("i", "j", "w", "src").count().where("count = 2").drop("count")


def final_graph(edges: DataFrame) -> DataFrame:
    """(idx, rank, nbr, w, src): each note's neighbours, strongest first."""
    both = edges.select(F.col("i").alias("idx"), F.col("j").alias("nbr"), "w", "src").union(edges.select("j", "i", "w", "src"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(F.col("w").desc(), "nbr"))).select("idx", "rank", "nbr", "w", "src")


def merge(a: DataFrame, b: DataFrame, vectors: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    kept = kept_edges(decide(merge_candidates(a, b), vectors, limits))
    return final_graph(capped(top_edges(kept, limits.top_k), limits.cap))


def note_targets(writers: DataFrame, graph: DataFrame, targets: DataFrame) -> DataFrame:
    """(idx, targets): link targets of each writer in rank order; none gives an empty array."""
    t = graph.join(targets.withColumnRenamed("idx", "nbr"), "nbr").groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("rank", "target"))).alias("_t"))
    none = F.array().cast("array<string>")
    return writers.select("idx").join(t, "idx", "left").select("idx", F.coalesce(F.transform("_t", lambda x: x["target"]), none).alias("targets"))
