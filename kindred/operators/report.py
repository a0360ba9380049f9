"""Statistics, integrity checks and samples of the graph, each a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.scalars import round4
from kindred.functions.text import truncated
from kindred.operators.terms import undirected
from kindred.sources.embeddings import BATCH
from kindred.sources.shared import written

POINTS = (50, 75, 90, 95, 99)


def corpus_stats(corpus: DataFrame, protected: tuple[str, ...]) -> DataFrame:
    return corpus.agg(F.count("*").alias("n_papers"), F.count_if(F.col("relpath").isin(*protected)).alias("n_protected"))


def protected_idx(corpus: DataFrame, protected: tuple[str, ...]) -> DataFrame:
    return corpus.where(F.col("relpath").isin(*protected)).select("idx")


def phase_a_stats(terms: DataFrame, weights: DataFrame, edges: DataFrame) -> DataFrame:
    t = terms.agg(F.count_distinct("term").alias("n_terms"))
    w = weights.agg(F.count_distinct("term").alias("n_weighted"))
    e = edges.agg(F.count_distinct("src").alias("papers_with_edge"), F.count_distinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("total_edges"))
    return _row(t, w, e)


def phase_b_stats(found: DataFrame, edges: DataFrame, tokens: int = 0, calls: int | None = None) -> DataFrame:
    """`found` is a cache lookup (hash, vec); without `calls` made, those that the misses need."""
    miss = F.count_distinct(F.when(F.col("vec").isNull(), F.col("hash")))
    c = found.agg(F.count("vec").alias("cache_hits"), (F.ceil(miss / BATCH) if calls is None else F.lit(calls)).cast("long").alias("batches"), F.lit(tokens).cast("long").alias("tokens"))
    e = edges.agg(F.count_distinct("src").alias("papers_with_edge"), F.count_distinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("total_edges"))
    return _row(c, e)


def _row(*parts: DataFrame) -> DataFrame:
    """One row of several one-row frames."""
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def percentiles(edges: DataFrame, kind: str) -> DataFrame:
    """Linear percentiles of the undirected weights to four places; null for none.

    Selected by rank: different weights with their counts are dealt into sorted ranges, a sum a range tells which ranges
    hold a wanted rank, and only these are numbered. No task holds more than a range, however often a weight occurs.
    """
    values = undirected(edges).groupBy(F.col("cos").cast("double").alias("v")).agg(F.count("*").alias("c"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = written(values.repartitionByRange(n, "v").withColumn("_part", F.spark_partition_id()), "values")
    sizes = values.groupBy("_part").agg(F.sum("c").alias("size"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.select("_part", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("total"))
    low = {x: F.floor((F.col("total") - 1) * x / 100) for x in POINTS}
    ranks = [r for x in POINTS for r in (low[x], F.least(low[x] + 1, F.col("total") - 1))]
    held = ranges.where(F.exists(F.array(*ranks), lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("size"))))
    end = F.col("start") + F.sum("c").over(Window.partitionBy("_part").orderBy("v"))
    placed = values.join(F.broadcast(held), "_part").select("v", "total", end.alias("end"), (end - F.col("c")).alias("start"))
    at = lambda r: F.max(F.when((r >= F.col("start")) & (r < F.col("end")), F.col("v")))
    got = placed.agg(F.max("total").alias("total"), *(at(r).alias(f"r{i}") for i, r in enumerate(ranks)))
    part = lambda x: (F.col("total") - 1) * x % 100 / 100
    line = lambda i, x: F.col(f"r{2 * i}") + (F.col(f"r{2 * i + 1}") - F.col(f"r{2 * i}")) * part(x)
    return got.select(F.lit(kind).alias("kind"), *(round4(line(i, x)).alias(f"p{x}") for i, x in enumerate(POINTS)))


def decision_stats(decisions: DataFrame) -> DataFrame:
    d, s = F.col("decision"), F.col("src")
    return decisions.agg(F.count_if(s.isin("B", "AB")).alias("keep_b_ab"), F.count_if(s == "A").alias("keep_a"), F.count_if(d == "veto-A").alias("veto_a"), F.count_if(d == "below-B").alias("below_b"))


def writer_graph(graph: DataFrame, protected: DataFrame) -> DataFrame:
    return graph.join(protected, "idx", "left_anti")


def degrees(corpus: DataFrame, graph: DataFrame, protected: DataFrame) -> DataFrame:
    d = graph.groupBy("idx").agg(F.count("*").alias("degree"))
    return corpus.select("idx").join(protected, "idx", "left_anti").join(d, "idx", "left").select("idx", F.coalesce("degree", F.lit(0)).alias("degree"))


def histogram(degree: DataFrame, cap: int = 10) -> DataFrame:
    """(links, notes, bar) for 0 to `cap` links, empty bins included."""
    got = degree.groupBy(F.least("degree", F.lit(cap)).alias("links")).agg(F.count("*").alias("notes"))
    bins = degree.sparkSession.range(cap + 1).select(F.col("id").alias("links"))
    n = F.coalesce(F.col("notes"), F.lit(0))
    return bins.join(got, "links", "left").select("links", n.alias("notes"), F.repeat(F.lit("#"), F.least(F.floor(n / 10), F.lit(60)).cast("int")).alias("bar"))


def final_stats(degree: DataFrame) -> DataFrame:
    return degree.agg(F.count("*").alias("writable"), F.count_if(F.col("degree") > 0).alias("with_link"), F.count_if(F.col("degree") == 0).alias("empty"))


def asymmetric(graph: DataFrame) -> DataFrame:
    """Edges without their reverse."""
    back = graph.select(F.col("nbr").alias("idx"), F.col("idx").alias("nbr"))
    return graph.join(back, ["idx", "nbr"], "left_anti").select("idx", "nbr")


def dead_targets(graph: DataFrame, targets: DataFrame) -> DataFrame:
    return graph.join(targets.select(F.col("idx").alias("nbr")), "nbr", "left_anti").select("idx", "nbr")


def integrity(graph: DataFrame, writers: DataFrame, targets: DataFrame) -> DataFrame:
    return _row(asymmetric(graph).agg(F.count("*").alias("asymmetric")), dead_targets(writers, targets).agg(F.count("*").alias("dead")), writers.agg(F.count_if(F.col("idx") == F.col("nbr")).alias("self_links")))


def strata(writers: DataFrame) -> DataFrame:
    """(idx, a_driven, b_driven) of linked writers."""
    return writers.groupBy("idx").agg(F.bool_or(F.col("src").isin("A", "AB")).alias("a_driven"), F.bool_or(F.col("src") == "B").alias("b_driven"))


def sample(writers: DataFrame, seed: int = 42, each: int = 8, total: int = 20) -> DataFrame:
    """(idx, stratum) of at most `total` linked writers: `each` with a tag edge, `each` with an embedding edge, then any, in seeded order."""
    s = strata(writers).withColumn("k", F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string"))))
    a = s.where("a_driven").orderBy("k").limit(each).select("idx", F.lit("A").alias("stratum"))
    b = s.where("b_driven").join(a, "idx", "left_anti").orderBy("k").limit(each).select("idx", F.lit("B").alias("stratum"))
    ab = a.union(b)
    n = total - ab.count()
    return ab.union(s.join(ab, "idx", "left_anti").orderBy("k").limit(n).select("idx", F.lit("any").alias("stratum")))


def sample_lines(chosen: DataFrame, corpus: DataFrame, graph: DataFrame) -> DataFrame:
    """(idx, folder, title, rank, src, weight, nbr_title), weights to three places."""
    t = corpus.select(F.col("idx").alias("nbr"), truncated(F.col("title"), 80).alias("nbr_title"))
    g = chosen.select("idx").join(graph, "idx").join(corpus.select("idx", "folder", truncated(F.col("title"), 90).alias("title")), "idx").join(t, "nbr")
    return g.select("idx", "folder", "title", "rank", "src", F.format_string("%.3f", F.col("w").cast("double")).alias("weight"), "nbr_title")


def apply_counters(corpus: DataFrame, protected: DataFrame, existing: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(changed, protected, missing) as an apply would report; `rewritten` has (file_path, changed)."""
    f = lambda d, keys, name: d.select(*keys).distinct().withColumn(name, F.lit(True))
    c = corpus.join(f(protected, ["idx"], "p"), "idx", "left").join(f(existing.withColumnRenamed("path", "file_path"), ["file_path"], "e"), "file_path", "left")
    c = c.join(rewritten.select("file_path", "changed"), "file_path", "left")
    p, e = F.col("p").isNotNull(), F.col("e").isNotNull()
    return c.agg(F.count_if(~p & e & F.col("changed")).alias("changed"), F.count_if(p).alias("protected"), F.count_if(~p & ~e).alias("missing"))
