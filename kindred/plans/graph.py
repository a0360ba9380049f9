"""The whole graph as one plan over a corpus' relations."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kindred.config import Thresholds
from kindred.operators import merge, terms, vectors
from kindred.sources.shared import written


@dataclass
class Graph:
    """Relations of (idx, tag), (idx, name) and (idx, vec) over n notes, and what follows from them.

    What several steps read is written once to the shared folder, which also keeps each plan short. While a step is
    written its figures are counted, in the job that writes it: see figures().
    """

    tags: DataFrame
    authors: DataFrame
    vecs: DataFrame
    n: int
    limits: Thresholds = Thresholds()
    limit_embed: int | None = None
    #: (idx) of notes that aren't written, if the figures of the final graph are wanted.
    protected: DataFrame | None = None
    _seen: dict[str, Observation] = field(default_factory=dict)

    def _written(self, step: str, df: DataFrame, **counts: Column) -> DataFrame:
        self._seen[step] = Observation()
        return written(df.observe(self._seen[step], *(c.alias(k) for k, c in counts.items())), step)

    def figures(self, step: str) -> dict[str, int]:
        """What was counted while a step was written: one of weights, a-edges, b-edges, decisions, graph."""
        {"weights": lambda: self._all_weights, "a-edges": lambda: self._ranked_a, "b-edges": lambda: self._ranked_b, "decisions": lambda: self.decisions, "graph": lambda: self._final}[step]()
        got = self._seen[step].get
        return {k: v or 0 for k, v in got.items()}

    @cached_property
    def terms(self) -> DataFrame:
        return terms.doc_terms(self.tags, self.authors)

    @cached_property
    def _all_weights(self) -> DataFrame:
        first = F.col("first")
        return self._written("weights", terms.all_weights(self.terms, self.n), n_terms=F.count_if(first), n_weighted=F.count_if(first & (F.col("w") > 0)))

    @cached_property
    def weights(self) -> DataFrame:
        return self._all_weights.where("w > 0").drop("first")

    @cached_property
    def _ranked_a(self) -> DataFrame:
        return self._written("a-edges", terms.ranked_a_edges(self.weights, self.limits), papers_with_edge=F.count_if(F.col("place") == 1))

    @cached_property
    def a_edges(self) -> DataFrame:
        return self._ranked_a.drop("place")

    @cached_property
    def _ranked_b(self) -> DataFrame:
        return self._written("b-edges", vectors.ranked_b_edges(self.vecs, self.limits, self.limit_embed), papers_with_edge=F.count_if(F.col("place") == 1))

    @cached_property
    def b_edges(self) -> DataFrame:
        return self._ranked_b.drop("place")

    @cached_property
    def pairs(self) -> DataFrame:
        """Both kinds of edges are independent, so their steps are written side by side."""
        with ThreadPoolExecutor(2) as pool:
            a, b = (pool.submit(inheritable_thread_target(self.tags.sparkSession)(f)) for f in (lambda: self.a_edges, lambda: self.b_edges))
            return merge.merge_candidates(a.result(), b.result())

    @cached_property
    def decisions(self) -> DataFrame:
        """Every pair of either kind is one row, so both kinds' undirected edges are counted here too."""
        d, s = F.col("decision"), F.col("src")
        counts = {"a_edges": F.col("is_a"), "b_edges": F.col("is_b"), "keep_b_ab": s.isin("B", "AB"), "keep_a": s == "A", "veto_a": d == "veto-A", "below_b": d == "below-B"}
        return self._written("decisions", merge.decide(self.pairs, self.vecs, self.limits), **{k: F.count_if(c) for k, c in counts.items()})

    @cached_property
    def top(self) -> DataFrame:
        return merge.top_edges(merge.kept_edges(self.decisions), self.limits.top_k)

    @cached_property
    def capped(self) -> DataFrame:
        return merge.capped(self.top, self.limits.cap)

    @cached_property
    def _final(self) -> DataFrame:
        """A writer of k links has one row of rank k, so the rows of each rank give the histogram."""
        g = merge.final_graph(self.capped)
        if self.protected is None:
            g = g.withColumn("writer", F.lit(True))
        else:
            g = g.join(self.protected.select("idx", F.lit(False).alias("writer")), "idx", "left").withColumn("writer", F.coalesce("writer", F.lit(True)))
        counts = {f"rank{k}": F.count_if(F.col("writer") & (F.col("rank") == k)) for k in range(1, self.limits.cap + 1)}
        return self._written("graph", g, self_links=F.count_if(F.col("writer") & (F.col("idx") == F.col("nbr"))), **counts)

    @cached_property
    def final(self) -> DataFrame:
        return self._final.drop("writer")

    @cached_property
    def writers(self) -> DataFrame:
        """The final graph without protected notes' own rows."""
        return self._final.where("writer").drop("writer")

    def link_counts(self, writable: int) -> list[int]:
        """How many of `writable` notes have 0, 1, ... links."""
        least = [writable, *(self.figures("graph").get(f"rank{k}", 0) for k in range(1, self.limits.cap + 1)), 0]
        return [a - b for a, b in zip(least, least[1:])]
