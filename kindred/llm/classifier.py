"""A quality classifier as a sparse rule ensemble, compiled into column expressions.

Boosted trees of depth 3 over text statistics are grown on a bounded sample of labelled rows; every path
from a root is a conjunctive rule. A lasso logistic regression weighs the rules, most weights become
zero, and the rest are one built-in expression over the statistics, so scoring all documents is a
single scan inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import table
from kindred.llm.textstats import FEATURES, with_features

#: Labelled rows the fit may use; those with the smallest hashes of their ids are taken.
MAX_ROWS = 12_000
CUTOFF = 0.7
_TREES, _DEPTH, _BINS, _RATE, _LAMBDA, _STEPS = 24, 3, 32, 0.3, 5e-4, 400

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, cut): all must hold


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 over the columns FEATURES."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            held = F.lit(True)
            for j, above, cut in rule:
                held &= F.col(FEATURES[j]) > cut if above else F.col(FEATURES[j]) <= cut
            z += F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same over rows of FEATURES."""
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, rule: Rule, out: list[tuple[Rule, np.ndarray, float]]) -> None:
    """Split where the sum of squared mean gradients grows most; record every path and every leaf's step."""
    best = (1e-9, 0, 0)
    total, n = g[rows].sum(), len(rows)
    for j, c in enumerate(cuts) if len(rule) < _DEPTH and n >= 20 else ():
        k = np.bincount(codes[rows, j], minlength=len(c) + 1).cumsum()[:-1]
        s = np.bincount(codes[rows, j], g[rows], minlength=len(c) + 1).cumsum()[:-1]
        ok = (k >= 10) & (n - k >= 10)
        gain = np.where(ok, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, 0)
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), j, int(gain.argmax()))
    if best[0] <= 1e-9:
        out.append((rule, rows, total / max(n, 1)))
        return
    _, j, i = best
    for above in (False, True):
        part, path = rows[(codes[rows, j] > i) == above], (*rule, (j, above, float(cuts[j][i])))
        if len(path) < _DEPTH:
            out.append((path, part, 0.0))
        _grow(x, codes, cuts, g, part, path, out)


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules by boosting, weights by lasso logistic regression (accelerated proximal gradient). One class or no rows: its rate alone."""
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return Ensemble(bias, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, _BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    z, rules = np.full(len(y), bias), {}
    for _ in range(_TREES):
        p, paths = 1 / (1 + np.exp(-z)), []
        _grow(x, codes, cuts, y - p, np.arange(len(y)), (), paths)
        for rule, rows, step in paths:
            if rule:
                rules[tuple(sorted(rule))] = None
            z[rows] += _RATE * 4 * step
    names = list(rules)
    a = np.column_stack([np.ones(len(y)), *(holds(r, x) for r in names)]).astype(np.float64)
    size = np.linalg.norm(a, 2) ** 2 / (4 * len(y))
    w = np.zeros(a.shape[1])
    w[0], v, t = bias, None, 1.0
    v = w.copy()
    for _ in range(_STEPS):
        new = v - a.T @ (1 / (1 + np.exp(-a @ v)) - y) / len(y) / size
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - _LAMBDA / size, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / u * (new - w), new, u
    return Ensemble(float(w[0]), tuple((r, float(c)) for r, c in zip(names, w[1:]) if abs(c) > 1e-6))


def held_out(id_col: str) -> Column:
    """Rows that never teach: the CRC-32 of the id as text is 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Ensemble:
    """Fit on at most `max_rows` labelled documents that aren't held out. An id with several labels teaches the lowest; nulls teach nothing."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_features(src.join(F.broadcast(sample), "id"), "text", ("id", "y"))  # at most max_rows ids
    got = rows.orderBy("id", *FEATURES).limit(max_rows).toPandas()
    return fit(got[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES)), got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null and empty texts score as texts without words. Repeated rows stay; other columns are ignored."""
    f = with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ("id",))
    return f.select("id", model.score().alias("score"))


def accepted(docs: DataFrame, model: Ensemble, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs`, whole, whose score is at least `cutoff`."""
    f = with_features(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), "_text", ("_row",))
    # The row number keeps the filter from being pushed below the statistics, which it would then compute once for each mention.
    scored = f.select("_row", model.score().alias("_score"), F.monotonically_increasing_id().alias("_n"))
    return scored.where((F.col("_score") >= cutoff) & (F.col("_n") >= 0)).select("_row.*")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model fitted on labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
