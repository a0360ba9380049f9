"""Findings of the fourth round."""

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.config import Thresholds
from kindred.functions.scalars import round4
from kindred.operators import termblocks, terms, vectors
from kindred.plans import queries
from kindred.sources import shared


def test_twin_spells_numbers_as_the_dump(spark):
    vals = [k / 10000 for k in range(-10000, 10001, 3)] + [-0.0, -0.00001, -0.00004999, 0.00001, 0.0001, -0.0009, 0.001, 1.0]
    rows = spark.createDataFrame(list(enumerate(vals)), "i long, x double")
    got = {r.i: r.j for r in rows.select("i", F.to_json(F.struct(round4(F.col("x")).alias("x"))).alias("j")).collect()}
    at = duckdb.connect()
    at.register("rows", pa.table({"i": list(range(len(vals))), "x": vals}))
    want = dict(at.sql(f"SELECT i, '{{\"x\":' || {queries._json_number('x')} || '}}' FROM (SELECT i, round(x * 10000) / 10000 AS x FROM rows)").fetchall())
    assert got == want


def test_tag_pairs_meet_in_blocks_and_are_not_exchanged(spark):
    r = random.Random(17)
    rows = sorted({(i, f"Concept/{min(int(r.expovariate(0.05)), 300)}") for i in range(150) for _ in range(r.choice([1, 2, 8, 30]))} | {(i, f"Concept/copy{k}") for i in range(150, 170) for k in range(3)})
    w = terms.term_weights(spark.createDataFrame(rows, "idx long, term string"), 170).persist()
    norms = {x.idx: x.norm for x in terms.doc_norms(w).collect()}
    for t, df in ((0.0, 12), (0.15, 40), (0.6, 200)):
        lim = Thresholds(a_specific_df=df, a_min=t)
        every = {(x.i, x.j): x.dot / norms[x.i] / norms[x.j] for x in terms.pair_dots(w, lim).collect()}
        want = {p: c for p, c in every.items() if c >= t}
        found = terms.candidates(w, lim, block=150)  # many blocks, some of one norm
        got = [(x.i, x.j, x.cos) for x in found.collect()]
        assert len(got) == len(want) and all(abs(want[i, j] - c) < 1e-12 for i, j, c in got)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "Aggregate" not in plan and "SortMergeJoin" not in plan  # what is dealt is notes


def test_blocks_of_tag_pairs_meet_each_other_once():
    bins = [(k, 30 + 7 * (k % 5), 2.0 ** (k / 8), 2.0 ** ((k + 0.9) / 8)) for k in range(60)]
    bins[20] = (20, 400, *bins[20][2:])  # one norm's notes fill several blocks
    for t in (0.0, 0.15, 0.7):
        table, slots = termblocks._slots(bins, t, 100)
        to = {(b, part): x for b, _, part, x in table}
        norm = {b[0]: b[2:] for b in bins}
        for (s, ps), x in to.items():
            own = [k for k, smaller in x if smaller]
            assert own and max(own) < slots
            for (l, pl), y in to.items():
                shared = [k for k in own if (k, False) in y]
                assert len(shared) <= 1
                if norm[s][0] <= norm[l][1] and norm[s][1] >= t * norm[l][0]:
                    assert shared, (t, s, ps, l, pl)


def test_all_vector_pairs_pass_by_blocks(spark):
    r = np.random.default_rng(23)
    rows = [(i, None if i % 11 == 0 else r.normal(size=5 - i % 2).astype(np.float32).tolist()) for i in range(90)]
    rows[7] = (7, [float("nan")] * 5)
    v = spark.createDataFrame(rows, "idx long, vec array<float>").repartition(3)
    m = {i: np.pad(np.array(x, np.float64), (0, 5 - len(x))) for i, x in rows if x is not None}
    every = {(i, j): np.float32(m[i] @ m[j]) for i in m for j in m if i < j}
    for block in (4, 13, None):
        for floor in (None, 0.5):
            found = vectors.pair_cosines(v, floor, block=block)
            got = [(x.i, x.j, x.cos) for x in found.collect()]
            want = {p: c for p, c in every.items() if floor is None or c >= floor}
            assert len(got) == len(want) and all(np.isclose(want[i, j], c, rtol=1e-5, equal_nan=True) for i, j, c in got)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no task gathers all pairs of two blocks before it gives one


def test_both_ways_from_one_product():
    r = np.random.default_rng(29)
    a, b = r.normal(size=(40, 6)), r.normal(size=(50, 6))
    a[3:20], b[5:30] = a[2], a[2]  # more equal cosines than are kept
    a[30] = np.nan
    i, j, k = np.arange(0, 80, 2), np.arange(1, 101, 2), 3
    key = lambda found: sorted((x, y) for s, d, _ in found for x, y in zip(s.tolist(), d.tolist()))
    for low, high in ((np.full(40, -9.0), np.full(50, -9.0)), (r.normal(size=40), r.normal(size=50) + 1)):
        got = key(vectors._nearest_both(i, a, low, j, b, high, k))
        assert got == key([*vectors._nearest(i, a, j, b, k, low), *vectors._nearest(j, b, i, a, k, high)])


def test_tag_pairs_are_found_once_for_both_directions(spark):
    w = terms.term_weights(spark.createDataFrame([(i, f"Concept/{k}") for i in range(12) for k in (i, (i + 1) % 12)], "idx long, term string"), 12)
    e = terms.a_edges(w, Thresholds(a_min=0.1))
    assert e._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(x.src, x.dst) for x in e.collect()}
    assert got == {(i, (i + d) % 12) for i in range(12) for d in (1, 11)}


def test_shuffle_files_go_before_the_next_step(spark):
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f"shuffle_{x}" for x in re.findall(r"shuffle_(\d+)_\d+_\d+\.data", str(root.getAllFiles()))}
    before = files()
    shared.written(spark.range(50_000).repartition(7).groupBy((F.col("id") % 9).alias("k")).count(), "step")
    own = files() - before
    assert own
    time.sleep(1)
    shared.written(spark.range(9), "next")
    for _ in range(40):
        if own & files():
            time.sleep(0.5)
    assert not own & files()
