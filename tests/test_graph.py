"""The graph's operators on small relations."""

import random

import pytest
from pyspark.sql import functions as F

import numpy as np

from kindred.config import REPORTS_REL, Settings, Thresholds, resolve
from kindred.functions import scalars
from kindred.operators import merge, report, terms, vectors
from kindred.plans.graph import Graph
from kindred.sources import corpus

LIMITS = Thresholds()


def a_edges(spark, tags, authors=(), n=None):
    t = spark.createDataFrame(tags, "idx long, tag string") if tags else spark.createDataFrame([], "idx long, tag string")
    a = spark.createDataFrame(list(authors), "idx long, name string")
    n = n or 1 + max(i for i, _ in [*tags, *authors])
    return {(r["i"], r["j"]): r["cos"] for r in terms.undirected(terms.a_edges(terms.term_weights(terms.doc_terms(t, a), n))).collect()}


def test_settings():
    home = {"HOME": "/h"}
    with pytest.raises(ValueError, match="vault root required"):
        resolve(env=home)
    assert resolve("/flag", env=home | {"KINDRED_VAULT_ROOT": "/env"}).vault_root == "/flag"
    c = resolve(env=home | {"KINDRED_VAULT_ROOT": "/env"}, cache_dir="/c")
    assert (c.vault_root, c.reports_rel, c.folders, c.protected) == ("/env", REPORTS_REL, ("00-General", "01-Simulation", "02-Security"), ())
    assert c.reports_dir == f"/env/{REPORTS_REL}" and c.embed_cache.startswith("/c/") and c.db_path.startswith("/h/")
    with pytest.raises(ValueError):
        resolve("/v", env={})
    assert resolve("/v", db_path="/x.db", folders=("A",), protected=("A/n.md",), env={}).folders == ("A",)


def test_terms(spark):
    zero = [(i, "Concept/x") for i in range(3)] + [(0, "Method/shared"), (1, "Method/shared")]
    assert a_edges(spark, zero) == {(0, 1): pytest.approx(1.0)}
    coarse = [(i, "Concept/coarse") for i in range(205)] + [(205 + i, f"Concept/own{i}") for i in range(20)]
    assert a_edges(spark, coarse) == {}  # df 205 is above the gate and below n
    rare = [(0, "Concept/a"), (0, "Method/b"), (1, "Concept/a"), (1, "Method/b"), (2, "Concept/c"), (3, "Concept/d")]
    assert set(a_edges(spark, rare)) == {(0, 1)}
    low = [(0, "Concept/a"), (1, "Concept/a"), *((i, f"Concept/own{i}{k}") for i in range(2) for k in range(4)), (2, "Concept/z")]
    assert a_edges(spark, low, n=4) == {}
    assert a_edges(spark, [(0, "学術論文"), (1, "学術論文"), (0, "Year/2020"), (1, "Year/2020"), (0, "Type/journal"), (1, "Type/journal")], n=9) == {}
    assert set(a_edges(spark, [], [(0, "Alice"), (1, "Alice"), (2, "Bob")])) == {(0, 1)}


def test_specific_terms_first_equals_all_terms(spark):
    r = random.Random(1)
    rows = sorted({(i, f"Concept/{min(int(r.expovariate(0.3)), 12)}") for i in range(60) for _ in range(5)})
    lim = Thresholds(a_specific_df=12, a_min=0.05)
    w = terms.term_weights(spark.createDataFrame(rows, "idx long, term string"), 60).persist()
    x, y = (w.select(F.col("idx").alias(k), "term", F.col("w").alias(f"w{k}"), "df") for k in "ij")
    direct = x.join(y.drop("df"), "term").where("i < j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("dot"), F.min("df").alias("low")).where("low <= 12")
    assert {(r.i, r.j): round(r.dot, 9) for r in direct.collect()} == {(r.i, r.j): round(r.dot, 9) for r in terms.pair_dots(w, lim).collect()}


def test_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(50)] + [(50, None), (51, [0.0] * 5)]
    v = spark.createDataFrame(rows, "idx long, vec array<float>").select("idx", scalars.normalised(F.col("vec")).alias("vec")).persist()
    one = {(x.i, x.j): round(x.cos, 5) for x in vectors.pair_cosines(v).collect()}
    many = {(x.i, x.j): round(x.cos, 5) for x in vectors.pair_cosines(v, block=9).collect()}
    assert len(one) == 51 * 50 // 2 and one == many
    pairs = spark.createDataFrame([(0, 1), (0, 50)], "i long, j long")
    got = {x.j: x.emb_cos for x in vectors.with_cosine(pairs, v).collect()}
    assert got[50] is None and round(got[1], 5) == one[0, 1]
    e = vectors.b_edges(v, Thresholds(b_min=0.3)).collect()
    for s in range(50):
        best = sorted((-c, (set(p) - {s}).pop()) for p, c in one.items() if s in p and c >= 0.3)[:8]
        assert sorted(x.dst for x in e if x.src == s) == sorted(d for _, d in best)
    assert spark.range(1).select(scalars.at_least(F.lit(float("nan")).cast("float"), 0.5).alias("x")).first().x is False


def unit(c):
    return [c, (1 - c * c) ** 0.5]


def test_decisions(spark):
    vec = [(0, [1.0, 0.0]), *((i, unit(c)) for i, c in ((1, 0.7), (2, 0.6), (3, 0.45), (4, 0.2), (5, 0.2)))]
    v = spark.createDataFrame(vec, "idx long, vec array<float>")
    a = spark.createDataFrame([(0, 1, 0.5), (0, 3, 0.5), (0, 4, 0.5), (0, 9, 0.5)], "src long, dst long, cos double")
    b = spark.createDataFrame([(0, 1, 0.7), (0, 2, 0.6), (5, 0, 0.2)], "src long, dst long, cos float")
    d = merge.decide(merge.merge_candidates(a, b), v).persist()
    assert {r.j: (r.decision, r.src) for r in d.collect()} == {1: ("keep", "AB"), 2: ("keep", "B"), 3: ("keep", "A"), 4: ("veto-A", None), 5: ("below-B", None), 9: ("drop-no-vec", None)}
    assert report.decision_stats(d).first().asDict() == {"keep_b_ab": 2, "keep_a": 1, "veto_a": 1, "below_b": 1}
    assert merge.merge(a, b, v).where("idx = 9").count() == 0


def loop_cap(edges, cap):
    """Remove the weakest edge of any note above the cap, again and again."""
    left = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    while True:
        deg: dict = {}
        for i, j, _ in left:
            deg[i], deg[j] = deg.get(i, 0) + 1, deg.get(j, 0) + 1
        over = [e for e in left if deg[e[0]] > cap or deg[e[1]] > cap]
        if not over:
            return {(i, j) for i, j, _ in left}
        left.remove(over[-1])


def test_cap_equals_the_loop(spark):
    r = random.Random(3)
    for cap in (2, 4):
        e = [(i, j, r.choice([0.5, 0.75, 0.625])) for i in range(18) for j in range(i + 1, 18) if r.random() < 0.5]
        df = spark.createDataFrame([(*x, "B") for x in e], "i long, j long, w float, src string")
        assert {(x.i, x.j) for x in merge.capped(df, cap).collect()} == loop_cap(e, cap)
    hub = spark.createDataFrame([(0, k, 0.60 + k / 100, "B") for k in range(1, 15)], "i long, j long, w float, src string")
    g = merge.final_graph(merge.capped(hub, 10)).persist()
    assert [x.nbr for x in g.where("idx = 0").orderBy("rank").collect()] == list(range(14, 4, -1))
    assert report.asymmetric(g).count() == 0
    assert merge.top_edges(hub, 8).count() == 14  # each leaf keeps its only edge


def test_input_order_does_not_matter(spark):
    r = random.Random(4)
    tags = [(i, f"Concept/{r.randrange(9)}") for i in range(30) for _ in range(3)]
    vec = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    out = []
    for _ in range(2):
        r.shuffle(tags)
        r.shuffle(vec)
        v = spark.createDataFrame(vec, "idx long, vec array<float>").select("idx", scalars.normalised(F.col("vec")).alias("vec"))
        g = Graph(spark.createDataFrame(tags, "idx long, tag string").distinct(), spark.createDataFrame([], "idx long, name string"), v, 30, Thresholds(0.1, 200, 0.2, 0.1, 3, 4))
        out.append(sorted(map(tuple, g.final.collect())))
    assert out[0] == out[1] and out[0] and not [x for x in out[0] if x[0] == x[2]]
    deg = {}
    for x in out[0]:
        deg[x[0]] = deg.get(x[0], 0) + 1
    assert max(deg.values()) <= 4


def test_corpus(spark):
    cfg = Settings("/v", "my_reports", ("A", "B"), protected=("A/x.md",))
    p = ["/v/my_reports/A/x.md", "/v/my_reports/B/x.md", "/v/my_reports/A/_no.md", "/v/my_reports/A/sub/y.md", "/v/my_reports/C/z.md", "/v/myXreports/A/w.md", "/v/my_reports/A/u.txt", "/v/my_reports/A/only.md", "/w/my_reports/A/x.md"]
    papers = spark.createDataFrame([(100 - i, x, None) for i, x in enumerate(p)], "id long, file_path string, title string")
    c = corpus.scan(papers, cfg).persist()
    assert [(r.idx, r.relpath, r.title) for r in c.orderBy("idx").collect()] == [(0, "A/only.md", ""), (1, "B/x.md", ""), (2, "A/x.md", "")]
    assert {r.idx: r.target for r in corpus.link_targets(c, cfg.reports_rel).collect()} == {0: "only", 1: "my_reports/B/x", 2: "my_reports/A/x"}
    assert report.corpus_stats(c, cfg.protected).first().asDict() == {"n_papers": 3, "n_protected": 1}
    there = spark.createDataFrame([(p[0],), (p[7],)], "path string")
    assert [r.relpath for r in corpus.live(c, there).orderBy("idx").collect()] == ["A/only.md", "A/x.md"]
    names = spark.createDataFrame([(100, " a　"), (100, "a"), (100, " "), (100, None)], "paper_id long, name string")
    assert [tuple(r) for r in corpus.corpus_authors(c, names).collect()] == [(2, "a")]


def test_reports(spark):
    e = spark.createDataFrame([(0, i, float(i)) for i in range(1, 6)], "src long, dst long, cos double")
    assert list(report.percentiles(e, "x").first())[1:] == [3.0, 4.0, 4.6, 4.8, 4.96]
    assert list(report.percentiles(e.limit(0), "x").first())[1:] == [None] * 5
    assert list(report.percentiles(e.where("dst = 2"), "x").first())[1:] == [2.0] * 5
    deg = spark.createDataFrame([(i, min(i, 12) if i < 20 else 0) for i in range(50)], "idx long, degree long")
    h = {r.links: (r.notes, r.bar) for r in report.histogram(deg).collect()}
    assert h[0] == (31, "###") and h[10][0] == 10 and len(h) == 11
    w = spark.createDataFrame([(i, 1, i + 1, 0.5, "A" if i % 3 else "B") for i in range(60)], "idx long, rank int, nbr long, w float, src string")
    s = [tuple(r) for r in report.sample(w).collect()]
    assert len(s) == len(set(x for x, _ in s)) == 20 and sorted(k for _, k in s) == ["A"] * 8 + ["B"] * 8 + ["any"] * 4
    assert set(s) == {tuple(r) for r in report.sample(w.repartition(5)).collect()}
    assert report.sample(w.limit(3)).count() == 3


def test_best_edges_in_blocks_equal_all_pairs(spark):
    """Blocks send out only the best of each note, with ties by the smaller target, as if all pairs were ranked."""
    r = np.random.default_rng(4)
    m = r.normal(size=(60, 8)).astype(np.float32)
    m[20:35] = m[3]  # copies: more ties than places
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "idx long, vec array<float>")
    for block in (7, 1000):
        got = {(e.src, e.dst) for e in vectors.b_edges(v, Thresholds(b_min=0.3), block=block).collect()}
        pairs = {(p.i, p.j): p.cos for p in vectors.pair_cosines(v, 0.3, block=block).collect()}
        both = [(i, j, c) for (a, b), c in pairs.items() for i, j in ((a, b), (b, a))]
        want = set()
        for i in range(60):
            want |= {(i, j) for _, j in sorted((-c, j) for k, j, c in both if k == i)[: Thresholds().top_k]}
        assert got == want


def test_numbered_by_ranges(spark):
    from kindred.sources.shared import numbered

    ids = [7 * i % 101 for i in range(101)]
    got = numbered(spark.createDataFrame([(i, "x") for i in ids], "id long, idx string").repartition(5), "id", "pos").collect()
    assert {(x["id"], x["pos"]) for x in got} == {(i, i) for i in range(101)}
    assert numbered(spark.createDataFrame([], "id long"), "id", "pos").count() == 0


def brute_edges(m, k, floor):
    """Each row's k best by (cosine, smaller number), summed in double precision."""
    c = (m.astype(np.float64) @ m.astype(np.float64).T).astype(np.float32)
    out = set()
    for i, row in enumerate(c):
        found = sorted((-x, j) for j, x in enumerate(row.tolist()) if j != i and x >= np.float32(floor))  # never true of NaN
        out |= {(i, j) for _, j in found[:k]}
    return out


def test_cells_prune_and_lose_nothing(spark):
    """Tight clusters: most copies aren't sent. Zero, broken and repeated vectors are among them; spread ones prune little."""
    from pyspark.sql import Observation

    r = np.random.default_rng(7)
    tight = np.repeat(r.normal(size=(12, 16)), 40, axis=0) + 0.15 * r.normal(size=(480, 16))
    spread = r.normal(size=(200, 16))
    for m, floor, least in ((tight, 0.5, 0.6), (spread, 0.3, 0.0), (np.concatenate([tight[:100], np.repeat(tight[:1], 90, axis=0)]), 0.9, 0.0)):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        m[5], m[17] = 0, np.nan
        m = m.astype(np.float32)
        v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(9999, None)], "idx long, vec array<float>").repartition(5)
        watch = Observation()
        got = {(e.src, e.dst) for e in vectors.b_edges(v, Thresholds(b_min=floor), block=30, watch=watch).collect()}
        assert got == brute_edges(m, 8, floor) and got
        assert 1 - watch.get["sent"] / watch.get["possible"] >= least
    one = Observation()
    assert {(e.src, e.dst) for e in vectors.b_edges(v, Thresholds(b_min=floor), watch=one).collect()} == got and one.get["sent"] == 0
    assert vectors.b_edges(v.limit(0)).count() == 0


def test_not_a_number_takes_no_place(spark):
    rows = [(0, [1.0, 0.0]), *((i, unit(c)) for i, c in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6))), (5, [float("nan"), 0.0])]
    v = spark.createDataFrame(rows, "idx long, vec array<float>")
    for block in (2, 100):
        got = [(e.src, e.dst) for e in vectors.b_edges(v, Thresholds(b_min=0.1, top_k=3), block=block).collect()]
        assert sorted(d for s, d in got if s == 0) == [1, 2, 3] and not [e for e in got if 5 in e]


def test_vectors_of_different_width(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [0.6, 0.8]), (2, [0.0, 0.6, 0.8]), (3, [0.8, 0.6])], "idx long, vec array<float>")
    want = {(x.i, x.j) for x in vectors.pair_cosines(v, 0.5).collect()}
    for block in (1, 2, 100):
        assert {(min(e.src, e.dst), max(e.src, e.dst)) for e in vectors.b_edges(v, Thresholds(b_min=0.5), block=block).collect()} == want


def test_prefix_pairs_score_few_and_lose_none(spark):
    r = random.Random(11)
    rows = sorted({(i, f"Concept/{min(int(r.expovariate(0.05)), 300)}") for i in range(150) for _ in range(r.choice([2, 8, 30]))})
    for t, df in ((0.1, 12), (0.3, 40), (0.0, 12), (0.95, 200)):
        lim = Thresholds(a_specific_df=df, a_min=t)
        w = terms.term_weights(spark.createDataFrame(rows, "idx long, term string"), 150).persist()
        norms = {x.idx: x.norm for x in terms.doc_norms(w).collect()}
        every = {(x.i, x.j): x.dot / norms[x.i] / norms[x.j] for x in terms.pair_dots(w, lim).collect()}
        got = {(x.i, x.j): x.cos for x in terms.candidates(w, lim).collect()}
        want = {p: c for p, c in every.items() if c >= t}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
        scored = terms.scored_pairs(terms.postings(w, lim), lim)
        assert len(want) <= scored.where("dot * 1.000001 >= need").count() <= scored.count() <= len(every)
        assert t < 0.9 or scored.count() < 0.5 * len(every)


def test_percentiles_by_rank(spark):
    r = np.random.default_rng(3)
    for n in (2, 3, 100, 101, 5000):
        w = r.choice([0.25, 0.5, 0.75, 1.0], n) if n == 5000 else r.random(n)  # very common weights, or none twice
        e = spark.createDataFrame([(0, i + 1, float(x)) for i, x in enumerate(w)], "src long, dst long, cos double").repartition(4)
        got = list(report.percentiles(e, "x").first())[1:]
        assert np.allclose(got, np.percentile(w, report.POINTS), atol=6e-5), n
    plan = report.percentiles(e, "x")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_one_stem_for_all_notes(spark):
    c = spark.range(3000).select(F.col("id").alias("idx"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("folder"), F.when(F.col("id") < 2990, "index.md").otherwise(F.concat(F.col("id").cast("string"), F.lit(".md"))).alias("basename"))
    t = corpus.link_targets(c, "r")
    assert "Window" not in t._jdf.queryExecution().toString()
    got = {x.idx: x.target for x in t.collect()}
    assert len(got) == 3000 and all(got[i] == (f"r/f{i}/index" if i < 2990 else str(i)) for i in got)
    exchanged = spark.createDataFrame([(i, "f", "index.md") for i in range(3000)], "idx long, folder string, basename string")
    assert corpus.link_targets(exchanged, "r").where("target <> 'r/f/index'").count() == 0


def test_pairs_meet_their_vectors_in_blocks(spark):
    r = np.random.default_rng(5)
    rows = [(i, None if i % 9 == 0 else r.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows[7] = (7, [float("nan")] * 6)
    v = spark.createDataFrame(rows, "idx long, vec array<float>")
    ends = sorted({tuple(sorted(map(int, r.integers(0, 70, 2)))) for _ in range(150)} | {(3, k) for k in range(4, 60)})  # one note has very many
    pairs = spark.createDataFrame([(i, j, f"{i}-{j}", None) for i, j in ends if i < j], "i long, j long, name string, none double").repartition(4)
    x, y = (v.toDF(k, f"v{k}") for k in "ij")
    both = pairs.join(x, "i", "left").join(y, "j", "left")
    want = {(p.i, p.j): p.c for p in both.select("i", "j", F.when(F.col("vi").isNotNull() & F.col("vj").isNotNull(), scalars.dot(F.col("vi"), F.col("vj"))).alias("c")).collect()}
    for block in (7, 1000):
        got = vectors.with_cosine(pairs, v, block=block)
        assert got.columns == ["i", "j", "name", "none", "emb_cos"]
        rows = got.collect()
        assert len(rows) == len(want) and all(p.name == f"{p.i}-{p.j}" and p.none is None for p in rows)
        for p in rows:
            c = want[p.i, p.j]
            assert (p.emb_cos is None) == (c is None) and (c is None or np.isnan(c) and np.isnan(p.emb_cos) or abs(p.emb_cos - c) < 1e-6)
    assert vectors.with_cosine(pairs.limit(0), v).count() == 0 and vectors.with_cosine(pairs, v.limit(0)).where("emb_cos is not null").count() == 0
