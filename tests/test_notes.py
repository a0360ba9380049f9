"""Note texts, front matter, caches and the command line's run."""

import io
import os
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from kindred.config import Settings
from kindred.functions import frontmatter, text
from kindred.sources import corpus, embeddings, sinks


def extracted(spark, *notes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i long, t string")
    return [r.body for r in text.extract(df, "t").orderBy("i").collect()]


def test_extraction(spark):
    note = "---\na: b\n---\n# T\n## 2. 要約\n### H3\n> [!note] head\n> quote [[l|x]] 　and\n<!-- c\n# d\n--> ![[i]] end\n## 3. Next\nno"
    assert extracted(spark, note)[0] == "### H3 quote and end"
    long = "あ" * 3000
    got = extracted(spark, long, "x\n##要約\ny", "## 2.要約　\nz\n# still\n##\tstop\nno", None, "---\nopen\n## 要約\nb", "## 要約 x\nw", "a [[b\rc]] d")
    assert got[0] == "あ" * 1500
    assert got[1:] == ["y", "z # still", "", "b", "## 要約 x w", "a d"]


def test_inputs_and_hashes(spark):
    c = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert c(text.embed_input(F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert len(c(text.embed_input(F.lit("t"), F.lit("😀" * 3000)))) == 2000
    blank = "36a9e7f1c95b82ffb99743e0c5c4ce95d83c9a430aac59f84ef3cbfab6145068"
    assert c(text.hash_input(F.lit(""))) == c(text.hash_input(F.lit(" "))) == blank
    assert c(text.stem(F.lit("a.md.md"))) == "a.md" and c(text.stem(F.lit("a.md\n"))) == "a.md\n"


BLOCK = 'related-documents:\n  - "[[X]]"\n  - "[[Y]]"'
CASES = [
    ("---\na: 1\nrelated-documents: []\nb: 2\n---\nbody\n", f"---\na: 1\n{BLOCK}\nb: 2\n---\nbody\n"),
    ('---\nrelated-documents:\n  - "[[old]]"\n  - z\nb: 2\n---\n', f"---\n{BLOCK}\nb: 2\n---\n"),
    ("---\na: 1\n---\nbody", f"---\na: 1\n{BLOCK}\n---\nbody"),
    ("no front matter\n---\n", None),
    ("---\nopen\n", None),
    ("", None),
    ("---\nrelated-documents: [x]\n---\n", f"---\nrelated-documents: [x]\n{BLOCK}\n---\n"),  # not empty: a second key
    ("---\nrelated-documents:\n- x\n---\n", f"---\n{BLOCK}\n- x\n---\n"),  # not indented: stays
    ("---\nrelated-documents:\n  -x\n---\n", f"---\n{BLOCK}\n  -x\n---\n"),
    ("---\nrelated-documents:\nrelated-documents: [ ]\n---\n", f"---\n{BLOCK}\n{BLOCK}\n---\n"),
    ("--- \r\na: 1\r\n---\r\nbody\r\n", f"---\na: 1\r\n{BLOCK}\n---\nbody\r\n"),
    ("---\n---\n", f"---\n{BLOCK}\n---\n"),
]


def test_rewriting(spark):
    df = spark.createDataFrame([(i, t, ["X", "Y"]) for i, (t, _) in enumerate(CASES)], "i long, t string, ts array<string>")
    once = frontmatter.rewrite(df, "t", "ts").orderBy("i").collect()
    for r, (t, want) in zip(once, CASES):
        assert (r.new_text, r.changed) == (t if want is None else want, want is not None), t
    again = frontmatter.rewrite(spark.createDataFrame([(r.i, r.new_text, ["X", "Y"]) for r in once], df.schema), "t", "ts")
    assert not again.where("changed").count()
    none = spark.createDataFrame([("---\nrelated-documents:\n  - a\n---\n", [])], "t string, ts array<string>")
    assert frontmatter.rewrite(none, "t", "ts").first().new_text == "---\nrelated-documents: []\n---\n"


def test_cache(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    assert embeddings.load_cache(spark, path).count() == 0
    empty = spark.createDataFrame([], embeddings.CACHE)
    assert not embeddings.save_cache(empty, path) and not (tmp_path / "c.parquet").exists()
    one = spark.createDataFrame([("h", [1.0, 2.0])], embeddings.CACHE)
    assert embeddings.save_cache(one, path) and embeddings.load_cache(spark, path).collect() == one.collect()
    assert embeddings.save_cache(embeddings.load_cache(spark, path).union(spark.createDataFrame([("i", [3.0])], embeddings.CACHE)), path)
    assert embeddings.load_cache(spark, path).count() == 2
    (tmp_path / "bad.parquet").write_bytes(b"not a file of the kind")
    assert embeddings.load_cache(spark, str(tmp_path / "bad.parquet")).count() == 0


def test_provider():
    calls, waits = [], []

    def send(req, timeout):
        calls.append(json.loads(req.data))
        if len(calls) < 3:
            raise urllib.error.HTTPError(req.full_url, 429 if len(calls) == 1 else 503, "busy", {}, io.BytesIO(b"wait"))
        return io.BytesIO(json.dumps({"data": [{"index": 1, "embedding": [2.0]}]}).encode())

    embed = embeddings.http_provider("http://h", "m", "k", send, waits.append)
    assert embed(["a", ""]) == ([None, [2.0]], 0) and waits == [2.0, 4.0] and calls[-1]["input"] == ["a", " "]

    def refuse(req, timeout):
        raise urllib.error.HTTPError(req.full_url, 401, "no", {}, io.BytesIO(b"key"))

    with pytest.raises(RuntimeError, match="401"):
        embeddings.http_provider("http://h", "m", "k", refuse)(["a"])


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok\r\n")
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in corpus.notes(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "ok\r\n", "b.md": "bad � byte"}
    with pytest.raises(Exception):
        corpus.notes(spark, str(tmp_path), strict=True).collect()
    rows = [(str(tmp_path / "a.md"), "new\r\nüé", True), (str(tmp_path / "b.md"), "untouched", False)]
    sinks.write_notes(spark.createDataFrame(rows, "file_path string, new_text string, changed boolean"))
    assert (tmp_path / "a.md").read_bytes() == "new\r\nüé".encode() and (tmp_path / "b.md").read_bytes() == b"bad \xff byte"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "b.md"]


def test_run(spark, tmp_path):
    from kindred import cli

    vault = tmp_path / "v"
    (vault / "r" / "A").mkdir(parents=True)
    rows = []
    for i in range(6):
        p = vault / "r" / "A" / f"n{i}.md"
        p.write_text(f"---\ntitle: n{i}\n---\nbody {i % 2}\n")
        rows.append((i, str(p), f"n{i}"))
    db = tmp_path / "db"
    spark.createDataFrame(rows, corpus.PAPERS.simpleString()[7:-1].replace(":", " ")).write.parquet(f"{db}/papers.parquet")
    spark.createDataFrame([(i, f"Concept/{i % 2}") for i in range(6)], "paper_id long, tag string").write.parquet(f"{db}/tags.parquet")
    spark.createDataFrame([(0, "x")], "paper_id long, name string").write.parquet(f"{db}/authors.parquet")
    cfg = Settings(str(vault), "r", ("A",), ("A/n5.md",), str(tmp_path / "cache"), str(db))
    provider = lambda ts: ([[1.0, float(t.split()[-1])] for t in ts], len(ts))
    said = []
    g = cli.run(spark, cfg, provider, say=said.append)
    assert g.count() and "[DRY-RUN]" in said and "related" not in (vault / "r" / "A" / "n0.md").read_text()
    cli.run(spark, cfg, None, apply=True, say=said.append)  # everything is cached
    assert "[[n2]]" in (vault / "r" / "A" / "n0.md").read_text() and "related" not in (vault / "r" / "A" / "n5.md").read_text()
    cli.run(spark, cfg, None, apply=True, say=said.append)
    assert any("files changed: 0" in s for s in said)
    assert any(s.startswith("files changed: ") and s.endswith("protected skipped: 1, missing skipped: 0") for s in said)
    assert any("batches=1" in s and "tokens=6" in s for s in said) and any("batches=0" in s for s in said)  # the calls made


def test_cache_survives_a_broken_save(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = lambda *hs: spark.createDataFrame([(h, [1.0]) for h in hs], embeddings.CACHE)
    assert embeddings.save_cache(cache("a"), path) and embeddings.save_cache(cache("a", "b"), path)
    assert {r["hash"] for r in embeddings.load_cache(spark, path).collect()} == {"a", "b"}
    os.rename(path, path + ".old")  # as if a save had stopped between its renames
    assert {r["hash"] for r in embeddings.load_cache(spark, path).collect()} == {"a", "b"}
    assert embeddings.save_cache(cache("c"), path) and {r["hash"] for r in embeddings.load_cache(spark, path).collect()} == {"c"}


def test_calls_are_counted_as_made(spark):
    texts = spark.createDataFrame([(f"h{i}", f"t{i}") for i in range(25)], "hash string, input string").repartition(1)
    got = embeddings.embed(texts, lambda ts: ([[1.0, 0.0]] * len(ts), 3 * len(ts)), batch=10).collect()
    assert sum(r["calls"] for r in got) == 3 and sum(r["tokens"] for r in got) == 75 and len(got) == 25


def test_sqlite_source_and_empty_vault(spark, tmp_path):
    import sqlite3

    db = str(tmp_path / "c.db")
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE papers (id INTEGER, file_path TEXT, title TEXT)")
        c.executemany("INSERT INTO papers VALUES (?, ?, ?)", [(2, "/v/r/A/x.md", None), (1, "/v/r/A/y.md", "t")])
    got = corpus.read_table(spark, db, "papers", corpus.PAPERS)
    assert {tuple(r) for r in got.collect()} == {(2, "/v/r/A/x.md", None), (1, "/v/r/A/y.md", "t")} and got.schema == corpus.PAPERS
    nothing = str(tmp_path / "vault" / "*" / "*.md")
    assert corpus.listing(spark, nothing).count() == 0 == corpus.notes(spark, nothing).count()
    papers = corpus.scan(got, Settings("/v", "r", ("A",)))
    assert [(r["idx"], r["id"]) for r in papers.orderBy("idx").collect()] == [(0, 1), (1, 2)] and corpus.live(papers, corpus.listing(spark, nothing)).count() == 0


def test_command_line(tmp_path, monkeypatch):
    from kindred import cli

    seen = []
    monkeypatch.setattr(cli, "run", lambda spark, cfg, provider, *a, **k: seen.append((cfg, provider, a, k)))
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    cli.main(["--vault-root", str(tmp_path), "--reports-rel", "r", "--folders", "A", "--folders", "B", "--protected", "A/p.md", "--apply", "--limit-embed", "3", "--seed", "7", "--requesters", "2"])
    cfg, provider, a, k = seen[0]
    assert cfg.folders == ("A", "B") and cfg.protected == ("A/p.md",) and provider is None and a == (True, 3, 7) and k == {"requesters": 2}


def test_report_text(spark, tmp_path):
    """The whole report of a small vault, and counts that need no job of their own."""
    from kindred import cli
    from kindred.operators import reporttext

    vault = tmp_path / "v"
    (vault / "r" / "A").mkdir(parents=True)
    rows = []
    for i in range(5):
        p = vault / "r" / "A" / f"n{i}.md"
        p.write_text(f"---\ntitle: n{i}\n---\nbody {i}\n")
        rows.append((i, str(p), f"Note {i}" if i else None))
    db = tmp_path / "db"
    spark.createDataFrame(rows, corpus.PAPERS).write.parquet(f"{db}/papers.parquet")
    spark.createDataFrame([(i, f"Concept/{i % 2}") for i in range(5)] + [(i, "Venue/all") for i in range(5)], "paper_id long, tag string").write.parquet(f"{db}/tags.parquet")
    spark.createDataFrame([], corpus.AUTHORS).write.parquet(f"{db}/authors.parquet")
    cfg = Settings(str(vault), "r", ("A",), ("A/n4.md",), str(tmp_path / "cache"), str(db))
    at = [(1.0, 0.0), (0.0, 1.0), (0.8, 0.6), (0.0, 1.0), (0.6, 0.8)]
    provider = lambda ts: ([list(at[int(t.split()[-1])]) for t in ts], 2 * len(ts))
    said = []
    cli.run(spark, cfg, provider, say=said.append)
    bar = "=" * 72
    want = f"""{bar}
[DRY-RUN]
Corpus size            : 5
Protected (skip-write) : 1
{bar}

--- Phase A (IDF-weighted tag/author cosine) ---
Distinct terms              : 3 (nonzero idf: 2)
Papers with >=1 A-edge      : 5
Total A-edges (undirected)  : 4
A edge-weight percentiles   : p50=1 p75=1 p90=1 p95=1 p99=1

--- Phase B (OpenAI embedding cosine) ---
Embedding batches/API calls : 1 / 1 (cache hits: 0)
Papers embedded             : 5
Papers with >=1 B-edge      : 5
Total B-edges (undirected)  : 8
B cosine percentiles        : p50=0.8 p75=0.84 p90=0.972 p95=0.986 p99=0.9972
API tokens (reported)       : 10

--- Merge edge decisions (B-veto, floor=0.4) ---
  keep (B/AB)         : 8
  keep (A-veto pass)  : 0
  veto-A (tag-only)   : 0
  below-B (B cand)    : 0

--- Final merged graph (writers only; protected excluded) ---
Writable reports            : 4
Will get >=1 link           : 4
Stay empty (related: [])    : 0
Link-count histogram (0..10):
   0:     0 
   1:     0 
   2:     1 
   3:     2 
   4:     1 
   5:     0 
   6:     0 
   7:     0 
   8:     0 
   9:     0 
  10:     0 
Asymmetric edges (must be 0): 0
Dead targets (must be 0)    : 0
Self-links (must be 0)      : 0

TOTAL embedding API calls   : 1

{bar}
20 RANDOM SAMPLE PAPERS (title -> related [target | weight | src])
{bar}
""".split("\n")[:-1]
    assert said[: len(want)] == want
    sample = said[len(want) : next(k for k, x in enumerate(said) if x.startswith("\nFigures"))]
    assert sorted(x for x in sample if x.startswith("[")) == ["[A] ", "[A] Note 1", "[A] Note 2", "[A] Note 3"]
    k = sample.index("[A] ")
    assert sample[k - 1 : k + 3] == ["", "[A] ", "   (AB 0.800)  Note 2", "   (AB 0.600)  Note 4"]
    none = []
    empty = Settings(str(tmp_path / "none"), "r", ("A",), (), str(tmp_path / "cache2"), str(db))
    cli.run(spark, empty, provider, say=none.append)
    assert "A edge-weight percentiles   : p50=None p75=None p90=None p95=None p99=None" in none and "Corpus size            : 0" in none
    assert reporttext.number(None) == "None" and reporttext.number(1.0) == "1" and reporttext.number(0.25) == "0.25"
    assert reporttext.final([25, 610, 0])[5:] == ["Link-count histogram (0..2):", "   0:    25 ##", "   1:   610 " + "#" * 60, "   2:     0 "]
