"""Databases in ranges, the cache's segments, committed embedding calls, and the two phases of writing notes."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from kindred.config import Settings
from kindred.sources import corpus, embeddings, sinks, sqlite


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE papers (id INTEGER, file_path TEXT, title TEXT)")
        c.executemany("INSERT INTO papers VALUES (?, ?, ?)", [(i, f"/v/r/{'AB'[i % 2]}/n{i}.md", None if i % 3 else "it's é") for i in range(200)])
        c.execute("CREATE TABLE tags (paper_id INTEGER, tag TEXT)")
        c.executemany("INSERT INTO tags VALUES (?, ?)", [(1, "x"), (2, None)])
        c.execute("CREATE TABLE authors (paper_id INTEGER PRIMARY KEY, name TEXT) WITHOUT ROWID")
        c.executemany("INSERT INTO authors VALUES (?, ?)", [(1, "a"), (2, None)])
        c.execute("CREATE TABLE none (id INTEGER, file_path TEXT, title TEXT)")
    return path


def test_sqlite_in_ranges(spark, db):
    t = corpus.read_table(spark, db, "papers", corpus.PAPERS, ranges=5)
    assert t.schema == corpus.PAPERS and t.rdd.getNumPartitions() == 5
    got = t.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and {r.part for r in got} == set(range(5))
    assert max(sum(r.part == k for r in got) for k in range(5)) <= 41
    assert {r.title for r in got} == {None, "it's é"}
    plan = t._jdf.queryExecution().toString()
    assert "BatchScan" in plan and "LocalTableScan" not in plan and "ExistingRDD" not in plan  # no row passes the driver
    assert corpus.read_table(spark, db, "authors", corpus.AUTHORS).count() == 2  # no row numbers: one range
    assert corpus.read_table(spark, db, "none", corpus.PAPERS).count() == 0
    with pytest.raises(Exception, match="null in tags.tag"):
        corpus.read_table(spark, db, "tags", corpus.TAGS).collect()
    with pytest.raises(Exception, match="no such table"):
        corpus.read_table(spark, db, "missing", corpus.PAPERS).collect()


def test_filters_reach_sqlite(spark, db):
    t = corpus.read_table(spark, db, "papers", corpus.PAPERS, {"file_path": corpus.folder_patterns(Settings("/v", "R", ("a",)))}, ranges=3)
    assert t.count() == 100  # LIKE takes no account of case
    c = F.col
    for where in (
        c("file_path").startswith("/v/r/A/n1"), c("file_path").endswith("0.md"), c("file_path").contains("n7"), c("id") > 150, c("id").isin(3, 4, 999), c("title") == "it's é",
        c("title").isNull() & (c("id") <= 20), c("title").isNotNull(), c("id").between(5, 9) | (c("id") == 50), ~c("file_path").startswith("/v/r/B"),
    ):
        q = corpus.read_table(spark, db, "papers", corpus.PAPERS, ranges=3).where(where)
        want = spark.createDataFrame(corpus.read_table(spark, db, "papers", corpus.PAPERS).collect(), corpus.PAPERS).where(where)
        assert sorted(q.collect()) == sorted(want.collect())
    q = corpus.scan(corpus.read_table(spark, db, "papers", corpus.PAPERS), Settings("/v", "r", ("A",)))
    assert q.count() == 100
    q = corpus.read_table(spark, db, "papers", corpus.PAPERS).where(c("file_path").startswith("/v/r/") & (c("id") > 3))
    plan = spark._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [StringStartsWith(file_path,/v/r/), GreaterThan(id,3)]" in plan


def test_jdbc_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/derby"
    rows = spark.createDataFrame([(i, f"/v/r/A/n{i}.md", "t") for i in range(40)], corpus.PAPERS)
    rows.write.format("jdbc").options(url=url + ";create=true", dbtable="papers", createTableColumnTypes="file_path VARCHAR(200), title VARCHAR(200)").save()
    t = corpus.read_table(spark, url, "papers", corpus.PAPERS, ranges=4)
    assert t.rdd.getNumPartitions() == 4 and sorted(r["id"] for r in t.collect()) == list(range(40)) and [f.dataType for f in t.schema] == [f.dataType for f in corpus.PAPERS]
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", createTableColumnTypes="file_path VARCHAR(200), title VARCHAR(200)").save()
    assert corpus.read_table(spark, url, "nothing", corpus.PAPERS).count() == 0


def _cache(spark, *hashes):
    return spark.createDataFrame([(h, [1.0]) for h in hashes], embeddings.CACHE)


def _hashes(spark, path):
    return sorted(r["hash"] for r in embeddings.load_cache(spark, path).collect())


def test_cache_grows_by_segments(spark, tmp_path):
    path = str(tmp_path / "cache")
    embeddings.append_cache(_cache(spark, *(f"{i % 16:x}{i}" for i in range(300))), path)
    base = embeddings.segments(spark, path)
    new = _cache(spark, *(f"{i % 16:x}new{i}" for i in range(10)))
    embeddings.append_cache(new, path)
    more = embeddings.segments(spark, path)
    (added,) = set(more) - set(base)
    assert spark.read.parquet(f"{path}/{added}").count() == 10 and {n: more[n] for n in base} == base  # what was there is as it was
    assert len({r.bucket for r in spark.read.parquet(f"{path}/{added}").collect()}) == 10
    assert len(_hashes(spark, path)) == 310
    embeddings.append_cache(spark.createDataFrame([("0new0", [0.5])], embeddings.CACHE), path)  # another run's vector of a known hash
    assert len(_hashes(spark, path)) == 310 and embeddings.load_cache(spark, path).where("hash = '0new0'").first().vec == [0.5]
    small = embeddings.compact_cache(spark, path, most=2)
    assert not set(base) & set(small) and len(small) == 2 and len(embeddings.segments(spark, path)) == 2  # the large one isn't written again
    assert len(_hashes(spark, path)) == 310 and embeddings.compact_cache(spark, path, most=2) == []


def test_compaction_that_breaks_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    for h in "abc":
        embeddings.append_cache(_cache(spark, h), path)
    before = set(embeddings.segments(spark, path))
    real = embeddings._fs

    class NoDelete:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "delete":
                raise OSError("lost")
            return getattr(self.fs, name)

    monkeypatch.setattr(embeddings, "_fs", lambda s, p: (NoDelete(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError, match="lost"):
        embeddings.compact_cache(spark, path, most=1)
    monkeypatch.setattr(embeddings, "_fs", real)
    assert {p.name for p in (tmp_path / "cache").iterdir() if p.name.startswith("segment=")} > before  # merged and still there
    assert len(embeddings.segments(spark, path)) == 1 and _hashes(spark, path) == ["a", "b", "c"]
    (tmp_path / "cache" / ".segment=half").mkdir()  # a segment without its name doesn't count
    assert _hashes(spark, path) == ["a", "b", "c"]


def test_cache_without_segments_goes_on(spark, tmp_path):
    path = str(tmp_path / "cache")
    _cache(spark, "a").write.parquet(path)
    embeddings.append_cache(_cache(spark, "b"), path)
    assert _hashes(spark, path) == ["a", "b"]
    bad = tmp_path / "bad"
    bad.write_bytes(b"no cache")
    embeddings.append_cache(_cache(spark, "c"), str(bad))
    assert _hashes(spark, str(bad)) == ["c"]


def test_only_uncommitted_calls_are_paid_again(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "calls"
    log.write_text("")
    texts = spark.createDataFrame([(f"h{i}", f"t{i}") for i in range(10)], "hash string, input string").repartition(3)

    def provider(ts, log=str(log), fail=3):
        with open(log, "a") as f:
            f.write(f"{len(ts)}\n")
        if sum(1 for _ in open(log)) == fail:
            raise RuntimeError("quota")
        return [[1.0, 0.0]] * len(ts), 7 * len(ts)

    with pytest.raises(Exception, match="quota"):
        embeddings.embed_into(texts, provider, path, batch=2, calls=1)
    assert log.read_text().split() == ["2"] * 3 and len(_hashes(spark, path)) == 4
    todo = embeddings.misses(texts, embeddings.load_cache(spark, path))
    assert embeddings.embed_into(todo, provider, path, batch=2, calls=1) == (42, 3)
    assert len(log.read_text().split()) == 6 and len(_hashes(spark, path)) == 10
    assert embeddings.embed_into(embeddings.misses(texts, embeddings.load_cache(spark, path)), provider, path) == (0, 0)
    part = lambda ts: ([None if t.endswith("1") else [3.0, 4.0] for t in ts], 0)  # noqa: E731  one text has no vector
    assert embeddings.embed_into(texts, part, str(tmp_path / "other"), requesters=2, batch=3, calls=2) == (0, 4)
    assert len(_hashes(spark, str(tmp_path / "other"))) == 9 and embeddings.load_cache(spark, str(tmp_path / "other")).first().vec == [pytest.approx(0.6), pytest.approx(0.8)]


ENDS = ["line\n", "no end", "dos\r\n", "。\n\n", "日本語", "x", "\n", "a ", "😀"]


@pytest.fixture
def vault(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    for i in range(len(ENDS)):
        (folder / f"n{i}.md").write_text(f"old {i}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.notes.link./v", f"file://{folder}")
    return folder


def _new(spark, at):
    return spark.createDataFrame([(f"{at}/n{i}.md", t, i != 5) for i, t in enumerate(ENDS)], "file_path string, new_text string, changed boolean").repartition(3)


@pytest.mark.parametrize("scheme", ["", "viewfs://notes/v"])
def test_notes_in_two_phases(spark, vault, scheme):
    assert sinks.write_notes(_new(spark, scheme or str(vault))) == len(ENDS) - 1
    for i, t in enumerate(ENDS):
        assert (vault / f"n{i}.md").read_bytes() == (b"old 5" if i == 5 else t.encode()), i
    assert {p.name for p in vault.iterdir() if not p.name.endswith(".crc")} == {f"n{i}.md" for i in range(len(ENDS))}
    assert scheme or not [p for p in vault.iterdir() if p.name.endswith(".crc")]
    assert sinks.write_notes(_new(spark, scheme or str(vault)).where("not changed")) == 0


def test_a_failed_task_leaves_all_notes(spark, vault):
    broken = _new(spark, vault).withColumn("new_text", F.when(F.col("file_path").endswith("n7.md"), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("new_text")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_notes(broken)
    assert all((vault / f"n{i}.md").read_text() == f"old {i}" for i in range(len(ENDS))) and len(list(vault.iterdir())) == len(ENDS)


def test_renames_that_break_off_are_finished(spark, vault, monkeypatch):
    real, done = sinks._replace, []

    def breaks(*a):
        if len(done) == 3:
            raise OSError("gone")
        done.append(real(*a))

    monkeypatch.setattr(sinks, "_replace", breaks)
    with pytest.raises(OSError, match="gone"):
        sinks.write_notes(_new(spark, vault))
    monkeypatch.setattr(sinks, "_replace", real)
    (vault / f"{sinks.STAGE}half").mkdir()  # staging that never ended
    assert sinks.recover_notes(spark, str(vault)) == len(ENDS) - 1 - 3
    assert [(vault / f"n{i}.md").read_bytes() for i in range(len(ENDS)) if i != 5] == [t.encode() for i, t in enumerate(ENDS) if i != 5]
    assert len(list(vault.iterdir())) == len(ENDS) and sinks.recover_notes(spark, str(vault / "none")) == 0


def test_cache_folder_on_a_cluster(spark, tmp_path, monkeypatch):
    from kindred import cli, config

    seen = []
    monkeypatch.setattr(cli, "run", lambda spark, cfg, *a, **k: seen.append(cfg.cache_dir))
    flags = ["--vault-root", str(tmp_path), "--db-path", str(tmp_path)]
    cli.main(flags)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    cli.main(flags)
    cli.main([*flags, "--cache-dir", "/given"])
    assert seen == [config.resolve(str(tmp_path), db_path=str(tmp_path)).cache_dir, spark.conf.get("spark.checkpoint.dir") + "/kindred", "/given"]
    config.Settings("/v", cache_dir="hdfs://h/c").ensure_cache_dir()
