"""Command line: build the graph of a vault's reports, print its statistics and, with --apply, write the links.

    python -m kindred.cli --vault-root PATH [--apply]
"""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kindred.config import Settings, resolve
from kindred.functions import frontmatter, text
from kindred.operators import merge, report, reporttext
from kindred.plans.graph import Graph
from kindred.sources import corpus, embeddings, sinks
from kindred.sources.shared import shared_dir, written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred", description=__doc__.splitlines()[0])
    p.add_argument("--apply", action="store_true", help="write changes (default: a dry run, no note is touched)")
    p.add_argument("--limit-embed", type=int, metavar="N", help="embed only the first N reports")
    p.add_argument("--a-veto-cos", type=float, default=0.40, metavar="F", help="embedding cosine that an edge from tags alone needs")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--vault-root", metavar="PATH")
    p.add_argument("--reports-rel", metavar="STR", help="reports folder below the vault")
    p.add_argument("--folders", action="append", default=[], metavar="NAME", help="folder to include (repeatable)")
    p.add_argument("--protected", action="append", default=[], metavar="RELPATH", help="report never to write (repeatable)")
    p.add_argument("--cache-dir", metavar="DIR")
    p.add_argument("--db-path", metavar="PATH", help="folder of Parquet relations, JDBC address or SQLite file")
    p.add_argument("--embed-url", default="https://api.openai.com/v1/embeddings")
    p.add_argument("--embed-model", default="text-embedding-3-small")
    p.add_argument("--requesters", type=int, default=1, metavar="N", help="tasks that send embedding requests at the same time")
    p.add_argument("--version", action="version", version="kindred 0.1")
    return p


def embedded(spark: SparkSession, papers: DataFrame, cfg: Settings, provider: embeddings.Provider | None, limit: int | None, requesters: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """(vectors, figures): vectors from the cache, and for misses from the provider, which are cached call by call."""
    some = papers if limit is None else papers.where(F.col("idx") < limit)
    read = text.extract(some.join(corpus.notes(spark, cfg.reports_dir + "/*/*.md").withColumnRenamed("path", "file_path"), "file_path", "left"), "text")
    inputs = embeddings.hashed_inputs(read.select("idx", text.embed_input(F.col("title"), F.col("body")).alias("input")))
    inputs, hits = written(inputs, "inputs"), Observation()
    cache = embeddings.load_cache(spark, cfg.embed_cache)
    found = embeddings.lookup(inputs, cache).select("idx", "hash", F.col("vec").isNotNull().alias("hit"))
    found = written(found.observe(hits, F.count_if("hit").alias("cache_hits")), "lookup")
    new = inputs.join(found.where("not hit").select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min("input").alias("input"))
    tokens = calls = 0
    if not new.isEmpty():
        if provider is None:
            raise ValueError("some texts aren't in the cache: set OPENAI_API_KEY")
        tokens, calls = embeddings.embed_into(new, provider, cfg.embed_cache, requesters)
        cache = embeddings.load_cache(spark, cfg.embed_cache)
    vecs, have = inputs.select("idx", "hash").join(cache, "hash").select("idx", "vec").where("vec is not null"), Observation()
    vecs = written(vecs.observe(have, F.count("*").alias("embedded")), "note-vectors")
    return vecs, {"tokens": tokens, "calls": calls, "cache_hits": hits.get.get("cache_hits", 0), "embedded": have.get.get("embedded", 0)}


def run(spark: SparkSession, cfg: Settings, provider: embeddings.Provider | None, apply: bool = False, limit: int | None = None, seed: int = 42, say=print, requesters: int = 1) -> DataFrame:
    """The final graph. Prints the report; writes the cache and the edge dump, and the notes if `apply`.

    The report's counts are observed while the steps are written; only percentiles, checks and samples have jobs of their own.
    """
    cfg.ensure_cache_dir()
    if apply:
        sinks.recover_notes(spark, cfg.reports_dir)
    table = lambda name, schema, **more: corpus.read_table(spark, cfg.db_path, name, schema, **more)
    papers = corpus.scan(table("papers", corpus.PAPERS, likes={"file_path": corpus.folder_patterns(cfg)}), cfg)
    papers, size = corpus.live(papers, corpus.listing(spark, cfg.reports_dir + "/*/*.md")), Observation()
    guarded = F.col("relpath").isin(*cfg.protected)
    papers = written(papers.observe(size, F.count("*").alias("n_papers"), F.count_if(guarded).alias("n_protected")), "papers")
    about = {"n_papers": 0, "n_protected": 0} | size.get
    protected, links = report.protected_idx(papers, cfg.protected), corpus.link_targets(papers, cfg.reports_rel)
    vecs, b = embedded(spark, papers, cfg, provider, limit, requesters)
    tags, authors = corpus.corpus_tags(papers, table("tags", corpus.TAGS)), corpus.corpus_authors(papers, table("authors", corpus.AUTHORS))
    g = Graph(tags, authors, vecs, about["n_papers"], cfg.limits, protected=protected)

    decided = {"keep_b_ab": 0, "keep_a": 0, "veto_a": 0, "below_b": 0, "a_edges": 0, "b_edges": 0} | g.figures("decisions")
    a = {"n_terms": 0, "n_weighted": 0, "papers_with_edge": 0} | g.figures("weights") | g.figures("a-edges") | {"total_edges": decided["a_edges"]}
    b |= {"papers_with_edge": 0} | g.figures("b-edges") | {"total_edges": decided["b_edges"]}
    points = {r["kind"]: r for r in report.percentiles(g.a_edges, "A").union(report.percentiles(g.b_edges, "B")).collect()}
    chosen = report.sample(g.writers, seed)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string")))
    lines = report.sample_lines(chosen, papers, g.writers).join(chosen.select("idx", "stratum"), "idx").orderBy("stratum", order, "rank").collect()  # A, B, any: 20 notes
    told = [
        *reporttext.head(apply, about),
        *reporttext.phase_a(a, points["A"]),
        *reporttext.phase_b(b, points["B"]),
        *reporttext.decisions(cfg.limits.a_veto, decided),
        *reporttext.final(g.link_counts(about["n_papers"] - about["n_protected"])),
        *reporttext.checks(report.integrity(g.final, g.writers, links).first().asDict(), b["calls"]),
        *reporttext.samples(lines),
    ]
    for line in told:
        say(line)
    say("\nFigures: " + "  ".join(f"{k}={v}" for k, v in {"batches": b["calls"], "tokens": b["tokens"], "hits": b["cache_hits"], "embedded": b["embedded"]}.items()))
    try:
        sinks.dump_edges(g.decisions, cfg.edge_dump)
    except Exception as e:  # noqa: BLE001  the dump is a courtesy
        say(f"edge dump not written: {e}")
    if apply:
        own = papers.join(protected, "idx", "left_anti")
        texts = own.join(corpus.notes(spark, cfg.reports_dir + "/*/*.md", strict=True).withColumnRenamed("path", "file_path"), "file_path")
        new = frontmatter.rewrite(texts.join(merge.note_targets(own, g.writers, links), "idx"), "text", "targets")
        new = written(new.select("file_path", "new_text", "changed"), "notes")  # all is read before any is written
        there = corpus.listing(spark, cfg.reports_dir + "/*/*.md")
        n = report.apply_counters(papers, protected, there, new).first()
        say(f"files changed: {n['changed']}, protected skipped: {n['protected']}, missing skipped: {n['missing']}")
        sinks.write_notes(new, cfg.reports_dir)
    return g.final


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    cfg = resolve(a.vault_root, a.reports_rel, tuple(a.folders), tuple(a.protected), a.cache_dir, a.db_path, a.a_veto_cos)
    key = os.environ.get("OPENAI_API_KEY")
    provider = embeddings.http_provider(a.embed_url, a.embed_model, key) if key else None
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    if not (a.cache_dir or spark.sparkContext.master.startswith("local")):  # executors share no temporary folder
        cfg = replace(cfg, cache_dir=f"{shared_dir(spark)}/kindred")
    run(spark, cfg, provider, a.apply, a.limit_embed, a.seed, requesters=a.requesters)


if __name__ == "__main__":
    main()
