"""The run's report as text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from kindred.operators.report import POINTS

BAR = "=" * 72


def number(x: float | None) -> str:
    """A number without needless places; None for none."""
    return "None" if x is None else repr(x).removesuffix(".0")


def _percentiles(row: Mapping | None) -> str:
    return " ".join(f"p{p}={number(row[f'p{p}'] if row else None)}" for p in POINTS)


# The layout of the report.
def head(apply: bool, corpus: Mapping) -> list[str]:
    return [BAR, "[APPLY]" if apply else "[DRY-RUN]", f"Corpus size            : {corpus['n_papers']}", f"Protected (skip-write) : {corpus['n_protected']}", BAR]


def phase_a(stats: Mapping, points: Mapping | None) -> list[str]:
    return [
        "",
        "--- Phase A (IDF-weighted tag/author cosine) ---",
        f"Distinct terms              : {stats['n_terms']} (nonzero idf: {stats['n_weighted']})",
        f"Papers with >=1 A-edge      : {stats['papers_with_edge']}",
        f"Total A-edges (undirected)  : {stats['total_edges']}",
        f"A edge-weight percentiles   : {_percentiles(points)}",
    ]


def phase_b(stats: Mapping, points: Mapping | None) -> list[str]:
    return [
        "",
        "--- Phase B (OpenAI embedding cosine) ---",
        f"Embedding batches/API calls : {stats['calls']} / {stats['calls']} (cache hits: {stats['cache_hits']})",
        f"Papers embedded             : {stats['embedded']}",
        f"Papers with >=1 B-edge      : {stats['papers_with_edge']}",
        f"Total B-edges (undirected)  : {stats['total_edges']}",
        f"B cosine percentiles        : {_percentiles(points)}",
        f"API tokens (reported)       : {stats['tokens']}",
    ]


def decisions(floor: float, stats: Mapping) -> list[str]:
    return [
        "",
        f"--- Merge edge decisions (B-veto, floor={number(floor)}) ---",
        f"  keep (B/AB)         : {stats['keep_b_ab']}",
        f"  keep (A-veto pass)  : {stats['keep_a']}",
        f"  veto-A (tag-only)   : {stats['veto_a']}",
        f"  below-B (B cand)    : {stats['below_b']}",
    ]


def final(notes: list[int]) -> list[str]:
    """`notes` are the writable notes with 0, 1, ... links; more links than bins count in the last one."""
    writable = sum(notes)
    bars = [f"  {k:2}: {n:5} {'#' * min(n // 10, 60)}" for k, n in enumerate(notes)]
    return [
        "",
        "--- Final merged graph (writers only; protected excluded) ---",
        f"Writable reports            : {writable}",
        f"Will get >=1 link           : {writable - notes[0]}",
        f"Stay empty (related: [])    : {notes[0]}",
        f"Link-count histogram (0..{len(notes) - 1}):",
        *bars,
    ]


def checks(stats: Mapping, calls: int) -> list[str]:
    return [
        f"Asymmetric edges (must be 0): {stats['asymmetric']}",
        f"Dead targets (must be 0)    : {stats['dead']}",
        f"Self-links (must be 0)      : {stats['self_links']}",
        "",
        f"TOTAL embedding API calls   : {calls}",
    ]


def samples(rows: Iterable[Mapping]) -> list[str]:
    """Rows of sample_lines() in the order of the notes chosen and their ranks."""
    out, last = ["", BAR, "20 RANDOM SAMPLE PAPERS (title -> related [target | weight | src])", BAR], None
    for r in rows:
        if r["idx"] != last:
            out += ["", f"[{r['folder']}] {r['title']}"]
            last = r["idx"]
        out.append(f"   ({r['src']:2} {r['weight']})  {r['nbr_title']}")
    return out
