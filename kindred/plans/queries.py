"""Every operator as a query over the test tables, and its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import FOLDERS, REPORTS_REL
from kindred.functions import frontmatter, text
from kindred.functions.scalars import round4
from kindred.operators import merge, report, terms, vectors
from kindred.plans.fixtures import ALL_FOLDERS, PROFILE, PROTECTED_IDS, Fixture
from kindred.plans.graph import Graph
from kindred.sources import corpus, embeddings, sinks
from kindred.sources.shared import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WS = text.WS
_LIST = "[" + ", ".join(f"'{f}'" for f in ALL_FOLDERS) + "]"
_NAMES = ", ".join(f"'{f}'" for f in FOLDERS)
_A, _B, _V, _K, _CAP, _DF = PROFILE.a_min, PROFILE.b_min, PROFILE.a_veto, PROFILE.top_k, PROFILE.cap, PROFILE.a_specific_df

#: Relations that the twins share; DuckDB computes those a twin mentions.
PRELUDE = f"""
WITH size AS (SELECT max(doc_id) + 1 AS n, count(*) AS c, (max(doc_id) + 1) * 4 // 5 + 1 AS names FROM documents),
papers AS (
  SELECT doc_id AS id, '/v/{REPORTS_REL}/' || {_LIST}[doc_id % 4 + 1] || '/' || CASE WHEN doc_id % 13 = 0 THEN 'nested/' ELSE '' END
         || CASE WHEN doc_id % 11 = 0 THEN '_' ELSE '' END || 'doc_' || (doc_id % names) || '.md' AS file_path,
         CASE WHEN doc_id % 23 <> 0 THEN split_part(text, '.', 1) END AS title
  FROM documents, size),
parts AS (SELECT id, file_path, coalesce(title, '') AS title, string_split(substr(file_path, length('/v/{REPORTS_REL}/') + 1), '/') AS p FROM papers),
corpus AS (
  SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, file_path, p[1] || '/' || p[2] AS relpath, p[1] AS folder, p[2] AS basename, title
  FROM parts WHERE len(p) = 2 AND p[1] IN ({_NAMES}) AND p[2] NOT LIKE '\\_%' ESCAPE '\\' AND p[2] LIKE '%.md'),
everything AS (
  SELECT doc_id AS idx, {_LIST}[doc_id % 4 + 1] AS folder, 'doc_' || (doc_id % names) AS stem, split_part(text, '.', 1) AS title FROM documents, size),
listing AS (SELECT DISTINCT file_path AS path FROM papers WHERE id % 17 <> 0),
tags AS (
  SELECT doc_id AS paper_id, 'Venue/' || source AS tag FROM documents
  UNION ALL SELECT doc_id, 'FoS/Primary/' || lang FROM documents UNION ALL SELECT doc_id, 'Lang/' || lang FROM documents
  UNION ALL SELECT doc_id, 'Year/2024' FROM documents UNION ALL SELECT doc_id, '学術論文' FROM documents
  UNION ALL SELECT vec_id, 'Method/topic_' || label FROM embeddings, size WHERE vec_id < n
  UNION ALL SELECT doc_id, 'Concept/' || w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents) WHERE length(w) >= 8),
authors AS (SELECT event_id % n AS paper_id, 'user_' || user_id AS name FROM events, size WHERE event_type = 'purchase'),
terms AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT paper_id AS idx, tag AS term FROM tags WHERE regexp_matches(tag, '^(Survey|Method|Concept|Dataset|FoS/Primary|FoS/Second|FoS/Secondary|Venue)/') AND paper_id IN (SELECT doc_id FROM documents)
    UNION ALL SELECT paper_id, 'author::' || name FROM authors WHERE paper_id IN (SELECT doc_id FROM documents))),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
w AS MATERIALIZED (SELECT idx, term, df, ln(c::DOUBLE / df) AS w FROM terms JOIN dfs USING (term), size WHERE ln(c::DOUBLE / df) > 0),
norms AS MATERIALIZED (SELECT idx, sqrt(sum(w * w)) AS norm FROM w GROUP BY idx),
met AS MATERIALIZED (SELECT DISTINCT a.idx AS i, b.idx AS j FROM w a JOIN w b ON a.term = b.term AND a.idx < b.idx WHERE a.df <= {_DF}),
dots AS MATERIALIZED (SELECT i, j, sum(a.w * b.w) AS dot FROM met JOIN w a ON a.idx = i JOIN w b ON b.idx = j AND a.term = b.term GROUP BY i, j),
cand AS MATERIALIZED (SELECT i, j, dot / (x.norm * y.norm) AS cos FROM dots JOIN norms x ON x.idx = i JOIN norms y ON y.idx = j WHERE dot / (x.norm * y.norm) >= {_A}),
adir AS MATERIALIZED (
  SELECT src, dst, cos FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(cos, 9) DESC, dst) AS r
    FROM (SELECT i AS src, j AS dst, cos FROM cand UNION ALL SELECT j, i, cos FROM cand)) WHERE r <= {_K}),
apairs AS MATERIALIZED (SELECT least(src, dst) AS i, greatest(src, dst) AS j, max(cos) AS cos FROM adir GROUP BY 1, 2),
raw AS (SELECT vec_id AS idx, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
vecs AS MATERIALIZED (SELECT idx, list_transform(e, lambda x: (x::DOUBLE / norm)::FLOAT::DOUBLE) AS v FROM raw),
cosines AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, list_dot_product(a.v, b.v)::FLOAT AS cos FROM vecs a JOIN vecs b ON a.idx < b.idx),
bcand AS MATERIALIZED (SELECT * FROM cosines WHERE cos >= {_B}::FLOAT),
bdir AS MATERIALIZED (
  SELECT src, dst, cos FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS r
    FROM (SELECT i AS src, j AS dst, cos FROM bcand UNION ALL SELECT j, i, cos FROM bcand)) WHERE r <= {_K}),
bpairs AS MATERIALIZED (SELECT least(src, dst) AS i, greatest(src, dst) AS j, max(cos) AS cos FROM bdir GROUP BY 1, 2),
pairs AS MATERIALIZED (
  SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, a.cos AS a_cos, a.i IS NOT NULL AS is_a, b.i IS NOT NULL AS is_b
  FROM apairs a FULL JOIN bpairs b ON a.i = b.i AND a.j = b.j),
decisions AS MATERIALIZED (
  SELECT *, CASE WHEN emb_cos IS NULL THEN 'drop-no-vec' WHEN emb_cos >= {_B}::FLOAT OR is_a AND emb_cos::DOUBLE >= {_V} THEN 'keep' WHEN is_a THEN 'veto-A' ELSE 'below-B' END AS decision,
         CASE WHEN emb_cos IS NULL THEN NULL WHEN emb_cos >= {_B}::FLOAT THEN CASE WHEN is_a THEN 'AB' ELSE 'B' END WHEN is_a AND emb_cos::DOUBLE >= {_V} THEN 'A' END AS src
  FROM (SELECT pairs.*, cosines.cos AS emb_cos FROM pairs LEFT JOIN cosines ON pairs.i = cosines.i AND pairs.j = cosines.j)),
kept AS MATERIALIZED (SELECT i, j, emb_cos AS w, src FROM decisions WHERE src IS NOT NULL),
ranked1 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, i, j) AS r FROM (SELECT i AS node, * FROM kept UNION ALL SELECT j, * FROM kept)),
top AS MATERIALIZED (SELECT DISTINCT i, j, w, src FROM ranked1 WHERE r <= {_K}),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, i, j) AS r FROM (SELECT i AS node, * FROM top UNION ALL SELECT j, * FROM top)),
capped AS MATERIALIZED (SELECT i, j, w, src FROM ranked2 WHERE r <= {_CAP} GROUP BY ALL HAVING count(*) = 2),
final AS MATERIALIZED (
  SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY w DESC, nbr) AS rank, nbr, w, src
  FROM (SELECT i AS idx, j AS nbr, w, src FROM capped UNION ALL SELECT j, i, w, src FROM capped)),
protected AS (SELECT doc_id AS idx FROM documents WHERE doc_id % 19 = 0),
writers AS (SELECT * FROM final WHERE idx NOT IN (SELECT idx FROM protected)),
targets AS (SELECT idx, CASE WHEN count(*) OVER (PARTITION BY stem) = 1 THEN stem ELSE '{REPORTS_REL}/' || folder || '/' || stem END AS target FROM everything),
degrees AS (SELECT idx, coalesce(d, 0) AS degree FROM everything LEFT JOIN (SELECT idx, count(*) AS d FROM writers GROUP BY idx) USING (idx) WHERE idx NOT IN (SELECT idx FROM protected)),
strata AS (SELECT idx, bool_or(src IN ('A', 'AB')) AS a_driven, bool_or(src = 'B') AS b_driven, md5('42:' || idx) AS k FROM writers GROUP BY idx),
pick_a AS (SELECT idx FROM strata WHERE a_driven ORDER BY k LIMIT 8),
pick_b AS (SELECT idx FROM strata WHERE b_driven AND idx NOT IN (SELECT idx FROM pick_a) ORDER BY k LIMIT 8),
pick AS (
  SELECT idx, 'A' AS stratum FROM pick_a UNION ALL SELECT idx, 'B' FROM pick_b UNION ALL
  SELECT idx, 'any' FROM (SELECT idx, row_number() OVER (ORDER BY k) AS r FROM strata WHERE idx NOT IN (SELECT idx FROM pick_a UNION ALL SELECT idx FROM pick_b))
  WHERE r <= 20 - (SELECT count(*) FROM pick_a) - (SELECT count(*) FROM pick_b)),
notes AS (
  SELECT doc_id AS idx, split_part(text, '.', 1) AS title,
    CASE doc_id % 6 WHEN 0 THEN '' WHEN 5 THEN E'---\\ntitle: open\\n' ELSE
      fence || E'title: t\\n' || CASE doc_id % 6 WHEN 1 THEN E'related-documents: []\\n' WHEN 2 THEN E'related-documents:\\n  - "[[Old one]]"\\n  - "[[Old two]]"\\n' ELSE '' END || E'tags:\\n  - a\\n' || fence END
    || CASE WHEN doc_id % 2 = 0 THEN E'# Title\\n\\n## 2. 要約\\n> [!note] head\\n> ' || text || E'　with [[a link|x]] and ![[image]]\\n<!-- two\\nlines --> tail\\n### more\\nend\\n## 3. Next\\nnot this' ELSE text END AS text
  FROM (SELECT *, CASE WHEN doc_id % 6 = 4 THEN E'---\\r\\n' ELSE E'---\\n' END AS fence FROM documents)),
lined AS (SELECT *, string_split(text, chr(10)) AS l, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g') = '---') AS f FROM notes),
fronted AS (SELECT *, CASE WHEN f[1] THEN coalesce(list_min(list_filter(range(2, len(l) + 1), lambda i: f[i])), 0) ELSE 0 END AS e FROM lined),
bodied AS (SELECT *, l[e + 1:] AS b FROM fronted),
headed AS (SELECT *, coalesce(list_min(list_filter(range(1, len(b) + 1), lambda i: regexp_matches(b[i], '^##{_WS}*(?:2\\.{_WS}*)?要約{_WS}*$'))), 0) AS h FROM bodied),
cut AS (SELECT *, CASE WHEN h > 0 THEN b[h + 1:] ELSE b END AS s FROM headed),
cut2 AS (SELECT *, CASE WHEN h > 0 THEN s[1:coalesce(list_min(list_filter(range(1, len(s) + 1), lambda i: regexp_matches(s[i], '^##{_WS}'))), len(s) + 1) - 1] ELSE s END AS s2 FROM cut),
cleaned AS (
  SELECT *, regexp_replace(regexp_replace(array_to_string(list_transform(
      list_filter(string_split(regexp_replace(array_to_string(s2, chr(10)), '(?s)<!--.*?-->', ' ', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^{_WS}*>{_WS}*\\[![^\\n]*?\\]')),
      lambda x: regexp_replace(regexp_replace(x, '^{_WS}*>{_WS}?', ''), '!?\\[\\[[^\\n]*?\\]\\]', ' ', 'g')), ' '), '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS c FROM cut2),
bodies AS (SELECT idx, title, CASE WHEN h > 0 THEN c ELSE substring(c, 1, 1500) END AS body FROM cleaned),
inputs AS (SELECT idx, substring(regexp_replace(title || chr(10) || body, '^{_WS}+|{_WS}+$', '', 'g'), 1, 2000) AS input FROM bodies),
hashed AS (SELECT idx, input, sha256(CASE WHEN input = '' THEN ' ' ELSE input END) AS hash FROM inputs),
cached AS (SELECT DISTINCT hash FROM hashed WHERE idx % 3 = 0),
linked AS (SELECT idx, list(target ORDER BY rank) AS ts FROM (SELECT w.idx, w.rank, t.target FROM writers w JOIN targets t ON t.idx = w.nbr) GROUP BY idx),
blocks AS (
  SELECT f.idx, f.text, f.l, f.e, CASE WHEN ts IS NULL THEN ['related-documents: []'] ELSE list_concat(['related-documents:'], list_transform(ts, lambda x: '  - "[[' || x || ']]"')) END AS blk
  FROM fronted f LEFT JOIN linked USING (idx) WHERE f.idx NOT IN (SELECT idx FROM protected)),
marked AS (
  SELECT *, list_transform(l[2:e - 1], lambda x: regexp_matches(x, '^related-documents:{_WS}*(\\[{_WS}*\\])?{_WS}*$')) AS key,
         list_transform(l[2:e - 1], lambda x: regexp_matches(x, '^{_WS}+-{_WS}')) AS item FROM blocks),
spelt AS (
  SELECT *, flatten(list_transform(range(1, len(key) + 1), lambda i: CASE WHEN key[i] THEN blk
      WHEN item[i] AND coalesce(key[list_max(list_filter(range(1, i), lambda j: NOT item[j]))], false) THEN [] ELSE [l[i + 1]] END)) AS o FROM marked),
rewritten AS (
  SELECT idx, text, CASE WHEN e > 0 THEN array_to_string(list_concat(['---'], o, CASE WHEN list_contains(key, true) THEN [] ELSE blk END, ['---'], l[e + 1:]), chr(10)) ELSE text END AS new_text FROM spelt)
"""


def _again(*steps: str) -> str:
    """The named relations of PRELUDE once more, over what the last of them gave."""
    parts = re.split(r"^(\w+) AS (?:MATERIALIZED )?\(", PRELUDE.strip().removesuffix(")"), flags=re.M)
    body = dict(zip(parts[1::2], parts[2::2]))
    out = []
    for name in steps:
        sql = re.sub(rf"\b({'|'.join(steps)})\b", r"\1_2", body[name].rstrip().rstrip(",").removesuffix(")"))
        out.append(f"{name}_2 AS ({sql.replace('FROM notes', f'FROM (SELECT idx, new_text AS text FROM {steps[-1]})')})")
    return "WITH " + ", ".join(out)


def query(sql: str | None):
    def add(f: Callable[[Fixture], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = PRELUDE + sql
        return f

    return add


def graph(x: Fixture) -> Graph:
    """One for each query, so that its steps share what is persisted."""
    if "graph" not in x.__dict__:
        x.graph = _graph(x)
    return x.graph


def _graph(x: Fixture) -> Graph:
    all_papers = x.everything
    return Graph(corpus.corpus_tags(all_papers, x.tags), corpus.corpus_authors(all_papers, x.authors), x.vectors, x.size, PROFILE)


def protected(x: Fixture) -> DataFrame:
    return x.everything.where("idx % 19 = 0").select("idx")


def writers(x: Fixture) -> DataFrame:
    return report.writer_graph(graph(x).final, protected(x))


def targets(x: Fixture) -> DataFrame:
    return corpus.link_targets(x.everything, REPORTS_REL)


def inputs(x: Fixture) -> DataFrame:
    n = text.extract(x.notes.join(x.everything.select("idx", "title"), "idx"), "text")
    return embeddings.hashed_inputs(n.select("idx", text.embed_input(F.col("title"), F.col("body")).alias("input")))


def cache(x: Fixture) -> DataFrame:
    return inputs(x).where("idx % 3 = 0").select("hash", F.array(F.lit(1.0).cast("float")).alias("vec")).distinct()


def rewritten(x: Fixture) -> DataFrame:
    own = x.everything.join(protected(x), "idx", "left_anti")
    t = merge.note_targets(own, writers(x), targets(x))
    return frontmatter.rewrite(x.notes.join(t, "idx"), "text", "targets")


@query("SELECT * FROM corpus")
def corpus_scan(x):
    return corpus.scan(x.papers, x.settings)


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, relpath FROM corpus WHERE file_path IN (SELECT path FROM listing)")
def corpus_live(x):
    return corpus.live(corpus.scan(x.papers, x.settings), x.listing).select("idx", "id", "relpath")


@query("SELECT DISTINCT idx, tag FROM corpus JOIN tags ON id = paper_id")
def corpus_tags(x):
    return corpus.corpus_tags(corpus.scan(x.papers, x.settings), x.tags)


@query("SELECT DISTINCT idx, name FROM corpus JOIN authors ON id = paper_id")
def corpus_authors(x):
    return corpus.corpus_authors(corpus.scan(x.papers, x.settings), x.authors)


@query(f"SELECT idx, CASE WHEN count(*) OVER (PARTITION BY basename) = 1 THEN stem ELSE '{REPORTS_REL}/' || folder || '/' || stem END AS target FROM (SELECT *, left(basename, length(basename) - 3) AS stem FROM corpus)")
def link_targets(x):
    return corpus.link_targets(corpus.scan(x.papers, x.settings), REPORTS_REL)


@query(f"SELECT idx FROM corpus WHERE relpath IN (SELECT {_LIST}[i % 4 + 1] || '/doc_' || (i % names) || '.md' FROM (SELECT unnest({list(PROTECTED_IDS)}) AS i), size)")
def protected_idx(x):
    return report.protected_idx(corpus.scan(x.papers, x.settings), x.settings.protected)


@query(f"SELECT count(*) AS n_papers, count_if(relpath IN (SELECT {_LIST}[i % 4 + 1] || '/doc_' || (i % names) || '.md' FROM (SELECT unnest({list(PROTECTED_IDS)}) AS i), size)) AS n_protected FROM corpus")
def report_corpus(x):
    return report.corpus_stats(corpus.scan(x.papers, x.settings), x.settings.protected)


@query("SELECT DISTINCT tag, regexp_matches(tag, '^(Survey|Method|Concept|Dataset|FoS/Primary|FoS/Second|FoS/Secondary|Venue)/') AS keep FROM tags")
def keep_tag(x):
    return x.tags.select("tag", terms.keep_tag(F.col("tag")).alias("keep")).distinct()


@query("SELECT * FROM terms")
def doc_terms(x):
    return graph(x).terms


@query("SELECT * FROM dfs")
def term_df(x):
    return terms.term_df(graph(x).terms)


@query("SELECT idx, term, df, round(w * 10000) / 10000 AS w FROM w")
def term_weights(x):
    return terms.term_weights(graph(x).terms, x.size).withColumn("w", round4(F.col("w")))


@query("SELECT idx, round(norm * 10000) / 10000 AS norm FROM norms")
def doc_norms(x):
    return terms.doc_norms(graph(x).weights).withColumn("norm", round4(F.col("norm")))


@query("SELECT i, j, round(dot * 10000) / 10000 AS dot FROM dots")
def a_pair_dots(x):
    return terms.pair_dots(graph(x).weights, PROFILE).withColumn("dot", round4(F.col("dot")))


@query("SELECT i, j, round(cos * 10000) / 10000 AS cos FROM cand")
def a_candidates(x):
    return terms.candidates(graph(x).weights, PROFILE).withColumn("cos", round4(F.col("cos")))


@query("SELECT src, dst, round(cos * 10000) / 10000 AS cos FROM adir")
def a_edges(x):
    return graph(x).a_edges.withColumn("cos", round4(F.col("cos")))


@query("SELECT i, j, round(cos * 10000) / 10000 AS cos FROM apairs")
def a_pairs(x):
    return terms.undirected(graph(x).a_edges).withColumn("cos", round4(F.col("cos")))


@query("SELECT (SELECT count(DISTINCT term) FROM terms) AS n_terms, (SELECT count(DISTINCT term) FROM w) AS n_weighted, (SELECT count(DISTINCT src) FROM adir) AS papers_with_edge, (SELECT count(*) FROM apairs) AS total_edges")
def report_phase_a(x):
    g = graph(x)
    return report.phase_a_stats(g.terms, g.weights, g.a_edges)


@query("SELECT i, j, round(cos::DOUBLE * 10000) / 10000 AS cos FROM cosines WHERE cos >= 0.05::FLOAT")
def b_pairs_cos(x):
    return vectors.pair_cosines(x.vectors, 0.05).withColumn("cos", round4(F.col("cos")))


@query("SELECT src, dst, round(cos::DOUBLE * 10000) / 10000 AS cos FROM bdir")
def b_edges(x):
    return graph(x).b_edges.withColumn("cos", round4(F.col("cos")))


@query(f"""SELECT src, dst, round(cos::DOUBLE * 10000) / 10000 AS cos FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY cos DESC, dst) AS r
    FROM (SELECT i AS src, j AS dst, cos FROM bcand WHERE j < 100 UNION ALL SELECT j, i, cos FROM bcand WHERE j < 100)) WHERE r <= {_K}""")
def limit_embed(x):
    return vectors.b_edges(x.vectors, PROFILE, limit=100).withColumn("cos", round4(F.col("cos")))


@query("SELECT i, j, round(a_cos * 10000) / 10000 AS a_cos, is_a, is_b FROM pairs")
def merge_candidates(x):
    return graph(x).pairs.drop("b_cos").withColumn("a_cos", round4(F.col("a_cos")))


_DECISION = "i, j, round(a_cos * 10000) / 10000 AS a_cos, round(emb_cos::DOUBLE * 10000) / 10000 AS emb_cos, is_a, is_b, decision, src"


@query(f"SELECT {_DECISION} FROM decisions")
def merge_decisions(x):
    return graph(x).decisions.withColumns({"a_cos": round4(F.col("a_cos")), "emb_cos": round4(F.col("emb_cos"))})


@query("""SELECT i, j, '{"i":' || i || ',"j":' || j || ',"is_a":' || is_a || ',"is_b":' || is_b || ',"decision":"' || decision || '","src":' || coalesce('"' || src || '"', 'null') || '}' AS json FROM decisions""")
def edge_dump(x):
    return graph(x).decisions.select("i", "j", F.to_json(F.struct("i", "j", "is_a", "is_b", "decision", "src"), {"ignoreNullFields": "false"}).alias("json"))


def _json_number(x: str) -> str:
    """A double of four places as JSON: Java spells those below 0.001 with an exponent, and what rounds to zero has no sign."""
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN abs({x}) BETWEEN 0.00005 AND 0.00095 THEN (round({x} * 10000)::INT)::VARCHAR || '.0E-4' ELSE ({x} + 0)::VARCHAR END"


@query(
    f"""SELECT i, j, '{{"i":' || i || ',"j":' || j || ',"a_cos":' || {_json_number("a_cos")} || ',"emb_cos":' || {_json_number("emb_cos")} || ',"is_a":' || is_a || ',"is_b":' || is_b
    || ',"decision":"' || decision || '","src":' || coalesce('"' || src || '"', 'null') || '}}' AS json FROM (SELECT {_DECISION} FROM decisions)"""
)
def edge_dump_lines(x):
    return sinks.edge_json(merge_decisions(x))


@query("SELECT count_if(src IN ('B', 'AB')) AS keep_b_ab, count_if(src = 'A') AS keep_a, count_if(decision = 'veto-A') AS veto_a, count_if(decision = 'below-B') AS below_b FROM decisions")
def report_decisions(x):
    return report.decision_stats(graph(x).decisions)


@query("SELECT i, j, round(w::DOUBLE * 10000) / 10000 AS w, src FROM top")
def merge_topk(x):
    return graph(x).top.withColumn("w", round4(F.col("w")))


@query("SELECT i, j, round(w::DOUBLE * 10000) / 10000 AS w, src FROM capped")
def merge_capped(x):
    return graph(x).capped.withColumn("w", round4(F.col("w")))


@query("SELECT idx, rank, nbr, round(w::DOUBLE * 10000) / 10000 AS w, src FROM final")
def final_graph(x):
    return graph(x).final.withColumn("w", round4(F.col("w")))


@query("SELECT idx, rank, nbr, src FROM writers")
def writer_graph(x):
    return writers(x).select("idx", "rank", "nbr", "src")


_P = ", ".join(f"round(quantile_cont(cos::DOUBLE, {p / 100}) * 10000) / 10000 AS p{p}" for p in report.POINTS)


@query(f"SELECT 'A' AS kind, {_P} FROM apairs UNION ALL SELECT 'B', {_P} FROM bpairs")
def report_percentiles(x):
    g = graph(x)
    return report.percentiles(g.a_edges, "A").union(report.percentiles(g.b_edges, "B"))


@query("SELECT links, coalesce(n, 0)::BIGINT AS notes, repeat('#', least(coalesce(n, 0) // 10, 60)::INT) AS bar FROM (SELECT unnest(range(11)) AS links) LEFT JOIN (SELECT least(degree, 10) AS links, count(*) AS n FROM degrees GROUP BY 1) USING (links)")
def degree_histogram(x):
    return report.histogram(report.degrees(x.everything, writers(x), protected(x)), PROFILE.cap)


@query("SELECT count(*) AS writable, count_if(degree > 0) AS with_link, count_if(degree = 0) AS empty FROM degrees")
def report_final(x):
    return report.final_stats(report.degrees(x.everything, writers(x), protected(x)))


@query("SELECT i AS idx, j AS nbr FROM capped WHERE (i + j) % 7 = 0 UNION ALL SELECT f.idx, f.nbr FROM final f WHERE false")
def check_asymmetric(x):
    """One direction of some edges is taken out, so that the check has something to find."""
    g = graph(x).final
    return report.asymmetric(g.where("not (idx > nbr and (idx + nbr) % 7 = 0)"))


@query("SELECT idx, nbr FROM writers WHERE nbr % 5 = 0")
def check_dead_targets(x):
    """Some targets are taken out, so that the check has something to find."""
    return report.dead_targets(writers(x), targets(x).where("idx % 5 <> 0"))


@query("""SELECT (SELECT count(*) FROM final a WHERE NOT EXISTS (SELECT 1 FROM final b WHERE b.idx = a.nbr AND b.nbr = a.idx)) AS asymmetric,
    (SELECT count(*) FROM writers w WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.idx = w.nbr)) AS dead, (SELECT count_if(idx = nbr)::BIGINT FROM writers) AS self_links""")
def integrity_checks(x):
    return report.integrity(graph(x).final, writers(x), targets(x))


@query("SELECT * FROM pick")
def sample_strata(x):
    return report.sample(writers(x))


@query("SELECT w.idx, e.folder, substring(e.title, 1, 90) AS title, w.rank, w.src, format('{:.3f}', w.w::DOUBLE) AS weight, substring(t.title, 1, 80) AS nbr_title FROM pick JOIN writers w USING (idx) JOIN everything e USING (idx) JOIN everything t ON t.idx = w.nbr")
def sample_report(x):
    w = writers(x)
    return report.sample_lines(report.sample(w), x.everything, w)


@query("SELECT idx, body FROM bodies")
def extract_embed_text(x):
    return text.extract(x.notes, "text").select("idx", "body")


@query("SELECT idx, input, hash FROM hashed")
def embed_inputs(x):
    return inputs(x).select("idx", "input", "hash")


@query("SELECT idx, hash, hash IN (SELECT hash FROM cached) AS hit FROM hashed")
def embed_cache_lookup(x):
    return embeddings.lookup(inputs(x), cache(x)).select("idx", "hash", F.col("vec").isNotNull().alias("hit"))


@query("SELECT hash, min(input) AS input FROM hashed WHERE hash NOT IN (SELECT hash FROM cached) GROUP BY hash")
def embed_cache_misses(x):
    return embeddings.misses(inputs(x), cache(x))


@query("SELECT (row_number() OVER (ORDER BY hash) - 1) // 96 AS batch, hash FROM (SELECT DISTINCT hash FROM hashed WHERE hash NOT IN (SELECT hash FROM cached))")
def embed_batches(x):
    m = numbered(embeddings.misses(inputs(x), cache(x)).select("hash"), "hash", "n")
    return m.select(F.floor(F.col("n") / embeddings.BATCH).alias("batch"), "hash")


@query("SELECT count_if(hit) AS cache_hits, ceil(count(DISTINCT CASE WHEN NOT hit THEN hash END) / 96)::BIGINT AS batches, 0::BIGINT AS tokens, (SELECT count(DISTINCT src) FROM bdir) AS papers_with_edge, (SELECT count(*) FROM bpairs) AS total_edges FROM (SELECT hash, hash IN (SELECT hash FROM cached) AS hit FROM hashed)")
def report_phase_b(x):
    return report.phase_b_stats(embeddings.lookup(inputs(x), cache(x)), graph(x).b_edges)


@query("SELECT idx, array_to_string(coalesce(ts, []), '|') AS targets FROM everything LEFT JOIN linked USING (idx) WHERE idx NOT IN (SELECT idx FROM protected)")
def note_targets(x):
    own = x.everything.join(protected(x), "idx", "left_anti")
    return merge.note_targets(own, writers(x), targets(x)).select("idx", F.array_join("targets", "|").alias("targets"))


@query("SELECT idx, array_to_string(blk, chr(10)) AS block FROM blocks")
def related_block(x):
    own = x.everything.join(protected(x), "idx", "left_anti")
    t = merge.note_targets(own, writers(x), targets(x))
    return t.select("idx", F.array_join(frontmatter.block(F.col("targets")), "\n").alias("block"))


@query("SELECT idx, new_text, new_text <> text AS changed FROM rewritten")
def frontmatter_rewrite(x):
    return rewritten(x).select("idx", "new_text", "changed")


@query(f"SELECT idx, new_text <> text AS changed FROM ({_again('lined', 'fronted', 'blocks', 'marked', 'spelt', 'rewritten')} SELECT * FROM rewritten_2)")
def frontmatter_idempotent(x):
    once = rewritten(x).select("idx", F.col("new_text").alias("text"), "targets")
    return frontmatter.rewrite(once, "text", "targets").select("idx", "changed")


@query("SELECT count_if(idx NOT IN (SELECT idx FROM protected) AND idx % 17 <> 0 AND idx IN (SELECT idx FROM rewritten WHERE new_text <> text)) AS changed, count_if(idx IN (SELECT idx FROM protected)) AS protected, count_if(idx NOT IN (SELECT idx FROM protected) AND idx % 17 = 0) AS missing FROM everything")
def apply_counters(x):
    there = x.everything.where("idx % 17 <> 0").select(F.col("file_path").alias("path"))
    done = rewritten(x).join(x.everything.select("idx", "file_path"), "idx")
    return report.apply_counters(x.everything, protected(x), there, done)
