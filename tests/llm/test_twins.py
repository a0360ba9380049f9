"""The corpus operators' DuckDB twins."""

from collections import Counter

import duckdb

from kindred.llm import queries, warc


def test_twins_are_sql_that_runs():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        assert isinstance(sql, str) and con.execute(sql).fetchall(), name


def test_warc_twin(spark, tmp_path):
    rows = [(1, "a" * 100), (2, "a" * 100), (3, "b" * 99), (4, "b" * 99), (5, None), (None, "a" * 100), (None, "c" * 300), (None, "c" * 300), (9, "é" * 50), (7, "é" * 50), (7, "é" * 50)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = Counter(con.execute(warc.ORACLE).fetchall())
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert Counter(map(tuple, queries.QUERIES["op3_warc"](spark, str(tmp_path)).collect())) == want
