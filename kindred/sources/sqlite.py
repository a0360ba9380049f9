"""SQLite tables read in parallel: ranges of row numbers, with filters evaluated by SQLite.

Each task opens the file itself, so it must lie where every executor sees it; the driver reads the two ends of the row
numbers and no rows. A table without row numbers is one range.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kindred.sources.shared import importable

#: Rows fetched at once, and ranges unless the reader says otherwise.
FETCH, RANGES = 10_000, 8


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> closing:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    return closing(c)


def condition(f: D.Filter) -> tuple[str, list] | None:
    """A filter as SQLite text with its values, or None where SQLite would decide otherwise than Spark."""
    column = getattr(f, "attribute", ())
    if len(column) != 1:
        return None
    c, v = _quoted(column[0]), getattr(f, "value", None)
    compared = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
    if isinstance(v, bool) or not isinstance(v, int | str | tuple | None):
        return None
    if type(f) in compared and v is not None and (isinstance(v, int) or isinstance(f, D.EqualTo)):  # texts have an order of their own
        return f"{c} {compared[type(f)]} ?", [v]
    if isinstance(f, D.In) and all(isinstance(x, int | str) and not isinstance(x, bool) for x in v):
        return (f"{c} IN ({', '.join('?' * len(v))})", list(v)) if v else ("0", [])
    if isinstance(f, D.IsNull):
        return f"{c} IS NULL", []
    if isinstance(f, D.IsNotNull):
        return f"{c} IS NOT NULL", []
    if isinstance(f, D.StringStartsWith):
        return f"substr({c}, 1, length(?)) = ?", [v, v]
    if isinstance(f, D.StringEndsWith) and v:
        return f"substr({c}, -length(?)) = ? AND length({c}) >= length(?)", [v, v, v]
    if isinstance(f, D.StringContains):
        return f"instr({c}, ?) > 0", [v]
    return None


@dataclass
class Range(D.InputPartition):
    """Row numbers from `low` on and below `high`; the first and last ranges are open, None is the whole table."""

    low: int | None
    high: int | None


class Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.ranges = int(options.get("numpartitions", RANGES))
        self.where: list[tuple[str, list]] = []
        for column, patterns in ((k[5:], v.split("\n")) for k, v in options.items() if k.startswith("like.")):
            likes = " OR ".join(f"{_quoted(column)} LIKE ?" for _ in patterns)
            self.where.append((f"({likes})", patterns))

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            made = condition(f)
            if made:
                self.where.append(made)
            else:
                yield f

    def partitions(self) -> list[Range]:
        with _open(self.path) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()  # both ends of a tree
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
                return [Range(None, None)]
        if low is None or not isinstance(low, int) or not isinstance(high, int):
            return [Range(None, None)]
        n = max(1, min(self.ranges, high - low + 1))
        cuts = [low + (high - low + 1) * k // n for k in range(1, n)]
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        bounds = [(f"rowid {op} ?", [v]) for op, v in ((">=", part.low), ("<", part.high)) if v is not None]
        parts = [*bounds, *self.where]
        sql = f"SELECT {', '.join(_quoted(f.name) for f in self.schema)} FROM {_quoted(self.table)}"
        sql += " WHERE " + " AND ".join(f"({w})" for w, _ in parts) if parts else ""
        kinds = [to_arrow_type(f.dataType) for f in self.schema]
        with _open(self.path) as c:
            rows = c.execute(sql, [v for _, vs in parts for v in vs])
            while some := rows.fetchmany(FETCH):
                columns = [pa.array(x, k) for x, k in zip(zip(*some), kinds)]
                for f, x in zip(self.schema, columns):
                    if x.null_count and not f.nullable:
                        raise ValueError(f"null in {self.table}.{f.name}")
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class Source(D.DataSource):
    """Format "sqlite_ranges": options path, dbtable, numPartitions, and `like.<column>`: LIKE patterns, a line each, one of which must match."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ranges"

    def schema(self) -> T.StructType:
        raise ValueError("give a schema")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)


def read(spark: SparkSession, path: str, table: str, schema: T.StructType, likes: dict[str, list[str]] | None = None, ranges: int = RANGES) -> DataFrame:
    """A table of `schema`. Filters on it reach SQLite; `likes` are evaluated there as SQLite's LIKE is, without regard to ASCII case."""
    importable(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    r = spark.read.format("sqlite_ranges").schema(schema).option("path", path).option("dbtable", table).option("numPartitions", ranges)
    for column, patterns in (likes or {}).items():
        r = r.option(f"like.{column}", "\n".join(patterns))
    return r.load()
