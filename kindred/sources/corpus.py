"""The corpus: reports, their tags and authors, note files and link targets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.config import Settings
from kindred.functions.text import stem, trimmed
from kindred.sources import sqlite
from kindred.sources.shared import numbered

PAPERS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("file_path", T.StringType(), False), T.StructField("title", T.StringType())])
TAGS = T.StructType([T.StructField("paper_id", T.LongType(), False), T.StructField("tag", T.StringType(), False)])
AUTHORS = T.StructType([T.StructField("paper_id", T.LongType(), False), T.StructField("name", T.StringType())])


def read_table(spark: SparkSession, source: str, name: str, schema: T.StructType, likes: dict[str, list[str]] | None = None, ranges: int = sqlite.RANGES) -> DataFrame:
    """A relation of the cache: from `<source>/<name>.parquet`, or in ranges from a database if source is a JDBC address or an SQLite file.

    Ranges are of row numbers in SQLite, where `likes` are evaluated too, and of the first column's values elsewhere.
    """
    if source.startswith("jdbc:"):
        key = schema.names[0]
        jdbc = lambda **more: spark.read.format("jdbc").options(url=source, **more).load()
        named = next(c for c in jdbc(dbtable=name).columns if c.lower() == key)  # as the database spells it
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source).quoteIdentifier(named)
        low, high = jdbc(query=f"SELECT min({quoted}) AS low, max({quoted}) AS high FROM {name}").first()
        split = {} if low is None else {"partitionColumn": key, "lowerBound": low, "upperBound": high + 1, "numPartitions": ranges}
        return jdbc(dbtable=name, **split).select(*(F.col(f.name).cast(f.dataType) for f in schema))
    if source.endswith(".db"):
        return sqlite.read(spark, source, name, schema, likes, ranges)
    return spark.read.schema(schema).parquet(f"{source}/{name}.parquet")


def folder_patterns(cfg: Settings) -> list[str]:
    """LIKE patterns of the configured folders' files."""
    return [f"%{cfg.reports_rel}/{f}/%" for f in cfg.folders]


def scan(papers: DataFrame, cfg: Settings) -> DataFrame:
    """Reports of the configured folders: (idx, id, file_path, relpath, folder, basename, title), idx by id.

    A report lies directly in its folder, ends in .md and doesn't start with an underscore. A null title is "".
    Positions follow the order of ids, which differ.
    """
    lead = cfg.reports_dir + "/"
    like = [F.col("file_path").ilike(p.replace("\\", "\\\\")) for p in folder_patterns(cfg)]
    p = papers.where(reduce(or_, like) & F.col("file_path").startswith(lead))
    p = p.withColumn("relpath", F.substring("file_path", len(lead) + 1, 1 << 20)).withColumn("_p", F.split("relpath", "/"))
    p = p.where(F.size("_p") == 2).withColumn("folder", F.col("_p")[0]).withColumn("basename", F.col("_p")[1])
    p = p.where(F.col("folder").isin(*cfg.folders) & ~F.col("basename").startswith("_") & F.col("basename").endswith(".md"))
    return numbered(p.withColumn("title", F.coalesce("title", F.lit(""))), "id", "idx").select("idx", "id", "file_path", "relpath", "folder", "basename", "title")


def live(corpus: DataFrame, listing: DataFrame) -> DataFrame:
    """Reports whose file exists, numbered anew; `listing` has a column path."""
    kept = corpus.join(listing.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return numbered(kept.drop("idx"), "id", "idx").select(*corpus.columns)


def corpus_tags(corpus: DataFrame, tags: DataFrame) -> DataFrame:
    return corpus.select("idx", F.col("id").alias("paper_id")).join(tags, "paper_id").select("idx", "tag").distinct()


def corpus_authors(corpus: DataFrame, authors: DataFrame) -> DataFrame:
    """Names are trimmed; null and empty ones are none."""
    named = authors.select("paper_id", trimmed(F.col("name")).alias("name")).where("name <> ''")
    return corpus.select("idx", F.col("id").alias("paper_id")).join(named, "paper_id").select("idx", "name").distinct()


def link_targets(corpus: DataFrame, reports_rel: str) -> DataFrame:
    """(idx, target): the file's stem where it is unique, else its path from the vault's root.

    Stems are counted before they are exchanged and only unique ones come back, by the note that has it, so a stem that
    every folder has is a row a task.
    """
    s = corpus.select("idx", "folder", stem(F.col("basename")).alias("stem"))
    unique = s.groupBy("stem").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).where("n = 1").select("idx", F.lit(True).alias("unique"))
    path = F.concat_ws("/", F.lit(reports_rel), "folder", "stem")
    return s.join(unique, "idx", "left").select("idx", F.when(F.col("unique"), F.col("stem")).otherwise(path).alias("target"))


def notes(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """(path, text) of note files. Bytes that aren't UTF-8 are replaced, or raise if `strict`."""
    if listing(spark, paths).isEmpty():
        return spark.createDataFrame([], "path string, text string")
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    if strict:
        return raw.select("path", F.decode("content", "utf-8").alias("text"))
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path) of existing files; contents aren't read. No file at all gives no rows."""
    try:
        found = spark.read.format("binaryFile").load(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
