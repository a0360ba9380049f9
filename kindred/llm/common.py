"""What the corpus operators share: the shared folder, written tables, and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; the contracts' words are runs of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from its checkout."""
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_REPO, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths handed out while a scope of this thread is open; see noted().
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _open.get():
        scope.append(path)
    return path


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The scratch paths handed out meanwhile to this thread, for whoever opened the scope to drop once a result is written."""
    scope: list[str] = []
    token = _open.set((*_open.get(), scope))
    try:
        yield scope
    finally:
        _open.reset(token)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written(make()), without the scratch tables that making it took."""
    with noted() as paths:
        df = make()
    out = written(df, name)
    for path in paths:
        drop_path(spark, path)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor then repeats tasks of the current step only.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("u % 1000003"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table as (node, root), root the smallest node; isolated nodes are absent.

    Alternates large-star and small-star steps. Each is an aggregate with map-side combine and an
    equi-join, so a hub's edges are never gathered in one place (adaptive execution splits its join
    partition), and each round is written, so lineage stays short. Null ends and loops are ignored.
    """
    with noted() as paths:
        e = _stars(edges, a, b)
    for path in paths[:-1]:
        drop_path(edges.sparkSession, path)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each node and its root (u, v), the last table written."""
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    before = _digest(e)
    while before[0]:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.toDF("u", "v")).distinct(), "small")
        after = _digest(e)
        if after == before:
            break
        before = after
    return e


def small(batches, column: int = 1, limit: int = 8 << 20):
    """Slice Arrow batches so that one slice's values of a binary column hold about `limit` bytes or are one row."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield b.slice(at, end - at)
            at = end


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
