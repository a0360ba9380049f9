"""Embedding providers and the cache of vectors by content hash."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kindred.functions.scalars import normalised
from kindred.functions.text import hash_input
from kindred.sources.shared import importable, numbered, written

BATCH, ATTEMPTS, FIRST_DELAY, TIMEOUT = 96, 5, 2.0, 120
CACHE = "hash string, vec array<float>"
#: Digits of a hash that name its bucket, and segments from which on the cache is compacted.
BUCKET_DIGITS, SEGMENTS = 1, 8
#: Batches that a requester sends before their vectors are committed.
CALLS = 8
_SEGMENT, _REPLACES = "segment=", "_replaces"
#: texts to (vectors or None, tokens)
Provider = Callable[[list[str]], tuple[list[list[float] | None], int]]


def http_provider(url: str, model: str, key: str, send=urllib.request.urlopen, wait=time.sleep) -> Provider:
    """Embeddings over HTTP. 429 and 5xx are tried again after 2, 4, 8 and 16 s; any other status is an error."""

    def embed(texts: list[str]) -> tuple[list[list[float] | None], int]:
        body = json.dumps({"model": model, "input": [t or " " for t in texts]}).encode()
        delay = FIRST_DELAY
        for attempt in range(ATTEMPTS):
            req = urllib.request.Request(url, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
            try:
                with send(req, timeout=TIMEOUT) as r:
                    got = json.load(r)
                break
            except urllib.error.HTTPError as e:
                if attempt == ATTEMPTS - 1 or e.code != 429 and e.code < 500:
                    raise RuntimeError(f"embeddings HTTP {e.code}: {e.read().decode(errors='replace')}") from e
                wait(delay)
                delay *= 2
        out: list[list[float] | None] = [None] * len(texts)
        for item in got["data"]:
            out[item["index"]] = item["embedding"]
        return out, got.get("usage", {}).get("total_tokens", 0)

    return embed


def hashed_inputs(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("hash", hash_input(F.col("input")))


def _fs(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, its Path class)"""
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def segments(spark: SparkSession, path: str) -> dict[str, int]:
    """The cache's valid segments and their bytes. A segment names those that it replaces, which count no more."""
    fs, p = _fs(spark, path)
    if not fs.exists(p(path)) or not fs.getFileStatus(p(path)).isDirectory():
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(p(path)) if s.getPath().getName().startswith(_SEGMENT)]
    gone: set[str] = set()
    for name in names:
        note = p(f"{path}/{name}/{_REPLACES}")
        if fs.exists(note):
            stream = fs.open(note)
            gone |= set(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
            stream.close()
    return {n: fs.getContentSummary(p(f"{path}/{n}")).getLength() for n in sorted(names) if n not in gone}


def _read(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    got = spark.read.schema(f"{CACHE}, segment string, bucket string").option("basePath", path).parquet(*(f"{path}/{n}" for n in names))
    return got.select("hash", "vec")


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; missing or unreadable: an empty one. Where a save broke off between its renames, the former cache.

    Of vectors that concurrent runs have stored for one hash, the smallest counts.
    """
    for at in (path, path + ".old"):
        try:
            found = segments(spark, at)
            got = _read(spark, at, found) if found else spark.read.parquet(at).select("hash", F.col("vec").cast("array<float>").alias("vec"))
            got.limit(1).collect()
            return got.groupBy("hash").agg(F.min("vec").alias("vec")) if len(found) > 1 else got
        except Exception as e:  # noqa: BLE001
            if not (isinstance(e, AnalysisException) or "parquet" in str(e).lower() or "CANNOT_READ" in str(e)):
                raise
    return spark.createDataFrame([], CACHE)


def _segment(cache: DataFrame, path: str, replaces: tuple[str, ...] = ()) -> str:
    """Write rows as a segment in buckets by hash; it counts once it has its name, by one rename."""
    spark, name = cache.sparkSession, f"{_SEGMENT}{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    cache.select("hash", "vec", F.substring("hash", 1, BUCKET_DIGITS).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/.{name}")
    if replaces:
        out = fs.create(p(f"{path}/.{name}/{_REPLACES}"))
        out.write(bytearray(" ".join(replaces), "utf-8"))
        out.close()
    if not fs.rename(p(f"{path}/.{name}"), p(f"{path}/{name}")):
        raise OSError(f"{path}/{name} couldn't be put in place")
    return name


def save_cache(cache: DataFrame, path: str) -> bool:
    """Replace the cache by renames: the former one is deleted last, once the new one is in place. An empty one isn't written."""
    if cache.isEmpty():
        return False
    fs, p = _fs(cache.sparkSession, path)
    fs.delete(p(path + ".new"), True)
    _segment(cache, path + ".new")  # read before the old one goes
    if fs.exists(p(path)):
        fs.delete(p(path + ".old"), True)
        if not fs.rename(p(path), p(path + ".old")):
            return False
    done = fs.rename(p(path + ".new"), p(path))
    if done:
        fs.delete(p(path + ".old"), True)
    return done


def append_cache(new: DataFrame, path: str) -> None:
    """Add rows as one more segment; nothing that is there is written again, unless it is of the form without segments."""
    spark = new.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p(path + ".old")) and not fs.exists(p(path)):  # a save broke off: the former cache goes on
        fs.rename(p(path + ".old"), p(path))
    if fs.exists(p(path)) and not segments(spark, path):
        if not save_cache(load_cache(spark, path), path):
            fs.delete(p(path), True)  # unreadable, so empty
    _segment(new, path)


def compact_cache(spark: SparkSession, path: str, most: int = SEGMENTS) -> list[str]:
    """Merge the smallest segments if there are more than `most`; gives the names of those merged.

    A segment over twice as large as all smaller ones together is left alone, so each row is written again about as often
    as the cache doubles. A run that breaks off leaves either all merged segments or the new one valid.
    """
    valid = segments(spark, path)
    if len(valid) <= most:
        return []
    merged, total = [], 0
    for name, size in sorted(valid.items(), key=lambda x: (x[1], x[0])):
        if len(merged) > 1 and size > 2 * total:
            break
        merged, total = [*merged, name], total + size
    _segment(_read(spark, path, merged).groupBy("hash").agg(F.min("vec").alias("vec")), path, tuple(merged))
    fs, p = _fs(spark, path)
    for name in merged:
        fs.delete(p(f"{path}/{name}"), True)
    return merged


def lookup(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """(idx, hash, vec): vec is null for misses."""
    return inputs.select("idx", "hash").join(cache, "hash", "left").select("idx", "hash", "vec")


def misses(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """(hash, input) to embed, each text once."""
    return inputs.join(cache, "hash", "left_anti").groupBy("hash").agg(F.min("input").alias("input"))


def _call(rows: list[tuple[str, str]], provider: Provider) -> pa.RecordBatch:
    vecs, tokens = provider([t for _, t in rows])
    first = [1] + [0] * (len(rows) - 1)
    cols = [pa.array([h for h, _ in rows]), pa.array(vecs, pa.list_(pa.float32())), pa.array([tokens * k for k in first], pa.int64()), pa.array(first, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["hash", "vec", "tokens", "calls"])


_CALLED = "hash string, vec array<float>, tokens long, calls long"


def embed(texts: DataFrame, provider: Provider, batch: int = BATCH) -> DataFrame:
    """(hash, vec, tokens, calls): vectors of unit length; texts that the provider leaves out have none.

    Tokens and the call stand with a batch's first row. Each partition of `texts` is a requester of its own and fills its batches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            while len(held) >= batch:
                yield _call(held[:batch], provider)
                held = held[batch:]
        if held:
            yield _call(held, provider)

    importable(texts.sparkSession)
    got = texts.select("hash", "input").mapInArrow(run, _CALLED)
    return got.select("hash", normalised(F.col("vec")).alias("vec"), "tokens", "calls")


def embed_into(texts: DataFrame, provider: Provider, path: str, requesters: int = 1, batch: int = BATCH, calls: int = CALLS) -> tuple[int, int]:
    """Embed (hash, input), each hash once, into the cache at `path`; gives the tokens and calls that it took.

    Texts are numbered by hash and sent in rounds of `calls` batches a requester. A round's vectors are in the cache before the
    next one begins, so a run that fails loses no round before, and the next run sends what is still missing. A task
    that is repeated sends its own share of a round again, `calls` batches at most.
    """
    spark = importable(texts.sparkSession)
    placed = written(numbered(texts.select("hash", "input"), "hash", "at"), "texts")
    n, size, tokens, made = placed.count(), batch * requesters * calls, 0, 0
    for at in range(0, n, size):
        some = placed.where((F.col("at") >= at) & (F.col("at") < at + size)).withColumn("batch", F.floor(F.col("at") / batch))

        def call(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_call(list(zip(t["hash"].to_pylist(), t["input"].to_pylist())), provider)])

        took = Observation()
        got = some.repartition(requesters, "batch").groupBy("batch").applyInArrow(call, _CALLED)
        got = got.observe(took, F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")).where("vec is not null")
        append_cache(got.select("hash", normalised(F.col("vec")).alias("vec")), path)
        compact_cache(spark, path)
        tokens, made = tokens + took.get["tokens"], made + took.get["calls"]
    return tokens, made
