"""Writing corpora as token files in document order, and reading them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import rans
from kindred.llm.common import partition_id, partitions, scratch, small, table, written
from kindred.llm.tokens import encoder, vocabulary

END = 2
#: Bytes and documents at which a token file is closed and the next one begun, and runs of blocks read for each partition.
ROLL, DOCS, RUNS = 256 << 20, 1 << 20, 16


def opened(path: str, mode: str):
    """A file of any store that pyarrow knows (file, hdfs, s3, gs), for random reading or for writing."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "r":
        return store.open_input_file(at)
    if store.type_name == "local":
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(at, compression=None, buffer_size=1 << 20)


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END) -> DataFrame:
    """(id long, ids binary): whole texts' ids as little-endian unsigned 16-bit integers where all fit, else 32-bit, with a leading width byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids, ends = encoder(tokenizer).encode_batch(b.column(1), end_id)
            short = ids.astype("<u2")
            fits = np.concatenate([[0], np.cumsum(ids != short)])[ends]
            ends = ends.tolist()
            out = [b"\x02" + short[i:j].tobytes() if fit else b"\x04" + ids[i:j].tobytes() for i, j, fit in zip(ends, ends[1:], fits[1:] == fits[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, ids binary")


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"\x02" else "<u4", offset=1).astype(np.int64)


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents; a row for each id and task is exchanged, one for each id collected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in small(batches, 0):
            ids = b.column(0).to_pylist()
            two = np.frombuffer(b"".join(x[1:] for x in ids if x[:1] == b"\x02"), "<u2")
            four = np.frombuffer(b"".join(x[1:] for x in ids if x[:1] == b"\x04"), "<u4")
            got = np.bincount(four, minlength=len(total))
            got += np.bincount(two, minlength=len(got))
            total = np.pad(total, (0, len(got) - len(total))) + got
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["sym", "n"])

    rows = ids.select("ids").mapInArrow(run, "sym long, n long").groupBy("sym").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r["sym"] for r in rows), default=0), np.int64)
    for r in rows:
        out[r["sym"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END, roll: int = ROLL, docs_a_file: int = DOCS) -> DataFrame:
    """Write token files below `folder` in ascending id order; their manifest: (part, piece, path, n_docs, n_tokens, n_blocks, start).

    `start` counts the ids of all files before. Each range of ids (part) is a run of files (piece) that are closed at `roll`
    bytes or `docs_a_file` documents, so neither a file nor what its writer and readers hold grows with the corpus. A file is named by attempt and counts only once its task's
    manifest row is committed, so repeated and lost tasks leave no duplicates. Null ids come first, rows of
    equal id in the order of their ids' bytes; null texts are empty ones. An empty table gives no rows. Other columns
    are ignored. Ids are numbers or texts of numbers, as files hold 64-bit ids; other texts are refused.
    """
    ids = written(token_ids(docs, tokenizer, id_col, text_col, end_id), "ids")
    counts = id_counts(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tables, piece, w = f"{folder}/tokens-{partition_id():06d}-{uuid.uuid4().hex}", None, 0, None

        def closed() -> pa.RecordBatch:
            w.close()
            w.f.close()
            cols = ([partition_id()], pa.int32()), ([piece], pa.int32()), ([path], pa.string()), ([len(w.docs)], pa.int64()), ([w.total], pa.int64()), ([len(w.blocks)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], names=["part", "piece", "path", "n_docs", "n_tokens", "n_blocks"])

        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                if w is None:
                    path, tables = f"{name}-{piece:06d}.rans", tables or rans.Tables(counts)
                    w = rans.Writer(opened(path, "w"), tables, counts)
                w.append(key, unpacked(data.as_py()))
                if w.at >= roll or len(w.docs) >= docs_a_file:
                    yield closed()
                    piece, w = piece + 1, None
        if w is not None:
            yield closed()

    ordered = ids.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "ids")
    files = written(ordered.mapInArrow(run, "part int, piece int, path string, n_docs long, n_tokens long, n_blocks int"), "manifest")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(files.withColumn("start", before), "manifest")  # a row for each file


def read_tokens(manifest: DataFrame, blocks: int = 4) -> DataFrame:
    """(id, start, n_tokens, ids binary, little-endian unsigned 32-bit) of every document in the manifest's files.

    Tasks are dealt runs of checkpoints, not files; each decodes its own and what its last document has behind them. A run has
    `blocks` of them, or more where that would make over RUNS runs for each partition.
    """
    total = manifest.agg(F.sum("n_blocks")).first()[0] or 0
    blocks = max(blocks, -(-total // (RUNS * partitions(manifest.sparkSession))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "start", "n_tokens", "ids"])

        for b in batches:
            for path, start, first in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows, size = [], 0
                with opened(path, "r") as f:
                    for key, before, ids in rans.Reader(f).documents(first, first + blocks):
                        rows.append((key, start + before, len(ids), ids.astype("<u4").tobytes()))
                        size += len(rows[-1][3])
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    parts = manifest.select("path", "start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_blocks") - 1), F.lit(blocks))).alias("first"))
    return parts.repartition(max(1, parts.count())).mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def op6_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents written as token files in doc_id order and read back."""
    files = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-files"), tokenizer or vocabulary("byte_bpe_50k.json"))
    return read_tokens(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
