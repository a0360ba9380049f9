"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are encoded once where they lie; only a count per length (at most `capacity` of them)
reaches the driver. Best-fit decreasing runs over these counts, many equal sequences at a time, and
yields slots for each length. A piece finds its slot by its rank within its length: the rank inside
its written chunk plus the counts of the chunks before it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import id_type, partition_id, small, table, written
from kindred.llm.tokens import encoder, vocabulary

CAPACITY = 4096
END = 1
#: Rows (chunk, length) up to which the counts of the chunks before are broadcast; beyond, they are joined.
TABLE = 2_000_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, per sequence, first sequence, offset).

    The pieces of one length from `first rank` up to the next row's fill sequences from `first sequence` on,
    `per sequence` in each, side by side from `offset`. Equal to placing the pieces one at a time, longest
    first, each in the fullest sequence with room; work depends on the lengths, not on how many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, how many)
    free: list[int] = []
    out, sequences = [], 0

    def add(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                bisect.insort(free, space)
                room[space] = []
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                space = free[i]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], free[i]
            else:
                space, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = space // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, per, first, capacity - space))
                add(space - per * length, first, full)
                left, rank = left - full * per, rank + full * per
            if left and full < n:  # fewer than `per` remain: they share the next sequence
                out.append((length, rank, left, first + full, capacity - space))
                add(space - left * length, first + full, 1)
                full, left, rank = full + 1, 0, rank + left
            add(space, first + full, n - full)
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END, capacity: int = CAPACITY) -> DataFrame:
    """Encode whole texts and cut them: (id, piece, start, length, ids binary, chunk, nth).

    ids are little-endian unsigned 32-bit integers, `end_id` last; null texts count as empty ones (and have no
    piece where `end_id` is None). nth counts a chunk's pieces of equal length, so (chunk, length, nth) is unique.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chunk = np.zeros(capacity + 1, np.int64), partition_id()
        for b in small(batches):
            ids, ends = encoder(tokenizer).encode_batch(b.column(1), end_id)
            size = np.diff(ends)
            per = -(-size // capacity)
            row = np.repeat(np.arange(b.num_rows), per)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            n = np.minimum(capacity, size[row] - piece * capacity)
            order = np.argsort(n, kind="stable")  # pieces of one length side by side, numbered there
            first = np.searchsorted(n[order], n[order])
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - first
            nth += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            at = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32 if 4 * len(ids) < 1 << 31 else np.int64)
            kind = pa.binary() if at.dtype == np.int32 else pa.large_binary()
            data = pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            cols = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(n), data, pa.array(nth), pa.array(np.full(len(n), chunk, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids", "nth", "chunk"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, f"id {id_type(docs, id_col)}, piece int, start long, length long, ids binary, nth long, chunk int")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END, capacity: int = CAPACITY, derive: dict[str, Column] | None = None) -> DataFrame:
    """(id, piece, start, length, ids, sequence, offset): every piece of every row in a sequence of at most `capacity` tokens.

    Sequences are gapless from offset 0. Repeated rows are packed as often as they occur, null ids stay null,
    an empty table gives no rows, and further columns of `docs` are ignored. `derive` names columns to compute
    from a piece's ids where it lies; they then stand in place of ids, which needn't move.
    """
    cut = written(pieces(docs, tokenizer, id_col, text_col, end_id, capacity), "pieces")
    hist = written(cut.groupBy("chunk", "length").count(), "lengths")
    counts = {r["length"]: r["n"] for r in hist.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = {"ids": F.col("ids")} if derive is None else derive
    kept = cut.select("id", "piece", "start", "length", *(c.alias(n) for n, c in extra.items()), "nth", "chunk")
    base = hist.select("chunk", "length", before.alias("before"))
    rows = base.limit(TABLE + 1).count()
    table: tuple[np.ndarray, ...] | None = None
    if rows <= TABLE:  # at most 24 bytes a row: carried to the pieces, which then needn't move
        got = base.toPandas().sort_values(["chunk", "length"])
        table = (got["chunk"].to_numpy(np.int64) << 32 | got["length"].to_numpy(np.int64), got["before"].to_numpy(np.int64))
        ranked = kept.withColumn("before", F.lit(0).cast("long"))
    else:
        ranked = kept.join(base, ["chunk", "length"]).select(*kept.columns, "before")
    shared = docs.sparkSession.sparkContext.broadcast((slots.T, table))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (length, first, per, seq, off), table = shared.value
        keys = length << 44 | first
        for b in batches:
            n = b.column(3).to_numpy()
            nth, chunk, rank = (c.to_numpy() for c in b.columns[-3:])
            if table is not None:
                rank = table[1][np.searchsorted(table[0], chunk.astype(np.int64) << 32 | n)] if len(n) else rank
            rank = rank + nth
            at = np.searchsorted(keys, n << 44 | rank, "right") - 1
            k = rank - first[at]
            cols = [*b.columns[:-3], pa.array(seq[at] + k // per[at]), pa.array(off[at] + k % per[at] * n)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-3], "sequence", "offset"])

    schema = T.StructType([*kept.schema.fields[:-2], T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def op1_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents packed into sequences of 4096 tokens: a row for each piece."""
    path = tokenizer or vocabulary("word_bpe_49k.json")
    out = pack(table(spark, sf_dir, "documents"), path, derive={"ids_crc32": F.crc32("ids")})
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")
