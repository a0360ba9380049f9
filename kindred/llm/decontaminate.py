"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item, every window of a document with as many words as the item is a candidate.
A window can only reach the similarity if enough of its shingles are shingles of items of that size, which
a running sum tells for all windows at once; the others are passed over without loss. Candidate windows
get a SimHash of 256 bits and meet the items of their size in a multi-index over Hamming blocks; the exact weighted
similarity of shingles (sum of smaller over sum of larger counts) decides.

The index loses nothing. A bit is the sign of a sum over shingles, and a window of the similarity differs from its
item in so few shingles that each sum moves by 2 (1 - s) / (1 + s) times the item's shingles at most. So only bits
with a sum up to that can flip. Each item is filed in the block where fewest bits can, under all values
that these flips give, and a window looks up its own values; then all bits that can't flip are compared.
Long items, where flips could give too many values in every block, are only met by that comparison.

The benchmark is the query set: it is taken in blocks of bounded size, one at a time, each met by all documents in one
scan without a shuffle.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.llm.common import drop_path, id_type, scratch, small, table

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint and of a block, and bits that may flip in the block an item is filed in.
BITS, WIDTH, FLIPS = 256, 12, 7
#: Bytes of benchmark text in one block.
ITEMS = 4 << 20
_MULT = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)]
_BLANKS = bytes(32 if chr(c) in string.punctuation or c < 32 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_BLANKS).split()


def shingles(w: list[bytes]) -> Counter:
    """Counts of SHINGLE-word shingles; fewer words: the whole sequence."""
    return Counter([b" ".join(w)] if 0 < len(w) < SHINGLE else [b" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def sums(counts: Counter) -> np.ndarray:
    """For each bit of the SimHash, how much more weight has shingles with it than without; the bit is set where positive."""
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s, seed) for s in counts for seed in range(BITS // 128)), np.uint8)
    n = np.array(list(counts.values()), np.int64)
    bits = np.unpackbits(h.reshape(len(counts), -1), axis=1).astype(np.int64)
    return n @ (2 * bits - 1)


def slack(shingles: int, similarity: float = SIMILARITY) -> int:
    """How far a sum of a window with at most `shingles` shingles can be from that of an item with so many, at this similarity."""
    return int(2 * shingles * (1 - similarity) / (1 + similarity) + 1e-9)


class MultiIndex:
    """Items of one size by fingerprint: near() has all whose similarity to a window can reach the bound."""

    def __init__(self, items: list[Counter]):
        s = np.array([sums(c) for c in items], np.int64).reshape(-1, BITS)
        fixed = np.abs(s - 0.5) > np.array([slack(sum(c.values())) for c in items], np.int64).reshape(-1, 1)
        self.bits, self.fixed = np.packbits(s > 0, axis=1), np.packbits(fixed, axis=1)
        self.blocks = BITS // WIDTH
        parts = (s > 0)[:, : self.blocks * WIDTH].reshape(-1, self.blocks, WIDTH)
        free = ~fixed[:, : self.blocks * WIDTH].reshape(-1, self.blocks, WIDTH)
        best = free.sum(axis=2).argmin(axis=1) if len(items) else []
        keys, owners, rest = [], [], []
        for i, b in enumerate(best):
            flips = (1 << np.flatnonzero(free[i, b])).astype(np.int64)
            if len(flips) > FLIPS:
                rest.append(i)
                continue
            value = np.array([int(parts[i, b] @ (1 << np.arange(WIDTH)))])
            for f in flips.tolist():
                value = np.concatenate([value, value ^ f])
            keys.append(int(b) << WIDTH | value)
            owners.append(np.full(len(value), i))
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.owners = key[order], np.concatenate(owners)[order] if keys else key
        self.rest = np.array(rest, np.int64)

    def met(self, s: np.ndarray) -> np.ndarray:
        """Items that the blocks give for a window with these sums."""
        q = (s > 0)[: self.blocks * WIDTH].reshape(self.blocks, WIDTH) @ (1 << np.arange(WIDTH)) + (np.arange(self.blocks) << WIDTH)
        lo, hi = np.searchsorted(self.keys, q), np.searchsorted(self.keys, q, "right")
        return np.concatenate([self.rest, *(self.owners[i:j] for i, j in zip(lo.tolist(), hi.tolist()) if i < j)])

    def near(self, s: np.ndarray) -> list[int]:
        """Those of them that differ in no bit that can't flip."""
        found = self.met(s)
        return found[~((self.bits[found] ^ np.packbits(s > 0)) & self.fixed[found]).any(axis=1)].tolist()


def _hashes(w: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """A hash for each run of k words, of this process only; collisions make candidates, never results."""
    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    n = len(w) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out += h[j : j + n] * np.uint64(_MULT[j])
    return out


class _Known:
    """Which hashes of an array are known, and what is told of them."""

    def __init__(self, told: dict[int, set]):
        self.told, self.sorted = told, np.sort(np.fromiter(told, np.uint64, len(told)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> list[int]:
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[k] == h[at]].tolist()


class Benchmark:
    """A block of items, indexed by their number of words."""

    def __init__(self, items: list[tuple[object, bytes]]):
        by: dict[int, list] = defaultdict(list)
        sizes: dict[int, set[int]] = defaultdict(set)  # shingle's hash -> sizes of the items that have it
        short: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))  # words -> hash -> texts
        self.short: dict[bytes, list] = defaultdict(list)
        for key, text in items:
            w = words(text)
            if len(w) >= SHINGLE:
                by[len(w)].append((key, shingles(w)))
                for h in _hashes(w).tolist():
                    sizes[h].add(len(w))
            elif w:
                self.short[b" ".join(w)].append(key)
                short[len(w)][int(_hashes(w, len(w))[0])].add(b" ".join(w))
        self.sizes = {n: (own, MultiIndex([s for _, s in own])) for n, own in by.items()}
        self.known = _Known(sizes) if sizes else None
        self.phrases = {n: _Known(told) for n, told in short.items()}

    def matches(self, text: bytes | None) -> list[tuple[object, int, int, float]]:
        """(item, first word, words, similarity) of each item's best window; of equally good ones the first."""
        w = words(text)
        best: dict[object, tuple] = {}
        for n, known in self.phrases.items():
            for at in known.places(_hashes(w, n)):
                for key in self.short.get(b" ".join(w[at : at + n]), ()):
                    best.setdefault(key, (key, at, n, 1.0))
        if self.known is None:
            return list(best.values())
        h = _hashes(w)
        places: dict[int, list[int]] = defaultdict(list)
        for at in self.known.places(h):
            for n in self.known.told[int(h[at])]:
                places[n].append(at)
        share = SIMILARITY / (1 + SIMILARITY)
        for n in sorted(places):
            m = n - SHINGLE + 1
            have = min(m, len(h))
            need = share * (m + have) - 1e-9  # shingles that a window and an item share at this similarity
            if len(places[n]) < need:
                continue
            total = np.zeros(len(h) + 1, np.int64)
            total[np.array(places[n]) + 1] = 1
            total, (own, index) = np.cumsum(total), self.sizes[n]
            for at in np.flatnonzero(total[have:] - total[: len(total) - have] >= need).tolist():
                s = shingles(w[at : at + n])
                for i in index.near(sums(s)):
                    key, item = own[i]
                    got = similarity(s, item)
                    if got >= SIMILARITY and (key not in best or got > best[key][3]):
                        best[key] = (key, at, min(n, len(w)), got)
        return list(best.values())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start_word, n_words, similarity) for each document and item of similarity 0.8 or more.

    Similarity is that of the best window of as many words as the item (the whole document if it has fewer). An item of
    under five words is one shingle of them all, so it matches where a document has exactly its words in a row. Null and
    blank texts match nothing; null ids stay; repeated documents and items give a row each; empty tables give no rows;
    other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kinds = (id_type(docs, id_col), id_type(items, item_col))
    schema = f"id {kinds[0]}, item {kinds[1]}, start_word long, n_words long, similarity double"
    item_type = items.schema[item_col].dataType

    def met(block: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark([(i, t) for i, (_, t) in enumerate(block.value)])
            names = pa.array([k for k, _ in block.value], to_arrow_type(item_type))
            for b in small(batches):
                found = [(r, *m) for r, t in enumerate(b.column(1)) for m in bench.matches(t.as_py())]
                r, i, at, size, sim = zip(*found) if found else [()] * 5
                cols = [b.column(0).take(pa.array(r, pa.int64())), names.take(pa.array(i, pa.int64())), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(sim, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "item", "start_word", "n_words", "similarity"])

        return src.mapInArrow(run, schema)

    it, n = _items(items, item_col, item_text)
    if n == 1:
        return met(_block(it, 0, 1))
    path = scratch(docs.sparkSession, "matches")
    docs.sparkSession.createDataFrame([], schema).write.parquet(path)
    for k in range(n):
        block = _block(it, k, n)
        met(block).write.mode("append").parquet(path)
        block.destroy()
    return docs.sparkSession.read.schema(schema).parquet(path)


def _items(items: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, int]:
    """(item, t) without null texts, and in how many blocks of about ITEMS bytes to take them."""
    it = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).cast("binary").alias("t"))
    return it, -(-(it.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // ITEMS)


def _block(it: DataFrame, k: int, n: int) -> Broadcast:
    """Block k of n, by hash of item and text, as a broadcast list: about ITEMS bytes, or one longer text."""
    rows = it.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == k).collect()
    return it.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["t"])) for r in rows])


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, whole, that match no benchmark item as contaminated() has it. Nothing is exchanged.

    Null texts and ids stay, repeated rows are judged alike, an empty benchmark takes nothing, columns of any name are carried along.
    """
    at = docs.columns.index(text_col)

    def clean(df: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark([(i, t) for i, (_, t) in enumerate(block.value)])
            for b in small(batches, at):
                yield b.filter(pa.array([t.as_py() is None or not bench.matches(t.as_py().encode("utf-8", "replace")) for t in b.column(at)], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    it, n = _items(items, item_col, item_text)
    before = None
    for k in range(n):
        block = _block(it, k, n)
        left = clean(docs, block)
        if n == 1:
            return left
        path = scratch(docs.sparkSession, "clean")  # what one block leaves, so that no two blocks are held
        left.write.option("compression", "zstd").parquet(path)
        block.destroy()
        if before:
            drop_path(docs.sparkSession, before)
        docs, before = docs.sparkSession.read.schema(docs.schema).parquet(path), path
    return docs


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, with the place and similarity of each."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnsRenamed({"id": "doc_id", "item": "item_id"})
