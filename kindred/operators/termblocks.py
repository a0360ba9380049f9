"""Pairs of notes that share rare terms, met in blocks of notes: no pair is exchanged before its cosine is known."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Thresholds
from kindred.operators.blocks import against
from kindred.sources.shared import importable, numbered, written

#: Bounds are sums of doubles; this much more than they say covers their rounding.
EXTRA = 1e-9
SLACK = 1 + EXTRA
#: Terms of a block of notes at most, and blocks that smaller corpora are dealt into, of so many terms at least; groups that all blocks form, about.
BLOCK, BLOCKS, LEAST, GROUPS = 6_000_000, 6, 1 << 15, 4
#: Notes whose bounds are summed together, shared terms that are held at once, and steps of norm by a factor of e.
ROWS, HITS, STEPS = 512, 1 << 19, 64
#: Notes and frequent terms of a table that says which note has which; the part of what a pair must reach that may still be open when it is judged again.
TABLE, OPEN = 1 << 22, 1.0


@dataclass
class Postings:
    """notes: (idx, norm, terms), the terms that other notes have too as ascending numbers, which go from rare to frequent.

    Numbers from first[k] on have document frequency df[k] and weight w[k].
    """

    notes: DataFrame
    first: np.ndarray
    df: np.ndarray
    w: np.ndarray


def postings(weights: DataFrame) -> Postings:
    """Terms are numbered by (df, term); a row a different df goes through the driver, at most the root of twice the postings."""
    shared = weights.where("df > 1")
    words = shared.groupBy("term").agg(F.max("df").alias("df"), F.max("w").alias("w")).withColumn("at", F.struct("df", "term"))
    words = written(numbered(words, "at", "number").select("term", "df", "w", "number"), "terms")
    steps = words.groupBy("df").agg(F.min("number").alias("first"), F.max("w").alias("w"), F.max("number").alias("last")).orderBy("df").toArrow()
    first, last = steps["first"].to_numpy().astype(np.int64), steps["last"].to_numpy()
    kind = "int" if not len(last) or last.max() < 1 << 31 else "long"
    numbers = shared.join(words.select("term", "number"), "term").select("idx", "w", F.col("number").cast(kind).alias("number"))
    alone = weights.where("df <= 1").select("idx", "w", F.lit(None).cast(kind).alias("number"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    notes = numbers.union(alone).groupBy("idx").agg(norm, F.sort_array(F.collect_list("number")).alias("terms"))
    return Postings(written(notes.where(F.size("terms") > 0), "notes"), first, steps["df"].to_numpy().astype(np.int64), steps["w"].to_numpy().astype(np.float64))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all lists, where each list begins and the last ends)"""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each entry, `count` of them, one entry after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Notes by their heads: the rarest terms, from which on a note's terms weigh `a_min` times its squared norm.

    A term weighs the same in every note. So a pair at the threshold shares terms of at least `a_min` times the smaller squared
    norm, and its rarest shared term is a head of the note of smaller norm. What its heads leave open is at most `tail`.
    """

    def __init__(self, idx: np.ndarray, norm: np.ndarray, lists: pa.Array, steps: Postings, limits: Thresholds):
        self.idx, self.norm, self.t, self.w2, self.first = idx, norm, max(limits.a_min, 0.0), steps.w * steps.w, steps.first
        self.terms, self.at = _flat(lists)
        specific = int(np.searchsorted(steps.df, limits.a_specific_df, "right"))
        self.common = steps.first[specific] if specific < len(steps.first) else np.iinfo(np.int64).max
        n = len(idx)
        self.heads, self.tail, self.halt, self.left = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        self.frequent = max(0, int(self.terms.max(initial=0)) + 1 - self.common)  # different ones, from `common` on
        self.rare = self.specifics(self.terms, self.at)
        self.codes, self.rows = (max(1, int(x).bit_length()) for x in (len(self.first), n))
        packed, self.coded = [], np.zeros(len(self.terms), np.int32)
        for low in range(0, n, ROWS):
            at = self.at[low : low + ROWS + 1]
            count, some = np.diff(at), self.terms[at[0] : at[-1]].astype(np.int64)
            row, code = np.repeat(np.arange(len(count)), count), np.searchsorted(self.first, some, "right") - 1
            self.coded[at[0] : at[-1]] = code
            total = np.cumsum(self.w2[code])
            extra = EXTRA * total[-1]
            rest = total[np.cumsum(count) - 1][row] - total
            own = norm[low : low + ROWS]
            head = (some < self.common) & ((self.w2[code] + rest) * SLACK + extra >= (self.t * own * own)[row])
            self.heads[low : low + ROWS] = heads = np.bincount(row[head], minlength=len(count))
            there = heads > 0
            self.tail[low : low + ROWS][there] = rest[(at[:-1] - at[0] + heads - 1)[there]] * SLACK + extra
            halt = np.maximum(np.bincount(row[rest > OPEN * (self.t * own * own)[row]], minlength=len(count)) + 1, self.rare[low : low + ROWS])
            self.halt[low : low + ROWS] = halt = np.minimum(halt, count)
            self.left[low : low + ROWS] = rest[at[:-1] - at[0] + halt - 1] * SLACK + extra
            packed.append((some[head] << (self.rows + self.codes)) | ((row[head] + low) << self.codes) | code[head])
        packed = np.sort(np.concatenate(packed))
        term = packed >> (self.rows + self.codes)
        begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.head_terms, self.begins = term[begins], np.concatenate([begins, [len(term)]])
        packed &= (1 << (self.rows + self.codes)) - 1
        self.posted = packed

    def scored(self, idx: np.ndarray, norm: np.ndarray, terms: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """(row here, row of the larger note, dot over heads, what it must reach) of pairs that meet."""
        if not len(self.head_terms):
            return
        row = np.repeat(np.arange(len(idx)), np.diff(at))[terms < self.common]
        terms = terms[terms < self.common]
        found = np.minimum(np.searchsorted(self.head_terms, terms), len(self.head_terms) - 1)
        same = self.head_terms[found] == terms
        found, row = found[same], row[same]
        start, count = self.begins[found], self.begins[found + 1] - self.begins[found]
        upto = np.cumsum(count)
        low = 0
        while low < len(row):  # whole rows, of about HITS shared terms
            high = np.searchsorted(upto, (upto[low - 1] if low else 0) + HITS, "right")
            high = np.searchsorted(row, row[min(max(high, low), len(row) - 1)], "left")
            high = high if high > low else np.searchsorted(row, row[low], "right")
            high = len(row) if upto[-1] - (upto[low - 1] if low else 0) <= HITS else high
            hits = (np.repeat(row[low:high], count[low:high]) << (self.rows + self.codes)) | self.posted[_spread(start[low:high], count[low:high])]
            hits.sort()
            pair = hits >> self.codes
            begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            dot = np.add.reduceat(self.w2[hits & ((1 << self.codes) - 1)], begin)
            l, s = pair[begin] >> self.rows, pair[begin] & ((1 << self.rows) - 1)
            smaller = (self.norm[s] < norm[l]) | ((self.norm[s] == norm[l]) & (self.idx[s] < idx[l]))
            s, l, dot = s[smaller], l[smaller], dot[smaller]
            yield s, l, dot, self.t * self.norm[s] * norm[l] - self.tail[s]
            low = high

    def specifics(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each note's terms are specific; they stand first."""
        upto = np.concatenate([[0], np.cumsum(terms < self.common)])
        return upto[at[1:]] - upto[at[:-1]]

    def cosines(self, idx: np.ndarray, norm: np.ndarray, terms: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """(row here, row of the larger note, cosine): pairs that can reach the threshold meet the smaller note's other terms."""
        width = int(max(self.terms.max(initial=0), terms.max(initial=0))).bit_length()
        held, rare = (np.repeat(np.arange(len(idx)), np.diff(at)) << width) | terms, self.specifics(terms, at)

        def has_rare(l: np.ndarray, count: np.ndarray, some: np.ndarray) -> np.ndarray:
            want = np.repeat(l << width, count) | some
            return held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want

        def has_frequent(l: np.ndarray, count: np.ndarray, some: np.ndarray) -> np.ndarray:
            first, last = l[0], l[-1] + 1
            own = _spread(at[first:last] + rare[first:last], np.diff(at[first : last + 1]) - rare[first:last])
            row = np.repeat(np.arange(last - first), np.diff(at[first : last + 1]) - rare[first:last])
            there = terms[own] - self.common < self.frequent
            table = np.zeros((last - first) * self.frequent, bool)
            table[row[there] * self.frequent + terms[own[there]] - self.common] = True
            return table[np.repeat((l - first) * self.frequent - self.common, count) + some]

        for s, l, dot, need in self.scored(idx, norm, terms, at):
            go = dot * SLACK >= need
            s, l, dot = s[go], l[go], dot[go]
            start, rows = self.at[s], max(1, TABLE // max(1, self.frequent))
            self.more(l, dot, start + self.heads[s], self.rare[s] - self.heads[s], has_rare, len(idx))
            self.more(l, dot, start + self.rare[s], self.halt[s] - self.rare[s], has_frequent, rows)
            go = (dot + self.left[s]) * SLACK >= self.t * self.norm[s] * norm[l]
            s, l, dot = s[go], l[go], dot[go]
            self.more(l, dot, self.at[s] + self.halt[s], self.at[s + 1] - self.at[s] - self.halt[s], has_frequent, rows)
            yield s, l, dot / (self.norm[s] * norm[l])

    def more(self, l: np.ndarray, dot: np.ndarray, start: np.ndarray, count: np.ndarray, has: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], rows: int) -> None:
        """Add to `dot` the terms at start, start + 1, ... that the larger notes have too; HITS terms and `rows` larger notes at once, about."""
        upto, low = np.cumsum(count), 0
        while low < len(l) and upto[-1] > (upto[low - 1] if low else 0):
            done = upto[low - 1] if low else 0
            high = max(low + 1, min(np.searchsorted(upto, done + HITS, "right"), np.searchsorted(l, l[low] + rows, "left")))
            some = count[low:high]
            if upto[high - 1] > done:
                at = np.repeat((start - upto + count)[low:high], some) + np.arange(done, upto[high - 1])
                both = np.flatnonzero(has(l[low:high], some, self.terms[at]))
                pair = np.repeat(np.arange(high - low, dtype=np.int32), some)[both]
                dot[low:high] += np.bincount(pair, self.w2[self.coded[at[both]]], high - low)
            low = high


def _slots(bins: list, t: float, block: int | None) -> tuple[list, int]:
    """([(bin, parts, part, [(slot, whether as the smaller note)])], slots): where notes of each step of norm meet.

    `bins` have (bin, terms, least norm, greatest norm), in order. Steps form cells of a block each; larger ones are split by hash.
    A slot is a block of smaller notes with a group of blocks of larger ones.
    """
    total = sum(b[1] for b in bins)
    room = block or min(BLOCK, max(LEAST, -(-total // BLOCKS)))
    cells: list = []  # [bins, parts, terms, least, greatest norm]
    for b in bins:
        if not cells or cells[-1][2] + b[1] > room:
            cells.append([[], 1, 0, b[2], b[3]])
        c = cells[-1]
        c[0], c[1], c[2], c[4] = [*c[0], b[0]], max(1, -(-(c[2] + b[1]) // room)), c[2] + b[1], b[3]
    starts = np.concatenate([[0], np.cumsum([c[1] for c in cells])]).astype(int).tolist()
    each = max(1, round(starts[-1] / GROUPS))
    least, greatest = np.array([c[3] for c in cells]), np.array([c[4] for c in cells])
    last = [int(np.searchsorted(least * t, c[4] * SLACK, "right")) - 1 for c in cells]  # cells of the largest notes it can meet
    base, slots = {}, 0
    for k, c in enumerate(cells):
        for i in range(starts[k], starts[k + 1]):
            groups = range(starts[k] // each, (starts[last[k] + 1] - 1) // each + 1)
            base[i] = slots - groups.start, [slots + g - groups.start for g in groups]
            slots += len(groups)
    out = []
    for k, c in enumerate(cells):
        smaller = int(np.searchsorted(greatest * SLACK, t * c[3], "left"))  # cells of the smallest notes it can meet
        for j in range(starts[k], starts[k + 1]):
            to = [(s, True) for s in base[j][1]] + [(base[i][0] + j // each, False) for i in range(starts[smaller], starts[k + 1])]
            out += [(b, c[1], j - starts[k], to) for b in c[0]]
    return out, slots


def met(posted: Postings, limits: Thresholds, found: Callable[[Block, tuple], Iterator[tuple]], schema: str, block: int | None = None) -> DataFrame:
    """What `found` tells of each block with notes of the same or larger norm; its rows are (note of the block, other note, ...).

    What is exchanged is each note with its terms' numbers, once for each block that it can meet; never a pair. Notes are dealt by
    their norm, so a note meets blocks of smaller notes as the larger one, and is sent as the smaller one once a group of blocks.
    """
    spark = importable(posted.notes.sparkSession)
    step = F.floor(F.log("norm") * STEPS).cast("int").alias("bin")
    notes = posted.notes.select("idx", "norm", "terms", step)
    bins = notes.groupBy("bin").agg(F.sum(F.size("terms")).alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("bin").collect()  # a row a step
    table, slots = _slots([tuple(b) for b in bins], max(limits.a_min, 0.0), block)
    to = spark.createDataFrame(table, "bin int, parts int, part int, to array<struct<slot: int, block: boolean>>").withColumnRenamed("bin", "_bin")
    own = (F.col("bin") == F.col("_bin")) & (F.pmod(F.xxhash64("idx"), F.col("parts")) == F.col("part"))
    dealt = notes.join(F.broadcast(to), own).select(F.explode("to").alias("to"), "idx", "norm", "terms").select("to.slot", "to.block", "idx", "norm", "terms")
    steps = Postings(None, posted.first, posted.df, posted.w)
    names = [x.split()[0] for x in schema.split(", ")]

    def build(t: pa.Table) -> Block:
        return Block(t["idx"].to_numpy(), t["norm"].to_numpy(), t["terms"].combine_chunks(), steps, limits)

    def meet(index: Block, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        idx, norm, (terms, ends) = b.column(2).to_numpy(), b.column(3).to_numpy(), _flat(b.column(4))
        for s, l, *more in found(index, (idx, norm, terms.astype(np.int64), ends)):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (index.idx[s], idx[l], *more)], names)

    return dealt.repartitionById(max(1, slots), F.col("slot")).sortWithinPartitions("slot", F.col("block").desc()).mapInArrow(lambda batches: against(batches, build, meet), schema)
