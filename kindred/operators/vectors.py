"""Pairs of notes by the cosine of their embeddings: exact, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.config import Thresholds
from kindred.operators.blocks import against
from kindred.operators.terms import ranked
from kindred.sources.shared import importable, written

#: Vectors in a block, and rows multiplied at once.
BLOCK, ROWS = 8000, 1024
#: For all pairs: numbers in the block that a task holds, blocks that fewer vectors are dealt into, of so many at least, and groups that blocks form, about.
NUMBERS, BLOCKS, LEAST, GROUPS = 1 << 22, 6, 500, 8
#: Cells at most (larger ones are split into blocks), numbers in the sample that their centres come from, and steps to find them.
CELLS, SAMPLE, STEPS = 1024, 1 << 24, 6
_NONE = pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "cos": pa.array([], pa.float32())})


def _matrix(vec: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    v = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    n = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy().astype(np.float64)
    m = np.zeros((len(n), max(1, int(n.max()))))
    m[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return m


def pair_cosines(vectors: DataFrame, floor: float | None = None, block: int | None = None) -> DataFrame:
    """(i, j, cos float) of all pairs of (idx, vec), or of those at `floor` or above; pairs below never leave a task.

    Vectors are dealt into blocks by hash. A task holds one block (`block` vectors, or NUMBERS numbers), and the blocks of a group
    pass by it in batches, so it holds no more whatever the corpus and gives its pairs as it finds them. Nothing is broadcast. A vector
    is sent to each earlier block and, as one of the block that is held, to some GROUPS tasks.
    """
    importable(vectors.sparkSession)
    v = vectors.where("vec is not null").select(F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<float>").alias("vec"))
    count, width = v.agg(F.count("*"), F.max(F.size("vec"))).first()
    block = block or max(1, min(NUMBERS // max(1, width or 1), max(LEAST, -(-count // BLOCKS))))
    n = max(1, -(-count // block))
    each = max(1, n // GROUPS)
    groups = -(-n // each)
    own, group = F.col("own"), F.floor(F.col("own") / each).cast("int")
    to = lambda slot, held: F.struct(slot.alias("slot"), F.lit(held).alias("held"))
    holds = F.transform(F.sequence(group, F.lit(groups - 1)), lambda g: to(own * groups + g, True))
    passes = F.transform(F.sequence(F.lit(0), own), lambda k: to(k * groups + group, False))
    dealt = v.withColumn("own", F.pmod(F.xxhash64("idx"), F.lit(n)).cast("int")).withColumn("to", F.explode(F.concat(holds, passes)))

    def pairs(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
        width, rows = max(a.shape[1], b.shape[1]), max(1, ROWS * BLOCK // len(i))
        a, b = _wide(a, width), _wide(b, width)
        for at in range(0, len(j), rows):
            c = (b[at : at + rows] @ a.T).astype(np.float32)
            keep = np.ones(c.shape, bool) if floor is None else c >= np.float32(floor)
            x = np.flatnonzero(same[at : at + rows])
            keep[x] &= i[None] < j[at + x, None]
            for part in np.array_split(np.flatnonzero(keep), max(1, np.count_nonzero(keep) >> 17)):
                q, p = j[at + part // len(i)], i[part % len(i)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(c.ravel()[part])], ["i", "j", "cos"])

    def build(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t["idx"].to_numpy(), _matrix(t["vec"])

    def meet(held: tuple[np.ndarray, np.ndarray], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return pairs(*held, b.column(3).to_numpy(), _matrix(b.column(4)), b.column(2).to_numpy() == b.column(0)[0].as_py() // groups)

    rows = dealt.select("to.slot", "to.held", "own", "idx", "vec")
    return rows.repartitionById(n * groups, F.col("slot")).sortWithinPartitions("slot", F.col("held").desc()).mapInArrow(lambda batches: against(batches, build, meet), "i long, j long, cos float")


def _largest(c: np.ndarray, k: int, floor: float | np.ndarray) -> np.ndarray:
    """Which k entries of each row at `floor` (one, or one a row) or above are largest; of equal ones the first. Not a number is none."""
    c = np.where(np.isnan(c), np.float32(-np.inf), c)
    keep = c >= np.asarray(floor, np.float32).reshape(-1, 1)
    if c.shape[1] > k:
        least = np.partition(c, -k, axis=1)[:, -k, None]
        more, equal = c > least, c == least
        keep &= more | equal & (np.cumsum(equal, axis=1) <= k - more.sum(axis=1, keepdims=True))
    return keep


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


def _nearest(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple]:
    """(src, dst, cos): the best in b of each row of a, itself left out. `j` ascends."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    for at in range(0, len(i), ROWS):
        c = (a[at : at + ROWS] @ b.T).astype(np.float32)
        c[i[at : at + ROWS, None] == j[None]] = -np.inf
        r, s = np.nonzero(_largest(c, k, floor[at : at + ROWS]))
        yield i[at + r], j[s], c[r, s]


def _best(src: np.ndarray, dst: np.ndarray, cos: np.ndarray, k: int) -> tuple:
    """The k largest of each src; of equal ones the smaller dst."""
    order = np.lexsort((dst, -cos, src))
    s = src[order]
    begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    keep = order[np.arange(len(s)) - np.repeat(begins, np.diff([*begins, len(s)])) < k]
    return src[keep], dst[keep], cos[keep]


def _above(c: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """Where rows have entries that may be among their k largest at their floor: few, or else these k alone."""
    keep = c >= np.asarray(floor, np.float32)[:, None]
    return keep if np.count_nonzero(keep) <= 8 * k * len(c) else _largest(c, k, floor)


def _nearest_both(i: np.ndarray, a: np.ndarray, low: np.ndarray, j: np.ndarray, b: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple]:
    """(src, dst, cos): the best in b of each row of a at its floor `low`, and those in a of each row of b at `high`, from one product."""
    width = max(a.shape[1], b.shape[1])
    a, b, back = _wide(a, width), _wide(b, width), []
    for at in range(0, len(i), ROWS):
        c = (a[at : at + ROWS] @ b.T).astype(np.float32)
        x = np.flatnonzero(_above(c, k, low[at : at + ROWS]))
        yield _best(i[at + x // len(j)], j[x % len(j)], c.ravel()[x], k)
        keep = c >= np.asarray(high, np.float32)
        if np.count_nonzero(keep) > 8 * k * len(j):
            keep = _largest(c.T, k, high).T
        x = np.flatnonzero(keep)
        back.append((j[x % len(j)], i[at + x // len(j)], c.ravel()[x]))
    if back:
        yield _best(*map(np.concatenate, zip(*back)), k)


class Cells:
    """Centres of cells of vectors, and what is known of each cell: how far its vectors are from its centre, and how long."""

    def __init__(self, sample: np.ndarray, n: int):
        size = np.linalg.norm(sample, axis=1, keepdims=True)
        unit = sample[(size > 0)[:, 0]] / size[size > 0][:, None]
        self.centres = unit[:: max(1, len(unit) // n)][:n].copy() if len(unit) else np.zeros((1, sample.shape[1] or 1))
        for _ in range(STEPS if len(unit) else 0):
            near = np.argmax(unit @ self.centres.T, axis=1)
            mean = np.zeros_like(self.centres)
            np.add.at(mean, near, unit)
            long = np.linalg.norm(mean, axis=1, keepdims=True)
            self.centres = np.where(long > 0, mean / np.where(long > 0, long, 1), self.centres)

    def place(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(angle to every centre, own cell, length) of rows; zero and broken ones have angle and length 0."""
        width = max(m.shape[1], self.centres.shape[1])
        m = _wide(m, width)
        size = np.linalg.norm(m, axis=1)
        size[~np.isfinite(size)] = 0
        with np.errstate(all="ignore"):
            angle = np.arccos(np.clip(m @ _wide(self.centres, width).T / size[:, None], -1, 1))
        angle[size == 0] = 0
        return angle, np.argmin(angle, axis=1), size

    def know(self, rows: list, block: int) -> None:
        """`rows` have (cell, vectors, least and greatest angle, greatest length)."""
        n = len(self.centres)
        count, self.low, self.high, self.long = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        for r in rows:
            count[r[0]], self.low[r[0]], self.high[r[0]], self.long[r[0]] = r[1:]
        self.blocks = -(-count // block)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.floor = np.full(n, np.inf)

    def reach(self, angle: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Above the cosine of each row with any vector of each cell: two vectors are no nearer than their angles to a centre differ."""
        apart = np.maximum(np.maximum(angle - self.high, self.low - angle), 0)
        return size[:, None] * self.long * np.maximum(np.cos(apart), 0) + 1e-5


def b_edges(vectors: DataFrame, limits: Thresholds = Thresholds(), limit: int | None = None, block: int = BLOCK, watch: Observation | None = None) -> DataFrame:
    """(src, dst, cos float) of ranked_b_edges()."""
    return ranked_b_edges(vectors, limits, limit, block, watch).drop("place")


def ranked_b_edges(vectors: DataFrame, limits: Thresholds = Thresholds(), limit: int | None = None, block: int = BLOCK, watch: Observation | None = None) -> DataFrame:
    """(src, dst, cos float, place): each note's best neighbours at the threshold or above; `limit` takes the first positions only.

    Exact, without all pairs: vectors are dealt into cells around centres (found in a bounded sample), large cells
    into blocks by hash. A block first meets itself, which gives each note a cosine that better neighbours must have. A vector
    goes on to another block only if its angle to that cell's centre allows a cosine that it, or the block's
    least demanding note, still asks for. Two blocks' vectors meet in one task, from which only each note's best leave.
    `watch` observes `sent`, the copies made for other blocks, of `possible`.
    """
    spark, k = importable(vectors.sparkSession), limits.top_k
    v = vectors.where("vec is not null") if limit is None else vectors.where((F.col("idx") < limit) & F.col("vec").isNotNull())
    about = Observation()
    counts = F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")
    v = written(v.select(F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<float>").alias("vec")).observe(about, *counts), "vectors")
    n, width = about.get["n"], max(1, about.get["width"])
    wanted = min(CELLS, -(-n // block))
    cells = None
    if wanted > 1:
        take = min(32 * wanted, max(wanted, SAMPLE // width))
        some = v.where(F.pmod(F.xxhash64("idx"), F.lit(1 << 20)) <= int(1.5 * (1 << 20) * take / n)).limit(take)
        cells = Cells(_matrix(some.select("vec").toArrow()["vec"]) if not some.isEmpty() else np.zeros((0, width)), wanted)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    angle, own, size = cells.place(_matrix(b.column(0)))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(angle[np.arange(len(own)), own]), pa.array(size)], ["cell", "angle", "size"])

        where = v.select("vec").mapInArrow(placed, "cell int, angle double, size double")
        cells.know(where.groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle"), F.max("size")).collect(), block)  # at most CELLS rows

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = cells.place(_matrix(b.column(1)))[1]
                at = cells.first[own] + b.column(2).to_numpy() % cells.blocks[own]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(own, pa.int32()), pa.array(at)], ["idx", "vec", "cell", "block"])

    def alone(t: pa.Table) -> pa.Table:
        """A block with itself: its vectors with what they have found and the cosine that they ask for from now on."""
        t = t.sort_by("idx")
        i, m = t["idx"].to_numpy(), _matrix(t["vec"])
        found = [np.concatenate(x) for x in zip(*_nearest(i, m, i, m, k, np.full(len(i), limits.b_min)))]
        at = np.searchsorted(i, found[0])
        size = np.bincount(at, minlength=len(i))
        worst = np.full(len(i), np.inf)
        np.minimum.at(worst, at, found[2])
        floor = np.where(size >= k, worst, limits.b_min)
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in found[1:]]
        return pa.table([t["idx"], t["vec"], t["cell"], t["block"], pa.array(floor), *lists], names=["idx", "vec", "cell", "block", "floor", "dst", "cos"])

    one = v.select("idx", "vec", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("block"))
    hashed = v.select("idx", "vec", F.pmod(F.xxhash64("idx"), F.lit(1 << 30)).alias("h"))
    placed_at = one if cells is None else hashed.mapInArrow(dealt, "idx long, vec array<float>, cell int, block long")
    met = placed_at.groupBy("block").applyInArrow(alone, "idx long, vec array<float>, cell int, block long, floor double, dst array<long>, cos array<float>")
    if cells is None:
        met = met if watch is None else met.observe(watch, F.count_if(F.lit(False)).alias("sent"), F.count_if(F.lit(False)).alias("possible"))
        return ranked(met.select(F.col("idx").alias("src"), F.explode(F.arrays_zip("dst", "cos")).alias("e")).select("src", "e.dst", "e.cos"), F.col("cos"), k)
    met = written(met, "blocks")
    for cell, floor in met.groupBy("cell").agg(F.min("floor")).collect():  # at most CELLS rows
        cells.floor[cell] = floor
    total = int(cells.blocks.sum())

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the tasks of its block with every other block where it can matter."""
        for b in batches:
            if not b.num_rows:
                continue
            angle, _, size = cells.place(_matrix(b.column(1)))
            own, floor = b.column(2).to_numpy(), b.column(3).to_numpy()
            row, cell = np.nonzero(cells.reach(angle, size) >= np.minimum(floor[:, None], cells.floor))
            parts = cells.blocks[cell]
            row, other = np.repeat(row, parts), np.repeat(cells.first[cell] - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
            row, other = row[own[row] != other], other[own[row] != other]
            pair = np.minimum(own[row], other) * total + np.maximum(own[row], other)
            for at in range(0, len(row), ROWS):
                some = pa.array(row[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + ROWS]), *(b.column(x).take(some) for x in range(4))], ["pair", "idx", "vec", "block", "floor"])

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        i, m, floor, low = t["idx"].to_numpy(), _matrix(t["vec"]), t["floor"].to_numpy(), t["block"].to_numpy() == t["pair"][0].as_py() // total
        both = _nearest_both(i[low], m[low], floor[low], i[~low], m[~low], floor[~low], k) if low.any() and not low.all() else ()
        found = [pa.table(dict(zip(("src", "dst", "cos"), e))) for e in both]
        return pa.concat_tables([_NONE.rename_columns(["src", "dst", "cos"]), *found])

    copies = met.select("idx", "vec", "block", "floor").mapInArrow(sent, "pair long, idx long, vec array<float>, block long, floor double")
    if watch is not None:
        copies = copies.observe(watch, F.count("*").alias("sent"), F.max(F.lit(n * (total - 1))).alias("possible"))
    across = copies.groupBy("pair").applyInArrow(together, "src long, dst long, cos float")
    inside = met.select(F.col("idx").alias("src"), F.explode(F.arrays_zip("dst", "cos")).alias("e")).select("src", "e.dst", "e.cos")
    return ranked(inside.union(across), F.col("cos"), k)


def with_cosine(pairs: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """pairs (i, j, ...) with emb_cos float, null where an end has no vector.

    A pair goes to the task of its ends' two blocks and carries no vector; a vector goes there once, however many of its
    pairs do. So what is exchanged for a pair does not grow with the vectors' width, and a note with very many pairs is
    spread over as many tasks as there are blocks.
    """
    importable(vectors.sparkSession)
    about = Observation()
    v = vectors.where("vec is not null").select(F.col("idx").cast("long").alias("idx"), F.col("vec").cast("array<float>").alias("vec"))
    v = written(v.observe(about, F.count("*").alias("n")), "pair-vectors")
    n = max(1, -(-about.get.get("n", 0) // block))
    own = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n))
    routed = pairs.withColumn("_key", F.least(own("i"), own("j")) * n + F.greatest(own("i"), own("j")))
    wanted = routed.select(F.col("_key").alias("_to"), F.explode(F.array(F.col("i").cast("long"), F.col("j").cast("long"))).alias("idx")).distinct().join(v, "idx")

    def meet(p: pa.Table, w: pa.Table) -> pa.Table:
        cos, there = np.zeros(p.num_rows, np.float32), np.zeros(p.num_rows, bool)
        if w.num_rows:
            w = w.sort_by("idx")
            ids, m = w["idx"].to_numpy(), _matrix(w["vec"])
            ends = [np.minimum(np.searchsorted(ids, e), len(ids) - 1) for e in (p["i"].to_numpy(), p["j"].to_numpy())]
            there = (ids[ends[0]] == p["i"].to_numpy()) & (ids[ends[1]] == p["j"].to_numpy())
            for at in range(0, len(cos), ROWS):
                x, y = (m[e[at : at + ROWS]] for e in ends)
                cos[at : at + ROWS] = np.einsum("ij,ij->i", x, y)
        return p.drop_columns(["_key"]).append_column("emb_cos", pa.array(cos, pa.float32(), mask=~there))

    schema = T.StructType([*pairs.schema.fields, T.StructField("emb_cos", T.FloatType())])
    return routed.groupBy("_key").cogroup(wanted.groupBy("_to")).applyInArrow(meet, schema)
