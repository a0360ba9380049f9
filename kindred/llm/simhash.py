"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two 32-bit segments. Two fingerprints within 3 bits agree to
within 1 bit in one of them, so each fingerprint is filed under its two segment values and looks up
the Hamming ball of radius 1 around each. A pair that differs by one bit in a segment is met from
the side whose bit is set, so only downward flips are enumerated: about 34 short rows a fingerprint,
however many there are. Entries meet by a shuffle on the segment value; complete distances are
verified there, and each meeting emits a spanning forest of its links, never all pairs.

For similarities well below those of 3 bits (`wide_*`, the pipeline's stage) fingerprints are wider: SKETCH bits whose
distance is verified, and as many further segments, of a width that the corpus sets, as a pair at the similarity needs to
agree in one of them. There more segments reach a pair with fewer entries than balls around them, so their radius is 0.
The members of a large group share values of many segments, so links are taken from the first EARLY segments, and the others
only tell links between what those leave apart: a text has a few links, however many segments there are and however large its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import components, partitions, settled, table, written

RADIUS = 3
#: Fingerprints under one segment value above which they meet in pairs of blocks.
BLOCK = 4096
#: Hot segment values (16 bytes each) up to which they are broadcast.
BROADCAST = 1_000_000
#: Wide fingerprints: verified bits, the distance up to which they link, and the share of bits that differ at a similarity
#: of 0.8, the highest of all set sizes (0.150 for large sets, 0.157 for 13 and 14 shingles).
SKETCH, WIDE_RADIUS, FLIP = 128, 39, 0.1575
#: Share of pairs at that similarity that may agree in no segment, and fingerprints that share a segment's value by chance.
LOSS, CROWD = 1e-5, 256
#: Segments from which links are taken first; see wide_links().
EARLY = 8


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is set if it is in over half the shingles' XXH64.

    No words: 0. Fewer than `words` words: one shingle of them all.
    """
    w = text.lower().split() if text else []
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    digest = xxhash.xxh64_intdigest
    total, n, step = np.zeros(64, np.int64), len(w) - words + 1, 1 << 16
    for at in range(0, n, step):  # bounded memory for very long texts
        part = w[at : at + step + words - 1]
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(words))))], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long, digest long, of the exact text) of every whole text; null and blank texts have fingerprint 0.

    Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["id", "fp", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("digest")).mapInArrow(run, f"id {kind}, fp long, digest long")


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """File each fingerprint under both segments and enumerate the downward ball around each."""
    for b in batches:
        fp = b.column(0).to_numpy().astype(np.int64)
        for s in range(2):
            seg = (fp.view(np.uint64) >> np.uint64(32 * s) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            base = np.int64(s) << 32
            rows = [(base | seg, fp, np.ones(len(fp), bool))]
            for j in range(32):
                hit = (seg >> j & 1).astype(bool)
                rows.append((base | seg[hit] ^ (np.int64(1) << j), fp[hit], np.zeros(int(hit.sum()), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["key", "fp", "filed"])


def _forest(filed: np.ndarray, arrived: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links that touch a filed fingerprint, by breadth-first search.

    All are distinct. Two that arrived are never compared: they meet under another segment value.
    """
    filed, arrived, out, todo = filed.astype(np.uint64), arrived.astype(np.uint64), [], []
    while len(filed) or todo:
        if not todo:
            todo.append((filed[0], True))
            filed = filed[1:]
        x, own = todo.pop()
        near = np.bitwise_count(filed ^ x) <= radius
        if near.any():
            out += [(int(x), int(y)) for y in filed[near]]
            todo += [(y, True) for y in filed[near]]
            filed = filed[~near]
        if own:
            near = np.bitwise_count(arrived ^ x) <= radius
            if near.any():
                out += [(int(x), int(y)) for y in arrived[near]]
                todo += [(y, False) for y in arrived[near]]
                arrived = arrived[~near]
    return out


def _meet(radius: int):
    """Groups of equal (key, part), sorted, to links; a group may run over batches."""

    def links(fp: list[np.ndarray], filed: list[np.ndarray]) -> list[tuple[int, int]]:
        fps, own = np.concatenate(fp), np.concatenate(filed)
        if len(fps) < 2 or not own.any():
            return []
        return _forest(np.unique(fps[own]).view(np.uint64), np.unique(fps[~own]).view(np.uint64), radius)

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        p = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_filed = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key, part, fp, filed = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            pairs = []
            if held and last != (key[0], part[0]):
                pairs += links(held, held_filed)
                held, held_filed = [], []
            held.append(fp[: end[0]])
            held_filed.append(filed[: end[0]])
            if len(start) > 1:  # all but the last group end here
                pairs += links(held, held_filed)
                n_filed = np.add.reduceat(filed.astype(np.int64), start)
                for g in np.flatnonzero((n_filed > 0) & (end - start > 1)).tolist():
                    if 0 < g < len(start) - 1:
                        pairs += links([fp[start[g] : end[g]]], [filed[start[g] : end[g]]])
                held, held_filed = [fp[start[-1] :]], [filed[start[-1] :]]
            last = (key[-1], part[-1])
            if pairs:
                yield out(pairs)
        if held:
            yield out(links(held, held_filed))

    return run


def hot_keys(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, n): segment values under which over `block` fingerprints are filed or arrive, and the blocks to deal them to.

    A value gets what is filed under its up to 32 upper neighbours. Those with up to block / 32 send it no more than a block
    together, so only the others are counted out, from one row a segment value.
    """
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    filed = fps.select(F.explode(F.array(low, high)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    heavy = filed.where(F.col("n") > block // 32)
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.pow(F.lit(2.0), j).cast("long")), lambda bit: F.col("key").bitwiseAND(bit) != 0)
    sent = heavy.select(F.explode(F.transform(flips, lambda bit: F.col("key").bitwiseXOR(bit))).alias("key"), "n")
    total = heavy.union(sent).groupBy("key").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("n"))


def _in_parts(e: DataFrame, hot: DataFrame, broadcast: int) -> DataFrame:
    """Entries with the parts they meet in: 0, or for the `hot` keys, dealt to n blocks, every pair of blocks with their own; and sides()."""
    rows = hot.count()
    if not rows:
        return e.withColumn("part", F.lit(0)).withColumn("side", F.lit(0))
    e = e.join(F.broadcast(hot) if rows <= broadcast else hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    e = e.withColumn("part", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(parts(own, F.col("n")))))
    return e.withColumn("side", F.when(F.col("n").isNull(), 0).otherwise(sides(F.col("part"), own, F.col("n"))))


def parts(own: Column, n: Column) -> Column:
    """The parts in which block `own` of n meets each block, itself included."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(j, own) * n + F.greatest(j, own))


def sides(part: Column, own: Column, n: Column) -> Column:
    """1 or 2 for the two blocks that meet in a part, 0 where a block meets itself."""
    low, high = F.floor(part / n), part % n
    return F.when(low == high, 0).when(own == high, 2).otherwise(1)


def link(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) as all pairs within `radius` bits (at most 3) would.

    A segment value under which more than `block` fingerprints meet is split: its entries go to blocks by hash,
    and every pair of blocks meets in a task of its own.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 cover at most 3 bits")
    e = fps.select("fp").mapInArrow(_entries, "key long, fp long, filed boolean")
    hot = written(hot_keys(fps, block), "hot")
    e = _in_parts(e, hot, broadcast).select("key", "part", "fp", "filed")
    n = partitions(fps.sparkSession)
    return e.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_meet(radius), "a long, b long")


def wide_plan(n: int) -> tuple[int, int]:
    """(width, number) of the segments for n fingerprints: wide enough that at most CROWD share a value by chance, so many that LOSS holds."""
    width = max(10, math.ceil(math.log2(max(n, 1) / CROWD)))
    return width, math.ceil(math.log(1 / LOSS) / (1 - FLIP) ** width)


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """The SimHash in `words` * 64 bits, as bytes, of a set of shingles' hashes; a constant shingle is added, so small sets tie less."""
    seeds = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = np.concatenate([np.array([0x5851F42D4C957F2D], np.uint64), shingles])
    total = np.zeros(words * 64, np.int64)
    for at in range(0, len(s), 255):  # a byte counts that far
        h = (s[at : at + 255, None] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * total > len(s), bitorder="little")


def _wide_entries(width: int, first: int, last: int):
    """File each fingerprint under the values of its segments from `first` to before `last`."""
    number = last - first
    weights, segment = 1 << np.arange(width, dtype=np.int64), np.arange(first, last, dtype=np.int64) << width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                bits = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                sketch = bits[:, : SKETCH // 8].copy().view(np.int64)
                value = np.unpackbits(bits[:, SKETCH // 8 :], axis=1, count=width * last, bitorder="little").reshape(-1, last, width)[:, first:] @ weights
                cols = ((value | segment).ravel(), *(np.repeat(c, number) for c in (b.column(0).to_numpy(), b.column(1).to_numpy(), sketch[:, 0], sketch[:, 1])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "fp", "name", "s0", "s1"])

    return run


def _groups(sketch: np.ndarray, radius: int) -> np.ndarray:
    """The number of the group of each sketch, as links within the radius make them, by breadth-first search."""
    group, rest, todo, n = np.zeros(len(sketch), np.int64), np.arange(len(sketch)), [], -1
    while len(rest):
        if not todo:
            n += 1
            group[rest[0]], todo = n, [sketch[0]]
            rest, sketch = rest[1:], sketch[1:]
        near = np.bitwise_count(sketch ^ todo.pop()).sum(axis=1) <= radius
        if near.any():
            group[rest[near]] = n
            todo += list(sketch[near])
            rest, sketch = rest[~near], sketch[~near]
    return group


def _least(name: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least name of each row's group."""
    low = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, name)
    return low[group]


def _wide_forest(name: np.ndarray, sketch: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between different names that connect them as all pairs within the radius would: the pairs while they are few, else stars.

    A star is around its least name, so the values that one large group meets under tell mostly the same few links. Where two
    blocks meet, each has its own links from the part where it meets itself, and only links between their groups are told.
    """
    if (name == name[0]).all():
        return []
    across = bool(side.any())
    if len(name) <= 512:
        near = np.triu(np.bitwise_count(sketch[:, None] ^ sketch).sum(axis=2, dtype=np.uint16) <= radius, 1) & (name[:, None] != name)
        x, y = np.nonzero(near & (side[:, None] != side) if across else near)
        if len(x) < len(name):
            return list(zip(name[x].tolist(), name[y].tolist()))
    if across:
        name = name.copy()
        for own in (side == 1, side == 2):
            name[own] = _least(name[own], _groups(sketch[own], radius))
    low = _least(name, _groups(sketch, radius))
    return [(a, b) for a, b in np.unique(np.stack([low, name], 1), axis=0).tolist() if a != b]


def _wide_meet(radius: int):
    """Groups of equal (key, part), sorted, to links; a group may run over batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        pairs: list[tuple[int, int]] = []

        def close() -> None:
            name, sketch, side = (np.concatenate(c) for c in zip(*held))
            if len(name) > 1:
                pairs.extend(_wide_forest(name, sketch, side, radius))
            held.clear()

        def out() -> pa.RecordBatch:
            p = np.unique(np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1), axis=0)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key, part, name, side, s0, s1 = (c.to_numpy() for c in b.columns)
            sketch = np.stack([s0, s1], 1).view(np.uint64)
            cut = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(key)]
            if held and last != (key[0], part[0]):
                close()
            for i, j in zip(cut, cut[1:]):
                held.append((name[i:j], sketch[i:j], side[i:j]))
                if j < len(key):
                    close()
            last = (key[-1], part[-1])
            if len(pairs) > 1 << 16:
                yield out()
        if held:
            close()
        yield out()

    return run


def wide_links(fps: DataFrame, width: int, number: int, radius: int = WIDE_RADIUS, block: int = BLOCK, broadcast: int = BROADCAST, early: int = EARLY) -> DataFrame:
    """Links (a, b) between distinct `fp` that connect them as all pairs would whose wide fingerprints (`bits`) agree in a segment
    and differ by `radius` bits of SKETCH at most.

    The first `early` segments' links make components; under the others' values fingerprints go by their component's name, so
    only links between components are told. A value of over `block` fingerprints is split into blocks that meet in pairs.
    """
    early = min(early, number)
    fps = written(fps.select("fp", F.col("fp").alias("name"), "bits"), "wide")

    def entries(rows: DataFrame, first: int, last: int) -> DataFrame:
        return rows.mapInArrow(_wide_entries(width, first, last), "key long, fp long, name long, s0 long, s1 long")

    counts = entries(fps, 0, number).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = written(counts.select("key", F.ceil(F.col("n") / block).cast("int").alias("n")), "hot")

    def met(rows: DataFrame, first: int, last: int) -> DataFrame:
        e = _in_parts(entries(rows, first, last), hot, broadcast).select("key", "part", "name", "side", "s0", "s1")
        return e.repartition(partitions(fps.sparkSession), "key", "part").sortWithinPartitions("key", "part").mapInArrow(_wide_meet(radius), "a long, b long")

    known = written(components(written(met(fps, 0, early), "early")), "known")
    named = fps.drop("name").join(known, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("name"), "bits")
    return known.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(met(named, early, number))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """(id, fp long, component, digest long): the group each row falls in, as the smallest id that links reach.

    `root` tells groups apart that have the same smallest id because different texts have it.

    Fingerprints link at `radius` or fewer differing bits; equal ones always do, those of empty and
    null texts (0) included. Repeated rows stay, null ids never name a component unless the whole
    component has none, and further columns of `docs` are ignored.
    """

    def make() -> DataFrame:
        fp = written(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
        each = written(fp.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
        comp = components(written(link(each, radius), "links"))
        named = each.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
        roots = named.groupBy("root").agg(F.min("low").alias("component"))
        return fp.join(named.select("fp", "root").join(roots, "root").select("fp", "component", "root"), "fp").select("id", "fp", "component", "digest", "root")

    return settled(docs.sparkSession, make, "groups")


def firsts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of `docs` for each group in `found` (id, digest of the exact text, component, root), and those without an id.

    Rows are told apart by id and text, so different texts under one id are judged each by itself. Of the rows whose id
    names their group one stays: that of the smallest digest, of rows equal in this too the first by its JSON.
    """
    named = found.where("id = component").groupBy("root", "id", "digest").agg(F.count("*").alias("n"))
    first = written(named.groupBy("root", "id").agg(F.min_by("n", "digest").alias("n"), F.min("digest").alias("digest")), "first")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.struct("*").alias("row"))
    kept = rows.join(first.where("n = 1").select("id", "digest"), ["id", "digest"], "left_semi").select("row.*")
    if not first.where("n > 1").isEmpty():
        same = rows.join(first.where("n > 1").select("id", "digest"), ["id", "digest"], "left_semi")
        kept = kept.union(same.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return kept.union(docs.where(F.col(id_col).isNull()))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of `docs`, whole, that are the first (smallest id) of their near-duplicate group.

    Different texts under one id are judged each by itself, of equal rows one stays, and rows without an
    id name no group and stay. An empty table gives no rows; columns of any name are carried along.
    """
    return firsts(docs, near_duplicates(docs, id_col, text_col, **kw), id_col, text_col)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
