"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Every string of LENGTH bytes has an anchor: the leftmost smallest hash among the GRAM-byte strings that
start in its first LENGTH - GRAM + 1 bytes. It depends on the string's bytes alone, so equal strings
meet at equal anchors, and only the suffixes at anchors (about one in 69) need sorting:

1. Texts are brought together by digest, so copies count once, and written in buckets.
2. Anchors whose hash occurs once in the corpus are dropped (their strings can't repeat).
3. Each task sorts the suffixes at its remaining anchors into runs, front-codes them (length of the
   prefix shared with the suffix before, then the rest) and sends each range of keys to its partition.
   A key starts with the anchor's hash, so equal ranges of hashes hold equal shares without sampling.
4. A partition merges its runs with a loser tree that keeps, at each node, how long a prefix is known
   to be shared, and compares from there on. The merge yields the common prefix of neighbours.
5. Suffixes sharing a whole anchor are compared to the left as well; a string repeats if some other
   occurrence agrees on both sides of the anchor over LENGTH bytes together. Nothing rests on hashes alone.

An anchor of over HOT occurrences is split: each string that it serves is sorted as a suffix of its own, under a
hash of all its bytes, so contexts that differ never meet, and of equal strings one goes on from each run. The others
are known to repeat, and so is that one; their starts go back as spans, joined where they touch, and the merge tells only
strings that a run has once, so a hot anchor costs no row a string.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import drop_path, partition_id, partitions, scratch, settled, small, table, written

LENGTH, GRAM = 200, 64
#: Texts are hashed in groups of about so many bytes; longer texts in overlapping segments.
GROUP, SEGMENT = 1 << 18, 1 << 23
#: Bytes of suffixes a task sorts into one run, and of texts a range of the merge stands for.
RUN, RANGE = 48 << 20, 256 << 20
#: Anchors a task holds at once, and occurrences of one above which it is split.
HELD, HOT = 1 << 22, 1 << 16
#: Hashes of hot anchors that are broadcast at most.
BROADCAST = 1 << 20
_MULT, _MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, GROUP)
        inverse = pow(_MULT, -1, 1 << 64)
        for name, base in (("up", _MULT), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of the texts data[starts:ends]: (text, anchor, first start, last start, hash), positions in `data`.

    An anchor serves the strings that start from `first start` to `last start`.
    """
    empty = tuple(np.empty(0, np.int64) for _ in range(4))
    if len(data) < length:
        return *empty, np.empty(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    rank = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equal ones
    at = (_sliding_min(rank, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int64)
    has = ends - starts >= length
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, ends[has] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]))
    a = at[s]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(s) != 1)])) if len(s) else s
    last = np.concatenate([new[1:], [len(s)]])[: len(new)] - 1
    # Anchors' hashes are small, as they are minima; an odd factor spreads them over all 64 bits again.
    return np.searchsorted(starts, s[new], "right") - 1, a[new], s[new], s[last], h[a[new]] * np.uint64(_MULT)


def _grouped(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into groups: (bytes, starts, ends, number of the text, its offset), long ones cut with overlap."""
    held, size = [], 0

    def group() -> tuple:
        ends = np.cumsum([len(p) for _, _, p in held])
        return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.concatenate([[0], ends[:-1]]), ends, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])

    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            part = t[off : off + SEGMENT + LENGTH - 1] if len(t) > SEGMENT else t
            if len(part) >= LENGTH:
                held.append((i, off, part))
                size += len(part)
            if size >= GROUP:
                yield group()
                held, size = [], 0
    if held:
        yield group()


def _found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, anchor, first start, last start, hash) with positions in the texts."""
    for data, starts, ends, number, offset in _grouped(texts):
        t, a, lo, hi, h = anchors(data, starts, ends)
        shift = offset[t] - starts[t]
        yield number[t], a + shift, lo + shift, hi + shift, h


# 1. Distinct texts -----------------------------------------------------------------------------


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of each task's copies of a text."""
    seen: set[bytes] = set()
    for b in batches:
        new = [not (k in seen or seen.add(k)) for k in b.column(0).to_pylist()]
        yield b.filter(pa.array(new, pa.bool_()))


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_once, and a lane that tells texts apart whose 64-bit uid is equal."""
    lanes: dict[int, int] = {}
    for b in _once(batches):
        lane = []
        for u in b.column(1).to_pylist():
            lane.append(lanes.get(u, 0))
            lanes[u] = lane[-1] + 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lane, pa.int32()), b.column(2)], names=["key", "uid", "lane", "t"])


def buckets(size: int, least: int, most: int) -> int:
    """How many buckets texts of `size` bytes are written in."""
    return min(max(least, -(-size // RANGE)), max(least, most))


def distinct_texts(docs: DataFrame, text_col: str, name: str, path: str) -> DataFrame:
    """Each different text once: (key SHA-256, uid its first 8 bytes, lane, t binary), as table `name` in buckets by uid.

    Buckets grow in number with the bytes, up to as many as Spark allows a table.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")).cast("long"))).first()[0] or 0
    n = buckets(size, partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    t = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t")).where(F.octet_length("t") >= LENGTH)
    t = t.select(F.unhex(F.sha2("t", 256)).alias("key"), "t")
    t = t.select("key", F.conv(F.hex(F.substring("key", 2, 7)), 16, 10).cast("long").alias("uid"), "t")
    t = t.mapInArrow(_once, "key binary, uid long, t binary").repartition(n, "uid").mapInArrow(_numbered, "key binary, uid long, lane int, t binary")
    t.write.option("path", path).option("compression", "zstd").bucketBy(n, "uid").saveAsTable(name)
    return spark.table(name)


# 2. Anchors that occur twice ---------------------------------------------------------------------


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, known, uid, h, n) for a task's anchors.

    An anchor that the task meets once among HELD goes out by its hash. One that it meets more often is known to
    repeat: it goes straight back to its texts, and a single row tells other tasks how often it was met, so a hash that
    every text has still makes only one row for each HELD anchors.
    """
    parts, held = [], 0
    for b in small(batches, 1):
        uid = b.column(0).to_numpy()
        for t, _, _, _, h in _found([x.as_py() for x in b.column(1)]):
            parts.append((h.view(np.int64), uid[t]))
            held += len(h)
            if held >= HELD:
                yield from _told(*(np.concatenate(c) for c in zip(*parts)))
                parts, held = [], 0
    if parts:
        yield from _told(*(np.concatenate(c) for c in zip(*parts)))


def _told(h: np.ndarray, uid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of _anchor_rows for some anchors and their texts."""
    order = np.argsort(h, kind="stable")
    h, uid = h[order], uid[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0]))
    n = np.diff(np.concatenate([first, [len(h)]]))
    many = np.repeat(n > 1, n)
    one, rep = ~many, first[n > 1]
    pairs = np.unique(np.stack([uid[many], h[many]], 1), axis=0) if many.any() else np.empty((0, 2), np.int64)
    w = np.concatenate([h[one], h[rep], pairs[:, 0]])
    known = np.concatenate([np.zeros(one.sum() + len(rep), bool), np.ones(len(pairs), bool)])
    u = np.concatenate([uid[one], np.zeros(len(rep), np.int64), pairs[:, 0]])
    hs = np.concatenate([h[one], h[rep], pairs[:, 1]])
    count = np.concatenate([np.ones(one.sum(), np.int64), n[n > 1], np.zeros(len(pairs), np.int64)])
    for i in range(0, len(w), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (w, known, u, hs, count)], names=["w", "known", "uid", "h", "n"])


def repeated_anchors(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(uid, hs, hot): for each text with any, the anchor hashes that occur at two places or more, and those met over `hot` times."""
    rows = texts.select("uid", "t").mapInArrow(_anchor_rows, "w long, known boolean, uid long, h long, n long")
    total = rows.withColumn("total", F.sum("n").over(Window.partitionBy("w", "known")))
    found = written(total.where("known or total >= 2").select("uid", "h", "n", "total"), "anchors")  # known ones have n = 0
    many = written(found.where(F.col("total") > hot).select("h").distinct().withColumn("hot", F.lit(True)), "hot")
    kept, n = found.where("n < 2").select("uid", "h"), many.count()
    kept = kept.join(F.broadcast(many) if n <= BROADCAST else many, "h", "left") if n else kept.withColumn("hot", F.lit(None).cast("boolean"))
    return kept.groupBy("uid").agg(F.collect_list("h").alias("hs"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))  # as many as the text's own anchors


# 3. Sorted runs --------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)


#: key (hash, then the bytes from the anchor on), bytes before the anchor back to the first start, distance
#: from the anchor to the last start, uid (TOLD if its own starts are known to repeat), position (lane in the high bits).
Suffix = tuple[bytes, bytes, int, int, int]
TOLD = -1


def front_code(run: list[Suffix]) -> bytes:
    """A sorted run as shared prefix lengths and remainders, compressed."""
    lcp, tails, prev = [], [], b""
    for s in run:
        k = shared(prev, s[0])
        lcp.append(k)
        tails.append(s[0][k:])
        prev = s[0]
    cols = [
        np.array(lcp, "<u2"), np.array([len(t) for t in tails], "<u2"), np.array([len(s[1]) for s in run], "<u2"),
        np.array([s[2] for s in run], "<u2"), np.array([s[3] for s in run], "<i8"), np.array([s[4] for s in run], "<i8"),
    ]
    body = b"".join(c.tobytes() for c in cols) + b"".join(tails) + b"".join(s[1] for s in run)
    return len(run).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def decode(data: bytes) -> Iterator[tuple[int, Suffix]]:
    """(shared prefix length, suffix) in order."""
    n = int.from_bytes(data[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(data[4:])
    lcp, tail, left, near = (np.frombuffer(body, "<u2", n, 2 * n * i).tolist() for i in range(4))
    uid, pos = (np.frombuffer(body, "<i8", n, 8 * n + 8 * n * i).tolist() for i in range(2))
    at, prev = 24 * n, b""
    behind = at + sum(tail)
    for i in range(n):
        prev = prev[: lcp[i]] + body[at : at + tail[i]]
        yield lcp[i], (prev, body[behind : behind + left[i]], near[i], uid[i], pos[i])
        at += tail[i]
        behind += left[i]


def coalesced(spans: np.ndarray) -> np.ndarray:
    """(uid, lo, hi) rows with those of one text that overlap or touch as one, in order; lanes, in the high bits, stay apart."""
    uid, lo, hi = spans[np.lexsort((spans[:, 1], spans[:, 0]))].T
    if not len(uid):
        return spans
    text = np.flatnonzero(np.concatenate([[True], np.diff(uid) != 0]))
    upto = np.concatenate([np.maximum.accumulate(part) for part in np.split(hi, text[1:])])
    new = np.concatenate([[True], (np.diff(uid) != 0) | (lo[1:] > upto[:-1] + 1)])
    return np.stack([uid[new], lo[new], upto[np.concatenate([new[1:], [True]])]], 1)


def _runs(ranges: int):
    """Texts with their repeated anchors' hashes to front-coded sorted runs, one for each range of hashes met."""

    def coded(held: list[Suffix]) -> pa.RecordBatch:
        held.sort()
        run, known, last = [], [], None
        for s in held:  # of suffixes equal on both sides one goes on, the rest are known to repeat
            if last and s[:3] == last[:3]:
                known += [(x[3], x[4] - len(x[1]), x[4] - x[2]) for x in ((s,) if equal else (last, s))]
                run[-1], equal = (*last[:3], TOLD, 0), True
            else:
                run.append(s)
                last, equal = s, False
        to = [int.from_bytes(s[0][:4]) * ranges >> 32 for s in run]
        cut = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(run)]
        pairs = [(to[i], front_code(run[i:j]), False) for i, j in zip(cut, cut[1:]) if i < j]
        if known:
            pairs.append((partition_id() % ranges, zstandard.ZstdCompressor(level=1).compress(coalesced(np.array(known, "<i8")).tobytes()), True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs), (pa.int32(), pa.binary(), pa.bool_()))], names=["range", "run", "known"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in small(batches, 2):
            uid, lane = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [x.as_py() for x in b.column(2)]
            wanted = [np.sort(np.array(x, np.int64)) for x in b.column(3).to_pylist()]
            hot = [set(x) for x in b.column(4).to_pylist()]
            for number, a, lo, hi, h in _found(texts):
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(number) != 0]))
                for i, j in zip(cuts, [*cuts[1:], len(number)]):
                    k = int(number[i])
                    t, want, mine = texts[k], wanted[k], h[i:j].view(np.int64)
                    at = np.minimum(np.searchsorted(want, mine), len(want) - 1)
                    for m in (np.flatnonzero(want[at] == mine) + i).tolist():
                        p, first, last = int(a[m]), int(lo[m]), int(hi[m])
                        if hot[k] and int(h[m : m + 1].view(np.int64)[0]) in hot[k]:
                            for s in range(first, last + 1):
                                one = t[s : s + LENGTH]
                                held.append((xxhash.xxh64_digest(one) + one, b"", 0, uid[k], lane[k] << 48 | s))
                            size += (last + 1 - first) * (LENGTH + 200)
                            if size >= RUN:
                                yield coded(held)
                                held, size = [], 0
                            continue
                        held.append((int(h[m]).to_bytes(8) + t[p : last + LENGTH], t[first:p], p - last, uid[k], lane[k] << 48 | p))
                        size += 200 + last - first
                if size >= RUN:
                    yield coded(held)
                    held, size = [], 0
        if held:
            yield coded(held)

    return run


# 4. Merge ---------------------------------------------------------------------------------------


def merge(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Merge sorted front-coded runs by a loser tree: (prefix length shared with the one before, suffix) in order.

    Every contender carries how long a prefix it shares with the last winner. Of two, the one that shares more
    comes first; only when both share equally much are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[Suffix | None] = []
    for r in runs:
        x = next(r, None)
        heads.append(x[1] if x else None)
    heads += [None] * (k - len(heads))
    loser, known = [0] * k, [0] * k  # of inner nodes 1..k-1

    def play(a: int, ka: int, b: int, kb: int) -> tuple[int, int, int, int]:
        """(winner, its known prefix, loser, its known prefix)"""
        x, y = heads[a], heads[b]
        if y is None:
            return a, ka, b, kb
        if x is None or ka < kb:
            return b, kb, a, ka
        if ka > kb:
            return a, ka, b, kb
        s = shared(x[0], y[0], ka)
        return (a, ka, b, s) if x[0][s:] <= y[0][s:] else (b, kb, a, s)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, ka = build(2 * node)
        b, kb = build(2 * node + 1)
        w, kw, loser[node], known[node] = play(a, ka, b, kb)
        return w, kw

    top, have = build(1)
    while heads[top] is not None:
        yield have, heads[top]
        x = next(runs[top], None)
        have, heads[top] = (x[0], x[1]) if x else (0, None)
        node = top + k >> 1
        while node:
            h = known[node]
            if h > have or heads[top] is None or h == have:  # else the contender stays
                top, have, loser[node], known[node] = play(top, have, loser[node], h)
            node >>= 1


# 5. Repeats -------------------------------------------------------------------------------------


def _suffix(a: bytes, b: bytes) -> int:
    """Length of the common suffix."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = a[-n:], b[-n:]
    if x == y:
        return n
    d = int.from_bytes(x) ^ int.from_bytes(y)
    return ((d & -d).bit_length() - 1) >> 3


def repeats(group: list[Suffix], right: list[int]) -> Iterator[tuple[int, int, int]]:
    """(uid, first start, last start) of the strings that repeat among suffixes of one anchor.

    `right` has the bytes each shares with the one before, from the anchor on.
    """
    m = len(group)
    if m <= 16:
        for i in range(m):
            _, left, near, uid, pos = group[i]
            spans = []
            for step in (-1, 1):
                r, j = LENGTH, i + step
                while 0 <= j < m:
                    r = min(r, right[j + 1] if step < 0 else right[j])
                    if LENGTH - r > len(left):
                        break
                    lo, hi = max(near, LENGTH - r), _suffix(left, group[j][1])
                    if lo <= hi:
                        spans.append((lo, hi))
                        if lo == near and hi == len(left):
                            break
                    j += step
            for lo, hi in spans:
                yield uid, pos - hi, pos - lo
        return
    # Many: for each distance to the anchor, classes of equal bytes on either side, by sorting once.
    lefts = [s[1][::-1] for s in group]
    order = sorted(range(m), key=lefts.__getitem__)
    common = np.array([0, *(shared(lefts[a], lefts[b]) for a, b in zip(order, order[1:]))])
    order, r = np.array(order), np.array(right)
    r[0] = 0
    far, near = np.array([len(x) for x in lefts]), np.array([s[2] for s in group])
    start = np.full(m, -1)
    uid, pos = [s[3] for s in group], [s[4] for s in group]
    for d in range(int(near.min()), int(far.max()) + 2):
        hit = np.zeros(m, bool)
        if d <= far.max():
            code = np.empty(m, np.int64)
            code[order] = np.cumsum(common < d)
            code = code * (m + 1) + np.cumsum(r < LENGTH - d)
            live = np.flatnonzero((near <= d) & (d <= far))
            _, back, n = np.unique(code[live], return_inverse=True, return_counts=True)
            hit[live[n[back] > 1]] = True
        for i in np.flatnonzero(~hit & (start >= 0)).tolist():
            yield uid[i], pos[i] - d + 1, pos[i] - int(start[i])
            start[i] = -1
        start[hit & (start < 0)] = d


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one range (all of a partition's rows) to spans of string starts (uid, lo, hi)."""
    runs: dict[int, list[bytes]] = {}
    for b in batches:
        for to, data, known in zip(*(c.to_pylist() for c in b.columns)):
            if known:
                spans = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in spans], names=["uid", "lo", "hi"])
            else:
                runs.setdefault(to, []).append(data)
    out: list[tuple[int, int, int]] = []

    def flush() -> pa.RecordBatch:
        found = np.array(out, np.int64).reshape(-1, 3)
        cols = coalesced(found[found[:, 0] != TOLD]).T
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["uid", "lo", "hi"])

    for to in sorted(runs):
        group, right = [], []
        for n, s in merge([decode(d) for d in runs.pop(to)]):
            if n < 8 + GRAM:  # another hash or another anchor
                if len(group) > 1:
                    out += repeats(group, right)
                group, right = [], []
            group.append(s)
            right.append(max(0, n - 8))
            if len(out) > 1 << 16:
                yield flush()
        if len(group) > 1:
            out += repeats(group, right)
        if out:
            yield flush()


def repeated_starts(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(uid, spans of (lo, hi)): starts of the strings of LENGTH bytes that start elsewhere too; the lane is in the high bits.

    Ranges grow in number with the texts, so that a task's runs don't grow with them.
    """
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(partitions(texts.sparkSession), -(-size // RANGE))
    runs = texts.join(repeated_anchors(texts, hot).hint("shuffle_hash"), "uid").select("uid", "lane", "t", "hs", "hot").mapInArrow(_runs(n), "range int, run binary, known boolean")
    found = runs.repartitionById(n, F.col("range")).mapInArrow(_merged, "uid long, lo long, hi long")
    return found.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their repeated starts to (key, kept, spans)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in small(batches, 2):
        kept, text, spans = [], [], []
        for lane, t, found in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            t, merged = t.as_py(), []
            for lo, hi in sorted((x["lo"] & (1 << 48) - 1, x["hi"] & (1 << 48) - 1) for x in found or () if x["lo"] >> 48 == lane):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi + LENGTH)
                else:
                    merged.append([lo, hi + LENGTH])
            edges = [0, *(e for s in merged for e in s), len(t)]
            kept.append(b"".join(t[i:j] for i, j in zip(edges[::2], edges[1::2])))
            text.append(kept[-1].decode("utf-8", "ignore"))
            spans.append([{"start": i, "end": j} for i, j in merged])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(text, pa.string()), pa.array(spans, kind)], names=["key", "kept", "text", "spans"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """(id, *keep, n_bytes, kept binary, spans): every row's UTF-8 bytes without those covered by a repeated string.

    A string of LENGTH bytes repeats if it also starts anywhere else in the input, in the same row or another;
    strings don't cross rows. `spans` are the maximal removed runs (start, end). Null texts are empty ones, rows
    of equal text of at least LENGTH bytes are removed whole, shorter texts are kept, and null or repeated ids are
    of no account. `derive` names columns to compute from kept, spans and text (what is left, without the halves of
    cut characters) where they lie; they then stand in place of kept and spans, which needn't move. Columns other than
    the id, the text and `keep` (of any name) are ignored. An empty table gives no rows.
    """
    spark, t = docs.sparkSession, F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    size = F.octet_length(t).cast("long")
    sources = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), sources.alias("carried"), size.alias("n_bytes"), F.unhex(F.sha2(t, 256)).alias("key"), F.when(size < LENGTH, t).otherwise(F.lit(b"")).alias("kept"))
    extra = derive or {"kept": F.col("kept"), "spans": F.col("spans")}

    def make(name: str, path: str) -> DataFrame:
        texts = distinct_texts(docs, text_col, name, path)
        spans = written(repeated_starts(texts, hot), "repeats")
        cut = texts.join(spans.hint("shuffle_hash"), "uid", "left").select("key", "lane", "t", "spans").mapInArrow(_cut, "key binary, kept binary, text string, spans array<struct<start:bigint,end:bigint>>")
        copies = rows.where(F.col("n_bytes") >= LENGTH).groupBy("key").agg(F.count("*").alias("copies"))
        return cut.select("key", F.struct(*(c.alias(n) for n, c in extra.items())).alias("found")).join(copies.where("copies = 1").select("key"), "key")

    table_name, path = f"texts_{uuid.uuid4().hex}", scratch(spark, "texts")
    try:
        own = settled(spark, lambda: make(table_name, path), "own")  # texts that occur once
    finally:  # the bucketed table is of this call only
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        drop_path(spark, path)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    rest = rows.withColumn("text", F.col("kept").cast("string")).withColumn("spans", F.when(F.col("n_bytes") < LENGTH, none).otherwise(whole))  # right for short texts and copies
    rest = rest.select("id", "carried", "n_bytes", "key", F.struct(*(c.alias(n) for n, c in extra.items())).alias("usual"))
    out = rest.join(own, "key", "left")
    got = F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.col("usual"))
    return out.select("id", *(F.col("carried")[c].alias(c) for c in keep), "n_bytes", *(got[n].alias(n) for n in extra))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 200-byte repeats cover, removed: digests a document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    derive = {"n_removed": removed, "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}
    return suffix_dedup(table(spark, sf_dir, "documents"), derive=derive).withColumnRenamed("id", "doc_id")
