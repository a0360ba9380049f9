"""A token file format coded with static range asymmetric numeral systems (rANS).

A coder with 64-bit states and 32-bit words codes ids under one frequency table that all files share.
Blocks of 2^19 ids are independent; within one, up to 2048 states are interleaved, so that numpy
advances them together. A file holds

    magic, length and JSON of the header (zlib), blocks, footer (zlib), length of the footer, magic

and its footer lists a checkpoint for each block (offset, size, ids before it, ids, CRC-32 of its ids)
and each document's id and length, so any block decodes alone and is checked.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"KRANS\x00\x02\n"
BITS, BLOCK, LANES = 20, 1 << 19, 2048
_ONE = 1 << BITS


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, at least 1 for what occurs; all zero if nothing does."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, counts * _ONE // total), 0).astype(np.int64)
    over = int(f.sum()) - _ONE
    while over > 0:  # rounding up rare ones took too much: take it from the largest
        i = int(f.argmax())
        take = min(over, int(f[i]) - max(1, int(f[i]) // 2))
        f[i] -= take
        over -= take
    f[int(counts.argmax())] -= min(over, 0)
    return f


class Tables:
    """Frequencies, cumulative frequencies and the decoding table made from counts by id."""

    def __init__(self, counts: np.ndarray):
        if len(counts) > _ONE:
            raise ValueError(f"ids must be below {_ONE}")
        f = quantise(counts.astype(np.int64))
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint16 if len(f) <= 1 << 16 else np.uint32), f)
        self.f, self.c = f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)
        self.crc = zlib.crc32(f.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        fs, cs = self.f[ids], self.c[ids]
        limits, bits, word = fs << np.uint64(63 - BITS), np.uint64(BITS), np.uint64(32)
        x, words = np.full(lanes, 1 << 31, np.uint64), []
        for at in range((n - 1) // lanes * lanes, -1, -lanes):
            end = min(n, at + lanes)
            y = x[: end - at]
            full = np.flatnonzero(y >= limits[at:end])
            if len(full):
                words.append(y[full].astype("<u4"))
                y[full] >>= word
            f = fs[at:end]
            q = y // f
            x[: end - at] = (q << bits) + (y - q * f) + cs[at:end]
        return struct.pack("<H", lanes) + x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        (lanes,) = struct.unpack_from("<H", data)
        x = np.frombuffer(data, "<u8", lanes, 2).astype(np.uint64)
        words, at_word = np.frombuffer(data, "<u4", offset=2 + 8 * lanes).astype(np.uint64), 0
        bits, mask, low, word = np.uint64(BITS), np.uint64(_ONE - 1), np.uint64(1 << 31), np.uint64(32)
        out = np.empty(n, np.int64)
        for at in range(0, n, lanes):
            end = min(n, at + lanes)
            y = x[: end - at]
            slot = y & mask
            s = self.symbol[slot]
            y = self.f[s] * (y >> bits) + (slot - self.c[s])
            less = np.flatnonzero(y < low)
            if len(less):
                y[less] = y[less] << word | words[at_word : at_word + len(less)]
                at_word += len(less)
            x[: end - at] = y
            out[at:end] = s
        return out


class Writer:
    """Writes one file; append() documents, then close(). Memory: a block of ids, and 16 bytes a document."""

    def __init__(self, f, tables: Tables, counts: np.ndarray):
        self.f, self.t, self.at = f, tables, 0
        head = zlib.compress(json.dumps({"bits": BITS, "tables_crc32": tables.crc, "counts": counts.tolist()}).encode())
        self._put(MAGIC + struct.pack("<I", len(head)) + head)
        self.held, self.n, self.total, self.blocks, self.docs, self.lengths = [], 0, 0, [], [], []

    def _put(self, data: bytes) -> None:
        self.f.write(data)
        self.at += len(data)

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.int64)
        at = 0
        while len(ids) - at >= BLOCK or last and at < len(ids):
            part = ids[at : at + BLOCK]
            data = self.t.encode(part)
            self.blocks.append((self.at, len(data), self.total, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            self._put(data)
            self.total += len(part)
            at += len(part)
        self.held, self.n = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.docs], bool)
        ids = np.array([0 if d is None else d for d in self.docs], "<i8")
        parts = [np.array(self.blocks, "<i8").reshape(-1, 5).tobytes(), ids.tobytes(), np.packbits(null).tobytes(), np.array(self.lengths, "<i8").tobytes()]
        foot = zlib.compress(struct.pack("<QQ", len(self.blocks), len(self.docs)) + b"".join(parts))
        self._put(foot + struct.pack("<Q", len(foot)) + MAGIC)


class Reader:
    """Reads a file with random access: block() decodes one alone; documents() streams those of some blocks in order."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        size = f.tell()
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token file")
        (n,) = struct.unpack("<Q", tail[:8])
        f.seek(size - 16 - n)
        foot = zlib.decompress(f.read(n))
        f.seek(0)
        head = f.read(12)
        meta = json.loads(zlib.decompress(f.read(struct.unpack("<I", head[8:])[0])))
        self.t = Tables(np.array(meta["counts"], np.int64))
        if head[:8] != MAGIC or self.t.crc != meta["tables_crc32"]:
            raise ValueError("damaged tables")
        n_blocks, n_docs = struct.unpack_from("<QQ", foot)
        at = 16
        self.blocks = np.frombuffer(foot, "<i8", 5 * n_blocks, at).reshape(-1, 5)
        at += 40 * n_blocks
        self.docs = np.frombuffer(foot, "<i8", n_docs, at)
        at += 8 * n_docs
        self.null = np.unpackbits(np.frombuffer(foot, np.uint8, -(-n_docs // 8), at), count=n_docs).astype(bool)
        self.lengths = np.frombuffer(foot, "<i8", n_docs, at + -(-n_docs // 8))

    def block(self, i: int) -> np.ndarray:
        at, size, _, n, crc = self.blocks[i].tolist()
        self.f.seek(at)
        try:
            ids = self.t.decode(self.f.read(size), n)
            good = zlib.crc32(ids.astype("<u4").tobytes()) == crc
        except (IndexError, ValueError, struct.error):
            good = False
        if not good:
            raise ValueError(f"block {i} is damaged")
        return ids

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, ids before it in this file, ids) of documents that start in blocks first to last, in file order.

        Only these blocks are decoded, and those that the last of these documents runs into. Empty documents at the
        file's end belong to its last block.
        """
        ends = np.cumsum(self.lengths)
        starts, begins = ends - self.lengths, self.blocks[:, 2]
        lo = int(begins[first]) if first < len(begins) else int(ends[-1]) if len(ends) else 0
        i = np.searchsorted(starts, lo) if first else 0
        j = np.searchsorted(starts, begins[last]) if last is not None and last < len(begins) else len(starts)
        nxt = max(0, int(np.searchsorted(begins, starts[i], "right")) - 1) if i < j else 0
        held, at = np.empty(0, np.int64), lo
        for k in range(i, j):
            start, n = int(starts[k]), int(self.lengths[k])
            held, at = held[start - at :], start  # what the document before had
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.block(nxt))
                    if not have:  # this block may begin before the document
                        parts[-1] = parts[-1][start - int(begins[nxt]) :]
                    have += len(parts[-1])
                    nxt += 1
                held = np.concatenate(parts)
            yield None if self.null[k] else int(self.docs[k]), start, held[:n]
