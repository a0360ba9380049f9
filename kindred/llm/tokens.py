"""Fast exact encoding with a tokenizers file: a batch's words are encoded once each and remembered.

The library spends its time on a text's repeated words. For the two kinds of files below, texts
split at blanks into chunks that the library would split too, so a chunk's ids don't depend on its
neighbours. Arrow splits a batch and numbers its different chunks; only those are looked up in a bounded
memo, new ones reach the library's model, and the ids of all chunks are gathered by number.
Anything else (another kind of file, runs of white space, unusual characters, the strings of special tokens, which
the library makes their ids) goes to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of remembered pieces above which those that the last batch didn't have are forgotten.
MEMO = 24 << 20
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGN = rf"[^\s0-9{_LETTER}]"
_SIMPLE = re.compile(rf"[\n !-&(-~{_LETTER}]+")
_BYTE_PIECES = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?{_SIGN}+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"[{_LETTER}]+|[0-9]|{_SIGN}+")
#: Chunks that Arrow can cut into pieces, and how: no white space but a leading blank and one or two line ends inside.
_SOLID = rf"[!-&(-~{_LETTER}]+"
_PLAIN = {"byte": rf"^ ?{_SOLID}(?:\n\n?{_SOLID})*$", "word": rf"^{_SOLID}$"}
_CUT = {"byte": rf"\n| ?[{_LETTER}]+| ?[0-9]+| ?{_SIGN}+", "word": rf"[{_LETTER}]+|[0-9]|{_SIGN}+"}
#: A blank that the byte-level pattern may join to white space before it; and what any text with one has.
_JOINED = re.compile(r"\s (?:\s|\Z)")
_PAIRS = r" (?:[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]|$)"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tok.model, _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.kind = None
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.kind, self.pieces = "byte", _BYTE_PIECES
        elif norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": _WORD_SPLIT}:
            self.kind, self.pieces = "word", _WORD_PIECES
        #: Strings that the library takes for a token wherever they stand.
        self.special = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or [])
        if any(t.get("normalized") for t in spec.get("added_tokens") or []):
            self.kind = None
        if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
            self.kind = None
        self.known, self.sizes, self.flat = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, "<u4")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[-1] > " ":
            shown = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk or not _SIMPLE.fullmatch(chunk):
            return self._whole(chunk) if chunk else b""
        return b"".join(map(self._piece, self.pieces.findall(chunk.lower() if self.kind == "word" else chunk)))

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after another) of different pieces, remembered for later batches."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy()
        new = pieces.filter(pa.array(at < 0))
        made = [self._piece(p) if p else b"" for p in new.to_pylist()]
        at = np.where(at < 0, len(self.known) + np.cumsum(at < 0) - 1, at)
        self.known = pa.concat_arrays([self.known, new])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made)) // 4])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])
        sizes, flat = self.sizes[at], _gather(self.sizes, self.flat, at)
        if self.known.nbytes > MEMO:
            few = pieces.nbytes <= MEMO
            self.known, self.sizes, self.flat = (pieces, sizes, flat) if few else (pieces[:0], sizes[:0], flat[:0])
        return sizes, flat

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after another) of different chunks."""
        plain = pc.match_substring_regex(chunks, _PLAIN[self.kind])
        cut = pc.utf8_lower(chunks.filter(plain)) if self.kind == "word" else chunks.filter(plain)
        parts = pc.split_pattern(pc.replace_substring_regex(cut, f"({_CUT[self.kind]})", r"\1" + "\0"), "\0")
        coded = parts.flatten().dictionary_encode()
        sizes, flat = self._look_up(coded.dictionary)
        codes = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[parts.offsets.to_numpy()]
        plain = plain.to_numpy(zero_copy_only=False)
        odd = [self._chunk(c) for c in chunks.filter(pa.array(~plain)).to_pylist()]
        out = np.empty(len(chunks), np.int64)
        out[plain], out[~plain] = np.diff(ends), np.fromiter(map(len, odd), np.int64, len(odd)) // 4
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        both = np.concatenate([_gather(sizes, flat, codes), np.frombuffer(b"".join(odd), "<u4")])
        return out, _gather(out[order], both, np.argsort(order))

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text starts and the last ends); null texts are empty.

        `texts` is a column of UTF-8 bytes; `end_id` is put after each text. Memory is a small multiple of the batch's.
        """
        try:
            texts = pc.fill_null(texts.cast(pa.string()), "")
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            texts = pa.array([(t.as_py() or b"").decode("utf-8", "replace") for t in texts], pa.string())
        if self.kind is None:
            odd = np.ones(len(texts), bool)
        else:
            odd = np.zeros(len(texts), bool) if self.kind == "word" else pc.match_substring_regex(texts, _PAIRS).to_numpy(zero_copy_only=False)
        named = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False) if self.special else np.zeros(len(texts), bool)
        whole = {i: self._whole(t) for i in np.flatnonzero(odd | named).tolist() if (t := texts[i].as_py()) and (self.kind is None or named[i] or _JOINED.search(t))}
        if whole:
            texts = pc.if_else(pa.array([i in whole for i in range(len(texts))], pa.bool_()), "", texts)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if self.kind == "word" else texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.kind == "byte":  # a text's first chunk has no blank before it, the others do
            first, heads = np.unique(codes[at[:-1]], return_inverse=True)
            codes[at[:-1]] = len(chunks) + heads
            chunks = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), chunks, ""), chunks.take(pa.array(first))])
        sizes, flat = (np.zeros(len(chunks), np.int64), np.empty(0, "<u4")) if self.kind is None else self._chunks(chunks)
        if whole:  # such a text has one chunk, an empty one
            codes[at[list(whole)]] = len(sizes) + np.arange(len(whole))
            sizes = np.concatenate([sizes, [len(w) // 4 for w in whole.values()]])
            flat = np.concatenate([flat, np.frombuffer(b"".join(whole.values()), "<u4")])
        if end_id is not None:  # one more chunk behind each text
            codes, at = np.insert(codes, at[1:], len(sizes)), at + np.arange(len(at))
            sizes, flat = np.append(sizes, 1), np.append(flat, np.uint32(end_id))
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[at]
        return _gather(sizes, flat, codes), ends

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_batch(pa.array([text.encode("utf-8", "replace")]))[0].tobytes()


def _gather(sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`flat` holds runs of `sizes` values; the runs of numbers `at`, one after another."""
    n = sizes[at]
    ends = np.cumsum(n)
    shift = (np.cumsum(sizes) - sizes)[at] - (ends - n)
    return flat[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python worker; workers are used again by later tasks."""
    return Encoder(path)
