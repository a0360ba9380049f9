"""Secrets in texts: three fixed patterns, and random strings by what a tokenizer makes of them.

A vocabulary learnt from text packs words into few tokens and random characters into many: a string of 20 and
more characters at under 1.9 characters a token is no language (random base64 has 1.3, random hex 1.65; of the
invented words of 12 and more letters in the tests' tables 99.9 % have over 1.7, and words are identifiers anyway).
Before that test known digests go, by their form, and identifiers: names of few changes between letters
and digits. Every text is scanned whole, in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import id_type, prepare, small, table
from kindred.llm.tokens import vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
#: In the order of spans that start together.
KINDS = ("assign", "access", "hex", "random")
#: A string is random from this length on and below this many characters a token.
MIN_CHARS, MAX_RATIO = 20, 1.9
#: An identifier's runs of a word or number have this many characters on average.
MIN_RUN = 6
#: Characters tokenized at once; a longer string is counted in pieces, each cut of which can add a token.
PIECE = 512

# The contract's patterns. A failing match ends where it would have ended anyway, so lengths can stand in the pattern.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_STRING = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}")
#: Digests as hex (MD5, SHA-1, Tiger, SHA-2, SHA-3) and with an algorithm's name as base64; UUIDs; numbers.
_DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|sha(?:1|256|384|512)-[A-Za-z0-9+/]+={0,2}")
_IDENTIFIER = re.compile(r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})|[0-9_-]+")
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(s: str) -> bool:
    """Whether a string is a digest or an identifier by its form."""
    return bool(_DIGEST.fullmatch(s) or _IDENTIFIER.fullmatch(s)) or MIN_RUN * len(_RUN.findall(s)) <= len(s)


def ratio(s: str, path: str) -> float:
    """Characters a token."""
    encode = _encoding(path).encode_ordinary
    return len(s) / sum(len(encode(s[i : i + PIECE])) for i in range(0, len(s), PIECE))


def spans(text: str, path: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind. A random string inside a base span isn't told again."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in out)
    at, reach = 0, 0  # the base spans that start at or before a string, and where the furthest of them ends
    for m in _STRING.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            reach, at = max(reach, base[at][1]), at + 1
        if reach < m.end() and not known(m[0]) and ratio(m[0], path) < MAX_RATIO:
            out.append(("random", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, as `<first kind>`."""
    out, end = [], 0
    for kind, s, e in found:
        if s >= end:
            out += [text[end:s], f"<{kind}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>, redacted) of every row; `redacted` is null where nothing was found.

    Null texts count as empty ones and have no spans; null ids and repeated rows are rows like any other; an empty
    table gives an empty one; further columns are ignored. Bytes that are no UTF-8 count as replacement characters.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary(VOCABULARY)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [(t or b"").decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            found = [spans(t, path) for t in texts]
            told = [[dict(zip(("kind", "start", "end"), x)) for x in f] for f in found]
            clean = [redacted(t, f) if f else None for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, _SPANS), pa.array(clean, pa.string())], ["id", "spans", "redacted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"id {id_type(docs, id_col)}, spans array<struct<kind: string, start: long, end: long>>, redacted string")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents. The base kinds are fixed, `random` spans come from the token-efficiency test."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("spans", lambda x: x["kind"] != "random"))
    out = secrets(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("random"))
