"""Fill-in-middle: texts cut at two code points and put together again with the middle last.

A text stays UTF-8 bytes. One Aho-Corasick automaton, over an alphabet that tells ASCII characters from the bytes
of longer ones, finds the sentinels and the places where a character's width changes: an ASCII character beside a
longer one, or two longer ones of different widths. Between two such events all characters have one width, so code
points are a product, and the byte of any code point is one search among the events.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import id_type, prepare, small, table

#: Prefix, suffix and middle begin with these in the output.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents, those that are transformed; of 100 of these, those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"

#: Stand-ins of bytes: an ASCII character, a byte that goes on with one, and first bytes by their width.
_ASCII, _MORE = "\x80", "\x81"
_FIRST = {2: "\x82", 3: "\x83", 4: "\x84"}


@functools.lru_cache(maxsize=4)
def _automaton(sentinels: tuple[str, ...]):
    """(automaton, table of stand-ins). Its values are 0 for a sentinel, else the width of characters from the match's last byte on."""
    import ahocorasick

    own = sorted({c for s in sentinels for c in s})  # these stand for themselves
    stand = [chr(b) if chr(b) in own else _ASCII for b in range(128)] + [_MORE] * 64
    stand += [_FIRST[2 if b < 0xE0 else 3 if b < 0xF0 else 4] for b in range(0xC0, 256)]
    a = ahocorasick.Automaton()
    for s in sentinels:
        a.add_word(s, 0)
    for c in (_ASCII, *own):
        a.add_word(_MORE + c, 1)
        for width, first in _FIRST.items():
            a.add_word(c + first, width)
    for before, head in _FIRST.items():
        for width, first in _FIRST.items():
            if width != before:
                a.add_word(head + _MORE * (before - 1) + first, width)
    a.make_automaton()
    return a, "".join(stand).encode("latin-1")


class Ranks:
    """Events of one text of valid UTF-8: where runs of one width start, in bytes and in code points."""

    def __init__(self, text: bytes, sentinels: tuple[str, ...] = SENTINELS):
        automaton, stand = _automaton(sentinels)
        shape = text.translate(stand).decode("latin-1")
        first = next((w for w, c in _FIRST.items() if shape[:1] == c), 1)
        self.bytes, self.units, self.widths, self.marked = [0], [0], [first], False
        for at, width in automaton.iter(shape) if shape else ():
            if width:
                self.units.append(self.units[-1] + (at - self.bytes[-1]) // self.widths[-1])
                self.bytes.append(at)
                self.widths.append(width)
            else:
                self.marked = True
        self.n = self.units[-1] + (len(text) - self.bytes[-1]) // self.widths[-1]

    def byte(self, unit: int) -> int:
        """Where code point number `unit` starts."""
        i = bisect_right(self.units, unit) - 1
        return self.bytes[i] + (unit - self.units[i]) * self.widths[i]


def transformed(text: bytes, digest: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and of middle, output). Cuts and form come from the digest's first 32 digits."""
    r = Ranks(text, sentinels)
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or r.marked or h[2] % 100 >= rate:
        return r.n, "plain", None, None, text
    low, high = sorted(x % (r.n + 1) for x in h[:2])
    a, b = r.byte(low), r.byte(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = map(str.encode, sentinels)
    if h[3] % 100 < suffix_first:
        return r.n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
    return r.n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row, in the task that reads it.

    `form` is psm (prefix, suffix, middle), spm (suffix first) or plain, where the text stays as it is: empty texts,
    texts with a sentinel, and the rest of `rate`. Null texts count as empty ones, null ids are hashed as empty
    strings, repeated rows are treated alike, an empty table gives an empty one, further columns are ignored.
    Bytes that are no UTF-8 count as replacement characters.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            try:
                texts = [t or b"" for t in b.column(1).cast(pa.string()).cast(pa.binary()).to_pylist()]
            except pa.ArrowInvalid:
                texts = [(t or b"").decode("utf-8", "replace").encode() for t in b.column(1).to_pylist()]
            made = [transformed(t, h, rate, suffix_first) for t, h in zip(texts, b.column(2).to_pylist())]
            n, form, prefix, middle, out = zip(*made) if made else ((),) * 5
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), digest.alias("digest"))
    return rows.mapInArrow(run, f"id {id_type(docs, id_col)}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. A transformed text holds no sentinel, so the output has each once."""
    part = lambda i: F.get(F.split(output, "|".join(SENTINELS)), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents transformed, and restored from output and form alone."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("form"), F.col("output"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), h AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS h1, ('0x' || h[9:16])::BIGINT % (n + 1) AS h2,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
  FROM d
), f AS (
  SELECT doc_id, t, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
