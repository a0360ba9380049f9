"""Unicode-aware text expressions, and the Markdown text that stands for a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, written so that Java's and RE2's engines agree.
WS = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
BODY_CHARS, INPUT_CHARS = 1500, 2000


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def truncated(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.md\z", "")


def hash_input(c: Column) -> Column:
    """SHA-256 of a text as it is sent to an embedder: an empty one as a blank."""
    return F.sha2(F.when(c == "", F.lit(" ")).otherwise(c), 256)


def front_end(lines: Column) -> Column:
    """1-based position of the line that closes the front matter; 0 without front matter."""
    shut = F.transform(lines, lambda x, i: (i > 0) & (trimmed(x) == "---"))
    return F.when(trimmed(F.get(lines, F.lit(0))) == "---", F.array_position(shut, True)).otherwise(F.lit(0)).cast("int")


def extract(df: DataFrame, text: str, out: str = "body") -> DataFrame:
    """df with the text of a note's summary section, or without one of its whole body cut at BODY_CHARS.

    The section starts at the first `## 要約` or `## 2. 要約` line and ends before the next line that starts with
    `## `. Comments, callout headers, quote marks and wiki links go; white space collapses. Null text gives "".
    """
    cols = df.columns
    s = df.withColumn("_l", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    s = s.withColumn("_b", F.slice("_l", front_end(F.col("_l")) + 1, F.greatest(F.size("_l"), F.lit(1))))
    heads = F.transform("_b", lambda x: x.rlike(rf"^##{WS}*(?:2\.{WS}*)?要約{WS}*\z"))
    s = s.withColumn("_h", F.array_position(heads, True).cast("int"))
    s = s.withColumn("_s", F.when(F.col("_h") > 0, F.slice("_b", F.col("_h") + 1, F.size("_l"))).otherwise(F.col("_b")))
    ends = F.array_position(F.transform("_s", lambda x: x.rlike(rf"^##{WS}")), True).cast("int")
    s = s.withColumn("_s", F.when((F.col("_h") > 0) & (ends > 0), F.slice("_s", F.lit(1), ends - 1)).otherwise(F.col("_s")))
    text = F.regexp_replace(F.array_join("_s", "\n"), r"(?s)<!--.*?-->", " ")
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(rf"^{WS}*>{WS}*\[![^\n]*?\]"))
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{WS}*>{WS}?", ""), r"!?\[\[[^\n]*?\]\]", " "))
    body = trimmed(F.regexp_replace(F.array_join(lines, " "), rf"{WS}+", " "))
    return s.withColumn(out, F.when(F.col("_h") > 0, body).otherwise(truncated(body, BODY_CHARS))).select(*cols, out)


def embed_input(title: Column, body: Column) -> Column:
    return truncated(trimmed(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), body)), INPUT_CHARS)
