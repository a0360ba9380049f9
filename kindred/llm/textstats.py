"""Statistics of whole texts as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = r"[#*$%&|<>]"
_SPACE = r"[\x20\x09-\x0D]+"
#: The statistics a classifier sees; all are doubles.
FEATURES = ("n_words", "word_len", "symbols", "dup_lines", "repeats", "stops", "distinct", "digits", "upper", "lines", "commas")


def _repeat_words(w, h):
    """Words in 3-word windows that occur twice or more. Hashes only show that no window can repeat; repeats are found by the words."""
    n = F.size(w)
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(3))).alias("s"), i.alias("i")))
    return F.when((n >= 3) & (F.size(F.array_distinct(h)) < F.size(h)), F.sort_array(window))


def with_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), words and text.

    A null text counts as an empty one: all are 0. Lines are those with a word.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, t.alias("_t"), F.array_remove(F.split(t, _SPACE), "").alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*keep, "_t", "_w", lines.alias("_l"), hashes.alias("_h"))
    df = df.select(*keep, "_t", "_w", "_l", _repeat_words(w, F.col("_h")).alias("_s"))
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["s"] == x["s"]) | (F.get(s, j + 1)["s"] == x["s"]))
    df = df.select(*keep, "_t", "_w", "_l", F.transform(twice, lambda x: x["i"]).alias("_p"))
    p = F.col("_p")
    covered = F.array_distinct(F.flatten(F.array(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))
    return df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("_w").alias("words"),
        F.col("_t").alias("whole"),
    )


def with_features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and FEATURES: ratios to words, lines or characters, 0 for texts without any."""
    s = with_stats(docs, text_col, keep)
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    count = lambda pattern: F.regexp_count("whole", F.lit(pattern))
    values = (
        F.col("n_words"),
        F.col("word_chars") / words,
        F.col("n_symbols") / words,
        F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / words,
        count("[.!?]") / words,
        F.size(F.array_distinct("words")) / words,
        count("[0-9]") / chars,
        count(r"\p{Lu}") / chars,
        F.col("n_lines") / words,
        count(",") / words,
    )
    return s.select(*keep, *(v.cast("double").alias(n) for n, v in zip(FEATURES, values)))
