"""How filters interact: what each takes in every order of application, by packed bitmaps.

The order of filters before a step does not matter, only their set does. So each task packs its rows into bitsets, one
for each filter and label, with the rows of a part side by side from a whole byte on, and counts for every set of
filters the rows that pass them all: NOT the OR of their failures, AND the label, bits counted by byte and
summed by part. A task gives one row of 2**k counts a label for each of its parts; sums of these, a row for each part,
hold all that any order needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import prepare, table, written

WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Filters audited together at most; there are k! orders and 2**k sets.
MOST = 7


def packed(flags: np.ndarray, codes: np.ndarray, k: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(different codes, counts[code, label, set]) of rows with bit i of `flags` for filter i's failure and bit k + j for label j.

    Label 0 of the result is every row. Rows are put in order of their codes; a code's bits start at a byte of their own.
    """
    order = np.argsort(codes, kind="stable")
    flags = flags[order]
    parts, sizes = np.unique(codes, return_counts=True)
    width = -(-sizes // 8)
    starts = np.concatenate([[0], np.cumsum(width)])
    place = np.arange(len(flags)) + np.repeat(8 * starts[:-1] - (np.cumsum(sizes) - sizes), sizes)

    def bits(on: np.ndarray) -> np.ndarray:
        row = np.zeros(8 * starts[-1], bool)
        row[place] = on
        return np.packbits(row)

    fails = [bits(flags >> i & 1 != 0) for i in range(k)]
    marks = [bits(np.ones(len(flags), bool)), *(bits(flags >> k + j & 1 != 0) for j in range(labels))]
    out = np.zeros((len(parts), 1 + labels, 1 << k), np.int64)
    for chosen in range(1 << k):
        gone = reduce(or_, (fails[i] for i in range(k) if chosen >> i & 1), np.zeros_like(marks[0]))
        for j, mark in enumerate(marks):
            out[:, j, chosen] = np.add.reduceat(np.bitwise_count(mark & ~gone).astype(np.int64), starts[:-1])
    return parts, out


def subset_counts(rows: DataFrame, part: str, filters: dict[str, Column], labels: dict[str, Column]) -> DataFrame:
    """(part, kept, one column a label): counts of each part's rows that pass all filters of a set, by the set's number.

    Bit i of the number stands for filter i, whose column is true where a row fails; null is false. A label's column
    counts those of them that have it. Null parts are the empty string.
    """
    prepare(rows.sparkSession)
    k, names = len(filters), list(labels)
    if k > MOST:
        raise ValueError(f"at most {MOST} filters")
    bit = lambda c, i: F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    flags = reduce(lambda a, b: a + b, (bit(c, i) for i, c in enumerate([*filters.values(), *labels.values()])))
    values = ["kept", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                coded = b.column(0).dictionary_encode()
                parts, counts = packed(b.column(1).to_numpy(), coded.indices.to_numpy(), k, len(names))
                flat = lambda x: pa.array(x.tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(parts)), *(flat(counts[:, j]) for j in range(len(values)))], ["part", *values])

    counted = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), flags.cast("int").alias("flags")).mapInArrow(run, "part string, " + ", ".join(f"{v} array<long>" for v in values))
    one = lambda v: F.array(*(F.sum(F.get(v, F.lit(i))) for i in range(1 << k))).alias(v)
    return counted.groupBy("part").agg(*map(one, values))


def audit(counts: DataFrame, filters: list[str], lost: dict[str, str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, one column each of `lost`, shapley) from subset_counts.

    `filters` are names of one letter, in the order of the counts; `lost` names a result column for a label. There is a row
    for every part, order of the filters, and step: its filter removes those that pass all before it and fail it.
    """
    k = len(filters)
    every, step = (1 << k) - 1, F.col("step")
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters))))
    rows = counts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = {f: F.instr("filter_order", f) for f in filters}
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    rows = rows.withColumn("before", total(F.when(place[f] < step, 1 << i).otherwise(0) for i, f in enumerate(filters)))
    rows = rows.withColumn("own", total(F.when(place[f] == step, 1 << i).otherwise(0) for i, f in enumerate(filters)))
    at = lambda v, s: F.get(v, s)
    before, own = F.col("before"), F.col("own")
    taken = lambda v: at(v, before) - at(v, before + own)

    def orders_sum(own: int) -> Column:
        """A filter's removals summed over all orders: each set before it stands in |set|! (k - 1 - |set|)! of them."""
        sets = [s for s in range(1 << k) if not s & own]
        weight = lambda s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())
        return total((at("kept", F.lit(s)) - at("kept", F.lit(s | own))) * weight(s) for s in sets)

    shapley = reduce(lambda acc, i: F.when(own == 1 << i, F.get("_shapley", F.lit(i))).otherwise(acc), range(k), F.lit(None).cast("long"))
    rows = rows.withColumn("_shapley", F.array(*(orders_sum(1 << i) for i in range(k))))
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("kept", before + own).alias("kept"),
        taken("kept").alias("removed"),
        (at("kept", F.lit(0)) - at("kept", own) - taken("kept")).alias("redundant"),
        (at("kept", F.lit(every) - own) - at("kept", F.lit(every))).alias("unique_fails"),
        *(taken(label).alias(name) for name, label in lost.items()),
        shapley.alias("shapley"),
    )


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, a, b, c, d): the four filters that a text decides alone, true where it fails, and the text's SHA-256."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), t.alias("_t"), F.array_remove(F.split(t, WORD_SPLIT), "").alias("_w"))
    words, distinct = F.size("_w"), F.size(F.array_distinct("_w"))
    return df.select(
        "id",
        "part",
        F.unhex(F.sha2("_t", 256)).alias("digest"),
        (words < 100).alias("a"),
        (100 * distinct.cast("long") < 80 * words.cast("long")).alias("b"),
        (100 * F.regexp_count("_t", F.lit("[A-Z]")).cast("long") > 10 * F.char_length("_t").cast("long")).alias("c"),
        F.col("_t").rlike("[#$%&*|]").alias("d"),
    )


def repeats(flags: DataFrame) -> DataFrame:
    """flags with e: whether a smaller id has the same text.

    Each text's smallest id is found with partial counts, so a group of copies of any size is a row a task; rows then
    meet that id by id and text, not by text. A null id is no smaller one and has none.
    """
    first = flags.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("e", F.lit(False))
    return flags.join(first, ["id", "digest"], "left").withColumn("e", F.when(F.col("id").isNotNull(), F.coalesce("e", F.lit(True))).otherwise(F.lit(False)))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of filters A to E over `docs`, with documents of good quality and toxic ones lost.

    A: under 100 words; B: under 80 % different words; C: over 10 % capital ASCII letters; D: a character of `#$%&*|`;
    E: the text of a smaller id. A document is good (toxic) if any label row of its id says so; null ids have no labels.
    Null texts count as empty ones, repeated rows each count, an empty table gives no rows, further columns are ignored.
    """
    flags = written(flagged(docs, id_col, text_col, part_col), "audit-flags")
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = repeats(flags).join(told, "id", "left")
    counts = subset_counts(rows, "part", {x: F.col(x.lower()) for x in "ABCDE"}, {"good": F.col("good"), "toxic": F.col("toxic")})
    return audit(written(counts, "audit-counts"), list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS x
  FROM t LEFT JOIN l USING (doc_id)
), o AS (
  SELECT a || b || c || d || e AS filter_order, unnest([1, 2, 3, 4, 5]) AS step
  FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS d), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), k AS (
  SELECT part, x, good, toxic, count(*) AS n FROM f GROUP BY ALL
), s AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS i, list_transform(range(1, step), lambda p: instr('ABCDE', filter_order[p])) AS before FROM o
), r AS (
  SELECT part, filter_order, step, i,
         coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT x[i]), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT earlier AND x[i]), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE earlier AND x[i]), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE x[i] AND len(list_filter(x, lambda v: v)) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE NOT earlier AND x[i] AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE NOT earlier AND x[i] AND toxic), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda j: x[j])) > 0 AS earlier FROM k, s) GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM r
"""
