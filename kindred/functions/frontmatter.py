"""A note's block of links and the front matter that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import WS, front_end

KEY = "related-documents"


def block(targets: Column) -> Column:
    """Lines of the block for an array of link targets."""
    items = F.transform(targets, lambda t: F.concat(F.lit('  - "[['), t, F.lit(']]"')))
    return F.when(F.size(targets) > 0, F.concat(F.array(F.lit(f"{KEY}:")), items)).otherwise(F.array(F.lit(f"{KEY}: []")))


def rewrite(df: DataFrame, text: str, targets: str, out: str = "new_text") -> DataFrame:
    """df with the text whose front matter lists `targets`, and whether it changed.

    A bare key or one with an empty inline list is replaced, with the indented items after it; several are each
    replaced; without one the block is added at the end. Fences become exactly `---`. Text without closed front
    matter, and null, stays as it is.
    """
    cols = df.columns
    s = df.withColumn("_l", F.split(text, "\n")).withColumn("_e", front_end(F.col("_l")))
    s = s.withColumn("_blk", block(F.coalesce(F.col(targets), F.array().cast("array<string>"))))
    is_key = lambda x: x.rlike(rf"^{KEY}:{WS}*(\[{WS}*\])?{WS}*\z")
    is_item = lambda x: x.rlike(rf"^{WS}+-{WS}")
    head = F.slice("_l", F.lit(2), F.greatest(F.col("_e") - 2, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"), F.lit(False).alias("seen"))

    def step(a: Column, x: Column) -> Column:
        key, drop = is_key(x), a["skip"] & is_item(x)
        add = F.when(key, F.col("_blk")).when(drop, F.array().cast("array<string>")).otherwise(F.array(x))
        return F.struct(F.concat(a["out"], add).alias("out"), (key | drop).alias("skip"), (a["seen"] | key).alias("seen"))

    s = s.withColumn("_a", F.when(F.col("_e") > 0, F.aggregate(head, start, step)))
    more = F.when(F.col("_a.seen"), F.array().cast("array<string>")).otherwise(F.col("_blk"))
    rest = F.slice("_l", F.col("_e") + 1, F.greatest(F.size("_l"), F.lit(1)))
    new = F.array_join(F.concat(F.array(F.lit("---")), F.col("_a.out"), more, F.array(F.lit("---")), rest), "\n")
    s = s.withColumn(out, F.when(F.col("_e") > 0, new).otherwise(F.col(text)))
    return s.withColumn("changed", F.coalesce(F.col(out) != F.col(text), F.lit(False))).select(*cols, out, "changed")
