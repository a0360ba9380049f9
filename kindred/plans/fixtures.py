"""The test tables as a corpus: reports, tags, authors, vectors and notes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import FOLDERS, REPORTS_REL, Settings, Thresholds
from kindred.functions.scalars import normalised

PROFILE = Thresholds(a_min=0.15, b_min=0.25, a_veto=0.10)
ALL_FOLDERS = (*FOLDERS, "99-Other")
PROTECTED_IDS = (19, 38, 57, 95, 114)


def note_text(idx, body):
    """Markdown around a body: six kinds of front matter by id, and a summary section for even ids."""
    keys = F.when(idx % 6 == 1, "related-documents: []\n").when(idx % 6 == 2, 'related-documents:\n  - "[[Old one]]"\n  - "[[Old two]]"\n').otherwise("")
    fence = F.when(idx % 6 == 4, "---\r\n").otherwise("---\n")
    head = F.when(idx % 6 == 0, "").when(idx % 6 == 5, F.lit("---\ntitle: open\n")).otherwise(F.concat(fence, F.lit("title: t\n"), keys, F.lit("tags:\n  - a\n"), fence))
    section = F.concat(F.lit("# Title\n\n## 2. 要約\n> [!note] head\n> "), body, F.lit("　with [[a link|x]] and ![[image]]\n<!-- two\nlines --> tail\n### more\nend\n## 3. Next\nnot this"))
    return F.concat(head, F.when(idx % 2 == 0, section).otherwise(body))


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return (self.table("documents").agg(F.max("doc_id")).first()[0] or 0) + 1

    @cached_property
    def size(self) -> int:
        return self.table("documents").count()

    def _name(self, i):
        return f"doc_{i % (self.n * 4 // 5 + 1)}.md"

    @property
    def settings(self) -> Settings:
        return Settings("/v", protected=tuple(f"{ALL_FOLDERS[i % 4]}/{self._name(i)}" for i in PROTECTED_IDS), limits=PROFILE)

    @property
    def papers(self) -> DataFrame:
        i = F.col("doc_id")
        name = F.concat(F.when(i % 11 == 0, "_").otherwise(""), F.lit("doc_"), (i % (self.n * 4 // 5 + 1)).cast("string"), F.lit(".md"))
        folder = F.element_at(F.array(*map(F.lit, ALL_FOLDERS)), (i % 4 + 1).cast("int"))
        path = F.concat(F.lit(f"/v/{REPORTS_REL}/"), folder, F.lit("/"), F.when(i % 13 == 0, "nested/").otherwise(""), name)
        return self.table("documents").select(i.alias("id"), path.alias("file_path"), F.when(i % 23 != 0, F.substring_index("text", ".", 1)).alias("title"))

    @property
    def everything(self) -> DataFrame:
        """All documents as a corpus whose positions are their ids, without the filters on paths."""
        i = F.col("doc_id")
        folder = F.element_at(F.array(*map(F.lit, ALL_FOLDERS)), (i % 4 + 1).cast("int"))
        name = F.concat(F.lit("doc_"), (i % (self.n * 4 // 5 + 1)).cast("string"), F.lit(".md"))
        return self.table("documents").select(i.alias("idx"), i.alias("id"), folder.alias("folder"), name.alias("basename"), F.concat_ws("/", folder, name).alias("relpath"), F.concat(F.lit("/n/"), i.cast("string")).alias("file_path"), F.substring_index("text", ".", 1).alias("title"))

    @property
    def listing(self) -> DataFrame:
        return self.papers.where("id % 17 <> 0").select(F.col("file_path").alias("path")).distinct()

    @property
    def tags(self) -> DataFrame:
        d = self.table("documents")
        tag = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("tag")
        words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
        concept = d.select("doc_id", words.alias("w")).where(F.char_length("w") >= 8).select("doc_id", tag("Concept/", F.col("w")))
        topic = self.table("embeddings").where(F.col("vec_id") < self.n).select(F.col("vec_id").alias("doc_id"), tag("Method/topic_", F.col("label").cast("string")))
        fixed = [d.select("doc_id", tag(*t)) for t in (("Venue/", F.col("source")), ("FoS/Primary/", F.col("lang")), ("Lang/", F.col("lang")), ("Year/2024",), ("学術論文",))]
        out = concept.union(topic)
        for f in fixed:
            out = out.union(f)
        return out.withColumnRenamed("doc_id", "paper_id")

    @property
    def authors(self) -> DataFrame:
        e = self.table("events").where("event_type = 'purchase'")
        return e.select((F.col("event_id") % self.n).alias("paper_id"), F.concat(F.lit(" user_"), F.col("user_id").cast("string"), F.lit("　")).alias("name"))

    @property
    def vectors(self) -> DataFrame:
        d = self.table("documents").select(F.col("doc_id").alias("vec_id"))
        return self.table("embeddings").join(d, "vec_id").select(F.col("vec_id").alias("idx"), normalised(F.col("embedding")).alias("vec"))

    @property
    def notes(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("idx"), note_text(F.col("doc_id"), F.col("text")).alias("text"))
