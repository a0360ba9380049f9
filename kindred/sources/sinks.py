"""Writing edges and notes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_json(decisions: DataFrame) -> DataFrame:
    """(i, j, json): one JSON object per decision, nulls spelt out."""
    row = F.struct("i", "j", "a_cos", "emb_cos", "is_a", "is_b", "decision", "src")
    return decisions.select("i", "j", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def dump_edges(decisions: DataFrame, path: str) -> None:
    """JSON lines, in order of the pairs."""
    edge_json(decisions).orderBy("i", "j").select("json").write.mode("overwrite").text(path)


STAGE, _READY = ".kindred-notes-", "_READY"


def stage_notes(rewritten: DataFrame, stage: str) -> None:
    """First phase: new_text of changed rows as files below `stage`, a folder for each, with a list of where they belong.

    Spark's text writer makes the files on any file system. It ends a file with a line separator of its own, for
    which the text's last character serves: one job for each that occurs. file_path differs from row to row.
    """
    spark = rewritten.sparkSession
    text, key = F.col("new_text"), F.sha2("file_path", 256).alias("k")
    rows = rewritten.where(F.col("changed") & (text != "")).select(key, "file_path", F.left(text, F.char_length(text) - 1).alias("value"), F.right(text, F.lit(1)).alias("end"))
    rows.write.parquet(f"{stage}/rows")
    rows = spark.read.parquet(f"{stage}/rows")
    for (end,) in rows.select("end").distinct().collect():  # characters, not texts
        rows.where(F.col("end") == end).select("k", "value").write.mode("append").option("lineSep", end).partitionBy("k").text(f"{stage}/files")
    p = spark._jvm.org.apache.hadoop.fs.Path
    p(stage).getFileSystem(spark._jsc.hadoopConfiguration()).create(p(f"{stage}/{_READY}")).close()


def _replace(spark: SparkSession, source, target) -> None:
    """Put a file in another's place by one rename."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    if fs.getScheme() == "file":  # without checksum files beside the notes
        if not fs.getRawFileSystem().rename(source, target):
            raise OSError(f"{target} couldn't be replaced")
        return
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(source, target, over)


def finish_notes(spark: SparkSession, stage: str) -> int:
    """Second phase: files that are all staged take their places, by renames alone; gives how many. Anything else is dropped.

    Repeated after a run that broke off, it goes on where that one stopped.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs, moved = p(stage).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    if fs.exists(p(f"{stage}/{_READY}")):
        for row in spark.read.parquet(f"{stage}/rows").select("k", "file_path").toLocalIterator():  # names, not texts
            folder = p(f"{stage}/files/k={row['k']}")
            for f in fs.listStatus(folder) if fs.exists(folder) else ():
                if f.getPath().getName().startswith("part-"):
                    _replace(spark, f.getPath(), p(row["file_path"]))
                    moved += 1
    fs.delete(p(stage), True)
    return moved


def recover_notes(spark: SparkSession, folder: str) -> int:
    """Finish or drop what broken runs have staged in `folder`."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    left = [s.getPath() for s in fs.listStatus(p(folder)) if s.getPath().getName().startswith(STAGE)] if fs.exists(p(folder)) else []
    return sum(finish_notes(spark, s.toString()) for s in left)


def write_notes(rewritten: DataFrame, folder: str | None = None) -> int:
    """Write new_text to file_path where it changed, all or, if staging fails, none; gives how many.

    Files are staged in `folder`, which must be on the notes' file system (default: the first note's folder), and then
    renamed. An empty new_text never replaces a note.
    """
    spark = rewritten.sparkSession
    if folder is None:
        first = rewritten.where("changed").select("file_path").first()
        if first is None:
            return 0
        folder = first["file_path"].rpartition("/")[0]
    stage = f"{folder}/{STAGE}{uuid.uuid4().hex}"
    try:
        stage_notes(rewritten, stage)
    except Exception:
        p = spark._jvm.org.apache.hadoop.fs.Path
        p(stage).getFileSystem(spark._jsc.hadoopConfiguration()).delete(p(stage), True)
        raise
    return finish_notes(spark, stage)
