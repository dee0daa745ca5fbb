"""Writing tables and documents."""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a stored table and its schema."""
    writer = df.write.mode("overwrite")
    (writer.option("overwriteSchema", "true") if kind == "delta" else writer).format(kind).save(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder that the session names and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vacuumed(spark: SparkSession, path: str, hours: float, kind: str = "parquet") -> int:
    """Deletes files of a table folder that no reader of its present state needs, and says how many.

    Of a Delta table the engine decides (VACUUM); a folder of Parquet holds left-overs of writers in hidden files and
    folders, which go when they are older than that."""
    if kind == "delta":
        return spark.sql(f"VACUUM delta.`{path}` RETAIN {hours} HOURS").count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = (time.time() - hours * 3600) * 1000
    gone = 0
    for f in store.listStatus(at):
        name = f.getPath().getName()
        if name.startswith((".", "_")) and name not in ("_SUCCESS", "_delta_log", "_manifest") and f.getModificationTime() < oldest:
            gone += bool(store.delete(f.getPath(), True))
    return gone


def manifest(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(file): the data files of a table's present state, written as text to _manifest beside them for readers that know no more."""
    if kind == "delta":
        spark.sql(f"GENERATE symlink_format_manifest FOR TABLE delta.`{path}`")
    files = spark.read.format(kind).load(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    if kind != "delta":
        files = stored(files, "manifest")  # what is listed and what is written are one state
        files.select(F.col("file").alias("value")).sort("value").write.mode("overwrite").text(f"{path.rstrip('/')}/_manifest")
    return files


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON document a row, written by the executors."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, column: str = "document") -> DataFrame:
    """Each row as a JSON document; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def write_document(document: dict, path: str, compact: bool = False, spark: SparkSession | None = None) -> None:
    """One document of bounded size, from the driver."""
    how = {"separators": (",", ":")} if compact else {"indent": 2}
    write_text(json.dumps(document, ensure_ascii=False, **how), path, spark)


def write_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    """A text file: on the driver's disk, or in a store (`scheme://...`) by way of the session."""
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
