"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A separator of words as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Mixing constants of 64-bit hashes (fixed values).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "/tmp/checkpoints"
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, when nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python at most 4 MB of rows at once: texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def give_back(collect: bool = True) -> None:
    """Returns freed memory of a Python worker, which lives on after a task, to the machine."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """Frees what the driver doesn't need any more. Broadcasts, shuffles and plans of what is done stay until the JVM
    collects its garbage, which it puts off for as long as its heap may grow."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text) -> F.Column:
    """Words of a text column, natively; an empty array where there are none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def lower_ascii(text) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(column: pa.Array, at_most: int = 1 << 22):
    """(first row, list of UTF-8 texts; null: empty) of a string or binary array, in pieces of about at_most bytes.

    A longer text makes a piece of its own."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    rows = column.cast(kind)
    first, held, size = 0, [], 0
    for i in range(len(rows)):
        raw = rows[i].as_py() or b""
        if held and size + len(raw) > at_most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + MIX[0]
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))
