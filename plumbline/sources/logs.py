"""Reading logs, outputs and scripts of runs, and finding which belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG_SUFFIXES = ("log", "txt", "out", "stderr", "err")


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(log_id, line_no, value): the lines of text files, numbered from 1 in each file.

    A file is read in splits. Lines are counted in each split first, and each split's lines are numbered from the sum of
    those before it, so that no file has to go through one task."""
    held = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_row")
    )
    counts = held.groupBy("log_id", "_at").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("log_id").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("log_id", "_at", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("log_id", "_at").orderBy("_row"))
    return held.withColumn("_in", inside).join(counts, ["log_id", "_at"]).select("log_id", (F.col("_before") + F.col("_in")).alias("line_no"), "value")


def text_of(spark: SparkSession, path: str) -> str:
    """A file of bounded size as one text, from wherever Spark's readers reach."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"] if rows else ""


def lines_of(spark: SparkSession, text: str, log_id: str = "log") -> DataFrame:
    """raw_lines of a text held in memory."""
    rows = [(log_id, i, line) for i, line in enumerate(text.splitlines(), 1)]
    return spark.createDataFrame(rows, "log_id string, line_no long, value string")


def digests(spark: SparkSession, path: str | list[str], large: int = 1 << 30) -> DataFrame:
    """(path, bytes, sha256) of files. Files too large for a cell of a table are read as a stream, without being held."""
    files = spark.read.format("binaryFile").load(path)
    out = files.where(F.col("length") < large).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rest = [(r["path"], r["length"], streamed_sha256(spark, r["path"])) for r in files.where(F.col("length") >= large).select("path", "length").collect()]
    return out.union(spark.createDataFrame(rest, "path string, bytes long, sha256 string")) if rest else out


def streamed_sha256(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    out = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(at.getFileSystem(conf).open(at), out, 1 << 20, True)
    return bytes(digest.digest()).hex()


def listing(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Paths of a folder, by name whatever its case. Contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "length").orderBy(F.lower("path"))


def logs_in(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).where(F.lower(F.substring_index("path", ".", -1)).isin(*LOG_SUFFIXES))


def scripts_in(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, "*.py", recursive=True)


def stem(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))


def paired_scripts(names: DataFrame, scripts: DataFrame, least: int = 4) -> DataFrame:
    """(name, path): for each name the script whose stem it contains, or the other way round; the longest stem wins."""
    s = scripts.select(F.col("path").alias("path"), stem(F.col("path")).alias("_stem")).where(F.length("_stem") >= least)
    n = names.select("name", F.lower("name").alias("_name"))
    both = n.join(s, F.contains("_name", "_stem") | F.contains("_stem", "_name"))
    return both.groupBy("name").agg(F.max_by("path", F.struct(F.length("_stem"), "path")).alias("path"))


def base_name(path) -> F.Column:
    """The stem without words that only say which stream a file holds."""
    return F.regexp_replace(stem(path), r"[-_. ]*(stderr|stdout|logs?)[-_. ]*", "")


def paired_outputs(logs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(log, output) with the same base name, else one of which one's base name contains the other's."""
    a = logs.select(F.col("path").alias("log"), base_name(F.col("path")).alias("_a"))
    b = outputs.select(F.col("path").alias("output"), base_name(F.col("path")).alias("_b")).where("_b <> ''")
    near = a.join(b, F.contains("_a", "_b") | ((F.col("_a") != "") & F.contains("_b", "_a")))
    best = F.max_by("output", F.struct((F.col("_a") == F.col("_b")), F.length("_b"), "output"))
    return near.groupBy("log").agg(best.alias("output"))


def stored_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def table(spark: SparkSession, path: str, columns: list[str], kind: str = "parquet") -> DataFrame:
    """A stored table with the columns that are asked for, and no others read."""
    return spark.read.format(kind).load(path).select(*columns)
