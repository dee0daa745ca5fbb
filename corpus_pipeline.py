"""Stages that turn a table of documents into encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents. It works
on everything that the stage before it kept. Null and empty texts pass all stages (they are clean, near nothing, and
have no token) unless their whole source has no word, of which the mix takes nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, mixing, near_dups, suffix_dedup, toxicity
from plumbline.llm.common import documents, settle, small_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def settled(stage: Stage) -> Stage:
    """The stage, begun when the driver has freed what the one before it left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@settled
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    scored = toxicity.toxicity(small_batches(docs.select(*COLUMNS)), documents(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


@settled
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by shingles of five words: that of the least id. Of equal rows with an id
    one stays; rows that share an id but differ are compared as any others, and rows without an id stay."""
    docs = docs.select(*COLUMNS)
    order = [F.col("doc_id"), F.col("_hash")]
    first = F.row_number().over(W.partitionBy(*order).orderBy(*order))
    named = docs.where("doc_id IS NOT NULL").withColumn("_hash", F.xxhash64(*COLUMNS)).repartitionByRange(*order)
    # a key of each row, in the order of ids: partitions are ranges of ids, sorted for the window
    rows = named.withColumn("_first", first).where("_first = 1").withColumn("_key", F.monotonically_increasing_id())
    rows = stored(rows.select("_key", *COLUMNS), "rows")
    found = near_dups.near_duplicates(rows, key="_key", how=near_dups.Sketching(shingle=5))
    kept = found.where("kept").select(F.col("id").alias("_id"))
    return rows.join(kept, F.col("_key") == F.col("_id"), "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


@settled
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere. A character of which a byte goes, goes."""
    found = suffix_dedup.with_spans(docs.select(*COLUMNS), rest="_rest", characters=True)
    cut = F.size("spans") > 0
    found = found.withColumn("text", F.when(cut, F.decode("_rest", "UTF-8")).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@settled
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, those that it takes twice as two rows."""
    docs = docs.select(*COLUMNS).withColumn("_id", F.xxhash64(*COLUMNS))
    sizes = mixing.measured(docs.select("doc_id", "source", "text", "_id"))
    taken = mixing.queue(sizes).groupBy(F.col("_id").alias("_t")).agg(F.count("*").cast("int").alias("_n"))
    rows = docs.dropDuplicates(["_id"]).join(taken, F.col("_id") == F.col("_t"))
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


@settled
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens, and the digest of the text that they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.round_trip(small_batches(docs.select(*COLUMNS)), ranks)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: SQL can express neither the learnt scores nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
