"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds every hash of its word shingles below a fixed fraction of the hash space. Sketches of parts merge
by union, and since the fraction is the same for all texts, the share of a small sketch found in a large one estimates
containment however unequal the texts are. A text whose shingles all lie above the threshold keeps its least hash, so
that short texts can be told apart. A text of fewer words than a shingle has one shingle, all its words.

Null and empty texts, and texts without a word, have an empty fingerprint; it is like another empty one (1.0) and unlike
all others (0.0). Equal texts have equal fingerprints. An empty table gives an empty result. Columns of the input stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.columns import NUMBER, apart, numbered
from plumbline.llm.common import documents, word_array

#: Words of a shingle; one of so many hashes is kept.
SHINGLE, SCALE = 5, 8
#: Rows of a bucket of neighbours, and the most buckets of each of two levels. Beyond 65 million rows buckets are larger;
#: a window over one holds a few rows and sorts on disk.
BUCKET_ROWS, BUCKETS = 4000, 128
LEAST_ID = -(1 << 63)


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds the sorted array of kept hashes of a text column."""
    df, (text,), back = apart(df, [text])
    held = df.withColumn("_w", F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w)))
    w = F.col("_w")
    n = F.size(w)
    held = held.withColumn(
        "_h",
        F.when(n >= shingle, F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(w[i + j] for j in range(shingle)))))
        .when(n > 0, F.array(F.xxhash64(F.array_join(w.cast("array<string>"), " "))))
        .otherwise(F.array().cast("array<long>")),
    )
    low = F.lit(-(1 << 63) + (1 << 64) // scale)
    held = held.withColumn("_k", F.sort_array(F.array_distinct(F.filter("_h", lambda h: h < low))))
    kept = F.when((F.size("_k") == 0) & (F.size("_h") > 0), F.array(F.array_min("_h"))).otherwise(F.col("_k"))
    return back(held, [kept.alias(out)])


def as_string(sketch: Column) -> Column:
    """Hexadecimal, 16 digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other has."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def merged(sketch: Column) -> Column:
    """An aggregate: the sketch of everything in a group of sketches (of texts with kept hashes below the threshold)."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketch))))


def _splits(ids: DataFrame, rows: int) -> list[list[int]]:
    """Lists of lists of ids that cut all ids into buckets of about BUCKET_ROWS rows."""
    outer = min(BUCKETS, max(1, -(-rows // BUCKET_ROWS)))
    inner = min(BUCKETS, max(1, -(-rows // (BUCKET_ROWS * outer))))
    parts = outer * inner
    if parts == 1:
        return [[]]
    cuts = ids.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 40 * parts)).first()[0] or []
    cuts = [LEAST_ID, *cuts]
    return [cuts[i : i + inner] for i in range(0, len(cuts), inner)]


def with_next(docs: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Adds those columns of the next row by ascending key; the first row's to the last row.

    Keys are of any type that has an order. Rows go to buckets of neighbouring keys, and the first rows of each bucket also
    to the one before it, as guests; the texts are shuffled once. Null keys come first; rows with one key stand in the order of their hashes."""
    needed = list(dict.fromkeys([key, *columns]))
    docs, names, back = apart(docs, needed)
    docs, _ = numbered(docs, names[0])
    places = [names[needed.index(c)] for c in columns]
    held = docs.withColumn("_id", F.coalesce(F.col(NUMBER), F.lit(LEAST_ID)))
    ids = held.select("_id")
    splits = _splits(ids, ids.count())
    outer = F.array(*(F.lit(s[0] if s else LEAST_ID).cast("long") for s in splits))
    inner = F.array(*(F.array(*(F.lit(x).cast("long") for x in s)).cast("array<long>") for s in splits))
    width = max(len(s) for s in splits) or 1

    def bucketed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_o", F.greatest(F.size(F.filter(outer, lambda s: s <= F.col("_id"))), F.lit(1)))
        within = F.greatest(F.size(F.filter(F.element_at(inner, F.col("_o")), lambda s: s <= F.col("_id"))), F.lit(1))
        return df.withColumn("_bucket", (F.col("_o") - 1) * width + within - 1).drop("_o")

    firsts = bucketed(ids).groupBy("_bucket").agg(F.min("_id").alias("_first"))
    order = W.orderBy("_bucket")  # a row for each bucket, BUCKETS * BUCKETS at most
    last = F.last("_bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = F.lag("_bucket").over(order)
    firsts = firsts.select("_first", F.coalesce(before, last).alias("_host"), before.isNull().alias("_wraps"))
    held = bucketed(held).join(F.broadcast(firsts), F.col("_id") == F.col("_first"), "left")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest"))
    held = held.withColumn("_at", F.explode(F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_host").alias("b"), F.lit(1).alias("guest"))))))
    held = held.withColumn("_hash", F.xxhash64(*names)).withColumns({"_b": F.col("_at.b"), "_guest": F.col("_at.guest")})
    row = W.partitionBy("_b").orderBy("_guest", "_id", "_hash")
    held = held.withColumns({f"_next{i}": F.lead(c).over(row) for i, c in enumerate(places)})
    return back(held.where("_guest = 0"), [F.col(f"_next{i}").alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_sketch(docs, "text", "sketch"), "doc_id", ["text", "sketch"])
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left("next_text", cut))
    docs = with_sketch(docs.withColumn("edited", edited), "edited", "edited_sketch")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
