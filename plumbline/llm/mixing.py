"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by a digest of their key), twice over. A document's virtual finish
time is the size of its source up to and with it, divided by the source's target; all documents are ranked by it over
all sources and taken until the next would exceed the budget. Running sums are taken in two levels (sums of cells, then
inside a cell), so no source and no global order lands in one task.

Null texts have size 0 and a null source is a source, the last. Documents of size 0 are taken without using budget while
the queue is served; a source without a word has the target 0, and nothing of it is taken. Repeated rows each have their own place in the queue, in any order among themselves, which changes
no figure. An empty table gives an empty result. Columns of the input stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.columns import apart
from plumbline.llm.common import documents, stored, word_array

#: Weights that sources take in turn, by code point of their names.
TURNS = (3, 1, 2)
#: Cells of the running sums: leading hexadecimal digits of a digest, parts of virtual time, parts of an octave past 2.
DIGITS, PARTS, OCTAVE = 3, 4096, 64


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", turns: tuple[int, ...] = TURNS, percent: int = 150, most: int = 2) -> DataFrame:
    """One row for each source: its size, weight and target. Targets share percent of all sizes by weight, none above
    most times its source's size; what is above goes to the others by weight until none is above."""
    total = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, turns)), ((rank - 1) % len(turns) + 1).cast("int"))
    total = total.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    # those whose cap is least for their weight are full first
    full = W.orderBy(F.col("_cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = total.withColumns(
        {
            "_left": F.sum("source_size").over(every) * percent / 100.0 - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    total = total.withColumn("_rank", F.row_number().over(full)).withColumn("_is_open", F.col("_cap") > F.col("weight") * F.col("_left") / F.col("_heavy"))
    first = F.min(F.when(F.col("_is_open"), F.struct("_rank", "_left", "_heavy"))).over(every)
    total = total.withColumn("_first", first)
    share = F.col("weight") * F.col("_first._left") / F.col("_first._heavy")
    target = F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank")), F.col("_cap").cast("double")).otherwise(share)
    return total.select(source, "source_size", "weight", target.alias("target"))


def running_sum(df: DataFrame, value: str, by: list[str], cell: str, order: list[Column], out: str) -> DataFrame:
    """Adds the sum of value up to and with each row: within by, by cell and then by order inside a cell."""
    cells = df.groupBy(*by, cell).agg(F.sum(value).alias("_s"))
    above = W.partitionBy(*by).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*(F.col(c).alias(f"_b{c}") for c in by), F.col(cell).alias("_bcell"), F.coalesce(F.sum("_s").over(above), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    held = df.withColumn("_in", F.sum(value).over(inside))
    same = [held[c].eqNullSafe(cells[f"_b{c}"]) for c in by] + [held[cell] == cells["_bcell"]]
    return held.join(cells, same).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_bcell", *(f"_b{c}" for c in by))


def queue(sizes: DataFrame, source: str = "source", key: str = "doc_id", size: str = "size", seed: str = "mix", **targets) -> DataFrame:
    """The services that the mix takes: a row for each time that a row of sizes is taken, with _turn 0 or 1."""
    each = source_targets(sizes, source, size, **targets)
    each = each.select(F.col(source).alias("_source"), "source_size", "target")
    placed = sizes.withColumn("_key", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")))
    placed = placed.withColumn("_cell", F.substring("_key", 1, DIGITS))
    placed = running_sum(placed, size, [source], "_cell", [F.col("_key"), F.col(size), F.col("_row")], "_upto")
    placed = placed.join(each, placed[source].eqNullSafe(each["_source"])).drop("_source")
    served = placed.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1))))
    served = served.withColumn("_finish", (F.col("_upto") + F.col("_turn") * F.col("source_size")) / F.nullif("target", F.lit(0.0)))
    served = served.where(F.col("_finish").isNotNull())
    cell = F.when(F.col("_finish") < 2, F.floor(F.col("_finish") * PARTS)).otherwise(F.floor(F.log2("_finish") * OCTAVE) + 2 * PARTS)
    served = served.withColumn("_cell", cell.cast("long")).withColumn("_all", F.lit(0))
    order = [F.col("_finish"), F.col("_key"), F.col(size), F.col("_turn"), F.col(source).asc_nulls_last(), F.col("_row")]
    served = running_sum(served, size, ["_all"], "_cell", order, "_served")
    budget = sizes.agg((F.sum(size) * targets.get("percent", 150) / 100.0).alias("_budget"))
    return served.join(F.broadcast(budget), F.col("_served") <= F.col("_budget")).drop("_budget", "_all", "_cell", "_upto", "_served", "_key")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the number of its words, stored; _row tells rows apart."""
    sized = docs.withColumn("size", F.size(word_array(F.col(text))).cast("long")).drop(text)
    return stored(sized.withColumn("_row", F.monotonically_increasing_id()), "mixing")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **targets) -> DataFrame:
    """docs without the text, with size, source_size, target (of its source) and taken: the words that the mix takes of it."""
    without = [text]
    own, (key, source, text), back = apart(docs, [key, source, text])
    sizes = measured(own, text)
    taken = queue(sizes, source, key, **targets).groupBy("_row").agg(F.sum("size").alias("_taken")).withColumnRenamed("_row", "_r")
    each = source_targets(sizes, source, **targets).withColumnRenamed(source, "_source").drop("weight")
    out = sizes.join(taken, F.col("_row") == F.col("_r"), "left").join(each, F.col(source).eqNullSafe(F.col("_source")))
    return back(out, ["size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")], without)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("source")


OP7_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM totals),
filled AS (
  SELECT *, row_number() OVER o AS rank,
    (sum(source_size) OVER ())::DOUBLE * 150 / 100.0 - coalesce(sum(cap) OVER b, 0)::DOUBLE AS room,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS heavy
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST),
    b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edge AS (SELECT rank AS r, room AS rm, heavy AS h FROM filled WHERE cap > weight * room / heavy ORDER BY rank LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN r IS NULL OR rank < r THEN cap::DOUBLE ELSE weight * rm / h END AS target FROM filled LEFT JOIN edge ON true),
placed AS (
  SELECT s.*, source_size, target, md5(doc_id::VARCHAR || ':mix') AS k,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id::VARCHAR || ':mix'), size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT *, (upto + turn * source_size)::DOUBLE / target AS finish FROM placed, (VALUES (0), (1)) AS v(turn) WHERE target > 0),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, k, size, turn, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto_all FROM served),
taken AS (
  SELECT doc_id, source, sum(size)::BIGINT AS taken FROM summed WHERE upto_all <= (SELECT sum(size) * 150 / 100.0 FROM sizes) GROUP BY doc_id, source)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id AND p.source IS NOT DISTINCT FROM t.source
"""
