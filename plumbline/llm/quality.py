"""Quality rules with thresholds that follow each language's and source's own distribution.

Fixed rules (too few words, too much repeated text) fail a document outright. The adaptive ones compare its shares of
symbols, capitals and stuttered words and its mean word length with fences around the quartiles of its group, a pair
of language and source. Quartiles come from KLL sketches, which Spark merges from the partial aggregates of all tasks;
a group of fewer than min_group documents takes the sketch merged over its language, or over everything.

Null and empty texts have no words and fail. A null language or source is a group like any other. Repeated rows are
judged alike and each counts in the sketches. An empty table gives an empty result. Columns of the input stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import apart
from plumbline.llm.common import SPACES, documents, stored, word_array

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "symbol_share", "capital_share", "stutter_share", "word_length")


@dataclass(frozen=True)
class Fence:
    """At most so many interquartile ranges (least_range at least) beyond the quartiles."""

    measure: str
    ranges: float
    least_range: float
    both_sides: bool = False


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    min_group: int = 50
    sketch_size: int = 400
    fences: tuple[Fence, ...] = field(
        default=(
            Fence("symbol_share", 3.0, 0.005),
            Fence("capital_share", 3.0, 0.05),
            Fence("stutter_share", 3.0, 0.05),
            Fence("word_length", 5.0, 1.0, True),
        )
    )


def repeated_windows(hashes: Column) -> Column:
    """Sorted positions of the windows whose hash is in the array twice or more."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # each element beside its neighbours in hash order
    n = F.size(hashes)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.transform(placed, lambda x: x["h"]), F.lit(1), n - 1))
    after = F.concat(F.slice(F.transform(placed, lambda x: x["h"]), F.lit(2), n - 1), F.array(F.lit(None).cast("long")))
    zipped = F.arrays_zip(placed.alias("x"), before.alias("b"), after.alias("a"))
    twice = F.filter(zipped, lambda z: z["x"]["h"].eqNullSafe(z["b"]) | z["x"]["h"].eqNullSafe(z["a"]))
    return F.sort_array(F.transform(twice, lambda z: z["x"]["i"]))


def covered(positions: Column, width: int) -> Column:
    """How many places windows of that width cover which begin at the sorted positions."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        positions, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")), lambda a: a["n"]
    )


def with_measures(df: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds the counts and shares that the rules look at."""
    k = rules.window
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_w", word_array(F.col(text))).withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("_v", F.transform("_w", lambda w: F.xxhash64(w)))
    w = F.col("_v")
    out = out.withColumn(
        "_h",
        F.when(F.col("n_words") >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))).otherwise(
            F.array().cast("array<long>")
        ),
    )
    out = out.withColumn("_twice", F.size("_h") > F.size(F.array_distinct("_h")))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    chars = F.length(F.translate(t, SPACES, "")).cast("long")
    letters = F.length(F.translate(t, SPACES + "0123456789.,;:!?'\"()-" + SYMBOLS, ""))
    small = F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    stutter = F.when(F.size(w) > 1, F.size(F.filter(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.size(w) - 1).alias("b")), lambda z: z["a"] == z["b"]))).otherwise(0)
    n = F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumns(
        {
            "word_chars": chars,
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_twice"), covered(repeated_windows(F.col("_h")), k)).otherwise(F.lit(0)).cast("long"),
            "symbol_share": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))) / F.greatest(chars, F.lit(1)),
            "capital_share": (F.length(t) - small) / F.greatest(letters, F.lit(1)),
            "stutter_share": stutter / n,
            "word_length": chars / n,
        }
    ).drop("_w", "_v", "_h", "_twice", "_lines")


def thresholds(measured: DataFrame, groups: tuple[str, ...], rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each group: the lower and upper fence of each measure. groups: from the widest to the finest column."""
    names = [f.measure for f in rules.fences]
    size = F.lit(rules.sketch_size)
    own = measured.groupBy(*groups).agg(F.count("*").alias("n_0"), *(F.kll_sketch_agg_double(m, size).alias(f"{m}_0") for m in names))
    out = own
    for level in range(1, len(groups) + 1):
        keys = groups[: len(groups) - level]
        merged = own.groupBy(*keys).agg(F.sum("n_0").alias(f"n_{level}"), *(F.kll_merge_agg_double(f"{m}_0", size).alias(f"{m}_{level}") for m in names))
        merged = merged.select(*(F.col(c).alias(f"_k{c}") for c in keys), *(c for c in merged.columns if c not in keys))
        out = out.join(merged, [out[c].eqNullSafe(merged[f"_k{c}"]) for c in keys] or F.lit(True), "left").drop(*(f"_k{c}" for c in keys))
    columns = [F.col(c) for c in groups]
    for f in rules.fences:
        last = len(groups)
        sketch = F.coalesce(*(F.when(F.col(f"n_{i}") >= rules.min_group, F.col(f"{f.measure}_{i}")) for i in range(last)), F.col(f"{f.measure}_{last}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        reach = F.lit(f.ranges) * F.greatest(high - low, F.lit(f.least_range))
        columns += [(low - reach if f.both_sides else F.lit(float("-inf"))).alias(f"{f.measure}_low"), (high + reach).alias(f"{f.measure}_high")]
    return out.select(columns)


def judged(df: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), rules: QualityRules = QualityRules()) -> DataFrame:
    """df with measures, base_failed and kept. Its columns, but for the text, are stored once on the way."""
    own, names, back = apart(df, [text, *groups])
    out = _judged(own, names[0], tuple(names[1:]), rules)
    return back(out, [*MEASURES, "base_failed", "kept"], [text])


def _judged(df: DataFrame, text: str, groups: tuple[str, ...], rules: QualityRules) -> DataFrame:
    held = stored(with_measures(df, text, rules).drop(text), "quality")
    fences = thresholds(held, groups, rules).select(*(F.col(c).alias(f"_g{c}") for c in groups), *(F.col(f"{f.measure}_{s}") for f in rules.fences for s in ("low", "high")))
    out = held.join(fences, [held[c].eqNullSafe(fences[f"_g{c}"]) for c in groups], "left")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    inside = F.lit(True)
    for f in rules.fences:
        inside = inside & F.col(f.measure).between(F.col(f"{f.measure}_low"), F.col(f"{f.measure}_high"))
    drop = [f"_g{c}" for c in groups] + [f"{f.measure}_{s}" for f in rules.fences for s in ("low", "high")]
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False))).drop(*drop)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
