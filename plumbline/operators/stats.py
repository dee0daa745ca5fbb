"""Operators over any table, with the columns as parameters: distributions, ordered matching, sessions, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.sources.sinks import stored

UP_TO_HERE = (W.unboundedPreceding, 0)
BEFORE_HERE = (W.unboundedPreceding, -1)


def exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of its terms: of cents, then as a double."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def nearest_rank(value: str, p: float) -> Column:
    """The least value that at least a share p of the values doesn't exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def duration_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, extremes, mean, median, nearest-rank p95, total and skew (slowest over median) of each group."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        exact_sum(F.col(value)).alias("total"),
        F.median(value).cast("double").alias("median"),
        nearest_rank(value, 0.95).cast("double").alias("p95"),
    )
    return out.withColumn("mean", F.round(F.col("total") / F.col("n"), 1)).withColumn("skew", skew(F.col("max"), F.col("median")))


def skew(slowest: Column, median: Column) -> Column:
    return F.when(median > 0, F.round(slowest / median, 2))


def merged_by_key(df: DataFrame, key: Sequence[str], order: str, last: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """A full outer join of several kinds of rows as one aggregation: for each key, the last value of each expression
    that isn't null, and whether each flag ever held."""
    aggs = [F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in last.items()]
    aggs += [F.bool_or(c).alias(n) for n, c in (flags or {}).items()]
    return df.groupBy(*key).agg(*aggs)


def asof_last(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds the last value so far that isn't null: an as-of join of a table with itself, without a join."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_HERE)
    return df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()})


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def ranked(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """df with the place of each row in the whole order, from 1, without one task for all rows: rows are sorted by ranges,
    and each range counts on from those before it. Ranges are stored once, so that both passes see the same."""
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = stored(held, "ranked").withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(*BEFORE_HERE)), F.lit(0))
    sizes = sizes.select(F.col("_range").alias("_r"), before.alias("_before"))
    return held.join(sizes, F.col("_range") == F.col("_r")).withColumn(out, F.col("_before") + F.col("_in") + 1).drop("_at", "_range", "_in", "_r", "_before")


def positional_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right, if there is one."""
    keys = [*by, "pos"]
    return numbered(left, by, left_order).join(numbered(right, by, right_order), keys, "left")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order."""
    return numbered(df, by, order, "_n").where(F.col("_n") <= k).drop("_n")


def sessions(df: DataFrame, by: Sequence[str], order: Sequence[str], begins: Column, out: str = "session") -> DataFrame:
    """Numbers sessions: a new one begins at each row for which begins holds; rows before the first are session 0."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_HERE)
    return df.withColumn(out, F.sum(begins.cast("long")).over(w))


def running_count(df: DataFrame, by: Sequence[str], order: str, flag: Column, out: str, block: int = 100_000) -> DataFrame:
    """Adds how often flag held up to and with each row of a key, in the order of a whole number.

    Counts of blocks of the order are summed up first, so that a long key doesn't go through one task."""
    held = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_flag", flag.cast("long"))
    sums = held.groupBy(*by, "_block").agg(F.sum("_flag").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_block").rowsBetween(*BEFORE_HERE))
    sums = sums.select(*by, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_flag").over(W.partitionBy(*by, "_block").orderBy(order).rowsBetween(*UP_TO_HERE))
    return held.withColumn("_in", inside).join(sums, [*by, "_block"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_block", "_flag", "_in", "_before")


def ever_before(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, out: str) -> DataFrame:
    """Whether flag held for an earlier row of the key."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(*BEFORE_HERE)
    return df.withColumn(out, F.coalesce(F.max(flag).over(w), F.lit(False)))


def first_match(text: Column, patterns: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first pattern (a Java regular expression) that is found in the text."""
    out = None
    for name, pattern in patterns:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(other)) if other is not None else out


def template(text: Column, width: int) -> Column:
    """Text with each run of digits as N, cut."""
    return F.substring(F.regexp_replace(text, "[0-9]+", "N"), 1, width)


def template_groups(df: DataFrame, text: str, order: str, by: Sequence[str] = (), width: int = 120) -> DataFrame:
    """Rows with the same template: how many, and the first of them."""
    return df.withColumn("template", template(F.col(text), width)).groupBy(*by, "template").agg(
        F.count("*").alias("n"), F.min(order).alias("first_seq"), F.min_by(text, order).alias("example")
    )


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_and_cited(df: DataFrame, key: str, order: Sequence[Column], k: int, cited: DataFrame) -> DataFrame:
    """The first k rows and those that are cited, each once."""
    chosen = top_k(df, order, k).select(key).union(cited.select(key)).distinct()
    return df.join(chosen, key, "left_semi")


def intervals(points: DataFrame, by: Sequence[str], at: str, order: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Neighbouring points as intervals from `at` to `to`; the last one of each key has no end."""
    w = W.partitionBy(*by).orderBy(*order)
    out = points.select(*by, at, *columns, F.lead(at).over(w).alias("to"), *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return out


def interval_of(df: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the columns of the interval [start, end) of their key that holds `at`.

    Intervals of a key don't overlap, so the one that holds a point is the last that starts before it: an as-of match
    over the union, instead of a range join that compares all pairs."""
    facts = df.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"), F.lit(None).cast(spans.select(F.struct(end, start, *columns).alias("s")).schema["s"].dataType).alias("_span"))
    heads = spans.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType).alias("_row"), F.struct(end, start, *columns).alias("_span"))
    w = W.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(*UP_TO_HERE)
    both = facts.unionByName(heads).withColumn("_span", F.last("_span", ignorenulls=True).over(w)).where("_kind = 1")
    both = both.where(F.col("_span").isNotNull() & (F.col(f"_span.{end}").isNull() | (F.col("_at") < F.col(f"_span.{end}"))))
    return both.select("_row.*", *(F.col(f"_span.{c}") for c in (start, end, *columns)))


def unique_multiplicity(df: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows no other key has."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    only = n.groupBy("n").agg(F.count("*").alias("_keys"), F.min(key).alias(key)).where("_keys = 1")
    return only.select(key, "n")


def contains_join(texts: DataFrame, needles: DataFrame, text: str, needle: str, text_key: str, needle_key: str) -> DataFrame:
    """(text_key, needle_key) of each text that contains a needle.

    A text with a needle of three words or more has the needle's inner words as words of its own, so pairs are found by
    an equi join on the longest inner word. Needles of one or two words are compared with all texts."""
    words = F.split(needle, r"[ \t\n]+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w")))), 1)["w"]
    keyed = needles.select(F.col(needle_key), F.col(needle), F.when((F.size(words) > 2) & (F.length(longest) > 0), longest).alias("_w"))
    own = texts.select(text_key, text, F.explode(F.array_distinct(F.split(text, r"[ \t\n]+"))).alias("_w"))
    long_ones = own.join(keyed.where("_w IS NOT NULL"), "_w").where(F.contains(text, needle)).select(text_key, needle_key)
    short_ones = texts.join(keyed.where("_w IS NULL").drop("_w"), F.contains(texts[text], needles[needle])).select(text_key, needle_key)
    return long_ones.union(short_ones).distinct()


def neighbours(df: DataFrame, flagged: DataFrame, by: Sequence[str], at: str, reach: int) -> DataFrame:
    """Rows at most reach places from a flagged one: the places are listed, then joined by equality."""
    places = flagged.select(*by, F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(at)).distinct()
    return df.join(places, [*by, at], "left_semi")


def queue_match(pdf_events, pending_limit: int = 6):
    """Matches openings with later closings of the same size: openings wait in a queue, a closing takes the first that
    waits for its size, and then the oldest goes if more than pending_limit wait.

    pdf_events: an ordered pandas frame with kind ('open' or 'close'), seq and size; returns (open_seq, close_seq)."""
    waiting: list[tuple[int, int]] = []
    pairs = []
    for kind, seq, size in zip(pdf_events["kind"], pdf_events["seq"], pdf_events["size"]):
        if kind == "open":
            waiting.append((seq, size))
            continue
        for i, (opened, wanted) in enumerate(waiting):
            if wanted == size:
                pairs.append((opened, seq))
                del waiting[i]
                break
        if len(waiting) > pending_limit:
            waiting.pop(0)
    return pairs


def queue_join(df: DataFrame, by: Sequence[str], kind: Column, seq: str, size: str, pending_limit: int = 6) -> DataFrame:
    """queue_match for each key, in the order of seq."""
    import pandas as pd

    held = df.select(*by, kind.alias("kind"), F.col(seq).cast("long").alias("seq"), F.col(size).cast("long").alias("size")).where("kind IS NOT NULL")
    names = list(by)
    schema = held.select(*by).schema.add("open_seq", "long").add("close_seq", "long")

    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = queue_match(rows.sort_values("seq"), pending_limit)
        return pd.DataFrame([(*key, a, b) for a, b in pairs], columns=[*names, "open_seq", "close_seq"])

    return held.groupBy(*by).applyInPandas(match, schema)
