"""Building blocks of batch jobs: spec-driven cleaning, deduplication, conditional aggregates, rule tables, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cleaned(df: DataFrame, spec: Mapping[str, tuple[str, object]], blanks: Sequence[str] = ("", "null", "N/A")) -> DataFrame:
    """Columns of the spec cast to their type, with their default for null, blank and unreadable values."""
    out = {}
    for name, (kind, default) in spec.items():
        text = F.trim(F.col(name).cast("string"))
        value = F.when(text.isNull() | text.isin(*blanks), None).otherwise(text)
        value = value if kind == "string" else value.try_cast(kind)
        out[name] = F.coalesce(value, F.lit(default).cast(kind))
    return df.withColumns(out)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def distinct_where(condition: Column, value: Column) -> Column:
    return F.countDistinct(F.when(condition, value))


def only_value(value: str) -> Column:
    """An aggregate: the group's value if it has one only (nulls don't count)."""
    return F.when(F.countDistinct(value) == 1, F.max(value))


def least_row(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each key the least row by those columns in turn, in one aggregation."""
    return df.groupBy(*by).agg(F.min(F.struct(*columns)).alias("_r")).select(*by, "_r.*")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def rule_case(rules: Sequence[tuple[Column, Column | str]], other: Column | str | None = None) -> Column:
    """The outcome of the first rule whose condition holds."""
    out = None
    for condition, outcome in rules:
        value = outcome if isinstance(outcome, Column) else F.lit(outcome)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if other is None else out.otherwise(other if isinstance(other, Column) else F.lit(other))


def filled_union(parts: Sequence[DataFrame], keys: Sequence[str], metrics: Sequence[str], fill: object = 0) -> DataFrame:
    """A union of tables of which each has some of the metrics; those that it lacks are filled."""
    out = None
    for part in parts:
        named = part.select(*keys, *(F.col(m) if m in part.columns else F.lit(fill).alias(m) for m in metrics))
        out = named if out is None else out.unionByName(named)
    return out


def summed(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(m).alias(m) for m in metrics))


def looked_up(df: DataFrame, table: DataFrame, on: Column, default: Mapping[str, object] | None = None) -> DataFrame:
    """A left join with a small table of codes; columns of it that find nothing get a default.

    Whether the table is broadcast is left to its size."""
    return df.join(table, on, "left").fillna(dict(default or {}))


def flattened(spark, nested: Mapping[str, Mapping[str, str]], columns: Sequence[str]) -> DataFrame:
    """Rows (outer key, inner key, value) of a nested mapping of literals."""
    return spark.createDataFrame([(a, b, v) for a, inner in nested.items() for b, v in inner.items()], list(columns))


def calendar(spark, first: str, last: str, column: str = "day") -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS {column}")


def by_two_branches(df: DataFrame, condition: Column, yes, no) -> DataFrame:
    """Rows for which the condition holds go through one function, all others (null too) through another."""
    held = F.coalesce(condition, F.lit(False))
    return yes(df.where(held)).unionByName(no(df.where(~held)))


def without(df: DataFrame, *columns: str, **computed: Column) -> DataFrame:
    """All columns but some, with computed ones in their place."""
    return df.select(*(c for c in df.columns if c not in columns and c not in computed), *(v.alias(k) for k, v in computed.items()))
