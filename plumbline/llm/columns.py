"""Names of columns: operators work under names of their own, so that no input column can clash with theirs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stored

OTHERS, NUMBER = "_others", "_number"


def own_name(i: int) -> str:
    return f"_in{i}"


def apart(df: DataFrame, needed: Iterable[str], **computed: Column) -> tuple[DataFrame, list[str], Callable[..., DataFrame]]:
    """df with the needed columns under names of their own and all others in one struct; those names; and the way back.

    computed: columns that are taken from df as it is. back(out, results, without) selects df's columns from out, but for
    those without and those that have the name of a result, and then the results."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    names = {c: own_name(i) for i, c in enumerate(dict.fromkeys(needed))}
    others = {c: f"c{i}" for i, c in enumerate(c for c in df.columns if c not in names)}
    packed = F.struct(*(quoted(c).alias(n) for c, n in others.items())) if others else F.lit(None).cast("int")
    held = df.select(*(quoted(c).alias(n) for c, n in names.items()), packed.alias(OTHERS), *(v.alias(k) for k, v in computed.items()))

    def back(out: DataFrame, results: Iterable[str | Column], without: Iterable[str] = ()) -> DataFrame:
        results = [quoted(r) if isinstance(r, str) else r for r in results]
        called = set(out.select(*results).columns) | set(without)
        kept = [(F.col(names[c]) if c in names else F.col(OTHERS)[others[c]]).alias(c) for c in df.columns if c not in called]
        return out.select(*kept, *results)

    return held, list(names.values()), back


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """df with NUMBER, a long integer that rises with the key: the key itself, if it is an integer; else distinct keys are
    sorted over all partitions and numbered, and that table (key, NUMBER) comes too. A null key has no number."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df.withColumn(NUMBER, F.col(key).cast("long")), None
    keys = df.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct().repartitionByRange("_key").sortWithinPartitions("_key")
    keys = stored(keys.withColumn(NUMBER, F.monotonically_increasing_id()), "keys")
    return df.join(keys, F.col(key) == F.col("_key"), "left").drop("_key"), keys
