"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating algorithm: neighbours are hung under the least of them."""
    both = links if not large else links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
    hung = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select(F.col("_u"), F.col("_m")))
    return out.where("u <> v").distinct()


def is_forest_of_stars(links: DataFrame) -> bool:
    """Whether each vertex hangs under one other, under which nothing else is hung: v < u, so all v are the least then."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
    held = ends.groupBy("x").agg(F.sum("hangs").alias("over"), F.min("hangs").alias("least"))
    return held.where("over > 1 OR (over = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, v) for each vertex u of a table of links (u, v) that isn't the least of its component v.

    Large-star and small-star steps by turns, until all components are stars. Each step is an aggregation and a join; no
    neighbourhood is gathered, and each round is stored in the shared folder."""
    links = stored(links.where("u <> v").distinct(), "links")
    while True:
        before, links = links, stored(_star(_star(links, True), False), "links")
        dropped(before)
        if is_forest_of_stars(links):
            return links
