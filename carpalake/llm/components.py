"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of each u and its partners v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """node, least: the smallest node of each linked node's component. links: two columns of long.

    Each step aggregates before it shuffles and joins one row per node to its links, where AQE
    splits a node with many. Each round is cut by a checkpoint. Rounds grow with the
    logarithm of the longest chain of links.
    """
    a, b = links.columns
    ends = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = cut(links.select(*ends).filter("u <> v").distinct())
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = sign(edges)
    few = lambda df: sized(df, 2 * seen[0])  # noqa: E731  links are few beside documents, and so are the tasks they need
    while seen[0]:
        both = few(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = few(both.join(few(_least(both)), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")).distinct()
        large = cut(few(large))
        small = few(large.join(few(_least(large)), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v"))
        edges = cut(few(small.filter("u <> v").distinct()))
        now = sign(edges)
        if now == seen:
            break
        seen = now
    top = edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(top)
