"""Connected components of links, by alternating large and small stars.

A large star joins every greater neighbour of a vertex to the least one, a small star every smaller or equal
one; repeated, they leave stars around the least vertex of each component. A vertex's neighbours are never
brought together: their minimum is aggregated before the exchange and joined back, where Spark can split
the rows of a vertex with very many. Each round is written to the shared folder, and only its
count and checksum go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _star(edges: DataFrame, keep) -> DataFrame:
    """Each (u, v) that keep selects becomes (v, least of u and all u's v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: two columns of one orderable type, without nulls. Returns vertex, component (its least vertex) of each vertex with a link."""
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges)
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        large = cut(large)
        # a small star looks at smaller neighbours only, and joins the vertex itself too
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        new = _state(edges)
        # a round leaves several exchanges behind, each of which has files for each of its tasks, however few links there are
        del both, large, least, small
        release(edges.sparkSession)
        if new == state:
            break
        state = new
    own = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(own)
