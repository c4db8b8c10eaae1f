"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round groups links by node with a plain minimum and joins it back, so no node's links are gathered in one row; hubs
make skewed joins, which adaptive execution splits. Rounds end when the links form stars and no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One round. ``both``: large-star, where each node hangs its larger neighbours below its smallest; else small-star."""
    near = edges.union(edges.select("v", "u")) if both else edges
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
    hung = near.join(least, "u")
    if both:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    # links of a node to itself stand for the node, so that it hangs below its smallest neighbour too
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node that has a link to another, the smallest node of its component.

    ``links`` has two columns of longs. Rows with a null, loops and repeated links add nothing. No links: no rows.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` <> `{b}`").distinct()
    edges = stored(edges, "links")
    seen = None
    while (now := _digest(edges)) != seen and now[0]:
        seen = now
        edges = stored(_stars(stored(_stars(edges, True), "large-star"), False), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
