"""Connected components of a link table by alternating star contractions, each round written to the shared folder.

Every step is a grouped minimum (combined before the shuffle) and a join, so a vertex with very many links is
never gathered in one place.  The number of rounds grows with the logarithm of the longest chain of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b long.  Returns vertex, component: the smallest vertex reachable, for each vertex in a link.

    Links with a null end and links of a vertex with itself are ignored; repeated links count once.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = _mark(edges)
    while True:
        # each vertex ties its larger neighbours to its smallest
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each vertex ties itself and its smaller neighbours to its smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        edges = saved(small, name)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
