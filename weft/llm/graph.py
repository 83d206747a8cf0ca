"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` but the roots; root is the least node reachable.

    A large star links each node's larger neighbours to its least neighbour, a small star
    its smaller ones; repeated in turn they end in one star per component. Only minima are
    grouped (with map-side combine) and joined back, so a node with very many links is
    never gathered in one task; each round is checkpointed. Self links and nulls drop out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = durable(edges)
    state = _fingerprint(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        edges = durable(small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple:
    # the contraction's fixed point is the set of stars, so an unchanged set ends it
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)
