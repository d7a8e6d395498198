"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep

#: Heavy keys of a join that are broadcast, at most, and the rows that none of the others exceeds.
SHARE, LEAST = 1 << 16, 1 << 10


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def spread_join(rows: DataFrame, per: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per``: a row for each key, ``n`` the number of its rows, of ``total`` in all.

    A key is heavy if it has over LEAST rows and over one SHARE-th of all. There are at most SHARE such keys, whatever the size: they are
    broadcast and their rows stay where they are. No other key brings a task more than that part of the rows. Null keys join nothing."""
    bound = max(LEAST, total // SHARE)
    heavy, light = F.broadcast(per.where(F.col("n") > bound).drop("n")), per.where(F.col("n") <= bound).drop("n")
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(per.where(F.col("n") > bound).select(key)), key, "left_anti").join(light, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node reachable.

    Nodes are of any orderable type; nulls and loops are ignored, repeated edges count once, an empty list gives an empty result.
    Each round is two joins on node with pre-aggregated minima. The first one meets all neighbours of a node, so nodes with very many,
    the centres of large components, are joined by broadcast; in the second, neighbours have been replaced by distinct minima. Rounds
    grow with the logarithm of the longest chain. Every round is written to the shared folder."""
    edges = edges.where((F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = keep(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both, least, "a", 2 * state[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = keep(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
