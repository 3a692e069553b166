"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node it reaches) for the nodes of edges (a bigint, b bigint).

    Edges may be repeated, stand both ways, and join a node to itself, which leaves it out unless another edge has it; one
    with a null end is ignored. Without edges the result is empty. Other columns are ignored.

    Large and small stars in turn: each node's neighbours are hung on the least of them, first the larger ones, then the
    smaller ones, until nothing changes, which takes logarithmically many rounds. Every round is written to the shared
    folder. A root with very many leaves is joined by the skew-safe attach().
    """

    def canonical(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, rows: int, keep) -> DataFrame:
        """pairs (u, v): for each u the least of u and its v; v is hung on it."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return keep(attach(pairs, least.withColumn("m", F.least("u", "m")), "u", rows, "n"))

    e = scratch.table(canonical(edges), few=True)
    now = state(e)
    while now[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, 2 * now[0], lambda d: d.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = scratch.table(canonical(large), now[0])
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down, now[0], lambda d: d.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(d.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        after = scratch.table(canonical(small), 2 * now[0])
        scratch.drop(large)
        scratch.drop(e)
        e, was, now = after, now, state(after)
        if was == now:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
