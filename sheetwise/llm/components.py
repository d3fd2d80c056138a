"""Connected components by alternating stars; edges and labels stay in tables, only two numbers a round reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_written, written


def _stated(edges: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """edges as a table, and what tells whether a round changes it: the number of rows and a sum of their hashes, observed while it is written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")).alias("h")), label)
    return table, (seen.get["n"], int(seen.get["h"] or 0))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u long, v long), in any direction, repeats and loops allowed -> (node, component): the least node that is reachable.

    Nodes without an edge to another node don't appear. Each round takes the least neighbour of every node (aggregated before it is shuffled)
    and hangs the node's larger neighbours, then its smaller ones, below it; the number of rounds grows with the logarithm of the longest path.
    A node with very many neighbours is one row on one side of a join, whose other side Spark can split."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("child"), F.least("u", "v").alias("parent")).distinct()
    now, state = _stated(pairs, "edges")
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.select(F.col("child").alias("at"), F.col("parent").alias("other")).unionAll(now.select(F.col("parent").alias("at"), F.col("child").alias("other")))
        least = both.groupBy("at").agg(F.min("other").alias("other")).select(F.col("at").alias("parent"), F.least("at", "other").alias("least"))
        large = now.join(least, "parent").select("child", F.col("least").alias("parent")).where("child <> parent").distinct()
        first = written(large, "edges")
        under = first.groupBy("child").agg(F.min("parent").alias("least"))
        small = first.join(under, "child").where("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent")).unionAll(under.select("child", F.col("least").alias("parent"))).distinct()
        before, last = state, now
        now, state = _stated(small, "edges")
        drop_written(first)
        drop_written(last)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionAll(now.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct())
