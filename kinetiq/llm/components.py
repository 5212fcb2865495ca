"""Connected components by alternating large-star and small-star steps, each a few joins over the edges.

Every step leaves one edge per node at most to a smaller node, so the edges shrink to a forest of stars. A hub with
many neighbours is only ever min-aggregated (combined map-side) and equi-joined (split by adaptive skew handling);
no neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> ``(node, component)``, component the smallest id reachable.

    Only nodes that occur in an edge are returned, roots included. Self loops, repeated and null edges are ignored; no
    edges give no rows.
    """
    e = cut(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(e)
    while state[0]:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select("v", "u"))
        low = both.groupBy("n").agg(F.min("m").alias("t")).select("n", F.least("n", "t").alias("t"))
        large = both.join(low, "n").filter("m > n").select(F.col("m").alias("u"), F.col("t").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("t"))
        small = large.join(root, "u").filter("v <> t").select(F.col("v").alias("u"), F.col("t").alias("v"))
        after = cut(small.union(root.select("u", F.col("t").alias("v"))).distinct(), "edges")
        now = _state(after)
        drop(e)
        e, done = after, now == state
        state = now
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct()
    )
