"""Connected components of links between rows, and where intermediate tables of iterations are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, where lineage ends. Only a local session without one gets its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="kinetiq-")
            spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> (node, component): the smallest node reachable, for all nodes of links.

    Every round each node's larger neighbours are linked to its smallest one, then each node to the smallest of its smaller
    neighbours, until nothing changes: a few aggregates and equi-joins a round, a logarithmic number of rounds in practice.
    """
    kept = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, before = checkpointed(kept), None
    while True:
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = kept.select(F.col("u").alias("n"), F.col("v").alias("m")).union(kept.select("v", "u"))
        lowest = both.groupBy("n").agg(F.least("n", F.min("m")).alias("low"))
        outward = both.join(lowest, "n").filter("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        root = outward.groupBy("u").agg(F.min("v").alias("low"))
        inward = outward.join(root, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        kept = checkpointed(inward.union(root.select("u", F.col("low").alias("v"))).distinct())
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(kept.select("v", "v").distinct())
