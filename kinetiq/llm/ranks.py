"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each combination of ``keys`` (nulls are a value), without gaps.

    A group is dealt into as many parts as there are shuffle partitions, numbered part by part and shifted by the sizes
    of the parts before, so that a key with a third of all rows is not sorted in one task. Numbers follow ``order``
    inside a part only. ``df`` is read twice and has to give the same rows both times.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    by = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(by)), "_before")
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(by)]
    return local.join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))
