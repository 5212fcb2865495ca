"""Gait cycles: resampling, baselines and scores against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cycles_from_strikes(frames: DataFrame, strikes: DataFrame, keys: list[str], frame: str, least: int = 15) -> DataFrame:
    """Frames with the cycle that holds them: from one strike to the next, at least ``least`` frames apart.

    A key with fewer than two strikes is one cycle over all of its frames; two strikes or more but only short gaps give
    none.
    """
    own = Window.partitionBy(*keys).orderBy("strike")
    s = strikes.withColumn("next", F.lead("strike").over(own)).withColumn("cycle", F.row_number().over(own) - 1)
    spans = s.filter(F.col("next") - F.col("strike") >= least).select(*keys, "cycle", F.col("strike").alias("start"), F.col("next").alias("stop"))
    few = frames.groupBy(*keys).agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("stop"))
    counts = strikes.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = few.join(counts, keys, "left").filter(F.coalesce("_n", F.lit(0)) < 2).select(*keys, F.lit(0).alias("cycle"), "start", "stop")
    both = spans.unionByName(whole)
    inside = (F.col(frame) >= F.col("start")) & (F.col(frame) < F.col("stop"))
    return frames.join(both, keys).filter(inside).withColumn("at", F.col(frame) - F.col("start")).withColumn("length", F.col("stop") - F.col("start")).drop("start", "stop")


def resample(cycles: DataFrame, keys: list[str], points: int = 60, values: str = "f") -> DataFrame:
    """Every cycle at ``points`` even places by linear interpolation: (keys, phase, f).

    The target grid is generated per cycle and joined with the two frames around each place.
    """
    sizes = cycles.groupBy(*keys).agg(F.max("length").alias("length"))
    grid = sizes.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    place = F.col("phase") * (F.col("length") - 1) / F.lit(points - 1)
    grid = grid.withColumn("lo", F.floor(place)).withColumn("w", place - F.floor(place))
    grid = grid.withColumn("hi", F.least(F.col("lo") + 1, F.col("length") - 1))
    a = cycles.select(*keys, F.col("at").alias("lo"), F.col(values).alias("_a"))
    b = cycles.select(*keys, F.col("at").alias("hi"), F.col(values).alias("_b"))
    met = grid.join(a, [*keys, "lo"]).join(b, [*keys, "hi"])
    w = F.col("w")
    mixed = F.transform(F.arrays_zip("_a", "_b"), lambda z: z["_a"] * (1 - w) + z["_b"] * w)
    return met.select(*keys, "phase", mixed.alias(values))


def baseline(resampled: DataFrame, keys: list[str], values: str = "f") -> DataFrame:
    """Mean and population deviation (1e-6 at least) of each phase and dimension: (keys, phase, dim, mean, std)."""
    long = resampled.select(*keys, "phase", F.posexplode(values).alias("dim", "v"))
    return long.groupBy(*keys, "phase", "dim").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("std"))


def score_cycles(resampled: DataFrame, base: DataFrame, cycle_keys: list[str], base_keys: list[str], values: str = "f") -> DataFrame:
    """Each cycle's deviation from its baseline: the mean over phases of the root mean square of |x - mean| / std."""
    long = resampled.select(*cycle_keys, "phase", F.posexplode(values).alias("dim", "v"))
    dev = long.join(base, [*base_keys, "phase", "dim"]).withColumn("d", F.abs(F.col("v") - F.col("mean")) / F.col("std"))
    frames = dev.groupBy(*cycle_keys, "phase").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"))
    return frames.groupBy(*cycle_keys).agg(F.avg("rms").alias("score"))


def mean_cycle(resampled: DataFrame, keys: list[str], values: str = "f") -> DataFrame:
    """The mean of each phase and dimension over a group's cycles."""
    long = resampled.select(*keys, "phase", F.posexplode(values).alias("dim", "v"))
    return long.groupBy(*keys, "phase", "dim").agg(F.avg("v").alias("mean"))
