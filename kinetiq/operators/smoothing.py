"""Smoothing of series of one or many numbers a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetiq.operators.monitors import savgol
from kinetiq.operators.ordered import ordered_scan, recurrence

#: Lowest cutoff (Hz), how much speed raises it, the cutoff of the speed; noise of the process and of a
#: measurement; weights of level and trend; weight after the median.
CUTOFF, SPEED_GAIN, SPEED_CUTOFF = 1.5, 0.01, 1.0
PROCESS, MEASUREMENT = 0.001, 0.01
LEVEL, TREND, AFTER_MEDIAN = 0.3, 0.05, 0.4


def _share(cutoff, fps: float):
    """The weight of a new value in a first-order low-pass."""
    return 1 / (1 + fps / (2 * np.pi * cutoff))


def one_euro(fps: float = 30.0) -> Callable:
    """A low-pass whose cutoff rises with the speed: slow motion is steady, fast motion isn't late."""
    steady = _share(SPEED_CUTOFF, fps)

    def step(state, x):
        out = np.empty_like(x)
        place, speed = (x[0], np.zeros(x.shape[1])) if state is None else state
        for i, new in enumerate(x):
            if state is None and i == 0:
                out[0] = new
                continue
            speed = steady * (new - place) * fps + (1 - steady) * speed
            weight = _share(CUTOFF + SPEED_GAIN * np.abs(speed), fps)
            out[i] = place = weight * new + (1 - weight) * place
        return (place, speed), out

    return step


def kalman(fps: float = 30.0) -> Callable:
    """A constant-velocity Kalman filter. Its gains depend on the row's number alone, so they are shared by all numbers of a row."""
    dt = 1 / fps
    move = np.array([[1, dt], [0, 1]])
    noise = PROCESS * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])

    def step(state, x):
        out = np.empty_like(x)
        at, spread = (np.stack((x[0], np.zeros(x.shape[1]))), np.eye(2)) if state is None else state
        for i, new in enumerate(x):
            if state is None and i == 0:
                out[0] = new
                continue
            at, spread = move @ at, move @ spread @ move.T + noise
            gain = spread[:, 0] / (spread[0, 0] + MEASUREMENT)
            at = at + gain[:, None] * (new - at[0])
            spread = spread - np.outer(gain, spread[0])
            out[i] = at[0]
        return (at, spread), out

    return step


def double_ema(fps: float = 30.0) -> Callable:
    """A smoothed level that a smoothed trend carries on."""

    def step(state, x):
        out = np.empty_like(x)
        level, trend = (x[0], np.zeros(x.shape[1])) if state is None else state
        for i, new in enumerate(x):
            if state is None and i == 0:
                out[0] = new
                continue
            before, level = level, LEVEL * new + (1 - LEVEL) * (level + trend)
            trend = TREND * (level - before) + (1 - TREND) * trend
            out[i] = level + trend
        return (level, trend), out

    return step


def ema(weight: float) -> Callable:
    def make(fps: float = 30.0):
        def step(state, x):
            fed = weight * x
            if state is None:
                fed[0], state = x[0], np.zeros(x.shape[1])
            out = np.stack([recurrence(fed[:, c], 1 - weight, state[c]) for c in range(x.shape[1])], axis=1)
            return out[-1], out

        return step

    return make


#: Methods by name; each makes a step over (state, rows x numbers).
METHODS: dict[str, Callable] = {"one_euro": one_euro, "kalman": kalman, "double_ema": double_ema, "ema": ema(0.3), "median_ema": ema(AFTER_MEDIAN)}


def _median3(df: DataFrame, keys: list[str], order: list[str], col: str, wide: bool) -> DataFrame:
    """The middle of each value and its neighbours; at the ends the value counts as its own neighbour."""
    own = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.coalesce(F.lag(col).over(own), F.col(col)), F.coalesce(F.lead(col).over(own), F.col(col))
    rows = df.withColumns({"_b": before, "_a": after})
    middle = lambda a, b, c: F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    if wide:
        value = F.transform(F.arrays_zip(F.col("_b").alias("b"), F.col(col).alias("x"), F.col("_a").alias("a")), lambda z: middle(z["b"], z["x"], z["a"]))
    else:
        value = middle(F.col("_b"), F.col(col), F.col("_a"))
    return rows.withColumn("_m", value).drop("_b", "_a")


def smooth(df: DataFrame, keys: list[str], order: list[str], col: str, method: str = "one_euro", fps: float = 30.0, out: str = "smooth") -> DataFrame:
    """Each row with ``out``: ``col`` (a number, or an array of as many in all rows) smoothed along its key.

    Methods are those of METHODS and ``savgol`` (a window of seven, cubic; numbers only). Rows whose value is null or holds
    a null keep no value and leave the filter as it was.
    """
    wide = isinstance(df.schema[col].dataType, T.ArrayType)
    if method == "savgol":
        return savgol(df, keys, order, col, 7, 3).withColumnRenamed("smooth", out)
    source = col
    if method == "median_ema":
        df, source = _median3(df, keys, order, col, wide), "_m"
    filtered = METHODS[method](fps)

    def step(state, values):
        rows = [v if wide else [v] for v in values]
        has = np.array([r is not None and not any(v is None or v != v for v in r) for r in rows])
        found = np.empty(len(rows), object)
        found[:] = None
        if has.any():
            state, done = filtered(state, np.array([list(r) for r, h in zip(rows, has) if h], float))
            for i, r in zip(np.flatnonzero(has).tolist(), done.tolist()):
                found[i] = r if wide else r[0]
        if not wide:
            found = np.array([np.nan if v is None else v for v in found])
        return state, (found,)

    kind = "array<double>" if wide else "double"
    scanned = ordered_scan(df, keys, order, step, lambda: None, f"{out} {kind}", [source])
    if not wide:
        scanned = scanned.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    return scanned.drop("_m")


#: Parents and children from the trunk outwards.
CHAIN = ((0, 1), (6, 7), (0, 6), (1, 7), (0, 2), (1, 3), (2, 4), (3, 5), (6, 8), (7, 9), (8, 10), (9, 11), (10, 12), (11, 13))


def enforce_bone_lengths(df: DataFrame, keys: list[str], joints: str, out: str = "steady") -> DataFrame:
    """Each row's 14 joints (arrays of numbers) with every bone at its key's median length, from the trunk outwards.

    Medians are aggregated per key and bone and joined back, a row a key; directions stay. A bone of no length stays.
    """
    size = lambda p, c: F.sqrt(F.aggregate(F.zip_with(F.get(joints, c), F.get(joints, p), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    medians = df.groupBy(*keys).agg(F.array(*(F.percentile(size(p, c), F.lit(0.5)) for p, c in CHAIN)).alias("_bones"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = df.join(medians.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_bones"), same).drop(*(f"_k{i}" for i in range(len(keys))))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            points = np.array([[list(p) for p in row] for row in batch[joints]], float)
            goal = np.array(batch["_bones"].tolist(), float)
            for k, (p, c) in enumerate(CHAIN):
                way = points[:, c] - points[:, p]
                length = np.linalg.norm(way, axis=1)
                moved = points[:, p] + way * (goal[:, k] / np.where(length < 1e-8, 1, length))[:, None]
                points[:, c] = np.where((length < 1e-8)[:, None], points[:, c], moved)
            batch = batch.drop(columns="_bones")
            batch[out] = points.tolist()
            yield batch

    return met.mapInPandas(run, schema)
