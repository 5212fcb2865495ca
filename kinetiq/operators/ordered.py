"""Operators over the ordered rows of a key: windows where a window can say it, a sorted scan for recurrences."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], step: Callable, init: Callable, out: str, needs: list[str]) -> DataFrame:
    """Carry a state through each key's rows in order and add the columns ``out``.

    ``step(state, *arrays) -> (state, arrays)`` gets the columns ``needs`` of as many of a key's rows as a batch holds and
    returns an array for each new column. Rows are dealt by key and sorted within partitions, then streamed: a key of any
    length needs the memory of one batch. Null keys are a key like any other.
    """
    added = T._parse_datatype_string(out)
    schema = T.StructType([*df.schema.fields, *added.fields])
    names = [f.name for f in added.fields]

    def run(batches):
        last, state = None, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            codes = [pd.factorize(batch[k], use_na_sentinel=False) for k in keys]
            new = np.zeros(n, bool)
            new[0] = True
            for code, _ in codes:
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            cols, found = [batch[c].to_numpy() for c in needs], []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                key = tuple(None if pd.isna(v) else v for v in (batch[k].iat[i] for k in keys))
                if i or last is None or key != last:
                    last, state = key, init()
                state, arrays = step(state, *(c[i:j] for c in cols))
                found.append(arrays)
            new_cols = pd.DataFrame({name: np.concatenate([f[k] for f in found]) for k, name in enumerate(names)})
            yield pd.concat([batch.reset_index(drop=True), new_cols], axis=1)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


#: Rows that a recurrence is worked out for at once.
_BLOCK = 256


@functools.lru_cache(maxsize=64)
def _powers(keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``keep``, and those of the distances of a block's rows below its diagonal."""
    powers, at = keep ** np.arange(_BLOCK + 1), np.arange(_BLOCK)
    return powers, np.tril(powers[np.abs(np.subtract.outer(at, at))])


def recurrence(x: np.ndarray, keep: float, before: float) -> np.ndarray:
    """y = x + keep * y before, as a triangular product per block of rows."""
    powers, lower = _powers(float(keep))
    out = np.empty(len(x))
    for i in range(0, len(x), _BLOCK):
        part = x[i : i + _BLOCK]
        out[i : i + len(part)] = lower[: len(part), : len(part)] @ part + before * powers[1 : len(part) + 1]
        before = out[i + len(part) - 1]
    return out


def _own(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def frame_velocity(feat: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """L2 distance of ``f`` to the previous row's; 0 for the first."""
    before = F.lag("f").over(_own(keys, order))
    return feat.withColumn("velocity", F.coalesce(l2(F.col("f"), before), F.lit(0.0)))


def ema(df: DataFrame, keys: list[str], order: list[str], col: str, alpha: float) -> DataFrame:
    """Exponential mean: alpha * x + (1 - alpha) * before, from the first value; nulls leave it as it was."""

    def step(state, x, alpha=alpha):
        x = x.astype(float)
        has = ~np.isnan(x)
        out = np.full(len(x), np.nan if state is None else state)
        if has.any():
            values = alpha * x[has]
            if state is None:
                values[0], state = x[has][0], 0.0
            found = recurrence(values, 1 - alpha, state)
            out[has], state = found, found[-1]
            at = np.maximum.accumulate(np.where(has, np.arange(len(x)), -1))
            out[at >= 0] = out[at[at >= 0]]
        return state, (out,)

    return ordered_scan(df, keys, order, step, lambda: None, "ema double", [col])


def decaying_peak(df: DataFrame, keys: list[str], order: list[str], col: str, decay: float) -> DataFrame:
    """max(x, peak before * decay), 0 before the first positive value: a running maximum of logarithms on a falling line."""
    own = _own(keys, order)
    fall = (F.row_number().over(own) - 1) * float(np.log(decay))
    d = df.withColumn("_f", fall)
    rise = F.max(F.when(F.col(col) > 0, F.ln(col) - F.col("_f"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("peak", F.coalesce(F.exp(rise + F.col("_f")), F.lit(0.0))).drop("_f")


def cooldown(df: DataFrame, keys: list[str], order: list[str], col: str, gap: float, strict: bool = False) -> DataFrame:
    """Keep a row when ``col`` is at least ``gap`` (more than, if strict) past that of the last kept row.

    ``order`` begins with ``col``, so each kept row's successor is found by bisection. Rows without ``col`` are dropped.
    """

    def step(state, at, gap=gap, side="right" if strict else "left"):
        at, keep = at.astype(float), np.zeros(len(at), bool)
        i = 0 if state is None else int(np.searchsorted(at, state + gap, side))
        while i < len(at):
            keep[i], state = True, at[i]
            i = max(i + 1, int(np.searchsorted(at, state + gap, side)))
        return state, (keep,)

    return ordered_scan(df.filter(F.col(col).isNotNull()), keys, order, step, lambda: None, "kept boolean", [col]).filter("kept").drop("kept")


def consolidate_events(df: DataFrame, keys: list[str], order: list[str], time: str, seconds: float = 5.0) -> DataFrame:
    """Drop an event within ``seconds`` of the last kept one of its key."""
    return cooldown(df, keys, order, time, seconds, strict=True)


def fatigue_index(df: DataFrame, keys: list[str], order: list[str], col: str, rows: int = 300, least: int = 60, alpha: float = 0.05) -> DataFrame:
    """Relative fall from the mean of the first half of the last ``rows`` values to that of the second, 0 to 1, smoothed."""
    frame = _own(keys, order).rowsBetween(-(rows - 1), 0)
    held = F.collect_list(col).over(frame)
    half = F.expr("size(held) div 2")
    mean = lambda part: F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, v: s + v), F.size(part))
    first, second = mean(F.expr("slice(held, 1, half)")), mean(F.expr("slice(held, half + 1, size(held))"))
    fall = F.when(F.col("a") > 1e-6, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("a") - F.col("b")) / F.col("a")))).otherwise(0.0)
    raw = F.when(F.size("held") >= least, fall)
    found = df.withColumn("held", held).withColumn("half", half).withColumn("a", first).withColumn("b", second)
    found = found.withColumn("raw", raw).drop("held", "half", "a", "b")

    def step(state, raw, alpha=alpha):
        raw = raw.astype(float)
        has, out = ~np.isnan(raw), np.full(len(raw), state)
        if has.any():
            out[has] = recurrence(alpha * raw[has], 1 - alpha, state)
            state = out[has][-1]
        return state, (out,)

    return ordered_scan(found, keys, order, step, lambda: 0.0, "fatigue double", ["raw"]).drop("raw")


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column) -> DataFrame:
    """Number the runs of a key's rows: ``new`` says that a row begins one."""
    own = _own(keys, order)
    return df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(own)).drop("_new")


def contiguous_regions(df: DataFrame, keys: list[str], order: str, mask: Column) -> DataFrame:
    """Runs of rows where ``mask`` holds: (keys, start, end), both in the run, by consecutive ``order`` values."""
    own = _own(keys, [order])
    on = df.filter(mask)
    runs = on.withColumn("_g", F.col(order) - F.row_number().over(own))
    return runs.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end")).drop("_g")


def merge_adjacent(df: DataFrame, keys: list[str], order: list[str], label: str, start: str, end: str) -> DataFrame:
    """Neighbouring rows of equal label, null being one, as one row: (keys, label, start, end, n)."""
    own = _own(keys, order)
    first = F.row_number().over(own) == 1
    runs = islands(df, keys, order, first | ~F.lag(label).over(own).eqNullSafe(F.col(label)))
    return runs.groupBy(*keys, "island").agg(
        F.first(label).alias(label), F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")
    ).drop("island")


def timeline_segments(df: DataFrame, keys: list[str], time: str, label: str, tie: list[str], gap: float = 0.5) -> DataFrame:
    """Runs of equal label whose rows are under ``gap`` apart; a null label ends a run."""
    own = _own(keys, [time, *tie])
    new = (F.lag(label).over(own).isNull()) | (F.lag(label).over(own) != F.col(label)) | (F.col(time) - F.lag(time).over(own) >= gap)
    runs = islands(df, keys, [time, *tie], new).filter(F.col(label).isNotNull())
    return runs.groupBy(*keys, "island", label).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("island")


def temporal_pattern(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """uniform (one label), sequential (each label one run), alternating (two runs or more of labels seen before, or one of
    two labels) or mixed."""
    own = _own(keys, order)
    steps = df.withColumn("_c", (F.lag(label).over(own) != F.col(label)).cast("int"))
    a = steps.groupBy(*keys).agg(F.countDistinct(label).alias("labels"), F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"))
    again = F.col("changes") + 1 - F.col("labels")
    pattern = (
        F.when(F.col("labels") == 1, "uniform")
        .when(again == 0, "sequential")
        .when((again >= 2) | ((again == 1) & (F.col("labels") == 2)), "alternating")
        .otherwise("mixed")
    )
    return a.select(*keys, pattern.alias("pattern"))


def interpolate_nulls(df: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """Linear between the neighbours that have a value, clamped at the ends, 0 where a key has none."""
    back = _own(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _own(keys, [order]).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col(order))
    x0, x1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    y0, y1 = F.last(col, True).over(back), F.first(col, True).over(ahead)
    between = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col(order) - x0) / (x1 - x0))
    return df.withColumn("filled", F.coalesce(between, y0, y1, F.lit(0.0)))


def unwrap_angle(df: DataFrame, keys: list[str], order: list[str], col: str) -> DataFrame:
    """Add the multiples of a full turn that keep steps within half a turn."""
    own, turn = _own(keys, order), F.lit(6.283185307179586)
    step = F.col(col) - F.lag(col).over(own)
    shift = F.when(F.abs(step) > 3.141592653589793, -turn * F.round(step / turn)).otherwise(0.0)
    total = df.withColumn("_s", F.coalesce(shift, F.lit(0.0)))
    return total.withColumn("unwrapped", F.col(col) + F.sum("_s").over(own)).drop("_s")


def convolve(df: DataFrame, keys: list[str], order: list[str], col: str, kernel: list[float]) -> DataFrame:
    """Centred convolution with zeros outside."""
    own, half = _own(keys, order), len(kernel) // 2
    terms = [F.coalesce(F.lag(col, half - i).over(own), F.lit(0.0)) * w for i, w in enumerate(reversed(kernel))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn("smoothed", total)


def curvature_jerk(feat: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """From a row and the three before: acceleration across the previous velocity over its square, and the change of
    acceleration. 0 where there are too few rows, and for the curvature where that velocity is under 1e-8."""
    own = _own(keys, order)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    d = feat.withColumn("v", minus(F.col("f"), F.lag("f").over(own))).withColumn("u", F.lag("v").over(own))
    d = d.withColumn("a", minus(F.col("v"), F.col("u")))
    d = d.withColumn("j", minus(F.col("a"), F.lag("a").over(own)))
    d = d.withColumn("uu", dot(F.col("u"), F.col("u"))).withColumn("aa", dot(F.col("a"), F.col("a"))).withColumn("ua", dot(F.col("u"), F.col("a")))
    across = F.sqrt(F.greatest(F.lit(0.0), F.col("aa") - F.col("ua") * F.col("ua") / F.col("uu")))
    bend = F.when(F.sqrt("uu") >= 1e-8, across / F.col("uu")).otherwise(0.0)
    jerk = F.coalesce(F.sqrt(dot(F.col("j"), F.col("j"))), F.lit(0.0))
    return d.withColumn("curvature", bend).withColumn("jerk", jerk).drop("v", "u", "a", "j", "uu", "aa", "ua")


def sample_even(df: DataFrame, keys: list[str], order: list[str], n: int = 4) -> DataFrame:
    """``n`` evenly spaced rows of a key: those at floor(i * rows / n); all rows of a shorter key."""
    numbered = df.withColumn("_r", F.row_number().over(_own(keys, order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    wanted = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("_n") / n) == F.col("_r"))
    return numbered.filter((F.col("_n") <= n) | wanted).drop("_r", "_n")


def score_decay(df: DataFrame, frame: str, score: str, now: Column, rate: float = 0.995, least: float = 0.5) -> DataFrame:
    """A score after ``now - frame`` frames of decay; rows below ``least`` are gone."""
    left = F.col(score) * F.pow(F.lit(rate), now - F.col(frame))
    return df.withColumn("left", left).filter(F.col("left") >= least)


def acceleration_series(df: DataFrame, keys: list[str], order: list[str], time: str, speed: str, alpha: float = 0.3, least: float = 0.001) -> DataFrame:
    """Smoothed abs(change of speed) / dt: a row for each step whose dt is over ``least``, the first as it is."""
    own = _own(keys, order)
    dt = F.col(time) - F.lag(time).over(own)
    steps = df.withColumn("_a", F.when(dt > least, F.abs(F.col(speed) - F.lag(speed).over(own)) / dt)).filter("_a is not null")
    return ema(steps, keys, order, "_a", alpha).withColumnRenamed("ema", "acceleration").drop("_a")


def track_changes(df: DataFrame, keys: list[str], order: list[str], track: str, most: int = 3) -> DataFrame:
    """How often a key's track changes; unstable beyond ``most``."""
    own = _own(keys, order)
    steps = df.withColumn("_c", (F.lag(track).over(own) != F.col(track)).cast("int"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("switches")).withColumn("unstable", F.col("switches") > most)
