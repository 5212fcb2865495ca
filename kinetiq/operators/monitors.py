"""Control charts, filters and event detectors over the ordered rows of a key."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetiq.functions import physics as P
from kinetiq.functions.geometry import let
from kinetiq.functions.skeleton import BONES
from kinetiq.operators.ordered import _own, cooldown, islands, ordered_scan, recurrence


def angular_velocity(df: DataFrame, keys: list[str], order: list[str], angle: str, fps: float = 30.0) -> DataFrame:
    """Degrees a second between rows that have an angle; rows without one are skipped, the first of a key has none."""
    seen = df.filter(F.col(angle).isNotNull())
    return seen.withColumn("omega", F.abs(F.col(angle) - F.lag(angle).over(_own(keys, order))) * fps)


def risk_moments(snapshots: DataFrame, risks: DataFrame, keys: list[str], time: str, least: float = 0.3) -> DataFrame:
    """Runs of consecutive snapshots in which a joint has a risk: start, end, duration, peak, severity, threshold and rank.

    ``snapshots(keys, time)`` has every snapshot; ``risks(keys, time, risk, joint, severity, value, threshold)`` those of
    severity medium or high count. A run's threshold is its first; high anywhere makes it high. Runs shorter than ``least``
    go. Ranks put high first, then the longest.
    """
    number = F.row_number().over(_own(keys, [time]))
    at = snapshots.select(*keys, time).distinct().withColumn("_n", number)
    rows = risks.filter(F.col("severity").isin("medium", "high")).join(at, [*keys, time])
    own = [*keys, "risk", "joint"]
    gap = F.col("_n") - F.lag("_n").over(_own(own, ["_n"])) > 1
    runs = islands(rows, own, ["_n"], gap).groupBy(*own, "island")
    out = runs.agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.max("value").alias("peak"),
        F.when(F.max(F.col("severity") == "high"), "high").otherwise("medium").alias("severity"), F.min_by("threshold", "_n").alias("threshold"),
    ).drop("island")
    out = out.withColumn("duration", F.col("end") - F.col("start")).filter(F.col("duration") >= least)
    rank = Window.partitionBy(*keys).orderBy(F.col("severity") != "high", F.desc("duration"), "start", "risk", "joint")
    return out.withColumn("rank", F.row_number().over(rank))


def _runs(df: DataFrame, keys: list[str], order: str, label: str, *more) -> DataFrame:
    """Runs of equal label: (keys, island, label, start, end, n), ``order`` consecutive within a run."""
    first = F.row_number().over(_own(keys, [order])) == 1
    runs = islands(df, keys, [order], first | ~F.lag(label).over(_own(keys, [order])).eqNullSafe(F.col(label)))
    return runs.groupBy(*keys, "island").agg(F.first(label).alias(label), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *more)


def label_runs(df: DataFrame, keys: list[str], order: str, label: str, confidence: str, step: float, least: float = 1.0) -> DataFrame:
    """Runs of equal label as seconds from rows ``step`` seconds apart: (keys, label, start, end, confidence).

    Runs under ``least`` seconds join the longer neighbour (the one before, of equals) until none is left; then neighbours
    of one label become one, of mean confidence. Only runs, not rows, meet per key.
    """
    runs = _runs(df, keys, order, label, F.avg(confidence).alias("confidence"))

    def merge(pdf):
        import pandas as pd

        rows = pdf.sort_values("island")
        segs = [[r[0], r[1] * step, (r[2] + 1) * step, r[3]] for r in rows[[label, "start", "end", "confidence"]].itertuples(index=False)]
        changed = True
        while changed and len(segs) > 1:
            changed, out = False, []
            for i, s in enumerate(segs):
                later = segs[i + 1] if i + 1 < len(segs) else None
                if s[2] - s[1] < least and (out or later):
                    changed = True
                    if out and (later is None or out[-1][2] - out[-1][1] >= later[2] - later[1]):
                        out[-1][2] = s[2]
                    else:
                        later[1] = s[1]
                else:
                    out.append(s)
            segs = out
        final = segs[:1]
        for s in segs[1:]:
            if s[0] == final[-1][0]:
                final[-1][2], final[-1][3] = s[2], (final[-1][3] + s[3]) / 2
            else:
                final.append(s)
        out = pd.DataFrame(final, columns=[label, "start", "end", "confidence"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, label, "start", "end", "confidence"]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in [*keys, label])
    return runs.groupBy(*keys).applyInPandas(merge, f"{kinds}, start double, end double, confidence double")


def temporal_smooth_labels(df: DataFrame, keys: list[str], order: list[str], label: str, least: int) -> DataFrame:
    """``smoothed``: runs of fewer than ``least`` rows take the label before them; a key's first run stays."""
    number = F.row_number().over(_own(keys, order))
    rows = df.withColumn("_at", number)
    runs = _runs(rows, keys, "_at", label)
    first = F.min("start").over(Window.partitionBy(*keys))
    kept = F.when((F.col("n") >= least) | (F.col("start") == first), F.col(label))
    name = F.last(kept, True).over(_own(keys, ["start"]).rowsBetween(Window.unboundedPreceding, 0))
    named = runs.withColumn("smoothed", name).select(*keys, F.col("island").alias("_island"), "smoothed")
    first_row = F.row_number().over(_own(keys, ["_at"])) == 1
    marked = islands(rows, keys, ["_at"], first_row | ~F.lag(label).over(_own(keys, ["_at"])).eqNullSafe(F.col(label)))
    on = [marked[k].eqNullSafe(named[k]) for k in keys] + [marked["island"] == named["_island"]]
    return marked.join(named, on).select(*(marked[c] for c in df.columns), "smoothed")


def savgol_weights(window: int, degree: int, deriv: int = 0) -> np.ndarray:
    """Row p: what the polynomial fitted to a window's values says (of its derivative) at place p."""
    x = np.arange(window)
    a = np.vander(x, degree + 1, increasing=True)
    fit = np.linalg.pinv(a)
    if deriv == 0:
        return a @ fit
    d = np.zeros_like(a, dtype=float)
    for k in range(1, degree + 1):
        d[:, k] = k * x.astype(float) ** (k - 1)
    return d @ fit


def savgol(df: DataFrame, keys: list[str], order: list[str], col: str, window: int = 5, degree: int = 2, deriv: int = 0) -> DataFrame:
    """Polynomial smoothing with fixed weights: centred inside, from the first and last window at the ends. Keys with fewer
    rows than the window keep their values (0 for a derivative)."""
    own, half = _own(keys, order), window // 2
    i = F.row_number().over(own) - 1
    rows = df.withColumn("_i", i).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    place = F.when(F.col("_i") < half, F.col("_i")).when(F.col("_i") >= F.col("_n") - half, F.col("_i") - F.col("_n") + window).otherwise(half)
    rows = rows.withColumn("_p", place)
    out = F.lit(0.0) if deriv else F.col(col).cast("double")
    for p, weights in enumerate(savgol_weights(window, degree, deriv)):
        value = reduce(lambda s, t: s + t, (float(w) * F.lag(col, p - k).over(own) for k, w in enumerate(weights)))
        out = F.when((F.col("_n") >= window) & (F.col("_p") == p), value).otherwise(out)
    return rows.withColumn("smooth", out).drop("_i", "_n", "_p")


def _sub(a: Column, b: Column) -> tuple[Column, Column]:
    return a["x"] - b["x"], a["y"] - b["y"]


def closing_velocity(a: Column, b: Column, scale: Column, fps: float, most: float = 10.0) -> Column:
    """Speed (m/s) at which two heads near each other from their last five places or fewer (arrays of x, y, oldest first).

    Five places are smoothed first; the central difference over the last three is projected on the line between the heads.
    Fewer than three give 0, going apart too; ``most`` is the ceiling.
    """
    weights = savgol_weights(5, 2)

    def place(h, back):
        raw = F.get(h, F.size(h) - 1 - back)
        row = weights[4 - back]
        smooth = F.struct(*(reduce(lambda s, t: s + t, (F.get(h, k)[c] * float(w) for k, w in enumerate(row))).alias(c) for c in "xy"))
        return F.when(F.least(F.size(a), F.size(b)) >= 5, smooth).otherwise(F.struct(raw["x"].alias("x"), raw["y"].alias("y")))

    def speed(s):
        (ax, ay), (bx, by), (lx, ly) = _sub(s["a0"], s["a2"]), _sub(s["b0"], s["b2"]), _sub(s["b0"], s["a0"])
        v = F.struct(((ax - bx) * fps / 2).alias("x"), ((ay - by) * fps / 2).alias("y"), lx.alias("lx"), ly.alias("ly"))
        along = lambda v: F.when(v["apart"] < 1e-6, F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])).otherwise((v["x"] * v["lx"] + v["y"] * v["ly"]) / v["apart"])
        return let(let(v, lambda v: v.withField("apart", F.sqrt(v["lx"] * v["lx"] + v["ly"] * v["ly"]))), along)

    last = F.struct(*(place(h, k).alias(f"{n}{k}") for n, h in (("a", a), ("b", b)) for k in (0, 2)))
    enough = (F.size(a) >= 3) & (F.size(b) >= 3) & (scale > 0)
    return F.when(enough, F.least(F.lit(most), F.greatest(F.lit(0.0), let(last, speed) * scale))).otherwise(0.0)


def approach_angle(a: Column, b: Column, fps: float) -> Column:
    """Radians between the relative velocity and the line between two heads, from unsmoothed places; 0 without either."""
    last = lambda h, k: F.get(h, F.size(h) - 1 - k)

    def lines(s):
        (ax, ay), (bx, by), (lx, ly) = _sub(s["a0"], s["a2"]), _sub(s["b0"], s["b2"]), _sub(s["b0"], s["a0"])
        return F.struct(((ax - bx) * fps / 2).alias("vx"), ((ay - by) * fps / 2).alias("vy"), lx.alias("lx"), ly.alias("ly"))

    def angle(s):
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (s["vx"] * s["lx"] + s["vy"] * s["ly"]) / (s["v"] * s["l"])))
        return F.when((s["v"] >= 1e-6) & (s["l"] >= 1e-6), F.acos(cos)).otherwise(0.0)

    places = F.struct(*(last(h, k).alias(f"{n}{k}") for n, h in (("a", a), ("b", b)) for k in (0, 2)))
    sized = lambda s: s.withField("v", F.sqrt(s["vx"] * s["vx"] + s["vy"] * s["vy"])).withField("l", F.sqrt(s["lx"] * s["lx"] + s["ly"] * s["ly"]))
    return F.when((F.size(a) >= 3) & (F.size(b) >= 3), let(let(let(places, lines), sized), angle)).otherwise(0.0)


def head_history(df: DataFrame, keys: list[str], order: list[str], head: str, rows: int = 5) -> DataFrame:
    """Each row with the key's last places of the head, of rows that have one."""
    seen = df.filter(F.col(head).isNotNull())
    return seen.withColumn("history", F.collect_list(head).over(_own(keys, order).rowsBetween(-(rows - 1), 0)))


def degrading_joints(scores: DataFrame, keys: list[str], order: list[str], joint: str, score: str, rows: int = 120, least: int = 60, part: int = 30) -> DataFrame:
    """Rows at which a joint's mean score over the last ``part`` of its last ``rows`` rows is over a tenth below that of the first."""
    frame = _own([*keys, joint], order).rowsBetween(-(rows - 1), 0)
    held = scores.withColumn("_h", F.collect_list(score).over(frame))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / part
    held = held.filter(F.size("_h") >= least).withColumn("early", mean(F.slice("_h", 1, part))).withColumn("recent", mean(F.slice("_h", -part, part)))
    return held.filter((F.col("early") > 0.1) & ((F.col("early") - F.col("recent")) / F.col("early") > 0.1)).drop("_h")


def ewma_alarms(reps: DataFrame, keys: list[str], rep: str, joint: str, dim: str, dev: str, first: int, weight: float = 0.2, width: float = 2.7) -> DataFrame:
    """(keys, joint, rep): the first repetition at which the smoothed deviation of one of a joint's dimensions leaves its
    control limit. The limit comes from the first ``first`` repetitions, which raise no alarm."""
    own = [*keys, joint, dim]
    base = Window.partitionBy(*own)
    early = F.when(F.col(rep) < first, F.col(dev))
    rows = reps.withColumn("_m", F.avg(early).over(base)).withColumn("_s", F.greatest(F.stddev_pop(early).over(base), F.lit(1e-6)))
    rows = rows.withColumn("_v", F.when(F.col(rep) == 0, F.col("_m")).otherwise(weight * F.col(dev)))

    def step(state, v):
        out = recurrence(v.astype(float), 1 - weight, state)
        return out[-1], (out,)

    scanned = ordered_scan(rows, own, [rep], step, lambda: 0.0, "ewma double", ["_v"])
    factor = F.sqrt(weight / (2 - weight) * (1 - F.pow(F.lit(1 - weight), 2 * (F.col(rep) + 1))))
    alarm = (F.col("ewma") > F.col("_m") + width * F.col("_s") * factor) & (F.col(rep) >= first) & (F.col(rep) > 0)
    return scanned.filter(alarm).groupBy(*keys, joint).agg(F.min(rep).alias(rep))


def cusum(reps: DataFrame, keys: list[str], rep: str, distance: str, first: int) -> DataFrame:
    """Each repetition with its one-sided cumulative sum and the key's ``onset``, the first beyond four deviations.

    The recurrence max(0, before + x) is a prefix sum less its smallest value so far.
    """
    all_rows, own = Window.partitionBy(*keys), _own(keys, [rep])
    early = F.when(F.col(rep) < first, F.col(distance))
    rows = reps.withColumn("_m", F.avg(early).over(all_rows)).withColumn("_s", F.greatest(F.stddev_pop(early).over(all_rows), F.lit(1e-6)))
    x = F.when(F.col(rep) == 0, 0.0).otherwise(F.col(distance) - F.col("_m") - 0.25 * F.col("_s"))
    rows = rows.withColumn("_x", x).withColumn("_sum", F.sum("_x").over(own))
    low = F.least(F.lit(0.0), F.min("_sum").over(own))
    rows = rows.withColumn("cusum", F.col("_sum") - low)
    onset = F.min(F.when(F.col("cusum") > 4 * F.col("_s"), F.col(rep))).over(all_rows)
    return rows.withColumn("onset", onset).drop("_m", "_s", "_x", "_sum")


def loop_boundaries(df: DataFrame, keys: list[str], frame: str, time: str, back: float = 1.0, rest: int = 30) -> DataFrame:
    """Frames at which the video's time falls by over ``back`` seconds, none within ``rest`` frames of another."""
    before = F.lag(time).over(_own(keys, [frame]))
    falls = df.withColumn("_b", before).filter((F.col(time) > 0) & (F.col("_b") > 0) & (F.col(time) < F.col("_b") - back)).drop("_b")
    return cooldown(falls, keys, [frame], frame, rest + 1)


def cut_detect(df: DataFrame, keys: list[str], frame: str, diff: str, threshold: float = 30.0, least: int = 15) -> DataFrame:
    """Frames whose difference to the one before is at least ``threshold``, ``least`` frames after the last cut or start."""
    rows = df.withColumn("_first", F.row_number().over(_own(keys, [frame])) == 1)
    kept = cooldown(rows.filter(F.col("_first") | (F.col(diff) >= threshold)), keys, [frame], frame, least)
    return kept.filter("not _first").drop("_first")


def bone_length_filter(df: DataFrame, keys: list[str], order: list[str], joints: str, warm: int = 30, alpha: float = 0.05) -> DataFrame:
    """Joints (14 pairs of numbers) whose bones are set to their smoothed lengths, from parents to children, once ``warm``
    rows have been seen."""

    def step(state, rows):
        seen, lengths = state
        points = np.array([[list(p) for p in r] for r in rows], float)
        n = len(points)
        after = {}
        for b in BONES:
            now = np.sqrt(((points[:, b[1]] - points[:, b[0]]) ** 2).sum(axis=1))
            x = alpha * now
            if lengths is None:
                x[0] = now[0]
            after[b] = recurrence(x, 1 - alpha, 0.0 if lengths is None else lengths[b])
        out, late = points.copy(), seen + 1 + np.arange(n) >= warm
        for p, c in BONES:
            way = out[:, c] - out[:, p]
            size = np.sqrt((way**2).sum(axis=1))
            moved = out[:, p] + way / np.where(size < 1e-8, 1, size)[:, None] * after[p, c][:, None]
            out[:, c] = np.where((late & (size >= 1e-8))[:, None], moved, out[:, c])
        filled = np.empty(n, object)
        filled[:] = out.tolist()
        return (seen + n, {b: v[-1] for b, v in after.items()}), (filled,)

    return ordered_scan(df, keys, order, step, lambda: (0, None), "steady array<array<double>>", [joints])


def ground_impacts(df: DataFrame, keys: list[str], frame: str, head_y: str, lowest_y: str, scale: str, fps: float = 30.0, least: float = 1.5, part: float = 0.3, at: float = 0.85, rest: int = 15, rows: int = 10) -> DataFrame:
    """Falls: a head that came down faster than ``least`` m/s, now under ``part`` of that, at the level of the ground.

    ``scale`` is pixels a metre. Speeds of the last ``rows`` rows count, three at least; events are ``rest`` rows apart.
    """
    own = _own(keys, [frame])
    speeds = df.withColumn("_i", F.row_number().over(own)).withColumn("_v", (F.col(head_y) - F.lag(head_y).over(own)) / F.col(scale) * fps)
    held = own.rowsBetween(-(rows - 1), 0)
    speeds = speeds.withColumn("speed", F.max("_v").over(held)).withColumn("_c", F.count("_v").over(held))
    falls = (F.col("_c") >= 3) & (F.col("speed") > least) & (F.col("_v") < part * F.col("speed")) & (F.col(lowest_y) > 0)
    hits = speeds.filter(falls & (F.col(head_y) / F.col(lowest_y) >= at))
    kept = cooldown(hits, keys, ["_i"], "_i", rest)
    return kept.withColumn("impact", P.ground_impact(F.col("speed"))).drop("_i", "_v", "_c")


def individual_g(df: DataFrame, keys: list[str], order: list[str], time: str, x: str, y: str, scale: str) -> DataFrame:
    """Head speed (m/s), acceleration (g) from its change, the running peak and its level; ``scale`` is pixels a metre."""
    own = _own(keys, order)
    dt = F.greatest(F.col(time) - F.lag(time).over(own), F.lit(1e-6))
    apart = F.sqrt(F.pow(F.col(x) - F.lag(x).over(own), 2) + F.pow(F.col(y) - F.lag(y).over(own), 2))
    rows = df.withColumn("_dt", dt).withColumn("speed", F.coalesce(apart / F.col(scale) / F.col("_dt"), F.lit(0.0)))
    g = F.abs(F.col("speed") - F.lag("speed").over(own)) / F.col("_dt") / P.GRAVITY
    rows = rows.withColumn("accel_g", F.coalesce(g, F.lit(0.0)))
    rows = rows.withColumn("peak_g", F.max("accel_g").over(own)).drop("_dt")
    return rows.withColumn("level", P.risk_of_g(F.col("peak_g")))


def standalone_spikes(df: DataFrame, keys: list[str], frame: str, accel: str, turn: str, p: str, rest: int = 30) -> DataFrame:
    """Rows with over 20 g and a turn over 45 degrees, ``rest`` frames apart, that make a probability over 10."""
    hits = df.filter((F.col(accel) > 20) & (F.col(turn) > 45) & (F.col(p) > 10))
    return cooldown(hits, keys, [frame], frame, rest)
