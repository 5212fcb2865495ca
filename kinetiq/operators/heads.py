"""Heads over time: kinematics, the concussion rating, and impacts after two people have approached each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetiq.functions import physics as P
from kinetiq.operators.ordered import convolve, interpolate_nulls, islands, recurrence, unwrap_angle
from kinetiq.operators.scans import Scan, scan

#: Weights of a new speed, acceleration, jerk and turn; the way (m) that no head goes in a frame; the least
#: acceleration (m/s2) whose direction counts; ceilings of acceleration (g) and jerk.
SPEED, ACCELERATION, JERK, TURN = 0.4, 0.3, 0.25, 0.3
JUMP, NOTABLE, MOST_G, MOST_JERK = 2.0, 0.5, 100.0, 50_000.0


class HeadState:
    """What a head's next frame needs: place, smoothed motion, and whether a frame since the last jump has been seen."""

    def __init__(self):
        self.at, self.moving = None, False
        self.v, self.a, self.jerk, self.ear, self.turn = np.zeros(2), np.zeros(2), 0.0, None, 0.0

    def lost(self) -> None:
        """After a jump: only the place is known."""
        self.moving, self.ear = False, None
        self.v, self.a, self.jerk, self.turn = np.zeros(2), np.zeros(2), 0.0, 0.0


def _smoothed(x: np.ndarray, weight: float, before: np.ndarray) -> np.ndarray:
    return np.stack([recurrence(weight * x[:, c], 1 - weight, before[c]) for c in range(x.shape[1])], axis=1)


def _run(s: HeadState, places: np.ndarray, ear: np.ndarray, dt: float) -> np.ndarray:
    """(speed, g, direction, jerk, turn) of frames without a jump among them."""
    start = places[:1] if s.at is None else s.at[None]
    before = np.concatenate((start, places[:-1]))
    v = _smoothed((places - before) / dt, SPEED, s.v)
    raw = (v - np.concatenate((s.v[None], v[:-1]))) / dt
    if not s.moving:
        raw[0] = 0
    a = _smoothed(raw, ACCELERATION, s.a)
    last = np.concatenate((s.a[None], a[:-1]))
    size, old = np.linalg.norm(a, axis=1), np.linalg.norm(last, axis=1)
    seen = (size > NOTABLE) & (old > NOTABLE)
    seen[0] &= s.moving
    cos = np.clip((a * last).sum(axis=1) / np.where(seen, size * old, 1), -1, 1)
    jerk = recurrence(JERK * np.linalg.norm(raw - a, axis=1) / dt, 1 - JERK, s.jerk)
    step = np.diff(ear, prepend=ear[0] if s.ear is None else s.ear)
    turn = recurrence(TURN * np.abs((step + np.pi) % (2 * np.pi) - np.pi) / dt, 1 - TURN, s.turn)
    s.at, s.moving, s.v, s.a, s.jerk, s.ear, s.turn = places[-1], True, v[-1], a[-1], jerk[-1], ear[-1], turn[-1]
    return np.stack((np.linalg.norm(v, axis=1), np.minimum(size / P.GRAVITY, MOST_G), np.where(seen, np.arccos(cos), 0), np.minimum(jerk, MOST_JERK), turn), axis=1)


def head_frames(s: HeadState, x: np.ndarray, y: np.ndarray, ear: np.ndarray, dt: float) -> np.ndarray:
    """Carry a head's state through frames: a row of (speed, g, direction, jerk, turn) for each."""
    places, ear, dt = np.stack((x, y), axis=1).astype(float), ear.astype(float), max(dt, 1e-4)
    out = np.zeros((len(places), 5))
    before = np.concatenate((places[:1] if s.at is None else s.at[None], places[:-1]))
    jumps = np.flatnonzero(np.linalg.norm(places - before, axis=1) > JUMP)
    for i, j in zip([0, *(jumps + 1).tolist()], [*jumps.tolist(), len(places)]):
        if i < j:
            out[i:j] = _run(s, places[i:j], ear[i:j], dt)
        if j < len(places):
            s.lost()
            s.at = places[j]
    return out


KINEMATICS = ("speed", "accel_g", "turn_rad", "jerk", "rotation")


def kinematics_scan(x: str, y: str, ear: str, fps: float = 30.0) -> Scan:
    """The recurrence of ``head_kinematics``; rows without a place keep nulls and leave the state as it was."""

    def step(s, x, y, ear, dt=1 / fps):
        x, y, ear = (v.astype(float) for v in (x, y, ear))
        seen = ~(np.isnan(x) | np.isnan(y) | np.isnan(ear))
        out = np.full((len(x), 5), np.nan)
        if seen.any():
            out[seen] = head_frames(s, x[seen], y[seen], ear[seen], dt)
        return s, tuple(out.T)

    return Scan([x, y, ear], ", ".join(f"{c} double" for c in KINEMATICS), HeadState, step)


def head_kinematics(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, ear: str, fps: float = 30.0) -> DataFrame:
    """Each frame that has a head with its speed (m/s), acceleration (g), change of the acceleration's direction (rad), jerk
    and rotation (rad/s), each smoothed from the smoothed one before.

    ``x`` and ``y`` are metres, ``ear`` the angle of the line between the ears. A head that goes over two metres in a frame
    is another one: that frame is all zero and smoothing starts anew. Frames without a place are left out.
    """
    seen = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(ear).isNotNull())
    return scan(seen, keys, order, kinematics_scan(x, y, ear, fps))


#: Shoulders (m), metres a pixel without them, frames that a peak holds, its decay then, the weight of a new
#: speed in the baseline; and (floor, width, points) of speed, rotation and of how far the speed stands out.
SHOULDERS, PIXEL, HOLD, DECAY, BASELINE = 0.40, 0.002, 45, 0.92, 0.05
RAMPS = ((5.0, 10.0, 40.0), (12.0, 23.0, 35.0), (5.0, 10.0, 25.0))


def held_peaks(scores: np.ndarray, peak: float, age: int) -> tuple[np.ndarray, float, int]:
    """The peak of scores that holds for HOLD rows and decays then; ``age`` counts rows since it was set."""
    out, i, n = np.empty(len(scores)), 0, len(scores)
    while i < n:
        part = scores[i : i + 1024]
        level = peak * DECAY ** np.maximum(0, np.arange(age, age + len(part) + 1) - HOLD)
        over = np.flatnonzero(part > level[:-1])
        stop = int(over[0]) if len(over) else len(part)
        out[i : i + stop] = level[1 : stop + 1]
        age += stop
        i += stop
        if len(over):
            peak, age, out[i] = float(part[stop]), 0, part[stop]
            i += 1
    return out, peak, age


def rating_scan(columns: list[str], fps: float = 30.0) -> Scan:
    """The recurrence of ``concussion_rating`` over x and y of nose, left and right ear and the shoulders' width, in pixels."""

    def step(s, nx, ny, lx, ly, rx, ry, width, dt=1 / fps):
        at, ear, turn, base, peak, age = s
        values = np.stack([v.astype(float) for v in (nx, ny, lx, ly, rx, ry)], axis=1)
        here = np.flatnonzero(~np.isnan(values).any(axis=1))
        score = np.full(len(nx), -1.0)
        if len(here):
            own, w = values[here], width[here].astype(float)
            scale = np.where(w > 1, SHOULDERS / np.where(w > 1, w, 1), PIXEL)
            before = np.concatenate((own[:1, :2] if at is None else at[None], own[:-1, :2]))
            speed = np.linalg.norm(own[:, :2] - before, axis=1) * scale / dt
            angle = np.arctan2(own[:, 5] - own[:, 3], own[:, 4] - own[:, 2])
            change = np.diff(angle, prepend=angle[0] if ear is None else ear)
            turns = recurrence(TURN * np.abs((change + np.pi) % (2 * np.pi) - np.pi) / dt, 1 - TURN, turn)
            fed = BASELINE * speed
            if base is None:
                fed[0], base = speed[0], 0.0
            level = recurrence(fed, 1 - BASELINE, base)
            floor = np.maximum(level, 0.01)
            parts = (speed, turns, np.maximum(0, (speed - floor) / floor))
            score[here] = sum(np.clip((v - low) / wide, 0, 1) * points for v, (low, wide, points) in zip(parts, RAMPS))
            at, ear, turn, base = own[-1, :2], angle[-1], turns[-1], level[-1]
        out, peak, age = held_peaks(score, peak, age)
        return (at, ear, turn, base, peak, age), (np.clip(out, 0, 100),)

    return Scan(columns, "rating double", lambda: (None, None, 0.0, None, 0.0, HOLD), step)


def concussion_rating(df: DataFrame, keys: list[str], order: list[str], nose: str, left_ear: str, right_ear: str, shoulders: str, fps: float = 30.0) -> DataFrame:
    """Each frame with ``rating``, 0 to 100: points for the head's speed, its smoothed rotation, and how far the speed stands
    out of its baseline; the highest holds for 45 frames and decays then.

    Points are structs of pixels (x, y); ``shoulders`` is their width in pixels. A frame without a head (any point null)
    only lets the peak age.
    """
    points = {f"_h{i}{c}": F.col(p)[c].cast("double") for i, p in enumerate((nose, left_ear, right_ear)) for c in "xy"}
    rows = df.withColumns(points | {"_hw": F.coalesce(F.col(shoulders).cast("double"), F.lit(0.0))})
    return scan(rows, keys, order, rating_scan([*points, "_hw"], fps)).drop(*points, "_hw")


#: Approach (per second) that opens a window and how many frames it stays open; what makes an impact in it.
APPROACH, OPEN, SPIKE_G, SPIKE_DEG = 0.8, 15, 3.0, 60.0
_BLOCK = 64


def approach_windows(pairs: DataFrame, seq: list[str], frame: str, a: str, b: str, speed: str) -> DataFrame:
    """(seq, a, b, start, end, closing): windows of pairs that approach fast, from the first such frame to 15 after the last.

    A further approach extends a window up to its last frame; the fastest counts. Pairs are unordered.
    """
    fast = pairs.filter(F.col(speed) >= APPROACH).select(*seq, F.col(frame).alias("frame"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(speed).alias("closing"))
    own = Window.partitionBy(*seq, "a", "b").orderBy("frame")
    runs = islands(fast, [*seq, "a", "b"], ["frame"], F.coalesce(F.col("frame") - F.lag("frame").over(own) > OPEN, F.lit(True)))
    windows = runs.groupBy(*seq, "a", "b", "island").agg(F.min("frame").alias("start"), (F.max("frame") + OPEN).alias("end"), F.max("closing").alias("closing"))
    return windows.drop("island")


def approach_impacts(kinematics: DataFrame, pairs: DataFrame, seq: list[str], frame: str, subject: str, a: str, b: str, speed: str) -> DataFrame:
    """Impacts of the people of a window: (seq, subject, other, start, end, closing, peaks, frames, probability).

    ``kinematics`` are rows of ``head_kinematics``; of those in a window (its last frame included) the peaks count, and the
    frames beyond three g. A subject that reaches neither three g nor 60 degrees, or has no head there, has no impact. Windows
    meet frames by subject and block of frames, so that one subject's history isn't met by each of its windows.
    """
    windows = approach_windows(pairs, seq, frame, a, b, speed)
    each = windows.select("*", F.explode(F.array(F.struct(F.col("a").alias("subject"), F.col("b").alias("other")), F.struct(F.col("b").alias("subject"), F.col("a").alias("other")))).alias("who"))
    each = each.select(*seq, "start", "end", "closing", "who.*").withColumn("_block", F.explode(F.sequence(F.expr(f"start div {_BLOCK}"), F.expr(f"end div {_BLOCK}"))))
    rows = kinematics.select(*seq, F.col(subject).alias("subject"), F.col(frame).alias("_f"), "accel_g", F.degrees("turn_rad").alias("_turn"), "jerk", "rotation")
    rows = rows.withColumn("_block", F.expr(f"_f div {_BLOCK}"))
    met = each.join(rows, [*seq, "subject", "_block"]).filter("_f between start and end")
    by = [*seq, "subject", "other", "start", "end", "closing"]
    peaks = met.groupBy(*by).agg(
        F.max("accel_g").alias("peak_g"), F.max("_turn").alias("turn_deg"), F.max("jerk").alias("peak_jerk"), F.max("rotation").alias("rotation"),
        F.count(F.when(F.col("accel_g") > SPIKE_G, 1)).alias("frames"),
    ).filter((F.col("peak_g") >= SPIKE_G) | (F.col("turn_deg") >= SPIKE_DEG))
    c = F.col
    return peaks.withColumn("probability", P.concussion_composite(c("peak_g"), c("turn_deg"), c("frames"), c("rotation"), c("closing")))


#: Metres from head to neck, metres a pixel without them; speed (m/s) and turn (degrees/s) of an impact, of a
#: moderate and of a high one.
HEAD_NECK, CLIP_PIXEL = 0.24, 0.004
IMPACT_AT, MODERATE_AT, HIGH_AT = (3.0, 1200.0), (4.0, 1500.0), (7.0, 3000.0)


def clip_report(samples: DataFrame, keys: list[str], frame: str, head: str, neck: str, location: str | None = None, fps: float = 240.0, scale: float | None = None) -> DataFrame:
    """A row per clip: impact_detected, risk_level, linear_ms, rotational_degs, duration_ms, frame_of_impact (from 0, -1 without an impact),
    location and recommendation.

    ``head`` and ``neck`` are structs (x, y) in pixels; what is missing is interpolated. Metres a pixel come from the median way
    from head to neck. Speed and turn are smoothed where a clip has five frames or more; frames beyond either limit form
    regions, and the region with the worst frame is the impact. ``location`` names a column that says where the head was seen from.
    """
    own, whole = Window.partitionBy(*keys).orderBy(frame), Window.partitionBy(*keys)
    rows = samples.withColumn("_i", F.row_number().over(own) - 1).withColumn("_n", F.count("*").over(whole))
    for name, point in (("h", head), ("n", neck)):
        for c in "xy":
            rows = rows.withColumn("_v", F.col(point)[c].cast("double"))
            rows = interpolate_nulls(rows, keys, "_i", "_v").withColumnRenamed("filled", f"_{name}{c}")
    far = F.sqrt(F.pow(F.col("_hx") - F.col("_nx"), 2) + F.pow(F.col("_hy") - F.col("_ny"), 2))
    metres = F.lit(float(scale)) if scale else F.coalesce(F.lit(HEAD_NECK) / F.greatest(F.percentile(F.when(far > 1, far), F.lit(0.5)).over(whole), F.lit(1e-3)), F.lit(CLIP_PIXEL))
    rows = rows.withColumn("_m", metres).withColumn("_a", F.atan2(F.col("_hy") - F.col("_ny"), F.col("_hx") - F.col("_nx")))
    rows = unwrap_angle(rows, keys, ["_i"], "_a")
    moved = F.sqrt(F.pow(F.col("_hx") - F.lag("_hx").over(own), 2) + F.pow(F.col("_hy") - F.lag("_hy").over(own), 2))
    turned = F.degrees(F.abs(F.col("unwrapped") - F.lag("unwrapped").over(own)))
    rows = rows.withColumns({"_s": F.coalesce(moved * F.col("_m") * fps, F.lit(0.0)), "_r": F.coalesce(turned * fps, F.lit(0.0))})
    for c in ("_s", "_r"):
        rows = convolve(rows, keys, ["_i"], c, [0.25, 0.5, 0.25]).withColumn(c, F.when(F.col("_n") >= 5, F.col("smoothed")).otherwise(F.col(c))).drop("smoothed")
    rows = rows.withColumn("_hit", (F.col("_s") >= IMPACT_AT[0]) | (F.col("_r") >= IMPACT_AT[1])).withColumn("_worst", F.col("_s") / HIGH_AT[0] + F.col("_r") / HIGH_AT[1])
    runs = islands(rows, keys, ["_i"], F.coalesce(F.lag("_hit").over(own) != F.col("_hit"), F.lit(True)))
    rows_with = runs.withColumn("_place", F.lit(None) if location is None else F.col(location))
    regions = rows_with.groupBy(*keys, "island", "_hit").agg(
        F.max("_s").alias("s"), F.max("_r").alias("r"), F.count("*").alias("n"), F.max(F.struct(F.col("_worst").alias("w"), (-F.col("_i")).alias("i"), F.col("_place").cast("string").alias("place"))).alias("top"), F.min("_i").alias("start"),
    )
    worst = F.max(F.when(F.col("_hit"), F.struct(F.col("top.w").alias("w"), (-F.col("start")).alias("o"), "s", "r", "n", "top")))
    clips = regions.groupBy(*keys).agg(worst.alias("hit"), F.max("s").alias("s"), F.max("r").alias("r"))
    hit = F.col("hit").isNotNull()
    linear, turn = F.coalesce("hit.s", "s"), F.coalesce("hit.r", "r")
    over = lambda at: (linear > at[0]) | (turn > at[1])
    level = F.when(over(HIGH_AT), "HIGH").when(hit & over(MODERATE_AT), "MODERATE").otherwise("LOW")
    return clips.select(
        *keys, hit.alias("impact_detected"), level.alias("risk_level"), linear.alias("linear_ms"), turn.alias("rotational_degs"),
        F.coalesce(F.col("hit.n") / fps * 1000, F.lit(0.0)).alias("duration_ms"), F.coalesce(-F.col("hit.top.i"), F.lit(-1)).cast("long").alias("frame_of_impact"),
        F.when(hit, F.coalesce("hit.top.place", F.lit("UNKNOWN"))).otherwise("UNKNOWN").alias("location"),
        F.when(level == "HIGH", "EVALUATE NOW").when(level == "MODERATE", "MONITOR").otherwise("CLEARED").alias("recommendation"),
    )
