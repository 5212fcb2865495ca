"""Recurrences over a key's rows as values: the columns they need and give, a state and a step over arrays of rows.

``scan`` runs one over a table; ``kinetiq.streaming.scans`` carries the same states from one micro-batch to the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kinetiq.operators.ordered import ordered_scan, recurrence


@dataclass
class Scan:
    needs: list[str]
    out: str
    init: Callable
    step: Callable


def scan(df: DataFrame, keys: list[str], order: list[str], s: Scan) -> DataFrame:
    return ordered_scan(df, keys, order, s.step, s.init, s.out, s.needs)


def chained(scans: list[Scan]) -> Scan:
    """Several recurrences in one pass over the rows; each may need columns that an earlier one gives."""
    names = [[field.split()[0] for field in s.out.split(",")] for s in scans]
    needs: list[str] = []
    for k, s in enumerate(scans):
        made = {n for given in names[:k] for n in given}
        needs += [c for c in s.needs if c not in made and c not in needs]

    def step(states, *arrays):
        columns, states, out = dict(zip(needs, arrays)), list(states), []
        for k, s in enumerate(scans):
            states[k], found = s.step(states[k], *(columns[c] for c in s.needs))
            columns |= zip(names[k], found)
            out += found
        return states, tuple(out)

    return Scan(needs, ", ".join(s.out for s in scans), lambda: [s.init() for s in scans], step)


def _matrix(values) -> np.ndarray:
    return np.array([list(v) for v in values], float)


def velocity(features: str, out: str = "velocity") -> Scan:
    """Distance of a row's vector to the one before; 0 for the first."""

    def step(before, values):
        x = _matrix(values)
        rows = np.concatenate((x[:1] if before is None else before[None], x))
        return x[-1], (np.linalg.norm(np.diff(rows, axis=0), axis=1),)

    return Scan([features], f"{out} double", lambda: None, step)


def ema(col: str, alpha: float, out: str = "ema") -> Scan:
    """Exponential mean from the first value on; nulls leave it as it was."""

    def step(state, x):
        x = x.astype(float)
        has, found = ~np.isnan(x), np.full(len(x), np.nan if state is None else state)
        if has.any():
            fed = alpha * x[has]
            if state is None:
                fed[0], state = x[has][0], 0.0
            values = recurrence(fed, 1 - alpha, state)
            at = np.cumsum(has) - 1
            found = np.where(at >= 0, values[np.maximum(at, 0)], found)
            state = float(values[-1])
        return state, (found,)

    return Scan([col], f"{out} double", lambda: None, step)


def peak(col: str, decay: float, out: str = "peak") -> Scan:
    """max(x, peak before * decay)."""

    def step(top, x):
        x, out = np.nan_to_num(x.astype(float)), np.empty(len(x))
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            fall = decay ** np.arange(1, len(part) + 1)
            out[i : i + 256] = np.maximum(np.maximum.accumulate(part / fall), top) * fall
            top = out[i + len(part) - 1]
        return top, (out,)

    return Scan([col], f"{out} double", lambda: 0.0, step)


def angular_velocity(angle: str, fps: float = 30.0, out: str = "omega") -> Scan:
    """Degrees a second since the last row that had an angle; null without either."""

    def step(before, x):
        x, out = x.astype(float), np.full(len(x), np.nan)
        at = np.flatnonzero(~np.isnan(x))
        if len(at):
            out[at] = np.abs(np.diff(x[at], prepend=np.nan if before is None else before)) * fps
            before = x[at[-1]]
        return before, (out,)

    return Scan([angle], f"{out} double", lambda: None, step)


def curvature(features: str) -> Scan:
    """Bend and change of acceleration of the last four rows; 0 where there are too few."""

    def step(held, values):
        x = _matrix(values)
        rows = np.concatenate((held, x)) if len(held) else x
        n, old = len(rows), len(rows) - len(x)
        v = np.diff(rows, axis=0)
        a = np.diff(v, axis=0)
        jerk = np.diff(a, axis=0)
        bend, change = np.zeros(n), np.zeros(n)
        if n > 2:
            u = v[:-1]
            uu, aa, ua = (u * u).sum(axis=1), (a * a).sum(axis=1), (u * a).sum(axis=1)
            moving = np.sqrt(uu) >= 1e-8
            safe = np.where(moving, uu, 1)
            bend[2:] = np.where(moving, np.sqrt(np.maximum(0, aa - ua * ua / safe)) / safe, 0)
        if n > 3:
            change[3:] = np.linalg.norm(jerk, axis=1)
        return rows[-3:], (bend[old:], change[old:])

    return Scan([features], "curvature double, jerk double", lambda: np.zeros((0, 0)), step)


def fatigue(col: str, rows: int = 300, least: int = 60, alpha: float = 0.05, out: str = "fatigue") -> Scan:
    """Fall from the first to the second half of the last ``rows`` values, 0 to 1, smoothed; nulls are not counted, but hold a
    place among the rows."""

    def step(state, x):
        held, level = state
        whole = np.concatenate((held, x.astype(float)))
        old, has = len(held), ~np.isnan(whole)
        sums = np.concatenate(([0.0], np.cumsum(np.where(has, whole, 0))))
        count = np.concatenate(([0], np.cumsum(has)))
        place = np.append(np.flatnonzero(has), len(whole))
        end = np.arange(old, len(whole)) + 1
        begin = np.maximum(0, end - rows)
        n = count[end] - count[begin]
        cut = place[np.minimum(count[begin] + n // 2, len(place) - 1)]  # where the second half begins
        a = (sums[cut] - sums[begin]) / np.maximum(n // 2, 1)
        b = (sums[end] - sums[cut]) / np.maximum(n - n // 2, 1)
        fall = np.where(a > 1e-6, np.clip((a - b) / np.where(a > 1e-6, a, 1), 0, 1), 0)
        raw = np.flatnonzero(n >= least)
        found = np.full(len(x), level)
        if len(raw):
            values = recurrence(alpha * fall[raw], 1 - alpha, level)
            at = np.cumsum(n >= least) - 1
            found = np.where(at >= 0, values[np.maximum(at, 0)], level)
            level = float(values[-1])
        return (whole[-(rows - 1) :], level), (found,)

    return Scan([col], f"{out} double", lambda: (np.zeros(0), 0.0), step)


def risk_counts(time: str, velocity: str, risks: str, seconds: float = 5.0, fps: float = 30.0, active: float = 0.05, high: float = 0.3) -> Scan:
    """Running counts of a player: kept risk events, those of high severity, and frames in all, active and at high intensity.

    ``risks`` is an array of (risk, joint, severity); one within ``seconds`` of the last kept of its risk and joint isn't kept.
    """

    def step(state, t, v, found):
        last, events, severe, frames, moving, hard = state
        v = np.nan_to_num(v.astype(float))
        out = np.empty((len(t), 5), np.int64)
        out[:, 2] = frames + np.arange(1, len(t) + 1)
        out[:, 3], out[:, 4] = moving + np.cumsum(v >= active), hard + np.cumsum(v >= high)
        for i, rows in enumerate(found):
            for r in rows if rows is not None else ():
                risk, joint, severity = (r[k] for k in ("risk", "joint", "severity"))
                if t[i] - last.get((risk, joint), -np.inf) > seconds:
                    last[risk, joint] = float(t[i])
                    events, severe = events + 1, severe + (severity == "high")
            out[i, :2] = events, severe
        return (last, events, severe, *(int(x) for x in out[-1, 2:])), tuple(out.T)

    names = ("events", "high", "total_frames", "active_frames", "high_frames")
    return Scan([time, velocity, risks], ", ".join(f"{n} long" for n in names), lambda: ({}, 0, 0, 0, 0, 0), step)
