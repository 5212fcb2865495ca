"""Where a series changes, and where a live one is in a known motion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetiq.functions import signals as S
from kinetiq.operators.ordered import ordered_scan
from kinetiq.operators.sequences import per_key


class Partition:
    """Penalised optimal partition, row by row: the cheapest last change before each row, over the candidates that can still win.

    A stretch costs the squares around its mean, from prefix sums; each change costs the penalty. A candidate that is dearer
    than the best without the penalty can win no more once a stretch from here is long enough, and is dropped then.
    """

    def __init__(self):
        self.n, self.sums, self.squares = 0, None, 0.0
        self.at, self.cost, self.s, self.q, self.until = (np.zeros(0) for _ in range(5))

    def rows(self, x: np.ndarray, penalty: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the last change before its end (rows so far before it), and the cost up to its end."""
        if self.sums is None:
            self.sums = np.zeros(x.shape[1])
            self.at, self.cost, self.s, self.q, self.until = np.zeros(1, np.int64), np.array([-penalty]), self.sums[None], np.zeros(1), np.array([np.inf])
            self.waiting = []
        last, costs = np.empty(len(x), np.int64), np.empty(len(x))
        for i, row in enumerate(x):
            self.n += 1
            self.sums, self.squares = self.sums + row, self.squares + float(row @ row)
            while self.waiting and self.waiting[0][0] <= self.n - least:
                at, cost, s, q = self.waiting.pop(0)
                self.at, self.cost = np.append(self.at, at), np.append(self.cost, cost)
                self.s, self.q, self.until = np.concatenate((self.s, s[None])), np.append(self.q, q), np.append(self.until, np.inf)
            keep = self.until > self.n
            if not keep.all():
                self.at, self.cost, self.s, self.q, self.until = (v[keep] for v in (self.at, self.cost, self.s, self.q, self.until))
            gone = self.sums - self.s
            stretch = self.squares - self.q - (gone * gone).sum(axis=1) / (self.n - self.at)
            total = self.cost + stretch
            total = np.where(self.n - self.at >= least, total, np.inf)
            k = int(total.argmin())
            best = total[k] + penalty
            last[i], costs[i] = self.at[k], best
            if np.isfinite(best):
                dear = np.isfinite(total) & (total > best + 1e-9 * abs(best))
                self.until = np.where(dear, np.minimum(self.until, self.n + least), self.until)
                self.waiting.append((self.n, best, self.sums, self.squares))
        return last, costs


def change_points(df: DataFrame, keys: list[str], order: list[str], features: str, least: int = 5, penalty: float | None = None, cost: str = "l2") -> DataFrame:
    """(keys, change): the rows (from 0) at which a new stretch begins in the partition of least cost; keys without a change
    have no row.

    Stretches have ``least`` rows at least. Without a penalty it is 1.5 times the dimensions times the logarithm of the rows.
    ``cost`` is ``l2``, squares around the mean, or ``cosine``, the same of directions. Rows are scanned in order, with the
    candidates of a key as state; the path back is folded over one number a row.
    """
    own = Window.partitionBy(*keys)
    value = F.col(features)
    if cost == "cosine":
        norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, v: s + v * v))
        value = F.transform(value, lambda v: F.when(norm > 1e-8, v / norm).otherwise(0.0))
    rows = df.select(*keys, *order, value.alias("_v")).withColumn("_n", F.count("*").over(own))

    def step(state, values, n, penalty=penalty, least=least):
        x = np.array([list(v) for v in values], float)
        fixed = 1.5 * x.shape[1] * np.log(n[0]) if penalty is None else penalty
        return state, (state.rows(x, fixed, least)[0],)

    scanned = ordered_scan(rows, keys, order, step, Partition, "last long", ["_v", "_n"])
    numbered = scanned.select(*keys, (F.row_number().over(own.orderBy(*order))).cast("long").alias("end"), "last")
    ends = F.transform(F.array_sort(F.collect_list(F.struct("end", "last"))), lambda e: e["last"])
    path = F.aggregate(
        F.expr("sequence(size(ends), 1, -1)"),
        F.struct(F.size("ends").cast("long").alias("at"), F.array().cast("array<bigint>").alias("found")),
        lambda s, i: F.when(i == s["at"], F.struct(F.get("ends", i - 1).alias("at"), F.array_append(s["found"], F.get("ends", i - 1)).alias("found"))).otherwise(s),
    )
    return numbered.groupBy(*keys).agg(ends.alias("ends")).select(*keys, F.explode(path["found"]).alias("change")).filter("change > 0")


def window_changes(df: DataFrame, keys: list[str], order: str, col: str, width: int) -> DataFrame:
    """Each row with ``gain``: how much cheaper the ``width`` rows before it and those from it on are apart than together,
    from sums over windows; null where either side is short."""
    own = Window.partitionBy(*keys).orderBy(order)
    before, after = own.rowsBetween(-width, -1), own.rowsBetween(0, width - 1)
    value = F.col(col)
    sums = {f"_{n}{k}": f(e).over(w) for n, w in (("b", before), ("a", after)) for k, f, e in (("n", F.count, value), ("s", F.sum, value))}
    rows = df.withColumns(sums)
    apart = F.pow(F.col("_bs"), 2) / F.col("_bn") + F.pow(F.col("_as"), 2) / F.col("_an") - F.pow(F.col("_bs") + F.col("_as"), 2) / (F.col("_bn") + F.col("_an"))
    return rows.withColumn("gain", F.when((F.col("_bn") == width) & (F.col("_an") == width), apart)).drop(*sums)


def ssm_novelty(df: DataFrame, keys: list[str], order: str, features: str, size: int) -> DataFrame:
    """Each row with ``novelty``: the checkerboard kernel of ``size`` rows to each side over the cosine similarities of its
    surroundings, as a share of the key's largest; 0 near the ends and where the surroundings are more alike across.

    With u the directions, the kernel's sum of similarities is |sum of u before - sum of u from here on|^2: two framed sums
    instead of a matrix.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    dot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    rows = df.withColumn("_l", F.greatest(F.sqrt(dot(F.col(features))), F.lit(1e-8))).withColumn("_u", F.transform(features, lambda v: v / F.col("_l")))
    rows = rows.withColumn("_b", F.collect_list("_u").over(own.rowsBetween(-size, -1))).withColumn("_a", F.collect_list("_u").over(own.rowsBetween(0, size - 1)))
    rows = rows.withColumn("_i", F.row_number().over(own) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    total = lambda c: F.aggregate(F.slice(c, 2, size), F.get(c, 0), lambda s, u: F.zip_with(s, u, lambda x, y: x + y))
    inside = (F.col("_i") >= size) & (F.col("_i") < F.col("_n") - size)
    raw = F.when(inside, dot(F.zip_with(total("_b"), total("_a"), lambda x, y: x - y))).otherwise(0.0)
    rows = rows.withColumn("_raw", raw).withColumn("_top", F.max(F.abs("_raw")).over(Window.partitionBy(*keys)))
    return rows.withColumn("novelty", F.when(F.col("_top") > 0, F.col("_raw") / F.col("_top")).otherwise(0.0)).drop("_l", "_u", "_b", "_a", "_i", "_n", "_raw", "_top")


def novelty_boundaries(df: DataFrame, keys: list[str], order: str, novelty: str = "novelty", apart: int = 5) -> DataFrame:
    """(keys, boundary): 0 and the peaks of the novelty, ``apart`` rows from each other, over half the median of what is positive."""

    def make(p):
        x = p[novelty].to_numpy(float)
        some = x[x > 0]
        tops = S.peaks(x, apart) if len(some) else np.zeros(0, int)
        return {"boundary": [0, *(int(t) for t in tops if x[t] >= np.median(some) / 2)]}

    return per_key(df.select(*keys, order, novelty), keys, order, make, "boundary long")


#: Rows of the representative that a pointer looks ahead to, and rows of the live series that are warped at a time.
AHEAD, WARPED = 6, 15


class Follower:
    """Where the rows of a live series are in a representative, which comes first in the stream."""

    def __init__(self):
        self.rep, self.at, self.seen, self.since, self.before, self.speed, self.buffer = [], 0, 0, 0, None, 0.0, []

    def nearest(self, x: np.ndarray) -> np.ndarray:
        rep = np.array(self.rep)
        return np.array([int(((rep - row) ** 2).sum(axis=1).argmin()) for row in x])

    def pointer(self, x: np.ndarray) -> np.ndarray:
        rep, out = np.array(self.rep), []
        for row in x:
            self.at += int(((rep[self.at : self.at + AHEAD] - row) ** 2).sum(axis=1).argmin())
            if self.at >= len(rep) - 1:
                self.at = 0
            out.append(self.at)
        return np.array(out)

    def phase(self, x: np.ndarray) -> np.ndarray:
        rep = np.array(self.rep)
        n, out = len(rep), []
        slow = 0.3 * float(np.median(np.linalg.norm(np.diff(rep, axis=0), axis=1))) if n > 1 else 0.0
        for row in x:
            speed = 0.0 if self.before is None else float(np.linalg.norm(row - self.before))
            if self.seen and self.speed > slow >= speed and self.seen - self.since > n / 2:
                self.since = self.seen
            out.append(min(int(min((self.seen - self.since) / n, 1.0) * n), n - 1))
            self.before, self.speed, self.seen = row, speed, self.seen + 1
        return np.array(out)

    def warp(self, x: np.ndarray, total: int) -> np.ndarray:
        rep, out = np.array(self.rep), []
        for row in x:
            self.buffer = [*self.buffer[-(WARPED - 1) :], row]
            here = self.seen * len(rep) // total
            low = max(0, here - WARPED)
            part = rep[low : here + WARPED]
            self.seen += 1
            if len(part) < 2 or len(self.buffer) < 2:
                out.append(min(here, len(rep) - 1))
                continue
            cost = np.sqrt(((np.array(self.buffer)[:, None] - part[None]) ** 2).sum(axis=2))
            line = np.cumsum(cost[0])
            for c in cost[1:]:
                new = np.empty_like(line)
                stay = np.minimum(line, np.concatenate(([np.inf], line[:-1])))
                run = np.inf
                for k in range(len(c)):
                    new[k] = run = c[k] + min(stay[k], run)
                line = new
            out.append(low + int(line.argmin()))
        return np.array(out)


def align_live(frames: DataFrame, reps: DataFrame, keys: list[str], order: str, features: str = "f", kind: str = "pointer") -> DataFrame:
    """Frames (keys, order, features) with ``rep_at``, their place in the key's representative ``reps(keys, phase, features)``.

    Kinds: ``nearest`` row; ``pointer``, forward only within six rows, begun anew at the end; ``phase``, rows since the motion
    last came to rest as a share of the representative; ``warp``, the end of the cheapest time warping of the last 15 rows into
    the representative around the expected place (its end is free: bound to the window's end it would always be that). A
    key's representative is sorted before its frames, so that a key of any length streams past a state of one
    representative and 15 rows. Frames of keys without a representative have null.
    """
    total = F.count("*").over(Window.partitionBy(*keys))
    live = frames.select(*keys, F.lit(1).alias("_side"), F.col(order).cast("long").alias("_o"), F.col(features).alias("_f"), total.alias("_n"))
    known = reps.select(*keys, F.lit(0).alias("_side"), F.col("phase").cast("long").alias("_o"), F.col(features).alias("_f"), F.lit(0).cast("long").alias("_n"))

    def step(state, side, values, n, kind=kind):
        x = np.array([list(v) for v in values], float)
        out = np.full(len(x), -1, np.int64)
        cut = int((side == 0).sum())  # sorted, so these come first
        state.rep += list(x[:cut])
        if cut < len(x) and state.rep:
            out[cut:] = state.warp(x[cut:], int(n[-1])) if kind == "warp" else getattr(state, kind)(x[cut:])
        return state, (out,)

    scanned = ordered_scan(known.unionByName(live), keys, ["_side", "_o"], step, Follower, "rep_at long", ["_side", "_f", "_n"])
    found = scanned.filter("_side = 1").select(*keys, F.col("_o").alias(order), F.col("_f").alias(features), F.when(F.col("rep_at") >= 0, F.col("rep_at")).alias("rep_at"))
    return found
