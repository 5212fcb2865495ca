"""How odd a row is among the last rows of its key, by random isolation trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from kinetiq.operators.scans import Scan, scan

#: Rows remembered, trees, rows of a tree, rows between fits and before the first, the share that counts as odd.
HELD, TREES, TREE_ROWS, EVERY, SHARE, SEED = 300, 50, 256, 60, 0.1, 42


def expected_depth(n: np.ndarray | float):
    """Mean depth of a miss in a search tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as one array of nodes: the feature and cut of a split and its first child, or the depth that a leaf stands for.

    All trees grow together, a level at a time; the first nodes are their roots.
    """

    def __init__(self, x: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        take = min(TREE_ROWS, len(x))
        self.unit = float(expected_depth(take))
        rows = np.concatenate([rng.choice(len(x), take, replace=False) for _ in range(TREES)])
        self._grow(x[rows], np.repeat(np.arange(TREES), take), rng, math.ceil(math.log2(max(take, 2))))
        self.border = 0.0
        self.border = float(np.percentile(self.scores(x), 100 * SHARE))

    def _grow(self, own: np.ndarray, node: np.ndarray, rng, limit: int) -> None:
        """``own`` rows stand in order of their ``node``, numbered within the level."""
        feature, cut, low, depth, before = [], [], [], [], 0
        for level in range(limit + 1):
            count = np.bincount(node)
            starts = np.cumsum(count) - count
            lo, hi = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
            wide = hi > lo
            split = wide.any(axis=1) & (level < limit)
            f = (np.cumsum(wide, axis=1) > (rng.random(len(count)) * wide.sum(axis=1)).astype(int)[:, None]).argmax(axis=1)
            lo, hi = lo[np.arange(len(f)), f], hi[np.arange(len(f)), f]
            c = 2 * (lo / 2 + (hi / 2 - lo / 2) * rng.random(len(count)))
            c = np.where((lo <= c) & (c < hi), c, lo)  # among neighbouring numbers a cut may round to the upper one
            place = 2 * (np.cumsum(split) - 1)
            feature.append(np.where(split, f, -1)), cut.append(c), low.append(before + len(count) + place)
            depth.append(level + np.where(split, 0.0, expected_depth(count)))
            before += len(count)
            if not split.any():
                break
            own, node = own[split[node]], node[split[node]]
            node = (place[node] + (own[np.arange(len(own)), f[node]] > c[node])).astype(np.int16)
            order = np.argsort(node, kind="stable")
            own, node = own[order], node[order]
        self.feature, self.cut, self.low, self.depth = map(np.concatenate, (feature, cut, low, depth))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The more usual a row, the larger; below 0 for the oddest tenth of the rows that the trees come from."""
        at, rows = np.tile(np.arange(TREES), (len(x), 1)), np.arange(len(x))[:, None]
        while ((f := self.feature[at]) >= 0).any():
            at = np.where(f >= 0, self.low[at] + (x[rows, f] > self.cut[at]), at)
        return -(2.0 ** (-self.depth[at].sum(axis=1) / TREES / max(self.unit, 1e-12))) - self.border


def isolation_scan(features: str) -> Scan:
    def step(state, values):
        held, seen, forest = state
        x = np.array([list(v) for v in values], float)
        x = np.where(np.isfinite(x), x, 0.0)
        out, i = np.full(len(x), np.nan), 0
        while i < len(x):
            j = min(len(x), i + EVERY - seen % EVERY)  # up to the row that fits anew
            fits = (seen + j - i) % EVERY == 0
            last = j - fits
            if forest is not None and last > i:
                out[i:last] = np.clip(-forest.scores(x[i:last]), 0, 1)
            held = np.concatenate((held, x[i:j]))[-HELD:] if len(held) else x[i:j][-HELD:]
            seen += j - i
            if fits:
                forest = Forest(held, SEED + seen)
                out[last] = np.clip(-forest.scores(x[last : last + 1]), 0, 1)[0]
            i = j
        return (held, seen, forest), (out,)

    return Scan([features], "isolation double", lambda: (np.zeros((0, 0)), 0, None), step)


def isolation_score(df: DataFrame, keys: list[str], order: list[str], features: str) -> DataFrame:
    """Each row with ``isolation``, 0 to 1: how much easier random cuts part it from the last 300 rows than most of them.

    Trees are seeded and fitted every 60 rows of a key on its last 300; before the first fit there is no score (null). Numbers that are none or
    not finite count as 0. The scan is usable live (``isolation_scan``); its trees are not those of any other library.
    """
    return scan(df, keys, order, isolation_scan(features))
