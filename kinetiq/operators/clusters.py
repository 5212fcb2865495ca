"""Clusters of segments, cycles and players: features of fixed length, online clusters, models, teams and a second pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetiq.functions import signals as S
from kinetiq.operators.cycles import resample
from kinetiq.operators.graphs import checkpointed
from kinetiq.operators.scans import Scan, scan
from kinetiq.operators.sequences import per_key, segment_apart

#: The low-pass filter of the Daubechies wavelet with four vanishing moments.
DB4 = (
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
)


def wavelet_matrix(points: int = 30, levels: int = 3) -> np.ndarray:
    """Rows that give the coefficients of ``points`` values: the last approximation, then details from coarse to fine.

    Values are mirrored at the ends, the end itself repeated; each level has (n + 7) // 2 coefficients.
    """
    low = np.array(DB4)
    high = low[::-1] * (-1.0) ** (np.arange(len(low)) + 1)
    rows, details = np.eye(points), []
    for _ in range(levels):
        n = len(rows)
        at = 2 * np.arange((n + len(low) - 1) // 2)[:, None] + 1 - np.arange(len(low))[None]
        at = np.mod(at, 2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        details.insert(0, np.einsum("kj,kjp->kp", np.broadcast_to(high, at.shape), rows[at]))
        rows = np.einsum("kj,kjp->kp", np.broadcast_to(low, at.shape), rows[at])
    return np.concatenate([rows, *details])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _by_matrix(x: Column, matrix: np.ndarray) -> Column:
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in matrix))
    return F.transform(rows, lambda row: _sum(F.zip_with(row, x, lambda a, b: a * b)))


def _fft_sizes(x: Column, points: int) -> Column:
    turn = 2 * np.pi / points * np.outer(np.arange(1, points // 2 + 1), np.arange(points))
    both = F.arrays_zip(_by_matrix(x, np.cos(turn)).alias("c"), _by_matrix(x, np.sin(turn)).alias("s"))
    return F.transform(both, lambda z: F.sqrt(z["c"] * z["c"] + z["s"] * z["s"]) / points)


def _moments(x: Column, *wanted: str) -> Column:
    n = F.size(x)
    mean = _sum(x) / n
    power = lambda k: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - mean, k)) / n
    spread = power(2)
    values = {
        "mean": mean, "std": F.sqrt(spread), "skew": F.when(spread > 1e-18, power(3) / F.pow(spread, 1.5)).otherwise(0.0),
        "kurtosis": F.when(spread > 1e-18, power(4) / F.pow(spread, 2) - 3).otherwise(0.0),
    }
    return F.array(*(values[w] for w in wanted))


#: What a segment's resampled dimension becomes, by kind; parts of all dimensions follow each other.
KINDS: dict[str, Callable[[Column, int], list[Column]]] = {
    "spectral": lambda x, n: [_moments(x, "mean"), _fft_sizes(x, n)],
    "mean_std": lambda x, n: [_moments(x, "mean"), _moments(x, "std")],
    "spectrum": lambda x, n: [_fft_sizes(x, n)],
    "flat": lambda x, n: [x],
    "wavelet": lambda x, n: [_by_matrix(x, wavelet_matrix(n))],
    "statistics": lambda x, n: [_moments(x, w) for w in ("mean", "std", "skew", "kurtosis")],
    "mean": lambda x, n: [_moments(x, "mean")],
}


def segment_features(frames: DataFrame, keys: list[str], kind: str = "spectral", features: str = "f", points: int = 30) -> DataFrame:
    """(keys, vector): one vector of fixed length per segment of ``frames`` (``at`` from 0, ``length``), resampled to ``points``.

    Parts of a kind stand one after another, each dimension by dimension; in ``flat`` rows of all dimensions follow each other. All
    of it are fixed weights over the resampled points.
    """
    rows = resample(frames, keys, points, features)
    if kind == "flat":
        held = F.array_sort(F.collect_list(F.struct("phase", features)))
        return rows.groupBy(*keys).agg(F.flatten(F.transform(held, lambda p: p[features])).alias("vector"))
    long = rows.select(*keys, "phase", F.posexplode(features).alias("dim", "v"))
    series = long.groupBy(*keys, "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("phase", "v"))), lambda p: p["v"]).alias("x"))
    parts = KINDS[kind](F.col("x"), points)
    each = series.select(*keys, "dim", *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", *(f"p{i}" for i in range(len(parts)))))).alias("w"))
    part = lambda i: F.flatten(F.transform("w", lambda d: d[f"p{i}"]))
    return whole.select(*keys, F.concat(*(part(i) for i in range(len(parts)))).alias("vector"))


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.linalg.norm(a - b, axis=1).mean())


class Merging:
    """Clusters as means that grow; every ``every`` segments those that have come close are merged."""

    def __init__(self, threshold: float, every: int = 10, close: float = 0.7):
        self.threshold, self.every, self.close = threshold, every, close
        self.means, self.sizes, self.next, self.since = {}, {}, 0, 0

    def add(self, x: np.ndarray) -> int:
        near = min(self.means, key=lambda k: _apart(x, self.means[k]), default=None)
        if near is None or _apart(x, self.means[near]) >= self.threshold:
            near, self.next = self.next, self.next + 1
            self.means[near], self.sizes[near] = x, 1
        else:
            n = self.sizes[near]
            self.means[near], self.sizes[near] = (self.means[near] * n + x) / (n + 1), n + 1
        self.since += 1
        if self.since >= self.every:
            self.since = 0
            self._merge()
        return near

    def _merge(self) -> None:
        pairs = ((a, b) for a in self.means for b in self.means if a < b and _apart(self.means[a], self.means[b]) < self.close * self.threshold)
        while (pair := next(pairs, None)) is not None:
            a, b = pair
            n, m = self.sizes[a], self.sizes.pop(b)
            self.means[a], self.sizes[a] = (self.means[a] * n + self.means.pop(b) * m) / (n + m), n + m
            pairs = ((a, b) for a in self.means for b in self.means if a < b and _apart(self.means[a], self.means[b]) < self.close * self.threshold)


class Matching:
    """Clusters of the first segments, whose means then stay; a segment that is far from all begins another."""

    def __init__(self, threshold: float, first: int = 5):
        self.threshold, self.first, self.held, self.means = threshold, first, [], []

    def add(self, x: np.ndarray) -> int:
        if not self.means:
            self.held.append(x)
            if len(self.held) < self.first:
                return -1
            spectrum = [np.abs(np.fft.rfft(h, axis=0))[1:].ravel() / len(h) for h in self.held]
            d = np.array([[(np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)) + np.linalg.norm(s - t)) / np.sqrt(a.shape[1]) for b, t in zip(self.held, spectrum)] for a, s in zip(self.held, spectrum)])
            labels = S.average_linkage(d, self.threshold)
            self.means = [np.mean([h for h, c in zip(self.held, labels) if c == k], axis=0) for k in range(max(labels) + 1)]
            return labels[-1]
        far = [_apart(x, m) for m in self.means]
        if min(far) >= self.threshold:
            self.means.append(x)
            return len(self.means) - 1
        return int(np.argmin(far))


ONLINE = {"merge": Merging, "match": Matching}


def online_scan(vector: str, points: int, kind: str, threshold: float) -> Scan:
    def step(state, values):
        out = np.array([(state.add(np.array(list(v), float).reshape(points, -1)), len(state.means)) for v in values])
        return state, tuple(out.T)

    return Scan([vector], "cluster long, clusters long", lambda: ONLINE[kind](threshold), step)


def online_clusters(segments: DataFrame, keys: list[str], order: list[str], vector: str, points: int = 30, kind: str = "merge", threshold: float = 2.0) -> DataFrame:
    """Segments (``vector`` as of ``segment_features``' flat kind) in order with ``cluster``, as assigned then, and the number of
    ``clusters`` after it.

    ``merge``: to the nearest mean under the threshold, which moves, else a new one; every ten segments means within 0.7 of it
    become one, and the later number is gone. ``match``: the first five (-1 until there are five) are clustered by linkage,
    and their means stay. The state is as many means as clusters; ``online_scan`` serves streams.
    """
    return scan(segments, keys, order, online_scan(vector, points, kind, threshold))


def adaptive_resegment(frames: DataFrame, keys: list[str], segmented: Callable[[DataFrame, float], DataFrame], seconds: float = 0.8, share: float = 0.8, many: int = 10) -> DataFrame:
    """Clustered segments (keys, cluster, ...) of ``segmented(frames, seconds)``, but of twice the seconds for keys where one
    cluster has over ``share`` of more than ``many`` segments, and where that gives two segments or more."""
    first = checkpointed(segmented(frames, seconds))
    counts = first.groupBy(*keys, "cluster").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.max("_c").alias("_top"), F.sum("_c").alias("_all"))
    again = counts.filter((F.col("_top") > share * F.col("_all")) & (F.col("_all") > many)).select(*keys)
    again = checkpointed(again)
    second = checkpointed(segmented(frames.join(again, keys, "left_semi"), 2 * seconds))
    enough = second.groupBy(*keys).count().filter("count >= 2").select(*keys)
    second = second.join(enough, keys, "left_semi").withColumn("run", F.lit(2))
    return first.join(enough, keys, "left_anti").withColumn("run", F.lit(1)).unionByName(second)


def team_kmeans(players: DataFrame, keys: list[str], player: str, histogram: str, color: str, k: int = 2) -> DataFrame:
    """(keys, player, team, team_color): a game's players in ``k`` teams by k-means over colour histograms; team 0 has the
    smallest player. ``color`` is an array of three (hue, saturation, value), averaged over a team.

    A game's few players are one group. Starts are the mean's farthest player and in turn the one farthest from those; games of fewer players than teams, and
    players without a histogram, have no row.
    """

    def make(p: pd.DataFrame) -> dict:
        x = np.array(p[histogram].tolist(), float)
        if len(x) < k:
            return {player: [], "team": [], "team_color": []}
        starts = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
        while len(starts) < k:
            starts.append(int(((x[:, None] - x[starts][None]) ** 2).sum(axis=2).min(axis=1).argmax()))
        centres, labels = x[starts], None
        while True:
            now = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            centres = np.array([x[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(k)])
        names: dict[int, int] = {}
        teams = np.array([names.setdefault(int(c), len(names)) for c in labels])  # rows are in order of player
        shades = np.array(p[color].tolist(), float)
        return {player: p[player].to_numpy(), "team": teams, "team_color": [shades[teams == t].mean(axis=0).tolist() for t in teams]}

    seen = players.filter(F.col(histogram).isNotNull()).select(*keys, player, histogram, color)
    kind = players.schema[player].dataType.simpleString()
    return per_key(seen, keys, player, make, f"{player} {kind}, team int, team_color array<double>")


def _contiguous(df: DataFrame, order: str, raw: str) -> DataFrame:
    """Labels numbered by their smallest ``order``."""
    first = df.groupBy(raw).agg(F.min(order).alias("_first"))
    names = first.select(raw, F.expr("row_number() over (order by _first) - 1").cast("int").alias("cluster"))  # a row a cluster
    return df.join(F.broadcast(names), raw).drop(raw)


def model_clusters(df: DataFrame, order: str, vector: str, kind: str = "gmm", most: int = 8, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster``, numbered by smallest ``order``, from the model whose number of clusters fits best.

    ``gmm``: Gaussian mixtures of 1 to ``most`` parts, the smallest BIC (full covariances). ``kmeans``: 2 to ``most`` means,
    the largest silhouette. Each fit is a distributed job over all rows; numbers that are none count as 0.
    """
    clean = F.transform(vector, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    rows = df.withColumn("_v", array_to_vector(clean))
    n = rows.count()
    if not n:
        return df.withColumn("cluster", F.lit(0))
    d = rows.select(F.size(vector)).first()[0]
    best = None
    if kind == "gmm":  # one part: its likelihood follows from the covariances
        x = [F.get(clean, i) for i in range(d)]
        pairs = [(i, j) for i in range(d) for j in range(i + 1)]
        row = rows.agg(*(F.covar_pop(x[i], x[j]) for i, j in pairs)).first()
        spread = np.zeros((d, d))
        for (i, j), v in zip(pairs, row):
            spread[i, j] = spread[j, i] = v
        size = np.linalg.slogdet(spread + 1e-9 * np.eye(d))[1]
        best = (-n * (d * np.log(2 * np.pi) + size + d) - np.log(n) * (d + d * (d + 1) / 2), None)
    for k in range(2, min(most, n if kind == "gmm" else n - 1) + 1):
        if kind == "gmm":
            model = GaussianMixture(k=k, seed=seed, maxIter=200, featuresCol="_v", predictionCol="_raw", probabilityCol="_p").fit(rows)
            worth = 2 * model.summary.logLikelihood - np.log(n) * (k - 1 + k * d + k * d * (d + 1) / 2)
        else:
            model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_raw").fit(rows)
            found = model.transform(rows)
            if found.select("_raw").distinct().count() < 2:
                continue
            worth = ClusteringEvaluator(featuresCol="_v", predictionCol="_raw").evaluate(found)
        if best is None or worth > best[0]:
            best = (worth, model)
    if best is None or best[1] is None:
        return df.withColumn("cluster", F.lit(0))
    return _contiguous(best[1].transform(rows).drop("_v", "_p"), order, "_raw")


def co_association(runs: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, a, b, share): in what share of the ``runs(keys, run, item, cluster)`` two items a < b of a key are together; pairs that never are, are
    left out. Items meet by run and cluster."""
    total = runs.groupBy(*keys).agg(F.countDistinct("run").alias("_runs"))
    left = runs.select(*keys, "run", "cluster", F.col(item).alias("a"))
    right = runs.select(*keys, "run", "cluster", F.col(item).alias("b"))
    together = left.join(right, [*keys, "run", "cluster"]).filter("a < b").groupBy(*keys, "a", "b").count()
    return together.join(total, keys).select(*keys, "a", "b", (F.col("count") / F.col("_runs")).alias("share"))


#: Items from which on the smallest eigenvalues are found without the others; vectors of a block and blocks at most.
DENSE, WIDTH, STEPS = 2000, 16, 60


def _smallest(w: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The Laplacian's ``many`` smallest eigenvalues and their vectors; ``w`` (symmetric) is used up.

    Beyond ``DENSE`` rows by block Lanczos, kept orthogonal, to residuals of 1e-10; all of them where that isn't reached.
    """
    size = 1 / np.sqrt(w.sum(axis=1))
    w *= size[:, None]
    w *= size[None]
    n = len(w)
    if n > DENSE:
        rng = np.random.default_rng(0)
        block = np.linalg.qr(np.column_stack([1 / size, rng.normal(size=(n, WIDTH - 1))]))[0]
        basis, images = block, w @ block
        for step in range(STEPS):
            if step % 5 == 4:
                values, inner = np.linalg.eigh(basis.T @ images)
                top = inner[:, ::-1][:, :many]
                if np.abs(images @ top - basis @ top * values[::-1][:many]).max() < 1e-10:
                    return 1 - values[::-1][:many], basis @ top
            block = images[:, -WIDTH:]
            for _ in range(2):
                block = block - basis @ (basis.T @ block)
                block = np.linalg.qr(block)[0]
            basis, images = np.hstack((basis, block)), np.hstack((images, w @ block))
        del basis, images
    np.negative(w, out=w)
    w[np.arange(n), np.arange(n)] += 1
    values, vectors = np.linalg.eigh(w)
    return values[:many], vectors[:, :many]


def _spectral(w: np.ndarray, k: int | None, most: int) -> list[int]:
    """Clusters of items by their similarities, numbered as they appear."""
    n, top = len(w), min(most, len(w) - 1)
    values, vectors = _smallest(w, max(top + 1, min(k or 1, n)))
    parts = k or (int(np.diff(values[: top + 1]).argmax()) + 1 if top >= 1 else 1)
    x = vectors[:, : min(parts, n)]
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    starts = [0]
    while len(starts) < min(parts, n):
        starts.append(int(((x[:, None] - x[starts][None]) ** 2).sum(axis=2).min(axis=1).argmax()))
    centres = x[starts]
    for _ in range(50):
        labels = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(len(centres))])
    names: dict[int, int] = {}
    return [names.setdefault(int(c), len(names)) for c in labels]


def spectral_clusters(similarity: DataFrame, items: DataFrame, keys: list[str], item: str, k: int | None = None, most: int = 8) -> DataFrame:
    """``items(keys, item)`` with ``cluster``: spectral clustering of a key's items by ``similarity(keys, a, b, share)``.

    ``k`` parts, or as many as come before the largest gap of the Laplacian's smallest eigenvalues. A key is one recording's segments; its
    items and its pairs meet once, in one group.
    """
    own = [f"_own{i}" for i in range(len(keys))]  # both sides may descend from one table
    pairs = similarity.select(*(F.col(c).alias(o) for c, o in zip(keys, own)), "a", "b", "share")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*keys, item, "cluster"])
        left = left.sort_values(item).reset_index(drop=True)
        place = pd.Index(left[item])
        a, b = place.get_indexer(right["a"]), place.get_indexer(right["b"])
        w = np.eye(len(left))
        w[a, b] = w[b, a] = right["share"].to_numpy(float)
        return left[[*keys, item]].assign(cluster=np.array(_spectral(w, k, most), np.int32))

    kinds = T.StructType([items.schema[c] for c in [*keys, item]] + [T.StructField("cluster", T.IntegerType())])
    return items.select(*keys, item).groupBy(*keys).cogroup(pairs.groupBy(*own)).applyInPandas(run, kinds)


def spectral_segments(spectra: DataFrame, keys: list[str], item: str, share: Callable[[np.ndarray], np.ndarray], k: int | None = None, most: int = 8, metric: str = "mean_and_spectrum") -> DataFrame:
    """``spectral_clusters`` of segments (``segment_spectra``) whose similarity is ``share`` of their distance: a key's matrix is worked out
    a block of rows at a time within its group, so that no table of all pairs is made."""

    def make(p: pd.DataFrame) -> dict:
        apart, n = segment_apart(p, metric), len(p)
        w, step = np.empty((n, n)), max(1, (1 << 22) // n)
        for i in range(0, n, step):
            w[i : i + step] = share(apart(np.arange(i, min(n, i + step)), np.arange(n)))
        for i in range(n):
            w[i, i] = 1.0
            w[i + 1 :, i] = w[i, i + 1 :]
        return {item: p[item].to_numpy(), "cluster": _spectral(w, k, most)}

    kind = spectra.schema[item].dataType.simpleString()
    return per_key(spectra.select(*keys, item, "mean", "spectrum"), keys, item, make, f"{item} {kind}, cluster int")
