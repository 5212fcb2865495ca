"""Per-sequence operators: segments, their distances and clusters, repetitions, and risks against thresholds.

A sequence is one recording of one subject; grouped maps see one sequence (or only its segments), never a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetiq.functions import signals as S
from kinetiq.operators.cycles import resample
from kinetiq.operators.joins import within
from kinetiq.operators.ordered import l2


def per_key(df: DataFrame, keys: list[str], order: str, make: Callable[[pd.DataFrame], dict], out: str) -> DataFrame:
    """``make`` gives new columns for a key's rows in order: (keys, out). Lists of any length make rows."""
    added = T._parse_datatype_string(out).fields
    kinds = T.StructType([df.schema[k] for k in keys] + added)
    lists = {f.name: object for f in added if isinstance(f.dataType, T.ArrayType)}  # also where a key gives no rows

    def run(pdf):
        pdf = pdf.sort_values(order)
        found = pd.DataFrame(make(pdf)).astype(lists)
        for i, k in enumerate(keys):
            found.insert(i, k, pdf[k].iloc[0])
        return found

    return df.groupBy(*keys).applyInPandas(run, kinds)


def _matrix(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.array(pdf[col].tolist(), float)


def lowpass(df: DataFrame, keys: list[str], order: str, col: str, cutoff: float = 3.0, fs: float = 30.0) -> DataFrame:
    """(keys, order, smooth): zero-phase Butterworth low-pass of a column."""
    kind = df.schema[order].dataType.simpleString()
    make = lambda p: {order: p[order].to_numpy(), "smooth": S.lowpass(p[col].to_numpy(float), cutoff, fs)}
    return per_key(df.select(*keys, order, col), keys, order, make, f"{order} {kind}, smooth double")


def heel_strikes(df: DataFrame, keys: list[str], order: str, ankle: str, fs: float = 30.0, least: int = 15) -> DataFrame:
    """(keys, strike): places (from 0) of the lowest points of the filtered ankle, ``least`` rows apart."""
    make = lambda p: {"strike": S.peaks(-S.lowpass(p[ankle].to_numpy(float), 3.0, fs), least)}
    return per_key(df.select(*keys, order, ankle), keys, order, make, "strike long")


def motion_boundaries(df: DataFrame, keys: list[str], order: str, features: str, fps: float = 24.0, seconds: float = 2.0) -> DataFrame:
    """(keys, boundary): places where a motion begins."""
    make = lambda p: {"boundary": S.motion_boundaries(_matrix(p, features), fps, seconds)}
    return per_key(df.select(*keys, order, features), keys, order, make, "boundary long")


def segment_motions(df: DataFrame, boundaries: DataFrame, keys: list[str], index: str, frame: str, features: str, forced: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Segments between boundaries: (keys, segment, start_valid, end_valid, start_frame, end_frame, mean_feature).

    ``index`` numbers a sequence's rows from 0; ``forced(keys, boundary)`` are further boundaries inside it. The end is
    exclusive; segments of fewer than ``least`` rows go.
    """
    ends = df.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    all_b = boundaries if forced is None else boundaries.unionByName(forced).distinct()
    b = all_b.join(ends, keys).filter((F.col("boundary") >= 0) & (F.col("boundary") < F.col("_n")))
    own = Window.partitionBy(*keys).orderBy("boundary")
    b = b.withColumn("end_valid", F.coalesce(F.lead("boundary").over(own), F.col("_n")))
    b = b.filter(F.col("end_valid") - F.col("boundary") >= least).withColumn("segment", F.row_number().over(own) - 1)
    b = b.select(*keys, "segment", F.col("boundary").alias("start_valid"), "end_valid")
    rows = within(df, b, keys, index, "start_valid", "end_valid")
    by = [*keys, "segment", "start_valid", "end_valid"]
    frames = rows.groupBy(*by).agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"))
    return frames.join(_mean_vector(rows, by, features).withColumnRenamed(features, "mean_feature"), by)


def _mean_vector(rows: DataFrame, by: list[str], features: str) -> DataFrame:
    long = rows.select(*by, F.posexplode(features).alias("_d", "_v")).groupBy(*by, "_d").agg(F.avg("_v").alias("_v"))
    pairs = F.array_sort(F.collect_list(F.struct("_d", "_v")))
    return long.groupBy(*by).agg(F.transform(pairs, lambda p: p["_v"]).alias(features))


#: Distances of two segments from their mean poses and spectra, by name; ``register_distance`` adds to them.
DISTANCES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "mean_and_spectrum": lambda ma, mb, sa, sb: (l2(ma, mb) + l2(sa, sb)) / F.sqrt(F.size(ma)),
    "mean": lambda ma, mb, sa, sb: l2(ma, mb) / F.sqrt(F.size(ma)),
    "spectrum": lambda ma, mb, sa, sb: l2(sa, sb) / F.sqrt(F.size(ma)),
}


def register_distance(name: str, distance: Callable[[Column, Column, Column, Column], Column]) -> None:
    """Add a distance for ``segment_distance``: a function of two mean poses and two spectra."""
    DISTANCES[name] = distance


def segment_spectra(frames: DataFrame, keys: list[str], features: str = "f", points: int = 30) -> DataFrame:
    """(keys, mean, spectrum) of segments resampled to ``points``: means of the dimensions, and the sizes of their
    frequencies but the lowest, dimension by dimension. ``frames`` has ``at`` (from 0) and ``length``."""
    long = resample(frames, keys, points, features).select(*keys, "phase", F.posexplode(features).alias("dim", "v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("phase", "v"))), lambda p: p["v"])
    series = long.groupBy(*keys, "dim").agg(values.alias("x"))
    turn = 2 * np.pi / points
    wave = lambda f, k: F.aggregate(
        F.zip_with("x", F.array(*(F.lit(float(f(turn * k * t))) for t in range(points))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    sizes = [F.sqrt(F.pow(wave(np.cos, k), 2) + F.pow(wave(np.sin, k), 2)) / points for k in range(1, points // 2 + 1)]
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / points
    each = series.select(*keys, "dim", mean.alias("m"), F.array(*sizes).alias("s"))
    whole = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    out = each.groupBy(*keys).agg(whole.alias("w"))
    return out.select(*keys, F.transform("w", lambda w: w["m"]).alias("mean"), F.flatten(F.transform("w", lambda w: w["s"])).alias("spectrum"))


def segment_distance(spectra: DataFrame, keys: list[str], segment: str, metric: str = "mean_and_spectrum") -> DataFrame:
    """(keys, a, b, distance) for the pairs a < b of a sequence's segments."""
    a = spectra.select(*keys, F.col(segment).alias("a"), F.col("mean").alias("ma"), F.col("spectrum").alias("sa"))
    b = spectra.select(*keys, F.col(segment).alias("b"), F.col("mean").alias("mb"), F.col("spectrum").alias("sb"))
    value = DISTANCES[metric](F.col("ma"), F.col("mb"), F.col("sa"), F.col("sb"))
    return a.join(b, keys).filter("a < b").select(*keys, "a", "b", value.alias("distance"))


#: The same distances between blocks of segments as arrays: which of mean poses and spectra count.
APART = {"mean_and_spectrum": ("mean", "spectrum"), "mean": ("mean",), "spectrum": ("spectrum",)}


def segment_apart(spectra: pd.DataFrame, metric: str = "mean_and_spectrum") -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``distance(rows, others)`` between rows of one sequence's ``segment_spectra``: a product of blocks for each part of the metric."""
    parts = [_matrix(spectra, c) for c in APART[metric]]
    squares, scale = [(x * x).sum(axis=1) for x in parts], np.sqrt(len(spectra["mean"].iat[0]))

    def distance(rows, others):
        total = 0.0
        for x, s in zip(parts, squares):
            gap = x[rows] @ (-2 * x[others].T)
            gap += s[rows][:, None]
            gap += s[others][None]
            np.maximum(gap, 0, out=gap)
            total = total + np.sqrt(gap, out=gap)
        return total / scale

    return distance


def cluster_segments(segments: DataFrame, distances: DataFrame, keys: list[str], threshold: float = 2.0, fps: float = 30.0, linkage: str = "average", metric: str = "mean_and_spectrum") -> DataFrame:
    """Segments (from ``segment_motions``) with a cluster: (keys, start_valid, end_valid, start_frame, end_frame, cluster).

    Agglomerative clustering cut at ``threshold``; neighbours of one cluster become one; a cluster of one segment and under
    three seconds joins the nearest other by mean feature; clusters are numbered as they appear.

    ``distances`` are the pairs of ``segment_distance``, or ``segment_spectra``, of which a key's distances are worked out a block at a
    time (average linkage and the metrics of ``APART`` only), so that no table of all pairs is made.
    """
    pairs = "distance" in distances.columns
    columns = ["start_valid", "end_valid", "start_frame", "end_frame"]

    def join_up(rows):
        out = []
        for r in rows:
            if out and out[-1]["c"] == r["c"]:
                last = out[-1]
                n, m = last["end_valid"] - last["start_valid"], r["end_valid"] - r["start_valid"]
                last["mean"] = (last["mean"] * n + r["mean"] * m) / (n + m)
                last["end_valid"], last["end_frame"] = r["end_valid"], r["end_frame"]
            else:
                out.append(dict(r))
        return out

    def run(left, right):
        if not len(left):
            return pd.DataFrame(columns=[*keys, *columns, "cluster"])
        left = left.sort_values("segment").reset_index(drop=True)
        if pairs:
            place = {s: i for i, s in enumerate(left["segment"])}
            d = np.zeros((len(left), len(left)))
            for a, b, v in right[["a", "b", "distance"]].itertuples(index=False):
                d[place[a], place[b]] = d[place[b], place[a]] = v
            labels = S.average_linkage(d, threshold, linkage)
        else:
            apart = segment_apart(right.set_index("_segment").loc[left["segment"]], metric)
            labels = S.linkage_by_blocks(apart, len(left), threshold)
        rows = [dict(zip(columns, r[:4]), mean=np.array(r[4], float), c=c) for r, c in zip(left[[*columns, "mean_feature"]].itertuples(index=False), labels)]
        rows = join_up(rows)
        seconds, means = {}, {}
        for r in rows:
            seconds.setdefault(r["c"], []).append((r["end_frame"] - r["start_frame"]) / max(fps, 1))
            means.setdefault(r["c"], []).append(r["mean"])
        small = {c for c, s in seconds.items() if len(s) < 2 and sum(s) < 3.0}
        if small and len(small) < len(seconds):
            large = {c: np.mean(m, axis=0) for c, m in means.items() if c not in small}
            names_of, centres = list(large), np.array(list(large.values()))
            nearest = {c: names_of[int(np.linalg.norm(centres - np.mean(means[c], axis=0), axis=1).argmin())] for c in small}
            rows = join_up([r | {"c": nearest.get(r["c"], r["c"])} for r in rows])
        names: dict[int, int] = {}
        out = pd.DataFrame([{k: r[k] for k in columns} | {"cluster": names.setdefault(r["c"], len(names))} for r in rows])
        for i, k in enumerate(keys):
            out.insert(i, k, left[k].iloc[0])
        return out

    kinds = T.StructType([segments.schema[c] for c in [*keys, *columns]] + [T.StructField("cluster", T.IntegerType())])
    own = [f"_own{i}" for i in range(len(keys))]  # both sides may descend from one table, whose keys are then the same columns
    right = distances.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *(("a", "b", "distance") if pairs else (F.col("segment").alias("_segment"), "mean", "spectrum")))
    return segments.groupBy(*keys).cogroup(right.groupBy(*own)).applyInPandas(run, kinds)


def self_similarity(df: DataFrame, keys: list[str], order: str, features: str, window: int = 15) -> DataFrame:
    """(keys, order, similarity): how close the nearest other window of a row's sequence comes."""
    kind = df.schema[order].dataType.simpleString()
    make = lambda p: {order: p[order].to_numpy(), "similarity": S.self_similarity(_matrix(p, features), window)}
    return per_key(df.select(*keys, order, features), keys, order, make, f"{order} {kind}, similarity double")


def procrustes(df: DataFrame, points: str, template: list[list[float]], reflect: bool = False) -> DataFrame:
    """Each row's points (arrays of three numbers) turned and scaled onto one template, as ``aligned``."""
    goal = np.array(template, float)
    schema = T.StructType([*df.schema.fields, T.StructField("aligned", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for batch in batches:
            turned = [S.procrustes(np.array([list(q) for q in p], float), goal, reflect).tolist() for p in batch[points]]
            yield batch.assign(aligned=pd.Series(turned, index=batch.index, dtype=object))

    return df.mapInPandas(run, schema)


def smoothness(df: DataFrame, keys: list[str], order: str, features: str, fps: float = 30.0) -> DataFrame:
    """Per repetition: sparc and median frequency of its speed, log jerk, spectral and sample entropy of its first feature,
    spread of the distances to its centre and path efficiency."""

    def make(p):
        x = _matrix(p, features)
        steps = np.linalg.norm(np.diff(x, axis=0), axis=1)
        far = np.linalg.norm(x - x.mean(axis=0), axis=1)
        speed, path = steps * fps, float(steps.sum())
        values = (
            S.sparc(speed, fps), S.median_frequency(speed, fps), S.log_jerk(x, fps), S.spectral_entropy(x[:, 0]), S.sample_entropy(x[:, 0]),
            float(far.std()), float(np.linalg.norm(x[-1] - x[0])) / max(path, 1e-8),
        )
        return {n: [float(v)] for n, v in zip(("sparc", "median_frequency", "ldlj", "entropy", "sample_entropy", "spread", "efficiency"), values)}

    out = "sparc double, median_frequency double, ldlj double, entropy double, sample_entropy double, spread double, efficiency double"
    return per_key(df.select(*keys, order, features), keys, order, make, out)


def range_of_motion(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """(keys, rom): largest less smallest angle."""
    return df.groupBy(*keys).agg((F.max(angle) - F.min(angle)).alias("rom"))


def rep_correlation(resampled: DataFrame, keys: list[str], rep: str, features: str = "f") -> tuple[DataFrame, DataFrame]:
    """Of each repetition with the next: (keys, rep, correlation); and per key the slope of that: (keys, slope)."""
    long = resampled.select(*keys, rep, "phase", F.posexplode(features).alias("dim", "v"))
    later = long.select(*keys, (F.col(rep) - 1).alias(rep), "phase", "dim", F.col("v").alias("w"))
    pairs = long.join(later, [*keys, rep, "phase", "dim"]).groupBy(*keys, rep).agg(F.corr("v", "w").alias("correlation"))
    return pairs, pairs.groupBy(*keys).agg(F.regr_slope("correlation", rep).alias("slope"))


def kinematic_sequence(df: DataFrame, keys: list[str], order: str, joint: str, omega: str, ideal: list[str]) -> DataFrame:
    """(keys, score, joints): how well joints peak in the ideal order, 1 in it and 0 against it; null below three joints.

    Joints with fewer than three values have no peak; joints that peak together count as in order.
    """
    rank = F.array_position(F.array(*map(F.lit, ideal)), F.col(joint))
    rows = df.filter(F.col(joint).isin(ideal) & F.col(omega).isNotNull()).withColumn("_rank", rank)
    top = rows.groupBy(*keys, "_rank").agg(F.max_by(order, F.struct(omega, -F.col(order))).alias("_at"), F.count("*").alias("_n"))
    top = top.filter("_n >= 3").select(*keys, "_rank", "_at")
    later = top.toDF(*keys, "_rank2", "_at2")
    pairs = top.join(later, keys).filter("_rank < _rank2").groupBy(*keys).agg(F.avg(F.when(F.col("_at") <= F.col("_at2"), 1.0).otherwise(0.0)).alias("_p"))
    counts = top.groupBy(*keys).agg(F.count("*").alias("joints"))
    return counts.join(pairs, keys, "left").select(*keys, F.when(F.col("joints") >= 3, F.round("_p", 3)).alias("score"), "joints")


#: The weights of what speaks for fatigue.
FATIGUE = {"rom": 0.25, "ewma": 0.20, "cusum": 0.20, "correlation": 0.15, "sparc": 0.08, "ldlj": 0.07, "spread": 0.05}


def composite_fatigue(digits: int = 3, **parts: Column) -> Column:
    """Weighted mean of the parts that are there: rom decay, share of alarming joints, height of the cumulative sum over its
    limit, slope of the correlations, sparc and ldlj decay, slope of the spread; each held to 0 to 1 in its own scale."""
    held = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    scale = {"rom": lambda c: F.least(F.lit(1.0), c / 0.25), "ewma": lambda c: c, "cusum": lambda c: F.least(F.lit(1.0), c)}
    scale |= {"correlation": lambda c: held(c * -20), "sparc": held, "ldlj": held, "spread": lambda c: held(c * 10)}
    sums = [(F.when(c.isNotNull(), scale[n](c) * FATIGUE[n]).otherwise(0.0), F.when(c.isNotNull(), FATIGUE[n]).otherwise(0.0)) for n, c in parts.items()]
    value, weight = (reduce(lambda a, b: a + b, (s[i] for s in sums)) for i in (0, 1))
    return F.round(F.when(weight > 0, F.try_divide(value, weight)).otherwise(0.0), digits)


def resample_each(frames: DataFrame, keys: list[str], points: str, features: str = "f") -> DataFrame:
    """``resample`` where every row carries how many points its segment gets."""
    sizes = frames.groupBy(*keys).agg(F.max("length").alias("length"), F.max(points).alias("_p"))
    grid = sizes.withColumn("phase", F.explode(F.sequence(F.lit(0), (F.col("_p") - 1).cast("int"))))
    place = F.col("phase") * (F.col("length") - 1) / (F.col("_p") - 1)
    grid = grid.withColumn("lo", F.floor(place)).withColumn("w", place - F.floor(place)).withColumn("hi", F.least(F.col("lo") + 1, F.col("length") - 1))
    a = frames.select(*keys, F.col("at").alias("lo"), F.col(features).alias("_a"))
    b = frames.select(*keys, F.col("at").alias("hi"), F.col(features).alias("_b"))
    met = grid.join(a, [*keys, "lo"]).join(b, [*keys, "hi"])
    mixed = F.transform(F.arrays_zip("_a", "_b"), lambda z: z["_a"] * (1 - F.col("w")) + z["_b"] * F.col("w"))
    return met.select(*keys, "phase", mixed.alias(features))


def _target(frames: DataFrame, cluster: list[str], segment: str, least: int, most: int | None) -> DataFrame:
    """Each row with its cluster's points: the median length of its segments, whole, within bounds."""
    lengths = frames.select(*cluster, segment, "length").distinct()
    middle = F.greatest(F.floor(F.percentile("length", F.lit(0.5))), F.lit(least))
    points = lengths.groupBy(*cluster).agg((middle if most is None else F.least(middle, F.lit(most))).cast("int").alias("_points"))
    return frames.join(points, cluster)


def representatives(frames: DataFrame, cluster: list[str], segment: str, features: str = "f") -> DataFrame:
    """(cluster, phase, f): a cluster's mean trajectory at the median length of its segments, 10 to 90."""
    x = resample_each(_target(frames, cluster, segment, 10, 90), [*cluster, segment], "_points", features)
    return _mean_vector(x, [*cluster, "phase"], features)


def analyze_consistency(frames: DataFrame, cluster: list[str], segment: str, features: str = "f") -> DataFrame:
    """(cluster, segment, score, anomaly): how far a repetition is from its cluster's mean, in deviations.

    Flagged beyond the mean score and 1.5 deviations (0.3 at least). One flag among five or more is none; a lone segment
    scores 0.
    """
    by = [*cluster, segment]
    x = resample_each(_target(frames, cluster, segment, 5, None), by, "_points", features)
    long = x.select(*by, "phase", F.posexplode(features).alias("dim", "v"))
    base = long.groupBy(*cluster, "phase", "dim").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-6)).alias("s"))
    dev = long.join(base, [*cluster, "phase", "dim"]).withColumn("d", (F.col("v") - F.col("m")) / F.col("s"))
    score = dev.groupBy(*by).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("score"))
    own = Window.partitionBy(*cluster)
    score = score.withColumn("n", F.count("*").over(own)).withColumn("score", F.when(F.col("n") < 2, 0.0).otherwise(F.col("score")))
    limit = F.avg("score").over(own) + 1.5 * F.greatest(F.stddev_pop("score").over(own), F.lit(0.3))
    score = score.withColumn("over", (F.col("n") >= 2) & (F.col("score") > limit)).withColumn("flags", F.sum(F.col("over").cast("int")).over(own))
    return score.select(*by, "score", (F.col("over") & ~((F.col("n") >= 5) & (F.col("flags") <= 1))).alias("anomaly"))


def align_to_representative(frames: DataFrame, reps: DataFrame, cluster: list[str], features: str = "f") -> DataFrame:
    """Each row (``at`` from 0, ``length``) with the representative's row of its phase, as ``rep``."""
    sizes = reps.groupBy(*cluster).agg(F.count("*").alias("_n"))
    place = F.floor(F.col("at") / F.greatest(F.col("length") - 1, F.lit(1)) * (F.col("_n") - 1))
    rows = frames.join(sizes, cluster).withColumn("phase", F.least(place, F.col("_n") - 1).cast("int")).drop("_n")
    return rows.join(reps.select(*cluster, "phase", F.col(features).alias("rep")), [*cluster, "phase"])


def form_score(features: Column, rep: Column, dims: int = 2) -> Column:
    """0 to 100 from each joint's distance to the representative's: none from one hip width on."""
    joints = F.sequence(F.lit(0), (F.size(features) / dims - 1).cast("int"))
    part = lambda j: F.greatest(F.lit(0.0), 1 - F.sqrt(reduce(lambda a, b: a + b, (F.pow(F.get(features, j * dims + c) - F.get(rep, j * dims + c), 2) for c in range(dims)))))
    return F.aggregate(F.transform(joints, part), F.lit(0.0), lambda s, v: s + v) / F.size(joints) * 100


#: Fixed values: (metric, joint, risk, medium, high) beyond which a metric is a risk; a null high never is.
THRESHOLDS = (
    ("fppa_left", "left_knee", "knee_valgus", 15.0, 25.0), ("fppa_right", "right_knee", "knee_valgus", 15.0, 25.0),
    ("hip_drop", "pelvis", "hip_drop", 8.0, 12.0), ("trunk_lean", "trunk", "trunk_lean", 15.0, 25.0), ("asymmetry", "bilateral", "asymmetry", 15.0, 25.0),
)
SPIKE = 500.0
_BY_SIZE = ("fppa_left", "fppa_right", "hip_drop", "trunk_lean")
METRICS: dict[str, Callable[[], Column]] = {m: (lambda m=m: F.abs(m) if m in _BY_SIZE else F.col(m)) for m, *_ in THRESHOLDS}


def register_metric(name: str, reading: Callable[[], Column]) -> None:
    """Add a reading that thresholds may name."""
    METRICS[name] = reading


def injury_risks(rows: DataFrame, keys: list[str], thresholds: DataFrame | None = None, scales: DataFrame | None = None, person: list[str] | None = None, digits: int = 1) -> DataFrame:
    """(keys, joint, risk, severity, value, threshold) of the metrics beyond their thresholds, strictly.

    ``rows`` has the metrics as columns; a missing or null one is 0. ``thresholds(metric, joint, risk, medium, high,
    enabled)``, a profile of a few rows, replaces the defaults; without it ``scales(person, *_scale)`` scale them per person.
    """
    spark, have = rows.sparkSession, set(rows.columns)
    names = {**METRICS}
    values = F.map_from_arrays(
        F.array(*map(F.lit, names)), F.array(*(F.coalesce((f() if m in have or m not in {t[0] for t in THRESHOLDS} else F.lit(0.0)).cast("double"), F.lit(0.0)) for m, f in names.items()))
    )
    own = [*keys, *(p for p in person or [] if p not in keys)]
    long = rows.select(*own, F.explode(values).alias("metric", "reading"))
    if thresholds is None:
        table = spark.createDataFrame([(*t, True) for t in THRESHOLDS], "metric string, joint string, risk string, medium double, high double, enabled boolean")
    else:
        table = thresholds
    met = long.join(F.broadcast(table.filter("enabled")), "metric")  # a profile's few rows
    if thresholds is None and scales is not None:
        base = F.regexp_replace("metric", "_(left|right)$", "")
        kinds = ("fppa", "hip_drop", "trunk_lean", "asymmetry")
        by = scales.select(*person, F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.col(f"{k}_scale") for k in kinds))).alias("_scale"))
        met = met.join(by, person, "left").withColumn("_k", F.coalesce(F.col("_scale")[base], F.lit(1.0)))
        met = met.withColumns({"medium": F.col("medium") * F.col("_k"), "high": F.col("high") * F.col("_k")})
    high, medium = F.col("reading") > F.col("high"), F.col("reading") > F.col("medium")
    found = met.filter(F.coalesce(high, F.lit(False)) | medium)
    return found.select(
        *keys, "joint", "risk", F.when(high, "high").otherwise("medium").alias("severity"), F.round("reading", digits).alias("value"),
        F.when(high, F.col("high")).otherwise(F.col("medium")).alias("threshold"),
    )


def velocity_spikes(rows: DataFrame, keys: list[str], joint: str, omega: str, scale: Column | None = None) -> DataFrame:
    """Risks of joints that turn faster than the threshold; medium only."""
    limit = F.lit(SPIKE) * (scale if scale is not None else F.lit(1.0))
    found = rows.filter(F.col(omega) > limit)
    return found.select(*keys, F.col(joint).alias("joint"), F.lit("angular_velocity_spike").alias("risk"), F.lit("medium").alias("severity"), F.round(omega, 1).alias("value"), limit.alias("threshold"))


def periodicity(df: DataFrame, keys: list[str], order: str, features: str, fps: float = 30.0) -> DataFrame:
    """(keys, period, boundary): the repeat of the first feature and the boundaries at its multiples; period 0 has one."""

    def make(p):
        x = _matrix(p, features)[:, 0]
        n = S.period(x, fps)
        at = list(range(0, len(x), n)) if n else [0]
        return {"period": [n] * len(at), "boundary": at}

    return per_key(df.select(*keys, order, features), keys, order, make, "period long, boundary long")


def distance_calibration(cycles: DataFrame, keys: list[str], cycle: str, vector: str) -> DataFrame:
    """(keys, p50, p90, p99) of each cycle's distance to the nearest other of its key, over z-scored vectors.

    Cycles meet only within their key (a subject's normal cycles).
    """
    long = cycles.select(*keys, cycle, F.posexplode(vector).alias("dim", "v"))
    fit = long.groupBy(*keys, "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))
    scaled = long.join(fit, [*keys, "dim"]).select(*keys, cycle, "dim", z.alias("z"))
    whole = scaled.groupBy(*keys, cycle).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda p: p["z"]).alias("a"))
    other = whole.toDF(*keys, "_c", "b")
    near = whole.join(other, keys).filter(F.col(cycle) != F.col("_c")).groupBy(*keys, cycle).agg(F.min(l2(F.col("a"), F.col("b"))).alias("d"))
    return near.groupBy(*keys).agg(*(F.percentile("d", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)))


def gait_summary(scores: DataFrame, subject: str, gait: str, score: str, normal: str) -> tuple[DataFrame, DataFrame]:
    """Mean, deviation and number of scores of each subject and gait; and per subject the ratio of the mean of the other
    gaits to that of the normal one."""
    by = scores.groupBy(subject, gait).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n"))
    usual, other = (F.avg(F.when(c, F.col(score))) for c in (F.col(gait) == normal, F.col(gait) != normal))
    return by, scores.groupBy(subject).agg(F.try_divide(other, usual).alias("separation"))


def nearest_feature(df: DataFrame, keys: list[str], order: str, features: str) -> DataFrame:
    """(keys, order, nearest): for each key's last row the earlier row whose features are nearest, the first of equals."""
    last = df.groupBy(*keys).agg(F.max(order).alias("_last"), F.max_by(features, order).alias("_f"))
    met = df.join(last, keys).filter(F.col(order) < F.col("_last"))
    return met.groupBy(*keys, F.col("_last").alias(order)).agg(F.min_by(order, F.struct(l2(F.col(features), F.col("_f")), order)).alias("nearest"))


def merge_by_jersey(subjects: DataFrame) -> DataFrame:
    """``subjects(subject_id, number, color, first_seen, frames)`` -> each with the subject it merges into: of equal number
    and colour the first seen, which gets all frames. Without a number a subject stays alone."""
    own = Window.partitionBy("number", "color")
    target = F.first("subject_id").over(own.orderBy("first_seen", "subject_id"))
    named = subjects.withColumn("target", F.when(F.col("number").isNull(), F.col("subject_id")).otherwise(target))
    total = F.when(F.col("number").isNull(), F.col("frames")).otherwise(F.sum("frames").over(own))
    return named.withColumn("frames", F.when(F.col("target") == F.col("subject_id"), total).otherwise(0))


def team_by_color(subjects: DataFrame, subject: str, color: str) -> DataFrame:
    """(team, subjects): the last word of a colour and who wears it; no colour, no team."""
    named = subjects.filter(F.col(color).isNotNull()).withColumn("team", F.element_at(F.split(F.trim(color), r"\s+"), -1))
    return named.groupBy("team").agg(F.array_sort(F.collect_list(subject)).alias("subjects"))


def label_to_cluster(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(label, cluster): each label's most frequent cluster, the smallest of equals; -1 counts as 0."""
    n = df.groupBy(label, F.greatest(F.col(cluster), F.lit(0)).alias("_c")).agg(F.count("*").alias("_n"))
    return n.groupBy(label).agg(F.max_by("_c", F.struct("_n", -F.col("_c"))).alias(cluster))


def cluster_count_check(segments: DataFrame, expected: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """(keys, clusters, passed): whether a sequence has as many clusters as ``expected(keys, lo, hi)``; null without that."""
    n = segments.groupBy(*keys).agg(F.countDistinct(cluster).alias("clusters"))
    return n.join(expected, keys, "left").select(*keys, "clusters", F.col("clusters").between(F.col("lo"), F.col("hi")).alias("passed"))


def merge_clusters_by_label(segments: DataFrame, keys: list[str], cluster: str, label: str, start: str, end: str) -> DataFrame:
    """Clusters of one label take the smallest id, then neighbours of one cluster become one segment."""
    from kinetiq.operators.ordered import merge_adjacent

    named = segments.withColumn(cluster, F.min(cluster).over(Window.partitionBy(*keys, label)))
    return merge_adjacent(named, keys, [start], cluster, start, end)
