"""Sequence operators against plain loops and known signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetiq.functions import signals as S
from kinetiq.functions import skeleton as K
from kinetiq.operators import clusters as C
from kinetiq.operators import joins as J
from kinetiq.operators import sequences as Q


def test_lowpass_keeps_slow_and_drops_fast():
    t = np.arange(300) / 30
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 12 * t)
    got = S.lowpass(slow + fast)
    assert np.abs(got - slow)[20:-20].max() < 0.02
    assert np.allclose(S.lowpass(np.full(50, 3.0)), 3.0) and S.lowpass(np.arange(9.0)).tolist() == list(range(9))


def test_peaks_by_height_distance_and_prominence():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 1.0, 0])
    assert S.peaks(x).tolist() == [1, 3, 6, 9]
    assert S.peaks(x, 3).tolist() == [3, 6, 9]
    assert S.peaks(x, 4).tolist() == [3, 9]
    assert S.peaks(x, 1, 2.0).tolist() == [3, 6]
    assert S.peaks(np.array([1.0, 2.0])).tolist() == []


def test_heel_strikes_and_period_of_a_sine(spark):
    df = spark.createDataFrame([(1, i, float(np.cos(2 * np.pi * i / 30))) for i in range(150)], "k int, i int, y double")
    got = sorted(r.strike for r in Q.heel_strikes(df, ["k"], "i", "y").collect())
    assert len(got) == 5 and all(abs(s - (15 + 30 * n)) <= 1 for n, s in enumerate(got))
    f = df.selectExpr("k", "i", "array(y) as f")
    rows = Q.periodicity(f, ["k"], "i", "f").collect()
    assert {r.period for r in rows} == {30} and sorted(r.boundary for r in rows) == [0, 30, 60, 90, 120]


def slow_linkage(d, threshold):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((np.mean([d[a, b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if best[0] > threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("threshold", [0.5, 1.0, 2.0, 9.0])
def test_average_linkage(threshold):
    x = np.random.default_rng(3).standard_normal((25, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    labels = S.average_linkage(d, threshold)
    got = {}
    for i, c in enumerate(labels):
        got.setdefault(c, set()).add(i)
    assert {frozenset(g) for g in got.values()} == slow_linkage(d, threshold) and labels[0] == 0


def test_boundaries_at_pauses():
    rng = np.random.default_rng(1)
    pace = np.concatenate([np.r_[np.full(40, 1.0), np.full(14, 0.0)] for _ in range(4)])
    way = rng.standard_normal(6)
    x = np.cumsum(pace[:, None] * way / np.linalg.norm(way), axis=0)
    got = S.motion_boundaries(x, fps=10.0, seconds=1.0)
    assert got[0] == 0 and len(got) == 4 and all(40 + 54 * k <= b <= 54 + 54 * k for k, b in enumerate(got[1:]))


def test_clusters_join_neighbours_and_absorb_the_small(spark):
    means = [0.0, 0.1, 5.0, 0.0, 5.1, 2.0]
    rows = [(1, i, 10 * i, 10 * i + 10, 10 * i, 10 * i + 9, [m, 0.0]) for i, m in enumerate(means)]
    seg = spark.createDataFrame(rows, "k int, segment int, start_valid long, end_valid long, start_frame long, end_frame long, mean_feature array<double>")
    pairs = [(1, a, b, abs(means[a] - means[b])) for a in range(6) for b in range(a + 1, 6)]
    got = Q.cluster_segments(seg, spark.createDataFrame(pairs, "k int, a int, b int, distance double"), ["k"], threshold=1.0).orderBy("start_valid").collect()
    # 0 and 1 are neighbours; the lone segment at 2.0 is nearest to the cluster around 0
    assert [(r.start_valid, r.end_valid, r.cluster) for r in got] == [(0, 20, 0), (20, 30, 1), (30, 40, 0), (40, 50, 1), (50, 60, 0)]


def test_procrustes_undoes_a_turn():
    rng = np.random.default_rng(2)
    goal = rng.standard_normal((6, 3))
    a = 0.7
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    assert np.allclose(S.procrustes(2.5 * goal @ turn.T + 4, goal), goal)


def test_smoothness_of_known_signals():
    t = np.arange(64) / 30
    tone, noise = np.sin(2 * np.pi * 30 / 64 * 4 * t), np.random.default_rng(1).standard_normal(64)
    assert S.spectral_entropy(tone) < 0.05 < 0.7 < S.spectral_entropy(noise)
    assert abs(S.median_frequency(tone) - 30 / 64 * 4) < 1e-9
    assert S.sample_entropy(tone) < S.sample_entropy(noise) and S.sample_entropy(np.ones(9)) == 0.0
    assert S.sparc(np.hanning(64)) > S.sparc(np.abs(noise))
    assert S.log_jerk(np.c_[np.hanning(64)]) > S.log_jerk(np.c_[noise])


def test_risks_by_profile_and_by_person(spark):
    rows = spark.createDataFrame([(1, 7, -20.0, 9.0), (2, 8, 30.0, None)], "i int, person int, fppa_left double, hip_drop double")
    found = lambda df: sorted((r.i, r.risk, r.severity, r.value, round(r.threshold, 2)) for r in df.collect())
    assert found(Q.injury_risks(rows, ["i"])) == [(1, "hip_drop", "medium", 9.0, 8.0), (1, "knee_valgus", "medium", 20.0, 15.0), (2, "knee_valgus", "high", 30.0, 25.0)]
    scales = spark.createDataFrame([(7, 0.65, 1.0, 1.0, 1.0)], "person int, fppa_scale double, hip_drop_scale double, trunk_lean_scale double, asymmetry_scale double")
    scaled = found(Q.injury_risks(rows, ["i"], scales=scales, person=["person"]))
    assert (1, "knee_valgus", "high", 20.0, 16.25) in scaled and (2, "knee_valgus", "high", 30.0, 25.0) in scaled
    profile = spark.createDataFrame([("hip_drop", "pelvis", "drop", 1.0, 5.0, True), ("fppa_left", "k", "v", 1.0, 2.0, False)], "metric string, joint string, risk string, medium double, high double, enabled boolean")
    assert found(Q.injury_risks(rows, ["i"], profile)) == [(1, "drop", "high", 9.0, 5.0)]


def test_new_metrics_and_distances(spark):
    from pyspark.sql import functions as F

    Q.register_metric("sway", lambda: F.col("sway"))
    try:
        rows = spark.createDataFrame([(1, 3.0)], "i int, sway double")
        profile = spark.createDataFrame([("sway", "trunk", "unsteady", 1.0, 2.0, True)], "metric string, joint string, risk string, medium double, high double, enabled boolean")
        assert [(r.risk, r.severity) for r in Q.injury_risks(rows, ["i"], profile).collect()] == [("unsteady", "high")]
    finally:
        del Q.METRICS["sway"]
    Q.register_distance("first", lambda ma, mb, sa, sb: F.abs(F.get(ma, 0) - F.get(mb, 0)))
    try:
        spectra = spark.createDataFrame([(1, 0, [1.0], [0.0]), (1, 1, [4.0], [0.0])], "k int, s int, mean array<double>, spectrum array<double>")
        assert [r.distance for r in Q.segment_distance(spectra, ["k"], "s", "first").collect()] == [3.0]
    finally:
        del Q.DISTANCES["first"]


def test_linkage_by_blocks_equals_linkage_of_the_whole_matrix(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(S, "HELD", 10)
    monkeypatch.setattr(S, "BLOCK", 200)
    for n in (1, 2, 40, 120):
        x = rng.normal(0, 1, (n, 3))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        met = []
        apart = lambda a, b: met.append(len(a) * len(b)) or d[np.ix_(a, b)]
        for limit in (0.3, 0.9, 2.0):
            assert S.linkage_by_blocks(apart, n, limit) == S.average_linkage(d, limit)
        assert max(met) <= max(200, n)


def test_segments_of_spectra_cluster_as_those_of_pairs_and_spans_meet_only_near_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, [float(v) for v in rng.normal((i // 6) % 3, 0.3, 4)]) for k in (1, 2) for i in range(150)]
    frames = spark.createDataFrame(rows, "k int, frame long, f array<double>")
    marks = frames.filter("frame % 6 = 0").select("k", F.col("frame").alias("boundary"))
    segments = Q.segment_motions(frames, marks, ["k"], "frame", "frame", "f")
    inside = J.within(frames, segments.select("k", "segment", "start_valid", "end_valid"), ["k"], "frame", "start_valid", "end_valid")
    assert inside.count() == 300
    spans = spark.createDataFrame([(1, 0, 150), (1, 63, 65), (1, 64, 64), (2, 128, 999)], "k int, a int, b int")
    assert J.within(frames, spans, ["k"], "frame", "a", "b").count() == 150 + 2 + 22
    spectra = Q.segment_spectra(inside.withColumns({"at": F.expr("frame - start_valid"), "length": F.expr("end_valid - start_valid")}), ["k", "segment"])
    pairs = Q.segment_distance(spectra, ["k"], "segment")
    got = [Q.cluster_segments(segments, d, ["k"], threshold=1.0).orderBy("k", "start_valid").collect() for d in (spectra, pairs)]
    assert got[0] == got[1] and len({r.cluster for r in got[0]}) == 3
    near = lambda d: np.exp(-((d / 0.2) ** 2) / 2)
    shares = pairs.withColumn("share", F.exp(-F.pow(F.col("distance") / 0.2, 2) / 2))
    two = [c.orderBy("k", "segment").collect() for c in (C.spectral_segments(spectra, ["k"], "segment", near), C.spectral_clusters(shares, spectra.select("k", "segment"), ["k"], "segment"))]
    assert two[0] == two[1] and len({r.cluster for r in two[0]}) > 1


def test_smallest_eigenvalues_are_the_same_without_the_others(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1, (200, 3)) for c in (0, 5, 10)])
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 8)
    whole = C._smallest(w.copy(), 9)
    monkeypatch.setattr(C, "DENSE", 100)
    part = C._smallest(w.copy(), 9)
    assert np.allclose(whole[0], part[0], atol=1e-9) and np.allclose(np.abs((whole[1] * part[1]).sum(axis=0)), 1, atol=1e-6)


def test_joints_of_a_feature_vector_are_worked_out_once(spark):
    df = spark.createDataFrame([(1, [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}])], "k int, p array<struct<x:double,y:double>>")
    moved = F.transform("p", lambda j: j.withField("x", j["x"] + 12345.678))
    out = df.select(K.feature_vector(moved, (0, 1), "xy").alias("f"))
    assert out.first().f == [12346.678, 2.0, 12348.678, 4.0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("12345.678") == 1
