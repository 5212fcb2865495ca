"""Edge rows of the ordered operators: one row, ties, nulls and equal values."""

import numpy as np
from pyspark.sql import functions as F

from kinetiq.functions import geometry as G
from kinetiq.functions import physics as P
from kinetiq.operators import aggregates as A
from kinetiq.operators import joins as J
from kinetiq.operators import ordered as E


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ema_skips_nulls_and_restarts_per_key(spark):
    df = frame(spark, [(1, 0, 2.0), (1, 1, None), (1, 2, 4.0), (2, 0, 8.0)], "s int, i int, x double")
    got = {(r.s, r.i): r.ema for r in E.ema(df, ["s"], ["i"], "x", 0.5).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2.0, (1, 2): 3.0, (2, 0): 8.0}


def test_scan_carries_state_across_batches(spark):
    n = 25_000  # more than one Arrow batch
    df = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("i"), F.lit(1.0).alias("x"))
    assert E.cooldown(df, ["s"], ["i"], "i", 10).count() == n // 10


def test_consolidation_is_measured_from_the_last_kept_event(spark):
    df = frame(spark, [("a", t) for t in (0.0, 3.0, 5.0, 5.1, 9.0, 10.2)], "k string, t double")
    assert sorted(r.t for r in E.consolidate_events(df, ["k"], ["t"], "t").collect()) == [0.0, 5.1, 10.2]


def test_interpolation_edges(spark):
    df = frame(spark, [(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, None), (2, 0, None)], "s int, i int, y double")
    got = {(r.s, r.i): r.filled for r in E.interpolate_nulls(df, ["s"], "i", "y").collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2.0, (1, 2): 3.0, (1, 3): 4.0, (1, 4): 4.0, (2, 0): 0.0}


def test_timeline_breaks_on_gap_label_and_null(spark):
    rows = [(1, 0.0, "a"), (1, 0.4, "a"), (1, 0.9, "a"), (1, 1.0, None), (1, 1.1, "a"), (1, 1.2, "b")]
    got = E.timeline_segments(frame(spark, rows, "s int, t double, c string"), ["s"], "t", "c", []).collect()
    assert sorted((r.c, r.start, r.end) for r in got) == [("a", 0.0, 0.4), ("a", 0.9, 0.9), ("a", 1.1, 1.1), ("b", 1.2, 1.2)]


def test_asof_takes_the_row_at_the_same_time(spark):
    left = frame(spark, [(1, 1.0), (1, 2.5)], "k int, t double")
    right = frame(spark, [(1, 1.0, "x"), (1, 2.0, "y"), (1, 3.0, "z")], "k int, t double, v string")
    assert sorted((r.t, r.r_v) for r in J.asof(left, right, ["k"], "t", ["v"]).collect()) == [(1.0, "x"), (2.5, "y")]


def test_closing_speed_needs_neighbouring_frames_and_caps_pairs(spark):
    rows = [(1, f, s, float(s) * (1 if f == 0 else 0.5), 0.0, float(s) * (1 if f == 0 else 0.5), 0.0, f / 30) for f in (0, 1, 3) for s in range(1, 6)]
    df = frame(spark, rows, "q int, f int, s int, x1 double, y1 double, x2 double, y2 double, t double")
    got = J.closing_speed(df, ["q"], "f", "s").collect()
    assert {r.f for r in got} == {1} and len(got) == 5
    assert abs(max(r.speed for r in got) - 60.0) < 1e-6 and all(r.warning for r in got)


def test_status_follows_events_before_fatigue(spark):
    load = frame(spark, [(i, f) for i, f in ((1, 0.9), (2, 0.0), (3, 0.0), (4, 0.7))], "s int, fatigue double")
    events = frame(spark, [(1, "high")] + [(2, "medium")] * 6 + [(3, "medium")] * 3, "s int, severity string")
    got = {r.s: (r.status, r.pull) for r in A.risk_status(events, load, ["s"]).collect()}
    assert got == {1: ("YELLOW", True), 2: ("RED", True), 3: ("YELLOW", False), 4: ("YELLOW", True)}


def test_impact_physics_limits(spark):
    df = frame(spark, [(0.0, 80.0, 80.0), (5.0, 80.0, 60.0), (30.0, 80.0, 80.0)], "v double, a double, b double")
    rows = df.select(P.impact_physics(F.col("v"), F.col("a"), F.col("b"), F.lit(0.7)).alias("i")).orderBy("v").collect()
    assert rows[0].i.peak_g == 0 and rows[0].i.hic == 0 and rows[0].i.level == "LOW"
    assert rows[2].i.restitution == 0.1 and rows[2].i.applicability == "EXTRAPOLATED"
    assert rows[0].i.probability < rows[1].i.probability < rows[2].i.probability


def test_joint_angle_of_a_limb_without_length(spark):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    row = spark.range(1).select(
        G.joint_angle(p(0.0, 0.0), p(0.0, 0.0), p(1.0, 0.0)).alias("a"), G.joint_angle(p(1.0, 0.0), p(0.0, 0.0), p(0.0, 1.0)).alias("b")
    ).first()
    assert row.a == 180.0 and abs(row.b - 90) < 1e-9


def test_absorb_moves_frames_behind(spark):
    df = frame(spark, [(1, 0), (1, 1), (2, 0), (3, 0)], "s int, f int")
    assert sorted(map(tuple, A.absorb(df, "s", "f", 1, 2).collect())) == [(1, 0), (1, 1), (1, 2), (3, 0)]


def test_empty_inputs(spark):
    empty = frame(spark, [], "s int, i int, x double")
    assert E.ema(empty, ["s"], ["i"], "x", 0.5).count() == 0
    assert A.workload(empty.withColumn("velocity", F.col("x")), ["s"]).count() == 0
    assert E.contiguous_regions(empty, ["s"], "i", F.col("x") > 0).count() == 0


def test_a_null_key_is_one_key(spark):
    df = frame(spark, [(None, 0, 2.0), (None, 1, 4.0), (None, 2, 8.0), (1, 0, 5.0)], "s int, i int, x double")
    got = {(r.s, r.i): r.ema for r in E.ema(df, ["s"], ["i"], "x", 0.5).collect()}
    assert got == {(None, 0): 2.0, (None, 1): 3.0, (None, 2): 5.5, (1, 0): 5.0}


def test_recurrence_over_blocks():
    x, y, out = np.random.default_rng(1).standard_normal(1000), 3.0, []
    for v in x:
        y = v + 0.9 * y
        out.append(y)
    assert np.allclose(E.recurrence(x, 0.9, 3.0), out)


def test_fatigue_falls_back_to_zero(spark):
    df = frame(spark, [(1, i, 0.0 if i < 4 else 1.0) for i in range(6)], "s int, i int, x double")
    got = [r.fatigue for r in E.fatigue_index(df, ["s"], ["i"], "x", rows=6, least=4).orderBy("i").collect()]
    assert got == [0.0] * 6
    falling = df.withColumn("x", 6.0 - F.col("i"))  # of 6, 5 | 4, 3, of 6, 5 | 4, 3, 2 and of 6, 5, 4 | 3, 2, 1
    got = [r.fatigue for r in E.fatigue_index(falling, ["s"], ["i"], "x", rows=6, least=4).orderBy("i").collect()]
    want = [0.0, 0.0, 0.0]
    for a, b in ((5.5, 3.5), (5.5, 3.0), (5.0, 2.0)):
        want.append(0.05 * (a - b) / a + 0.95 * want[-1])
    assert np.allclose(got, want)


def test_pattern_rules(spark):
    rows = [(k, i, c) for k, seq in enumerate(("AAA", "AABB", "AAABBBAAA", "ABCA", "ABCAB")) for i, c in enumerate(seq)]
    got = {r.k: r.pattern for r in E.temporal_pattern(frame(spark, rows, "k int, i int, c string"), ["k"], ["i"], "c").collect()}
    assert got == {0: "uniform", 1: "sequential", 2: "alternating", 3: "mixed", 4: "alternating"}


def test_curvature_uses_the_velocity_before(spark):
    rows = [(1, 0, [0.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [2.0, 1.0]), (1, 3, [2.0, 3.0])]
    got = [(r.curvature, r.jerk) for r in E.curvature_jerk(frame(spark, rows, "s int, i int, f array<double>"), ["s"], ["i"]).orderBy("i").collect()]
    # rows 2 and 3: velocities (1, 0), (1, 1), (0, 2); accelerations (0, 1), (-1, 1)
    assert got[:2] == [(0.0, 0.0)] * 2 and got[2] == (1.0, 0.0)
    assert abs(got[3][0] - 2**0.5 / 2) < 1e-9 and abs(got[3][1] - 1.0) < 1e-9


def test_regions_end_with_their_last_row(spark):
    df = frame(spark, [(1, i, m) for i, m in enumerate((True, True, False, True))], "s int, i int, m boolean")
    assert sorted((r.start, r.end) for r in E.contiguous_regions(df, ["s"], "i", F.col("m")).collect()) == [(0, 1), (3, 3)]


def test_hip_drop_is_positive_where_the_left_hip_is_higher(spark):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    row = spark.range(1).select(G.hip_drop(p(0.0, 0.0), p(5.0, 1.0)).alias("a"), G.hip_drop(p(0.0, 0.0), p(5.0, 1.0), y_up=True).alias("b")).first()
    assert abs(row.a - 11.3099) < 1e-3 and abs(row.b + 11.3099) < 1e-3
