"""Control charts and filters against plain loops."""

import numpy as np

from kinetiq.functions.skeleton import BONES
from kinetiq.operators import monitors as M


def test_labels_of_short_runs(spark):
    rows = [(k, i, c) for k, seq in enumerate(("AAABAAACCB", "BAAAB", "ABABAB", "A")) for i, c in enumerate(seq)]
    df = spark.createDataFrame(rows, "k int, i int, c string")
    got = {}
    for r in M.temporal_smooth_labels(df, ["k"], ["i"], "c", 2).orderBy("k", "i").collect():
        got[r.k] = got.get(r.k, "") + r.smoothed
    assert got == {0: "AAAAAAACCC", 1: "BAAAA", 2: "AAAAAA", 3: "A"}


def test_label_runs_join_the_longer_neighbour(spark):
    seq = "A" * 5 + "B" + "C" * 3 + "A" + "C" * 4 + "D"
    df = spark.createDataFrame([(1, i, c, float(i)) for i, c in enumerate(seq)], "k int, i int, c string, p double")
    got = [(r.c, r.start, r.end) for r in M.label_runs(df, ["k"], "i", "c", "p", 0.5, 1.0).orderBy("start").collect()]
    # B joins A (longer), the single A joins the longer C after it, D joins C
    assert got == [("A", 0.0, 3.0), ("C", 3.0, 7.5)]


def slow_filter(frames):
    lengths, out = {}, []
    for n, joints in enumerate(frames, 1):
        joints = np.array(joints)
        for p, c in BONES:
            now = np.linalg.norm(joints[c] - joints[p])
            lengths[p, c] = now if (p, c) not in lengths else 0.05 * now + 0.95 * lengths[p, c]
        if n >= 30:
            joints = joints.copy()
            for p, c in BONES:
                way = joints[c] - joints[p]
                size = np.linalg.norm(way)
                if size >= 1e-8:
                    joints[c] = joints[p] + way / size * lengths[p, c]
        out.append(joints)
    return np.array(out)


def test_bone_lengths_against_a_loop(spark):
    rng = np.random.default_rng(4)
    frames = {k: rng.standard_normal((50, 14, 2)) for k in (1, 2)}
    rows = [(k, i, f.tolist()) for k, v in frames.items() for i, f in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, i int, j array<array<double>>")
    got = M.bone_length_filter(df, ["k"], ["i"], "j").orderBy("k", "i").collect()
    for k, v in frames.items():
        assert np.allclose([r.steady for r in got if r.k == k], slow_filter(v))


def test_savgol_weights_are_the_classic_ones():
    assert np.allclose(M.savgol_weights(5, 2)[2] * 35, [-3, 12, 17, 12, -3])
    assert np.allclose(M.savgol_weights(5, 2, 1)[2] * 10, [-2, -1, 0, 1, 2])


def test_cusum_onset(spark):
    x = [1.0, 1.2, 0.8, 1.0, 5.0, 5.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, x double")
    m, s, c, want = 1.0, np.std(x[:4]), 0.0, []
    for i, v in enumerate(x):
        c = 0.0 if i == 0 else max(0.0, c + v - m - 0.25 * s)
        want.append(c)
    got = M.cusum(df, ["k"], "i", "x", 4).orderBy("i").collect()
    assert np.allclose([r.cusum for r in got], want) and {r.onset for r in got} == {4}
