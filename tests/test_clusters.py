"""Density, online, model and team clusters, isolation scores, change points and live alignment against plain loops."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetiq.operators import clusters as C
from kinetiq.operators import density as N
from kinetiq.operators import outliers as O
from kinetiq.operators import segmentation as G
from kinetiq.operators import smoothing as M

rng = np.random.default_rng(3)


def plain_dbscan(points, distance, least):
    ids = sorted(points)
    near = {i: [j for j in ids if np.linalg.norm(points[i] - points[j]) <= distance] for i in ids}
    core = {i for i in ids if len(near[i]) >= least}
    cluster, n = {}, 0
    for i in ids:
        if i in core and i not in cluster:
            todo = [i]
            while todo:
                k = todo.pop()
                for j in [k, *near[k]]:
                    if j not in cluster:
                        cluster[j] = n
                        todo += [j] if j in core else []
            n += 1
    return {i: (i in core, cluster.get(i, -1)) for i in ids}


def test_dbscan_equals_brute_force_whatever_the_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 25)
    monkeypatch.setattr(N, "BLOCK", 16)
    x = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in (0, 2.2, 5)] + [rng.uniform(-4, 9, (50, 3))])
    points = {int(i): v for i, v in zip(rng.permutation(len(x)), x)}
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in points.items()] + [(900, None, 1)], "id long, v array<double>, cell int")
    got = {r.id: (r.core, r.cluster) for r in N.dbscan(df, 0.8, 5).collect()}
    assert got.pop(900) == (False, -1)
    assert got == plain_dbscan(points, 0.8, 5) and len({c for _, c in got.values()}) > 3
    assert N.dbscan(df.limit(0), 1.0).collect() == []


def test_dbscan_settles_points_by_a_sample_and_compares_only_the_rest(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 25)
    monkeypatch.setattr(N, "BLOCK", 16)
    x = np.concatenate([rng.normal(0, 0.5, (300, 3)), rng.normal(4, 0.4, (60, 3)), rng.uniform(-4, 8, (40, 3)), np.zeros((20, 3)), np.array([[0.8, 0, 0]] * 3)])
    points = {int(i): v for i, v in zip(rng.permutation(len(x)), x)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id long, v array<double>")
    want = plain_dbscan(points, 0.8, 5)
    met = []
    compared = N._compared
    monkeypatch.setattr(N, "_compared", lambda points, *rest: met.append(points.filter("not settled").count()) or compared(points, *rest))
    for size in (1, 40, 100):
        monkeypatch.setattr(N, "SAMPLE", size)
        assert {r.id: (r.core, r.cluster) for r in N.dbscan(df, 0.8, 5).collect()} == want
    assert max(met[-2:]) < len(x) // 2 <= min(met[:2])


def cheapest(x, penalty, least):
    """The least cost over all ways to part a short series."""
    cost = lambda i, j: float(((x[i:j] - x[i:j].mean(axis=0)) ** 2).sum())
    best = (np.inf, None)
    for n in range(len(x) // least):
        for cuts in itertools.combinations(range(least, len(x) - least + 1), n):
            edges = [0, *cuts, len(x)]
            if min(np.diff(edges)) >= least:
                best = min(best, (sum(cost(i, j) for i, j in zip(edges, edges[1:])) + penalty * n, cuts))
    return best


@pytest.mark.parametrize("kind", ["l2", "cosine"])
def test_change_points_are_those_of_the_cheapest_partition(spark, kind):
    rows, want = [], set()
    for key in range(6):
        x = np.concatenate([rng.normal(rng.uniform(-2, 2, 2), 0.4, (int(n), 2)) for n in rng.integers(3, 9, 3)])
        rows += [(key, i, v.tolist()) for i, v in enumerate(x)]
        own = x / np.linalg.norm(x, axis=1)[:, None] if kind == "cosine" else x
        want |= {(key, c) for c in cheapest(own, 0.8, 3)[1]}
    df = spark.createDataFrame(rows, "k int, frame int, f array<double>")
    got = {(r.k, r.change) for r in G.change_points(df, ["k"], ["frame"], "f", least=3, penalty=0.8, cost=kind).collect()}
    assert got == want and len(want) > 5


def test_warping_follows_a_motion_and_a_key_without_one_has_none(spark):
    rep = [[float(np.sin(i / 5)), float(np.cos(i / 7))] for i in range(40)]
    live = [(1, i, rep[i * 40 // 60]) for i in range(60)] + [(2, 0, [0.0, 0.0])]
    frames = spark.createDataFrame(live, "k int, frame long, f array<double>")
    reps = spark.createDataFrame([(1, i, v) for i, v in enumerate(rep)], "k int, phase long, f array<double>")
    for kind in ("nearest", "warp", "pointer"):
        got = {(r.k, r.frame): r.rep_at for r in G.align_live(frames, reps, ["k"], "frame", "f", kind).collect()}
        assert got[2, 0] is None
        assert np.mean([abs(got[1, i] - i * 40 // 60) <= 1 for i in range(58)]) > 0.9, kind


def test_an_odd_row_is_easier_to_isolate(spark):
    x = rng.normal(0, 1, (200, 4))
    x[150] = 9
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, i, [1.0, None, 2.0, 3.0]) for i in range(70)], "k int, frame int, f array<double>")
    rows = sorted(((r.k, r.frame, r.isolation) for r in O.isolation_score(df, ["k"], ["frame"], "f").collect()), key=str)
    rows.sort(key=lambda r: r[:2])
    again_first = dict.fromkeys(map(str, rows))
    one = [s for k, _, s in rows if k == 1]
    assert all(s is None for s in one[:59]) and all(0 <= s <= 1 for s in one[59:])
    assert one[150] > 0.1 and one[150] == max(one[59:]) and sum(s > 0 for s in one[59:]) < 50
    assert [s for k, f, s in rows if k == 2 and f >= 59] == [0.0] * 11  # equal rows: nothing can be parted
    again = sorted(((r.k, r.frame, r.isolation) for r in O.isolation_score(df.repartition(3), ["k"], ["frame"], "f").collect()), key=str)
    assert {str(r) for r in again} == set(again_first)


def test_rows_that_differ_by_rounding_are_parted(spark):
    near = [0.1, float(np.nextafter(0.1, 1)), float("inf"), -1.7e308, 1.7e308]
    df = spark.createDataFrame([(k, i, [near[i % (2 if k == 1 else 5)], 1.0]) for k in (1, 2) for i in range(130)], "k int, frame int, f array<double>")
    rows = O.isolation_score(df, ["k"], ["frame"], "f").collect()
    assert len(rows) == 260 and all(0 <= r.isolation <= 1 for r in rows if r.frame >= 59)


def test_online_clusters_equal_a_loop(spark):
    base = rng.normal(0, 2, (4, 6))
    x = [base[i % 4] + rng.normal(0, 0.3 if i < 30 else 1.2, 6) for i in range(45)]
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "k int, segment int, v array<double>")
    got = [(r.cluster, r.clusters) for r in C.online_clusters(df, ["k"], ["segment"], "v", 3, "merge", 2.0).orderBy("segment").collect()]
    apart = lambda a, b: np.linalg.norm((a - b).reshape(3, 2), axis=1).mean()
    means, want, name, since = {}, [], 0, 0
    for v in x:
        k = min(means, key=lambda c: apart(v, means[c][0]), default=None)
        if k is not None and apart(v, means[k][0]) < 2.0:
            m, n = means[k]
            means[k] = ((m * n + v) / (n + 1), n + 1)
        else:
            k, name = name, name + 1
            means[k] = (v, 1)
        since += 1
        while since >= 10:
            close = [(a, b) for a, b in itertools.combinations(means, 2) if apart(means[a][0], means[b][0]) < 1.4]
            if not close:
                since = 0
                break
            (a, n), (b, m) = (means[c] for c in close[0])
            means[close[0][0]] = ((a * n + b * m) / (n + m), n + m)
            del means[close[0][1]]
        want.append((k, len(means)))
    assert got == want and len({c for c, _ in want}) > 3
    match = [r.cluster for r in C.online_clusters(df, ["k"], ["segment"], "v", 3, "match", 2.0).orderBy("segment").collect()]
    assert match[:4] == [-1] * 4 and 2 <= len(set(match[5:30])) <= 8


def test_models_find_parted_groups(spark):
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 6, 12)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    for kind in ("gmm", "kmeans"):
        got = [r.cluster for r in C.model_clusters(df, "i", "v", kind, most=5).orderBy("i").collect()]
        if kind == "kmeans":
            assert got == [0] * 40 + [1] * 40 + [2] * 40
        assert not set(got[:40]) & set(got[40:80]) and not set(got[40:80]) & set(got[80:]) and got[0] == 0  # mixtures may split a group, never join two
    games = spark.createDataFrame([(1, i, [1.0, 0.0] if i % 3 else [0.0, 1.0], [10.0 * (i % 3 > 0), 0.0, 0.0]) for i in range(9)] + [(2, 1, [1.0, 0.0], [0.0] * 3)], "g int, p int, h array<double>, c array<double>")
    teams = {(r.g, r.p): (r.team, r.team_color[0]) for r in C.team_kmeans(games, ["g"], "p", "h", "c").collect()}
    assert teams == {(1, i): (int(i % 3 > 0), 10.0 * (i % 3 > 0)) for i in range(9)}
    items = spark.createDataFrame([(1, i) for i in range(8)], "k int, s int")
    pairs = spark.createDataFrame([(1, a, b, 0.9 if (a < 3) == (b < 3) else 0.01) for a, b in itertools.combinations(range(8), 2)], "k int, a int, b int, share double")
    got = [r.cluster for r in C.spectral_clusters(pairs, items, ["k"], "s").orderBy("s").collect()]
    assert got == [0] * 3 + [1] * 5


def test_a_second_pass_only_where_one_cluster_prevails(spark):
    frames = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(48)], "k int, frame int")

    def segmented(rows, seconds):
        size = int(seconds)
        return rows.filter(f"frame % {size} = 0").select("k", F.col("frame").alias("start"), F.when(F.col("k") == 1, F.lit(0)).otherwise(F.expr(f"(frame div {size}) % 2")).alias("cluster"))

    got = C.adaptive_resegment(frames, ["k"], segmented, seconds=4)
    assert {(r.k, r.run, r["count"]) for r in got.groupBy("k", "run").count().collect()} == {(1, 2, 6), (2, 1, 12)}


def test_wavelets_of_polynomials_have_no_details_inside():
    w = C.wavelet_matrix(30)
    assert w.shape == (48, 30)
    assert np.allclose(w[:9] @ np.ones(30), 2**1.5) and np.allclose(w[9:] @ np.ones(30), 0, atol=1e-9)
    t = np.arange(30.0)
    for k in (1, 2, 3):
        assert np.allclose((w[30:] @ t**k)[4:14], 0, atol=1e-7 * 30**k)  # the finest level, away from the ends


def test_bones_are_set_to_their_median_length(spark):
    frames = rng.normal(0, 1, (7, 14, 2))
    df = spark.createDataFrame([(1, i, f.tolist()) for i, f in enumerate(frames)], "k int, frame int, p array<array<double>>")
    for r in M.enforce_bone_lengths(df, ["k"], "p").collect():
        steady = np.array(r.steady)
        for p, c in ((8, 10), (10, 12), (11, 13), (2, 4)):  # the outermost aren't moved any more
            goal = np.median(np.linalg.norm(frames[:, c] - frames[:, p], axis=1))
            assert abs(np.linalg.norm(steady[c] - steady[p]) - goal) < 1e-9
