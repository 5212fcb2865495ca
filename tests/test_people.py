"""Contacts against a plain loop over pairs."""

import math

import numpy as np

from kinetiq.operators import people as O

ZONES = {**{i: "head_to_head" for i in range(5)}, 5: "head_to_shoulder", 6: "head_to_shoulder", 7: "head_to_torso", 8: "head_to_torso", 11: "head_to_torso", 12: "head_to_torso"}


def center(p):
    seen = [q for q in p[:5] if q[2] >= 0.3]
    return np.mean([q[:2] for q in seen], axis=0) if seen else None


def to_body(a, b):
    head = center(a)
    seen = [i for i in range(5, 17) if b[i][2] >= 0.3]
    if head is None or not seen:
        return math.inf, -1
    d, k = min((float(np.hypot(*(np.array(b[i][:2]) - head))), i) for i in seen)
    torso = [b[i][:2] for i in (5, 6, 11, 12) if b[i][2] >= 0.3]
    if len(torso) >= 2 and (far := float(np.hypot(*(np.mean(torso, axis=0) - head)))) < d:
        return far, 11
    return d, k


def contact(a, b):
    box = lambda p: (min(q[0] for q in p), min(q[1] for q in p), max(q[0] for q in p), max(q[1] for q in p))
    x, y = box(a), box(b)
    w, h = max(0, min(x[2], y[2]) - max(x[0], y[0])), max(0, min(x[3], y[3]) - max(x[1], y[1]))
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    if w * h / (area(x) + area(y) - w * h) < 0.05:
        return None
    (d1, k1), (d2, k2) = to_body(a, b), to_body(b, a)
    d, k, struck = (d1, k1, "a") if d1 <= d2 else (d2, k2, "b")
    ha, hb = center(a), center(b)
    if ha is not None and hb is not None and (hh := float(np.hypot(*(ha - hb)))) < d:
        d, k, struck = hh, 0, "a"
    if not math.isfinite(d) or d > 0.25 * (math.hypot(x[2] - x[0], x[3] - x[1]) + math.hypot(y[2] - y[0], y[3] - y[1])):
        return None
    return round(d, 6), struck, ZONES.get(k, "head_to_limb")


def test_contacts_against_a_loop(spark):
    rng = np.random.default_rng(5)
    people, rows = {}, []
    for f in range(25):
        for s in range(4):
            p = np.c_[rng.normal(rng.uniform(0, 60), 25, 17), rng.normal(50, 25, 17), rng.uniform(0, 1, 17)]
            if f == 3:
                p[:5, 2] = 0.1  # heads unseen
            people[f, s] = p.tolist()
            rows.append((f, s, p.tolist(), float(p[:, 0].min()), float(p[:, 1].min()), float(p[:, 0].max()), float(p[:, 1].max())))
    df = spark.createDataFrame(rows, "f int, s int, k array<array<double>>, x1 double, y1 double, x2 double, y2 double")
    df = df.withColumn("k", __import__("pyspark.sql.functions", fromlist=["x"]).expr("transform(k, q -> struct(q[0] as x, q[1] as y, q[2] as c))"))
    got = {(r.f, r.a_s, r.b_s): (round(r.distance, 6), "a" if r.struck == r.a_s else "b", r.zone) for r in O.detect_contacts(df, ["f"], "s", "k").collect()}
    want = {}
    for f in range(25):
        for i in range(4):
            for j in range(i + 1, 4):
                if c := contact(people[f, i], people[f, j]):
                    want[f, i, j] = c
    assert len(want) > 20 and got == want


def test_kmeans_and_projection_keep_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(5) + 8 * (i % 3)).tolist()) for i in range(90)] + [(90, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    got = {r.i: r.cluster for r in O.kmeans_cycles(df, "v", 3).collect()}
    assert len(got) == 91 and len({got[i] for i in range(0, 90, 3)}) == 1 and len(set(got.values())) == 3
    assert all(len(r.place) == 3 for r in O.project_3d(df.filter("i < 90"), "v").collect())
