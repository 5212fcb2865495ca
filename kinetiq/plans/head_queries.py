"""Queries of heads over time and of smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetiq.operators import heads as H
from kinetiq.operators import joins as J
from kinetiq.operators import smoothing as M
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORDER, query, r, up

# a subject's head: places in metres (some jump over two), and the angle between the ears
_HEAD = "SELECT subject_id, frame, x / 30 AS hx, k / 60.0::DOUBLE AS hy, (x * 7 + k) / 10 - 6.283185307179586 * floor((x * 7 + k) / 62.83185307179586) - 3.14159 AS ear FROM signal"

_RECURRENCE = """,
q(subject_id, frame, hx, hy, ear, moving, vx, vy, ax, ay, jerk, turn, dir) AS (
  SELECT subject_id, frame, hx, hy, ear, true, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM h WHERE frame = 0
  UNION ALL
  SELECT subject_id, frame, hx, hy, CASE WHEN NOT jump THEN ear END, NOT jump, CASE WHEN jump THEN 0 ELSE wx END, CASE WHEN jump THEN 0 ELSE wy END,
    CASE WHEN jump THEN 0 ELSE bx END, CASE WHEN jump THEN 0 ELSE "by" END,
    CASE WHEN jump THEN 0 ELSE 0.25::DOUBLE * sqrt((rx - bx) ** 2 + (ry - "by") ** 2) * 30 + 0.75::DOUBLE * jerk END,
    CASE WHEN jump THEN 0 ELSE 0.3::DOUBLE * CASE WHEN before IS NULL THEN 0 ELSE abs(d - 6.283185307179586 * floor((d + pi()) / 6.283185307179586)) * 30 END + 0.7::DOUBLE * turn END,
    CASE WHEN jump OR NOT moving OR sqrt(bx ** 2 + "by" ** 2) <= 0.5 OR sqrt(ax ** 2 + ay ** 2) <= 0.5 THEN 0
      ELSE acos(greatest(-1, least(1, (bx * ax + "by" * ay) / (sqrt(bx ** 2 + "by" ** 2) * sqrt(ax ** 2 + ay ** 2))))) END
  FROM (SELECT *, 0.3::DOUBLE * rx + 0.7::DOUBLE * ax AS bx, 0.3::DOUBLE * ry + 0.7::DOUBLE * ay AS "by" FROM (
    SELECT *, CASE WHEN moving THEN (wx - vx) * 30 ELSE 0 END AS rx, CASE WHEN moving THEN (wy - vy) * 30 ELSE 0 END AS ry FROM (
      SELECT h.*, sqrt((h.hx - q.hx) ** 2 + (h.hy - q.hy) ** 2) > 2 AS jump, q.moving, q.vx, q.vy, q.ax, q.ay, q.jerk, q.turn, q.ear AS before, h.ear - q.ear AS d,
        0.4::DOUBLE * (h.hx - q.hx) * 30 + 0.6::DOUBLE * q.vx AS wx, 0.4::DOUBLE * (h.hy - q.hy) * 30 + 0.6::DOUBLE * q.vy AS wy
      FROM q JOIN h ON h.subject_id = q.subject_id AND h.frame = q.frame + 1)))),
kin AS (SELECT subject_id, frame, sqrt(vx ** 2 + vy ** 2) AS speed, least(sqrt(ax ** 2 + ay ** 2) / 9.81::DOUBLE, 100) AS accel_g, dir AS turn_rad, least(jerk, 50000) AS jerk, turn AS rotation FROM q)"""
_KINEMATICS = f", h AS ({_HEAD})" + _RECURRENCE


def _heads(spark, d):
    turn = 6.283185307179586
    angle = (F.col("x") * 7 + F.col("k")) / 10
    s = V.signal(spark, d)
    return s.select(*KEY, *ORDER, (F.col("x") / 30).alias("hx"), (F.col("k") / 60).alias("hy"), (angle - turn * F.floor((F.col("x") * 7 + F.col("k")) / (10 * turn)) - 3.14159).alias("ear"))


def _kinematics(spark, d):
    return H.head_kinematics(_heads(spark, d), KEY, ORDER, "hx", "hy", "ear")


@query(with_views(_KINEMATICS + " SELECT subject_id, frame, round(speed, 4) AS speed, round(accel_g, 4) AS accel_g, round(turn_rad, 4) AS turn_rad, round(jerk, 2) AS jerk, round(rotation, 4) AS rotation FROM kin", "signal"))
def e7_head_kinematics(spark, d):
    out = _kinematics(spark, d)
    return out.select(*KEY, *ORDER, *(r(c, 2 if c == "jerk" else 4).alias(c) for c in H.KINEMATICS))


_RATING = """, h AS (SELECT subject_id, frame, CASE WHEN k % 5 <> 0 THEN x * 3 END AS nx, k * 2.0::DOUBLE AS ny, x - 5 AS lx, k - 3.0::DOUBLE AS ly, x + k / 20.0::DOUBLE AS rx, 40 - x AS ry, k + 1.0::DOUBLE AS w FROM signal),
q(subject_id, frame, nx, ny, ear, turn, base, peak, hold) AS (
  SELECT subject_id, -1::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0::DOUBLE, NULL::DOUBLE, 0::DOUBLE, 0 FROM h WHERE frame = 0
  UNION ALL
  SELECT subject_id, frame, nx, ny, ear, turn, base, CASE WHEN score > peak THEN score WHEN hold > 0 THEN peak ELSE peak * 0.92::DOUBLE END, CASE WHEN score > peak THEN 45 WHEN hold > 0 THEN hold - 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN here THEN least(greatest((speed - 5) / 10, 0), 1) * 40 + least(greatest((turn - 12) / 23, 0), 1) * 35
      + least(greatest(((speed - greatest(base, 0.01::DOUBLE)) / greatest(base, 0.01::DOUBLE) - 5) / 10, 0), 1) * 25 ELSE -1 END AS score FROM (
    SELECT subject_id, frame, here, CASE WHEN here THEN nx ELSE px END AS nx, CASE WHEN here THEN ny ELSE py END AS ny, CASE WHEN here THEN angle ELSE before END AS ear, peak, hold, speed,
      CASE WHEN here THEN 0.3::DOUBLE * coalesce(abs(d - 6.283185307179586 * floor((d + pi()) / 6.283185307179586)) * 30, 0) + 0.7::DOUBLE * turn ELSE turn END AS turn,
      CASE WHEN here THEN coalesce(0.05::DOUBLE * speed + 0.95::DOUBLE * base, speed) ELSE base END AS base FROM (
      SELECT *, angle - before AS d FROM (
        SELECT h.subject_id, h.frame, h.nx IS NOT NULL AS here, h.nx, h.ny, q.nx AS px, q.ny AS py, q.ear AS before, q.turn, q.base, q.peak, q.hold, atan2(h.ry - h.ly, h.rx - h.lx) AS angle,
          coalesce(sqrt((h.nx - q.nx) ** 2 + (h.ny - q.ny) ** 2), 0) * CASE WHEN h.w > 1 THEN 0.4::DOUBLE / h.w ELSE 0.002::DOUBLE END * 30 AS speed
        FROM q JOIN h ON h.subject_id = q.subject_id AND h.frame = q.frame + 1)))))
SELECT subject_id, frame, round(greatest(0, least(100, peak)), 4) AS rating FROM q WHERE frame >= 0"""


@query(with_views(_RATING, "signal"))
def e8_concussion_rating(spark, d):
    x, k = F.col("x"), F.col("k").cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    s = V.signal(spark, d).select(*KEY, *ORDER, point(F.when(F.col("k") % 5 != 0, x * 3), k * 2).alias("nose"), point(x - 5, k - 3).alias("left"), point(x + k / 20, 40 - x).alias("right"), (k + 1).alias("w"))
    return H.concussion_rating(s, KEY, ORDER, "nose", "left", "right", "w").select(*KEY, *ORDER, r("rating").alias("rating"))


# pairs: subjects of one group of fifteen whose x values come nearer from frame to frame
_PAIRS = """, s AS (SELECT subject_id // 15 AS seq_id, subject_id, frame, x, lag(x) OVER (PARTITION BY subject_id ORDER BY frame) AS px FROM signal),
p AS (SELECT a.seq_id, a.frame, a.subject_id AS a, b.subject_id AS b, (abs(a.px - b.px) - abs(a.x - b.x)) / 100 AS speed FROM s a JOIN s b ON a.seq_id = b.seq_id AND a.frame = b.frame AND a.subject_id < b.subject_id)"""

_WINDOWS = """, f AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY seq_id, a, b ORDER BY frame) > 15, true)::INT AS new FROM p WHERE speed >= 0.8),
i AS (SELECT *, sum(new) OVER (PARTITION BY seq_id, a, b ORDER BY frame) AS i FROM f),
w AS (SELECT seq_id, a, b, min(frame) AS start, max(frame) + 15 AS stop, max(speed) AS closing FROM i GROUP BY seq_id, a, b, i),
e AS (SELECT seq_id, a AS subject, b AS other, start, stop, closing FROM w UNION ALL SELECT seq_id, b, a, start, stop, closing FROM w),
m AS (SELECT seq_id, subject, other, start, stop, closing, max(accel_g) AS g, max(degrees(turn_rad)) AS deg, max(jerk) AS jerk, max(rotation) AS rot, count(*) FILTER (WHERE accel_g > 3) AS n
  FROM e JOIN kin ON kin.subject_id = e.subject AND kin.frame BETWEEN start AND stop GROUP BY ALL),
z AS (SELECT *, least(greatest(g - 3, 0) / 12, 1) * 30 + least(greatest(deg - 30, 0) / 120, 1) * 25 + least(greatest(n - 1, 0) / 4, 1) * 15 + least(greatest(rot - 12, 0) / 23, 1) * 20 + least(greatest(closing - 0.8::DOUBLE, 0) / 2.2::DOUBLE, 1) * 10 AS raw FROM m WHERE g >= 3 OR deg >= 60)
SELECT seq_id, subject, other, start, stop AS "end", round(closing, 4) AS closing, round(g, 3) AS peak_g, round(deg, 2) AS turn_deg, round(rot, 3) AS rotation, n AS frames, round(100 / (1 + exp(-0.08::DOUBLE * (raw - 50))), 3) AS probability FROM z"""


def approaching(spark, d):
    """(kinematics, pairs) of the groups of fifteen subjects."""
    kin = _kinematics(spark, d).withColumn("seq_id", F.expr("subject_id div 15"))
    own = V.signal(spark, d).select(F.expr("subject_id div 15").alias("seq_id"), "subject_id", "frame", "x", F.expr("lag(x) over (partition by subject_id order by frame)").alias("px"))
    p = J.pairs_in_frame(own, ["seq_id", "frame"], "subject_id")
    speed = (F.abs(F.col("a_px") - F.col("b_px")) - F.abs(F.col("a_x") - F.col("b_x"))) / 100
    return kin, p.select("seq_id", "frame", F.col("a_subject_id").alias("a"), F.col("b_subject_id").alias("b"), speed.alias("speed"))


@query(with_views(_KINEMATICS + _PAIRS + _WINDOWS, "signal"))
def c4_approach_impacts(spark, d):
    kin, pairs = approaching(spark, d)
    out = H.approach_impacts(kin, pairs, ["seq_id"], "frame", "subject_id", "a", "b", "speed")
    return out.select(
        "seq_id", "subject", "other", "start", "end", r("closing").alias("closing"), r("peak_g", 3).alias("peak_g"), r("turn_deg", 2).alias("turn_deg"), r("rotation", 3).alias("rotation"), "frames",
        r("probability", 3).alias("probability"),
    )


_SMOOTH = """, w(subject_id, frame, e, de, k, kv, p00, p01, p11, lv, tr) AS (
  SELECT subject_id, frame, x, 0::DOUBLE, x, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, x, 0::DOUBLE FROM signal WHERE frame = 0
  UNION ALL
  SELECT subject_id, frame, a * x + (1 - a) * e, de, pk + g0 * (x - pk), kv + g1 * (x - pk), q00 - g0 * q00, q01 - g0 * q01, q11 - g1 * q01, lv, 0.05::DOUBLE * (lv - l0) + 0.95::DOUBLE * tr
  FROM (SELECT *, 1 / (1 + 30 / (2 * pi() * (1.5::DOUBLE + 0.01::DOUBLE * abs(de)))) AS a, q00 / (q00 + 0.01::DOUBLE) AS g0, q01 / (q00 + 0.01::DOUBLE) AS g1 FROM (
    SELECT s.subject_id, s.frame, s.x, w.e, c * (s.x - w.e) * 30 + (1 - c) * w.de AS de, w.k + w.kv / 30 AS pk, w.kv, w.p00 + 2 * w.p01 / 30 + w.p11 / 900 + 0.001::DOUBLE / 81000 AS q00,
      w.p01 + w.p11 / 30 + 0.001::DOUBLE / 1800 AS q01, w.p11 + 0.001::DOUBLE / 30 AS q11, w.lv AS l0, 0.3::DOUBLE * s.x + 0.7::DOUBLE * (w.lv + w.tr) AS lv, w.tr
    FROM w JOIN signal s ON s.subject_id = w.subject_id AND s.frame = w.frame + 1, (SELECT 1 / (1 + 30 / (2 * pi())) AS c)))),
m AS (SELECT subject_id, frame, list_sort([coalesce(lag(x) OVER o, x), x, coalesce(lead(x) OVER o, x)])[2] AS m FROM signal WINDOW o AS (PARTITION BY subject_id ORDER BY frame)),
n AS (SELECT a.subject_id, a.frame, sum(CASE WHEN b.frame = 0 THEN 1 ELSE 0.4::DOUBLE END * pow(0.6::DOUBLE, a.frame - b.frame) * b.m) AS m FROM m a JOIN m b ON a.subject_id = b.subject_id AND b.frame <= a.frame GROUP BY ALL)
SELECT w.subject_id, w.frame, round(e + 1e-9::DOUBLE, 4) AS one_euro, round(k + 1e-9::DOUBLE, 4) AS kalman, round(lv + tr + 1e-9::DOUBLE, 4) AS double_ema, round(m + 1e-9::DOUBLE, 4) AS median_ema FROM w JOIN n USING (subject_id, frame)"""


@query(with_views(_SMOOTH, "signal"))
def f19_smooth(spark, d):
    s = V.signal(spark, d).select(*KEY, *ORDER, "x")
    for method in ("one_euro", "kalman", "double_ema", "median_ema"):
        s = M.smooth(s, KEY, ORDER, "x", method, out=method)
    return s.select(*KEY, *ORDER, *(up(F.col(m)).alias(m) for m in ("one_euro", "kalman", "double_ema", "median_ema")))



@query(with_views(""", b AS (SELECT label, median(sqrt((joints[1].x - joints[2].x) ** 2 + (joints[1].y - joints[2].y) ** 2)) AS span, median(sqrt((joints[1].x - joints[3].x) ** 2 + (joints[1].y - joints[3].y) ** 2)) AS arm FROM pose14 GROUP BY 1),
e AS (SELECT vec_id, joints[1] AS s, joints[3] AS e, span, arm, joints[2] AS t FROM pose14 JOIN b USING (label))
SELECT vec_id, round(s.x + (t.x - s.x) * span / sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2), 4) AS right_x, round(s.x + (e.x - s.x) * arm / sqrt((e.x - s.x) ** 2 + (e.y - s.y) ** 2), 4) AS elbow_x,
  round(s.y + (e.y - s.y) * arm / sqrt((e.x - s.x) ** 2 + (e.y - s.y) ** 2), 4) AS elbow_y FROM e""", "pose14"))
def f19_bone_lengths(spark, d):
    p = V.pose14(spark, d).select("vec_id", "label", F.transform("joints", lambda j: F.array(j["x"], j["y"])).alias("p"))
    out = M.enforce_bone_lengths(p, ["label"], "p")
    at = lambda j, c: r(F.get(F.get("steady", j), c))
    return out.select("vec_id", at(1, 0).alias("right_x"), at(2, 0).alias("elbow_x"), at(2, 1).alias("elbow_y"))
