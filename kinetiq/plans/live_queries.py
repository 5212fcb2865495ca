"""Queries of the live operators, run over the tables: what a stream of the same rows gives, whatever its micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

import kinetiq.plans.registry  # noqa: F401  its SQL is used here
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORACLES, ORDER, query, r, up
from kinetiq.plans.head_queries import _KINEMATICS, _RATING, _RECURRENCE, _WINDOWS
from kinetiq.streaming import scans as L

_TURN = 6.283185307179586


def quality_frames(spark, d):
    """A subject's events as frames: two features, an angle, a head in metres and a face in pixels."""
    s, x, k = V.signal(spark, d), F.col("x"), F.col("k").cast("double")
    turned = (x * 7 + k) / 10
    face = {"nx": F.when(F.col("k") % 5 != 0, x * 3), "ny": k * 2, "lx": x - 5, "ly": k - 3, "rx": x + k / 20, "ry": 40 - x, "width": k + 1}
    return s.select(
        *KEY, *ORDER, F.array(x, k).alias("f"), F.when(F.col("k") % 3 != 0, x).alias("angle"), (x / 30).alias("hx"), (k / 60).alias("hy"),
        (turned - _TURN * F.floor((x * 7 + k) / (10 * _TURN)) - 3.14159).alias("ear"), *(c.alias(n) for n, c in face.items()),
    )


FACE = ["nx", "ny", "lx", "ly", "rx", "ry", "width"]


def quality(frames, **more):
    return L.live_quality(frames, KEY, ORDER, "f", "angle", ("hx", "hy", "ear"), FACE, **more)


_RATINGS = _RATING.replace(", h AS (", ", hr AS (").replace("q(subject_id, frame, nx", "qr(subject_id, frame, nx").replace("FROM h WHERE", "FROM hr WHERE").replace("q.", "qr.").replace("FROM q JOIN h ON h.", "FROM qr JOIN hr ON hr.")
_RATINGS = _RATINGS.replace(" h.", " hr.").replace("(h.", "(hr.").replace("SELECT subject_id, frame, round(greatest(0, least(100, peak)), 4) AS rating FROM q WHERE frame >= 0", "rated AS (SELECT subject_id, frame, greatest(0, least(100, peak)) AS rating FROM qr WHERE frame >= 0)")
_RATINGS = _RATINGS.replace("\nrated AS", ",\nrated AS")


@query(with_views(_KINEMATICS + _RATINGS + """, v AS (SELECT subject_id, frame, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (k - lag(k) OVER w) ** 2), 0) AS v FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
m AS (SELECT a.subject_id, a.frame, sum(CASE WHEN b.frame = 0 THEN 1 ELSE 0.05::DOUBLE END * pow(0.95::DOUBLE, a.frame - b.frame) * b.v) AS mean, max(b.v * pow(0.999::DOUBLE, a.frame - b.frame)) AS peak
  FROM v a JOIN v b ON a.subject_id = b.subject_id AND b.frame <= a.frame GROUP BY ALL),
o AS (SELECT subject_id, frame, abs(x - lag(x) OVER (PARTITION BY subject_id ORDER BY frame)) * 30 AS omega FROM signal WHERE k % 3 <> 0 AND x IS NOT NULL)
SELECT v.subject_id, v.frame, round(v, 4) AS velocity, round(mean, 4) AS velocity_mean, round(peak, 4) AS velocity_peak, round(omega, 3) AS omega, round(speed, 4) AS speed, round(accel_g, 4) AS accel_g, round(rating, 4) AS rating
FROM v JOIN m USING (subject_id, frame) JOIN kin USING (subject_id, frame) JOIN rated USING (subject_id, frame) LEFT JOIN o USING (subject_id, frame)""", "signal"))
def h2_live_quality(spark, d):
    q = quality(quality_frames(spark, d))
    some = ("velocity", "velocity_mean", "velocity_peak", "speed", "accel_g", "rating")
    return q.select(*KEY, *ORDER, *(r(c).alias(c) for c in some), r(F.when(~F.isnan("omega"), F.col("omega")), 3).alias("omega"))


def risk_frames(spark, d):
    """Events as frames with the risks they hold: none, one, or two of a joint."""
    one = lambda severity: F.struct(F.col("kind").alias("risk"), (F.col("k") % 2).alias("joint"), F.lit(severity).alias("severity"))
    risks = F.when(F.col("x") > 90, F.array(one("high"), one("medium"))).when(F.col("x") > 60, F.array(one("medium"))).otherwise(F.array().cast("array<struct<risk:string,joint:int,severity:string>>"))
    return V.signal(spark, d).select(*KEY, *ORDER, (F.col("t") / 17280).alias("t"), "velocity", risks.alias("risks"))


@query(with_views(""", e AS (SELECT subject_id, frame, t / 17280 AS t, kind, k % 2 AS joint, x > 90 AS high FROM signal WHERE x > 60),
k(subject_id, kind, joint, t) AS (SELECT subject_id, kind, joint, min(t) FROM e GROUP BY ALL
  UNION ALL SELECT k.subject_id, k.kind, k.joint, min(e.t) FROM k JOIN e ON e.subject_id = k.subject_id AND e.kind = k.kind AND e.joint = k.joint AND e.t > k.t + 5 GROUP BY k.subject_id, k.kind, k.joint, k.t),
s AS (SELECT s.subject_id, s.frame, count(*) OVER w AS frames, count(*) FILTER (WHERE coalesce(velocity, 0) >= 0.05) OVER w AS active, count(*) FILTER (WHERE coalesce(velocity, 0) >= 0.3) OVER w AS hard,
  count(k.t) OVER w AS events, count(*) FILTER (WHERE k.t IS NOT NULL AND e.high) OVER w AS high
  FROM signal s LEFT JOIN e USING (subject_id, frame) LEFT JOIN k ON k.subject_id = e.subject_id AND k.kind = e.kind AND k.joint = e.joint AND k.t = e.t WINDOW w AS (PARTITION BY s.subject_id ORDER BY s.frame)),
f AS (SELECT *, CASE WHEN active > 0 THEN least(1, hard / active * 0.6::DOUBLE + least(1, active / 30 / 600) * 0.4::DOUBLE) * greatest(0.3::DOUBLE, 1 - (frames - active) / frames * 0.5::DOUBLE) ELSE 0 END AS fatigue FROM s)
SELECT subject_id, frame, events, high, round(fatigue + 1e-9::DOUBLE, 4) AS fatigue,
  CASE WHEN events >= 6 THEN 'RED' WHEN events >= 3 OR high > 0 THEN 'YELLOW' WHEN fatigue >= 0.8 THEN 'RED' WHEN fatigue >= 0.6 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM f""", "signal"))
def h3_live_player_risk(spark, d):
    """The state after each frame; five seconds of this clock are a day of the table's."""
    out = L.live_player_risk(risk_frames(spark, d), KEY, ORDER, "t", "velocity", "risks")
    return out.select(*KEY, *ORDER, "events", "high", up(F.col("fatigue")).alias("fatigue"), "status")


def seen_frames(spark, d):
    """Boxes of a group's subjects by day, with a head in metres."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    ear = cx * 40 - _TURN * F.floor(cx * 40 / _TURN) - 3.14159
    return V.boxes(spark, d).select("seq_id", "frame", F.col("frame").cast("double").alias("t"), "subject_id", "x1", "y1", "x2", "y2", (cx * 4).alias("x"), (cy * 3).alias("y"), ear.alias("ear"))


@query(ORACLES["c2_closing_speed"])
def h4_live_proximity(spark, d):
    return L.live_proximity(seen_frames(spark, d), ["seq_id"]).select("seq_id", "frame", "a", "b", r("speed").alias("speed"), "rank", "warning")


_CLOSING = ORACLES["c2_closing_speed"]
_CLOSING = _CLOSING[_CLOSING.index(", c AS (") : _CLOSING.index("\nSELECT seq_id, frame, a, b, round")]
_SEEN = """, c0 AS (SELECT seq_id, frame AS day, subject_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY subject_id ORDER BY frame) - 1 AS frame FROM boxes),
h AS (SELECT subject_id, frame, cx * 4 AS hx, cy * 3 AS hy, cx * 40 - 6.283185307179586 * floor(cx * 40 / 6.283185307179586) - 3.14159 AS ear FROM c0)"""
_APPROACH = _WINDOWS[: _WINDOWS.index("\nSELECT seq_id, subject")].replace("frame", "day").replace("kin.day", "kd.day").replace("kin.subject_id", "kd.subject_id").replace("JOIN kin ON", "JOIN kd ON").replace("AS n\n", "AS n\n")
_APPROACH = _APPROACH.replace("FROM p WHERE", "FROM (SELECT seq_id, frame AS day, a, b, speed FROM k WHERE rank <= 5) WHERE").replace("f AS", "fa AS").replace("FROM f)", "FROM fa)").replace("m AS (", "ma AS (").replace("FROM m WHERE", "FROM ma WHERE")


@query(with_views(_CLOSING + _SEEN + _RECURRENCE + ", kd AS (SELECT c0.seq_id AS grp, c0.day, kin.* FROM kin JOIN c0 USING (subject_id, frame))" + _APPROACH + """,
sp AS (SELECT *, least(greatest(accel_g - 3, 0) / 12, 1) * 30 + least(greatest(degrees(turn_rad) - 30, 0) / 120, 1) * 25 + least(greatest(rotation - 12, 0) / 23, 1) * 20 AS raw FROM kd WHERE accel_g > 20 AND degrees(turn_rad) > 45),
sq AS (SELECT * FROM sp WHERE 100 / (1 + exp(-0.08::DOUBLE * (raw - 50))) > 10),
sk(subject_id, day) AS (SELECT subject_id, min(day) FROM sq GROUP BY 1 UNION ALL SELECT sk.subject_id, min(sq.day) FROM sk JOIN sq ON sq.subject_id = sk.subject_id AND sq.day >= sk.day + 30 GROUP BY sk.subject_id, sk.day)
SELECT seq_id, 'approach' AS kind, subject, other, start, stop AS "end", round(closing, 4) AS closing, round(g, 3) AS peak_g, round(deg, 2) AS turn_deg, n AS frames, round(100 / (1 + exp(-0.08::DOUBLE * (raw - 50))), 3) AS probability FROM z
UNION ALL
SELECT grp, 'spike', subject_id, subject_id, day, day, 0, round(accel_g, 3), round(degrees(turn_rad), 2), 1, round(100 / (1 + exp(-0.08::DOUBLE * (raw - 50))), 3) FROM sq JOIN sk USING (subject_id, day)""", "boxes"))
def h5_live_head_impacts(spark, d):
    out = L.live_head_impacts(seen_frames(spark, d), ["seq_id"])
    return out.select("seq_id", "kind", "subject", "other", "start", "end", r("closing").alias("closing"), r("peak_g", 3).alias("peak_g"), r("turn_deg", 2).alias("turn_deg"), "frames", r("probability", 3).alias("probability"))


def tracked(spark, d):
    """Vectors as detections: a label is a scene, four rows of it a frame; tracks change every seven frames, every twentieth frame is a cut."""
    f = V.feat(spark, d).withColumns({"n": F.expr("frame % 4"), "frame": F.expr("frame div 4")})
    box = lambda c, k: (F.get("f", 20 + k) + F.col("n") * 0.4 + (0.3 if c == "2" else 0.0))
    return f.select(
        F.col("subject_id").alias("seq_id"), "frame", (F.col("n") + 10 * F.expr("frame div 7")).alias("track_id"), F.slice("f", 1, 16).alias("emb"), F.transform(F.slice("f", 17, 10), lambda v: F.abs(v) + 1).alias("limbs"),
        F.lit(0.9).alias("confidence"), box("1", 0).alias("x1"), box("1", 1).alias("y1"), box("2", 0).alias("x2"), box("2", 1).alias("y2"), (F.expr("frame % 20") == 19).alias("cut"),
    )


@query()
def h6_live_identity(spark, d):
    return L.live_identity(tracked(spark, d), ["seq_id"]).withColumn("consistency", r("consistency"))
