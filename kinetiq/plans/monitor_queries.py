"""Queries of control charts, filters and event detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetiq.operators import joins as J
from kinetiq.operators import monitors as M
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORDER, query, r


@query(with_views("""SELECT subject_id, frame, round(abs(x - lag(x) OVER (PARTITION BY subject_id ORDER BY frame)) * 30, 3) AS omega FROM signal WHERE k % 3 <> 0 AND x IS NOT NULL""", "signal"))
def e4_angular_velocity(spark, d):
    s = V.signal(spark, d).withColumn("angle", F.when(F.col("k") % 3 != 0, F.col("x")))
    return M.angular_velocity(s, KEY, ORDER, "angle").select(*KEY, *ORDER, r("omega", 3).alias("omega"))


_FIRST_KEPT = """, k(subject_id, frame) AS (SELECT subject_id, min(frame) FROM c GROUP BY 1
  UNION ALL SELECT k.subject_id, min(c.frame) FROM k JOIN c ON c.subject_id = k.subject_id AND c.frame >= k.frame + {gap} GROUP BY k.subject_id, k.frame)"""


@query(with_views(""", c AS (SELECT subject_id, frame FROM signal WHERE x > 20 AND k > 45 AND velocity * 100 > 10)""" + _FIRST_KEPT.format(gap=30) + " SELECT subject_id, frame FROM k", "signal"))
def e9_standalone_spikes(spark, d):
    s = V.signal(spark, d).withColumn("p", F.col("velocity") * 100)
    return M.standalone_spikes(s, KEY, "frame", "x", "k", "p").select(*KEY, *ORDER)


@query(with_views(""", n AS (SELECT subject_id, frame, t, kind AS risk, k % 2 AS joint, CASE WHEN x > 70 THEN 'high' WHEN x > 30 THEN 'medium' ELSE 'low' END AS severity, x AS value, row_number() OVER (PARTITION BY subject_id ORDER BY t) AS n FROM signal),
a AS (SELECT *, coalesce(n - lag(n) OVER w > 1, true)::INT AS b FROM n WHERE severity <> 'low' WINDOW w AS (PARTITION BY subject_id, risk, joint ORDER BY n)),
i AS (SELECT *, sum(b) OVER (PARTITION BY subject_id, risk, joint ORDER BY n) AS i FROM a),
m AS (SELECT subject_id, risk, joint, i, min(t) AS s, max(t) AS e, max(value) AS peak, max(severity = 'high') AS high, max(t) - min(t) AS duration FROM i GROUP BY ALL)
SELECT subject_id, risk, joint, round(s, 2) AS start, round(duration, 2) AS duration, round(peak, 4) AS peak, CASE WHEN high THEN 'high' ELSE 'medium' END AS severity,
  row_number() OVER (PARTITION BY subject_id ORDER BY high DESC, duration DESC, s, risk, joint) AS rank FROM m WHERE duration >= 0.3""", "signal"))
def e15_risk_moments(spark, d):
    s = V.signal(spark, d)
    level = F.when(F.col("x") > 70, "high").when(F.col("x") > 30, "medium").otherwise("low")
    risks = s.select(*KEY, "t", F.col("kind").alias("risk"), (F.col("k") % 2).alias("joint"), level.alias("severity"), F.col("x").alias("value"), F.lit(30.0).alias("threshold"))
    out = M.risk_moments(s.select(*KEY, "t"), risks, KEY, "t")
    return out.select(*KEY, "risk", "joint", r("start", 2).alias("start"), r("duration", 2).alias("duration"), r("peak").alias("peak"), "severity", "rank")


@query()
def e17_label_runs(spark, d):
    s = V.signal(spark, d)
    out = M.label_runs(s, KEY, "frame", "kind", "x", 0.5, 1.0)
    return out.select(*KEY, "kind", r("start").alias("start"), r("end").alias("end"), r("confidence").alias("confidence"))


@query(with_views(""", b AS (SELECT *, (row_number() OVER w = 1 OR lag(kind) OVER w <> kind)::INT AS b FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
i AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY frame) AS i FROM b),
n AS (SELECT *, count(*) OVER (PARTITION BY subject_id, i) AS n FROM i)
SELECT subject_id, frame, last_value(CASE WHEN n >= 2 OR i = 1 THEN kind END IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY frame) AS smoothed FROM n""", "signal"))
def e18_temporal_smooth_labels(spark, d):
    return M.temporal_smooth_labels(V.signal(spark, d), KEY, ORDER, "kind", 2).select(*KEY, *ORDER, "smoothed")


def _lags(col: str, weights: tuple, shift: int) -> str:
    """A weighted sum of the rows from ``shift`` before on."""
    at = lambda o: f"lead({col}, {o}) OVER w" if o > 0 else f"lag({col}, {-o}) OVER w"
    return "(" + " + ".join(f"{w} * {at(k - shift)}" for k, w in enumerate(weights)) + ") / 35.0::DOUBLE"


# The classic coefficients of the quadratic over five points, for each place in the window.
_SG5 = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3), (-5, 6, 12, 13, 9), (3, -5, -3, 9, 31))


@query(with_views(f""", n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY subject_id) AS n FROM signal)
SELECT subject_id, frame, round(CASE WHEN n < 5 THEN x WHEN i = 0 THEN {_lags('x', _SG5[0], 0)} WHEN i = 1 THEN {_lags('x', _SG5[1], 1)} WHEN i = n - 2 THEN {_lags('x', _SG5[3], 3)}
  WHEN i = n - 1 THEN {_lags('x', _SG5[4], 4)} ELSE {_lags('x', _SG5[2], 2)} END, 4) AS smooth FROM n WINDOW w AS (PARTITION BY subject_id ORDER BY frame)""", "signal"))
def e23_savgol(spark, d):
    return M.savgol(V.signal(spark, d), KEY, ORDER, "x").select(*KEY, *ORDER, r("smooth").alias("smooth"))


def _smooth(h: str, c: str, row: int) -> str:
    terms = " + ".join(f"{w} * {h}[{k + 1}].{c}" for k, w in enumerate(_SG5[row]))
    return f"CASE WHEN len(a) >= 5 AND len(b) >= 5 THEN ({terms}) / 35.0::DOUBLE ELSE {h}[len({h}) - {4 - row}].{c} END"


@query(with_views(f""", h AS (SELECT seq_id, frame, subject_id, list({{'x': 50 * (x1 + x2), 'y': 50 * (y1 + y2)}}) OVER (PARTITION BY seq_id, subject_id ORDER BY frame ROWS 4 PRECEDING) AS h FROM boxes),
p AS (SELECT a.seq_id, a.frame, a.subject_id AS sa, b.subject_id AS sb, a.h AS a, b.h AS b FROM h a JOIN h b ON a.seq_id = b.seq_id AND a.frame = b.frame AND a.subject_id < b.subject_id),
q AS (SELECT *, {_smooth('a', 'x', 4)} AS ax, {_smooth('a', 'y', 4)} AS ay, {_smooth('b', 'x', 4)} AS bx, {_smooth('b', 'y', 4)} AS bby, {_smooth('a', 'x', 2)} AS a3x, {_smooth('a', 'y', 2)} AS a3y, {_smooth('b', 'x', 2)} AS b3x, {_smooth('b', 'y', 2)} AS b3y,
  ((a[len(a)].x - a[len(a) - 2].x) - (b[len(b)].x - b[len(b) - 2].x)) * 15 AS rx, ((a[len(a)].y - a[len(a) - 2].y) - (b[len(b)].y - b[len(b) - 2].y)) * 15 AS ry,
  b[len(b)].x - a[len(a)].x AS lx, b[len(b)].y - a[len(a)].y AS ly FROM p),
v AS (SELECT *, ((ax - a3x) - (bx - b3x)) * 15 AS vx, ((ay - a3y) - (bby - b3y)) * 15 AS vy, sqrt((bx - ax) ** 2 + (bby - ay) ** 2) AS l FROM q)
SELECT seq_id, frame, sa AS a, sb AS b, round(CASE WHEN len(v.a) >= 3 AND len(v.b) >= 3 THEN least(10, greatest(0, CASE WHEN l < 1e-6 THEN sqrt(vx * vx + vy * vy) ELSE (vx * (bx - ax) + vy * (bby - ay)) / l END * 0.004::DOUBLE)) ELSE 0 END, 4) AS speed,
  round(CASE WHEN len(v.a) >= 3 AND len(v.b) >= 3 AND sqrt(rx * rx + ry * ry) >= 1e-6 AND sqrt(lx * lx + ly * ly) >= 1e-6 THEN acos(greatest(-1, least(1, (rx * lx + ry * ly) / (sqrt(rx * rx + ry * ry) * sqrt(lx * lx + ly * ly))))) ELSE 0 END, 3) AS angle FROM v""", "boxes"))
def e24_closing_velocity(spark, d):
    head = F.struct((50 * (F.col("x1") + F.col("x2"))).alias("x"), (50 * (F.col("y1") + F.col("y2"))).alias("y"))
    b = V.boxes(spark, d).select("seq_id", "frame", "subject_id", head.alias("head"))
    h = M.head_history(b, ["seq_id", "subject_id"], ["frame"], "head").drop("head")
    p = J.pairs_in_frame(h, ["seq_id", "frame"], "subject_id")
    a, b = F.col("a_history"), F.col("b_history")
    return p.select(
        "seq_id", "frame", F.col("a_subject_id").alias("a"), F.col("b_subject_id").alias("b"),
        r(M.closing_velocity(a, b, F.lit(0.004), 30.0)).alias("speed"), r(M.approach_angle(a, b, 30.0), 3).alias("angle"),
    )


@query(with_views(""", h AS (SELECT subject_id, frame, k % 3 AS joint, list(x) OVER (PARTITION BY subject_id, k % 3 ORDER BY frame ROWS 19 PRECEDING) AS h FROM signal),
m AS (SELECT *, list_avg(h[1:5]) AS early, list_avg(h[-5:]) AS recent FROM h WHERE len(h) >= 10)
SELECT subject_id, frame, joint, round(early, 4) AS early, round(recent, 4) AS recent FROM m WHERE early > 0.1 AND (early - recent) / early > 0.1""", "signal"))
def e25_degrading_joints(spark, d):
    s = V.signal(spark, d).withColumn("joint", F.col("k") % 3)
    out = M.degrading_joints(s, KEY, ORDER, "joint", "x", rows=20, least=10, part=5)
    return out.select(*KEY, *ORDER, "joint", r("early").alias("early"), r("recent").alias("recent"))


@query(with_views(""", d AS (SELECT subject_id, frame AS rep, unnest(range(28)) AS dim, abs(unnest(f)) AS dev FROM feat),
b AS (SELECT subject_id, dim, avg(dev) AS m, greatest(stddev_pop(dev), 1e-6) AS s FROM d WHERE rep < 3 GROUP BY ALL),
e AS (SELECT a.subject_id, a.dim, a.rep, any_value(m) AS m, any_value(s) AS s, pow(0.8::DOUBLE, a.rep) * any_value(m) + coalesce(sum(0.2::DOUBLE * pow(0.8::DOUBLE, a.rep - p.rep) * p.dev), 0) AS e
  FROM d a JOIN b USING (subject_id, dim) LEFT JOIN d p ON p.subject_id = a.subject_id AND p.dim = a.dim AND p.rep BETWEEN 1 AND a.rep GROUP BY a.subject_id, a.dim, a.rep)
SELECT subject_id, dim // 2 AS joint, min(rep) AS rep FROM e WHERE rep >= 3 AND e > m + 2.7::DOUBLE * s * sqrt(1 / 9.0::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (rep + 1)))) GROUP BY ALL""", "feat"))
def e26_ewma_alarms(spark, d):
    f = V.feat(spark, d).select("subject_id", F.col("frame").alias("rep"), F.posexplode("f").alias("dim", "v"))
    reps = f.select("subject_id", "rep", "dim", F.expr("dim div 2").alias("joint"), F.abs("v").alias("dev"))
    return M.ewma_alarms(reps, KEY, "rep", "joint", "dim", "dev", 3)


@query(with_views(""", b AS (SELECT subject_id, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS s FROM signal WHERE frame < 5 GROUP BY 1),
c(subject_id, frame, c) AS (SELECT subject_id, 0::BIGINT, 0::DOUBLE FROM b UNION ALL
  SELECT c.subject_id, s.frame, greatest(0, c.c + s.x - b.m - 0.25::DOUBLE * b.s) FROM c JOIN signal s ON s.subject_id = c.subject_id AND s.frame = c.frame + 1 JOIN b ON b.subject_id = c.subject_id)
SELECT c.subject_id, c.frame, round(c, 3) AS cusum, min(CASE WHEN c > 4 * s THEN c.frame END) OVER (PARTITION BY c.subject_id) AS onset FROM c JOIN b USING (subject_id)""", "signal"))
def e27_cusum(spark, d):
    return M.cusum(V.signal(spark, d), KEY, "frame", "x", 5).select(*KEY, *ORDER, r("cusum", 3).alias("cusum"), "onset")


@query(with_views(""", v AS (SELECT subject_id, frame, 0.1::DOUBLE + 0.5::DOUBLE * (frame % 17) AS v FROM signal),
l AS (SELECT *, lag(v) OVER (PARTITION BY subject_id ORDER BY frame) AS b FROM v), c AS (SELECT subject_id, frame FROM l WHERE v < b - 1)""" + _FIRST_KEPT.format(gap=31) + " SELECT subject_id, frame FROM k", "signal"))
def e28_loop_boundary(spark, d):
    s = V.signal(spark, d).withColumn("v", 0.1 + 0.5 * (F.col("frame") % 17))
    return M.loop_boundaries(s, KEY, "frame", "v").select(*KEY, *ORDER)


@query(with_views(""", c AS (SELECT subject_id, frame FROM signal WHERE x >= 60 OR frame = 0)""" + _FIRST_KEPT.format(gap=15) + " SELECT subject_id, frame FROM k WHERE frame > 0", "signal"))
def e29_cut_detect(spark, d):
    return M.cut_detect(V.signal(spark, d), KEY, "frame", "x", 60.0).select(*KEY, *ORDER)


@query()
def e30_bone_length_filter(spark, d):
    p = V.pose14(spark, d).select("label", "vec_id", F.transform("joints", lambda j: F.array(j["x"], j["y"])).alias("joints"))
    out = M.bone_length_filter(p, ["label"], ["vec_id"], "joints")
    rows = out.select("label", "vec_id", F.posexplode("steady").alias("joint", "q"))
    return rows.select("label", "vec_id", "joint", r(F.get("q", 0)).alias("x"), r(F.get("q", 1)).alias("y"))


@query(with_views(""", v AS (SELECT subject_id, frame, x, (4 * x - 4 * lag(x) OVER (PARTITION BY subject_id ORDER BY frame)) / 100 * 30 AS v FROM signal),
m AS (SELECT *, max(v) OVER w AS speed, count(v) OVER w AS n FROM v WINDOW w AS (PARTITION BY subject_id ORDER BY frame ROWS 9 PRECEDING)),
c AS (SELECT * FROM m WHERE n >= 3 AND speed > 1.5 AND v < 0.3::DOUBLE * speed AND 4 * x / 80 >= 0.85)""" + _FIRST_KEPT.format(gap=15) + """
SELECT subject_id, frame, round(speed, 4) AS speed, round(speed / 0.006::DOUBLE * (pi() / 2) / 9.81::DOUBLE, 3) AS peak_g FROM k JOIN c USING (subject_id, frame)""", "signal"))
def e32_ground_impacts(spark, d):
    s = V.signal(spark, d).withColumns({"y": 4 * F.col("x"), "low": F.lit(80.0), "ppm": F.lit(100.0)})
    out = M.ground_impacts(s, KEY, "frame", "y", "low", "ppm")
    return out.select(*KEY, *ORDER, r("speed").alias("speed"), r("impact.peak_g", 3).alias("peak_g"))


@query(with_views(""", v AS (SELECT subject_id, frame, greatest(t - lag(t) OVER w, 1e-6) AS dt, sqrt((x - lag(x) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS a FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
s AS (SELECT *, coalesce(a / 0.001::DOUBLE / dt, 0) AS speed FROM v),
g AS (SELECT *, coalesce(abs(speed - lag(speed) OVER w) / dt / 9.81::DOUBLE, 0) AS g FROM s WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
p AS (SELECT *, max(g) OVER (PARTITION BY subject_id ORDER BY frame) AS p FROM g)
SELECT subject_id, frame, round(speed, 3) AS speed, round(g, 3) AS accel_g, round(p, 3) AS peak_g, CASE WHEN p < 40 THEN 'LOW' WHEN p < 75 THEN 'MODERATE' ELSE 'HIGH' END AS level FROM p""", "signal"))
def e33_individual_g(spark, d):
    s = V.signal(spark, d).withColumn("ppm", F.lit(0.001))
    out = M.individual_g(s, KEY, ORDER, "t", "x", "k", "ppm")
    return out.select(*KEY, *ORDER, *(r(c, 3).alias(c) for c in ("speed", "accel_g", "peak_g")), "level")
