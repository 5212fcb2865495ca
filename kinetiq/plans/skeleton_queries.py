"""Queries of the per-frame skeleton functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetiq.functions import physics as P
from kinetiq.functions import skeleton as K
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import query, r


def _long(df, points, *parts):
    rows = df.select("vec_id", F.posexplode(points).alias("joint", "q"))
    return rows.select("vec_id", "joint", *(r(F.col("q")[c]).alias(c) for c in parts))


_COCO = "{0: 0, 7: 3, 8: 4, 11: 5, 12: 6, 13: 7, 14: 8, 15: 9, 16: 10, 23: 11, 24: 12, 25: 13, 26: 14, 27: 15, 28: 16, 31: 15, 32: 16}"


@query(with_views(f""", m AS (SELECT MAP {_COCO} AS m)
SELECT vec_id, joint::INT AS joint, round(coalesce(p[m[joint] + 1].x, 0), 4) AS x, round(coalesce(p[m[joint] + 1].y, 0), 4) AS y, 0.0::DOUBLE AS z, round(coalesce(p[m[joint] + 1].c, 0), 4) AS v
FROM coco17, m, range(33) t(joint)""", "coco17"))
def b1_remap_coco17_to_mp33(spark, d):
    return _long(V.coco17(spark, d), K.coco17_to_33(F.col("p")), "x", "y", "z", "v")


@query(with_views(""", s(k, m, o) AS (VALUES (0, 0, 0), (5, 11, 0), (6, 12, 0), (7, 13, 0), (8, 14, 0), (9, 15, 0), (10, 16, 0), (11, 23, 0), (12, 24, 0), (13, 25, 0), (14, 26, 0), (15, 27, 0), (16, 28, 0),
  (17, 31, 0), (18, 31, 1), (19, 29, 0), (20, 32, 0), (21, 32, 1), (22, 30, 0), (23, 7, 0), (39, 8, 0), (84, 9, 0), (78, 10, 0), (1, 2, 2), (2, 5, 2), (3, 7, 2), (4, 8, 2)),
b AS (SELECT vec_id, m, arg_max(p[k + 1], p[k + 1].c) AS q FROM (SELECT * FROM whole133, s ORDER BY vec_id, m, o) WHERE p[k + 1].c > 0 GROUP BY ALL)
SELECT w.vec_id, joint::INT AS joint, round(coalesce(q.x, 0), 4) AS x, round(coalesce(q.y, 0), 4) AS y, round(coalesce(q.z, 0), 4) AS z, round(coalesce(q.c, 0), 4) AS v
FROM (SELECT vec_id, unnest(range(33)) AS joint FROM whole133) w LEFT JOIN b ON b.vec_id = w.vec_id AND b.m = joint""", "whole133"))
def b2_remap_wholebody_to_mp33(spark, d):
    return _long(V.whole133(spark, d), K.whole133_to_33(F.col("p")), "x", "y", "z", "v")


@query(with_views("""SELECT vec_id, (i - 1)::INT AS joint, round(p[a[i] + 1].x, 4) AS x, round(p[a[i] + 1].y, 4) AS y, round(p[a[i] + 1].v, 4) AS c
FROM marks33, (SELECT [0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28] AS a), range(1, 18) t(i)""", "marks33"))
def b3_remap_mp33_to_coco17(spark, d):
    return _long(V.marks33(spark, d), K.marks33_to_coco17(F.col("p")), "x", "y", "c")


_FRAME3 = """, a AS (SELECT vec_id, p, p[24] AS l, p[25] AS h, p[12] AS s, p[13] AS t FROM marks33),
b AS (SELECT *, (l.x + h.x) / 2 AS px, (l.y + h.y) / 2 AS py, (l.z + h.z) / 2 AS pz, greatest(sqrt((l.x - h.x) ** 2 + (l.y - h.y) ** 2 + (l.z - h.z) ** 2), 1e-4) AS w FROM a),
c AS (SELECT *, (l.x - h.x) / w AS xx, (l.y - h.y) / w AS xy, (l.z - h.z) / w AS xz, (s.x + t.x) / 2 - px AS tx, (s.y + t.y) / 2 - py AS ty, (s.z + t.z) / 2 - pz AS tz FROM b),
e AS (SELECT *, tx - (tx * xx + ty * xy + tz * xz) * xx AS ox, ty - (tx * xx + ty * xy + tz * xz) * xy AS oy, tz - (tx * xx + ty * xy + tz * xz) * xz AS oz FROM c),
f AS (SELECT *, sqrt(ox * ox + oy * oy + oz * oz) AS n FROM e),
g AS (SELECT *, CASE WHEN n < 1e-6 THEN 0 ELSE ox / n END AS yx, CASE WHEN n < 1e-6 THEN 1 ELSE oy / n END AS yy, CASE WHEN n < 1e-6 THEN 0 ELSE oz / n END AS yz FROM f),
k AS (SELECT *, xy * yz - xz * yy AS zx, xz * yx - xx * yz AS zy, xx * yy - xy * yx AS zz FROM g),
o AS (SELECT vec_id, joint, ((q.x - px) * xx + (q.y - py) * xy + (q.z - pz) * xz) / w AS x, ((q.x - px) * yx + (q.y - py) * yy + (q.z - pz) * yz) / w AS y,
  ((q.x - px) * zx + (q.y - py) * zy + (q.z - pz) * zz) / w AS z FROM (SELECT *, unnest(p) AS q, unnest(range(33)) AS joint FROM k))"""


@query(with_views(_FRAME3 + " SELECT vec_id, joint::INT AS joint, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM o", "marks33"))
def b6_srp_normalize_3d(spark, d):
    return _long(V.marks33(spark, d), K.srp_3d(F.col("p"), (23, 24), (11, 12)), "x", "y", "z")


_VISUAL = """, a AS (SELECT vec_id, p, p[24] AS l, p[25] AS h, sqrt((p[24].x - p[25].x) ** 2 + (p[24].y - p[25].y) ** 2) AS w FROM marks33),
n AS (SELECT vec_id, [{'x': (j.x - (l.x + h.x) / 2) / w, 'y': (j.y - (l.y + h.y) / 2) / w} FOR j IN p] AS q FROM a
  WHERE w >= 1e-4 AND l.v >= 0.3 AND h.v >= 0.3 AND p[12].v >= 0.3 AND p[13].v >= 0.3)"""


@query(with_views(_VISUAL + " SELECT vec_id, (i - 1)::INT AS joint, round(q[i].x, 4) AS x, round(q[i].y, 4) AS y FROM n, range(1, 34) t(i)", "marks33"))
def b7_normalize_visual(spark, d):
    return _long(V.marks33(spark, d), K.normalize_visual(F.col("p")), "x", "y")


def _limb(a: int, b: int, length: float) -> str:
    d = f"((q[{b + 1}].x - q[{a + 1}].x) ** 2 + (q[{b + 1}].y - q[{a + 1}].y) ** 2)"
    return f"CASE WHEN {d} < {length * length}::DOUBLE THEN sqrt({length * length}::DOUBLE - {d}) / 2 ELSE 0 END"


@query(with_views(_VISUAL + f""", z AS (SELECT vec_id, q, -({_limb(11, 13, 1.2)}) AS z13, -({_limb(12, 14, 1.2)}) AS z14, -({_limb(23, 25, 1.6)}) AS z25, -({_limb(24, 26, 1.6)}) AS z26 FROM n),
y AS (SELECT *, z13 - ({_limb(13, 15, 1.05)}) AS z15, z14 - ({_limb(14, 16, 1.05)}) AS z16, z25 - ({_limb(25, 27, 1.5)}) AS z27, z26 - ({_limb(26, 28, 1.5)}) AS z28 FROM z),
w AS (SELECT vec_id, MAP {{13: z13, 14: z14, 15: z15, 16: z16, 25: z25, 26: z26, 27: z27, 28: z28}} AS m FROM y)
SELECT vec_id, joint::INT AS joint, round(coalesce(m[joint], 0), 4) AS z FROM w, range(33) t(joint)""", "marks33"))
def b8_estimate_depth(spark, d):
    return _long(V.marks33(spark, d).withColumn("q", K.normalize_visual(F.col("p"))).select("vec_id", "q"), K.estimate_depth(F.col("q")), "z")


@query(with_views("SELECT vec_id, list_bool_and([abs(p[i].z) >= 0.05 FOR i IN [24, 25, 12, 13]]) AS real FROM (SELECT vec_id, [{'z': CASE WHEN abs(j.z) < 0.05 THEN 0 ELSE j.z END} FOR j IN p] AS p FROM marks33)", "marks33"))
def b9_has_real_depth(spark, d):
    """Depths under 0.05 are taken as none, so that the tables hold both cases."""
    flat = F.transform("p", lambda j: j.withField("z", F.when(F.abs(j["z"]) < 0.05, 0.0).otherwise(j["z"])))
    return V.marks33(spark, d).select("vec_id", K.has_real_depth(flat).alias("real"))


_FEATURES = (4, 5, 6, 8, 9, 10, 12, 13, 14, 15, 16, 17, 18, 19)


@query(with_views(f""", f AS (SELECT vec_id, label, flatten([[p[i + 1].x, p[i + 1].y, CASE WHEN vec_id % 7 = 0 THEN 'nan'::DOUBLE ELSE p[i + 1].z END] FOR i IN {list(_FEATURES)}]) AS f FROM marks33),
n AS (SELECT vec_id, label, f, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS valid_index FROM f WHERE vec_id % 7 <> 0)
SELECT vec_id, label, valid_index, (i - 1)::INT AS dim, round(f[i], 4) AS v FROM n, range(1, 43) t(i)""", "marks33"))
def b10_feature_vector(spark, d):
    """42 numbers a frame; every seventh has a depth that is no number and leaves the trajectory."""
    odd = F.transform("p", lambda j: j.withField("z", F.when(F.col("vec_id") % 7 == 0, float("nan")).otherwise(j["z"])))
    frames = V.marks33(spark, d).select("vec_id", "label", K.feature_vector(odd, _FEATURES).alias("f"))
    t = K.trajectory(frames, ["label"], ["vec_id"], "f")
    return t.select("vec_id", "label", "valid_index", F.posexplode("f").alias("dim", "v")).withColumn("v", r("v"))


_MASSES = "[(1, 3, 0.028), (2, 4, 0.028), (3, 5, 0.016), (4, 6, 0.016), (7, 9, 0.1), (8, 10, 0.1), (9, 11, 0.0465), (10, 12, 0.0465), (11, 13, 0.0145), (12, 14, 0.0145)]"


def _mass(c: str) -> str:
    trunk = f"0.497::DOUBLE * ((j[7].{c} + j[8].{c}) / 2 + 0.43::DOUBLE * ((j[1].{c} + j[2].{c}) / 2 - (j[7].{c} + j[8].{c}) / 2))"
    limbs = f"list_sum([t[3]::DOUBLE * (j[t[1]::INT].{c} + 0.43::DOUBLE * (j[t[2]::INT].{c} - j[t[1]::INT].{c})) FOR t IN {_MASSES.replace('(', '[').replace(')', ']')}])"
    return f"({trunk} + {limbs}) / 0.907::DOUBLE"


@query(with_views(f""", c AS (SELECT vec_id, j, {_mass('x')} AS x, {_mass('y')} AS y FROM (SELECT vec_id, joints AS j FROM pose14))
SELECT vec_id, round(x, 4) AS x, round(y, 4) AS y, round(sqrt((x - (j[11].x + j[12].x) / 2) ** 2 + (y - (j[11].y + j[12].y) / 2) ** 2), 4) AS sway FROM c""", "pose14"))
def b15_center_of_mass(spark, d):
    p = V.pose14(spark, d).withColumn("c", K.center_of_mass(F.col("joints")))
    return p.select("vec_id", r("c.x").alias("x"), r("c.y").alias("y"), r(K.com_sway(F.col("c"), F.col("joints"))).alias("sway"))


@query(with_views(""", s AS (SELECT vec_id, [p[i] FOR i IN [1, 2, 3, 4, 5] IF p[i].c >= 0.3] AS h, [p[i] FOR i IN [6, 7] IF p[i].c >= 0.15] AS n FROM coco17)
SELECT vec_id, round(list_avg([q.x FOR q IN h]), 4) AS hx, round(list_avg([q.y FOR q IN h]), 4) AS hy, round(list_avg([q.x FOR q IN n]), 4) AS nx, round(list_avg([q.y FOR q IN n]), 4) AS ny FROM s""", "coco17"))
def b17_head_center(spark, d):
    p = V.coco17(spark, d).select("vec_id", K.head_center(F.col("p")).alias("h"), K.neck_point(F.col("p")).alias("n"))
    return p.select("vec_id", r("h.x").alias("hx"), r("h.y").alias("hy"), r("n.x").alias("nx"), r("n.y").alias("ny"))


@query(with_views(""", s AS (SELECT vec_id, p, [p[i] FOR i IN [6, 7] IF p[i].c >= 0.3] AS t, [p[i] FOR i IN [12, 13] IF p[i].c >= 0.3] AS b, [p[i] FOR i IN [16, 17] IF p[i].c >= 0.3] AS k FROM coco17),
a AS (SELECT *, CASE WHEN len(t) = 2 THEN sqrt((p[6].x - p[7].x) ** 2 + (p[6].y - p[7].y) ** 2) END AS sh,
  sqrt((list_avg([q.x FOR q IN t]) - list_avg([q.x FOR q IN b])) ** 2 + (list_avg([q.y FOR q IN t]) - list_avg([q.y FOR q IN b])) ** 2) AS tr,
  list_max([q.y FOR q IN k]) AS low FROM s),
h AS (SELECT *, CASE WHEN sh > 1 THEN 0.45::DOUBLE / sh WHEN tr > 1 THEN 0.5::DOUBLE / tr ELSE 0.004::DOUBLE END AS m,
  CASE WHEN p[1].c >= 0.3 THEN sqrt((p[1].x - [q FOR q IN k IF q.y = low][1].x) ** 2 + (p[1].y - low) ** 2) END AS px FROM a),
o AS (SELECT *, coalesce(px > 1 AND (px * m < 1.5 OR px * m > 2.1), false) AS odd FROM h)
SELECT vec_id, round(CASE WHEN odd THEN 1.75::DOUBLE / px ELSE m END, 6) AS scale,
  CASE WHEN odd THEN 'low' WHEN sh > 1 THEN CASE WHEN px > 1 THEN 'high' ELSE 'medium' END WHEN tr > 1 THEN 'medium' ELSE 'low' END AS confidence FROM o""", "coco17"))
def b18_meters_per_pixel(spark, d):
    p = V.coco17(spark, d).select("vec_id", K.meters_per_pixel(F.col("p")).alias("m"))
    return p.select("vec_id", r("m.scale", 6).alias("scale"), "m.confidence")


@query(with_views("""SELECT vec_id, CASE WHEN p[1].c >= 0.35 AND least(l, h) >= 0.15 THEN 'FRONT' WHEN p[1].c <= 0.12 AND l + h <= 0.45 THEN 'REAR' WHEN abs(l - h) >= 0.25 THEN 'SIDE' ELSE 'UNKNOWN' END AS location
FROM (SELECT vec_id, p, greatest(p[2].c, p[4].c) AS l, greatest(p[3].c, p[5].c) AS h FROM coco17)""", "coco17"))
def b26_impact_location(spark, d):
    c = lambda i: F.get("p", i)["c"]
    return V.coco17(spark, d).select("vec_id", K.impact_location(c(0), c(1), c(2), c(3), c(4)).alias("location"))


@query(with_views("""SELECT vec_id, joint, round(p[joint + 1].x / 640, 4) AS x, round(p[joint + 1].y / 480, 4) AS y, round(p[joint + 1].v, 4) AS v
FROM (SELECT vec_id, [{'x': 640 * j.x, 'y': 480 * j.y, 'v': j.v} FOR j IN p] AS p FROM marks33), unnest([0, 1, 2, 3, 4, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28, 31, 32]) t(joint)""", "marks33"))
def b27_project_sparse(spark, d):
    pixels = F.transform("p", lambda j: j.withField("x", 640 * j["x"]).withField("y", 480 * j["y"]))
    m = V.marks33(spark, d).select("vec_id", K.project_sparse(pixels, F.lit(640.0), F.lit(480.0)).alias("m"))
    return m.select("vec_id", F.explode("m").alias("joint", "q")).select("vec_id", "joint", *(F.col("q")[c].alias(c) for c in "xyv"))


@query(with_views("""SELECT CASE kind WHEN 'click' THEN 'run' WHEN 'view' THEN 'walk' ELSE kind END AS kind, count(*) AS n, count(*) FILTER (WHERE kind IN ('click', 'view')) AS updated FROM signal GROUP BY 1""", "signal"))
def b29_relabel(spark, d):
    s = K.relabel(V.signal(spark, d), "kind", {"click": "run", "view": "walk"})
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("relabelled").cast("long")).alias("updated"))


_ANSWER = """CASE o_orderkey % 8 WHEN 0 THEN '{"number": 23, "color": "Red "}' WHEN 1 THEN '```json
{"number": "7", "color": "dark blue"}
```' WHEN 2 THEN '{"number": null, "color": "none"}' WHEN 3 THEN 'no answer' WHEN 4 THEN '{"number": "x", "color": ""}' WHEN 5 THEN '[1, 2]' WHEN 6 THEN '{"number": 4.9}' ELSE '{"number": "4.9", "color": "NULL"}' END"""


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 23 WHEN 1 THEN 7 WHEN 6 THEN 4 END::INT AS number, CASE o_orderkey % 8 WHEN 0 THEN 'red' WHEN 1 THEN 'dark blue' END AS color,
o_orderkey % 8 NOT IN (3, 5) AS parsed FROM orders""")
def b30_parse_jersey(spark, d):
    """Answers of every shape, dealt out to orders."""
    o = V.table(spark, d, "orders").select("o_orderkey", K.parse_jersey(F.expr(_ANSWER)).alias("j"))
    return o.select("o_orderkey", "j.number", "j.color", F.col("j").isNotNull().alias("parsed"))


def _mixture(c: str) -> str:
    rows = []
    for row in K.lowpass_matrix():
        rows.append(" + ".join(f"j[{k + 1}].{c} * ({float(w)!r})::DOUBLE" for k, w in enumerate(row) if abs(w) > 1e-12) or "0::DOUBLE")
    return f"[{', '.join(rows)}]"


@query(with_views(f""", m AS (SELECT vec_id, {_mixture('x')} AS x, {_mixture('y')} AS y FROM (SELECT vec_id, joints AS j FROM pose14))
SELECT vec_id, (i - 1)::INT AS joint, round(x[i], 4) AS x, round(y[i], 4) AS y FROM m, range(1, 15) t(i)""", "pose14"))
def b34_graph_lowpass(spark, d):
    return _long(V.pose14(spark, d), K.graph_lowpass(F.col("joints"), K.lowpass_matrix()), "x", "y")


@query("""WITH t AS (SELECT conv_id, turn, role, conv_id % 4 AS k, len(text) AS n FROM conversations)
SELECT conv_id, turn, k < 2 AS kept, k = 1 AS complete, CASE WHEN k < 2 THEN n END AS n FROM t""")
def b35_extract_json_profile(spark, d):
    """Turns that end in a fenced profile: whole, without the flag, without injuries, or broken."""
    t = V.table(spark, d, "conversations").withColumn("n", F.length("text"))
    block = F.expr("""CASE conv_id % 4 WHEN 0 THEN concat('{"injuries": [], "n": ', n, '}') WHEN 1 THEN concat('{"injuries": [{"type": "acl"}], "n": ', n, ', "complete": true}')
        WHEN 2 THEN '{"goals": []}' ELSE '{"injuries": [' END""")
    turn = F.concat(F.col("text"), F.lit("\n```json\n"), block, F.lit("\n```"))
    e = t.select("conv_id", "turn", K.extract_json_profile(turn).alias("e"))
    n = F.get_json_object("e.profile", "$.n").cast("int")
    return e.select("conv_id", "turn", F.col("e").isNotNull().alias("kept"), F.coalesce("e.complete", F.lit(False)).alias("complete"), n.alias("n"))


@query(with_views("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p < 0.05 THEN 'LOW' WHEN p < 0.15 THEN 'MODERATE' WHEN p < 0.5 THEN 'HIGH' ELSE 'CRITICAL' END AS level,
CASE WHEN p < 0.05 THEN 'CLEARED — routine contact, no action needed' WHEN p < 0.15 THEN 'MONITOR — watch for concussion symptoms over next 24 hours'
  WHEN p < 0.5 THEN 'EVALUATE — significant risk, consider immediate assessment' ELSE 'EVALUATE NOW — remove from play immediately for concussion assessment' END AS advice,
CASE WHEN speed * 10 < 40 THEN 'LOW' WHEN speed * 10 < 75 THEN 'MODERATE' ELSE 'HIGH' END AS by_g
FROM (SELECT *, speed / 20 AS p FROM impact_rows)""", "impact_rows"))
def b25_risk_level(spark, d):
    i = V.impact_rows(spark, d).withColumn("level", P.risk_level(F.col("speed") / 20))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level", P.recommendation(F.col("level")).alias("advice"), P.risk_of_g(F.col("speed") * 10).alias("by_g"))
