"""Registered queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetiq.functions import geometry as G
from kinetiq.functions import physics as P
from kinetiq.operators import aggregates as A
from kinetiq.operators import cycles as C
from kinetiq.operators import joins as J
from kinetiq.operators import ordered as E
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORACLES, ORDER, QUERIES, query, r, up
from kinetiq.sources import frames as S

__all__ = ["ORACLES", "QUERIES"]

# Ordered rows


@query(with_views("SELECT subject_id, frame, round(coalesce(list_distance(f, lag(f) OVER (PARTITION BY subject_id ORDER BY frame)), 0), 4) AS velocity FROM feat", "feat"))
def e1_frame_velocity(spark, d):
    return E.frame_velocity(V.feat(spark, d), KEY, ORDER).select(*KEY, *ORDER, r("velocity").alias("velocity"))


@query(with_views("""SELECT a.subject_id, a.frame, round(sum(CASE WHEN b.frame = 0 THEN 1 ELSE 0.1 END * pow(0.9::DOUBLE, a.frame - b.frame) * b.x), 6) AS ema
FROM signal a JOIN signal b ON a.subject_id = b.subject_id AND b.frame <= a.frame GROUP BY ALL""", "signal"))
def e2_ema(spark, d):
    return E.ema(V.signal(spark, d), KEY, ORDER, "x", 0.1).select(*KEY, *ORDER, r("ema", 6).alias("ema"))


@query(with_views("""SELECT a.subject_id, a.frame, round(greatest(0, max(b.x * pow(0.99::DOUBLE, a.frame - b.frame))), 4) AS peak
FROM signal a JOIN signal b ON a.subject_id = b.subject_id AND b.frame <= a.frame GROUP BY ALL""", "signal"))
def e3_decaying_peak(spark, d):
    return E.decaying_peak(V.signal(spark, d), KEY, ORDER, "x", 0.99).select(*KEY, *ORDER, r("peak").alias("peak"))


@query(with_views(""", d AS (SELECT subject_id, frame, list_transform(list_zip(f, lag(f) OVER w), lambda z: z[1] - z[2]) AS v0, lag(f) OVER w AS p, f FROM feat
  WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
v AS (SELECT subject_id, frame, CASE WHEN p IS NOT NULL THEN v0 END AS v FROM d),
a AS (SELECT *, lag(v) OVER w AS u, CASE WHEN v IS NOT NULL AND lag(v) OVER w IS NOT NULL THEN list_transform(list_zip(v, lag(v) OVER w), lambda z: z[1] - z[2]) END AS a
  FROM v WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
j AS (SELECT *, CASE WHEN a IS NOT NULL AND lag(a) OVER w IS NOT NULL THEN list_transform(list_zip(a, lag(a) OVER w), lambda z: z[1] - z[2]) END AS j
  FROM a WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
k AS (SELECT subject_id, frame, [coalesce(u[i], 0) FOR i IN range(1, 29)] AS u, [coalesce(a[i], 0) FOR i IN range(1, 29)] AS a, [coalesce(j[i], 0) FOR i IN range(1, 29)] AS j FROM j)
SELECT subject_id, frame, round(CASE WHEN sqrt(list_dot_product(u, u)) < 1e-8 THEN 0
  ELSE sqrt(greatest(0, list_dot_product(a, a) - list_dot_product(u, a) ** 2 / list_dot_product(u, u))) / list_dot_product(u, u) END, 4) AS curvature,
  round(sqrt(list_dot_product(j, j)), 4) AS jerk FROM k""", "feat"))
def e5_curvature_jerk(spark, d):
    return E.curvature_jerk(V.feat(spark, d), KEY, ORDER).select(*KEY, *ORDER, r("curvature").alias("curvature"), r("jerk").alias("jerk"))


@query(with_views(""", h AS (SELECT subject_id, frame, list(velocity) FILTER (velocity IS NOT NULL) OVER (PARTITION BY subject_id ORDER BY frame ROWS 39 PRECEDING) AS h FROM signal),
m AS (SELECT subject_id, frame, list_avg(h[1:len(h) // 2]) AS a, list_avg(h[len(h) // 2 + 1:]) AS b FROM h WHERE len(h) >= 20),
w AS (SELECT subject_id, frame, CASE WHEN a > 1e-6 THEN greatest(0, least(1, (a - b) / a)) ELSE 0 END AS raw FROM m),
e AS (SELECT x.subject_id, x.frame, sum(0.05::DOUBLE * pow(0.95::DOUBLE, x.frame - y.frame) * y.raw) AS f FROM w x JOIN w y ON x.subject_id = y.subject_id AND y.frame <= x.frame GROUP BY ALL)
SELECT s.subject_id, s.frame, round(coalesce(f, 0), 4) AS fatigue FROM signal s LEFT JOIN e USING (subject_id, frame)""", "signal"))
def e6_fatigue_index(spark, d):
    """With a window of 40 rows and 20 at least, as the tables' subjects are short."""
    out = E.fatigue_index(V.signal(spark, d), KEY, ORDER, "velocity", rows=40, least=20)
    return out.select(*KEY, *ORDER, r("fatigue").alias("fatigue"))


@query(with_views(""", e AS (SELECT subject_id, frame, x * pow(0.995::DOUBLE, 100 - frame) AS s FROM signal)
SELECT subject_id, frame, round(s, 4) AS "left" FROM e WHERE s >= 0.5""", "signal"))
def e10_score_decay(spark, d):
    return E.score_decay(V.signal(spark, d), "frame", "x", F.lit(100)).select(*KEY, *ORDER, r("left").alias("left"))


@query(with_views(""", k(subject_id, frame) AS (SELECT subject_id, min(frame) FROM signal WHERE x > 50 GROUP BY 1
  UNION ALL SELECT k.subject_id, min(s.frame) FROM k JOIN signal s ON s.subject_id = k.subject_id AND s.x > 50 AND s.frame >= k.frame + 15 GROUP BY k.subject_id, k.frame)
SELECT subject_id, frame FROM k""", "signal"))
def e11_cooldown(spark, d):
    hits = V.signal(spark, d).filter("x > 50").select(*KEY, *ORDER)
    return E.cooldown(hits, KEY, ORDER, "frame", 15)


_KEPT = """, k(subject_id, kind, t) AS (SELECT subject_id, kind, min(t) FROM signal GROUP BY 1, 2
  UNION ALL SELECT k.subject_id, k.kind, min(s.t) FROM k JOIN signal s ON s.subject_id = k.subject_id AND s.kind = k.kind AND s.t > k.t + 86400 GROUP BY k.subject_id, k.kind, k.t)"""


@query(with_views(_KEPT + " SELECT subject_id, kind, round(t, 3) AS t FROM k", "signal"))
def e12_consolidate_events(spark, d):
    events = V.signal(spark, d).select("subject_id", "kind", "frame", "t")
    return E.consolidate_events(events, ["subject_id", "kind"], ["t", "frame"], "t", 86400.0).select("subject_id", "kind", r("t", 3).alias("t"))


@query(with_views(""", g AS (SELECT subject_id, frame, frame - row_number() OVER (PARTITION BY subject_id ORDER BY frame) AS g FROM signal WHERE velocity >= 0.3)
SELECT subject_id, min(frame) AS start, max(frame) AS "end" FROM g GROUP BY subject_id, g""", "signal"))
def e13_contiguous_regions(spark, d):
    return E.contiguous_regions(V.signal(spark, d), KEY, "frame", F.col("velocity") >= 0.3)


_RUNS = """, n AS (SELECT *, (row_number() OVER w = 1 OR lag(kind) OVER w IS DISTINCT FROM kind)::INT AS b FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
i AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY frame) AS i FROM n)"""


@query(with_views(_RUNS + """ SELECT subject_id, kind, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM i GROUP BY subject_id, i, kind""", "signal"))
def e14_merge_adjacent(spark, d):
    return E.merge_adjacent(V.signal(spark, d), KEY, ORDER, "kind", "frame", "frame")


@query(with_views(""", n AS (SELECT *, coalesce(lag(kind) OVER w <> kind OR t - lag(t) OVER w >= 43200, true)::INT AS b FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY t, frame)),
i AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY t, frame) AS i FROM n)
SELECT subject_id, kind, round(min(t), 3) AS start, round(max(t), 3) AS "end", count(*) AS n FROM i GROUP BY subject_id, i, kind""", "signal"))
def e16_timeline_segments(spark, d):
    out = E.timeline_segments(V.signal(spark, d), KEY, "t", "kind", ["frame"], 43200.0)
    return out.select("subject_id", "kind", r("start", 3).alias("start"), r("end", 3).alias("end"), "n")


@query(with_views(""", c AS (SELECT subject_id, kind, frame, lag(kind) OVER (PARTITION BY subject_id ORDER BY frame) AS before FROM signal),
v AS (SELECT *, row_number() OVER (PARTITION BY subject_id, kind ORDER BY frame) > 1 AS seen FROM c WHERE before IS NULL OR before <> kind),
a AS (SELECT subject_id, count(DISTINCT kind) AS labels, count(*) AS runs, count(*) FILTER (WHERE seen) AS revisits FROM v GROUP BY 1)
SELECT subject_id, CASE WHEN labels = 1 THEN 'uniform' WHEN runs = labels THEN 'sequential' WHEN revisits >= 2 OR (revisits = 1 AND labels = 2) THEN 'alternating' ELSE 'mixed' END AS pattern FROM a""", "signal"))
def e19_temporal_pattern(spark, d):
    return E.temporal_pattern(V.signal(spark, d), KEY, ORDER, "kind")


@query(with_views(""", n AS (SELECT subject_id, frame, CASE WHEN k % 3 <> 0 THEN x END AS y FROM signal),
p AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, first_value(y IGNORE NULLS) OVER a AS y1,
  last_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS x0, first_value(CASE WHEN y IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS x1 FROM n
  WINDOW b AS (PARTITION BY subject_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY subject_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT subject_id, frame, round(coalesce(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (frame - x0) / (x1 - x0) END, y0, y1, 0), 4) AS filled FROM p""", "signal"))
def e20_interpolate_nulls(spark, d):
    gaps = V.signal(spark, d).withColumn("y", F.when(F.col("k") % 3 != 0, F.col("x")))
    return E.interpolate_nulls(gaps, KEY, "frame", "y").select(*KEY, *ORDER, r("filled").alias("filled"))


@query(with_views(""", a AS (SELECT subject_id, frame, x / 10 - 6.283185307179586 * floor(x / 10 / 6.283185307179586) AS a FROM signal),
s AS (SELECT *, a - lag(a) OVER (PARTITION BY subject_id ORDER BY frame) AS s FROM a)
SELECT subject_id, frame, round(a + sum(CASE WHEN abs(s) > 3.141592653589793 THEN -6.283185307179586 * round(s / 6.283185307179586) ELSE 0 END)
  OVER (PARTITION BY subject_id ORDER BY frame), 4) AS unwrapped FROM s""", "signal"))
def e21_unwrap_angle(spark, d):
    turn = 6.283185307179586
    angles = V.signal(spark, d).withColumn("a", F.col("x") / 10 - turn * F.floor(F.col("x") / 10 / turn))
    return E.unwrap_angle(angles, KEY, ORDER, "a").select(*KEY, *ORDER, r("unwrapped").alias("unwrapped"))


@query(with_views("""SELECT subject_id, frame, round(0.25 * coalesce(lag(x) OVER w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) OVER w, 0), 4) AS smoothed
FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)""", "signal"))
def e22_convolve(spark, d):
    return E.convolve(V.signal(spark, d), KEY, ORDER, "x", [0.25, 0.5, 0.25]).select(*KEY, *ORDER, r("smoothed").alias("smoothed"))


@query(with_views(""", n AS (SELECT subject_id, frame, row_number() OVER (PARTITION BY subject_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY subject_id) AS n FROM signal)
SELECT subject_id, frame FROM n WHERE n <= 4 OR i IN (0, n // 4, 2 * n // 4, 3 * n // 4)""", "signal"))
def e31_sample_even(spark, d):
    return E.sample_even(V.signal(spark, d), KEY, ORDER, 4).select(*KEY, *ORDER)


@query(with_views("SELECT subject_id, frame, round(x, 4) AS x FROM signal WHERE frame % 30 = 0 AND x IS NOT NULL", "signal"))
def e34_fatigue_timeline(spark, d):
    return V.signal(spark, d).filter("frame % 30 = 0 and x is not null").select(*KEY, *ORDER, r("x").alias("x"))


@query(with_views(""", c AS (SELECT subject_id, lag(k % 4) OVER (PARTITION BY subject_id ORDER BY frame) <> k % 4 AS c FROM signal)
SELECT subject_id, coalesce(sum(c::INT), 0)::BIGINT AS switches, coalesce(sum(c::INT), 0) > 3 AS unstable FROM c GROUP BY 1""", "signal"))
def e35_track_changes(spark, d):
    return E.track_changes(V.signal(spark, d).withColumn("track", F.col("k") % 4), KEY, ORDER, "track")


@query(with_views(""", s AS (SELECT subject_id, frame, CASE WHEN t - lag(t) OVER w > 0.001 THEN abs(x - lag(x) OVER w) / (t - lag(t) OVER w) END AS a
  FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
n AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY frame) AS i FROM s WHERE a IS NOT NULL)
SELECT p.subject_id, p.frame, round(1000 * sum(CASE WHEN q.i = 1 THEN 1 ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, p.i - q.i) * q.a), 4) AS acceleration
FROM n p JOIN n q ON p.subject_id = q.subject_id AND q.i <= p.i GROUP BY ALL""", "signal"))
def e36_acceleration_series(spark, d):
    out = E.acceleration_series(V.signal(spark, d), KEY, ORDER, "t", "x")
    return out.select(*KEY, *ORDER, r(F.col("acceleration") * 1000).alias("acceleration"))


# Joins


@query(with_views("SELECT a.seq_id, a.frame, a.subject_id AS a, b.subject_id AS b FROM boxes a JOIN boxes b ON a.seq_id = b.seq_id AND a.frame = b.frame AND a.subject_id < b.subject_id", "boxes"))
def c1_pairs_in_frame(spark, d):
    p = J.pairs_in_frame(V.boxes(spark, d), ["seq_id", "frame"], "subject_id")
    return p.select("seq_id", "frame", F.col("a_subject_id").alias("a"), F.col("b_subject_id").alias("b"))


@query(with_views(""", c AS (SELECT seq_id, frame, subject_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes),
f AS (SELECT seq_id, frame, lag(frame) OVER (PARTITION BY seq_id ORDER BY frame) AS before FROM (SELECT DISTINCT seq_id, frame FROM boxes)),
m AS (SELECT c.*, p.cx AS px, p.cy AS py FROM c JOIN f USING (seq_id, frame) JOIN c p ON p.seq_id = c.seq_id AND p.subject_id = c.subject_id AND p.frame = f.before),
s AS (SELECT a.seq_id, a.frame, a.subject_id AS a, b.subject_id AS b,
  (sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) - sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) * 30 AS speed
  FROM m a JOIN m b ON a.seq_id = b.seq_id AND a.frame = b.frame AND a.subject_id < b.subject_id),
k AS (SELECT *, row_number() OVER (PARTITION BY seq_id, frame ORDER BY speed DESC, a, b) AS rank, max(speed) OVER (PARTITION BY seq_id, frame) >= 1.5 AS warning FROM s WHERE speed > 0.1)
SELECT seq_id, frame, a, b, round(speed, 4) AS speed, rank, warning FROM k WHERE rank <= 5""", "boxes"))
def c2_closing_speed(spark, d):
    b = V.boxes(spark, d).withColumn("t", F.col("frame").cast("double"))
    out = J.closing_speed(b, ["seq_id"], "frame", "subject_id")
    return out.select("seq_id", "frame", F.col("a_subject_id").alias("a"), F.col("b_subject_id").alias("b"), r("speed").alias("speed"), "rank", "warning")


_IOU = """round(iou, 4) AS iou FROM (SELECT a.frame, a.subject_id AS a, b.subject_id AS b,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS p, (b.x2 - b.x1) * (b.y2 - b.y1) AS q, i / (p + q - i) AS iou
  FROM contacts a JOIN contacts b ON a.frame = b.frame AND a.subject_id < b.subject_id) WHERE iou >= 0.05"""


@query(with_views("SELECT frame, a, b, " + _IOU, "contacts"))
def b19_bbox_iou(spark, d):
    out = J.overlaps(V.contacts(spark, d), ["frame"], "subject_id")
    return out.select("frame", F.col("a_subject_id").alias("a"), F.col("b_subject_id").alias("b"), r("iou").alias("iou"))


@query(with_views(""", g AS (SELECT subject_id, frame, frame - row_number() OVER (PARTITION BY subject_id ORDER BY frame) AS g FROM signal WHERE velocity >= 0.3),
s AS (SELECT subject_id, min(frame) AS st, max(frame) + 1 AS en FROM g GROUP BY subject_id, g)
SELECT f.subject_id, f.frame, s.st AS start FROM signal f JOIN s ON s.subject_id = f.subject_id AND f.frame >= s.st AND f.frame < s.en""", "signal"))
def c5_frames_to_segments(spark, d):
    s = V.signal(spark, d)
    seg = E.contiguous_regions(s, KEY, "frame", F.col("velocity") >= 0.3).withColumn("end", F.col("end") + 1)
    return J.in_segments(s.select(*KEY, *ORDER), seg, KEY, "frame").select(*KEY, *ORDER, F.col("s_start").alias("start"))


@query(with_views("""SELECT a.subject_id, a.frame, coalesce(b.frame, -1) AS r_frame, round(coalesce(b.x, -1), 4) AS r_x FROM (SELECT * FROM signal WHERE kind = 'click') a
ASOF LEFT JOIN (SELECT * FROM signal WHERE kind <> 'click') b ON a.subject_id = b.subject_id AND a.t >= b.t""", "signal"))
def c7_replay_asof(spark, d):
    s = V.signal(spark, d)
    out = J.asof(s.filter("kind = 'click'").select("subject_id", "frame", "t"), s.filter("kind <> 'click'").select("subject_id", "frame", "t", "x"), KEY, "t", ["frame", "x"])
    return out.select(*KEY, *ORDER, F.coalesce("r_frame", F.lit(-1)).alias("r_frame"), r(F.coalesce("r_x", F.lit(-1.0))).alias("r_x"))


def _vectors(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("uuid"), F.col("label").alias("activity"), F.col("embedding").cast("array<double>").alias("vector"))
    q = e.filter("uuid % 50 = 0").select(F.col("uuid").alias("query_id"), F.col("vector").alias("q"), "activity")
    return q, e


_SEARCH = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS uuid, q.label AS ql, e.label AS el, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)"""


@query(f"WITH {_SEARCH}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM s WHERE ql = el) SELECT query_id, rank, uuid, round(score, 4) AS score FROM k WHERE rank <= 5")
def c8_vector_search(spark, d):
    q, e = _vectors(spark, d)
    return J.vector_search(q, e, 5, on=["activity"]).select("query_id", "rank", "uuid", r("score").alias("score"))


@query(f"WITH {_SEARCH}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM s) SELECT query_id, rank, uuid, round(score, 4) AS score FROM k WHERE rank <= 10")
def c9_similar_to(spark, d):
    q, e = _vectors(spark, d)
    return J.vector_search(q.drop("activity"), e, 10).select("query_id", "rank", "uuid", r("score").alias("score"))


@query(f"WITH {_SEARCH}, k AS (SELECT query_id, max(score) AS score, arg_max(uuid, score) AS uuid FROM s GROUP BY 1) SELECT query_id, CASE WHEN score >= 0.45 THEN uuid ELSE -1 END AS match, round(CASE WHEN score >= 0.45 THEN score ELSE 0 END, 4) AS score FROM k")
def c10_find_person(spark, d):
    q, e = _vectors(spark, d)
    return J.best_match(q.drop("activity"), e, 0.45, "uuid").select(
        "query_id", F.coalesce("match", F.lit(-1)).alias("match"), r(F.coalesce("score", F.lit(0.0))).alias("score")
    )


@query(f"WITH {_SEARCH}, k AS (SELECT query_id, max(score) AS score, arg_max(el, score) AS el FROM s GROUP BY 1) SELECT query_id, CASE WHEN score >= 0.4 THEN el::VARCHAR ELSE 'unknown' END AS match FROM k")
def c11_classify_activity(spark, d):
    q, e = _vectors(spark, d)
    return J.best_match(q.drop("activity"), e, 0.4, "activity", "unknown").select("query_id", "match")


_PROFILES = [("first", 1, "1-"), ("first", 1, "urgent"), ("second", 2, "high"), ("third", 3, "low")]


@query("""SELECT o_orderpriority AS label, CASE WHEN contains(l, '1-') OR contains(l, 'urgent') THEN 'first' WHEN contains(l, 'high') THEN 'second'
WHEN contains(l, 'low') THEN 'third' ELSE 'generic' END AS profile FROM (SELECT DISTINCT o_orderpriority, lower(trim(o_orderpriority)) AS l FROM orders)""")
def c13_match_profile(spark, d):
    profiles = spark.createDataFrame(_PROFILES, "profile string, rank int, keyword string")
    return J.match_profile(V.workout_rows(spark, d), profiles, "label")


@query("""WITH g AS (SELECT o_orderkey, o_custkey FROM orders), f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, n FROM g LEFT JOIN f ON l_orderkey = o_orderkey AND n <= 5000""")
def c17_game_detail(spark, d):
    """Every game (an order) with its first 5000 frames (lines) in order."""
    games = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    frames = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return J.game_detail(games, frames, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


# Aggregations


@query(with_views("""SELECT subject_id, frame, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-6 THEN 1 ELSE stddev_pop(x) OVER w END, 4) AS z
FROM signal WINDOW w AS (PARTITION BY subject_id)""", "signal"))
def d1_zscore(spark, d):
    return A.zscore(V.signal(spark, d), KEY, "x").select(*KEY, *ORDER, r("z").alias("z"))


@query(with_views("SELECT kind, k AS cluster, count(*) AS n FROM signal WHERE k >= 0 GROUP BY ALL", "signal"))
def d7_confusion_matrix(spark, d):
    return A.confusion(V.signal(spark, d).withColumnRenamed("k", "cluster"), "kind", "cluster")


@query(with_views(""", n AS (SELECT kind, k, count(*) AS n FROM signal GROUP BY ALL), a AS (SELECT sum(n) AS n FROM n GROUP BY kind), b AS (SELECT sum(n) AS n FROM n GROUP BY k),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(n * (n - 1) / 2) FROM a) AS a, (SELECT sum(n * (n - 1) / 2) FROM b) AS b, (SELECT sum(n) FROM n) AS t)
SELECT round((ij - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM s""", "signal"))
def d8_adjusted_rand(spark, d):
    return A.adjusted_rand(V.signal(spark, d), "kind", "k").select(r("ari", 6).alias("ari"))


_LOAD = """, w AS (SELECT subject_id, count(*) AS total_frames, sum((coalesce(velocity, 0) >= 0.05)::INT) / 30.0::DOUBLE AS active_s,
  sum((coalesce(velocity, 0) >= 0.3)::INT) / 30.0::DOUBLE AS high_s, sum((coalesce(velocity, 0) < 0.05)::INT) / 30.0::DOUBLE AS rest_s FROM signal GROUP BY 1),
l AS (SELECT *, CASE WHEN active_s > 0 THEN high_s / active_s ELSE 0 END AS intensity FROM w),
f AS (SELECT *, CASE WHEN active_s > 0 THEN least(1, intensity * 0.6::DOUBLE + least(1, active_s / 600) * 0.4::DOUBLE) * greatest(0.3, 1 - rest_s / (active_s + rest_s) * 0.5::DOUBLE) ELSE 0 END AS fatigue FROM l)"""


@query(with_views(_LOAD + " SELECT subject_id, total_frames, round(active_s, 4) AS active_s, round(high_s, 4) AS high_s, round(rest_s, 4) AS rest_s, round(intensity, 4) AS intensity, round(fatigue, 4) AS fatigue FROM f", "signal"))
def d12_workload(spark, d):
    out = A.workload(V.signal(spark, d), KEY)
    return out.select("subject_id", "total_frames", *(r(c).alias(c) for c in ("active_s", "high_s", "rest_s", "intensity", "fatigue")))


@query(with_views(_LOAD + _KEPT.replace("FROM signal GROUP", "FROM signal WHERE kind IN ('purchase', 'error') GROUP") + """,
e AS (SELECT subject_id, count(*) AS events, sum((kind = 'error')::INT) AS high FROM k GROUP BY 1),
j AS (SELECT f.subject_id, coalesce(events, 0) AS events, coalesce(high, 0) AS high, fatigue FROM f LEFT JOIN e USING (subject_id)),
s AS (SELECT *, CASE WHEN events >= 6 THEN 'RED' WHEN events >= 3 OR high > 0 THEN 'YELLOW' WHEN fatigue >= 0.8 THEN 'RED' WHEN fatigue >= 0.6 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM j)
SELECT subject_id, status, events::BIGINT AS events, high::BIGINT AS high, round(fatigue, 4) AS fatigue, reason <> '' AS pull, reason FROM (SELECT *, concat_ws('; ',
  CASE WHEN status = 'RED' THEN 'RED status: ' || events || ' injury risk events detected' END,
  CASE WHEN fatigue >= 0.8 THEN 'High fatigue (' || printf('%.0f%%', fatigue * 100) || ')' WHEN fatigue >= 0.6 AND status <> 'GREEN'
    THEN 'Elevated fatigue (' || printf('%.0f%%', fatigue * 100) || ') combined with YELLOW risk status' END,
  CASE WHEN high >= 2 THEN high || ' high-severity risk events' END) AS reason FROM s)""", "signal"))
def d13_risk_status(spark, d):
    """Workload and consolidated events of each subject to a traffic light with reasons: the flagship query."""
    s = V.signal(spark, d)
    risky = s.filter("kind in ('purchase', 'error')").select("subject_id", "kind", "frame", "t")
    kept = E.consolidate_events(risky, ["subject_id", "kind"], ["t", "frame"], "t", 86400.0)
    kept = kept.withColumn("severity", F.when(F.col("kind") == "error", "high").otherwise("medium"))
    out = A.risk_status(kept, A.workload(s, KEY), KEY)
    return out.withColumn("fatigue", r("fatigue"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END AS risk FROM lineitem),
n AS (SELECT o_orderkey, risk, count(*) AS n FROM o JOIN l ON l_orderkey = o_orderkey WHERE k <= 10 GROUP BY ALL)
SELECT o_custkey AS user_id, o.o_orderkey AS workout_id, coalesce(sum(n), 0)::BIGINT AS total, coalesce(string_agg(risk || ':' || n, ',' ORDER BY risk), '') AS counts
FROM o LEFT JOIN n USING (o_orderkey) WHERE k <= 10 GROUP BY 1, 2""")
def d14_risk_trend(spark, d):
    risks = V.risk_rows(spark, d).withColumn("risk_name", F.when(F.col("risk_name") != "N", F.col("risk_name")))
    out = A.risk_trend(V.workout_rows(spark, d), risks, 10)
    text = F.concat_ws(",", F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return out.select("user_id", "workout_id", "total", text.alias("counts"))


_HIT = """, p AS (SELECT *, greatest(0.1, 0.55::DOUBLE - 0.025::DOUBLE * speed) AS e,
  CASE l_linenumber % 3 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END AS c, greatest(0.5, least(2, 5 / speed)) AS ratio FROM impact_rows),
q AS (SELECT *, (1 + e) * speed / (mass_a + mass_b) * greatest(mass_a, mass_b) AS dv, 0.008::DOUBLE * pow(ratio, 0.2::DOUBLE) AS dur FROM p),
g AS (SELECT *, dv * c / dur * (pi() / 2) / 9.81::DOUBLE AS g FROM q),
h AS (SELECT *, 1 / (1 + exp(-(-10.2::DOUBLE + 0.0433::DOUBLE * g + 0.000873::DOUBLE * 50 * g - 0.00000092::DOUBLE * g * 50 * g))) AS prob,
  1 / (1 + exp(-(-9.805::DOUBLE + 0.1154::DOUBLE * g))) AS lin, dur * pow(2 / pi() * g, 2.5::DOUBLE) AS hic FROM g),
i AS (SELECT *, CASE WHEN prob < 0.05 THEN 'LOW' WHEN prob < 0.15 THEN 'MODERATE' WHEN prob < 0.5 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM h)"""


def _impacts(spark, d):
    i = V.impact_rows(spark, d)
    c = F.when(F.col("l_linenumber") % 3 == 0, 0.7).when(F.col("l_linenumber") % 3 == 1, 0.4).otherwise(0.25)
    return i.withColumn("i", P.impact_physics(F.col("speed"), F.col("mass_a"), F.col("mass_b"), c))


@query(with_views(_HIT + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(speed, 2) AS speed, round(dv, 6) AS delta_v, round(g, 6) AS peak_g, round(prob, 6) AS probability, round(lin, 6) AS linear, round(hic, 5) AS hic, level,
  CASE WHEN speed > 8 OR mass_a < 40 OR mass_a > 130 OR mass_b < 40 OR mass_b > 130 THEN 'EXTRAPOLATED' ELSE 'VALIDATED' END AS applicability FROM i""", "impact_rows"))
def b21_impact_physics(spark, d):
    i = F.col("i")
    return _impacts(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("speed", 2).alias("speed"), r(i["delta_v_body"], 6).alias("delta_v"), r(i["peak_g"], 6).alias("peak_g"),
        r(i["probability"], 6).alias("probability"), r(i["probability_linear"], 6).alias("linear"), r(i["hic"], 5).alias("hic"), i["level"].alias("level"), i["applicability"].alias("applicability"),
    )


@query(with_views(_HIT + """, e AS (SELECT l_suppkey AS a, l_partkey AS b, level, prob FROM i WHERE l_linenumber <= 3),
s AS (SELECT l_suppkey AS subject FROM i UNION SELECT l_partkey FROM i),
x AS (SELECT a AS subject, level, prob FROM e UNION ALL SELECT b, level, prob FROM e WHERE b <> a)
SELECT subject, count(level) AS events, round(coalesce(max(prob), 0), 4) AS max_p,
  coalesce(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][max(list_position(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], level))], 'NONE') AS worst FROM s LEFT JOIN x USING (subject) GROUP BY 1""", "impact_rows"))
def d15_crash_summary(spark, d):
    """Events of both subjects of a pair (a line's supplier and part); subjects without one have worst NONE."""
    i = _impacts(spark, d).select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_linenumber", F.col("i.level").alias("level"), F.col("i.probability").alias("p"))
    subjects = i.select(F.col("a").alias("subject")).union(i.select("b")).distinct()
    return A.crash_summary(i.filter("l_linenumber <= 3"), subjects).withColumn("max_p", r("max_p"))


@query(with_views("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(150, greatest(30, 22 * (l_quantity::DOUBLE * 40 * 0.001::DOUBLE) ** 2)), 3) AS mass FROM lineitem""", "impact_rows"))
def b22_body_mass(spark, d):
    t = V.table(spark, d, "lineitem")
    mass = P.body_mass(F.col("l_quantity").cast("double") * 40, F.lit(0.001))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(mass, 3).alias("mass"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def d19_collection_stats(spark, d):
    return V.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query(with_views(""", n AS (SELECT k, kind, count(*) AS n FROM signal GROUP BY ALL), t AS (SELECT k, max(n) AS m, sum(n) AS s FROM n GROUP BY 1)
SELECT t.k, min(kind) AS label, round(max(m / s), 4) AS share FROM t JOIN n ON n.k = t.k AND n.n = t.m GROUP BY 1""", "signal"))
def d21_label_vote(spark, d):
    return A.majority(V.signal(spark, d), "k", "kind").withColumn("share", r("share"))


@query(with_views("SELECT subject_id, arg_max(frame, frame) AS frame, arg_max(kind, frame) AS kind, round(arg_max(x, frame), 4) AS x FROM signal GROUP BY 1", "signal"))
def d27_latest_state(spark, d):
    return A.latest_state(V.signal(spark, d), KEY, ORDER, ["frame", "kind", "x"]).withColumn("x", r("x"))


# Geometry

_J = "joints[{}]"


@query(with_views("""SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))), 3) AS angle FROM (
SELECT vec_id, joints[7].x - joints[9].x AS ux, joints[7].y - joints[9].y AS uy, joints[11].x - joints[9].x AS vx, joints[11].y - joints[9].y AS vy FROM pose14)""", "pose14"))
def b11_joint_angle(spark, d):
    j = lambda i: F.get("joints", i)
    return V.pose14(spark, d).select("vec_id", r(G.joint_angle(j(6), j(8), j(10)), 3).alias("angle"))


@query(with_views("""SELECT vec_id, round(degrees(asin(greatest(-1, least(1, (h.y - l.y) / sqrt((l.x - h.x) ** 2 + (l.y - h.y) ** 2))))), 3) AS hip_drop,
round(degrees(atan2((s.x + t.x) / 2 - (l.x + h.x) / 2, (l.y + h.y) / 2 - (s.y + t.y) / 2)), 3) AS trunk_lean
FROM (SELECT vec_id, joints[7] AS l, joints[8] AS h, joints[1] AS s, joints[2] AS t FROM pose14)""", "pose14"))
def b13_hip_drop_trunk_lean(spark, d):
    j = lambda i: F.get("joints", i)
    lean = G.trunk_lean(G.midpoint(j(0), j(1)), G.midpoint(j(6), j(7)))
    return V.pose14(spark, d).select("vec_id", r(G.hip_drop(j(6), j(7)), 3).alias("hip_drop"), r(lean, 3).alias("trunk_lean"))


@query(with_views("""SELECT vec_id, list_bool_and([joints[i].v >= 0.3 FOR i IN [1, 2, 7, 8]]) AS seen FROM pose14""", "pose14"))
def b4_visibility_gate(spark, d):
    return V.pose14(spark, d).select("vec_id", G.visible(F.col("joints"), [0, 1, 6, 7]).alias("seen"))


@query(with_views(""", s AS (SELECT vec_id, [j FOR j IN joints IF j.v > 0.3] AS s FROM pose14)
SELECT vec_id, round(greatest(0, list_min([j.x FOR j IN s]) - 0.05), 4) AS x1, round(greatest(0, list_min([j.y FOR j IN s]) - 0.05), 4) AS y1,
round(least(1, list_max([j.x FOR j IN s]) + 0.05), 4) AS x2, round(least(1, list_max([j.y FOR j IN s]) + 0.05), 4) AS y2 FROM s WHERE len(s) > 0""", "pose14"))
def b33_landmark_bbox(spark, d):
    b = V.pose14(spark, d).select("vec_id", G.landmark_bbox(F.col("joints")).alias("b")).filter("b is not null")
    return b.select("vec_id", *(r(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


_LIMBS = ((0, 2), (2, 4), (1, 3), (3, 5), (6, 8), (8, 10), (7, 9), (9, 11), (0, 6), (1, 7))


@query(with_views(f""", w AS (SELECT vec_id, joints AS j, sqrt((joints[7].x - joints[8].x) ** 2 + (joints[7].y - joints[8].y) ** 2) AS w FROM pose14 WHERE joints[7].v >= 0.3 AND joints[8].v >= 0.3)
SELECT vec_id, (i - 1)::INT AS limb, round(CASE WHEN j[p[1] + 1].v >= 0.3 AND j[p[2] + 1].v >= 0.3 THEN sqrt((j[p[1] + 1].x - j[p[2] + 1].x) ** 2 + (j[p[1] + 1].y - j[p[2] + 1].y) ** 2) / w ELSE 0 END, 4) AS length
FROM (SELECT *, unnest({[list(p) for p in _LIMBS]}) AS p, unnest(range(1, 11)) AS i FROM w WHERE w >= 1e-6)""", "pose14"))
def b16_limb_lengths(spark, d):
    x = V.pose14(spark, d).withColumn("l", G.limb_lengths(F.col("joints"), list(_LIMBS), (6, 7))).filter("l is not null")
    return x.select("vec_id", F.posexplode("l").alias("limb", "length")).withColumn("length", r("length"))


@query(with_views(""", a AS (SELECT vec_id, joints, l, h, (l.x + h.x) / 2 AS px, (l.y + h.y) / 2 AS py, sqrt((l.x - h.x) ** 2 + (l.y - h.y) ** 2) AS w,
  (joints[1].x + joints[2].x) / 2 - px AS tx, (joints[1].y + joints[2].y) / 2 - py AS ty, (l.x - h.x) / w AS xx, (l.y - h.y) / w AS xy FROM (SELECT *, joints[7] AS l, joints[8] AS h FROM pose14)),
b AS (SELECT *, tx - (tx * xx + ty * xy) * xx AS ox, ty - (tx * xx + ty * xy) * xy AS oy, sqrt(ox * ox + oy * oy) AS n FROM a WHERE w >= 1e-4)
SELECT vec_id, round(((joints[9].x - px) * xx + (joints[9].y - py) * xy) / w, 4) AS x, round(((joints[9].x - px) * (CASE WHEN n < 1e-6 THEN -xy ELSE ox / n END) + (joints[9].y - py) * (CASE WHEN n < 1e-6 THEN xx ELSE oy / n END)) / w, 4) AS y FROM b""", "pose14"))
def b5_srp_normalize_2d(spark, d):
    x = V.pose14(spark, d).withColumn("s", G.srp_2d(F.col("joints"), (6, 7), (0, 1))).filter("s is not null")
    knee = F.get("s", 8)
    return x.select("vec_id", r(knee["x"]).alias("x"), r(knee["y"]).alias("y"))


# Selections


@query("""SELECT o_orderkey AS workout_id, o_custkey AS user_id FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def g1_page(spark, d):
    w = V.workout_rows(spark, d).filter("label = '1-URGENT'").orderBy(F.desc("created_at"), F.desc("workout_id"))
    return w.offset(40).limit(20).select("workout_id", "user_id")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey AS user_id, o_orderkey AS workout_id, round(o_totalprice, 2) AS fatigue_score FROM k WHERE n <= 5 AND o_totalprice > 50000""")
def g2_metric_trend(spark, d):
    """The latest five workouts of each user; rows without the metric go only after the limit."""
    own = A.top_n(V.workout_rows(spark, d), ["user_id"], [F.desc("created_at"), F.desc("workout_id")], 5)
    return own.filter("fatigue_score > 50000").select("user_id", "workout_id", r("fatigue_score", 2).alias("fatigue_score"))


@query(with_views("SELECT subject_id, rank, frame, round(x, 4) AS x FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY x DESC, frame) AS rank FROM signal) WHERE rank <= 3", "signal"))
def g3_top_n(spark, d):
    return A.top_n(V.signal(spark, d), KEY, [F.desc("x"), "frame"], 3).select(*KEY, "rank", "frame", r("x").alias("x"))


@query(with_views("""SELECT CASE WHEN subject_id = 2 THEN 1 ELSE subject_id END AS subject_id, CASE WHEN subject_id = 2 THEN frame + (SELECT max(frame) + 1 FROM signal WHERE subject_id = 1) ELSE frame END AS frame, round(x, 4) AS x FROM signal""", "signal"))
def g4_absorb(spark, d):
    return A.absorb(V.signal(spark, d), "subject_id", "frame", 1, 2).select(*KEY, *ORDER, r("x").alias("x"))


@query(with_views("SELECT subject_id, frame FROM signal WHERE subject_id IN (SELECT subject_id FROM signal GROUP BY 1 HAVING count(*) >= 70)", "signal"))
def g5_drop_short(spark, d):
    return A.drop_short(V.signal(spark, d), KEY, 70).select(*KEY, *ORDER)


# Cycles


def _cycles(spark, d):
    """Feature frames in cycles of 20, the last one shorter."""
    f = V.feat(spark, d).withColumn("cycle", F.expr("frame div 20")).withColumn("at", F.expr("frame % 20"))
    n = f.groupBy("subject_id", "cycle").agg(F.count("*").alias("length")).filter("length >= 2")
    return f.join(n, ["subject_id", "cycle"])


_CYCLE = """, c AS (SELECT subject_id, frame // 20 AS cycle, frame % 20 AS at, f FROM feat),
n AS (SELECT subject_id, cycle, count(*) AS length FROM c GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT *, phase * (length - 1) / 9.0::DOUBLE AS place, floor(place)::BIGINT AS lo, least(floor(place)::BIGINT + 1, length - 1) AS hi, place - floor(place) AS w
  FROM n, range(10) t(phase)),
s AS (SELECT g.subject_id, g.cycle, phase, unnest(range(28)) AS dim, unnest(a.f) * (1 - w) + unnest(b.f) * w AS v
  FROM g JOIN c a ON a.subject_id = g.subject_id AND a.cycle = g.cycle AND a.at = lo JOIN c b ON b.subject_id = g.subject_id AND b.cycle = g.cycle AND b.at = hi),
b AS (SELECT subject_id, phase, dim, avg(v) AS mean, greatest(stddev_pop(v), 1e-6) AS std FROM s GROUP BY ALL)"""


@query(with_views(_CYCLE + " SELECT subject_id, cycle, phase, dim, round(v, 4) AS v FROM s", "feat"))
def f4_resample(spark, d):
    out = C.resample(_cycles(spark, d), ["subject_id", "cycle"], 10)
    return out.select("subject_id", "cycle", "phase", F.posexplode("f").alias("dim", "v")).withColumn("v", r("v"))


@query(with_views(_CYCLE + " SELECT subject_id, phase, dim, round(mean, 4) AS mean, round(std, 4) AS std FROM b", "feat"))
def d2_build_baseline(spark, d):
    out = C.baseline(C.resample(_cycles(spark, d), ["subject_id", "cycle"], 10), ["subject_id"])
    return out.select("subject_id", "phase", "dim", r("mean").alias("mean"), r("std").alias("std"))


@query(with_views(_CYCLE + """, q AS (SELECT subject_id, cycle, phase, sqrt(avg(((v - mean) / std) ** 2)) AS rms FROM s JOIN b USING (subject_id, phase, dim) GROUP BY ALL)
SELECT subject_id, cycle, round(avg(rms), 4) AS score FROM q GROUP BY ALL""", "feat"))
def d4_score_cycles(spark, d):
    x = C.resample(_cycles(spark, d), ["subject_id", "cycle"], 10)
    out = C.score_cycles(x, C.baseline(x, ["subject_id"]), ["subject_id", "cycle"], ["subject_id"])
    return out.withColumn("score", r("score"))


@query(with_views(_CYCLE + " SELECT (subject_id % 2 = 0) AS normal, phase, dim, round(avg(v), 4) AS mean FROM s GROUP BY ALL", "feat"))
def d26_mean_cycle(spark, d):
    x = C.resample(_cycles(spark, d), ["subject_id", "cycle"], 10).withColumn("normal", F.col("subject_id") % 2 == 0)
    return C.mean_cycle(x, ["normal"]).withColumn("mean", r("mean"))


# More summaries and selections


@query(with_views("SELECT kind, count(*) AS n, round(avg(x), 4) AS mean, count(*) FILTER (WHERE velocity >= 0.3) AS anomalies FROM signal GROUP BY 1", "signal"))
def d10_cluster_summary(spark, d):
    s = V.signal(spark, d)
    return s.groupBy("kind").agg(F.count("*").alias("n"), r(F.avg("x")).alias("mean"), F.count(F.when(F.col("velocity") >= 0.3, 1)).alias("anomalies"))


_PLAYERS = "SELECT c_nationkey AS team, c_custkey AS player, c_acctbal / 100 AS risk, c_custkey % 100 AS fatigue FROM customer"


@query(f"""SELECT team, round(avg(risk) OVER w, 6) AS mean, round(avg(fatigue) OVER w, 6) AS fatigue, player, round(risk, 4) AS risk FROM ({_PLAYERS}) WINDOW w AS (PARTITION BY team) QUALIFY risk > 70""")
def d20_team_averages(spark, d):
    """Each team's means, with its players over 70."""
    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("player"), (F.col("c_acctbal") / 100).alias("risk"), (F.col("c_custkey") % 100).alias("fatigue"))
    t = A.team_averages(c, ["team"], "player", "risk", "fatigue")
    return t.select("team", r("mean", 6).alias("mean"), r("fatigue", 6).alias("fatigue"), F.explode("over").alias("o")).select("team", "mean", "fatigue", "o.player", r("o.risk").alias("risk"))


@query(with_views("SELECT subject_id, frame, round(x, 4) AS x FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t DESC, frame DESC) AS n FROM signal) WHERE n <= 50", "signal"))
def g6_person_history(spark, d):
    own = A.top_n(V.signal(spark, d), KEY, [F.desc("t"), F.desc("frame")], 50)
    return own.select(*KEY, *ORDER, r("x").alias("x"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey AS user_id, o_orderkey AS workout_id FROM k WHERE n <= 3""")
def g8_sample_per_group(spark, d):
    return A.top_n(V.workout_rows(spark, d), ["user_id", "label"], ["workout_id"], 3).select("user_id", "workout_id")


@query("""SELECT o_custkey AS user_id, o_orderkey AS workout_id, round(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END, 2) AS fatigue_score FROM orders""")
def a8_upsert(spark, d):
    w = V.workout_rows(spark, d).select("user_id", "workout_id", "fatigue_score")
    changed = w.filter("workout_id % 10 = 0").withColumn("fatigue_score", F.lit(0.0))
    return S.upsert(w, changed, ["workout_id"]).withColumn("fatigue_score", r("fatigue_score", 2))


@query(with_views("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(g, 4) AS peak_g, round(1 / (1 + exp(-(-10.2::DOUBLE + 0.0433::DOUBLE * g + 0.000873::DOUBLE * 50 * g - 0.00000092::DOUBLE * g * 50 * g))), 6) AS probability
FROM (SELECT *, speed / 0.006::DOUBLE * (pi() / 2) / 9.81::DOUBLE AS g FROM impact_rows)""", "impact_rows"))
def b23_ground_impact(spark, d):
    i = V.impact_rows(spark, d).withColumn("i", P.ground_impact(F.col("speed")))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("i.peak_g").alias("peak_g"), r("i.probability", 6).alias("probability"))


_ANGLE = """CASE WHEN {a}.v >= 0.3 AND {b}.v >= 0.3 AND {c}.v >= 0.3 THEN CASE WHEN sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2) < 1e-8 OR sqrt(({c}.x - {b}.x) ** 2 + ({c}.y - {b}.y) ** 2) < 1e-8 THEN 180
  ELSE degrees(acos(greatest(-1, least(1, (({a}.x - {b}.x) * ({c}.x - {b}.x) + ({a}.y - {b}.y) * ({c}.y - {b}.y)) / (sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2) * sqrt(({c}.x - {b}.x) ** 2 + ({c}.y - {b}.y) ** 2)))))) END END"""
_PAIRED = ", ".join(f"[{', '.join(_ANGLE.format(**{n: f'j[{i + 1}]' for n, i in zip('abc', chain)}) for chain in pair)}]" for pair in G.BILATERAL)


@query(with_views(f"""SELECT vec_id, round(coalesce(list_avg([CASE WHEN greatest(abs(p[1]), abs(p[2])) < 1e-8 THEN 0 ELSE abs(p[1] - p[2]) / greatest(abs(p[1]), abs(p[2])) * 100 END FOR p IN a IF p[1] IS NOT NULL AND p[2] IS NOT NULL]), 0), 3) AS asymmetry
FROM (SELECT vec_id, [{_PAIRED}] AS a FROM (SELECT vec_id, joints AS j FROM pose14))""", "pose14"))
def b14_asymmetry_index(spark, d):
    return V.pose14(spark, d).select("vec_id", r(G.frame_asymmetry(F.col("joints")), 3).alias("asymmetry"))


@query(with_views("""SELECT a.subject_id, a.frame, count(b.frame) AS covering FROM signal a LEFT JOIN (SELECT subject_id, t AS st, t + 86400 AS en, frame FROM signal WHERE kind = 'purchase') b
ON a.subject_id = b.subject_id AND a.t >= b.st AND a.t < b.en WHERE a.kind = 'click' GROUP BY ALL""", "signal"))
def c19_risks_at(spark, d):
    """How many risk segments of its subject cover each time point."""
    s = V.signal(spark, d)
    seg = s.filter("kind = 'purchase'").select("subject_id", F.col("t").alias("start"), (F.col("t") + 86400).alias("end"))
    at = s.filter("kind = 'click'").select(*KEY, *ORDER, "t")
    n = J.in_segments(at, seg, KEY, "t").groupBy(*KEY, *ORDER).agg(F.count("*").alias("covering"))
    return at.select(*KEY, *ORDER).join(n, [*KEY, *ORDER], "left").fillna(0, ["covering"])


@query(with_views("""SELECT vec_id, round(CASE WHEN c > 0 THEN -1 ELSE 1 END * degrees(atan2(abs(c) / l, l * 0.5)), 3) AS fppa FROM (
SELECT vec_id, ax * ky - ay * kx AS c, sqrt(ax * ax + ay * ay) AS l FROM (SELECT vec_id, joints[11].x - joints[7].x AS ax, joints[11].y - joints[7].y AS ay,
  joints[9].x - joints[7].x AS kx, joints[9].y - joints[7].y AS ky FROM pose14))""", "pose14"))
def b12_fppa(spark, d):
    j = lambda i: F.get("joints", i)
    return V.pose14(spark, d).select("vec_id", r(G.fppa(j(6), j(8), j(10)), 3).alias("fppa"))


@query("""SELECT l_partkey % 17 AS keypoint, CASE WHEN l_partkey % 17 <= 4 THEN 'head_to_head' WHEN l_partkey % 17 IN (5, 6) THEN 'head_to_shoulder' WHEN l_partkey % 17 IN (7, 8, 11, 12) THEN 'head_to_torso' ELSE 'head_to_limb' END AS zone,
CASE WHEN l_partkey % 17 <= 4 THEN 0.7 WHEN l_partkey % 17 IN (5, 6) THEN 0.4 WHEN l_partkey % 17 IN (7, 8) THEN 0.25 WHEN l_partkey % 17 IN (11, 12) THEN 0.2 WHEN l_partkey % 17 IN (9, 10) THEN 0.15 ELSE 0.08 END::DOUBLE AS coupling, count(*) AS n FROM lineitem GROUP BY ALL""")
def b20_contact_zone(spark, d):
    t = V.table(spark, d, "lineitem").select((F.col("l_partkey") % 17).alias("keypoint"))
    z = t.withColumn("z", P.contact_zone(F.col("keypoint")))
    return z.groupBy("keypoint", F.col("z.zone").alias("zone"), F.col("z.coupling").alias("coupling")).agg(F.count("*").alias("n"))


@query(with_views("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(100 / (1 + exp(-0.08::DOUBLE * (least(greatest(mass_a / 8 - 3, 0) / 12, 1) * 30 + least(greatest(mass_b - 30, 0) / 120, 1) * 25
  + least(greatest(l_linenumber - 1, 0) / 4.0::DOUBLE, 1) * 15 + least(greatest(speed * 4 - 12, 0) / 23, 1) * 20 + least(greatest(speed - 0.8::DOUBLE, 0) / 2.2::DOUBLE, 1) * 10 - 50))), 4) AS p FROM impact_rows""", "impact_rows"))
def b24_concussion_composite(spark, d):
    i = V.impact_rows(spark, d)
    p = P.concussion_composite(F.col("mass_a") / 8, F.col("mass_b"), F.col("l_linenumber").cast("double"), F.col("speed") * 4, F.col("speed"))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(p).alias("p"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, list_avg(v[1:10]) AS a, list_max(v[1:10]) AS h, list_avg(v[11:20]) AS b, list_avg(v[21:30]) AS c, list_avg(v[31:40]) AS d, list_avg(v[41:50]) AS e FROM e)
SELECT vec_id, floor((a * 0.6::DOUBLE + h * 0.4::DOUBLE) * 100)::BIGINT AS concussion, floor(b * 100)::BIGINT AS fatigue, floor((1 - c) * 100)::BIGINT AS recovery, floor(d * 100)::BIGINT AS movement, floor(e * 100)::BIGINT AS performance,
  floor(60 + b * 140)::BIGINT AS heart_rate, round(h * 40, 1) AS collision_velocity, floor((1 - b * 0.5) * 100)::BIGINT AS hydration FROM m""")
def b28_derive_metrics(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", P.derive_metrics(F.col("embedding").cast("array<double>")).alias("m"))
    return e.select("vec_id", "m.*")


@query(with_views("""SELECT subject_id, frame, CASE WHEN p < 0.1 OR p > 0.9 THEN 'transition' WHEN p < 0.5 THEN 'ascending' ELSE 'descending' END AS phase
FROM (SELECT subject_id, frame, least(1, greatest(0, (frame % 20) / 19.0::DOUBLE)) AS p FROM signal)""", "signal"))
def b31_movement_phase(spark, d):
    s = V.signal(spark, d)
    return s.select(*KEY, *ORDER, G.movement_phase((F.col("frame") % 20).cast("double"), F.lit(0.0), F.lit(20.0)).alias("phase"))


@query(with_views("""SELECT subject_id, frame, CASE WHEN frame < greatest(30, floor(count(*) OVER (PARTITION BY subject_id) * 0.2)) THEN 'calibrating' WHEN coalesce(velocity >= 0.3, false) THEN 'anomaly' ELSE 'normal' END AS phase FROM signal""", "signal"))
def b32_frame_phase_label(spark, d):
    s = V.signal(spark, d)
    n = s.groupBy("subject_id").agg(F.count("*").alias("n"))
    return s.join(n, "subject_id").select(*KEY, *ORDER, G.frame_phase(F.col("frame"), F.col("n"), F.lit(1), F.col("velocity") >= 0.3).alias("phase"))


@query(with_views(""", j AS (SELECT subject_id, kind, avg(x) AS m, row_number() OVER (PARTITION BY subject_id ORDER BY avg(x) DESC, kind) AS n FROM signal GROUP BY subject_id, kind),
s AS (SELECT subject_id, count(x) AS cycles, round(avg(x) + 1e-9::DOUBLE, 4) AS mean, round(quantile_cont(x, 0.5) + 1e-9::DOUBLE, 4) AS median, round(max(x) + 1e-9::DOUBLE, 4) AS most FROM signal GROUP BY 1)
SELECT s.*, kind AS joint, round(m + 1e-9::DOUBLE, 4) AS joint_mean, n <= 3 AS worst FROM s JOIN j USING (subject_id)""", "signal"))
def d5_sequence_summary(spark, d):
    """Subjects as sequences, kinds of event as joints."""
    s = V.signal(spark, d)
    out = A.sequence_summary(s, KEY, "x").join(A.joint_summary(s, KEY, "kind", "x"), KEY)
    rows = out.select(*KEY, "cycles", "mean", "median", "most", F.explode("joints").alias("joint", "joint_mean"), "worst")
    return rows.select(*KEY, "cycles", "joint", *(up(F.col(c)).alias(c) for c in ("mean", "median", "most", "joint_mean")), F.array_contains("worst", F.col("joint")).alias("worst"))


_INJURIES = """SELECT o_custkey % 500 AS user_id, ['acl', 'shoulder', 'lower_back', 'hip', 'hamstring', 'knee_general', 'ankle', 'unknown'][o_orderkey % 8 + 1] AS type, ['left', 'right', 'bilateral', NULL][o_orderkey // 8 % 4 + 1] AS side,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0.65::DOUBLE WHEN '2-HIGH' THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS f FROM orders"""


@query("WITH i AS (" + _INJURIES + ") SELECT user_id, " + ", ".join(f"round(product(CASE WHEN type IN ({t}) THEN f ELSE 1 END), 6) AS {n}" for n, t in (("fppa", "'acl', 'knee_general'"), ("hip_drop", "'lower_back', 'hip'"), ("trunk_lean", "'lower_back'"), ("asymmetry", "'hamstring'"), ("angular_velocity", "'shoulder'")))
  + """, count(*) FILTER (WHERE type = 'acl') * 2 + count(*) FILTER (WHERE type = 'ankle') * 2 + count(*) FILTER (WHERE type = 'shoulder' AND coalesce(side, 'bilateral') IN ('left', 'right')) + 2 * count(*) FILTER (WHERE type = 'shoulder' AND coalesce(side, 'bilateral') = 'bilateral') AS watched,
  coalesce(bool_or(type = 'shoulder' AND coalesce(side, 'bilateral') <> 'right'), false) AS left_elbow FROM i GROUP BY 1""")
def d23_injury_modifiers(spark, d):
    pick = lambda n, *names: F.get(F.array(*(F.lit(k) for k in names)), n.cast("int"))
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "severe").when(F.col("o_orderpriority") == "2-HIGH", "moderate").otherwise("mild")
    kind = pick(F.col("o_orderkey") % 8, "acl", "shoulder", "lower_back", "hip", "hamstring", "knee_general", "ankle", "unknown")
    side = pick(F.expr("o_orderkey div 8 % 4"), "left", "right", "bilateral", None)
    i = V.table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("user_id"), kind.alias("type"), severity.alias("severity"), side.alias("side"))
    m = A.injury_modifiers(i, ["user_id"])
    names = ("fppa", "hip_drop", "trunk_lean", "asymmetry", "angular_velocity")
    return m.select("user_id", *(r(f"{n}_scale", 6).alias(n) for n in names), F.size("monitor_joints").cast("long").alias("watched"), F.array_contains("monitor_joints", "left_elbow").alias("left_elbow"))


from kinetiq.plans import cluster_queries, head_queries, live_queries, monitor_queries, people_queries, segment_queries, sequence_queries, skeleton_queries  # noqa: E402, F401  they register their queries
