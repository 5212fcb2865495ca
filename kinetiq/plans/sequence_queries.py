"""Queries of the per-sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetiq.operators import cycles as C
from kinetiq.operators import joins as J
from kinetiq.operators import sequences as Q
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORDER, query, r, up

SEG = ["subject_id", "segment"]


def _segments(spark, d, size: int = 10):
    """Feature frames in segments of ``size``, a shorter last one left out if it has under two frames."""
    f = V.feat(spark, d).withColumn("segment", F.expr(f"frame div {size}")).withColumn("at", F.expr(f"frame % {size}"))
    n = f.groupBy(*SEG).agg(F.count("*").alias("length")).filter("length >= 2")
    return f.join(n, SEG)


def _sql_segments(size: int = 10) -> str:
    return f""", c AS (SELECT subject_id, frame // {size} AS segment, frame % {size} AS at, f, count(*) OVER (PARTITION BY subject_id, frame // {size}) AS length FROM feat)"""


def _sql_resampled(points: str, name: str = "s", source: str = "c") -> str:
    return f""", n AS (SELECT DISTINCT subject_id, segment, length, {points} AS points FROM {source} WHERE length >= 2),
g AS (SELECT *, phase * (length - 1) / (points - 1)::DOUBLE AS place, floor(place)::BIGINT AS lo, least(floor(place)::BIGINT + 1, length - 1) AS hi, place - floor(place) AS w FROM n, range(100) t(phase) WHERE phase < points),
{name} AS (SELECT g.subject_id, g.segment, phase, unnest(range(28)) AS dim, unnest(a.f) * (1 - w) + unnest(b.f) * w AS v
  FROM g JOIN {source} a ON a.subject_id = g.subject_id AND a.segment = g.segment AND a.at = lo JOIN {source} b ON b.subject_id = g.subject_id AND b.segment = g.segment AND b.at = hi)"""


@query()
def f1_lowpass(spark, d):
    return Q.lowpass(V.signal(spark, d), KEY, "frame", "x").select(*KEY, *ORDER, r("smooth").alias("smooth"))


@query()
def f2_heel_strikes(spark, d):
    return Q.heel_strikes(V.signal(spark, d), KEY, "frame", "x", least=15)


@query(with_views(""", s AS (SELECT subject_id, frame AS strike, lead(frame) OVER (PARTITION BY subject_id ORDER BY frame) AS next, row_number() OVER (PARTITION BY subject_id ORDER BY frame) - 1 AS cycle FROM feat WHERE frame % 17 = 3)
SELECT f.subject_id, f.frame, s.cycle, f.frame - s.strike AS at, s.next - s.strike AS length FROM feat f JOIN s ON s.subject_id = f.subject_id AND f.frame >= s.strike AND f.frame < s.next""", "feat"))
def f3_gait_cycles(spark, d):
    f = V.feat(spark, d).select(*KEY, *ORDER)
    strikes = f.filter("frame % 17 = 3").select("subject_id", F.col("frame").alias("strike"))
    return C.cycles_from_strikes(f, strikes, KEY, "frame").select(*KEY, *ORDER, "cycle", "at", "length")


@query()
def f5_motion_boundaries(spark, d):
    return Q.motion_boundaries(V.feat(spark, d), KEY, "frame", "f", fps=10.0, seconds=0.5)


@query(with_views(""", b AS (SELECT DISTINCT subject_id, frame AS b FROM feat WHERE frame % 12 = 0 OR frame = 30), n AS (SELECT subject_id, max(frame) + 1 AS n FROM feat GROUP BY 1),
e AS (SELECT subject_id, b, coalesce(lead(b) OVER (PARTITION BY subject_id ORDER BY b), n) AS e FROM b JOIN n USING (subject_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY b) - 1 AS segment FROM e WHERE e - b >= 3),
x AS (SELECT s.subject_id, segment, b, e, vec_id, unnest(range(28)) AS dim, unnest(f) AS v FROM s JOIN feat ON feat.subject_id = s.subject_id AND frame >= b AND frame < e)
SELECT subject_id, segment, b AS start_valid, e AS end_valid, (SELECT min(vec_id) FROM x y WHERE y.subject_id = x.subject_id AND y.segment = x.segment) AS start_frame, dim, round(avg(v), 4) AS mean FROM x GROUP BY subject_id, segment, b, e, dim""", "feat"))
def f6_segment_motions(spark, d):
    f = V.feat(spark, d)
    every = f.filter("frame % 12 = 0").select("subject_id", F.col("frame").alias("boundary"))
    forced = f.filter("frame = 30").select("subject_id", F.col("frame").alias("boundary"))
    s = Q.segment_motions(f, every, KEY, "frame", "vec_id", "f", forced)
    rows = s.select("subject_id", "segment", "start_valid", "end_valid", "start_frame", F.posexplode("mean_feature").alias("dim", "mean"))
    return rows.withColumn("mean", r("mean"))


_SPECTRA = _sql_segments() + _sql_resampled("30") + """, w AS (SELECT subject_id, segment, dim, k, sqrt(sum(v * cos(2 * pi() * k * phase / 30)) ** 2 + sum(v * sin(2 * pi() * k * phase / 30)) ** 2) / 30 AS z FROM s, range(1, 16) t(k) GROUP BY ALL),
m AS (SELECT subject_id, segment, dim, avg(v) AS m FROM s GROUP BY ALL),
p AS (SELECT a.subject_id, a.segment AS a, b.segment AS b, sqrt(sum((a.z - b.z) ** 2)) AS d FROM w a JOIN w b ON a.subject_id = b.subject_id AND a.dim = b.dim AND a.k = b.k AND a.segment < b.segment GROUP BY ALL),
q AS (SELECT a.subject_id, a.segment AS a, b.segment AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM m a JOIN m b ON a.subject_id = b.subject_id AND a.dim = b.dim AND a.segment < b.segment GROUP BY ALL)"""


@query(with_views(_SPECTRA + " SELECT subject_id, a, b, round((p.d + q.d) / sqrt(28), 4) AS distance FROM p JOIN q USING (subject_id, a, b)", "feat"))
def f7_segment_distance(spark, d):
    spectra = Q.segment_spectra(_segments(spark, d), SEG)
    return Q.segment_distance(spectra, KEY, "segment").withColumn("distance", r("distance"))


@query()
def f8_cluster_segments(spark, d):
    f = V.feat(spark, d)
    every = f.filter("frame % 10 = 0").select("subject_id", F.col("frame").alias("boundary"))
    segments = Q.segment_motions(f, every, KEY, "frame", "frame", "f")
    inside = J.within(f, segments.select(*SEG, "start_valid", "end_valid"), KEY, "frame", "start_valid", "end_valid")
    inside = inside.withColumns({"at": F.expr("frame - start_valid"), "length": F.expr("end_valid - start_valid")})
    return Q.cluster_segments(segments, Q.segment_spectra(inside, SEG), KEY, threshold=0.14, fps=5.0)


@query(with_views(""", n AS (SELECT subject_id, count(*) AS n FROM feat GROUP BY 1), x AS (SELECT subject_id, frame, unnest(range(28)) AS dim, unnest(f) AS v FROM feat),
m AS (SELECT x.subject_id, x.frame, dim, avg(v) OVER (PARTITION BY x.subject_id, dim ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m, n FROM x JOIN n USING (subject_id)),
k AS (SELECT * FROM m WHERE frame >= 3 AND frame < n - 3 AND n >= 14),
p AS (SELECT a.subject_id, a.frame, b.frame AS other, sqrt(sum((a.m - b.m) ** 2)) AS d FROM k a JOIN k b ON a.subject_id = b.subject_id AND a.dim = b.dim AND abs(a.frame - b.frame) >= 7 GROUP BY ALL),
s AS (SELECT subject_id, frame, 1 / (min(d) + 0.01::DOUBLE) AS s FROM p GROUP BY ALL)
SELECT f.subject_id, f.frame, round(coalesce(s, 0), 4) AS similarity FROM feat f LEFT JOIN s USING (subject_id, frame)""", "feat"))
def f9_self_similarity(spark, d):
    return Q.self_similarity(V.feat(spark, d), KEY, "frame", "f", 7).withColumn("similarity", r("similarity"))


@query()
def f10_procrustes(spark, d):
    p = V.marks33(spark, d).select("vec_id", F.transform(F.slice("p", 12, 6), lambda j: F.array(j["x"], j["y"], j["z"])).alias("q"))
    template = [[0.2, 1.0, 0.0], [-0.2, 1.0, 0.0], [0.3, 0.6, 0.1], [-0.3, 0.6, 0.1], [0.3, 0.2, 0.2], [-0.3, 0.2, 0.2]]
    rows = Q.procrustes(p, "q", template).select("vec_id", F.posexplode("aligned").alias("point", "a"))
    return rows.select("vec_id", "point", *(r(F.get("a", i)).alias(c) for i, c in enumerate("xyz")))


@query()
def f11_smoothness(spark, d):
    out = Q.smoothness(_segments(spark, d), SEG, "at", "f")
    return out.select(*SEG, *(r(c).alias(c) for c in ("sparc", "median_frequency", "ldlj", "entropy", "sample_entropy", "spread", "efficiency")))


@query(with_views("SELECT subject_id, kind, round(max(x) - min(x), 4) AS rom FROM signal GROUP BY ALL", "signal"))
def f12_range_of_motion(spark, d):
    return Q.range_of_motion(V.signal(spark, d), ["subject_id", "kind"], "x").withColumn("rom", r("rom"))


_CORR = _sql_segments() + _sql_resampled("12") + """, k AS (SELECT a.subject_id, a.segment, corr(a.v, b.v) AS c FROM s a JOIN s b ON a.subject_id = b.subject_id AND b.segment = a.segment + 1 AND a.phase = b.phase AND a.dim = b.dim GROUP BY ALL)"""


@query(with_views(_CORR + " SELECT subject_id, segment, round(c, 4) AS correlation, round(regr_slope(c, segment) OVER (PARTITION BY subject_id), 4) AS slope FROM k", "feat"))
def f13_rep_correlation(spark, d):
    pairs, slope = Q.rep_correlation(C.resample(_segments(spark, d), SEG, 12), KEY, "segment")
    return pairs.join(slope, KEY).select(*SEG, r("correlation").alias("correlation"), r("slope").alias("slope"))


@query(with_views(""", p AS (SELECT subject_id, list_position(['click', 'view', 'purchase', 'error'], kind) AS rank, arg_max(frame, (x, -frame)) AS at, count(*) AS n FROM signal WHERE kind IN ('click', 'view', 'purchase', 'error') GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT a.subject_id, avg((a.at <= b.at)::INT) AS s FROM p a JOIN p b ON a.subject_id = b.subject_id AND a.rank < b.rank GROUP BY 1), c AS (SELECT subject_id, count(*) AS joints FROM p GROUP BY 1)
SELECT subject_id, CASE WHEN joints >= 3 THEN round(s, 3) END AS score, joints FROM c LEFT JOIN q USING (subject_id)""", "signal"))
def f14_kinematic_sequence(spark, d):
    return Q.kinematic_sequence(V.signal(spark, d), KEY, "frame", "kind", "x", ["click", "view", "purchase", "error"])


@query(with_views("""SELECT subject_id, frame, round((least(1, x / 400) / 0.25::DOUBLE * 0 + 0.25::DOUBLE * least(1, x / 400 / 0.25::DOUBLE) + 0.2::DOUBLE * k / 100 + CASE WHEN velocity IS NULL THEN 0 ELSE 0.2::DOUBLE * least(1, velocity * 3) END
  + 0.15::DOUBLE * greatest(0, least(1, (x - 50) / 1000 * 20))) / (0.25::DOUBLE + 0.2::DOUBLE + CASE WHEN velocity IS NULL THEN 0 ELSE 0.2::DOUBLE END + 0.15::DOUBLE) + 1e-9::DOUBLE, 3) AS fatigue FROM signal""", "signal"))
def f15_composite_fatigue(spark, d):
    s = V.signal(spark, d)
    value = Q.composite_fatigue(8, rom=F.col("x") / 400, ewma=F.col("k") / 100, cusum=F.col("velocity") * 3, correlation=(50 - F.col("x")) / 1000)
    return s.select(*KEY, *ORDER, up(value, 3).alias("fatigue"))


_GROUPED = _sql_segments(12) + """, k AS (SELECT *, floor(quantile_cont(length, 0.5) OVER (PARTITION BY subject_id)) AS q FROM (SELECT DISTINCT subject_id, segment, length FROM c WHERE length >= 2)),
cc AS (SELECT c.*, greatest({least}, {most}) AS pts FROM c JOIN k USING (subject_id, segment))"""


@query(with_views(_GROUPED.format(least=10, most="least(q, 90)") + _sql_resampled("pts::INT", source="cc") + " SELECT subject_id, phase, dim, round(avg(v), 4) AS v FROM s GROUP BY ALL", "feat"))
def f16_representatives(spark, d):
    reps = Q.representatives(_segments(spark, d, 12), KEY, "segment")
    return reps.select("subject_id", "phase", F.posexplode("f").alias("dim", "v")).withColumn("v", r("v"))


_REPS = _GROUPED.format(least=10, most="least(q, 90)") + _sql_resampled("pts::INT", source="cc") + """, r AS (SELECT subject_id, phase, list(m ORDER BY dim) AS rep FROM (SELECT subject_id, phase, dim, avg(v) AS m FROM s GROUP BY ALL) GROUP BY ALL),
t AS (SELECT subject_id, max(phase) AS top FROM r GROUP BY 1),
a AS (SELECT cc.subject_id, cc.segment, cc.at, cc.f, floor(cc.at / (cc.length - 1)::DOUBLE * top)::BIGINT AS phase FROM cc JOIN t USING (subject_id)), j AS (SELECT a.*, rep FROM a JOIN r USING (subject_id, phase))"""


@query(with_views(_REPS + " SELECT subject_id, segment, \"at\", phase, unnest(range(28))::INT AS dim, round(unnest(rep), 4) AS v FROM j", "feat"))
def c6_align_to_representative(spark, d):
    f = _segments(spark, d, 12)
    out = Q.align_to_representative(f, Q.representatives(f, KEY, "segment"), KEY)
    return out.select(*SEG, "at", "phase", F.posexplode("rep").alias("dim", "v")).withColumn("v", r("v"))


@query(with_views(_REPS + " SELECT subject_id, segment, \"at\", round(list_avg([greatest(0, 1 - sqrt((f[2*i+1] - rep[2*i+1]) ** 2 + (f[2*i+2] - rep[2*i+2]) ** 2)) FOR i IN range(14)]) * 100, 3) AS score FROM j", "feat"))
def f17_form_score(spark, d):
    f = _segments(spark, d, 12)
    out = Q.align_to_representative(f, Q.representatives(f, KEY, "segment"), KEY)
    return out.select(*SEG, "at", r(Q.form_score(F.col("f"), F.col("rep")), 3).alias("score"))


@query(with_views(_GROUPED.format(least=5, most="q") + _sql_resampled("pts::INT", source="cc") + """, b AS (SELECT subject_id, phase, dim, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS sd FROM s GROUP BY ALL),
e AS (SELECT subject_id, segment, sqrt(avg(((v - m) / sd) ** 2)) AS score FROM s JOIN b USING (subject_id, phase, dim) GROUP BY ALL),
z AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w + 1.5::DOUBLE * greatest(stddev_pop(score) OVER w, 0.3::DOUBLE) AS lim FROM e WINDOW w AS (PARTITION BY subject_id)),
y AS (SELECT *, n >= 2 AND score > lim AS o, sum((n >= 2 AND score > lim)::INT) OVER (PARTITION BY subject_id) AS flags FROM z)
SELECT subject_id, segment, round(CASE WHEN n < 2 THEN 0 ELSE score END, 4) AS score, o AND NOT (n >= 5 AND flags <= 1) AS anomaly FROM y""", "feat"))
def d9_analyze_consistency(spark, d):
    return Q.analyze_consistency(_segments(spark, d, 12), KEY, "segment").withColumn("score", r("score"))


def _risk_sql(rows: str) -> str:
    return f"""SELECT subject_id, frame, joint, risk, CASE WHEN v > h THEN 'high' ELSE 'medium' END AS severity, round(v + 1e-9::DOUBLE, 1) AS value, CASE WHEN v > h THEN h ELSE m END AS threshold FROM ({rows}) WHERE v > m"""


_RISKS = " UNION ALL ".join(
    f"SELECT subject_id, frame, '{j}' AS joint, '{n}' AS risk, {v} AS v, {m}::DOUBLE AS m, {h}::DOUBLE AS h FROM signal"
    for j, n, v, m, h in (
        ("left_knee", "knee_valgus", "abs(x - 50)", 15, 25), ("right_knee", "knee_valgus", "k / 3.0::DOUBLE", 15, 25), ("pelvis", "hip_drop", "abs(k - 50) / 4.0::DOUBLE", 8, 12),
        ("bilateral", "asymmetry", "coalesce(velocity * 101.3::DOUBLE, 0)", 15, 25),
    )
)


@query(with_views(_risk_sql(_RISKS), "signal"))
def f18_injury_risks(spark, d):
    s = V.signal(spark, d).withColumns({
        "fppa_left": F.col("x") - 50, "fppa_right": F.col("k") / 3, "hip_drop": (F.col("k") - 50) / 4, "asymmetry": F.col("velocity") * 101.3,
    })
    return Q.injury_risks(s, [*KEY, *ORDER], digits=6).withColumn("value", up(F.col("value"), 1))


@query()
def f27_periodicity(spark, d):
    return Q.periodicity(V.feat(spark, d), KEY, "frame", "f")


@query(with_views(""", l AS (SELECT subject_id, max(frame) AS last FROM feat GROUP BY 1), q AS (SELECT l.subject_id, last, f FROM l JOIN feat ON feat.subject_id = l.subject_id AND frame = last)
SELECT q.subject_id, last AS frame, arg_min(e.frame, (list_distance(e.f, q.f), e.frame)) AS nearest FROM q JOIN feat e ON e.subject_id = q.subject_id AND e.frame < last GROUP BY ALL""", "feat"))
def c12_nearest_feature(spark, d):
    return Q.nearest_feature(V.feat(spark, d), KEY, "frame", "f")


_JERSEYS = """, j AS (SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS number, ['dark red', 'red', 'white', NULL][c_custkey % 4 + 1] AS color, c_custkey % 97 AS first_seen, c_custkey % 13 AS frames FROM customer)"""


def _jerseys(spark, d):
    colors = F.array(F.lit("dark red"), F.lit("red"), F.lit("white"), F.lit(None).cast("string"))
    key = F.col("c_custkey")
    return V.table(spark, d, "customer").select(
        key.alias("subject_id"), F.when(key % 5 > 0, F.col("c_nationkey")).alias("number"), F.get(colors, (key % 4).cast("int")).alias("color"), (key % 97).alias("first_seen"), (key % 13).alias("frames")
    )


@query("WITH" + _JERSEYS[1:] + """, w AS (SELECT *, CASE WHEN number IS NULL THEN subject_id ELSE first_value(subject_id) OVER (PARTITION BY number, color ORDER BY first_seen, subject_id) END AS target, sum(frames) OVER (PARTITION BY number, color) AS total FROM j)
SELECT subject_id, target, CASE WHEN target <> subject_id THEN 0 WHEN number IS NULL THEN frames ELSE total END::BIGINT AS frames FROM w""")
def c16_merge_by_jersey(spark, d):
    return Q.merge_by_jersey(_jerseys(spark, d)).select("subject_id", "target", F.col("frames").cast("long").alias("frames"))


@query("WITH" + _JERSEYS[1:] + " SELECT team, unnest(s) AS subject_id FROM (SELECT CASE WHEN color = 'dark red' THEN 'red' ELSE color END AS team, list(subject_id) AS s FROM j WHERE color IS NOT NULL GROUP BY 1)")
def d18_team_by_color(spark, d):
    return Q.team_by_color(_jerseys(spark, d), "subject_id", "color").select("team", F.explode("subjects").alias("subject_id"))


@query(with_views(_sql_segments() + _sql_resampled("5") + """, b AS (SELECT subject_id, phase, dim, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS sd FROM s GROUP BY ALL),
z AS (SELECT subject_id, segment, phase, dim, (v - m) / sd AS z FROM s JOIN b USING (subject_id, phase, dim)),
p AS (SELECT a.subject_id, a.segment, b.segment AS o, sqrt(sum((a.z - b.z) ** 2)) AS d FROM z a JOIN z b ON a.subject_id = b.subject_id AND a.phase = b.phase AND a.dim = b.dim AND a.segment <> b.segment GROUP BY ALL),
q AS (SELECT subject_id, segment, min(d) AS d FROM p GROUP BY ALL)
SELECT subject_id, round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.9), 3) AS p90, round(quantile_cont(d, 0.99), 3) AS p99 FROM q GROUP BY 1""", "feat"))
def d3_distance_calibration(spark, d):
    x = C.resample(_segments(spark, d), SEG, 5).groupBy(*SEG).agg(F.array_sort(F.collect_list(F.struct("phase", "f"))).alias("w"))
    cycles = x.select(*SEG, F.flatten(F.transform("w", lambda w: w["f"])).alias("vector"))
    out = Q.distance_calibration(cycles, KEY, "segment", "vector")
    return out.select("subject_id", *(r(c, 3).alias(c) for c in ("p50", "p90", "p99")))


@query(with_views("""SELECT subject_id, kind, round(avg(x) + 1e-9::DOUBLE, 4) AS mean, round(stddev_pop(x) + 1e-9::DOUBLE, 4) AS std, count(x) AS n, (SELECT round(avg(y.x) FILTER (WHERE y.kind <> 'click') / avg(y.x) FILTER (WHERE y.kind = 'click') + 1e-9::DOUBLE, 4) FROM signal y WHERE y.subject_id = s.subject_id) AS separation FROM signal s GROUP BY ALL""", "signal"))
def d6_gait_summary(spark, d):
    """Scores by subject and gait (here events and their kinds), with each subject's separation of other gaits from the normal one."""
    by, ratio = Q.gait_summary(V.signal(spark, d), "subject_id", "kind", "x", "click")
    return by.join(ratio, KEY).select(*KEY, "kind", "n", *(up(F.col(c)).alias(c) for c in ("mean", "std", "separation")))


@query(with_views(""", n AS (SELECT kind, greatest(k - 90, 0) AS c, count(*) AS n FROM signal GROUP BY ALL) SELECT kind, arg_max(c, (n, -c)) AS cluster FROM n GROUP BY 1""", "signal"))
def d8_label_to_cluster(spark, d):
    s = V.signal(spark, d).withColumn("cluster", F.greatest(F.col("k") - 90, F.lit(-1)))
    return Q.label_to_cluster(s, "kind", "cluster")


@query(with_views("""SELECT subject_id, count(DISTINCT k % 10) AS clusters, CASE WHEN subject_id % 2 = 0 THEN count(DISTINCT k % 10) BETWEEN 9 AND 10 END AS passed FROM signal GROUP BY 1""", "signal"))
def d25_cluster_count_check(spark, d):
    s = V.signal(spark, d).withColumn("cluster", F.col("k") % 10)
    expected = s.filter("subject_id % 2 = 0").select("subject_id", F.lit(9).alias("lo"), F.lit(10).alias("hi")).distinct()
    return Q.cluster_count_check(s, expected, KEY, "cluster")


@query(with_views(""", m AS (SELECT subject_id, frame, min(k % 7) OVER (PARTITION BY subject_id, kind) AS c FROM signal),
b AS (SELECT *, (row_number() OVER w = 1 OR lag(c) OVER w <> c)::INT AS b FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY frame)), i AS (SELECT *, sum(b) OVER (PARTITION BY subject_id ORDER BY frame) AS i FROM b)
SELECT subject_id, c AS cluster, min(frame) AS start, max(frame) AS "end", count(*) AS n FROM i GROUP BY subject_id, i, c""", "signal"))
def d22_merge_clusters_by_label(spark, d):
    s = V.signal(spark, d).withColumn("cluster", F.col("k") % 7)
    return Q.merge_clusters_by_label(s, KEY, "cluster", "kind", "frame", "frame")
