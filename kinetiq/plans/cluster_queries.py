"""Queries of clip reports, outliers, and clusters of segments, cycles and players."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinetiq.operators import clusters as C
from kinetiq.operators import heads as H
from kinetiq.operators import joins as J
from kinetiq.operators import outliers as O
from kinetiq.operators import sequences as Q
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORDER, query, r
from kinetiq.plans.sequence_queries import SEG, _segments, _sql_resampled, _sql_segments


def _filled(*columns: str) -> str:
    """Interpolation of columns of ``raw``, each as a table of its own."""
    parts = []
    for c in columns:
        parts.append(f"""{c}p AS (SELECT subject_id, frame, {c} AS y, last_value({c} IGNORE NULLS) OVER b AS y0, first_value({c} IGNORE NULLS) OVER a AS y1,
  last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS x0, first_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS x1 FROM raw
  WINDOW b AS (PARTITION BY subject_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY subject_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{c}f AS (SELECT subject_id, frame, coalesce(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (frame - x0) / (x1 - x0) END, y0, y1, 0) AS {c} FROM {c}p)""")
    return ", ".join(parts)


_CLIP = f""", raw AS (SELECT subject_id, frame, CASE WHEN k % 7 <> 0 THEN x / 4 END AS hx, CASE WHEN k % 7 <> 0 THEN 40 + k / 9.0::DOUBLE END AS hy, CASE WHEN k % 5 <> 0 THEN x / 4 + k / 50.0::DOUBLE END AS nx, CASE WHEN k % 5 <> 0 THEN 60 + x / 30 END AS ny,
  CASE WHEN k % 3 = 0 THEN 'FRONT' ELSE 'SIDE' END AS side FROM signal), {_filled("hx", "hy", "nx", "ny")},
f AS (SELECT *, sqrt((hx - nx) ** 2 + (hy - ny) ** 2) AS far, atan2(hy - ny, hx - nx) AS a, count(*) OVER (PARTITION BY subject_id) AS n FROM hxf JOIN hyf USING (subject_id, frame) JOIN nxf USING (subject_id, frame) JOIN nyf USING (subject_id, frame)),
m AS (SELECT subject_id, coalesce(0.24::DOUBLE / greatest(median(far) FILTER (WHERE far > 1), 1e-3::DOUBLE), 0.004::DOUBLE) AS m FROM f GROUP BY 1),
s AS (SELECT f.subject_id, frame, n, coalesce(sqrt((hx - lag(hx) OVER w) ** 2 + (hy - lag(hy) OVER w) ** 2) * m * 240, 0) AS s, a - lag(a) OVER w AS d FROM f JOIN m USING (subject_id) WINDOW w AS (PARTITION BY f.subject_id ORDER BY frame)),
t AS (SELECT *, coalesce(degrees(abs(d - CASE WHEN abs(d) > pi() THEN 2 * pi() * round(d / (2 * pi())) ELSE 0 END)) * 240, 0) AS r FROM s),
u AS (SELECT subject_id, frame, CASE WHEN n >= 5 THEN 0.25::DOUBLE * coalesce(lag(s) OVER w, 0) + 0.5::DOUBLE * s + 0.25::DOUBLE * coalesce(lead(s) OVER w, 0) ELSE s END AS s,
  CASE WHEN n >= 5 THEN 0.25::DOUBLE * coalesce(lag(r) OVER w, 0) + 0.5::DOUBLE * r + 0.25::DOUBLE * coalesce(lead(r) OVER w, 0) ELSE r END AS r FROM t WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
v AS (SELECT *, s >= 3 OR r >= 1200 AS hit, s / 7 + r / 3000 AS worst FROM u),
i AS (SELECT *, frame - row_number() OVER (PARTITION BY subject_id, hit ORDER BY frame) AS g FROM v),
g AS (SELECT subject_id, g, max(s) AS s, max(r) AS r, count(*) AS n, max(worst) AS w, arg_max(frame, (worst, -frame)) AS "at", min(frame) AS start FROM i WHERE hit GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY w DESC, start) = 1),
o AS (SELECT subject_id, b."at" IS NOT NULL AS hit, coalesce(b.s, z.s) AS s, coalesce(b.r, z.r) AS r, coalesce(b.n / 240 * 1000, 0) AS ms, coalesce(b."at", -1) AS "at" FROM (SELECT subject_id, max(s) AS s, max(r) AS r FROM u GROUP BY 1) z LEFT JOIN b USING (subject_id))
SELECT o.subject_id, hit AS impact_detected, CASE WHEN s > 7 OR r > 3000 THEN 'HIGH' WHEN hit AND (s > 4 OR r > 1500) THEN 'MODERATE' ELSE 'LOW' END AS risk_level, round(s, 4) AS linear_ms, round(r, 3) AS rotational_degs, round(ms, 3) AS duration_ms, o."at" AS frame_of_impact,
  CASE WHEN hit THEN side ELSE 'UNKNOWN' END AS location FROM o LEFT JOIN raw ON raw.subject_id = o.subject_id AND raw.frame = o."at" """


@query(with_views(_CLIP, "signal"))
def f20_clip_report(spark, d):
    x, k = F.col("x"), F.col("k")
    point = lambda c, a, b: F.when(c, F.struct(a.alias("x"), b.alias("y")))
    s = V.signal(spark, d).select(
        *KEY, *ORDER, point(k % 7 != 0, x / 4, 40 + k / 9).alias("head"), point(k % 5 != 0, x / 4 + k / 50, 60 + x / 30).alias("neck"), F.when(k % 3 == 0, "FRONT").otherwise("SIDE").alias("side")
    )
    out = H.clip_report(s, KEY, "frame", "head", "neck", "side")
    return out.select(*KEY, "impact_detected", "risk_level", r("linear_ms").alias("linear_ms"), r("rotational_degs", 3).alias("rotational_degs"), r("duration_ms", 3).alias("duration_ms"), "frame_of_impact", "location")


@query()
def f23_isolation_score(spark, d):
    s = V.signal(spark, d).select(*KEY, *ORDER, F.array("x", F.col("k").cast("double"), F.coalesce("velocity", F.lit(0.0))).alias("f"))
    return O.isolation_score(s, KEY, ORDER, "f").select(*KEY, *ORDER, r(F.when(~F.isnan("isolation"), F.col("isolation"))).alias("isolation"))


@query()
def f25_team_kmeans(spark, d):
    """Players are vectors: a label's first game, histograms of 16 bins and a colour."""
    e = V.table(spark, d, "embeddings").select(F.col("label").alias("game_id"), F.col("vec_id").alias("player_id"), F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 19), lambda v: F.abs(v)).alias("e"))
    players = e.select("game_id", "player_id", F.slice("e", 1, 16).alias("histogram"), F.slice("e", 17, 3).alias("color"))
    out = C.team_kmeans(players, ["game_id"], "player_id", "histogram", "color")
    return out.select("game_id", "player_id", "team", r(F.get("team_color", 0)).alias("hue"))


def _vectors(spark, d):
    return V.feat(spark, d).select("vec_id", F.slice("f", 1, 4).alias("v"))


@query()
def f26_gmm_clusters(spark, d):
    return C.model_clusters(_vectors(spark, d), "vec_id", "v", "gmm", most=4).select("vec_id", "cluster")


@query()
def f26_kmeans_clusters(spark, d):
    return C.model_clusters(_vectors(spark, d), "vec_id", "v", "kmeans", most=5).select("vec_id", "cluster")


_RUNS = """SELECT user_id // 15 AS seq_id, user_id AS item, run, CASE run WHEN 0 THEN n % 3 WHEN 1 THEN floor(v / 5)::BIGINT WHEN 2 THEN e % 4 ELSE user_id % 2 END AS cluster
FROM (SELECT user_id, count(*) AS n, avg(value) AS v, min(event_id) AS e FROM events GROUP BY 1), range(4) t(run)"""


@query(f"WITH r AS ({_RUNS}) SELECT a.seq_id, a.item AS a, b.item AS b, round(count(*) / 4, 4) AS share FROM r a JOIN r b ON a.seq_id = b.seq_id AND a.run = b.run AND a.cluster = b.cluster AND a.item < b.item GROUP BY ALL")
def f26_co_association(spark, d):
    """Four ways to cluster the subjects of a group."""
    e = V.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.min("event_id").alias("e"))
    ways = F.array((F.col("n") % 3).cast("long"), F.floor(F.col("v") / 5).cast("long"), (F.col("e") % 4).cast("long"), (F.col("user_id") % 2).cast("long"))
    runs = e.select(F.expr("user_id div 15").alias("seq_id"), F.col("user_id").alias("item"), F.posexplode(ways).alias("run", "cluster"))
    return C.co_association(runs, ["seq_id"], "item").withColumn("share", r("share"))


@query()
def f26_spectral_clusters(spark, d):
    spectra = Q.segment_spectra(_segments(spark, d), SEG)
    return C.spectral_segments(spectra, KEY, "segment", lambda d: np.exp(-((d / 0.1) ** 2) / 2))


@query()
def f30_adaptive_resegment(spark, d):
    """Stretches of five rows a second; keys whose stretches are nearly all alike get longer ones."""
    f = V.feat(spark, d)

    def segmented(rows, seconds):
        size = int(5 * seconds)
        marks = rows.filter(f"frame % {size} = 0").select("subject_id", F.col("frame").alias("boundary"))
        segments = Q.segment_motions(rows, marks, KEY, "frame", "frame", "f")
        inside = J.within(rows, segments.select(*SEG, "start_valid", "end_valid"), KEY, "frame", "start_valid", "end_valid")
        inside = inside.withColumns({"at": F.expr("frame - start_valid"), "length": F.expr("end_valid - start_valid")})
        return Q.cluster_segments(segments, Q.segment_spectra(inside, SEG), KEY, threshold=0.11, fps=30.0)

    return C.adaptive_resegment(f, KEY, segmented, share=0.5, many=3).select(*KEY, "start_valid", "end_valid", "cluster", "run")


@query()
def f32_online_clusters(spark, d):
    flat = C.segment_features(_segments(spark, d, 5), SEG, "flat", points=5)
    merged = C.online_clusters(flat, KEY, ["segment"], "vector", 5, "merge", threshold=0.85)
    return merged.select(*SEG, "cluster", "clusters")


_LEVELS = C.wavelet_matrix(30)
_ROWS = "[" + ", ".join("[" + ", ".join(f"({float(v)!r})::DOUBLE" for v in _LEVELS[i]) + "]" for i in (0, 9, 20, 47)) + "]"


@query(with_views(_sql_segments() + _sql_resampled("30") + f""", x AS (SELECT subject_id, segment, dim, list(v ORDER BY phase) AS x, avg(v) AS m, stddev_pop(v) AS sd FROM s GROUP BY ALL),
mo AS (SELECT *, list_avg([((v - m) / sd) ** 3 FOR v IN x]) AS skew, list_avg([((v - m) / sd) ** 4 FOR v IN x]) - 3 AS kurtosis FROM x)
SELECT subject_id, segment, dim, round(m, 4) AS mean, round(sd, 4) AS std, round(skew, 3) AS skew, round(kurtosis, 3) AS kurtosis, round(list_dot_product(x, w[1]), 4) AS a0, round(list_dot_product(x, w[2]), 4) AS d3, round(list_dot_product(x, w[3]), 4) AS d2, round(list_dot_product(x, w[4]), 4) AS d1
FROM mo, (SELECT {_ROWS} AS w)""", "feat"))
def f33_segment_features(spark, d):
    """Moments and a coefficient of each level of the wavelet transform, by dimension."""
    f = _segments(spark, d)
    moments = C.segment_features(f, SEG, "statistics").select(*SEG, F.col("vector").alias("m"))
    waves = C.segment_features(f, SEG, "wavelet").select(*SEG, F.col("vector").alias("w"))
    rows = moments.join(waves, SEG).select("*", F.explode(F.sequence(F.lit(0), F.lit(27))).alias("dim"))
    m = {n: r(F.get("m", F.col("dim") + 28 * i), 4 if i < 2 else 3).alias(n) for i, n in enumerate(("mean", "std", "skew", "kurtosis"))}
    w = {n: r(F.get("w", F.col("dim") * 48 + i)).alias(n) for n, i in (("a0", 0), ("d3", 9), ("d2", 20), ("d1", 47))}
    return rows.select(*SEG, "dim", *m.values(), *w.values())
