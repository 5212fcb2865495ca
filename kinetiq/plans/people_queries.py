"""Queries about people in frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetiq.operators import people as O
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORDER, query, r


def _crowd(spark, d):
    """Four people a frame: 17 keypoints and the box around them."""
    own = Window.partitionBy("label").orderBy("vec_id")
    p = V.coco17(spark, d).withColumn("frame", F.floor((F.row_number().over(own) - 1) / 4))
    x, y = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    return p.select(
        F.col("label").alias("seq_id"), "frame", F.col("vec_id").alias("subject_id"), "p", F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2")
    )


@query()
def c3_detect_contacts(spark, d):
    out = O.detect_contacts(_crowd(spark, d), ["seq_id", "frame"], "subject_id", "p")
    return out.select(
        "seq_id", "frame", F.col("a_subject_id").alias("a"), F.col("b_subject_id").alias("b"), r("iou").alias("iou"), r("distance").alias("distance"), "keypoint", "struck", "zone", "coupling"
    )


def _tracks(spark, d):
    own = Window.partitionBy("label").orderBy("vec_id")
    e = V.table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")).withColumn("i", F.row_number().over(own) - 1)
    at = lambda k: F.abs(F.get("v", k))
    e = e.select(
        "vec_id", (F.col("label") * 1000 + F.floor(F.col("i") / 4)).alias("scene"), (F.col("i") % 4).alias("place"), F.slice("v", 1, 32).alias("emb"), F.transform(F.slice("v", 33, 10), F.abs).alias("limbs"),
        at(50).alias("x1"), at(51).alias("y1"), (at(50) + 0.3).alias("x2"), (at(51) + 0.3).alias("y2"), F.floor(at(52) * 400).alias("last_frame"),
    )
    new = e.filter("place = 3").withColumn("track_id", F.col("vec_id")).withColumn("frame", F.lit(60))
    return new, e.filter("place < 3").withColumnRenamed("vec_id", "subject_id").withColumnRenamed("emb", "mean_emb").withColumn("penalty", F.lit(0.0))


_MATCH = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
t AS (SELECT vec_id, label * 1000 + i // 4 AS scene, i % 4 AS place, v[1:32] AS emb, [abs(x) FOR x IN v[33:42]] AS limbs, abs(v[51]) AS x1, abs(v[52]) AS y1, floor(abs(v[53]) * 400) AS last FROM e),
p AS (SELECT n.scene, n.vec_id AS track_id, g.vec_id AS s, 0.8::DOUBLE * list_dot_product(n.emb, g.emb) + 0.2::DOUBLE * list_dot_product(n.limbs, g.limbs) / sqrt(list_dot_product(n.limbs, n.limbs) * list_dot_product(g.limbs, g.limbs)) AS score,
  greatest(0, least(n.x1, g.x1) + 0.3::DOUBLE - greatest(n.x1, g.x1)) * greatest(0, least(n.y1, g.y1) + 0.3::DOUBLE - greatest(n.y1, g.y1)) AS i, 60 - g.last AS age, sqrt((n.x1 - g.x1) ** 2 + (n.y1 - g.y1) ** 2) AS far,
  count(*) OVER (PARTITION BY n.vec_id) AS n FROM t n JOIN t g ON n.scene = g.scene AND n.place = 3 AND g.place < 3),
q AS (SELECT *, i / (0.18::DOUBLE - i) AS iou FROM p),
b AS (SELECT scene, track_id, max(n) AS n, max(score) AS score, arg_max(s, (score, -s)) AS s1, max(iou) FILTER (age <= 90) AS iou, arg_max(s, (iou, -s)) FILTER (age <= 90) AS s2, min(far) FILTER (age <= 30) AS far, arg_min(s, (far, s)) FILTER (age <= 30) AS s3 FROM q GROUP BY ALL)
SELECT t.scene, t.vec_id AS track_id, {choose} FROM t LEFT JOIN b ON b.scene = t.scene AND b.track_id = t.vec_id WHERE place = 3"""


@query(_MATCH.format(choose="""CASE WHEN score >= CASE WHEN n = 1 THEN 0.3 ELSE 0.45 END THEN s1 WHEN iou >= 0.3 THEN s2 WHEN far <= 0.08 THEN s3 END AS subject_id,
CASE WHEN score >= CASE WHEN n = 1 THEN 0.3 ELSE 0.45 END THEN 'appearance' WHEN iou >= 0.3 THEN 'box' WHEN far <= 0.08 THEN 'centre' END AS how"""))
def c14_match_identities(spark, d):
    return O.match_identities(*_tracks(spark, d), ["scene"])


@query(_MATCH.format(choose="CASE WHEN score >= 0.45 THEN s1 END AS subject_id, CASE WHEN score >= 0.45 THEN 'appearance' END AS how"))
def c15_match_cross_cut(spark, d):
    return O.match_identities(*_tracks(spark, d), ["scene"], across_cut=True)


@query(with_views(""", m AS (SELECT label, q FROM (SELECT label, unnest(p) AS q FROM marks33) WHERE q.v > 0.3)
SELECT label, round(greatest(0, min(q.x) - 0.05), 4) AS x1, round(greatest(0, min(q.y) - 0.05), 4) AS y1, round(least(1, max(q.x) + 0.05), 4) AS x2, round(least(1, max(q.y) + 0.05), 4) AS y2 FROM m GROUP BY 1""", "marks33"))
def d11_cluster_bbox(spark, d):
    b = O.cluster_bbox(V.marks33(spark, d), ["label"], "p")
    return b.select("label", *(r(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(with_views("SELECT subject_id, kind, frame, row_number() OVER (PARTITION BY subject_id, kind ORDER BY frame) - 1 AS i FROM signal", "signal"))
def d11_cluster_frame_indices(spark, d):
    out = O.cluster_frame_indices(V.signal(spark, d), ["subject_id", "kind"], "frame")
    return out.select("subject_id", "kind", F.posexplode("frames").alias("i", "frame"))


@query(with_views(""", c AS (SELECT l_suppkey AS struck, l_partkey AS striker, speed / 20 AS p, speed AS dv FROM impact_rows),
u AS (SELECT struck AS person, p, dv FROM c UNION ALL SELECT striker, p / 2, dv FROM c), b AS (SELECT person, count(*) AS contacts, max(p) AS p, sum(dv) AS dv FROM u GROUP BY 1),
k AS (SELECT l_suppkey AS person, max(mass_a) AS g FROM impact_rows GROUP BY 1)
SELECT person, coalesce(contacts, 0) AS contacts, round(coalesce(p, 0), 4) AS p, round(coalesce(dv, 0), 3) AS delta_v, round(coalesce(g, 0), 3) AS peak_g, coalesce(dv, 0) >= 40 AS flagged,
  CASE WHEN coalesce(g, 0) < 40 THEN 'LOW' WHEN g < 75 THEN 'MODERATE' ELSE 'HIGH' END AS level FROM b FULL JOIN k USING (person)""", "impact_rows"))
def d16_monitor_report(spark, d):
    i = V.impact_rows(spark, d)
    contacts = i.select(F.col("l_suppkey").alias("struck"), F.col("l_partkey").alias("striker"), (F.col("speed") / 20).alias("p"), F.col("speed").alias("delta_v"))
    out = O.monitor_report(contacts, i.select(F.col("l_suppkey").alias("person"), F.col("mass_a").alias("peak_g")))
    return out.select("person", "contacts", r("p").alias("p"), r("delta_v", 3).alias("delta_v"), r("peak_g", 3).alias("peak_g"), "flagged", "level")


@query("""WITH k AS (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings),
l AS (SELECT label, k, unnest(range(64)) AS dim, unnest(v) AS v FROM k WHERE k <= 40), m AS (SELECT label, dim, avg(v) AS m FROM l GROUP BY ALL),
n AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM m), d AS (SELECT label, k, sum(v * m) AS d FROM l JOIN n USING (label, dim) GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(d), 4) AS consistency, CASE WHEN avg(d) >= 0.65 THEN 'confirmed' WHEN avg(d) >= 0.45 THEN 'tentative' ELSE 'unknown' END AS status FROM d GROUP BY 1""")
def d17_gallery_stats(spark, d):
    e = V.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return O.gallery_stats(e, ["label"], "vec_id", "v").withColumn("consistency", r("consistency"))


@query(with_views(""", s AS (SELECT subject_id, frame, x, 0.25::DOUBLE * coalesce(lag(x) OVER w, x) + 0.5::DOUBLE * x + 0.25::DOUBLE * coalesce(lead(x) OVER w, x) AS s, 50::DOUBLE AS truth, k > 80 AS spike FROM signal WINDOW w AS (PARTITION BY subject_id ORDER BY frame)),
j AS (SELECT *, abs(s - 3 * lag(s) OVER w + 3 * lag(s, 2) OVER w - lag(s, 3) OVER w) * 27000 AS j FROM s WINDOW w AS (PARTITION BY subject_id ORDER BY frame))
SELECT subject_id, round(avg((s - truth) ** 2), 3) AS mse, round(avg(j) / 1000, 3) AS jerk, round(coalesce(avg((abs(s - truth) < abs(x - truth))::INT) FILTER (spike) * 100, 100), 3) AS removed FROM j GROUP BY 1""", "signal"))
def d24_smoothing_metrics(spark, d):
    own = Window.partitionBy("subject_id").orderBy("frame")
    side = lambda k: F.coalesce(F.lag("x", k).over(own), F.col("x"))
    s = V.signal(spark, d).withColumns({"s": 0.25 * side(1) + 0.5 * F.col("x") + 0.25 * side(-1), "truth": F.lit(50.0), "spike": F.col("k") > 80})
    out = O.smoothing_metrics(s, KEY, ORDER, "s", "truth", "x", "spike")
    return out.select("subject_id", r("mse", 3).alias("mse"), r(F.col("jerk") / 1000, 3).alias("jerk"), r("removed", 3).alias("removed"))


@query()
def f21_kmeans_cycles(spark, d):
    """Numbers of rows by cluster and label: cluster numbers are those of the fixed seed."""
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return O.kmeans_cycles(e, "v", 6).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query()
def f24_project_3d(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = O.project_3d(e, "v")
    return p.select("vec_id", *(r(F.get("place", i)).alias(c) for i, c in enumerate("xyz")))


@query(with_views("""SELECT subject_id, frame, CASE WHEN frame < 10 THEN false WHEN frame < 60 THEN frame - k % 60 >= 30 WHEN frame < 300 THEN frame - k % 60 >= 45 ELSE frame - k % 60 >= 60 END AS due FROM signal""", "signal"))
def h7_reanalysis_due(spark, d):
    return V.signal(spark, d).select(*KEY, *ORDER, O.needs_reanalysis(F.col("frame"), F.col("k") % 60).alias("due"))


@query(with_views(""", l AS (SELECT seq_id, subject_id, max(frame) AS last FROM boxes GROUP BY ALL), m AS (SELECT *, max(last) OVER (PARTITION BY seq_id) - last AS gone FROM l)
SELECT seq_id, subject_id, last AS last_frame, CASE WHEN gone <= 0 THEN 'active' WHEN gone <= 1 THEN 'missing' ELSE 'expired' END AS status FROM m""", "boxes"))
def h8_expire_subjects(spark, d):
    return O.expire_subjects(V.boxes(spark, d), ["seq_id"], "subject_id", "frame", gone=1, active=0)


@query("""SELECT o_custkey AS user_id, o_orderkey AS workout_id, o_orderpriority AS label FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)""")
def g7_lookup(spark, d):
    """Rows of the stated ids: here each user's largest workout id."""
    w = V.workout_rows(spark, d)
    ids = w.groupBy("user_id").agg(F.max("workout_id").alias("workout_id")).select("workout_id")
    return O.lookup(w, ids, ["workout_id"]).select("user_id", "workout_id", "label")
