"""Queries of change points, novelty, live alignment and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetiq.operators import density as N
from kinetiq.operators import segmentation as G
from kinetiq.plans import adapters as V
from kinetiq.plans.adapters import with_views
from kinetiq.plans.base import KEY, ORDER, query, r, up

_PARTITION = """, l AS (SELECT subject_id, list(x ORDER BY frame) AS x, count(*) AS n FROM signal GROUP BY 1),
c AS (SELECT subject_id, n, list_prepend(0::DOUBLE, [list_sum(x[1:i]) FOR i IN range(1, n + 1)]) AS s, list_prepend(0::DOUBLE, [list_sum([v * v FOR v IN x[1:i]]) FOR i IN range(1, n + 1)]) AS q, 1500 * ln(n) AS pen FROM l),
z(subject_id, t, f, l) AS (
  SELECT subject_id, 0::BIGINT, [-pen], [0::BIGINT] FROM c
  UNION ALL
  SELECT subject_id, t + 1, list_append(f, b.v), list_append(l, b.s) FROM (
    SELECT z.subject_id, z.t, z.f, z.l, coalesce(list_min([{'v': z.f[k + 1] + c.q[z.t + 2] - c.q[k + 1] - (c.s[z.t + 2] - c.s[k + 1]) ** 2 / (z.t + 1 - k) + pen, 's': k} FOR k IN range(0, z.t + 1 - 5 + 1) IF z.f[k + 1] < 'inf'::DOUBLE]), {'v': 'inf'::DOUBLE, 's': 0::BIGINT}) AS b
    FROM z JOIN c ON z.subject_id = c.subject_id WHERE z.t < c.n)),
e AS (SELECT z.subject_id, t, l FROM z JOIN c ON z.subject_id = c.subject_id AND z.t = c.n),
p(subject_id, l, c) AS (SELECT subject_id, l, l[t + 1] FROM e UNION ALL SELECT subject_id, l, l[c + 1] FROM p WHERE c > 0)
SELECT subject_id, c AS change FROM p WHERE c > 0"""


@query(with_views(_PARTITION, "signal"))
def f28_change_points(spark, d):
    """Stretches of five events or more; the penalty is scaled to values up to 100."""
    s = V.signal(spark, d).withColumn("f", F.array(F.col("x") / 1000**0.5))
    return G.change_points(s, KEY, ["frame"], "f", least=5)


_GAINS = """, w AS (SELECT subject_id, frame, count(x) OVER b AS bn, sum(x) OVER b AS bs, count(x) OVER a AS an, sum(x) OVER a AS s FROM signal
  WINDOW b AS (PARTITION BY subject_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY subject_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT subject_id, frame, CASE WHEN bn = 8 AND an = 8 THEN round((bs / 8 - s / 8) ** 2 * 4 + 1e-9::DOUBLE, 3) END AS gain FROM w"""


@query(with_views(_GAINS, "signal"))
def f28_window_changes(spark, d):
    """Two windows of eight: their gain is four times the square of how far their means are apart."""
    return G.window_changes(V.signal(spark, d), KEY, "frame", "x", 8).select(*KEY, *ORDER, up(F.col("gain"), 3).alias("gain"))


_NOVELTY = """, n AS (SELECT subject_id, count(*) AS n FROM feat GROUP BY 1),
b AS (SELECT a.subject_id, a.frame AS i, b.frame AS j, list_cosine_similarity(a.f, b.f) AS s FROM feat a JOIN feat b ON a.subject_id = b.subject_id AND abs(a.frame - b.frame) < 12),
k AS (SELECT c.subject_id, c.frame, sum(CASE WHEN (b.i < c.frame) = (b.j < c.frame) THEN s ELSE -s END) AS v
  FROM feat c JOIN n USING (subject_id) JOIN b ON b.subject_id = c.subject_id AND b.i >= c.frame - 6 AND b.i < c.frame + 6 AND b.j >= c.frame - 6 AND b.j < c.frame + 6
  WHERE c.frame >= 6 AND c.frame < n - 6 GROUP BY ALL),
t AS (SELECT subject_id, max(abs(v)) AS top FROM k GROUP BY 1)
SELECT f.subject_id, f.frame, round(greatest(0, coalesce(v / top, 0)), 4) AS novelty FROM feat f LEFT JOIN k USING (subject_id, frame) LEFT JOIN t ON t.subject_id = f.subject_id"""


@query(with_views(_NOVELTY, "feat"))
def f29_ssm_novelty(spark, d):
    """The SQL sums the similarities of the band, the query two framed sums of directions."""
    return G.ssm_novelty(V.feat(spark, d), KEY, "frame", "f", 6).select(*KEY, *ORDER, r("novelty").alias("novelty"))


@query()
def f29_novelty_boundaries(spark, d):
    return G.novelty_boundaries(G.ssm_novelty(V.feat(spark, d), KEY, "frame", "f", 6), KEY, "frame")


_LIVE = """, r AS (SELECT subject_id, frame AS phase, f FROM feat WHERE frame < 20), v AS (SELECT subject_id, frame - 20 AS i, f FROM feat WHERE frame >= 20),
n AS (SELECT v.subject_id, v.i, arg_min(r.phase, (list_distance(v.f, r.f), r.phase)) AS nearest FROM v JOIN r USING (subject_id) GROUP BY ALL),
p(subject_id, i, ptr) AS (
  SELECT DISTINCT subject_id, -1::BIGINT, 0::BIGINT FROM v
  UNION ALL
  SELECT subject_id, i, CASE WHEN ptr >= 19 THEN 0 ELSE ptr END FROM (
    SELECT p.subject_id, p.i + 1 AS i, arg_min(r.phase, (list_distance(v.f, r.f), r.phase)) AS ptr
    FROM p JOIN v ON v.subject_id = p.subject_id AND v.i = p.i + 1 JOIN r ON r.subject_id = p.subject_id AND r.phase >= p.ptr AND r.phase < p.ptr + 6 GROUP BY p.subject_id, p.i)),
m AS (SELECT subject_id, 0.3::DOUBLE * median(d) AS slow FROM (SELECT subject_id, list_distance(f, lag(f) OVER (PARTITION BY subject_id ORDER BY phase)) AS d FROM r) WHERE d IS NOT NULL GROUP BY 1),
s AS (SELECT subject_id, i, coalesce(list_distance(f, lag(f) OVER w), 0) AS d FROM v WINDOW w AS (PARTITION BY subject_id ORDER BY i)),
g AS (SELECT s.subject_id, i, i > 0 AND lag(d) OVER w > slow AND d <= slow AS rest FROM s JOIN m USING (subject_id) WINDOW w AS (PARTITION BY s.subject_id ORDER BY i)),
q(subject_id, i, since) AS (
  SELECT DISTINCT subject_id, -1::BIGINT, 0::BIGINT FROM v
  UNION ALL
  SELECT q.subject_id, g.i, CASE WHEN g.rest AND g.i - q.since > 10 THEN g.i ELSE q.since END FROM q JOIN g ON g.subject_id = q.subject_id AND g.i = q.i + 1)
SELECT n.subject_id, n.i + 20 AS frame, nearest, p.ptr AS pointer, least(floor(least((n.i - q.since) / 20, 1.0) * 20)::BIGINT, 19) AS phase
FROM n JOIN p USING (subject_id, i) JOIN q USING (subject_id, i)"""


def _live(spark, d):
    f = V.feat(spark, d).select(*KEY, *ORDER, "f")
    reps = f.filter("frame < 20").select("subject_id", F.col("frame").alias("phase"), "f")
    return f.filter("frame >= 20"), reps


@query(with_views(_LIVE, "feat"))
def f31_align_live(spark, d):
    """Each label's first twenty vectors are the motion that the others are followed through."""
    frames, reps = _live(spark, d)
    found = {k: G.align_live(frames, reps, KEY, "frame", "f", k).select(*KEY, *ORDER, F.col("rep_at").alias(k)) for k in ("nearest", "pointer", "phase")}
    return found["nearest"].join(found["pointer"], [*KEY, *ORDER]).join(found["phase"], [*KEY, *ORDER])


@query()
def f31_align_warp(spark, d):
    frames, reps = _live(spark, d)
    return G.align_live(frames, reps, KEY, "frame", "f", "warp").select(*KEY, *ORDER, "rep_at")


_DENSITY = """, m AS (SELECT dim, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS s FROM (SELECT unnest(range(1, 9)) AS dim, unnest(f[1:8]) AS v FROM feat) GROUP BY 1),
z AS (SELECT vec_id AS id, list((f[dim] - m) / s ORDER BY dim) AS v FROM feat, m GROUP BY vec_id),
n AS (SELECT a.id AS a, b.id AS b FROM z a JOIN z b ON list_distance(a.v, b.v) <= 1.9),
c AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 5),
r(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.other JOIN c ON c.id = n.b),
g AS (SELECT id, min(other) AS first FROM r GROUP BY 1), k AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT DISTINCT first FROM g)),
e AS (SELECT n.a AS id, min(first) AS first FROM n JOIN g ON g.id = n.b WHERE n.a NOT IN (SELECT id FROM c) GROUP BY 1)
SELECT z.id, g.id IS NOT NULL AS core, coalesce(k.cluster, -1)::INT AS cluster FROM z LEFT JOIN g USING (id) LEFT JOIN e USING (id) LEFT JOIN k ON k.first = coalesce(g.first, e.first)"""


@query(with_views(_DENSITY, "feat"))
def f22_dbscan(spark, d):
    """The first eight features of all vectors, z-scored."""
    f = V.feat(spark, d).select("vec_id", F.posexplode(F.slice("f", 1, 8)).alias("dim", "v"))
    fit = f.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))  # eight rows
    scaled = f.join(F.broadcast(fit), "dim").withColumn("z", (F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")))
    points = scaled.groupBy(F.col("vec_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda p: p["z"]).alias("v"))
    return N.dbscan(points, 1.9, 5)
