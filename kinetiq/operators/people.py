"""People in frames: contacts, identities, clusters' boxes, reports and who is still there."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetiq.functions import physics as P
from kinetiq.functions.geometry import bbox_iou, let
from kinetiq.functions.skeleton import SEEN, head_center
from kinetiq.operators.joins import pairs_in_frame

_BODY = tuple(range(5, 17))
_TORSO = (5, 6, 11, 12)


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def head_to_body(head: Column, body: Column) -> Column:
    """(distance, keypoint) of a head to the nearest seen body keypoint of another, or to the middle of its torso, which
    counts as a hip; null without either."""
    near = lambda i: F.struct(_apart(F.get(body, i), head).alias("d"), F.lit(i).alias("k"), (F.get(body, i)["c"] >= SEEN).alias("seen"))
    seen_points = F.filter(F.array(*map(near, _BODY)), lambda p: p["seen"])
    nearest = F.array_min(F.transform(seen_points, lambda p: F.struct(p["d"].alias("d"), p["k"].alias("k"))))
    mean = lambda seen, c: F.aggregate(seen, F.lit(0.0), lambda s, p: s + p[c]) / F.size(seen)
    middle = lambda seen: F.when(F.size(seen) >= 2, F.sqrt(F.pow(mean(seen, "x") - head["x"], 2) + F.pow(mean(seen, "y") - head["y"], 2)))
    torso = let(F.filter(F.array(*(F.get(body, i) for i in _TORSO)), lambda p: p["c"] >= SEEN), middle)

    def nearer(s):
        inside = F.coalesce(s["torso"] < s["nearest"]["d"], F.lit(False))
        return F.when(inside, F.struct(s["torso"].alias("d"), F.lit(11).alias("k"))).otherwise(s["nearest"])

    found = let(F.struct(torso.alias("torso"), nearest.alias("nearest")), lambda s: F.when(s["nearest"].isNotNull(), nearer(s)))
    return F.when(head.isNotNull(), found)


def detect_contacts(df: DataFrame, keys: list[str], subject: str, points: str, least: float = 0.05, part: float = 0.5) -> DataFrame:
    """Contacts of two people of a frame: (keys, a_*, b_*, iou, distance, keypoint, struck, zone, coupling).

    ``df`` has boxes x1 .. y2 and 17 keypoints (x, y, c). Boxes have to overlap; then the nearer of the two ways from a head
    to the other's body counts, or the way between the heads if that is shorter; it has to be within ``part`` of the boxes'
    mean diagonal. ``struck`` is the one whose head it is (the first, between heads).
    """
    pairs = pairs_in_frame(df.withColumn("head", head_center(F.col(points))), keys, subject)
    pairs = pairs.withColumn("iou", bbox_iou("a_", "b_")).filter(F.col("iou") >= least)
    ab, ba = head_to_body(F.col("a_head"), F.col(f"b_{points}")), head_to_body(F.col("b_head"), F.col(f"a_{points}"))
    pairs = pairs.withColumn("_ab", ab).withColumn("_ba", ba).withColumn("_hh", _apart(F.col("a_head"), F.col("b_head")))
    first = F.col("_ab").isNotNull() & (F.col("_ba").isNull() | (F.col("_ab.d") <= F.col("_ba.d")))
    body = F.when(first, F.col("_ab")).otherwise(F.col("_ba"))
    heads = F.col("_hh").isNotNull() & (body.isNull() | (F.col("_hh") < body["d"]))
    pairs = pairs.withColumn("distance", F.when(heads, F.col("_hh")).otherwise(body["d"])).withColumn("keypoint", F.when(heads, 0).otherwise(body["k"]))
    pairs = pairs.withColumn("struck", F.when(heads | first, F.col(f"a_{subject}")).otherwise(F.col(f"b_{subject}")))
    diagonal = lambda p: F.sqrt(F.pow(F.col(f"{p}_x2") - F.col(f"{p}_x1"), 2) + F.pow(F.col(f"{p}_y2") - F.col(f"{p}_y1"), 2))
    mean = (diagonal("a") + diagonal("b")) / 2
    near = pairs.filter((mean > 0) & (F.col("distance") <= part * mean))
    zone = P.contact_zone(F.col("keypoint"))
    return near.withColumn("zone", zone["zone"]).withColumn("coupling", zone["coupling"]).drop("_ab", "_ba", "_hh")


#: The weight of body proportions, thresholds of the score (one gallery alone, small scene), of the overlap
#: and of the distance between centres, and the frames for which the latter two hold.
PROPORTIONS, MATCH, MATCH_ALONE, SMALL_SCENE, IOU, IOU_AGE, CENTRES, CENTRES_AGE = 0.2, 0.45, 0.30, 3, 0.3, 90, 0.08, 30


def match_identities(new: DataFrame, galleries: DataFrame, keys: list[str], across_cut: bool = False) -> DataFrame:
    """(keys, track_id, subject_id, how): which known subject a new track is, each track judged alone.

    ``new(keys, track_id, emb, limbs, x1 .. y2, frame)`` meets ``galleries(keys, subject_id, mean_emb, limbs, x1 .. y2,
    last_frame, penalty)`` of the subjects that are free. The best score of appearance and proportions counts if it is over
    its threshold; else (not across a cut) the box that overlaps most, of recent ones, else the nearest centre.
    """
    g = galleries.select(*keys, *(F.col(c).alias(f"g_{c}") for c in galleries.columns if c not in keys))
    size = Window.partitionBy(*keys)
    g = g.withColumn("_n", F.count("*").over(size))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    length = lambda a: F.sqrt(dot(a, a))
    limbs = F.coalesce(F.try_divide(dot("n_limbs", "g_limbs"), length("n_limbs") * length("g_limbs")), F.lit(0.0))
    met = n.join(g, keys)  # a frame's new tracks by its scene's few galleries
    score = (1 - PROPORTIONS) * dot("n_emb", "g_mean_emb") + PROPORTIONS * limbs - F.coalesce("g_penalty", F.lit(0.0))
    met = met.withColumn("score", F.when(length("n_emb") >= 1e-8, score))
    met = met.withColumn("iou", bbox_iou("n_", "g_")).withColumn("age", F.col("n_frame") - F.col("g_last_frame"))
    middle = lambda p, c: (F.col(f"{p}_{c}1") + F.col(f"{p}_{c}2")) / 2
    met = met.withColumn("far", F.sqrt(F.pow(middle("n", "x") - middle("g", "x"), 2) + F.pow(middle("n", "y") - middle("g", "y"), 2)))
    who = F.col("g_subject_id")
    best = lambda value, ok: F.max(F.when(ok & value.isNotNull(), F.struct(value.alias("v"), (-who).alias("s"))))
    alone = (F.col("_n") == 1) & F.lit(not across_cut)
    found = met.groupBy(*keys, "n_track_id").agg(
        best(F.col("score"), F.lit(True)).alias("a"), best(F.col("iou"), F.col("age") <= IOU_AGE).alias("b"), best(-F.col("far"), F.col("age") <= CENTRES_AGE).alias("c"),
        F.when(F.max(alone), MATCH_ALONE).otherwise(MATCH).alias("least"),
    )
    by_score, by_box, by_centre = F.col("a.v") >= F.col("least"), F.col("b.v") >= IOU, F.col("c.v") >= -CENTRES
    if across_cut:
        by_box = by_centre = F.lit(False)
    chosen = F.when(by_score, -F.col("a.s")).when(by_box, -F.col("b.s")).when(by_centre, -F.col("c.s"))
    how = F.when(by_score, "appearance").when(by_box, "box").when(by_centre, "centre")
    return new.select(*keys, "track_id").join(found.withColumnRenamed("n_track_id", "track_id"), [*keys, "track_id"], "left").select(*keys, "track_id", chosen.alias("subject_id"), how.alias("how"))


def gallery_stats(embeddings: DataFrame, keys: list[str], order: str, vector: str, most: int = 40) -> DataFrame:
    """(keys, n, consistency, status): of the last ``most`` embeddings the mean dot product with their normalised mean
    (0 below two), and what that makes of an identity: unknown, tentative from 0.45, confirmed from 0.65."""
    own = Window.partitionBy(*keys)
    rows = embeddings.withColumn("_k", F.row_number().over(own.orderBy(F.desc(order)))).filter(F.col("_k") <= most)
    long = rows.select(*keys, "_k", F.posexplode(vector).alias("dim", "v"))
    mean = long.groupBy(*keys, "dim").agg(F.avg("v").alias("m"))
    mean = mean.withColumn("m", F.try_divide(F.col("m"), F.sqrt(F.sum(F.col("m") * F.col("m")).over(own))))
    dots = long.join(mean, [*keys, "dim"]).groupBy(*keys, "_k").agg(F.sum(F.col("v") * F.col("m")).alias("d"))
    out = dots.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("_c"))
    out = out.withColumn("consistency", F.when(F.col("n") < 2, 0.0).otherwise(F.col("_c"))).drop("_c")
    status = F.when(F.col("consistency") >= 0.65, "confirmed").when(F.col("consistency") >= 0.45, "tentative").otherwise("unknown")
    return out.withColumn("status", status)


def cluster_bbox(frames: DataFrame, keys: list[str], marks: str, width: float = 1.0, height: float = 1.0, pad: float = 0.05) -> DataFrame:
    """(keys, x1, y1, x2, y2): the padded box of all seen landmarks of a cluster's frames, within the picture."""
    seen = frames.select(*keys, F.explode(marks).alias("m")).filter(F.col("m.v") > SEEN)
    low = lambda c, s: F.greatest(F.lit(0.0), F.min(F.col(f"m.{c}") / s) - pad)
    high = lambda c, s: F.least(F.lit(1.0), F.max(F.col(f"m.{c}") / s) + pad)
    return seen.groupBy(*keys).agg(low("x", width).alias("x1"), low("y", height).alias("y1"), high("x", width).alias("x2"), high("y", height).alias("y2"))


def cluster_frame_indices(frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, frames): a cluster's frames in order."""
    return frames.groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("frames"))


def monitor_report(contacts: DataFrame, peaks: DataFrame, limit: float = 40.0) -> DataFrame:
    """Per person: contacts, largest probability, peak g and the changes of speed together, flagged from ``limit``.

    ``contacts(struck, striker, p, delta_v)`` count whole for the struck and with half their probability for the striker;
    ``peaks(person, peak_g)`` come from the person's own movement. Everyone in either is listed.
    """
    struck = contacts.select(F.col("struck").alias("person"), "p", "delta_v")
    striker = contacts.select(F.col("striker").alias("person"), (F.col("p") * 0.5).alias("p"), "delta_v")
    by = struck.unionByName(striker).groupBy("person").agg(F.count("*").alias("contacts"), F.max("p").alias("p"), F.sum("delta_v").alias("delta_v"))
    out = peaks.groupBy("person").agg(F.max("peak_g").alias("peak_g")).join(by, "person", "full")
    out = out.fillna({"contacts": 0, "p": 0.0, "delta_v": 0.0, "peak_g": 0.0})
    return out.withColumn("flagged", F.col("delta_v") >= limit).withColumn("level", P.risk_of_g(F.col("peak_g")))


def smoothing_metrics(df: DataFrame, keys: list[str], order: list[str], smooth: str, truth: str, noisy: str, spike: str, fps: float = 30.0) -> DataFrame:
    """Per key: mean square error to the truth, mean size of the third derivative, and the percentage of spikes that came
    nearer to the truth (100 without spikes)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    lag = lambda k: F.lag(smooth, k).over(own)
    rows = df.withColumn("_j", F.abs(F.col(smooth) - 3 * lag(1) + 3 * lag(2) - lag(3)) * fps**3)
    nearer = F.abs(F.col(smooth) - F.col(truth)) < F.abs(F.col(noisy) - F.col(truth))
    removed = F.avg(F.when(F.col(spike), nearer.cast("double"))) * 100
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col(smooth) - F.col(truth), 2)).alias("mse"), F.avg("_j").alias("jerk"), F.coalesce(removed, F.lit(100.0)).alias("removed"))


def needs_reanalysis(frames: Column, last: Column) -> Column:
    """Whether a subject with so many frames, ``last`` of them analysed, is due: every 30, 45 or 60 frames as it grows."""
    return F.when(frames < 10, False).when(frames < 60, frames - last >= 30).when(frames < 300, frames - last >= 45).otherwise(frames - last >= 60)


def expire_subjects(seen: DataFrame, keys: list[str], subject: str, frame: str, gone: int = 90, active: int = 45) -> DataFrame:
    """(keys, subject, last_frame, status) at each sequence's last frame: active within ``active`` frames, expired after ``gone``."""
    last = seen.groupBy(*keys, subject).agg(F.max(frame).alias("last_frame"))
    missing = F.max("last_frame").over(Window.partitionBy(*keys)) - F.col("last_frame")
    return last.withColumn("status", F.when(missing <= active, "active").when(missing <= gone, "missing").otherwise("expired"))


def _vectors(df: DataFrame, column: str) -> DataFrame:
    clean = F.transform(column, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    return df.withColumn("_v", array_to_vector(clean))


def kmeans_cycles(df: DataFrame, vector: str, k: int = 6, seed: int = 42) -> DataFrame:
    """``cluster`` by k-means over z-scored vectors; numbers that are none count as 0."""
    rows = _vectors(df, vector)
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(scaled).transform(scaled).drop("_v", "_z")


def project_3d(df: DataFrame, vector: str) -> DataFrame:
    """``place``: the first three principal components, for display; the largest loading of each is positive."""
    rows = _vectors(df, vector)
    model = PCA(k=3, inputCol="_v", outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    signs = [float(np.sign(column[np.abs(column).argmax()]) or 1.0) for column in loadings.T]
    turned = F.zip_with(vector_to_array("_p"), F.array(*map(F.lit, signs)), lambda v, s: v * s)
    return model.transform(rows).withColumn("place", turned).drop("_v", "_p")


def lookup(df: DataFrame, ids: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The rows of the given ids, sorted where an order is given."""
    found = df.join(ids.select(*keys).distinct(), keys, "left_semi")
    return found.orderBy(*order) if order else found
