"""Landmark layouts, body frames and readings of single frames as Column expressions over arrays of joints."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetiq.functions.geometry import let

# Landmark numbers of the layouts. 33 landmarks, 17 and 133 keypoints.
COCO17_TO_33 = {0: 0, 3: 7, 4: 8, 5: 11, 6: 12, 7: 13, 8: 14, 9: 15, 10: 16, 11: 23, 12: 24, 13: 25, 14: 26, 15: 27, 16: 28}
FEET = {31: 27, 32: 28}
WHOLE133_TO_33 = {
    0: 0, 5: 11, 6: 12, 7: 13, 8: 14, 9: 15, 10: 16, 11: 23, 12: 24, 13: 25, 14: 26, 15: 27, 16: 28,
    17: 31, 18: 31, 19: 29, 20: 32, 21: 32, 22: 30, 23: 7, 39: 8, 84: 9, 78: 10,
}
WHOLE133_FACE = {1: 2, 2: 5, 3: 7, 4: 8}
M33_TO_COCO17 = (0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)
LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_HIP, RIGHT_HIP = 11, 12, 23, 24
ANCHORS = (LEFT_HIP, RIGHT_HIP, LEFT_SHOULDER, RIGHT_SHOULDER)
#: Limb lengths in hip widths, in the order of the chain.
CHAIN = (
    (11, 13, 1.20), (12, 14, 1.20), (13, 15, 1.05), (14, 16, 1.05), (23, 25, 1.60), (24, 26, 1.60), (25, 27, 1.50), (26, 28, 1.50),
)
#: Joints that a slim projection keeps.
SPARSE = (0, 1, 2, 3, 4, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28, 31, 32)
#: Mass fraction of the trunk and of segments of the 14 joints; a segment's centre is 43 % along it.
TRUNK_MASS, CENTRE = 0.497, 0.43
SEGMENT_MASSES = {
    (0, 2): 0.028, (1, 3): 0.028, (2, 4): 0.016, (3, 5): 0.016, (6, 8): 0.1, (7, 9): 0.1, (8, 10): 0.0465, (9, 11): 0.0465,
    (10, 12): 0.0145, (11, 13): 0.0145,
}
BONES = ((0, 2), (1, 3), (2, 4), (3, 5), (6, 8), (7, 9), (8, 10), (9, 11))
HEAD = (0, 1, 2, 3, 4)
SEEN = 0.3
#: Fixed values of the scale: widths in metres, and the range of a plausible height.
SHOULDERS_M, TORSO_M, DEFAULT_M, HEIGHT_M, HEIGHTS_M = 0.45, 0.50, 0.004, 1.75, (1.5, 2.1)


def _mark(x, y, z, v) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), v.cast("double").alias("v"))


_NOTHING = lambda: _mark(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


def coco17_to_33(points: Column) -> Column:
    """17 keypoints (x, y, c) as 33 landmarks (x, y, z = 0, v); feet stand at the ankles, the others are zero."""
    at = {m: c for c, m in COCO17_TO_33.items()}
    at |= {foot: at[ankle] for foot, ankle in FEET.items()}
    take = lambda k: _mark(k["x"], k["y"], F.lit(0.0), k["c"])
    return F.array(*(take(F.get(points, at[m])) if m in at else _NOTHING() for m in range(33)))


def whole133_to_33(points: Column) -> Column:
    """133 keypoints (x, y, z, c) as 33 landmarks: of the keypoints of a landmark the surest, the first of equals."""
    sources: dict[int, list[int]] = {}
    for k, m in (*WHOLE133_TO_33.items(), *WHOLE133_FACE.items()):
        sources.setdefault(m, []).append(k)
    out = []
    for m in range(33):
        best = _NOTHING()
        for k in sources.get(m, ()):
            p = F.get(points, k)
            best = F.when(p["c"] > best["v"], _mark(p["x"], p["y"], p["z"], p["c"])).otherwise(best)
        out.append(best)
    return F.array(*out)


def marks33_to_coco17(marks: Column) -> Column:
    """33 landmarks as 17 keypoints (x, y, c)."""
    take = lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"), m["v"].alias("c"))
    return F.array(*(take(F.get(marks, m)) for m in M33_TO_COCO17))


def _vec(j: Column) -> tuple[Column, Column, Column]:
    return j["x"], j["y"], j["z"]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def srp_3d(joints: Column, hips: tuple[int, int], shoulders: tuple[int, int]) -> Column:
    """Joints in the body's frame: origin between the hips, unit their distance (1e-4 at least), x from right to left hip,
    y along the trunk made square to x (straight up where that has no length), z square to both."""
    three = lambda name, v: [c.alias(f"{name}{k}") for k, c in enumerate(v)]
    of = lambda s, name: tuple(s[f"{name}{k}"] for k in range(3))

    def anchored(j):
        lh, rh, ls, rs = (_vec(F.get(j, i)) for i in (*hips, *shoulders))
        pelvis = tuple((a + b) / 2 for a, b in zip(lh, rh))
        trunk = tuple((a + b) / 2 - p for a, b, p in zip(ls, rs, pelvis))
        return F.struct(*three("p", pelvis), *three("a", (a - b for a, b in zip(lh, rh))), *three("t", trunk))

    def across(s):
        width = F.greatest(F.sqrt(_dot(of(s, "a"), of(s, "a"))), F.lit(1e-4))
        return let(width, lambda w: F.struct(*three("p", of(s, "p")), w.alias("w"), *three("x", (c / w for c in of(s, "a"))), *three("t", of(s, "t"))))

    def along(s):
        up = let(_dot(of(s, "t"), of(s, "x")), lambda d: F.struct(*three("u", (t - d * c for t, c in zip(of(s, "t"), of(s, "x"))))))
        return F.struct(*three("p", of(s, "p")), s["w"].alias("w"), *three("x", of(s, "x")), up.alias("u"))

    def upright(s):
        up = of(s["u"], "u")
        y = let(F.sqrt(_dot(up, up)), lambda n: F.struct(*three("y", (F.when(n < 1e-6, d).otherwise(c / n) for c, d in zip(up, (0.0, 1.0, 0.0))))))
        return F.struct(*three("p", of(s, "p")), s["w"].alias("w"), *three("x", of(s, "x")), y.alias("y"))

    def square(s):
        x, y = of(s, "x"), of(s["y"], "y")
        z = (x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
        return F.struct(*three("p", of(s, "p")), s["w"].alias("w"), *three("x", x), *three("y", y), *three("z", z))

    def placed(j, s):
        rel = tuple(c - p for c, p in zip(_vec(j), of(s, "p")))
        return F.struct(*((_dot(rel, of(s, c)) / s["w"]).alias(c) for c in "xyz"))

    frame = lambda j: let(let(let(let(anchored(j), across), along), upright), square)
    return let(joints, lambda j: let(frame(j), lambda s: F.transform(j, lambda q: placed(q, s))))


def normalize_visual(marks: Column) -> Column:
    """33 landmarks about the pelvis in hip widths, not turned; null where an anchor is unseen or the hips nearly meet."""
    lh, rh = F.get(marks, LEFT_HIP), F.get(marks, RIGHT_HIP)
    width = F.sqrt(F.pow(lh["x"] - rh["x"], 2) + F.pow(lh["y"] - rh["y"], 2))
    seen = reduce(lambda a, b: a & b, (F.get(marks, i)["v"] >= SEEN for i in ANCHORS))
    mid = lambda c: (lh[c] + rh[c]) / 2
    place = lambda j: F.struct(((j["x"] - mid("x")) / width).alias("x"), ((j["y"] - mid("y")) / width).alias("y"))
    return F.when(seen & (width >= 1e-4), F.transform(marks, place))


def estimate_depth(placed: Column) -> Column:
    """Depth of the limbs of ``normalize_visual``'s landmarks: a limb that looks shorter than it is reaches half of the
    missing length towards the viewer; (x, y, z) of all 33."""
    z = {}
    for parent, child, length in CHAIN:
        a, b = F.get(placed, parent), F.get(placed, child)
        seen = F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)
        z[child] = z.get(parent, F.lit(0.0)) - F.when(seen < length * length, F.sqrt(length * length - seen) * 0.5).otherwise(0.0)
    take = lambda i: F.struct(F.get(placed, i)["x"].alias("x"), F.get(placed, i)["y"].alias("y"), z.get(i, F.lit(0.0)).alias("z"))
    return F.when(placed.isNotNull(), F.array(*(take(i) for i in range(33))))


def has_real_depth(marks: Column) -> Column:
    """Whether all four anchors have a depth."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.get(marks, i)["z"]) >= 1e-6, F.lit(False)) for i in ANCHORS))


def feature_vector(joints: Column, at: tuple[int, ...], parts: str = "xyz") -> Column:
    """The chosen joints' coordinates one after another; ``joints`` are worked out once for all of them."""
    return let(joints, lambda p: F.array(*(F.get(p, i)[c] for i in at for c in parts)))


def trajectory(frames: DataFrame, keys: list[str], order: list[str], values: str) -> DataFrame:
    """Rows whose vector is whole and finite, numbered from 0 within their key as ``valid_index``."""
    from pyspark.sql import Window

    whole = F.col(values).isNotNull() & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return frames.filter(whole).withColumn("valid_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def _between(a: Column, b: Column, c: str, part: float) -> Column:
    return a[c] + part * (b[c] - a[c])


def center_of_mass(joints: Column) -> Column:
    """Of the 14 joints, by segment masses: (x, y)."""
    j = lambda i: F.get(joints, i)
    total = TRUNK_MASS + sum(SEGMENT_MASSES.values())

    def coordinate(c):
        hips, shoulders = (j(6)[c] + j(7)[c]) / 2, (j(0)[c] + j(1)[c]) / 2
        trunk = TRUNK_MASS * (hips + CENTRE * (shoulders - hips))
        return reduce(lambda s, p: s + SEGMENT_MASSES[p] * _between(j(p[0]), j(p[1]), c, CENTRE), SEGMENT_MASSES, trunk) / total

    return F.struct(coordinate("x").alias("x"), coordinate("y").alias("y"))


def com_sway(com: Column, joints: Column) -> Column:
    """How far the centre of mass is from the middle between the ankles."""
    a, b = F.get(joints, 10), F.get(joints, 11)
    return F.sqrt(F.pow(com["x"] - (a["x"] + b["x"]) / 2, 2) + F.pow(com["y"] - (a["y"] + b["y"]) / 2, 2))


def _mean_of_seen(points: Column, at: tuple[int, ...], least: float) -> Column:
    seen = F.filter(F.array(*(F.get(points, i) for i in at)), lambda p: p["c"] >= least)
    mean = lambda c: F.try_divide(F.aggregate(seen, F.lit(0.0), lambda s, p: s + p[c]), F.size(seen))
    return F.when(F.size(seen) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def head_center(points: Column, least: float = SEEN) -> Column:
    """The middle of the seen head keypoints; null without one."""
    return _mean_of_seen(points, HEAD, least)


def neck_point(points: Column, least: float = 0.15) -> Column:
    """The middle of the seen shoulders; null without one."""
    return _mean_of_seen(points, (5, 6), least)


def meters_per_pixel(points: Column) -> Column:
    """(scale, confidence) from shoulder width, else torso length, else a default, checked against a plausible height."""
    k = lambda i: F.get(points, i)
    seen = lambda i: k(i)["c"] >= SEEN
    apart = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    shoulders = F.when(seen(5) & seen(6) & (apart(k(5), k(6)) > 1), SHOULDERS_M / apart(k(5), k(6)))
    top, low = _mean_of_seen(points, (5, 6), SEEN), _mean_of_seen(points, (11, 12), SEEN)
    torso = F.when(apart(top, low) > 1, TORSO_M / apart(top, low))
    first = F.coalesce(shoulders, torso, F.lit(DEFAULT_M))
    left, right = F.when(seen(15), k(15)), F.when(seen(16), k(16))
    ankle = F.when(left.isNull() | (right["y"] > left["y"]), right).otherwise(left)
    height = F.when(seen(0) & (apart(k(0), ankle) > 1), apart(k(0), ankle))
    odd = F.coalesce((height * first < HEIGHTS_M[0]) | (height * first > HEIGHTS_M[1]), F.lit(False))
    sure = F.when(shoulders.isNotNull(), F.when(height.isNotNull(), "high").otherwise("medium")).when(torso.isNotNull(), "medium").otherwise("low")
    return F.struct(F.when(odd, HEIGHT_M / height).otherwise(first).alias("scale"), F.when(odd, "low").otherwise(sure).alias("confidence"))


def impact_location(nose: Column, left_eye: Column, right_eye: Column, left_ear: Column, right_ear: Column) -> Column:
    """Which side of the head is seen, from the confidences of its keypoints; UNKNOWN without them."""
    left, right = F.greatest(left_eye, left_ear), F.greatest(right_eye, right_ear)
    return (
        F.when((nose >= 0.35) & (F.least(left, right) >= 0.15), "FRONT")
        .when((nose <= 0.12) & (left + right <= 0.45), "REAR")
        .when(F.abs(left - right) >= 0.25, "SIDE")
        .otherwise("UNKNOWN")
    )


def project_sparse(marks: Column, width: Column | None = None, height: Column | None = None, at: tuple[int, ...] = SPARSE) -> Column:
    """Map of the kept joints, coordinates divided by the picture's size where it is given, four decimals."""
    w, h = width if width is not None else F.lit(1.0), height if height is not None else F.lit(1.0)
    place = lambda j: F.struct(F.round(j["x"] / w, 4).alias("x"), F.round(j["y"] / h, 4).alias("y"), F.round(j["v"], 4).alias("v"))
    return F.map_from_arrays(F.array(*map(F.lit, at)), F.array(*(place(F.get(marks, i)) for i in at)))


def relabel(df: DataFrame, column: str, renames: dict[str, str]) -> DataFrame:
    """Labels replaced by a map; ``relabelled`` says where, so that their sum is the number of updates."""
    table = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair)) if renames else F.create_map().cast("map<string,string>")
    new = table[F.coalesce(F.col(column), F.lit(""))]
    return df.withColumn("relabelled", new.isNotNull()).withColumn(column, F.coalesce(new, F.col(column)))


def parse_jersey(text: Column) -> Column:
    """(number, color) of a JSON answer, in a code fence or not; null where it is no JSON object."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\n?", ""), r"\n?```$", ""))
    fenced = F.when(F.startswith(F.trim(text), F.lit("```")), bare).otherwise(F.trim(text))
    found = F.from_json(fenced, T.StructType([T.StructField("number", T.StringType()), T.StructField("color", T.StringType()), T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    number = F.trim(found["number"])
    whole = F.coalesce(number.try_cast("int"), F.when(number.rlike(r"^-?\d+\.\d+$"), F.expr("null").cast("int")))
    bare_number = F.get_json_object(fenced, "$.number")
    quoted = fenced.rlike(r'"number"\s*:\s*"')
    cut = F.when(~quoted & bare_number.rlike(r"^-?\d+\.\d+$"), F.regexp_extract(bare_number, r"^-?\d+", 0).try_cast("int"))
    color = F.lower(F.trim(found["color"]))
    named = F.when(~color.isin("null", "none", ""), color)
    good = found.isNotNull() & found["_bad"].isNull() & F.startswith(fenced, F.lit("{"))
    return F.when(good, F.struct(F.coalesce(whole, cut).alias("number"), named.alias("color")))


def extract_json_profile(text: Column) -> Column:
    """(profile, complete) from the first fenced JSON block that holds ``injuries``; null otherwise."""
    block = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    good = F.coalesce(F.get_json_object(block, "$.injuries").isNotNull(), F.lit(False))
    complete = F.coalesce(F.get_json_object(block, "$.complete") == "true", F.lit(False))
    return F.when(good, F.struct(block.alias("profile"), complete.alias("complete")))


def lowpass_matrix(joints: int = 14, bones: tuple = BONES, part: float = 0.5) -> np.ndarray:
    """Projection on the skeleton graph's slowest components."""
    a = np.zeros((joints, joints))
    for p, c in bones:
        a[p, c] = a[c, p] = 1
    _, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
    slow = vectors[:, : max(1, int(joints * part))]
    return slow @ slow.T


def graph_lowpass(joints: Column, matrix: np.ndarray) -> Column:
    """Joint coordinates smoothed over the skeleton: each is a fixed mixture of all joints."""
    n = len(matrix)

    def mixed(row, c):
        weights = [(k, float(w)) for k, w in enumerate(row) if abs(w) > 1e-12]
        return reduce(lambda s, t: s + F.get(joints, t[0])[c] * t[1], weights, F.lit(0.0))

    return F.array(*(F.struct(mixed(matrix[i], "x").alias("x"), mixed(matrix[i], "y").alias("y")) for i in range(n)))
