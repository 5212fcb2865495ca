"""Per-frame geometry as Column expressions over arrays of joints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once; a Column used twice is otherwise an expression planned twice."""
    return F.get(F.transform(F.array(value), body), 0)


def dist(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def visible(joints: Column, at: list[int], least: float = 0.3) -> Column:
    """Whether all listed joints are seen well enough."""
    return F.forall(F.array(*(F.get(joints, i)["v"] for i in at)), lambda v: v >= least)


def joint_angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at ``b``; 180 where a limb has no length."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cos = (ux * vx + uy * vy) / (nu * nv)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return F.when((nu < 1e-8) | (nv < 1e-8), 180.0).otherwise(angle)


def hip_drop(left: Column, right: Column, y_up: bool = False) -> Column:
    """Degrees of the hip line against the horizontal, positive where the left hip is higher (of smaller y unless y_up)."""
    width = dist(left, right)
    rise = left["y"] - right["y"] if y_up else right["y"] - left["y"]
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rise / width))
    return F.when(width < 1e-8, 0.0).otherwise(F.degrees(F.asin(ratio)))


def trunk_lean(shoulders: Column, hips: Column, y_up: bool = False) -> Column:
    """Signed degrees of the trunk from the vertical."""
    dy = shoulders["y"] - hips["y"] if y_up else hips["y"] - shoulders["y"]
    return F.degrees(F.atan2(shoulders["x"] - hips["x"], dy))


def asymmetry_index(left: Column, right: Column) -> Column:
    """Percent of difference against the larger."""
    most = F.greatest(F.abs(left), F.abs(right))
    return F.when(most < 1e-8, 0.0).otherwise(F.abs(left - right) / most * 100)


#: The joints of the angles that come in pairs, left and right: knees, elbows, hips.
BILATERAL = (((6, 8, 10), (7, 9, 11)), ((0, 2, 4), (1, 3, 5)), ((0, 6, 8), (1, 7, 9)))


def frame_asymmetry(joints: Column, least: float = 0.3) -> Column:
    """Mean asymmetry of the pairs of angles whose joints are all seen; 0 without any."""
    angle = lambda chain: F.when(visible(joints, list(chain), least), joint_angle(*(F.get(joints, i) for i in chain)))
    both = lambda pair: let(F.struct(angle(pair[0]).alias("l"), angle(pair[1]).alias("r")), lambda s: F.when(s["l"].isNotNull() & s["r"].isNotNull(), asymmetry_index(s["l"], s["r"])))
    there = F.filter(F.array(*map(both, BILATERAL)), lambda v: v.isNotNull())
    return let(there, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)).otherwise(0.0))


def midpoint(a: Column, b: Column) -> Column:
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def srp_2d(joints: Column, hips: tuple[int, int], shoulders: tuple[int, int]) -> Column:
    """Joints in the body's frame: origin between the hips, unit their distance, x from right to left hip, y upwards along
    the trunk made square to x. Null where the hips are under 1e-4 apart."""
    lh, rh = F.get(joints, hips[0]), F.get(joints, hips[1])
    pelvis, top = midpoint(lh, rh), midpoint(F.get(joints, shoulders[0]), F.get(joints, shoulders[1]))
    width = dist(lh, rh)
    xx, xy = (lh["x"] - rh["x"]) / width, (lh["y"] - rh["y"]) / width
    tx, ty = top["x"] - pelvis["x"], top["y"] - pelvis["y"]
    along = tx * xx + ty * xy
    ox, oy = tx - along * xx, ty - along * xy
    n = F.sqrt(ox * ox + oy * oy)
    yx, yy = F.when(n < 1e-6, -xy).otherwise(ox / n), F.when(n < 1e-6, xx).otherwise(oy / n)

    def place(j):
        dx, dy = (j["x"] - pelvis["x"]) / width, (j["y"] - pelvis["y"]) / width
        return F.struct((dx * xx + dy * xy).alias("x"), (dx * yx + dy * yy).alias("y"))

    return F.when(width >= 1e-4, F.transform(joints, place))


def limb_lengths(joints: Column, pairs: list[tuple[int, int]], hips: tuple[int, int], least: float = 0.3) -> Column:
    """Lengths over the hips' distance; 0 where an end isn't seen, null where the hips are not."""
    width = dist(F.get(joints, hips[0]), F.get(joints, hips[1]))
    seen = lambda i: F.get(joints, i)["v"] >= least
    each = [F.when(seen(i) & seen(j), dist(F.get(joints, i), F.get(joints, j)) / width).otherwise(0.0) for i, j in pairs]
    return F.when(visible(joints, list(hips), least) & (width >= 1e-6), F.array(*each))


def landmark_bbox(joints: Column, least: float = 0.3, pad: float = 0.05) -> Column:
    """Box around the seen joints, padded and held within 0 to 1; null where none is seen."""
    seen = F.filter(joints, lambda j: j["v"] > least)
    xs, ys = F.transform(seen, lambda j: j["x"]), F.transform(seen, lambda j: j["y"])
    low = lambda c: F.greatest(F.lit(0.0), F.array_min(c) - pad)
    high = lambda c: F.least(F.lit(1.0), F.array_max(c) + pad)
    return F.when(F.size(seen) > 0, F.struct(low(xs).alias("x1"), low(ys).alias("y1"), high(xs).alias("x2"), high(ys).alias("y2")))


def bbox_iou(a: str, b: str) -> Column:
    """Intersection over union of boxes in the columns {a}x1 .. and {b}x1 ..; 0 for an empty union."""
    c = lambda p, n: F.col(p + n)
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def fppa(hip: Column, knee: Column, ankle: Column) -> Column:
    """Degrees by which the knee leaves the line from hip to ankle: negative (valgus) where the cross product is positive."""
    ax, ay, kx, ky = ankle["x"] - hip["x"], ankle["y"] - hip["y"], knee["x"] - hip["x"], knee["y"] - hip["y"]
    length = F.sqrt(ax * ax + ay * ay)
    cross = ax * ky - ay * kx
    away = F.abs(cross) / length
    angle = F.degrees(F.atan2(away, F.greatest(length * 0.5, F.lit(1e-8))))
    return F.when((length < 1e-8) | (away < 1e-8), 0.0).otherwise(F.when(cross > 0, -angle).otherwise(angle))


def movement_phase(at: Column, start: Column, end: Column) -> Column:
    """Where a frame is in its segment: transition near the ends, ascending in the first half, descending in the second."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - start) / F.greatest(end - start - 1, F.lit(1))))
    return F.when((p < 0.1) | (p > 0.9), "transition").when(p < 0.5, "ascending").otherwise("descending")


def frame_phase(frame: Column, total: Column, segments: Column, anomaly: Column) -> Column:
    """calibrating for the first max(30, fifth) frames or without segments, then anomaly or normal."""
    early = frame < F.greatest(F.lit(30), F.floor(total * 0.2))
    return F.when(early | (segments == 0), "calibrating").when(F.coalesce(anomaly, F.lit(False)), "anomaly").otherwise("normal")
