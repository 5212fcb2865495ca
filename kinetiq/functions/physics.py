"""Impact physics as Column expressions, evaluated inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
GRAVITY = 9.81
DURATION_S, DURATION_HELMET_S, DURATION_GROUND_S = 0.008, 0.012, 0.006
RESTITUTION_BASE, RESTITUTION_SLOPE, RESTITUTION_LEAST = 0.55, 0.025, 0.1
REFERENCE_SPEED, DURATION_POWER = 5.0, 0.2
LOGIT = (-10.2, 0.0433, 0.000873, -0.00000092)
LOGIT_LINEAR = (-9.805, 0.1154)
ROTATIONAL_PER_G = 50.0
BODY_MASS_INDEX, MASS_LEAST, MASS_MOST = 22.0, 30.0, 150.0
LEVELS = ((0.05, "LOW"), (0.15, "MODERATE"), (0.50, "HIGH"))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def risk_level(p: Column) -> Column:
    out = F.lit("CRITICAL")
    for cut, name in reversed(LEVELS):
        out = F.when(p < cut, name).otherwise(out)
    return out


def body_mass(height_px: Column, metres_per_px: Column) -> Column:
    height = height_px * metres_per_px
    return F.greatest(F.lit(MASS_LEAST), F.least(F.lit(MASS_MOST), BODY_MASS_INDEX * height * height))


def peak_g(delta_v: Column, seconds: Column) -> Column:
    """Peak of a half-sine pulse of that change of speed."""
    return F.when(seconds > 0, delta_v / seconds * (math.pi / 2) / GRAVITY).otherwise(0.0)


def concussion_probability(g: Column, rotational: Column) -> Column:
    b0, b1, b2, b3 = LOGIT
    return logistic(b0 + b1 * g + b2 * rotational + b3 * g * rotational)


def impact_physics(
    speed: Column, mass_a: Column, mass_b: Column, coupling: Column, angle: Column | None = None,
    confidence: Column | None = None, seconds: float = DURATION_S,
) -> Column:
    """One struct with all results of two people meeting at a closing speed (m/s).

    The lighter takes the larger change of speed; coupling and approach angle pass a part of it to the head. An angle over
    a right angle counts as the least coupling.
    """
    restitution = F.greatest(F.lit(RESTITUTION_LEAST), RESTITUTION_BASE - RESTITUTION_SLOPE * speed)
    body = (1 + restitution) * speed / (mass_a + mass_b) * F.greatest(mass_a, mass_b)
    cos = F.cos(angle) if angle is not None else F.lit(1.0)
    turned = F.greatest(F.lit(0.1), F.when(cos > 0, F.pow(cos, F.lit(0.6))).otherwise(0.0))
    head = F.abs(body) * coupling * turned
    ratio = F.greatest(F.lit(0.5), F.least(F.lit(2.0), REFERENCE_SPEED / speed))
    lasting = F.when(speed > 0, seconds * F.pow(ratio, F.lit(DURATION_POWER))).otherwise(seconds)
    g = peak_g(head, lasting)
    rotational = ROTATIONAL_PER_G * g
    p = concussion_probability(g, rotational)
    outside = (speed > 8) | (mass_a < 40) | (mass_a > 130) | (mass_b < 40) | (mass_b > 130)
    if confidence is not None:
        outside = outside | (confidence < 0.5)
    return F.struct(
        restitution.alias("restitution"),
        F.abs(body).alias("delta_v_body"),
        head.alias("delta_v_head"),
        lasting.alias("duration_s"),
        g.alias("peak_g"),
        rotational.alias("peak_rotational"),
        p.alias("probability"),
        logistic(LOGIT_LINEAR[0] + LOGIT_LINEAR[1] * g).alias("probability_linear"),
        F.when(g > 0, lasting * F.pow(2 / math.pi * g, F.lit(2.5))).otherwise(0.0).alias("hic"),
        risk_level(p).alias("level"),
        F.when(outside, "EXTRAPOLATED").otherwise("VALIDATED").alias("applicability"),
    )


def ground_impact(speed: Column) -> Column:
    """A fall: the whole speed is lost within the ground's duration."""
    g = peak_g(speed, F.lit(DURATION_GROUND_S))
    p = concussion_probability(g, ROTATIONAL_PER_G * g)
    return F.struct(g.alias("peak_g"), p.alias("probability"), risk_level(p).alias("level"))


def _ramp(value: Column, start: float, width: float, points: float) -> Column:
    return F.least(F.greatest(value - start, F.lit(0.0)) / width, F.lit(1.0)) * points


def concussion_composite(accel_g: Column, turn_deg: Column, frames: Column, rotation: Column, closing: Column) -> Column:
    """0 to 100 from five ramps with a dead zone each, through a sigmoid."""
    raw = _ramp(accel_g, 3.0, 12.0, 30.0) + _ramp(turn_deg, 30.0, 120.0, 25.0) + _ramp(frames, 1.0, 4.0, 15.0)
    raw = raw + _ramp(rotation, 12.0, 23.0, 20.0) + _ramp(closing, 0.8, 2.2, 10.0)
    return 100 / (1 + F.exp(-0.08 * (raw - 50)))


def composite_of(accel_g: float, turn_deg: float, frames: int, rotation: float, closing: float) -> float:
    """``concussion_composite`` of plain numbers, for states of streams."""
    ramps = ((accel_g, 3.0, 12.0, 30.0), (turn_deg, 30.0, 120.0, 25.0), (frames, 1.0, 4.0, 15.0), (rotation, 12.0, 23.0, 20.0), (closing, 0.8, 2.2, 10.0))
    raw = sum(min(max(v - start, 0.0) / width, 1.0) * points for v, start, width, points in ramps)
    return 100 / (1 + math.exp(-0.08 * (raw - 50)))


#: Zone and part of the speed that reaches the head, by COCO keypoints of the struck person.
ZONES = (((0, 1, 2, 3, 4), "head_to_head", 0.7), ((5, 6), "head_to_shoulder", 0.4), ((7, 8), "head_to_torso", 0.25), ((11, 12), "head_to_torso", 0.2), ((9, 10), "head_to_limb", 0.15))


def contact_zone(keypoint: Column) -> Column:
    zone, coupling = F.lit("head_to_limb"), F.lit(0.08)
    for at, name, part in ZONES:
        zone, coupling = F.when(keypoint.isin(*at), name).otherwise(zone), F.when(keypoint.isin(*at), part).otherwise(coupling)
    return F.struct(zone.alias("zone"), coupling.alias("coupling"))


def derive_metrics(v: Column) -> Column:
    """Metrics from a 50-number vector: tens of it stand for head impact, exertion, recovery, movement and performance."""
    ten = lambda k: F.slice(v, 10 * k + 1, 10)
    mean = lambda k: F.aggregate(ten(k), F.lit(0.0), lambda s, x: s + x) / F.size(ten(k))
    whole = lambda c: F.floor(c).cast("long")
    hit = F.array_max(ten(0))
    return F.struct(
        whole((mean(0) * 0.6 + hit * 0.4) * 100).alias("concussion"), whole(mean(1) * 100).alias("fatigue"), whole((1 - mean(2)) * 100).alias("recovery"),
        whole(mean(3) * 100).alias("movement"), whole(mean(4) * 100).alias("performance"), whole(60 + mean(1) * 140).alias("heart_rate"),
        F.round(hit * 40, 1).alias("collision_velocity"), whole((1 - mean(1) * 0.5) * 100).alias("hydration"),
    )


#: What each level advises, and the levels' least peak accelerations.
ADVICE = {
    "CRITICAL": "EVALUATE NOW — remove from play immediately for concussion assessment",
    "HIGH": "EVALUATE — significant risk, consider immediate assessment",
    "MODERATE": "MONITOR — watch for concussion symptoms over next 24 hours",
    "LOW": "CLEARED — routine contact, no action needed",
    "NONE": "No collisions detected",
}
NO_ADVICE = "No assessment available"
G_LEVELS = ((40.0, "LOW"), (75.0, "MODERATE"))


def recommendation(level: Column) -> Column:
    out = F.lit(NO_ADVICE)
    for name, text in ADVICE.items():
        out = F.when(level == name, text).otherwise(out)
    return out


def risk_of_g(g: Column) -> Column:
    """LOW, MODERATE or HIGH by peak acceleration."""
    out = F.lit("HIGH")
    for cut, name in reversed(G_LEVELS):
        out = F.when(g < cut, name).otherwise(out)
    return out
