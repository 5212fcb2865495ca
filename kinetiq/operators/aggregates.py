"""Aggregations over subjects, clusters and workouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(x - mean) / population deviation of the key; a deviation under 1e-6 counts as 1."""
    fit = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    z = (F.col(col) - F.col("_m")) / F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s"))
    return df.join(fit, keys).withColumn("z", z).drop("_m", "_s")


def _load(a: DataFrame) -> DataFrame:
    """``a`` with the seconds active_s, high_s and rest_s, and with the intensity and fatigue that they suggest."""
    ratio = F.when(F.col("active_s") > 0, F.col("high_s") / F.col("active_s")).otherwise(0.0)
    a = a.withColumn("intensity", ratio)
    rest = F.greatest(F.lit(0.3), 1 - F.col("rest_s") / (F.col("active_s") + F.col("rest_s")) * 0.5)
    tired = F.least(F.lit(1.0), F.col("intensity") * 0.6 + F.least(F.lit(1.0), F.col("active_s") / 600) * 0.4) * rest
    return a.withColumn("fatigue", F.when(F.col("active_s") > 0, tired).otherwise(0.0))


def workload(signal: DataFrame, keys: list[str], fps: float = 30.0, active: float = 0.05, high: float = 0.3) -> DataFrame:
    """Seconds active, at high intensity and at rest, their ratio and the fatigue that they suggest. Null velocity: rest."""
    v = F.coalesce(F.col("velocity"), F.lit(0.0))
    secs = lambda c: F.sum(F.when(c, 1).otherwise(0)) / fps
    a = signal.groupBy(*keys).agg(
        F.count("*").alias("total_frames"), secs(v >= active).alias("active_s"), secs(v >= high).alias("high_s"), secs(v < active).alias("rest_s")
    )
    return _load(a)


def risk_status(events: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
    """Traffic light per subject from kept events (severity) and workload, and why a player should be pulled.

    Six events are RED; three, or one of high severity, YELLOW; only without those fatigue decides (.8 RED, .6 YELLOW).
    """
    n = events.groupBy(*keys).agg(F.count("*").alias("events"), F.sum((F.col("severity") == "high").cast("int")).alias("high"))
    return _status(load.join(n, keys, "left").fillna(0, ["events", "high"]), keys)


def status_of(counts: DataFrame, keys: list[str], fps: float = 30.0) -> DataFrame:
    """The same from running counts: events, high, total_frames, active_frames and high_frames; a row per row, of a table or a stream."""
    seconds = {"active_s": F.col("active_frames") / fps, "high_s": F.col("high_frames") / fps, "rest_s": (F.col("total_frames") - F.col("active_frames")) / fps}
    return _status(_load(counts.withColumns(seconds)), keys)


def _status(j: DataFrame, keys: list[str]) -> DataFrame:
    status = (
        F.when(F.col("events") >= 6, "RED")
        .when((F.col("events") >= 3) | (F.col("high") > 0), "YELLOW")
        .when(F.col("fatigue") >= 0.8, "RED")
        .when(F.col("fatigue") >= 0.6, "YELLOW")
        .otherwise("GREEN")
    )
    j = j.withColumn("status", status)
    percent = F.format_string("%.0f%%", F.col("fatigue") * 100)
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("status") == "RED", F.concat(F.lit("RED status: "), F.col("events").cast("string"), F.lit(" injury risk events detected"))),
        F.when(F.col("fatigue") >= 0.8, F.concat(F.lit("High fatigue ("), percent, F.lit(")"))).when(
            (F.col("fatigue") >= 0.6) & (F.col("status") != "GREEN"),
            F.concat(F.lit("Elevated fatigue ("), percent, F.lit(") combined with YELLOW risk status")),
        ),
        F.when(F.col("high") >= 2, F.concat(F.col("high").cast("string"), F.lit(" high-severity risk events"))),
    )
    return j.select(*keys, "status", "events", "high", "fatigue", (reasons != "").alias("pull"), reasons.alias("reason"))


def confusion(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Counts of label and cluster; noise (cluster below 0) is left out."""
    return df.filter(F.col(cluster) >= 0).groupBy(label, cluster).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row with the adjusted Rand index, from pair counts of the contingency table."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    part = lambda d, name: d.agg(F.sum(two(F.col("n"))).alias(name))
    a = cells.groupBy(label).agg(F.sum("n").alias("n"))
    b = cells.groupBy(cluster).agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    row = part(cells, "ij").crossJoin(part(a, "a")).crossJoin(part(b, "b")).crossJoin(total)  # one row each
    expected = F.col("a") * F.col("b") / two(F.col("t"))
    most = (F.col("a") + F.col("b")) / 2
    return row.select(F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def majority(df: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label of each key (the smallest of equals) and its share."""
    n = df.groupBy(key, label).agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.max_by(label, F.struct("n", -F.crc32(F.col(label).cast("string")))).alias("_x"), F.sum("n").alias("total"), F.max("n").alias("top"))
    tied = n.join(best, key).filter(F.col("n") == F.col("top")).groupBy(key).agg(F.min(label).alias("label"))
    return best.join(tied, key).select(key, "label", (F.col("top") / F.col("total")).alias("share"))


def risk_trend(workouts: DataFrame, risks: DataFrame, last: int) -> DataFrame:
    """Each user's latest workouts with all risks and a map of how often each occurs; one without a name is ``unknown``."""
    own = top_n(workouts, ["user_id"], [F.desc("created_at"), F.desc("workout_id")], last).select("user_id", "workout_id", "created_at")
    n = risks.groupBy("workout_id", F.coalesce("risk_name", F.lit("unknown")).alias("risk_name")).agg(F.count("*").alias("n"))
    entry = F.when(F.col("risk_name").isNotNull(), F.struct("risk_name", "n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    met = own.join(n, "workout_id", "left").groupBy("user_id", "workout_id", "created_at")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), counts.alias("counts"))


def crash_summary(events: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per subject: events that it is one of the two of (``a``, ``b``), the largest probability ``p`` and the worst level.

    A subject without an event has probability 0 and level NONE.
    """
    order = F.expr("array_position(array('LOW', 'MODERATE', 'HIGH', 'CRITICAL'), level)")
    sides = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    own = events.withColumn("subject", F.explode(sides))
    found = own.groupBy("subject").agg(F.count("*").alias("events"), F.max("p").alias("max_p"), F.max_by("level", order).alias("worst"))
    return subjects.join(found, "subject", "left").fillna({"events": 0, "max_p": 0.0, "worst": "NONE"})


def latest_state(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row's columns for each key."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_s")).select(*keys, *(F.col("_s")[c].alias(c) for c in columns))


def percentiles(df: DataFrame, keys: list[str], col: str, at: tuple = (0.5, 0.9, 0.99)) -> DataFrame:
    """Exact percentiles, linear between values."""
    each = [F.percentile(col, F.lit(p)).alias(f"p{round(p * 100)}") for p in at]
    return df.groupBy(*keys).agg(*each)


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def drop_short(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of keys that have at least ``least`` rows."""
    long = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return df.join(long, keys, "left_semi")


def absorb(df: DataFrame, subject: str, frame: str, target, source) -> DataFrame:
    """One subject's frames appended to another's, moved behind its last."""
    n = df.filter(F.col(subject) == target).agg((F.coalesce(F.max(frame), F.lit(-1)) + 1).alias("_n"))
    moved = df.filter(F.col(subject) == source).crossJoin(F.broadcast(n))  # one row
    moved = moved.withColumn(frame, F.col(frame) + F.col("_n")).withColumn(subject, F.lit(target).cast(df.schema[subject].dataType)).drop("_n")
    return df.filter(F.col(subject) != source).unionByName(moved)


#: A severity's factor, and what each injury scales and watches.
SEVERITY = {"severe": 0.65, "moderate": 0.8, "mild": 0.9}
SCALES = {
    "acl": ("fppa",), "shoulder": ("angular_velocity",), "lower_back": ("trunk_lean", "hip_drop"), "hip": ("hip_drop",),
    "hamstring": ("asymmetry",), "knee_general": ("fppa",),
}


#: Joints that an injury has watched; of a shoulder the elbow of its side, both where none is named.
WATCHED = {"acl": ("left_knee", "right_knee"), "ankle": ("left_ankle", "right_ankle")}


def injury_modifiers(injuries: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold scales of each person, the product of the factors of the injuries (type, severity, side) that touch a metric, and
    ``monitor_joints``, the joints to watch, once for each injury that names them."""
    factor = F.lit(SEVERITY["mild"])
    for name, value in SEVERITY.items():
        factor = F.when(F.col("severity") == name, value).otherwise(factor)
    out = []
    for metric in ("fppa", "hip_drop", "trunk_lean", "asymmetry", "angular_velocity"):
        types = [t for t, m in SCALES.items() if metric in m]
        out.append(F.product(F.when(F.col("type").isin(*types), factor).otherwise(1.0)).alias(f"{metric}_scale"))
    side = F.coalesce(F.col("side"), F.lit("bilateral")) if "side" in injuries.columns else F.lit("bilateral")
    elbow = lambda s: F.when((F.col("type") == "shoulder") & side.isin(s, "bilateral"), f"{s}_elbow")
    joints = [F.when(F.col("type") == t, j) for t, names in WATCHED.items() for j in names]
    watched = F.filter(F.array(*joints, elbow("left"), elbow("right")), lambda j: j.isNotNull())
    return injuries.groupBy(*keys).agg(*out, F.array_sort(F.flatten(F.collect_list(watched))).alias("monitor_joints"))


def joint_summary(scores: DataFrame, keys: list[str], joint: str, score: str, worst: int = 3) -> DataFrame:
    """(keys, joints, worst): the mean score of each joint as a map, and the joints of the highest means, worst first."""
    means = scores.groupBy(*keys, joint).agg(F.avg(score).alias("_m"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("_m")).alias("m"), F.col(joint).alias("j"))))
    table = F.map_from_entries(F.collect_list(F.struct(F.col(joint), F.col("_m"))))
    return means.groupBy(*keys).agg(table.alias("joints"), F.transform(F.slice(order, 1, worst), lambda s: s["j"]).alias("worst"))


def team_averages(players: DataFrame, keys: list[str], player: str, risk: str, fatigue: str, limit: float = 70.0) -> DataFrame:
    """(keys, mean, fatigue, over): a team's means of risk and fatigue, and its players (player, risk) over the limit, highest first."""
    over = F.collect_list(F.when(F.col(risk) > limit, F.struct((-F.col(risk)).alias("r"), F.col(player).alias("p"))))
    out = players.groupBy(*keys).agg(F.avg(risk).alias("mean"), F.avg(fatigue).alias("fatigue"), F.array_sort(over).alias("_o"))
    return out.select(*keys, "mean", "fatigue", F.transform("_o", lambda o: F.struct(o["p"].alias("player"), (-o["r"]).alias("risk"))).alias("over"))


def sequence_summary(scores: DataFrame, keys: list[str], score: str, sequences: DataFrame | None = None) -> DataFrame:
    """Mean, median, largest and number of cycle scores; sequences without cycles are kept with 0 cycles."""
    out = scores.groupBy(*keys).agg(F.avg(score).alias("mean"), F.percentile(score, F.lit(0.5)).alias("median"), F.max(score).alias("most"), F.count(score).alias("cycles"))
    return out if sequences is None else sequences.select(*keys).distinct().join(out, keys, "left").fillna(0, ["cycles"])
