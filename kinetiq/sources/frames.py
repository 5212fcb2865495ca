"""Sources and sinks of frames, replays, rosters and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOINTS = 25
FAR = 1e6
PATH = r"/([^/]+?)_(normal|[a-z]+(?:_[a-z]+)?)_(\d+)/([^/]+)$"


def read_kinect(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated frames: a time, then joint number, x, y and z for each of 25 joints.

    Blank lines, rows with fewer fields and frames with a coordinate beyond 1e6 are left out. Subject, gait, instance and
    file come from the path ``subject_gait_instance/file``; the joints keep the order of the line.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("c"), F.col("_metadata.file_path").alias("file"))
    rows = lines.filter(F.size("c") >= 1 + 4 * JOINTS)
    number = lambda i: F.get("c", i).try_cast("double")
    joint = lambda i: F.struct(*(number(2 + 4 * i + k).alias(n) for k, n in enumerate("xyz")))
    frames = rows.select(
        *(F.regexp_extract("file", PATH, k).alias(n) for k, n in ((1, "subject"), (2, "gait_type"), (3, "instance"), (4, "sensor"))),
        number(0).alias("ts"),
        F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), joint).alias("joints"),
    )
    far = F.exists("joints", lambda j: (F.abs(j["x"]) > FAR) | (F.abs(j["y"]) > FAR) | (F.abs(j["z"]) > FAR))
    return frames.filter(F.col("ts").isNotNull() & ~far)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Teams with players and bench as one row per player: team, bench, and the player's fields."""
    teams = spark.read.option("multiLine", True).json(path)
    part = lambda c, bench: teams.select(F.col("name").alias("team"), F.lit(bench).alias("bench"), F.explode(c).alias("p"))
    return part("players", False).unionByName(part("bench", True), allowMissingColumns=True).select("team", "bench", "p.*")


def write_replay(df: DataFrame, path: str) -> None:
    """Replay rows by video, so that a lookup reads one folder."""
    df.write.mode("overwrite").partitionBy("video").parquet(path)


def append_vectors(df: DataFrame, path: str, dimensions: dict[str, int]) -> None:
    """Append vectors by collection; a vector of another length than its collection's is an error."""
    wanted = F.create_map(*(x for k, v in dimensions.items() for x in (F.lit(k), F.lit(v))))[F.col("collection")]
    checked = F.when(F.size("vector") == wanted, F.col("vector")).otherwise(F.raise_error(F.lit("a vector has the wrong length")))
    df.withColumn("vector", checked.cast(df.schema["vector"].dataType)).write.mode("append").partitionBy("collection").parquet(path)


def upsert(df: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows of ``updates`` in place of those with their keys."""
    return df.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def write_event_csv(path: str, *events: DataFrame) -> None:
    """Events of several kinds in one table; rows of individuals only above 1 g."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    kept = out.filter((F.col("kind") != "individual") | (F.coalesce(F.col("accel_g"), F.lit(0.0)) > 1)) if "accel_g" in out.columns else out
    kept.write.mode("overwrite").option("header", True).csv(path)


def retry_due(outbox: DataFrame, now) -> DataFrame:
    """Pending reports that may be tried again: min(2 ** attempts * 5, 300) seconds after the last try."""
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts")) * 5, F.lit(300.0))
    return outbox.filter(F.col("last_try").isNull() | (F.col("last_try").cast("double") + wait <= now))


HEAD = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def head_point(payload) -> object:
    """The head point of a JSON payload: head, head_keypoint, landmarks.head or landmarks.nose, as object or list; first valid."""
    found = []
    for at in ("$.head", "$.head_keypoint", "$.landmarks.head", "$.landmarks.nose"):
        x = F.coalesce(F.get_json_object(payload, f"{at}.x"), F.get_json_object(payload, f"{at}[0]")).try_cast("double")
        y = F.coalesce(F.get_json_object(payload, f"{at}.y"), F.get_json_object(payload, f"{at}[1]")).try_cast("double")
        found.append(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))
    return F.coalesce(*found)


def pick_sensor(frames: DataFrame, sequence: list[str], sensor: str, index: int = 0, subject: str | None = None, gait: str | None = None) -> DataFrame:
    """The frames of a sequence's ``index``-th sensor file by name, of its first where it has fewer; filtered where asked."""
    rows = frames if subject is None else frames.filter(F.col("subject") == subject)
    rows = rows if gait is None else rows.filter(F.col("gait_type") == gait)
    files = rows.select(*sequence, sensor).distinct().groupBy(*sequence).agg(F.array_sort(F.collect_list(sensor)).alias("_s"))
    chosen = files.select(*sequence, F.coalesce(F.get("_s", F.lit(index)), F.get("_s", F.lit(0))).alias(sensor))
    return rows.join(chosen, [*sequence, sensor], "left_semi")


def list_sequences(frames: DataFrame) -> DataFrame:
    """(subject, gait_type, instance, sensors) of what was read, sensors in order of name."""
    return frames.groupBy("subject", "gait_type", "instance").agg(F.array_sort(F.collect_set("sensor")).alias("sensors"))


def write_baseline(baseline: DataFrame, path: str, subject: str = "subject") -> None:
    """Baselines by subject, so that one is read alone."""
    baseline.write.mode("overwrite").partitionBy(subject).parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_replay(spark: SparkSession, path: str, video: str | None = None) -> DataFrame:
    """Replay rows, of one video where named: only its folder is read."""
    rows = spark.read.parquet(path)
    return rows if video is None else rows.filter(F.col("video") == video)


def read_replay_json(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """Replays kept as (gzipped) JSON with a map of subjects a frame: a row per frame and subject, whose fields are
    ``subject``, a schema as text."""
    shape = f"frames array<struct<frame_index:bigint,video_time:double,subjects:map<string,struct<{subject}>>>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("frames").alias("f"), F.col("_metadata.file_name").alias("video"))
    each = rows.select("video", "f.frame_index", "f.video_time", F.explode("f.subjects").alias("subject_id", "s"))
    return each.select("video", "frame_index", "video_time", "subject_id", "s.*")


def append_player_frames(frames: DataFrame, path: str) -> None:
    """Players' rows of frames by game."""
    frames.write.mode("append").partitionBy("game_id").parquet(path)


def write_summary_json(scores: DataFrame, subject: str, gait: str, score: str, path: str) -> None:
    """One JSON row per subject: the mean score of each of its gaits."""
    by = scores.groupBy(subject, gait).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))
    whole = by.groupBy(subject).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(gait), F.struct("mean", "n"))))).alias("gaits"))
    whole.write.mode("overwrite").json(path)


def game_players(game_id: str, subjects: DataFrame, status: DataFrame, subject: str = "subject_id") -> DataFrame:
    """A row per player of a finished game; without a status it is GREEN and without events."""
    met = subjects.select(subject).distinct().join(status, subject, "left")
    return met.fillna({"status": "GREEN", "events": 0, "high": 0, "fatigue": 0.0, "reason": ""}).withColumn("game_id", F.lit(game_id))


def stream_frames(spark: SparkSession, path: str, schema: str, late: str = "10 seconds") -> DataFrame:
    """Live frames from a folder of JSON lines; ``ts`` is their event time, rows later than ``late`` are dropped."""
    return spark.readStream.schema(schema).json(path).withWatermark("ts", late)


def stream_head_samples(stream: DataFrame, payload: str) -> DataFrame:
    """Samples (play_id, player_id, timestamp_ms, head) of a stream of JSON payloads; those without a head point go."""
    value = lambda name: F.get_json_object(payload, f"$.{name}")
    rows = stream.select(value("play_id").alias("play_id"), value("player_id").alias("player_id"), value("timestamp_ms").try_cast("double").alias("timestamp_ms"), head_point(F.col(payload)).alias("head"))
    return rows.filter(F.col("head").isNotNull() & F.col("timestamp_ms").isNotNull())
