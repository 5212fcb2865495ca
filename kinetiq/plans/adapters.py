"""Views of the driver tables in the shapes that the operators take, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def signal(spark, sf_dir) -> DataFrame:
    """(subject_id, frame, t, x, velocity, kind, k): a subject's events as a signal."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        (F.row_number().over(own) - 1).alias("frame"),
        _seconds("ts").alias("t"),
        F.col("value").alias("x"),
        (F.abs(F.col("value") - F.lag("value").over(own)) / 200).alias("velocity"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def feat(spark, sf_dir) -> DataFrame:
    """(subject_id, frame, vec_id, f): 28 features a frame."""
    own = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("subject_id"),
        (F.row_number().over(own) - 1).alias("frame"),
        "vec_id",
        F.slice(F.col("embedding").cast("array<double>"), 1, 28).alias("f"),
    )


def pose14(spark, sf_dir) -> DataFrame:
    """(vec_id, label, joints): 14 joints with x, y and visibility v."""
    e = F.col("embedding").cast("array<double>")
    joint = lambda j: F.struct(
        F.get(e, 2 * j).alias("x"), F.get(e, 2 * j + 1).alias("y"), F.least(F.lit(1.0), F.abs(F.get(e, 28 + j)) * 8).alias("v")
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(13)), joint).alias("joints"))


def _points(spark, sf_dir, n: int, **parts) -> DataFrame:
    """(vec_id, label, p): ``n`` points whose parts are expressions over the vector ``e`` and the point's number ``j``."""
    point = lambda j: F.struct(*(f(F.col("e"), j).alias(name) for name, f in parts.items()))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point).alias("p"))


def _at(a: int, b: int):
    return lambda e, j: F.get(e, (a * j + b) % 64)


def _sure(a: int, b: int):
    return lambda e, j: F.least(F.lit(1.0), F.abs(F.get(e, (a * j + b) % 64)) * 8)


def marks33(spark, sf_dir) -> DataFrame:
    """33 landmarks (x, y, z, v) a vector."""
    return _points(spark, sf_dir, 33, x=_at(2, 0), y=_at(2, 1), z=_at(3, 5), v=_sure(5, 7))


def coco17(spark, sf_dir) -> DataFrame:
    """17 keypoints (x, y, c) a vector, in pixels."""
    pixels = lambda f: lambda e, j: 300 + 400 * f(e, j)
    return _points(spark, sf_dir, 17, x=pixels(_at(2, 0)), y=pixels(_at(2, 1)), c=_sure(1, 34))


def whole133(spark, sf_dir) -> DataFrame:
    """133 keypoints (x, y, z, c) a vector."""
    return _points(spark, sf_dir, 133, x=_at(1, 0), y=_at(1, 13), z=_at(1, 29), c=_sure(7, 3))


def boxes(spark, sf_dir) -> DataFrame:
    """(seq_id, frame, subject_id, x1, y1, x2, y2): a box per subject and day."""
    e = table(spark, sf_dir, "events").select(
        F.expr("user_id div 15").alias("seq_id"),
        F.floor(_seconds("ts") / 86400).alias("frame"),
        F.col("user_id").alias("subject_id"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return _box(e, ["seq_id", "frame", "subject_id"])


def contacts(spark, sf_dir) -> DataFrame:
    """(frame, subject_id, box): boxes in six-minute frames."""
    e = table(spark, sf_dir, "events").select(
        F.floor(_seconds("ts") / 360).alias("frame"),
        F.col("user_id").alias("subject_id"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return _box(e, ["frame", "subject_id"])


def _box(events: DataFrame, by: list[str]) -> DataFrame:
    a = events.groupBy(*by).agg(
        (F.avg("value") / 200).alias("cx"), (F.avg("k") / 100).alias("cy"), (0.05 + 0.02 * F.count("*")).alias("h")
    )
    return a.select(*by, *(F.expr(f"{c} {s} h").alias(f"{n}") for n, c, s in (("x1", "cx", "-"), ("y1", "cy", "-"), ("x2", "cx", "+"), ("y2", "cy", "+"))))


def workout_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("workout_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").alias("fatigue_score"),
        F.col("o_orderpriority").alias("label"),
    )


def risk_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("workout_id"), F.col("l_returnflag").alias("risk_name"), F.col("l_linestatus").alias("joint"), F.col("l_quantity").cast("double").alias("value")
    )


def impact_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity").cast("double") / 5).alias("speed"),
        (40 + F.col("l_tax").cast("double") * 1000).alias("mass_a"),
        (40 + F.col("l_discount").cast("double") * 1000).alias("mass_b"),
    )


#: The same views for DuckDB, as common table expressions.
SQL = {
    "signal": """signal AS (SELECT user_id AS subject_id, row_number() OVER w - 1 AS frame, epoch(ts) AS t, value AS x,
        abs(value - lag(value) OVER w) / 200 AS velocity, event_type AS kind, (props->>'$.k')::INT AS k
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "feat": """feat AS (SELECT label AS subject_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id,
        embedding[1:28]::DOUBLE[] AS f FROM embeddings)""",
    "pose14": """pose14 AS (SELECT vec_id, label, [{'x': e[2*j+1], 'y': e[2*j+2], 'v': least(1.0, abs(e[29+j])*8)} FOR j IN range(14)] AS joints
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))""",
    "marks33": """marks33 AS (SELECT vec_id, label, [{'x': e[(2*j)%64+1], 'y': e[(2*j+1)%64+1], 'z': e[(3*j+5)%64+1], 'v': least(1.0, abs(e[(5*j+7)%64+1])*8)} FOR j IN range(33)] AS p
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))""",
    "coco17": """coco17 AS (SELECT vec_id, label, [{'x': 300 + 400*e[(2*j)%64+1], 'y': 300 + 400*e[(2*j+1)%64+1], 'c': least(1.0, abs(e[(j+34)%64+1])*8)} FOR j IN range(17)] AS p
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))""",
    "whole133": """whole133 AS (SELECT vec_id, label, [{'x': e[j%64+1], 'y': e[(j+13)%64+1], 'z': e[(j+29)%64+1], 'c': least(1.0, abs(e[(7*j+3)%64+1])*8)} FOR j IN range(133)] AS p
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))""",
    "boxes": """boxes AS (SELECT seq_id, frame, subject_id, cx - h AS x1, cy - h AS y1, cx + h AS x2, cy + h AS y2 FROM (
        SELECT user_id // 15 AS seq_id, floor(epoch(ts) / 86400)::BIGINT AS frame, user_id AS subject_id, avg(value) / 200 AS cx,
        avg((props->>'$.k')::INT) / 100 AS cy, 0.05::DOUBLE + 0.02::DOUBLE * count(*) AS h FROM events GROUP BY ALL))""",
    "contacts": """contacts AS (SELECT frame, subject_id, cx - h AS x1, cy - h AS y1, cx + h AS x2, cy + h AS y2 FROM (
        SELECT floor(epoch(ts) / 360)::BIGINT AS frame, user_id AS subject_id, avg(value) / 200 AS cx,
        avg((props->>'$.k')::INT) / 100 AS cy, 0.05::DOUBLE + 0.02::DOUBLE * count(*) AS h FROM events GROUP BY ALL))""",
    "workout_rows": """workout_rows AS (SELECT o_custkey AS user_id, o_orderkey AS workout_id, o_orderdate AS created_at,
        o_totalprice AS fatigue_score, o_orderpriority AS label FROM orders)""",
    "risk_rows": """risk_rows AS (SELECT l_orderkey AS workout_id, l_returnflag AS risk_name, l_linestatus AS joint, l_quantity::DOUBLE AS value FROM lineitem)""",
    "impact_rows": """impact_rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DOUBLE / 5 AS speed,
        40 + l_tax::DOUBLE * 1000 AS mass_a, 40 + l_discount::DOUBLE * 1000 AS mass_b FROM lineitem)""",
}


def with_views(sql: str, *names: str) -> str:
    """An oracle query over the named views."""
    return f"WITH RECURSIVE {', '.join(SQL[n] for n in names)}\n{sql}"
