"""Joins: pairs within a frame, intervals, as-of, and search by vector."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetiq.functions.geometry import bbox_iou


def pairs_in_frame(df: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """All unordered pairs of subjects of a frame: an equi-join on the frame's keys, the columns as a_* and b_*."""
    a, b = (df.select(*(F.col(c).alias(c if c in keys else f"{p}_{c}") for c in df.columns)) for p in "ab")
    return a.join(b, keys).filter(F.col(f"a_{subject}") < F.col(f"b_{subject}"))


def overlaps(df: DataFrame, keys: list[str], subject: str, least: float = 0.05) -> DataFrame:
    """Pairs whose boxes overlap by at least ``least``."""
    return pairs_in_frame(df, keys, subject).withColumn("iou", bbox_iou("a_", "b_")).filter(F.col("iou") >= least)


def closing_speed(df: DataFrame, seq: list[str], frame: str, subject: str, threshold: float = 1.5, least: float = 0.1, most: int = 5, fps: float = 30.0) -> DataFrame:
    """How fast the centres of two boxes near each other since the sequence's frame before: the ``most`` fastest of a frame.

    Both have to be in both frames, so each row takes its subject's last centre along before pairs are made. A time step
    outside (0, 1) counts as 1 / fps; ``t`` is the frame's time. ``warning`` says that the frame's fastest pair reaches
    ``threshold``.
    """
    frames = df.groupBy(*seq, frame).agg(F.min("t").alias("_t"))
    before = Window.partitionBy(*seq).orderBy(frame)
    frames = frames.select(*seq, frame, F.lag(frame).over(before).alias("_frame"), (F.col("_t") - F.lag("_t").over(before)).alias("_dt"))
    own = Window.partitionBy(*seq, subject).orderBy(frame)
    c = df.select(*seq, frame, subject, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    c = c.withColumns({"px": F.lag("cx").over(own), "py": F.lag("cy").over(own), "pf": F.lag(frame).over(own)})
    c = c.join(frames, [*seq, frame]).filter("pf = _frame").drop("pf", "_frame")
    p = pairs_in_frame(c, [*seq, frame], subject)
    apart = lambda x, y: F.sqrt(F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) + F.pow(F.col(f"a_{y}") - F.col(f"b_{y}"), 2))
    dt = F.when((F.col("a__dt") > 0) & (F.col("a__dt") < 1), F.col("a__dt")).otherwise(1 / fps)
    p = p.withColumn("speed", (apart("px", "py") - apart("cx", "cy")) / dt).filter(F.col("speed") > least)
    in_frame = Window.partitionBy(*seq, frame)
    top = in_frame.orderBy(F.desc("speed"), f"a_{subject}", f"b_{subject}")
    ranked = p.withColumn("warning", F.max("speed").over(in_frame) >= threshold).withColumn("rank", F.row_number().over(top))
    return ranked.filter(F.col("rank") <= most).select(*seq, frame, f"a_{subject}", f"b_{subject}", "speed", "rank", "warning")


#: Rows of a stretch in which rows and the spans that reach into it meet.
STRETCH = 64


def within(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float = STRETCH) -> DataFrame:
    """Rows with the spans of their key that hold them, end exclusive, for spans that overlap little: an equi-join by key and stretch of
    ``width``, so that a key's rows don't meet all of its spans. A span has a row for each stretch that it reaches into."""
    stretch = lambda c: F.floor(c / F.lit(width)).cast("long")
    cut = spans.filter(F.col(start) < F.col(end)).withColumn("_stretch", F.explode(F.sequence(stretch(F.col(start)), stretch(F.col(end)))))
    met = rows.withColumn("_stretch", stretch(F.col(at))).join(cut, [*keys, "_stretch"]).drop("_stretch")
    return met.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def in_segments(frames: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with the segments of their key that hold them, end exclusive: an equi-join with a range."""
    s = segments.select(*(F.col(c).alias(c if c in keys else f"s_{c}") for c in segments.columns))
    return frames.join(s, keys).filter((F.col(at) >= F.col(f"s_{start}")) & (F.col(at) < F.col(f"s_{end}")))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The last right row of the key at or before each left row: one union and a window, no range join."""
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}") for c in columns]
    a = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast("struct<t:double>").alias("_hit"), *blank)
    b = right.select(
        *(F.col(c) if c in keys or c == time else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns),
        F.lit(0).alias("_side"), F.struct(F.col(time).cast("double").alias("t")).alias("_hit"), *(F.col(c).alias(f"r_{c}") for c in columns),
    )
    own = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(F.when(F.col("_hit").isNotNull(), F.struct(*(f"r_{c}" for c in columns))), True).over(own)
    met = a.unionByName(b).withColumn("_v", value).filter("_side = 1")
    return met.select(*left.columns, *(F.col("_v")[f"r_{c}"].alias(f"r_{c}") for c in columns))


#: Numbers of a block of queries that are broadcast together, and so held by a task: rows times dimensions.
BLOCK_NUMBERS = 4_000_000
#: Scores that a task works out at once.
SCORES = 1 << 19


def _scored(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return vectors @ queries.T  # both of unit length, or zero
    return -np.sqrt(np.maximum(0, (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ queries.T + (queries**2).sum(axis=1)))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", on: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The ``k`` best corpus rows of each query: (query_id, rank, uuid, score, the corpus's other columns).

    Scores are equal to 1e-9 rank by uuid; a row isn't its own neighbour; ``on`` are metadata columns that have to be equal.
    Queries are dealt into blocks of bounded size by a hash; a block is broadcast and met by the corpus in matrix products of
    ``SCORES`` numbers. A task keeps each query's best over all of its batches, and only those leave it.
    """
    spark, on = queries.sparkSession, on or []
    dim = queries.select(F.max(F.size("q"))).first()[0]
    if not dim or dim < 0:
        dim = 1
    many = queries.count()
    blocks = max(1, -(-many // (most or max(1, BLOCK_NUMBERS // dim))))
    extra = [c for c in corpus.columns if c not in ("uuid", "vector")]
    kind = corpus.schema["uuid"].dataType
    schema = T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("uuid", kind), T.StructField("score", T.DoubleType()), T.StructField("_near", T.DoubleType())]
        + [corpus.schema[c] for c in extra]
    )
    names = schema.names
    parts = []
    for b in range(blocks):
        rows = queries.select("query_id", "q", *on).filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        if not len(rows):
            continue
        matrix = np.array(rows["q"].tolist(), float)
        held = (rows["query_id"].to_numpy(), _unit(matrix) if metric == "cosine" else matrix, [rows[c].to_numpy() for c in on])
        shared = spark.sparkContext.broadcast(held)  # BLOCK_NUMBERS numbers

        def search(batches, shared=shared):
            ids, matrix, same = shared.value
            floor, held, many = np.full(len(ids), -np.inf), [], 0

            def best():
                rows = pd.concat(held, ignore_index=True).sort_values(["at", "_near", "uuid"], ascending=[True, False, True])
                rows = rows[rows.groupby("at").cumcount() < k]
                full = rows[rows.groupby("at").cumcount() == k - 1]
                floor[full["at"].to_numpy()] = full["_near"].to_numpy()
                return rows

            for batch in batches:
                batch = batch[batch["vector"].notna()]
                if not len(batch):
                    continue
                vectors = np.array(batch["vector"].tolist(), float)
                vectors = _unit(vectors) if metric == "cosine" else vectors
                uuid, width = batch["uuid"].to_numpy(), max(1, SCORES // len(batch))
                for first in range(0, len(ids), width):
                    some = slice(first, first + width)
                    score = _scored(vectors, matrix[some], metric)
                    near = score.round(9)
                    fits = uuid[:, None] != ids[some][None, :]
                    for c, values in zip(on, same):
                        fits &= batch[c].to_numpy()[:, None] == values[some][None, :]
                    near = np.where(fits, near, -np.inf)
                    if len(batch) >= k:
                        floor[some] = np.maximum(floor[some], np.partition(near, len(batch) - k, axis=0)[len(batch) - k])
                    row, query = np.nonzero((near >= floor[some]) & (near > -np.inf))
                    out = pd.DataFrame({"at": query + first, "uuid": uuid[row], "score": score[row, query].round(12), "_near": near[row, query]})
                    held.append(pd.concat([out, batch[extra].iloc[row].reset_index(drop=True)], axis=1))
                    many += len(row)
                    if many > 2 * SCORES and many > 4 * k * len(ids):
                        held[:] = [best()]
                        many = len(held[0])
            if held:
                rows = best()
                for i in range(0, len(rows), 10_000):
                    part = rows.iloc[i : i + 10_000]
                    yield part.assign(query_id=ids[part["at"].to_numpy()])[names]

        parts.append(corpus.select("uuid", "vector", *extra).mapInPandas(search, schema))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])).drop("_near")
    best = Window.partitionBy("query_id").orderBy(F.desc("_near"), "uuid")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_near")


def best_match(queries: DataFrame, corpus: DataFrame, threshold: float, column: str, missing: str | None = None) -> DataFrame:
    """Each query's best row's ``column`` if it scores at least ``threshold``, else ``missing``."""
    found = vector_search(queries, corpus, 1).filter(F.col("score") >= threshold).select("query_id", F.col(column).alias("found"), "score")
    named = F.coalesce(F.col("found").cast("string"), F.lit(missing)) if missing is not None else F.col("found")
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", named.alias("match"), "score")


def match_profile(labels: DataFrame, profiles: DataFrame, column: str, default: str = "generic") -> DataFrame:
    """The first profile by rank whose keyword is part of the trimmed lower-case label. ``profiles(profile, rank, keyword)`` is a dimension of
    a few hundred rows and is broadcast."""
    clean = labels.select(column).distinct().withColumn("_l", F.lower(F.trim(column)))
    met = clean.join(F.broadcast(profiles), F.contains(F.col("_l"), F.col("keyword")), "left")
    best = met.groupBy(column).agg(F.min_by("profile", "rank").alias("profile"))
    return best.withColumn("profile", F.coalesce("profile", F.lit(default)))


def game_detail(games: DataFrame, frames: DataFrame, keys: list[str], order: list[str], most: int = 5000) -> DataFrame:
    """Every game with its first ``most`` frames in order, numbered from 1; a game without frames has one row of nulls."""
    own = Window.partitionBy(*keys).orderBy(*order)
    first = frames.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= most)
    return games.join(first, keys, "left")
