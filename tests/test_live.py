"""Live operators: a stream cut into any micro-batches gives what the table gives, and plain loops agree."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetiq.operators import ordered as E
from kinetiq.plans import live_queries as Q
from kinetiq.streaming import scans as L

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables are not here")


def streamed(spark, tmp_path, df, part, make, name, sentinel=None):
    """``make(stream)`` over the rows of ``df``, a file for each value of ``part``, one file a micro-batch; sorted rows."""
    rows = df.withColumn("_part", part).toPandas()
    folder = str(tmp_path / name)
    for k, (_, some) in enumerate(sorted(rows.groupby("_part"))):
        plain = [{c: v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for c, v in r.items()} for r in some.drop(columns="_part").to_dict("records")]
        spark.createDataFrame(plain, df.schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):  # file times decide the order
            if f.endswith(".parquet") and not f.startswith("n"):
                os.rename(f"{folder}/{f}", f"{folder}/n{k:03}.parquet")
                os.utime(f"{folder}/n{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        for f in os.listdir(folder):
            if f.startswith((".", "_")):
                os.remove(f"{folder}/{f}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def rows_of(df, *columns):
    return sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def test_quality_does_not_depend_on_micro_batches(spark, tmp_path):
    frames = Q.quality_frames(spark, TABLES)
    columns = ["subject_id", "frame", "velocity", "velocity_mean", "velocity_peak", "fatigue", "omega", "curvature", "jerk", "speed", "accel_g", "head_jerk", "rotation", "rating"]
    whole = rows_of(Q.quality(frames), *columns)
    live = streamed(spark, tmp_path, frames, F.expr("(frame * 7 + subject_id) div 160"), Q.quality, "live_quality")
    assert rows_of(live, *columns) == whole


def test_a_table_of_frames_is_dealt_once_for_all_scans(spark):
    plan = Q.quality(Q.quality_frames(spark, TABLES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_heads_of_a_whole_sequence_are_worked_out_by_subject(monkeypatch):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"subject_id": rng.integers(0, 3, 60), "x": rng.normal(0, 1, 60), "y": rng.normal(0, 1, 60), "ear": rng.uniform(-3, 3, 60)})
    rows.loc[rng.choice(60, 9, replace=False), "x"] = None
    plain, want = {}, []
    for r in rows.itertuples():
        want.append(L.H.head_frames(plain.setdefault(r.subject_id, L.H.HeadState()), *(np.array([v]) for v in (r.x, r.y, r.ear)), 1 / 30)[0] if r.x == r.x else np.full(5, np.nan))
    calls, frames = [], L.H.head_frames
    monkeypatch.setattr(L.H, "head_frames", lambda *a: calls.append(1) or frames(*a))
    got = np.stack(L.HeadImpacts().whole(rows)["head"])
    assert len(calls) == 3 and np.allclose(got, np.stack(want), atol=1e-9, equal_nan=True)


def test_scans_equal_the_windows_of_the_batch_operators(spark):
    frames = Q.quality_frames(spark, TABLES)
    whole = Q.quality(frames)
    by = ["subject_id"], ["frame"]
    bent = E.curvature_jerk(frames, *by)
    assert rows_of(whole, "subject_id", "frame", "curvature", "jerk") == rows_of(bent, "subject_id", "frame", "curvature", "jerk")
    moved = E.frame_velocity(frames, *by)
    tired = E.fatigue_index(moved, *by, "velocity")
    peak = E.decaying_peak(moved, *by, "velocity", 0.999)
    assert rows_of(whole, "subject_id", "frame", "fatigue") == rows_of(tired, "subject_id", "frame", "fatigue")
    assert rows_of(whole, "subject_id", "frame", "velocity_peak") == rows_of(peak, "subject_id", "frame", "peak")


def test_player_risk_does_not_depend_on_micro_batches(spark, tmp_path):
    frames = Q.risk_frames(spark, TABLES)
    make = lambda f: L.live_player_risk(f, ["subject_id"], ["frame"], "t", "velocity", "risks")
    columns = ["subject_id", "frame", "status", "events", "high", "fatigue", "pull", "reason"]
    live = streamed(spark, tmp_path, frames, F.expr("(frame * 5 + subject_id * 3) div 100"), make, "live_risk")
    assert rows_of(live, *columns) == rows_of(make(frames), *columns)


def ended(frames):
    """The frames and two late ones of each sequence: the first closes all windows, the second shows that the first is whole."""
    last = frames.groupBy("seq_id").agg(F.max("frame").alias("last")).select("seq_id", F.explode(F.expr("array(last + 100, last + 101)")).alias("frame"))
    blank = [F.col("frame").cast(kind).alias(c) if c in ("frame", "t") else F.col("seq_id") if c == "seq_id" else F.lit(-1).cast(kind).alias(c) if c in ("subject_id", "track_id") else F.lit(None).cast(kind).alias(c) for c, kind in frames.dtypes]
    return frames.union(last.select(*blank))


def test_head_impacts_and_proximity_do_not_depend_on_micro_batches(spark, tmp_path):
    frames = ended(Q.seen_frames(spark, TABLES))
    for name, make in (("live_impacts", lambda f: L.live_head_impacts(f, ["seq_id"])), ("live_near", lambda f: L.live_proximity(f, ["seq_id"]))):
        whole = make(frames)
        # subjects of one frame come in different micro-batches
        live = streamed(spark, tmp_path, frames, F.expr("((frame - 19000) * 15 + abs(subject_id)) div 100"), make, name)
        assert rows_of(live, *whole.columns) == rows_of(whole, *whole.columns)
        assert whole.count() > 20


def test_a_sequence_that_rests_is_closed(spark, tmp_path):
    row = lambda seq, frame, s, x, ts: (seq, frame, frame / 30, s, x, 0.0, x + 0.1, 0.1, x, float(frame % 2), 0.1, ts)
    at = "2024-01-01 00:00:"
    rows = [row(1, f, s, (0.0 if s else 0.9 - 0.1 * f), f"{at}{f:02}") for f in range(5) for s in (0, 1)]
    later = [row(2, 0, 5, 0.0, "2024-01-01 01:00:00"), row(2, 1, 5, 0.0, "2024-01-01 02:00:00")]
    schema = "seq_id long, frame long, t double, subject_id long, x1 double, y1 double, x2 double, y2 double, x double, y double, ear double, ts string"
    frames = spark.createDataFrame(rows + later, schema).withColumn("ts", F.to_timestamp("ts"))
    make = lambda f: L.live_head_impacts(f.withWatermark("ts", "1 second") if f.isStreaming else f, ["seq_id"], idle=60)
    live = streamed(spark, tmp_path, frames, F.expr("case when seq_id = 1 then 0 else 1 + frame end"), make, "live_idle")
    whole = make(frames)
    assert rows_of(live.filter("seq_id = 1"), *whole.columns) == rows_of(whole.filter("seq_id = 1"), *whole.columns)
    assert live.filter("seq_id = 1").count() > 0


def plain_identities(rows):
    """Greedy assignment by frame, written again with dictionaries."""
    tracks, seen, active, left, n, out = {}, {}, set(), 0, 0, []
    for number in sorted({r["frame"] for r in rows}):
        now = sorted((r for r in rows if r["frame"] == number), key=lambda r: r["track_id"])
        if any(r["cut"] for r in now):
            tracks, active, left = {}, set(), 5
            for s in seen.values():
                s["recent"] = []
        for t in set(tracks) - {r["track_id"] for r in now}:
            active.discard(tracks.pop(t))
        taken = set()
        for r in now:
            t, old = r["track_id"], r["track_id"] in tracks
            emb, limbs, box = np.array(r["emb"]), np.array(r["limbs"]), np.array([r["x1"], r["y1"], r["x2"], r["y2"]])
            who = tracks.get(t)
            if not old:
                free = {k: s for k, s in seen.items() if k not in taken and (left or k not in active)}
                best, who = -1.0, None
                for k, s in free.items():
                    m = np.mean(s["embs"], axis=0)
                    score = 0.8 * (emb @ (m / np.linalg.norm(m)))
                    if len(s["limbs"]) >= 5:
                        p = np.median(s["limbs"], axis=0)
                        score += 0.2 * (limbs @ p) / np.linalg.norm(limbs) / np.linalg.norm(p)
                    window = s["recent"][-10:]
                    if not left and window and sum(x != t for _, x in window) < 0.3 * len(window):
                        score -= 0.2 if s["status"] == 2 and s["frames"] > 30 else 0.1
                    if score > best:
                        best, who = score, k
                if best < (0.3 if not left and len(free) == 1 and len(seen) <= 3 else 0.45):
                    who = None
                    if not left:
                        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                        over = {}
                        for k, s in free.items():
                            if number - s["at"] <= 90:
                                w = np.clip(np.minimum(box[2:], s["box"][2:]) - np.maximum(box[:2], s["box"][:2]), 0, None)
                                over[k] = w[0] * w[1] / (area(box) + area(s["box"]) - w[0] * w[1])
                        if over and max(over.values()) >= 0.3:
                            who = max(over, key=over.get)
                        else:
                            far = {k: np.hypot(*((box[:2] + box[2:] - s["box"][:2] - s["box"][2:]) / 2)) for k, s in free.items() if number - s["at"] <= 30}
                            if far and min(far.values()) <= 0.08:
                                who = min(far, key=far.get)
                if who is None:
                    n, who = n + 1, n + 1
                    seen[who] = {"embs": [], "limbs": [], "status": 0, "frames": 0, "recent": []}
                tracks[t] = who
            s = seen[who]
            s["embs"], s["limbs"] = [*s["embs"], emb][-40:], [*s["limbs"], limbs]
            m = np.mean(s["embs"], axis=0)
            steady = np.mean([e @ m / np.linalg.norm(m) for e in s["embs"]]) if len(s["embs"]) > 1 else 0.0
            if old:
                s["status"] += (s["status"] == 0 and steady >= 0.45) or (s["status"] == 1 and steady >= 0.65)
            s |= {"box": box, "at": number, "frames": s["frames"] + 1, "recent": [(f, x) for f, x in [*s["recent"], (number, t)] if number - f <= 10]}
            taken.add(who)
            out.append((number, t, who, ("unknown", "tentative", "confirmed")[s["status"]]))
        active, left = taken, max(0, left - 1)
    return out


def test_identities_equal_a_loop_and_do_not_depend_on_micro_batches(spark, tmp_path):
    frames = Q.tracked(spark, TABLES)
    whole = L.live_identity(frames, ["seq_id"])
    want = []
    every = [r.asDict() for r in frames.collect()]
    for seq in {r["seq_id"] for r in every}:
        want += [(seq, *o) for o in plain_identities([r for r in every if r["seq_id"] == seq])]
    columns = ["seq_id", "frame", "track_id", "subject_id", "status"]
    assert rows_of(whole, *columns) == sorted(want, key=str)
    assert {r[4] for r in want} > {"unknown"} or len({r[3] for r in want}) > 4
    live = streamed(spark, tmp_path, frames, F.expr("(frame * 4 + track_id % 10) div 7"), lambda f: L.live_identity(f, ["seq_id"]), "live_ids")
    newest = frames.groupBy("seq_id").agg(F.max("frame").alias("newest"))
    done = whole.join(newest, "seq_id").filter("frame < newest")  # a stream waits for the end of its newest frame
    assert rows_of(live, *columns) == rows_of(done, *columns)
