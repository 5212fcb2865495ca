import json

from pyspark.sql import functions as F

from kinetiq.operators import cycles as C
from kinetiq.sources import frames as S
from kinetiq.streaming import live


def test_kinect_rules(spark, tmp_path):
    folder = tmp_path / "anna_stiff_legged_2"
    folder.mkdir()
    line = lambda t, x: "\t".join([str(t)] + [str(v) for i in range(25) for v in (i, x, 0.5, i)])
    (folder / "k1.txt").write_text("\n".join([line(1, 0.1), "", line(2, 1e7), "3\t1\t2", line(4, 0.2)]) + "\n")
    rows = S.read_kinect(spark, str(folder)).orderBy("ts").collect()
    assert [r.ts for r in rows] == [1.0, 4.0]
    assert (rows[0].subject, rows[0].gait_type, rows[0].instance) == ("anna", "stiff_legged", "2")
    assert len(rows[0].joints) == 25 and rows[0].joints[3].z == 3.0


def test_roster(spark, tmp_path):
    p = tmp_path / "teams.json"
    p.write_text(json.dumps([{"name": "A", "players": [{"id": 1}, {"id": 2}], "bench": [{"id": 3}]}]))
    assert sorted((r.team, r.bench, r.id) for r in S.read_roster(spark, str(p)).collect()) == [("A", False, 1), ("A", False, 2), ("A", True, 3)]


def test_head_point_spellings(spark):
    texts = ['{"head":{"x":1,"y":2}}', '{"head_keypoint":[3,4]}', '{"landmarks":{"nose":{"x":5,"y":6}}}', '{"head":{"x":"no"},"landmarks":{"head":[7,8]}}', "{}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string").withColumn("h", S.head_point(F.col("p")))
    got = {r.i: r.h and (r.h.x, r.h.y) for r in df.collect()}
    assert got == {0: (1, 2), 1: (3, 4), 2: (5, 6), 3: (7, 8), 4: None, 5: None}


def test_wrong_vector_length_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "collection string, vector array<double>")
    S.append_vectors(df, str(tmp_path / "v"), {"a": 2})
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    try:
        S.append_vectors(df, str(tmp_path / "v"), {"a": 3})
        raise AssertionError("no error")
    except Exception as e:
        assert "wrong length" in str(e)


def test_resample_keeps_ends_and_short_gaps_give_no_cycle(spark):
    frames = spark.createDataFrame([(1, i, [float(i)]) for i in range(40)], "s int, frame int, f array<double>")
    strikes = lambda *at: spark.createDataFrame([(1, a) for a in at], "s int, strike int")
    cyc = C.cycles_from_strikes(frames, strikes(0, 20, 25, 40), ["s"], "frame")
    out = C.resample(cyc, ["s", "cycle"], 5).orderBy("cycle", "phase").collect()
    assert [r.f[0] for r in out if r.cycle == 0] == [0.0, 4.75, 9.5, 14.25, 19.0]
    assert {r.cycle for r in out} == {0, 2}
    assert C.cycles_from_strikes(frames, strikes(0, 5), ["s"], "frame").count() == 0
    assert C.cycles_from_strikes(frames, strikes(3), ["s"], "frame").count() == 40


def test_collision_state_machine():
    state, events = (None, None, 0), []
    for t, v in [(0, 1), (10, 8), (20, 5), (30, 3), (100, 2), (140, 5), (150, 1), (280, 1), (290, 9)]:
        state, e = live.collision_step(state, float(t), float(v))
        events += [e] if e else []
    assert events == [("start", 1, 10.0, 0.0), ("end", 1, 280.0, 270.0), ("start", 2, 290.0, 0.0)]


def test_live_windows_equal_batch(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:00:00.4", "a", 3.0), ("2024-01-01 00:00:01.2", "a", 5.0), ("2024-01-01 00:10:00", "b", 0.0)]
    df = spark.createDataFrame(rows, "t string, subject_id string, velocity double").select(F.to_timestamp("t").alias("ts"), "subject_id", "velocity")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.window_metrics(stream).writeStream.format("memory").queryName("live_windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.subject_id, r.n, r.most) for r in spark.table("live_windows").collect())
    assert got == [("a", 1, 5.0), ("a", 2, 3.0)]
    assert live.window_metrics(df).count() == 3


def test_sensor_falls_back_to_the_first(spark):
    rows = [("a", "normal", "1", s, i) for s in ("k1", "k2") for i in range(3)] + [("b", "lurch", "1", "k1", 0)]
    df = spark.createDataFrame(rows, "subject string, gait_type string, instance string, sensor string, i int")
    by = ["subject", "gait_type", "instance"]
    got = sorted({(r.subject, r.sensor) for r in S.pick_sensor(df, by, "sensor", 1).collect()})
    assert got == [("a", "k2"), ("b", "k1")]
    assert {r.subject for r in S.pick_sensor(df, by, "sensor", 0, gait="lurch").collect()} == {"b"}
    assert {(r.subject, tuple(r.sensors)) for r in S.list_sequences(df).collect()} == {("a", ("k1", "k2")), ("b", ("k1",))}


def test_files_come_back(spark, tmp_path):
    base = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "subject string, phase int, mean double")
    S.write_baseline(base, str(tmp_path / "b"))
    assert sorted((r.subject, r.mean) for r in S.read_baseline(spark, str(tmp_path / "b")).collect()) == [("a", 1.0), ("b", 2.0)]
    replay = spark.createDataFrame([("v1", 0), ("v2", 1)], "video string, frame int")
    S.write_replay(replay, str(tmp_path / "r"))
    assert [r.frame for r in S.read_replay(spark, str(tmp_path / "r"), "v2").collect()] == [1]
    frames = [{"frame_index": 3, "video_time": 0.1, "subjects": {"1": {"phase": "normal"}, "2": {"phase": "anomaly"}}}]
    (tmp_path / "x.json").write_text(json.dumps({"frames": frames}))
    rows = S.read_replay_json(spark, str(tmp_path / "x.json"), "phase:string").collect()
    assert sorted((r.video, r.frame_index, r.subject_id, r.phase) for r in rows) == [("x.json", 3, "1", "normal"), ("x.json", 3, "2", "anomaly")]
    for _ in range(2):
        S.append_player_frames(spark.createDataFrame([("g", 1)], "game_id string, f int"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    scores = spark.createDataFrame([("a", "normal", 1.0), ("a", "normal", 3.0), ("a", "lurch", 5.0)], "s string, g string, x double")
    S.write_summary_json(scores, "s", "g", "x", str(tmp_path / "j"))
    row = spark.read.json(str(tmp_path / "j")).first()
    assert row.gaits.normal.mean == 2.0 and row.gaits.lurch.n == 1


def test_players_without_events_are_green(spark):
    subjects = spark.createDataFrame([(1,), (2,)], "subject_id int")
    status = spark.createDataFrame([(1, "RED", 7, 1, 0.5, "r")], "subject_id int, status string, events long, high long, fatigue double, reason string")
    got = {r.subject_id: (r.status, r.events, r.game_id) for r in S.game_players("g", subjects, status).collect()}
    assert got == {1: ("RED", 7, "g"), 2: ("GREEN", 0, "g")}


def test_streams_of_frames_and_heads(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"ts": "2024-01-01T00:00:00Z", "subject_id": "s", "payload": "{\\"play_id\\": \\"p\\", \\"player_id\\": \\"q\\", \\"timestamp_ms\\": 5, \\"head\\": [1, 2]}"}\n')
    stream = S.stream_frames(spark, str(folder), "ts timestamp, subject_id string, payload string")
    q = S.stream_head_samples(stream, "payload").writeStream.format("memory").queryName("heads").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.play_id, r.timestamp_ms, r.head.x) for r in spark.table("heads").collect()] == [("p", 5.0, 1.0)]
