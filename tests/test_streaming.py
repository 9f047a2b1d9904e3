"""Streams fed file by file, and the same rows in batch."""

from __future__ import annotations

from datetime import datetime, timedelta

from swinglake.streaming import pipelines

T0 = datetime(2024, 1, 1)


def drive(spark, tmp_path, batches, schema, build, mode="append"):
    """Write each batch as one file, let the stream take one file at a time, and return all its rows."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    name = f"q{abs(hash(str(tmp_path)))}"
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_health_windows_match_batch(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=0.05 * i),) for i in range(600)]
    late = [(T0 + timedelta(seconds=200),)]
    got = drive(spark, tmp_path, [rows, late, [(T0 + timedelta(seconds=400),)]], "ts timestamp", pipelines.tumbling_health)
    batch = pipelines.tumbling_health(spark.createDataFrame(rows, "ts timestamp")).collect()
    assert sorted(batch) == sorted(r for r in got if r["n"] > 1)
    assert {r["low"] for r in batch} == {True}


def test_retry_states(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    got = drive(spark, tmp_path, [[("a", at(0), 500), ("b", at(0), 200)], [("a", at(5), 429), ("c", at(5), 404)], [("a", at(9), 201)]], "file string, ts timestamp, status int", pipelines.upload_states)
    assert [(r["state"], r["attempts"]) for r in sorted((r for r in got if r["file"] == "a"), key=lambda r: r["ts"])] == [("retry", 1), ("retry", 2), ("pushed", 3)]
    assert {r["file"]: r["state"] for r in got if r["file"] != "a"} == {"b": "pushed", "c": "parked"}


def test_clock_state_expires(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    got = drive(spark, tmp_path, [[(1, at(0), 2.5)], [(1, at(30), None)], [(1, at(100), None)]], "k long, ts timestamp, offset_s double", lambda s: pipelines.clock_state(s, "k"))
    assert [r["source"] for r in sorted(got, key=lambda r: r["ts"])] == ["fresh", "previous", "none"]


def test_debounce(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    got = drive(spark, tmp_path, [[(1, at(0)), (1, at(0.3))], [(1, at(0.5)), (1, at(0.9))]], "k long, ts timestamp", lambda s: pipelines.debounced(s, "k"))
    assert sorted(r["ts"] for r in got) == [at(0), at(0.5)]


def test_shot_frames(spark, tmp_path):
    shots = spark.createDataFrame([(1, 7, T0 + timedelta(seconds=10))], "k long, shot long, shot_ts timestamp")
    frames = spark.createDataFrame([(1, i, T0 + timedelta(seconds=i)) for i in range(20)] + [(1, 99, T0 + timedelta(seconds=10, milliseconds=750))], "k long, frame long, frame_ts timestamp")
    assert sorted(r["frame"] for r in pipelines.shot_frames(shots, frames, "k").collect()) == [4, 5, 6, 7, 8, 9, 10, 99]


def test_gap_exactly_at_the_limit_stays(spark):
    ms = [0, 450, 1000]
    df = spark.createDataFrame([(1, T0 + timedelta(milliseconds=m)) for m in ms], "k long, ts timestamp")
    assert sorted(r["n"] for r in pipelines.gap_sessions(df, "k").collect()) == [1, 2]


def test_ring_buffer_keeps_the_newest(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[(1, at(i), i) for i in range(5)], [(1, at(i), i) for i in range(5, 8)]]
    got = drive(spark, tmp_path, batches, "k long, ts timestamp, frame long", lambda s: pipelines.ring_buffer(s, "k", size=4), mode="update")
    assert [(r["newest"], r["held"], r["dropped"]) for r in sorted(got, key=lambda r: r["newest"])] == [(4, 4, 1), (7, 4, 4)]


def test_running_stats(spark, tmp_path):
    got = drive(spark, tmp_path, [[(1, 100.0)], [(1, 110.0), (2, 90.0)]], "k long, ball_speed double", lambda s: pipelines.running_stats(s, "k"), mode="update")
    assert sorted((r["k"], r["shot_count"], r["avg_ball"]) for r in got) == [(1, 1, 100.0), (1, 2, 105.0), (2, 1, 90.0)]


def test_shot_empties_the_buffer(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[(1, at(0), 10), (1, at(1), 11), (1, at(2), None), (1, at(3), 12)], [(1, at(4), 13), (1, at(5), 14), (1, at(6), 15), (1, at(7), None), (1, at(8), None)]]
    got = drive(spark, tmp_path, batches, "k long, ts timestamp, frame long", lambda s: pipelines.shot_buffers(s, "k", size=3))
    assert [(r["ts"], r["frames"]) for r in sorted(got, key=lambda r: r["ts"])] == [(at(2), [10, 11]), (at(7), [13, 14, 15]), (at(8), [])]


def test_buffer_warnings(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(1, 7, at(10), i, at(4 + i * 0.05)) for i in range(130)] + [(1, 8, at(50), 999, at(49))]
    got = {r["shot"]: r for r in pipelines.buffer_warnings(spark.createDataFrame(rows, "k long, shot long, shot_ts timestamp, frame long, frame_ts timestamp"), "k").collect()}
    assert (got[7]["underfilled"], got[7]["nothing_after"]) == (False, False) and (got[8]["underfilled"], got[8]["nothing_after"]) == (True, True)


def test_payloads_are_left_out_of_uploads(spark, tmp_path):
    lines = ['{"type": "shot", "n": 1, "radc_b64": "AAAA"}', '{"type": "other"}', "broken", '{"type": "shot", "frames": [1, 2]}']
    got = drive(spark, tmp_path, [[(x,) for x in lines]], "raw string", lambda s: pipelines.uploadable(s, ("shot",)))
    assert sorted(r["raw"] for r in got) == ['{"type":"shot","n":1}', '{"type":"shot"}']


def state_rows(spark, tmp_path, batches, schema, build, mode="append"):
    """What :func:`drive` does, and the rows of state after the last batch."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    return spark.table("states").collect(), left


def test_states_expire(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    cases = {
        "debounced": ([[(k, at(0)) for k in range(20)], [(99, at(100))], [(99, at(200))]], "k long, ts timestamp", lambda s: pipelines.debounced(s, "k"), "append"),
        "clock": ([[(k, at(0), 1.0) for k in range(20)], [(99, at(300), None)], [(99, at(400), None)]], "k long, ts timestamp, offset_s double", lambda s: pipelines.clock_state(s, "k"), "append"),
        "ring": ([[(k, at(0), 1) for k in range(20)], [(99, at(9000), 2)], [(99, at(9100), 3)]], "k long, ts timestamp, frame long", lambda s: pipelines.ring_buffer(s, "k"), "update"),
        "uploads": ([[(f"{k}", at(0), 500) for k in range(20)], [("x", at(10**6), 200)], [("x", at(10**6 + 9), 200)]], "file string, ts timestamp, status int", pipelines.upload_states, "append"),
        "buffers": ([[(k, at(0), 1) for k in range(20)], [(99, at(9000), 2)], [(99, at(9100), None)]], "k long, ts timestamp, frame long", lambda s: pipelines.shot_buffers(s, "k"), "append"),
    }
    for name, (batches, schema, build, mode) in cases.items():
        assert state_rows(spark, tmp_path / name, batches, schema, build, mode)[1] <= 1, name


def test_shots_wait_for_their_frames(spark, tmp_path):
    """Frames after a shot count until the wait is over, however they are batched; later ones don't; the timer gives a shot without further frames."""
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "k long, ts timestamp, shot long, frame long"
    frames = [(1, at(1 + 0.05 * i), None, i) for i in range(20)]  # 1.00 to 1.95
    for n, batches in enumerate(
        (
            [[*frames, (1, at(1.6), 7, None)], [(2, at(60), None, 1)], [(2, at(61), None, 2)]],
            [[*frames[:5], (1, at(1.6), 7, None)], frames[5:14], frames[14:], [(2, at(60), None, 1)], [(2, at(61), None, 2)]],
        )
    ):
        got, left = state_rows(spark, tmp_path / str(n), batches, schema, lambda s: pipelines.waited_frames(s, "k"))
        assert [(r["k"], r["shot"], sorted(r["frames"])) for r in got] == [(1, 7, list(range(16)))]  # up to 1.75 of 1.78
        assert left <= 1


def test_waits_reach_back_and_end(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "k long, ts timestamp, shot long, frame long"
    batches = [[(1, at(s), None, s) for s in range(20)], [(1, at(10.0), 1, None), (1, at(19.5), 2, None)], [(1, at(90), None, 99)], [(1, at(91), None, 100)]]
    got, _ = state_rows(spark, tmp_path, batches, schema, lambda s: pipelines.waited_frames(s, "k", late="15 seconds"))
    assert {r["shot"]: r["frames"] for r in got} == {1: [4, 5, 6, 7, 8, 9, 10], 2: [14, 15, 16, 17, 18, 19]}


def test_diagnostics_are_drained_by_cycle(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "k long, ts timestamp, reason string, latency_ms double"
    batches = [[(1, at(0), "slow", 3.0), (1, at(1), "no_ball", None)], [(1, at(2), "zero", 0.0), (1, at(3), None, 250.0), (1, at(4), "after", None)], [(2, at(5000), "x", 1.0)], [(2, at(6000), None, 9.0)]]
    got, left = state_rows(spark, tmp_path, batches, schema, lambda s: pipelines.drained_diagnostics(s, "k"))
    assert sorted((r["k"], r["reason"], r["latency_ms"]) for r in got if r["reason"] != "after") == [(1, "no_ball", 250.0), (1, "slow", 3.0), (1, "zero", 250.0), (2, "x", 1.0)]
    assert [r["latency_ms"] for r in got if r["reason"] == "after"] == [None] and left == 0


def test_log_tail_resumes(spark, tmp_path):
    logs, out, cp = (str(tmp_path / x) for x in ("logs", "out", "cp"))

    def feed(name, lines):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / name).write_text("\n".join(lines) + "\n")

    def run():
        q = pipelines.log_tail(spark, logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()

    feed("a.jsonl", ['{"type": "shot_detected", "ts": "t1", "device_id": "d"}', "broken"])
    run()
    feed("b.jsonl", ['{"type": "error", "message": "m"}'])
    run()
    got = [(r["raw"] == "broken", r["type"], r["device_id"], r["ts"], r["message"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted([(False, "shot_detected", "d", "t1", None), (True, None, None, None, None), (False, "error", None, None, "m")], key=repr)
