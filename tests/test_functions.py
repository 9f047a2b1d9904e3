"""Functions against direct computation, closed forms and generated signals."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swinglake.functions import dsp, flight
from swinglake.functions.stats import nearest_rank, pearson, slope_intercept, sums
from swinglake.sources import logs


def test_constant_doppler_is_found():
    t = np.arange(4096) / dsp.FS
    for mph, sign in ((90.0, 1), (150.0, 1), (60.0, -1)):
        f = sign * mph / dsp.MPH_PER_BIN * dsp.FS / dsp.FFT
        got = dsp.speed_readings(2048 + 500 * np.cos(2 * np.pi * f * t), 2048 + 500 * np.sin(2 * np.pi * f * t))
        assert len({r[0] for r in got}) == 32
        strongest = max(got, key=lambda r: r[2])
        assert abs(strongest[1] - mph) < 1.0
        assert strongest[3] == ("outbound" if sign > 0 else "inbound")


def test_flat_spectrum_has_no_peaks():
    assert dsp.peaks(np.full(500, 9.0)) == []


def test_peaks_keep_their_distance():
    s = np.zeros(400)
    s[[100, 130, 200, 300]] = [10, 9, 8, 7]
    assert dsp.peaks(s) == [100, 200, 300]


def test_carry_never_falls(spark):
    got = [r[0] for r in spark.range(50, 230).select(flight.table_carry(F.col("id").cast("double")).alias("c")).collect()]
    assert got == sorted(got) and got[50] == 136.0


def test_nearest_rank(spark):
    for n in (1, 2, 5, 11, 20):
        df = spark.createDataFrame([(0, float(i)) for i in range(n)], "k int, x double")
        assert nearest_rank(df, ["k"], "x", 0.9).first()["x"] == round(0.9 * (n - 1))


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double").agg(*sums("x", "y"))
    slope, intercept = slope_intercept()
    r = df.select(pearson().alias("r"), slope.alias("s"), intercept.alias("i")).first()
    assert (r["r"], r["s"], r["i"]) == (None, 1.0, 0.0)


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    import uuid

    names = [f"device:{i}" for i in range(40)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(logs.uuid5(ns, F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]


def test_log_scans(spark, tmp_path):
    text = '{"type": "shot_detected", "shot_number": 1, "ball_speed_mph": 100.5, "ts": "a"}\n\nnot json\n[1]\n{"type": "shot_detected", "data": {"shot_number": 2, "club": "pw"}, "timestamp": "b"}\n{"type": "x\x00"}'
    (tmp_path / "s.jsonl").write_text(text)
    lines = logs.read_log(spark, str(tmp_path))
    got = logs.shots(lines).orderBy("line_no").collect()
    assert [(r["shot_number"], r["ts"], r["club"], r["line_no"]) for r in got] == [(1, "a", None, 0), (2, "b", "pw", 4)]
    states = {r["line_no"]: r["state"] for r in logs.allowed(lines).collect()}
    assert states == {0: "kept", 1: "blank", 2: "broken", 3: "broken", 4: "kept", 5: "broken"}
    with pytest.raises(Exception, match="line 2"):
        logs.strict(lines).select("shot_number").collect()


def test_truth_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿sep=,\nBall Speed,Club Speed,Carry,Club,Spin Rate\n[km/h],[mph],[m],,[rpm]\n"160.9344",90,"100",7 Iron,"6,500"\n,,,PW,\n', encoding="utf-8")
    got = logs.read_truth_csv(spark, str(tmp_path / "t.csv")).collect()
    assert len(got) == 2
    assert got[0]["ball_speed"] == pytest.approx(100.0) and got[0]["carry"] == pytest.approx(109.3613) and got[0]["spin"] == 6500.0
    assert got[1]["ball_speed"] is None and got[1]["club"] == "PW"


def path_worth(path, before):
    """A path's worth by its definition, or None where a ball can't have taken it."""
    clip = lambda x, most: min(most, max(0.0, x))
    h = path[0]
    worth = 1 + clip((h["magnitude"] - 1800) / 2200, 1.6) + (1.2 if h["ms"] <= 120 else 0.4 if h["ms"] <= 180 else -1) + (0.8 if h["distance"] <= 2.8 else 0.2 if h["distance"] <= 3.6 else -0.5)
    worth -= sum(abs(b["distance"] - h["distance"]) <= 0.3 and abs(b["angle"] - h["angle"]) <= 8 for b in before)
    for a, b in zip(path, path[1:]):
        gain, turn = b["distance"] - a["distance"], abs(b["angle"] - a["angle"])
        if not (20 <= b["ms"] - a["ms"] <= 95 and -0.05 <= gain <= 1.8 and turn <= 18):
            return None
        worth += 2 + min(1.8, max(0, gain) * 1.1) - 0.04 * turn + clip((b["magnitude"] - 1800) / 3000, 0.8) - (0.8 if gain < 0.02 else 0)
    return worth


def test_best_path_is_the_best_of_all(spark):

    from swinglake.functions.tracks import HIT, best_path

    rng = np.random.default_rng(4)
    some = lambda n, low, high: [
        dict(frame=i, ms=float(m), distance=float(d), angle=float(a), magnitude=float(g))
        for i, (m, d, a, g) in enumerate(zip(np.sort(rng.uniform(low, high, n)), rng.uniform(0.6, 5, n), rng.uniform(-20, 20, n), rng.uniform(1500, 4000, n)))
    ]
    rows = [(k, some(8, 0, 260), some(3, -100, 0)) for k in range(25)] + [(90, [], []), (91, some(1, 0, 10), [])]
    df = spark.createDataFrame(rows, f"k int, hits array<struct<{HIT}>>, before array<struct<{HIT}>>")
    got = {r["k"]: r["b"] for r in df.select("k", best_path(F.col("hits"), F.col("before")).alias("b")).collect()}
    for k, hits, before in rows:
        worths = [w for n in range(1, len(hits) + 1) for c in combinations(hits, n) if (w := path_worth(c, before)) is not None]
        if not hits:
            assert got[k] is None
            continue
        assert got[k]["score"] == pytest.approx(max(worths))
        assert path_worth([h.asDict() for h in got[k]["path"]], before) == pytest.approx(max(worths))


def plain_pick(score, path, later, ball_ms):
    """(worth, quality, what lingers) of a path by the rules, one after another."""
    end, gain = path[-1], path[-1]["distance"] - path[0]["distance"]
    left = sum(h["ms"] > end["ms"] + 90 and abs(h["distance"] - end["distance"]) <= 0.35 and abs(h["angle"] - end["angle"]) <= 8 for h in later)
    steps = [b["distance"] - a["distance"] > 0 for a, b in zip(path, path[1:], strict=False)]
    steady, long = (sum(steps) / len(steps) if steps else 1.0), end["ms"] - path[0]["ms"]
    worth = score - 1.2 * left + 0.8 * min(gain, 2.5) + 0.7 * steady + (0.5 if len(path) >= 3 else -0.6) + (0.4 if 30 <= long <= 220 else -0.4)
    worth += (0.5 if path[0]["distance"] <= 2.5 else 0) - 0.35 * max(0, path[0]["ms"] - 120) / 40 - 0.8 * max(0, path[0]["distance"] - 3.8) - 0.6 * left
    worth -= min(1.0, abs(path[0]["ms"] - ball_ms) / 160) if ball_ms is not None else 0
    strong = path[0]["ms"] <= 120 and steady >= 0.75 and (len(path) >= 4 and gain >= 1.2 or len(path) >= 3 and gain >= 1.5 and left <= 4)
    return worth, "strong" if strong else "partial" if len(path) >= 2 and gain >= 0.4 and steady >= 0.5 else "weak", left


def test_events_are_judged(spark):
    from swinglake.functions.tracks import HIT
    from swinglake.operators.tracks import judged_events

    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        ms = np.sort(rng.uniform(-100, 420, 12)).round(1)
        flight = k % 3 == 0
        hits = [dict(frame=i, ms=float(m), distance=float(0.8 + max(m, 0) / 60 if flight else rng.uniform(0.3, 5.6)), angle=float(rng.uniform(-3, 3) if flight else rng.uniform(-20, 20)), magnitude=float(rng.uniform(1500, 4000))) for i, m in enumerate(ms)]
        rows.append((k, hits, None if k % 4 == 0 else 30.0 * (k % 5)))
    rows += [(90, [], None), (91, [dict(frame=0, ms=-5.0, distance=1.0, angle=0.0, magnitude=2000.0)], 3.0)]
    got = {r["k"]: r for r in judged_events(spark.createDataFrame(rows, f"k int, all array<struct<{HIT}>>, ball_ms double")).collect()}
    for k, hits, ball_ms in rows:
        inside = [h for h in hits if 0 <= h["ms"] <= 260 and 0.6 <= h["distance"] <= 5.2]
        assert (k in got) == bool(inside)
        if inside:
            r = got[k]
            path = [h.asDict() for h in r["path"]]
            worth, quality, left = plain_pick(r["score"], path, hits, ball_ms)
            assert r["worth"] == pytest.approx(worth) and (r["quality"], r["left"]) == (quality, left)
            assert r["metrics"]["points"] == len(path) and r["metrics"]["angle_span"] == pytest.approx(max(h["angle"] for h in path) - min(h["angle"] for h in path))
            before = [h for h in hits if h["ms"] < 0]
            assert r["score"] == pytest.approx(max(w for n in range(1, len(inside) + 1) for c in combinations(inside, n) if (w := path_worth(c, before)) is not None))
    assert {r["quality"] for r in got.values()} == {"strong", "partial", "weak"}


def test_sinks_round_trip(spark, tmp_path):
    import csv
    import gzip
    import json

    from swinglake.sources import scans, sinks

    lines = spark.createDataFrame([("a", i, f'{{"n": {i}, "t": "é"}}') for i in range(30)] + [("b", 0, "x" * 5000), (None, 0, "{}")], "file string, line_no int, raw string").repartition(4)
    got = {r["file"]: r for r in sinks.upload_bodies(lines, "file", raw_bytes=1000).collect()}
    body = gzip.decompress(got["a"]["body"]).decode().splitlines()
    assert json.loads(body[0]) == {"manifest": {"lines": 30}} and [json.loads(x)["n"] for x in body[1:]] == list(range(30))
    assert got["b"]["refused"] == "too large" and got["b"]["body"] is None
    assert {r["refused"] for r in sinks.upload_bodies(lines.where("file = 'a'"), "file", packed_bytes=10).collect()} == {"too large when packed"}
    shots = spark.createDataFrame([(1, "t1", 2.5), (2, "t2", None)], "shot_number int, at string, spin double")
    for _ in range(2):
        sinks.append_entries(shots, "shot_detected", "at", ["shot_number", "spin"], str(tmp_path / "log"))
    read = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(read) == 4 and all(list(x)[:2] == ["ts", "type"] for x in read) and sum("spin" in x for x in read) == 2
    pairs = spark.createDataFrame([("pw", 100.12345, 99.0, "good"), ("pw", None, 99.0, "unmatched_truth")], "club string, ball_speed_of double, ball_speed_tm double, match_quality string")
    sinks.write_csv([sinks.comparison(pairs)], str(tmp_path / "c"))
    back = scans.read_comparison(spark, str(tmp_path / "c"))
    assert len(back.columns) == 34 and [(r["ball_speed_of"], r["ball_speed_delta"]) for r in back.collect()] == [(100.123, 1.123)]
    sinks.write_csv([shots.select("shot_number"), shots.select("at", "shot_number")], str(tmp_path / "u"))
    files = [list(csv.reader(open(p))) for p in (tmp_path / "u").glob("*.csv")]
    assert {tuple(f[0]) for f in files if f} == {("shot_number", "at")} and sum(len(f) - 1 for f in files if f) == 4
    sinks.write_summary(shots, str(tmp_path / "s"))
    assert sorted(r["spin"] or 0 for r in spark.read.json(str(tmp_path / "s")).collect()) == [0, 2.5]
    assert "| 1 | t1 | 2.500 |" in sinks.markdown(shots, "Shots")
    with pytest.raises(ValueError):
        sinks.markdown(shots, "Shots", most=1)


def test_named_truth_and_tail(spark, tmp_path):
    from swinglake.sources import scans

    (tmp_path / "monday.csv").write_text('Club,Ball Speed,Extra\nPW,"1,100.5",x\n7i,,y\n')
    got = scans.read_truth_named(spark, str(tmp_path), {"club": "Club", "ball_speed": "Ball Speed"}).collect()
    assert [(r["session"], r["club"], r["ball_speed"]) for r in got] == [("monday.csv", "PW", 1100.5), ("monday.csv", "7i", None)]
    lines = spark.createDataFrame([('{"type": "shot", "ts": "t", "device_id": 5}',), ("broken",)], "raw string")
    assert [(r["type"], r["device_id"], r["ts"], r["message"]) for r in scans.labelled_tail(lines).collect()] == [("shot", "5", "t", None), (None, None, None, None)]


def test_grid_fit_takes_every_shot(spark, sf):
    """Against direct computation on the reference's grid: all shots, 451 angles."""
    from swinglake.functions.lens import lens
    from swinglake.operators.enrichment import launch_grid_fit

    shots = lens(spark, sf, "shots").where("launch_v IS NOT NULL").collect()
    got = {r["shot_number"]: r for r in launch_grid_fit(spark, sf).collect()}
    assert sorted(got) == sorted(r["shot_number"] for r in shots)
    assert any(n % 10 == 9 for n in got)
    alpha = np.arange(451) / 10
    for r in shots:
        run = r["ball_speed"] * 1.4666667 * (0.02 + r["num_frames"] / 1000)
        seen = np.degrees(np.arctan2(0.5 + run * np.sin(np.radians(alpha)), r["distance_ft"] + run * np.cos(np.radians(alpha))))
        off = np.abs(r["launch_v"] * 0.7 + 2.0 - seen)
        found = got[r["shot_number"]]
        assert found["residual"] == pytest.approx(off.min(), abs=1.1e-5)
        if abs(off.min() - 1.0) > 1e-6:
            assert (found["alpha"] is None) == (off.min() > 1.0)
        if found["alpha"] is not None:
            assert off[round(found["alpha"] * 10)] == pytest.approx(off.min(), abs=1e-8)
            near = np.flatnonzero(off <= off.min() + 1e-10)
            assert found["alpha"] <= alpha[near[0]] + 1e-9


def test_stored_captures(spark):
    from swinglake.sources import scans

    frames = spark.createDataFrame([("a", "vertical", float(t), t) for t in range(20)] + [("b", "horizontal", 3.0, 1)], "capture string, orientation string, at double, frame int")
    shots = spark.createDataFrame([("a", 15.25), ("a", 5.0), ("a", None)], "capture string, at double")
    got = {}
    for r in scans.stored_captures(frames, shots, 3).collect():
        got.setdefault((r["capture"], r["shot_number"]), []).append(r["frame"])
    assert {k: sorted(v) for k, v in got.items()} == {("a", 3): list(range(6)), ("a", 4): list(range(10, 17)), ("b", 3): [1]}
    bad = frames.withColumn("orientation", F.lit("upside down"))
    with pytest.raises(Exception, match="vertical or horizontal"):
        scans.stored_captures(bad, shots).collect()
