"""Frame diagnostics against plain code, quantiles by strips, numbering by ranges, and lines of the radar."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_launch import SCHEMA, aliased, payload, shot

from swinglake.functions import radc, stats
from swinglake.functions.stats import quantiles
from swinglake.operators import frames, logs, pairing, summaries


@pytest.fixture(scope="module")
def diagnosed(spark):
    k = aliased(72.0)
    rows = shot(1, [(0.05, [(k, 12.0, 5000)]), (0.08, [(k, 12.0, 5000)]), (0.1, [(k, 60.0, 5000)]), (0.12, [(k + 12, 10.0, 5000)])], quiet=2)
    rows += [(1, "vertical", 20, 1001.0, None, 72.0, 1000.0, 18.0, 5.5, 0.0), (1, "vertical", 21, 1001.0, b"abc", 72.0, 1000.0, 18.0, 5.5, 0.0)]
    loud = (np.full((6, 256), 32768.0) + 60000 * np.cos(np.arange(256) * 0.3)).clip(0, 65535).astype("<u2").tobytes()
    rows += [(1, "vertical", 22, 1001.0, loud, 72.0, 1000.0, 18.0, 5.5, 0.0), (2, "horizontal", 0, 1001.0, b"\x00\x80" * 1536, None, None, None, None, None)]
    uneven = np.full((6, 256), 32768.0)
    uneven[0] += 3000 * np.cos(np.arange(256) * 0.3)
    uneven[1] += 100 * np.sin(np.arange(256) * 0.3)
    rows += [(2, "horizontal", 1, 1001.0, uneven.astype("<u2").tobytes(), 72.0, None, None, None, None)]
    return frames.frame_diagnostics(spark.createDataFrame(rows, SCHEMA).repartition(2))


def test_diagnoses(diagnosed):
    got = {(r.shot, r.frame): r for r in diagnosed.collect()}
    assert (got[1, 20].has_radc, got[1, 20].valid, got[1, 20].reason, got[1, 20].warnings) == (False, False, "missing_radc", ["missing_radc"])
    assert (got[1, 21].has_radc, got[1, 21].valid, got[1, 21].reason, got[1, 21].warnings) == (True, False, "invalid_payload_size", ["invalid_payload"])
    ball = got[1, 2]
    assert ball.warnings == [] and abs(ball.angle - 12.0) < 0.3 and ball.bin_error <= 2 and abs(ball.speed_error) < 0.5 and ball.coherence > 0.99
    assert ball.snr_db == pytest.approx(10 * np.log10(ball.magnitude / ball.floor))
    assert "outside_vertical_bounds" in got[1, 4].warnings and "far_from_ops_bin" in got[1, 5].warnings
    assert {w for w in got[1, 22].warnings if w.startswith("adc")} == {f"adc_clipping:{c}" for c in radc.CHANNELS}
    assert got[2, 0].reason == "no_peak_in_target_band" and got[2, 0].warnings == ["no_peak_in_target_band"]
    assert "iq_imbalance:f1a" in got[2, 1].warnings


def test_capture_diagnostics(diagnosed):
    rows = diagnosed.collect()
    for r in frames.capture_diagnostics(diagnosed, ["shot", "orientation"]).collect():
        mine = [x for x in rows if x.shot == r.shot]
        peaks = [x for x in mine if x.peak_bin is not None]
        assert (r.frames, r.valid, r.with_peak) == (len(mine), sum(x.valid for x in mine), len(peaks))
        assert r.median_snr_db == pytest.approx(np.median([x.snr_db for x in peaks])) and r.max_snr_db == max(x.snr_db for x in peaks)
        counts = {}
        for x in mine:
            for w in x.warnings:
                counts[w] = counts.get(w, 0) + 1
        assert r.warnings == counts
        bins = [x.peak_bin for x in peaks]
        assert [tuple(x) for x in r.fullest] == sorted(((b, bins.count(b)) for b in set(bins)), key=lambda x: (-x[1], x[0]))[:8]


def test_channels_of_a_payload(spark):
    df = spark.createDataFrame([(1, payload([(20.0, 5.0, 3000)])), (2, None), (3, b"x")], "id int, radc binary")
    got = {r.channel: r for r in frames.channel_rows(df, ["id"]).collect()}
    codes = np.frombuffer(payload([(20.0, 5.0, 3000)]), "<u2").reshape(6, 256)
    assert set(got) == set(radc.CHANNELS)
    for c, name in zip(codes, radc.CHANNELS, strict=True):
        assert (got[name].least, got[name].most, got[name].range) == (c.min(), c.max(), int(c.max()) - int(c.min()))
        assert got[name].mean == pytest.approx(c.mean()) and got[name].deviation == pytest.approx(c.std())


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0.0, rng.gauss(0, 10 ** rng.randint(-3, 3)), 5.0, -5.0, 1e-300, -1e300])) for k in ("a", "b", None) for _ in range(rng.randint(150, 300))]
    rows += [("one", 3.0), ("none", None)] + [("same", 2.5)] * 40
    ps = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.k: r.q for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", ps).collect()}
    assert set(got) == {"a", "b", None, "one", "same"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for key, v in rows if key == k and v is not None], ps), rtol=1e-12, atol=0)
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", ps).collect() == []


def test_numbering_by_bounded_ranges(spark):
    """Positions are those of one sort, and what a window over ranges holds is bounded by days, whatever the rows."""
    rng = random.Random(3)
    for rows in (400, 4000):
        data = [(rng.choice("xy"), None if rng.random() < 0.02 else rng.randint(0, 30), rng.randint(0, rows * 10), i) for i in range(rows)]
        df = spark.createDataFrame(data, "club string, day int, key int, id int")
        got = {r.id: r.pos for r in pairing.numbered(df, ["club"], ["day", "key", "id"], F.col("day"), F.expr("key div 100")).collect()}
        for club in "xy":
            mine = sorted((r for r in data if r[0] == club), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
            assert [got[r[3]] for r in mine] == list(range(1, len(mine) + 1))
        starts = pairing.range_starts(df.withColumns({"__c": F.col("day"), "__f": F.expr("key div 100")}), ["club"])
        assert starts.groupBy("club", "__c").count().groupBy("club").count().agg(F.max("count")).first()[0] <= 32


def test_radar_lines(spark):
    lines = {
        '{"speed": -12.5, "magnitude": 7}': ("outbound", 12.5, 7.0),
        '{"speed": [3, -9], "magnitude": [4, 8]}': ("inbound", 3.0, 4.0),
        '{"speed": [-3], "magnitude": []}': ("outbound", 3.0, None),
        '{"speed": [], "magnitude": [1]}': None,
        '{"magnitude": 2}': ("outbound", 0.0, 2.0),
        '{"speed": 5, "magnitude": 0}': ("inbound", 5.0, None),
        '{"speed": "fast"}': None,
        '{"speed": 5': None,
        "-7.25": ("outbound", 7.25, None),
        "4": ("inbound", 4.0, None),
        "?": None,
        "": None,
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(99, None)], "id int, line string")
    got = {r.line: (r.direction, r.speed_mph, r.magnitude) for r in logs.radar_readings(df, "line").collect()}
    assert got == {k: v for k, v in lines.items() if v}


def test_numbered_rows_are_dealt_once(spark):
    """Rows meet the start of their range where they were numbered: no second shuffle by other keys, nulls or not."""
    df = spark.createDataFrame([(None, 1, 5), (None, 1, 3), ("a", None, 4), ("a", 2, 9), ("a", None, 1)], "club string, day int, key int")
    got = pairing.numbered(df, ["club"], ["day", "key"], F.col("day"), F.expr("key div 4"))
    shuffles = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert shuffles and not any("coalesce(" in line or "isnull(" in line for line in shuffles)
    assert {(r.club, r.day, r.key): r.pos for r in got.collect()} == {(None, 1, 3): 1, (None, 1, 5): 2, ("a", 2, 9): 1, ("a", None, 1): 2, ("a", None, 4): 3}


def test_replay_rows_are_counted(spark, sf):
    rows, pairs = summaries.replay_rows(spark, sf), pairing.good_errors(spark, sf)
    assert rows.agg(F.sum("n")).first()[0] == len(summaries.PARAMETERS) * pairs.count()
    assert rows.count() == rows.select("least", "club", "source_id", "reason", "e").count() and not pairs.groupBy("club", "source_id", "confidence", "frames", "e_launch").count().where("count < 1").count()
    plain = spark.createDataFrame([("a", float(v)) for v in (1, 1, 1, 2, 5, 5, 9)] + [("b", 3.0)], "k string, v double")
    counted = plain.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for p in (0.0, 0.3, 0.5, 0.9, 1.0):
        assert sorted(stats.nearest_rank(plain, ["k"], "v", p).collect()) == sorted(stats.nearest_rank(counted, ["k"], "v", p, "n").collect())
        assert sorted(stats.quantiles(plain, ["k"], "v", (p,)).collect()) == sorted(stats.quantiles(counted, ["k"], "v", (p,), "n").collect())
