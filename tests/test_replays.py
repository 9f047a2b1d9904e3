"""Replays against plain models: clusters, bins that could be the ball, clock shifts, whole periods, sidebands, the simplex."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_launch import SCHEMA, aliased, bearing, payload, shot

from swinglake.functions import ladder, radc, sidebands
from swinglake.functions.spin import FS, MPS_TO_MPH, WAVELENGTH_M
from swinglake.operators import launch, replays

PERIOD = replays.PERIOD_FT


def test_densest_cluster(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([100, 104, 109, 130, 133, 400]), rng.choice([7.0, 8.0, 9.0, 20.0]), rng.uniform(-10, 10)) for s in range(60) for i in range(rng.randint(1, 9))]
    got = {r.shot: r for r in replays.agreeing(spark.createDataFrame(rows, "shot int, frame int, bin int, snr double, angle double"), ["shot"], "frame").collect()}
    for s in range(60):
        mine = [r for r in rows if r[0] == s and r[3] >= 8]
        best = max(((sum(abs(b[2] - a[2]) <= 10 for b in mine), sum(b[3] for b in mine if abs(b[2] - a[2]) <= 10), -a[1], a[2]) for a in mine), default=(0,))
        if best[0] < 2:
            assert s not in got
            continue
        held = [r for r in mine if abs(r[2] - best[3]) <= 10]
        w = [r[3] ** 2 for r in held]
        assert got[s].frames == len(held) and got[s].angle == pytest.approx(sum(r[4] * x for r, x in zip(held, w, strict=True)) / sum(w))
        assert got[s].bin == int(np.median([r[2] for r in held]))


def test_bins_that_could_be_the_ball(spark):
    k, impact = aliased(72.0), 1000.0
    data = payload([(k, bearing(16, 0.05), 900), (k + 6, 40.0, 500)], 3)
    rows = [(1, "vertical", 0, impact + 0.05, data, 72.0, impact, 18.0, 5.5, 0.0), (1, "vertical", 1, impact + 0.2, data, 72.0, impact, 18.0, 5.5, 0.0), (1, "vertical", 2, impact + 0.05, None, 72.0, impact, 18.0, 5.5, 0.0)]
    got = {r.bin: r for r in replays.ball_bins(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = radc.spectra(radc.complex_channels(np.frombuffer(data, "<u2").reshape(1, 6, 256)))[0]
    m = np.abs(x[0])
    floor, expected = np.median(m[m > 0]), int(2048 + k * 1024 / 100)
    lo, hi = (int(2048 + (k + s * 16.09) * 1024 / 100) for s in (-1, 1))
    band = sorted(range(lo, hi), key=lambda b: (-m[b], b))
    plain = {}
    for b in range(lo, hi):
        if m[b] / floor >= 3 and abs(b - expected) <= 80:
            angle = float(radc.arrival(x[0, b] * np.conj(x[1, b])))
            off = [abs(angle - bearing(a * 0.1, 0.05)) for a in range(451)]
            if min(off) <= 1:
                plain[b] = (m[b] / floor, int(np.argmin(off)) * 0.1, band.index(b) + 1, m[b] >= max(m[b - 1], m[b + 1]))
    assert set(got) == set(plain) and plain
    for b, (snr, alpha, place, local) in plain.items():
        assert (got[b].snr, got[b].launch_angle, got[b].place, got[b].local_peak) == (pytest.approx(snr), pytest.approx(alpha), place, local) and got[b].frame == 0


def test_whole_periods(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for s in range(100):
        frames = [(0.01 * i, None if rng.random() < 0.1 else round(rng.uniform(0, PERIOD), 3), rng.choice([10, 90, None]) if rng.random() < 0.3 else 5, rng.choice([2.0, 5.0])) for i in range(rng.randint(0, 8))]
        last, out = None, []
        for t, r, off, snr in frames:
            if r is None or off is None or off > 80 or snr < 3:
                out.append(r)
                continue
            if t >= 0.020:
                while r < 5.5 - 0.75:
                    r += PERIOD
            if last is not None:
                while r < last - 0.75:
                    r += PERIOD
            last = r
            out.append(r)
        rows.append((s, frames))
        expected[s] = out
    df = spark.createDataFrame(rows, "s int, f array<struct<t: double, range: double, bin_error: int, snr: double>>")
    for r in df.select("s", ladder.unwrapped(F.col("f"), PERIOD, F.lit(5.5)).alias("out")).collect():
        assert len(r.out) == len(expected[r.s])
        for a, b in zip(r.out, expected[r.s], strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b))


def test_choice_by_strength(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for s in range(300):
        c = [(i, rng.choice([None, -0.01, 0.01, 0.02, 0.05, 0.07, 0.1, 0.12, 0.13]), rng.choice([2.0, 4.0, 6.0, 9.0]), rng.uniform(-5, 5), rng.choice([None, 3, 60])) for i in range(rng.randint(0, 6))]
        c = sorted(c, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
        c = [(i, *x[1:]) for i, x in enumerate(c)]
        heard = [x for x in c if x[1] is not None and 0 <= x[1] <= 0.125 and x[2] >= 3]
        pool = [x for x in heard if 0.02 <= x[1] <= 0.1 and x[2] >= 5]
        pick = None
        if pool:
            a = min(pool, key=lambda x: (-x[2], abs(x[1] - 0.06), 99999 if x[4] is None else x[4], x[0]))
            two = [((x, a) if x[1] < a[1] else (a, x)) for x in heard if x is not a and abs(x[0] - a[0]) <= 2]
            two = [p for p in two if p[1][3] >= p[0][3]]
            pick = [x[0] for x in (min(two, key=lambda p: (-min(p[0][2], p[1][2]), abs(p[0][0] - p[1][0]), p[0][0])) if two else (a,))]
        rows.append((s, [(x[0], x[1], x[2], x[3], x[4]) for x in c]))
        expected[s] = pick
    df = spark.createDataFrame(rows, "s int, f array<struct<frame: int, t: double, snr: double, angle: double, bin_error: int>>")
    got = {r.s: None if r.b is None else [x.frame for x in r.b] for r in df.select("s", ladder.broad(F.col("f")).alias("b")).collect()}
    assert got == expected and any(p and len(p) == 2 for p in expected.values())


def ranged(t, alpha, size=5000, speed=72.0):
    """A frame with the ball's tone at both frequencies, the second turned by its range."""
    a, k = math.radians(alpha), aliased(speed)
    along, up = 5.5 + speed * 1.46667 * math.cos(a) * t, -4 / 12 + speed * 1.46667 * math.sin(a) * t
    codes = np.frombuffer(payload([(k, bearing(alpha, t, speed), size)], int(t * 1000)), "<u2").reshape(6, 256).astype(float)
    phase = 2 * np.pi * k / 200 * np.arange(256) + 2 * np.pi * math.hypot(along, up) / PERIOD
    codes[4] += size * np.cos(phase)
    codes[5] += size * np.sin(phase)
    return np.clip(codes, 0, 65535).astype("<u2").tobytes()


def test_clock_shift_is_found_from_ranges(spark):
    rows = []
    for number, late in ((1, 0.0), (2, 0.006), (3, -0.004)):
        quiet = shot(number, [])
        rows += quiet + [(number, "vertical", 6 + i, 1000.0 + t + late, ranged(t, 16.0), 72.0, 1000.0, 18.0, 5.5, 0.0) for i, t in enumerate((0.045, 0.070))]
    for by_strength in (False, True):
        got = {r.shot: r for r in replays.range_fits(spark.createDataFrame(rows, SCHEMA), by_strength).collect()}
        for number, late in ((1, 0), (2, -6), (3, 4)):
            r = got[number]
            assert abs(r.shift_ms - late) <= 1 and abs(r.shifted_angle - 16.0) < 0.5 and r.shifted_range_rmse < 0.2, r
        assert got[2].range_rmse > 0.4 and got[2].frames == [6, 7]


def test_pairs_that_disagree_fall_back(spark):
    """Two strong frames whose bearings no launch angle gives together: the earlier one alone sets the angle."""
    chosen = [{"t": 0.03, "frame": 1, "bin_error": 0, "snr": 9.0, "angle": bearing(20, 0.03), "coherence": 1.0, "weak": False, "range": None}, {"t": 0.06, "frame": 2, "bin_error": 0, "snr": 9.0, "angle": 60.0, "coherence": 1.0, "weak": False, "range": None}]
    schema = "shot long, orientation string, chosen array<struct<t: double, frame: long, bin_error: int, snr: double, angle: double, coherence: double, weak: boolean, range: double>>, ball_speed double, distance_ft double, mount_deg double"
    rows = [(1, "vertical", chosen, 72.0, 5.5, 18.0), (2, "vertical", chosen[:1], 72.0, 5.5, 18.0), (3, "vertical", chosen[1:], 72.0, 5.5, 18.0), (4, "vertical", chosen, None, 5.5, 18.0)]
    df = spark.createDataFrame([(a, b, [tuple(x.values()) for x in c], *d) for a, b, c, *d in rows], schema)
    got = {r.shot: r for r in df.mapInArrow(replays._shifted(np.arange(-5, 5.5, 1.0)), replays.FITS).collect()}
    assert got[1].fell_back and got[1].frames == [1] and abs(got[1].angle - 20.0) < 0.2
    assert not got[2].fell_back and abs(got[2].angle - 20.0) < 0.2 and got[2].range_rmse is None
    assert got[3].angle is None and got[4].angle is None and got[4].shift_ms is None


def seam(mph, hz, depth, drift, seed, start=0.02):
    t = np.arange(4096) / FS
    rng = np.random.default_rng(seed)
    f = 2 * mph / MPS_TO_MPH / WAVELENGTH_M
    phase = 2 * np.pi * (f * t + drift * t * t / 2)
    size = 300 * (1 + depth * np.cos(2 * np.pi * hz * t)) * (t >= start)
    return size * np.cos(phase) + rng.normal(0, 4, len(t)) + 2048, size * np.sin(phase) + rng.normal(0, 4, len(t)) + 2048


def test_sidebands_of_a_drifting_tone():
    """The course is read in steps of 117 Hz: a drift averages them out, a tone without one must lie on a step."""
    for seed, (mph, hz, drift) in enumerate([(120, 75, -3000), (150, 110, -5000), (58 * FS / 256 * MPS_TO_MPH * WAVELENGTH_M / 2, 150, 0), (140, 60, 2000)]):
        i, q = seam(mph, hz, 0.15, drift, seed)
        got = sidebands.sideband_spin(i, q, mph, 25.0)
        assert abs(got["spacing_hz"] - hz) < 9  # a cell of the window
        assert got["seen"] in ("1x", "2x") and abs(got["drift_hz_s"] - drift) < 900
        assert abs(sidebands.onset_ms(i + 1j * q) - 20.0) < 4
    quiet = np.random.default_rng(1).normal(2048, 4, (2, 4096))
    assert sidebands.onset_ms(quiet[0] + 1j * quiet[1]) is None and sidebands.sideband_spin(*quiet, 120, 25.0) is None
    assert sidebands.sideband_spin(*seam(120, 75, 0.1, 0, 1), 120, 136.0) is None


def test_side_ratio_is_that_of_one_bin_after_another():
    rng = np.random.default_rng(3)
    half = rng.random(4000)
    for k in (500, 901, 1600):
        ring = np.r_[half[k - 80 : k - 10], half[k + 11 : k + 80]]
        assert sidebands.side_ratio(half, np.array([k]), 10, 80)[0] == pytest.approx(half[k - 10 : k + 11].max() / np.median(ring))


def test_simplex_finds_the_least_error(spark):
    rng = np.random.default_rng(4)
    x, session = rng.uniform(0.2, 2, 400), rng.integers(0, 5, 400)
    y = 3.0 * x**1.7 + rng.normal(0, 0.05, 400) + (session == 2) * 0.3
    df = spark.createDataFrame([(float(a), float(b), int(s)) for a, b, s in zip(x, y, session, strict=True)], "x double, y double, s int")
    model = lambda p: p[0] * F.pow(F.col("x"), p[1])
    got = replays.simplex_fit(df, model, F.col("y"), F.col("s"), [-1, 0, 2], [2.0, 1.0], [0.5, 0.3], rounds=80, tolerance=1e-9)
    for fold, (p, loss) in got.items():
        keep = session != fold
        # for a given power the best factor is known, so a line search gives the least error
        def least(power):
            b = x[keep] ** power
            return float(np.sqrt(np.mean((y[keep] - (y[keep] @ b) / (b @ b) * b) ** 2)))

        best = min(least(w) for w in np.linspace(1.4, 2.0, 2001))
        assert loss == pytest.approx(best, rel=1e-4) and loss == pytest.approx(float(np.sqrt(np.mean((p[0] * x[keep] ** p[1] - y[keep]) ** 2))), rel=1e-9)
    assert got[2][1] < got[-1][1]  # without the session that is off


def test_launch_uses_the_same_grid():
    assert len(launch.ANGLES) == 451 and launch.ANGLES[-1] == pytest.approx(45.0)


def test_clock_shift_fits_joins_no_payloads(spark, sf):
    found = replays.clock_shift_fits(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    frames = launch.frame_signals(spark, sf).where("orientation = 'vertical'")
    for by, strength in (("rules", False), ("strength", True)):
        one, mine = replays.range_fits(frames, strength), found.where(F.col("by") == by).drop("by")
        assert mine.count() > 0 and not mine.exceptAll(one).count() and not one.exceptAll(mine).count()


def test_comb_looks_at_each_bin_once(monkeypatch):
    """Medians are those of the bins that count, and bins that harmonics share are looked at once."""
    rng = np.random.default_rng(4)
    half, k = rng.random(3000), np.array([40, 57, 58, 900, 2000])
    for cell, ring in ((3, 40), (7, 57), (1, 9)):
        outer = np.concatenate((np.arange(-ring, -cell), np.arange(cell + 1, ring)))
        plain = [max(half[c - cell : c + cell + 1]) / np.median([half[c + o] for o in outer if c + o >= 1]) for c in k[k >= ring]]
        assert sidebands.side_ratio(half, k[k >= ring], cell, ring).tolist() == plain
    asked, pairs = [], sidebands.pairs
    monkeypatch.setattr(sidebands, "pairs", lambda spectrum, f, n: asked.append(np.rint(f / (FS / sidebands.COMB_FFT)).tolist()) or pairs(spectrum, f, n))
    t = np.arange(2400) / FS
    sidebands.comb((1 + 0.2 * np.cos(2 * np.pi * 90 * t)) + rng.normal(0, 0.01, 2400) * 1j)
    assert len(asked[0]) == len(set(asked[0])) < 3 * len(np.arange(sidebands.COMB_LOW, sidebands.COMB_HIGH, sidebands.COMB_STEP))
