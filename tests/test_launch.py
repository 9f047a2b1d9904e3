"""Launch extraction: every way to an angle from payloads with planted tones, and the choice of frames against a plain model."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swinglake.functions import radc
from swinglake.operators import launch

N = 256
SCHEMA = "shot long, orientation string, frame long, timestamp double, radc binary, ball_speed double, impact_timestamp double, mount_deg double, distance_ft double, offset_deg double"


def payload(tones=(), seed=0):
    """Quiet codes with (km/h, degrees, amplitude) tones; the angle is what the radar should read."""
    codes = np.full((6, N), 32768.0) + np.random.default_rng(seed).integers(-50, 50, (6, N))
    for kmh, degrees, size in tones:
        phase = 2 * np.pi * kmh / 200 * np.arange(N)
        turn = -2 * np.pi * radc.SPACING_M * math.sin(math.radians(degrees)) / radc.WAVELENGTH_M
        codes[0] += size * np.cos(phase)
        codes[1] += size * np.sin(phase)
        codes[2] += size * np.cos(phase + turn)
        codes[3] += size * np.sin(phase + turn)
    return np.clip(codes, 0, 65535).astype("<u2").tobytes()


def aliased(mph):
    return (mph * 1.609 + 100) % 200 - 100


def bearing(alpha, t, speed=72.0, distance=5.5, mount=18.0):
    a = math.radians(alpha)
    return math.degrees(math.atan2(-4 / 12 + speed * 1.46667 * math.sin(a) * t, distance + speed * 1.46667 * math.cos(a) * t)) - mount


def shot(number, tones, orientation="vertical", speed=72.0, impact=1000.0, offset=0.0, quiet=6):
    """Quiet frames, then one for each (seconds after impact, tones)."""
    rows = [(number, orientation, i, 1000.0 - (quiet - i) * 0.056, payload(seed=i), speed, impact, 18.0, 5.5, offset) for i in range(quiet)]
    return rows + [(number, orientation, quiet + i, 1000.0 + t, payload(x, 90 + i), speed, impact, 18.0, 5.5, offset) for i, (t, x) in enumerate(tones)]


def ball(t, alpha=16.0, size=5000, off=0.0, angle=None, speed=72.0):
    return t, [(aliased(speed) + off, bearing(alpha, t, speed) if angle is None else angle, size)]


@pytest.fixture(scope="module")
def shots():
    k = aliased(72.0)
    return {
        "primary": shot(1, [ball(0.056), ball(0.084, size=6000)]),
        "offset": shot(2, [(0.056, [(k, bearing(16, 0.056) - 5, 4000)]), (0.084, [(k, bearing(16, 0.084) - 5, 6000)])], offset=5.0),
        "early": shot(3, [ball(0.012, size=4500), ball(0.040, size=6000)]),
        "single": shot(4, [ball(0.056, angle=bearing(16, 0.056), size=6000)]),
        "not_rising": shot(5, [ball(0.050, angle=10.0), ball(0.078, angle=2.0, size=6000)]),
        "horizontal": shot(6, [(0.056, [(k, 6.0, 5000)]), (0.084, [(k, 6.0, 5000)])], "horizontal"),
        "too_wide": shot(7, [(0.056, [(k, 25.0, 5000)]), (0.084, [(k, 25.0, 5000)])], "horizontal"),
        "no_impact_time": shot(8, [ball(0.056, angle=12.0), ball(0.084, angle=12.0)], impact=None),
        "blind": shot(9, [ball(0.056, speed=124.3, angle=14.0, off=6.0), ball(0.084, speed=124.3, angle=14.5, off=6.0)], speed=124.3),
        "quiet": shot(10, []),
        "free": shot(11, [(0.056, [(-25.0, 9.0, 5000)]), (0.084, [(-25.0, 9.0, 5000)])], "any", speed=None),
        "late": shot(12, [ball(0.16, angle=11.0), ball(0.19, angle=11.0)]),
    }


@pytest.fixture(scope="module")
def found(spark, shots):
    rows = [r for s in shots.values() for r in s]
    rows += [(13, "vertical", i, 1000.0 + i, None if i % 2 else b"short", 72.0, 1000.0, 18.0, 5.5, 0.0) for i in range(6)]
    got = launch.launch_angles(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = {s[0][0]: name for name, s in shots.items()}
    return {names[r.shot]: r for r in got}


def test_ways(found):
    way = {name: (r.estimator, r.path) for name, r in found.items()}
    assert way == {
        "primary": ("geometry", "geometry_primary"),
        "offset": ("geometry", "geometry_primary"),
        "early": ("geometry", "geometry_early_assisted"),
        "single": ("geometry_single_frame", "geometry_single_frame"),
        "not_rising": ("geometry_single_frame", "geometry_single_frame"),
        "horizontal": ("naive", "naive"),
        "no_impact_time": ("naive", "legacy_naive_suspect"),
        "blind": ("geometry", "geometry_primary"),
        "free": ("naive", "naive"),
        "late": ("naive", "legacy_naive_suspect"),
    }
    assert len(found["not_rising"].frames) == 1  # the anchor alone


def test_planted_angles(found):
    for name in ("primary", "offset", "early", "single"):
        assert abs(found[name].launch_angle - 16.0) < 1.0, name
    for name, angle in (("horizontal", 6.0), ("no_impact_time", 12.0), ("free", 9.0), ("late", 11.0)):
        assert abs(found[name].launch_angle - angle) < 0.5, name
    assert found["no_impact_time"].confidence <= 0.35 and found["blind"].confidence <= 0.35 and found["blind"].blind
    assert found["early"].confidence == pytest.approx(found["primary"].confidence - 0.08, abs=0.1)
    assert abs(found["primary"].ball_speed - 72.0) < 5.0  # of all detections, the quiet frame before impact too
    for f in found["primary"].fringes:  # one clean ray: nothing moves
        assert f.parts == 13 and f.swing < 2.0 and abs(f.balance_max - f.balance_min) < 0.1


def test_weak_neighbours_only_accompany(spark):
    k = aliased(72.0)
    # a strong other target in the band lifts the floor's ratio of nothing: the weak ball is near, but below five times the floor
    faint = lambda t, angle: (t, [(k, angle, 5.2)])
    rows = shot(1, [ball(0.040, angle=bearing(16, 0.040), size=6000), faint(0.068, bearing(16, 0.068))]) + shot(2, [faint(0.040, 3.0), faint(0.068, 4.0)])
    frames = launch.with_bands(spark.createDataFrame(rows, SCHEMA)).withColumns({"event": F.lit(0), "impact": F.lit(True)})
    seen = {(r.shot, r.frame): r for r in launch.candidates(frames).collect()}
    weak = [key for key, r in seen.items() if r.weak]
    for key in weak:
        assert 3.0 <= seen[key].snr < 5.0
    got = {r.shot: r for r in launch.events(launch.candidates(frames)).collect()}
    assert 1 in got and not any(seen[2, f].weak for f in (got[2].frames if 2 in got else []))


def plain_impacts(energies, factor=3.0):
    live = [e for e in energies if e > 0]
    if not live or np.median(energies) <= 0:
        return {}
    hits = [i for i, e in enumerate(energies) if e > factor * np.median(live)]
    groups = []
    for i in hits:
        if groups and i - groups[-1][-1] <= 5:
            groups[-1].append(i)
        else:
            groups.append([i])
    return {i + d: g for g, group in enumerate(groups) for i in group for d in range(-1, 3) if 0 <= i + d < len(energies)}


def test_impacts(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for s in range(40):
        energies = [rng.choice([0.0, 1.0, 1.2, 0.8, 1.1, 9.0 if s % 4 else 1.0]) for _ in range(rng.randint(1, 40))]
        rows += [(s, "vertical", i, e) for i, e in enumerate(energies)]
        expected |= {(s, i): g for i, g in plain_impacts(energies).items()}
    got = launch.impacts(spark.createDataFrame(rows, "shot long, orientation string, frame long, energy double").repartition(3), 3.0).collect()
    assert {(r.shot, r.frame): r.event for r in got} == expected


def plain_event(c, vertical, horizontal, timed, speed, offset, blind):
    """(estimator, path, angle, frames) of a shot's candidates by the rules, one after another; None where there is no result."""
    fits = lambda x: (x["bin_error"] is None or x["bin_error"] <= 50) and not (x["weak"] and x["snr"] < 3)
    first = [x for x in c if timed and x["t"] is not None and 0.020 <= x["t"] <= 0.100 and fits(x)]
    early = [x for x in c if timed and x["t"] is not None and 0.005 <= x["t"] < 0.020 and fits(x)]
    strong = [x for x in first if not x["weak"]]
    chosen, ruled = None, False
    if vertical and timed and strong:
        ruled = True
        a = min(strong, key=lambda x: (99999 if x["bin_error"] is None else x["bin_error"], -x["snr"], -1 if x["coherence"] is None else -x["coherence"], x["frame"]))
        for pool in (first, sorted(first + early, key=lambda x: x["frame"])):
            at = pool.index(a)
            for i, j in ((at - 1, at), (at, at + 1)):
                if chosen is None and i >= 0 and j < len(pool):
                    other = pool[i] if j == at else pool[j]
                    least = 3.0 if other["weak"] else max(2.0, 0.5 * a["snr"])
                    if other["snr"] >= least and pool[j]["angle"] > pool[i]["angle"]:
                        chosen = [pool[i], pool[j]]
        chosen = chosen or [a]
    else:
        chosen = [x for x in c if not x["weak"]]
        if len(chosen) >= 3:
            snrs, angles = [x["snr"] for x in chosen], [x["angle"] for x in chosen]
            if max(snrs) > 10 * max(np.median(snrs), 1.0):
                worst = int(np.argmin(snrs))
            else:
                worst = int(np.argmax([abs(x - np.median(angles)) for x in angles]))
            chosen = [x for i, x in enumerate(chosen) if i != worst]
    if not chosen or len(chosen) == 1 and chosen[0]["snr"] < 5:
        return None
    weigh = lambda x: x["snr"] ** 2 / (10 if x["bin_error"] is not None and x["bin_error"] > 25 else 1)
    angle = sum(x["angle"] * weigh(x) for x in chosen) / sum(map(weigh, chosen)) + offset
    kind = "naive"
    if vertical and speed is not None:
        grid = [i * 0.1 for i in range(451)]
        off = lambda x, g: x["angle"] + offset - bearing(g, x["t"], speed)
        flying = [x for x in chosen if x["t"] is not None and timed and 0 < x["t"] <= 0.150]
        alone = sorted((x for x in flying if not x["weak"]), key=lambda x: (x["t"], math.inf if x["bin_error"] is None else x["bin_error"], -x["snr"]))
        rmse = None
        if len(flying) >= 2:
            sums = [sum(weigh(x) * off(x, g) ** 2 for x in flying) for g in grid]
            best = int(np.argmin(sums))
            rmse = math.sqrt(sums[best] / sum(map(weigh, flying)))
            if any(x["weak"] for x in chosen) and rmse > 2 or len(alone) >= 2 and rmse > 4:
                rmse = None
            else:
                kind, angle = "geometry", grid[best]
        if rmse is None and alone:
            off_by = [abs(off(alone[0], g)) for g in grid]
            if min(off_by) <= 1:
                kind, angle, chosen = "geometry_single_frame", grid[int(np.argmin(off_by))], [alone[0]]
    if vertical and not 0 <= angle <= 45 or horizontal and abs(angle) > 15:
        return None
    by_early = any(x["t"] is not None and timed and 0.005 <= x["t"] < 0.02 for x in chosen)
    path = kind if not vertical else {"geometry": "geometry_early_assisted" if by_early else "geometry_primary"}.get(kind, kind if kind != "naive" else "naive_rule_stack" if ruled else "legacy_naive_suspect")
    return kind, path, angle, [x["frame"] for x in chosen]


def test_choice_of_frames(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for s in range(500):
        orientation = ("vertical", "vertical", "horizontal", "any")[s % 4]
        timed, speed, offset = s % 7 != 0, None if s % 13 == 0 else 72.0, rng.choice([0.0, 2.0])
        alpha, c = rng.uniform(2, 40), []
        for frame in range(rng.randint(1, 7)):
            t = None if rng.random() < 0.05 else round(rng.choice([0.0, 0.003, 0.006, 0.012, 0.018, 0.021, 0.04, 0.06, 0.09, 0.098, 0.11, 0.14, 0.16]), 4)
            angle = (bearing(alpha, t or 0.03) if rng.random() < 0.6 else rng.uniform(-20, 40)) + rng.choice([0, 0, 1.5])
            error = None if speed is None else rng.choice([0, 3, 10, 26, 49, 60])
            snr = rng.choice([2.1, 2.9, 3.4, 4.9, 6.0, 8.0, 11.0, 300.0])
            c.append({"frame": frame, "t": t, "bin_error": error, "snr": snr, "angle": angle, "coherence": rng.choice([None, 0.5, 0.9]), "weak": error is not None and error <= 25 and snr < 5 and orientation == "vertical"})
        for x in c:
            rows.append((s, orientation, x["frame"], None if x["t"] is None else 0.0 + x["t"], speed, 0.0 if timed else None, 18.0, 5.5, offset, s % 5 == 0,
                         None if speed is None else 1000, 0, True, 1000 + (x["bin_error"] or 0), x["snr"], x["angle"], 3, x["coherence"], x["weak"], 13, 0.0, 0.0, 1.0, 1.0))
        expected[s] = plain_event(c, orientation == "vertical", orientation == "horizontal", timed, speed, offset, s % 5 == 0)
    schema = "shot long, orientation string, frame long, timestamp double, ball_speed double, impact_timestamp double, mount_deg double, distance_ft double, offset_deg double, blind boolean, expected int, event int, impact boolean, " + launch.CANDIDATE
    got = {r.shot: r for r in launch.events(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert {s for s, e in expected.items() if e} == set(got)
    assert len({e[1] for e in expected.values() if e}) == 6
    for s, e in expected.items():
        if e:
            assert (got[s].estimator, got[s].path, got[s].frames) == (e[0], e[1], e[3]), s
            assert got[s].launch_angle == pytest.approx(e[2], abs=0.0501), s
            assert 0 <= got[s].confidence <= (0.35 if s % 5 == 0 else 1.0)


def test_best_event_is_by_way_first(spark):
    schema = "shot long, orientation string, event int, launch_angle double, estimator string, path string, frames array<long>, confidence double, fit_rmse double, latest long, snr double"
    rows = [
        (1, "vertical", 0, 10.0, "geometry", "geometry_primary", [1, 2], 0.4, 1.0, 5, 3.0),
        (1, "vertical", 1, 20.0, "naive", "naive_rule_stack", [9], 0.9, None, 12, 30.0),
        (2, "vertical", 0, 10.0, "naive", "legacy_naive_suspect", [1], 0.3, None, 5, 3.0),
        (2, "vertical", 1, 20.0, "naive", "legacy_naive_suspect", [9], 0.3, None, 12, 2.0),
        (3, "vertical", 0, 10.0, "geometry", "geometry_early_assisted", [1, 2], 0.9, 0.1, 5, 3.0),
        (3, "vertical", 1, 20.0, "geometry", "geometry_primary", [9, 10], 0.2, 3.0, 2, 1.0),
    ]
    got = {r.shot: r.event for r in launch.best_events(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_fringes_see_two_rays():
    """A second ray whose phase turns within the frame makes the angle swing; one ray alone doesn't."""
    k, kmh = np.arange(N), -30.0
    tone = np.exp(2j * np.pi * kmh / 200 * k)
    turn = np.exp(-2j * np.pi * radc.SPACING_M * np.sin(np.radians(10.0)) / radc.WAVELENGTH_M)
    ground = 0.6 * np.exp(2j * np.pi * (kmh / 200 * k + 3.0 * k / N))
    a = np.stack([tone, tone + ground, np.zeros(N)])
    b = np.stack([tone * turn, tone * turn + ground * np.conj(turn), np.zeros(N)])
    peak = np.full(3, round((200 + kmh) / 200 * 2048))
    m = radc.fringes(a, b, peak)
    assert m["parts"].tolist() == [13, 13, 0] and m["swing"][0] < 1e-6 and m["swing"][1] > 5 and np.isnan(m["swing"][2])
    for i in (0, 1):  # against whole spectra of each part
        angles, balances = [], []
        for at in range(0, N - 63, 16):
            x, y = (radc.spectra(c[i, at : at + 64]) for c in (a, b))
            lo = peak[i] - 16
            best = lo + int(np.argmax(np.abs(x[lo : lo + 33]) + np.abs(y[lo : lo + 33])))
            angles.append(radc.arrival(x[best] * np.conj(y[best])))
            balances.append(abs(y[best]) / abs(x[best]))
        assert np.allclose([m["swing"][i], m["deviation"][i], m["balance_min"][i], m["balance_max"][i]], [np.ptp(angles), np.std(angles), min(balances), max(balances)])


def test_decode_and_bands():
    good = payload([(30.0, 5.0, 4000)])
    whole, codes = radc.decode(pa.array([None, good, b"x", good], pa.binary()))
    assert whole.tolist() == [1, 3] and codes.shape == (2, 6, 256) and (codes[0] == np.frombuffer(good, "<u2").reshape(6, 256)).all()
    assert radc.decode(pa.array([], pa.binary()))[1].shape == (0, 6, 256)
    m = np.zeros((2, 2048))
    m[0, [2040, 5, 700]] = [3.0, 4.0, 9.0]
    at, value, band = radc.strongest(m, np.array([[[2000, 2048], [0, 60]]] * 2))
    assert at.tolist() == [5, -1] and value.tolist() == [4.0, 0.0] and band[0].tolist() == [0, 60]
    at, value, _ = radc.strongest(m, np.array([[[2000, 2048], [0, 60]]] * 2), np.array([2042, 2042]), 8)
    assert at.tolist() == [2040, -1]


def test_steered_power_and_detections():
    x = radc.spectra(radc.complex_channels(radc.decode(pa.array([payload([(-30.0, 12.0, 6000)])]))[1]))
    angles = np.arange(-60, 61, 1.0)
    power = radc.angle_power(x[:, 0], x[:, 1], angles)[0]
    angle, at = np.unravel_index(power.argmax(), power.shape)
    # both receivers are in phase where the turn is undone
    assert abs(angles[angle] + 12.0) <= 1 and abs(at - round(170 / 200 * 2048)) <= 2
    frame, at, ratio = radc.detections(np.abs(x[:, 0]), 8.0)
    m = np.abs(x[0, 0])
    plain = [i for i in range(20, 2028) if np.median(np.r_[m[i - 20 : i - 4], m[i + 5 : i + 21]]) > 0 and m[i] > 8 * np.median(np.r_[m[i - 20 : i - 4], m[i + 5 : i + 21]])]
    assert at.tolist() == plain and (ratio > 8).all()


def test_payloads_stay_in_their_task(spark, sf):
    """Peaks are read before frames are shuffled by shot, and give what reading them around impacts alone gives."""
    frames = launch.frame_signals(spark, sf)
    plan = launch.around_impacts(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(shot") < plan.index("MapInArrow run")
    late = launch.candidates(launch.impacts(launch.with_energy(launch.with_bands(frames)), 3.0))
    early = launch.around_impacts(frames).select(*late.columns)
    assert early.count() > 0 and not early.exceptAll(late).count() and not late.exceptAll(early).count()
