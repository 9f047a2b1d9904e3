"""Replays of shots by other rules, for comparison: frame clusters, range and clock fits, sidebands, and fits of coefficients across sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions import ladder, radc, sidebands
from swinglake.functions.lens import lens, with_lenses
from swinglake.operators.launch import ABOVE_FT, ANGLES, MPH_TO_FTS, PERIOD_FT, SHOT, Settings, _bands, _pieces, around_impacts, frame_signals, with_bands
from swinglake.operators.sessions import READINGS
from swinglake.operators.spin import DERIVED, Run, capture_vectors, kept_columns, over_captures

# frames that agree


def agreeing(frames: DataFrame, keys: list[str], order: str, least: float = 8.0, within: int = 10) -> DataFrame:
    """Per key the angle of the densest cluster of strong frames: those whose bin is ``within`` that of one of them.

    Of equally dense ones the stronger in sum, then the first. Keys with fewer than two frames in it are left out. ``frames`` has ``bin``, ``snr``
    and ``angle``; a key's frames are a buffer's.
    """
    strong = frames.where(F.col("snr") >= least).select(*keys, order, "bin", "snr", "angle")
    around = Window.partitionBy(*keys).orderBy("bin").rangeBetween(-within, within)
    scored = strong.withColumns({"near": F.count(F.lit(1)).over(around), "sum": F.sum("snr").over(around)})
    first = Window.partitionBy(*keys).orderBy(F.desc("near"), F.desc("sum"), order)
    centre = F.first("bin").over(first)
    held = scored.withColumn("centre", centre).where(F.abs(F.col("bin") - F.col("centre")) <= within)
    w = F.col("snr") * F.col("snr")
    found = held.groupBy(*keys).agg(
        (F.sum(F.col("angle") * w) / F.sum(w)).alias("angle"),
        F.count(F.lit(1)).alias("frames"),
        F.avg("snr").alias("snr"),
        F.min("snr").alias("least_snr"),
        F.stddev_pop("angle").alias("spread"),
        F.floor(F.median("bin")).alias("bin"),
        (F.max("bin") - F.min("bin")).alias("span"),
    )
    return found.where("frames >= 2")


def near_speed(frames: DataFrame, keys: list[str], within: int = 25, least: float = 2.0) -> DataFrame:
    """Per key the angle of the frames whose bin is near the ``expected`` one, weighted by power; keys without such a frame are left out."""
    held = frames.where((F.col("snr") >= least) & (F.abs(F.col("bin") - F.col("expected")) <= within))
    w, off = F.col("snr") * F.col("snr"), F.col("bin") - F.col("expected")
    return held.groupBy(*keys).agg(
        (F.sum(F.col("angle") * w) / F.sum(w)).alias("angle"), F.count(F.lit(1)).alias("frames"), F.max("snr").alias("most_snr"), F.stddev_pop("angle").alias("spread"), F.avg(off).alias("off"), F.max(F.abs(off)).alias("most_off")
    )


def _readings_as_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a session's hour as the frames of a shot."""
    r = lens(spark, sf_dir, "readings")
    return r.select(
        "session_id", F.expr("us div 3600000000 % 24").alias("hour"), "seq", F.floor("speed_mph").alias("bin"), (F.col("magnitude") / 4).alias("snr"), (F.col("seq") * 7 % 60 - 30).cast("double").alias("angle"), (F.col("session_id") % 100).alias("expected")
    )


_FRAMES_SQL = READINGS + """, f AS (SELECT session_id, us // 3600000000 % 24 AS hour, seq, floor(speed_mph)::BIGINT AS bin, magnitude / 4 AS snr, (seq * 7 % 60 - 30)::DOUBLE AS angle, session_id % 100 AS expected FROM readings)"""


def frame_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agreeing(_readings_as_frames(spark, sf_dir), ["session_id", "hour"], "seq")
    return found.select("session_id", "hour", F.round("angle", 5).alias("angle"), "frames", F.round("snr", 5).alias("snr"), "least_snr", F.round("spread", 5).alias("spread"), "bin", "span")


CLUSTERS_SQL = _FRAMES_SQL + """, s AS (SELECT * FROM f WHERE snr >= 8),
n AS (SELECT a.session_id, a.hour, a.seq, a.bin, count(*) AS near, sum(b.snr) AS total FROM s a JOIN s b ON a.session_id = b.session_id AND a.hour = b.hour AND abs(a.bin - b.bin) <= 10 GROUP BY 1, 2, 3, 4),
c AS (SELECT session_id, hour, arg_min(bin, (-near, -total, seq)) AS centre FROM n GROUP BY 1, 2)
SELECT s.session_id, s.hour, round(sum(angle * snr * snr) / sum(snr * snr), 5) AS angle, count(*) AS frames, round(avg(snr), 5) AS snr, min(snr) AS least_snr, round(stddev_pop(angle), 5) AS spread,
floor(quantile_cont(bin, 0.5))::BIGINT AS bin, max(bin) - min(bin) AS span FROM s JOIN c ON s.session_id = c.session_id AND s.hour = c.hour AND abs(s.bin - centre) <= 10 GROUP BY 1, 2 HAVING count(*) >= 2"""


def anchored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_speed(_readings_as_frames(spark, sf_dir), ["session_id", "hour"])
    return found.select("session_id", "hour", F.round("angle", 5).alias("angle"), "frames", "most_snr", F.round("spread", 5).alias("spread"), F.round("off", 5).alias("off"), "most_off")


ANCHORED_SQL = _FRAMES_SQL + """ SELECT session_id, hour, round(sum(angle * snr * snr) / sum(snr * snr), 5) AS angle, count(*) AS frames, max(snr) AS most_snr, round(stddev_pop(angle), 5) AS spread,
round(avg(bin - expected), 5) AS off, max(abs(bin - expected)) AS most_off FROM f WHERE snr >= 2 AND abs(bin - expected) <= 25 GROUP BY 1, 2"""

# every bin that could be the ball


def _nearest_alpha(bearing: np.ndarray, t: np.ndarray, speed: np.ndarray, distance: np.ndarray, mount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle of the grid, how far its bearing is off) for each bearing."""
    best, off = np.zeros(len(bearing)), np.zeros(len(bearing))
    radians = np.radians(ANGLES)
    for at in range(0, len(bearing), 4096):
        p = slice(at, at + 4096)
        reach = (speed[p] * MPH_TO_FTS * t[p])[:, None]
        gap = np.abs(bearing[p, None] - (np.degrees(np.arctan2(ABOVE_FT + reach * np.sin(radians), distance[p, None] + reach * np.cos(radians))) - mount[p, None]))
        k = gap.argmin(axis=1)
        best[p], off[p] = ANGLES[k], gap[np.arange(len(k)), k]
    return best, off


def ball_bins(frames: DataFrame, window_ms: tuple[float, float] = (0.0, 125.0), least: float = 3.0, within: int = 80, settings: Settings = Settings()) -> DataFrame:
    """A row for each bin of each frame in the window that could be the ball: strong, near the speed's bin, and at a bearing that some launch angle gives.

    With its rank by strength among the band's bins, whether it is a local peak, and the launch angle it would mean alone.
    """
    t = F.col("timestamp") - F.col("impact_timestamp")
    ready = with_bands(frames, settings).withColumn("t", t).where(F.col("t").between(window_ms[0] / 1000, window_ms[1] / 1000) & F.col("ball_speed").isNotNull() & F.col("mount_deg").isNotNull())
    names = "bin int, bin_error int, snr double, bearing double, place int, local_peak boolean, prominence double, launch_angle double, residual double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            whole, codes = radc.decode(column("radc"))
            take = pa.array(whole)
            bands, expected = _bands(column("bands").take(take)), column("expected").take(take).to_numpy(zero_copy_only=False)
            numbers = {n: column(n).take(take).fill_null(0.0 if n == "offset_deg" else np.nan).to_numpy(zero_copy_only=False) for n in ("t", "ball_speed", "distance_ft", "mount_deg", "offset_deg")}
            parts: list[tuple] = []
            for p in _pieces(len(whole)):
                x = radc.spectra(radc.complex_channels(codes[p, :4]))
                m = np.abs(x[:, 0])
                floor = radc.floor_of(m)
                bins = np.arange(radc.FFT)
                inside = ((bins >= bands[p, :, :1]) & (bins < bands[p, :, 1:])).any(axis=1)
                snr = np.divide(m, floor[:, None], out=np.zeros_like(m), where=floor[:, None] > 0)
                order = np.argsort(np.where(inside, -snr, np.inf), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(bins + 1, order.shape), 1)
                off = radc.bin_distance(bins[None], expected[p, None])
                row, k = np.nonzero(inside & (snr >= least) & (off <= within))
                sides = np.maximum(m[row, (k - 1) % radc.FFT], m[row, (k + 1) % radc.FFT])
                local = np.maximum(sides, m[row, k])
                at = p.start + row
                bearing = radc.arrival(x[row, 0, k] * np.conj(x[row, 1, k])) + numbers["offset_deg"][at]
                alpha, gap = _nearest_alpha(bearing, *(numbers[n][at] for n in ("t", "ball_speed", "distance_ft", "mount_deg")))
                fits = gap <= ladder.SINGLE_FIT
                parts.append(tuple(c[fits] for c in (whole[at], k, off[row, k], snr[row, k], bearing, place[row, k], m[row, k] >= local, m[row, k] / local, alpha, gap)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 10
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), *[pa.float64()] * 3]
            rows = pa.array(columns[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(column(c).take(rows) for c in (*SHOT, "frame", "t")), *(pa.array(c).cast(k) for c, k in zip(columns[1:], kinds, strict=True))], [*SHOT, "frame", "t", *[n.split()[0] for n in names.split(", ")]])

    return ready.mapInArrow(run, f"shot long, orientation string, frame long, t double, {names}")


def geometry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every shot's buffer the bins that could be the ball, summed up by frame: how many, and the strongest with its angle."""
    found = ball_bins(frame_signals(spark, sf_dir).where("orientation = 'vertical'"))
    best = F.max_by(F.struct("bin", "launch_angle", "residual", "place"), F.struct("snr", -F.col("bin"))).alias("best")
    return found.groupBy("shot", "frame").agg(F.count(F.lit(1)).alias("bins"), F.count_if("local_peak").alias("peaks"), best).select("shot", "frame", "bins", "peaks", "best.*")


# range and clock


def _shifted(shifts_ms: np.ndarray, also: tuple[str, ...] = ()):
    """Chosen frames to the fit at no shift of the clock, and the one whose ranges, or bearings without any, agree best."""
    radians = np.radians(ANGLES)

    def fit(frames: list[dict], speed: float, distance: float, mount: float) -> list[tuple | None]:
        t0, bearing, snr = (np.array([f[k] for f in frames], float) for k in ("t", "angle", "snr"))
        ranges = np.array([np.nan if f["range"] is None else f["range"] for f in frames])
        weight = np.maximum(snr * snr, 1.0)
        out: list[tuple | None] = []
        for shift in shifts_ms:
            t = t0 + shift / 1000
            fly = (t > 0) & (t <= ladder.FLIGHT_S)
            if not fly.any() or len(frames) >= 2 and fly.sum() < 2:
                out.append(None)
                continue
            reach = (speed * MPH_TO_FTS * t[fly])[:, None]
            off = bearing[fly, None] - (np.degrees(np.arctan2(ABOVE_FT + reach * np.sin(radians), distance + reach * np.cos(radians))) - mount)
            squares = (weight[fly, None] * off * off).sum(axis=0)
            k = int(squares.argmin())
            rmse = float(np.sqrt(squares[k] / weight[fly].sum()))
            if len(frames) == 1 and rmse > ladder.SINGLE_FIT:
                out.append(None)
                continue
            seen = (t > 0) & ~np.isnan(ranges)
            along, up = distance + speed * MPH_TO_FTS * np.cos(radians[k]) * t, ABOVE_FT + speed * MPH_TO_FTS * np.sin(radians[k]) * t
            gaps = (np.hypot(along, up) - ranges)[seen]
            out.append((float(shift), float(ANGLES[k]), rmse, float(np.sqrt((gaps * gaps).mean())) if len(gaps) else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still = int(np.abs(shifts_ms).argmin())
        for b in batches:
            rows = []
            for r in b.select([*also, *SHOT, "chosen", "ball_speed", "distance_ft", "mount_deg"]).to_pylist():
                frames, fallback = r["chosen"] or [], False
                args = (r["ball_speed"], r["distance_ft"], r["mount_deg"])
                fits = fit(frames, *args) if frames and None not in args else []
                if len(frames) >= 2 and fits and fits[still] and fits[still][2] > ladder.PAIR_FIT:
                    alone = [f for f in frames if not f["weak"] and 0 < f["t"] <= ladder.FLIGHT_S]
                    if alone:
                        frames = [min(alone, key=lambda f: (f["t"], 99_999 if f["bin_error"] is None else f["bin_error"], -f["snr"]))]
                        fits, fallback = fit(frames, *args), True
                valid = [f for f in fits if f]
                best = min(valid, key=lambda f: (f[3] if f[3] is not None else f[2], abs(f[0])), default=None)
                nominal = fits[still] if fits else None
                rows.append((*(r[c] for c in also), r["shot"], r["orientation"], [f["frame"] for f in frames], fallback, *(nominal[1:] if nominal else (None,) * 3), *(best or (None,) * 4)))
            kinds = [*[pa.string()] * len(also), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_(), *[pa.float64()] * 7]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*also, *FIT_NAMES])

    return run


FITS = "shot long, orientation string, frames array<long>, fell_back boolean, angle double, bearing_rmse double, range_rmse double, shift_ms double, shifted_angle double, shifted_bearing_rmse double, shifted_range_rmse double"
FIT_NAMES = [c.split()[0] for c in FITS.split(", ")]


def range_fits(frames: DataFrame, by_strength: bool | None = False, clock_ms: float = 20.0, step_ms: float = 1.0, settings: Settings = Settings(speed_tolerance_mph=25.0)) -> DataFrame:
    """Launch angles of shots whose clock may be off: the frames the rules (or strength alone) choose, fitted at every shift of the clock.

    Of the shifts the one is taken whose ranges agree best, or whose bearings do where no frame has a range; equal ones: the smaller shift.
    Ranges come from the phase between the radar's two frequencies, with whole periods added along the shot. A pair whose
    bearings don't agree falls back on its earliest strong frame. Shots without a chosen frame are left out. With ``by_strength`` None,
    both choices are fitted, told apart by the column ``by``.
    """
    found = around_impacts(frames, settings, ranged=True).drop("speed")
    off = F.abs(F.col("bin") - F.col("expected"))
    rows = found.withColumns({"t": F.col("timestamp") - F.col("impact_timestamp"), "bin_error": F.least(off, radc.FFT - off), "angle": F.col("angle") + F.coalesce("offset_deg", F.lit(0.0))})
    frame = F.struct("t", "frame", "bin_error", "snr", "angle", "coherence", "weak", "range")
    shots = rows.where("t IS NOT NULL").groupBy(*SHOT).agg(F.sort_array(F.collect_list(frame)).alias("all"), *[F.first(c).alias(c) for c in ("ball_speed", "distance_ft", "mount_deg")])
    ranges = ladder.unwrapped(F.col("all"), PERIOD_FT, F.col("distance_ft"))
    shots = shots.withColumn("ranges", ranges).withColumn("all", F.transform("all", lambda c, i: c.withField("range", F.get("ranges", i))))
    shots = shots.withColumn("anchor", ladder.anchor(F.col("all")))
    choices = {False: ("rules", F.when(F.col("anchor").isNotNull(), ladder.by_rules(F.col("all"), F.col("anchor")))), True: ("strength", ladder.broad(F.col("all")))}
    asked = choices.values() if by_strength is None else [choices[by_strength]]
    shots = shots.select(*SHOT, "ball_speed", "distance_ft", "mount_deg", F.inline(F.array(*[F.struct(F.lit(by).alias("by"), chosen.alias("chosen")) for by, chosen in asked]))).where("chosen IS NOT NULL")
    shifts, also = np.arange(-clock_ms, clock_ms + step_ms / 2, step_ms), ("by",) if by_strength is None else ()
    return shots.mapInArrow(_shifted(shifts, also), ", ".join([*(f"{c} string" for c in also), FITS]))


def clock_shift_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertical shot's fit by both choices of frames."""
    frames = frame_signals(spark, sf_dir).where("orientation = 'vertical'")
    return range_fits(frames, by_strength=None).select(*FIT_NAMES, "by")


# sidebands


def with_sidebands(captures: DataFrame, derived: tuple[Run, str] | None = None) -> DataFrame:
    """Captures (i, q, ball_speed, ball_ms) with their onset and what the comb of sidebands says; nulls where it says nothing. ``derived``: :func:`over_captures`."""
    keep = kept_columns(captures, derived)
    names = ["onset_ms", "spacing_hz", "score", "odd", "seen", "rpm", "heard_ms", "drift_hz_s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, q, mph, ms = (b.column(b.schema.get_field_index(c)) for c in ("i", "q", "ball_speed", "ball_ms"))
            rows = []
            for k in range(b.num_rows):
                if not (i[k].is_valid and q[k].is_valid and len(i[k].values) == len(q[k].values) > 1):
                    rows.append((None,) * len(names))
                    continue
                x, y = np.asarray(i[k].values, float), np.asarray(q[k].values, float)
                found = sidebands.sideband_spin(x, y, mph[k].as_py(), ms[k].as_py() or 0.0) if mph[k].is_valid else None
                rows.append((sidebands.onset_ms(x + 1j * y), *((found or {}).get(n) for n in names[1:])))
            arrays = [pa.array(c, pa.string() if n == "seen" else pa.float64()) for n, c in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *arrays], [*keep, *names])

    return over_captures(captures, keep, run, ", ".join(f"{n} {'string' if n == 'seen' else 'double'}" for n in names), derived)


def sideband_spins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onset, course and comb of every capture."""
    return with_sidebands(capture_vectors(spark, sf_dir), DERIVED).select("capture", "ball_speed", "onset_ms", "heard_ms", "drift_hz_s", "spacing_hz", "score", "odd", "seen", "rpm")


# coefficients across sessions

#: Folds that sessions are dealt to, and the steps of the search's simplex.
FOLDS, REFLECT, EXPAND, CONTRACT, SHRINK = 8, 1.0, 2.0, 0.5, 0.5


def losses(rows: DataFrame, points: dict[tuple[int, int], list[float]], model, truth: Column, fold: Column) -> dict[tuple[int, int], float]:
    """The root mean square error of ``model`` at each point, on all rows but those of the point's fold (-1: on all).

    One pass: every row is taken at every point, sums combine in the tasks, and a sum for each point and fold comes back.
    """
    tried = F.explode(F.array(*[F.struct(F.lit(f).alias("leave"), F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("p")) for (f, k), p in points.items()]))
    error = model(F.col("at.p")) - F.col("__truth")
    sums = (
        rows.select("*", truth.alias("__truth"), fold.alias("__fold"))
        .select("*", tried.alias("at"))
        .where("__fold <> at.leave")
        .groupBy(F.col("at.leave").alias("leave"), F.col("at.k").alias("k"))
        .agg(F.sum(error * error).alias("ss"), F.count(error).alias("n"))
    )
    return {(r.leave, r.k): (r.ss / r.n) ** 0.5 if r.n else float("inf") for r in sums.collect()}


def simplex_fit(rows: DataFrame, model, truth: Column, fold: Column, folds: list[int], start: list[float], spread: list[float], rounds: int = 40, tolerance: float = 1e-6) -> dict[int, tuple[list[float], float]]:
    """Coefficients with the least error on all rows but a fold's, for each of ``folds`` (-1: none left out), without derivatives.

    The simplex search of Nelder and Mead, all folds side by side: a round is one pass over the rows, in which every fold's reflection, expansion and
    both contractions are tried; a fold that has to shrink tries its new corners in the next. The driver holds a simplex for each fold.
    """
    corners = {f: [list(start)] + [[v + (spread[i] if i == j else 0.0) for i, v in enumerate(start)] for j in range(len(start))] for f in folds}
    asked = {(f, k): p for f in folds for k, p in enumerate(corners[f])}
    found = losses(rows, asked, model, truth, fold)
    simplex = {f: sorted((found[f, k], p) for k, p in enumerate(c)) for f, c in corners.items()}
    shrinking: set[int] = set()
    for _ in range(rounds):
        asked = {}
        for f, s in simplex.items():
            if f in shrinking:
                asked |= {(f, k): p for k, (_, p) in enumerate(s) if k}
                continue
            if s[-1][0] - s[0][0] <= tolerance * max(s[0][0], 1e-12):
                continue
            mid = [sum(p[i] for _, p in s[:-1]) / len(start) for i in range(len(start))]
            for k, by in enumerate((REFLECT, EXPAND, CONTRACT, -CONTRACT)):
                asked[f, k] = [m + by * (m - w) for m, w in zip(mid, s[-1][1], strict=True)]
        if not asked:
            break
        found = losses(rows, asked, model, truth, fold)
        for f, s in simplex.items():
            if f in shrinking:
                simplex[f] = sorted([s[0]] + [(found[f, k], p) for k, (_, p) in enumerate(s) if k])
                shrinking.discard(f)
            elif (f, 0) in asked:
                reflected, expanded, outer, inner = ((found[f, k], asked[f, k]) for k in range(4))
                if reflected[0] < s[0][0]:
                    new = min(reflected, expanded)
                elif reflected[0] < s[-2][0]:
                    new = reflected
                else:
                    new = outer if reflected[0] < s[-1][0] else inner
                    new = new if new[0] <= min(reflected[0], s[-1][0]) else None
                if new is None:
                    best = s[0][1]
                    simplex[f] = [s[0]] + [(x, [b + SHRINK * (v - b) for b, v in zip(best, p, strict=True)]) for x, p in s[1:]]
                    shrinking.add(f)
                else:
                    simplex[f] = sorted([*s[:-1], new])
    return {f: (min(s)[1], min(s)[0]) for f, s in simplex.items()}


def spin_model(p: Column) -> Column:
    """Spin from speed and launch angle: a factor times speed times a power of the angle's sine."""
    return p[0] * F.col("ball_speed") * F.pow(F.sin(F.radians("launch_v")), p[1])


def coefficient_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the spin model fitted to all sessions and to all but each fold of sessions, and their error on the fold left out, beside the defaults' error.

    A shot's truth is a spin with coefficients of its own (160 and 1.1) and a regular error. Folds deal sessions by their number.
    """
    s = lens(spark, sf_dir, "shots").where("launch_v BETWEEN 2 AND 45").select("session_id", "shot_number", "ball_speed", "launch_v")
    truth = 160 * F.col("ball_speed") * F.pow(F.sin(F.radians("launch_v")), F.lit(1.1)) + (F.col("shot_number") % 41 - 20) * 10
    fold = (F.col("session_id") % FOLDS).cast("int")
    fits = simplex_fit(s, spin_model, truth, fold, [-1, *range(FOLDS)], [170.0, 1.2], [10.0, -0.05])
    rows = [(f, p[0], p[1], loss) for f, (p, loss) in fits.items()]
    found = F.broadcast(spark.createDataFrame(rows, "leave int, factor double, power double, fit_rmse double"))  # a row for each fold
    error = lambda p: F.sqrt(F.avg(F.pow(spin_model(p) - F.col("truth"), F.lit(2))))
    mine = s.withColumns({"truth": truth, "fold": fold}).join(found, (F.col("fold") == F.col("leave")) | (F.col("leave") == -1))
    return mine.groupBy("leave", "factor", "power", "fit_rmse").agg(
        F.count(F.lit(1)).alias("n"), error(F.array("factor", "power")).alias("rmse"), error(F.array(F.lit(170.0), F.lit(1.2))).alias("default_rmse")
    )


def default_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a grid of coefficients, on all shots but those of each fold: the sweep's losses without the search."""
    s = lens(spark, sf_dir, "shots").where("launch_v BETWEEN 2 AND 45").select("session_id", "shot_number", "ball_speed", "launch_v")
    truth = 160 * F.col("ball_speed") * F.pow(F.sin(F.radians("launch_v")), F.lit(1.1)) + (F.col("shot_number") % 41 - 20) * 10
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("factor"), F.lit(b).alias("power")) for a in (150.0, 160.0, 170.0) for b in (1.0, 1.1, 1.2)]))
    rows = s.select("*", truth.alias("truth"), (F.col("session_id") % FOLDS).alias("fold")).select("*", grid.alias("p"))
    e = spin_model(F.array("p.factor", "p.power")) - F.col("truth")
    own = rows.groupBy("p.factor", "p.power", "fold").agg(F.sum(e * e).alias("ss"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("factor", "power")
    rest, n = F.sum("ss").over(whole) - F.col("ss"), F.sum("n").over(whole) - F.col("n")
    return own.select("factor", "power", "fold", F.round(F.sqrt(rest / n), 4).alias("rmse_without"), F.round(F.sqrt(F.col("ss") / F.col("n")), 4).alias("rmse_within"))


LOSSES_SQL = with_lenses("shots") + f""", p AS (SELECT unnest([150.0, 160.0, 170.0])::DOUBLE AS factor), q AS (SELECT unnest([1.0, 1.1, 1.2])::DOUBLE AS power),
e AS (SELECT factor, power, session_id % {FOLDS} AS fold, factor * ball_speed * pow(sin(radians(launch_v)), power) - (160 * ball_speed * pow(sin(radians(launch_v)), 1.1::DOUBLE) + (shot_number % 41 - 20) * 10) AS e
FROM shots, p, q WHERE launch_v BETWEEN 2 AND 45), f AS (SELECT DISTINCT fold FROM e)
SELECT factor, power, f.fold, round(sqrt(avg(e * e) FILTER (e.fold <> f.fold)), 4) AS rmse_without, round(sqrt(avg(e * e) FILTER (e.fold = f.fold)), 4) AS rmse_within FROM e, f GROUP BY 1, 2, 3"""

QUERIES = {
    "frame_clusters": (frame_clusters, CLUSTERS_SQL),
    "anchored_frames": (anchored_frames, ANCHORED_SQL),
    "geometry_candidates": (geometry_candidates, None),
    "clock_shift_fits": (clock_shift_fits, None),
    "sideband_spins": (sideband_spins, None),
    "coefficient_sweep": (coefficient_sweep, None),
    "default_losses": (default_losses, LOSSES_SQL),
}
