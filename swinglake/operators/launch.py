"""Launch angles from the angle radar's frames: impacts, one candidate a frame, the frames that count, fits, trust.

Frames are dealt as rows. Their energy, and for those around an impact their peak, angle and coherence, come from numpy on
Arrow batches (:mod:`swinglake.functions.radc`); impacts are windows over the shot's frames; the choice of frames and the ladder of
estimates are columns over a shot's array of candidates (:mod:`swinglake.functions.ladder`); the geometric fits are numpy again, all
angles of the grid and a batch of shots at once. A shot's buffer is of bounded length, and that is all a window or an array holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions import flight, ladder, radc

#: The ball's height at the tee against the radar's, and the grid of angles.
ABOVE_FT, MPH_TO_FTS = -4.0 / 12.0, 1.46667
ANGLES = np.arange(451) * 0.1
#: The band that is searched where no speed is known, in km/h as the radar sees it.
BAND_KMH = (-39.0, -7.0)
SHOT = ["shot", "orientation"]


@dataclass(frozen=True)
class Settings:
    """How angles are extracted. Radar and session give the mount, the distance and the offset by columns of the frames."""

    impact_factor: float = 3.0
    speed_tolerance_mph: float = 10.0
    near_bins: int = 25
    far_penalty: float = 10.0
    floor_share: float = 0.5
    source: str = "f1a"
    near_snr: float = 5.0
    least_snr: float = 2.0
    only_near: bool = False
    horizontal_most: float = 15.0
    geometry: bool = True


def with_bands(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The frames with ``bands``, array<struct<lo, hi>> of the ball's bins, ``expected``, the bin of its speed (or null), and ``blind``."""
    speed = F.col("ball_speed")
    whole = [flight.velocity_bin(F.lit(v)) for v in BAND_KMH]
    broad = F.array(F.struct(whole[0].alias("lo"), whole[1].alias("hi")))
    seen = flight.alias_kmh(speed)
    return frames.withColumns(
        {
            "bands": F.when(speed.isNotNull(), flight.bin_ranges(speed, settings.speed_tolerance_mph)).otherwise(broad),
            "expected": flight.velocity_bin(seen),
            "blind": F.coalesce(F.abs(seen) <= flight.BLIND_KMH, F.lit(False)),
        }
    )


def _bands(column: pa.Array) -> np.ndarray:
    """frame x 2 x (low, high); a frame with one band has an empty second one."""
    out = np.zeros((len(column), 2, 2), int)
    for i, bands in enumerate(column.to_pylist()):
        for k, b in enumerate(bands):
            out[i, k] = max(0, min(radc.FFT, b["lo"])), max(0, min(radc.FFT, b["hi"]))
    return out


def _pieces(n: int) -> Iterator[slice]:
    return (slice(at, min(at + radc.TOGETHER, n)) for at in range(0, n, radc.TOGETHER))


def _energy(x: np.ndarray, bands: np.ndarray) -> np.ndarray:
    power = np.abs(x) ** 2
    sums = np.concatenate((np.zeros((len(power), 1)), np.cumsum(power, axis=1)), axis=1)
    row = np.arange(len(power))
    ball = sum(np.maximum(sums[row, bands[:, k, 1]] - sums[row, bands[:, k, 0]], 0) for k in (0, 1))
    return sums[:, radc.FFT // 2] - sums[:, radc.CLUB_LOW] + ball


def _energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``energy``: of the first channel, in the club's bins and the ball's; 0 without a whole payload."""
    for b in batches:
        energy = np.zeros(b.num_rows)
        whole, codes = radc.decode(b.column(b.schema.get_field_index("radc")))
        bands = _bands(b.column(b.schema.get_field_index("bands")).take(pa.array(whole)))
        for p in _pieces(len(whole)):
            energy[whole[p]] = _energy(radc.spectra(radc.complex_channels(codes[p, :2])[:, 0]), bands[p])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(energy)], [*b.schema.names, "energy"])


def with_energy(frames: DataFrame) -> DataFrame:
    """Frames that have ``bands`` with their ``energy``."""
    return frames.mapInArrow(_energies, frames.withColumn("energy", F.lit(0.0)).schema)


def impacts(frames: DataFrame, factor: float) -> DataFrame:
    """The frames around impacts, with ``event``, the impact's number in the shot, and ``impact``, whether it is one.

    An impact has more energy than ``factor`` times the median of the shot's frames with any; a shot whose median frame has none has
    none. Impacts at most five frames apart are one event, and it holds the frame before and two behind each of them.
    """
    shot = Window.partitionBy(*SHOT)
    order = shot.orderBy("frame")
    some = F.when(F.col("energy") > 0, F.col("energy"))
    level, typical = F.median(some).over(shot), F.median("energy").over(shot)
    hit = F.coalesce((typical > 0) & (F.col("energy") > factor * level), F.lit(False))
    marked = frames.withColumn("impact", hit)
    last = F.last(F.when(F.col("impact"), F.col("frame")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("impact") & F.coalesce(F.col("frame") - last > 5, F.lit(True))
    marked = marked.withColumn("starts", starts)
    number = F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("number", F.when(F.col("impact"), number - 1)).drop("starts")
    near = F.max("number").over(order.rangeBetween(-2, 1))
    return marked.withColumn("event", near).where("event IS NOT NULL").drop("number", "energy")


CANDIDATE = "bin int, snr double, angle double, width int, coherence double, weak boolean, parts int, swing double, deviation double, balance_min double, balance_max double"


PERIOD_FT = 5.0 * 3.28084
RANGED = CANDIDATE + ", range double"
TYPES = {"bin": pa.int32(), "width": pa.int32(), "parts": pa.int32(), "weak": pa.bool_()}


def ranges(first: np.ndarray, other: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """The phase between the two frequencies around each frame's peak, as a share of the period; not a number where the other is silent."""
    bins, inside = radc.around(peak, np.broadcast_to(np.array([0, radc.FFT]), (len(peak), 2)), radc.CORE_HALF)
    bins, rows = np.minimum(bins, radc.FFT - 1), np.arange(len(peak))[:, None]
    a, b = first[rows, bins], other[rows, bins]
    turn = np.angle((np.where(inside, np.abs(a), 0.0) * b * np.conj(a)).sum(axis=1))
    return np.where(np.abs(b).sum(axis=1) > 0, turn % (2 * np.pi) / (2 * np.pi) * PERIOD_FT, np.nan)


def _found(x: np.ndarray, samples: np.ndarray, bands: np.ndarray, expected: np.ndarray, known: np.ndarray, vertical: np.ndarray, horizontal: np.ndarray, settings: Settings, ranged: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(places of the frames with a candidate, its columns), of frames' spectra."""
    source = radc.source(x, settings.source)
    noise = radc.floor_of(source)
    ratio = lambda v: np.divide(v, noise, out=np.zeros(len(v)), where=noise > 0)
    at, value, band = radc.strongest(source, bands, expected, settings.near_bins)
    near = known & (at >= 0) & (ratio(value) >= settings.near_snr)
    weak = known & ~near & vertical & settings.geometry & (at >= 0) & (ratio(value) >= ladder.WEAK_SNR)
    left = known & ~near & ~weak & (horizontal | settings.only_near)
    open_ = np.flatnonzero(~near & ~weak)
    at[open_], value[open_], band[open_] = radc.strongest(source[open_], bands[open_])
    snr = ratio(value)
    fine = np.flatnonzero(~left & (at >= 0) & (snr >= settings.least_snr))
    if not len(fine):
        return fine, {}
    angle, width, coherence = radc.peak_angles(x[fine, 0], x[fine, 1], source[fine], at[fine], band[fine], settings.floor_share)
    parts = radc.fringes(samples[fine, 0], samples[fine, 1], at[fine])
    out = {"bin": at[fine], "snr": snr[fine], "angle": angle, "width": width, "coherence": coherence, "weak": weak[fine], **parts}
    return fine, out | ({"range": ranges(x[fine, 0], x[fine, 2], at[fine])} if ranged else {})


def _peaks(settings: Settings, every: bool = False, ranged: bool = False):
    """Batches to the frames with a candidate; with ``every``, to all frames and their energy, nulls where there is no candidate."""
    names = [c.split()[0] for c in (RANGED if ranged else CANDIDATE).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            whole, codes = radc.decode(column("radc"))
            take = pa.array(whole)
            bands = _bands(column("bands").take(take))
            expected = column("expected").take(take)
            known = ~expected.is_null().to_numpy(zero_copy_only=False)
            expected = expected.fill_null(0).to_numpy()
            vertical, horizontal = (np.array([o == kind for o in column("orientation").take(take).to_pylist()], bool) for kind in ("vertical", "horizontal"))
            kept, found, energy = [], {name: [] for name in names}, np.zeros(b.num_rows)
            for p in _pieces(len(whole)):
                samples = radc.complex_channels(codes[p])
                x = radc.spectra(samples)
                if every:
                    energy[whole[p]] = _energy(x[:, 0], bands[p])
                fine, seen = _found(x, samples, bands[p], expected[p], known[p], vertical[p], horizontal[p], settings, ranged)
                kept.append(whole[p][fine])
                for name, v in seen.items():
                    found[name].append(v)
            rows = np.concatenate(kept) if kept else np.zeros(0, int)
            narrow = [c for c in b.schema.names if c not in ("radc", "bands")]
            places = np.full(b.num_rows, -1)
            places[rows] = np.arange(len(rows))
            spread = pa.array(places, mask=places < 0)
            arrays = [column(c) if every else column(c).take(pa.array(rows)) for c in narrow]
            for name in names:
                v = pa.array(np.concatenate(found[name]) if found[name] else np.zeros(0), TYPES.get(name, pa.float64()), from_pandas=True)
                arrays.append(v.take(spread) if every else v)
            more = [pa.array(energy)] if every else []
            yield pa.RecordBatch.from_arrays([*arrays, *more], [*narrow, *names, *["energy"][: len(more)]])

    return run


def _seen(frames: DataFrame, columns: str) -> str:
    narrow = frames.drop("radc", "bands")
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema] + columns.split(", "))


def candidates(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Frames with their peak near the speed's bin, or in the band where there is none near and the orientation allows it; frames without one are left out.

    A vertical frame whose near peak is weak stays as such: it may only accompany a strong one.
    """
    return frames.mapInArrow(_peaks(settings), _seen(frames, CANDIDATE))


def around_impacts(frames: DataFrame, settings: Settings = Settings(), ranged: bool = False) -> DataFrame:
    """The candidates around impacts, with ``range`` where asked for: ``candidates(impacts(with_energy(with_bands(frames))))``.

    Every frame's energy and peak are read from its payload at once, so that payloads are neither shuffled, sorted nor joined; impacts
    are then found on what is left of the frames.
    """
    ready = with_bands(frames, settings)
    seen = ready.mapInArrow(_peaks(settings, True, ranged), _seen(ready, (RANGED if ranged else CANDIDATE) + ", energy double"))
    return impacts(seen, settings.impact_factor).where("bin IS NOT NULL")


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the fit of the grid to all frames in flight (alpha, rmse; null below two) and to the single frame (alone, residual)."""
    radians = np.radians(ANGLES)
    for b in batches:
        out = []
        for points, one, speed, distance, mount in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("points", "one", "ball_speed", "distance_ft", "mount_deg")), strict=True):
            usable = [(p["t"], p["angle"], p["w"]) for p in points or [] if p["t"] is not None and 0 < p["t"] <= ladder.FLIGHT_S]
            row = [None] * 4
            if None not in (speed, distance, mount):
                for place, frames in ((0, usable if len(usable) >= 2 else []), (2, [(one["t"], one["angle"], 1.0)] if one else [])):
                    t, angle, w = (np.array(c, float)[:, None] for c in zip(*frames, strict=True)) if frames else (np.zeros((0, 1)),) * 3
                    if w.sum() > 0:
                        along = distance + speed * MPH_TO_FTS * np.cos(radians) * t
                        up = ABOVE_FT + speed * MPH_TO_FTS * np.sin(radians) * t
                        off = angle - (np.degrees(np.arctan2(up, along)) - mount)
                        squares = (w * off * off).sum(axis=0)
                        best = int(np.argmin(squares))
                        row[place], row[place + 1] = float(ANGLES[best]), float(np.sqrt(squares[best] / w.sum()))
            out.append(row)
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.float64()) for c in columns)], [*b.schema.names, "alpha", "rmse", "alone", "residual"])


def events(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each event of a shot that gives an angle: the frames that set it, the estimate, its way and its trust."""
    frame = F.struct(
        "frame", "t", "bin_error", "snr", "angle", "coherence", "weak", "bin", "speed", F.struct("parts", "swing", "deviation", "balance_min", "balance_max").alias("fringes")
    )
    seen = rows.withColumns(
        {
            "t": F.col("timestamp") - F.col("impact_timestamp"),
            "bin_error": F.when(F.col("expected").isNotNull(), F.least(F.abs(F.col("bin") - F.col("expected")), radc.FFT - F.abs(F.col("bin") - F.col("expected")))),
            "speed": (2 * radc.TOP_KMH + F.when(F.col("bin") <= radc.FFT // 2, F.col("bin")).otherwise(F.col("bin") - radc.FFT) * (radc.TOP_KMH * 2 / radc.FFT)) / flight.MPH_TO_KMH,
        }
    )
    shot = ["ball_speed", "distance_ft", "mount_deg", "offset_deg", "blind", "impact_timestamp"]
    grouped = seen.groupBy(*SHOT, "event").agg(
        F.sort_array(F.collect_list(frame)).alias("all"), F.max(F.when(F.col("impact"), F.col("frame"))).alias("latest"), *[F.first(c).alias(c) for c in shot]
    )
    vertical, timed = F.col("orientation") == "vertical", F.col("impact_timestamp").isNotNull()
    strong = F.filter("all", lambda c: ~c["weak"])
    # the rules where they find an anchor, else all strong frames but the worst; a frame alone must be strong in itself
    picked = (
        grouped.withColumn("anchor", F.when(vertical & timed, ladder.anchor(F.col("all"))))
        .withColumn("ruled", F.col("anchor").isNotNull())
        .withColumn("frames", F.when(F.col("ruled"), ladder.by_rules(F.col("all"), F.col("anchor"))).otherwise(ladder.without_worst(strong)))
        .where((F.size("frames") > 1) | ((F.size("frames") == 1) & (F.col("frames")[0]["snr"] >= ladder.ALONE_SNR)))
    )
    w = lambda c: ladder.weight(c, settings.near_bins, settings.far_penalty)
    fits = vertical & F.lit(settings.geometry)
    offset = F.coalesce("offset_deg", F.lit(0.0))
    point = lambda c: F.struct(c["t"].alias("t"), (c["angle"] + F.col("offset")).alias("angle"), w(c).alias("w"))
    ready = (
        picked.withColumn("offset", offset)
        .withColumn("lone", F.when(fits, ladder.single(F.col("frames"))))
        .withColumn("points", F.when(fits, F.transform("frames", point)))
        .withColumn("one", F.when(F.col("lone").isNotNull(), point(F.col("lone"))))
    )
    schema = ready.withColumns({c: F.lit(None).cast("double") for c in ("alpha", "rmse", "alone", "residual")}).schema
    fitted = ready.mapInArrow(_fits, schema).withColumn("estimator", F.when(fits, ladder.estimator(F.col("frames"), F.col("rmse"), F.col("residual"))).otherwise("naive"))
    by_one = F.col("estimator") == "geometry_single_frame"
    fitted = fitted.withColumn("frames", F.when(by_one, F.array("lone")).otherwise(F.col("frames")))
    angles, snrs = F.transform("frames", lambda c: c["angle"]), F.transform("frames", lambda c: c["snr"])
    n = F.size("frames").cast("double")
    mean = ladder.total(angles) / n
    raw = ladder.total(F.col("frames"), lambda c: c["angle"] * w(c)) / ladder.total(F.col("frames"), w)
    angle = F.when(by_one, F.col("alone")).when(F.col("estimator") == "geometry", F.col("alpha")).otherwise(F.col("raw") + F.col("offset"))
    early = F.exists("frames", lambda c: F.coalesce((c["t"] >= ladder.EARLY_S) & (c["t"] < ladder.FIRST_S), F.lit(False)))
    rmse = F.when(F.col("estimator") == "geometry", F.col("rmse"))
    residual = F.when(by_one, F.col("residual"))
    told = (
        fitted.withColumns({"raw": raw, "spread": F.sqrt(ladder.total(angles, lambda a: (a - mean) * (a - mean)) / n), "snr": ladder.total(snrs) / n, "rmse": rmse, "residual": residual})
        .withColumn("path", ladder.path(F.col("estimator"), vertical, F.col("ruled"), early))
        .withColumn("angle", angle)
        .where(F.when(vertical, F.col("angle").between(0.0, ladder.VERTICAL_MOST)).when(F.col("orientation") == "horizontal", F.abs("angle") <= max(settings.horizontal_most, 0.0)).otherwise(True))
        .withColumn("confidence", ladder.confidence(F.col("estimator"), F.col("path"), F.col("snr"), F.size("frames"), F.col("spread"), F.col("rmse"), F.col("residual"), F.col("blind")))
    )
    return told.select(
        *SHOT,
        "event",
        F.round("angle", 1).alias("launch_angle"),
        F.round("raw", 1).alias("raw_angle"),
        "estimator",
        "path",
        F.round("rmse", 2).alias("fit_rmse"),
        F.round("residual", 2).alias("residual"),
        F.transform("frames", lambda c: c["frame"]).alias("frames"),
        F.transform("frames", lambda c: F.round(c["t"] * 1000, 1)).alias("t_ms"),
        F.transform("frames", lambda c: c["bin_error"]).alias("bin_errors"),
        F.exists("frames", lambda c: c["weak"]).alias("weak_used"),
        "blind",
        F.transform("frames", lambda c: c["fringes"]).alias("fringes"),
        F.round(ladder.total(F.col("all"), lambda c: c["speed"]) / F.size("all"), 1).alias("ball_speed"),
        "confidence",
        F.size("all").alias("detections"),
        F.round("spread", 1).alias("angle_spread"),
        F.round("snr", 1).alias("snr"),
        "latest",
    )


def best_events(found: DataFrame) -> DataFrame:
    """One result a shot: by its way, then by confidence, the fit's error, the latest impact and strength."""
    rank = F.struct(
        ladder.tier(F.col("estimator"), F.col("path"), F.size("frames")).alias("tier"), "confidence", F.coalesce(-F.col("fit_rmse"), F.lit(0.0)).alias("fit"), "latest", "snr"
    )
    row = F.struct(*[c for c in found.columns if c not in SHOT])
    return found.groupBy(*SHOT).agg(F.max_by(row, rank).alias("best")).select(*SHOT, "best.*")


def launch_angles(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One launch angle for each shot and orientation that gives any.

    ``frames``: shot, orientation (vertical, horizontal or another: no bounds), frame (its place in the buffer), timestamp, radc (payload),
    ball_speed, impact_timestamp, mount_deg, distance_ft, offset_deg; all but the first three may be null. A frame without a whole payload has no
    energy; without a speed the broad band is searched; without the time of impact the rules and fits don't apply.
    """
    return best_events(events(around_impacts(frames, settings), settings))


def frame_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots' buffers derived from the embeddings: twelve frames each, vertical and horizontal, with payloads.

    A vector gives a ball speed, a launch angle and the floor's noise; frames before impact hold noise, those behind it a tone at the ball's
    bin with the bearing of its flight, faint in some vectors and off its bin in others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(radc.SAMPLES)
        for b in batches:
            for shot, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.array(v)
                speed, alpha, rows = 60 + 100 * abs(v[0]) / (abs(v[0]) + 0.1), 3 + 35 * abs(v[1]) / (abs(v[1]) + 0.1), []
                kmh = (speed * flight.MPH_TO_KMH + 100) % 200 - 100
                noise = np.resize(v, 2 * radc.SAMPLES * 6).reshape(6, -1)[:, : radc.SAMPLES] * 150
                for orientation in ("vertical", "horizontal"):
                    for frame in range(12):
                        t = (frame - 7.5 + v[2]) * 0.028
                        codes = noise * np.cos(np.arange(6)[:, None] + k * (0.7 + 0.31 * frame) * (1 + np.arange(6)[:, None] / 7))
                        if t > 0:
                            along = 5.5 + speed * MPH_TO_FTS * np.cos(np.radians(alpha)) * t
                            up = ABOVE_FT + speed * MPH_TO_FTS * np.sin(np.radians(alpha)) * t
                            bearing = np.degrees(np.arctan2(up, along)) - 18.0 if orientation == "vertical" else 20 * v[3]
                            size = (4000, 150, 700, 2500)[label % 4] * (1 + 0.2 * np.sin(frame))
                            phase = 2 * np.pi * (kmh + (label % 5 == 4) * 14) / 200 * k
                            turn = -2 * np.pi * radc.SPACING_M * np.sin(np.radians(bearing)) / radc.WAVELENGTH_M
                            out = 2 * np.pi * np.hypot(along, up) / (5.0 * 3.28084)  # the second frequency's phase grows with the range
                            for c, extra in ((0, 0.0), (2, turn), (4, out)):
                                codes[c] += size * np.cos(phase + extra)
                                codes[c + 1] += size * np.sin(phase + extra)
                        payload = np.clip(np.floor(codes + 32768), 0, 65535).astype("<u2").tobytes()
                        rows.append((shot, orientation, frame, 1000.0 + shot + t, payload if (frame + label) % 11 else payload[:100], speed, 1000.0 + shot, 18.0, 5.5, 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], NAMES)

    schema = "shot long, orientation string, frame long, timestamp double, radc binary, ball_speed double, impact_timestamp double, mount_deg double, distance_ft double, offset_deg double"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>"))
    vectors = vectors.repartition(spark.sparkContext.defaultParallelism, "vec_id")  # a vector becomes a hundred times its size
    return vectors.mapInArrow(run, schema)


NAMES = ["shot", "orientation", "frame", "timestamp", "radc", "ball_speed", "impact_timestamp", "mount_deg", "distance_ft", "offset_deg"]


def launch_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The launch angle of every shot and orientation, with the way it was come by and its trust."""
    return launch_angles(frame_signals(spark, sf_dir)).drop("fringes", "t_ms", "bin_errors")


QUERIES = {"launch_extraction": (launch_extraction, None)}
