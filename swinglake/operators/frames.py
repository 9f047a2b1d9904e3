"""The angle radar's frames one by one: payload health, diagnostics of a capture, angle maps, spatial detections, sub-frame fringes.

Payloads are binary columns that are decoded in Arrow batches; what numpy gives back are rows, and medians, maxima and counts over a
capture are Spark's. The angle queries read a frame of the embeddings as two receivers of sixteen complex samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.functions import flight, radc
from swinglake.operators.launch import Settings, _bands, _pieces, frame_signals, with_bands

# Fixed values of the warnings: shares and ratios of channels, strength, coherence, bins off, angles.
CLIPPED, UNEVEN, FAINT, INCOHERENT, FAR_BINS = 0.005, 2.0, 2.0, 0.65, 25
BOUNDS = {"vertical": (0.0, 45.0), "horizontal": (-15.0, 15.0)}

#: A code of a payload made of a frame: channel c and sample k read value k + 7c of the vector; loud ones run out of range.
CODE = "least(65535, greatest(0, cast(floor(32768 + {v} * 45000 * ({c} + 1)) AS BIGINT)))"
#: Frames without a payload, and with one of another length.
MISSING, SHORT = "vec_id % 19 = 0", "vec_id % 17 = 0"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, radc: the frames of the embeddings as payloads."""
    code = CODE.format(v="cast(embedding[(i % 256 + 7 * (i div 256)) % 64] AS DOUBLE)", c="(i div 256)")
    words = f"transform(sequence(0, 1535), i -> lpad(hex({code}), 4, '0'))"
    swapped = f"array_join(transform({words}, h -> concat(substr(h, 3, 2), substr(h, 1, 2))), '')"
    radc_column = F.expr(f"CASE WHEN {MISSING} THEN NULL WHEN {SHORT} THEN unhex('00FF') ELSE unhex({swapped}) END")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", radc_column.alias("radc"))


def channel_stats(codes: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, deviation, least and largest code, and shares at the ends of the range, frame x channel."""
    return {
        "mean": codes.mean(axis=2),
        "deviation": codes.std(axis=2),
        "least": codes.min(axis=2).astype(np.int64),
        "most": codes.max(axis=2).astype(np.int64),
        "clipped_low": (codes == 0).mean(axis=2),
        "clipped_high": (codes == 65535).mean(axis=2),
    }


def channel_rows(frames: DataFrame, keys: list[str], column: str = "radc") -> DataFrame:
    """A row for each channel of each whole payload: its statistics, and range. Frames without a whole payload give none."""
    names = ["mean", "deviation", "least", "most", "clipped_low", "clipped_high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, codes = radc.decode(b.column(len(keys)))
            stats = channel_stats(codes)
            rows = pa.array(np.repeat(whole, len(radc.CHANNELS)))
            arrays = [*(b.column(i).take(rows) for i in range(len(keys))), pa.array(list(radc.CHANNELS) * len(whole), pa.string()), *(pa.array(stats[n].ravel()) for n in names)]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "channel", *names])

    narrow = frames.select(*keys, column)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[: len(keys)]] + ["channel string, mean double, deviation double, least long, most long, clipped_low double, clipped_high double"])
    return narrow.mapInArrow(run, schema).withColumn("range", F.col("most") - F.col("least"))


def payload_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each channel of each payload."""
    rows = channel_rows(payloads(spark, sf_dir), ["vec_id"])
    return rows.select("vec_id", "channel", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "least", "most", "range", "clipped_low", "clipped_high")


PAYLOAD_SQL = f"""WITH c AS (SELECT vec_id, embedding, unnest(range(0, 6)) AS c FROM embeddings WHERE NOT ({MISSING}) AND NOT ({SHORT})),
k AS (SELECT vec_id, embedding, c, unnest(range(0, 256)) AS k FROM c),
v AS (SELECT vec_id, c, {CODE.format(v="embedding[(k + 7 * c) % 64 + 1]::DOUBLE", c="c")} AS code FROM k)
SELECT vec_id, {list(radc.CHANNELS)}[c + 1] AS channel, round(avg(code), 4) AS mean, round(stddev_pop(code), 4) AS deviation, min(code) AS least, max(code) AS most, max(code) - min(code) AS range,
avg((code = 0)::INT) AS clipped_low, avg((code = 65535)::INT) AS clipped_high FROM v GROUP BY vec_id, c"""


def capture_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: the worst shares at the ends of the range and the widest range of each channel, over its frames."""
    rows = channel_rows(payloads(spark, sf_dir), ["label"])
    return rows.groupBy("label", "channel").agg(F.count(F.lit(1)).alias("frames"), F.max("clipped_low").alias("low"), F.max("clipped_high").alias("high"), F.max("range").alias("dynamic_range"))


CAPTURE_CHANNELS_SQL = f"""WITH c AS (SELECT vec_id, label, embedding, unnest(range(0, 6)) AS c FROM embeddings WHERE NOT ({MISSING}) AND NOT ({SHORT})),
k AS (SELECT vec_id, label, embedding, c, unnest(range(0, 256)) AS k FROM c),
v AS (SELECT vec_id, label, c, {CODE.format(v="embedding[(k + 7 * c) % 64 + 1]::DOUBLE", c="c")} AS code FROM k),
f AS (SELECT label, c, avg((code = 0)::INT) AS low, avg((code = 65535)::INT) AS high, max(code) - min(code) AS r FROM v GROUP BY vec_id, label, c)
SELECT label, {list(radc.CHANNELS)}[c + 1] AS channel, count(*) AS frames, max(low) AS low, max(high) AS high, max(r) AS dynamic_range FROM f GROUP BY label, c"""

DIAGNOSIS = (
    "has_radc boolean, valid boolean, reason string, peak_bin int, magnitude double, floor double, snr double, snr_db double, angle_peak double, angle double, coherence double, "
    "width int, warnings array<string>"
)


def frame_diagnostics(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Frames (as :func:`swinglake.operators.launch.launch_angles` takes them) with what their payload says and what is wrong with it.

    A frame without a payload, or with one of another length, has that as its reason and its only warning; one without a
    peak in its bands has the statistics of its channels alone.
    """
    ready = with_bands(frames, settings)
    keep = [c for c in ready.columns if c not in ("radc", "bands")]
    names = [c.split()[0] for c in DIAGNOSIS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            there = column("radc").is_valid().to_numpy(zero_copy_only=False)
            rows = [[bool(t), False, "invalid_payload_size" if t else "missing_radc", None, 0.0, 0.0, 0.0, 0.0, None, None, None, 0, ["invalid_payload" if t else "missing_radc"]] for t in there]
            whole, codes = radc.decode(column("radc"))
            bands = _bands(column("bands").take(pa.array(whole)))
            sides = [column("orientation")[int(i)].as_py() for i in whole]
            expected = [column("expected")[int(i)].as_py() for i in whole]
            for p in _pieces(len(whole)):
                x = radc.spectra(radc.complex_channels(codes[p, :4]))
                m = np.abs(x[:, 0])
                floor = radc.floor_of(m)
                at, value, band = radc.strongest(m, bands[p])
                snr = np.divide(value, floor, out=np.zeros(len(m)), where=floor > 0)
                found = np.maximum(at, 0)
                angle, width, coherence = radc.peak_angles(x[:, 0], x[:, 1], m, found, band, settings.floor_share) if (at >= 0).any() else (np.zeros(len(m)), np.zeros(len(m), int), np.zeros(len(m)))
                raw = radc.arrival(np.take_along_axis(x[:, 0] * np.conj(x[:, 1]), found[:, None], 1))[:, 0]
                stats = channel_stats(codes[p])
                spread = stats["deviation"]
                for j, place in enumerate(whole[p]):
                    k = p.start + j
                    warnings = [f"adc_clipping:{c}" for c, lo, hi in zip(radc.CHANNELS, stats["clipped_low"][j], stats["clipped_high"][j], strict=True) if max(lo, hi) > CLIPPED]
                    for name, i in (("f1a", 0), ("f2a", 2)):
                        uneven = spread[j, i + 1] / spread[j, i] if spread[j, i] > 0 else np.inf if spread[j, i + 1] > 0 else 0.0
                        if uneven > UNEVEN or 0 < uneven < 1 / UNEVEN:
                            warnings.append(f"iq_imbalance:{name}")
                    head = [True, True]
                    strength = [float(value[j]), float(floor[j]), float(snr[j]), float(10 * np.log10(snr[j])) if snr[j] > 0 else 0.0]
                    if at[j] < 0:
                        rows[place] = [*head, "no_peak_in_target_band", None, *strength, None, None, None, 0, [*warnings, "no_peak_in_target_band"]]
                        continue
                    agree = None if np.isnan(coherence[j]) else float(coherence[j])
                    low, high = BOUNDS.get(sides[k], (-np.inf, np.inf))
                    tests = {
                        "low_snr": snr[j] < FAINT,
                        "low_phase_coherence": agree is not None and agree < INCOHERENT,
                        "far_from_ops_bin": expected[k] is not None and int(radc.bin_distance(np.array(at[j]), np.array(expected[k]))) > FAR_BINS,
                        f"outside_{sides[k]}_bounds": not low <= angle[j] <= high,
                    }
                    rows[place] = [*head, None, int(at[j]), *strength, float(raw[j]), float(angle[j]), agree, int(width[j]), [*warnings, *(n for n, bad in tests.items() if bad)]]
            kinds = [pa.bool_(), pa.bool_(), pa.string(), pa.int32(), *[pa.float64()] * 7, pa.int32(), pa.list_(pa.string())]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in keep), *arrays], [*keep, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*keep).schema] + [DIAGNOSIS])
    bins = F.least(F.abs(F.col("peak_bin") - F.col("expected")), radc.FFT - F.abs(F.col("peak_bin") - F.col("expected")))
    kmh = F.when(F.col("peak_bin") <= radc.FFT // 2, F.col("peak_bin")).otherwise(F.col("peak_bin") - radc.FFT) * (2 * radc.TOP_KMH / radc.FFT)
    seen = ready.mapInArrow(run, schema).withColumn("bin_error", bins).withColumn("peak_kmh", kmh)
    return seen.withColumn("peak_mph", (2 * radc.TOP_KMH + F.col("peak_kmh")) / flight.MPH_TO_KMH).withColumn("speed_error", F.col("peak_mph") - F.col("ball_speed"))


def tallied(values: Column) -> Column:
    """array<struct<value, n>> of a short array's values, in their order."""
    return F.transform(F.sort_array(F.array_distinct(values)), lambda v: F.struct(v.alias("value"), F.size(F.filter(values, lambda w: w == v)).alias("n")))


def capture_diagnostics(diagnosed: DataFrame, keys: list[str], top: int = 8) -> DataFrame:
    """Per capture: counts of frames, medians over those with a peak, the fullest bins (the lower of equally full ones), and counts of each warning.

    A capture is a buffer of bounded length, and its peaks and warnings are held as arrays.
    """
    peak = F.col("peak_bin").isNotNull()
    of_peaks = lambda c: F.when(peak, c)
    found = diagnosed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("has_radc").alias("with_radc"),
        F.count_if("valid").alias("valid"),
        F.count_if(peak).alias("with_peak"),
        F.coalesce(F.max(of_peaks(F.col("snr_db"))), F.lit(0.0)).alias("max_snr_db"),
        F.median(of_peaks(F.col("snr_db"))).alias("median_snr_db"),
        F.median(of_peaks(F.col("coherence"))).alias("median_coherence"),
        F.median(of_peaks(F.col("bin_error"))).alias("median_bin_error"),
        F.median(of_peaks(F.abs("speed_error"))).alias("median_speed_error"),
        F.median(of_peaks(F.col("width"))).alias("median_width"),
        F.collect_list("peak_bin").alias("fullest"),
        F.flatten(F.collect_list("warnings")).alias("warnings"),
    )
    by_count = F.array_sort(F.transform(tallied(F.col("fullest")), lambda x: F.struct((-x["n"]).alias("minus"), x["value"].alias("bin"))))
    fullest = F.transform(F.slice(by_count, 1, top), lambda x: F.struct(x["bin"].alias("bin"), (-x["minus"]).alias("n")))
    return found.withColumns({"fullest": fullest, "warnings": F.map_from_entries(tallied(F.col("warnings")))})


def radar_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnosis of every shot's buffer, by orientation."""
    found = capture_diagnostics(frame_diagnostics(frame_signals(spark, sf_dir)), ["shot", "orientation"])
    bins = F.array_join(F.transform("fullest", lambda x: F.concat_ws("=", x["bin"], x["n"])), ",")
    warnings = F.array_join(F.transform(F.map_entries("warnings"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return found.withColumns({"fullest": bins, "warnings": warnings})


def _two_receivers(run: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch]):
    """Batches of (vec_id, x) as both receivers' complex samples."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, 64) if b.num_rows else np.zeros((0, 64))
            yield run(b.column(0), x[:, 0:32:2] + 1j * x[:, 1:32:2], x[:, 32::2] + 1j * x[:, 33::2])

    return go


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


STEERED = np.arange(-60, 61, 15.0)


def angle_velocity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each frame's power over steering angles and speeds: the strongest cell of each angle (the lower of equal bins)."""

    def run(ids: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        power = radc.angle_power(radc.spectra(a, 32, 0), radc.spectra(b, 32, 0), STEERED)
        at = power.round(6).argmax(axis=2)
        rows = pa.array(np.repeat(np.arange(len(a)), len(STEERED)))
        best = np.take_along_axis(power, at[..., None], 2)[..., 0]
        return pa.RecordBatch.from_arrays([ids.take(rows), pa.array(np.tile(STEERED, len(a))), pa.array(at.ravel().astype(np.int32)), pa.array(best.ravel().round(5))], ["vec_id", "angle", "bin", "power"])

    return _vectors(spark, sf_dir).mapInArrow(_two_receivers(run), "vec_id long, angle double, bin int, power double")


_SPACING = f"{2 * np.pi * radc.SPACING_M / radc.WAVELENGTH_M!r}::DOUBLE"


def _receivers_sql(fft: int, samples: int = 16, bins: str | None = None) -> str:
    """b: real and imaginary parts of both receivers' Hann-windowed spectra by vec_id and bin."""
    hann = f"(0.5 - 0.5 * cos(2 * pi() * i / {samples - 1}))"
    turn = f"2 * pi() * bin * i / {fft}"
    part = lambda o: (f"sum({hann} * (e[2 * i + {o + 1}] * cos({turn}) + e[2 * i + {o + 2}] * sin({turn})))", f"sum({hann} * (e[2 * i + {o + 2}] * cos({turn}) - e[2 * i + {o + 1}] * sin({turn})))")
    (ar, ai), (br, bi) = part(0), part(32)
    return f"""k AS (SELECT vec_id, unnest({bins or f"range(0, {fft})"}) AS bin, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT vec_id, bin, e, unnest(range(0, {samples})) AS i FROM k),
b AS (SELECT vec_id, bin, {ar} AS ar, {ai} AS ai, {br} AS br, {bi} AS bi FROM t GROUP BY 1, 2)"""


MAP_SQL = f"""WITH {_receivers_sql(32)}, a AS (SELECT *, unnest({STEERED.tolist()})::DOUBLE AS angle FROM b), z AS (SELECT *, {_SPACING} * sin(radians(angle)) AS z FROM a),
p AS (SELECT vec_id, angle, bin, pow(ar + br * cos(z) + bi * sin(z), 2) + pow(ai + bi * cos(z) - br * sin(z), 2) AS power FROM z)
SELECT vec_id, angle, arg_max(bin, (round(power, 6), -bin))::INT AS bin, round(max(power), 5) AS power FROM p GROUP BY 1, 2"""


def spatial_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of each frame's spectrum that stand out of their surroundings on both sides, with the angle they come from."""

    def run(ids: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        x, y = radc.spectra(a, 64, 0), radc.spectra(b, 64, 0)
        frame, at, ratio = radc.detections(np.abs(x), 1.8, 2, 6)
        angle = radc.arrival(x[frame, at] * np.conj(y[frame, at]))
        arrays = [ids.take(pa.array(frame)), pa.array(at.astype(np.int32)), pa.array(angle.round(4)), pa.array((10 * np.log10(ratio)).round(5))]
        return pa.RecordBatch.from_arrays(arrays, ["vec_id", "bin", "angle", "snr_db"])

    return _vectors(spark, sf_dir).mapInArrow(_two_receivers(run), "vec_id long, bin int, angle double, snr_db double")


_ARRIVAL = f"degrees(asin(greatest(-1, least(1, atan2(ai * br - ar * bi, ar * br + ai * bi) / {_SPACING}))))"
SPATIAL_SQL = f"""WITH {_receivers_sql(64)}, m AS (SELECT vec_id, bin, sqrt(ar * ar + ai * ai) AS m, {_ARRIVAL} AS angle FROM b),
n AS (SELECT x.vec_id, x.bin, x.m, x.angle, quantile_cont(y.m, 0.5) AS noise FROM m x JOIN m y ON x.vec_id = y.vec_id AND abs(x.bin - y.bin) BETWEEN 3 AND 8 WHERE x.bin BETWEEN 8 AND 55 GROUP BY 1, 2, 3, 4)
SELECT vec_id, bin::INT AS bin, round(angle, 4) AS angle, round(10 * log10(m / noise), 5) AS snr_db FROM n WHERE noise > 0 AND m > 1.8 * noise"""


def subframe_fringes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How angle and balance move within each frame: three overlapping parts of eight samples, followed at the frame's strongest bin."""

    def run(ids: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        peak = np.abs(radc.spectra(a, 16, 0)).round(9).argmax(axis=1)
        f = radc.fringes(a, b, peak, fft=16, part=8, step=4, half=2, mask=0)
        names = ["swing", "deviation", "balance_min", "balance_max"]
        return pa.RecordBatch.from_arrays([ids, pa.array(f["parts"].astype(np.int32)), *(pa.array(f[n].round(4)) for n in names)], ["vec_id", "parts", *names])

    return _vectors(spark, sf_dir).mapInArrow(_two_receivers(run), "vec_id long, parts int, swing double, deviation double, balance_min double, balance_max double")


_PART = "(0.5 - 0.5 * cos(2 * pi() * i / 7))"
_TURN = "2 * pi() * bin * i / 16"
_SUB = [
    f"sum({_PART} * (e[2 * (i + s) + {o + 1}] * {f} {sign} e[2 * (i + s) + {o + 2}] * {g}))" if sign == "+" else f"sum({_PART} * (e[2 * (i + s) + {o + 2}] * {f} - e[2 * (i + s) + {o + 1}] * {g}))"
    for o in (0, 32)
    for f, sign, g in ((f"cos({_TURN})", "+", f"sin({_TURN})"), (f"cos({_TURN})", "-", f"sin({_TURN})"))
]
FRINGES_SQL = f"""WITH {_receivers_sql(16)}, p AS (SELECT vec_id, arg_max(bin, (round(sqrt(ar * ar + ai * ai), 9), -bin)) AS peak FROM b GROUP BY 1),
w AS (SELECT p.vec_id, unnest(range(greatest(peak - 2, 0), least(peak + 3, 16))) AS bin, embedding::DOUBLE[] AS e FROM p JOIN embeddings USING (vec_id)),
s AS (SELECT vec_id, bin, e, unnest([0, 4, 8]) AS s FROM w), u AS (SELECT vec_id, bin, s, e, unnest(range(0, 8)) AS i FROM s),
d AS (SELECT vec_id, s, bin, {_SUB[0]} AS ar, {_SUB[1]} AS ai, {_SUB[2]} AS br, {_SUB[3]} AS bi FROM u GROUP BY vec_id, s, bin),
f AS (SELECT vec_id, s, arg_max({{'ar': ar, 'ai': ai, 'br': br, 'bi': bi}}, sqrt(ar * ar + ai * ai) + sqrt(br * br + bi * bi)) AS x FROM d GROUP BY 1, 2),
g AS (SELECT vec_id, x.ar AS ar, x.ai AS ai, x.br AS br, x.bi AS bi FROM f), h AS (SELECT vec_id, {_ARRIVAL} AS angle, sqrt(br * br + bi * bi) / sqrt(ar * ar + ai * ai) AS balance FROM g)
SELECT vec_id, count(*)::INT AS parts, round(max(angle) - min(angle), 4) AS swing, round(stddev_pop(angle), 4) AS deviation, round(min(balance), 4) AS balance_min, round(max(balance), 4) AS balance_max FROM h GROUP BY 1"""

QUERIES = {
    "payload_channels": (payload_channels, PAYLOAD_SQL),
    "capture_channels": (capture_channels, CAPTURE_CHANNELS_SQL),
    "radar_diagnostics": (radar_diagnostics, None),
    "angle_velocity_map": (angle_velocity_map, MAP_SQL),
    "spatial_detections": (spatial_detections, SPATIAL_SQL),
    "subframe_fringes": (subframe_fringes, FRINGES_SQL),
}
