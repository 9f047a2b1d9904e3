"""Spin of captures: which line of the seam's band is taken, which captures are refused and why, and how far to trust the rest.

The spectra come from numpy on Arrow batches, a capture a row (:mod:`swinglake.functions.spin`); all choices are columns over the band's
arrays, so they can be read, tested and changed without the signal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.functions import spin

# Fixed values of the gates: strengths, cycles, depths and agreement.
HIGH, MEDIUM, LEAST, PHASE_FLOOR, PHASE_LEAST = 8.0, 5.0, 2.5, 1.75, 2.5
LEAST_CYCLES, LEAST_DEPTH, WEAK_DEPTH, RAIL_DEPTH = 2, 0.005, 0.01, 0.012
REPEAT_LEAST, REPEAT_OFF, PHASE_OFF_PCT, LOW_RPM = 0.3, 0.10, 10.0, 3100.0
# Fixed values of the choice by the expected spin: shares of the strongest line, errors, and which spins are high.
RAIL, KEPT = 2, 5
NEAR_SHARE, NEAR_OFF, FAR_OFF = 0.40, 0.55, 0.45
HIGH_RPM, RAIL_SHARE, BACK_SHARE, BACK_OFF = 6000.0, 0.60, 0.20, 0.35
RELIABLE = 0.6
LOW_EDGE, HIGH_EDGE = spin.LEAK + RAIL, len(spin.BINS) - RAIL
STEP_HZ = spin.FS / spin.FFT

EVIDENCE = (
    "stop string, samples int, depth double, band array<double>, shoulder array<double>, lasting array<boolean>, repeat_rpm double, repeat_corr double, "
    "phase_residual array<double>, instant_frequency array<double>"
)


def rpm_of(k: Column) -> Column:
    return (k + int(spin.BINS[0])) * (STEP_HZ * 60)


#: Captures that are looked at together.
TOGETHER = 64
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def over_captures(captures: DataFrame, keep: list[str], run: Run, columns: str, derived: tuple[Run, str] | None) -> DataFrame:
    """``run`` over the captures, few at a time: the columns ``keep`` and ``columns``.

    ``derived``, a function and its schema, makes the captures of ``captures``' rows in the same task. Samples are a hundred times what they are
    made of, and between two functions Spark would gather them by ten thousand captures (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    """
    make, shape = (derived[0], captures.mapInArrow(*derived)) if derived else (iter, captures)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in shape.select(*[F.col(f"`{c}`") for c in keep]).schema] + [columns])
    return captures.mapInArrow(lambda batches: run(in_slices(make(batches))), schema)


def kept_columns(captures: DataFrame, derived: tuple[Run, str] | None) -> list[str]:
    """All columns of captures but the samples."""
    return [c for c in (captures.mapInArrow(*derived) if derived else captures).columns if c not in ("i", "q")]


def with_evidence(captures: DataFrame, derived: tuple[Run, str] | None = None) -> DataFrame:
    """Captures (i, q, ball_speed, ball_ms and any other columns) with their evidence in place of the samples; ``derived``: :func:`over_captures`."""
    keep = kept_columns(captures, derived)
    names = [c.split()[0] for c in EVIDENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, q, mph, ms = (b.column(b.schema.get_field_index(c)) for c in ("i", "q", "ball_speed", "ball_ms"))
            found = []
            for k in range(b.num_rows):
                there = i[k].is_valid and q[k].is_valid and mph[k].is_valid and len(i[k].values) == len(q[k].values) > 1
                samples = [np.asarray(c[k].values, float) for c in (i, q)] if there else []
                found.append(spin.evidence(*samples, mph[k].as_py(), ms[k].as_py() or 0.0) if there else {"stop": "no_samples"})
            arrays = []
            for name in names:
                values = [None if (v := f.get(name)) is None else v.tolist() if isinstance(v, np.ndarray) else v for f in found]
                kind = {"stop": pa.string(), "samples": pa.int32(), "lasting": pa.list_(pa.bool_())}.get(name, pa.list_(pa.float64()) if name in LISTS else pa.float64())
                arrays.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *arrays], [*keep, *names])

    return over_captures(captures, keep, run, EVIDENCE, derived)


LISTS = ("band", "shoulder", "phase_residual", "instant_frequency")


def lines_of(band: Column) -> Column:
    """array<struct<k, size>> of the band's lines: bins above both neighbours, and the strongest bin, by place."""
    at = F.transform(band, lambda v, k: F.struct(k.alias("k"), v.alias("size")))
    top = strongest(band)
    return F.filter(at, lambda c: (c["k"] == top) | F.coalesce((c["size"] > F.get(band, c["k"] - 1)) & (c["size"] > F.get(band, c["k"] + 1)), F.lit(False)))


def strongest(band: Column) -> Column:
    """The first of the largest bins."""
    return (F.array_position(band, F.array_max(band)) - 1).cast("int")


def chosen(band: Column, expected: Column) -> Column:
    """The bin that is taken: the strongest, unless the expected spin speaks for another line.

    Lines off the rails near the expectation replace a strongest bin on the lower rail, or one far off. Where the expectation is high and the
    strongest bin is far below it on the rail, fainter lines nearer to it do.
    """
    top, most = strongest(band), F.array_max(band)
    off = lambda k: F.abs(rpm_of(k) - expected) / expected
    inner = F.filter(lines_of(band), lambda c: (c["k"] >= LOW_EDGE) & (c["k"] < HIGH_EDGE))
    scored = F.transform(inner, lambda c: F.struct(off(c["k"]).alias("off"), (-c["size"] / most).alias("minus"), c["k"].alias("k")))
    near = F.array_min(F.filter(scored, lambda c: (-c["minus"] >= NEAR_SHARE) & (c["off"] <= NEAR_OFF)))
    back = F.filter(scored, lambda c: (-c["minus"] >= BACK_SHARE) & (c["off"] <= BACK_OFF))
    loudest = F.array_min(F.transform(back, lambda c: F.struct(c["minus"].alias("minus"), c["off"].alias("off"), c["k"].alias("k"))))
    low = top < LOW_EDGE
    lost = low & (expected >= HIGH_RPM) & (rpm_of(top) < expected * RAIL_SHARE)
    by_prior = F.when(near.isNotNull(), F.when(low | ((off(top) > FAR_OFF) & (near["off"] < off(top))), near["k"])).when(lost, loudest["k"])
    return F.when((expected > 0) & (most > 0), F.coalesce(by_prior, top)).otherwise(top)


def median_above_zero(band: Column) -> Column:
    live = F.sort_array(F.filter(band, lambda v: v > 0))
    n = F.size(live)
    return (F.get(live, F.floor((n - 1) / 2).cast("int")) + F.get(live, F.floor(n / 2).cast("int"))) / 2.0


def ratio(size: Column, floor: Column) -> Column:
    return F.when(floor > 0, size / floor).otherwise(0.0)


def candidates_of(band: Column, picked: Column, floor: Column, expected: Column) -> Column:
    """The strongest lines in their order, and the picked one wherever it stands."""
    by_size = F.array_sort(F.transform(lines_of(band), lambda c: F.struct((-c["size"]).alias("minus"), c["k"].alias("k"))))
    ranked = F.transform(by_size, lambda c, i: F.struct((i + 1).alias("place"), c["k"].alias("k"), (-c["minus"]).alias("size")))
    kept = F.filter(ranked, lambda c: (c["place"] <= KEPT) | (c["k"] == picked))
    most = F.array_max(band)
    return F.transform(
        kept,
        lambda c, i: F.struct(
            (i + 1).alias("rank"),
            rpm_of(c["k"]).alias("rpm"),
            (c["size"] / most).alias("share"),
            ratio(c["size"], floor).alias("snr"),
            (c["k"] < LOW_EDGE).alias("lower_rail"),
            (c["k"] >= HIGH_EDGE).alias("upper_rail"),
            F.when(expected > 0, F.abs(rpm_of(c["k"]) - expected) / expected * 100).alias("off_pct"),
            (c["k"] == picked).alias("selected"),
        ),
    )


def witness(band: Column, name: str, turns: Column, expected: Column) -> Column:
    """struct<denied, off_pct, minus_snr, method, rpm, snr>: a phase band's line against the envelope's; null without a band."""
    k = chosen(band, expected)
    snr = ratio(F.get(band, k), median_above_zero(band))
    off = F.abs(rpm_of(k) - turns) / F.greatest(turns, F.lit(1.0)) * 100
    agrees = (snr >= PHASE_LEAST) & (k >= LOW_EDGE) & (k < HIGH_EDGE) & (off <= PHASE_OFF_PCT)
    out = F.struct((~agrees).alias("denied"), off.alias("off_pct"), (-snr).alias("minus_snr"), F.lit(name).alias("method"), rpm_of(k).alias("rpm"), snr.alias("snr"))
    return F.when(F.array_max(band) > 0, out)


def judged(seen: DataFrame, expected: Column | None = None) -> DataFrame:
    """Evidence with the spin's verdict: rpm (0 where refused), reason, quality, confidence, and what they rest on."""
    keep = [c for c in seen.columns if c not in EVIDENCE_NAMES]
    d = seen.withColumn("expected", F.lit(None).cast("double") if expected is None else expected.cast("double"))
    d = d.withColumn("k", chosen(F.col("band"), F.col("expected")))
    turns = rpm_of(F.col("k"))
    floor = F.greatest(F.coalesce(median_above_zero(F.col("band")), F.lit(1.0)), F.get("shoulder", F.col("k")))
    d = d.withColumns({"turns": turns, "floor": floor}).withColumns(
        {
            "snr": ratio(F.get("band", F.col("k")), F.col("floor")),
            "cycles": F.col("turns") / 60 * F.col("samples") / spin.FS,
            "lower": F.col("k") < LOW_EDGE,
            "upper": F.col("k") >= HIGH_EDGE,
        }
    )
    snr, cycles = F.col("snr"), F.col("cycles")
    repeats = snr.between(LEAST, MEDIUM) & (snr < MEDIUM) & (F.col("repeat_corr") >= REPEAT_LEAST)
    repeats = repeats & (F.abs(F.col("repeat_rpm") - F.col("turns")) / F.greatest(F.col("turns"), F.lit(1.0)) < REPEAT_OFF)
    heard = F.array_min(F.array_compact(F.array(*[witness(F.col(n), n, F.col("turns"), F.col("expected")) for n in ("phase_residual", "instant_frequency")])))
    asked = (snr < LEAST) & (snr >= PHASE_FLOOR) & ~F.col("lower") & ~F.col("upper")
    d = d.withColumns({"repeats": F.coalesce(repeats, F.lit(False)), "witness": F.when(asked, heard)})
    confirmed = F.coalesce(~F.col("witness.denied"), F.lit(False))
    d = d.withColumn(
        "reason",
        F.when(F.col("stop").isin("no_samples", "outside_filter", "too_short"), F.col("stop"))
        .when(F.col("depth") < LEAST_DEPTH, "modulation_too_low")
        .when(F.col("stop").isNotNull(), F.col("stop"))
        .when(F.col("upper") & (snr < HIGH), "upper_rail")
        .when(F.col("lower") & (F.coalesce(F.col("depth") < RAIL_DEPTH, F.lit(True)) | (snr < MEDIUM)), "lower_rail")
        .when(cycles < LEAST_CYCLES, "too_few_cycles")
        .when((snr < LEAST) & ~confirmed, "snr_too_low"),
    )
    steps = (
        F.when(snr < LEAST, F.struct(F.lit("low").alias("quality"), F.lit(0.3).alias("confidence")))
        .when((snr >= HIGH) & (cycles >= 5), F.struct(F.lit("high").alias("quality"), F.lit(0.9).alias("confidence")))
        .when((snr >= HIGH) & (cycles >= 3), F.struct(F.lit("high").alias("quality"), F.lit(0.8).alias("confidence")))
        .when((snr >= MEDIUM) & ((cycles >= 3) | F.col("repeats")), F.struct(F.lit("medium").alias("quality"), F.lit(0.7).alias("confidence")))
        .when((snr >= MEDIUM) | F.col("repeats"), F.struct(F.lit("low").alias("quality"), F.lit(0.5).alias("confidence")))
        .otherwise(F.struct(F.lit("low").alias("quality"), F.lit(0.3).alias("confidence")))
    )
    # what is taken off: a line of one half alone, a shallow modulation, a line in the low band
    fleeting = (snr >= LEAST) & ~F.get("lasting", F.col("k"))
    shallow = F.coalesce(F.col("depth") < WEAK_DEPTH, F.lit(False)) & (snr >= LEAST)
    deep_down = (F.col("lower") | (F.col("turns") <= LOW_RPM)) & (snr >= LEAST)
    taken = F.col("reason").isNull()
    d = d.withColumn("step", steps).withColumns(
        {
            "confidence": F.when(taken, F.least(F.col("step.confidence"), F.when(fleeting, 0.3).when(shallow | deep_down, 0.5).otherwise(1.0))).otherwise(0.0),
            "quality": F.when(~taken, "none").when(fleeting | deep_down, "low").when(shallow & (F.col("step.quality") == "high"), "medium").otherwise(F.col("step.quality")),
        }
    )
    reliable = (F.col("confidence") >= RELIABLE) & F.col("quality").isin("high", "medium")
    said = F.col("stop").isNull() & ~F.coalesce(F.col("depth") < LEAST_DEPTH, F.lit(False))
    return d.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(taken, F.bround("turns")).otherwise(0.0).alias("spin_rpm"),
        "reason",
        "quality",
        "confidence",
        reliable.alias("reliable"),
        F.when(said, F.round("snr", 2)).alias("snr"),
        "depth",
        F.when(said, F.col("cycles")).alias("cycles"),
        F.coalesce(said & F.col("lower"), F.lit(False)).alias("lower_rail"),
        F.coalesce(said & F.col("upper"), F.lit(False)).alias("upper_rail"),
        F.col("witness.method").alias("phase_method"),
        F.bround("witness.rpm").alias("phase_rpm"),
        (taken & confirmed).alias("phase_confirmed"),
        F.when(said, candidates_of(F.col("band"), F.col("k"), F.col("floor"), F.col("expected"))).alias("candidates"),
    )


EVIDENCE_NAMES = [c.split()[0] for c in EVIDENCE.split(", ")]


def detect_spin(captures: DataFrame, expected: Column | None = None, derived: tuple[Run, str] | None = None) -> DataFrame:
    """The spin of captures: i and q of 30,000 samples a second, ball_speed, ball_ms (when the ball is first seen).

    ``expected``: the spin that club and speed suggest, or null. A capture without samples or speed is refused as such.
    """
    return judged(with_evidence(captures, derived), expected)


#: Lengths of the windows that are tried (ms).
LENGTHS = (25, 30, 35, 45, 60, 80)


def window_spins(captures: DataFrame, expected: Column | None = None, lengths_ms: tuple[int, ...] = LENGTHS, derived: tuple[Run, str] | None = None) -> DataFrame:
    """The spin that each window of each capture gives alone, by the envelope's line and the gates on it: for comparing windows.

    Without what judges a line by its surroundings, its halves or the phase. A capture without samples or speed, or with a speed outside the
    band, has no windows.
    """
    keep = kept_columns(captures, derived)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, q, mph, ms = (b.column(b.schema.get_field_index(c)) for c in ("i", "q", "ball_speed", "ball_ms"))
            rows, found = [], []
            for k in range(b.num_rows):
                if i[k].is_valid and q[k].is_valid and mph[k].is_valid and len(i[k].values) == len(q[k].values) > 1:
                    mine = spin.window_evidence(*(np.asarray(c[k].values, float) for c in (i, q)), mph[k].as_py(), ms[k].as_py() or 0.0, lengths_ms)
                    found += mine
                    rows += [k] * len(mine)
            take = pa.array(rows, pa.int64())
            kinds = {"window": pa.string(), "samples": pa.int32(), "depth": pa.float64(), "band": pa.list_(pa.float64())}
            arrays = [pa.array([f[n] for f in found], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(take) for c in keep), *arrays], [*keep, *kinds])

    found = over_captures(captures, keep, run, "window string, samples int, depth double, band array<double>", derived)
    d = found.withColumn("expected", F.lit(None).cast("double") if expected is None else expected.cast("double"))
    return by_envelope(d).select(*[F.col(f"`{c}`") for c in keep], "window", "samples", "spin_rpm", "reason", "quality", "confidence", "snr", "cycles", "reportable")


def by_envelope(d: DataFrame) -> DataFrame:
    """Windows (samples, depth, band, expected) with the verdict of the envelope's line alone."""
    d = d.withColumn("k", chosen(F.col("band"), F.col("expected"))).withColumn("turns", rpm_of(F.col("k")))
    d = d.withColumns({"snr": ratio(F.get("band", F.col("k")), F.coalesce(median_above_zero(F.col("band")), F.lit(1.0))), "cycles": F.col("turns") / 60 * F.col("samples") / spin.FS})
    lower, upper = F.col("k") < LOW_EDGE, F.col("k") >= HIGH_EDGE
    reason = (
        F.when(F.col("samples") < spin.LEAST_SAMPLES, "too_short")
        .when(F.col("depth") < LEAST_DEPTH, "modulation_too_low")
        .when(F.col("band").isNull(), "flat")
        .when(upper & (F.col("snr") < HIGH), "upper_rail")
        .when(lower & F.coalesce(F.col("depth") < RAIL_DEPTH, F.lit(True)), "lower_rail")
        .when(F.col("cycles") < LEAST_CYCLES, "too_few_cycles")
        .when(F.col("snr") < LEAST, "snr_too_low")
    )
    strong, fair = F.col("snr") >= HIGH, F.col("snr") >= MEDIUM
    step = (
        F.when(strong & (F.col("cycles") >= 5), F.struct(F.lit("high").alias("q"), F.lit(0.9).alias("c")))
        .when(strong & (F.col("cycles") >= 3), F.struct(F.lit("high").alias("q"), F.lit(0.8).alias("c")))
        .when(fair & (F.col("cycles") >= 3), F.struct(F.lit("medium").alias("q"), F.lit(0.7).alias("c")))
        .when(fair, F.struct(F.lit("low").alias("q"), F.lit(0.5).alias("c")))
        .otherwise(F.struct(F.lit("low").alias("q"), F.lit(0.3).alias("c")))
    )
    shallow, taken = F.coalesce(F.col("depth") < WEAK_DEPTH, F.lit(False)), F.col("reason").isNull()
    d = d.withColumns({"reason": reason, "step": step, "lower": lower, "upper": upper})
    return d.withColumns(
        {
            "spin_rpm": F.when(taken, F.bround("turns")).otherwise(0.0),
            "confidence": F.when(~taken, 0.0).when(shallow | F.col("lower"), F.least(F.col("step.c"), F.lit(0.5))).otherwise(F.col("step.c")),
            "quality": F.when(~taken, "none").when(F.col("lower"), "low").when(shallow & (F.col("step.q") == "high"), "medium").otherwise(F.col("step.q")),
            "reportable": taken & ~F.col("lower") & ~F.col("upper"),
        }
    )


def spin_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window: how many captures it gives a spin for, how many reliable ones, and how the spins lie to those expected."""
    found = window_spins(capture_vectors(spark, sf_dir), F.col("expected_rpm"), derived=DERIVED)
    off = F.when(F.col("reportable"), F.abs(F.col("spin_rpm") - F.col("expected_rpm")) / F.col("expected_rpm"))
    return found.groupBy("window").agg(
        F.count(F.lit(1)).alias("captures"), F.count_if("reportable").alias("reportable"), F.count_if(F.col("confidence") >= RELIABLE).alias("reliable"), F.round(F.avg("snr"), 3).alias("snr"), F.count_if(off <= 0.1).alias("near")
    )


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of vectors: 4096 samples of a ball's tone whose amplitude a seam and the vector's own noise modulate.

    Some lose the ball half way, some have a club's tone before it, some no seam at all.
    """
    t = np.arange(4096) / spin.FS
    for b in in_slices(batches):
        rows = []
        for key, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            v = np.array(v)
            mph, turns = 70 + 90 * abs(v[0]) / (abs(v[0]) + 0.1), 2200 + 8000 * abs(v[1]) / (abs(v[1]) + 0.1)
            depth = (0.05, 0.02, 0.0, 0.008)[label % 4]
            size = 300 * (1 + depth * np.cos(2 * np.pi * turns / 60 * t + v[2])) * np.exp(-2 * t)
            noise = np.interp(t, np.linspace(0, t[-1], len(v)), v) * 8
            size = np.where((t > 0.07) & (label % 5 == 3), 0.0, size + noise)
            phase = 2 * np.pi * (2 * mph / spin.MPS_TO_MPH / spin.WAVELENGTH_M) * t
            grain = np.resize(v, 4096) * 4 * np.sin(np.arange(4096) * 1.7)
            i, q = np.rint(2048 + size * np.cos(phase) + grain), np.rint(2048 + size * np.sin(phase) + grain[::-1])
            rows.append((key, i.astype(np.int32), q.astype(np.int32), mph, 5.0 + 10 * abs(v[3]), turns if label % 2 else None))
        arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.float64()] * 3), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["capture", "i", "q", "ball_speed", "ball_ms", "expected_rpm"])


#: How captures are made of vectors, for :func:`over_captures`.
DERIVED: tuple[Run, str] = (_captures, "capture long, i array<int>, q array<int>, ball_speed double, ball_ms double, expected_rpm double")


def capture_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings that captures are derived from, dealt over all cores: what is made of a vector is a hundred times its size."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>"))
    return vectors.repartition(spark.sparkContext.defaultParallelism, "vec_id")


def spin_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spin, reason or quality of every capture; the expected spin is at hand for half of them."""
    found = detect_spin(capture_vectors(spark, sf_dir), F.col("expected_rpm"), DERIVED)
    return found.select("capture", "spin_rpm", "reason", "quality", "confidence", "reliable", "snr", "lower_rail", "upper_rail", "phase_confirmed", F.size("candidates").alias("candidates"))


def spin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line taken of each frame's first values read as a seam's band, without and with an expected spin, and the strongest lines."""
    n = len(spin.BINS)
    f = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = lambda v, k: F.when(k < spin.LEAK, 0.0).otherwise(F.round(F.abs(v.cast("double")) * F.when((k < 3) & (F.col("vec_id") % 3 == 0), 4.0).otherwise(1.0), 6))
    f = f.select("vec_id", (2000.0 + F.col("vec_id") * 37 % 9000).alias("expected"), F.transform(F.slice("embedding", 1, n), size).alias("band"))
    taken = chosen(F.col("band"), F.col("expected"))
    f = f.withColumn("k", taken).withColumn("c", candidates_of(F.col("band"), F.col("k"), median_above_zero(F.col("band")), F.col("expected")))
    return f.select(
        "vec_id",
        F.round(rpm_of(strongest(F.col("band"))), 4).alias("strongest_rpm"),
        F.round(rpm_of(F.col("k")), 4).alias("taken_rpm"),
        F.size("c").alias("lines"),
        F.array_join(F.transform("c", lambda c: F.format_string("%.0f", F.round(c["rpm"] * 1000))), ",").alias("rpms"),
        F.round(F.array_max(F.transform("c", lambda c: c["snr"])), 6).alias("snr"),
    )


LINES_SQL = f"""WITH v AS (SELECT vec_id, 2000.0::DOUBLE + vec_id * 37 % 9000 AS expected, unnest(range(0, {len(spin.BINS)})) AS k, embedding FROM embeddings),
b AS (SELECT vec_id, expected, k, (k + {int(spin.BINS[0])}) * {STEP_HZ * 60!r}::DOUBLE AS rpm, CASE WHEN k < {spin.LEAK} THEN 0 ELSE round(abs(embedding[k + 1]::DOUBLE) * CASE WHEN k < 3 AND vec_id % 3 = 0 THEN 4 ELSE 1 END, 6) END AS size FROM v),
m AS (SELECT *, max(size) OVER w AS most, quantile_cont(CASE WHEN size > 0 THEN size END, 0.5) OVER w AS floor, first_value(k) OVER (PARTITION BY vec_id ORDER BY size DESC, k) AS top,
lag(size) OVER (PARTITION BY vec_id ORDER BY k) AS l, lead(size) OVER (PARTITION BY vec_id ORDER BY k) AS r, abs(rpm - expected) / expected AS off FROM b WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT *, k >= {LOW_EDGE} AND k < {HIGH_EDGE} AS inside FROM m WHERE k = top OR coalesce(size > l AND size > r, false)),
t AS (SELECT vec_id, any_value(expected) AS expected, any_value(top) AS top, max(CASE WHEN k = top THEN rpm END) AS top_rpm, max(CASE WHEN k = top THEN off END) AS top_off,
min({{'off': off, 'minus': -size / most, 'k': k}}) FILTER (inside AND size / most >= {NEAR_SHARE} AND off <= {NEAR_OFF}) AS near,
min({{'minus': -size / most, 'off': off, 'k': k}}) FILTER (inside AND size / most >= {BACK_SHARE} AND off <= {BACK_OFF}) AS back FROM p GROUP BY 1),
c AS (SELECT *, coalesce(CASE WHEN near IS NOT NULL THEN CASE WHEN top < {LOW_EDGE} OR top_off > {FAR_OFF} AND near.off < top_off THEN near.k END
WHEN top < {LOW_EDGE} AND expected >= {HIGH_RPM} AND top_rpm < expected * {RAIL_SHARE} THEN back.k END, top) AS taken FROM t),
s AS (SELECT p.*, taken, row_number() OVER (PARTITION BY p.vec_id ORDER BY size DESC, k) AS place FROM p JOIN c ON p.vec_id = c.vec_id)
SELECT vec_id, round(max(CASE WHEN k = top THEN rpm END), 4) AS strongest_rpm, round(max(CASE WHEN k = taken THEN rpm END), 4) AS taken_rpm, count(*)::INT AS lines,
string_agg(printf('%.0f', round(rpm * 1000)), ',' ORDER BY place) AS rpms, round(max(size / floor), 6) AS snr FROM s WHERE place <= {KEPT} OR k = taken GROUP BY 1"""

QUERIES = {"spin_detection": (spin_detection, None), "spin_lines": (spin_lines, LINES_SQL), "spin_windows": (spin_windows, None)}
