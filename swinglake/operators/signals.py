"""Signal operators over captures and frames: numpy works on Arrow batches, one row or one group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions import dsp
from swinglake.functions.radc import SOURCES, combined
from swinglake.functions.stats import quantiles


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of the first eight frequencies of each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.abs(np.fft.fft(np.stack(p["x"].to_numpy()), axis=1))[:, :8] if len(p) else np.zeros((0, 8))
            yield pd.DataFrame({"vec_id": np.repeat(p["vec_id"].to_numpy(), 8), "freq": np.tile(np.arange(8), len(p)), "magnitude": m.ravel().round(5)})

    return _frames(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, freq int, magnitude double")


DFT_SQL = """WITH k AS (SELECT vec_id, unnest(range(0, 8)) AS freq, embedding FROM embeddings),
t AS (SELECT vec_id, freq, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM k)
SELECT vec_id, freq::INT AS freq, round(sqrt(pow(sum(x * cos(2 * pi() * freq * i / 64)), 2) + pow(sum(x * sin(2 * pi() * freq * i / 64)), 2)), 5) AS magnitude FROM t GROUP BY 1, 2"""


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of overlapping windows of 16 in steps of 8, and the window with the most: the first one on ties."""
    f = _frames(spark, sf_dir)
    energy = lambda w: F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v)
    windows = F.transform(F.sequence(F.lit(0), F.lit(48), F.lit(8)), lambda s: F.struct(energy(F.slice("x", s + 1, 16)).alias("e"), (-s).alias("minus")))
    best = F.array_max(windows)
    return f.select("vec_id", F.round(best["e"], 5).alias("energy"), (-best["minus"]).alias("start"))


SLIDING_SQL = """WITH w AS (SELECT vec_id, unnest(range(0, 49, 8)) AS start, embedding FROM embeddings),
e AS (SELECT vec_id, start, list_sum(list_transform(embedding[start + 1:start + 16], lambda v: v::DOUBLE * v::DOUBLE)) AS e FROM w)
SELECT vec_id, round(max(e), 5) AS energy, arg_max(start, (e, -start))::INT AS start FROM e GROUP BY 1"""


def median_iqr_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartiles of each position over the frames of a label."""
    f = _frames(spark, sf_dir).select("label", F.posexplode("x").alias("i", "v"))
    return quantiles(f, ["label", "i"], "v", (0.25, 0.5, 0.75)).select("label", "i", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q25", "median", "q75"))])


BAND_SQL = """WITH f AS (SELECT label, unnest(range(0, 64))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, i, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM f GROUP BY 1, 2"""


def channel_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each frame as two interleaved channels: means, deviations, their correlation (0 where flat) and ratio."""
    f = _frames(spark, sf_dir).select("vec_id", F.filter("x", lambda v, k: k % 2 == 0).alias("i"), F.filter("x", lambda v, k: k % 2 == 1).alias("q"))
    s = f.select("vec_id", F.posexplode(F.arrays_zip("i", "q")).alias("k", "p")).select("vec_id", "p.i", "p.q")
    sd_i, sd_q = F.stddev_pop("i"), F.stddev_pop("q")
    return s.groupBy("vec_id").agg(
        F.round(F.avg("i"), 6).alias("mean_i"),
        F.round(sd_i, 6).alias("sd_i"),
        F.round(F.coalesce(F.try_divide(F.covar_pop("i", "q"), sd_i * sd_q), F.lit(0.0)), 6).alias("iq_corr"),
        F.round(F.when(sd_i > 0, sd_q / sd_i).otherwise(F.lit(float("inf"))), 6).alias("sd_ratio"),
    )


HEALTH_SQL = """WITH s AS (SELECT vec_id, unnest(embedding[1::2])::DOUBLE AS i, unnest(embedding[2::2])::DOUBLE AS q FROM embeddings)
SELECT vec_id, round(avg(i), 6) AS mean_i, round(stddev_pop(i), 6) AS sd_i, round(coalesce(covar_pop(i, q) / nullif(stddev_pop(i) * stddev_pop(q), 0), 0), 6) AS iq_corr,
round(stddev_pop(q) / stddev_pop(i), 6) AS sd_ratio FROM s GROUP BY 1""".replace("embedding[1::2]", "[embedding[2 * k + 1] for k in range(0, 32)]").replace("embedding[2::2]", "[embedding[2 * k + 2] for k in range(0, 32)]")


def cfar_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of each frame's spectrum that stand out of their surroundings, strongest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(v, rank, k, round(r, 6)) for v, x in zip(p["vec_id"], p["x"], strict=True) for rank, (k, r) in enumerate(dsp.cfar(np.abs(np.fft.fft(x, 128))[:64], 8, 2))]
            yield pd.DataFrame(rows, columns=["vec_id", "place", "bin", "ratio"])

    return _frames(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, place int, bin int, ratio double")


CFAR_SQL = """WITH k AS (SELECT vec_id, unnest(range(0, 64)) AS bin, embedding FROM embeddings),
t AS (SELECT vec_id, bin, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM k),
m AS (SELECT vec_id, bin, sqrt(pow(sum(x * cos(2 * pi() * bin * i / 128)), 2) + pow(sum(x * sin(2 * pi() * bin * i / 128)), 2)) AS m FROM t GROUP BY 1, 2),
n AS (SELECT a.vec_id, a.bin, a.m, quantile_cont(b.m, 0.5) AS noise FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.bin - b.bin) BETWEEN 3 AND 10 GROUP BY 1, 2, 3)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY m / noise DESC, bin) - 1)::INT AS place, bin::INT AS bin, round(m / noise, 6) AS ratio FROM n WHERE noise > 0 AND m > 3 * noise"""


def frame_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed peaks of each frame read as a capture of 32 complex samples, at most three to either direction and 50 bins apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for v, x in zip(p["vec_id"], p["x"], strict=True):
                s = np.abs(np.fft.fft((x[0::2] - x[0::2].mean()) + 1j * (x[1::2] - x[1::2].mean()), dsp.FFT))
                for side, half in (("outbound", s[dsp.LOW_BIN : dsp.HIGH_BIN + 1]), ("inbound", s[dsp.FFT - dsp.LOW_BIN : dsp.FFT // 2 : -1])):
                    rows += [(v, side, round((k + dsp.LOW_BIN) * dsp.MPH_PER_BIN, 6), round(float(half[k]), 5)) for k in dsp.peaks(half, floor=0.0)]
            yield pd.DataFrame(rows, columns=["vec_id", "direction", "mph", "magnitude"])

    return _frames(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, direction string, mph double, magnitude double")


def _nth_peak(n: int) -> str:
    """The strongest of the peaks that are clear of those before."""
    clear = " AND ".join([f"abs(m.bin - p{k}.bin) >= {dsp.PEAK_GAP}" for k in range(1, n)])
    joins = " ".join(f"JOIN p{k} ON p{k}.vec_id = m.vec_id AND p{k}.direction = m.direction" for k in range(1, n))
    return f"p{n} AS (SELECT m.vec_id, m.direction, arg_max(m.bin, (m.m, -m.bin)) AS bin, max(m.m) AS m FROM tops m {joins} {'WHERE ' + clear if clear else ''} GROUP BY 1, 2)"


SPEEDS_SQL = f"""WITH c AS (SELECT vec_id, [embedding[2 * i + 1]::DOUBLE for i in range(0, 32)] AS a, [embedding[2 * i + 2]::DOUBLE for i in range(0, 32)] AS b FROM embeddings),
z AS (SELECT vec_id, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM c),
k AS (SELECT vec_id, a, b, unnest(range({dsp.LOW_BIN}, {dsp.HIGH_BIN + 1})) AS bin FROM z),
t AS (SELECT vec_id, bin, unnest(a) AS a, unnest(b) AS b, 2 * pi() * bin * unnest(range(0, 32)) / {dsp.FFT} AS w FROM k),
s AS (SELECT vec_id, bin, sum(a * cos(w)) AS ac, sum(b * sin(w)) AS bs, sum(b * cos(w)) AS bc, sum(a * sin(w)) AS sa FROM t GROUP BY 1, 2),
m AS (SELECT vec_id, 'outbound' AS direction, bin, sqrt(pow(ac + bs, 2) + pow(bc - sa, 2)) AS m FROM s UNION ALL SELECT vec_id, 'inbound', bin, sqrt(pow(ac - bs, 2) + pow(bc + sa, 2)) FROM s),
n AS (SELECT *, lag(m) OVER w AS l, lead(m) OVER w AS r FROM m WINDOW w AS (PARTITION BY vec_id, direction ORDER BY bin)), tops AS (SELECT vec_id, direction, bin, m FROM n WHERE m > l AND m > r),
{_nth_peak(1)}, {_nth_peak(2)}, {_nth_peak(3)}
SELECT vec_id, direction, round(bin * {dsp.MPH_PER_BIN!r}::DOUBLE, 6) AS mph, round(m, 5) AS magnitude FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


#: A frame's strength: some are loud, some lost; of label 3 most are lost.
LOUDNESS = "CASE WHEN vec_id % 13 = 0 THEN 4.0 WHEN vec_id % 5 = 0 OR label = 3 AND vec_id % 3 <> 0 THEN 0.0 ELSE 1.0 END"


def impact_frames(spark: SparkSession, sf_dir: str, factor: float = 3.0) -> DataFrame:
    """Frames of a capture with more energy at high speed, either way, than ``factor`` times the median of its frames with any; none where the median frame has none.

    A frame is 32 complex samples, a capture the frames of a label among a hundred running ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = np.stack(p["x"].to_numpy()) if len(p) else np.zeros((0, 64))
            s = np.abs(np.fft.fft(x[:, 0::2] + 1j * x[:, 1::2], axis=1)) * p["loudness"].to_numpy()[:, None]
            yield pd.DataFrame({"vec_id": p["vec_id"], "label": p["label"], "energy": (s[:, 4:16] ** 2).sum(axis=1) + (s[:, 20:] ** 2).sum(axis=1)})

    f = _frames(spark, sf_dir).withColumn("loudness", F.expr(LOUDNESS).cast("double"))
    energies = f.mapInPandas(run, f"vec_id long, label {dict(f.dtypes)['label']}, energy double").withColumn("capture", F.expr("vec_id div 100"))
    w = Window.partitionBy("label", "capture")
    level = F.median(F.when(F.col("energy") > 0, F.col("energy"))).over(w)
    hit = (F.median("energy").over(w) > 0) & (F.col("energy") > factor * level)
    return energies.withColumn("hit", hit).where("hit").select("vec_id", "label", F.round("energy", 4).alias("energy"))


IMPACT_SQL = f"""WITH k AS (SELECT vec_id, label, {LOUDNESS}::DOUBLE AS l, unnest(list_concat(range(4, 16), range(20, 32))) AS freq, embedding FROM embeddings),
t AS (SELECT vec_id, label, l, freq, unnest([embedding[2 * i + 1] for i in range(0, 32)])::DOUBLE AS a, unnest([embedding[2 * i + 2] for i in range(0, 32)])::DOUBLE AS b, 2 * pi() * freq * unnest(range(0, 32)) / 32 AS z FROM k),
m AS (SELECT vec_id, label, l, freq, pow(sum(a * cos(z) + b * sin(z)), 2) + pow(sum(b * cos(z) - a * sin(z)), 2) AS p FROM t GROUP BY 1, 2, 3, 4),
e AS (SELECT vec_id, label, vec_id // 100 AS capture, sum(p) * l * l AS energy FROM m GROUP BY vec_id, label, l),
c AS (SELECT label, capture, quantile_cont(energy, 0.5) AS typical, quantile_cont(energy, 0.5) FILTER (energy > 0) AS level FROM e GROUP BY 1, 2)
SELECT vec_id, e.label, round(energy, 4) AS energy FROM e JOIN c ON e.label = c.label AND e.capture = c.capture WHERE typical > 0 AND energy > 3.0 * level"""


def channel_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle between two channels of a frame (its halves as complex samples) from their summed cross product, and how well its phases agree."""
    f = _frames(spark, sf_dir)
    part = lambda c: F.filter(F.slice("x", c[0] + 1, 32), lambda v, k: k % 2 == c[1])
    f = f.select("vec_id", *[part(c).alias(n) for n, c in {"ai": (0, 0), "aq": (0, 1), "bi": (32, 0), "bq": (32, 1)}.items()])
    s = f.select("vec_id", F.explode(F.arrays_zip("ai", "aq", "bi", "bq")).alias("s")).select("vec_id", "s.*")
    real, imaginary = F.col("ai") * F.col("bi") + F.col("aq") * F.col("bq"), F.col("aq") * F.col("bi") - F.col("ai") * F.col("bq")
    sums = s.groupBy("vec_id").agg(F.sum(real).alias("re"), F.sum(imaginary).alias("im"), F.sum(F.sqrt(real * real + imaginary * imaginary)).alias("size"))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.atan2("im", "re") / F.pi()))
    return sums.select("vec_id", F.round(F.degrees(F.asin(sine)), 5).alias("angle"), F.round(F.try_divide(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.col("size")), 5).alias("coherence"))


CHANNEL_ANGLES_SQL = """WITH s AS (SELECT vec_id, unnest(range(0, 16)) AS k, embedding AS e FROM embeddings),
c AS (SELECT vec_id, e[2 * k + 1]::DOUBLE AS ai, e[2 * k + 2]::DOUBLE AS aq, e[2 * k + 33]::DOUBLE AS bi, e[2 * k + 34]::DOUBLE AS bq FROM s),
p AS (SELECT vec_id, ai * bi + aq * bq AS re, aq * bi - ai * bq AS im FROM c),
t AS (SELECT vec_id, sum(re) AS re, sum(im) AS im, sum(sqrt(re * re + im * im)) AS size FROM p GROUP BY 1)
SELECT vec_id, round(degrees(asin(greatest(-1, least(1, atan2(im, re) / pi())))), 5) AS angle, round(sqrt(re * re + im * im) / size, 5) AS coherence FROM t"""


def fringe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame in four parts in time: the energy of each, how much of it lies in the strongest part, and whether energy rises towards it."""
    energy = lambda w: F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v)
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(energy(F.slice("x", k * 16 + 1, 16)).alias("e"), (-k).alias("first")))
    f = _frames(spark, sf_dir).select("vec_id", parts.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, v: s + v["e"])
    best = F.array_max("p")
    return f.select("vec_id", (-best["first"]).alias("part"), F.round(F.try_divide(best["e"], total), 6).alias("share"), (F.col("p")[1]["e"] > F.col("p")[0]["e"]).alias("rises"))


FRINGE_SQL = """WITH p AS (SELECT vec_id, unnest(range(0, 4)) AS k, embedding FROM embeddings),
e AS (SELECT vec_id, k, list_sum(list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda v: v::DOUBLE * v::DOUBLE)) AS e FROM p)
SELECT vec_id, arg_max(k, (e, -k))::INT AS part, round(max(e) / sum(e), 6) AS share, max(e) FILTER (k = 1) > max(e) FILTER (k = 0) AS rises FROM e GROUP BY 1"""

def spectrum_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest bin of each frame by every source; a frame's channels are its halves and its middle as 16 complex samples. The lower of equal bins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = np.stack(p["x"].to_numpy()) if len(p) else np.zeros((0, 64))
            channels = [np.abs(np.fft.fft(x[:, k : k + 32 : 2] + 1j * x[:, k + 1 : k + 32 : 2], axis=1)) for k in (0, 32, 16)]
            for name, s in combined(*channels).items():
                yield pd.DataFrame({"vec_id": p["vec_id"], "source": name, "bin": s.round(6).argmax(axis=1), "magnitude": s.max(axis=1, initial=0.0).round(4)})

    return _frames(spark, sf_dir).select("vec_id", "x").mapInPandas(run, "vec_id long, source string, bin int, magnitude double")


def _channel(offset: int) -> str:
    re = f"sum(e[2 * i + {offset + 1}] * cos(2 * pi() * bin * i / 16) + e[2 * i + {offset + 2}] * sin(2 * pi() * bin * i / 16))"
    im = f"sum(e[2 * i + {offset + 2}] * cos(2 * pi() * bin * i / 16) - e[2 * i + {offset + 1}] * sin(2 * pi() * bin * i / 16))"
    return f"sqrt(pow({re}, 2) + pow({im}, 2))"


SOURCES_SQL = f"""WITH k AS (SELECT vec_id, unnest(range(0, 16)) AS bin, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT vec_id, bin, e, unnest(range(0, 16)) AS i FROM k),
m AS (SELECT vec_id, bin, {_channel(0)} AS a, {_channel(32)} AS b, {_channel(16)} AS c FROM t GROUP BY 1, 2),
s AS (SELECT vec_id, bin, unnest({list(SOURCES)}) AS source, unnest([a, b, c, (a + b) / 2, least(a, b), sqrt(a * b), (a + c) / 2, (a + b + c) / 3]) AS v FROM m)
SELECT vec_id, source, arg_max(bin, (round(v, 6), -bin))::INT AS bin, round(max(v), 4) AS magnitude FROM s GROUP BY 1, 2"""

QUERIES = {
    "spectrum_sources": (spectrum_sources, SOURCES_SQL),
    "dft_magnitude": (dft_magnitude, DFT_SQL),
    "sliding_windows": (sliding_windows, SLIDING_SQL),
    "median_iqr_band": (median_iqr_band, BAND_SQL),
    "channel_health": (channel_health, HEALTH_SQL),
    "cfar_peaks": (cfar_peaks, CFAR_SQL),
    "frame_speeds": (frame_speeds, SPEEDS_SQL),
    "impact_frames": (impact_frames, IMPACT_SQL),
    "channel_angles": (channel_angles, CHANNEL_ANGLES_SQL),
    "fringe_metrics": (fringe_metrics, FRINGE_SQL),
}
