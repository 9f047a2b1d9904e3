"""Which frames of a shot set its launch angle, how it is estimated from them, and how far to trust it: columns over arrays of frames.

A candidate is a struct of frame, t (seconds after impact, or null), bin_error (or null), snr, angle, coherence (or null) and weak.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules: times after impact, bins off the speed's bin, and strengths.
EARLY_S, FIRST_S, LAST_S, FLIGHT_S = 0.005, 0.020, 0.100, 0.150
BIN_ERROR, WEAK_SNR, ALONE_SNR, PARTNER_SNR, PARTNER_SHARE = 50, 3.0, 5.0, 2.0, 0.5
# Fixed values of the estimates: largest errors of fits, and ceilings and steps of confidence.
WEAK_FIT, PAIR_FIT, SINGLE_FIT = 2.0, 4.0, 1.0
SINGLE_MOST, SUSPECT_MOST, BLIND_MOST, EARLY_LOSS = 0.72, 0.35, 0.35, 0.08
VERTICAL_MOST = 45.0
# What trust is made of. A fit: base, share of strength (full at so much), of the error (none left at so much); a single frame: base, strength,
# residual; a frame alone: base, strength; several: strength, spread of angles (none left at so much), frames (full at so many).
FULL_SNR = 10.0
FIT_TRUST, SINGLE_TRUST, ALONE_TRUST, MANY_TRUST = (0.30, 0.40, 0.30, 6.0), (0.53, 0.16, 0.05), (0.40, 0.50), (0.5, 0.3, 15.0, 0.2, 3.0)


def _fits(c: Column) -> Column:
    """The rules but for time."""
    return F.coalesce(c["bin_error"] <= BIN_ERROR, F.lit(True)) & (~c["weak"] | (c["snr"] >= WEAK_SNR))


def is_primary(c: Column) -> Column:
    return F.coalesce(c["t"].between(FIRST_S, LAST_S), F.lit(False)) & _fits(c)


def is_early(c: Column) -> Column:
    return F.coalesce((c["t"] >= EARLY_S) & (c["t"] < FIRST_S), F.lit(False)) & _fits(c)


def _first_by(frames: Column, key: Column) -> Column:
    """The frame whose key is least; ``key`` maps a frame to a struct that ends with its number."""
    return F.array_min(F.transform(frames, lambda c: F.struct(key(c).alias("key"), c.alias("frame"))))["frame"]


def anchor(frames: Column) -> Column:
    """The strong primary frame nearest to the speed's bin, then the strongest, then the most coherent; null without one."""
    strong = F.filter(frames, lambda c: is_primary(c) & ~c["weak"])
    return _first_by(strong, lambda c: F.struct(F.coalesce(c["bin_error"], F.lit(99_999)), -c["snr"], F.coalesce(-c["coherence"], F.lit(-1.0)), c["frame"]))


def _partner_pair(pool: Column, chosen: Column) -> Column:
    """The anchor with its neighbour in the pool before, else behind, if that is loud enough and the angle rises; null otherwise."""
    before = F.try_element_at(F.filter(pool, lambda c: c["frame"] < chosen["frame"]), F.lit(-1))
    behind = F.get(F.filter(pool, lambda c: c["frame"] > chosen["frame"]), F.lit(0))
    loud = lambda c: c["snr"] >= F.when(c["weak"], WEAK_SNR).otherwise(F.greatest(F.lit(PARTNER_SNR), PARTNER_SHARE * chosen["snr"]))
    return F.when(loud(before) & (chosen["angle"] > before["angle"]), F.array(before, chosen)).when(
        loud(behind) & (behind["angle"] > chosen["angle"]), F.array(chosen, behind)
    )


def by_rules(frames: Column, chosen: Column) -> Column:
    """The frames that the rules select: the anchor with a partner in the primary window, else one in the early one, else alone."""
    primary = F.filter(frames, is_primary)
    both = F.filter(frames, lambda c: is_primary(c) | is_early(c))
    return F.coalesce(_partner_pair(primary, chosen), _partner_pair(both, chosen), F.array(chosen))


def median(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def without_worst(frames: Column) -> Column:
    """Of three frames and more, all but one: the weakest where one is ten times as strong as their median, else the one farthest from the median angle."""
    snrs, angles = F.transform(frames, lambda c: c["snr"]), F.transform(frames, lambda c: c["angle"])
    lopsided = F.array_max(snrs) > 10.0 * F.greatest(median(snrs), F.lit(1.0))
    off = median(angles)
    worst = _first_by(frames, lambda c: F.struct(F.when(lopsided, c["snr"]).otherwise(-F.abs(c["angle"] - off)), c["frame"]))["frame"]
    return F.when(F.size(frames) >= 3, F.filter(frames, lambda c: c["frame"] != worst)).otherwise(frames)


def weight(c: Column, tolerance: int, penalty: float) -> Column:
    """The square of a frame's strength, less where it lies far from the speed's bin."""
    return c["snr"] * c["snr"] / F.when(F.coalesce(c["bin_error"] > tolerance, F.lit(False)), max(penalty, 1.0)).otherwise(1.0)


def total(values: Column, of=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def single(frames: Column) -> Column:
    """The frame that sets an angle alone: strong, in flight, the earliest, then nearest to the speed's bin, then strongest."""
    return _first_by(F.filter(frames, in_flight), lambda c: F.struct(c["t"], F.coalesce(c["bin_error"], F.lit(1 << 30)), -c["snr"], c["frame"]))


def in_flight(c: Column) -> Column:
    return F.coalesce((c["t"] > 0) & (c["t"] <= FLIGHT_S), F.lit(False)) & ~c["weak"]


def estimator(frames: Column, rmse: Column, residual: Column) -> Column:
    """``geometry``, ``geometry_single_frame`` or ``naive``, from the error of the fit over all frames and that of the single frame's (null: none)."""
    weak = F.exists(frames, lambda c: c["weak"])
    bad = (weak & (rmse > WEAK_FIT)) | ((F.size(F.filter(frames, in_flight)) >= 2) & (rmse > PAIR_FIT))
    return F.when(rmse.isNotNull() & ~bad, "geometry").when(residual <= SINGLE_FIT, "geometry_single_frame").otherwise("naive")


def path(kind: Column, vertical: Column, ruled: Column, early: Column) -> Column:
    """How the frames were come by; ``early``: one of them is of the early window."""
    return (
        F.when(~vertical, kind)
        .when(kind == "geometry", F.when(early, "geometry_early_assisted").otherwise("geometry_primary"))
        .when(kind == "geometry_single_frame", kind)
        .when(ruled, "naive_rule_stack")
        .otherwise("legacy_naive_suspect")
    )


def base_trust(kind: Column, snr: Column, frames: Column, spread: Column, rmse: Column, residual: Column) -> Column:
    """Trust in an angle from mean strength, number of frames, spread of angles and error of the fit, before any ceiling. ``residual``: of the largest allowed."""
    loud = F.least(snr / FULL_SNR, F.lit(1.0))
    left = lambda x, most: F.greatest(F.lit(0.0), 1.0 - x / most)
    base, by_snr, by_error, worst = FIT_TRUST
    single, single_snr, single_error = SINGLE_TRUST
    many_snr, many_spread, widest, many_frames, full = MANY_TRUST
    return (
        F.when(kind == "geometry", base + loud * by_snr + left(rmse, worst) * by_error)
        .when(kind == "geometry_single_frame", F.least(F.lit(SINGLE_MOST), single + loud * single_snr + left(residual, 1.0) * single_error))
        .when(frames == 1, ALONE_TRUST[0] + loud * ALONE_TRUST[1])
        .otherwise(loud * many_snr + left(spread, widest) * many_spread + F.least(frames / full, F.lit(1.0)) * many_frames)
    )


def held(trust: Column, way: Column, blind: Column) -> Column:
    """Rounded trust under the ceilings and losses of its way and of the blind zone."""
    by_way = (
        F.when(way == "geometry_early_assisted", F.greatest(F.lit(0.0), trust - EARLY_LOSS)).when(way == "legacy_naive_suspect", F.least(trust, F.lit(SUSPECT_MOST))).otherwise(trust)
    )
    return F.when(blind, F.least(by_way, F.lit(BLIND_MOST))).otherwise(by_way)


def confidence(kind: Column, way: Column, snr: Column, frames: Column, spread: Column, rmse: Column, residual: Column, blind: Column) -> Column:
    """Trust in an angle; a residual of nothing counts as the largest."""
    share = F.coalesce(F.nullif(residual, F.lit(0.0)), F.lit(SINGLE_FIT)) / SINGLE_FIT
    return F.round(held(F.round(base_trust(kind, snr, frames, spread, rmse, share), 2), way, blind), 2)


def tier(kind: Column, way: Column, frames: Column) -> Column:
    """The rank of a way among a shot's results; the highest is taken."""
    return (
        F.when((kind == "geometry") & (frames >= 2), F.when(way == "geometry_primary", 50).otherwise(45))
        .when(kind == "geometry_single_frame", 40)
        .when(kind == "naive", F.when(way == "legacy_naive_suspect", 10).otherwise(20))
        .otherwise(0)
    )


# Fixed values of the broad choice: times, strengths, frames apart.
BROAD_LAST_S, BROAD_GAP, BROAD_LEAST, MIDDLE_S = 0.125, 2, 3.0, 0.060


def broad(frames: Column) -> Column:
    """The frames that strength alone selects: the strongest of the primary window, with the rising partner near by that is strongest; null without one.

    Equally strong anchors: the one nearest to the window's middle, then to the speed's bin. Equally strong pairs: the closer one, then the earlier.
    """
    heard = F.filter(frames, lambda c: F.coalesce(c["t"].between(0.0, BROAD_LAST_S), F.lit(False)) & (c["snr"] >= BROAD_LEAST))
    pool = F.filter(heard, lambda c: c["t"].between(FIRST_S, LAST_S) & (c["snr"] >= ALONE_SNR))
    lead = _first_by(pool, lambda c: F.struct(-c["snr"], F.abs(c["t"] - MIDDLE_S), F.coalesce(c["bin_error"], F.lit(99_999)), c["frame"]))

    def pair(a: Column) -> Column:
        near = F.filter(heard, lambda c: (c["frame"] != a["frame"]) & (F.abs(c["frame"] - a["frame"]) <= BROAD_GAP))
        two = F.transform(near, lambda c: F.when(c["t"] < a["t"], F.array(c, a)).otherwise(F.array(a, c)))
        rising = F.filter(two, lambda p: p[1]["angle"] >= p[0]["angle"])
        scored = F.transform(rising, lambda p: F.struct((-F.least(p[0]["snr"], p[1]["snr"])).alias("minus"), F.abs(p[0]["frame"] - p[1]["frame"]).alias("gap"), p[0]["frame"].alias("first"), p.alias("pair")))
        return F.array_min(scored)["pair"]

    return F.when(lead.isNotNull(), F.coalesce(pair(lead), F.array(lead)))


def unwrapped(frames: Column, period: float, tee: Column, back: float = 0.75, far_bins: int = 80, least: float = 3.0) -> Column:
    """Ranges of frames in order of time (t, range, bin_error, snr) with whole periods added, so that a ball is beyond its tee and never comes back.

    Both by more than ``back``. Only frames near the speed's bin and strong enough take part; others keep their range.
    """

    def step(s: Column, c: Column) -> Column:
        takes = F.coalesce(c["range"].isNotNull() & (c["bin_error"] <= far_bins) & (c["snr"] >= least), F.lit(False))
        low = F.greatest(F.when(c["t"] >= FIRST_S, tee - back), s["last"] - back)
        turns = F.greatest(F.coalesce(F.ceil((low - c["range"]) / period), F.lit(0)), F.lit(0))
        value = F.when(takes, c["range"] + turns * period).otherwise(c["range"])
        return F.struct(F.when(takes, value).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(value)).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(frames, start, step)["out"]
