"""Shot physics as column expressions: carry, spin, launch, corrections."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ball speed (mph) and the low and high carry (yd) seen at it.
CARRY = [(100, 130, 142), (110, 157, 170), (120, 183, 197), (130, 207, 223), (140, 231, 249), (150, 254, 275), (160, 276, 301), (167, 275, 285), (170, 298, 325), (180, 320, 349), (190, 342, 372), (200, 360, 389), (210, 383, 408)]
YARDS_PER_MPH_ABOVE = 1.8
# From this speed on (mph), rpm at the upper speed, rpm per mph below it, upper speed.
SPIN_BANDS = [(180, 2050.0, 0.0, 999.0), (170, 2050.0, 25.0, 180.0), (160, 2300.0, 25.0, 170.0), (140, 2550.0, 7.5, 160.0), (120, 2700.0, 10.0, 140.0), (100, 2900.0, 10.0, 120.0)]
SPIN_BELOW = 3200.0
MPH_TO_KMH = 1.609
MPH_TO_MPS = 0.44704
MPH_TO_FTS = 1.4666667


def carry_knots() -> list[tuple[float, float]]:
    """Speed and carry, the carry never falling."""
    return [(float(s), c) for (s, _, _), c in zip(CARRY, accumulate(((a + b) / 2 for _, a, b in CARRY), max), strict=True)]


def table_carry(speed: Column) -> Column:
    """Carry by ball speed: linear between knots, in proportion below the first, at a fixed slope above the last."""
    knots = carry_knots()
    out = F.lit(knots[-1][1]) + (speed - knots[-1][0]) * YARDS_PER_MPH_ABOVE
    for (a, ca), (b, cb) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(speed < b, F.lit(ca) + (speed - a) / (b - a) * (cb - ca)).otherwise(out)
    return F.when(speed <= knots[0][0], speed / knots[0][0] * knots[0][1]).otherwise(out)


def launch_penalised_carry(carry: Column, launch: Column, optimal: Column, confidence: Column) -> Column:
    off = launch - optimal
    raw = F.when(off < 0, F.abs(off) * 2.0).otherwise(off * 1.5)
    return F.when(launch.isNotNull(), carry - F.least(raw * confidence, carry * 0.10))


def optimal_spin(speed: Column, factor: Column) -> Column:
    out = F.lit(SPIN_BELOW)
    for least, rpm, slope, upper in reversed(SPIN_BANDS):
        out = F.when(speed >= least, F.lit(rpm) + (F.lit(upper) - speed) * slope).otherwise(out)
    return out * factor


def smash(ball: Column, club: Column) -> Column:
    """Null where the club speed is missing or not above zero."""
    return F.when(club > 0, ball / club)


def spin_carry(carry: Column, speed: Column, spin: Column, best: Column, club_speed: Column, target: Column) -> Column:
    """Carry adjusted for spin off its best value and for contact quality."""
    off = spin - best
    loss = F.abs(off) / 100
    by_spin = F.when(off < 0, F.greatest(F.lit(0.82), 1.0 - loss * 0.012)).otherwise(F.greatest(F.lit(0.88), 1.0 - loss * 0.008))
    by_spin = F.when(F.abs(off) < 200, F.least(F.lit(1.02), by_spin + 0.01)).otherwise(by_spin)
    short = target - smash(speed, club_speed)
    contact = F.when(short > 0, F.greatest(F.lit(0.94), 1.0 - short / 0.05 * 0.03)).when(short < -0.05, 0.98).otherwise(1.0)
    return F.when(spin.isNotNull(), carry * by_spin * contact)


def launch_estimate(speed: Column, club_speed: Column, spin: Column, best_spin: Column) -> tuple[Column, Column]:
    """Launch angle (degrees, to a tenth) and its confidence, with the club's columns at hand."""
    off = smash(speed, club_speed) - F.col("launch_smash")
    by_smash = F.when(off < 0, F.greatest(F.lit(-3.0), off * 100 * 0.4)).when(off >= 0, F.least(F.lit(2.0), off * 100 * 0.2)).otherwise(0.0)
    has_spin = F.coalesce(spin > 0, F.lit(False))
    by_spin = F.when(has_spin, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (spin - best_spin) / 500.0 * 0.3))).otherwise(0.0)
    angle = F.col("optimal_launch") - (speed - F.col("launch_mph")) * F.col("launch_deg_per_mph") + by_smash + by_spin
    known = F.coalesce(club_speed > 0, F.lit(False)).cast("int") + has_spin.cast("int")
    confidence = F.when(known == 2, 0.5).when(known == 1, 0.35).otherwise(0.2)
    return F.greatest(F.lit(5.0), F.floor(angle * 10 + 0.5) / 10), confidence


def kinematic_spin(speed: Column, launch: Column) -> Column:
    """Null outside launch angles of 2 to 60 degrees and for speeds not above zero."""
    spin = F.least(170.0 * speed * F.pow(F.sin(F.radians(launch)), F.lit(1.2)), F.lit(13000.0))
    return F.when((speed > 0) & launch.between(2.0, 60.0), spin)


def radial_factor(launch: Column, speed: Column, distance_ft: Column, above_ft: Column, window_ms: int = 70) -> Column:
    """The largest share of the ball's speed that a radar sees along its line of sight in the window, within 0.5 and 1."""

    def at(step: Column) -> Column:
        ms = step.cast("double") * 2.0
        t = ms / 1000.0
        kept = F.greatest(1.0 - 0.027 * ms / speed, F.lit(0.0))
        angle = F.radians(launch)
        x = distance_ft + speed * MPH_TO_FTS * F.cos(angle) * t
        y = above_ft + speed * MPH_TO_FTS * F.sin(angle) * t
        return kept * F.cos(angle - F.atan2(y, x))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(window_ms // 2)), at))
    return F.when(speed > 0, F.least(F.greatest(best, F.lit(0.5)), F.lit(1.0))).otherwise(1.0)


def bearing(alpha: Column, t: Column, speed: Column, distance_ft: Column, above_ft: float, mount_deg: float) -> Column:
    """Where the radar should see a ball that started at ``alpha`` degrees, ``t`` seconds before."""
    x = distance_ft + speed * MPH_TO_FTS * F.cos(F.radians(alpha)) * t
    y = F.lit(above_ft) + speed * MPH_TO_FTS * F.sin(F.radians(alpha)) * t
    return F.degrees(F.atan2(y, x)) - mount_deg


# Doppler aliasing of the angle radar.
FFT, TOP_KMH, BLIND_KMH = 2048, 100.0, 11.0


def alias_kmh(mph: Column) -> Column:
    v = F.pmod(mph * MPH_TO_KMH, F.lit(2 * TOP_KMH))
    return F.when(v > TOP_KMH, v - 2 * TOP_KMH).otherwise(v)


def velocity_bin(kmh: Column) -> Column:
    """Truncated as positive numbers are."""
    at = kmh * (FFT // 2) / TOP_KMH
    return F.floor(F.when(kmh >= 0, at).otherwise(FFT + at)).cast("int")


def bin_ranges(mph: Column, tolerance_mph: float) -> Column:
    """array<struct<lo, hi>>: the half-open bins of a speed band; two where the band crosses zero."""
    v, tol = alias_kmh(mph), tolerance_mph * MPH_TO_KMH
    lo, hi = velocity_bin(v - tol), velocity_bin(v + tol)
    crosses = (v - tol < 0) & (v + tol > 0)
    of = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    wrapped = F.filter(F.array(of(lo, F.lit(FFT)), of(F.lit(0), hi)), lambda r: r["lo"] < r["hi"])
    return F.when(crosses, wrapped).otherwise(F.array(of(F.least(lo, hi), F.greatest(lo, hi))))


