"""Enrichment of shots: carry, spin, launch, corrections, acceptance of radar angles, and what goes to a simulator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.functions import clubs, flight
from swinglake.functions.lens import lens, with_lenses
from swinglake.operators.sessions import CARRY_SQL

#: Shots with the constants of their club, in DuckDB.
CLUBBED = with_lenses("shots") + f""", dim AS ({clubs.values_sql()}),
s AS (SELECT *, {CARRY_SQL.format(b="ball_speed")} AS carry,
  CASE WHEN ball_speed >= 180 THEN 2050.0 WHEN ball_speed >= 170 THEN 2050 + (180 - ball_speed) * 25 WHEN ball_speed >= 160 THEN 2300 + (170 - ball_speed) * 25
       WHEN ball_speed >= 140 THEN 2550 + (160 - ball_speed) * 7.5 WHEN ball_speed >= 120 THEN 2700 + (140 - ball_speed) * 10
       WHEN ball_speed >= 100 THEN 2900 + (120 - ball_speed) * 10 ELSE 3200 END * spin_factor AS best_spin,
  CASE WHEN club_speed > 0 THEN ball_speed / club_speed END AS smash
  FROM shots LEFT JOIN dim ON dim.club = CASE WHEN shots.club IN (SELECT club FROM dim) THEN shots.club ELSE 'unknown' END)
"""


def clubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clubs.with_club(lens(spark, sf_dir, "shots"))
    return (
        s.withColumn("carry", flight.table_carry(F.col("ball_speed")))
        .withColumn("best_spin", flight.optimal_spin(F.col("ball_speed"), F.col("spin_factor")))
        .withColumn("smash", flight.smash(F.col("ball_speed"), F.col("club_speed")))
    )


def dim_club_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clubbed(spark, sf_dir).select("shot_number", "club", "optimal_launch", "typical_spin", "simulator_spin", F.col("club_order").cast("int").alias("club_order"))


DIM_SQL = CLUBBED + "SELECT shot_number, club, optimal_launch, typical_spin, simulator_spin, club_order FROM s"


def carry_table_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clubbed(spark, sf_dir)
    penalised = flight.launch_penalised_carry(F.col("carry"), F.col("launch_v"), F.col("optimal_launch"), F.coalesce(F.nullif("launch_confidence", F.lit(0.0)), F.lit(0.2)))
    return c.select("shot_number", F.round("carry", 4).alias("carry"), F.round(penalised, 6).alias("penalised"))


CARRY_INTERP_SQL = CLUBBED + """SELECT shot_number, round(carry, 4)::DOUBLE AS carry,
round(carry - least(CASE WHEN launch_v < optimal_launch THEN (optimal_launch - launch_v) * 2.0 WHEN launch_v >= optimal_launch THEN (launch_v - optimal_launch) * 1.5 END * coalesce(nullif(launch_confidence, 0), 0.2),
  CASE WHEN launch_v IS NOT NULL THEN carry * 0.1 END), 6) AS penalised FROM s"""


def carry_spin_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clubbed(spark, sf_dir)
    adjusted = flight.spin_carry(F.col("carry"), F.col("ball_speed"), F.col("spin_rpm"), F.col("best_spin"), F.col("club_speed"), F.col("carry_smash"))
    return c.select("shot_number", F.round("best_spin", 4).alias("best_spin"), F.round(adjusted, 9).alias("carry"))


CARRY_SPIN_SQL = CLUBBED + """, f AS (SELECT *, abs(spin_rpm - best_spin) / 100 AS loss, carry_smash - smash AS short FROM s),
g AS (SELECT *, CASE WHEN spin_rpm < best_spin THEN greatest(0.82, 1 - loss * 0.012) WHEN spin_rpm >= best_spin THEN greatest(0.88, 1 - loss * 0.008) END AS f0,
CASE WHEN short > 0 THEN greatest(0.94, 1 - short / 0.05 * 0.03) WHEN short < -0.05 THEN 0.98 ELSE 1.0 END AS contact FROM f)
SELECT shot_number, round(best_spin, 4) AS best_spin, round(carry * CASE WHEN loss < 2 THEN least(1.02, f0 + 0.01) ELSE f0 END * contact, 9) AS carry FROM g"""


def launch_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clubbed(spark, sf_dir)
    angle, confidence = flight.launch_estimate(F.col("ball_speed"), F.col("club_speed"), F.col("spin_rpm"), F.col("best_spin"))
    return c.select("shot_number", angle.alias("launch"), confidence.alias("confidence"))


ESTIMATE_SQL = CLUBBED + """, e AS (SELECT *, greatest(5.0, floor((optimal_launch - (ball_speed - launch_mph) * launch_deg_per_mph
+ CASE WHEN smash < launch_smash THEN greatest(-3.0, (smash - launch_smash) * 100 * 0.4) WHEN smash >= launch_smash THEN least(2.0, (smash - launch_smash) * 100 * 0.2) ELSE 0 END
+ CASE WHEN spin_rpm > 0 THEN greatest(-2.0, least(2.0, (spin_rpm - best_spin) / 500.0 * 0.3)) ELSE 0 END) * 10 + 0.5) / 10) AS est,
CASE coalesce((club_speed > 0)::INT, 0) + coalesce((spin_rpm > 0)::INT, 0) WHEN 2 THEN 0.5 WHEN 1 THEN 0.35 ELSE 0.2 END::DOUBLE AS est_conf FROM s) """
LAUNCH_SQL = ESTIMATE_SQL + "SELECT shot_number, est AS launch, est_conf AS confidence FROM e"


def kinematic_spin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots")
    return s.select("shot_number", F.round(flight.kinematic_spin(F.col("ball_speed"), F.col("launch_v")), 3).alias("spin"))


KINEMATIC_SQL = with_lenses("shots") + """SELECT shot_number, CASE WHEN ball_speed > 0 AND launch_v BETWEEN 2 AND 60 THEN round(least(170 * ball_speed * pow(sin(radians(launch_v)), 1.2), 13000), 3) END AS spin FROM shots"""


def radial_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots").where("launch_v IS NOT NULL")
    f = flight.radial_factor(F.col("launch_v"), F.col("ball_speed"), F.col("distance_ft"), F.col("above_ft"))
    return s.withColumn("f", f).select("shot_number", F.round("f", 6).alias("factor"), F.round(F.col("ball_speed") / F.col("f"), 3).alias("corrected"))


RADIAL_SQL = with_lenses("shots") + """, f AS (SELECT shot_number, ball_speed, least(greatest(list_max(list_transform(range(0, 36), lambda k:
greatest(1 - 0.027 * (k * 2.0::DOUBLE) / ball_speed, 0) * cos(radians(launch_v) - atan2(above_ft + ball_speed * 1.4666667::DOUBLE * sin(radians(launch_v)) * (k * 2.0::DOUBLE / 1000),
  distance_ft + ball_speed * 1.4666667::DOUBLE * cos(radians(launch_v)) * (k * 2.0::DOUBLE / 1000))))), 0.5), 1.0) AS f FROM shots WHERE launch_v IS NOT NULL)
SELECT shot_number, round(f, 6) AS factor, round(ball_speed / f, 3) AS corrected FROM f"""


def launch_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The launch angle, of a grid of 0.1 degrees up to 45, whose bearing is nearest to a measured one; null beyond 1 degree.

    A ball that starts higher is always seen higher from a radar behind it, so the grid is halved nine times: the last angle seen
    at or below the measured bearing and its neighbour are the nearest. Of angles equally near to nine decimals the smaller is taken.
    """
    s = lens(spark, sf_dir, "shots").where("launch_v IS NOT NULL")
    t = F.lit(0.02) + F.col("num_frames") / 1000.0
    seen = lambda i: flight.bearing(i.cast("double") / 10.0, t, F.col("ball_speed"), F.col("distance_ft"), 0.5, 0.0)
    measured = F.col("launch_v") * 0.7 + 2.0
    s = s.withColumn("__i", F.lit(0))
    for step in (256, 128, 64, 32, 16, 8, 4, 2, 1):
        next_one = F.col("__i") + step
        s = s.withColumn("__i", F.when((next_one <= 450) & (seen(F.least(next_one, F.lit(450))) <= measured), next_one).otherwise(F.col("__i")))
    two = [F.struct(F.round(F.abs(measured - seen(i)), 9).alias("off"), (i.cast("double") / 10.0).alias("alpha")) for i in (F.col("__i"), F.least(F.col("__i") + 1, F.lit(450)))]
    return s.withColumn("b", F.least(*two)).select("shot_number", F.when(F.col("b.off") <= 1.0, F.col("b.alpha")).alias("alpha"), F.round("b.off", 5).alias("residual"))


GRID_SQL = with_lenses("shots") + """, g AS (SELECT shot_number, list_min(list_transform(range(0, 451), lambda i: {'off': round(abs(launch_v * 0.7 + 2.0 - degrees(atan2(
0.5 + ball_speed * 1.4666667::DOUBLE * sin(radians(i / 10.0::DOUBLE)) * (0.02 + num_frames / 1000.0::DOUBLE), distance_ft + ball_speed * 1.4666667::DOUBLE * cos(radians(i / 10.0::DOUBLE)) * (0.02 + num_frames / 1000.0::DOUBLE)))), 9), 'alpha': i / 10.0::DOUBLE})) AS b
FROM shots WHERE launch_v IS NOT NULL)
SELECT shot_number, CASE WHEN b.off <= 1 THEN b.alpha END AS alpha, round(b.off, 5) AS residual FROM g"""


def alias_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots")
    v = flight.alias_kmh(F.col("ball_speed"))
    r = flight.bin_ranges(F.col("ball_speed"), 10.0)
    return s.select(
        "shot_number",
        F.round(v, 4).alias("alias_kmh"),
        flight.velocity_bin(v).alias("bin"),
        (F.abs(v) <= flight.BLIND_KMH).alias("blind"),
        F.size(r).alias("ranges"),
        r[0]["lo"].alias("lo"),
        F.element_at(r, -1)["hi"].alias("hi"),
    )


ALIAS_SQL = with_lenses("shots") + """, v AS (SELECT shot_number, CASE WHEN (ball_speed * 1.609::DOUBLE) % 200 > 100 THEN (ball_speed * 1.609::DOUBLE) % 200 - 200 ELSE (ball_speed * 1.609::DOUBLE) % 200 END AS v FROM shots),
b AS (SELECT *, floor(CASE WHEN v >= 0 THEN v * 1024 / 100 ELSE 2048 + v * 1024 / 100 END)::INT AS bin,
floor(CASE WHEN v - 16.09::DOUBLE >= 0 THEN (v - 16.09::DOUBLE) * 1024 / 100 ELSE 2048 + (v - 16.09::DOUBLE) * 1024 / 100 END)::INT AS a,
floor(CASE WHEN v + 16.09::DOUBLE >= 0 THEN (v + 16.09::DOUBLE) * 1024 / 100 ELSE 2048 + (v + 16.09::DOUBLE) * 1024 / 100 END)::INT AS c, v - 16.09::DOUBLE < 0 AND v + 16.09::DOUBLE > 0 AS x FROM v)
SELECT shot_number, round(v, 4) AS alias_kmh, bin, abs(v) <= 11 AS blind, CASE WHEN x THEN (a < 2048)::INT + (c > 0)::INT ELSE 1 END AS ranges,
CASE WHEN x THEN CASE WHEN a < 2048 THEN a ELSE 0 END ELSE least(a, c) END AS lo, CASE WHEN x THEN CASE WHEN c > 0 THEN c ELSE 2048 END ELSE greatest(a, c) END AS hi FROM b"""


def ladder_vertical(angle: Column, confidence: Column, frames: Column, expected: Column, expected_conf: Column, club: Column, speed: Column) -> Column:
    """Why a vertical radar angle is taken or not; the first rule that applies decides."""
    skipped = (club == "unknown") | (speed <= 0)
    delta = F.abs(angle - expected)
    allowed = clubs.base_delta(club) + (1.0 - expected_conf) * 5.0
    plausible = skipped | F.when(angle <= expected, angle.between(0.0, 45.0)).otherwise(delta <= allowed)
    low, high = clubs.soft_lane(club)
    close = F.round(delta, 1)
    return (
        F.when(angle.isNull(), "no_candidate")
        .when(~plausible, "implausible_launch")
        .when(confidence >= 0.80, "strict_accept")
        .when(confidence < 0.65, "low_confidence")
        .when(skipped, "soft_guard_unavailable")
        .when((angle < low) | (angle > high), "outside_soft_lane")
        .when(close > 4.5, "estimator_delta_too_large")
        .when(frames <= 0, "no_candidate_frames")
        .when((frames > 40) & (close > 2.0), "suspicious_frame_span")
        .when(confidence >= 0.68, "soft_accept")
        .otherwise("low_confidence_accept")
    )


def acceptance_ladder_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clubbed(spark, sf_dir)
    expected, conf = flight.launch_estimate(F.col("ball_speed"), F.col("club_speed"), F.col("spin_rpm"), F.col("best_spin"))
    known = F.when(F.col("club").isin(clubs.NAMES), F.col("club")).otherwise("unknown")
    c = c.withColumn("known", known).withColumn("expected", expected).withColumn("conf", conf)
    reason = ladder_vertical(*(F.col(x) for x in ("launch_v", "launch_confidence", "num_frames", "expected", "conf", "known", "ball_speed")))
    return c.select("shot_number", reason.alias("reason")).withColumn("accepted", F.col("reason").endswith("accept"))


LADDER_V_SQL = ESTIMATE_SQL + """, k AS (SELECT *, CASE WHEN club IN ('pw', 'gw', 'sw', 'lw') THEN 22.0 WHEN club IN ('6-iron', '7-iron', '8-iron', '9-iron') THEN 20.0 ELSE 18.0 END + (1 - est_conf) * 5 AS allowed,
club = 'unknown' OR club = 'putter' AS skipped, round(abs(launch_v - est), 1) AS close,
CASE WHEN club = 'driver' THEN 4 WHEN club LIKE '%wood' THEN 5 WHEN club LIKE '%hybrid' THEN 6 WHEN club IN ('2-iron', '3-iron', '4-iron', '5-iron') THEN 5 WHEN club LIKE '%iron' THEN 7 WHEN club IN ('pw', 'gw', 'sw', 'lw') THEN 10 ELSE 5 END AS lane0,
CASE WHEN club = 'driver' THEN 22 WHEN club LIKE '%wood' THEN 24 WHEN club LIKE '%hybrid' THEN 26 WHEN club IN ('2-iron', '3-iron', '4-iron', '5-iron') THEN 25 WHEN club LIKE '%iron' THEN 28 WHEN club IN ('pw', 'gw', 'sw', 'lw') THEN 45 ELSE 35 END AS lane1 FROM e),
r AS (SELECT shot_number, CASE WHEN launch_v IS NULL THEN 'no_candidate'
WHEN NOT (skipped OR CASE WHEN launch_v <= est THEN launch_v BETWEEN 0 AND 45 ELSE abs(launch_v - est) <= allowed END) THEN 'implausible_launch'
WHEN launch_confidence >= 0.80 THEN 'strict_accept' WHEN launch_confidence < 0.65 THEN 'low_confidence' WHEN skipped THEN 'soft_guard_unavailable'
WHEN launch_v < lane0 OR launch_v > lane1 THEN 'outside_soft_lane' WHEN close > 4.5 THEN 'estimator_delta_too_large' WHEN num_frames <= 0 THEN 'no_candidate_frames'
WHEN num_frames > 40 AND close > 2 THEN 'suspicious_frame_span' WHEN launch_confidence >= 0.68 THEN 'soft_accept' ELSE 'low_confidence_accept' END AS reason FROM k)
SELECT shot_number, reason, reason LIKE '%accept' AS accepted FROM r"""


def ladder_horizontal(angle: Column, confidence: Column, frames: Column, limit: float = 15.0) -> Column:
    size = F.abs(angle)
    return (
        F.when(angle.isNull(), "no_candidate")
        .when(size > limit, "outside_horizontal_limit")
        .when((size >= limit * 0.80) & (frames <= 2) & (confidence < 0.80), "weak_near_limit")
        .when(confidence >= 0.40, "strict_accept")
        .when(confidence < 0.30, "low_confidence")
        .when(size > min(5.0, max(limit, 0.0)), "outside_soft_lane")
        .when(frames <= 0, "no_candidate_frames")
        .when(frames > 40, "suspicious_frame_span")
        .otherwise("soft_accept")
    )


def acceptance_ladder_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots")
    return s.select("shot_number", ladder_horizontal(F.col("launch_h"), F.col("launch_confidence"), F.col("num_frames")).alias("reason"))


LADDER_H_SQL = with_lenses("shots") + """SELECT shot_number, CASE WHEN launch_h IS NULL THEN 'no_candidate' WHEN abs(launch_h) > 15 THEN 'outside_horizontal_limit'
WHEN abs(launch_h) >= 12 AND num_frames <= 2 AND launch_confidence < 0.8 THEN 'weak_near_limit' WHEN launch_confidence >= 0.4 THEN 'strict_accept' WHEN launch_confidence < 0.3 THEN 'low_confidence'
WHEN abs(launch_h) > 5 THEN 'outside_soft_lane' WHEN num_frames <= 0 THEN 'no_candidate_frames' WHEN num_frames > 40 THEN 'suspicious_frame_span' ELSE 'soft_accept' END AS reason FROM shots"""


def simulator_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a simulator gets, with where each value comes from."""
    c = clubbed(spark, sf_dir)
    measured = F.coalesce((F.col("spin_rpm") > 0) & (F.col("spin_confidence") >= 0.6), F.lit(False))
    axis_known = F.col("face_deg").isNotNull() & F.col("path_deg").isNotNull()
    axis = F.when(axis_known, F.round(F.col("face_deg") - F.col("path_deg"), 1)).otherwise(0.0)
    c = c.withColumn("spin", F.when(measured, F.col("spin_rpm")).otherwise(F.col("simulator_spin"))).withColumn("axis", axis)
    of = lambda known: F.when(known, "measured").otherwise("estimated")
    provenance = F.create_map(
        F.lit("vla"), of(F.col("launch_v").isNotNull()), F.lit("hla"), of(F.col("launch_h").isNotNull()), F.lit("total_spin"), of(measured),
        F.lit("spin_axis"), of(axis_known), F.lit("back_spin"), of(measured & axis_known), F.lit("club_speed"), of(F.coalesce(F.col("club_speed") > 0, F.lit(False))),
    )
    estimated = F.map_filter(provenance, lambda _, v: v == "estimated")
    return c.select(
        "shot_number",
        F.coalesce("launch_v", "optimal_launch").alias("vla"),
        F.coalesce("launch_h", F.lit(0.0)).alias("hla"),
        "spin",
        "axis",
        F.round(F.col("spin") * F.cos(F.radians("axis")), 3).alias("back_spin"),
        F.round(F.col("spin") * F.sin(F.radians("axis")), 3).alias("side_spin"),
        F.nullif(F.col("club_speed"), F.lit(0.0)).alias("club_speed"),
        F.array_join(F.array_sort(F.map_keys(estimated)), ",").alias("estimated"),
    )


SIMULATOR_SQL = CLUBBED + """, m AS (SELECT *, coalesce(spin_rpm > 0 AND spin_confidence >= 0.6, false) AS measured, face_deg IS NOT NULL AND path_deg IS NOT NULL AS axis_known FROM s),
a AS (SELECT *, CASE WHEN measured THEN spin_rpm ELSE simulator_spin END AS spin, CASE WHEN axis_known THEN round(face_deg - path_deg, 1) ELSE 0.0 END AS axis FROM m)
SELECT shot_number, coalesce(launch_v, optimal_launch) AS vla, coalesce(launch_h, 0.0) AS hla, spin, axis, round(spin * cos(radians(axis)), 3) AS back_spin, round(spin * sin(radians(axis)), 3) AS side_spin,
nullif(club_speed, 0) AS club_speed, array_to_string(list_filter([CASE WHEN NOT (measured AND axis_known) THEN 'back_spin' END, CASE WHEN NOT coalesce(club_speed > 0, false) THEN 'club_speed' END,
CASE WHEN launch_h IS NULL THEN 'hla' END, CASE WHEN NOT axis_known THEN 'spin_axis' END, CASE WHEN NOT measured THEN 'total_spin' END, CASE WHEN launch_v IS NULL THEN 'vla' END], lambda x: x IS NOT NULL), ',') AS estimated FROM a"""


#: A spin's rails and quality in the lens of shots.
_LOWER, _UPPER = "shot_number % 6 = 0", "shot_number % 17 = 0"
_QUALITY = "CASE CAST(shot_number % 4 AS INT) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END"


def spin_verdict(rpm: Column, lower: Column, upper: Column, confidence: Column, quality: Column, club: Column, best: Column) -> Column:
    """What becomes of a measured spin: a line on the lower rail below 0.6 of a lofted club's best can't be one; other lines on a rail
    are kept for diagnosis only; the rest is reliable with a confidence of 0.6 and a quality above low, else only reported."""
    lofted = club.isin(*clubs.WEDGES, *clubs.SHORT_IRONS)
    return (
        F.when(~F.coalesce(rpm > 0, F.lit(False)), "none")
        .when(lower & lofted & (rpm < best * 0.60), "implausible_for_club")
        .when(lower, "lower_rail")
        .when(upper, "upper_rail")
        .when((confidence >= 0.6) & quality.isin("high", "medium"), "reliable")
        .otherwise("reportable")
    )


def spin_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each shot's spin, and the carry that follows: adjusted for spin where that is reliable."""
    c = clubbed(spark, sf_dir).withColumns({"lower": F.expr(_LOWER), "upper": F.expr(_UPPER), "quality": F.expr(_QUALITY)})
    verdict = spin_verdict(*[F.col(n) for n in ("spin_rpm", "lower", "upper", "spin_confidence", "quality", "club", "best_spin")])
    adjusted = flight.spin_carry(F.col("carry"), F.col("ball_speed"), F.col("spin_rpm"), F.col("best_spin"), F.col("club_speed"), F.col("carry_smash"))
    return c.withColumn("verdict", verdict).select("shot_number", "verdict", F.round(F.when(F.col("verdict") == "reliable", adjusted).otherwise(F.col("carry")), 6).alias("carry"))


REJECTION_SQL = CARRY_SPIN_SQL.split("SELECT shot_number, round(best_spin")[0] + f""", v AS (SELECT *, CASE WHEN NOT coalesce(spin_rpm > 0, false) THEN 'none'
WHEN {_LOWER} AND club IN ('pw', 'gw', 'sw', 'lw', '6-iron', '7-iron', '8-iron', '9-iron') AND spin_rpm < best_spin * 0.60::DOUBLE THEN 'implausible_for_club' WHEN {_LOWER} THEN 'lower_rail' WHEN {_UPPER} THEN 'upper_rail'
WHEN spin_confidence >= 0.6::DOUBLE AND {_QUALITY} IN ('high', 'medium') THEN 'reliable' ELSE 'reportable' END AS verdict FROM g)
SELECT shot_number, verdict, round(CASE WHEN verdict = 'reliable' THEN carry * CASE WHEN loss < 2 THEN least(1.02::DOUBLE, f0 + 0.01::DOUBLE) ELSE f0 END * contact ELSE carry END, 6) AS carry FROM v"""


def launch_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ball's flight starts from: shots without a vertical angle have none; spin is measured where its confidence is 0.7, else the club's typical one; what is missing is straight."""
    c = clubbed(spark, sf_dir).where("launch_v IS NOT NULL")
    measured = F.coalesce(F.col("spin_rpm").isNotNull() & (F.col("spin_confidence") >= 0.7), F.lit(False))
    axis = F.when(F.col("face_deg").isNotNull() & F.col("path_deg").isNotNull(), F.col("face_deg") - F.col("path_deg"))
    return c.select(
        "shot_number",
        "ball_speed",
        "launch_v",
        F.coalesce("launch_h", F.lit(0.0)).alias("launch_h"),
        F.when(measured, F.col("spin_rpm")).otherwise(F.col("typical_spin")).alias("spin_rpm"),
        F.round(F.coalesce(axis, F.lit(0.0)), 4).alias("spin_axis"),
        F.when(measured, "measured").otherwise("club_typical").alias("spin_source"),
    )


CONDITIONS_SQL = CLUBBED + """SELECT shot_number, ball_speed, launch_v, coalesce(launch_h, 0.0) AS launch_h, CASE WHEN spin_rpm IS NOT NULL AND spin_confidence >= 0.7::DOUBLE THEN spin_rpm ELSE typical_spin END AS spin_rpm,
round(coalesce(face_deg - path_deg, 0.0), 4) AS spin_axis, CASE WHEN spin_rpm IS NOT NULL AND spin_confidence >= 0.7::DOUBLE THEN 'measured' ELSE 'club_typical' END AS spin_source FROM s WHERE launch_v IS NOT NULL"""


def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots that have each metric; the spin axis can come from face and path."""
    s = lens(spark, sf_dir, "shots")
    metrics = {
        "ball_speed": F.col("ball_speed").isNotNull(),
        "club_speed": F.col("club_speed").isNotNull(),
        "spin": F.col("spin_rpm").isNotNull(),
        "launch_v": F.col("launch_v").isNotNull(),
        "launch_h": F.col("launch_h").isNotNull(),
        "spin_axis": F.col("face_deg").isNotNull() & F.col("path_deg").isNotNull(),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("int").alias("has")) for k, v in metrics.items()]))
    return s.select("club", cells.alias("m")).groupBy("club", "m.metric").agg(F.sum("m.has").alias("n_have"), F.count(F.lit(1)).alias("n"))


COMPLETENESS_SQL = with_lenses("shots") + """, m AS (SELECT club, unnest(['ball_speed', 'club_speed', 'spin', 'launch_v', 'launch_h', 'spin_axis']) AS metric,
unnest([ball_speed IS NOT NULL, club_speed IS NOT NULL, spin_rpm IS NOT NULL, launch_v IS NOT NULL, launch_h IS NOT NULL, face_deg IS NOT NULL AND path_deg IS NOT NULL]) AS has FROM shots)
SELECT club, metric, sum(has::INT)::BIGINT AS n_have, count(*) AS n FROM m GROUP BY 1, 2"""


def rule_reasons(t: Column, bin_error: Column, weak: Column, snr: Column) -> Column:
    """All rules that a vertical frame breaks: a time after impact of 20 to 100 ms, at most 50 bins off, and a strength of 3 where the speed anchor is weak."""
    rules = {
        "missing_t_after": t.isNull(),
        "time_too_early": t < 0.020,
        "time_too_late": t > 0.100,
        "bin_error_gt_50": bin_error > 50,
        "weak_adjacent_snr_too_low": weak & (snr < 3.0),
    }
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))


def rule_reasons_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each frame breaks, and whether it may be used."""
    n = F.col("shot_number")
    s = lens(spark, sf_dir, "shots").select("shot_number", F.when(n % 11 != 0, n * 7 % 130 / 1000).alias("t"), F.when(n % 5 != 0, n * 13 % 80).alias("bin_error"), (n % 3 == 0).alias("weak"), (F.col("num_frames") / 8).alias("snr"))
    reasons = rule_reasons(F.col("t"), F.col("bin_error"), F.col("weak"), F.col("snr"))
    return s.select("shot_number", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("usable"))


REASONS_SQL = with_lenses("shots") + """, f AS (SELECT shot_number, CASE WHEN shot_number % 11 <> 0 THEN shot_number * 7 % 130 / 1000 END AS t, CASE WHEN shot_number % 5 <> 0 THEN shot_number * 13 % 80 END AS b, shot_number % 3 = 0 AND num_frames / 8 < 3 AS w FROM shots)
SELECT shot_number, concat_ws(',', CASE WHEN t IS NULL THEN 'missing_t_after' WHEN t < 0.02::DOUBLE THEN 'time_too_early' WHEN t > 0.1::DOUBLE THEN 'time_too_late' END, CASE WHEN b > 50 THEN 'bin_error_gt_50' END, CASE WHEN w THEN 'weak_adjacent_snr_too_low' END) AS reasons,
t BETWEEN 0.02::DOUBLE AND 0.1::DOUBLE AND coalesce(b <= 50, true) AND NOT w AS usable FROM f WHERE t IS NOT NULL
UNION ALL SELECT shot_number, concat_ws(',', 'missing_t_after', CASE WHEN b > 50 THEN 'bin_error_gt_50' END, CASE WHEN w THEN 'weak_adjacent_snr_too_low' END), false FROM f WHERE t IS NULL"""

def ensured_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shot with both angles: the vertical one measured or else estimated, the horizontal one measured or else 0, each with its source and confidence.

    An estimate's confidence stands in wherever none was measured.
    """
    c = clubbed(spark, sf_dir)
    angle, confidence = flight.launch_estimate(F.col("ball_speed"), F.col("club_speed"), F.col("spin_rpm"), F.col("best_spin"))
    has_v, has_h = F.col("launch_v").isNotNull(), F.col("launch_h").isNotNull()
    source = lambda has: F.when(has, "radar").otherwise("estimated")
    return c.select(
        "shot_number",
        F.coalesce("launch_v", angle).alias("vertical"),
        source(has_v).alias("vertical_source"),
        F.when(has_v, F.col("launch_confidence")).otherwise(confidence).alias("confidence"),
        F.coalesce("launch_h", F.lit(0.0)).alias("horizontal"),
        source(has_h).alias("horizontal_source"),
        F.when(has_h, F.col("launch_confidence")).otherwise(confidence).alias("horizontal_confidence"),
    )


ENSURED_SQL = ESTIMATE_SQL + """SELECT shot_number, coalesce(launch_v, est) AS vertical, CASE WHEN launch_v IS NULL THEN 'estimated' ELSE 'radar' END AS vertical_source,
CASE WHEN launch_v IS NULL THEN est_conf ELSE launch_confidence END AS confidence, coalesce(launch_h, 0) AS horizontal, CASE WHEN launch_h IS NULL THEN 'estimated' ELSE 'radar' END AS horizontal_source,
CASE WHEN launch_h IS NULL THEN est_conf ELSE launch_confidence END AS horizontal_confidence FROM e"""


def carry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which carry a shot shows: one computed from physics where its launch is known (here given as a column), else the table's, with the measured
    spin if that is reliable (confidence of 0.6 or more) or else the best spin for its speed."""
    c = clubbed(spark, sf_dir).withColumn("physics", F.when(F.col("launch_v").isNotNull(), F.col("ball_speed") * 1.6))
    reliable = F.coalesce((F.col("spin_rpm") > 0) & (F.col("spin_confidence") >= 0.6), F.lit(False))
    spin = F.when(reliable, F.col("spin_rpm")).otherwise(F.col("best_spin"))
    table = flight.spin_carry(F.col("carry"), F.col("ball_speed"), spin, F.col("best_spin"), F.col("club_speed"), F.col("carry_smash"))
    way = F.when(F.col("physics").isNotNull(), "physics").when(reliable, "table_measured_spin").otherwise("table_best_spin")
    return c.select("shot_number", way.alias("way"), F.round(F.coalesce("physics", table), 6).alias("carry"))


CHOICE_SQL = CLUBBED + """, m AS (SELECT *, coalesce(spin_rpm > 0 AND spin_confidence >= 0.6, false) AS ok FROM s), n AS (SELECT *, CASE WHEN ok THEN spin_rpm ELSE best_spin END AS spin FROM m),
f AS (SELECT *, abs(spin - best_spin) / 100 AS loss, carry_smash - smash AS short FROM n),
g AS (SELECT *, CASE WHEN spin < best_spin THEN greatest(0.82, 1 - loss * 0.012) ELSE greatest(0.88, 1 - loss * 0.008) END AS f0, CASE WHEN short > 0 THEN greatest(0.94, 1 - short / 0.05 * 0.03) WHEN short < -0.05 THEN 0.98 ELSE 1.0 END AS contact FROM f)
SELECT shot_number, CASE WHEN launch_v IS NOT NULL THEN 'physics' WHEN ok THEN 'table_measured_spin' ELSE 'table_best_spin' END AS way,
round(CASE WHEN launch_v IS NOT NULL THEN ball_speed * 1.6 ELSE carry * CASE WHEN loss < 2 THEN least(1.02, f0 + 0.01) ELSE f0 END * contact END, 6)::DOUBLE AS carry FROM g"""


def expected_spin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spin that a detector is told to expect of each ball speed, as a column beside it."""
    return clubbed(spark, sf_dir).select("shot_number", F.round("best_spin", 4).alias("expected_rpm"))


EXPECTED_SQL = CLUBBED + "SELECT shot_number, round(best_spin, 4)::DOUBLE AS expected_rpm FROM s"

QUERIES = {
    "ensured_angles": (ensured_angles, ENSURED_SQL),
    "carry_choice": (carry_choice, CHOICE_SQL),
    "expected_spin": (expected_spin, EXPECTED_SQL),
    "dim_club_fallback": (dim_club_fallback, DIM_SQL),
    "carry_table_interp": (carry_table_interp, CARRY_INTERP_SQL),
    "carry_spin_adjusted": (carry_spin_adjusted, CARRY_SPIN_SQL),
    "launch_estimate": (launch_estimate, LAUNCH_SQL),
    "kinematic_spin": (kinematic_spin, KINEMATIC_SQL),
    "radial_factor": (radial_factor, RADIAL_SQL),
    "launch_grid_fit": (launch_grid_fit, GRID_SQL),
    "alias_bins": (alias_bins, ALIAS_SQL),
    "acceptance_ladder_v": (acceptance_ladder_v, LADDER_V_SQL),
    "acceptance_ladder_h": (acceptance_ladder_h, LADDER_H_SQL),
    "simulator_shot": (simulator_shot, SIMULATOR_SQL),
    "spin_rejection": (spin_rejection, REJECTION_SQL),
    "launch_conditions": (launch_conditions, CONDITIONS_SQL),
    "completeness_matrix": (completeness_matrix, COMPLETENESS_SQL),
    "rule_reasons_array": (rule_reasons_array, REASONS_SQL),
}
