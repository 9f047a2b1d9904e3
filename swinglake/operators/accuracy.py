"""Accuracy and calibration of paired shots: correlation, fits, limits of agreement, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.functions.stats import nearest_rank, pearson, slope_intercept, sums
from swinglake.operators.pairing import GOOD_SQL, good_errors


def nearest_rank_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = good_errors(spark, sf_dir).withColumn("p90_abs", F.abs("e_launch"))
    return nearest_rank(e, ["club"], "p90_abs", 0.9).select("club", F.round("p90_abs", 4).alias("p90_abs"))


P90_SQL = GOOD_SQL + """, r AS (SELECT club, abs(e_launch) AS a, row_number() OVER (PARTITION BY club ORDER BY abs(e_launch)) - 1 AS i, count(*) OVER (PARTITION BY club) AS n FROM good)
SELECT club, round(a, 4) AS p90_abs FROM r WHERE i = round_even(0.9 * (n - 1), 0)"""


def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null below three pairs or for a constant side in one form, 0 in the other."""
    fit = good_errors(spark, sf_dir).groupBy("club", "frames").agg(*sums("d_ball_speed", "t_ball_speed"))
    r = pearson()
    return fit.select("club", "frames", "n", F.round(F.when(F.col("n") >= 3, r), 4).alias("r_or_null"), F.round(F.coalesce(r, F.lit(0.0)), 4).alias("r_or_zero"))


PEARSON_SQL = GOOD_SQL + """, g AS (SELECT club, frames, count(*) AS n, covar_pop(d_speed, t_speed) AS c, stddev_pop(d_speed) * stddev_pop(t_speed) AS s FROM good GROUP BY 1, 2)
SELECT club, frames, n, CASE WHEN n >= 3 AND s > 0 THEN round(c / s, 4) END AS r_or_null, CASE WHEN n > 1 AND s > 0 THEN round(c / s, 4) ELSE 0.0 END AS r_or_zero FROM g"""


def _calibration(spark: SparkSession, sf_dir: str, device: str, truth: str) -> DataFrame:
    fit = good_errors(spark, sf_dir).groupBy("club").agg(*sums(device, truth))
    slope, intercept = slope_intercept()
    fit = fit.withColumn("slope", slope).withColumn("intercept", intercept)
    vx, vy, cxy = F.col("vx"), F.col("vy"), F.col("cxy")
    residual = F.sqrt(F.greatest(vy - 2 * F.col("slope") * cxy + F.col("slope") * F.col("slope") * vx, F.lit(0.0)))
    offset = F.sqrt(F.greatest(vx + vy - 2 * cxy, F.lit(0.0)))
    return fit.where("n >= 3").select("club", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round(residual, 3).alias("residual_sd"), F.round(offset, 3).alias("offset_rmse"))


def ols_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth on device: linear fit with the deviation of its residuals, and the error left by an offset alone."""
    return _calibration(spark, sf_dir, "d_ball_speed", "t_ball_speed")


def angle_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of launch angles."""
    return _calibration(spark, sf_dir, "d_launch_v", "t_launch_v")


OLS_SQL = GOOD_SQL + """, f AS (SELECT club, count(*) AS n, regr_slope(t_speed, d_speed) AS slope, regr_intercept(t_speed, d_speed) AS intercept, stddev_pop(t_speed - d_speed) AS o FROM good GROUP BY club)
SELECT f.club, max(f.n) AS n, round(max(slope), 4) AS slope, round(max(intercept), 4) AS intercept,
round(stddev_pop(t_speed - (slope * d_speed + intercept)), 3) AS residual_sd, round(max(o), 3) AS offset_rmse FROM good JOIN f ON good.club = f.club GROUP BY f.club HAVING max(f.n) >= 3"""


ANGLE_SQL = GOOD_SQL + OLS_SQL.removeprefix(GOOD_SQL).replace("d_speed", "d_launch").replace("t_speed", "t_launch")


def proportional_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = good_errors(spark, sf_dir).groupBy("club").agg(*sums("d_ball_speed", "t_ball_speed"))
    return fit.select("club", F.round(F.try_divide(F.col("cxy") + F.col("mx") * F.col("my"), F.col("vx") + F.col("mx") * F.col("mx")), 5).alias("slope"))


PROPORTIONAL_SQL = GOOD_SQL + "SELECT club, round(sum(d_speed * t_speed) / sum(d_speed * d_speed), 5) AS slope FROM good GROUP BY club"


def bland_altman_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bias, sd = F.avg("e_speed"), F.stddev_pop("e_speed")
    return good_errors(spark, sf_dir).groupBy("club").agg(
        F.round(bias, 4).alias("bias"),
        F.round(bias - 1.96 * sd, 4).alias("lower"),
        F.round(bias + 1.96 * sd, 4).alias("upper"),
        F.round(F.avg((F.col("d_ball_speed") + F.col("t_ball_speed")) / 2), 4).alias("mean_level"),
    )


BLAND_SQL = GOOD_SQL + """SELECT club, round(avg(e_speed), 4) AS bias, round(avg(e_speed) - 1.96 * stddev_pop(e_speed), 4) AS lower,
round(avg(e_speed) + 1.96 * stddev_pop(e_speed), 4) AS upper, round(avg((d_speed + t_speed) / 2), 4) AS mean_level FROM good GROUP BY club"""


def metric_verdict(spark: SparkSession, sf_dir: str, bias_limit: float = 1.0, noise_limit: float = 17.0) -> DataFrame:
    """good, biased, noisy or thin (fewer than three pairs, or under half of the shots paired) by club and metric."""
    rows = good_errors(spark, sf_dir)
    metric = F.explode(F.array(F.struct(F.lit("speed").alias("metric"), F.col("e_speed").alias("e")), F.struct(F.lit("launch").alias("metric"), F.when(F.col("frames") > 2, F.col("e_launch")).alias("e"))))
    stats = rows.select("club", metric.alias("m")).groupBy("club", "m.metric").agg(F.count("m.e").alias("n"), F.count(F.lit(1)).alias("shots"), F.avg("m.e").alias("bias"), F.stddev_pop("m.e").alias("sd"))
    verdict = (
        F.when((F.col("n") < 3) | (F.col("n") / F.col("shots") < 0.5), "thin")
        .when(F.abs("bias") > bias_limit, "biased")
        .when(F.col("sd") > noise_limit, "noisy")
        .otherwise("good")
    )
    return stats.select("club", "metric", "n", "shots", verdict.alias("verdict"))


VERDICT_SQL = GOOD_SQL + """, m AS (SELECT club, 'speed' AS metric, e_speed AS e FROM good UNION ALL SELECT club, 'launch', CASE WHEN frames > 2 THEN e_launch END FROM good),
s AS (SELECT club, metric, count(e) AS n, count(*) AS shots, avg(e) AS bias, stddev_pop(e) AS sd FROM m GROUP BY 1, 2)
SELECT club, metric, n, shots, CASE WHEN n < 3 OR n / shots < 0.5 THEN 'thin' WHEN abs(bias) > 1.0 THEN 'biased' WHEN sd > 17.0 THEN 'noisy' ELSE 'good' END AS verdict FROM s"""

QUERIES = {
    "nearest_rank_p90": (nearest_rank_p90, P90_SQL),
    "pearson_guarded": (pearson_guarded, PEARSON_SQL),
    "ols_calibration": (ols_calibration, OLS_SQL),
    "angle_calibration": (angle_calibration, ANGLE_SQL),
    "proportional_fit": (proportional_fit, PROPORTIONAL_SQL),
    "bland_altman_limits": (bland_altman_limits, BLAND_SQL),
    "metric_verdict": (metric_verdict, VERDICT_SQL),
}
