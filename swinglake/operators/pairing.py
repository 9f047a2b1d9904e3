"""Pairing device shots with truth shots, and error statistics of the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses
from swinglake.functions.stats import error_columns, nearest_rank

KEY = ["us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def numbered(df: DataFrame, keys: list[str], by: list[str], coarse: Column, fine: Column) -> DataFrame:
    """``df`` with ``pos``, each row's place in its key's order from 1, nulls last; no task sorts a whole key.

    ``coarse`` and ``fine`` don't fall along that order: ``coarse`` cuts a key into ranges of a bounded number (days), ``fine``
    cuts those. Rows are numbered inside a fine range, which begins behind the rows of the fine ranges before it in its coarse one,
    which begins behind those of the coarse ones before it. So a window holds a fine range's rows, a coarse range's fine
    ranges, or a key's coarse ranges.
    """
    # one struct names a range, nulls and all: rows are dealt by it once, to be numbered and to meet their range's start; its hash is what sorts compare first
    named = F.struct(*[F.col(c) for c in (*keys, "__c", "__f")])
    at = ["__hash", "__range"]
    rows = df.withColumns({"__c": coarse, "__f": fine}).withColumns({"__hash": F.xxhash64(*keys, "__c", "__f"), "__range": named})
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*[F.col(c).asc_nulls_last() for c in by]))
    starts = range_starts(rows, keys).select(F.xxhash64(*keys, "__c", "__f").alias("__hash"), named.alias("__range"), "__start")
    placed = rows.withColumn("__inside", inside).join(starts, at)
    return placed.select(*[F.col(c) for c in df.columns], (F.col("__start") + F.col("__inside")).alias("pos"))


def range_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __c, __f and ``__start``: the rows of a key that come before a fine range."""
    fine = rows.groupBy(*keys, "__c", "__f").agg(F.count(F.lit(1)).alias("__n"))
    before = lambda by, over: F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(F.col(over).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy(*keys, "__c").agg(F.sum("__n").alias("__n")).withColumn("__whole", before(keys, "__c"))
    whole = F.struct(*[F.col(c) for c in (*keys, "__c")]).alias("__coarse")
    placed = fine.withColumn("__part", before([*keys, "__c"], "__f")).select("*", whole).join(coarse.select(whole, "__whole"), "__coarse")
    return placed.select(*keys, "__c", "__f", (F.col("__whole") + F.col("__part")).alias("__start"))


def ordinal_pairs(device: DataFrame, truth: DataFrame, keys: list[str], by: list[str], coarse: Column, fine: Column, speed: str = "ball_speed", tolerance: float = 5.0) -> DataFrame:
    """Full outer pairing by position inside each key: the n-th of one side with the n-th of the other.

    Both sides are sorted by ``by``, nulls last, in ranges of that order (:func:`numbered`). A pair whose speeds differ by more than the
    tolerance is a mismatch; a shot that is left over stays unmatched. Columns become ``d_*`` and ``t_*``.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        placed = numbered(df, keys, by, coarse, fine)
        return placed.select(*keys, "pos", *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"{mark}_here"))

    delta = F.abs(F.col(f"d_{speed}") - F.col(f"t_{speed}"))
    quality = (
        F.when(F.col("t_here").isNull(), "unmatched_device")
        .when(F.col("d_here").isNull(), "unmatched_truth")
        .when(delta > tolerance, "ball_speed_mismatch")
        .otherwise("good")
    )
    return side(device, "d").join(side(truth, "t"), [*keys, "pos"], "full_outer").withColumn("match_quality", quality).drop("d_here", "t_here")


def paired(spark: SparkSession, sf_dir: str, tolerance: float = 30.0) -> DataFrame:
    # a club's shots of a day, in blocks of ten million orders: some thousands of rows each, so that there are far fewer ranges than rows
    return ordinal_pairs(lens(spark, sf_dir, "device"), lens(spark, sf_dir, "truth"), ["club"], KEY, F.col("us"), F.expr("l_orderkey div 10000000"), tolerance=tolerance)


PAIRS_SQL = (
    with_lenses("device", "truth")
    + """, d AS (SELECT *, row_number() OVER (PARTITION BY club ORDER BY us, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos FROM device),
t AS (SELECT *, row_number() OVER (PARTITION BY club ORDER BY us, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos FROM truth),
pairs AS (SELECT coalesce(d.club, t.club) AS club, coalesce(d.pos, t.pos) AS pos, d.ball_speed AS d_speed, t.ball_speed AS t_speed,
  d.launch_v AS d_launch, t.launch_v AS t_launch, d.confidence, d.frames, d.source_id,
  CASE WHEN t.pos IS NULL THEN 'unmatched_device' WHEN d.pos IS NULL THEN 'unmatched_truth'
       WHEN abs(d.ball_speed - t.ball_speed) > 30 THEN 'ball_speed_mismatch' ELSE 'good' END AS match_quality
  FROM d FULL OUTER JOIN t ON d.club = t.club AND d.pos = t.pos)
"""
)


def pair_shots_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paired(spark, sf_dir)
    delta = F.col("d_ball_speed") - F.col("t_ball_speed")
    return p.select("club", F.col("pos").cast("long").alias("pos"), "d_ball_speed", "t_ball_speed", F.round(delta, 4).alias("delta_speed"), "match_quality")


PAIR_SHOTS_SQL = PAIRS_SQL + "SELECT club, pos, d_speed AS d_ball_speed, t_speed AS t_ball_speed, round(d_speed - t_speed, 4) AS delta_speed, match_quality FROM pairs"


def match_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).groupBy("club", "match_quality").agg(F.count(F.lit(1)).alias("n"))


MATCH_QUALITY_SQL = PAIRS_SQL + "SELECT club, match_quality, count(*) AS n FROM pairs GROUP BY 1, 2"


def good_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good pairs with the errors of speed and launch angle, and what slices them."""
    return (
        paired(spark, sf_dir)
        .where("match_quality = 'good'")
        .select(
            "club",
            "pos",
            "d_ball_speed",
            "t_ball_speed",
            "d_launch_v",
            "t_launch_v",
            (F.col("d_ball_speed") - F.col("t_ball_speed")).alias("e_speed"),
            (F.col("d_launch_v") - F.col("t_launch_v")).alias("e_launch"),
            F.col("d_confidence").alias("confidence"),
            F.col("d_frames").alias("frames"),
            F.col("d_source_id").alias("source_id"),
        )
    )


GOOD_SQL = PAIRS_SQL + ", good AS (SELECT *, d_speed - t_speed AS e_speed, d_launch - t_launch AS e_launch FROM pairs WHERE match_quality = 'good') "


def pair_error_by_club(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per club: mean, population deviation and the error of the largest size."""
    worst = F.max(F.struct(F.abs("e_speed").alias("size"), F.col("e_speed").alias("e")))["e"]
    return good_errors(spark, sf_dir).groupBy("club").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("e_speed"), 4).alias("bias"),
        F.round(F.stddev_pop("e_speed"), 4).alias("pop_sd"),
        F.round(F.avg(F.abs("e_speed")), 4).alias("mae"),
        F.round(F.sqrt(F.avg(F.col("e_speed") * F.col("e_speed"))), 4).alias("rmse"),
        worst.alias("worst"),
    )


PAIR_ERROR_SQL = GOOD_SQL + """SELECT club, count(*) AS n, round(avg(e_speed), 4) AS bias, round(stddev_pop(e_speed), 4) AS pop_sd,
round(avg(abs(e_speed)), 4) AS mae, round(sqrt(avg(e_speed * e_speed)), 4) AS rmse, arg_max(e_speed, (abs(e_speed), e_speed)) AS worst
FROM good GROUP BY club"""


def slices(spark: SparkSession, sf_dir: str, labels: dict[str, Column]) -> DataFrame:
    """Error statistics by one label at a time; a label is any column expression."""
    rows = good_errors(spark, sf_dir)
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.cast("string").alias("label")) for k, v in labels.items()]))
    long = rows.select(label.alias("s"), F.col("e_launch").alias("e")).select("s.slice", "s.label", "e")
    stats = long.groupBy("slice", "label").agg(*error_columns("e"))
    ranks = nearest_rank(long.withColumn("a", F.abs("e")), ["slice", "label"], "a", 0.9).withColumnRenamed("a", "p90")
    return stats.join(ranks, ["slice", "label"])


def error_stats_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("confidence") < 0.5, "low").when(F.col("confidence") < 0.7, "mid").otherwise("high")
    frames = F.when(F.col("frames") <= 1, "1").when(F.col("frames") <= 3, "2-3").otherwise("4+")
    out = slices(spark, sf_dir, {"all": F.lit("all"), "club": F.col("club"), "source": F.col("source_id"), "confidence": bucket, "frames": frames})
    return out.select("slice", "label", "n", "bias", "mae", "rmse", F.round("p90", 4).alias("p90"))


SLICES_SQL = GOOD_SQL + """, long AS (
SELECT 'all' AS slice, 'all' AS label, e_launch AS e FROM good
UNION ALL SELECT 'club', club, e_launch FROM good
UNION ALL SELECT 'source', CAST(source_id AS VARCHAR), e_launch FROM good
UNION ALL SELECT 'confidence', CASE WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.7 THEN 'mid' ELSE 'high' END, e_launch FROM good
UNION ALL SELECT 'frames', CASE WHEN frames <= 1 THEN '1' WHEN frames <= 3 THEN '2-3' ELSE '4+' END, e_launch FROM good),
r AS (SELECT *, row_number() OVER (PARTITION BY slice, label ORDER BY abs(e)) - 1 AS i, count(*) OVER (PARTITION BY slice, label) AS n FROM long)
SELECT slice, label, max(n) AS n, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
round(max(CASE WHEN i = round_even(0.9 * (n - 1), 0) THEN abs(e) END), 4) AS p90 FROM r GROUP BY 1, 2"""


def worst_n_errors(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The n largest errors of each axis."""
    axes = F.explode(F.array(F.struct(F.lit("speed").alias("axis"), F.col("e_speed").alias("e")), F.struct(F.lit("launch").alias("axis"), F.col("e_launch").alias("e"))))
    long = good_errors(spark, sf_dir).select("club", "pos", axes.alias("x")).select("x.axis", "club", F.col("pos").cast("long").alias("pos"), "x.e")
    order = [F.desc(F.abs("e")), F.col("club"), F.col("pos")]
    tops = [long.where(F.col("axis") == a).orderBy(*order).limit(n) for a in ("speed", "launch")]
    return tops[0].unionByName(tops[1]).select("axis", "club", "pos", F.round("e", 4).alias("error"))


WORST_SQL = GOOD_SQL + """, long AS (SELECT 'speed' AS axis, club, pos, e_speed AS e FROM good UNION ALL SELECT 'launch', club, pos, e_launch FROM good)
SELECT axis, club, pos, round(e, 4) AS error FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY abs(e) DESC, club, pos) AS rn FROM long) WHERE rn <= 10"""


def gating_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch error under four policies of which shots count."""
    tests = {"all": F.lit(True), "radar_only": F.col("source_id") < 3, "confident": F.col("confidence") >= 0.7, "many_frames": F.col("frames") >= 4}
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return good_errors(spark, sf_dir).select(F.explode(named).alias("policy"), F.col("e_launch").alias("e")).groupBy("policy").agg(*error_columns("e"))


GATING_SQL = GOOD_SQL + """, long AS (SELECT 'all' AS policy, e_launch AS e FROM good UNION ALL SELECT 'radar_only', e_launch FROM good WHERE source_id < 3
UNION ALL SELECT 'confident', e_launch FROM good WHERE confidence >= 0.7 UNION ALL SELECT 'many_frames', e_launch FROM good WHERE frames >= 4)
SELECT policy, count(*) AS n, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM long GROUP BY 1"""

QUERIES = {
    "pair_shots_ordinal": (pair_shots_ordinal, PAIR_SHOTS_SQL),
    "match_quality_counts": (match_quality_counts, MATCH_QUALITY_SQL),
    "pair_error_by_club": (pair_error_by_club, PAIR_ERROR_SQL),
    "error_stats_slices": (error_stats_slices, SLICES_SQL),
    "worst_n_errors": (worst_n_errors, WORST_SQL),
    "gating_policies": (gating_policies, GATING_SQL),
}
