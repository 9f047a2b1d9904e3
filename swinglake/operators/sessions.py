"""Session statistics, session windows, and paging over shots and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions.flight import table_carry
from swinglake.functions.lens import lens, with_lenses

READINGS, SHOTS = with_lenses("readings"), with_lenses("shots")


def session_stats_of(shots: DataFrame, keys: list[str], truthy: bool = True) -> DataFrame:
    """Counts, ball speeds, mean club speed, smash, carry and spin, and the share of shots with spin.

    ``truthy``: club speed and smash leave out zeros as well as nulls; else nulls alone. Deviations are of the sample, 0 for one shot.
    """
    club = F.nullif(F.col("club_speed"), F.lit(0.0)) if truthy else F.col("club_speed")
    smash = F.when(F.col("club_speed") > 0, F.col("ball_speed") / F.col("club_speed"))
    return (
        shots.withColumn("__club", club)
        .withColumn("__smash", smash)
        .withColumn("__carry", table_carry(F.col("ball_speed")))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("shot_count"),
            F.round(F.avg("ball_speed"), 8).alias("avg_ball"),
            F.max("ball_speed").alias("max_ball"),
            F.min("ball_speed").alias("min_ball"),
            F.round(F.coalesce(F.stddev_samp("ball_speed"), F.lit(0.0)), 4).alias("sd_ball"),
            F.round(F.avg("__club"), 8).alias("avg_club"),
            F.round(F.avg("__smash"), 4).alias("avg_smash"),
            F.round(F.avg("__carry"), 3).alias("avg_carry"),
            F.round(F.avg("spin_rpm"), 8).alias("avg_spin"),
            F.round(F.count("spin_rpm") / F.count(F.lit(1)), 8).alias("spin_rate"),
        )
    )


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_stats_of(lens(spark, sf_dir, "shots"), ["session_id"])


def session_stats_non_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_stats_of(lens(spark, sf_dir, "shots"), ["session_id"], truthy=False)


CARRY_SQL = """CASE WHEN {b} <= 100 THEN {b} / 100 * 136.0 WHEN {b} < 110 THEN 136 + ({b} - 100) / 10 * 27.5 WHEN {b} < 120 THEN 163.5 + ({b} - 110) / 10 * 26.5
WHEN {b} < 130 THEN 190 + ({b} - 120) / 10 * 25 WHEN {b} < 140 THEN 215 + ({b} - 130) / 10 * 25 WHEN {b} < 150 THEN 240 + ({b} - 140) / 10 * 24.5
WHEN {b} < 160 THEN 264.5 + ({b} - 150) / 10 * 24 WHEN {b} < 167 THEN 288.5 WHEN {b} < 170 THEN 288.5 + ({b} - 167) / 3 * 23 WHEN {b} < 180 THEN 311.5 + ({b} - 170) / 10 * 23
WHEN {b} < 190 THEN 334.5 + ({b} - 180) / 10 * 22.5 WHEN {b} < 200 THEN 357 + ({b} - 190) / 10 * 17.5 WHEN {b} < 210 THEN 374.5 + ({b} - 200) / 10 * 21
ELSE 395.5 + ({b} - 210) * 1.8 END"""


def _stats_sql(club: str) -> str:
    return f"""{SHOTS}, s AS (SELECT *, {CARRY_SQL.format(b="ball_speed")}::DOUBLE AS carry FROM shots)
SELECT session_id, count(*) AS shot_count, round(avg(ball_speed), 8) AS avg_ball, max(ball_speed) AS max_ball, min(ball_speed) AS min_ball,
round(coalesce(stddev_samp(ball_speed), 0), 4) AS sd_ball, round(avg({club}), 8) AS avg_club,
round(avg(CASE WHEN club_speed > 0 THEN ball_speed / club_speed END), 4) AS avg_smash, round(avg(carry), 3) AS avg_carry,
round(avg(spin_rpm), 8) AS avg_spin, round(count(spin_rpm) / count(*), 8) AS spin_rate FROM s GROUP BY session_id"""


STATS_SQL = _stats_sql("nullif(club_speed, 0)")
STATS_NULLS_SQL = _stats_sql("club_speed")


def club_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots by club, with the place at which each club first came up in its session."""
    shots = lens(spark, sf_dir, "shots")
    return shots.groupBy("session_id", "club").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("us", "shot_number")).alias("f")).select("session_id", "club", "n", F.col("f.shot_number").alias("first_shot"))


CLUB_COUNTS_SQL = SHOTS + "SELECT session_id, club, count(*) AS n, arg_min(shot_number, (us, shot_number)) AS first_shot FROM shots GROUP BY 1, 2"


def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by direction with their peaks, 0 where there are none, and whether a session counts as active."""
    out = F.col("direction") == "outbound"
    return lens(spark, sf_dir, "readings").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(out).alias("outbound"),
        F.count_if(~out).alias("inbound"),
        F.coalesce(F.max(F.when(out, F.col("speed_mph"))), F.lit(0.0)).alias("peak_outbound"),
        F.coalesce(F.max(F.when(~out, F.col("speed_mph"))), F.lit(0.0)).alias("peak_inbound"),
        F.coalesce(F.max("magnitude"), F.lit(0.0)).alias("peak_magnitude"),
        (F.count_if(out & (F.col("speed_mph") >= 15)) >= 20).alias("active"),
    )


ACTIVITY_SQL = READINGS + """SELECT session_id, count(*) AS n, count(*) FILTER (direction = 'outbound') AS outbound, count(*) FILTER (direction = 'inbound') AS inbound,
coalesce(max(speed_mph) FILTER (direction = 'outbound'), 0) AS peak_outbound, coalesce(max(speed_mph) FILTER (direction = 'inbound'), 0) AS peak_inbound,
coalesce(max(magnitude), 0) AS peak_magnitude, count(*) FILTER (direction = 'outbound' AND speed_mph >= 15) >= 20 AS active FROM readings GROUP BY 1"""


def gap_groups(df: DataFrame, keys: list[str], at: str, order: list[str], gap: int, name: str) -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most ``gap``, from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.coalesce(((F.col(at) - F.lag(at).over(w)) > gap).cast("long"), F.lit(0))
    return df.withColumn("__o", opens).withColumn(name, F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__o")


def gap_sessions(spark: SparkSession, sf_dir: str, gap_us: int = 6 * 3600 * 1_000_000) -> DataFrame:
    """Groups of readings by time gap; a gap of exactly the limit stays inside."""
    runs = gap_groups(lens(spark, sf_dir, "readings"), ["session_id"], "us", ["us", "seq"], gap_us, "run")
    return runs.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("speed_mph").alias("peak"))


GAP_SQL = READINGS + """, f AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY session_id ORDER BY us, seq) > 21600000000)::BIGINT, 0) AS o FROM readings),
r AS (SELECT *, (sum(o) OVER (PARTITION BY session_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM f)
SELECT session_id, run, count(*) AS n, min(us) AS first_us, max(us) AS last_us, max(speed_mph) AS peak FROM r GROUP BY 1, 2"""


def detection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of readings above 20 mph: a run ends at the first reading that isn't, or at a gap above an hour."""
    w = Window.partitionBy("session_id").orderBy("us", "seq")
    hit = F.col("speed_mph") > 20
    r = lens(spark, sf_dir, "readings").withColumn("hit", hit)
    opens = r["hit"] & (~F.coalesce(F.lag("hit").over(w), F.lit(False)) | ((F.col("us") - F.lag("us").over(w)) > 3_600_000_000))
    runs = r.withColumn("o", opens.cast("long")).withColumn("run", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("hit")
    return runs.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("speed_mph"), 4).alias("avg_speed"), F.max("magnitude").alias("max_magnitude"))


RUNS_SQL = READINGS + """, h AS (SELECT *, speed_mph > 20 AS hit, coalesce(lag(speed_mph > 20) OVER w, false) AS was, us - lag(us) OVER w AS g FROM readings WINDOW w AS (PARTITION BY session_id ORDER BY us, seq)),
r AS (SELECT *, (sum((hit AND (NOT was OR g > 3600000000))::BIGINT) OVER (PARTITION BY session_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM h)
SELECT session_id, run, count(*) AS n, round(avg(speed_mph), 4) AS avg_speed, max(magnitude) AS max_magnitude FROM r WHERE hit GROUP BY 1, 2"""


def index_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers that lie at most 500 apart are one island."""
    hits = lens(spark, sf_dir, "readings").where("magnitude >= 50")
    runs = gap_groups(hits, ["session_id"], "seq", ["seq"], 500, "island")
    return runs.groupBy("session_id", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


ISLANDS_SQL = READINGS + """, f AS (SELECT *, coalesce((seq - lag(seq) OVER (PARTITION BY session_id ORDER BY seq) > 500)::BIGINT, 0) AS o FROM readings WHERE magnitude >= 50),
r AS (SELECT *, (sum(o) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM f)
SELECT session_id, island, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM r GROUP BY 1, 2"""


def lag_abs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("us", "shot_number")
    return lens(spark, sf_dir, "shots").select("session_id", "shot_number", F.round(F.abs(F.col("ball_speed") - F.lag("ball_speed").over(w)), 4).alias("delta"))


LAG_SQL = SHOTS + "SELECT session_id, shot_number, round(abs(ball_speed - lag(ball_speed) OVER (PARTITION BY session_id ORDER BY us, shot_number)), 4) AS delta FROM shots"


def frame_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings one before to two after a strong one, each once."""
    w = Window.partitionBy("session_id").orderBy("us", "seq")
    near = F.max((F.col("magnitude") >= 95).cast("int")).over(w.rowsBetween(-2, 1)) == 1
    return lens(spark, sf_dir, "readings").withColumn("near", near).where("near").select("session_id", "seq", "magnitude")


NEIGHBOURS_SQL = READINGS + """SELECT session_id, seq, magnitude FROM (SELECT *, max((magnitude >= 95)::INT) OVER (PARTITION BY session_id ORDER BY us, seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM readings) WHERE near = 1"""


def signal_ends(df: DataFrame, keys: list[str], order: str, value: str, smooth: int = 90, reference: int = 450, share: float = 0.15, hold: int = 150) -> DataFrame:
    """Per key: its number of rows, its reference level, and the place (from 0) at which its signal is lost, else its number of rows.

    The signal is smoothed by a centred mean of ``smooth`` rows, rows beyond an end being 0. The reference is the median of the
    first ``reference`` smoothed values. The signal is lost at the first of ``hold`` rows on end that are below the share of the
    reference; a signal shorter than the reference, or whose reference isn't above 0, isn't lost.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    half = smooth // 2
    rows = df.select(*keys, order, (F.sum(value).over(w.rowsBetween(-half, smooth - half - 1)) / smooth).alias("smooth"), (F.row_number().over(w) - 1).alias("at"))
    levels = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("at") < reference, F.col("smooth")), F.lit(0.5)).alias("level"))
    below = rows.join(levels, keys).withColumn("below", (F.col("smooth") < share * F.col("level")).cast("int"))
    lost = below.withColumn("run", F.sum("below").over(w.rowsBetween(0, hold - 1))).where((F.col("run") == hold) & (F.col("n") >= reference) & (F.col("level") > 0))
    first = lost.groupBy(*keys).agg(F.min("at").alias("lost"))
    return levels.join(first, keys, "left").select(*keys, "n", F.round("level", 5).alias("level"), F.coalesce("lost", "n").cast("long").alias("end"))


def rolling_mean_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the signals of captures end; a capture is a run of 2000 readings, the odd ones of which are all but silent from a place on."""
    faded = F.when((F.expr("seq div 2000") % 2 == 1) & (F.col("seq") % 2000 > 1400), F.col("magnitude") * 0.02).otherwise(F.col("magnitude"))
    r = lens(spark, sf_dir, "readings").select(F.expr("seq div 2000").alias("capture"), "seq", faded.alias("value"))
    return signal_ends(r, ["capture"], "seq", "value")


ROLLING_SQL = READINGS + """, r AS (SELECT seq // 2000 AS capture, seq, CASE WHEN seq // 2000 % 2 = 1 AND seq % 2000 > 1400 THEN magnitude * 0.02::DOUBLE ELSE magnitude END AS v FROM readings),
s AS (SELECT capture, row_number() OVER w - 1 AS at_row, sum(v) OVER (PARTITION BY capture ORDER BY seq ROWS BETWEEN 45 PRECEDING AND 44 FOLLOWING) / 90 AS s FROM r WINDOW w AS (PARTITION BY capture ORDER BY seq)),
l AS (SELECT capture, count(*) AS n, quantile_cont(s, 0.5) FILTER (at_row < 450) AS level FROM s GROUP BY 1),
b AS (SELECT s.capture, at_row, n, level, sum((s < 0.15::DOUBLE * level)::INT) OVER (PARTITION BY s.capture ORDER BY at_row ROWS BETWEEN CURRENT ROW AND 149 FOLLOWING) AS k FROM s JOIN l ON s.capture = l.capture)
SELECT capture, max(n) AS n, round(max(level), 5) AS level, coalesce(min(at_row) FILTER (k = 150 AND n >= 450 AND level > 0), max(n)) AS "end" FROM b GROUP BY 1"""


def paged_recent(spark: SparkSession, sf_dir: str, page: int = 3, size: int = 5) -> DataFrame:
    """One page of the newest shots: a page is the feature, so the limit is."""
    return lens(spark, sf_dir, "shots").orderBy(F.desc("us"), F.desc("shot_number")).offset(page * size).limit(size).select("session_id", "shot_number", "ball_speed", "club")


PAGED_SQL = SHOTS + "SELECT session_id, shot_number, ball_speed, club FROM shots ORDER BY us DESC, shot_number DESC LIMIT 5 OFFSET 15"


def recent_retained(spark: SparkSession, sf_dir: str, keep: int = 200) -> DataFrame:
    """The newest shots of each session, numbered from the newest."""
    w = Window.partitionBy("session_id").orderBy(F.desc("us"), F.desc("shot_number"))
    return lens(spark, sf_dir, "shots").withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep).select("session_id", "shot_number", F.col("age").cast("long").alias("age"))


RETAINED_SQL = SHOTS + "SELECT session_id, shot_number, age FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, shot_number DESC) AS age FROM shots) WHERE age <= 200"


def packet_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, median and 95th percentile of the gaps between packets, long gaps, and errors."""
    w = Window.partitionBy("session_id").orderBy("us", "seq")
    g = lens(spark, sf_dir, "readings").withColumn("gap", (F.col("us") - F.lag("us").over(w)).cast("double") / 1e6)
    return g.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.try_divide((F.count(F.lit(1)) - 1) * 1e6, (F.max("us") - F.min("us")).cast("double")) * 3600, 4).alias("per_hour"),
        F.round(F.percentile("gap", F.lit(0.5)), 3).alias("p50_s"),
        F.round(F.percentile("gap", F.lit(0.95)), 3).alias("p95_s"),
        F.count_if(F.col("gap") > 14400).alias("long_gaps"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )


PACKET_SQL = READINGS + """, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY session_id ORDER BY us, seq))::DOUBLE / 1e6 AS gap FROM readings)
SELECT session_id, count(*) AS n, round((count(*) - 1) * 1e6 / (max(us) - min(us))::DOUBLE * 3600, 4) AS per_hour, round(quantile_cont(gap, 0.5), 3) AS p50_s,
round(quantile_cont(gap, 0.95), 3) AS p95_s, count(*) FILTER (gap > 14400) AS long_gaps, count(*) FILTER (event_type = 'error') AS errors FROM g GROUP BY 1"""


def mode_bin_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole-mph bins with two readings or more the fastest; the largest speed within 2 mph of it, else the largest of all."""
    r = lens(spark, sf_dir, "readings").where("direction = 'outbound'").select("session_id", "speed_mph", F.bround("speed_mph").alias("bin"))
    bins = r.groupBy("session_id", "bin").agg(F.count(F.lit(1)).alias("k"), F.max("speed_mph").alias("top"))
    fastest = bins.groupBy("session_id").agg(F.max(F.when(F.col("k") >= 2, F.col("bin"))).alias("bin"), F.max("top").alias("top"))
    # only bins that can hold such a speed meet their readings again
    close = bins.join(fastest.select("session_id", F.col("bin").alias("best")), "session_id").where(F.abs(F.col("bin") - F.col("best")) <= 3).select("session_id", "bin", "best")
    near = r.join(close, ["session_id", "bin"]).where(F.abs(F.col("speed_mph") - F.col("best")) <= 2)
    picked = near.groupBy("session_id").agg(F.max("speed_mph").alias("picked"))
    return fastest.join(picked, "session_id", "left").select("session_id", F.col("bin").alias("mode_bin"), F.coalesce("picked", "top").alias("ball_speed"))


MODE_SQL = READINGS + """, r AS (SELECT session_id, speed_mph, round_even(speed_mph, 0) AS bin FROM readings WHERE direction = 'outbound'),
b AS (SELECT session_id, bin, count(*) AS k, max(speed_mph) AS top FROM r GROUP BY 1, 2),
f AS (SELECT session_id, max(bin) FILTER (k >= 2) AS bin, max(top) AS top FROM b GROUP BY 1)
SELECT f.session_id, max(f.bin) AS mode_bin, coalesce(max(r.speed_mph) FILTER (abs(r.speed_mph - f.bin) <= 2), max(f.top)) AS ball_speed FROM f JOIN r ON f.session_id = r.session_id GROUP BY 1"""


def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speed by squared magnitude, a tenth of the weight beyond 100 mph."""
    w = F.col("magnitude") * F.col("magnitude") * F.when(F.col("speed_mph") > 100, 0.1).otherwise(1.0)
    return lens(spark, sf_dir, "readings").groupBy("session_id").agg(F.round(F.try_divide(F.sum(w * F.col("speed_mph")), F.sum(w)), 4).alias("centroid"))


CENTROID_SQL = READINGS + """, w AS (SELECT *, magnitude * magnitude * CASE WHEN speed_mph > 100 THEN 0.1 ELSE 1.0 END::DOUBLE AS w FROM readings)
SELECT session_id, round(sum(w * speed_mph) / sum(w), 4) AS centroid FROM w GROUP BY 1"""

QUERIES = {
    "session_stats": (session_stats, STATS_SQL),
    "session_stats_non_truthy": (session_stats_non_truthy, STATS_NULLS_SQL),
    "club_counts": (club_counts, CLUB_COUNTS_SQL),
    "activity_summary": (activity_summary, ACTIVITY_SQL),
    "gap_sessions": (gap_sessions, GAP_SQL),
    "detection_runs": (detection_runs, RUNS_SQL),
    "index_islands": (index_islands, ISLANDS_SQL),
    "lag_abs_delta": (lag_abs_delta, LAG_SQL),
    "frame_neighbourhood": (frame_neighbourhood, NEIGHBOURS_SQL),
    "rolling_mean_below": (rolling_mean_below, ROLLING_SQL),
    "paged_recent": (paged_recent, PAGED_SQL),
    "recent_retained": (recent_retained, RETAINED_SQL),
    "packet_timing": (packet_timing, PACKET_SQL),
    "mode_bin_speed": (mode_bin_speed, MODE_SQL),
    "weighted_centroid": (weighted_centroid, CENTROID_SQL),
}
