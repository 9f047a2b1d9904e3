"""Summaries of replays, captures, models and sessions. All are one aggregation, after one more that counts equal rows where ranks or counts by name are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses
from swinglake.functions.stats import nearest_rank, quantiles
from swinglake.operators.pairing import GOOD_SQL, good_errors

READINGS, SHOTS = with_lenses("readings"), with_lenses("shots")


def named_counts(df: DataFrame, keys: list[str], name: str, out: str, times: str | None = None) -> DataFrame:
    """Per key, how often each value of a column stands, as one text ``a=3,b=1`` in the order of the values."""
    counts = df.groupBy(*keys, name).agg(F.sum(times or F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("k"), "n")))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["k"], x["n"].cast("string"))), ",").alias(out))


def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a model over all shots, by club and by source, in one pass; how many were measured and how many estimated."""
    e = good_errors(spark, sf_dir).withColumn("measured", F.col("confidence") >= 0.5)
    return spark.sql(
        """SELECT coalesce(club, 'all') AS club, coalesce(source_id, -1) AS source, count(*) AS n, round(avg(e_launch), 4) AS mean, round(stddev_pop(e_launch), 4) AS pop_sd,
        round(sqrt(avg(e_launch * e_launch)), 4) AS rmse, round(avg(abs(e_launch)), 4) AS mae, round(max(abs(e_launch)), 4) AS worst, count_if(measured) AS measured, count_if(NOT measured) AS estimated
        FROM {e} GROUP BY GROUPING SETS ((), (club), (source_id))""",
        e=e,
    )


MODEL_SQL = GOOD_SQL + """SELECT coalesce(club, 'all') AS club, coalesce(source_id, -1) AS source, count(*) AS n, round(avg(e_launch), 4) AS mean, round(stddev_pop(e_launch), 4) AS pop_sd,
round(sqrt(avg(e_launch * e_launch)), 4) AS rmse, round(avg(abs(e_launch)), 4) AS mae, round(max(abs(e_launch)), 4) AS worst, count(*) FILTER (confidence >= 0.5) AS measured, count(*) FILTER (confidence < 0.5) AS estimated
FROM good GROUP BY GROUPING SETS ((), (club), (source_id))"""

#: The least confidence of a detection, as a replay's parameters.
PARAMETERS = (0.0, 0.5, 1.0)


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good pairs under each parameter: the error where there is a detection, the reason, and how many equal pairs a row stands for (``n``).

    Pairs are counted before anything else is asked of them: all that follows reads the counts, and the plan pairs shots once.
    """
    found = F.col("confidence") >= F.col("least")
    reason = F.when(found, "detected").when(F.col("frames") < 2, "no_frames").otherwise("low_confidence")
    equal = good_errors(spark, sf_dir).groupBy("club", "source_id", "confidence", "frames", "e_launch").agg(F.count(F.lit(1)).alias("n"))
    rows = equal.withColumn("least", F.explode(F.array(*[F.lit(x) for x in PARAMETERS])))
    return rows.select("least", "club", "source_id", reason.alias("reason"), F.when(found, F.abs("e_launch")).alias("e"), "n")


ROWS_SQL = GOOD_SQL + """, rows AS (SELECT least, club, source_id, CASE WHEN confidence >= least THEN 'detected' WHEN frames < 2 THEN 'no_frames' ELSE 'low_confidence' END AS reason,
CASE WHEN confidence >= least THEN abs(e_launch) END AS e FROM good, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS least) p) """


def detection_columns(limits: tuple[float, ...]) -> list[Column]:
    """Of rows that stand for ``n`` pairs each."""
    n, detected = F.col("n"), F.sum(F.when(F.col("e").isNotNull(), F.col("n")).otherwise(0))
    within = [F.sum(F.when(F.col("e") <= x, n).otherwise(0)).alias(f"within_{str(x).replace('.', '_')}") for x in limits]
    return [
        F.sum(n).alias("attempted"),
        detected.alias("detected"),
        F.round(detected / F.sum(n), 6).alias("rate"),
        F.round(F.try_divide(F.sum(F.col("e") * n), detected), 4).alias("mae"),
        F.round(F.max("e"), 4).alias("worst"),
        *within,
    ]


def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parameter: detections and their errors, the 90th percentile by nearest rank, counts by reason, and whether all are within half a degree."""
    rows = replay_rows(spark, sf_dir)
    stats = rows.groupBy("least").agg(*detection_columns((0.5,)))
    p90 = nearest_rank(rows, ["least"], "e", 0.9, "n").select("least", F.round("e", 4).alias("p90"))
    gate = (F.col("detected") == F.col("attempted")) & F.coalesce(F.col("worst") <= 0.5, F.lit(False))
    return stats.join(p90, "least", "left").join(named_counts(rows, ["least"], "reason", "reasons", "n"), "least").withColumn("passes", gate)


def _rank(p: str) -> str:
    return f"round(max(CASE WHEN i = round_even({p} * (k - 1), 0) THEN e END), 4)"


_RANKED = ", r AS (SELECT *, row_number() OVER (PARTITION BY {by}, e IS NULL ORDER BY e) - 1 AS i, count(e) OVER (PARTITION BY {by}) AS k FROM rows) "
REPLAY_SQL = ROWS_SQL + _RANKED.format(by="least") + f""", c AS (SELECT least, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT least, reason, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY 1)
SELECT least, count(*) AS attempted, count(e) AS detected, round(count(e) / count(*), 6) AS rate, round(avg(e), 4) AS mae, round(max(e), 4) AS worst, count(*) FILTER (e <= 0.5) AS within_0_5,
{_rank("0.9")} AS p90, max(reasons) AS reasons, count(e) = count(*) AND coalesce(max(e) <= 0.5, false) AS passes FROM r JOIN c USING (least) GROUP BY 1"""


def medians(df: DataFrame, keys: list[str], value: str, name: str, places: int, times: str | None = None) -> DataFrame:
    return quantiles(df, keys, value, (0.5,), times).select(*keys, F.round(F.col("q")[0], places).alias(name))


def geometry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per club: median and 90th percentile of errors, how many are within 1, 2 and 5 degrees, counts by reason and by source."""
    rows = replay_rows(spark, sf_dir).where("least = 0.5")
    stats = rows.groupBy("club").agg(*detection_columns((1.0, 2.0, 5.0)))
    stats = stats.join(medians(rows, ["club"], "e", "median", 4, "n"), "club", "left")
    p90 = nearest_rank(rows, ["club"], "e", 0.9, "n").select("club", F.round("e", 4).alias("p90"))
    return stats.join(p90, "club", "left").join(named_counts(rows, ["club"], "reason", "reasons", "n"), "club").join(named_counts(rows, ["club"], "source_id", "sources", "n"), "club")


GEOMETRY_SQL = ROWS_SQL.replace("FROM good, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS least) p", "FROM good, (SELECT 0.5::DOUBLE AS least) p") + _RANKED.format(by="club") + f""",
c AS (SELECT club, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT club, reason, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT club, string_agg(source_id || '=' || n, ',' ORDER BY source_id) AS sources FROM (SELECT club, source_id::VARCHAR AS source_id, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY 1)
SELECT club, count(*) AS attempted, count(e) AS detected, round(count(e) / count(*), 6) AS rate, round(avg(e), 4) AS mae, round(max(e), 4) AS worst, count(*) FILTER (e <= 1) AS within_1_0,
count(*) FILTER (e <= 2) AS within_2_0, count(*) FILTER (e <= 5) AS within_5_0, round(quantile_cont(e, 0.5), 4) AS median, {_rank("0.9")} AS p90, max(reasons) AS reasons, max(sources) AS sources
FROM r JOIN c USING (club) JOIN s USING (club) GROUP BY 1"""


def readiness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets (purchases) by what their session has to replay: no buffer, one without a payload, an invalid payload, or a whole one."""
    r = lens(spark, sf_dir, "readings")
    b = r.where("event_type IN ('view', 'error')").groupBy("session_id").agg(
        F.max(F.when(F.col("event_type") == "error", (F.col("seq") % 5 == 0).cast("int"))).alias("whole"), F.count_if(F.col("event_type") == "error").alias("payloads")
    )
    t = r.where("event_type = 'purchase'").join(b, "session_id", "left")
    has, none = F.col("whole").isNotNull(), F.col("payloads").isNull()
    return t.groupBy((F.col("session_id") % 10).alias("part")).agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(none).alias("missing_buffer"),
        F.count_if(~none & (F.col("payloads") == 0)).alias("missing_payload"),
        F.count_if(has & (F.col("whole") == 0)).alias("invalid_payload"),
        F.count_if(has & (F.col("whole") == 1)).alias("with_payload"),
    )


READINESS_SQL = READINGS + """, b AS (SELECT session_id, max((seq % 5 = 0)::INT) FILTER (event_type = 'error') AS whole, count(*) FILTER (event_type = 'error') AS payloads FROM readings WHERE event_type IN ('view', 'error') GROUP BY 1)
SELECT r.session_id % 10 AS part, count(*) AS targets, count(*) FILTER (payloads IS NULL) AS missing_buffer, count(*) FILTER (payloads = 0) AS missing_payload, count(*) FILTER (whole = 0) AS invalid_payload, count(*) FILTER (whole = 1) AS with_payload
FROM readings r LEFT JOIN b ON r.session_id = b.session_id WHERE event_type = 'purchase' GROUP BY 1"""


def spin_replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, mean and median error and the share within a tenth, of three ways to read spin; the third takes the better of a rate and its double."""
    s = lens(spark, sf_dir, "shots").withColumn("truth", F.col("ball_speed") * 40 + 500)
    half = F.col("spin_rpm") / 2
    better = F.when(F.abs(half - F.col("truth")) <= F.abs(F.col("spin_rpm") - F.col("truth")), half).otherwise(F.col("spin_rpm"))
    ways = {"envelope": F.when(F.col("spin_confidence") >= 0.5, F.col("spin_rpm")), "sidebands": half, "harmonic": better}
    long = s.select("club", "truth", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), v.alias("rpm")) for k, v in ways.items()])).alias("w")).select("club", "truth", "w.*")
    long = long.withColumn("e", F.abs(F.col("rpm") - F.col("truth")))
    stats = long.groupBy("club", "way").agg(
        F.count(F.lit(1)).alias("total"), F.count("rpm").alias("covered"), F.round(F.avg("e"), 3).alias("mae"), F.count_if(F.col("e") / F.col("truth") * 100 <= 10).alias("within_10")
    )
    return stats.join(medians(long, ["club", "way"], "e", "median", 3), ["club", "way"], "left")


SPIN_SQL = SHOTS + """, s AS (SELECT club, ball_speed * 40 + 500 AS truth, spin_rpm AS r, spin_rpm / 2 AS h, spin_confidence AS c FROM shots),
l AS (SELECT club, truth, 'envelope' AS way, CASE WHEN c >= 0.5 THEN r END AS rpm FROM s UNION ALL SELECT club, truth, 'sidebands', h FROM s
UNION ALL SELECT club, truth, 'harmonic', CASE WHEN abs(h - truth) <= abs(r - truth) THEN h ELSE r END FROM s)
SELECT club, way, count(*) AS total, count(rpm) AS covered, round(avg(abs(rpm - truth)), 3) AS mae, round(quantile_cont(abs(rpm - truth), 0.5), 3) AS median, count(*) FILTER (abs(rpm - truth) / truth * 100 <= 10) AS within_10 FROM l GROUP BY 1, 2"""


def club_speed_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to read club speed: how they differ, and how often each gives a smash above 1.42."""
    old = F.nullif(F.col("club_speed"), F.lit(0.0))
    new = F.when(F.col("shot_number") % 13 != 0, F.col("ball_speed") * (0.66 + 0.02 * (F.col("shot_number") % 10)))
    s = lens(spark, sf_dir, "shots").select("club", "ball_speed", old.alias("old"), new.alias("new"))
    s = s.withColumn("d", F.col("new") - F.col("old"))
    stats = s.groupBy("club").agg(
        F.count("d").alias("n"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.min("d"), 4).alias("least"), F.round(F.max("d"), 4).alias("most"),
        F.count_if(F.col("ball_speed") / F.col("old") > 1.42).alias("high_old"), F.count_if(F.col("ball_speed") / F.col("new") > 1.42).alias("high_new"),
    )
    return stats.join(medians(s, ["club"], "d", "median", 4), "club", "left")


AB_SQL = SHOTS + """, s AS (SELECT club, ball_speed AS b, nullif(club_speed, 0) AS o, CASE WHEN shot_number % 13 <> 0 THEN ball_speed * (0.66::DOUBLE + 0.02::DOUBLE * (shot_number % 10)) END AS w FROM shots)
SELECT club, count(w - o) AS n, round(avg(w - o), 4) AS mean, round(quantile_cont(w - o, 0.5), 4) AS median, round(min(w - o), 4) AS least, round(max(w - o), 4) AS most,
count(*) FILTER (b / o > 1.42::DOUBLE) AS high_old, count(*) FILTER (b / w > 1.42::DOUBLE) AS high_new FROM s GROUP BY 1"""


def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a kind: medians and maxima of their peaks, the eight fullest bins (of equally full ones the lower), and counts of warnings."""
    r = lens(spark, sf_dir, "readings").withColumn("bin", F.floor("speed_mph"))
    w = F.array_compact(F.array(F.when(F.col("magnitude") < 5, F.lit("weak")), F.when(F.col("speed_mph") > 100, F.lit("fast"))))
    stats = r.groupBy("event_type").agg(F.count(F.lit(1)).alias("frames"), F.max("magnitude").alias("max_magnitude"))
    off = r.select("event_type", F.abs(F.col("speed_mph") - 50).alias("off"))
    stats = stats.join(medians(r, ["event_type"], "magnitude", "median_magnitude", 4), "event_type", "left").join(medians(off, ["event_type"], "off", "median_off", 4), "event_type", "left")
    bins = r.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "bin"))).where("place <= 8")
    tops = bins.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "bin", "n"))), lambda x: F.concat_ws("=", x["bin"].cast("string"), x["n"].cast("string"))), ",").alias("bins"))
    warned = named_counts(r.select("event_type", F.explode(w).alias("w")), ["event_type"], "w", "warnings")
    return stats.join(tops, "event_type").join(warned, "event_type", "left")


DIAGNOSTIC_SQL = READINGS + """, b AS (SELECT event_type, floor(speed_mph)::BIGINT AS bin, count(*) AS n FROM readings GROUP BY 1, 2),
t AS (SELECT event_type, string_agg(bin || '=' || n, ',' ORDER BY n DESC, bin) AS bins FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) AS p FROM b) WHERE p <= 8 GROUP BY 1),
w AS (SELECT event_type, string_agg(w || '=' || n, ',' ORDER BY w) AS warnings FROM (SELECT event_type, w, count(*) AS n FROM (SELECT event_type, 'weak' AS w FROM readings WHERE magnitude < 5 UNION ALL SELECT event_type, 'fast' FROM readings WHERE speed_mph > 100) GROUP BY 1, 2) GROUP BY 1)
SELECT r.event_type, count(*) AS frames, round(quantile_cont(magnitude, 0.5), 4) AS median_magnitude, max(magnitude) AS max_magnitude, round(quantile_cont(abs(speed_mph - 50), 0.5), 4) AS median_off, max(bins) AS bins, max(warnings) AS warnings
FROM readings r JOIN t USING (event_type) LEFT JOIN w USING (event_type) GROUP BY 1"""


def horizontal_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session and over all: sources of horizontal angles, share detected, percentiles, hits at the wall of 15 degrees, mean confidence of those found."""
    s = lens(spark, sf_dir, "shots").withColumn("source", F.when(F.col("launch_h").isNull(), "none").when(F.col("launch_confidence") >= 0.5, "radar").otherwise("estimated"))
    s = s.withColumn("part", F.explode(F.array(F.lit("all"), F.concat(F.lit("s"), (F.col("session_id") % 20).cast("string")))))
    stats = s.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count("launch_h") / F.count(F.lit(1)), 6).alias("rate"), F.count_if(F.abs("launch_h") >= 15).alias("wall"), F.round(F.avg(F.when(F.col("launch_h").isNotNull(), F.col("launch_confidence"))), 4).alias("confidence")
    )
    stats = stats.join(quantiles(s, ["part"], "launch_h", (0.1, 0.5, 0.9)), "part", "left")
    stats = stats.select("part", "n", "rate", *[F.round(F.col("q")[i], 4).alias(k) for i, k in enumerate(("p10", "p50", "p90"))], "wall", "confidence")
    return stats.join(named_counts(s, ["part"], "source", "sources"), "part")


HORIZONTAL_SQL = SHOTS + """, s AS (SELECT *, unnest(['all', 's' || session_id % 20]) AS part, CASE WHEN launch_h IS NULL THEN 'none' WHEN launch_confidence >= 0.5 THEN 'radar' ELSE 'estimated' END AS source FROM shots),
c AS (SELECT part, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM (SELECT part, source, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT part, count(*) AS n, round(count(launch_h) / count(*), 6) AS rate, round(quantile_cont(launch_h, 0.1), 4) AS p10, round(quantile_cont(launch_h, 0.5), 4) AS p50, round(quantile_cont(launch_h, 0.9), 4) AS p90,
count(*) FILTER (abs(launch_h) >= 15) AS wall, round(avg(launch_confidence) FILTER (launch_h IS NOT NULL), 4) AS confidence, max(sources) AS sources FROM s JOIN c USING (part) GROUP BY 1"""


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session's end line says: triggers accepted and rejected, errors, shots, and shots for each accepted reading (0 without any)."""
    r = lens(spark, sf_dir, "readings")
    accepted = (F.col("event_type") == "view") & (F.col("magnitude") >= 20)
    shots, taken = F.count_if(F.col("event_type") == "purchase"), F.count_if(accepted)
    return r.groupBy("session_id").agg(
        taken.alias("accepted"), F.count_if((F.col("event_type") == "view") & (F.col("magnitude") < 20)).alias("rejected"), F.count_if(F.col("event_type") == "error").alias("errors"), shots.alias("shots"),
        F.round(F.when(taken > 0, shots / taken).otherwise(0.0), 6).alias("shot_rate"),
    )


COUNTERS_SQL = READINGS + """SELECT session_id, count(*) FILTER (event_type = 'view' AND magnitude >= 20) AS accepted, count(*) FILTER (event_type = 'view' AND magnitude < 20) AS rejected, count(*) FILTER (event_type = 'error') AS errors,
count(*) FILTER (event_type = 'purchase') AS shots, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view' AND magnitude >= 20), 0), 0), 6) AS shot_rate FROM readings GROUP BY 1"""


def upload_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to upload: pushed, parked (and not pushed), and pending."""
    files = lens(spark, sf_dir, "readings").groupBy("session_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("pushed"), F.count_if(F.col("event_type") == "error").alias("tries"))
    pushed, parked = F.col("pushed") == 1, F.col("tries") >= 10
    return files.groupBy((F.col("session_id") % 3).alias("device")).agg(F.count(F.lit(1)).alias("total"), F.count_if(pushed).alias("pushed"), F.count_if(parked).alias("parked"), F.count_if(~pushed & ~parked).alias("pending"))


QUEUE_SQL = READINGS + """, f AS (SELECT session_id, bool_or(event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') >= 10 AS k FROM readings GROUP BY 1)
SELECT session_id % 3 AS device, count(*) AS total, count(*) FILTER (p) AS pushed, count(*) FILTER (k) AS parked, count(*) FILTER (NOT p AND NOT k) AS pending FROM f GROUP BY 1"""


def detections_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own detections (outbound) beside the module's (inbound): counts and maxima, 0 where there are none."""
    own = F.col("direction") == "outbound"
    top = lambda c, side: F.coalesce(F.max(F.when(side, F.abs(c))), F.lit(0.0))
    return lens(spark, sf_dir, "readings").groupBy("session_id", F.floor(F.col("seq") / 1000).alias("frame")).agg(
        F.count_if(own).alias("own"), F.count_if(~own).alias("module"), top("speed_mph", own).alias("own_speed"), top("speed_mph", ~own).alias("module_speed"), top("magnitude", own).alias("own_magnitude"), top("magnitude", ~own).alias("module_magnitude")
    )


COMPARED_SQL = READINGS + """SELECT session_id, floor(seq / 1000)::BIGINT AS frame, count(*) FILTER (direction = 'outbound') AS own, count(*) FILTER (direction <> 'outbound') AS module,
coalesce(max(abs(speed_mph)) FILTER (direction = 'outbound'), 0) AS own_speed, coalesce(max(abs(speed_mph)) FILTER (direction <> 'outbound'), 0) AS module_speed,
coalesce(max(abs(magnitude)) FILTER (direction = 'outbound'), 0) AS own_magnitude, coalesce(max(abs(magnitude)) FILTER (direction <> 'outbound'), 0) AS module_magnitude FROM readings GROUP BY 1, 2"""


def reflector_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles to a fixed reflector: mean, median, population deviation (0 for one), bounds, and its strength."""
    return lens(spark, sf_dir, "readings").where("direction = 'inbound'").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("speed_mph"), 5).alias("mean"), F.round(F.percentile("speed_mph", F.lit(0.5)), 5).alias("median"), F.round(F.stddev_pop("speed_mph"), 5).alias("sd"),
        F.min("speed_mph").alias("least"), F.max("speed_mph").alias("most"), F.round(F.avg("magnitude"), 5).alias("mean_snr"), F.round(F.percentile("magnitude", F.lit(0.5)), 5).alias("median_snr"),
    )


REFLECTOR_SQL = READINGS + """SELECT session_id, count(*) AS n, round(avg(speed_mph), 5) AS mean, round(quantile_cont(speed_mph, 0.5), 5) AS median, round(stddev_pop(speed_mph), 5) AS sd, min(speed_mph) AS least, max(speed_mph) AS most,
round(avg(magnitude), 5) AS mean_snr, round(quantile_cont(magnitude, 0.5), 5) AS median_snr FROM readings WHERE direction = 'inbound' GROUP BY 1"""


def onset_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's noise floor: the median of its first five peaks; and the first reading that is three times as strong."""
    w = Window.partitionBy("session_id").orderBy("us", "seq")
    r = lens(spark, sf_dir, "readings").withColumn("n", F.row_number().over(w))
    floor = r.groupBy("session_id").agg(F.percentile(F.when(F.col("n") <= 5, F.col("magnitude")), F.lit(0.5)).alias("floor"))
    onset = r.join(floor, "session_id").where((F.col("n") > 5) & (F.col("magnitude") > 3 * F.col("floor"))).groupBy("session_id").agg(F.min("n").cast("long").alias("onset"))
    return floor.join(onset, "session_id", "left").select("session_id", F.round("floor", 5).alias("floor"), "onset")


ONSET_SQL = READINGS + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, seq) AS n FROM readings), f AS (SELECT session_id, quantile_cont(magnitude, 0.5) FILTER (n <= 5) AS floor FROM n GROUP BY 1)
SELECT session_id, round(max(floor), 5) AS floor, min(n) FILTER (n > 5 AND magnitude > 3 * floor) AS onset FROM n JOIN f USING (session_id) GROUP BY 1"""


def variant_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live, strict and anchored readings of the same frames: share found, mean, population deviation, bounds, and the largest jump between frames that follow one another."""
    r = lens(spark, sf_dir, "readings")
    ways = {"live": F.lit(True), "strict": F.col("magnitude") >= 50, "anchored": F.abs(F.col("speed_mph") - 40) <= 30}
    long = r.select("session_id", "us", "seq", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.when(v, F.col("speed_mph")).alias("x")) for k, v in ways.items()])).alias("v")).select("session_id", "us", "seq", "v.*")
    w = Window.partitionBy("session_id", "variant").orderBy("us", "seq")
    long = long.withColumn("jump", F.abs(F.col("x") - F.lag("x").over(w)))
    return long.groupBy("session_id", "variant").agg(
        F.round(F.count("x") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("x"), 7).alias("mean"), F.round(F.stddev_pop("x"), 7).alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.max("jump"), 4).alias("jump")
    )


VARIANTS_SQL = READINGS + """, l AS (SELECT session_id, us, seq, unnest(['live', 'strict', 'anchored']) AS variant, unnest([speed_mph, CASE WHEN magnitude >= 50 THEN speed_mph END, CASE WHEN abs(speed_mph - 40) <= 30 THEN speed_mph END]) AS x FROM readings),
j AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY session_id, variant ORDER BY us, seq)) AS j FROM l)
SELECT session_id, variant, round(count(x) / count(*), 6) AS rate, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS sd, min(x) AS least, max(x) AS most, round(max(j), 4) AS jump FROM j GROUP BY 1, 2"""


def event_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module detections by event (a tenth of a session's lines): plain means of angle and distance, and the strongest."""
    return lens(spark, sf_dir, "readings").groupBy("session_id", F.floor(F.col("seq") / 500).alias("event")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("speed_mph"), 5).alias("angle"), F.round(F.avg(F.col("magnitude") / 20), 5).alias("distance"), F.max("magnitude").alias("strongest")
    )


MEANS_SQL = READINGS + "SELECT session_id, floor(seq / 500)::BIGINT AS event, count(*) AS n, round(avg(speed_mph), 5) AS angle, round(avg(magnitude / 20), 5) AS distance, max(magnitude) AS strongest FROM readings GROUP BY 1, 2"


def club_speed_picks(spark: SparkSession, sf_dir: str, window_us: int = 100 * 3600 * 1_000_000) -> DataFrame:
    """Club speed before a session's ball (its fastest outbound reading): of outbound readings in the window before it, at 67 to 85 % of its
    speed, the strongest; and the median of those with 30 % of the strongest's magnitude. An hour stands for a millisecond."""
    r = lens(spark, sf_dir, "readings").where("direction = 'outbound'")
    ball = r.groupBy("session_id").agg(F.max(F.struct("speed_mph", (-F.col("us")).alias("m"))).alias("b")).select("session_id", F.col("b.speed_mph").alias("ball"), (-F.col("b.m")).alias("ball_us"))
    share = F.col("speed_mph") / F.col("ball")
    c = r.join(ball, "session_id").where((F.col("us") <= F.col("ball_us")) & (F.col("ball_us") - F.col("us") <= window_us) & share.between(0.67, 0.85) & (F.abs(F.col("speed_mph") - F.col("ball")) > 1))
    c = c.withColumn("top", F.max("magnitude").over(Window.partitionBy("session_id")))
    pick = F.max(F.struct("magnitude", (-F.col("us")).alias("m"), (-F.col("seq")).alias("q"), "speed_mph"))["speed_mph"]
    found = c.groupBy("session_id").agg(pick.alias("club_speed"), F.round(F.percentile(F.when(F.col("magnitude") >= 0.3 * F.col("top"), F.col("speed_mph")), F.lit(0.5)), 5).alias("median_speed"))
    return ball.join(found, "session_id", "left").select("session_id", "ball", "club_speed", "median_speed")


PICKS_SQL = READINGS + """, r AS (SELECT * FROM readings WHERE direction = 'outbound'), b AS (SELECT session_id, max(speed_mph) AS ball, arg_max(us, (speed_mph, -us)) AS ball_us FROM r GROUP BY 1),
c AS (SELECT r.*, max(magnitude) OVER (PARTITION BY r.session_id) AS top FROM r JOIN b USING (session_id) WHERE us <= ball_us AND ball_us - us <= 360000000000 AND speed_mph / ball BETWEEN 0.67::DOUBLE AND 0.85::DOUBLE AND abs(speed_mph - ball) > 1)
SELECT b.session_id, max(ball) AS ball, arg_max(speed_mph, (magnitude, -us, -seq)) AS club_speed, round(quantile_cont(speed_mph, 0.5) FILTER (magnitude >= 0.3 * top), 5) AS median_speed FROM b LEFT JOIN c USING (session_id) GROUP BY 1"""

QUERIES = {
    "model_errors": (model_errors, MODEL_SQL),
    "replay_summary": (replay_summary, REPLAY_SQL),
    "geometry_summary": (geometry_summary, GEOMETRY_SQL),
    "readiness_counts": (readiness_counts, READINESS_SQL),
    "spin_replay_summary": (spin_replay_summary, SPIN_SQL),
    "club_speed_ab": (club_speed_ab, AB_SQL),
    "diagnostic_summary": (diagnostic_summary, DIAGNOSTIC_SQL),
    "horizontal_diagnosis": (horizontal_diagnosis, HORIZONTAL_SQL),
    "session_counters": (session_counters, COUNTERS_SQL),
    "upload_queue": (upload_queue, QUEUE_SQL),
    "detections_compared": (detections_compared, COMPARED_SQL),
    "reflector_calibration": (reflector_calibration, REFLECTOR_SQL),
    "onset_floor": (onset_floor, ONSET_SQL),
    "variant_replays": (variant_replays, VARIANTS_SQL),
    "event_means": (event_means, MEANS_SQL),
    "club_speed_picks": (club_speed_picks, PICKS_SQL),
}
