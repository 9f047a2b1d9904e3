"""Paths and rule stacks over detections, and calibration across sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses
from swinglake.functions.tracks import best_path, lingering, path_metrics, path_quality, pick_worth
from swinglake.operators.joins import interval_join

READINGS = with_lenses("readings")
MINUTE = 60_000_000


# Where a ball's detections lie (m), and the time looked at after an event (ms).
WITHIN_M, AFTER_MS = (0.6, 5.2), 260.0


def _events_with_hits(spark: SparkSession, sf_dir: str, before_hours: int, after_hours: int) -> DataFrame:
    """Purchases as events, each with the readings around it in order as an array ``all``; an hour stands for 10 ms.

    What a sensor reports around an event is bounded by its frames; so is this array by the window.
    """
    r = lens(spark, sf_dir, "readings")
    events = r.where("event_type = 'purchase'").select("session_id", F.col("seq").alias("event"), F.col("us").alias("event_us"), F.when(F.col("seq") % 3 != 0, F.col("magnitude")).alias("ball_ms"))
    hits = r.where("event_type <> 'purchase'").select("session_id", "seq", "us", "speed_mph", F.col("magnitude").alias("strength"))
    near = interval_join(hits, events, ["session_id"], "us", "event_us", before_hours * 60 * MINUTE, after_hours * 60 * MINUTE)
    ms = (F.col("us") - F.col("event_us")).cast("double") / (360 * 1e6)
    hit = F.struct(F.col("seq").alias("frame"), ms.alias("ms"), (0.6 + F.col("speed_mph") / 60).alias("distance"), (F.col("strength") / 5).alias("angle"), (1500 + F.col("strength") * 20).alias("magnitude"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", hit.alias("hit")))), lambda x: x["hit"])
    return near.groupBy("session_id", "event").agg(listed.alias("all"), F.first("ball_ms").alias("ball_ms"))


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path through what follows each purchase within 26 hours (an hour stands for 10 ms), given what was there in the hours before.

    An event's detections are an array of bounded length, that of its window; the fold over it runs in the JVM.
    """
    found = _events_with_hits(spark, sf_dir, 26, 26)
    found = found.withColumn("hits", F.filter("all", lambda h: h["ms"] >= 0)).withColumn("best", best_path(F.col("hits"), F.filter("all", lambda h: h["ms"] < 0)))
    return found.select(
        "session_id", "event", F.size("hits").alias("hits"), F.coalesce(F.size("best.path"), F.lit(0)).alias("points"), F.round("best.score", 6).alias("score"), F.element_at("best.path", -1)["frame"].alias("last")
    )


def judged_events(events: DataFrame) -> DataFrame:
    """Events (all, ball_ms) with ``path``, ``score``, ``metrics``, ``left`` (what lingers), ``worth`` and ``quality``; events without a detection are left out."""
    inside = lambda h: (h["ms"] >= 0) & (h["ms"] <= AFTER_MS) & h["distance"].between(*WITHIN_M)
    found = events.withColumn("hits", F.filter("all", inside)).where(F.size("hits") > 0)
    found = found.withColumn("best", best_path(F.col("hits"), F.filter("all", lambda h: h["ms"] < 0)))
    found = found.withColumns({"path": F.col("best.path"), "score": F.col("best.score")}).withColumn("metrics", path_metrics(F.col("path")))
    found = found.withColumn("left", lingering(F.col("path"), F.col("all")))
    return found.withColumns({"worth": pick_worth(F.col("score"), F.col("metrics"), F.col("left"), F.col("ball_ms")), "quality": path_quality(F.col("metrics"), F.col("left"))}).drop("best", "hits")


def event_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session's events the one whose path is the likeliest shot, the first of equal ones, with its shape and quality."""
    found = judged_events(_events_with_hits(spark, sf_dir, 18, 40))
    row = F.struct("event", "score", "worth", "left", "quality", "metrics")
    picked = found.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.max_by(row, F.struct("worth", -F.col("event"))).alias("p"))
    return picked.select(
        "session_id", "events", "p.event", F.round("p.score", 6).alias("score"), F.round("p.worth", 6).alias("worth"), "p.left", "p.quality", "p.metrics.points", F.round("p.metrics.gain_m", 6).alias("gain_m"), F.round("p.metrics.steady", 6).alias("steady")
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens(spark, sf_dir, "readings").select(
        "session_id",
        "seq",
        (F.col("seq") * 7 % 120).cast("double").alias("ms"),
        (F.col("seq") * 13 % 80).alias("bin_error"),
        (F.col("magnitude") / 10).alias("snr"),
        F.col("speed_mph").alias("angle"),
        (F.col("event_type") == "error").alias("weak"),
    )


def vertical_rule_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that set a session's angle: an anchor and, where the bearing rises, one gated neighbour."""
    c = _candidates(spark, sf_dir)
    fits = (F.col("bin_error") <= 50) & (~F.col("weak") | (F.col("snr") >= 3))
    c = c.withColumn("primary", F.col("ms").between(20, 100) & fits).withColumn("early", (F.col("ms") >= 5) & (F.col("ms") < 20) & fits)
    anchors = c.where("primary AND NOT weak").groupBy("session_id").agg(F.min(F.struct("bin_error", (-F.col("snr")).alias("s"), "seq")).alias("a")).select("session_id", F.col("a.seq").alias("anchor"))

    def neighbours(pool: DataFrame, mark: str) -> DataFrame:
        w = Window.partitionBy("session_id").orderBy("seq")
        row = F.struct("seq", "snr", "angle", "weak")
        near = pool.withColumn("p", F.lag(row).over(w)).withColumn("n", F.lead(row).over(w)).join(anchors, "session_id").where("seq = anchor")
        loud = lambda x: F.col(f"{x}.snr") >= F.when(F.col(f"{x}.weak"), 3.0).otherwise(F.greatest(F.lit(2.0), 0.5 * F.col("snr")))
        before = F.coalesce(loud("p") & (F.col("angle") > F.col("p.angle")), F.lit(False))
        after = F.coalesce(loud("n") & (F.col("n.angle") > F.col("angle")), F.lit(False))
        return near.select("session_id", "anchor", F.when(before, F.col("p.seq")).when(after, F.col("n.seq")).alias(mark))

    first = neighbours(c.where("primary"), "partner")
    second = neighbours(c.where("primary OR early"), "early_partner")
    return first.join(second.drop("anchor"), "session_id").select("session_id", "anchor", F.coalesce("partner", "early_partner").alias("partner"), F.col("partner").isNull().alias("looked_early"))


RULES_SQL = READINGS + """, c AS (SELECT session_id, seq, (seq * 7 % 120)::DOUBLE AS ms, seq * 13 % 80 AS bin_error, magnitude / 10 AS snr, speed_mph AS angle, event_type = 'error' AS weak FROM readings),
g AS (SELECT *, ms BETWEEN 20 AND 100 AND bin_error <= 50 AND (NOT weak OR snr >= 3) AS prim, ms >= 5 AND ms < 20 AND bin_error <= 50 AND (NOT weak OR snr >= 3) AS early FROM c),
a AS (SELECT session_id, arg_min(seq, (bin_error, -snr, seq)) AS anchor FROM g WHERE prim AND NOT weak GROUP BY 1),
n AS (SELECT 1 AS k, session_id, seq, snr, angle, lag({'q': seq, 's': snr, 'a': angle, 'w': weak}) OVER w AS p, lead({'q': seq, 's': snr, 'a': angle, 'w': weak}) OVER w AS x FROM g WHERE prim WINDOW w AS (PARTITION BY session_id ORDER BY seq)
UNION ALL SELECT 2, session_id, seq, snr, angle, lag({'q': seq, 's': snr, 'a': angle, 'w': weak}) OVER w, lead({'q': seq, 's': snr, 'a': angle, 'w': weak}) OVER w FROM g WHERE prim OR early WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
r AS (SELECT k, n.session_id, anchor, CASE WHEN p.s >= CASE WHEN p.w THEN 3 ELSE greatest(2, 0.5 * snr) END AND angle > p.a THEN p.q
WHEN x.s >= CASE WHEN x.w THEN 3 ELSE greatest(2, 0.5 * snr) END AND x.a > angle THEN x.q END AS q FROM n JOIN a ON n.session_id = a.session_id AND n.seq = a.anchor)
SELECT r.session_id, r.anchor, coalesce(r.q, e.q) AS partner, r.q IS NULL AS looked_early FROM r JOIN r e ON r.session_id = e.session_id AND r.k = 1 AND e.k = 2"""


def leave_one_session_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proportional fit of smash on all other sessions, and its error on the one left out: sums less the session's own."""
    s = lens(spark, sf_dir, "shots").where("club_speed > 0")
    own = s.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("club_speed") * F.col("ball_speed")).alias("sxy"),
        F.sum(F.col("club_speed") * F.col("club_speed")).alias("sxx"),
        F.sum(F.col("ball_speed") * F.col("ball_speed")).alias("syy"),
    )
    whole = own.agg(F.sum("sxy").alias("txy"), F.sum("sxx").alias("txx"))  # one row
    k = F.try_divide(F.col("txy") - F.col("sxy"), F.col("txx") - F.col("sxx"))
    fit = own.crossJoin(F.broadcast(whole)).withColumn("k", k)
    rmse = F.sqrt(F.greatest(F.col("syy") - 2 * F.col("k") * F.col("sxy") + F.col("k") * F.col("k") * F.col("sxx"), F.lit(0.0)) / F.col("n"))
    return fit.select("session_id", "n", F.round("k", 6).alias("slope"), F.round(rmse, 4).alias("rmse"))


LOSO_SQL = with_lenses("shots") + """, o AS (SELECT * FROM shots WHERE club_speed > 0), t AS (SELECT sum(club_speed * ball_speed) AS xy, sum(club_speed * club_speed) AS xx FROM o),
k AS (SELECT session_id, ((SELECT xy FROM t) - sum(club_speed * ball_speed)) / ((SELECT xx FROM t) - sum(club_speed * club_speed)) AS k FROM o GROUP BY 1)
SELECT o.session_id, count(*) AS n, round(max(k), 6) AS slope, round(sqrt(avg(pow(ball_speed - k * club_speed, 2))), 4) AS rmse FROM o JOIN k ON o.session_id = k.session_id GROUP BY 1"""


def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wrapped value carried forward: a period is added where it falls by more than half of one, taken where it rises so."""
    w = Window.partitionBy("session_id").orderBy("us", "seq")
    r = lens(spark, sf_dir, "readings").select("session_id", "seq", "us", F.col("magnitude").alias("v"))
    d = F.col("v") - F.lag("v").over(w)
    turn = F.when(d < -50, 1).when(d > 50, -1).otherwise(0)
    r = r.withColumn("t", turn)
    return r.select("session_id", "seq", (F.col("v") + 100 * F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("unwrapped"))


UNWRAP_SQL = READINGS + """, d AS (SELECT *, magnitude - lag(magnitude) OVER (PARTITION BY session_id ORDER BY us, seq) AS d FROM readings)
SELECT session_id, seq, magnitude + 100 * sum(CASE WHEN d < -50 THEN 1 WHEN d > 50 THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS unwrapped FROM d"""

QUERIES = {
    "event_paths": (event_paths, None),
    "event_picks": (event_picks, None),
    "vertical_rule_stack": (vertical_rule_stack, RULES_SQL),
    "leave_one_session_out": (leave_one_session_out, LOSO_SQL),
    "phase_unwrap": (phase_unwrap, UNWRAP_SQL),
}
