"""Joins that a session's data need: by time band, as of, by absence, by position, over parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses

READINGS = with_lenses("readings")
HOUR = 3_600_000_000


def interval_join(points: DataFrame, events: DataFrame, keys: list[str], point_at: str, event_at: str, before: int, after: int) -> DataFrame:
    """Points in [event - before, event + after], both ends inside, with their events.

    Time is cut into buckets of the window's length; an event goes to the two or three buckets that its window touches, so
    the join is an equi-join whose skew Spark can split, and no pair is compared that lies further apart than two buckets.
    """
    width = before + after + 1
    bucket = lambda at: F.floor(at / width)
    spread = events.withColumn("__b", F.explode(F.sequence(bucket(F.col(event_at) - before), bucket(F.col(event_at) + after))))
    near = points.withColumn("__b", bucket(F.col(point_at)))
    inside = (F.col(point_at) >= F.col(event_at) - before) & (F.col(point_at) <= F.col(event_at) + after)
    return near.join(spread, [*keys, "__b"]).where(inside).drop("__b")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lens(spark, sf_dir, "readings").where("event_type = 'purchase'")
    return hits.select("session_id", F.col("seq").alias("shot"), F.col("us").alias("shot_us"))


def interval_join_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from six hours before to three quarters of one after each shot of the session."""
    joined = interval_join(lens(spark, sf_dir, "readings"), _events(spark, sf_dir), ["session_id"], "us", "shot_us", 6 * HOUR, 3 * HOUR // 4)
    return joined.groupBy("session_id", "shot").agg(F.count(F.lit(1)).alias("frames"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("speed_mph").alias("peak"))


INTERVAL_SQL = READINGS + """SELECT s.session_id, s.seq AS shot, count(*) AS frames, min(r.us) AS first_us, max(r.us) AS last_us, max(r.speed_mph) AS peak
FROM readings r JOIN readings s ON s.session_id = r.session_id AND s.event_type = 'purchase' AND r.us BETWEEN s.us - 21600000000 AND s.us + 2700000000 GROUP BY 1, 2"""


def last_valid(points: DataFrame, keys: list[str], order: list[str], value: Column, valid: Column, at: str, ttl: int) -> DataFrame:
    """``points`` with the latest valid value up to each, if it is at most ``ttl`` old, as (value, value_at)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(valid, F.struct(value.alias("v"), F.col(at).alias("t"))), ignorenulls=True).over(w)
    fresh = F.col(at) - F.col("__last.t") <= ttl
    return points.withColumn("__last", last).withColumn("value", F.when(fresh, F.col("__last.v"))).withColumn("value_at", F.when(fresh, F.col("__last.t"))).drop("__last")


def last_valid_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last clock reading of good quality before each click, no older than twelve hours."""
    r = lens(spark, sf_dir, "readings")
    good = (F.col("event_type") == "signup") & (F.col("magnitude") < 60)
    out = last_valid(r, ["session_id"], ["us", "seq"], F.col("speed_mph"), good, "us", 12 * HOUR)
    return out.where("event_type = 'click'").select("session_id", "seq", "value", ((F.col("us") - F.col("value_at")) / 1000).alias("age_ms"))


ASOF_SQL = READINGS + """, g AS (SELECT *, max(CASE WHEN event_type = 'signup' AND magnitude < 60 THEN {'us': us, 'seq': seq, 'v': speed_mph} END) OVER (PARTITION BY session_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS l FROM readings)
SELECT session_id, seq, CASE WHEN us - l.us <= 43200000000 THEN l.v END AS value, CASE WHEN us - l.us <= 43200000000 THEN (us - l.us) / 1000 END AS age_ms FROM g WHERE event_type = 'click'"""


def semi_missing_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without an open line, and those with one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    sides = [orders.join(lines, "o_orderkey", how).withColumn("state", F.lit(name)) for how, name in (("left_semi", "has_buffer"), ("left_anti", "missing_buffer"))]
    return sides[0].unionByName(sides[1]).groupBy("o_orderstatus", "state").agg(F.count(F.lit(1)).alias("n"))


SEMI_SQL = """SELECT o_orderstatus, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') THEN 'has_buffer' ELSE 'missing_buffer' END AS state, count(*) AS n FROM orders GROUP BY 1, 2"""


def anti_pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are neither pushed nor parked."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    files = read("customer").select(F.col("c_custkey").alias("file"))
    pushed = read("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("file"))
    parked = read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("file"))
    return files.join(pushed.unionByName(parked), "file", "left_anti")


ANTI_SQL = "SELECT c_custkey AS file FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"


def bundle_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session the last entry of each type, side by side."""
    r = lens(spark, sf_dir, "readings")
    last = F.max(F.struct("us", "seq", "speed_mph"))
    cols = [F.max(F.when(F.col("event_type") == t, F.struct("us", "seq", "speed_mph")))["speed_mph"].alias(t) for t in ("click", "view", "purchase", "signup", "error")]
    return r.groupBy("session_id").agg(*cols, last["seq"].alias("last_seq"))


BUNDLE_SQL = READINGS + "SELECT session_id, " + ", ".join(f"arg_max(speed_mph, (us, seq)) FILTER (event_type = '{t}') AS \"{t}\"" for t in ("click", "view", "purchase", "signup", "error")) + ", arg_max(seq, (us, seq)) AS last_seq FROM readings GROUP BY 1"


def first_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots without a spin axis borrow it from the first shot of the same club, speed and launch, both to the nearest ten."""
    s = lens(spark, sf_dir, "shots")
    key = [F.col("club"), F.bround(F.col("ball_speed") / 10).alias("k_speed"), F.bround(F.col("launch_v") / 10).alias("k_launch")]
    axis = F.round(F.col("face_deg") - F.col("path_deg"), 1)
    keyed = s.select("shot_number", *key, axis.alias("axis"))
    donors = keyed.where("axis IS NOT NULL").groupBy("club", "k_speed", "k_launch").agg(F.min(F.struct("shot_number", "axis")).alias("d"))
    lacking = keyed.where("axis IS NULL AND k_launch IS NOT NULL").drop("axis")
    return lacking.join(donors, ["club", "k_speed", "k_launch"], "left").select("shot_number", F.col("d.axis").alias("axis"), F.col("d.shot_number").alias("donor"))


FIRST_SQL = with_lenses("shots") + """, k AS (SELECT shot_number, club, round_even(ball_speed / 10, 0) AS a, round_even(launch_v / 10, 0) AS b, round(face_deg - path_deg, 1) AS axis FROM shots),
d AS (SELECT club, a, b, arg_min(axis, shot_number) AS axis, min(shot_number) AS donor FROM k WHERE axis IS NOT NULL GROUP BY 1, 2, 3)
SELECT k.shot_number, d.axis, d.donor FROM k LEFT JOIN d ON k.club = d.club AND k.a = d.a AND k.b = d.b WHERE k.axis IS NULL AND k.b IS NOT NULL"""


def cross_param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shot judged under each of nine settings: detected, error, rank. The settings are nine rows, which go to all tasks."""
    grid = spark.createDataFrame([(s, c) for s in (20.0, 40.0, 60.0) for c in (0.2, 0.4, 0.6)], "spread double, floor double")
    s = lens(spark, sf_dir, "shots").where("launch_v IS NOT NULL AND launch_h IS NOT NULL").select("ball_speed", "launch_v", "launch_h", "launch_confidence")
    hit = (F.abs(F.col("ball_speed") - 120) <= F.col("spread")) & (F.col("launch_confidence") >= F.col("floor"))
    e = F.when(hit, F.abs(F.col("launch_v") - F.abs("launch_h")))
    return s.crossJoin(F.broadcast(grid)).groupBy("spread", "floor").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(hit).alias("detected"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("rate"),
        F.round(F.avg(e), 4).alias("mae"),
        F.max(F.round(e, 4)).alias("max_error"),
        F.count_if(e <= 0.5).alias("within_half"),
    )


SWEEP_SQL = with_lenses("shots") + """, p AS (SELECT * FROM (VALUES (20.0::DOUBLE), (40.0), (60.0)) a(spread), (VALUES (0.2::DOUBLE), (0.4), (0.6)) b(floor)),
x AS (SELECT spread, floor, abs(ball_speed - 120) <= spread AND launch_confidence >= floor AS hit, abs(launch_v - abs(launch_h)) AS e FROM shots, p WHERE launch_v IS NOT NULL AND launch_h IS NOT NULL)
SELECT spread, floor, count(*) AS attempted, count(*) FILTER (hit) AS detected, round(count(*) FILTER (hit) / count(*), 6) AS rate, round(avg(e) FILTER (hit), 4) AS mae,
max(round(e, 4)) FILTER (hit) AS max_error, count(*) FILTER (hit AND e <= 0.5) AS within_half FROM x GROUP BY 1, 2"""


def rank_param_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from the best on: enough coverage first, then rate, largest error, mean error (missing ones last)."""
    s = cross_param_sweep(spark, sf_dir)
    last = F.lit(float("inf"))
    order = Window.orderBy(F.col("rate") < 0.2, F.desc("rate"), F.coalesce("max_error", last), F.coalesce("mae", last), "spread", "floor")  # nine rows
    return s.select("spread", "floor", F.row_number().over(order).cast("long").alias("place"))


RANK_SQL = f"SELECT spread, floor, row_number() OVER (ORDER BY rate < 0.2, rate DESC, coalesce(max_error, 1e308), coalesce(mae, 1e308), spread, floor) AS place FROM ({SWEEP_SQL})"


def topk_per_frame(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The k readings of each session and type with the best score."""
    score = F.col("magnitude") * 2 + F.col("speed_mph")
    w = Window.partitionBy("session_id", "event_type").orderBy(F.desc("score"), "seq")
    r = lens(spark, sf_dir, "readings").withColumn("score", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return r.select("session_id", "event_type", "seq", F.round("score", 4).alias("score"), F.col("place").cast("long").alias("place"))


TOPK_SQL = READINGS + """SELECT session_id, event_type, seq, round(score, 4) AS score, place FROM (SELECT *, magnitude * 2 + speed_mph AS score, row_number() OVER (PARTITION BY session_id, event_type ORDER BY magnitude * 2 + speed_mph DESC, seq) AS place FROM readings) WHERE place <= 3"""


def theta_pair_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a session's kept candidates, of different types, the second later: at most fifteen candidates a session."""
    t = topk_per_frame(spark, sf_dir).join(lens(spark, sf_dir, "readings").select("session_id", "seq", "us"), ["session_id", "seq"])
    a, b = (t.select("session_id", *[F.col(c).alias(f"{c}_{m}") for c in ("event_type", "seq", "us", "score")]) for m in "ab")
    pairs = a.join(b, "session_id").where("event_type_a <> event_type_b AND us_b > us_a")
    return pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max(F.col("score_a") + F.col("score_b")), 4).alias("best"))


THETA_SQL = READINGS + """, t AS (SELECT * FROM (SELECT *, magnitude * 2 + speed_mph AS score, row_number() OVER (PARTITION BY session_id, event_type ORDER BY magnitude * 2 + speed_mph DESC, seq) AS place FROM readings) WHERE place <= 3)
SELECT a.session_id, count(*) AS pairs, round(max(round(a.score, 4) + round(b.score, 4)), 4) AS best FROM t a JOIN t b ON a.session_id = b.session_id AND a.event_type <> b.event_type AND b.us > a.us GROUP BY 1"""


def impact_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fast outbound reading of a session, and the latest slower one in the twelve hours before it."""
    r = lens(spark, sf_dir, "readings").where("direction = 'outbound'")
    ball = r.where("speed_mph >= 60").groupBy("session_id").agg(F.min(F.struct("us", "seq", "speed_mph")).alias("b"))
    near = r.join(ball, "session_id").where((F.col("us") < F.col("b.us")) & (F.col("us") >= F.col("b.us") - 12 * HOUR) & (F.col("speed_mph") / F.col("b.speed_mph")).between(0.1, 0.85))
    club = near.groupBy("session_id").agg(F.max(F.struct("us", "magnitude", "seq", "speed_mph")).alias("c"))
    jump = F.col("b.speed_mph") - F.col("c.speed_mph")
    reason = F.when(F.col("c").isNull(), "no_club_transition_candidate").when(jump < 15, "speed_delta_below_threshold")
    return ball.join(club, "session_id", "left").select(
        "session_id",
        F.col("b.seq").alias("ball_seq"),
        F.col("c.seq").alias("club_seq"),
        F.when(reason.isNull(), (F.col("b.us") + F.col("c.us")) / 2).alias("impact_us"),
        reason.alias("fallback"),
    )


IMPACT_SQL = READINGS + """, o AS (SELECT * FROM readings WHERE direction = 'outbound'), b AS (SELECT session_id, min({'us': us, 'seq': seq, 'v': speed_mph}) AS b FROM o WHERE speed_mph >= 60 GROUP BY 1),
c AS (SELECT o.session_id, max({'us': us, 'm': magnitude, 'seq': seq, 'v': speed_mph}) AS c FROM o JOIN b ON o.session_id = b.session_id AND us < b.b.us AND us >= b.b.us - 43200000000 AND speed_mph / b.b.v BETWEEN 0.1 AND 0.85 GROUP BY 1)
SELECT b.session_id, b.b.seq AS ball_seq, c.c.seq AS club_seq, CASE WHEN b.b.v - c.c.v >= 15 THEN (b.b.us + c.c.us) / 2 END AS impact_us,
CASE WHEN c.c IS NULL THEN 'no_club_transition_candidate' WHEN b.b.v - c.c.v < 15 THEN 'speed_delta_below_threshold' END AS fallback FROM b LEFT JOIN c ON b.session_id = c.session_id"""


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sources with different columns, absent ones null."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    a = read("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = read("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("nation", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


UNION_SQL = """SELECT nation, segment, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL BY NAME SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier) GROUP BY 1, 2"""

QUERIES = {
    "interval_join_frames": (interval_join_frames, INTERVAL_SQL),
    "last_valid_asof": (last_valid_asof, ASOF_SQL),
    "semi_missing_buffers": (semi_missing_buffers, SEMI_SQL),
    "anti_pending_files": (anti_pending_files, ANTI_SQL),
    "bundle_last_wins": (bundle_last_wins, BUNDLE_SQL),
    "first_wins_lookup": (first_wins_lookup, FIRST_SQL),
    "cross_param_sweep": (cross_param_sweep, SWEEP_SQL),
    "rank_param_sets": (rank_param_sets, RANK_SQL),
    "topk_per_frame": (topk_per_frame, TOPK_SQL),
    "theta_pair_enumeration": (theta_pair_enumeration, THETA_SQL),
    "impact_transition": (impact_transition, IMPACT_SQL),
    "union_by_name": (union_by_name, UNION_SQL),
}
