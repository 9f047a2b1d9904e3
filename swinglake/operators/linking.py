"""Rows that belong together: by what stood before, by position, by key; and the best or first few of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses
from swinglake.operators.sessions import gap_groups

READINGS, SHOTS = with_lenses("readings"), with_lenses("shots")


def buffers_before_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shot (a purchase), the last buffer of each orientation on an earlier line of its session, and how many came since the shot before.

    One window over a session's lines finds them all: nothing is joined.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = lens(spark, sf_dir, "readings")
    kinds = {"vertical": "view", "horizontal": "click"}
    last = [F.last(F.when(F.col("event_type") == kind, F.col("seq")), ignorenulls=True).over(before).alias(name) for name, kind in kinds.items()]
    earlier = F.last(F.when(F.col("event_type") == "purchase", F.col("seq")), ignorenulls=True).over(before).alias("earlier")
    return r.select("session_id", "seq", "event_type", *last, earlier).where("event_type = 'purchase'").select(
        "session_id", "seq", "vertical", "horizontal", F.coalesce(F.col("vertical") > F.coalesce("earlier", F.lit(-1)), F.lit(False)).alias("fresh")
    )


BUFFERS_SQL = READINGS + """SELECT s.session_id, s.seq, max(b.seq) FILTER (b.event_type = 'view') AS vertical, max(b.seq) FILTER (b.event_type = 'click') AS horizontal,
coalesce(max(b.seq) FILTER (b.event_type = 'view') > coalesce(max(b.seq) FILTER (b.event_type = 'purchase'), -1), false) AS fresh
FROM readings s LEFT JOIN readings b ON b.session_id = s.session_id AND b.seq < s.seq WHERE s.event_type = 'purchase' GROUP BY 1, 2"""


def shot_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison's rows with the details of their shot; where there are none, the detail's defaults."""
    d = lens(spark, sf_dir, "device").select("l_orderkey", "l_linenumber", "ball_speed")
    s = lens(spark, sf_dir, "shots").where("shot_number % 3 <> 0").select(F.col("shot_number").alias("l_orderkey"), "spin_rpm", "num_frames", F.lit(True).alias("found"))
    return d.join(s, "l_orderkey", "left").select(
        "l_orderkey", "l_linenumber", "ball_speed", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("num_frames", F.lit(0)).alias("num_frames"), "spin_rpm"
    )


DETAILS_SQL = with_lenses("device", "shots") + """SELECT l_orderkey, l_linenumber, d.ball_speed, s.shot_number IS NOT NULL AS found, coalesce(s.num_frames, 0)::INT AS num_frames, s.spin_rpm
FROM device d LEFT JOIN shots s ON s.shot_number = d.l_orderkey AND s.shot_number % 3 <> 0"""


def sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th impact (a purchase) of a session with its n-th capture (a view); an impact without one stays."""
    r = lens(spark, sf_dir, "readings")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("us", "seq"))
    a = r.where("event_type = 'purchase'").select("session_id", F.col("seq").alias("impact"), nth.alias("n"))
    b = r.where("event_type = 'view'").select("session_id", F.col("seq").alias("capture"), nth.alias("n"))
    return a.join(b, ["session_id", "n"], "left").select("session_id", F.col("n").cast("long").alias("n"), "impact", "capture")


SEQUENCE_SQL = READINGS + """, n AS (SELECT session_id, seq, event_type, row_number() OVER (PARTITION BY session_id, event_type ORDER BY us, seq) AS n FROM readings)
SELECT a.session_id, a.n, a.seq AS impact, b.seq AS capture FROM n a LEFT JOIN n b ON a.session_id = b.session_id AND a.n = b.n AND b.event_type = 'view' WHERE a.event_type = 'purchase'"""


def impact_epoch(trigger_epoch: Column, impact_ms: Column, offset_ms: Column) -> Column:
    """When the ball was hit: the trigger's time, and how much later in the capture the impact lies than the trigger."""
    return trigger_epoch + (impact_ms - offset_ms) / 1000


def impact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots")
    at = impact_epoch(F.col("us").cast("double") / 1e6, F.col("num_frames").cast("double"), F.col("distance_ft") * 10)
    return s.select("shot_number", F.round(at, 3).alias("impact_s"))


IMPACT_SQL = SHOTS + "SELECT shot_number, round(us::DOUBLE / 1e6 + (num_frames::DOUBLE - distance_ft * 10) / 1000, 3) AS impact_s FROM shots"


def club_keys(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = ("driver", "pw", "putter")) -> DataFrame:
    """Clubs that either side has, of those that are wanted."""
    sides = [lens(spark, sf_dir, name).select("club").distinct() for name in ("device", "truth")]
    return sides[0].union(sides[1]).distinct().where(F.col("club").isin(*wanted))


CLUB_KEYS_SQL = with_lenses("device", "truth") + "(SELECT club FROM device UNION SELECT club FROM truth) INTERSECT SELECT unnest(['driver', 'pw', 'putter'])"


def reasons_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of reasons as one, each reason at its first place."""
    n = F.col("shot_number")
    name = lambda k: F.concat(F.lit("r"), (n % k).cast("string"))
    both = F.array_distinct(F.concat(F.array(name(2), name(3)), F.array(name(5), name(4))))
    return lens(spark, sf_dir, "shots").select("shot_number", F.array_join(both, ",").alias("reasons"))


REASONS_SQL = SHOTS + """, r AS (SELECT shot_number, ['r' || shot_number % 2, 'r' || shot_number % 3, 'r' || shot_number % 5, 'r' || shot_number % 4] AS r FROM shots)
SELECT shot_number, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS reasons FROM r"""


def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per shot of either source; where both have it, the recovery overrides the envelope."""
    s = lens(spark, sf_dir, "shots")
    envelope = s.where("spin_rpm IS NOT NULL").select("shot_number", F.col("spin_rpm").alias("e"))
    recovery = s.where("shot_number % 4 = 1").select("shot_number", (F.col("ball_speed") * 40).alias("r"))
    return envelope.join(recovery, "shot_number", "full_outer").select(
        "shot_number", F.round(F.coalesce("r", "e"), 3).alias("spin_rpm"), F.when(F.col("r").isNotNull(), "recovery").otherwise("envelope").alias("source")
    )


MERGE_SQL = SHOTS + """SELECT shot_number, round(CASE WHEN shot_number % 4 = 1 THEN ball_speed * 40 ELSE spin_rpm END, 3) AS spin_rpm, CASE WHEN shot_number % 4 = 1 THEN 'recovery' ELSE 'envelope' END AS source
FROM shots WHERE shot_number % 4 = 1 OR spin_rpm IS NOT NULL"""


def cluster_best_frames(spark: SparkSession, sf_dir: str, gap_us: int = 6 * 3600 * 1_000_000) -> DataFrame:
    """Of each cluster of readings in time the nearest (slowest) one, of equally near ones the strongest, then the first."""
    runs = gap_groups(lens(spark, sf_dir, "readings"), ["session_id"], "us", ["us", "seq"], gap_us, "run")
    best = F.min(F.struct("speed_mph", (-F.col("magnitude")).alias("m"), "seq"))
    return runs.groupBy("session_id", "run").agg(best.alias("b")).select("session_id", "run", F.col("b.seq").alias("seq"), F.col("b.speed_mph").alias("distance"), (-F.col("b.m")).alias("magnitude"))


BEST_FRAMES_SQL = READINGS + """, f AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY session_id ORDER BY us, seq) > 21600000000)::BIGINT, 0) AS o FROM readings),
r AS (SELECT *, (sum(o) OVER (PARTITION BY session_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM f)
SELECT session_id, run, seq, speed_mph AS distance, magnitude FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY speed_mph, magnitude DESC, seq) AS n FROM r) WHERE n = 1"""


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot's number in its session, in the order of time."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("us", "shot_number"))
    return lens(spark, sf_dir, "shots").select("session_id", "shot_number", nth.cast("long").alias("sequence_id"))


SEQUENCE_IDS_SQL = SHOTS + "SELECT session_id, shot_number, row_number() OVER (PARTITION BY session_id ORDER BY us, shot_number) AS sequence_id FROM shots"


def spin_candidates(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """The strongest peaks of each session, and behind them the selected one (its last reading) where it isn't among them."""
    w = Window.partitionBy("session_id")
    r = lens(spark, sf_dir, "readings").select("session_id", "seq", "magnitude", (F.col("seq") == F.max("seq").over(w)).alias("selected"))
    placed = r.withColumn("place", F.row_number().over(w.orderBy(F.desc("magnitude"), "seq")))
    return placed.where((F.col("place") <= most) | F.col("selected")).select("session_id", "seq", "selected", F.least("place", F.lit(most + 1)).cast("long").alias("rank"))


CANDIDATES_SQL = READINGS + """, p AS (SELECT session_id, seq, seq = max(seq) OVER (PARTITION BY session_id) AS selected, row_number() OVER (PARTITION BY session_id ORDER BY magnitude DESC, seq) AS place FROM readings)
SELECT session_id, seq, selected, least(place, 6) AS rank FROM p WHERE place <= 5 OR selected"""


def top_bins(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """The fullest whole-mph bins of each kind of reading; of equally full ones the lower. Counts come before ranks."""
    bins = lens(spark, sf_dir, "readings").groupBy("event_type", F.floor("speed_mph").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "bin"))
    return bins.withColumn("place", place).where(F.col("place") <= most).select("event_type", "bin", "n", F.col("place").cast("long").alias("place"))


TOP_BINS_SQL = READINGS + """, b AS (SELECT event_type, floor(speed_mph)::BIGINT AS bin, count(*) AS n FROM readings GROUP BY 1, 2)
SELECT event_type, bin, n, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) AS place FROM b) WHERE place <= 8"""

#: The worth of an estimator and of the way it took.
TIERS = {"geometry_primary": 50, "geometry": 45, "geometry_single_frame": 40, "naive": 20, "legacy_naive_suspect": 10}


def best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's best result: by tier, confidence, fit, latest frame and strength, and of equals the first."""
    kinds = list(TIERS)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("shot_number") % len(kinds) + 1).cast("int"))
    tier = F.element_at(F.array(*[F.lit(TIERS[k]) for k in kinds]), (F.col("shot_number") % len(kinds) + 1).cast("int"))
    rank = F.struct(tier.alias("t"), F.col("launch_confidence").alias("c"), F.coalesce(-F.col("spin_confidence"), F.lit(0.0)).alias("f"), "num_frames", "distance_ft", (-F.col("us")).alias("u"), (-F.col("shot_number")).alias("p"))
    best = F.max_by(F.struct("shot_number", kind.alias("path"), "launch_confidence"), rank)
    return lens(spark, sf_dir, "shots").groupBy("session_id").agg(best.alias("b")).select("session_id", "b.*")


BEST_SQL = SHOTS + """SELECT session_id, shot_number, ['geometry_primary', 'geometry', 'geometry_single_frame', 'naive', 'legacy_naive_suspect'][shot_number % 5 + 1] AS path, launch_confidence
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY [50, 45, 40, 20, 10][shot_number % 5 + 1] DESC, launch_confidence DESC, coalesce(-spin_confidence, 0) DESC, num_frames DESC, distance_ft DESC, us, shot_number) AS n FROM shots) WHERE n = 1"""


def club_order(club: Column) -> Column:
    """A key that sorts clubs as players do: driver, woods, hybrids, irons by number, wedges, others by name."""
    kinds = F.create_map(F.lit("wood"), F.lit(1), F.lit("hybrid"), F.lit(2), F.lit("iron"), F.lit(3))
    kind, number = F.regexp_extract(club, r"^\d+-(wood|hybrid|iron)", 1), F.regexp_extract(club, r"^(\d+)-(?:wood|hybrid|iron)", 1)
    wedge = F.array_position(F.array(*[F.lit(w) for w in ("pw", "gw", "sw", "lw")]), club)
    first = F.when(club == "driver", 0).when(kind != "", F.try_element_at(kinds, kind)).when(wedge > 0, 4).otherwise(5)
    return F.struct(first.alias("kind"), F.coalesce(number.try_cast("int"), wedge.cast("int")).alias("number"), club.alias("name"))


def clubs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lens(spark, sf_dir, "shots").select("club").distinct()
    return c.select("club", club_order(F.col("club")).alias("k")).select("club", F.col("k.kind").alias("kind"), F.col("k.number").alias("number"), F.row_number().over(Window.orderBy("k")).cast("long").alias("place"))


ORDER_SQL = SHOTS + """, c AS (SELECT DISTINCT club FROM shots), k AS (SELECT club, CASE WHEN club = 'driver' THEN 0 WHEN club LIKE '%-wood' THEN 1 WHEN club LIKE '%-hybrid' THEN 2 WHEN club LIKE '%-iron' THEN 3
WHEN club IN ('pw', 'gw', 'sw', 'lw') THEN 4 ELSE 5 END AS kind, coalesce(TRY_CAST(regexp_extract(club, '^(\\d+)-', 1) AS INT), coalesce(list_position(['pw', 'gw', 'sw', 'lw'], club), 0))::INT AS number FROM c)
SELECT club, kind, number, row_number() OVER (ORDER BY kind, number, club) AS place FROM k"""

def clock_sync(reads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key, how a device's clock maps to the host's: from reads with ``mid`` (host, s), ``latency_ms`` and ``clock`` (s, null if it failed).

    A clock with fractions gives the offset of its quickest read. One of whole seconds is off by up to one, so its offset comes from
    the first two valid reads in order that lie a second apart: the host's time between them is where the second turned. Without
    such a turn, or a valid read, nothing can be said.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    valid = reads.where("clock IS NOT NULL").withColumn("off", F.col("mid") - F.col("clock"))
    turned = (F.col("clock") - F.lag("clock").over(w)) == 1.0
    valid = valid.withColumn("turn", F.when(turned, F.struct(order, F.lag("mid").over(w).alias("from"), F.col("mid").alias("to"), F.col("clock").alias("at"))))
    found = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid"),
        F.min_by("off", F.struct("latency_ms", order)).alias("raw_offset"),
        F.min("latency_ms").alias("latency_ms"),
        F.when(F.count(F.lit(1)) > 1, (F.max("off") - F.min("off")) * 1000).alias("spread_ms"),
        (F.count_if(F.abs(F.col("clock") - F.bround("clock")) > 1e-6) > 0).alias("fractions"),
        F.min("turn").alias("turn"),
    )
    method = F.when(F.col("valid").isNull(), "no_valid_reads").when(F.col("fractions"), "fractional_clock").when(F.col("turn").isNotNull(), "integer_rollover").otherwise("integer_unusable_no_rollover")
    offset = F.when(F.col("fractions"), F.col("raw_offset")).otherwise((F.col("turn.from") + F.col("turn.to")) / 2 - F.col("turn.at"))
    uncertain = F.when(~F.col("fractions"), (F.col("turn.to") - F.col("turn.from")) * 1000)
    return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).join(found, keys, "left").select(
        *keys, "samples", F.coalesce("valid", F.lit(0)).alias("valid"), method.alias("method"), F.round(offset, 6).alias("offset_s"), F.round("raw_offset", 6).alias("raw_offset_s"), "latency_ms",
        F.round("spread_ms", 3).alias("spread_ms"), F.round(uncertain, 3).alias("uncertainty_ms"),
    )


_READS = """SELECT session_id, seq, n * 0.3::DOUBLE + (seq % 3) * 0.01::DOUBLE AS mid, CAST(2 + seq % 7 AS DOUBLE) AS latency_ms, CASE WHEN seq % 11 = 0 OR session_id % 10 = 9 THEN NULL
WHEN session_id % 3 = 0 THEN n * 0.3::DOUBLE - 0.25::DOUBLE + (seq % 5) * 0.001::DOUBLE WHEN session_id % 3 = 1 THEN floor(n * 0.3::DOUBLE + 0.45::DOUBLE) ELSE 5.0::DOUBLE END AS clock
FROM (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS n FROM {r}) x"""


def clock_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's readings as reads of a clock: with fractions, of whole seconds, one that stands, and one that never answers."""
    reads = spark.sql(_READS.format(r="{r}"), r=lens(spark, sf_dir, "readings"))
    return clock_sync(reads, ["session_id"], "seq")


SYNC_SQL = READINGS + f""", q AS ({_READS.format(r="readings")}), v AS (SELECT *, mid - clock AS off, lag(clock) OVER w AS pc, lag(mid) OVER w AS pm FROM q WHERE clock IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
t AS (SELECT session_id, arg_min(pm, seq) AS a, arg_min(mid, seq) AS b, arg_min(clock, seq) AS c FROM v WHERE clock - pc = 1 GROUP BY 1),
f AS (SELECT session_id, count(*) AS valid, arg_min(off, (latency_ms, seq)) AS raw, min(latency_ms) AS latency_ms, CASE WHEN count(*) > 1 THEN (max(off) - min(off)) * 1000 END AS spread, bool_or(abs(clock - round_even(clock, 0)) > 1e-6) AS fr FROM v GROUP BY 1),
n AS (SELECT session_id, count(*) AS samples FROM q GROUP BY 1)
SELECT n.session_id, samples, coalesce(valid, 0) AS valid, CASE WHEN valid IS NULL THEN 'no_valid_reads' WHEN fr THEN 'fractional_clock' WHEN c IS NOT NULL THEN 'integer_rollover' ELSE 'integer_unusable_no_rollover' END AS method,
round(CASE WHEN fr THEN raw ELSE (a + b) / 2 - c END, 6) AS offset_s, round(raw, 6) AS raw_offset_s, latency_ms, round(spread, 3) AS spread_ms, round(CASE WHEN NOT fr THEN (b - a) * 1000 END, 3) AS uncertainty_ms
FROM n LEFT JOIN f ON n.session_id = f.session_id LEFT JOIN t ON n.session_id = t.session_id"""

QUERIES = {
    "clock_syncs": (clock_syncs, SYNC_SQL),
    "buffers_before_shots": (buffers_before_shots, BUFFERS_SQL),
    "shot_details": (shot_details, DETAILS_SQL),
    "sequence_pairs": (sequence_pairs, SEQUENCE_SQL),
    "impact_times": (impact_times, IMPACT_SQL),
    "club_keys": (club_keys, CLUB_KEYS_SQL),
    "reasons_merged": (reasons_merged, REASONS_SQL),
    "keyed_merge": (keyed_merge, MERGE_SQL),
    "cluster_best_frames": (cluster_best_frames, BEST_FRAMES_SQL),
    "sequence_ids": (sequence_ids, SEQUENCE_IDS_SQL),
    "spin_candidates": (spin_candidates, CANDIDATES_SQL),
    "top_bins": (top_bins, TOP_BINS_SQL),
    "best_results": (best_results, BEST_SQL),
    "clubs_in_order": (clubs_in_order, ORDER_SQL),
}
