"""Rules that look at one row, or at one row's place in its session: filters, gates, projections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.functions import ladder
from swinglake.functions.lens import lens, with_lenses

READINGS, SHOTS = with_lenses("readings"), with_lenses("shots")


def half_up(x: Column, places: int) -> Column:
    """Rounded by the same two operations as in SQL elsewhere, so that ties agree."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def timeline_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session cut at its fastest reading (of equal ones the earliest): what lies strictly before it and strictly after it."""
    r = lens(spark, sf_dir, "readings")
    peak = r.groupBy("session_id").agg(F.max(F.struct("speed_mph", (-F.col("us")).alias("m"))).alias("p"))
    peak = peak.select("session_id", F.col("p.speed_mph").alias("peak"), (-F.col("p.m")).alias("peak_us"))
    before, after = F.col("us") < F.col("peak_us"), F.col("us") > F.col("peak_us")
    return r.join(peak, "session_id").groupBy("session_id", "peak", "peak_us").agg(
        F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), F.max(F.when(before, F.col("speed_mph"))).alias("top_before"), F.max(F.when(after, F.col("speed_mph"))).alias("top_after")
    )


SLICES_SQL = READINGS + """, p AS (SELECT session_id, max(speed_mph) AS peak, arg_max(us, (speed_mph, -us)) AS peak_us FROM readings GROUP BY 1)
SELECT session_id, peak, peak_us, count(*) FILTER (us < peak_us) AS n_before, count(*) FILTER (us > peak_us) AS n_after,
max(speed_mph) FILTER (us < peak_us) AS top_before, max(speed_mph) FILTER (us > peak_us) AS top_after FROM readings JOIN p USING (session_id) GROUP BY 1, 2, 3"""


def device_filter(min_speed: float = 0, max_speed: float = 0, min_magnitude: float = 0, max_magnitude: float = 0, direction: str | None = None) -> Column:
    """What a radar's own filters let through; a limit of 0 is none, as is a direction of None."""
    limits = [(">=", "speed_mph", min_speed), ("<=", "speed_mph", max_speed), (">=", "magnitude", min_magnitude), ("<=", "magnitude", max_magnitude)]
    tests = [f"{column} {sign} {limit}" for sign, column, limit in limits if limit > 0]
    return F.expr(" AND ".join(tests + ([f"direction = '{direction}'"] if direction else [])) or "true")


def device_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lens(spark, sf_dir, "readings").where(device_filter(min_speed=20, min_magnitude=10, max_magnitude=90, direction="outbound"))
    return r.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("speed_mph").alias("top"))


FILTERS_SQL = READINGS + "SELECT session_id, count(*) AS n, max(speed_mph) AS top FROM readings WHERE speed_mph >= 20 AND magnitude >= 10 AND magnitude <= 90 AND direction = 'outbound' GROUP BY 1"


def shot_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that may be a ball: 15 mph or more."""
    return lens(spark, sf_dir, "readings").groupBy("session_id", (F.col("speed_mph") >= 15).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


VALIDITY_SQL = READINGS + "SELECT session_id, speed_mph >= 15 AS valid, count(*) AS n FROM readings GROUP BY 1, 2"


def angle_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack angle: the club's angle negated, within -15 to 8 degrees. Launch: 0 to 45 degrees up, 15 to either side. Null where it isn't."""
    attack = -F.col("path_deg") * 5
    return lens(spark, sf_dir, "shots").select(
        "shot_number",
        F.when(attack.between(-15, 8), attack).alias("attack_deg"),
        F.when(F.col("launch_v").between(0, 45), F.col("launch_v")).alias("launch_v"),
        F.when(F.abs("launch_h") <= 15, F.col("launch_h")).alias("launch_h"),
    )


ANGLES_SQL = SHOTS + """SELECT shot_number, CASE WHEN path_deg * -5 BETWEEN -15 AND 8 THEN path_deg * -5 END AS attack_deg,
CASE WHEN launch_v BETWEEN 0 AND 45 THEN launch_v END AS launch_v, CASE WHEN abs(launch_h) <= 15 THEN launch_h END AS launch_h FROM shots"""


def targets_in_window(spark: SparkSession, sf_dir: str, slack_s: int = 300) -> DataFrame:
    """Purchases inside and outside the time that their session's views span, five minutes more on either side; one without a time is neither."""
    r = lens(spark, sf_dir, "readings")
    bounds = r.where("event_type = 'view'").groupBy("session_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    t = r.where("event_type = 'purchase'").select("session_id", F.when(F.col("seq") % 13 != 0, F.col("us")).alias("us")).join(bounds, "session_id")
    inside = F.col("us").between(F.col("first_us") - slack_s * 1_000_000, F.col("last_us") + slack_s * 1_000_000)
    return t.groupBy("session_id").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_if(F.col("us").isNull()).alias("no_time"))


TARGETS_SQL = READINGS + """, b AS (SELECT session_id, min(us) - 300000000 AS lo, max(us) + 300000000 AS hi FROM readings WHERE event_type = 'view' GROUP BY 1),
t AS (SELECT session_id, CASE WHEN seq % 13 <> 0 THEN us END AS us FROM readings WHERE event_type = 'purchase')
SELECT session_id, count(*) FILTER (us BETWEEN lo AND hi) AS inside, count(*) FILTER (us NOT BETWEEN lo AND hi) AS outside, count(*) FILTER (us IS NULL) AS no_time FROM t JOIN b USING (session_id) GROUP BY 1"""


def api_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot as it is shown: rounded field by field, and what is 0 counts as not measured."""
    shown = lambda c, places: F.when(c != 0, half_up(c, places))
    smash = F.when(F.col("club_speed") > 0, F.col("ball_speed") / F.col("club_speed"))
    return lens(spark, sf_dir, "shots").select(
        "shot_number",
        shown(F.col("ball_speed"), 1).alias("ball_speed_mph"),
        shown(F.col("club_speed"), 1).alias("club_speed_mph"),
        shown(smash, 2).alias("smash_factor"),
        shown(F.col("spin_rpm"), 0).alias("spin_rpm"),
        shown(F.col("spin_confidence"), 2).alias("spin_confidence"),
        "launch_v",
        half_up(F.col("launch_h"), 2).alias("launch_h"),
    )


def _shown(x: str, p: int, zero: bool = True) -> str:
    value = f"floor({x} * {10.0**p}::DOUBLE + 0.5) / {10.0**p}::DOUBLE"
    return f"CASE WHEN {x} <> 0 THEN {value} END" if zero else value


API_SQL = SHOTS + f"""SELECT shot_number, {_shown("ball_speed", 1)} AS ball_speed_mph, {_shown("club_speed", 1)} AS club_speed_mph,
CASE WHEN club_speed > 0 THEN {_shown("(ball_speed / club_speed)", 2)} END AS smash_factor, {_shown("spin_rpm", 0)} AS spin_rpm,
{_shown("spin_confidence", 2)} AS spin_confidence, launch_v, {_shown("launch_h", 2, False)} AS launch_h FROM shots"""

#: What a recording made for comparison must say of itself.
PROVENANCE = {
    "raw_radc_payload_logging_requested": True,
    "raw_radc_payload_logging_enabled": True,
    "calibration_enabled": False,
    "radc_tuning_enabled": False,
}


def provenance_issues(flags: dict[str, Column]) -> Column:
    """All that a session's flags lack, in the order of PROVENANCE; a flag that isn't there is no flag of the right value."""
    say = lambda name, want: F.when(~F.coalesce(flags[name] == want, F.lit(False)), F.lit(f"{name} is not {str(want).lower()}"))
    return F.array_compact(F.array(*[say(name, want) for name, want in PROVENANCE.items()]))


def provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots")
    n = F.col("shot_number")
    flags = {k: F.when(n % (7 + i) != 0, n % (2 + i) == 0) for i, k in enumerate(PROVENANCE)}
    issues = provenance_issues(flags)
    return s.select("shot_number", F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("passes"))


PROVENANCE_SQL = SHOTS + """, i AS (SELECT shot_number, list_filter([""" + ", ".join(
    f"CASE WHEN NOT coalesce((CASE WHEN shot_number % {7 + i} <> 0 THEN shot_number % {2 + i} = 0 END) = {want}, false) THEN '{k} is not {str(want).lower()}' END" for i, (k, want) in enumerate(PROVENANCE.items())
) + """], lambda x: x IS NOT NULL) AS i FROM shots) SELECT shot_number, array_to_string(i, '; ') AS issues, len(i) = 0 AS passes FROM i"""


def review_quality(points: Column, gain: Column, start: Column, rising: Column, lingering: Column) -> Column:
    """A path's class: enough points that gain distance early and steadily, or fewer that gain more with little left behind."""
    steady = (start <= 120) & (rising >= 0.75)
    return (
        F.when(steady & (points >= 4) & (gain >= 1.2), "strong")
        .when(steady & (points >= 3) & (gain >= 1.5) & (lingering <= 4), "strong")
        .when((points >= 2) & (gain >= 0.4) & (rising >= 0.5), "partial")
        .otherwise("weak")
    )


def review_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots")
    kind = review_quality(F.col("num_frames") % 6, F.col("distance_ft") / 4, F.col("launch_confidence") * 200, F.col("spin_confidence"), F.col("shot_number") % 8)
    return s.select("shot_number", kind.alias("quality"))


REVIEW_SQL = SHOTS + """, m AS (SELECT shot_number, num_frames % 6 AS p, distance_ft / 4 AS g, launch_confidence * 200 <= 120 AND spin_confidence >= 0.75 AS ok, spin_confidence AS r FROM shots)
SELECT shot_number, CASE WHEN ok AND (p >= 4 AND g >= 1.2 OR p >= 3 AND g >= 1.5 AND shot_number % 8 <= 4) THEN 'strong' WHEN p >= 2 AND g >= 0.4 AND r >= 0.5 THEN 'partial' ELSE 'weak' END AS quality FROM m"""

#: Patterns of club labels in the order in which they are tried, and what they become.
CLUB_PATTERNS = (
    (r"\b(driver|drv|1w|1-wood)\b", "driver"),
    (r"\b(\d)\s*-?\s*(wood|w)\b", "$1-wood"),
    (r"\b(\d)\s*-?\s*(hybrid|h|hy)\b", "$1-hybrid"),
    (r"\b(\d)\s*-?\s*(iron|i)\b", "$1-iron"),
    (r"\biron\s*-?\s*(\d)\b", "$1-iron"),
    (r"\bpitching\s*wedge\b|\bpw\b", "pw"),
    (r"\bgap\s*wedge\b|\bgw\b", "gw"),
    (r"\bsand\s*wedge\b|\bsw\b", "sw"),
    (r"\blob\s*wedge\b|\blw\b", "lw"),
)
#: Whole labels and what they stand for, in two readers.
TOKEN_ALIASES = {"drv": "driver", "1-wood": "driver", "pitching-wedge": "pw", "sand-wedge": "sw", "gap-wedge": "gw", "lob-wedge": "lw"}
REPLAY_ALIASES = {"7i": "7-iron", "9i": "9-iron", "wedge": "pw", "3w": "3-wood"}


def club_by_pattern(label: Column) -> Column:
    """The first pattern found anywhere in the label names the club; else the label in lower case; nothing is the empty text."""
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = s
    for pattern, name in reversed(CLUB_PATTERNS):
        out = F.when(s.rlike(pattern), F.trim(F.regexp_replace(F.regexp_extract(s, pattern, 0), pattern, name))).otherwise(out)
    return out


def club_by_tokens(label: Column) -> Column:
    """A number and a kind in either order, else a whole label's alias."""
    s = F.rtrim(F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit("_"), F.lit("-")), F.lit("."))
    words = F.regexp_replace(F.trim(F.replace(s, F.lit("-"), F.lit(" "))), " +", " ")
    kind = F.regexp_extract(words, r"^\d+ (i|w|h)[a-z]*$", 1)
    whole = F.create_map(F.lit("i"), F.lit("iron"), F.lit("w"), F.lit("wood"), F.lit("h"), F.lit("hybrid"))
    alias = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    return (
        F.when(words.rlike(r"^\d+ (iron|i|wood|w|hybrid|h)$"), F.concat_ws("-", F.regexp_extract(words, r"^(\d+)", 1), F.try_element_at(whole, kind)))
        .when(words.rlike(r"^(iron|wood|hybrid) \d+$"), F.regexp_replace(words, r"^(\w+) (\d+)$", "$2-$1"))
        .otherwise(F.coalesce(F.try_element_at(alias, s), s))
    )


def club_by_alias(label: Column) -> Column:
    """Spaces and underlines become hyphens, and a few short labels their club."""
    s = F.translate(F.lower(F.trim(label)), "_ ", "--")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in REPLAY_ALIASES.items() for x in pair]), s), s)


_LABEL = """CASE CAST(shot_number % 16 AS INT) WHEN 0 THEN ' Driver' WHEN 1 THEN '7 Iron' WHEN 2 THEN 'iron 7' WHEN 3 THEN '7i' WHEN 4 THEN 'PW' WHEN 5 THEN 'Pitching Wedge'
WHEN 6 THEN 'drv.' WHEN 7 THEN '3_wood' WHEN 8 THEN '3w' WHEN 9 THEN '4 hy' WHEN 10 THEN 'wedge' WHEN 11 THEN 'sand-wedge' WHEN 12 THEN '' WHEN 13 THEN 'Wood 5' WHEN 14 THEN 'my 5 - iron (new)' ELSE '1-wood' END"""


def club_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label as its three readers understand it."""
    s = lens(spark, sf_dir, "shots").select("shot_number", F.expr(_LABEL).alias("label"))
    return s.select("shot_number", club_by_pattern(F.col("label")).alias("by_pattern"), club_by_tokens(F.col("label")).alias("by_tokens"), club_by_alias(F.col("label")).alias("by_alias"))


def _labels_sql() -> str:
    tests = " ".join(f"WHEN regexp_matches(s, '{p}') THEN trim(regexp_replace(regexp_extract(s, '{p}'), '{p}', '{n.replace('$', chr(92))}'))" for p, n in CLUB_PATTERNS)
    tokens = " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in TOKEN_ALIASES.items())
    aliases = " ".join(f"WHEN h = '{a}' THEN '{b}'" for a, b in REPLAY_ALIASES.items())
    return f"""{SHOTS}, l AS (SELECT shot_number, {_LABEL} AS label FROM shots),
s AS (SELECT shot_number, lower(trim(label)) AS s, rtrim(replace(lower(trim(label)), '_', '-'), '.') AS t, replace(replace(lower(trim(label)), '_', '-'), ' ', '-') AS h FROM l),
w AS (SELECT *, string_split(trim(regexp_replace(replace(t, '-', ' '), ' +', ' ', 'g')), ' ') AS w FROM s)
SELECT shot_number, CASE {tests} ELSE s END AS by_pattern,
CASE WHEN len(w) = 2 AND regexp_matches(w[1], '^\\d+$') AND w[2] IN ('iron', 'i') THEN w[1] || '-iron' WHEN len(w) = 2 AND regexp_matches(w[1], '^\\d+$') AND w[2] IN ('wood', 'w') THEN w[1] || '-wood'
WHEN len(w) = 2 AND regexp_matches(w[1], '^\\d+$') AND w[2] IN ('hybrid', 'h') THEN w[1] || '-hybrid' WHEN len(w) = 2 AND regexp_matches(w[2], '^\\d+$') AND w[1] IN ('iron', 'wood', 'hybrid') THEN w[2] || '-' || w[1]
{tokens} ELSE t END AS by_tokens, CASE {aliases} ELSE h END AS by_alias FROM w"""


LABELS_SQL = _labels_sql()

#: Formats of a time, in the order in which they are tried; ISO is first.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "d/M/yyyy H:mm:ss", "yyyy-MM-dd HH:mm")


def any_time(text: Column) -> Column:
    """The time in the first format that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")


def times_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int), 5, 9)")).alias("t"))
    shapes = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "M/d/yyyy h:mm:ss a", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm"]
    text = F.lit("no time")
    for i, shape in enumerate(shapes):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("t", shape)).otherwise(text)
    return o.select("o_orderkey", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), any_time(text)).alias("epoch_s"))


TIMES_SQL = """WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_seconds((o_orderkey % 24) * 3600 + 309) AS t FROM orders),
s AS (SELECT o_orderkey, t, CASE o_orderkey % 7 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(t, '%m/%d/%Y %H:%M:%S')
WHEN 3 THEN strftime(t, '%m/%d/%Y %I:%M:%S %p') WHEN 4 THEN strftime(t, '%d/%m/%Y %H:%M:%S') WHEN 5 THEN strftime(t, '%Y-%m-%d %H:%M') ELSE 'no time' END AS x FROM o)
SELECT o_orderkey, epoch(try_strptime(x, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %I:%M:%S %p', '%d/%m/%Y %H:%M:%S', '%Y-%m-%d %H:%M']))::BIGINT AS epoch_s FROM s"""


def selection_confidence(path: Column, snr: Column, frames: Column, spread: Column, rmse: Column, residual: Column, blind: Column) -> Column:
    """How far a launch angle is to be trusted, by the way on which it was found. Residuals are shares of the largest allowed."""
    kind = F.when(path.startswith("geometry_single"), "geometry_single_frame").when(path.startswith("geometry"), "geometry").otherwise("naive")
    return F.round(ladder.held(half_up(ladder.base_trust(kind, snr, frames, spread, rmse, residual), 2), path, blind), 4)


_PATH = "CASE CAST(shot_number % 5 AS INT) WHEN 0 THEN 'geometry_primary' WHEN 1 THEN 'geometry_early_assisted' WHEN 2 THEN 'geometry_single_frame' WHEN 3 THEN 'naive_rule_stack' ELSE 'legacy_naive_suspect' END"


def launch_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lens(spark, sf_dir, "shots").withColumn("path", F.expr(_PATH)).withColumn("n", (F.col("num_frames") % 4 + 1).cast("double"))
    confidence = selection_confidence(F.col("path"), F.col("num_frames") / 4.0, F.col("n"), F.col("distance_ft") * 2, F.col("distance_ft"), F.col("launch_confidence"), F.col("shot_number") % 9 == 0)
    return s.select("shot_number", "path", confidence.alias("confidence"))


CONFIDENCE_SQL = SHOTS + f""", s AS (SELECT shot_number, {_PATH} AS path, (num_frames % 4 + 1)::DOUBLE AS n, least(num_frames / 4.0::DOUBLE / 10, 1.0::DOUBLE) AS q, distance_ft AS d, launch_confidence AS r FROM shots),
f AS (SELECT *, floor(CASE WHEN path = 'geometry_single_frame' THEN least(0.72::DOUBLE, 0.53::DOUBLE + q * 0.16::DOUBLE + greatest(0, 1 - r) * 0.05::DOUBLE)
WHEN path LIKE 'geometry%' THEN 0.3::DOUBLE + q * 0.4::DOUBLE + greatest(0, 1 - d / 6) * 0.3::DOUBLE WHEN n = 1 THEN 0.4::DOUBLE + q * 0.5::DOUBLE
ELSE q * 0.5::DOUBLE + greatest(0, 1 - d * 2 / 15) * 0.3::DOUBLE + least(n / 3, 1.0::DOUBLE) * 0.2::DOUBLE END * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS c FROM s),
h AS (SELECT *, CASE path WHEN 'geometry_early_assisted' THEN greatest(0, c - 0.08::DOUBLE) WHEN 'legacy_naive_suspect' THEN least(c, 0.35::DOUBLE) ELSE c END AS h FROM f)
SELECT shot_number, path, round(CASE WHEN shot_number % 9 = 0 THEN least(h, 0.35::DOUBLE) ELSE h END, 4) AS confidence FROM h"""

QUERIES = {
    "timeline_slices": (timeline_slices, SLICES_SQL),
    "device_filters": (device_filters, FILTERS_SQL),
    "shot_validity": (shot_validity, VALIDITY_SQL),
    "angle_gates": (angle_gates, ANGLES_SQL),
    "targets_in_window": (targets_in_window, TARGETS_SQL),
    "api_projection": (api_projection, API_SQL),
    "provenance_gate": (provenance_gate, PROVENANCE_SQL),
    "review_classes": (review_classes, REVIEW_SQL),
    "club_labels": (club_labels, LABELS_SQL),
    "times_parsed": (times_parsed, TIMES_SQL),
    "launch_confidence": (launch_confidence, CONFIDENCE_SQL),
}
