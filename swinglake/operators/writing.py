"""What sinks write and scans of frames and captures read, as queries over logs built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses
from swinglake.operators.logs import DUCK, _lines
from swinglake.operators.pairing import PAIRS_SQL, paired
from swinglake.sources import scans, sinks

READINGS, SHOTS = with_lenses("readings"), with_lenses("shots")


def typed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots as lines of a log."""
    s = lens(spark, sf_dir, "shots").select("shot_number", F.concat(F.lit("t"), F.col("us").cast("string")).alias("at"), "club", "num_frames")
    return sinks.entry_lines(s, "shot_detected", "at", ["shot_number", "club", "num_frames"])


ENTRIES_SQL = SHOTS + "SELECT json_object('ts', 't' || us, 'type', 'shot_detected', 'shot_number', shot_number, 'club', club, 'num_frames', num_frames)::VARCHAR AS value FROM shots"


def derived_at_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a shot's and its buffer's entries derive when they are written."""
    s = lens(spark, sf_dir, "shots")
    frames = F.transform(F.sequence(F.lit(0), F.col("num_frames") % 5), lambda k: F.struct(((F.col("shot_number") + k) % 3 != 0).alias("has_radc"), F.when((F.col("shot_number") + k) % 7 == 0, 100).otherwise(sinks.PAYLOAD).alias("bytes")))
    s = s.select("shot_number", (F.col("spin_rpm") / 60).alias("spin_peak_hz"), (F.col("num_frames") / 1000).alias("trigger_time"), F.lit(0.0).alias("sample_time"), F.col("distance_ft").alias("impact_ms"), frames.alias("frames"))
    return s.withColumns(sinks.shot_columns()).withColumns(sinks.payload_columns(F.col("frames"))).select(
        "shot_number", "spin_candidate_rpm", "trigger_offset_ms", "impact_offset_ms", "frame_count", "radc_count", "radc_valid", "radc_complete"
    )


DERIVED_SQL = SHOTS + """, f AS (SELECT *, list_transform(range(0, num_frames % 5 + 1), lambda k: {'h': (shot_number + k) % 3 <> 0, 'b': CASE WHEN (shot_number + k) % 7 = 0 THEN 100 ELSE 3072 END}) AS f FROM shots),
c AS (SELECT *, len(f) AS n, len(list_filter(f, lambda x: x.h)) AS r, len(list_filter(f, lambda x: x.h AND x.b = 3072)) AS v FROM f)
SELECT shot_number, round(spin_rpm / 60 * 60)::BIGINT AS spin_candidate_rpm, round(num_frames / 1000 * 1000, 3) AS trigger_offset_ms, round(distance_ft - num_frames / 1000 * 1000, 3) AS impact_offset_ms,
n::INT AS frame_count, r::INT AS radc_count, v::INT AS radc_valid, r > 0 AND r = v AS radc_complete FROM c"""


def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as the 33 columns of a comparison file."""
    p = paired(spark, sf_dir).select("club", F.col("d_ball_speed").alias("ball_speed_of"), F.col("t_ball_speed").alias("ball_speed_tm"), F.col("d_launch_v").alias("launch_v_of"), F.col("t_launch_v").alias("launch_v_tm"), "match_quality")
    return sinks.comparison(p)


COMPARISON_SQL = PAIRS_SQL + "SELECT " + ", ".join(
    {
        "club": "club", "match_quality": "match_quality", "ball_speed_of": "round(d_speed, 3) AS ball_speed_of", "ball_speed_tm": "round(t_speed, 3) AS ball_speed_tm", "ball_speed_delta": "round(d_speed - t_speed, 3) AS ball_speed_delta",
        "launch_v_of": "round(d_launch, 3) AS launch_v_of", "launch_v_tm": "round(t_launch, 3) AS launch_v_tm", "launch_v_delta": "round(d_launch - t_launch, 3) AS launch_v_delta",
    }.get(c, f"NULL::{'DOUBLE' if c.endswith('_delta') else 'VARCHAR'} AS {c}")
    for c in sinks.COMPARISON
) + " FROM pairs"


def upload_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload bodies of sessions: a cap of 150,000 bytes refuses those with long lines. Of the body, what unpacking it gives back is measured in tests."""
    kept = _lines(spark, sf_dir).where("trim(raw) <> ''")
    bodies = sinks.upload_bodies(kept, "session_id", raw_bytes=150_000)
    return bodies.select("session_id", "lines", "bytes", "refused", F.col("body").isNotNull().alias("packed"))


UPLOAD_SQL = DUCK + """, s AS (SELECT session_id, count(*) AS lines, sum(strlen(raw) + 1)::BIGINT AS bytes FROM lines WHERE trim(raw) <> '' GROUP BY 1)
SELECT session_id, lines, bytes, CASE WHEN bytes > 150000 THEN 'too large' END AS refused, bytes <= 150000 AS packed FROM s"""


def frame_buffer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in buffer lines: base64 payloads are decoded, those of 3072 bytes are whole, frames beyond 2 s of the shot or without a time are left out."""
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select(F.col("event_id").alias("line_no"), F.expr(scans.BUFFER_LINE).alias("raw"))
    return scans.frames(lines, before_s=2.0, after_s=2.0).groupBy("line_no").agg(F.count(F.lit(1)).alias("frames"), F.count_if("whole").alias("whole"), F.round(F.sum("offset_s"), 3).alias("offsets"))


FRAMES_SQL = """WITH f AS (SELECT event_id AS line_no, unnest(range(0, 5)) AS k FROM events WHERE event_type = 'purchase'),
g AS (SELECT line_no, k, CASE WHEN (line_no + k) % 6 <> 0 THEN (k - 2) * ((line_no % 3) + 0.5::DOUBLE) END AS o, (line_no + k) % 4 = 0 AS w FROM f)
SELECT line_no, count(*) AS frames, count(*) FILTER (w) AS whole, round(sum(o), 3) AS offsets FROM g WHERE o BETWEEN -2 AND 2 GROUP BY 1"""


def capture_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture replies of four JSON lines in any order with junk between; a reply that lacks one gives nulls."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(scans.REPLY).alias("reply"))
    return scans.captures(e, "reply").select("event_id", "sample_time", "trigger_time", F.size("i").alias("n_i"), F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_q"))


REPLIES_SQL = """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id / 1000 END AS sample_time, CASE WHEN event_id % 5 <> 0 THEN event_id / 1000 + 0.5::DOUBLE END AS trigger_time,
CASE WHEN event_id % 5 <> 0 THEN 3 END::INT AS n_i, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 + 7 END AS sum_q FROM events"""


def capture_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each log: its first and last time, shots, buffers, and whether it can be replayed (a buffer for every shot at least)."""
    r = lens(spark, sf_dir, "readings")
    shots, buffers = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")
    return r.groupBy("session_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), shots.alias("shots"), buffers.alias("buffers"), ((shots > 0) & (buffers >= shots)).alias("ready"))


INFO_SQL = READINGS + """SELECT session_id, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (event_type = 'purchase') AS shots, count(*) FILTER (event_type = 'view') AS buffers,
count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'view') >= count(*) FILTER (event_type = 'purchase') AS ready FROM readings GROUP BY 1"""


def blocks_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed blocks of a capture in their order as one array; a capture is a hundred lines of a session."""
    r = lens(spark, sf_dir, "readings").select("session_id", F.floor(F.col("seq") / 2000).alias("capture"), "seq", F.array(F.col("seq") % 7, F.col("seq") % 11).alias("block"))
    joined = scans.joined_blocks(r, ["session_id", "capture"], "seq", "block")
    weighed = F.aggregate(F.transform("samples", lambda x, k: x * (k + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return joined.select("session_id", "capture", F.size("samples").alias("n"), weighed.alias("weighed"))


BLOCKS_SQL = READINGS + """, b AS (SELECT session_id, floor(seq / 2000)::BIGINT AS capture, seq, row_number() OVER (PARTITION BY session_id, floor(seq / 2000) ORDER BY seq) AS n FROM readings)
SELECT session_id, capture, (2 * count(*))::INT AS n, sum((seq % 7) * (2 * n - 1) + (seq % 11) * 2 * n)::BIGINT AS weighed FROM b GROUP BY 1, 2"""

QUERIES = {
    "typed_entries": (typed_entries, ENTRIES_SQL),
    "derived_at_write": (derived_at_write, DERIVED_SQL),
    "comparison_rows": (comparison_rows, COMPARISON_SQL),
    "upload_sessions": (upload_sessions, UPLOAD_SQL),
    "frame_buffer_scan": (frame_buffer_scan, FRAMES_SQL),
    "capture_replies": (capture_replies, REPLIES_SQL),
    "capture_info": (capture_info, INFO_SQL),
    "blocks_joined": (blocks_joined, BLOCKS_SQL),
}
