"""Log queries over lines built from the events table, some of them broken on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.functions.lens import lens, with_lenses
from swinglake.sources.logs import allowed, shots, tolerant, uuid5
from swinglake.sources.scans import capture_lines, stored_captures

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_TYPES = "CASE event_type WHEN 'click' THEN 'shot_detected' WHEN 'view' THEN 'trigger_event' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'kld_buffer' ELSE 'session_end' END"
#: A line of a log, in SQL that Spark and DuckDB read alike: every 97th is broken, every 101st no object, every 103rd too long.
LINE = f"""CASE WHEN event_id % 97 = 0 THEN '{{"type": "shot'
WHEN event_id % 101 = 0 THEN '[1, 2]' WHEN event_id % 107 = 0 THEN '  '
ELSE concat('{{"type": "', {_TYPES}, '", "value": ', CAST(CAST(floor(value) AS BIGINT) AS STRING), ', "data": {{"k": ', CAST(event_id % 10 AS STRING), '}}',
 CASE WHEN event_id % 103 = 0 THEN concat(', "pad": "', repeat('x', 33000), '"') ELSE '' END, '}}') END"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_no"), F.expr(LINE).alias("raw"))


DUCK = "WITH lines AS (SELECT user_id AS session_id, event_id AS line_no, " + LINE.replace("AS STRING", "AS VARCHAR") + " AS raw FROM events) "


def json_tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tolerant(_lines(spark, sf_dir))
    return v.groupBy("session_id", F.try_variant_get("v", "$.type", "string").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("v", "$.data.k", "bigint")).alias("k"), F.max(F.try_variant_get("v", "$.value", "bigint")).alias("top")
    )


TOLERANT_SQL = DUCK + """SELECT session_id, raw->>'type' AS type, count(*) AS n, sum((raw->'data'->>'k')::BIGINT)::BIGINT AS k, max((raw->>'value')::BIGINT) AS top
FROM (SELECT * FROM lines WHERE json_valid(raw)) WHERE json_type(raw) = 'OBJECT' GROUP BY 1, 2"""


def json_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allowed(_lines(spark, sf_dir)).groupBy("session_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("bytes"))


ALLOWLIST_SQL = DUCK + """, j AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS j FROM lines),
s AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'blank' WHEN json_type(j) <> 'OBJECT' THEN 'broken'
WHEN coalesce(j->>'type', '') NOT IN ('session_start', 'session_end', 'shot_detected', 'trigger_event', 'rolling_buffer_capture', 'error') THEN 'other_type'
WHEN strlen(raw) > 32768 THEN 'too_long' ELSE 'kept' END AS state FROM j)
SELECT session_id, state, count(*) AS n, sum(strlen(raw))::BIGINT AS bytes FROM s GROUP BY 1, 2"""


def session_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's id: the first one that its lines carry and that isn't empty, in lower case; else one made of the device and the session's name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.expr(EMBEDDED).alias("own"))
    first = F.min(F.when(F.trim("own") != "", F.struct("event_id", F.lower(F.trim("own")).alias("id"))))["id"]
    return e.groupBy("user_id").agg(first.alias("own")).select("user_id", F.coalesce("own", uuid5(NAMESPACE, F.concat(F.lit("device:"), F.col("user_id").cast("string")))).alias("session_uuid"))


#: What a line carries of its session's id: every third session has one, on some of its lines only.
EMBEDDED = "CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN concat('ABCDEF00-0000-5000-8000-', lpad(cast(user_id AS string), 12, '0')) WHEN event_id % 5 = 0 THEN ' ' END"
UUID_SQL = """WITH e AS (SELECT user_id, event_id, """ + EMBEDDED.replace("AS string", "AS VARCHAR") + """ AS own FROM events),
f AS (SELECT user_id, arg_min(lower(trim(own)), event_id) FILTER (trim(own) <> '') AS own FROM e GROUP BY 1),
h AS (SELECT user_id, own, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('device:' || user_id)) AS h FROM f)
SELECT user_id, coalesce(own, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', ['8', '9', 'a', 'b'][1 + (instr('0123456789abcdef', h[17:17]) - 1) % 4], h[18:20], '-', h[21:32])) AS session_uuid FROM h"""


#: Lines of the radar from an event: single readings, arrays of several objects, empty arrays, plain numbers, and what isn't one.
RADAR_LINE = """CASE event_id % 8 WHEN 0 THEN concat('{"speed": ', event_id % 80 - 40, ', "magnitude": ', event_id % 3, '}') WHEN 1 THEN cast(event_id % 60 - 30 AS string)
WHEN 2 THEN concat('{"speed": [', event_id % 50 - 25, ', ', event_id % 30 - 15, '], "magnitude": [', event_id % 9, ', 1]}') WHEN 3 THEN '{"speed": []}'
WHEN 4 THEN concat('{"speed": [', event_id % 50 - 25, ']}') WHEN 5 THEN concat('{"magnitude": ', event_id % 7, '}') WHEN 6 THEN '{broken' ELSE '?garbage' END"""


def radar_readings(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` that hold a reading, with speed_mph, direction and magnitude.

    The radar's protocol: JSON with a number or, of several objects, an array with the strongest first; or a plain signed number. The sign is
    the direction. JSON without a speed reads 0, a magnitude of 0 is none, an empty array or anything else is no reading.
    """
    v = F.when(F.startswith(line, F.lit("{")), F.try_parse_json(line))
    speeds, magnitudes = (F.try_variant_get(v, f"$.{k}", "array<double>") for k in ("speed", "magnitude"))
    given = F.when(F.try_variant_get(v, "$.speed", "string").isNull(), 0.0).otherwise(F.try_variant_get(v, "$.speed", "double"))
    speed = F.when(v.isNull(), F.col(line).try_cast("double")).when(speeds.isNotNull(), F.get(speeds, F.lit(0))).otherwise(given)
    strength = F.when(speeds.isNotNull(), F.get(magnitudes, F.lit(0))).otherwise(F.nullif(F.try_variant_get(v, "$.magnitude", "double"), F.lit(0.0)))
    out = lines.withColumns({"__speed": speed, "magnitude": strength}).where("__speed IS NOT NULL")
    return out.withColumns({"speed_mph": F.abs("__speed"), "direction": F.when(F.col("__speed") > 0, "inbound").otherwise("outbound")}).drop("__speed")


def radar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of each line of the radar's text protocol."""
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(RADAR_LINE).alias("line"))
    return radar_readings(lines, "line").drop("line")


RADAR_SQL = """WITH l AS (SELECT event_id, """ + RADAR_LINE.replace("AS string", "AS VARCHAR") + """ AS line FROM events),
j AS (SELECT *, CASE WHEN json_valid(line) AND line LIKE '{%' THEN line::JSON END AS j FROM l),
r AS (SELECT event_id, CASE WHEN j IS NULL THEN try_cast(line AS DOUBLE) WHEN json_type(j, '$.speed') = 'ARRAY' THEN (j->>'$.speed[0]')::DOUBLE ELSE coalesce((j->>'$.speed')::DOUBLE, 0) END AS s,
CASE WHEN json_type(j, '$.speed') = 'ARRAY' THEN (j->>'$.magnitude[0]')::DOUBLE ELSE nullif((j->>'$.magnitude')::DOUBLE, 0) END AS magnitude FROM j)
SELECT event_id, magnitude, abs(s) AS speed_mph, CASE WHEN s > 0 THEN 'inbound' ELSE 'outbound' END AS direction FROM r WHERE s IS NOT NULL"""

#: Lines of a session log from an event: shots whose fields stand at the top or in ``data``, with one name of the time or another, captures, and
#: broken ones; {nul} is a NUL byte.
SHOT_LINE = """CASE WHEN event_id % 13 = 0 THEN '{{"type": "shot_detected", "shot' WHEN event_type = 'view' THEN concat({nul}, '{{"type": "rolling_buffer_capture", "shot_number": ', event_id, CASE WHEN event_id % 5 = 0 THEN '}}' ELSE
concat(', "i_samples": [', event_id % 7, ', 2, 3], "q_samples": [4, ', event_id % 11, ', 6], "ball_timestamp_ms": ', event_id % 90, '}}') END) WHEN event_type <> 'click' THEN '{{"type": "error", "shot_number": 3}}'
WHEN event_id % 3 = 0 THEN concat('{{"type": "shot_detected", "data": {{"shot_number": ', event_id, ', "ball_speed_mph": ', event_id % 80 + 60, ', "timestamp": "t', event_id, '"}}}}')
WHEN event_id % 3 = 1 THEN concat('{{"type": "shot_detected", "shot_number": ', event_id, ', "club": "pw", "ts": "a', event_id, '", "timestamp": "b", "data": {{"shot_number": 5, "spin_rpm": ', event_id % 9000, '}}}}')
ELSE concat({nul}, '{{"type": "shot_detected", "shot_number": ', event_id, ', "timestamp": "c', event_id, '", "club_speed_mph": "', event_id % 50, '"}}') END"""


def _session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), F.expr(SHOT_LINE.format(nul="char(0)")).alias("raw"))


_SESSION_LINES = "WITH l AS (SELECT user_id::VARCHAR AS file, event_id AS line_no, replace(" + SHOT_LINE.format(nul="chr(0)") + ", chr(0), '') AS raw FROM events), j AS (SELECT file, line_no, raw::JSON AS j FROM l WHERE json_valid(raw))"


def log_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots of session logs: fields at the top or else in ``data``, the time by ``ts`` or else ``timestamp``."""
    return shots(_session_lines(spark, sf_dir))


LOG_SHOTS_SQL = _SESSION_LINES + """ SELECT file, line_no, coalesce(j->>'$.shot_number', j->>'$.data.shot_number')::BIGINT AS shot_number, coalesce(j->>'$.ts', j->>'$.data.ts', j->>'$.timestamp', j->>'$.data.timestamp') AS ts, coalesce(j->>'$.club', j->>'$.data.club') AS club,
coalesce(j->>'$.ball_speed_mph', j->>'$.data.ball_speed_mph')::DOUBLE AS ball_speed_mph, coalesce(j->>'$.club_speed_mph', j->>'$.data.club_speed_mph')::DOUBLE AS club_speed_mph, coalesce(j->>'$.spin_rpm', j->>'$.data.spin_rpm')::DOUBLE AS spin_rpm
FROM j WHERE j->>'$.type' = 'shot_detected'"""


def log_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of session logs: how many samples each has, their sums, and when the ball was seen."""
    c = capture_lines(_session_lines(spark, sf_dir))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    return c.select("file", "line_no", "shot_number", "ball_ms", F.coalesce(F.size("i"), F.lit(0)).alias("samples"), total("i").alias("sum_i"), total("q").alias("sum_q"))


LOG_CAPTURES_SQL = _SESSION_LINES + """, c AS (SELECT file, line_no, (j->>'$.shot_number')::BIGINT AS shot_number, (j->>'$.ball_timestamp_ms')::DOUBLE AS ball_ms, (j->'$.i_samples')::INT[] AS i, (j->'$.q_samples')::INT[] AS q FROM j WHERE j->>'$.type' = 'rolling_buffer_capture')
SELECT file, line_no, shot_number, ball_ms, coalesce(len(i), 0)::INT AS samples, list_sum(i)::INT AS sum_i, list_sum(q)::INT AS sum_q FROM c"""


def capture_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as the frames of stored captures, a session each, by the number of the shot (a purchase) they surround within days."""
    r = lens(spark, sf_dir, "readings").withColumn("at", F.col("us") / 1e6)
    frames = r.where("event_type <> 'purchase'").select(F.col("session_id").alias("capture"), F.when(F.col("session_id") % 2 == 0, "vertical").otherwise("horizontal").alias("orientation"), "at", "seq")
    found = stored_captures(frames, r.where("event_type = 'purchase' AND session_id % 9 <> 0").select(F.col("session_id").alias("capture"), "at"), 7, 86400.0, 43200.0)
    return found.groupBy("capture", "orientation", "shot_number").agg(F.count(F.lit(1)).alias("frames"), F.sum("seq").alias("seqs"))


BUFFERS_SQL = with_lenses("readings") + """, r AS (SELECT *, us / 1e6::DOUBLE AS t FROM readings), f AS (SELECT session_id AS capture, CASE WHEN session_id % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation, t, seq FROM r WHERE event_type <> 'purchase'),
s AS (SELECT session_id AS capture, t, (row_number() OVER (PARTITION BY session_id ORDER BY t) + 6)::INT AS n FROM r WHERE event_type = 'purchase' AND session_id % 9 <> 0),
m AS (SELECT f.*, n FROM f JOIN s ON f.capture = s.capture AND f.t >= s.t - 86400 AND f.t <= s.t + 43200 UNION ALL SELECT f.*, 7 FROM f WHERE capture NOT IN (SELECT capture FROM s))
SELECT capture, orientation, n AS shot_number, count(*) AS frames, sum(seq)::BIGINT AS seqs FROM m GROUP BY 1, 2, 3"""

QUERIES = {
    "json_tolerant_scan": (json_tolerant_scan, TOLERANT_SQL),
    "json_allowlist": (json_allowlist, ALLOWLIST_SQL),
    "session_uuids": (session_uuids, UUID_SQL),
    "radar_lines": (radar_lines, RADAR_SQL),
    "log_shots": (log_shots, LOG_SHOTS_SQL),
    "log_captures": (log_captures, LOG_CAPTURES_SQL),
    "capture_buffers": (capture_buffers, BUFFERS_SQL),
}
