"""Scans of what a log's lines hold: frames with radar payloads, capture replies, streamed blocks, and comparison files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAYLOAD = 3072
FRAME = "struct<timestamp: string, radc_b64: string>"
#: A buffer line for tests and queries, from an id: five frames, a sixth of which have no time; a quarter have whole payloads, others short or broken ones.
BUFFER_LINE = """concat('{"type": "kld7_buffer", "shot_timestamp": ', 1000 + event_id, ', "frames": [', array_join(transform(sequence(0, 4), k -> concat('{"timestamp": ',
CASE WHEN (event_id + k) % 6 = 0 THEN '"late"' ELSE cast(1000 + event_id + (k - 2) * ((event_id % 3) + 0.5D) AS string) END, ', "radc_b64": "',
CASE (event_id + k) % 4 WHEN 0 THEN repeat('A', 4096) WHEN 1 THEN repeat('A', 100) WHEN 2 THEN '!!' ELSE '' END, '"}')), ', '), ']}')"""
#: A capture reply from an id: its lines in two orders, junk between, and every fifth without its times.
REPLY = """concat_ws('\\n', CASE WHEN event_id % 2 = 0 THEN concat('{"I": [1, 2, ', event_id % 10, ']}') ELSE 'OK' END, CASE WHEN event_id % 5 <> 0 THEN concat('{"sample_time": "', cast(event_id / 1000 AS string), '"}') ELSE '{broken' END,
concat('{"Q": [', event_id % 100, ', 7]}'), concat('{"trigger_time": "', cast(event_id / 1000 + 0.5D AS string), '"}'), CASE WHEN event_id % 2 = 1 THEN concat('{"I": [1, 2, ', event_id % 10, ']}') ELSE '' END)"""


def frames(lines: DataFrame, before_s: float, after_s: float, raw: str = "raw") -> DataFrame:
    """(line_no, offset_s, radc, whole) of buffer lines: frames without a time or outside the shot's window are left out, payloads that aren't base64 are null."""
    parsed = F.from_json(raw, f"type string, shot_timestamp double, frames array<{FRAME}>")
    shot = lines.withColumn("v", parsed).where("v.type = 'kld7_buffer'")
    rows = shot.select("line_no", F.col("v.shot_timestamp").alias("shot"), F.explode("v.frames").alias("f"))
    offset = F.col("f.timestamp").try_cast("double") - F.col("shot")
    radc = F.try_to_binary(F.col("f.radc_b64"), F.lit("base64"))
    return rows.select("line_no", offset.alias("offset_s"), radc.alias("radc")).where(F.col("offset_s").between(-before_s, after_s)).withColumn("whole", F.coalesce(F.octet_length("radc") == PAYLOAD, F.lit(False)))


def captures(df: DataFrame, reply: str) -> DataFrame:
    """``df`` with sample_time, trigger_time, i and q of a reply whose four JSON lines stand in any order; all null if one is missing."""
    objects = F.transform(F.split(reply, "\n"), lambda x: F.try_parse_json(x))

    def found(name: str, kind: str) -> Column:
        values = F.transform(objects, lambda v: F.try_variant_get(v, f"$.{name}", kind))
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    parts = {"sample_time": found("sample_time", "double"), "trigger_time": found("trigger_time", "double"), "i": found("I", "array<bigint>"), "q": found("Q", "array<bigint>")}
    out = df.withColumns({f"__{k}": v for k, v in parts.items()})
    there = F.lit(True)
    for k in parts:
        there = there & F.col(f"__{k}").isNotNull()
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(there, F.col(f"__{k}")).alias(k) for k in parts])


def capture_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` that log a capture, with its shot's number, times and samples; NUL bytes are taken out, broken lines and other entries left out.

    A capture without samples stays, with nulls, so that replays can say so.
    """
    v = F.try_parse_json(F.translate(F.trim(raw), "\u0000", ""))
    of = lambda name, kind: F.try_variant_get(F.col("__v"), f"$.{name}", kind)
    kept = lines.withColumn("__v", v).where(F.try_variant_get(F.col("__v"), "$.type", "string") == "rolling_buffer_capture")
    out = {"shot_number": of("shot_number", "bigint"), "ball_speed": of("ball_speed_mph", "double"), "ball_ms": of("ball_timestamp_ms", "double"), "i": of("i_samples", "array<int>"), "q": of("q_samples", "array<int>")}
    return kept.select(*[F.col(f"`{c}`") for c in lines.columns if c not in (raw, *out)], *[x.alias(n) for n, x in out.items()])


def stored_captures(frames: DataFrame, shots: DataFrame, first_shot: int = 1, before_s: float = 6.0, after_s: float = 0.75) -> DataFrame:
    """Frames of stored captures (capture, orientation, at, ...) by the number of their shot, as a buffer's would be.

    ``shots`` has (capture, at): a capture's shots are numbered by time from ``first_shot`` on, each has the frames of the closed window around it,
    and a capture without shots is one shot of all its frames. Captures of another orientation than vertical or horizontal are refused.
    """
    bad = ~F.coalesce(F.col("orientation").isin("vertical", "horizontal"), F.lit(False))
    right = frames.withColumn("orientation", F.when(bad, F.raise_error(F.lit("orientation must be vertical or horizontal")).cast("string")).otherwise(F.col("orientation")))
    placed = F.row_number().over(Window.partitionBy("capture").orderBy("at")) + (first_shot - 1)
    numbered = shots.where("at IS NOT NULL").select(F.col("capture").alias("__c"), F.col("at").alias("__at"), placed.alias("shot_number"))
    width = before_s + after_s
    # frames and shots meet in buckets as wide as the window, so that the join is by equality
    bucket = lambda x: F.floor(x / width)
    near = numbered.withColumn("__b", F.explode(F.sequence(bucket(F.col("__at") - before_s), bucket(F.col("__at") + after_s))))
    met = right.join(near, (F.col("capture") == F.col("__c")) & (bucket(F.col("at")) == F.col("__b")))
    met = met.where((F.col("at") >= F.col("__at") - before_s) & (F.col("at") <= F.col("__at") + after_s)).drop("__c", "__at", "__b")
    alone = right.join(numbered.select("__c").distinct(), F.col("capture") == F.col("__c"), "left_anti").withColumn("shot_number", F.lit(first_shot))
    return met.unionByName(alone)


def joined_blocks(df: DataFrame, keys: list[str], order: str, block: str) -> DataFrame:
    """One array ``samples`` per key, its blocks in order. A capture is of bounded length."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).alias("b"))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x["b"])).alias("samples"))


def read_comparison(spark: SparkSession, path: str, good_only: bool = True) -> DataFrame:
    """A comparison CSV's rows, numbers where a column holds them, with the file's name as session."""
    rows = spark.read.option("header", True).csv(path).withColumn("session", F.col("_metadata.file_name"))
    numbers = [c for c in rows.columns if c.endswith(("_of", "_tm", "_delta")) and not c.startswith(("timestamp", "spin_quality", "spin_rejection"))]
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return rows.where("match_quality = 'good'") if good_only else rows


def read_truth_named(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A truth device's CSV with fixed column names (name here to name there), numbers where they are numbers, and the file's name as session."""
    rows = spark.read.option("header", True).csv(path)
    value = lambda there: F.regexp_replace(F.trim(F.col(f"`{there}`")), ",", "")
    kept = [(F.trim(F.col(f"`{b}`")) if a == "club" else value(b).try_cast("double")).alias(a) for a, b in columns.items()]
    return rows.select(F.col("_metadata.file_name").alias("session"), *kept)


def labelled_tail(lines: DataFrame, labels: tuple[str, ...] = ("type", "session_uuid", "device_id"), fields: tuple[str, ...] = ("ts", "message"), raw: str = "raw") -> DataFrame:
    """A log's new lines with labels and fields taken from their JSON, null where they lack them; a projection, so it runs on a stream too. Broken lines keep their text alone."""
    v = F.try_parse_json(raw)
    return lines.select(raw, *[F.try_variant_get(v, f"$.{name}", "string").alias(name) for name in (*labels, *fields)])
