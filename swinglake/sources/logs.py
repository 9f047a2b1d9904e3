"""Session logs: tolerant and strict scans of JSON lines, the upload filter, and files of a truth device."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entry types that may leave the device, and the most bytes of a line.
ALLOWED = ("session_start", "session_end", "shot_detected", "trigger_event", "rolling_buffer_capture", "error")
LINE_BYTES = 32_768


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of text files: a line's number counts from 0 in its file.

    A file is read in blocks, as Spark splits it: lines are numbered inside their block, and a block begins behind the lines
    of those before it, which are counted first.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__nth"), F.col("value").alias("raw")
    )
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "__at").agg(F.count(F.lit(1)).alias("__n")).select("file", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("file", "__at").orderBy("__nth")) - 1
    return lines.withColumn("__in", inside).join(blocks, ["file", "__at"]).select("file", (F.col("__first") + F.col("__in")).alias("line_no"), "raw")


def tolerant(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines that are JSON objects, with ``v`` as VARIANT; NUL bytes are taken out, blank and broken lines and other JSON left out."""
    clean = F.translate(F.col(raw), "\u0000", "")
    v = F.try_parse_json(clean)
    return lines.withColumn("v", v).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def strict(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """As :func:`tolerant`, but a line that is no object, or a shot without an integer number, raises with its line number."""
    v = F.try_parse_json(F.col(raw))
    number = F.try_variant_get("v", "$.shot_number", "bigint")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    is_shot = F.coalesce(F.try_variant_get("v", "$.type", "string") == "shot_detected", F.lit(False))
    wrong = F.when(~is_object, F.lit("not a JSON object")).when(is_shot & number.isNull(), F.lit("no shot_number"))
    checked = F.when(wrong.isNull(), number).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), wrong)).cast("bigint"))
    return lines.where(F.trim(raw) != "").withColumn("v", v).withColumn("shot_number", checked)


def field(name: str, kind: str) -> Column:
    """A field of an entry, from its ``data`` object if it isn't at the top."""
    return F.coalesce(F.try_variant_get("v", f"$.{name}", kind), F.try_variant_get("v", f"$.data.{name}", kind))


def shots(lines: DataFrame) -> DataFrame:
    """Shots of a log, the time from ``ts`` or else ``timestamp``."""
    v = tolerant(lines).where(F.try_variant_get("v", "$.type", "string") == "shot_detected")
    return v.select(
        "file",
        "line_no",
        field("shot_number", "bigint").alias("shot_number"),
        F.coalesce(field("ts", "string"), field("timestamp", "string")).alias("ts"),
        field("club", "string").alias("club"),
        field("ball_speed_mph", "double").alias("ball_speed_mph"),
        field("club_speed_mph", "double").alias("club_speed_mph"),
        field("spin_rpm", "double").alias("spin_rpm"),
    )


def allowed(lines: DataFrame) -> DataFrame:
    """Per file: lines kept for upload, too long, of other types, and broken."""
    v = F.try_parse_json(F.col("raw"))
    kind = F.try_variant_get(v, "$.type", "string")
    state = (
        F.when(F.trim("raw") == "", "blank")
        .when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "broken")
        .when(~F.coalesce(kind.isin(*ALLOWED), F.lit(False)), "other_type")
        .when(F.octet_length("raw") > LINE_BYTES, "too_long")
        .otherwise("kept")
    )
    return lines.withColumn("state", state)


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, from built-in functions."""
    prefix = uuid.UUID(namespace).bytes
    h = F.sha1(F.concat(F.lit(prefix), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid5_py(namespace: str, name: str) -> str:
    digest = bytearray(hashlib.sha1(uuid.UUID(namespace).bytes + name.encode()).digest()[:16])
    digest[6], digest[8] = digest[6] & 0x0F | 0x50, digest[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(digest)))


#: Truth-device columns and the headers that may name them, the first that fits in this order.
ALIASES = {
    "ball_speed": ("ball speed", "ballspeed"),
    "club_speed": ("club speed", "clubspeed"),
    "smash_factor": ("smash factor", "smash"),
    "launch_angle_v": ("launch angle", "launch v"),
    "launch_angle_h": ("launch direction", "launch h"),
    "spin": ("spin rate", "spin"),
    "carry": ("carry", "carry distance"),
    "club": ("club", "club type"),
}
TO_MPH = {"km/h": 1 / 1.609344, "m/s": 1 / 0.44704}
TO_YARDS = {"m": 1.093613}


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """A truth device's CSV: a ``sep=`` line and byte order marks are skipped, headers mapped by alias, units converted.

    Only the first lines are looked at on the driver; the rows are read by Spark.
    """
    head = [r["value"].replace("﻿", "") for r in spark.read.text(path).limit(4).collect()]
    skip = 1 if head and head[0].lower().startswith("sep=") else 0
    sep = head[0][4:5] or "," if skip else ","
    headers = [h.strip().strip('"').lower() for h in head[skip].split(sep)]
    units = [u.strip().strip('"') for u in head[skip + 1].split(sep)] if len(head) > skip + 1 else []
    has_units = any(u.startswith("[") for u in units)
    rows = spark.read.option("sep", sep).schema(", ".join(f"c{i} string" for i in range(len(headers)))).csv(path)
    first = F.regexp_replace(F.coalesce("c0", F.lit("")), "﻿", "")
    rows = rows.where(~first.startswith("sep=") & (F.lower(F.trim(first)) != headers[0]) & ~first.startswith("["))
    out = []
    for name, names in ALIASES.items():
        at = next((headers.index(n) for n in names if n in headers), None)
        value = F.lit(None).cast("string") if at is None else F.trim(F.col(f"c{at}"))
        if name == "club":
            out.append(value.alias(name))
            continue
        unit = units[at].strip("[]").lower() if has_units and at is not None and at < len(units) else ""
        factor = TO_MPH.get(unit, 1.0) if "speed" in name else TO_YARDS.get(unit, 1.0) if name == "carry" else 1.0
        out.append((F.regexp_replace(value, ",", "").try_cast("double") * factor).alias(name))
    return rows.select(*out)
