"""What is written: typed JSON lines, CSV and JSON reports, Markdown of small tables, and upload bodies."""

from __future__ import annotations

import gzip
import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most bytes of an upload body, packed and unpacked.
PACKED_BYTES, RAW_BYTES = 20 * 1024 * 1024, 64 * 1024 * 1024
#: Bytes of a whole radar payload.
PAYLOAD = 3072
#: The columns of a comparison, in their order.
COMPARISON = (
    "shot_number_of", "shot_number_tm", "timestamp_of", "timestamp_tm", "club", "ball_speed_of", "ball_speed_tm", "ball_speed_delta", "club_speed_of", "club_speed_tm", "club_speed_delta",
    "smash_of", "smash_tm", "smash_delta", "launch_v_of", "launch_v_tm", "launch_v_delta", "launch_h_of", "launch_h_tm", "launch_h_delta", "spin_of", "spin_tm", "spin_delta",
    "spin_candidate_of", "spin_confidence_of", "spin_quality_of", "spin_snr_of", "spin_rejection_of", "carry_of", "carry_tm", "carry_delta", "match_quality", "notes",
)


def entry_lines(df: DataFrame, kind: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """One JSON line per row: ``ts`` and ``type`` first, then the columns; nulls are left out."""
    return df.select(F.to_json(F.struct(F.col(ts).alias("ts"), F.lit(kind).alias("type"), *[F.col(c) for c in columns])).alias("value"))


def append_entries(df: DataFrame, kind: str, ts: str, columns: Sequence[str], path: str) -> None:
    """Add entries of one type to a log: files of JSON lines, which a failed run leaves out whole."""
    entry_lines(df, kind, ts, columns).write.mode("append").text(path)


def shot_columns() -> dict[str, Column]:
    """What a shot's entry derives when it is written, from its spin peak and times."""
    return {
        "spin_candidate_rpm": F.round(F.col("spin_peak_hz") * 60).cast("long"),
        "trigger_offset_ms": F.round((F.col("trigger_time") - F.col("sample_time")) * 1000, 3),
        "impact_offset_ms": F.round(F.col("impact_ms") - (F.col("trigger_time") - F.col("sample_time")) * 1000, 3),
    }


def payload_columns(frames: Column) -> dict[str, Column]:
    """What a buffer's entry derives from its frames (array of structs with ``has_radc`` and ``bytes``): counts, and whether all are whole."""
    count = lambda test: F.size(F.filter(frames, test))
    expected = count(lambda f: f["has_radc"])
    valid = count(lambda f: f["has_radc"] & (f["bytes"] == PAYLOAD))
    return {"frame_count": F.size(frames), "radc_count": expected, "radc_valid": valid, "radc_complete": (expected > 0) & (expected == valid)}


def comparison(pairs: DataFrame) -> DataFrame:
    """A comparison's 33 columns from what ``pairs`` has of them: numbers to three places, differences of a and b where both are there, the rest null."""
    kinds = dict(pairs.dtypes)

    def column(name: str) -> Column:
        if name.endswith("_delta"):
            a, b = (f"{name.removesuffix('_delta')}_{side}" for side in ("of", "tm"))
            return F.round(F.col(a) - F.col(b), 3) if a in kinds and b in kinds else F.lit(None).cast("double")
        if name not in kinds:
            return F.lit(None).cast("string")
        return F.round(F.col(name), 3) if kinds[name] == "double" else F.col(name)

    return pairs.select(*[column(name).alias(name) for name in COMPARISON])


def write_csv(reports: Sequence[DataFrame], path: str) -> None:
    """Reports as one CSV whose header is the union of their columns, in the order in which they come up."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports).write.option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary as JSON lines, nulls included."""
    df.write.option("ignoreNullFields", False).json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small aggregate as a Markdown table. A report's rows are few: more than ``most`` are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(shown, r))} |" for r in rows]) + "\n"


def upload_bodies(lines: DataFrame, key: str, number: str = "line_no", raw: str = "raw", packed_bytes: int = PACKED_BYTES, raw_bytes: int = RAW_BYTES) -> DataFrame:
    """(key, lines, bytes, refused, body): a session's lines behind a manifest line, packed; nothing is packed of a session above a cap.

    Sizes are summed before any line is gathered, so that only sessions within the cap are ever held in one task.
    """
    size = F.octet_length(raw).cast("long") + 1
    sizes = lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.sum(size).alias("bytes"))
    small = sizes.where(F.col("bytes") <= raw_bytes)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        kept = group.sort_values(number)
        text = "".join(f"{x}\n" for x in [json.dumps({"manifest": {"lines": len(kept)}}), *kept[raw]])
        body = gzip.compress(text.encode(), mtime=0)
        return pd.DataFrame({key: [group[key].iloc[0]], "body": [body if len(body) <= packed_bytes else None]})

    kind = dict(lines.dtypes)[key]
    packed = lines.join(small.select(key), key, "left_semi").select(key, number, raw).groupBy(key).applyInPandas(pack, f"`{key}` {kind}, body binary")
    refused = F.when(F.col("bytes") > raw_bytes, "too large").when(F.col("body").isNull(), "too large when packed")
    return sizes.join(packed, key, "left").select(key, "lines", "bytes", refused.alias("refused"), "body")
