"""Streaming forms: health by window, shots with their frames, gap sessions, running statistics, clock and retry state.

Each takes a streaming (or batch) DataFrame and returns one; sources and sinks are the caller's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from swinglake.sources import scans

#: Seconds between attempts to reconnect; the last one repeats.
BACKOFF_S = (1, 2, 4, 8, 16, 30)
MAX_ATTEMPTS, COOLDOWN_S = 20, 24 * 3600


def tumbling_health(frames: DataFrame, at: str = "ts", window: str = "10 seconds", seconds: float = 10.0, least_hz: float = 25.0, late: str = "1 minute") -> DataFrame:
    """Frames per second of each window, and whether that is too few. Late frames count until the watermark passes."""
    rate = F.count(F.lit(1)) / seconds
    grouped = frames.withWatermark(at, late).groupBy(F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(rate, 4).alias("hz"))
    return grouped.select(F.col("w.start").alias("start"), "n", "hz", (F.col("hz") < least_hz).alias("low"))


def shot_frames(shots: DataFrame, frames: DataFrame, key: str, before: str = "6 seconds", after: str = "750 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Frames in the closed interval around each shot, as a stream-stream join bounded by both watermarks.

    ``shots``: key, shot, shot_ts. ``frames``: key, frame, frame_ts.
    """
    s = shots.withWatermark("shot_ts", late).alias("s")
    f = frames.withWatermark("frame_ts", late).alias("f")
    near = F.expr(f"s.{key} = f.{key} AND frame_ts >= shot_ts - INTERVAL {before} AND frame_ts <= shot_ts + INTERVAL {after}")
    return s.join(f, near).select(F.col(f"s.{key}"), "shot", "shot_ts", "frame", "frame_ts")


def gap_sessions(readings: DataFrame, key: str, at: str = "ts", gap: str = "450 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sessions by time gap. Spark closes a session at the gap itself, so one microsecond is added to keep a gap of exactly the limit inside."""
    return (
        readings.withWatermark(at, late)
        .groupBy(F.session_window(at, f"{gap} 1 microsecond").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
        .select(key, F.col("w.start").alias("start"), "last", "n")
    )


def running_stats(shots: DataFrame, key: str) -> DataFrame:
    """Statistics of all shots so far, for update or complete mode."""
    return shots.groupBy(key).agg(
        F.count(F.lit(1)).alias("shot_count"), F.avg("ball_speed").alias("avg_ball"), F.max("ball_speed").alias("max_ball"), F.coalesce(F.stddev_samp("ball_speed"), F.lit(0.0)).alias("sd_ball")
    )


def _expire(state: GroupState, seconds: float) -> None:
    """Let the state go once the watermark passes that time: at once if it has."""
    ms = math.floor(seconds * 1000) + 1
    if ms <= state.getCurrentWatermarkMs():
        state.remove()
    else:
        state.setTimeoutTimestamp(ms)


def _seconds(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[ns]").astype("int64").to_numpy() / 1e9


def _in_order(batches: Iterator[pd.DataFrame], at: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(at, kind="stable", ignore_index=True)


def debounced(events: DataFrame, key: str, at: str = "ts", seconds: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """Events at least ``seconds`` after the last one that was let through, per key. The state is one time, and goes once it can't hold anything back."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        batch = _in_order(batches, at)
        kept = []
        for i, t in enumerate(_seconds(batch[at])):
            if last is None or t - last >= seconds:
                kept.append(i)
                last = float(t)
        state.update((last,))
        _expire(state, last + seconds)
        yield batch.iloc[kept]

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, events.schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def clock_state(reads: DataFrame, key: str, at: str = "ts", ttl_s: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """Each read with the clock offset in force: its own if it is valid, else the last valid one no older than the limit, after which the state goes.

    ``reads`` has ``offset_s``, null where the read was not valid.
    """
    schema = f"{key} long, {at} timestamp, offset_s double, source string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        offset, since = state.get if state.exists else (None, None)
        batch = _in_order(batches, at)
        seconds = pd.Series(_seconds(batch[at]), batch.index)
        own = batch["offset_s"].notna()
        last = batch["offset_s"].ffill().fillna(math.nan if offset is None else offset)
        last_at = seconds.where(own).ffill().fillna(math.nan if since is None else since)
        held = (seconds - last_at <= ttl_s) & last.notna()
        source = pd.Series("none", batch.index).mask(held, "previous").mask(own, "fresh")
        if last.notna().iloc[-1]:
            state.update((float(last.iloc[-1]), float(last_at.iloc[-1])))
            _expire(state, float(last_at.iloc[-1]) + ttl_s)
        yield pd.DataFrame({key: k[0], at: batch[at], "offset_s": last.where(held), "source": source})

    return reads.select(key, at, "offset_s").withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "offset_s double, at double", "append", GroupStateTimeout.EventTimeTimeout)


def upload_states(results: DataFrame, key: str = "file", at: str = "ts", keep_s: float = 7 * 24 * 3600.0, late: str = "1 hour") -> DataFrame:
    """After each upload result (an HTTP status) the file's state: pushed, retry or parked, attempts, and the time before which it rests.

    2xx pushes, 429 and 5xx are tried again after a growing pause, other statuses park the file, and so do too many attempts. A file
    without a result for ``keep_s`` is forgotten.
    """
    schema = f"{key} string, {at} timestamp, state string, attempts int, rest_until double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, attempts, rest = state.get if state.exists else ("pending", 0, 0.0)
        batch = _in_order(batches, at)
        times, out = _seconds(batch[at]), []
        for t, status in zip(times, batch["status"], strict=True):
            if name not in ("pushed", "parked"):
                attempts += 1
                if 200 <= status < 300:
                    name, rest = "pushed", 0.0
                elif (status == 429 or status >= 500) and attempts < MAX_ATTEMPTS:
                    name, rest = "retry", float(t) + BACKOFF_S[min(attempts - 1, len(BACKOFF_S) - 1)]
                else:
                    name, rest = "parked", float(t) + COOLDOWN_S
            out.append((name, attempts, rest))
        state.update((name, attempts, rest))
        _expire(state, float(times[-1]) + keep_s)
        yield pd.DataFrame(out, columns=["state", "attempts", "rest_until"]).assign(**{key: k[0], at: batch[at]})[[key, at, "state", "attempts", "rest_until"]]

    return results.select(key, at, "status").withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "state string, attempts int, rest_until double", "append", GroupStateTimeout.EventTimeTimeout)


def ring_buffer(frames: DataFrame, key: str, at: str = "ts", size: int = 204, keep_s: float = 3600.0, late: str = "10 seconds") -> DataFrame:
    """After each batch the keys' newest ``size`` frames by number, and how many older ones were let go; state holds numbers only, and none for a key that is silent for ``keep_s``."""
    schema = f"{key} long, newest long, held int, dropped long"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        batch = _in_order(batches, at)
        held += batch["frame"].tolist()
        over = max(0, len(held) - size)
        held, dropped = held[over:], dropped + over
        state.update((held, dropped))
        _expire(state, float(_seconds(batch[at])[-1]) + keep_s)
        yield pd.DataFrame([(k[0], held[-1] if held else None, len(held), dropped)], columns=[key, "newest", "held", "dropped"])

    return frames.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "held array<bigint>, dropped long", "update", GroupStateTimeout.EventTimeTimeout)


def waited_frames(events: DataFrame, key: str, at: str = "ts", wait_s: float = 0.18, before_s: float = 6.0, late: str = "1 second") -> DataFrame:
    """For each shot its frames from ``before_s`` before to ``wait_s`` after it, given once the watermark says that no more can come.

    ``events`` has ``shot`` and ``frame``, one of them null. A timer wakes the key when a shot is due, whether or not anything else arrives. State
    holds the shots that wait, and the numbers and times of frames that they or a shot to come may need; then it goes.
    """
    schema = f"{key} long, shot long, {at} timestamp, frames array<bigint>"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shots, shot_at, frames, frame_at = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        if not state.hasTimedOut:
            batch = pd.concat(list(batches))
            times = _seconds(batch[at])
            is_shot = batch["shot"].notna().to_numpy()
            shots += batch["shot"][is_shot].astype(int).tolist()
            shot_at += times[is_shot].tolist()
            frames += batch["frame"][~is_shot].astype(int).tolist()
            frame_at += times[~is_shot].tolist()
        now = state.getCurrentWatermarkMs() / 1000
        order, t = np.argsort(frame_at, kind="stable"), np.array(frame_at, float)
        due = sorted((x, s) for x, s in zip(shot_at, shots, strict=True) if x + wait_s < now)
        out = [(k[0], s, pd.Timestamp(round(x * 1e6), unit="us"), [frames[i] for i in order if x - before_s <= t[i] <= x + wait_s]) for x, s in due]
        waiting = [(x, s) for x, s in zip(shot_at, shots, strict=True) if x + wait_s >= now]
        # a shot to come is not older than the watermark
        oldest = min([now, *(x for x, _ in waiting)]) - before_s
        kept = [i for i in order if t[i] >= oldest]
        wake = [x + wait_s for x, _ in waiting] + [t[i] + before_s for i in kept[-1:]]
        if wake:
            state.update(([s for _, s in waiting], [float(x) for x, _ in waiting], [frames[i] for i in kept], [float(t[i]) for i in kept]))
            state.setTimeoutTimestamp(max(math.floor(min(wake) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "shot", at, "frames"])

    form = "shots array<bigint>, shot_at array<double>, frames array<bigint>, frame_at array<double>"
    return events.select(key, at, "shot", "frame").withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, form, "append", GroupStateTimeout.EventTimeTimeout)


def drained_diagnostics(events: DataFrame, key: str, at: str = "ts", keep_s: float = 600.0, late: str = "10 seconds") -> DataFrame:
    """Diagnostics of a trigger, given when its cycle ends: each with its own latency, or the cycle's where it has none.

    ``events`` has ``reason`` and ``latency_ms``; an event without a reason ends the cycle, its latency is the cycle's. What
    no cycle ends within ``keep_s`` is let go with a latency of null.
    """
    schema = f"{key} long, {at} timestamp, reason string, latency_ms double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_at, reasons, latencies = (list(x) for x in state.get) if state.exists else ([], [], [])
        held = pd.DataFrame({at: pd.to_datetime(pd.Series(held_at, dtype="int64"), unit="us"), "reason": pd.Series(reasons, dtype=object), "latency_ms": pd.Series(latencies, dtype=float)})
        if state.hasTimedOut:
            state.remove()
            yield held.assign(**{key: k[0]}, latency_ms=held["latency_ms"].where(held["latency_ms"] > 0))[[key, at, "reason", "latency_ms"]]
            return
        batch = pd.concat([held, _in_order(batches, at)[[at, "reason", "latency_ms"]]], ignore_index=True)
        ends = batch["reason"].isna()
        cycle = batch["latency_ms"].where(ends).bfill()
        told = batch[~ends & ends[::-1].cummax()[::-1]]
        left = batch[~ends & ~ends[::-1].cummax()[::-1]]
        if len(left):
            us = left[at].astype("datetime64[us]").astype("int64")
            state.update((us.tolist(), left["reason"].tolist(), left["latency_ms"].fillna(0.0).astype(float).tolist()))
            _expire(state, us.iloc[-1] / 1e6 + keep_s)
        elif state.exists:
            state.remove()
        own = told["latency_ms"].where(told["latency_ms"] > 0)
        yield told.assign(**{key: k[0]}, latency_ms=own.fillna(cycle[told.index]))[[key, at, "reason", "latency_ms"]]

    form = "at array<bigint>, reasons array<string>, latencies array<double>"
    return events.select(key, at, "reason", "latency_ms").withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, form, "append", GroupStateTimeout.EventTimeTimeout)


def buffer_warnings(joined: DataFrame, key: str, window_s: float = 6.75, hz: float = 34.0, after_s: float = 0.75, least: float = 0.5) -> DataFrame:
    """Of each shot with its frames (rows of :func:`shot_frames`): how many it has, whether that is under the share of what its window should
    hold, and whether none came after the shot. ``joined`` is a batch, or one micro-batch of the stream."""
    late = F.count_if(F.col("frame_ts") > F.col("shot_ts"))
    counts = joined.groupBy(key, "shot", "shot_ts").agg(F.count("frame").alias("frames"), late.alias("after"))
    return counts.select(key, "shot", "frames", (F.col("frames") < least * window_s * hz).alias("underfilled"), (F.col("after") == 0).alias("nothing_after"))


def uploadable(lines: DataFrame, types: tuple[str, ...], dropped: tuple[str, ...] = ("radc_b64", "frames", "i_samples", "q_samples"), raw: str = "raw") -> DataFrame:
    """Lines of the allowed types without their raw payloads: a projection, so it runs on a stream as on a table. Other lines and broken ones are left out."""
    fields = F.from_json(raw, "map<string, variant>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*dropped))
    return lines.withColumn("__f", kept).where(F.try_variant_get(F.col("__f")["type"], "$", "string").isin(*types)).withColumn(raw, F.to_json("__f")).drop("__f")


def shot_buffers(events: DataFrame, key: str, at: str = "ts", size: int = 204, keep_s: float = 3600.0, late: str = "10 seconds") -> DataFrame:
    """For each shot the frames held since the shot before it, at most the newest ``size``; the buffer is then empty.

    ``events`` has ``frame``, null where the event is a shot. State holds frame numbers only, and none for a key that is silent for ``keep_s``.
    """
    schema = f"{key} long, {at} timestamp, frames array<bigint>"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        batch = _in_order(batches, at)
        shots = batch["frame"].isna().to_numpy()
        turn = shots.cumsum() - shots  # how many shots came before
        out = []
        for n, part in batch.groupby(turn):
            held += part["frame"].dropna().astype(int).tolist()
            if n < shots.sum():
                out.append((k[0], part[at].iloc[-1], held[-size:]))
                held = []
        state.update((held[-size:],))
        _expire(state, float(_seconds(batch[at])[-1]) + keep_s)
        yield pd.DataFrame(out, columns=[key, at, "frames"])

    return events.select(key, at, "frame").withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def log_tail(spark: SparkSession, folder: str, labels: tuple[str, ...] = ("type", "session_uuid", "device_id"), fields: tuple[str, ...] = ("ts", "message"), per_trigger: int = 100) -> DataFrame:
    """The new lines of a folder's logs as a stream, with labels and fields from their JSON; a checkpoint resumes where the last run stopped."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder).withColumnRenamed("value", "raw")
    return scans.labelled_tail(lines, labels, fields)
