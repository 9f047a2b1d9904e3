"""All queries of the library by name, and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swinglake.operators import accuracy, enrichment, frames, gates, health, joins, launch, linking, logs, pairing, replays, sessions, signals, spin, summaries, tracks, writing

FLAGSHIP = "pair_error_by_club"
_ALL = {name: pair for module in (pairing, accuracy, sessions, enrichment, joins, logs, signals, tracks, health, gates, linking, summaries, writing, launch, spin, frames, replays) for name, pair in module.QUERIES.items()}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
