"""Views of shot data over the star schema's tables, stated once in SQL that Spark and DuckDB both read.

No golf data is in those tables; each view maps a table onto the shape of a session log, so that operators run at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swinglake.functions.clubs import NAMES


def _d(x: str, by: float = 1) -> str:
    return f"(CAST({x} AS DOUBLE) / CAST({by} AS DOUBLE))"


_CLUB = "CASE CAST({} AS INT) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(NAMES)) + " ELSE 'putter' END"
_CLUB4 = "CASE CAST({} AS INT) WHEN 0 THEN 'driver' WHEN 1 THEN '7-iron' WHEN 2 THEN 'pw' ELSE '5-wood' END"

#: View name to (table, SQL). {t} is the table, {us} microseconds of a timestamp column since 1970.
LENSES: dict[str, tuple[str, str]] = {
    "readings": (
        "events",
        """SELECT user_id AS session_id, event_id AS seq, {us} AS us, value AS speed_mph,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS magnitude,
        CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'outbound' ELSE 'inbound' END AS direction, event_type
        FROM {t}""",
    ),
    "shots": (
        "orders",
        f"""SELECT o_custkey AS session_id, o_orderkey AS shot_number, {{us}} AS us, {_CLUB.format("o_orderkey % 22")} AS club,
        60 + {_d("o_orderkey * 37 % 1300", 10)} AS ball_speed,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE 45 + {_d("o_orderkey * 53 % 900", 10)} END AS club_speed,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1500 + {_d("o_orderkey * 71 % 9000")} END AS spin_rpm,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {_d("o_orderkey * 13 % 100", 100)} END AS spin_confidence,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {_d("o_orderkey * 29 % 500", 10)} - 2 END AS launch_v,
        {_d("o_orderkey * 17 % 100", 100)} AS launch_confidence, CAST(o_orderkey * 7 % 50 AS INT) AS num_frames,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {_d("o_orderkey * 31 % 360", 10)} - 18 END AS launch_h,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_d("o_orderkey * 19 % 100", 10)} - 5 END AS face_deg,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {_d("o_orderkey * 23 % 80", 10)} - 4 END AS path_deg,
        3 + {_d("o_orderkey % 50", 10)} AS distance_ft, {_d("o_orderkey % 20", 10)} - 1 AS above_ft
        FROM {{t}}""",
    ),
    "device": (
        "lineitem",
        f"""SELECT {_CLUB4.format("l_partkey % 4")} AS club, {{us}} AS us, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {_d("CAST(l_quantity AS BIGINT) * 3 + l_partkey % 10")} AS ball_speed, {_d("l_suppkey % 60")} + l_discount * 100 AS launch_v,
        {_d("l_orderkey % 5", 4)} AS confidence, CAST(l_partkey % 7 AS INT) AS frames, l_suppkey % 6 AS source_id
        FROM {{t}} WHERE l_linenumber % 2 = 1""",
    ),
    "truth": (
        "lineitem",
        f"""SELECT {_CLUB4.format("l_partkey % 4")} AS club, {{us}} AS us, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {_d("CAST(l_quantity AS BIGINT) * 3 + l_suppkey % 10")} AS ball_speed, {_d("l_suppkey % 60")} + l_tax * 100 AS launch_v
        FROM {{t}} WHERE l_linenumber % 2 = 0""",
    ),
}
_TIME = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = LENSES[name]
    us = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({_TIME[table]} AS TIMESTAMP_NTZ))"
    return spark.sql(sql.format(t="{t}", us=us), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def lens_sql(name: str) -> str:
    """The view as DuckDB SQL, to stand in a WITH clause."""
    table, sql = LENSES[name]
    return sql.format(t=table, us=f"epoch_us({_TIME[table]}::TIMESTAMP)")


def with_lenses(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({lens_sql(n)})" for n in names)
