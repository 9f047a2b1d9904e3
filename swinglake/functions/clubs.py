"""Constants by club, as one small table to join with or look up in.

Fixed values: results depend on them, so they are stated as they are used by launch monitors of this kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, in the order of the columns below.
COLUMNS = ["club", "optimal_launch", "spin_factor", "carry_smash", "launch_mph", "launch_deg_per_mph", "launch_smash", "typical_spin", "simulator_spin"]
ROWS = [
    ("driver", 11.0, 1.0, 1.48, 143.0, 0.15, 1.48, 2700.0, 2500.0),
    ("3-wood", 12.5, 1.15, 1.44, 135.0, 0.18, 1.44, 3500.0, 3000.0),
    ("5-wood", 14.0, 1.25, 1.42, 128.0, 0.20, 1.42, 4200.0, 3500.0),
    ("7-wood", 15.5, 1.32, 1.41, 122.0, 0.20, 1.42, 4800.0, 4000.0),
    ("3-hybrid", 13.5, 1.45, 1.39, 123.0, 0.22, 1.39, 4400.0, 3500.0),
    ("5-hybrid", 15.0, 1.55, 1.37, 118.0, 0.22, 1.38, 4900.0, 4000.0),
    ("7-hybrid", 16.5, 1.65, 1.35, 112.0, 0.25, 1.37, 5300.0, 4500.0),
    ("9-hybrid", 18.0, 1.75, 1.33, 106.0, 0.25, 1.36, 5800.0, 5000.0),
    ("2-iron", 13.0, 1.5, 1.36, 120.0, 0.25, 1.37, 4000.0, 4000.0),
    ("3-iron", 14.5, 1.6, 1.35, 118.0, 0.25, 1.36, 4500.0, 4500.0),
    ("4-iron", 16.0, 1.8, 1.33, 114.0, 0.28, 1.35, 5000.0, 5000.0),
    ("5-iron", 17.5, 2.0, 1.31, 110.0, 0.28, 1.35, 5400.0, 5500.0),
    ("6-iron", 19.0, 2.2, 1.29, 105.0, 0.30, 1.34, 6000.0, 6000.0),
    ("7-iron", 20.5, 2.5, 1.27, 100.0, 0.30, 1.34, 6500.0, 7000.0),
    ("8-iron", 23.0, 2.8, 1.25, 94.0, 0.30, 1.33, 7500.0, 8000.0),
    ("9-iron", 25.5, 3.2, 1.23, 88.0, 0.30, 1.33, 8500.0, 9000.0),
    ("pw", 28.0, 3.6, 1.21, 82.0, 0.30, 1.25, 9000.0, 9500.0),
    ("gw", 30.0, 4.1, 1.19, 76.0, 0.30, 1.23, 9500.0, 10000.0),
    ("sw", 32.0, 4.3, 1.18, 73.0, 0.30, 1.22, 10000.0, 10500.0),
    ("lw", 35.0, 4.6, 1.17, 70.0, 0.30, 1.20, 10500.0, 11000.0),
    ("unknown", 18.0, 1.0, 1.35, 120.0, 0.25, 1.35, 5000.0, 5000.0),
]
NAMES = [r[0] for r in ROWS]
WEDGES = ("pw", "gw", "sw", "lw")
SHORT_IRONS = ("6-iron", "7-iron", "8-iron", "9-iron")
#: Lanes in which a launch angle of little confidence must lie, by family.
SOFT_LANES = [
    (("driver",), 4.0, 22.0),
    (("3-wood", "5-wood", "7-wood"), 5.0, 24.0),
    (("3-hybrid", "5-hybrid", "7-hybrid", "9-hybrid"), 6.0, 26.0),
    (("2-iron", "3-iron", "4-iron", "5-iron"), 5.0, 25.0),
    (SHORT_IRONS, 7.0, 28.0),
    (WEDGES, 10.0, 45.0),
]
OTHER_LANE = (5.0, 35.0)


def dim_club(spark: SparkSession) -> DataFrame:
    """One row per club with all its constants and its place in the bag."""
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "club_order int, club string, " + ", ".join(f"{c} double" for c in COLUMNS[1:]))


def with_club(shots: DataFrame, club_col: str = "club") -> DataFrame:
    """``shots`` with the constants of their club; a club that isn't known has those of ``unknown``. 21 rows are broadcast."""
    known = F.when(F.col(club_col).isin(NAMES), F.col(club_col)).otherwise(F.lit("unknown"))
    clubs = dim_club(shots.sparkSession).withColumnRenamed("club", "__club")
    return shots.join(F.broadcast(clubs), known == F.col("__club"), "left").drop("__club")


def base_delta(club: Column) -> Column:
    """Degrees by which a radar launch angle may lie above the expected one, by family."""
    return F.when(club.isin(*WEDGES), 22.0).when(club.isin(*SHORT_IRONS), 20.0).otherwise(18.0)


def soft_lane(club: Column) -> tuple[Column, Column]:
    low, high = F.lit(OTHER_LANE[0]), F.lit(OTHER_LANE[1])
    for names, a, b in reversed(SOFT_LANES):
        low, high = F.when(club.isin(*names), a).otherwise(low), F.when(club.isin(*names), b).otherwise(high)
    return low, high


def values_sql() -> str:
    """The table as portable SQL."""
    rows = ", ".join("(" + ", ".join([str(i), f"'{r[0]}'", *(f"CAST({v} AS DOUBLE)" for v in r[1:])]) + ")" for i, r in enumerate(ROWS))
    return f"SELECT * FROM (VALUES {rows}) AS c(club_order, {', '.join(COLUMNS)})"
