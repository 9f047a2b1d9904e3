"""Statistics that differ from Spark's own in ties, empty groups or constant columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_columns(e: str) -> list[Column]:
    """n, bias, mae and rmse of an error column, to four places."""
    x = F.col(e)
    return [
        F.count(x).alias("n"),
        F.round(F.avg(x), 4).alias("bias"),
        F.round(F.avg(F.abs(x)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(x * x)), 4).alias("rmse"),
    ]


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, times: str | None = None) -> DataFrame:
    """Per key, the value at place round(p * (n - 1)), halves to even, of the sorted values that aren't null; a row counts ``times`` (once).

    Equal values are counted first, so a group's window holds its distinct values only.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(times or F.lit(1)).alias("__k"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    place = F.bround(F.lit(p) * (F.sum("__k").over(whole) - 1), 0)
    return (
        distinct.withColumn("__upto", F.sum("__k").over(order))
        .withColumn("__at", place)
        .where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__k") <= F.col("__at")))
        .select(*keys, value)
    )


#: Strips of a factor of two that values are counted in.
STRIPS = 64


def quantiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...], times: str | None = None) -> DataFrame:
    """Per key ``q``: the quantiles of the values that aren't null, between neighbours by linear interpolation; a row counts ``times`` (once).

    No task holds a key's values: they are counted by strips, about one percent of a value wide, and only the strips in which a
    wanted place lies are ranked, equal values counted first. Keys without a value are left out.
    """
    v = F.col("__v")
    strip = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * STRIPS) + 2000 * STRIPS)).cast("int")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), (F.col(times) if times else F.lit(1)).alias("__w")).withColumn("__strip", strip)
    order, whole = Window.partitionBy(*keys).orderBy("__strip"), Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "__strip").agg(F.sum("__w").alias("__n")).withColumns(
        {"__before": F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum("__n").over(whole)}
    )
    spot = [F.lit(float(p)) * (F.col("__all") - 1) for p in ps]
    places = F.array_distinct(F.array(*[f(x).cast("long") for x in spot for f in (F.floor, F.ceil)]))
    wanted = F.filter(places, lambda x: (x >= F.col("__before")) & (x < F.col("__before") + F.col("__n")))
    kept = counts.withColumn("__wanted", wanted).where(F.size("__wanted") > 0)
    kept = kept.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__strip").alias("__s"), "__before", "__all", "__wanted")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    held = rows.join(kept, [*same, F.col("__strip") == F.col("__s")]).groupBy(*keys, "__strip", "__v")
    held = held.agg(F.sum("__w").alias("__c"), F.first("__before").alias("__before"), F.first("__all").alias("__all"), F.first("__wanted").alias("__wanted"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__strip").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("__upto", upto)
    hits = held.select(*keys, "__all", "__v", F.explode(F.filter("__wanted", lambda x: (x < F.col("__upto")) & (x >= F.col("__upto") - F.col("__c")))).alias("__at"))
    found = hits.groupBy(*keys).agg(F.first("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__at", "__v"))).alias("__m"))
    low, high = ([F.element_at("__m", f(x).cast("long")) for x in spot] for f in (F.floor, F.ceil))
    return found.select(*keys, F.array(*[a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, spot, strict=True)]).alias("q"))


def sums(x: str, y: str) -> list[Column]:
    """What correlation and fits need of pairs without nulls: number, means, and variances and covariance about the means."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return [F.count(a).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("cxy")]


def pearson() -> Column:
    """From :func:`sums`; null where a side is constant."""
    return F.when((F.col("n") > 1) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy")))


def slope_intercept() -> tuple[Column, Column]:
    """Least squares of y on x, from :func:`sums`; 1 and 0 where it isn't determined."""
    fits = (F.col("n") > 1) & (F.col("vx") > 0)
    slope = F.when(fits, F.try_divide(F.col("cxy"), F.col("vx"))).otherwise(1.0)
    return slope, F.when(fits, F.col("my") - slope * F.col("mx")).otherwise(0.0)
