"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target, in words, is what its weight gives it of the whole mix, up to ``max_copies`` times its
size; what is above is shared among the others. A document is expected ``target * weight / sum(weight * size)``
times; the whole part of that is allocated for certain and its fraction p enters a Pareto sample: documents are
ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of the id, and taken from the smallest on until the source's
fixed size is filled. The last words are filled with the one remaining document whose size is nearest to the gap.

No source passes through one task: ranks are summed in buckets of the rank's range, and only the bucket in which
a source's quota ends is ordered document by document. Which documents are in is then a threshold per source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words
has target 0; an empty table gives an empty result; rows that repeat an id draw the same number, so they are in or out
together; reruns agree, as u depends on the id and seed alone. Further columns are carried by :func:`mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.llm.common import WORD, table, written

BUCKETS = 4096
#: Tables with a row for each source go to all tasks where there are at most so many sources, and by shuffle beyond.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """One row per source: key, source_size, target. ``sizes``: key, size.

    With sources ordered by cap / weight, those before the first whose cap is above the level of the rest are
    full, and the level of the rest is what is left over their weights: the limit of sharing the excess again.
    """
    by_source = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy((F.col("key") == "n").cast("int"), "key")
    fill = Window.orderBy("ratio", "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = (
        by_source.withColumn("place", F.row_number().over(in_order) - 1)
        .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(max_copies))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(whole) * float(share))
    )
    levels = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "key", "level"))).over(whole)
    return levels.select(
        "key",
        "source_size",
        F.least("cap", F.coalesce(F.col("w") * level["level"], F.col("cap"))).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_copies: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """One row per document: id, key, size, source_size, target, copies.

    ``weight_col``, if given, holds positive weights that make documents of one source unequally likely.
    """
    w = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    sizes = written(
        docs.select(
            F.col(id_col).alias("id"),
            _source_key(F.col(source_col)).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            w.alias("weight"),
            uniform(F.col(id_col), seed).alias("u"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, share, max_copies)
    if weight_col:
        weighed = sizes.groupBy("key").agg(F.sum(F.col("weight") * F.col("size")).alias("mass"))
    else:
        weighed = targets.select("key", F.col("source_size").cast("double").alias("mass"))
    targets = written(targets.join(weighed, "key"), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda df: df
    rate = F.when(F.col("mass") > 0, F.col("target") * F.col("weight") / F.col("mass")).otherwise(0.0)
    ranked = (
        sizes.join(small(targets), "key")
        .withColumn("rate", F.least(rate, F.lit(float(max_copies))))
        .withColumn("certain", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("certain"))
        .withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("v", F.col("q") / (1 + F.col("q")))
        .withColumn("bucket", F.floor(F.col("v") * BUCKETS))
    )
    quota = ranked.groupBy("key").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("quota"))
    sums = ranked.where("v IS NOT NULL").groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("key").orderBy("bucket")
    edges = written(
        sums.join(small(quota), "key")
        .withColumn("upto", F.sum("words").over(running))
        .groupBy("key", "quota")
        .agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("quota"), F.col("bucket"))), F.lit(-1)).alias("full"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("quota"), F.col("upto"))), F.lit(0)).alias("filled"),
            F.min(F.when(F.col("upto") > F.col("quota"), F.col("bucket"))).alias("edge"),
        ),
        "mix-edges",
    )
    at_edge = ranked.join(small(edges), "key").where(F.col("bucket") == F.col("edge"))
    ties = at_edge.groupBy("key", "v").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("filled").alias("filled"))
    cut = (
        ties.withColumn("upto", F.col("filled") + F.sum("words").over(Window.partitionBy("key").orderBy("v")))
        .where(F.col("upto") <= F.col("quota"))
        .groupBy("key")
        .agg(F.max("v").alias("last_v"), F.max("upto").alias("words"))
    )
    cuts = edges.join(cut, "key", "left").select(
        "key", "quota", "full", F.coalesce("last_v", F.lit(-1.0)).alias("last_v"), (F.col("quota") - F.coalesce("words", "filled")).alias("gap")
    )
    inside = F.coalesce((F.col("bucket") <= F.col("full")) | (F.col("v") <= F.col("last_v")), F.lit(False))
    drawn = ranked.join(small(cuts), "key", "left").withColumn("inside", inside)
    miss = F.abs(F.col("size") - F.col("gap"))
    closing = (
        drawn.where(~F.col("inside") & F.col("v").isNotNull() & (miss < F.col("gap")))
        .groupBy("key")
        .agg(F.min(F.struct(miss.alias("miss"), "v", "id")).alias("best"))
        .select("key", F.col("best.v").alias("best_v"), F.col("best.id").alias("best_id"))
    )
    closes = F.coalesce((F.col("v") == F.col("best_v")) & F.col("id").eqNullSafe(F.col("best_id")), F.lit(False))
    return drawn.join(small(closing), "key", "left").select(
        "id", "key", "size", "source_size", "target", (F.col("certain") + (F.col("inside") | closes).cast("long")).cast("long").alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan takes it, with all its columns."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    plan = mix_plan(docs, **options).groupBy("id", "key").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    plan = plan.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "__copies")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (_source_key(F.col(source_col)) == F.col("__key"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.join(plan, same).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH sizes AS (
    SELECT doc_id, coalesce('s' || source, 'n') AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           (CAST('0x' || substr(md5('0:' || doc_id), 1, 13) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
    FROM documents
), by_source AS (
    SELECT key, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
           [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY key = 'n', key) - 1) % 3] AS w
    FROM sizes GROUP BY key
), levels AS (
    SELECT *, cap / w AS ratio,
           (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM by_source
), targets AS (
    SELECT key, source_size,
           least(cap, coalesce(w * (SELECT arg_min(level, (ratio, key)) FROM levels WHERE ratio >= level), cap)) AS target
    FROM levels
), rated AS (
    SELECT doc_id, key, size, source_size, target, u,
           CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate
    FROM sizes JOIN targets USING (key)
), ranked AS (
    SELECT *, floor(rate) AS certain, rate - floor(rate) AS p,
           CASE WHEN rate > floor(rate) THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS q
    FROM rated
), summed AS (
    SELECT *, q / (1 + q) AS v,
           target - sum(certain * size) OVER (PARTITION BY key) AS quota,
           CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY key ORDER BY q / (1 + q)) END AS upto
    FROM ranked
), drawn AS (
    SELECT *, coalesce(upto <= quota, false) AS inside,
           quota - coalesce(max(CASE WHEN upto <= quota THEN upto END) OVER (PARTITION BY key), 0) AS gap
    FROM summed
), closing AS (
    SELECT key, arg_min(doc_id, (abs(size - gap), v, doc_id)) AS best
    FROM drawn WHERE NOT inside AND v IS NOT NULL AND abs(size - gap) < gap GROUP BY key
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (certain + (inside OR coalesce(doc_id = best, false))::INT))::BIGINT AS taken
FROM drawn LEFT JOIN closing USING (key)
"""
