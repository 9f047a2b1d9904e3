"""Exact deduplication by 128-bit content hash, with bytes compared inside groups.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space;
a null text counts as empty. Defined results: an empty table gives an empty result; a null id sorts
first and so stays; rows that repeat an id and a text share that id's verdict in :func:`exact_groups`,
while :func:`drop_exact_duplicates` keeps one row of them; further columns, whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import SPACE, table, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Grouping on (hash, text) combines before its shuffle, so a large group of copies costs one row per
    task, and it compares the bytes of texts whose hashes agree. The narrow join back goes by hash;
    only where one hash stands for two texts does it go by the text as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn(
        "h", F.unhex(F.md5("norm"))
    )
    groups = written(
        rows.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.count_if(F.col("id").isNull()).alias("no_id"))
        .select("h", F.when(F.col("no_id") == 0, F.col("keep_id")).alias("keep_id"), "group_size", F.sha2("norm", 256).alias("text_sha256")),
        "exact-groups",
    )
    collided = groups.groupBy("h").count().where("count > 1").select("h")
    if collided.isEmpty():
        members = rows.select("id", "h").join(groups, "h")
    else:  # the full digest then tells the texts of one hash apart, and a byte comparison confirmed them above
        members = rows.select("id", "h", F.sha2("norm", 256).alias("text_sha256")).join(groups, ["h", "text_sha256"])
    return members.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the smallest id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    norm = normalised(F.col(text_col))
    return (
        docs.select(F.unhex(F.md5(norm)).alias("__h"), norm.alias("__norm"), row.alias("__row"), order.alias("__order"))
        .groupBy("__h", "__norm")
        .agg(F.min_by("__row", "__order").alias("__row"))
        .select("__row.*")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH norm AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM norm
"""
