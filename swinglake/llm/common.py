"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none, as in tests, a temporary folder is set as the checkpoint folder. On a cluster
    the setting must be there, since executors don't see each other's local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="swinglake-"))
    return context.getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors are lost.

    Results read such tables when they are computed, so a caller deletes them after that: see :func:`scratch`.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    to_delete(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def to_delete(path: str) -> None:
    """Have :func:`scratch` delete a table that was written by other means."""
    _SCRATCH.append(path)


#: Folders of the tables that ``written`` made and nothing has deleted yet.
_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """On leaving, delete the tables that ``written`` made inside: when what reads them has been written in turn."""
    outer, _SCRATCH[:] = list(_SCRATCH), []
    try:
        yield
    finally:
        for path in _SCRATCH:
            drop_path(spark, path)
        _SCRATCH[:] = outer


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder through Hadoop's file system API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m


def crc_mod_py(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m
