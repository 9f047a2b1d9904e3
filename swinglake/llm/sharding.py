"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

The shards are nodes: an old shard holds bytes to give away, a new one has a capacity to fill, and a byte that stays
costs nothing while one that moves costs 1 (or what ``cost`` says). Successive shortest paths solve that graph, whose
size is that of the shard counts alone. The flow from an old to a new shard is then a block of the old shard's files,
laid end to end, what stays before what moves. A file inside one block stays untouched or moves whole; a file that
lies on the edge of blocks is cut: its documents, the largest first, each go to the block that still lacks most, so
that blocks come out near equal. Only files that move or are cut are read and written.

A table (:func:`lay_out`) is a folder of Parquet files with numbered manifests, of which the highest counts: one line a
file with its shard, rows and bytes. :func:`reshard` writes new files beside the old ones, then the next manifest by one
rename, then deletes files that it doesn't list. A run that stops anywhere leaves the old or the new table whole, and
running it again brings it to its end: a table that already has its shards is only tidied. A document's slot is the
number of rows of its shard's files before its own, and its place in the file.

Law: ``bytes``. Equal texts are separate documents here, and may come into different shards.

Defined results: a null text has 0 bytes and still its fixed overhead; null ids, and rows that repeat an id or are alike
throughout, are rows like any others, as a row is known by its file and place; a document larger than a capacity goes
whole; an empty table gives an empty result; further columns are carried, whatever their names but ``__shard``.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from swinglake.llm.common import shared_path, table, written

OVERHEAD = 16
#: Tables with a row for each file go to all tasks up to so many files, and are joined by shuffle beyond.
BROADCAST_FILES = 100_000


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """flow[i, j] from supplies to demands at the least total cost, by successive shortest paths. The sums must agree."""
    left, need = np.array(supply, object), np.array(demand, object)
    if left.sum() != need.sum():
        raise ValueError("supply and demand differ")
    n, m = len(left), len(need)
    cost = np.asarray(cost, float)
    flow = np.zeros((n, m), object)
    while left.any():
        # Bellman-Ford from all sources that have something left; edges back from a sink exist where there is flow
        far, near = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        to_sink, to_source = np.zeros(m, int), np.full(n, -1)
        back = np.where(flow > 0, cost, np.nan)
        while True:
            through = far[:, None] + cost
            best = through.min(0)
            better = best < near - 1e-12
            near = np.where(better, best, near)
            to_sink = np.where(better, through.argmin(0), to_sink)
            returned = np.where(np.isnan(back), np.inf, near[None, :] - np.nan_to_num(back))
            again = returned.min(1)
            closer = again < far - 1e-12
            if not closer.any():
                break
            far = np.where(closer, again, far)
            to_source = np.where(closer, returned.argmin(1), to_source)
        j = int(np.argmin(np.where(need > 0, near, np.inf)))
        path, sink = [], j
        while True:
            i = int(to_sink[sink])
            path.append((i, sink, 1))
            if to_source[i] < 0 or far[i] == 0.0 and left[i] > 0:
                break
            sink = int(to_source[i])
            path.append((i, sink, -1))
        amount = min([need[j], left[i], *(flow[a, b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a, b] += way * amount
        left[i] -= amount
        need[j] -= amount
    return flow


def transfer_plan(sizes: Sequence[int], capacities: Sequence[int], cost: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, from byte, to byte): the blocks of each old shard, in the order in which they are cut."""
    if cost is None:
        cost = 1.0 - np.eye(len(sizes), len(capacities))
    flow = min_cost_flow(sizes, capacities, cost)
    plan = []
    for i in range(len(sizes)):
        at = 0
        order = sorted(range(len(capacities)), key=lambda j: (cost[i, j], j))
        for j in order:
            if flow[i, j]:
                plan.append((i, j, int(at), int(at + flow[i, j])))
                at += flow[i, j]
    return plan


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass(frozen=True)
class File:
    name: str  # below the table's folder
    shard: int
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    number: int
    shards: int
    schema: StructType
    files: list[File]


def document_size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + OVERHEAD


def _folder(spark: SparkSession, path: str):
    """(Hadoop's class of paths, file system) of a folder."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The table's highest manifest. It has a line for each file, as Spark's own index of a table has."""
    kind, system = _folder(spark, path)
    at = kind(f"{path}/_manifest")
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return None
    stream = system.open(kind(f"{path}/_manifest/{max(numbers):08d}"))
    try:
        head, *lines = bytes(stream.readAllBytes()).decode().splitlines()
    finally:
        stream.close()
    head = json.loads(head)
    return Manifest(max(numbers), head["shards"], StructType.fromJson(head["schema"]), [File(**json.loads(x)) for x in lines])


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Write a manifest under its number, which no other may have: by a rename, so that none is ever half there."""
    kind, system = _folder(spark, path)
    lines = [json.dumps({"shards": new.shards, "schema": json.loads(new.schema.json())}), *(json.dumps(asdict(f)) for f in new.files)]
    part = kind(f"{path}/_manifest/_{uuid.uuid4().hex}")
    stream = system.create(part, False)
    stream.write(bytearray("\n".join(lines).encode()))
    stream.close()
    final = kind(f"{path}/_manifest/{new.number:08d}")
    if system.exists(final) or not system.rename(part, final):
        raise OSError(f"manifest {new.number} of {path} was written by another run")


def _tidy(spark: SparkSession, path: str) -> None:
    """Delete files that the highest manifest doesn't list, and older manifests."""
    kept = manifest(spark, path)
    names = {f.name for f in kept.files}
    kind, system = _folder(spark, path)
    for generation in system.listStatus(kind(path)):
        name = generation.getPath().getName()
        if name == "_manifest":
            for old in system.listStatus(generation.getPath()):
                if old.getPath().getName() != f"{kept.number:08d}":
                    system.delete(old.getPath(), False)
        else:
            found = system.listFiles(generation.getPath(), True)
            while found.hasNext():
                at = found.next().getPath()
                if f"{name}/{at.getParent().getName()}/{at.getName()}" not in names:
                    system.delete(at, False)


def _write(rows: DataFrame, path: str, text_col: str, schema: StructType, **options) -> list[File]:
    """Write ``rows`` (with ``__shard``) as new files of the table, and return them."""
    spark = rows.sparkSession
    name = f"files-{uuid.uuid4().hex}"
    rows.write.options(**options).partitionBy("__shard").parquet(f"{path}/{name}")
    kind, system = _folder(spark, path)
    found = [f"{name}/{d.getPath().getName()}" for d in system.listStatus(kind(f"{path}/{name}")) if d.isDirectory()]
    if not found:
        return []
    at = _located(spark.read.schema(schema).parquet(*[f"{path}/{d}" for d in found]))
    counts = at.groupBy("__file").agg(F.count(F.lit(1)).alias("rows"), F.sum(document_size(text_col)).alias("bytes")).collect()  # a row for each file
    return sorted((File(r["__file"], int(r["__file"].split("=")[1].split("/")[0]), r["rows"], r["bytes"]) for r in counts), key=lambda f: (f.shard, f.name))


def _located(rows: DataFrame) -> DataFrame:
    """``rows`` of Parquet files with ``__file``, the file's name below the table's folder, and ``__row``, the place in it."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/__shard=\d+/[^/]+)$", 1)
    return rows.select("*", name.alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _by_file(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= BROADCAST_FILES else out


def lay_out(docs: DataFrame, shard: str, shards: int, path: str, file_rows: int = 100_000, text_col: str = "text") -> Manifest:
    """Write ``docs`` as a table at ``path`` with shards 0 to ``shards`` - 1, ``shard`` being SQL for a row's, in files of at most so many rows.

    A shard's rows may be many: they are dealt out by Spark's rebalancing, which splits what is large.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("__shard", F.expr(shard).cast("int")).hint("rebalance", "__shard")
    new = Manifest(1, shards, docs.schema, _write(rows, path, text_col, docs.schema, maxRecordsPerFile=file_rows))
    _commit(spark, path, new)
    return new


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table as they lie, with ``__shard`` and ``__slot``."""
    now = manifest(spark, path)
    if not now.files:
        return spark.createDataFrame([], now.schema).select("*", F.lit(0).alias("__shard"), F.lit(0).cast("long").alias("__slot"))
    filled: dict[int, int] = defaultdict(int)
    places = []
    for f in now.files:
        places.append((f.name, f.shard, filled[f.shard]))
        filled[f.shard] += f.rows
    at = _by_file(spark, places, "__file string, __shard int, __first long")
    rows = _located(spark.read.schema(now.schema).parquet(*[f"{path}/{f.name}" for f in now.files]))
    return rows.join(at, "__file").select(*[F.col(f"`{c}`") for c in now.schema.names], "__shard", (F.col("__first") + F.col("__row")).alias("__slot"))


def file_transfers(files: Sequence[File], shards: int, cost: np.ndarray | None = None) -> tuple[dict[str, int], dict[str, dict[int, int]]]:
    """(new shard of each file that moves whole, bytes for each new shard of each file that is cut)."""
    of: dict[int, list[File]] = defaultdict(list)
    for f in files:
        of[f.shard].append(f)
    sizes = [sum(f.bytes for f in of[i]) for i in range(max(of, default=-1) + 1)]
    whole: dict[str, int] = {}
    cut: dict[str, dict[int, int]] = {}
    blocks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, j, a, b in transfer_plan(sizes, even_capacities(sum(sizes), shards), cost):
        blocks[i].append((j, a, b))
    for i, mine in blocks.items():
        at = 0
        for f in of[i]:
            shares = {j: n for j, a, b in mine if (n := min(b, at + f.bytes) - max(a, at)) > 0}
            at += f.bytes
            if len(shares) > 1:
                cut[f.name] = shares
            elif shares and i not in shares:
                whole[f.name] = next(iter(shares))
    return whole, cut


def deal(sizes: np.ndarray, shares: dict[int, int]) -> np.ndarray:
    """The new shard of each document of a file that is cut: the largest first, each to the shard that still lacks most."""
    lacks = dict(sorted(shares.items()))
    out = np.empty(len(sizes), np.int32)
    for k in np.argsort(-sizes, kind="stable").tolist():
        out[k] = j = max(lacks, key=lacks.__getitem__)
        lacks[j] -= int(sizes[k])
    return out


#: Documents of each shard that may be exchanged to even out what dealing files one by one leaves, and how many each shard should have at least.
EXCHANGED, LEAST_FREE = 64, 8


def open_up(files: Sequence[File], whole: dict[str, int], cut: dict[str, dict[int, int]], shards: int) -> None:
    """Give every shard documents that may be exchanged, LEAST_FREE where it has as many: files that were to stay are cut too, the smallest first.

    A file that is cut has thousands of rows in a large table, so this adds files of shards without one, and in small tables others.
    """
    free = [0.0] * shards
    for f in files:
        for j, share in cut.get(f.name, {}).items():
            free[j] += f.rows * share / f.bytes
    small = sorted(files, key=lambda f: (f.rows, f.name))
    for f in small:
        if f.name not in cut and f.name not in whole and f.shard < shards and free[f.shard] < LEAST_FREE:
            cut[f.name] = {f.shard: f.bytes}
            free[f.shard] += f.rows
    for f in small:  # where nothing else is free, files that move
        if f.name in whole and free[whole[f.name]] < 2:
            j = whole.pop(f.name)
            cut[f.name] = {j: f.bytes}
            free[j] += f.rows


def exchanges(sizes: Sequence[int], movable: Sequence[list[tuple[int, object]]], most: int = 10_000) -> dict[object, int]:
    """New shards of some documents, such that the shards' ``sizes`` come closer to each other.

    ``movable``: (size, document) of each shard. As long as it helps, the fullest shard that can gives a document to an emptier one, or
    exchanges one for a smaller: of all ways between the two that which brings them closest.
    """
    dev = np.array(sizes, np.int64) * len(sizes) - int(sum(sizes))  # times the number of shards, so whole
    scale = len(sizes)
    held = [sorted(m, key=lambda x: x[0]) for m in movable]
    moved: dict[object, int] = {}
    for _ in range(most):
        order = np.argsort(-dev, kind="stable").tolist()
        best = None
        for i, j in [(i, j) for i in order[:4] for j in order[:-5:-1] if dev[i] > dev[j]]:
            gap = int(dev[i] - dev[j])
            mine, theirs = np.array([x for x, _ in held[i]] or [0]), np.array([0, *(x for x, _ in held[j])])
            if not held[i]:
                continue
            # what i gives less what it takes should be half the gap
            aim = mine - gap / (2 * scale)
            order_j = np.argsort(theirs, kind="stable")
            at = np.searchsorted(theirs[order_j], aim)
            for near in (np.clip(at - 1, 0, len(theirs) - 1), np.clip(at, 0, len(theirs) - 1)):
                gives = mine - theirs[order_j[near]]
                left = np.abs(gap - 2 * scale * gives)
                k = int(left.argmin())
                if gives[k] > 0 and left[k] < gap and (best is None or gap - left[k] > best[0]):
                    best = (gap - int(left[k]), i, j, k, int(order_j[near[k]]) - 1, int(gives[k]))
        if best is None:
            break
        _, i, j, k, b, gives = best
        given, taken = held[i].pop(k), held[j].pop(b) if b >= 0 else None
        held[j].append(given)
        moved[given[1]] = j
        if taken:
            held[i].append(taken)
            moved[taken[1]] = i
        for x in (i, j):
            held[x].sort(key=lambda y: y[0])
        dev[i] -= gives * scale
        dev[j] += gives * scale
    return moved


def reshard(spark: SparkSession, path: str, shards: int, text_col: str = "text", cost: np.ndarray | None = None) -> list[str]:
    """Bring the table at ``path`` to so many shards of near equal bytes, and return the files that were rewritten.

    Safe to stop and to run again; readers of the table before must have ended, as files that were rewritten are deleted.
    """
    old = manifest(spark, path)
    if old.shards == shards:
        _tidy(spark, path)
        return []
    whole, cut = file_transfers(old.files, shards, cost)
    open_up(old.files, whole, cut, shards)
    columns = [F.col(f"`{c}`") for c in old.schema.names]

    def rows(names: Sequence[str]) -> DataFrame:
        return _located(spark.read.schema(old.schema).parquet(*[f"{path}/{n}" for n in names]))

    new: list[File] = []
    if whole:
        to = _by_file(spark, sorted(whole.items()), "__file string, __shard int")
        new += _write(rows(sorted(whole)).join(to, "__file").select(*columns, "__shard"), path, text_col, old.schema)
    if cut:

        def dealt(group: pd.DataFrame) -> pd.DataFrame:  # one file, whose rows are bounded
            group = group.sort_values("__row")
            return pd.DataFrame({"__file": group["__file"], "__row": group["__row"], "__shard": deal(group["__size"].to_numpy(), cut[group["__file"].iloc[0]]), "__size": group["__size"]})

        measured = rows(sorted(cut)).select("__file", "__row", document_size(text_col).alias("__size"))
        to = measured.groupBy("__file").applyInPandas(dealt, "__file string, __row long, __shard int, __size long")
        to = _evened(written(to, "reshard-deal"), old.files, whole, cut, shards)
        moved = rows(sorted(cut)).join(to, ["__file", "__row"]).select(*columns, "__shard").hint("rebalance", "__shard")
        new += _write(moved, path, text_col, old.schema)
    rewritten = set(whole) | set(cut)
    files = sorted([f for f in old.files if f.name not in rewritten] + new, key=lambda f: (f.shard, f.name))
    _commit(spark, path, Manifest(old.number + 1, shards, old.schema, files))
    _tidy(spark, path)
    return sorted(rewritten)


def _evened(to: DataFrame, files: Sequence[File], whole: dict[str, int], cut: dict[str, dict[int, int]], shards: int) -> DataFrame:
    """The deal of the files that are cut (__file, __row, __shard, __size), with a bounded number of documents of each shard exchanged."""
    spark = to.sparkSession
    sizes = [0] * shards
    for f in files:
        if f.name not in cut:
            sizes[whole.get(f.name, f.shard)] += f.bytes
    for shard, n in to.groupBy("__shard").agg(F.sum("__size")).collect():  # a row for each shard
        sizes[shard] += n
    nth = F.row_number().over(Window.partitionBy("__shard").orderBy("__size", "__file", "__row"))
    movable: list[list[tuple[int, object]]] = [[] for _ in range(shards)]
    for r in to.withColumn("nth", nth).where(F.col("nth") <= EXCHANGED).orderBy("__shard", "nth").collect():  # bounded: so many for each shard
        movable[r["__shard"]].append((r["__size"], (r["__file"], r["__row"])))
    moved = exchanges(sizes, movable)
    if not moved:
        return to.drop("__size")
    new = F.broadcast(spark.createDataFrame([(f, r, j) for (f, r), j in sorted(moved.items())], "__file string, __row long, __new int"))
    return to.join(new, ["__file", "__row"], "left").select("__file", "__row", F.coalesce("__new", "__shard").alias("__shard"))


def op10_sharding(spark: SparkSession, sf_dir: str, old_shards: int = 32, shards: int = 40, files: int = 8) -> DataFrame:
    """The table is laid out in 32 shards by a hash of the id, about 8 files each, and goes to 40 of near equal bytes; the result is read back."""
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "reshard-table")
    file_rows = min(100_000, docs.count() // (old_shards * files) + 1)
    lay_out(docs, f"pmod(xxhash64(doc_id), {old_shards})", old_shards, path, file_rows)
    reshard(spark, path, shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_shards(spark, path).select(
        "doc_id",
        document_size("text").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
