"""SimHash near-duplicates: fingerprints of word shingles, linked through shards of BK-trees.

A fingerprint has the bits set in over half of the XXH64 values of a text's shingles. Distinct fingerprints are sharded
so that any two within the radius meet: the 64 bits are cut into radius + 2 blocks, of which two at least are untouched,
and each pair of blocks with its value is a shard. A shard above ``tree_nodes`` is split into tiles of that size, so no
tree grows with a group of near copies; every fingerprint of the shard is a query to each tile after its own, and the
queries of a tile come in blocks of ``QUERY_TILES`` tiles, each with its copy of the tree: a task holds a bounded number of
rows at a time, while a shard of n fingerprints costs n * n / (2 * tree_nodes) rows in all, spread over its blocks. In a
block a BK-tree is built (children keyed by their Hamming distance to the parent) and all its queries walk down
it together, following only edges whose key lies within the radius of the query's distance to the node. A task reports
a spanning star of what it linked, never all pairs, and the stars are joined into components by rounds of star
contraction, each round a table in the shared folder.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text of fewer words than a
shingle has the whole sequence as its one shingle; an empty table gives an empty result; rows that repeat an id are
linked like other rows; a component without any id has a null component_id; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import drop_path, shared_path, table, to_delete, written

BITS = 64
#: The queries of so many tiles are asked of a tree together.
QUERY_TILES = 16
#: Bands of least hashes in :func:`drop_similar`, and orders of the shingles a band: two texts of Jaccard similarity s
#: share a band with probability 1 - (1 - s^5)^16, 0.998 at 0.8.
BANDS, ROWS = 16, 5
ORDERS = np.random.default_rng(2024).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The XXH64 values of a text's shingles, in their order and with repeats."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    lasts = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), lasts.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # little-endian bytes with little bit order: bit i of the value is column i
        part = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, columns: list[str], text_col: str = "text", words: int = 4) -> DataFrame:
    """``columns`` of every row with ``fp``, its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("__text"))
            values = np.fromiter((fingerprint(x.as_py(), words) for x in text), np.uint64, len(text)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(values)], [*columns, "fp"])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text"))
    schema = rows.select(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("long").alias("fp")).schema
    return rows.mapInArrow(run, schema)


def shard_keys(fp: Column, radius: int) -> Column:
    """array<struct<pair, key>>: the shards of a fingerprint, one for each pair of its blocks."""
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    cut = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, (i, j) in enumerate(combinations(range(blocks), 2)):
        keys.append(F.struct(F.lit(n).alias("pair"), F.shiftleft(cut[i], edges[j + 1] - edges[j]).bitwiseOR(cut[j]).alias("key")))
    return F.array(*keys)


class Forest:
    """BK-trees of several shards, built and searched together."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """``fp``: distinct in a shard. ``shard``: its number, ascending."""
        self.fp = fp
        first = np.concatenate(([True], shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, bool)
        roots = np.flatnonzero(first)
        self.root_of = dict(zip(shard[roots].tolist(), roots.tolist(), strict=True))
        at = roots[np.cumsum(first) - 1] if len(shard) else roots
        left = np.flatnonzero(~first)
        at, parents, keys, nodes = at[left], [], [], []
        while len(left):  # each turn places one node below every (parent, distance) and sends the others one edge down
            edge = at * 128 + np.bitwise_count(fp[left] ^ fp[at])
            _, lead, group = np.unique(edge, return_index=True, return_inverse=True)
            nodes.append(left[lead])
            keys.append(edge[lead])
            stay = np.ones(len(left), bool)
            stay[lead] = False
            at, left = left[lead][group][stay], left[stay]
        self.edges = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges, self.nodes = self.edges[order], self.nodes[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of a query, node) of all that lie within the radius. ``roots``: where each query starts."""
        q, at, found_q, found_n = np.arange(len(queries)), roots, [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fp[at]).astype(np.int64)
            near = d <= radius
            found_q.append(q[near])
            found_n.append(at[near])
            low = np.searchsorted(self.edges, at * 128 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.edges, at * 128 + np.minimum(d + radius, BITS), "right")
            n = np.maximum(high - low, 0)
            q = np.repeat(q, n)
            at = self.nodes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_n])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its component), for all values of the links that aren't the smallest."""
    values, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for z in (x, y, label[x], label[y]):
            np.minimum.at(new, z, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def _walk(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Tiles one after another (tile, role, fp), nodes before queries; each is a bounded number of rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(tile: np.ndarray, query: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = ~query
        if not node.any():
            return
        forest = Forest(fp[node].view(np.uint64), tile[node])
        # nodes ask as well; a tile may have queries and, by the chance of hashing, no node
        some = np.isin(tile, tile[node])
        ask_tile, ask = tile[some], fp[some]
        sizes = np.unique(tile[node], return_counts=True)[1]
        step = max(256, 4_000_000 // max(1, int(sizes.max())))
        for at in range(0, len(ask), step):
            roots = np.fromiter((forest.root_of[t] for t in ask_tile[at : at + step].tolist()), np.int64)
            part = ask[at : at + step].view(np.uint64)
            q, n = forest.search(part, roots, radius)
            x, y = part[q].view(np.int64), forest.fp[n].view(np.int64)
            other = x != y
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in stars(x[other], y[other])], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for b in batches:
        got = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append(got)
        rows += len(got[0])
        if rows < 200_000:
            continue
        joined = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        whole = int(np.searchsorted(joined[0], joined[0][-1], "left")) if len(joined[0]) else 0
        if whole:
            yield from links(*(x[:whole] for x in joined))
            held = [tuple(x[whole:] for x in joined)]
            rows = len(held[0][0])
        else:
            held = [joined]
    if rows:
        yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint_links(distinct: DataFrame, radius: int = 4, tree_nodes: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): enough to join all that reach each other in steps of at most the radius."""
    shards = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("s")).select("fp", "s.pair", "s.key")
    return shard_links(shards, radius, tree_nodes)


def shard_links(shards: DataFrame, radius: int, tree_nodes: int = 1024) -> DataFrame:
    """Links (a, b) within the radius inside the shards (fp, pair, key), each fingerprint once in a shard."""
    sizes = shards.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mates = shards.join(sizes, ["pair", "key"]).withColumn("tiles", F.ceil(F.col("n") / tree_nodes).cast("int"))
    mates = mates.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("block", F.expr(f"own div {QUERY_TILES}"))
    # a fingerprint is a node of its own tile, wherever that is asked, and a query to all later tiles
    nodes = "transform(sequence(0, block), b -> named_struct('at', own, 'block', b, 'query', false))"
    queries = "transform(sequence(own + 1, tiles - 1), t -> named_struct('at', t, 'block', block, 'query', true))"
    asked = mates.select("pair", "key", "fp", F.explode(F.expr(f"IF(own < tiles - 1, concat({nodes}, {queries}), {nodes})")).alias("x"))
    rows = asked.select(F.xxhash64("pair", "key", "x.at", "x.block").alias("tile"), F.col("x.query").alias("query"), "fp")
    return (
        rows.repartition("tile")
        .sortWithinPartitions("tile", "query")
        .mapInArrow(lambda batches: _walk(batches, radius), "a long, b long")
    )


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); the label is the component's smallest node.

    Rounds of large and small stars: each hangs a node's larger, then its smaller neighbours on the least of them.
    """
    spark = links.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    def least_of(pairs: DataFrame) -> tuple[DataFrame, str]:
        """(a, m): each node's least neighbour or itself, as a table, so that the join after it can split a hub's rows."""
        least, path = keep(pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")))
        return least.withColumnRenamed("b", "m"), path

    edges, path = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least, least_path = least_of(both)
        large, large_path = keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small, small_path = least_of(large)
        hung = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, new_path = keep(hung.union(small).distinct())
        after = state(new)
        for old in (path, least_path, large_path, small_path):
            drop_path(spark, old)
        edges, path = new, new_path
        if after == before:
            break
        before = after
    to_delete(path)  # the result reads it
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_components(fps: DataFrame, id_col: str, radius: int = 4) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``fps`` (id_col, fp)."""
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    labels = written(components(fingerprint_links(distinct.select("fp"), radius)), "simhash-labels")
    named = labels.withColumnRenamed("node", "fp")
    linked = distinct.join(named, "fp")
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    alone = distinct.join(named, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return linked.join(least, "label").select("fp", "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id, fp (long), component_id."""
    fps = written(fingerprints(docs, [id_col], text_col, words), "simhash-fps")
    return fps.join(near_components(fps, id_col, radius), "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component stays, that with the smallest id, with all its columns."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], row.alias("__row"))
    fps = written(fingerprints(keyed, [id_col, "__row"], text_col, words), "simhash-fps")
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__row").alias("r"))
    distinct = written(fps.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    labels = written(components(fingerprint_links(distinct.select("fp"), radius)), "simhash-labels")
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    stay = linked.groupBy(F.coalesce("label", "fp").alias("g")).agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.i").alias("__id"), F.col("first.r").alias("__stay"))
    same = (F.col("__row") == F.col("__stay")) & F.col(id_col).eqNullSafe(F.col("__id"))
    # rows alike in every column have one key: one of them is enough
    return keyed.join(stay, same, "left_semi").dropDuplicates(["__row", id_col]).select(*[F.col(f"`{c}`") for c in docs.columns])


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band: a hash of the least values of its ``ROWS`` orders of the shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[at : at + 2048, None] * ORDERS[None, :]).min(axis=0), out=low)
    return (low.reshape(BANDS, ROWS) * ORDERS[:ROWS]).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame, columns: list[str], text_col: str, words: int) -> DataFrame:
    """``columns`` of every row with ``fp`` (of the set, repeats left out), ``set`` (MD5 of its set of shingles), ``n`` (their number) and ``bands``."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets, sizes, bands = [], [], [], []
            for x in b.column(b.schema.get_field_index("__text")):
                hashes = np.unique(shingle_hashes(x.as_py(), words))
                fps.append(majority(hashes))
                sets.append(hashlib.md5(hashes.tobytes()).digest())
                sizes.append(len(hashes))
                bands.append(min_hashes(hashes).view(np.int64))
            offsets = pa.array(np.arange(0, BANDS * (len(fps) + 1), BANDS), pa.int32())
            found = [
                pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array(sets, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), *found], [*columns, "fp", "set", "n", "bands"])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text"))
    found = {"fp": "long", "set": "binary", "n": "long", "bands": "array<long>"}
    schema = rows.select(*[F.col(f"`{c}`") for c in columns], *[F.lit(None).cast(t).alias(c) for c, t in found.items()]).schema
    return rows.mapInArrow(run, schema)


def similar_links(sets: list[np.ndarray], similarity: tuple[int, int]) -> tuple[list[int], list[int]]:
    """A spanning forest (place, place) of the sets whose Jaccard similarity is at least the fraction; repeated values are not allowed in a set."""
    m = len(sets)
    part, whole = similarity
    sizes = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), sizes)
    values, name = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    owners = owner[np.argsort(name, kind="stable")]
    often = np.bincount(name, minlength=len(values))
    begins = np.cumsum(often) - often
    first = np.cumsum(sizes) - sizes
    left = np.ones(m, bool)
    a, b = [], []
    for seed in range(m):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            u = queue.pop()
            mine = name[first[u] : first[u] + sizes[u]]
            mine = mine[often[mine] > 1]
            count = often[mine]
            at = np.repeat(begins[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owners[at], minlength=m)
            new = np.flatnonzero(left & (whole * common >= part * (sizes + sizes[u] - common))).tolist()
            left[new] = False
            queue.extend(new)
            a.extend([u] * len(new))
            b.extend(new)
    return a, b


def _confirm(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Tiles one after another (tile, node, hashes): links between nodes of a tile."""
    held, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        a, b = similar_links(sets, similarity)
        names = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"]) if a else empty

    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    for batch in batches:
        for tile, node, hashes in zip(*(batch.column(i) for i in range(3)), strict=True):
            if tile.as_py() != held:
                yield links()
                held, nodes, sets = tile.as_py(), [], []
            nodes.append(node.as_py())
            sets.append(np.frombuffer(hashes.as_py(), np.uint64))
    yield links()


def drop_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (4, 5),
    radius: int = 20,
    tile_texts: int = 1024,
    tile_shingles: int = 1 << 20,
) -> DataFrame:
    """One row stays of each component of texts linked by Jaccard similarity of their sets of shingles, that with the smallest id.

    Shards are bands of least hashes, each with its BK-trees of fingerprints; what they join is only proposed. All texts of
    a proposed group then meet in tasks of two tiles each, a tile of bounded texts and shingles, and a link is one whose
    similarity, computed on the sets themselves (of 64-bit values), reaches the fraction. Texts without words are one set.
    """
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], row.alias("__row"))
    found = signatures(keyed.select(F.col(id_col).alias("__id"), "__row", F.col(text_col).alias("__t")), ["__id", "__row"], "__t", words)
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__row").alias("r"))
    grouped = written(found, "similar-rows").groupBy("set").agg(
        F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    distinct = written(grouped.drop("set").withColumn("node", F.monotonically_increasing_id()), "similar-distinct")
    shards = distinct.select("fp", F.posexplode("bands").alias("pair", "key")).distinct()
    proposed = written(components(shard_links(shards, radius), "similar-proposed"), "similar-groups").distinct()
    members = distinct.drop("bands").join(proposed.withColumnRenamed("node", "fp"), "fp", "left").withColumn("g", F.coalesce("label", "fp"))
    members = written(members.select("g", "node", "first", "n"), "similar-members")
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / tile_texts), F.ceil(F.sum("n") / tile_shingles)).cast("int")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("all"), tiles.alias("tiles")).where("all > 1").drop("all")
    asked = members.join(sizes, "g").select("g", "node", "tiles", F.col("first.i").alias("__of"), F.col("first.r").alias("__as"))
    same = (F.col("__row") == F.col("__as")) & F.col(id_col).eqNullSafe(F.col("__of"))
    texts = keyed.join(asked, same).select("g", "node", "tiles", F.col(text_col).alias("__text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), words)).tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], ["g", "node", "tiles", "hashes"])

    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    meets = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    placed = texts.mapInArrow(hashed, "g long, node long, tiles int, hashes binary").select("g", "node", "hashes", own.alias("own"), "tiles", meets)
    # a tile alone is a pair only where there is no other
    placed = placed.where("own <> other OR tiles = 1")
    tile = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    links = (
        placed.select(tile.alias("tile"), "node", "hashes")
        .repartition("tile")
        .sortWithinPartitions("tile")
        .mapInArrow(lambda batches: _confirm(batches, similarity), "a long, b long")
    )
    labels = written(components(links, "similar-links"), "similar-labels")
    stay = members.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("g")).agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.i").alias("__of"), F.col("first.r").alias("__as"))
    # rows alike in every column have one key: one of them is enough
    return keyed.join(stay, same, "left_semi").dropDuplicates(["__row", id_col]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
