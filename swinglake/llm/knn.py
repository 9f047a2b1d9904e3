"""Exact top-k search by inner product: a Voronoi join of queries and vectors.

Components are taken in whole steps (floor of 256 x). Every vector belongs to the cell of its nearest pivot; queries do
so too, and cells with queries form groups of about ``GROUP_QUERIES`` (a cell with more is dealt into several). The
summary of a cell, the largest distance r of its queries to the pivot p, bounds what any of them scores with a
vector x: p.x - r|x| <= q.x <= p.x + r|x|. So the (k+1)-th largest lower bound over all vectors, one more than k since a
query isn't its own neighbour, is a score that each query of the cell reaches k times: the cell's threshold. Tasks keep their k + 1
best bounds and those are merged. A vector goes to a group only if its upper bound reaches the threshold of one of the
group's cells. A group's vectors are dealt into parts of about ``PART_ROWS``, each with a copy of the group's queries, and a
part is solved by matrix products, batch by batch, from the thresholds up; the parts' results are merged.

The driver holds the pivots (at most ``PIVOTS``), and a count, a radius and a threshold for each. A task holds a
group's queries and a batch of vectors. Vectors that no bound keeps from a group cost queries / ``GROUP_QUERIES`` copies each:
in many dimensions without clusters the bounds prune little, and the join is then that of blocks.

Defined results: vectors that are null or hold a null or non-finite component (its 256-fold counts) take no part; a shorter
vector counts as padded with zeros, an empty one as all zeros; rows that repeat an id are vectors of their own (a query's own row alone
is left out, and each repeated query row has its own ranks); a null id is never a query and comes after all others of its score;
scores beyond a long are cut to its range; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.llm.common import table, written

#: Pivots are a quarter of the square root of the rows, within these bounds.
LEAST_PIVOTS, PIVOTS = 16, 4096
GROUP_QUERIES = 1024
PART_ROWS = 2048
#: Below this, sums of products of doubles are exact.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, uid (a number of the row) and v, the whole steps of every valid vector."""
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * 256)
    whole = F.transform("v", lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y))
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), scaled.alias("v"))
        .where(F.col("v").isNotNull() & F.forall("v", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False))))
        .withColumn("v", whole)
    )


def matrix(v: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors as rows, padded with zeros to ``dim``."""
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def slack(size: np.ndarray) -> np.ndarray:
    """More than rounding moves a bound that is made of products of this size."""
    return 1e-9 * size + 1e-6


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as longs: by doubles where they are exact, else by whole numbers of any size."""
    if norms(a).max(initial=0) * norms(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    a, b = ([[int(x) for x in r] for r in m] for m in (a, b))
    return np.array([[max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(r, s, strict=True)))) for s in b] for r in a], np.int64)


class Cells:
    """Cells with queries: their pivots, the largest distance of a query, and the groups that their queries are dealt to."""

    def __init__(self, pivots: np.ndarray, queries: dict[int, tuple[int, float]], group_queries: int):
        self.cells = sorted(queries)
        self.pivots = pivots[self.cells]
        self.radius = np.array([queries[c][1] for c in self.cells])
        #: First group of a cell, and over how many groups its queries are dealt; of a group, the places of its cells.
        self.first: dict[int, int] = {}
        self.pieces: dict[int, int] = {}
        self.places: list[list[int]] = []
        left = list(range(len(self.cells)))
        while left:
            seed = left.pop(0)
            held, count = [seed], queries[self.cells[seed]][0]
            for near in sorted(left, key=lambda i: (norms((self.pivots[i] - self.pivots[seed])[None])[0], i)):
                if count + queries[self.cells[near]][0] > group_queries:
                    break
                held.append(near)
                left.remove(near)
                count += queries[self.cells[near]][0]
            pieces = -(-count // group_queries) if len(held) == 1 else 1
            for i in held:
                self.first[self.cells[i]], self.pieces[self.cells[i]] = len(self.places), pieces
            self.places += [held] * pieces

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bound of what a query of each cell scores with each vector."""
        dots, size = x @ self.pivots.T, norms(x)[:, None]
        reach = self.radius * size
        reach = reach + slack(reach + norms(self.pivots) * size)
        return dots - reach, dots + reach


def assigned(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """The rows with their cell, the first of equally near pivots, and the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.einsum("ij,ij->i", pivots, pivots)
        for b in batches:
            x = matrix(b.column(2), dim)
            cell = (squares - 2 * (x @ pivots.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(norms(x - pivots[cell]))], ["id", "uid", "v", "cell", "distance"])

    return rows.mapInArrow(run, "id long, uid long, v array<double>, cell int, distance double")


def thresholds(vectors: DataFrame, cells: Cells, dim: int, k: int) -> np.ndarray:
    """For each cell a score that all its queries reach with ``k`` other rows; minus infinity where there are too few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((0, len(cells.cells)), -np.inf)
        for b in batches:
            top = np.concatenate((top, cells.bounds(matrix(b.column(0), dim))[0]))
            if len(top) > k + 1:
                top = np.partition(top, len(top) - k - 1, axis=0)[len(top) - k - 1 :]
        place = np.tile(np.arange(len(cells.cells), dtype=np.int32), len(top))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(top.ravel())], ["place", "bound"])

    best = Window.partitionBy("place").orderBy(F.desc("bound"))
    merged = vectors.select("v").mapInArrow(run, "place int, bound double").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    out = np.full(len(cells.cells), -np.inf)
    for place, n, least in merged.groupBy("place").agg(F.count(F.lit(1)), F.min("bound")).collect():
        if n > k:
            out[place] = least
    return out


def groups_of(vectors: DataFrame, cells: Cells, least: np.ndarray, dim: int) -> DataFrame:
    """id, uid, v and grp: a row for each group that a vector may have a result in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reaches = cells.bounds(matrix(b.column(2), dim))[1] >= least
            goes = np.stack([reaches[:, held].any(axis=1) for held in cells.places], axis=1)
            ends = np.concatenate(([0], np.cumsum(goes.sum(axis=1)))).astype(np.int32)
            to = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(goes)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, to], ["id", "uid", "v", "groups"])

    out = vectors.select("id", "uid", "v").mapInArrow(run, "id long, uid long, v array<double>, groups array<int>")
    return out.select("id", "uid", "v", F.explode("groups").alias("grp"))


class Found:
    """The best ``k`` vectors of each query of a group, in any order of the vectors."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.uids, self.x, self.k = ids, uids, x, k
        #: What a score has to reach to matter.
        self.least = np.maximum(np.floor(least), float(-LONG - 1)).clip(max=2.0**62).astype(np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # query, ~score, id is null, id: ascending is best first

    def add(self, ids: np.ndarray, no_id: np.ndarray, uids: np.ndarray, x: np.ndarray) -> None:
        scores = products(self.x, x)
        own = np.argsort(self.uids)
        at = own[np.searchsorted(self.uids, uids, sorter=own) % len(own)]
        mine = np.flatnonzero(self.uids[at] == uids)
        scores[at[mine], mine] = -LONG - 1
        least = self.least
        if len(x) > self.k:  # of a batch's vectors only its own k best, and their equals, can matter
            least = np.maximum(least, np.partition(scores, len(x) - self.k, axis=1)[:, len(x) - self.k])
        reach = scores >= least[:, None]
        reach[at[mine], mine] = False
        q, c = np.nonzero(reach)
        rows = np.concatenate((self.rows, np.stack((q, ~scores[q, c], no_id[c].astype(np.int64), ids[c]))), axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        starts = np.searchsorted(rows[0], np.arange(len(self.ids)))
        place = np.arange(rows.shape[1]) - starts[rows[0]]
        self.rows = rows[:, place < self.k]
        kth = place == self.k - 1
        self.least[rows[0][kth]] = np.maximum(self.least[rows[0][kth]], ~rows[1][kth])

    def result(self) -> pa.RecordBatch:
        q, s, no_id, ids = self.rows
        arrays = [pa.array(self.ids[q]), pa.array(self.uids[q]), pa.array(ids, mask=no_id.astype(bool)), pa.array(~s)]
        return pa.RecordBatch.from_arrays(arrays, ["query_id", "query_uid", "vec_id", "score"])


def _solved(dim: int, k: int):
    """Rows of (group, part), its queries first, to what the part's vectors give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, found = None, [], None
        for batch in batches:
            grp, part, vector = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(part) != 0) | (np.diff(vector) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == z:
                    continue
                if (grp[a], part[a]) != key:
                    if found is not None:
                        yield found.result()
                    key, queries, found = (grp[a], part[a]), [], None
                piece = batch.slice(a, z - a)
                ids, uids = piece.column(3), piece.column(4).to_numpy()
                x, no_id = matrix(piece.column(5), dim), ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                if not vector[a]:
                    queries.append((ids, uids, x, piece.column(6).to_numpy()))
                    continue
                if not queries:  # the hash has left this piece of a cell without any
                    continue
                if found is None:
                    found = Found(*(np.concatenate(c) for c in zip(*queries, strict=True)), k)
                found.add(ids, no_id, uids, x)
        if found is not None:
            yield found.result()

    return run


def top_k(
    rows: DataFrame, k: int, every: int, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, group_queries: int = GROUP_QUERIES, part_rows: int = PART_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best vectors of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    ready = valid(rows, id_col, vec_col)
    n, dim = ready.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    many = pivots or min(PIVOTS, max(LEAST_PIVOTS, int(n**0.5 / 4)))
    centres = [r.v for r in ready.select("v").orderBy(F.xxhash64("v"), "v").limit(many).collect()]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centre = np.unique(matrix(pa.array(centres, pa.list_(pa.float64())), dim), axis=0)
    vectors = written(assigned(ready, centre, dim), "knn-vectors")
    asked = vectors.where(F.col("id") % every == 0)
    cells = Cells(centre, {c: (m, r) for c, m, r in asked.groupBy("cell").agg(F.count(F.lit(1)), F.max("distance")).collect()}, group_queries)
    if not cells.cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    least = thresholds(vectors, cells, dim, k)
    parts = -(-n // part_rows)
    of_cell = spark.createDataFrame(
        [(c, cells.first[c], cells.pieces[c], float(least[i])) for i, c in enumerate(cells.cells)], "cell int, first int, pieces int, least double"
    )
    queries = (
        asked.join(F.broadcast(of_cell), "cell")  # a row for each pivot at most
        .withColumn("grp", F.col("first") + F.pmod(F.xxhash64("uid"), "pieces").cast("int"))
        .select("grp", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("vector"), "id", "uid", "v", "least")
    )
    sent = groups_of(vectors, cells, least, dim).select(
        "grp", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("vector"), "id", "uid", "v", F.lit(None).cast("double").alias("least")
    )
    dealt = queries.unionByName(sent).repartition("grp", "part").sortWithinPartitions("grp", "part", "vector")
    solved = dealt.mapInArrow(_solved(dim, k), "query_id long, query_uid long, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), 5, 50)


OP13_SQL = r"""
WITH steps AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v, row_number() OVER () AS uid
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.uid, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
    FROM steps q JOIN steps x ON x.uid <> q.uid WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""
