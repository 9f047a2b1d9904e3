"""Ranked lexical search by MaxScore: a stated set of queries against all documents, shard by shard.

Two passes read the documents once: the first counts the terms of each whole text and keeps those that a query asks for,
as a table of (document, length, terms, counts) in the shared folder; counts of documents and terms are sums over it.
In the second pass a task cuts its rows of that table into shards of at most ``SHARD_POSTINGS`` postings, holds one at a
time as an inverted index, and asks every query of it. A term's upper bound in a shard is its largest weighted impact
there. With the terms in ascending order of that bound, those whose bounds together stay below the query's threshold are
non-essential: a document that holds only such terms can't enter the result. Documents of the essential lists are the
candidates; the non-essential lists are probed for them from the largest bound down, and a candidate leaves as soon as what it has
and what could come stays below the threshold. The threshold is the score of the k-th best document that the task has
found so far, and it is carried from shard to shard; a document that equals it stays, since ties go to the smaller id.
The best k of every task are merged, first within groups of tasks, then over all.

Queries come in blocks of about ``BLOCK_TERMS`` terms (never less than one item), each one pass, so that what is sent to the
tasks is bounded. Weights are integers, and so are scores: results don't depend on the layout of the documents.

Defined results: null or termless documents count neither in N nor in L and are never found; a null or termless item has no rows;
rows that share an item id are one item with the terms of all of them; rows that repeat a document id are documents of their own, a
null document id comes after all others of its score; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.llm.common import table, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_POSTINGS = 1 << 18
BLOCK_TERMS = 1 << 20
#: Groups of tasks whose results are merged first.
MERGES = 64
#: Bytes of UTF-8: letters and digits of ASCII and all bytes of other characters stay, the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def terms_column(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the document), ids and tfs (of ``terms`` that it holds): a row for each document with a term."""
    place = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lengths, ids, tfs = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    held = {place[t]: c for t, c in Counter(words).items() if t in place}
                    keep.append(row)
                    lengths.append(len(words))
                    ids.append(list(held))
                    tfs.append(list(held.values()))
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """An inverted index over the terms of a block of queries: for each term its documents, in order, with weighted impacts."""

    def __init__(self, rows: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        lengths, ids, tfs = (rows.column(i) for i in (1, 2, 3))
        sizes = np.diff(ids.offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        term, tf = ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
        m = 75 + (25 * lengths.to_numpy() * n_docs) // n_terms
        order = np.argsort(term, kind="stable")
        self.docs, tf, term = doc[order], tf[order], term[order]
        self.impacts = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs]))
        self.terms, starts = np.unique(term, return_index=True)
        self.starts = np.append(starts, len(term))
        self.bounds = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, repeats: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all documents whose score reaches ``threshold``, above 0, and maybe none of the others."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        at, repeats = at[here], repeats[here]
        bounds = self.bounds[at] * repeats
        order = np.argsort(bounds, kind="stable")
        at, repeats, total = at[order], repeats[order], np.cumsum(bounds[order])
        essential = int(np.searchsorted(total, threshold, "left"))  # the terms before it stay below the threshold together
        none = np.zeros(0, np.int64)
        if essential >= len(at):
            return none, none
        lists = [slice(self.starts[i], self.starts[i + 1]) for i in at[essential:]]
        found = np.concatenate([self.docs[s] for s in lists])
        parts = np.concatenate([self.impacts[s] * r for s, r in zip(lists, repeats[essential:], strict=True)])
        rows, inverse = np.unique(found, return_inverse=True)
        scores = np.zeros(len(rows), np.int64)
        np.add.at(scores, inverse, parts)
        for i in range(essential - 1, -1, -1):
            alive = scores + total[i] >= threshold
            rows, scores = rows[alive], scores[alive]
            if not len(rows):
                return none, none
            docs, impacts = self.docs[self.starts[at[i]] : self.starts[at[i] + 1]], self.impacts[self.starts[at[i]] : self.starts[at[i] + 1]]
            p = np.minimum(np.searchsorted(docs, rows), len(docs) - 1)
            scores = scores + np.where(docs[p] == rows, impacts[p] * repeats[i], 0)
        alive = (scores >= threshold) & (scores > 0)
        return rows[alive], scores[alive]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in record batches of at most ``limit`` postings (or one document)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()) + 1)  # a document without postings counts as one
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + limit - count, "right")), at + 1 if not held else at)
            if to > at:
                held.append(batch.slice(at, to - at))
                count += int(ends[to - 1] - before)
            at = to
            if at < batch.num_rows or count >= limit:
                yield _joined(held)
                held, count = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]


def _searched(items: list[tuple[int | None, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_postings: int):
    """A task's postings to the best ``k`` documents of each item among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (minus score, id is null, id), the best first
        for rows in _shards(batches, shard_postings):
            shard = Shard(rows, weights, n_docs, n_terms)
            ids = rows.column(0)
            for i, (_, terms, repeats) in enumerate(items):
                top = best[i]
                threshold = -top[-1][0] if len(top) == k else 1
                at, scores = shard.search(terms, repeats, threshold)
                if len(at) > 4 * k:  # all of the k-th score stay
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    at, scores = at[scores >= least], scores[scores >= least]
                new = [(-int(s), x is None, 0 if x is None else x) for s, x in zip(scores, ids.take(pa.array(at)).to_pylist(), strict=True)]
                best[i] = sorted(top + new)[:k]
        out = [(item, None if no_id else x, -s) for (item, *_), top in zip(items, best, strict=True) for s, no_id, x in top]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([TaskContext.get().partitionId() % MERGES] * len(out), pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["item_id", "doc_id", "score", "part"])

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item (item_id, text)."""
    asked = items.select(F.col("item_id").cast("long"), F.explode(terms_column(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))
    blocks = max(1, -(-asked.count() // block_terms))
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = mine.orderBy("item_id", "term").toArrow()
        words = [t.encode("utf-8", "surrogatepass") for t in rows.column("term").to_pylist()]
        terms = sorted(set(words))
        place = {t: i for i, t in enumerate(terms)}
        ids = rows.column("item_id").to_pylist()
        at, repeats = np.array([place[t] for t in words], np.int64), rows.column("repeats").to_numpy()
        cuts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]] + [len(ids)]
        queries = [(ids[a], at[a:z], repeats[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
        index = written(postings(docs, terms, id_col, text_col), "lexical-postings")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(index.select(F.explode("ids").alias("id")).groupBy("id").count().collect())  # at most a block's terms
        weights = np.array([weight(df.get(i, 0), n_docs) for i in range(len(terms))], np.int64)
        found = index.mapInArrow(_searched(queries, weights, n_docs, max(n_terms, 1), k, shard_postings), "item_id long, doc_id long, score long, part int")
        best = _ranked(_ranked(found, ["item_id", "part"], k).drop("rank"), ["item_id"], k).select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), lengths AS (
    SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), ms AS (
    SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, totals
), item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (
    SELECT item_id, term, count(*) AS repeats FROM item_terms GROUP BY item_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
