"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic texts (positives) and unlabelled texts with the risk

    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)),   pi the share of toxic texts,

whose second part, the risk on clean texts, is never let below zero: where a batch drives it there, the step goes the
other way. Features are hashed words and word beginnings of the whole text, as present or not; those are kept whose rate
among positives lies clearly above their corrected rate among clean texts. The threshold is the one of least corrected
0-1 risk, false alarms weighing twice, and scores are shifted so that it is 0.5.

Only labels of the learning part are read, and of them only which texts are confirmed toxic and how many there are. The
sample is bounded: at most ``max_positives`` and ``max_unlabelled`` rows, those whose hashes of id and text are the smallest;
of rows alike one goes to the driver with their number.
Scoring reads every whole text. Fitting runs on the driver over that sample; weights go to tasks with the function.

Defined results: a null or empty text has no features and gets the score of the bias alone; without a confirmed toxic
text every score is 0; a null label is no label, several labels of an id count as their largest; rows that repeat an id
are scored each for itself; an empty table gives an empty result; further columns are carried by :func:`drop_toxic`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import crc_mod, table

DIM = 1 << 20
#: Confirmed toxic texts that a feature must be in.
MIN_SEEN = 5
MARKS = ".,!?|%$*&#;:()[]<>{}\"'"


def word_features(word: str) -> tuple[int, ...]:
    w = word.strip(MARKS)
    if not w:
        return ()
    return zlib.crc32(w.encode("utf-8", "replace")) % DIM, zlib.crc32(b"^" + w[:5].encode("utf-8", "replace")) % DIM


def features(text: str | None) -> np.ndarray:
    out: set[int] = set()
    for w in set((text or "").lower().split()):
        out.update(word_features(w))
    return np.fromiter(out, np.int32, len(out))


@dataclass
class Model:
    weights: dict[int, float]  # by feature
    bias: float  # threshold taken off

    def scorer(self):
        """A function of a text; what a word contributes is remembered, up to a bound."""
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            if not np.isfinite(self.bias):
                return 0.0
            found: set[int] = set()
            for w in set((text or "").lower().split()):
                f = known.get(w)
                if f is None:
                    if len(known) > 500_000:
                        known.clear()
                    known[w] = f = tuple(x for x in word_features(w) if x in weights)
                if f:
                    found.update(f)
            z = self.bias + sum(weights[x] for x in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk on toxic texts, risk on clean ones) of outputs on positives and unlabelled texts, with the logistic loss; the second may be below 0."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def risk_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What each output is to be lowered by: the slopes of the whole risk, or where the risk on clean texts is below 0, those of its negative alone."""
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    if risks(zp, zu, prior)[1] >= 0:
        return prior * ((sp - 1) - sp) / len(zp), su / len(zu)
    return prior * sp / len(zp), -su / len(zu)


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.1, z: float = 3.0, seed: int = 0) -> Model:
    if not positives or not unlabelled:
        return Model({}, -np.inf)
    n_pos, n_unl = len(positives), len(unlabelled)
    count = lambda docs: np.bincount(np.concatenate(docs), minlength=DIM)
    seen = count(positives)
    p, u = seen / n_pos, count(unlabelled) / n_unl
    clean = np.maximum(u - prior * p, 0) / (1 - prior)
    spread = np.sqrt(np.maximum(clean, 1 / n_unl) * (1 - np.minimum(clean, 1)) / n_pos)
    keep = np.flatnonzero((p - clean > z * spread) & (p > 2 * clean) & (seen >= MIN_SEEN))
    place = np.full(DIM, -1)
    place[keep] = np.arange(len(keep))
    chosen = [[(lambda f: f[f >= 0])(place[d]) for d in docs] for docs in (positives, unlabelled)]
    w, b, h, hb = np.zeros(len(keep)), -2.0, np.full(len(keep), 1e-6), 1e-6
    rng = np.random.default_rng(seed)

    def outputs(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([np.zeros(0, int), *docs]).astype(int)
        rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        return at, rows, b + np.bincount(rows, w[at], len(docs))

    for _ in range(steps):
        batch = [[docs[i] for i in rng.integers(0, len(docs), n)] for docs, n in zip(chosen, (64, 192), strict=True)]
        (at_p, rows_p, zp), (at_u, rows_u, zu) = outputs(batch[0]), outputs(batch[1])
        gp, gu = risk_slopes(zp, zu, prior)
        g = np.bincount(np.concatenate((at_p, at_u)), np.concatenate((gp[rows_p], gu[rows_u])), len(keep))
        h += g * g
        w -= rate * g / np.sqrt(h)
        gb = gp.sum() + gu.sum()
        hb += gb * gb
        b -= rate * gb / np.sqrt(hb)
    zp, zu = np.sort(outputs(chosen[0])[2]), np.sort(outputs(chosen[1])[2])
    tries = np.unique(np.concatenate((zp, zu)))
    below_p, below_u = np.searchsorted(zp, tries) / n_pos, np.searchsorted(zu, tries) / n_unl
    risk = prior * below_p + 2 * np.maximum(0, (1 - below_u) - prior * (1 - below_p))
    best = int(np.flatnonzero(risk <= risk.min() + 1e-12)[-1])  # of equal risks, the one that rejects least
    threshold = (tries[best] + tries[best - 1]) / 2 if best else tries[0]
    return Model(dict(zip(keep.tolist(), w.tolist(), strict=True)), float(b - threshold) if len(keep) else -np.inf)


def train(docs: DataFrame, labels: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positives: int = 10_000, max_unlabelled: int = 10_000) -> Model:
    """``learn``: SQL over ``id`` that says which ids may be learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(learn)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").where(learn)
    rows = rows.withColumn("r", F.xxhash64("id", "text"))
    keys = rows.select("id", "r")
    share = known.join(keys.select("id"), "id", "left_semi").agg(F.avg((F.col("label") > 0).cast("int")).alias("p")).first()["p"]
    if not share or share >= 1:
        return Model({}, -np.inf)

    def smallest(of: DataFrame, most: int) -> DataFrame:
        """(id, r, n): the rows of the smallest hashes, at most so many in all, with how many of rows alike are among them."""
        return of.orderBy("r", "id").limit(most).groupBy("id", "r").agg(F.count(F.lit(1)).alias("n"))

    positive = smallest(keys.join(known.where("label > 0"), "id", "left_semi"), max_positives)
    sample = positive.withColumn("kind", F.lit(1)).unionByName(smallest(keys, max_unlabelled).withColumn("kind", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [features(t).tobytes() for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], ["kind", "id", "r", "n", "found"])

    # the sample is a bounded number of keys, and of rows alike one is enough
    drawn = rows.join(F.broadcast(sample), ["id", "r"]).select("kind", "id", "r", "n", "text")
    kind_of = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    got = drawn.mapInArrow(run, f"kind int, id {kind_of}, r long, n long, found binary").groupBy("kind", "id", "r", "n").agg(F.first("found").alias("found"))
    table_ = got.select("kind", "n", "found").toArrow()
    docs_of: dict[int, list[bytes]] = {0: [], 1: []}
    for kind, n, found in zip(table_["kind"].to_pylist(), table_["n"].to_pylist(), table_["found"].to_pylist(), strict=True):
        docs_of[kind] += [found] * n
    # sorted: the order in which tasks end must not change the model
    pos, unl = ([np.frombuffer(x, np.int32) for x in sorted(docs_of[k])] for k in (1, 0))
    return fit(pos, unl, float(share))


def scored(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of every row and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            values = [score(t.as_py()) for t in b.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(values, pa.float64())], [*columns, "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


LEARN = "crc32(cast(cast(id as string) as binary)) % 5 <> 0"


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, learn: str = LEARN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    model = train(docs, labels, learn, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield b.filter(pa.array([of(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), LEARN)
    return scored(docs, model, ["doc_id"]).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
