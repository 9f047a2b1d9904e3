"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read each segment of a text's UTF-8 bytes, one forwards and one backwards; from their states a softmax labels
every byte's position, and the document's probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time, with Adam, on windows of a bounded sample: at most ``per_language`` rows of each
language, those whose hashes of id and text are the smallest, and a few windows of each. Scoring reads
every byte of every text, in segments that advance side by side; the network's few thousand numbers go with the function.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing can be learned;
null languages are not learned from; one language alone is predicted with score 1; rows that repeat an id are predicted each
for itself; an empty table gives an empty result; texts of any length are read whole; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swinglake.llm.common import crc_mod, table, written

SEGMENT = 128
SPACE = 0x20
#: Sample keys that go to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows of the whole sample: where languages are so many that they would make more, each has fewer (one at least).
SAMPLE_ROWS = 200_000
#: Segments that advance together.
WIDTH = 2048


@dataclass
class Network:
    """wx: (2, 3h, 256), u: (2, 3h, h), out: (k, 2h), bias: (k,). The gates are update, reset, candidate."""

    wx: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, hidden: int, classes: int, rng: np.random.Generator) -> Network:
        f = np.float32
        return cls(
            rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(f),
            rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(f),
            rng.normal(0, 0.3, (classes, 2 * hidden)).astype(f),
            np.zeros(classes, f),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.u, self.out, self.bias]


def _step(wx: np.ndarray, u: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gates, candidate, new state) from the bytes x and the state h; all are feature by segment."""
    n = h.shape[0]
    a = wx.take(x, axis=1)
    gates = a[: 2 * n]
    gates += u[: 2 * n] @ h
    gates *= np.float32(0.5)
    np.tanh(gates, out=gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    candidate = a[2 * n :]
    candidate += u[2 * n :] @ (gates[n:] * h)
    np.tanh(candidate, out=candidate)
    new = h - candidate
    new *= gates[:n]
    new += candidate
    return gates, candidate, new


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def position_sums(net: Network, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Summed label probabilities (k, segments) of the first ``sizes`` positions. ``x``: (time, segment) bytes."""
    steps, n = x.shape
    hidden = net.u.shape[2]
    h = np.zeros((hidden, n), np.float32)
    ahead = np.empty((steps, hidden, n), np.float32)
    for t in range(steps):
        _, _, h = _step(net.wx[0], net.u[0], x[t], h)
        ahead[t] = h
    total = np.zeros((len(net.bias), n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    a, b = net.out[:, :hidden], net.out[:, hidden:]
    for t in range(steps - 1, -1, -1):
        _, _, h = _step(net.wx[1], net.u[1], x[t], h)
        p = _softmax(a @ ahead[t] + b @ h + net.bias[:, None])
        p *= t < sizes
        total += p
    return total


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions and its gradients. ``x``: (time, window) bytes, ``y``: each window's class."""
    steps, n = x.shape
    hidden = net.u.shape[2]
    states = np.zeros((2, steps + 1, hidden, n), np.float32)
    kept = [[], []]
    for d in range(2):
        for s in range(steps):
            t = s if d == 0 else steps - 1 - s
            gates, candidate, states[d, s + 1] = _step(net.wx[d], net.u[d], x[t], states[d, s])
            kept[d].append((gates, candidate))
    grads = [np.zeros_like(p) for p in net.parameters()]
    above = np.zeros((2, steps, hidden, n), np.float32)
    loss, columns = 0.0, np.arange(n)
    for t in range(steps):
        both = np.concatenate((states[0, t + 1], states[1, steps - t]))
        p = _softmax(net.out @ both + net.bias[:, None])
        loss -= float(np.log(p[y, columns] + 1e-9).sum())
        p[y, columns] -= 1
        p /= steps * n
        grads[2] += p @ both.T
        grads[3] += p.sum(axis=1)
        back = net.out.T @ p
        above[0, t] += back[:hidden]
        above[1, steps - 1 - t] += back[hidden:]
    for d in range(2):
        u = net.u[d]
        dh = np.zeros((hidden, n), np.float32)
        by_step = np.empty((steps, 3 * hidden, n), np.float32)
        for s in range(steps - 1, -1, -1):
            (gates, candidate), h = kept[d][s], states[d, s]
            z, r = gates[:hidden], gates[hidden:]
            dh = dh + above[d, s]
            dc = dh * (1 - z) * (1 - candidate * candidate)
            drh = u[2 * hidden :].T @ dc
            da = np.concatenate((dh * (h - candidate) * z * (1 - z), drh * h * r * (1 - r), dc))
            by_step[s] = da
            grads[1][d][: 2 * hidden] += da[: 2 * hidden] @ h.T
            grads[1][d][2 * hidden :] += dc @ (r * h).T
            dh = dh * z + drh * r + u[: 2 * hidden].T @ da[: 2 * hidden]
        order = x if d == 0 else x[::-1]
        flat = by_step.transpose(1, 0, 2).reshape(3 * hidden, -1)
        for k in range(3 * hidden):
            grads[0][d][k] = np.bincount(order.ravel(), flat[k], 256)
    return loss / (steps * n), grads


def fit(windows: list[bytes], labels: np.ndarray, classes: int, hidden: int = 8, steps: int = 350, batch: int = 192, rate: float = 0.015, seed: int = 0) -> Network:
    """Train on windows of SEGMENT bytes, classes drawn equally often."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(hidden, classes, rng)
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), SEGMENT)
    of = [np.flatnonzero(labels == k) for k in range(classes)]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for i in range(1, steps + 1):
        y = rng.integers(0, classes, batch)
        rows = np.array([of[k][rng.integers(len(of[k]))] for k in y])
        _, grads = gradients(net, np.ascontiguousarray(x[rows].T), y)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        pace = rate * min(1.0, 4 * (1 - i / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g *= scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= pace * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return net


def windows_of(text: str, key: int, most: int = 4) -> list[bytes]:
    """Up to ``most`` windows of a text, from places that the key decides; a short text is filled with spaces."""
    data = text.encode("utf-8", "replace")
    if len(data) <= SEGMENT:
        return [data.ljust(SEGMENT)]
    span = len(data) - SEGMENT
    return [data[(a := zlib.crc32(f"{key}:{i}".encode()) % (span + 1)) : a + SEGMENT] for i in range(min(most, 1 + span // SEGMENT))]


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> tuple[list[str], Network | None]:
    """Languages and the network. ``learn``: a condition on rows that may be learned from. Up to 1000 rows a language, SAMPLE_ROWS in
    all; each task keeps only that many of one before they are shuffled, as long as ``per_language`` isn't above
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000). The driver holds the sample's windows."""
    languages = docs.where(learn).where(F.col(lang_col).isNotNull()).select(lang_col).distinct().count()
    per_language = max(1, min(per_language, SAMPLE_ROWS // max(1, languages)))
    known = docs.where(learn).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.withColumn("r", F.xxhash64("id", "text"))
    order = Window.partitionBy("lang").orderBy("r")
    first = known.select("lang", "r").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    first = written(first.groupBy("lang", "r").agg(F.count(F.lit(1)).alias("n")), "langid-sample")
    # a row for each of the sample: they go to the texts, unless there are very many languages
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, r, n, w) for lang, r, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in windows_of(t, r)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["lang", "r", "n", "w"])

    # of rows alike one is enough, with their number
    drawn = known.join(first, ["lang", "r"]).select("lang", "r", "n", "text").mapInArrow(run, "lang string, r long, n long, w binary")
    got = drawn.groupBy("lang", "r", "n", "w").agg(F.lit(1).alias("one")).toArrow()
    # sorted: the order in which tasks end must not change the network
    pairs = sorted((k, w) for k, n, w in zip(got["lang"].to_pylist(), got["n"].to_pylist(), got["w"].to_pylist(), strict=True) for _ in range(n))
    names = sorted({k for k, _ in pairs})
    if len(names) < 2:
        return names, None
    place = {k: i for i, k in enumerate(names)}
    return names, fit([w for _, w in pairs], np.array([place[k] for k, _ in pairs]), len(names))


def document_probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """(document, language): the mean of the position probabilities over each whole text. No text is empty."""
    data = [t.encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(d) for d in data])
    parts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(data)), parts)
    flat = np.frombuffer(b"".join(d.ljust(n * SEGMENT) for d, n in zip(data, parts.tolist(), strict=True)), np.uint8).reshape(-1, SEGMENT)
    last = np.cumsum(parts) - 1
    sizes = np.full(len(owner), SEGMENT)
    sizes[last] = lengths - (parts - 1) * SEGMENT
    sums = np.empty((len(net.bias), len(owner)), np.float32)
    for at in range(0, len(owner), WIDTH):
        part = slice(at, at + WIDTH)
        sums[:, part] = position_sums(net, np.ascontiguousarray(flat[part].T), sizes[part])
    return np.stack([np.bincount(owner, s, len(data)) for s in sums], axis=1) / lengths[:, None]


def predicted(docs: DataFrame, names: list[str], net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
            lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if names else []
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if net is None:
                for i in lettered:
                    lang[i], score[i] = names[0], 1.0
            elif lettered:
                p = document_probabilities(net, [texts[i] for i in lettered])
                best = p.argmax(axis=1)
                for i, k, v in zip(lettered, best.tolist(), p.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = names[k], min(1.0, v)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(lang), pa.array(score)], [id_col, "lang_pred", "score"])

        ids: list[pa.Array] = []
        texts: list[str | None] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                ids.append(some.column(0))
                texts += (got := some.column(1).to_pylist())
                size += sum(len(t) for t in got if t)
                if size >= 1_000_000:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield out(ids, texts)

    rows = docs.select(F.col(id_col), F.col(text_col))
    schema = docs.select(F.col(id_col), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, net = train(docs, crc_mod("doc_id", 4) != 2)
    return predicted(docs, names, net).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
