"""Order-preserving packing: dynamic programming over cut points, with a monotone queue for its transitions.

Documents are tokenised (each ends in ``end_id``) and laid end to end in the order in which a task reads them; windows of
at most ``window`` tokens are cut from that stream. Cuts may fall at document ends (free), at sentence ends or, where
none is near, inside a sentence (both at a penalty). With positions p and penalties c, the least cost of cutting at j is

    best[j] = c[j] + window - p[j] + min of (best[i] + p[i]) over i with p[j] - window <= p[i] < p[j]

and the minimum of that sliding range is the head of a monotone queue, so a document's cost is linear in its cut points.
The stream is solved a block at a time and the last window of a block is carried into the next, so memory is bounded.
What is left at a task's end is split into lengths that are powers of two, which need no padding, if that costs less.

A task's stream is its input partition: nothing is shuffled, and a task that runs again packs the same rows again.

Tokenising goes by distinct chunks between spaces and newlines, which the tokenizer's own split never crosses; each task
process remembers the ids of chunks it has met, up to a bound. The strings of added tokens in a text are those tokens.

Defined results: a null text counts as empty and is the end id alone; an empty table gives an empty result; rows that
repeat an id are packed each for itself; a null id stays null; texts of any length are cut; further columns are not read.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import table

SENTENCE_END = (".", "!", "?", "...", "!!", "?!")
#: Penalties in tokens of padding.
CUT_SENTENCE, CUT_INSIDE, EXTRA_SEQUENCE = 4.0, 12.0, 16.0
#: Cut points inside sentences stand at most so many tokens apart.
STRIDE = 16
BLOCK = 1 << 18
#: Bytes of text that are tokenised together, about.
PART = 4_000_000


class Memory:
    """Values by key, at most about twice ``most`` of them, of which the older half may go."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def trim(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys that have no value; the others are counted as new."""
        new, old = self.new, self.old
        fresh = [k for k in keys if k not in new]
        new.update((k, old[k]) for k in fresh if k in old)
        return [k for k in fresh if k not in new]


class ChunkTokenizer:
    """Ids of texts, little-endian: those of ``encode(text, add_special_tokens=False)``, with a bounded memory of chunks.

    A chunk stands between spaces or newlines, which neither a token nor an added token crosses. Letters and the marks
    behind them are tokens apart, so a chunk of both is put together from two, and letters go to the tokenizer's model
    at once. Letters are what is so after the tokenizer's normalisation, which takes some apart into a letter and a sign.
    A text's chunks are looked up once for all that are alike in a call.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str, parts: int = 500_000, chunks: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.parts, self.chunks = Memory(parts), Memory(chunks)
        self.plain: set[str] = set()  # letters that normalisation leaves letters

    def _letters(self, text: str) -> bool:
        if not text.isalpha():
            return False
        if text.isascii() or self.plain.issuperset(text):
            return True
        self.plain.update(c for c in set(text) if self.normalizer.normalize_str(c).isalpha())
        return self.plain.issuperset(text)

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = found.ids
            starts = np.fromiter((x[0] for x in found.offsets), np.int64, len(ids))
            ends = np.cumsum([len(p) + 1 for p in some])  # of the parts, a space behind each
            ends = np.searchsorted(starts, ends).tolist()
            self.parts.new.update(zip(some, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn(self, chunks: list[str]) -> None:
        letters = [c.rstrip(self.MARKS) for c in chunks]
        words = [x if self._letters(x) else "" for x in letters]
        tails = [c[len(w) :] for c, w in zip(chunks, words, strict=True)]  # all of a chunk that isn't letters and marks
        self._learn_parts(self.parts.missing(set(tails)))
        signs = [w for w in words if not w.isascii()]  # no letter joins one beyond a space in normalisation
        normal = dict(zip(signs, self.normalizer.normalize_str(" ".join(signs)).split(" "), strict=False))
        bytewise = {w: x.encode().decode("latin-1").translate(BYTE_LETTERS) for w, x in normal.items()}
        part, tokens = self.parts.new, self.model.tokenize
        ids: list[int] = []
        ends = []
        for word, tail in zip(words, tails, strict=True):
            if word:
                ids += [t.id for t in tokens(word.lower() if word.isascii() else bytewise[word])]
            ids += part[tail]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        self.chunks.new.update(zip(chunks, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        self.parts.trim()
        self.chunks.trim()
        column = pc.replace_substring(pc.fill_null(pa.array(texts, pa.large_string()), ""), "\n", " ")
        split = pc.split_pattern(column, " ")
        counted = split.flatten().dictionary_encode()
        chunk, names = counted.indices.to_numpy(), counted.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.chunks.missing(names))
        found = [self.chunks.new[c] for c in names]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, n = (np.cumsum(sizes) - sizes)[chunk], sizes[chunk]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(found), "<u4").take(np.arange(upto[-1]) + np.repeat(starts - upto[:-1], n))
        ends = upto[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _byte_letters() -> dict[int, str]:
    """What byte-level tokenizers write for each byte: itself, where it can be seen, or the next free character from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()

_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_at(path: str) -> ChunkTokenizer:
    """One for each process of an executor."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def best_cuts(pos: np.ndarray, cost: np.ndarray, window: int, rest_cost: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Positions of the best cuts. ``pos``: ascending, steps of at most the window, from above 0.

    The last cut leaves a rest of less than a window, for which ``rest_cost`` says what it costs; a rest of 0 is free.
    """
    points, costs = [0, *pos.tolist()], [0.0, *cost.tolist()]
    value = [0.0] * len(points)  # best[i] + p[i]
    back = [0] * len(points)
    queue: deque[int] = deque([0])
    for j in range(1, len(points)):
        p = points[j]
        low = p - window
        while points[queue[0]] < low:
            queue.popleft()
        back[j] = i = queue[0]
        value[j] = v = value[i] + costs[j] + window
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    end = points[-1]
    near = np.arange(np.searchsorted(points, end - window, "right"), len(points))
    at = np.array(points)[near]
    total = np.array(value)[near] - at + rest_cost(end - at)
    j = int(near[len(total) - 1 - int(np.argmin(total[::-1]))])
    cuts = []
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, cut_sentence: float = CUT_SENTENCE, cut_inside: float = CUT_INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which windows may be cut, and their penalties."""
    kind = np.zeros(len(ids) + 1, np.int8)  # of each position: 1 sentence end, 2 document end, 3 inside
    kind[1:][ends_sentence[ids]] = 1
    kind[doc_ends] = 2
    known = np.flatnonzero(kind)
    gaps = np.diff(known, prepend=0)
    wide = gaps > STRIDE
    n = (gaps[wide] - 1) // STRIDE
    first = (known - gaps)[wide]
    kind[np.repeat(first, n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)] = 3
    pos = np.flatnonzero(kind)
    cost = np.array([0.0, cut_sentence, 0.0, cut_inside])[kind[pos]]
    return pos, cost


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` give pieces (doc, start, length, ids, doc_tokens, sequence, offset, padding)."""

    def __init__(self, window: int, ends_sentence: np.ndarray, block: int = BLOCK):
        self.window, self.ends_sentence, self.block = window, ends_sentence, max(block, 4 * window)
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, all its ids, how many are packed
        self.held = self.sequences = 0

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc, ids, 0))
        self.held += len(ids)
        return self._solve(False) if self.held >= self.block else []

    def finish(self) -> list[tuple]:
        return self._solve(True) if self.docs else []

    def _rest_cost(self, rest: np.ndarray) -> np.ndarray:
        """Of a last window: its padding, or the cuts that leave lengths without padding."""
        split = (np.bitwise_count(rest.astype(np.uint64)).astype(float) - 1) * (CUT_INSIDE + EXTRA_SEQUENCE)
        return np.where(rest > 0, EXTRA_SEQUENCE + np.minimum(self.window - rest, split), 0.0)

    def _solve(self, last: bool) -> list[tuple]:
        ids = np.concatenate([x[done:] for _, x, done in self.docs])
        ends = np.cumsum([len(x) - done for _, x, done in self.docs])
        cuts = best_cuts(*cut_points(ids, ends, self.ends_sentence), self.window, self._rest_cost if last else np.zeros_like)
        if last and (rest := len(ids) - (start := cuts[-1] if cuts else 0)):
            powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
            split = (len(powers) - 1) * (CUT_INSIDE + EXTRA_SEQUENCE) < self.window - rest
            cuts += (start + np.cumsum(powers)).tolist() if split else [len(ids)]
        elif not cuts:
            return []
        done, bounds = cuts[-1], np.array(cuts)
        out = []
        edges = np.union1d(bounds, ends[ends <= done]).tolist()
        owner = np.searchsorted(ends, [0, *edges[:-1]], "right").tolist()
        window_of = np.searchsorted(bounds, [0, *edges[:-1]], "right").tolist()
        begins = np.concatenate(([0], ends[:-1])).tolist()
        a = 0
        for b, d, w in zip(edges, owner, window_of, strict=True):
            doc, whole, packed = self.docs[d]
            opened = cuts[w - 1] if w else 0
            used = cuts[w] - opened
            padding = 0 if used & (used - 1) == 0 else self.window - used
            out.append((doc, packed + a - begins[d], b - a, ids[a:b].astype("<u4").tobytes(), len(whole), self.sequences + w, a - opened, padding))
            a = b
        self.sequences += len(cuts)
        k = int(np.searchsorted(ends, done, "right"))
        self.docs = [(doc, whole, packed + max(0, done - begins[k + i])) for i, (doc, whole, packed) in enumerate(self.docs[k:])]
        self.held = int(ends[-1]) - done
        return out


def in_parts(batch: pa.RecordBatch, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Rows whose second column is the text, of about ``most`` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)) + 1  # behind a row that reaches a multiple
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, padding (its sequence's)."""
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padding"]
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    number = F.lit(0).cast("long")
    schema = rows.select(id_col, *[(F.lit(b"") if n == "ids" else number).alias(n) for n in names[1:]]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_at(tokenizer_path)
        vocabulary = tokens.tokenizer
        ends_sentence = np.zeros(max(vocabulary.get_vocab_size(), end_id + 1), bool)
        for mark in SENTENCE_END:
            if (i := vocabulary.token_to_id(f"{mark}</w>")) is not None:
                ends_sentence[i] = True
        packer, base, end = Packer(window, ends_sentence), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4")
        kind = None

        def table_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[5] = pa.array(np.array(columns[5], np.int64) + base)
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            kind = batch.column(0).type
            for part in in_parts(batch):
                for doc, ids in zip(part.column(0).to_pylist(), tokens(part.column(1).to_pylist()), strict=True):
                    if pieces := packer.add(doc, np.concatenate((ids, end))):
                        yield table_of(pieces)
        if pieces := packer.finish():
            yield table_of(pieces)

    return rows.mapInArrow(run, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with the production tokenizer and window, ids as a checksum."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
