"""Language-model scores by online logistic context mixing.

A text is the sequence of its lower-cased words, each closed by a space, and one end mark. Bytes are coded bit by bit along
a Huffman tree of the corpus's bytes after the byte before, and every bit is predicted by three contexts, each with the
tree's node: the two bytes before; the whole word so far (of at most ``PREFIX`` bytes); and, at a word's first two bytes,
the word before it with the byte so far. A predictor gives the log odds of the zeros and ones that all learning documents
have in its context. They are combined by weights that a gate selects (how sure the predictor by the word before is, or where
it has nothing to say, that of the word), starting from weights fitted to the learning documents, and after every ``BLOCK`` bits of a
document its weights are refined by the errors in them; weights go on through the whole document. The score is the log10
probability of all bits.

What is gathered grows with the corpus. The word contexts are the nodes of the vocabulary's trie, none of which shares its
counts. The vocabulary, a table with all documents' tokens, is dealt into ranges of its order, so that a range holds all
words of a context; only the contexts of words at which ranges are cut lie in several, and those are counted beforehand.
Each token so gets the log odds of all its bits, kept beside it as bytes. Contexts of two bytes have a table of their full
range (2^24 cells). As a word before, each of the ``words_before`` most frequent words is a context of its own, and all other
words with the same last two bytes are one together, so that every token is counted behind some context and none is silent;
these contexts, a bounded number, are counted by shuffle and go into a hash table whose slots are chosen from their measured
number. Starting weights are fitted on the same counts, which have all
that is needed: each token or pair counts as often as it stands in the corpus, taken once off its own contexts.

The ``head`` most frequent tokens, a bounded number, go to all tasks with what belongs to them, and a Python process lays their
bits out once. All other tokens of a
document are joined with the vocabulary by shuffle, and texts are then joined with what came of that.

Defined results: a null or empty text is the end mark alone; rows that repeat an id are scored each for itself; a null id
counts as the empty text for the split; without learning documents counts are 0 and every bit has probability 1/2; an empty
table gives an empty result; texts of any length are scored whole, long ones piece by piece; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import crc_mod, drop_path, table, written

END = b"\n"
SPACE = 0x20
#: Bytes of a word that its own context may hold; beyond them that predictor is silent.
PREFIX = 64
#: Log odds are kept as steps of 1 / STEPS, within LIMIT steps.
STEPS, LIMIT = 12, 100
#: What is added to both counts of a context.
PRIOR = 0.1
#: Bits after which a document's weights are refined, and by how much of the summed errors.
BLOCK, RATE = 128, 0.01
#: Upper ends, in steps, of the gates but the last, of how far from even a predictor is.
GATE_ENDS = (0, 12, 27, 34, 50)
#: Bits that the word before has a say in have the later gates, by how far from even that predictor is.
KNOWN = len(GATE_ENDS) + 1
GATES, INPUTS = KNOWN + len(GATE_ENDS), 3
#: Of the word before, two bytes, word so far: what fitted weights are held slightly to.
START = (0.5, 0.3, 0.5)
#: Tokens of a range of the vocabulary, about; and pairs that are counted together.
RANGE = 30_000
#: Ranges there are at most: a sample of 50 tokens of each, and 32 prefixes of each cut, are what the driver holds and sends of them.
RANGES = 1 << 14
#: Tokens are numbered for documents of about so many bytes, which are scored side by side, about so many tokens in all at a time; and laid out so many together.
PIECE, TOKENS, LAID = 4_000_000, 150_000, 10_000
GATE_OF = np.searchsorted(np.array(GATE_ENDS), np.abs(np.arange(256).astype(np.uint8).view(np.int8).astype(int)), "left").astype(np.uint8)
#: What stays of a bit's cell where the word before says so much, and what it says, by 256 * bit and that.
KEPT = np.where(np.arange(256) > 0, 0x01FFFF00, 0xFFFFFFFF).astype(np.uint32)
SAYING = np.array([((x if bit else -x) & 255 | (KNOWN - 1 + int(GATE_OF[x & 255])) << 25) if x else 0 for bit in (0, 1) for x in [*range(128), *range(-128, 0)]], np.uint32)
FACTOR = np.uint64(0x5851F42D4C957F2D)
MIX_NODE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POWERS = np.array([pow(int(FACTOR), k, 1 << 64) for k in range(PREFIX + 2)], np.uint64)


class Words:
    """The words of texts as numbers of the distinct ones, in the order in which they first stand."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        words = split.flatten()
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # there are empty ones at white space at a text's ends
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        #: How many words a text has.
        self.counts = np.diff(np.append(0, np.cumsum(some))[offsets])
        coded = (words if some.all() else words.filter(pa.array(some))).dictionary_encode()
        self.numbers = coded.indices.to_numpy()
        self.distinct = coded.dictionary.cast(pa.binary())


def ends_of(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words, a column of binaries: the first byte, the second (a space where there is none), the last but one (0), and the last."""
    if not len(tokens):
        return (np.zeros(0, np.int64),) * 4
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset :][: len(tokens) + 1].astype(np.int64)
    data = np.frombuffer(tokens.buffers()[2], np.uint8)
    first, last, longer = offsets[:-1], offsets[1:] - 1, np.diff(offsets) > 1
    second, other = (np.where(longer, data.take(at, mode="clip"), no) for at, no in ((first + 1, SPACE), (last - 1, 0)))
    return data[first].astype(np.int64), second.astype(np.int64), other.astype(np.int64), data[last].astype(np.int64)


def closed(token: bytes) -> bytes:
    """A token as it is coded: a word with the space behind it, or the end mark."""
    return token if token == END else token + b" "


class Code:
    """A Huffman code of bytes for each byte before them: the tree nodes and bits of (byte before, byte)."""

    def __init__(self, counts: np.ndarray):
        """``counts``: how often each byte follows each."""
        paths: list[list[tuple[int, int]]] = []
        for before in range(256):
            weights = counts[before].astype(float) + max(1.0, counts[before].sum() / 4096)
            heap = [(w, i) for i, w in enumerate(weights.tolist())]  # bytes are below 256, inner nodes from there on
            heapq.heapify(heap)
            children, order = {}, 256
            while len(heap) > 1:
                (v, a), (w, b) = heapq.heappop(heap), heapq.heappop(heap)
                children[order] = (a, b)
                heapq.heappush(heap, (v + w, order))
                order += 1
            own: list[list[tuple[int, int]]] = [[] for _ in range(256)]
            stack: list[tuple[int, list[tuple[int, int]]]] = [(order - 1, [])]
            while stack:
                node, path = stack.pop()
                if node < 256:
                    own[node] = path
                else:
                    stack.extend((child, [*path, (before * 256 + node - 256, bit)]) for bit, child in enumerate(children[node]))
            paths += own
        self.length = np.array([len(p) for p in paths], np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.node = np.array([n for p in paths for n, _ in p], np.int32)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)

    def bits(self, before: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all bits of all bytes: the byte's place, the tree's node, and the bit."""
        pair = before.astype(np.int32) * 256 + sym
        length = self.length[pair]
        place = np.repeat(np.arange(len(sym), dtype=np.int32), length)
        rank = np.arange(len(place), dtype=np.int32) + (self.start[pair] - (np.cumsum(length) - length).astype(np.int32))[place]
        return place, self.node[rank], self.bit[rank]


def laid(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' bytes as they are coded, which token a byte is of, and how many bytes of it stand before."""
    parts = [closed(t) for t in tokens]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), lengths)
    return np.frombuffer(b"".join(parts), np.uint8), owner, np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]


def two_before(x: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte before each, and the one before that; spaces before a token."""
    last, other = np.full(len(x), SPACE, np.uint8), np.full(len(x), SPACE, np.uint8)
    last[1:] = x[:-1]
    other[2:] = x[:-2]
    last[since < 1] = SPACE
    other[since < 2] = SPACE
    return last, other


def prefix_hashes(x: np.ndarray, since: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of its token before each byte; of no use from PREFIX bytes on."""
    terms = (x.astype(np.uint64) + np.uint64(1)) * POWERS[np.minimum(since, PREFIX + 1)]
    sums = np.cumsum(terms, dtype=np.uint64) - terms  # of all bytes before, modulo 2^64
    first = np.flatnonzero(since == 0)
    return sums - np.repeat(sums[first], np.diff(np.append(first, len(x))))


def towards(odds: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Log odds of ones as those of the bits themselves, or back: alike from byte to byte in rare words, so they are kept that way."""
    return np.where(bit == 1, odds, -odds).astype(np.int8)


def odds_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of counts, in steps."""
    return np.clip(np.rint(STEPS * np.log((ones + PRIOR) / (zeros + PRIOR))), -LIMIT, LIMIT).astype(np.int8)


def table_of_two(counts: np.ndarray, keys: np.ndarray, code: Code) -> np.ndarray:
    """Log odds of the contexts of two bytes (other byte * 2^16 + node), from how often ``keys`` (other, last, byte) stand."""
    place, node, bit = code.bits(keys >> 8 & 0xFF, keys & 0xFF)
    n = counts[place].astype(float)
    cells, cell = np.unique((keys[place] >> 16 << 16) + node, return_inverse=True)
    two = np.zeros(1 << 24, np.int8)
    two[cells] = odds_of(np.bincount(cell, n * (1 - bit), len(cells)), np.bincount(cell, n * bit, len(cells)))
    return two


def prefixes(tokens: list[bytes]) -> list[bytes]:
    """All beginnings of the tokens, of less than PREFIX bytes: the contexts that may lie in several ranges."""
    return sorted({t[:k] for t in tokens for k in range(min(len(t), PREFIX - 1) + 1)})


def hash_of(prefix: bytes) -> int:
    return sum((b + 1) * int(POWERS[k]) for k, b in enumerate(prefix)) % (1 << 64)


def count_contexts(tokens: list[bytes], times: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys (other, last, byte), counts; keys (place in ``shared`` * 256 + byte), counts) of tokens that stand so often. ``shared``: hashes, ascending."""
    x, owner, since = laid(tokens)
    last, other = two_before(x, since)
    n = times[owner].astype(float)
    keys, at = np.unique((other.astype(np.int64) << 16) + (last.astype(np.int64) << 8) + x, return_inverse=True)
    counts = np.bincount(at, n, len(keys))
    h = prefix_hashes(x, since)
    place = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
    inside = (since < PREFIX) & (shared[place] == h if len(shared) else False)
    shared_keys, at = np.unique(place[inside] * 256 + x[inside], return_inverse=True)
    return keys, counts, shared_keys, np.bincount(at, n[inside], len(shared_keys))


def trie_cells(h: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (h ^ (node.astype(np.uint64) + np.uint64(1)) * MIX_NODE) * MIX


class Shared:
    """Zeros and ones of the trie's contexts that lie in several ranges."""

    def __init__(self, hashes: np.ndarray, last: np.ndarray, keys: np.ndarray, counts: np.ndarray, code: Code):
        """``hashes`` of the prefixes, ascending, and their last bytes; ``keys``: place * 256 + byte."""
        at, x = keys >> 8, (keys & 0xFF).astype(np.uint8)
        place, node, bit = code.bits(last[at], x)
        self.cells, cell = np.unique(trie_cells(hashes[at][place], node), return_inverse=True)
        n = counts[place].astype(float)
        self.zeros, self.ones = np.bincount(cell, n * (1 - bit), len(self.cells)), np.bincount(cell, n * bit, len(self.cells))


def trie_inputs(tokens: list[bytes], times: np.ndarray, code: Code, two: np.ndarray, shared: Shared) -> tuple[list[bytes], np.ndarray, float]:
    """Of a whole range's tokens: the word predictor's log odds :func:`towards` all their bits, and weights (GATES, INPUTS) fitted to them with how many bits they stand for."""
    x, owner, since = laid(tokens)
    last, other = two_before(x, since)
    place, node, bit = code.bits(last, x)
    inside = since[place] < PREFIX
    cells, cell = np.unique(trie_cells(prefix_hashes(x, since)[place], node), return_inverse=True)
    n = times[owner][place].astype(float)
    w = n * inside
    zeros, ones = np.bincount(cell, w * (1 - bit), len(cells)), np.bincount(cell, w * bit, len(cells))
    if len(shared.cells):
        at = np.minimum(np.searchsorted(shared.cells, cells), len(shared.cells) - 1)
        known = shared.cells[at] == cells
        zeros[known], ones[known] = shared.zeros[at[known]], shared.ones[at[known]]
    word = odds_of(zeros, ones)[cell]
    word[~inside] = 0
    ends = np.cumsum(np.bincount(owner[place], minlength=len(tokens))).tolist()
    data = towards(word, bit).tobytes()
    counted = np.flatnonzero(n > 0)
    own = bit[counted]
    held = odds_of(np.maximum(zeros[cell[counted]] - (1 - own.astype(float)), 0), np.maximum(ones[cell[counted]] - own, 0))
    held[~inside[counted]] = 0
    short = two[(other[place].astype(np.int64) << 16)[counted] + node[counted]]
    weights = fitted(short, held, own, n[counted], lambda a, b: ((np.zeros_like(a), a, b), GATE_OF[b.view(np.uint8)].astype(int)))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], weights, float(n.sum())


def fitted(a: np.ndarray, b: np.ndarray, bit: np.ndarray, times: np.ndarray, laid_out, steps: int = 8) -> np.ndarray:
    """Weights (GATES, INPUTS) of least loss by Newton steps, held slightly to START.

    ``a`` and ``b`` are steps of log odds; ``laid_out`` says what inputs and which gate (-1: none) they stand for. Bits that are alike in
    all of that are counted first, so that there are 2^17 rows at most.
    """
    key = (a.view(np.uint8).astype(np.int32) << 9) + (b.view(np.uint8).astype(np.int32) << 1) + bit
    counts = np.bincount(key, times, 1 << 17)
    some = np.flatnonzero(counts)
    n, y = counts[some], (some & 1).astype(float)
    columns, gate = laid_out((some >> 9).astype(np.uint8).view(np.int8), (some >> 1 & 255).astype(np.uint8).view(np.int8))
    inputs = np.stack(columns, axis=1).astype(float) / STEPS
    out = np.tile(np.array(START), (GATES, 1))
    for g in range(GATES):
        rows = np.flatnonzero(gate == g)
        x, own, m = inputs[rows], y[rows], n[rows]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ out[g], -30, 30)))
            slope = x.T @ (m * (own - p)) + 10 * (np.array(START) - out[g])
            curve = (x * (m * p * (1 - p))[:, None]).T @ x + 10 * np.eye(INPUTS)
            out[g] = np.clip(out[g] + np.clip(np.linalg.solve(curve, slope), -0.5, 0.5), -2, 3)
    return out


def first_two(token: bytes) -> int:
    """The first two bytes of a token as it is coded, as a number; the end mark has one."""
    t = closed(token)
    return t[0] << 8 | (t[1] if len(t) > 1 else 0)


def pair_slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of contexts (rank of the word before * 512, and 256 + its byte at a word's second byte) with nodes."""
    return (trie_cells(context.astype(np.uint64) * FACTOR, node) >> np.uint64(64 - bits)).astype(np.int64)


def pair_cells(pairs: np.ndarray, times: np.ndarray, code: Code, two: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of all pairs (rank of a word * 2^16 + first two bytes of the token behind it) of some words: slots, their log odds, and
    weights (GATES, INPUTS) fitted to them with how many bits they stand for; of use from gate KNOWN on."""
    rank, a, b = pairs >> 16, pairs >> 8 & 0xFF, pairs & 0xFF
    second = a != END[0]
    before = np.concatenate((np.full(len(pairs), SPACE), a[second]))
    context = np.concatenate((rank << 9, rank[second] << 9 | 256 | a[second]))
    place, node, bit = code.bits(before, np.concatenate((a, b[second])))
    n = np.concatenate((times, times[second]))[place].astype(float)
    cells, where, cell = np.unique(trie_cells(context[place].astype(np.uint64) * FACTOR, node), return_index=True, return_inverse=True)
    zeros, ones = np.bincount(cell, n * (1 - bit), len(cells)), np.bincount(cell, n * bit, len(cells))
    held = odds_of(np.maximum(zeros[cell] - (1 - bit), 0), np.maximum(ones[cell] - bit, 0))
    # a word's contexts of two bytes and of all bytes so far are the same here
    short = two[(SPACE << 16) + node]
    weights = fitted(held, short, bit, n, lambda a, b: ((a, b, b), np.where(a == 0, -1, KNOWN - 1 + GATE_OF[a.view(np.uint8)])))
    return pair_slots(context[place[where]], node[where], bits), odds_of(zeros, ones), weights, float(n.sum())


def in_pieces(mixer: Mixer, sequences: list[np.ndarray], tokens: int = TOKENS) -> np.ndarray:
    """Natural log probability of each sequence of token numbers, whole; in pieces of about so many tokens of all together, which changes nothing.

    Sequences of like length go side by side, and a piece ends with a block of each. The token before a sequence is number 0.
    """
    counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
    upto = np.append(0, np.cumsum(mixer.sizes[np.concatenate([np.zeros(0, np.int32), *sequences])], dtype=np.int64))
    bits = upto[np.cumsum(counts)] - upto[np.cumsum(counts) - counts]
    order, score = np.argsort(-bits, kind="stable"), np.zeros(len(sequences))
    side = max(1, tokens // BLOCK)
    for i in range(0, len(order), side):
        part = order[i : i + side]
        score[part] = _side_by_side(mixer, [sequences[j] for j in part.tolist()], bits[part], tokens)
    return score


def _side_by_side(mixer: Mixer, sequences: list[np.ndarray], bits: np.ndarray, tokens: int) -> np.ndarray:
    """:func:`in_pieces` of sequences, those of most ``bits`` first."""
    token, counts = np.concatenate(sequences), np.fromiter(map(len, sequences), np.int64, len(sequences))
    first = np.cumsum(counts) - counts
    behind = np.append(0, token[:-1])
    behind[first] = 0
    size = mixer.sizes[token]
    upto = np.cumsum(size, dtype=np.int64)
    base = upto[first] - size[first]
    score, state, done = np.zeros(len(sequences)), mixer.fresh(len(sequences)), 0
    while m := int(np.searchsorted(-bits, -done, "left")):  # so many go on
        window = BLOCK * max(1, 16 * tokens // (m * BLOCK))
        start, end = base[:m] + done, base[:m] + np.minimum(bits[:m], done + window)
        at = np.searchsorted(upto, start, "right")  # the token that is open
        have = np.searchsorted(upto, end - 1, "right") + 1 - at
        own = np.arange(int(have.sum())) + np.repeat(at - (np.cumsum(have) - have), have)
        score[:m] += mixer.bits_scored(token[own], behind[own], have, start - (upto[at] - size[at]), end - start, state[:m])
        done += window
    return score


def by_token(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrays of so many values end to end as a column of binaries, from which Arrow takes many at once."""
    offsets = np.append(0, np.cumsum(counts, dtype=np.int64) * values.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


class Laid:
    """The bits of distinct tokens: inputs, and what the slots of the word before are made of."""

    def __init__(self, cells: pa.Array, low: pa.Array, node: pa.Array, sizes: np.ndarray, early: np.ndarray, ranks: np.ndarray):
        """``cells``: of a token's bits; ``low`` and ``node``: of those of its first two bytes; ``sizes``, ``early``: how many these are; ``ranks``: as a word before, or -1."""
        self.columns, self.numbers = (cells, low, node), (sizes, early, ranks)

    @classmethod
    def of(cls, tokens: list[bytes], data: np.ndarray, ranks: np.ndarray, code: Code, two: np.ndarray) -> Laid:
        """``data``: the trie's inputs of all tokens."""
        parts, done = [], 0
        for at in range(0, len(tokens), LAID):
            x, owner, since = laid(tokens[at : at + LAID])
            last, other = two_before(x, since)
            place, node, bit = code.bits(last, x)
            word = data[done : done + len(place)]
            done += len(place)
            cells = np.zeros((len(place), 4), np.uint8)  # three inputs towards the bit itself, and the gate with the bit
            cells[:, 1] = towards(two.take((other.astype(np.int32) << 16)[place] + node), bit).view(np.uint8)
            cells[:, 2] = word
            cells[:, 3] = bit + 2 * GATE_OF[word]
            length = code.length[last.astype(np.int32) * 256 + x]
            sizes = np.add.reduceat(length, np.flatnonzero(since == 0))
            # a token's first two bytes, where the word before has its say
            near = np.flatnonzero(since < 2)
            early = np.bincount(owner[near], length[near], len(sizes)).astype(np.int32)
            low = np.repeat(np.where(since[near] == 1, 256 + last[near].astype(np.int16), 0).astype(np.uint16), length[near])
            own = np.arange(len(low)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(early) - early), early)
            parts.append((cells.reshape(-1).view(np.uint32), low, node[own], sizes, early))
        if not parts:
            parts = [tuple(np.zeros(0, kind) for kind in (np.uint32, np.uint16, np.int32, np.int32, np.int32))]
        cells, low, node, sizes, early = map(np.concatenate, zip(*parts, strict=True))
        return cls(by_token(cells, sizes), by_token(low, early), by_token(node, early), sizes, early, ranks)

    def some(self, at: np.ndarray) -> Laid:
        return Laid(*(c.take(pa.array(at)) for c in self.columns), *(x[at] for x in self.numbers))

    def and_of(self, other: Laid) -> Laid:
        return Laid(*map(pa.concat_arrays, zip(self.columns, other.columns, strict=True)), *map(np.concatenate, zip(self.numbers, other.numbers, strict=True)))


class Mixer:
    """Scores streams of tokens side by side; a document's weights go on from piece to piece."""

    def __init__(self, code: Code, two: np.ndarray, pairs: np.ndarray, weights: np.ndarray, rate: float = RATE):
        """``pairs``: log odds by slot, a power of two of them."""
        self.code, self.two, self.pairs, self.slot_bits = code, two, pairs, len(pairs).bit_length() - 1
        self.start, self.rate = weights.astype(np.float32) / STEPS, np.float32(rate * STEPS**-2)

    def fresh(self, n: int) -> np.ndarray:
        return np.tile(self.start, (n, 1, 1))

    def laid(self, tokens: list[bytes], data: np.ndarray, ranks: np.ndarray) -> Laid:
        return Laid.of(tokens, data, ranks, self.code, self.two)

    def learn(self, tokens: list[bytes], inputs: list[bytes], ranks: list[int]) -> None:
        """Lay out the bits of distinct tokens. ``inputs``: of the trie, in any pieces; ``ranks``: as a word before, or -1."""
        self.take(self.laid(tokens, np.frombuffer(b"".join(inputs), np.uint8), np.array(ranks, np.int64)))

    def take(self, known: Laid) -> None:
        """Score streams of these tokens from now on."""
        (self.cells, self.early_low, self.early_node), (self.sizes, self.early, self.ranks) = known.columns, known.numbers

    def score(self, streams: list[np.ndarray], before: list[int], weights: np.ndarray) -> np.ndarray:
        """Natural log probability of each stream of token numbers behind the token ``before``. ``weights`` (stream, GATES, INPUTS) are refined in place."""
        token, counts = np.concatenate(streams), np.fromiter(map(len, streams), np.int64, len(streams))
        behind = np.append(0, token[:-1])
        behind[np.cumsum(counts) - counts] = before
        upto = np.append(0, np.cumsum(self.sizes[token], dtype=np.int64))
        length = upto[np.cumsum(counts)] - upto[np.cumsum(counts) - counts]
        return self.bits_scored(token, behind, counts, np.zeros(len(streams), np.int64), length, weights)

    def bits_scored(self, token: np.ndarray, behind: np.ndarray, counts: np.ndarray, skip: np.ndarray, length: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """:meth:`score` of streams of ``counts`` tokens each (at least one), with the token ``behind`` which each stands.

        Of a stream the first ``skip`` bits are left out, and of what follows all but the first ``length``, so that a long
        document is scored in pieces as it is whole: a piece ends with a block, and the next begins at the token that is open.
        """
        n, total = len(counts), int(self.sizes[token].sum())
        chosen = pa.array(token)
        values = np.frombuffer(self.cells.take(chosen).buffers()[2], np.uint32, total).copy()
        upto = np.cumsum(self.sizes[token], dtype=np.int32) - self.sizes[token]
        # the word before has its say at the first two bytes
        rank, early = self.ranks[behind], self.early[token]
        near = int(early.sum())
        place = np.arange(near, dtype=np.int32)
        place += np.repeat(upto - (np.cumsum(early, dtype=np.int32) - early), early)
        slot = np.repeat(rank.astype(np.uint64) << np.uint64(9), early)
        slot += np.frombuffer(self.early_low.take(chosen).buffers()[2], np.uint16, near)
        slot *= FACTOR
        node = np.frombuffer(self.early_node.take(chosen).buffers()[2], np.int32, near).astype(np.uint64)
        node += np.uint64(1)
        node *= MIX_NODE
        slot ^= node
        del node
        slot *= MIX
        slot >>= np.uint64(64 - self.slot_bits)
        said = self.pairs.take(slot.view(np.int64), mode="clip").view(np.uint8)
        del slot
        if rank.min(initial=0) < 0:
            said[np.repeat(rank < 0, early)] = 0
        now = values.take(place, mode="clip")
        which = (now >> np.uint32(16) & np.uint32(256)).astype(np.uint16)
        which |= said
        now &= KEPT.take(said, mode="clip")
        now |= SAYING.take(which, mode="clip")
        values[place] = now
        del now, which, place, said
        # a stream begins with a block; then first blocks stand together, those of the longest streams first, then second ones, and so on
        blocks = -(-length // BLOCK)
        begin = np.cumsum(blocks) - blocks
        grid = np.zeros(int(blocks.sum()) * BLOCK, np.uint32)
        edges = upto[np.cumsum(counts) - counts] + skip
        for start, n_bits, to in zip(edges.tolist(), length.tolist(), (begin * BLOCK).tolist(), strict=True):
            grid[to : to + n_bits] = values[start : start + n_bits]
        del values
        order = np.argsort(-blocks, kind="stable")
        nth = np.empty(n, np.int64)
        nth[order] = np.arange(n)
        row = np.repeat(nth, blocks)
        turn = np.argsort((np.arange(len(row)) - np.repeat(begin, blocks)) * n + row)
        row, grid = row[turn], grid.reshape(-1, BLOCK)[turn]
        going = np.searchsorted(-blocks[order], -np.arange(int(blocks.max(initial=0))), "left")
        steps = np.append(0, np.cumsum(going))
        ends, gates = row * GATES, grid.view(np.uint8).reshape(-1, BLOCK, 4)[:, :, 3] >> 1
        fields = grid.view(np.int8).reshape(-1, BLOCK, 4)
        w = [-weights[order, :, k].reshape(-1) for k in range(INPUTS)]
        ones = np.empty((len(row), BLOCK), np.float32)
        for m, at, upto in zip(going.tolist(), steps.tolist(), steps[1:].tolist(), strict=False):
            gate = (gates[at:upto] + ends[at:upto, None]).reshape(-1)
            ins = [fields[at:upto, :, k].astype(np.float32).reshape(-1) for k in range(INPUTS)]
            z = w[0].take(gate, mode="clip")
            z *= ins[0]
            for k in range(1, INPUTS):
                part = w[k].take(gate, mode="clip")
                part *= ins[k]
                z += part
            np.exp(z, z)
            one = ones[at:upto].reshape(-1)
            np.add(z, np.float32(1), one)
            z /= one  # how far off each bit's probability is
            for k in range(INPUTS):
                ins[k] *= z
                w[k][: m * GATES] -= self.rate * np.bincount(gate, ins[k], m * GATES).astype(np.float32)
        for k in range(INPUTS):
            weights[order, :, k] = -w[k].reshape(n, GATES)
        loss = np.bincount(row, np.log(ones, ones).sum(axis=1), n)[nth]
        # what fills a last block up is even and teaches nothing
        return (blocks * BLOCK - length) * math.log(2) - loss


def _pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``most`` bytes of their texts."""
    held, size = [], 0
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at, gone = 0, 0
        while at < b.num_rows:
            end = min(int(np.searchsorted(upto, gone + most - size, "left")) + 1, b.num_rows)
            held.append(b.slice(at, end - at))
            size += int(upto[end - 1]) - gone
            at, gone = end, int(upto[end - 1])
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of all texts (learn, text), the end mark among them as a newline; only rows to learn from are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for piece in _pieces(batches, 3 * PIECE):
            words, learn = Words(piece.column("text")), piece.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(words.numbers[np.repeat(learn, words.counts)], minlength=len(words.distinct))
            ends += int(learn.sum())
            yield pa.RecordBatch.from_arrays([words.distinct, pa.array(n, pa.int64())], ["token", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["token", "n"])

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def range_cuts(tokens: DataFrame, count: int, size: int = RANGE) -> list[bytes]:
    """Tokens, cut to 32 bytes, at which the vocabulary's order is cut into ranges of about ``size``, or into RANGES where those would be more: from a sample of 50 a range."""
    every = max(1, size // 50, -(-count // (50 * RANGES)))
    if count <= size:
        return []
    some = tokens.where(F.pmod(F.xxhash64("token"), F.lit(every)) == 0).select(F.substring("token", 1, 32).alias("token")).toArrow()["token"].to_pylist()
    return sorted(set(sorted(some)[50::50]))


def short_contexts(tokens: DataFrame, cuts: list[bytes]) -> tuple[Code, np.ndarray, Shared]:
    """The code, the table of two bytes, and the trie's contexts that lie in several ranges; all bounded (2^24 keys; RANGES cuts, 32 prefixes a cut)."""
    shared = prefixes(cuts)
    hashes = np.array([hash_of(p) for p in shared], np.uint64)
    order = np.argsort(hashes)
    hashes, last = hashes[order], np.array([shared[i][-1] if shared[i] else SPACE for i in order], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 50_000):
                part = b.slice(at, 50_000)
                keys, counts, shared_keys, shared_counts = count_contexts(part.column(0).to_pylist(), part.column(1).to_numpy(), hashes)
                key = np.concatenate((keys, -1 - shared_keys))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate((counts, shared_counts)).astype(np.int64))], ["k", "n"])

    got = tokens.where("c > 0").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    key, n = got["k"].to_numpy(), got["n"].to_numpy()
    keys, counts, shared_keys, shared_counts = key[key >= 0], n[key >= 0], -1 - key[key < 0], n[key < 0]
    order = np.argsort(keys)  # rows come in any order
    keys, counts = keys[order], counts[order]
    code = Code(np.bincount(keys & 0xFFFF, counts, 1 << 16).reshape(256, 256))
    return code, table_of_two(counts, keys, code), Shared(hashes, last, shared_keys, shared_counts, code)


class Sent:
    """Numpy arrays that are mostly zero, small while they are sent to tasks."""

    def __init__(self, array: np.ndarray):
        import zstandard

        self.data, self.kind = zstandard.compress(array.tobytes(), 3), array.dtype

    def array(self) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.decompress(self.data), self.kind)


def vocabulary_of(tokens: DataFrame, cuts: list[bytes], code: Code, two: np.ndarray, shared: Shared) -> DataFrame:
    """(token, c, inputs) of all tokens; a row without a token has a range's weights, and in c the bits they stand for."""
    model = tokens.sparkSession.sparkContext.broadcast((code, Sent(two), shared))  # of bounded size

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_right(cuts, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], ["part", "token", "c"])

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        code, sent, shared = model.value
        two = sent.array()

        def out() -> pa.RecordBatch:
            token = [t for b in held for t in b.column(1).to_pylist()]
            c = [n for b in held for n in b.column(2).to_pylist()]
            found, weights, mass = trie_inputs(token, np.array(c), code, two, shared)
            kinds = zip((pa.binary(), pa.int64(), pa.binary()), ([*token, None], [*c, int(mass)], [*found, weights.tobytes()]), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for k, x in kinds], ["token", "c", "inputs"])

        for b in batches:
            part = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for i, (at, upto) in enumerate(zip(edges, edges[1:], strict=False)):
                if held and (i or held[-1].column(0)[0].as_py() != part[at]):
                    yield out()
                    held.clear()
                if upto > at:
                    held.append(b.slice(at, upto - at))
        if held:
            yield out()

    dealt = tokens.mapInArrow(ranges, "part int, token binary, c long").repartition("part").sortWithinPartitions("part", "token")
    return dealt.mapInArrow(inputs, "token binary, c long, inputs binary")


class Head:
    """The most frequent tokens, the end mark first and then the most frequent, with what scoring needs of them."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, inputs: list[bytes], words_before: int):
        self.tokens = pa.array(tokens, pa.binary())
        self.log_c, self.words_before = np.log10(counts.astype(float) + 1), words_before
        self.data = np.frombuffer(b"".join(inputs), np.uint8)

    def rank(self, token: bytes) -> int:
        """As a word before: its own rank if it is one of the most frequent words, or that of all other words that end in the same two bytes."""
        i = pc.index(self.tokens, pa.scalar(token, pa.binary())).as_py()
        return i if 0 <= i < self.words_before else self.words_before + int.from_bytes(token[-2:])

    def places(self, words: Words) -> np.ndarray:
        """Of distinct words: their places, or -1."""
        return pc.index_in(words.distinct, self.tokens).fill_null(-1).to_numpy().astype(np.int64)

    def ranks(self, tokens: pa.Array, at: np.ndarray) -> np.ndarray:
        """:meth:`rank` of tokens that have these places."""
        _, _, other, last = ends_of(tokens)
        return np.where((at >= 0) & (at < self.words_before), at, self.words_before + (other << 8) + last)


class Model:
    """All that scoring needs and all tasks share. A Python process lays the head's tokens out once, for all pieces and tasks it has."""

    def __init__(self, code: Code, two: np.ndarray, pairs: np.ndarray, weights: np.ndarray):
        self.sent, self.made = (code, Sent(two), Sent(pairs), weights), None

    def mixer(self, head: Head) -> tuple[Mixer, Laid]:
        if self.made is None:
            code, two, pairs, weights = self.sent
            mixer = Mixer(code, two.array(), pairs.array(), weights)
            self.made = mixer, mixer.laid(head.tokens.to_pylist(), head.data, head.ranks(head.tokens, np.arange(len(head.tokens))))
            self.sent = None
        return self.made


class Tail:
    """A piece's tokens that aren't in the head, in their order, and what their documents' rows have of them."""

    def __init__(self, tokens: list[bytes] | pa.Array, far: np.ndarray):
        """``far``: which tokens are such."""
        self.far = far
        own = np.flatnonzero(far)
        self.order = own[pc.sort_indices(pa.array(tokens, pa.binary()).take(pa.array(own))).to_numpy()]  # token numbers
        self.rank = np.empty(len(tokens), np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def of(self, sequence: np.ndarray) -> np.ndarray:
        """Numbers of a document's distinct tokens of these, sorted by token."""
        return self.of_all(sequence, np.array([len(sequence)]))[0]

    def of_all(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`of` all documents, of ``counts`` words each, one after another; and how many each has."""
        far = self.far[numbers]
        many = max(1, len(self.order))
        found = np.unique(np.repeat(np.arange(len(counts)), counts)[far] * many + self.rank[numbers[far]])
        return self.order[found % many], np.bincount(found // many, minlength=len(counts))

    def take(self, sequence: np.ndarray, given: pa.StructArray) -> None:
        """``given``: (at, c, inputs) of the document's tokens of these, ``at`` their places in that order."""
        self._take(self.of(sequence)[given.field(0).to_numpy()], given)

    def _take(self, number: np.ndarray, given: pa.StructArray) -> None:
        self.parts.append((number, given.field(1).to_numpy(), given.field(2)))

    def take_all(self, numbers: np.ndarray, counts: np.ndarray, given: pa.ListArray) -> None:
        """:meth:`take` of all documents: ``given`` has a list for each, or null."""
        own, have = self.of_all(numbers, counts)
        values = given.flatten()
        n = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(values):
            self._take(own[np.repeat(np.cumsum(have) - have, n) + values.field(0).to_numpy()], values)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token numbers, counts, lengths of inputs, inputs end to end) of all that was taken."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        number, c, inputs = (list(x) for x in zip(*self.parts, strict=True))
        inputs = [x for part in inputs for x in part.to_pylist()]
        return np.concatenate(number), np.concatenate(c), np.fromiter(map(len, inputs), np.int64, len(inputs)), np.frombuffer(b"".join(inputs), np.uint8)

    def each(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of tokens, their counts, inputs end to end), each token once and in their order."""
        if not self.parts:
            return self.order, np.zeros(0, np.int64), np.zeros(0, np.uint8)
        number, c = (np.concatenate([part[k] for part in self.parts]) for k in (0, 1))
        first = np.unique(self.rank[number], return_index=True)[1]
        inputs = pa.chunked_array([part[2] for part in self.parts]).take(pa.array(first)).to_pylist()
        return number[first], c[first], np.frombuffer(b"".join(inputs), np.uint8)


def with_ends(numbers: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Documents' token numbers one after another, the end mark behind each."""
    out = np.full(len(numbers) + len(counts), end, np.int64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)), counts)] = numbers
    return out


def reading(texts: DataFrame, top) -> DataFrame:
    """What scoring needs of the texts (learn, text, k1, k2): rows (k1, k2, tail) with the tokens of a text that aren't in ``top``, in their
    order, and once in a task for rows alike; and rows (pair, n) with how often the first two bytes of a token stand behind words of a rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = top.value
        names = ["k1", "k2", "tail", "pair", "n"]
        held: list[np.ndarray] = []
        met: set[tuple[int, int]] = set()

        def pairs() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            none = [pa.nulls(len(keys), k) for k in (pa.int64(), pa.int32(), pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([*none, pa.array(keys), pa.array(n.astype(np.int64))], names)

        for piece in _pieces(batches):
            words = Words(piece.column("text"))
            at = head.places(words)
            tail = Tail(words.distinct, at < 0)
            new = np.zeros(piece.num_rows, bool)
            for i, key in enumerate(zip(piece.column("k1").to_pylist(), piece.column("k2").to_pylist(), strict=True)):
                if key not in met:
                    met.add(key)
                    new[i] = True
            own, have = tail.of_all(words.numbers[np.repeat(new, words.counts)], words.counts[new])
            some = np.flatnonzero(new)[have > 0]
            if len(some):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(have[have > 0])), pa.int32()), words.distinct.take(pa.array(own)))
                columns = [*(piece.column(k).take(pa.array(some)) for k in ("k1", "k2")), lists, *(pa.nulls(len(some), pa.int64()) for _ in range(2))]
                yield pa.RecordBatch.from_arrays(columns, names)
            learn = piece.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            first, second, *_ = ends_of(words.distinct)
            end = len(first)
            order = np.append(end, with_ends(words.numbers[np.repeat(learn, words.counts)], words.counts[learn], end))
            rank, start = np.append(head.ranks(words.distinct, at), head.rank(END)), np.append(first << 8 | second, first_two(END))
            held.append((rank[order[:-1]] << 16) + start[order[1:]])
            if sum(map(len, held)) > 3_000_000:
                yield pairs()
        yield pairs()

    return texts.mapInArrow(run, "k1 long, k2 int, tail array<binary>, pair long, n long")


def pair_table(pairs: DataFrame, code: Code, two: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(log odds by slot, weights) of pairs (pair, n); there are at most ``words_before`` and 2^16 ranks, times 2^16."""
    bits = max(10, math.ceil(math.log2(4 * pairs.count() + 1)))
    model = pairs.sparkSession.sparkContext.broadcast((code, Sent(two)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sent = model.value
        two = sent.array()
        held = [np.zeros(0, np.int64)] * 2

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            slots, odds, weights, mass = pair_cells(keys, n, code, two, bits)
            row = (slots.astype("<i8").tobytes(), odds.tobytes(), weights.tobytes(), mass)
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["slots", "odds", "weights", "mass"])

        for b in batches:
            for at in range(0, b.num_rows, RANGE):
                held = [np.concatenate((h, c.to_numpy()[at : at + RANGE])) for h, c in zip(held, b.columns, strict=True)]
                whole = int(np.searchsorted(held[0], held[0][-1] >> 16 << 16))  # up to the last word, whose pairs may go on
                if whole > RANGE:
                    yield out(*(h[:whole] for h in held))
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield out(*held)

    dealt = pairs.select("pair", "n").repartition(F.shiftright("pair", 16)).sortWithinPartitions("pair")
    out = np.zeros(1 << bits, np.int8)
    weights, mass = np.zeros(GATES * INPUTS), 0.0
    rows = written(dealt.mapInArrow(run, "slots binary, odds binary, weights binary, mass double"), "lm-pairs")
    for r in rows.orderBy("mass", "weights").toLocalIterator():
        out[np.frombuffer(r["slots"], "<i8")] = np.frombuffer(r["odds"], np.int8)
        weights += r["mass"] * np.frombuffer(r["weights"])
        mass += r["mass"]
    return out, (weights / mass).reshape(GATES, INPUTS)[KNOWN:] if mass else None


def lm_scores(
    docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", head: int = 300_000, words_before: int = 32_768
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumns({"learn": crc_mod("id", folds) != held_out, "k1": F.xxhash64("id", "text"), "k2": F.coalesce(F.octet_length("text"), F.lit(-1))})
    tokens = written(token_counts(texts.select("learn", "text")), "lm-tokens")
    totals = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count(F.lit(1)).alias("all")).first()
    n_train, base = totals["n"], math.log10(totals["n"] + totals["v"] + 1)
    cuts = range_cuts(tokens, totals["all"])
    code, two, shared = short_contexts(tokens, cuts)
    vocabulary = written(vocabulary_of(tokens, cuts, code, two, shared), "lm-vocabulary")
    drop_path(spark, tokens.inputFiles()[0].rsplit("/", 1)[0])
    known = vocabulary.where("token IS NOT NULL")
    weights = np.tile(np.array(START), (GATES, 1))
    fits = [(r["c"], np.frombuffer(r["inputs"])) for r in vocabulary.where("token IS NULL AND c > 0").orderBy("inputs").collect()]  # one for each range
    if fits:
        weights = np.average([w for _, w in fits], axis=0, weights=[n for n, _ in fits]).reshape(GATES, INPUTS)
    end = F.col("token") == F.lit(END)
    first = known.where(end | (F.col("c") > 0)).orderBy(F.desc(end), F.desc("c"), "token").limit(head).toArrow()
    shared_top = spark.sparkContext.broadcast(Head(first["token"].to_pylist(), first["c"].to_numpy(), first["inputs"].to_pylist(), words_before))  # a bounded number of tokens
    del first
    read = written(reading(texts.select("learn", "text", "k1", "k2"), shared_top), "lm-read")
    pairs = written(read.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "lm-pair-counts")
    slots, pair_weights = pair_table(pairs, code, two)
    if pair_weights is not None:
        weights[KNOWN:] = pair_weights
    model = spark.sparkContext.broadcast(Model(code, two, slots, weights))
    # rows alike in id and text have one key, and what they have in common is taken once
    rest = read.where("k1 IS NOT NULL").select("k1", "k2", F.posexplode("tail").alias("at", "token"))
    tails = rest.join(known, "token").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "c", "inputs")).alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared_top.value
        mixer, head = model.value.mixer(top)
        for piece in _pieces(batches):
            words = Words(piece.column("text"))
            at = top.places(words)
            tail = Tail(words.distinct, at < 0)
            tail.take_all(words.numbers, words.counts, piece.column("tail"))
            rest, c, data = tail.each()
            near = np.flatnonzero(at >= 0)
            number = np.empty(len(at), np.int64)  # the end mark is 0
            number[near], number[rest] = 1 + np.arange(len(near)), 1 + len(near) + np.arange(len(rest))
            known = np.append(0, at[near])  # their places in the head
            log_c = np.append(top.log_c[known], np.log10(c + 1.0))
            others = mixer.laid(words.distinct.take(pa.array(rest)).to_pylist(), data, top.ranks(words.distinct, at)[rest])
            mixer.take(head.some(known).and_of(others))
            stream, n_tokens = with_ends(number[words.numbers], words.counts, 0), words.counts + 1
            first = np.cumsum(n_tokens) - n_tokens
            score = in_pieces(mixer, np.split(stream, first[1:]))
            # of words, with a space behind each, and the end mark with one
            n_bytes = pc.binary_length(words.distinct).to_numpy(zero_copy_only=False)[words.numbers].astype(np.int64) + 1
            n_bytes = np.add.reduceat(with_ends(n_bytes, words.counts, 2), first)
            columns = [
                piece.column("id"),
                piece.column("learn"),
                pa.array(n_tokens, pa.int64()),
                pa.array(np.add.reduceat((log_c[stream] > 0).astype(np.int64), first), pa.int64()),
                pa.array(np.add.reduceat(log_c[stream], first), pa.float64()),
                pa.array(score / math.log(10), pa.float64()),
                pa.array(n_bytes, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "learn", "n_tokens", "n_known", "total", "score", "n_bytes"])
            del piece, words, tail, columns
            pa.default_memory_pool().release_unused()

    fields = f"id {dict(texts.dtypes)['id']}, learn boolean, n_tokens long, n_known long, total double, score double, n_bytes long"
    rows = texts.join(tails, ["k1", "k2"], "left").select("id", "text", "learn", "tail").mapInArrow(run, fields)
    return rows.select(
        F.col("id").alias(id_col),
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("total") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
