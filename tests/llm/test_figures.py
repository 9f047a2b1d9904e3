"""What the figures of the check tool asked for: work that isn't done twice, and nothing left out of it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from swinglake.llm import lm, packing


class Counting:
    """A tokenizer that notes what it was asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode(self, text, **options):
        self.asked.append(text)
        return self.tokenizer.encode(text, **options)


def test_letters_go_to_the_model_and_only_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, chunks = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    chunks.tokenizer = Counting(plain)
    texts = ["Naïve words, ΣΑΣ and Éclairs! words, words", None, "words, naïve\nÉclairs!", ""]
    for text, got in zip(texts, chunks(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert not any(c.isalpha() for text in chunks.tokenizer.asked for c in text)


def test_texts_are_tokenised_by_size():
    texts = ["x" * 7, None, "", "y" * 30, "z", "w" * 9, "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    parts = [p.column(1).to_pylist() for p in packing.in_parts(batch, 10)]
    assert [t for p in parts for t in p] == texts
    assert all(sum(len(t or "") for t in p[:-1]) < 20 for p in parts) and len(parts) > 2
    assert list(packing.in_parts(batch.slice(0, 0), 10)) == []


def test_every_word_has_a_say_as_the_word_before(spark):
    """Behind words that aren't among the most frequent, pairs are counted and used too."""
    rows = [(i, f"frequent frequent rareword{i % 5}ing {'qqq' if i % 2 else 'zzz'}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.selectExpr("true AS learn", "text", "doc_id AS k1", "1 AS k2")
    words = [lm.END, b"frequent", b"rareword0ing", b"qqq"]
    top = lm.Head(words, np.array([40, 80, 8, 20]), [b""] * 4, 2)
    assert top.rank(b"rareword0ing") == top.rank(b"never-seen-ing") == 2 + int.from_bytes(b"ng") and top.rank(b"x") == 2 + ord("x")
    found = lm.reading(texts, spark.sparkContext.broadcast(top)).where("pair IS NOT NULL").groupBy("pair").sum("n").collect()
    counted = {r["pair"]: r["sum(n)"] for r in found}
    assert sum(counted.values()) == sum(len(t.split()) + 1 for _, t in rows)  # every token stands behind one word
    assert counted[top.rank(b"rareword0ing") << 16 | lm.first_two(b"qqq")] == 20


def test_tails_are_read_by_number():
    tokens = [lm.END, b"b", b"zz", b"a", b"c"]
    tail = lm.Tail(tokens, np.array([False, False, True, True, True]))
    sequence = np.array([2, 1, 3, 2], np.int32)
    assert [tokens[i] for i in tail.of(sequence).tolist()] == [b"a", b"zz"]
    given = pa.array([{"at": 1, "c": 9, "inputs": b"xyz"}, {"at": 0, "c": 99, "inputs": b"u"}])
    for part in (given, given.slice(1)):
        tail.take(sequence, part)
    number, c, lengths, data = tail.found()
    assert (number.tolist(), c.tolist(), lengths.tolist(), data.tobytes()) == ([2, 3, 3], [9, 99, 99], [3, 1, 1], b"xyzuu")


def test_words_of_many_texts_at_once():
    """Words are split, lower-cased and numbered by column as they are by text, in slices and at odd white space too."""
    texts = [None, "", " \t\n", "A b\x0bÄ Ö a\x1cB", "  b a ", "İx A\r\nb\x85c", "one", None, "Ünï A" * 30]
    for column in (pa.array(texts, pa.string()), pa.array(["zz", *texts, "yy"], pa.string()).slice(1, len(texts)), pa.array([None, ""], pa.string())):
        words = lm.Words(column)
        expected = [(t or "").encode().lower().split() for t in column.to_pylist()]
        tokens = words.distinct.to_pylist()
        assert words.counts.tolist() == list(map(len, expected)) and len(set(tokens)) == len(tokens)
        assert [tokens[i] for i in words.numbers.tolist()] == [w for t in expected for w in t]
        first, second, other, last = (x.tolist() for x in lm.ends_of(words.distinct))
        assert [a << 8 | b for a, b in zip(first, second, strict=True)] == [lm.first_two(t) for t in tokens]
        assert [a << 8 | b for a, b in zip(other, last, strict=True)] == [int.from_bytes(t[-2:]) for t in tokens]


def test_frequent_tokens_are_laid_out_once(monkeypatch):
    """Pieces and tasks of a process lay out only what isn't in the head, and score as if all was laid out for each."""
    from test_operators import lm_parts

    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 5))) for _ in range(90)]
    streams = [[rng.choice(words) for _ in range(n)] + [lm.END] for n in (300, 0, 1, 80, 150)]
    tokens, times, code, two, inputs = lm_parts(streams)
    tokens = [lm.END] + [t for t, _ in times.most_common() if t != lm.END]
    head, rest = tokens[:40], tokens[40:]
    top = lm.Head(head, np.array([times[t] for t in head]), [inputs[t] for t in head], 10)
    table = np.random.default_rng(1).integers(-100, 100, 1 << 12).astype(np.int8)
    weights = np.tile(np.array(lm.START), (lm.GATES, 1))
    whole = lm.Mixer(code, two, table, weights)
    whole.learn(tokens, [inputs[t] for t in tokens], list(map(top.rank, tokens)))
    expected = lm.in_pieces(whole, [np.array([tokens.index(t) for t in s]) for s in streams])
    model, laid, of = lm.Model(code, two, table, weights), [], lm.Laid.of.__func__
    monkeypatch.setattr(lm.Laid, "of", classmethod(lambda cls, tokens, *more: laid.extend(tokens) or of(cls, tokens, *more)))
    for seed in (1, 2):
        mixer, known = model.mixer(top)
        some = list(range(1, 40))
        random.Random(seed).shuffle(some)
        own = [lm.END, *(head[i] for i in some), *rest]
        others = mixer.laid(rest, np.frombuffer(b"".join(inputs[t] for t in rest), np.uint8), np.array(list(map(top.rank, rest))))
        mixer.take(known.some(np.array([0, *some])).and_of(others))
        assert lm.in_pieces(mixer, [np.array([own.index(t) for t in s]) for s in streams]).tolist() == expected.tolist()
    assert laid == head + rest + rest


def test_tails_of_many_documents_at_once():
    tokens = [b"b", b"zz", b"a", b"c"]
    one, all_ = (lm.Tail(tokens, np.array([False, True, True, True])) for _ in range(2))
    documents = [[1, 0, 2, 1], [], [0, 0], [3], [2]]
    given = [[{"at": 1, "c": 9, "inputs": b"xyz"}, {"at": 0, "c": 5, "inputs": b"u"}], None, None, [{"at": 0, "c": 0, "inputs": b"vw"}], [{"at": 0, "c": 5, "inputs": b"u"}]]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("c", pa.int64()), ("inputs", pa.binary())]))
    column = pa.array([[{"at": 0, "c": 1, "inputs": b"?"}], *given], kind).slice(1)
    all_.take_all(np.array([i for d in documents for i in d], np.int32), np.array(list(map(len, documents))), column)
    for d, g in zip(documents, column, strict=True):
        if g.is_valid:
            one.take(np.array(d, np.int32), g.values)
    assert [x.tolist() for x in all_.found()] == [x.tolist() for x in one.found()]
    number, c, data = all_.each()
    assert (number.tolist(), c.tolist(), data.tobytes()) == ([2, 3, 1], [5, 0, 9], b"uvwxyz")
