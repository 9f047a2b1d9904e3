"""Token ids of letters that normalisation takes apart, even shards of small tables, exchanges, and tables that are deleted."""

from __future__ import annotations

import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from swinglake.llm import langid, lm, packing, sharding, simhash
from swinglake.llm.common import scratch, shared_dir


@pytest.mark.parametrize("mark", packing.ChunkTokenizer.MARKS)
def test_ids_are_those_of_plain_encode_for_every_letter(mark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, chunks = Tokenizer.from_file(path), packing.ChunkTokenizer(path, 1 << 20, 1 << 20)
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    if mark != "?":  # every letter once, those that may be taken apart with every mark
        letters = [x for x in letters if plain.normalizer.normalize_str(x) != x]
    texts = [f.format(x, mark) for x in letters for f in ("{0}{1}", "a{0}{1}!", "{0}a {0}{1}")]
    for text, got, expected in zip(texts, chunks(texts), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == expected.ids, text


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_shards_of_small_tables_are_near_equal(spark, name):
    rows = sharding.op10_sharding(spark, f"/root/testdata/{name}").select("doc_id", "size", "shard", "slot").toPandas()
    by = rows.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    dealt = [0] * 40  # the largest first, each to the emptiest
    for x in sorted(rows["size"], reverse=True):
        dealt[dealt.index(min(dealt))] += x
    assert by.max() - by.min() <= max(dealt) - min(dealt) + rows["size"].median()
    for _, slots in rows.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_exchanges_bring_sizes_together():
    rng = random.Random(3)
    for _ in range(50):
        held = [[(rng.randint(1, 2000), (j, i)) for i in range(rng.randint(0, 12))] for j in range(rng.randint(1, 9))]
        fixed = [rng.randint(0, 3000) for _ in held]
        before = [f + sum(x for x, _ in m) for f, m in zip(fixed, held, strict=True)]
        moved = sharding.exchanges(before, held)
        after = list(fixed)
        for j, m in enumerate(held):
            for x, name in m:
                after[moved.get(name, j)] += x
        assert sum(after) == sum(before) and max(after) - min(after) <= max(before) - min(before)


def test_components_leave_no_tables(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    at = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(at))
    with scratch(spark):
        got = {tuple(r) for r in simhash.components(links).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)} and set(os.listdir(at)) == before


def test_pipeline_leaves_only_its_stages(spark, sf):
    at = shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(at))
    corpus_pipeline.run(spark, sf).write.format("noop").mode("overwrite").save()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before}
    assert left == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES}


def test_long_ids_clash_with_helper_columns(spark):
    docs = spark.createDataFrame([(i, f"word {i} text") for i in range(30)], "doc_id long, text string")
    rows = docs.withColumns({c: F.lit(1) for c in ("__file", "__row", "__size", "__new", "size", "slot", "nth")})
    path = f"{shared_dir(spark)}/clash-{random.random()}"
    sharding.lay_out(docs, "pmod(doc_id, 3)", 3, path, 5)
    sharding.reshard(spark, path, 4)
    assert sorted(r.doc_id for r in sharding.read_shards(spark, path).collect()) == list(range(30)) and rows.count() == 30


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Long documents have the same score alone and beside others, whole and in pieces, in one partition and in many."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([60_001, 9000, 1, 0, 300, 25_000, 40, 700])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts, piece in ((1, lm.PIECE), (8, lm.PIECE), (1, 8 * 2000), (3, 8 * 131)):
        monkeypatch.setattr(lm.in_pieces, "__defaults__", (piece // 8,))
        found.append({r.doc_id: r.score for r in lm.lm_scores(docs.repartition(parts, "doc_id")).collect()})
    for other in found[1:]:
        for i, score in found[0].items():
            assert other[i] == pytest.approx(score, rel=1e-6)


def test_pieces_are_the_whole(monkeypatch):
    """A stream scored in pieces has the loss of the stream scored at once, to the last digits, and leaves the same weights."""
    from test_operators import lm_parts

    rng = random.Random(9)
    streams = [[bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6))) for _ in range(n)] + [b"\n"] for n in (2000, 0, 400, 129, 128)]
    tokens, times, code, two, inputs = lm_parts(streams)
    table = np.random.default_rng(1).integers(-100, 100, 1 << 12).astype(np.int8)
    mixer = lm.Mixer(code, two, table, np.tile(np.array(lm.START), (lm.GATES, 1)))
    mixer.learn(tokens, [inputs[t] for t in tokens], [i % 7 - 1 for i in range(len(tokens))])
    numbers = [np.array([tokens.index(t) for t in s]) for s in streams]
    end = tokens.index(b"\n")
    order = [end] + [i for i in range(len(tokens)) if i != end]  # the end mark comes first, as in the query
    mixer.learn([tokens[i] for i in order], [inputs[tokens[i]] for i in order], [i % 7 - 1 for i in range(len(tokens))])
    numbers = [np.array([order.index(i) for i in s]) for s in numbers]
    whole = mixer.score(numbers, [0] * len(numbers), mixer.fresh(len(numbers)))
    for tokens_each in (128, 150, 500, 1999, 5000):
        assert lm.in_pieces(mixer, numbers, tokens_each) == pytest.approx(whole, rel=1e-9)


def test_ranges_are_bounded(spark, monkeypatch):
    tokens = spark.range(5000).selectExpr("cast(concat('t', id) as binary) AS token")
    assert len(lm.range_cuts(tokens, 5000, 100)) > 20
    monkeypatch.setattr(lm, "RANGES", 8)
    assert 1 <= len(lm.range_cuts(tokens, 5000, 100)) <= 16


def test_language_sample_is_bounded_by_all_languages(spark, monkeypatch):
    """With many languages each gives fewer rows, and none is left out."""
    rows = [(i, f"word{i} of language {i % 20}", f"l{i % 20}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda windows, classes, k: seen.update(n=len(windows), classes=set(classes.tolist())))
    for most, each in ((200_000, 20), (60, 3), (5, 1)):
        monkeypatch.setattr(langid, "SAMPLE_ROWS", most)
        names, _ = langid.train(docs, F.lit(True))
        assert len(names) == 20 and seen["classes"] == set(range(20)) and seen["n"] == 20 * each
