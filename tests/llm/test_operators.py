"""Training-data operators against brute force on small tables, with nulls, empty and long texts, ties and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swinglake.llm import chat, exact, langid, lm, mixing, packing, quality, registry, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ",", "!"]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 1) for i in range(120)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n ", "en", "b", 4), (203, "one", "en", "a", 3), (204, text(9000), "en", "c", 1)]
    base = text(80)
    rows += [(300 + i, base, "en", "a", 1) for i in range(6)]
    rows += [(310 + i, base.replace(" ", ["  ", "\n", "\t"][i], 2), "de", "b", 1) for i in range(3)]
    rows += [(320 + i, base + " " + vocab[i], "en", "a", 1) for i in range(5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Further columns that are named as the operators' own ones."""
    return docs.withColumns({c: F.lit(1) for c in ("id", "h", "fp", "size", "key", "slot", "old", "norm", "copies", "score", "kept", "keep_id", "ids")})


# exact dedup


def test_exact(spark, data, docs):
    norm = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in data}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact.exact_groups(clashing(docs)).collect()}
    assert len(got) == len(data)
    for i, t in norm.items():
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(groups[t]), len(groups[t]), i == min(groups[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    stay = exact.drop_exact_duplicates(clashing(docs))
    assert stay.columns == clashing(docs).columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(min(g) for g in groups.values())
    assert exact.exact_groups(empty(spark)).count() == 0 and exact.drop_exact_duplicates(empty(spark)).count() == 0


def test_exact_collisions(spark, docs, data, monkeypatch):
    """With a hash that makes everything collide, the comparison of bytes still tells texts apart."""
    monkeypatch.setattr(exact.F, "md5", lambda c: F.lit("00" * 16))
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(docs).collect()}
    norm = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in data}
    assert got == {i: min(j for j, u in norm.items() if u == t) for i, t in norm.items()}


def test_exact_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a", "x", "s", 1)] * 3 + [(None, "a", "x", "s", 1)], SCHEMA)
    assert exact.drop_exact_duplicates(d).collect()[0]["doc_id"] is None and exact.drop_exact_duplicates(d).count() == 1
    assert {(r["doc_id"], r["kept"]) for r in exact.exact_groups(d).collect()} == {(None, True), (1, False)}


# simhash


def brute_fingerprint(t):
    w = WORDS.findall(lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(items)
    for n, x in enumerate(items):
        for y in items[:n]:
            if linked(x, y):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_simhash(spark, data, docs):
    fp = {r[0]: brute_fingerprint(r[1]) for r in data}
    expected = classes(fp, lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(clashing(docs)).collect()}
    assert got == {i: (fp[i], expected[i]) for i in fp}
    stay = simhash.drop_near_duplicates(clashing(docs))
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(expected.values()))
    assert stay.columns == clashing(docs).columns
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tiles_lose_no_link(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)}
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), 4, tree_nodes=40)
    label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    expected = classes(values, lambda x, y: (x ^ y).bit_count() <= 4)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({v: label.get(signed[v], signed[v]) for v in values}) == groups(expected)


def test_tiles_without_a_node(spark):
    rng = random.Random(21)
    for _ in range(6):
        values = sorted({(5 << 40) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(12)})
        links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, tree_nodes=3)
        label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
        assert {v: label.get(v, v) for v in values} == classes(values, lambda x, y: (x ^ y).bit_count() <= 4)


def test_hot_shard_in_bounded_blocks(spark, monkeypatch):
    """Near copies of one text fill single shards: no piece of work holds more than a tile and its block of queries."""
    rng = np.random.default_rng(2)
    bits = np.uint64(1) << rng.integers(0, 64, (30_000, 4)).astype(np.uint64)
    values = np.unique(np.bitwise_xor.reduce(bits, axis=1)).view(np.int64)
    shards = spark.createDataFrame([(v,) for v in values.tolist()], "fp long").select("fp", F.lit(0).alias("pair"), F.lit(0).alias("key"))
    links = simhash.shard_links(shards, 2, tree_nodes=256).collect()
    per_tile = 256 * (1 + simhash.QUERY_TILES)
    assert len(links) < len(values) * (len(values) / per_tile + 2) * 2
    whole = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    # one bit and two bits away from a common value: all within the radius of another
    assert len({whole.get(v, v) for v in values.tolist() if int(v).bit_count() <= 2}) == 1


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [(None, "x y", 0), (0, None, 1), (1, "", 2), (2, " ", 3)], 10
    for k in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 5)):  # edits by one place or a few: similarities on both sides of 0.8, chains too
            rows.append((n, rng.choice([" ", "  "]).join(words).replace("w", rng.choice("wW")), k))
            n += 1
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocab)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
                links += 1
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append((r[0] is None, r[0] or 0))
    expected = sorted(min(g) for g in groups.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, further long").repartition(3)
    for tile in (1024, 2):  # tiles of two texts lose no link
        got = simhash.drop_similar(docs, tile_texts=tile).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == expected
    assert links > 40 and len(simhash.drop_near_duplicates(docs).collect()) != len(expected)
    assert simhash.drop_similar(docs.limit(0)).collect() == []


def test_repeated_rows_of_one_component(spark):
    d = spark.createDataFrame([(4, "same text here now", "x", "s", 1)] * 3 + [(2, "same text here now", "x", "s", 1)], SCHEMA)
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(d).collect()] == [2]


# mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    keys = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: float(weights[i % 3]) for i, k in enumerate(keys)}
    total, target, free = share * sum(sizes.values()), dict.fromkeys(keys, 0.0), set(keys)
    left = total
    while free and left > 1e-9:
        unit = left / sum(w[k] for k in free)
        for k in free:
            target[k] += unit * w[k]
        left = 0.0
        for k in list(free):
            if target[k] >= most * sizes[k]:
                left += target[k] - most * sizes[k]
                target[k] = most * sizes[k]
                free.discard(k)
    return target


def test_mixing(spark, data, docs):
    n = {r[0]: len(WORDS.findall(r[1] or "")) for r in data}
    source = {r[0]: r[3] for r in data}
    sizes = Counter()
    for i, k in n.items():
        sizes[source[i]] += k
    target = brute_targets(sizes)
    got = {r["id"]: r for r in mixing.mix_plan(clashing(docs)).collect()}
    taken = Counter()
    for i, r in got.items():
        assert r["size"] == n[i] and r["source_size"] == sizes[source[i]]
        assert r["target"] == pytest.approx(target[source[i]])
        assert 0 <= r["copies"] <= 2
        taken[source[i]] += r["copies"] * n[i]
    for k in target:
        largest = max(n[i] for i in n if source[i] == k)
        assert abs(taken[k] - target[k]) <= largest / 2
    again = {r["id"]: r["copies"] for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {i: r["copies"] for i, r in got.items()}
    rows = Counter(r["doc_id"] for r in mixing.mixed(clashing(docs)).collect())
    assert rows == Counter({i: c for i, c in again.items() if c})
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_unequal_probabilities(spark):
    d = spark.createDataFrame([(i, "w " * 10, "x", "a", 1, 3.0 if i % 2 else 1.0) for i in range(4000)] + [(9999, "w " * 40000, "x", "b", 1, 1.0)], SCHEMA + ", w double")
    got = mixing.mix_plan(d, weights=(1, 3), share=0.5, weight_col="w").where("key = 'sa'").collect()
    by = Counter()
    for r in got:
        by[r["id"] % 2] += r["copies"]
    assert sum(by.values()) * 10 == pytest.approx(got[0]["target"], abs=10)
    assert by[1] / by[0] == pytest.approx(3, rel=0.2)


# packing


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    """A fresh one, with nothing set on it."""
    return Tokenizer.from_file(TOKENIZER)


def test_token_ids(tokenizer):
    texts = ["It's O'Neill's, l'été Σίσυφος ΣΑΣ. naïve x²y ½ <|endoftext|> a<|startoftext|>", "A B\tC\x1fD\x85E é ÀÉÎ ßÿ don't!!! İ", "!?!? (x)[y]{z}~`^ 12 a1b", None, "", "\n\n  "]
    texts += ["hello <|endoftext|> world", "a<|endoftext|><|startoftext|>b, <|ENDOFTEXT|> <|endoftext|>. <|end oftext|>"]
    rng = random.Random(3)
    bits = list("aZ é.ßÀ'1\n\t,!ÿ\xad\xa0Ǆ日;?Σ\u0301<|>") + ["<|endoftext|>", "<|startoftext|>", "endoftext", "<|", "|>"]
    texts += ["".join(rng.choice(bits) for _ in range(60)) for _ in range(500)]
    chunked = packing.ChunkTokenizer(TOKENIZER, parts=50, chunks=60)
    for at in range(0, len(texts), 20):  # with a memory that forgets
        part = texts[at : at + 20]
        for t, g in zip(part, chunked(part), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert len(tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids) == 3


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        pos = np.array(sorted(rng.sample(range(1, 40), 12)) + [40])
        pos = np.array(sorted(set(pos.tolist()) | set(range(8, 40, 8))))
        cost = np.array([float(rng.randrange(6)) for _ in pos])
        rest = lambda r: r.astype(float) * 0.7
        cuts = packing.best_cuts(pos, cost, 10, rest)
        of = dict(zip(pos.tolist(), cost.tolist(), strict=True))

        def price(c):
            edges = [0, *c]
            return sum(10 - (b - a) + of[b] for a, b in zip(edges, c)) + 0.7 * (40 - edges[-1])

        best = {0: 0.0}
        for p in pos.tolist():
            best[p] = min((best[q] + 10 - (p - q) + of[p] for q in best if p - 10 <= q < p), default=math.inf)
        assert all(b - a <= 10 for a, b in zip([0, *cuts], cuts))
        assert price(cuts) == pytest.approx(min(v + 0.7 * (40 - p) for p, v in best.items() if 40 - p < 10))


def test_packing(spark, data, docs, tokenizer):
    special = [(400, "x <|endoftext|> y<|startoftext|>", None, None, None), (401, "<|endoftext|>" * 300, None, None, None)]
    rows = data + special
    docs = docs.unionByName(spark.createDataFrame(special, SCHEMA))
    got = packing.pack(clashing(docs), public_tokenizers.path("word_bpe_49k.json"), window=256).collect()
    text = {r[0]: r[1] for r in rows}
    ids, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
    assert set(ids) == set(text)
    for i, pieces in ids.items():
        pieces.sort(key=lambda r: r["start"])
        whole = tokenizer.encode(text[i] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == whole
        assert all(p["doc_tokens"] == len(whole) for p in pieces)
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
    padding = total = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        n = sum(p["length"] for p in pieces)
        assert n <= 256 and [p["offset"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
        padding += 0 if n & (n - 1) == 0 else 256 - n
        total += n
    assert padding < 0.05 * total
    assert packing.pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["[INST]", "[/INST] ", "</s>", "\\", "[", "<", "[SYS]", " [ANS] ", "text", "\n", "é", "[\\INST]", "<\\\\s>", "[ROLE] x [/ROLE]", "[/TURN]", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "we[/ROLE]ird", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (61, None, "user", "late"), (61, 0, "user", "early"), (62, 0, "user", "same"), (62, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df.withColumn("segments", F.lit(1)))
    got = {r["conv_id"]: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_texts(F.col("segments")).alias("learned")).collect()}
    expected = defaultdict(list)
    for c, t, role, text in rows:
        expected[c].append((t is None, t or 0, role or "", text or ""))
    assert set(got) == set(expected)
    for c, turns in expected.items():
        turns.sort()
        assert [(b["role"], b["text"]) for b in got[c]["back"]] == [x[2:] for x in turns]
        assert got[c]["learned"] == [x[3] for x in turns if x[2] == "assistant"]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_machine(spark):
    cases = {"sua": "answered", "ua": "answered", "uaua": "answered", "u": "asked", "s": "told", "a": "broken", "uu": "broken", "us": "broken", "uaa": "broken", "xu": "broken"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, t, names[x], "") for i, c in enumerate(cases) for t, x in enumerate(c)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: (r["state"], r["valid"]) for r in got.collect()} == {i: (s, s == "answered") for i, s in enumerate(cases.values())}


# toxicity


def test_toxicity(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    make = lambda bad: " ".join([rng.choice(vocab) for _ in range(40)] + (["scumbag"] * bad))
    toxic = [i % 8 == 0 for i in range(1600)]
    rows = [(i, make(t), "en", "a", 1) for i, t in enumerate(toxic)] + [(5000, None, None, None, None), (5001, "", "en", "a", 0)]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i % 3] + [(9, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(d, labels, toxicity.LEARN)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(clashing(d), model, ["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == t for i, t in enumerate(toxic)) > 0.98 * len(toxic)
    assert got[5000] < 0.5 and got[5001] < 0.5
    again = toxicity.train(d.repartition(5), labels.repartition(3), toxicity.LEARN)
    assert again == model
    assert toxicity.drop_toxic(d, labels).columns == d.columns
    nothing = toxicity.train(d, labels.where("toxic = 0"), toxicity.LEARN)
    assert {r["score"] for r in toxicity.scored(d, nothing, ["doc_id"]).collect()} == {0.0}
    assert toxicity.scored(empty(spark), toxicity.train(empty(spark), labels.limit(0), toxicity.LEARN), ["doc_id"]).count() == 0


def test_toxic_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda pos, unl, prior: seen.append((len(pos), len(unl), prior)) or toxicity.Model({}, -np.inf))
    d = spark.createDataFrame([(i % 12, "same" if i % 2 else f"text {i}", "en", "a", 1) for i in range(1200)] + [(None, "x", "en", "a", 1)] * 50, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] * 3 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    toxicity.train(d, labels, toxicity.LEARN, max_positives=7, max_unlabelled=9)
    toxicity.train(d, labels, toxicity.LEARN)
    learnable = [i for i in range(12) if zlib.crc32(str(i).encode()) % 5]
    assert seen[0][:2] == (7, 9) and seen[1][:2] == (100 * sum(i % 2 for i in learnable), 100 * len(learnable))
    assert seen[0][2] == pytest.approx(np.mean([i % 2 for i in learnable]))
    renamed = d.withColumnsRenamed({"doc_id": "n", "text": "body"}).withColumn("text", F.lit(1)).withColumn("score", F.lit("s"))
    kept = toxicity.drop_toxic(renamed, labels.withColumnRenamed("doc_id", "n"), id_col="n", text_col="body")
    assert kept.columns == renamed.columns and kept.count() == 1250


def test_non_negative_risk():
    """The risks and their slopes against the definition and differences; below 0 the step goes the other way."""
    rng = np.random.default_rng(3)
    loss = lambda z: math.log1p(math.exp(z))
    for low in (False, True):
        zp, zu, prior = rng.normal(1, 1, 7), rng.normal(-6 if low else 0, 0.5, 9), 0.4
        toxic = prior * sum(loss(-z) for z in zp) / 7
        clean = sum(loss(z) for z in zu) / 9 - prior * sum(loss(z) for z in zp) / 7
        assert toxicity.risks(zp, zu, prior) == pytest.approx((toxic, clean)) and (clean < 0) == low
        slopes = np.concatenate(toxicity.risk_slopes(zp, zu, prior))
        for i in range(16):
            z = [np.concatenate((zp, zu)) + d * np.eye(16)[i] for d in (1e-5, -1e-5)]
            above, below = (toxicity.risks(x[:7], x[7:], prior) for x in z)
            goal = lambda r: -r[1] if low else r[0] + r[1]
            assert slopes[i] == pytest.approx((goal(above) - goal(below)) / 2e-5, abs=1e-6)


# quality


def brute_measures(t):
    t = t or ""
    w = WORDS.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len({j for i, x in enumerate(windows) if c[x] > 1 for j in (i, i + 1, i + 2)})


def test_measures():
    rng = random.Random(8)
    texts = [None, "", " ", "a", "a b", "a\na\n\na\n \n \nb", "x y\x85z \x1c q", "a b c a b c a b", "||## a", "🎉 é🎉"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "\t", "|", "d\r"]) for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert quality.measures(t)[:5] == brute_measures(t), t


def test_exact_bound():
    for k, n, p in ((0, 50, 0.05), (3, 80, 0.1), (9, 10, 0.4)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    bound = quality.upper_bound(2, 100, 0.01)
    assert quality.binomial_tail(2, 100, bound) == pytest.approx(0.01, rel=1e-6)
    assert quality.upper_bound(0, 300, 0.05) == pytest.approx(1 - 0.05 ** (1 / 300))


def test_cutoffs_hold_the_risk():
    good, bad = np.zeros(41, int), np.zeros(41, int)
    good[0], good[10], bad[30] = 990, 10, 200
    cell = quality.select_cutoff(good, bad, 0.02, 0.01, 10.0)
    assert 10 <= cell < 30
    few = np.zeros(41, int)
    few[0] = 20
    assert quality.select_cutoff(few, bad, 0.02, 0.01, 10.0) == 40


def test_quality(spark):
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(2, 6) + rng.choice("klmnop") for _ in range(90))
    rows = [(i, clean() if i % 5 else re.sub(r" ", " %% ", clean()), ["en", None][i % 2], "a", 1) for i in range(2000)] + [(5000, None, None, None, None), (5001, "", "zz", "a", 0), (5002, clean(), "zz", "a", 1)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(2000)] + [(5002, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(clashing(spark.createDataFrame(rows, SCHEMA)), labels).collect()}
    assert len(got) == len(rows)
    ok = [i for i in range(2000) if not got[i]["base_failed"]]
    assert all(got[i]["kept"] for i in ok if i % 5) and not any(got[i]["kept"] for i in ok if i % 5 == 0)
    assert got[5000]["base_failed"] and got[5001]["base_failed"] and got[5002]["kept"]
    assert quality.judged(empty(spark), labels.limit(0)).count() == 0


# language


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(3, 3, rng)
    for f in ("wx", "u", "out", "bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    x, y = rng.integers(0, 256, (7, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, grads = langid.gradients(net, x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for _ in range(4):
            i = tuple(int(rng.integers(0, s)) for s in p.shape)
            if p is net.wx:
                i = (i[0], i[1], int(x[rng.integers(7), 0]))
            keep = p[i]
            p[i] = keep + 1e-3
            above = langid.gradients(net, x, y)[0]
            p[i] = keep - 1e-3
            below = langid.gradients(net, x, y)[0]
            p[i] = keep
            assert abs((above - below) / 2e-3 - g[i]) < 1e-4 + 0.02 * abs(g[i])


def test_langid(spark, monkeypatch):
    rng = random.Random(10)
    alphabets = {"aa": "abcdé", "bb": "vwxyz", "cc": "mnopß"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 60))), k, "a", 1) for i, k in enumerate(rng.choice(sorted(alphabets)) for _ in range(500))]
    rows += [(900, None, "aa", "a", 0), (901, "", "aa", "a", 0), (902, "12 34 !", "bb", "a", 0), (903, "abcdé abc " * 3000, None, "a", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    names, net = langid.train(d, F.col("doc_id") % 4 != 2)
    assert names == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.predicted(clashing(d), names, net).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i]["lang_pred"] == k for i, _, k, *_ in rows[:500] if i % 4 == 2]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    few = spark.createDataFrame([(i % 3, f"{'abc' if i % 2 else 'xyz'} {i}", "aa" if i % 2 else "bb", "a", 1) for i in range(600)] + [(None, "rare word", "zz", None, None)] * 30, SCHEMA)
    windows = []
    monkeypatch.setattr(langid, "fit", lambda w, y, k: windows.append(Counter(y.tolist())) or net)
    for most in (10, 1000):
        assert langid.train(few, F.lit(True), per_language=most)[0] == ["aa", "bb", "zz"]
    assert windows == [Counter({0: 10, 1: 10, 2: 10}), Counter({0: 300, 1: 300, 2: 30})]
    one, none = langid.train(d.where("lang = 'aa'"), F.lit(True)), langid.train(empty(spark), F.lit(True))
    assert {r["lang_pred"] for r in langid.predicted(d, *one).collect()} == {"aa", "und"}
    assert {r["lang_pred"] for r in langid.predicted(d, *none).collect()} == {"und"}
    assert langid.predicted(empty(spark), names, net).count() == 0


# language model


def test_lm(spark, data, docs):
    got = {r["doc_id"]: r for r in lm.lm_scores(clashing(docs), head=50).collect()}
    tokens = {r[0]: WORDS.findall(lower(r[1] or "")) + ["\n"] for r in data}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
        assert r["score"] < 0
    nonsense = spark.createDataFrame([(i, " ".join("qjxz" * 3 for _ in range(20)), "x", "s", 1) for i in range(3)], SCHEMA)
    both = {r["doc_id"]: r["bits_per_byte"] for r in lm.lm_scores(docs.unionByName(nonsense.withColumn("doc_id", F.col("doc_id") + 100_003))).collect()}
    assert min(both[100_003 + i] for i in range(3) if zlib.crc32(str(100_003 + i).encode()) % 7 == 2 or i == 0) > 0
    assert lm.lm_scores(empty(spark)).count() == 0


def lm_parts(streams, cuts=(), ranked=()):
    """The model of some streams by plain counting, as by its own functions: (code, two, pairs by context, inputs by token)."""
    tokens = sorted({t for s in streams for t in s})
    times = Counter(t for s in streams for t in s)
    shared = lm.prefixes(list(cuts))
    order = sorted(shared, key=lm.hash_of)
    keys, n, shared_keys, shared_n = lm.count_contexts(tokens, np.array([times[t] for t in tokens]), np.array([lm.hash_of(p) for p in order], np.uint64))
    code = lm.Code(np.bincount(keys & 0xFFFF, n, 1 << 16).reshape(256, 256))
    two = lm.table_of_two(n, keys, code)
    known = lm.Shared(np.array([lm.hash_of(p) for p in order], np.uint64), np.array([p[-1] if p else 32 for p in order], np.uint8), shared_keys, shared_n, code)
    inputs = {}
    for part in sorted({bisect_right(cuts, t) for t in tokens}):
        mine = [t for t in tokens if bisect_right(cuts, t) == part]
        found, weights, mass = lm.trie_inputs(mine, np.array([times[t] for t in mine]), code, two, known)
        inputs |= dict(zip(mine, found, strict=True))
        assert weights.shape == (lm.GATES, lm.INPUTS) and mass > 0
    return tokens, times, code, two, inputs


def path(code, before, sym):
    _, node, bit = code.bits(np.array([before]), np.array([sym]))
    return list(zip(node.tolist(), bit.tolist(), strict=True))


def log_odds(counts):
    return max(-lm.LIMIT, min(lm.LIMIT, round(lm.STEPS * math.log((counts[1] + lm.PRIOR) / (counts[0] + lm.PRIOR)))))


def test_trie_in_ranges_is_the_trie_of_all():
    rng = random.Random(7)
    streams = [[bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(60)] + [b"\n"] for _ in range(12)] + [[b"a" * 80, b"a" * 90]]
    cuts = [b"aab", b"abca", b"b", b"bb"]
    tokens, times, code, two, inputs = lm_parts(streams, cuts)
    for before in (32, 97):
        assert sum(2.0 ** -int(code.length[before * 256 + s]) for s in range(256)) == pytest.approx(1)
    cells, pairs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for t in tokens:
        x = lm.closed(t)
        for i, c in enumerate(x):
            for node, bit in path(code, x[i - 1] if i else 32, c):
                cells[x[:i], node][bit] += times[t]
                pairs[x[i - 2] if i > 1 else 32, node][bit] += times[t]
    for t in tokens:
        x = lm.closed(t)
        expected = [log_odds(cells[x[:i], node]) if i < lm.PREFIX else 0 for i, c in enumerate(x) for node, _ in path(code, x[i - 1] if i else 32, c)]
        signs = [2 * bit - 1 for i, c in enumerate(x) for _, bit in path(code, x[i - 1] if i else 32, c)]
        assert [v * s for v, s in zip(np.frombuffer(inputs[t], np.int8).tolist(), signs, strict=True)] == expected, t
    assert all(two[(o << 16) + node] == log_odds(n) for (o, node), n in pairs.items())


def test_mixing_is_that_of_one_bit_after_another():
    rng = random.Random(8)
    streams = [[bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(n)] + [b"\n"] for n in (150, 0, 3, 40)]
    tokens, times, code, two, inputs = lm_parts(streams)
    ranks = {t: i for i, (t, _) in enumerate(times.most_common(20))}
    counted = Counter()
    for s in streams:
        for before, t in zip([b"\n", *s], s):
            if before in ranks:
                counted[ranks[before] << 16 | lm.first_two(t)] += 1
    slots, odds, fitted, _ = lm.pair_cells(np.array(list(counted)), np.array(list(counted.values())), code, two, 20)
    table = np.zeros(1 << 20, np.int8)
    table[slots] = odds
    assert fitted.shape == (lm.GATES, lm.INPUTS)
    after = defaultdict(lambda: [0, 0])
    for s in streams:
        for before, t in zip([b"\n", *s], s):
            x = lm.closed(t)
            for i, c in enumerate(x[:2]):
                for node, bit in path(code, x[i - 1] if i else 32, c):
                    after[before, x[:i], node][bit] += 1
    start = np.random.default_rng(1).uniform(0.1, 0.6, (lm.GATES, lm.INPUTS))
    mixer = lm.Mixer(code, two, table, start)
    mixer.learn(tokens, [inputs[t] for t in tokens], [ranks.get(t, -1) for t in tokens])
    place = {t: i for i, t in enumerate(tokens)}
    numbers = [np.array([place[t] for t in s]) for s in streams]
    state = mixer.fresh(len(streams))
    got = mixer.score(numbers, [place[b"\n"]] * len(streams), state)
    for s, g in zip(streams, got, strict=True):
        w, errors, total, bits = start.copy(), np.zeros_like(start), 0.0, 0
        for before, t in zip([b"\n", *s], s):
            x, k = lm.closed(t), 0
            for i, c in enumerate(x):
                for node, bit in path(code, x[i - 1] if i else 32, c):
                    word = int(np.frombuffer(inputs[t], np.int8)[k]) * (2 * bit - 1)
                    k += 1
                    said = log_odds(after[before, x[:i], node]) if i < 2 and before in ranks else 0
                    gate = sum(abs(said or word) > e for e in lm.GATE_ENDS) + (lm.KNOWN - 1 if said else 0)
                    v = np.array([said, int(two[((x[i - 2] if i > 1 else 32) << 16) + node]), word]) / lm.STEPS
                    p = 1 / (1 + math.exp(-float(w[gate] @ v)))
                    total += math.log(p if bit else 1 - p)
                    errors[gate] += (bit - p) * v
                    bits += 1
                    if bits % lm.BLOCK == 0:
                        w += lm.RATE * errors
                        errors[:] = 0
        assert g == pytest.approx(total, rel=2e-3)
    # in two pieces, the second with the weights of the first: only where blocks end differs
    apart = mixer.fresh(1)
    cut = 75
    first = mixer.score([numbers[0][:cut]], [place[b"\n"]], apart)
    second = mixer.score([numbers[0][cut:]], [int(numbers[0][cut - 1])], apart)
    assert first[0] + second[0] == pytest.approx(got[0], rel=3e-3)


def test_lm_long_and_repeated(spark, data, monkeypatch):
    """Long texts in pieces and vocabularies in ranges give nearly what they give whole; repeated rows and null ids are scored each."""
    rows = data + data[:20] + [(None, "one two", None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = lm.lm_scores(docs, head=30, words_before=20).orderBy("doc_id", "n_tokens").collect()
    assert len(whole) == len(rows)
    by = defaultdict(set)
    for r in whole:
        by[r["doc_id"]].add((r["n_tokens"], round(r["score"], 6)))
    assert all(len(v) == 1 for v in by.values())
    cut = lm.range_cuts
    monkeypatch.setattr(lm, "range_cuts", lambda tokens, count: cut(tokens, count, 100))
    ranged = lm.lm_scores(docs, head=30, words_before=20).orderBy("doc_id", "n_tokens").collect()
    for a, b in zip(whole, ranged, strict=True):
        assert a["base_score"] == pytest.approx(b["base_score"])
    # starting weights are fitted range by range and differ a little
    assert sum(r["score"] for r in whole) == pytest.approx(sum(r["score"] for r in ranged), rel=0.03)
    nothing = lm.lm_scores(spark.createDataFrame([r for r in data if zlib.crc32(str(r[0]).encode()) % 7 == 2], SCHEMA)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["bits_per_byte"] > 1 for r in nothing)


# sharding


def test_flow_is_the_cheapest():
    import itertools

    rng = random.Random(2)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(3)]
        d = [0] * 3
        for _ in range(sum(s)):
            d[rng.randrange(3)] += 1
        c = np.array([[rng.randrange(5) for _ in range(3)] for _ in range(3)])
        f = sharding.min_cost_flow(s, d, c)
        assert list(f.sum(1)) == s and list(f.sum(0)) == d
        units = [i for i in range(3) for _ in range(s[i])]
        places = [j for j in range(3) for _ in range(d[j])]
        assert (f * c).sum() == min(sum(c[i, j] for i, j in zip(units, p)) for p in set(itertools.permutations(places)))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([1], [2], np.zeros((1, 1)))


def layout(spark, path):
    """What lies in a table, read without its own reader."""
    now = sharding.manifest(spark, path)
    return Counter((r["doc_id"], r["text"], f.shard) for f in now.files for r in spark.read.schema(now.schema).parquet(f"{path}/{f.name}").collect())


def check_shards(got, rows, shards):
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["__shard"]] += len((r["text"] or "").encode()) + 16
        slots[r["__shard"]].append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes


def test_sharding(spark, data, docs, tmp_path):
    repeated = data + data[:40] + data[:10] + [(None, "x", None, None, None)] * 30
    for n, (rows, df) in enumerate([(data, clashing(docs)), (repeated, spark.createDataFrame(repeated, SCHEMA).repartition(3))]):
        path = str(tmp_path / str(n))
        first = sharding.lay_out(df, "pmod(xxhash64(doc_id), 3)", 3, path, file_rows=9)
        assert len(first.files) > 6 and check_shards(sharding.read_shards(spark, path).collect(), rows, 3)
        rewritten = sharding.reshard(spark, path, 4)
        assert rewritten and set(rewritten) < {f.name for f in first.files}
        got = sharding.read_shards(spark, path)
        assert got.columns == [*df.columns, "__shard", "__slot"]
        sizes = check_shards(got.collect(), rows, 4)
        assert max(sizes.values()) - min(sizes.values()) < 200 + max(len((r[1] or "").encode()) for r in rows) * (max(sizes.values()) > sum(sizes.values()) / 3)
        assert layout(spark, path) == Counter((r["doc_id"], r["text"], r["__shard"]) for r in got.collect())
        stays = sum(f.bytes for f in sharding.manifest(spark, path).files if f.name in {x.name for x in first.files})
        assert stays > 0
    path = str(tmp_path / "none")
    sharding.lay_out(empty(spark), "pmod(xxhash64(doc_id), 3)", 3, path)
    assert sharding.reshard(spark, path, 4) == [] and sharding.read_shards(spark, path).count() == 0


def test_cut_files_are_near_equal():
    rng = np.random.default_rng(4)
    sizes = np.append(rng.integers(16, 400, 500), [9000, 4000])
    shares = {0: int(sizes.sum() * 0.3), 5: int(sizes.sum() * 0.6), 2: int(sizes.sum()) - int(sizes.sum() * 0.3) - int(sizes.sum() * 0.6)}
    to = sharding.deal(sizes, shares)
    assert all(abs(int(sizes[to == j].sum()) - n) < 50 for j, n in shares.items())


@pytest.mark.parametrize("step", ["_write", "_commit", "_tidy", "second write"])
def test_reshard_survives(spark, data, docs, tmp_path, monkeypatch, step):
    """Stopped before or after each of its steps, and run again, once or twice: no row is lost or there twice."""
    path = str(tmp_path / "t")
    sharding.lay_out(docs, "pmod(xxhash64(doc_id), 3)", 3, path, file_rows=9)
    name = "_write" if step == "second write" else step
    for when, shards in (("before", 6),) if step == "second write" else (("before", 4), ("after", 5)):
        calls = []
        real = getattr(sharding, name)

        def stop(*a, **k):
            calls.append(1)
            last = step != "second write" or len(calls) == 2
            if when == "before" and last:
                raise RuntimeError("lost")
            out = real(*a, **k)
            if last:
                raise RuntimeError("lost")
            return out

        with monkeypatch.context() as m:
            m.setattr(sharding, name, stop)
            with pytest.raises(RuntimeError):
                sharding.reshard(spark, path, shards)
        check_shards(sharding.read_shards(spark, path).collect(), data, 6)
        sharding.reshard(spark, path, shards)
        assert sharding.reshard(spark, path, shards) == []
        check_shards(sharding.read_shards(spark, path).collect(), data, shards)
        now = sharding.manifest(spark, path)
        assert now.shards == shards
        assert {str(x.relative_to(path)) for x in (tmp_path / "t").glob("files-*/*/*.parquet")} == {f.name for f in now.files}


# all operators: null ids, rows that repeat an id, rows alike throughout


def test_null_ids_and_repeated_rows(spark, data, tokenizer):
    alike = [(None, "one two three", "en", "a", 1)] * 3 + [(7, "another text of id seven", "de", None, 1), (None, None, None, None, None)]
    rows = data + data[:30] + alike
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(100)] + [(None, 1, 1), (5, None, None)] + [(3, 1, 0)] * 4, "doc_id long, quality int, toxic int")

    def same(found, key, values):
        """Rows alike have the same result, and there is one for each row."""
        got = found.collect()
        assert len(got) == len(rows)
        by = defaultdict(set)
        for r in got:
            by[key(r)].add(values(r))
        return by

    plan = same(mixing.mix_plan(docs), lambda r: (r["id"], r["key"], r["size"]), lambda r: r["copies"])
    assert all(len(v) == 1 for v in plan.values())
    assert mixing.mixed(docs).columns == docs.columns
    same(simhash.near_duplicates(docs), lambda r: (r["doc_id"], r["fp"]), lambda r: r["component_id"])
    model = toxicity.train(docs, labels, toxicity.LEARN)
    same(toxicity.scored(docs, model, ["doc_id", "text"]), lambda r: (r["doc_id"], r["text"]), lambda r: r["score"])
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    judged = same(quality.judged(docs, labels), lambda r: (r["doc_id"], r["n_words"], r["word_chars"]), lambda r: r["kept"])
    assert all(len(v) == 1 for v in judged.values())
    names, net = langid.train(docs, F.lit(True))
    assert names == ["de", "en"]
    same(langid.predicted(docs, names, net), lambda r: r["doc_id"], lambda r: r["lang_pred"])
    same(exact.exact_groups(docs), lambda r: r["doc_id"], lambda r: r["keep_id"])
    pieces = packing.pack(docs, TOKENIZER, window=256).collect()
    expected = Counter()
    for i, t, *_ in rows:
        expected[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    found = Counter()
    for r in pieces:
        found[r["doc_id"]] += r["length"]
    assert found == expected
    similar = simhash.drop_similar(docs)
    assert similar.columns == docs.columns and 0 < similar.count() < len(rows)


# queries and pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, sf).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
    k = sorted(a.columns)
    assert sorted(b.columns) == k
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    for col in k:
        assert (a[col] == b[col]).all(), col


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    before = None
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        before, kept = kept.count(), spark.createDataFrame(out.collect(), docs.schema)
        if name != "mixing":
            assert 0.5 * before < kept.count() <= before
    pieces = corpus_pipeline.STAGES[4][1](spark, kept, sf)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    # the stages against brute force on what they were given
    clean = corpus_pipeline.keep_clean(spark, docs, sf).collect()
    one = {r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, spark.createDataFrame(clean, docs.schema), sf).collect()}
    norm = defaultdict(list)
    for r in clean:
        norm[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    assert one == {min(v) for v in norm.values()}
