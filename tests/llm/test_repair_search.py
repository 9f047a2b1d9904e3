"""Conversation repair, ranked search and nearest vectors against brute force: nulls, ties, repeats, long and empty input."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swinglake.llm import knn, lexical, registry, repair

TURNS = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


# conversation repair


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub(r"[.!?]", "", text) if way == 2 else text
        out[conv] += [] if way == 0 else [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def cheapest(rows):
    """The least (cost, audit) over all edits, by a heap of whole paths; rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
        for role in ("user", "assistant"):
            if role[0] in FOLLOWS[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], [*kept, (role, "")]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in FOLLOWS[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], [*kept, (role, text)]))
                for new in ("user", "assistant"):
                    if new[0] in FOLLOWS[last]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, new[0], [*kept, (new, text)]))


def repaired(rows):
    out = set()
    for conv, turns in damage(rows).items():
        turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, marked = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        known = [t for t, *_ in turns if t is not None]
        faults = Counter(m[2] for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, text = cheapest(marked)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.add((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    texts = ["Yes.", "no", "Why?", "  ", "", None, "\x0b\x0c", "well. \n", "Ja!", "...", " ", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "umpire", "User"]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, i, "user", "Who?") for i in range(4)] + [(None, None, None, None)] * 3
    rows += [(70, None, "user", "Hm.")] * 3 + [(70, 2, "user", "Hm."), (71, None, "system", "Be."), (71, 5, "user", "Go?"), (71, 9, "user", "Go?")]
    rows += [(72, i, ("user", "assistant")[i % 2], f"{i % 90} long.") for i in range(700)]
    rows += [(73, 4, "assistant", "same turn."), (73, 4, "assistant", "same turn."), (73, 4, "user", "other.")]
    return rows


@pytest.mark.parametrize("block_rows,block_chars,ranges", [(1024, 1 << 20, 4), (1, 1 << 20, 2), (7, 40, 9)])
def test_repair(spark, turns, block_rows, block_chars, ranges):
    rows = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit(1) for c in ("key", "again", "gone", "part", "no", "fault")}).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in repair.repair(repair.damaged(rows), block_rows, block_chars).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(set(got)) and set(got) == repaired(turns)


def test_dropped_and_empty_conversations(spark):
    dropped = [(c, t, "user", "Hi.") for c in range(400) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert dropped
    got = {tuple(r) for r in repair.repair(repair.damaged(spark.createDataFrame(dropped, TURNS))).collect()}
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in dropped}
    assert repair.repair(repair.damaged(spark.createDataFrame([], TURNS))).collect() == []


def test_distances_are_shortest():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 7))]
        faults = [["", "blank", "duplicate", "truncated"].index(f) for *_, f in rows]
        assert repair.distances([r for r, *_ in rows], faults, repair.END)[0] == cheapest(rows)[0]


# ranked lexical search


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    texts = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    asked = defaultdict(list)
    for item, text in items:
        asked[item] += terms(text)
    out = []
    for item, words in asked.items():
        found = []
        for i, t in texts:
            if t:
                m, tf = 75 + 25 * len(t) * n // total, Counter(t)
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in words if tf[w])
                found += [(-score, i is None, i)] if score > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(8)
    vocab = [a + b for a in "abcdéßя漢Ĳ" for b in ("", "x", "Y", "1", "ñ", "İ")]
    text = lambda n: "".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))])[0] + rng.choice([" ", "-", "\n", ", ", " "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)] + [(400, None), (401, ""), (402, " ,.;\x00"), (403, text(9000)), (None, text(30)), (5, text(20))]
    docs += [(500 + i, docs[7][1]) for i in range(40)]
    items = [(i, text(rng.randint(1, 20))) for i in range(25)] + [(30, None), (31, "..."), (32, "nowhere"), (3, "ax bx"), (33, "a a a A")]
    return docs, items


@pytest.mark.parametrize("postings,block", [(lexical.SHARD_POSTINGS, lexical.BLOCK_TERMS), (1, 1 << 20), (200, 60)])
def test_lexical(spark, library, postings, block):
    docs, items = library
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "ids", "item_id", "score")}).repartition(3)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), 20, shard_postings=postings, block_terms=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == ranked(docs, items, 20)


def test_lexical_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, one).collect() == lexical.search(docs, items).collect() == []
    assert lexical.search(one.withColumnRenamed("item_id", "doc_id"), items).collect() == []


def test_nonessential_lists_are_only_probed(spark, library):
    """A shard finds the same documents at the threshold as without one, and reads fewer."""
    docs, items = library
    words = sorted({t for _, x in items for t in terms(x)})
    index = lexical.postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), [w.encode() for w in words], "doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    weights = np.array([1 + 37 * i % 900 for i in range(len(words))])
    shard = lexical.Shard(index, weights, 300, 9000)
    at = np.arange(min(12, len(words)))
    rows, scores = shard.search(at, np.ones(len(at), np.int64), 1)
    for threshold in np.quantile(scores, [0.3, 0.9, 1.0]).astype(int):
        r, s = shard.search(at, np.ones(len(at), np.int64), int(threshold))
        keep = scores >= threshold
        assert dict(zip(r, s, strict=True)) == dict(zip(rows[keep], scores[keep], strict=True))
    assert not len(shard.search(at, np.ones(len(at), np.int64), int(scores.max()) + 1)[0])


# nearest vectors


def nearest(rows, k, every):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(fine):
        if q is not None and q % every == 0:
            found = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(u, v, strict=False)))), i is None, i) for b, (i, v) in enumerate(fine) if a != b]
            out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] * (1 + i % 3) + 0.2 * rng.normal(size=6)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[10][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(10, rows[10][1]), (None, rows[10][1]), (600, None), (610, [None, 1.0]), (620, [float("nan")] * 6), (630, [float("inf")] + [0.0] * 5), (640, []), (650, [1.0, 2.0]), (660, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("pivots,group,part", [(None, knn.GROUP_QUERIES, knn.PART_ROWS), (40, 3, 50), (1, 2, 7)])
def test_knn(spark, vectors, pivots, group, part):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "uid", "v", "cell", "grp", "part")}).repartition(3)
    got = knn.top_k(frame, 5, 10, pivots=pivots, group_queries=group, part_rows=part).collect()
    assert sorted((tuple(r) for r in got), key=repr) == nearest(vectors, 5, 10)


def test_knn_prunes(spark, vectors):
    """Of vectors in clusters a group gets only some."""
    frame = spark.createDataFrame([r for r in vectors if r[0] is not None and r[0] < 400], "vec_id long, embedding array<double>")
    ready = knn.valid(frame, "vec_id", "embedding")
    centres = np.unique(np.array([r.v for r in ready.select("v").limit(40).collect()]), axis=0)
    found = knn.assigned(ready, centres, 6)
    asked = found.where("id % 10 = 0").groupBy("cell").agg(F.count(F.lit(1)), F.max("distance")).collect()
    cells = knn.Cells(centres, {c: (n, r) for c, n, r in asked}, 3)
    sent = knn.groups_of(found, cells, knn.thresholds(found, cells, 6, 5), 6).count()
    assert sent < 0.6 * 400 * len(cells.places)


def test_knn_large_empty_and_few(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [3e17, -1.0]), (10, [2e16, 1e16]), (3, [-9e15, 2.0]), (4, [1e-3, 1e300])]
    got = knn.top_k(spark.createDataFrame(rows, schema), 5, 10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == nearest(rows, 5, 10)
    assert knn.top_k(spark.createDataFrame([], schema), 5, 10).collect() == []
    assert knn.top_k(spark.createDataFrame([(1, [1.0])], schema), 5, 10).collect() == knn.top_k(spark.createDataFrame([(10, [1.0])], schema), 5, 10).collect() == []


@pytest.mark.parametrize("name", ["op11_repair", "op12_lexical", "op13_knn"])
def test_queries_against_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(duck.sql(registry.ORACLE_SQL[name]).select(*got.columns).fetchall(), key=repr)
