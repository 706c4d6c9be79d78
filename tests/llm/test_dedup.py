"""Substring dedup, the n-gram join and embedding dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lexweave.llm.common import Forest
from lexweave.llm.components import components
from lexweave.llm.embedding_dedup import embedding_dedup
from lexweave.llm.ngram_join import keep_one, least_matches, ngram_join
from lexweave.llm.substring_dedup import FMIndex, substring_dedup


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        rows.append([i, w])
    for i in range(60, 90):
        w = list(rows[i % 7 + 20][1])
        if w and i % 2:
            w[r.randrange(len(w))] = "changed"
        rows.append([i, w])
    rows += [[90, ["and"] * 300], [91, ["and"] * 45], [92, []], [93, ["one", "two"]], [94, ["one", "two"]]]
    r.shuffle(rows)
    return [(i, r.choice([" ", "\n", " \t"]).join(w)) for i, w in rows] + [(95, None), (96, ""), (None, " ".join(passage)), (20, dict((i, " ".join(w)) for i, w in rows)[20])]


def brute_substring(rows, window=20):
    places = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                places[key] = min(places.get(key, (i, p)), (i, p))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and places[tuple(w[p : p + window])] < (i, p):
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_dedup(spark, hot):
    rows = corpus(hot)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, key int")
    found = substring_dedup(docs, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute_substring(rows)
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in found)
    assert substring_dedup(docs.limit(0)).count() == 0


def test_matching_statistics():
    r = np.random.default_rng(3)
    t = np.concatenate([r.integers(1, 4, 300), [7], r.integers(1, 5, 100), [0]])
    ends = np.arange(9, 401)
    for most in (1, 6, 10):
        length, low, high = FMIndex(t, most).matching_statistics(t, ends, most)
        kinds = {}
        for e, n, a, b in zip(ends, length, low, high):
            times = lambda k, e=e: sum(tuple(t[q - k + 1 : q + 1]) == tuple(t[e - k + 1 : e + 1]) for q in range(k - 1, 401))
            want = next((k for k in range(most, 0, -1) if times(k) > 1), 0)
            assert n == want and b - a == (times(want) if want else 0)
            if n:
                kinds.setdefault(tuple(t[e - n + 1 : e + 1]), set()).add((a, b))
        assert all(len(x) == 1 for x in kinds.values())


def test_own_repeats_are_compared_by_their_words(monkeypatch):
    """Windows whose hashes are made equal are told apart."""
    from lexweave.llm import substring_dedup as s

    part = s._Part([b"a b c d a b c e a b", b"a b c d"], 3)
    assert part.own_first.tolist() == [True, True, True, True, False, True, True, True, False, False, True, True]
    monkeypatch.setattr(s, "gram_hashes", lambda words, k: np.zeros(len(words) - k + 1, dtype=np.uint64))
    assert s._Part([b"a b c d a b c e a b", b"a b c d"], 3).own_first.tolist() == part.own_first.tolist()


def test_substring_dedup_of_many_copies_and_a_hot_passage(spark, monkeypatch):
    """Small shards, hot minimizers and a large group of copies, with ids and texts that repeat."""
    from lexweave.llm import substring_dedup as s

    monkeypatch.setattr(s, "INDEX_WORDS", 64)
    r = random.Random(31)
    words = [f"w{i}" for i in range(90)]
    line = [r.choice(words) for _ in range(25)]
    rows = [(i, " ".join([r.choice(words) for _ in range(r.randint(0, 40))] + line * (i % 2) + [r.choice(words) for _ in range(30)])) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(150)] + [(7, rows[8][1]), (8, rows[7][1]), (None, rows[3][1])]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, starts string")
    found = substring_dedup(docs, hot=5).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in found), key=str) == brute_substring(rows)


def brute_join(rows):
    """Rows of one id are one document, with the text of the smallest MD5."""
    sets, texts = [], {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t)
    times = {i: len(x) for i, x in texts.items()}
    rows = [(i, min(x, key=lambda t: hashlib.md5((t or "").encode()).hexdigest())) for i, x in texts.items()]
    for i, t in rows:
        w = (t or "").encode().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    links, f = [0] * len(rows), Forest()
    for a in range(len(rows)):
        for b in range(len(rows)):
            (i, x), (j, y) = sets[a], sets[b]
            if a != b and i is not None and j is not None and x and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                f.union(i, j)
    return sorted((i, links[k], f.find(i)) for k, (i, _) in enumerate(sets) for _ in range(times[i]))


def test_ngram_join(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, rep string")
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in ngram_join(docs).collect()) == brute_join(rows)
    kept = sorted({r.doc_id for r in keep_one(docs).where("doc_id is not null").collect()})
    assert kept == sorted({c for _, _, c in brute_join(rows)})
    assert keep_one(docs).columns == docs.columns and keep_one(docs).where("doc_id is null").count() == 1
    assert ngram_join(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches(0.8, 1e-6)
    r = np.random.default_rng(1)
    for n, m in least.items():
        assert (r.binomial(n, 0.8, 100_000) < m).mean() < 1e-3 and m < 0.8 * n


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 4)]
    f = Forest()
    for a, b in edges:
        if a is not None and a != b:
            f.union(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    found = {(x.id, x.component) for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {(x, f.find(x)) for x in nodes}


def test_embedding_dedup(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(400, 16))
    near = base[r.integers(0, 30, 150)] + 0.08 * r.normal(size=(150, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:5]]).astype(np.float32))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (904, [None] * 16), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0] * 16), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, kept string")
    found = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup(docs, per_cell=32, margin=0.4).collect()), key=str)
    links, f = [0] * len(rows), Forest()
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows):
            if a == b or i is None or j is None or not x or not y or len(x) != len(y) or i in (901, 902, 903, 904) or j in (901, 902, 903, 904):
                continue
            x_, y_ = np.array(x), np.array(y)
            if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.9:
                links[a] += 1
                f.union(i, j)
    expected = sorted(((i, links[k], None if i is None else f.find(i), i is None or f.find(i) == i) for k, (i, _) in enumerate(rows)), key=str)
    assert found == expected
    assert embedding_dedup(docs.limit(0)).count() == 0


def test_embedding_dedup_at_its_own_margin(spark, monkeypatch):
    """Many cells in 64 dimensions, and blocks that are crossed: every link found is right, and 99 in 100 are found."""
    from lexweave.llm import embedding_dedup as e

    monkeypatch.setattr(e, "RESIDENTS", 40)
    monkeypatch.setattr(e, "COLUMNS", 90)
    monkeypatch.setattr(e, "HELD", 3000)
    r = np.random.default_rng(14)
    base = r.normal(size=(2500, 64))
    pairs = base[r.integers(0, 600, 700)] + r.uniform(0.2, 0.5, size=(700, 1)) * r.normal(size=(700, 64))
    group = base[700] + 0.2 * r.normal(size=(300, 64))
    x = np.concatenate([base, pairs, group, np.repeat(base[701:702], 60, axis=0)]).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {f.vec_id: f for f in e.embedding_dedup(docs, per_cell=32).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    got = np.array([found[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 50_000
    f = Forest()
    for a, b in zip(*np.nonzero(np.triu(linked))):
        f.union(int(a), int(b))
    assert np.mean([found[i].component_id == f.find(i) for i in range(len(x))]) > 0.99
    assert all(found[i].kept == (found[i].component_id == i) for i in range(len(x)))


@pytest.mark.parametrize("width", [16, 64])
def test_embedding_dedup_finds_isolated_pairs_at_the_boundary(spark, width):
    """Pairs of a cosine just over 0.9, each alone, among many cells."""
    r = np.random.default_rng(width)
    n = 1500
    x = r.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=(n, width))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = r.uniform(0.9005, 0.93, size=(n, 1))
    every = np.concatenate([x, c * x + np.sqrt(1 - c * c) * away])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id bigint, embedding array<double>")
    found = {f.vec_id: f for f in embedding_dedup(docs, per_cell=32).collect()}
    assert np.mean([found[n + i].component_id == found[i].component_id for i in range(n)]) >= 0.99
    linked = (every @ every.T / np.outer(np.linalg.norm(every, axis=1), np.linalg.norm(every, axis=1)) >= 0.9).sum(axis=1) - 1
    got = np.array([found[i].n_links for i in range(2 * n)])
    assert (got <= linked).all() and got.sum() >= 0.99 * linked.sum()


def test_ngram_join_over_blocks_and_large_buckets(spark, monkeypatch):
    from lexweave.llm import ngram_join as n

    monkeypatch.setattr(n, "BLOCK", 16)
    monkeypatch.setattr(n, "LARGE_BUCKET", 20)
    r = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(80)] for _ in range(4)]
    rows = []
    for i in range(200):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(300 + i, rows[i][1]) for i in range(30)] + [(400 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((x.doc_id, x.n_links, x.class_id) for x in ngram_join(docs).collect()) == brute_join(rows)


def test_keep_one_judges_each_text_of_an_id(spark):
    from hashlib import md5

    r = random.Random(12)
    texts = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(4)]
    near = [t + " more" for t in texts]
    low, high = sorted(texts[2:], key=lambda t: md5(t.encode()).hexdigest())
    rows = [(1, texts[0]), (2, near[0]), (2, texts[1]), (3, near[1]), (5, low), (5, high), (6, low + " more"), (7, high + " more"), (9, "x " + low), (9, "x " + low + " y"), (8, None), (8, ""), (None, low)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id int, text string, n int")
    left = keep_one(docs.unionByName(docs.where("doc_id = 5")))
    assert left.columns == docs.columns
    # Of 2 the near copy of 1 goes and the other text stays; 3, 6, 7 and both of 9 are near copies of what stays.
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == sorted([(1, texts[0]), (2, texts[1]), (5, low), (5, high), (8, ""), (8, ""), (0, low)])
