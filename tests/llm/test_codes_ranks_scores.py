"""Vector codes, ranked search and the language model against plain versions, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import maxent_lm, ranked_search, vector_codes
from lexweave.llm.common import cut

# Vector codes


def plain_nearest(x, entries):
    d = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2).astype(np.int64)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


@pytest.mark.parametrize(("width", "scale"), [(16, 300), (16, 2), (1, 5), (3, 40), (7, 10**6), (16, 0)])
def test_nearest_equals_all_distances(width, scale):
    r = np.random.default_rng(width)
    entries = r.integers(-scale, scale + 1, (60, width))
    entries[30:40] = entries[10:20]  # ties
    x = np.concatenate([r.integers(-scale, scale + 1, (700, width)), entries, entries + 1])
    code, distance = vector_codes.Codebook(entries).nearest(x)
    expected = plain_nearest(x, entries)
    assert (code == expected[0]).all() and (distance == expected[1]).all()


def test_bounds_filter_entries(monkeypatch):
    r = np.random.default_rng(3)
    entries = r.integers(-1000, 1000, (256, 16)) + np.repeat(r.integers(-3000, 3000, (32, 1)), 8, axis=0)
    book, exact = vector_codes.Codebook(entries), []
    own = book._exact
    monkeypatch.setattr(book, "_exact", lambda x, row, entry: exact.append(len(row)) or own(x, row, entry))
    book.nearest(entries[:128] + r.integers(-5, 6, (128, 16)))
    assert sum(exact) < 0.1 * 128 * 256


def plain_codes(rows, parts, entries, rounds):
    """Codes of (id, vector, label) rows that are all in order."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in rows])
    codes, errors, books = [], 0, []
    for part in np.split(x, parts, axis=1):
        book = part[:entries].copy()
        for _ in range(rounds):
            code = plain_nearest(part, book)[0]
            for e in set(code):
                book[e] = part[code == e].sum(axis=0) // (code == e).sum()
        code, d = plain_nearest(part, book)
        codes.append(code)
        errors = errors + d
        books.append(book)
    label = Counter()
    for r, e in zip(rows, errors):
        label[r[2]] += int(e)
    return Counter((r[0], tuple(int(c[i]) for c in codes), int(errors[i]), label[r[2]]) for i, r in enumerate(rows)), books


def test_vector_codes(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], r.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [rows[5], rows[5], (None, rows[7][1], 3), (7, rows[9][1], None), (400, [0.0] * 8, 2), (401, [0.0] * 8, 2)]
    odd = [(500, None, 1), (501, [1.0] * 7 + [None], 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, 1), (504, [1.0] * 4, 1), (505, [], None), (506, [1.0] * 7, 9), (507, [1e30] + [0.0] * 7, 9)]
    vectors = spark.createDataFrame([(*x, "own", -1) for x in rows + odd], "vec_id bigint, embedding array<double>, label int, codes string, error int").repartition(5)
    found, books = vector_codes.vector_codes(vectors, parts=2, entries=16, rounds=4)
    expected, plain = plain_codes(rows, 2, 16, 4)
    assert Counter((x.vec_id, tuple(x.codes), x.error, x.label_error) for x in found.collect()) == expected
    assert all((a == b).all() for a, b in zip(books, plain))
    shown = found.select(vector_codes.hexadecimal(F.col("codes")).alias("c"), "codes").first()
    assert shown.c == "".join(f"{c:02x}" for c in shown.codes)


def test_vector_codes_of_few_and_none(spark):
    kind = "vec_id bigint, embedding array<float>, label string"
    none, books = vector_codes.vector_codes(spark.createDataFrame([(1, None, "a")], kind))
    assert none.collect() == [] and books == []
    few, books = vector_codes.vector_codes(spark.createDataFrame([(2, [1.0, 2.0, 3.0, -4.0], "a")] * 3 + [(1, [0.0, 2.0, 3.0, 1.0], None)], kind))
    assert {(x.vec_id, tuple(x.codes), x.error, x.label_error) for x in few.collect()} == {(1, (0, 0, 0, 0), 0, 0), (2, (1, 0, 0, 1), 0, 0)}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(few, entries=300)


# Ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(items, docs, k):
    split = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df, counts = Counter(), []
    for d, t in split:
        counts.append((d, Counter(t), len(t)))
        df.update(set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(i, rank, x[2], x[3]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(found):
    return sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in found.collect()), key=str)


def documents(r, n):
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "ñandú", "É", "straße", "日本", "x_y", "İ"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(r.choices(words, weights, k=r.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranked_search, "TERMS_PER_PASS", 40)
        monkeypatch.setattr(ranked_search, "FIRST_READ", 2)
    r = random.Random(4)
    docs = documents(r, 400)
    docs += [(1000 + i, "w3 w5 w50 w50") for i in range(80)] + [(3, "w3 w50"), (3, "w3 w50"), (None, "w3 w5 w50 w50"), (None, None), (2000, None), (2001, ""), (2002, "--- !"), (2003, "w1 " * 20000)]
    items = [(i, t) for i, t in documents(r, 30) if t] + [(100, "w50 w3 W3"), (100, "w5"), (101, None), (102, "nowhere"), (None, "w50"), (None, "w7 日本")]
    d = spark.createDataFrame([(*x, "own", 1, 2) for x in docs], "doc_id bigint, text string, score string, rank int, item_id int").repartition(6)
    q = spark.createDataFrame([(*x, 5) for x in items], "item_id int, text string, doc_id int")
    assert searched(ranked_search.lexical_search(q, d, 7)) == plain_search(items, docs, 7)


def test_lexical_search_with_words_for_ids_and_empty_tables(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "doc_id string, text string")
    q = spark.createDataFrame([("x", "one")], "item_id string, text string")
    assert [(x.doc_id, x["rank"]) for x in ranked_search.lexical_search(q, d).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert ranked_search.lexical_search(q.limit(0), d).collect() == [] == ranked_search.lexical_search(q, d.limit(0)).collect()


def test_reading_stops_at_the_threshold():
    """Each turn reads the lists further; what is not read is not scored, and shards in a row give the same as one."""
    r = np.random.default_rng(5)
    n, n_terms = 3000, 6
    impacts = (r.pareto(1.5, n * n_terms) * 1000).astype(np.int64) + 1
    terms, weights = np.tile(np.arange(n_terms), n), np.array([5, 3, 2, 1, 0, 0], np.int64)
    shard = ranked_search.Shard(np.arange(1, n + 1) * n_terms, terms, impacts, n_terms, np.arange(n))
    looked = []
    own = shard.score
    shard.score = lambda docs, w: looked.append(len(docs)) or own(docs, w)
    docs, scores = shard.top(np.arange(4), weights, 5, 1)
    every = (impacts.reshape(n, n_terms) * weights).sum(axis=1)
    order = np.lexsort((np.arange(n), -every))[:5]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert sum(looked) < n // 4
    assert len(shard.top(np.arange(4), weights, 5, int(every.max()) * 10)[0]) <= 5


# The language model


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def corpus(r, n):
    """Two languages whose words follow their own."""
    words = {x: [x * 2 + str(i) for i in range(40)] + [f"{x}{i}{x}" for i in range(2000)] for x in "ab"}
    out = []
    for i in range(n):
        own = words[r.choice("ab")]
        out.append((i, " ".join(r.choice(own[:40]) if r.random() < 0.7 else r.choice(own) for _ in range(r.randint(1, 120)))))
    return out


def blocks_of(docs):
    rows = docs.select(F.col("doc_id").alias("id"), "text", (~(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1)).alias("train"))
    encoded = cut(maxent_lm.encoded_blocks(rows, "id", "text"))
    words = maxent_lm.word_rows(encoded)
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")))
    leaves = maxent_lm.Leaves(counts)
    return cut(maxent_lm.counted_blocks(encoded, words, counts, leaves)), leaves


def leaf_of(word, leaves):
    raw = np.frombuffer(word, np.uint8)
    return int(maxent_lm.leaf_of(pa.array([word], pa.large_binary()), raw, np.array([0, len(word)]), leaves.common)[0])


def test_lm_scores_against_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", 3000)
    rows = corpus(random.Random(6), 150)
    rows += [(3, rows[3][1]), (None, "aa1 aa2"), (901, None), (902, ""), (903, " \t\n\x0b\x0c\r "), (904, "AA1 É é İ \x85 aa1\x1caa2 　 x"), (905, "bb1 " * 5000)]
    docs = spark.createDataFrame([(*x, 1.5, "own") for x in rows], "doc_id bigint, text string, score double, train string").repartition(4, "doc_id")
    steps = (0.5, 0.5)
    found = maxent_lm.lm_scores(docs, steps=steps).collect()
    assert Counter(x.doc_id for x in found) == Counter(i for i, _ in rows)

    # Counts and the base, by the definition.
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    total, v = sum(c.values()), len(c)
    plain = {(i, len(split(t)), sum(w in c for w in split(t)), round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in split(t)), 6)) for i, t in rows}
    assert {(x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in found} == plain
    assert {(x.doc_id, x.held_out, x.train_tokens) for x in found} == {(i, held(i), total) for i, _ in rows}

    # The model, one token after another.
    blocks, leaves = blocks_of(docs)
    assert leaves.common == [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: maxent_lm.COMMON]]
    leaf = {w: leaf_of(w, leaves) for _, t in rows for w in split(t)}
    groups = maxent_lm.leaf_groups(blocks)
    assert Counter(groups.tolist()) == dict.fromkeys(range(maxent_lm.GROUPS), maxent_lm.IN_GROUP)
    members = [[x for x in range(maxent_lm.LEAVES) if groups[x] == g] for g in range(maxent_lm.GROUPS)]
    share = {x: 0.5 for x in range(maxent_lm.LEAVES)}
    for w, n in c.items():
        share[leaf[w]] += n
    group_share = [sum(share[x] for x in m) / sum(share.values()) for m in members]

    def walk(only_training):
        for i, t in rows:
            if not (only_training and held(i)):
                words = split(t)
                hashes = np.array([hash_of(w) for w in words], np.uint32)
                yield i, words, [r.tolist() for r in maxent_lm.features(np.arange(len(words)), np.array([len(words)]), hashes)]

    def hash_of(w):
        x = maxent_lm.word_hashes(w, np.array([0]), np.array([len(w)])) if w else maxent_lm.mix64(np.array([1], np.uint64))
        return int(x[0] >> np.uint64(32))

    first, second = {}, {}

    def chances(rows_of, g):
        outer = [math.log(group_share[x]) + sum(first.get((r, x), 0) for r in rows_of) for x in range(maxent_lm.GROUPS)]
        inner = [math.log(share[x] / sum(share[y] for y in members[g])) + sum(second.get((k, r // 16, x), 0) for k, r in enumerate(rows_of)) for x in members[g]]
        soft = lambda s: [math.exp(y - max(s)) / sum(math.exp(z - max(s)) for z in s) for y in s]
        return soft(outer), soft(inner)

    for step in steps:
        seen, want = (Counter(), Counter()), (Counter(), Counter())
        for _, words, feats in walk(True):
            for at, w in enumerate(words):
                rows_of = [f[at] for f in feats]
                g = int(groups[leaf[w]])
                outer, inner = chances(rows_of, g)
                for k, r in enumerate(rows_of):
                    seen[0][r, g] += 1
                    seen[1][k, r // 16, leaf[w]] += 1
                    for x, p in enumerate(outer):
                        want[0][r, x] += p
                    for x, p in zip(members[g], inner):
                        want[1][k, r // 16, x] += p
        for table, o, e, prior in ((first, seen[0], want[0], lambda x: group_share[x]), (second, seen[1], want[1], lambda x: share[x] / sum(share[y] for y in members[groups[x]]))):
            for key in e:
                q = maxent_lm.PRIOR * prior(key[-1])
                table[key] = table.get(key, 0) + step * math.log((o[key] + q) / (e[key] + q))
    scores = []
    for i, words, feats in walk(False):
        score = 0
        for at, w in enumerate(words):
            g = int(groups[leaf[w]])
            outer, inner = chances([f[at] for f in feats], g)
            score += math.log10(outer[g] * inner[members[g].index(leaf[w])]) + float(leaves.inner(np.array([c[w]]), np.array([leaf[w]]))[0])
        scores.append((i, score))
    by_id = {x.doc_id: x.score for x in found}
    assert all(abs(by_id[i] - s) < 1e-4 * max(1, abs(s)) for i, s in scores)

    # Within a leaf the training words and what is unseen share all of its probability.
    for x in {leaf[w] for w in c}:
        own = np.array([c[w] for w in c if leaf[w] == x] + [0] * (x >= maxent_lm.COMMON))
        assert abs((10 ** leaves.inner(own, np.full(len(own), x))).sum() - 1) < 1e-9


def test_lm_learns_from_words_before(spark):
    docs = spark.createDataFrame(corpus(random.Random(7), 1500), "doc_id bigint, text string")
    mean = lambda steps: maxent_lm.lm_scores(docs, steps=steps).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    before, base = mean(())
    after, _ = mean(maxent_lm.STEPS)
    assert after > before + 0.15 and after > base + 0.15  # the words before tell the language, which is worth log10(2) = 0.3 at most


def test_lm_of_nothing(spark):
    kind = "doc_id bigint, text string"
    assert maxent_lm.lm_scores(spark.createDataFrame([], kind)).collect() == []
    only = next(i for i in range(100) if held(i))
    (x,) = maxent_lm.lm_scores(spark.createDataFrame([(only, "a b")], kind)).collect()
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) == (True, 3, 0, 0, 0.0, 0.0)
