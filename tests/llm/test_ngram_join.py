"""The n-gram join against a comparison of all pairs."""

from __future__ import annotations

import random

import pytest

from vulnspark.llm import ngram_join as J


def brute(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 75 * len(sets[i] | sets[k]):
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "one two three four", "a b c d e", "A b c d e\n"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 120]))]
        chain = base
        for _ in range(8):
            texts.append(" ".join(edited(rng, base, rng.randint(0, 4))))
            chain = edited(rng, chain, 1)
            texts.append(" ".join(chain))
        texts.append(" ".join(base[:40] + passage))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_components(df).collect()}
    assert got == brute(texts)


def test_hot_group_without_leaders(spark, monkeypatch):
    """Without leader rounds the counting step alone finds every component."""
    monkeypatch.setattr(J, "LEADER_ROUNDS", 0)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 3))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_components(df).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("rounds", [0, 2])
def test_truncated_copies_of_many_lengths(spark, monkeypatch, rounds):
    """The tokens of a pair of different sizes are found from either side; they count together."""
    monkeypatch.setattr(J, "LEADER_ROUNDS", rounds)
    rng = random.Random(5)
    texts = []
    for size in range(60, 360, 6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        cut = int(size * rng.uniform(0.76, 0.88))
        texts.append(" ".join(base))
        texts.append(" ".join(base[:cut]))
        own = rng.randint(0, size - cut)  # the rest of the tail stands in a third document too
        texts.append(" ".join(base[cut + own - 5 :] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 10))]))
        if rng.random() < 0.5:
            texts.append(" ".join(base[: size // 2]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_components(df).collect()}
    assert got == brute(texts)


def test_long_chain_of_components(spark, folder):
    from vulnspark.llm.common import Store

    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").filter("a % 100 <> 99")
    roots = J.components(edges, Store(spark)).collect()
    by_group = {}
    for r in roots:
        by_group.setdefault(r.node // 100, set()).add(r.root)
    assert all(len(x) == 1 for x in by_group.values()) and len(by_group) == 3 and len(roots) == 300


def test_empty_and_null_ids(spark):
    assert J.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b"), (2, "a b"), (5, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, J.similar_components(df).collect()), key=str) == [(2, 1, 2), (5, 1, 2), (None, 1, None)]
