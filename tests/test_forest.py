"""The forest's vocabulary against plain counts, and its splits against all thresholds of a node."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vulnspark.operators import classifier, forest, vocabulary
from vulnspark.session import materialize_alone, work_folder
from vulnspark.taxonomy import NUM_LABELS


def saver(spark):
    folder = work_folder(spark)
    return lambda df, name: materialize_alone(df, folder, name)


def made_texts(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyzé") + rnd.choice(["", "x", "yy"])
    return [" ".join(word() for _ in range(int(rnd.paretovariate(1) * 5) - 5)) for _ in range(n)]


def plain_terms(texts: list[str], most: int, min_df: int) -> list[tuple[str, int, int]]:
    tf, df = Counter(), Counter()
    for words in map(str.split, texts):
        grams = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        tf.update(grams)
        df.update(set(grams))
    return sorted(((t, n, df[t]) for t, n in tf.items() if df[t] >= min_df), key=lambda r: (-r[1], r[0]))[:most]


@pytest.mark.parametrize(("most", "min_df"), [(0, 2), (40, 2), (900, 2), (100_000, 1), (60, 30)])
def test_frequent_terms_equal_plain_counts(spark, monkeypatch, most, min_df):
    monkeypatch.setattr(vocabulary, "COUNTED_BYTES", 2_000)
    texts = made_texts(300)
    df = spark.createDataFrame([(t,) for t in texts], "joined string").repartition(3)
    assert vocabulary.frequent_terms(df, most, min_df, saver(spark)) == plain_terms(texts, most, min_df)


def test_pieces_of_a_batch_lose_no_token():
    texts = ["", *made_texts(50, 5), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["joined"])
    for most in (1, 300, 1 << 20):
        found = []
        for piece in vocabulary.gathered(iter([batch, batch.slice(7, 5)]), most):
            words, token, row = vocabulary._tokens(piece.column("joined"))
            found += words.take(pa.array(token)).to_pylist()
            assert list(np.bincount(row, minlength=piece.num_rows)) == [len(t.split()) for t in piece.column("joined").to_pylist()]
        assert found == " ".join([*texts, *texts[7:12]]).split()


def test_a_vocabulary_finds_its_terms():
    texts = [*made_texts(100, 2), "", "zz unknown zz"]
    terms = [t for t, _, _ in plain_terms(texts[:60], 500, 1)]
    known = vocabulary.Vocabulary(terms)
    got = {(r, terms[t]): n for r, t, n in zip(*map(np.ndarray.tolist, known.counts(pa.array(texts))), strict=True)}
    want = {}
    for i, words in enumerate(map(str.split, texts)):
        grams = Counter(" ".join(words[j : j + k]) for k in (1, 2, 3) for j in range(len(words) - k + 1))
        want |= {(i, t): n for t, n in grams.items() if t in set(terms)}
    assert got == want and len(known.counts(pa.array([], pa.string()))[0]) == 0


def test_the_forest_sees_every_term(spark):
    """Over 2,000 terms in two records each: none is left out before the trees grow."""
    rows = [(" ".join(f"{c}{'x' * (i // 26)}{chr(97 + i % 26)}" for i in range(400)), ord(c) % 2) for c in "aabbccdd"]
    model = classifier.train_forest(spark.createDataFrame(rows, "code string, y_true int"), trees=2, max_depth=2)
    assert len(model.terms) == len(plain_terms([t for t, _ in rows], 10**6, 2)) > 4_000


def gini_gain(left: np.ndarray, right: np.ndarray) -> float:
    impurity = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    whole = left + right
    return impurity(whole) - (left.sum() * impurity(left) + right.sum() * impurity(right)) / whole.sum()


def test_every_split_is_the_best_of_its_hand(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 16)
    for name in ("SHARD", "SCORED", "HELD"):
        monkeypatch.setattr(forest, name, 50)
    texts, n_trees, depth, seed = made_texts(90, 3), 4, 4, 7
    labels = [len(t) * 5 % 3 for t in texts]
    terms = [t for t, _, _ in plain_terms(texts, 120, 2)]
    known, idf = vocabulary.Vocabulary(terms), np.linspace(1, 2, len(terms))
    shared = spark.sparkContext.broadcast((known, idf))
    df = spark.createDataFrame(list(zip(labels, texts, strict=True)), "label int, joined string").repartition(3)
    data = saver(spark)(forest.blocks(df, shared), "blocks")
    trees, weight = forest.grow(data, len(terms), n_trees, depth, seed, saver(spark))
    sizes = np.bincount(labels, minlength=NUM_LABELS)
    assert np.allclose(weight, [90 / (3 * n) if n else 0 for n in sizes])

    steps, label, drawn = [], [], []
    for b in data.collect():
        size = np.frombuffer(b.size, np.int32)
        dense = np.zeros((len(size), len(terms)), np.int64)
        dense[np.repeat(np.arange(len(size)), size), np.frombuffer(b.term, np.int32)] = np.frombuffer(b.step, np.uint8)
        steps.append(dense)
        label.append(np.frombuffer(b.label, np.uint8))
        drawn.append(forest._drawn(seed, b.block, n_trees, len(size)))
    steps, label, drawn = np.concatenate(steps), np.concatenate(label), np.concatenate(drawn, 1)
    assert len(steps) == 90 and (steps > 0).sum() == len(known.counts(pa.array(texts))[0])

    inner = 0
    members = {tree: np.arange(90) for tree in range(n_trees)}
    tree_of = {tree: tree for tree in range(n_trees)}
    first = 0
    for level in range(depth + 1):
        nodes = sorted(members)
        _, _, term_at, hands = forest._dealt(seed, level, len(terms))
        hand = np.random.default_rng([seed, level, 2]).integers(0, hands, len(nodes), np.int32)
        below = {}
        for node in nodes:
            at, times = members[node], drawn[tree_of[node], members[node]]
            of = lambda own: np.bincount(label[at[own]], times[own], NUM_LABELS)  # noqa: E731, B023
            assert (of(np.ones(len(at), bool)) == trees.counts[node]).all()
            best = -1.0
            for t in term_at[hand[node - first]] if level < depth else ():
                for s in np.unique(steps[at, t])[1:]:
                    high = steps[at, t] >= s
                    if times[high].sum() and times[~high].sum():
                        best = max(best, gini_gain(of(~high) * weight, of(high) * weight))
            if trees.child[node] == node:
                assert best < 1e-9 or (trees.counts[node] > 0).sum() == 1
                continue
            high = steps[at, trees.term[node]] > trees.limit[node]
            assert abs(gini_gain(of(~high) * weight, of(high) * weight) - best) < 1e-9 and trees.term[node] in term_at[hand[node - first]]
            inner += 1
            for child, own in ((trees.child[node], ~high), (trees.child[node] + 1, high)):
                below[int(child)] = at[own]
                tree_of[int(child)] = tree_of[node]
        first, members = first + len(nodes), below
        assert level < depth or not below
    assert inner > 20
    shares = classifier.Forest(terms, idf, trees, weight, n_trees, depth).shares()
    votes = forest.votes(trees, shares, n_trees, depth, pa.array(texts), known, idf)
    assert np.allclose(votes.sum(1), n_trees) and (votes.argmax(1) == labels).mean() > 0.5
