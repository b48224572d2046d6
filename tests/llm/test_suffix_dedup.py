"""Suffix arrays and byte removal against brute force."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vulnspark.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\0", bytes(range(256))])
def test_suffix_order_and_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for n in [1, 2, 7, 8, 9, 30, 200]:
        data = bytes(rng.choice(alphabet) for _ in range(n))
        order, heads = S.suffix_array(np.frombuffer(data, np.uint8))
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        cuts = sorted(rng.sample(range(n + 1), min(3, n + 1)))
        first, last = np.array([0, *cuts]), np.array([*cuts, n])
        shared = S.common_prefixes(order, heads, first, last, 20)
        for k in range(n):
            a, b = data[order[k] :], data[order[k - 1] :] if k else b""
            want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert shared[k] == min(want, 20)


def test_order_of_more_suffixes_than_one_number_holds():
    data = np.random.default_rng(1).integers(0, 3, (1 << 21) + 9, np.uint8)
    order, _ = S.suffix_array(data)
    assert np.array_equal(np.sort(order), np.arange(len(data)))
    whole = data.tobytes()
    for a, b in zip(order[:-1:97].tolist(), order[1::97].tolist(), strict=True):
        assert whole[a : a + 200] < whole[b : b + 200]


def test_marks_without_two_kinds_of_segments_are_not_sorted(monkeypatch):
    real, sorted_ = S.repeated_windows, []
    monkeypatch.setattr(S, "repeated_windows", lambda bodies, length: sorted_.extend(bodies) or real(bodies, length))
    rows = [  # mark, parts, part, d1, d2, copies, body
        (1, 1, 0, 1, 1, 3, b"alone, copied"), (2, 1, 0, 2, 2, 1, b"alone, once"),
        (3, 1, 0, 3, 3, 2, b"both copied"), (3, 1, 0, 4, 4, 5, b"both copied too"),
        (4, 1, 0, 5, 5, 2, b"shared"), (4, 1, 0, 6, 6, 1, b"is shared"), (5, 2, 1, 7, 7, 4, b"a part"),
    ]
    names = ["mark", "parts", "part", "d1", "d2", "copies", "body"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in some]) for some in (rows[:3], rows[3:])]
    out = [r for b in S._sort_shards(6, 1 << 20)(iter(batches)) for r in b.to_pylist()]
    assert sorted_ == [b"shared", b"is shared", b"a part"]
    want = {1: [0, 7], 3: [0, 5], 4: [0, 9], 5: [0, 0], 6: [3, 3], 7: [0, 0]}
    assert {r["d1"]: r["runs"] for r in out if r["runs"] is not None} == want


def _split_marks(marks, segments, parts):
    """Parts of split marks: different segments of 359 bytes around a passage of 40."""
    rng = np.random.default_rng(marks)
    names = ["mark", "parts", "part", "d1", "d2", "copies", "body"]
    word = lambda n: rng.integers(97, 110, n, np.uint8).tobytes()
    for m in range(marks):
        passage = word(40)
        rows = [(m, parts, m % parts, m, k, 1, word(159) + passage + word(160)) for k in range(segments)]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def test_windows_of_split_marks_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(S, "WINDOWS", 500)
    given = list(_split_marks(2, 20, 7))
    batches = list(S._sort_shards(200, 1 << 20)(iter(given)))
    assert max(b.num_rows for b in batches) <= 500 < sum(b.num_rows for b in batches)
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    want = []
    for mark, parts, part, d1, d2, _, body in (tuple(r.values()) for b in given for r in b.to_pylist()):
        for at in range(len(body) - 199):
            w = xxhash.xxh3_128_intdigest(body[at : at + 200])
            w1, w2 = w >> 64, w & (2**64 - 1)
            want.append((d1, d2, None, mark, w1 * parts * S.RANGES >> 64, S._signed(w1), S._signed(w2), at, part))
    assert len(want) == 2 * 20 * 160
    key = lambda r: (r[3], r[1], r[7])
    assert sorted(got, key=key) == sorted(want, key=key)
    # A seventh of a mark's windows would be over 400.
    assert max(Counter((r[3], r[4]) for r in got).values()) < 100


def test_memory_of_a_shard_of_split_marks():
    """At most 80 bytes a byte of the segments are held, their windows included."""
    given = list(_split_marks(2, 600, 7))
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in S._sort_shards(200, 1 << 20)(iter(given)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2 * 600 * 160
    assert peak < 80 * 2 * 600 * 359


@pytest.mark.parametrize(("segments", "shard_bytes"), [(2000, 1 << 20), (2, 60), (1, 1)])
def test_removal(spark, segments, shard_bytes):
    rng = random.Random(segments)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 60)))
    common = [word() for _ in range(6)]
    texts = [None, "", "a" * 300, common[0]]
    texts += ["".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += [texts[10]] * 5
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = S.remove_repeated_bytes(df, length=12, gram=4, segments=segments, shard_bytes=shard_bytes).collect()
    want = brute(texts, 12)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(want))


def test_empty_table_and_null_id(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeated_bytes(none).count() == 0
    two = spark.createDataFrame([(None, "x" * 250), (1, "y" * 150)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in S.remove_repeated_bytes(two).collect()} == {None: 0, 1: 0}


def test_sorted_windows_of_one_shard_are_found_in_another():
    rng = random.Random(5)
    for _ in range(50):
        lists = []
        for _ in range(2):
            own = sorted({(rng.randint(-5, 5), rng.randint(-3, 3)) for _ in range(rng.randint(0, 25))})
            lists.append(np.array([(a, b, i) for i, (a, b) in enumerate(own)], [("w1", "i8"), ("w2", "i8"), ("row", "i8")]))
        here, there = S.searched(*lists)
        plain = [x[["w1", "w2"]].tolist() for x in lists]
        assert list(zip(here.tolist(), there.tolist())) == [(i, plain[1].index(w)) for i, w in enumerate(plain[0]) if w in plain[1]]


@pytest.mark.parametrize("parts", [2, 7, 50])
def test_shards_of_one_mark_merge_like_one(spark, parts):
    """Documents around one common passage: its mark has many different segments."""
    rng = random.Random(parts)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, edges = word(30), [word(9) for _ in range(8)]
    texts = [f"{rng.choice(edges)}{word(3)}{passage}{word(2)}{rng.choice(edges)}" for _ in range(2 * parts + 10)]
    texts += [None, "", texts[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, mark string")
    got = S.remove_repeated_bytes(df, length=12, gram=4, segments=-(-len(texts) // parts), shard_bytes=200).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(brute(texts, 12)))
