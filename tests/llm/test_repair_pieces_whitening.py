"""Conversation repair, piece encoding and whitening against brute force, the library and exact fractions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL

from vulnspark.llm import conversation_repair as C
from vulnspark.llm import sentencepiece_codec as S
from vulnspark.llm import whitening as W
from vulnspark.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# conversation repair


def plain_damage(conv, turn, role, text):
    spaced = lambda v: " " if v is None else str(v)
    kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
    role, text = spaced(role), spaced(text)
    before = (role, text)
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    row = (turn, before, "user" if kind == 4 else role, text)
    return [] if kind == 0 else [row, row] if kind == 3 else [row]


def plain_repair(conv, turns):
    """All of the contract over one conversation, by dynamic programming over (cost, audit) pairs."""
    rows = [d for t in turns for d in plain_damage(conv, *t)]
    rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        faults.append("b" if not kept else "d" if (role, text) in seen else "-" if kept[-1] in ".!?" else "t")
        seen.add((role, text))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def with_inserts(at):
        for _ in range(3):
            for state, role in follows.items():
                if role in at:
                    cost, audit, told = at[role]
                    new = (cost + 5, "I" + audit, ((C.ROLES[role], ""), *told))
                    at[state] = min(at.get(state, new), new)
        return at

    best = with_inserts(best)
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        at = {}
        for state, need in follows.items():
            options = []
            if state in best:
                cost, audit, told = best[state]
                options.append((cost + 2, "D" + audit, told))
            extra = 5 * (fault == "t")
            if fault not in "bd":
                to = need if role[:1] == need else "s" if role[:1] == "s" and state == "" else None
                for letter, price, to, name in (("K", 0, to, role), ("R", 1, need, C.ROLES[need])):
                    if to is not None and to in best:
                        cost, audit, told = best[to]
                        options.append((cost + price + extra, letter + audit, ((name, text), *told)))
            if options:
                at[state] = min(options)
        best = with_inserts(at)
    cost, audit, told = best[""]
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    text = "\n".join(f"{r}:{t}" for r, t in told)
    count = faults.count
    return (
        conv, gaps, count("b"), count("d"), count("t"), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def plain_repairs(rows):
    groups = defaultdict(list)
    for conv, *turn in rows:
        groups[conv].append(turn)
    return sorted((plain_repair(c, t) for c, t in groups.items()), key=str)


def random_turns(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", " ", "", None, "a!\n", "so b\t", f"t{turn}.", f"t{turn}.", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


TURNS = "conv_id long, turn long, role string, text string, key string, part int, result string, conv int"


@pytest.mark.parametrize(("longest", "block"), [(9, 64), (40, 3), (40, 1)])
def test_repair(spark, longest, block):
    rows = random_turns(longest + block, 60, longest)
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], TURNS).repartition(5)
    got = sorted(map(tuple, C.repair(df, block=block).collect()), key=str)
    assert got == plain_repairs(rows)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_conversation_repair"](spark, SMALL).collect()), key=str)
    assert got == plain_repairs(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_a_long_conversation_with_long_texts(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", "word " * (20_000 if i == 5 else 3) + ".") for i in range(700)]
    df = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], TURNS)
    assert [tuple(r) for r in C.repair(df).collect()] == plain_repairs(rows)
    assert C.repair(df.limit(0)).count() == 0


def test_prices_prove_the_cheapest_path():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(0, 12)
        initials = "".join(rng.choice("uasx") for _ in range(n))
        faults = "".join(rng.choice("--td b".replace(" ", "")) for _ in range(n))
        arcs = C.arcs_of(initials, faults, C.FINAL, True)
        prices = C.first_prices(arcs)
        cost = C.auction(arcs, C.START, prices)
        assert all(prices[i] <= c + prices[j] for i, here in enumerate(arcs) for _, c, j in here)
        far = [0 if i == len(arcs) - 1 else C.UNREACHABLE for i in range(len(arcs))]
        for _ in range(3 * n + 8):
            far = [min([far[i], *(c + far[j] for _, c, j in here)]) for i, here in enumerate(arcs)]
        assert cost == far[C.START]


# sentencepiece


def packed(number, value):
    def varint(x):
        return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_with(rule, prefix, squeeze):
    """The model with another compiled character map and other white-space rules."""
    charsmap = b""
    if rule:
        other = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        charsmap = dict(S.message(dict(S.message(other))[3]))[2]
    spec = packed(1, b"own") + packed(2, charsmap) + packed(3, prefix) + packed(4, squeeze) + packed(5, 1)
    raw = open(MODEL, "rb").read()
    return b"".join(packed(k, spec if k == 3 else v) for k, v in S.message(raw) if k != 3 or v)


ODD = (
    "a", "b", "the ", "ing", "é", "ß", " ", "  ", "\n", "\t", "▁", "日", "本", "😀", "\x00", "​", "　", "ﬁ", "ｱ", "ﾞ",
    "é", "가", "각", "①", "<s>", "</s>", "<0x0A>", "﻿", " ", "½", "㍿", ".", "!", "123", "Σ", "́", "zzzzzzzzz",
)


@pytest.mark.parametrize("rule", ["", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("prefix", "squeeze"), [(1, 0), (0, 0), (1, 1), (0, 1)])
def test_codec_equals_the_library(rule, prefix, squeeze):
    model = model_with(rule, prefix, squeeze)
    library, codec, rng = sentencepiece.SentencePieceProcessor(model_proto=model), S.Codec(model), random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, (ids, begins, ends) in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids) == library.decode(ids.tolist())
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert spans == list(zip(begins.tolist(), ends.tolist(), strict=True))
        mixed = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 8))]
        assert codec.decode(np.array(mixed, int)) == library.decode(mixed)


def test_codec_of_very_long_words():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), S._load(MODEL)
    for text in ("ab" * 60_000, " " * 100_000, "日本" * 40_000, "\n" * 50_000, "a" * 49, "x" * 48 + "\x00"):
        assert codec.encode([text])[0][0].tolist() == library.encode(text)


def test_codec_keeps_its_words_for_the_next_task(monkeypatch):
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), S._load(MODEL)
    assert S._load(MODEL) is codec
    texts = [f"{c}and.\nThe日本{k}\x00 end" for k, c in enumerate("abé😀")]
    codec._forget()
    codec.encode(texts)
    # Neither known words nor characters without a piece are merged one by one.
    monkeypatch.setattr(codec, "_merge_long", None)
    assert [c[0].tolist() for c in codec.encode([f"{t} more\n" for t in texts])] == [library.encode(f"{t} more\n") for t in texts]
    monkeypatch.setattr(codec, "_merge_short", None)
    assert [c[0].tolist() for c in codec.encode(texts)] == [library.encode(t) for t in texts]


def test_codec_forgets_words(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 5)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), S._load(MODEL)
    for k in range(9):
        text = f"one two{k} three\n{k} {'x' * 60}"
        assert codec.encode([text])[0][0].tolist() == library.encode(text)
        assert len(codec.words) == len(codec.starts) <= 10


def test_other_models_are_refused():
    raw = open(MODEL, "rb").read()
    own = packed(1, packed(1, b"<own>") + packed(3, 4))
    with pytest.raises(ValueError):
        S.Codec(raw + own)


def test_pieces(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x\x01y 😀"), (4, "lang " * 50_000), (5, "é▁ ")]
    extra = "ids string, begins int, decoded string, id int, n_tokens long"
    df = spark.createDataFrame([(*r, "a", 1, "b", 2, 3) for r in rows], f"doc_id long, text string, {extra}").repartition(3)
    coded = S.encode_pieces(df, MODEL)
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, S.piece_digests(coded).collect())) == want
    back = S.decode_pieces(coded, MODEL).select("decoded", "text").collect()
    assert all(r.decoded == r.text for r in back)
    assert S.piece_digests(S.encode_pieces(df.limit(0), MODEL)).count() == 0


def test_pieces_of_the_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op11_sentencepiece"](spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t)) for i, t in texts.items()}
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(texts[r.doc_id]))).encode()).hexdigest() for r in got)


# whitening


def exact(vectors):
    """n, sums, covariance and rows of x in fractions, straight from the definition."""
    import math

    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dims)]
    centred = [[Fraction(n * r[i] - sums[i], n) for i in range(dims)] for r in x]
    cov = [[sum(r[i] * r[j] for r in centred) / n for j in range(dims)] for i in range(dims)]
    return n, sums, cov, centred, [sum((n * r[i] - sums[i]) ** 2 for i in range(dims)) for r in x]


def check_whitening(got, vectors, ids):
    n, _, cov, centred, deviations = exact(vectors)
    dims = len(cov)
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.sort(np.linalg.eigvalsh(v))[::-1][:32]
    by_id = {r.vec_id: r for r in got}
    assert sorted(by_id) == sorted(ids)
    w = np.array([by_id[i].whitened for i in ids])
    assert w.shape == (n, min(32, dims)) and all(r.n == n for r in got)
    assert [by_id[i].deviation for i in ids] == deviations
    z = np.array([[float(c) for c in row] for row in centred])
    # The projections that give these values, from least squares; unit, orthogonal, and eigenvectors.
    u = np.linalg.lstsq(z, w * np.sqrt(values), rcond=None)[0]
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-6)
    assert np.allclose(v @ u, u * values, atol=1e-6 * values[0])
    assert np.allclose(got[0].explained, values / np.trace(v), rtol=1e-6)
    error = np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(w.shape[1])).max()
    assert got[0].identity_error < 1e-9 and error < 1e-9


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    kept = [r for r in df.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check_whitening(W.whiten(df).collect(), [r.embedding for r in kept], [r.vec_id for r in kept])
    rows = QUERIES["op12_embedding_whitening"](spark, SMALL)
    assert rows.count() == 32 * len(kept)
    assert {r.component for r in rows.select("component").distinct().collect()} == set(range(1, 33))


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e15])
def test_whitening_edge_cases(spark, scale):
    rng = random.Random(int(scale))
    good = [(i, [rng.gauss(0, 1) * scale for _ in range(5)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, [1.0] * 4), (95, [])]
    extra = "n long, whitened double, id int, vector string"
    df = spark.createDataFrame([(*r, 1, 0.5, 2, "a") for r in good + bad], f"vec_id long, embedding array<double>, {extra}")
    got = W.whiten(df.repartition(4)).collect()
    if scale < 1e15:
        check_whitening(got, [v for _, v in good], [i for i, _ in good])
    else:  # deviations no long can hold
        assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-9


def test_whitening_without_spread(spark):
    rows = lambda *vs: spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>")
    assert W.whiten(rows().limit(0)).count() == 0 and W.by_component(W.whiten(rows())).count() == 0
    one = W.whiten(rows([1.0, 2.0])).first()
    assert one.whitened == [0.0, 0.0] and one.explained == [0.0, 0.0] and one.deviation == 0 and one.identity_error == 0
    line = W.whiten(rows([1.0, 1.0], [3.0, 3.0], [3.0, 3.0])).collect()
    assert all(r.whitened[1] == 0.0 and abs(r.explained[0] - 1) < 1e-12 for r in line) and line[0].identity_error < 1e-9
    assert [r.whitened for r in W.whiten(rows([], [])).collect()] == [[], []]
