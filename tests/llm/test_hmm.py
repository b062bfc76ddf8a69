"""The language model: counts against plain ones, recursions against sums over all paths, and what it learns."""

import collections
import itertools
import math
import random
import re
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hmm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row string, train boolean, score int"


def tokens(text):
    return WORD.findall((text or "").translate(LOW)) + [None]


def two_tongues(n, seed):
    """Texts in one of two vocabularies, so that states can tell more than single words."""
    r = random.Random(seed)
    tongue = [[f"{p}{i}{s}" for i in range(150)] for p, s in (("la", "um"), ("ko", "is"))]
    return [(i, " ".join(r.choice(tongue[i % 2]) for _ in range(r.randint(5, 120))), "x", None, 1) for i in range(n)]


def awkward():
    rows = two_tongues(120, 1) + [(200, None, "x", True, 1), (201, "", "x", False, 1), (None, "No id HERE", "x", None, 1), (202, "É ÀB ab\x0bAB " * 40, "x", None, 1), (203, "unseen words only " * 3, "x", None, 1)]
    return rows + rows[:3] + [(10, "word " * 9000, "x", None, 1)]


def scored(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return hmm.score(df, F.col("doc_id") % 10 != 3, ["doc_id", "row", "score"], **more)


def test_counts_and_base_are_plain(spark):
    rows = awkward()
    counts = collections.Counter(w for i, t, *_ in rows if i is not None and i % 10 != 3 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows:
        w = tokens(t)
        want.append((i or -1, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    for more in ({"states": 3}, {"states": 2, "own": 20, "known": 50, "endings": 7}):  # most words joined, few symbols
        df = scored(spark, rows, start_passes=2, passes=1, **more)
        assert df.columns == ["doc_id", "row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = df.collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_states_beat_single_words_on_unseen_texts(spark):
    got = [r for r in scored(spark, two_tongues(300, 2), states=4).collect() if r["doc_id"] % 10 == 3]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.2  # two vocabularies: up to log10(2) for each token


def test_every_pass_runs_over_all_training_texts(spark, monkeypatch):
    seen, plain = [], hmm.baum_welch

    def watched(texts, *more):
        seen.append(texts.count())
        return plain(texts, *more)

    monkeypatch.setattr(hmm, "baum_welch", watched)
    rows = [(i, f"w{i % 7} w{i % 3}", "x", None, 1) for i in range(6000)]  # more than the start was once made from
    assert scored(spark, rows, states=2, start_passes=2, passes=1).count() == 6000
    assert seen == [5400] * 3


def model(symbols, states, seed):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(r.random(states), 0), norm(r.random(states), 0), norm(r.random((states, states)), 1), norm(r.random((symbols, states)), 0).astype(np.float32))


def all_paths(m, seq, start):
    total, states = 0.0, len(m.start)
    for path in itertools.product(range(states), repeat=len(seq)):
        p = start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[s, b]
        total += p
    return total


def test_likelihood_is_the_sum_over_all_paths(monkeypatch):
    m, r = model(5, 3, 1), np.random.default_rng(2)
    texts = [r.integers(0, 5, size=n).astype(np.uint16) for n in (1, 2, 5, 7, 8, 3)]
    want = [math.log10(all_paths(m, t, m.start)) for t in texts]
    assert np.allclose(hmm.likelihoods(m, texts), want, rtol=1e-6)
    monkeypatch.setattr(hmm, "BLOCK", 2)
    assert np.allclose(hmm.likelihoods(m, texts), want, rtol=1e-6)


def test_expected_counts_are_sums_over_all_paths():
    m, r = model(4, 2, 3), np.random.default_rng(4)
    parts = [r.integers(0, 4, size=n).astype(np.uint16) for n in (6, 4, 1)]
    first = np.array([True, False, True])
    emitted, want_emit = np.zeros((4, 2)), np.zeros((4, 2))
    moved = hmm.expected(m, parts, first, emitted)
    want = np.zeros((5, 2))
    for seq, f in zip(parts, first, strict=True):
        start = m.start if f else m.inside
        whole = all_paths(m, seq, start)
        want[4] += math.log(whole) / 2
        for path in itertools.product(range(2), repeat=len(seq)):
            p = start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= m.move[a, b] * m.emit[s, b]
            p /= whole
            want[0 if f else 1, path[0]] += p
            for s, j in zip(seq, path, strict=True):
                want_emit[s, j] += p
            for a, b in zip(path, path[1:]):
                want[2 + a, b] += p
    assert np.allclose(moved, want, rtol=1e-4) and np.allclose(emitted, want_emit, rtol=1e-4)


def plainly(m, parts, first, counts):
    """The recursions one segment after the other, in double precision."""
    k = len(m.start)
    begun, moves, log = np.zeros((2, k)), np.zeros((k, k)), 0.0
    for seq, f in zip(parts, first, strict=True):
        seen, alpha, one = m.emit[seq].astype(float), np.zeros((len(seq), k)), np.zeros(len(seq))
        for t in range(len(seq)):
            alpha[t] = seen[t] * ((m.start if f else m.inside) if t == 0 else alpha[t - 1] @ m.move)
            one[t] = alpha[t].sum()
            alpha[t] /= one[t]
        beta, log = np.ones(k), log + np.log(one).sum()
        for t in range(len(seq) - 1, -1, -1):
            np.add.at(counts, seq[t], alpha[t] * beta)
            if t == 0:
                begun[0 if f else 1] += alpha[0] * beta
            else:
                ahead = seen[t] * beta / one[t]
                moves += m.move * np.outer(alpha[t - 1], ahead)
                beta = m.move @ ahead
    return np.vstack([begun, moves, np.full(k, log / k)])


def ragged(symbols, n, seed):
    r = np.random.default_rng(seed)
    parts = sorted((r.integers(0, symbols, size=x).astype(np.uint16) for x in r.integers(1, 257, size=n)), key=lambda p: -len(p))
    return parts, r.random(n) < 0.6


def test_expected_counts_of_many_ragged_segments():
    m, (parts, first) = model(50, 8, 5), ragged(50, 70, 6)
    emitted, want = np.zeros((50, 8)), np.zeros((50, 8))
    moved = hmm.expected(m, parts, first, emitted)
    assert np.allclose(moved, plainly(m, parts, first, want), rtol=1e-4) and np.allclose(emitted, want, rtol=1e-4)


def test_a_pass_costs_little_for_each_symbol():
    # in terms of eight sums by symbol, the least that it does: about 7; with tables of a row for each symbol 17
    m, (parts, first) = model(30_000, 8, 7), ragged(30_000, 2048, 8)
    emitted, every = np.zeros((8, 30_000)).T, np.concatenate(parts).astype(np.intp)
    weights = np.random.default_rng(9).random((8, len(every))).astype(np.float32)

    def cpu(run):
        took = []
        for _ in range(5):
            begun = time.process_time()
            run()
            took.append(time.process_time() - begun)
        return min(took)

    ratio = cpu(lambda: hmm.expected(m, parts, first, emitted)) / cpu(lambda: [np.bincount(every, weights=w, minlength=30_000) for w in weights])
    tracemalloc.start()
    hmm.expected(m, parts, first, emitted)
    held = tracemalloc.get_traced_memory()[1] / len(every)
    tracemalloc.stop()
    assert held < 120  # bytes for each symbol; 565 with tables of a row for each symbol
    assert ratio < 12


def test_places_are_those_of_searchsorted():
    r = np.random.default_rng(3)
    for n, shift in ((0, 0), (1, 0), (3000, 0), (3000, 50)):  # with 50 all words begin with the same bits
        word = np.unique(r.integers(0, 1 << 64, size=n, dtype=np.uint64) >> np.uint64(shift))
        asked = np.concatenate([word, word + np.uint64(1), r.integers(0, 1 << 64, size=500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        begin = np.searchsorted(word, np.arange(1 << hmm.BITS, dtype=np.uint64) << np.uint64(64 - hmm.BITS))
        assert (hmm._places(word, begin, asked) == np.searchsorted(word, asked)).all()


def test_tables_without_training_texts_or_rows(spark):
    (r,) = scored(spark, [(3, "no text to learn from", "x", None, 1)]).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (6, 0, 0, 0.0) and math.isfinite(r["score"])
    assert scored(spark, []).collect() == []
