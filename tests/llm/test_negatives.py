"""Hard negatives against all pairs, on awkward vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, cell string, score int, id string"


def plain(rows, positives=5, hard=10):
    usable, seen = [], set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        row = (i, label, tuple(math.floor(256 * x) for x in v))
        if row not in seen:
            seen.add(row)
            usable.append(row)
    out = []
    for i, label, v in usable:
        if i % 100:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), j, m == label) for j, m, w in usable})
        for p, j, _ in [s for s in scored if s[2] and s[1] != i][:positives]:
            fit = [(-s, k) for s, k, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, n + 1, k, -p, s) for n, (s, k) in enumerate(fit[:hard])]
    return sorted(set(out))


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, label, v and [x if x is None else float(x) for x in v], "x", 1, "y") for i, label, v in rows], SCHEMA).repartition(4)
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def vectors(n, dim, seed, groups=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = centres[r.integers(groups)] + 0.4 * r.normal(size=dim) if i % 3 else r.integers(-2, 3, size=dim) / 4
        rows.append((i, int(r.integers(10)), v.tolist()))
    return rows


def test_equals_all_pairs(spark):
    rows = vectors(900, 6, 1)
    rows += [(None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1001, 2, None), (1100, 3, [1.0, None, 1, 1, 1, 1]), (1200, 3, [float("nan")] * 6), (1300, 3, [float("inf")] + [0.0] * 5), (1400, 4, [0.0] * 6)]
    rows += rows[:60] + [(2000 + i, rows[100][1], rows[100][2]) for i in range(80)]  # repeated rows, and many copies of an anchor under other ids
    want = plain(rows)
    assert found(spark, rows) == want and len(want) > 300
    assert found(spark, rows, anchor_block=3, pivots=2, sample_rows=5) == want  # neither blocks nor pivots change the result


def test_one_label_with_most_rows(spark):
    rows = [(i, 1 if i % 4 else 2, v) for i, _, v in vectors(600, 5, 4)]
    assert found(spark, rows) == plain(rows)


def test_large_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i, i % 3, [r.uniform(-1, 1) * 2**20 for _ in range(4)]) for i in range(250)]
    assert found(spark, rows) == plain(rows)


def test_vectors_that_take_no_part(spark):
    rows = vectors(300, 4, 5)
    odd = [(400, 1, [1.0, 2.0]), (500, 1, []), (600, 1, [1e300, 0, 0, 0])]  # another length, none, and too large for 64-bit scores
    assert found(spark, rows + odd) == found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(0, 1, [1.0])], [(100, 1, [1.0]), (7, 2, [0.5])], [(0, None, None)]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == plain(rows) == []


def test_brackets_hold_every_score():
    r = np.random.default_rng(3)
    v = r.integers(-300, 300, size=(200, 8))
    most = float((v * v).sum(axis=1).max())
    pivots = negatives.spread(negatives.lifted(v[:50].astype(float), most), 6)
    a = negatives.Anchors(np.arange(40), np.zeros(40), v[:40], pivots, most)
    d = negatives.distances(negatives.lifted(v.astype(float), most), pivots)
    low, high = a.brackets(np.arange(40), d)
    exact = v[:40] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    low, high = a.run_brackets(np.arange(40), d.min(axis=0), d.max(axis=0))
    assert (low[:, None] <= exact).all() and (exact <= high[:, None]).all()
