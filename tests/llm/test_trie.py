"""The prefix trie against a plain trie of tuples, on awkward conversations."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, a int, depth int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))

    def order(v):
        return v[0] is not None, v[0] or 0, hashlib.md5(f"{len(v[1].encode())}:{v[1]}{v[2]}".encode()).hexdigest()

    turns = {c: [v[1:] for v in sorted(vs, key=order)] for c, vs in convs.items()}
    made, nodes, kids = {}, {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(made[c]) + 1):
            nodes.setdefault(made[c][:d], []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[q] for q in below) or 1
        saved[k] = sum(saved[q] for q in below) + (len(nodes[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(made[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(spark, rows, parts=5):
    base, heads = F.col("conv") - F.col("conv") % 20, F.pmod(F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")), F.lit(4))
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    return sorted(repr(tuple(r)) for r in trie.prefix_trie(df, base, heads, 3).collect())


def awkward():
    r = random.Random(3)
    rows = []
    for c in [*range(-25, 0), 0, *range(21, 70)]:  # no conversation 20; 40 and 60 lend their heads
        for t in range(r.choice([1, 1, 2, 3, 4, 5, 8])):
            rows.append((c, t if r.random() > 0.05 else None, r.choice(["user", "bot", None]), r.choice(["a b", "c  d e", None, "", "x"])))
    return [*rows, (None, 1, "u", "lost"), *rows[:5]]


def test_equals_a_plain_trie(spark):
    rows = awkward()
    assert found(spark, rows) == plain(rows)


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """Copies of a long conversation, and every prefix of another, are paths that a counter alone would climb turn by turn."""
    rows = [(c, t, "u", f"turn {t}") for c in range(100, 140) for t in range((c - 99) * 2)]
    rows += [(c, t, "u", f"same {t}") for c in range(200, 210) for t in range(90)]
    peel, rounds = trie.peel, []
    monkeypatch.setattr(trie, "peel", lambda state, most=14: rounds.append(most) or peel(state, most))
    assert found(spark, rows) == plain(rows)
    assert rounds == [14]


def test_one_conversation_over_many_partitions(spark):
    """A conversation with nearly all rows is numbered across partitions."""
    rows = [(7, t, "u", f"turn {t % 50}") for t in range(3000)] + [(8, 0, "u", "a"), (6, 1, None, None)]
    assert found(spark, rows, 3) == plain(rows)


def test_without_conversations(spark):
    assert found(spark, []) == [] == found(spark, [(None, 1, "u", "t")])


def test_a_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 1, "u", "dropped, as no conversation 0 lends a head")]
    assert found(spark, rows) == plain(rows) == [repr((c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()))]


def test_members_of_one_node_stream(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    ids = random.Random(1).sample(range(10**6), 500)
    members = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 9), (5, 2, -4), (5, 2, 30)], "conv_id long, depth long, conv long")
    got = {(r["conv_id"], r["depth"]): r["sha"] for r in trie.digests(members).collect()}
    want = {(1, 2): sorted(ids), (1, 3): [9], (5, 2): [-4, 30]}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("n", [0, 1, 5, 1 << 40])
def test_powers(n):
    import numpy as np

    assert int(trie.powers(trie.BASES[0], np.array([n]))[0]) == pow(int(trie.BASES[0]), n, 1 << 64)
