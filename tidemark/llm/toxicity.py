"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, lower-cased. A text's features are the distinct 32-bit hashes of its
words, word pairs, and pairs with one word between; a longer word also stands for its beginnings of
4 to 7 bytes, so that inflected forms share what was learned. FTRL-proximal learns with a rate of its own
for each coordinate, and its L1 term leaves nearly all weights at exactly zero, so the model is a
short sorted table that is broadcast whole.

The fit takes at most `max_rows` labelled documents, those with the smallest hash of doc_id; scoring
reads every whole text, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept
from tidemark.llm.wordhash import NOT_LETTER, Words, flat, mix, slices

#: Text bytes taken at a time; numpy needs about fifty times as much for a moment.
STEP = 2 << 20
#: Bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Weights:
    """Sorted feature hashes, their weights, and the bias; all other weights are zero."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float


def features(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature hashes (uint32), with repetitions."""
    data, offsets = flat(pc.utf8_lower(texts))
    words = Words(data, offsets, NOT_LETTER)
    row = words.row_of()
    found = [(row, words.hash)]
    for k in PREFIXES:
        longer = np.flatnonzero(words.end - words.start > k)
        found.append((row[longer], words.beginnings(longer, k)))
    at, pairs = words.windows(2)
    found.append((row[at], mix(pairs + np.uint64(1))))
    n = len(words.hash)
    if n > 2:
        at = np.flatnonzero(row[:-2] == row[2:])
        found.append((row[at], mix(words.hash[at] + mix(words.hash[at + 2] + np.uint64(2)))))
    return np.concatenate([r for r, _ in found]), np.concatenate([(h >> np.uint64(32)).astype(np.uint32) for _, h in found])


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 8000, epochs: int = 5, alpha: float = 0.4, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, least_rows: int = 3
) -> Weights:
    """Weights learned from `docs` (doc_id, text) and `labels` (doc_id, label).

    Of several labels of a document the greatest counts, of several texts the one whose feature set is the
    smallest as a byte string. Null labels and ids are left out; a null text has no feature; without rows, or with one
    label only, the bias alone decides. Features of fewer than `least_rows` sampled rows are not learned.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                row, feature = features(part.column("text"))
                key = np.unique((row.astype(np.uint64) << np.uint64(32)) | feature)
                ends = np.searchsorted(key >> np.uint64(32), np.arange(part.num_rows + 1))
                low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                ids = [low[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(ids, pa.binary())], ["doc_id", "label", "ids"])

    rows = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.col("label").cast("int")).alias("label"))
    sample = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # max_rows ids at most
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    encoded = texts.mapInArrow(encode, "doc_id string, label int, ids binary")
    got = encoded.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("ids").alias("ids")).select("label", "ids").toArrow()
    label = got.column("label").to_numpy().astype(np.float64)
    docs = [np.frombuffer(x.as_buffer(), np.uint32).copy() for x in got.column("ids")]
    del got
    # first by counts of hash buckets, so that the rare features are gone before anything is sorted
    bucket = np.zeros(1 << 24, np.uint16)
    for ids in docs:
        seen = np.unique(ids >> np.uint32(8))
        bucket[seen[bucket[seen] < 0xFFFF]] += 1  # full counts stay full
    docs = [ids[bucket[ids >> np.uint32(8)] >= least_rows] for ids in docs]
    del bucket
    if not docs:
        return Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), -4.0)
    # a fixed order that does not depend on how rows arrived
    order = sorted(range(len(docs)), key=lambda i: (len(docs[i]), label[i], docs[i].tobytes()))
    order = [order[i] for i in np.random.default_rng(0).permutation(len(order))]
    vocabulary, seen = np.unique(np.concatenate(docs), return_counts=True)
    vocabulary = vocabulary[seen >= least_rows]
    n_coord = len(vocabulary)
    z, n = np.zeros(n_coord + 1), np.zeros(n_coord + 1)

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    index = []
    for ids in docs:
        at = np.searchsorted(vocabulary, ids)
        hit = at < n_coord
        hit[hit] = vocabulary[at[hit]] == ids[hit]
        index.append(np.append(at[hit], n_coord).astype(np.int32))  # the last coordinate is the bias
    for _ in range(epochs):
        for d in order:
            i = index[d]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label[d]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    final = weights(np.arange(n_coord + 1))
    kept = np.flatnonzero(final[:-1])
    return Weights(vocabulary[kept], final[kept].astype(np.float32), float(final[-1]))


def score(docs: DataFrame, weights: Weights, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with `score`, the probability of label 1, from the whole text.

    A null or empty text has the bias only. A kept column named score is replaced by the result; other
    columns of `docs` do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep, columns, types = kept(docs, keep, ["score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        first = np.zeros(1 << 20, bool)  # by the low bits: drops nearly all features before the search
        first[model.feature & np.uint32((1 << 20) - 1)] = True
        for batch in batches:
            for part in slices(batch, "text", STEP):
                row, feature = features(part.column("text"))
                may = np.flatnonzero(first[feature & np.uint32((1 << 20) - 1)])
                row, feature = row[may], feature[may]
                at = np.searchsorted(model.feature, feature)
                hit = at < len(model.feature)
                hit[hit] = model.feature[at[hit]] == feature[hit]
                pairs = np.unique(row[hit] * np.int64(max(1, len(model.feature))) + at[hit])
                total = np.full(part.num_rows, model.bias)
                if len(pairs):
                    np.add.at(total, pairs // len(model.feature), model.weight[pairs % len(model.feature)])
                result = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), result], [*(f"k{i}" for i in range(len(keep))), "score"])

    renamed = docs.select(*columns, F.col("text").cast("string").alias("text"))
    ddl = ", ".join([*([types] if types else []), "score double"])
    return renamed.mapInArrow(run, ddl).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score")
