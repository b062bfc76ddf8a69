"""Hard negatives of anchors by inner product, exactly, behind a pivot table.

* Components become integers floor(scale * x), so scores are integers and ties are exact.
* Inner product becomes distance: a row v gains sqrt(M^2 - |v|^2), with M the largest norm, an anchor q gains 0,
  and then |q' - v'|^2 = M^2 + |q|^2 - 2 <q, v>.
* The pivot table holds each row with its distances to some pivots; it is dealt and sorted by nearest pivot and
  distance, so that runs of rows have narrow intervals of every distance, and rows of one place may fill many tasks.
* For an anchor, | |q'p| - |v'p| | <= |q'v'| <= |q'p| + |v'p| over all pivots p bracket the score, first of a whole run
  of rows, then of each row. What the bracket cannot rule out is scored exactly.
* Anchors are a stated query set: they meet the table in blocks of bounded size, the table itself stays where it
  lies, and each task sends on at most k rows of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import column, shared_dir

#: Rows of the pivot table whose distances are bounded together.
RUN = 1024

#: Beyond any score.
FAR = 2**62


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(kind)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each the farthest from those before it."""
    chosen = [int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """The rows of v with a further component that gives all of them the norm sqrt(most)."""
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) if len(x) else np.zeros((0, len(pivots)))


def first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k different (id, score) of each group, higher scores and then smaller ids first."""
    order = np.lexsort((ids, -score, group))
    g, s, i = group[order], score[order], ids[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])) if len(g) else np.zeros(0, bool)
    order, g = order[fresh], g[fresh]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


class Anchors:
    """A block of anchors: ids, labels, integer vectors, and distances to the pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, pivots: np.ndarray, most: float):
        self.ids, self.labels, self.v, self.most = ids, labels, v, most
        self.norm = (v.astype(np.float64) ** 2).sum(axis=1)
        self.far = distances(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1), pivots)

    def _score(self, which: np.ndarray, d: np.ndarray, sign: float) -> np.ndarray:
        """The score at a distance, with some room for rounding in the direction of the sign."""
        base = self.most + self.norm[which]
        return (base - d * d) / 2 + sign * (1e-9 * base + 1e-6)

    def run_brackets(self, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that a row can have whose distances lie between `low` and `high`."""
        q = self.far[which]
        near = np.maximum(np.maximum(q - high, low - q), 0).max(axis=1)
        return self._score(which, (q + high).min(axis=1), -1), self._score(which, near, 1)

    def brackets(self, which: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each of the anchors `which` with each row, from the rows' distances d."""
        near, far = np.zeros((len(which), len(d))), np.full((len(which), len(d)), np.inf)
        for q, p in zip(self.far[which].T, d.T, strict=True):
            np.maximum(near, np.abs(q[:, None] - p[None, :]), out=near)
            np.minimum(far, q[:, None] + p[None, :], out=far)
        return self._score(which[:, None], far, -1), self._score(which[:, None], near, 1)

    def scores(self, which: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact products: in floating point where every sum is an integer below 2^53."""
        if self.most < 2**52:
            return np.rint(self.v[which].astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
        return self.v[which].astype(np.int64) @ v.T.astype(np.int64)


def _best(anchors: Anchors, slots: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool, k: int, tables: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(slot, id, score): the first k rows of each slot among those of the tables whose score lies within the slot's bounds.

    slots: the anchor of each slot, ascending. same: rows of the anchor's label but with another id; else rows of other labels.
    """
    floor = least.copy()  # no row below can be among the first k any more
    have = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for table in tables:
        for a in range(0, table.num_rows, RUN):
            run = table.slice(a, RUN)
            ids, labels = run.column("id").to_numpy(), run.column("label").to_numpy()
            v, d = _matrix(run.column("v"), np.int64), _matrix(run.column("d"))
            every = np.arange(len(anchors.ids))
            low, high = anchors.run_brackets(every, d.min(axis=0), d.max(axis=0))
            open_ = (high[slots] >= floor) & (low[slots] <= most)
            known = np.unique(labels)
            open_ &= np.isin(anchors.labels[slots], known) if same else (len(known) > 1) | (anchors.labels[slots] != known[0])
            if not open_.any():
                continue
            which = np.unique(slots[open_])
            low, high = anchors.brackets(which, d)
            fit = (anchors.labels[which][:, None] == labels[None, :]) == same
            if same:
                fit &= anchors.ids[which][:, None] != ids[None, :]
            at = np.flatnonzero(open_)
            of = np.searchsorted(which, slots[at])
            # the weakest bounds of an anchor's slots decide what is scored
            weak, strong = np.full(len(which), np.inf), np.full(len(which), -np.inf)
            np.minimum.at(weak, of, floor[at])
            np.maximum.at(strong, of, most[at])
            fit &= (high >= weak[:, None]) & (low <= strong[:, None])
            some, rows = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
            if not len(some):
                continue
            exact, fit = anchors.scores(which[some], v[rows]), fit[np.ix_(some, rows)]
            place = np.full(len(which), -1)
            place[some] = np.arange(len(some))
            at, of = at[place[of] >= 0], place[of[place[of] >= 0]]
            slot, row = np.nonzero(fit[of] & (exact[of] >= floor[at][:, None]) & (exact[of] <= most[at][:, None]))
            if len(slot):
                new = at[slot], ids[rows[row]], exact[of[slot], row]
                have = tuple(np.concatenate(x) for x in zip(have, new, strict=True))
                keep = first_k(have[0], have[2], have[1], k)
                have = tuple(x[keep] for x in have)
                count = np.bincount(have[0], minlength=len(slots))
                last = np.cumsum(count) - 1  # first_k leaves the slots in order, the k-th score last
                full = count >= k
                floor[full] = np.maximum(floor[full], have[2][last[full]])
    return have


def mine(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    pivots: int = 16,
    sample_rows: int = 2_000,
    anchor_block: int = 4_096,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors: (id, label, vector); anchors: the condition on these rows that makes one an anchor. Of each anchor, its
    first `positives` other rows of the same label, and for each of these the first `negatives` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score; higher scores first, ties by the smaller id.
    Rows without an id or label take no part, nor do those whose vector is null, of another length than most, holds a null or
    non-finite component, one of 2^31 or more after scaling, or has a squared norm over 2^60 (scores would not fit).
    Rows that repeat an id and score count once; a row with the anchor's own id is no positive. All, where fewer fit; an
    anchor without any has no row. Pivots are chosen from at most `sample_rows` rows; the result does not depend on them.
    """
    spark = vectors.sparkSession
    scaled = F.col("x").cast("array<double>")
    sound = F.col("x").isNotNull() & F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < 2.0**31 - 1))
    named = vectors.select(column(id_column).cast("long").alias("id"), column(label_column).cast("long").alias("label"), column(vector_column).alias("x"), anchors.cast("boolean").alias("anchor"))
    rows = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound)
    rows = rows.select("id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.transform(scaled, lambda c: F.floor(c * scale).cast("int")).alias("v"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).where(F.col("norm") <= 2.0**60)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not common or not common[0]["anchors"]:
        return spark.createDataFrame([], schema)
    dim, most = common[0]["dim"], common[0]["most"]
    rows = rows.where(F.size("v") == dim).drop("norm")
    shared_dir(spark)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).select("v").toArrow()
    told = spark.sparkContext.broadcast(spread(lifted(_matrix(sample.column("v")), most), pivots))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, RUN):
                batch = whole.slice(a, RUN)
                d = distances(lifted(_matrix(batch.column("v")), most), told.value)
                cells = [pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1)), pa.array(list(d), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "anchor", "v")), *cells], ["id", "label", "anchor", "v", "cell", "near", "d"])

    table = rows.mapInArrow(measure, "id long, label long, anchor boolean, v array<int>, cell int, near double, d array<double>")
    table = table.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id").checkpoint()

    blocks = -(-common[0]["anchors"] // anchor_block)
    found = [_block(table, told, most, (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), positives, negatives, low, high) for b in range(blocks)]
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    return done.select(*(c.split()[0] for c in schema.split(", ")))


def _block(table: DataFrame, told, most: float, chosen: Column, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The rows of the anchors of one block."""
    spark = table.sparkSession
    got = table.where(F.col("anchor") & chosen).select("id", "label", "v").distinct().orderBy("id", "label", "v").toArrow()  # a block of anchors
    ids, labels = got.column("id").to_numpy(), got.column("label").to_numpy()
    block = spark.sparkContext.broadcast(Anchors(ids, labels, _matrix(got.column("v"), np.int64), told.value, most) if len(ids) else None)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if block.value is not None:
            n = len(block.value.ids)
            slot, other, score = _best(block.value, np.arange(n), np.full(n, -FAR), np.full(n, FAR), True, positives, batches)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.int64())], ["slot", "id", "score"])

    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    best = table.select("id", "label", "v", "d").mapInArrow(near, "slot long, id long, score long").distinct()
    kept = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).orderBy("slot", "n").toArrow()  # `positives` rows for each anchor of the block
    of, positive, gained = (kept.column(c).to_numpy() for c in ("slot", "id", "score"))
    least, greatest = ([-(-low * s // 100) for s in gained.tolist()], [high * s // 100 for s in gained.tolist()])
    wanted = spark.sparkContext.broadcast((of, np.array(least, np.int64), np.array(greatest, np.int64), positive, gained))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, least, greatest, positive, gained = wanted.value
        if len(of):
            slot, other, score = _best(block.value, of, least, greatest, False, negatives, batches)
            columns = [block.value.ids[of[slot]], slot, positive[slot], gained[slot], other, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["anchor_id", "slot", "positive_id", "positive_score", "negative_id", "negative_score"]
    order = Window.partitionBy("slot").orderBy(F.desc("negative_score"), "negative_id")
    hardest = table.select("id", "label", "v", "d").mapInArrow(hard, ", ".join(f"{c} long" for c in names)).distinct()
    hardest = hardest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hardest.drop("slot").checkpoint()
