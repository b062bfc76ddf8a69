"""N-gram Jaccard join with a count-vector R-tree.

Documents are sets of word shingles. Equal sets are one node. For two sets linked at similarity t,
the symmetric difference has at most T = floor((1 - t) / t * n) shingles, n the size of either.

* Routing. Shingles are hashed into more than T groups (their number is set by size class), so among the
  first T + 1 non-empty groups of a set one at least is the same in the other set. A node is sent to the
  contents of those groups; nodes that meet nowhere cannot be linked, and nothing is lost. Places where
  the same nodes meet are one place; a group's content that very many nodes share is a place of its own.
* R-tree. At a place, each node is a point: the counts of its shingles in `DIMENSIONS` hashed groups. Points are
  packed into leaves, leaves into boxes of `FAN`, and so on up to a root. The tree is joined with itself from
  the root down: the sum over groups of the smaller count bounds the overlap of two points and, with the
  boxes' upper corners, of all points in two boxes; pairs of boxes that cannot hold a link, or whose
  points are all in one component already, are left. Each node carries its first places, so that a pair
  that meets at several places is taken at the first of them.
* Verification. Pairs that survive are decided by their whole shingle sets.
* Large places run twice: first each point meets only the best partner in its own leaf and the next, and a few
  anchors their best partner in each cell of the place, which takes time in proportion to the place, and the
  components of these links are formed; then the trees of places that hold several components are joined in full. A group of many near copies is so joined by
  about as many links as it has members, without losing any component. Where the number of links is
  asked for, every surviving pair is verified instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import batches_of, counted_only, release, shared_dir, slim
from tidemark.llm.substring import LEAST_MESSAGE, _bucket, _expand, _squeeze
from tidemark.llm.wordhash import LOWER, SPACE, Words, flat, mix, slices

#: Text bytes taken at a time.
STEP = 2 << 20
DIMENSIONS = 256
#: The greatest count that a point holds: it stands for this many or more.
MOST = np.iinfo(np.uint8).max
#: Places by which two nodes tell whether they also meet at an earlier one.
FIRST = 4
#: Points of an R-tree leaf, and boxes of a larger box.
LEAF, FAN = 32, 8
#: Places with more points run in two rounds; for the first they are dealt out in cells of the second size, for the other in pairs of parts of the third.
SMALL, CELL, PART = 3, 512, 8192
#: Points of a place that all its cells have in common, so that what is linked in each of them is linked across them.
ANCHORS = 8
#: Keys that a task gathers before it sends them; of those, so many with one content make it hot.
GATHERED, HOT = 1 << 20, 4096
#: Stands among the nodes of a key for those that were sent to its place directly.
ELSEWHERE = np.int64(-(1 << 63) + 7)
#: Parts in which a component is named.
SALTS = 8
#: Words of the filter that names the nodes whose sets are needed: 64 bits each, a fixed size.
FILTER_WORDS = 1 << 17

_U = np.uint64


class Sets:
    """The distinct shingle hashes of each row of a batch, sorted: row r has h[first[r]:first[r + 1]]."""

    def __init__(self, texts: pa.Array, k: int):
        words = Words(*flat(texts), SPACE, LOWER)
        at, h = words.windows(k)
        row = words.row_of()[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        row, h = np.concatenate([row, short]), np.concatenate([h, mix(words.whole()[short] + _U(7))])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        self.row, self.h = row[new], h[new]
        self.first = np.searchsorted(self.row, np.arange(words.rows + 1))
        self.n = np.diff(self.first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n), _U)
        full = self.n > 0
        if full.any():
            out[full] = np.add.reduceat(values, self.first[:-1][full])
        return out

    def node(self) -> np.ndarray:
        """A 64-bit name of each set; 0 for empty ones."""
        return np.where(self.n > 0, mix(self.sums(mix(self.h)) + self.n.astype(_U)), _U(0)).view(np.int64)

    def points(self) -> np.ndarray:
        """Counts of each row's shingles in the hashed groups, at most MOST."""
        cell = self.row * DIMENSIONS + (self.h % _U(DIMENSIONS)).astype(np.int64)
        return np.minimum(np.bincount(cell, minlength=len(self.n) * DIMENSIONS), MOST).reshape(-1, DIMENSIONS).astype(np.uint8)


def routes(sets: Sets, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: where each of `rows` is sent."""
    step = (100 / percent) ** 2  # ratio of the size classes: a partner is in the same class or the next
    n = sets.n[rows]
    miss = n * (100 - percent) // percent
    rows, n, miss = rows[miss > 0], n[miss > 0], miss[miss > 0]
    own = np.floor(np.log(n) / np.log(step) + 1e-9).astype(np.int64)
    over = np.flatnonzero(n * (100 / percent) * (1 + 1e-9) >= step ** (own + 1))
    row = np.concatenate([rows, rows[over]])
    level = np.concatenate([own, own[over] + 1])
    need = np.concatenate([miss, miss[over]]) + 1
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    most = np.ceil(step ** (level + 1)).astype(np.int64) * (100 - percent) // percent
    groups = most + 1 + -(-most // 20)
    size = sets.n[row]
    at = np.repeat(np.arange(len(row)), size)
    source = np.repeat(sets.first[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h = sets.h[source]
    # hashes are sorted, so groups by their upper bits come in order
    group = (((h >> _U(32)) * groups[at].astype(_U)) >> _U(32)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (at[1:] != at[:-1]) | (group[1:] != group[:-1])
    start = np.flatnonzero(new)
    contents = np.add.reduceat(mix(h + _U(0x51ED)), start)
    of, number = at[start], group[start]
    first = np.searchsorted(of, np.arange(len(row)))
    rank = np.arange(len(start)) - first[of]
    sent = rank < need[of]
    label = (level[of].astype(_U) << _U(32)) | number.astype(_U)
    key = mix(contents + mix(label))[sent]
    few = np.flatnonzero(np.bincount(of, minlength=len(row)) < need)  # too few non-empty groups: all such sets of a class meet
    return np.concatenate([row[of][sent], row[few]]), np.concatenate([key, mix(level[few].astype(_U) + _U(0xFE3))])


def _place_of(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The place of a key of its own."""
    return mix((bucket.astype(_U) << _U(32)) + low + _U(0x9A5)).view(np.int64)


def _unbounded(x: np.ndarray) -> np.ndarray:
    """Counts of MOST are not known, so they bound nothing: they become greater than any."""
    return np.where(x == MOST, np.uint32(1 << 31), x) if len(x) and x.max() == MOST else x


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)


def _one(values: np.ndarray | None, edges: np.ndarray) -> np.ndarray | None:
    """For each run between `edges` the value that all have, else -1 less its number: a value of no other run."""
    if values is None:
        return None
    low, high = np.minimum.reduceat(values, edges), np.maximum.reduceat(values, edges)
    return np.where(low == high, low, -1 - np.arange(len(edges)))


class RTree:
    """Boxes over packed points, level by level; level 0 are the leaves. low, high: sizes; corner: largest counts; label, side: if all are equal."""

    def __init__(self, n: np.ndarray, x: np.ndarray, label: np.ndarray | None, side: np.ndarray | None):
        edges = np.arange(0, len(n), LEAF)
        self.levels = []
        low, high, corner = np.minimum.reduceat(n, edges), np.maximum.reduceat(n, edges), np.maximum.reduceat(x, edges, axis=0)
        label = None if label is None else np.unique(label, return_inverse=True)[1]
        while True:
            self.levels.append((low, high, corner, _one(label, edges), _one(side, edges)))
            if len(low) == 1:
                break
            up = np.arange(0, len(low), FAN)
            low, high, corner = np.minimum.reduceat(low, up), np.maximum.reduceat(high, up), np.maximum.reduceat(corner, up, axis=0)
            edges = edges[::FAN]

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (i <= j) that may hold a link."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = np.concatenate([self._may(level, i[a : a + 4096], j[a : a + 4096], percent) for a in range(0, len(i), 4096)]) if len(i) else np.zeros(0, bool)
            i, j = i[keep], j[keep]
            if level and len(i):
                below = len(self.levels[level - 1][0])
                a, b = np.divmod(np.arange(FAN * FAN), FAN)
                i, j = (i[:, None] * FAN + a).ravel(), (j[:, None] * FAN + b).ravel()
                real = (i < below) & (j < below) & (i <= j)
                i, j = i[real], j[real]
        return i, j

    def _may(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        low, high, corner, label, side = self.levels[level]
        may = (low[j] * percent <= high[i] * 100) & (low[i] * percent <= high[j] * 100)
        for whole in (label, side):
            if whole is not None:
                may &= (whole[i] != whole[j]) | (whole[i] < 0)
        at = np.flatnonzero(may)
        most = np.minimum(corner[i[at]], corner[j[at]]).sum(axis=1, dtype=np.int64)
        may[at] = (100 + percent) * most >= percent * (low[i[at]] + low[j[at]])
        return may


def near_pairs(
    n: np.ndarray,
    x: np.ndarray,
    percent: int,
    label: np.ndarray | None,
    side: np.ndarray | None,
    best_only: bool,
    place: int = 0,
    places: np.ndarray | None = None,
    anchors: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points whose bound allows a link, by a join of an R-tree of all points with itself.

    label: only pairs of different labels. side: only pairs with one point of side 0 and one of side 1.
    best_only: of each point only the partner with the greatest bound for their sizes, in its leaf and the next, and of
    each of the points `anchors` the best of all others. places: the first places of each point; a pair that has one
    below `place` in common is left to that one.
    """
    x = _unbounded(x)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0] // 2, n)) if len(n) <= LEAF else _pack_order(n, x)
    if side is not None:
        order = order[np.argsort(side[order], kind="stable")]
    n, x = n[order], x[order]
    label, side, places, anchors = (None if v is None else v[order] for v in (label, side, places, anchors))
    if best_only:
        i = np.arange(-(-len(n) // LEAF))
        i, j = np.concatenate([i, i[:-1]]), np.concatenate([i, i[1:]])
    else:
        i, j = RTree(n, x, label, side).pairs(percent)
    best, mate = np.full(len(n), -1.0), np.full(len(n), -1)
    left, right = [], []
    for one, other in zip(i.tolist(), j.tolist(), strict=True):
        a, b = slice(one * LEAF, one * LEAF + LEAF), slice(other * LEAF, other * LEAF + LEAF)
        may = np.tri(*[len(n[a])] * 2, -1, dtype=bool) if one == other else np.ones((len(n[a]), len(n[b])), bool)
        if label is not None:
            may &= label[a][:, None] != label[b][None, :]
        if side is not None:
            may &= side[a][:, None] != side[b][None, :]
        if not may.any():
            continue
        bound, total = _bound(x[a], x[b]), n[a][:, None] + n[b][None, :]
        p, q = np.nonzero(may & ((100 + percent) * bound >= percent * total))
        if places is not None and len(p):
            u, v = places[a][p][:, :, None], places[b][q][:, None, :]
            here = ~((u == v) & (u < place)).any(axis=(1, 2))
            p, q = p[here], q[here]
        if not len(p):
            continue
        score = bound[p, q] / total[p, q]
        p, q = p + a.start, q + b.start
        if best_only:
            for at, partner in ((p, q), (q, p)):
                up = np.lexsort((-partner, score, at))
                last = np.append(np.flatnonzero(np.diff(at[up])), len(up) - 1)
                up = up[last]
                better = score[up] > best[at[up]]
                best[at[up[better]]], mate[at[up[better]]] = score[up[better]], partner[up[better]]
        else:
            left.append(p)
            right.append(q)
    if best_only:
        p = np.flatnonzero(mate >= 0)
        left, right = [p], [mate[p]]
        for at in np.flatnonzero(anchors).tolist() if anchors is not None else ():
            bound, total = np.minimum(x[at], x).sum(axis=1, dtype=np.int64), n[at] + n
            may = (100 + percent) * bound >= percent * total
            if places is not None:
                may &= ~((places[:, :, None] == places[at]) & (places[:, :, None] < place)).any(axis=(1, 2))
            may[at] = False
            for kind in (anchors, ~anchors):
                other = np.flatnonzero(may & kind)
                if len(other):
                    left.append(np.array([at]))
                    right.append(other[[(bound[other] / total[other]).argmax()]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _pack_order(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive packing: by size, then inside slabs by the two groups that vary most."""
    order = np.lexsort((np.arange(len(n)), n))
    leaves = -(-len(n) // LEAF)
    slab = LEAF * max(1, round(leaves ** (2 / 3)))
    a, b = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")[:2]
    out = []
    for s in range(0, len(n), slab):
        part = order[s : s + slab]
        part = part[np.argsort(x[part, a], kind="stable")]
        tile = LEAF * max(1, round(leaves ** (1 / 3)))
        out += [part[t : t + tile][np.argsort(x[part[t : t + tile], b], kind="stable")] for t in range(0, len(part), tile)]
    return np.concatenate(out)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Consecutive rows as tables that never cut a run of equal values in `column`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy()
        if value[0] == value[-1]:
            if held and held[-1].column(column)[-1].as_py() != value[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        cut = int(np.flatnonzero(value != value[-1])[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def link_components(docs: DataFrame, k: int = 3, percent: int = 90, bucket_bytes: int = 8 << 20, degrees: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, and with `degrees` n_links, for every row of `docs` (doc_id, text).

    A-Z is lower-cased, words are `[^\\x20\\x09-\\x0D]+`; a set holds the distinct k-word shingles, for fewer
    words the whole sequence as one. Two documents link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable by links; n_links is the number of all different sets
    that the document's own is linked with (copies aside), which takes time by the square of a group's size.

    Edge cases: null and empty texts, and texts without words, have an empty set and are linked with nothing,
    each its own component; a null doc_id stays null and never names a component of others; repeated rows
    get equal results; other columns of `docs` do not matter. Sets are told apart and compared by 64-bit
    hashes.
    """
    shared_dir(docs.sparkSession)
    with batches_of(docs.sparkSession, 250):
        return _link(docs, k, percent, bucket_bytes, degrees)


def _link(docs: DataFrame, k: int, percent: int, bucket_bytes: int, degrees: bool) -> DataFrame:
    """The work of link_components. All plans with Python end in a checkpoint, so none runs after it returns."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    # buckets grow with the square root of the text, so that messages to them stay long
    buckets = max(4, -(-text_bytes // max(bucket_bytes, int((text_bytes * LEAST_MESSAGE) ** 0.5))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                sets = Sets(part.column("text"), k)
                points = sets.points()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sets.n.astype(np.int64)), pa.array(sets.node()), pa.array([p.tobytes() for p in points], pa.binary())], ["doc_id", "n", "node", "point"]
                )

    described = rows.mapInArrow(counted_only(describe), "doc_id long, n long, node long, point binary").checkpoint()
    nodes = described.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("point").alias("point"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, who = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket, low = _bucket(key, buckets), key & _U(0xFFFFFFFF)
            order = np.lexsort((who, low, bucket))
            bucket, low, who = bucket[order], low[order], who[order]
            new = np.append(True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]))
            new_who = new | np.append(True, who[1:] != who[:-1])
            bucket, low, who, new = bucket[new_who], low[new_who], who[new_who], new[new_who]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(low)))
            hot = np.flatnonzero(size > HOT)
            # nodes of a hot key go straight to its place; in the bucket one entry says so
            gone = np.repeat(size > HOT, size)
            direct = [who[start[k] : start[k] + size[k]] for k in hot]
            who = who.copy()
            who[start[hot]], gone[start[hot]] = ELSEWHERE, False
            bucket, low, who, at = bucket[~gone], low[~gone], who[~gone], (bucket[start[hot]], low[start[hot]])
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            cuts = [slice(edges[b], edges[b + 1]) for b in full]
            own = -1 - (mix(np.array([d[0] for d in direct], np.int64).view(_U)) >> _U(34)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([full.astype(np.int32), own])),
                    pa.array([_squeeze(low[c].astype(np.uint32)) for c in cuts] + [b""] * len(hot), pa.binary()),
                    pa.array([who[c].tobytes() for c in cuts] + [d.tobytes() for d in direct], pa.binary()),
                    pa.array(np.concatenate([np.zeros(len(full), np.int64), _place_of(*at)])),
                ],
                ["bucket", "keys", "who", "place"],
            )

        for batch in batches:
            for part in slices(batch, "text", STEP):
                sets = Sets(part.column("text"), k)
                name = sets.node()
                node, one = np.unique(name, return_index=True)
                row, key = routes(sets, one[node != 0], percent)
                if len(key):
                    held.append((key, name[row]))
            if sum(len(key) for key, _ in held) >= GATHERED:
                yield flush()
        if held:
            yield flush()

    def gather(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            whole = [np.frombuffer(x, np.int64) for x in group.column("who").to_pylist()]
            return pa.table({"place": pa.array(np.repeat(group.column("place").to_numpy(), [len(w) for w in whole])), "node": pa.array(np.concatenate(whole))})
        key = np.concatenate([_expand(x, np.uint32) for x in group.column("keys").to_pylist()])
        who = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("who").to_pylist()])
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[new], who[new]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(start, len(key)))
        place = mix(np.add.reduceat(mix(who.view(_U)), start) + count.astype(_U)).view(np.int64)
        hot = np.logical_or.reduceat(who == ELSEWHERE, start)
        place[hot] = _place_of(_U(bucket), key[start[hot]].astype(_U))
        several = np.repeat((count > 1) | hot, count) & (who != ELSEWHERE)
        place = np.repeat(place, count)[several]
        who = who[several]
        order = np.lexsort((who, place))
        place, who = place[order], who[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (who[1:] != who[:-1])
        return pa.table({"place": pa.array(place[new], pa.int64()), "node": pa.array(who[new], pa.int64())})

    met = rows.mapInArrow(counted_only(send), "bucket int, keys binary, who binary, place long").groupBy("bucket").applyInArrow(slim(gather), "place long, node long").distinct()
    parts = F.ceil(F.col("members") / PART).cast("int")
    members = met.join(met.groupBy("place").agg(F.count("*").alias("members")), "place").checkpoint()
    del met
    release(spark)
    firsts = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("place")), 1, FIRST).alias("firsts"))
    points = members.join(nodes.select("node", "n", "point").join(firsts, "node"), "node")
    cells = F.ceil(F.col("members") / CELL).cast("int")
    by_hash = Window.partitionBy("place").orderBy(F.xxhash64("node"), "node")
    anchors = members.where(F.col("members") > CELL).withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= ANCHORS).select("place", "node", F.lit(True).alias("anchor"))
    marked = points.join(anchors, ["place", "node"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    every = F.when(F.col("anchor"), F.sequence(F.lit(0), cells - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), cells).cast("int")))
    lone = marked.withColumn("cell", F.explode(every)).withColumn("task", F.xxhash64("place", "cell")).withColumn("side", F.lit(-1))

    def dealt(points: DataFrame) -> DataFrame:
        """A large place is a triangle of part pairs; each point goes to the pairs of its own part."""
        cell = F.pmod(F.xxhash64("node"), parts).cast("int")
        each = points.withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        whole = (parts == 1) | (F.col("cell") == F.col("other"))
        return each.withColumn("task", F.xxhash64("place", F.least("cell", "other"), F.greatest("cell", "other"))).withColumn(
            "side", F.when(whole, F.lit(-1)).otherwise((F.col("cell") > F.col("other")).cast("int"))
        )

    def pairs(where: DataFrame, labelled: bool, best_only: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _runs(batches, "task"):
                task, node, n = (table.column(c).to_numpy() for c in ("task", "node", "n"))
                x = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, DIMENSIONS)
                side, place = table.column("side").to_numpy(), table.column("place").to_numpy()
                firsts = np.full((len(node), FIRST), np.iinfo(np.int64).max)
                lists = table.column("firsts").combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy())
                firsts[np.arange(FIRST) < sizes[:, None]] = lists.flatten().to_numpy()
                label = table.column("label").to_numpy() if labelled else None
                anchor = table.column("anchor").to_numpy(zero_copy_only=False) if best_only else None
                edges = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
                out_a, out_b = [], []
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if z - a < 2 or (labelled and (label[a:z] == label[a]).all()):
                        continue
                    own = side[a:z]
                    p, q = near_pairs(n[a:z], x[a:z], percent, label[a:z] if labelled else None, None if own[0] < 0 else own, best_only, place[a], firsts[a:z], anchor[a:z] if best_only else None)
                    out_a.append(node[a:z][p])
                    out_b.append(node[a:z][q])
                a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        columns = ["task", "node", "n", "point", "side", "place", "firsts", *(["label"] if labelled else []), *(["anchor"] if best_only else [])]
        spread = where.select(*columns).repartition("task").sortWithinPartitions("task", "place", "n", "node")
        return spread.mapInArrow(counted_only(run), "a long, b long").distinct()

    def verified(candidates: DataFrame) -> DataFrame:
        """Of the candidate pairs those that really link."""
        candidates = candidates.checkpoint()
        ends = candidates.select(F.explode(F.array("a", "b")).alias("node"))
        # a filter of fixed size says whose sets may be needed; the joins below decide
        word, bit = F.pmod("node", F.lit(FILTER_WORDS)).cast("int"), F.pmod(F.shiftright("node", 40), F.lit(64)).cast("int")
        bits = ends.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m"))
        filled = bits.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        need = np.zeros(FILTER_WORDS, np.int64)
        need[filled.column("w").to_numpy()] = filled.column("m").to_numpy()
        needed = spark.sparkContext.broadcast(need)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            need = needed.value
            for batch in batches:
                for part in slices(batch, "text", STEP):
                    sets = Sets(part.column("text"), k)
                    node, one = np.unique(sets.node(), return_index=True)
                    hit = (need[node % FILTER_WORDS] >> ((node >> 40) % 64)) & 1 == 1
                    hit &= node != 0
                    body = [sets.h[sets.first[r] : sets.first[r + 1]].tobytes() for r in one[hit]]
                    yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(body, pa.binary())], ["node", "body"])

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    u, v = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                    both = np.concatenate([u, v])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                chosen = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], ["a", "b"])

        sets = rows.mapInArrow(counted_only(pick), "node long, body binary").dropDuplicates(["node"])
        left = candidates.join(sets.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
        linked = both.select("a", "b", "x", "y").mapInArrow(counted_only(decide), "a long, b long").checkpoint()
        del sets, left, both
        release(spark)
        return linked

    large = F.col("members") > SMALL
    if degrees:
        links = verified(pairs(dealt(points), False, False))
    else:
        links = verified(pairs(lone.where(~large), False, False).unionByName(pairs(lone.where(large), False, True)).distinct())
        if not members.where(large).isEmpty():
            known = components(links).withColumnRenamed("root", "label")
            labelled = members.where(large).join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed = labelled.groupBy("place").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("place")
            apart = labelled.join(mixed, "place").checkpoint()  # only places that hold several components
            if not apart.isEmpty():
                apart = apart.join(nodes.select("node", "n", "point").join(firsts, "node"), "node")
                links = links.unionByName(verified(pairs(dealt(apart), True, False))).distinct().checkpoint()
    joined = components(links)
    # singletons are their own component; those of others are named in parts, as one of them may hold most nodes
    reps = nodes.select("node", "rep").join(joined, "node", "left").select("node", "rep", "root", F.coalesce("root", "node").alias("key"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    least = reps.where("root is not null").groupBy(F.col("root").alias("key")).agg(F.min("rep").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = reps.join(least, ["key", "salt"], "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    full = described.where("n > 0").join(named, "node").select("node", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = described.where("n = 0").select("node", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = full.unionByName(empty)
    if not degrees:
        return rows.drop("node")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return rows.join(degree, "node", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
