"""Approximate nearest neighbours by inner product: balanced posting lists around centroids.

* Inner product becomes nearness of directions in one more dimension: v gains sqrt(M^2 - |v|^2), with M the
  largest norm, so that all points lie on one sphere.
* Equal vectors are one point that carries its smallest ids: k + 1 of them always suffice, since
  equal scores are ordered by id. A vector shared by a third of all rows is thus one point.
* Lists come from a tree of centroids that is split where it is too full: Spark counts the points of every
  leaf, and each leaf of more than twice `list_size` points is divided by balanced splitting of a bounded
  sample of its own points, until none is left. So there are about as many lists as points / list_size.
* A point goes to its leaf and, where neighbouring lists are within `closure` of that distance, to those too.
* Queries search a neighbour graph over the centroids, held in memory by each worker, and keep every list
  whose distance is within `ratio` of that of their `rank`-th nearest list. Scores are exact, in double
  precision, on the original vectors.
* Neighbouring lists lie in shards of about `block` points. A query is sent once to each shard, with the lists
  it wants there; only a shard that very many queries want is copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir


@dataclass
class Tree:
    """Centroids by node; the children of a node are consecutive, a leaf has none, node 0 is the root."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def root(cls, dim: int) -> Tree:
        return cls(np.zeros((1, dim), np.float32), np.zeros(1, np.int64), np.zeros(1, np.int64))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x: from the root always to the nearest child."""
        at = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.count[at] > 0)):
            order = inner[np.argsort(at[inner], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                first = self.first[at[rows[0]]]
                c = self.centre[first : first + self.count[at[rows[0]]]]
                at[rows] = first + (x[rows] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        return at

    def split(self, parts: dict[int, np.ndarray]) -> Tree:
        """The tree with children at the given leaves."""
        centre, first, count, size = [self.centre], self.first.copy(), self.count.copy(), len(self.first)
        for node, c in sorted(parts.items()):
            first[node], count[node] = size, len(c)
            centre.append(c.astype(np.float32))
            size += len(c)
        more = size - len(first)
        return Tree(np.concatenate(centre), np.append(first, np.zeros(more, np.int64)), np.append(count, np.zeros(more, np.int64)))


@dataclass
class Index:
    """The tree, its leaves as lists (centroids in the lifted space), the number of each leaf's list, and the lists' neighbour graph."""

    tree: Tree
    centroids: np.ndarray
    number: np.ndarray
    graph: np.ndarray

    @classmethod
    def of(cls, tree: Tree, degree: int = 24, spark: SparkSession | None = None) -> Index:
        """The index of a tree's leaves; with a session the neighbour graph is made in tasks."""
        leaves = np.flatnonzero(tree.count == 0)
        number = np.zeros(len(tree.count), np.int64)
        number[leaves] = np.arange(len(leaves))
        c = tree.centre[leaves]
        return cls(tree, c, number, neighbour_graph(c, degree) if spark is None else _graph_in_tasks(spark, c, degree))


def lift(v: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most * most - (v * v).sum(axis=1), 0.0))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def balanced_centroids(points: np.ndarray, groups: int, seed: int = 0) -> np.ndarray:
    """Means of about `groups` groups of nearly equal size: each group is halved along the line between two means."""
    size = max(1, -(-len(points) // max(1, groups)))
    r, stack, out = np.random.default_rng(seed), [np.arange(len(points))], []
    while stack:
        at = stack.pop()
        x = points[at]
        if len(at) <= size:
            out.append(x.mean(axis=0))
            continue
        a, b = x[r.choice(len(at), 2, replace=False)]
        for _ in range(6):
            side = x @ (a - b)
            left = side >= np.median(side)
            if left.all() or not left.any():
                break
            a, b = x[left].mean(axis=0), x[~left].mean(axis=0)
        order = np.argsort(x @ (a - b), kind="stable")
        half = size * max(1, round(len(at) / size / 2))
        stack += [at[order[:half]], at[order[half:]]]
    c = np.asarray(out, np.float32)
    for _ in range(4 if len(c) > 1 else 0):  # moved to the means of what is nearest to them
        own = (points @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, own, points)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


#: Distances between centroids that are held at a time.
HELD = 1 << 23


def _nearest(c: np.ndarray, rows: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest other centroids of the centroids `rows`."""
    near, step, norm = np.zeros((len(rows), degree), np.int32), max(1, HELD // len(c)), (c * c).sum(axis=1)
    for a in range(0, len(rows) if degree else 0, step):
        some = rows[a : a + step]
        d = -2 * c[some] @ c.T + norm
        d[np.arange(len(some)), some] = np.inf
        near[a : a + step] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    return near


def _ringed(near: np.ndarray) -> np.ndarray:
    """Neighbours, plus links that keep the graph in one piece."""
    n = len(near)
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1).astype(np.int32)
    return np.concatenate([near, ring], axis=1)


def neighbour_graph(c: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest other centroids of each, plus links that keep the graph in one piece."""
    return _ringed(_nearest(c, np.arange(len(c)), min(degree, len(c) - 1)))


def _graph_in_tasks(spark: SparkSession, c: np.ndarray, degree: int) -> np.ndarray:
    """The same graph, its rows found in tasks; the driver gathers `degree` numbers for each list."""
    n, degree = len(c), min(degree, len(c) - 1)
    shared = spark.sparkContext.broadcast(c)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("id").to_numpy()
            near = _nearest(shared.value, rows, degree)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in near], pa.binary())], ["id", "near"])

    found = spark.range(0, n, 1, max(1, min(4096, n // 256))).mapInArrow(find, "id long, near binary").toArrow()
    near = np.zeros((n, degree), np.int32)
    near[found.column("id").to_numpy()] = np.frombuffer(b"".join(found.column("near").to_pylist()), np.int32).reshape(n, degree)
    return _ringed(near)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(((x - c) ** 2).sum(axis=-1), 0)


def lists_of_points(index: Index, x: np.ndarray, copies: int, closure: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, list) pairs: each point's own list, and of its neighbours in the graph those within `closure` of its distance, `copies` lists at most."""
    own = index.number[index.tree.leaf(x)]
    near = np.concatenate([own[:, None], index.graph[own]], axis=1)
    d = _squared(x[:, None, :], index.centroids[near])
    limit = (1 + closure) ** 2 * d[:, :1] + 1e-12
    d[:, 1:][near[:, 1:] == own[:, None]] = np.inf
    order = np.argsort(d[:, 1:], axis=1, kind="stable") + 1
    keep = np.concatenate([np.zeros((len(x), 1), np.int64), order[:, : copies - 1]], axis=1)
    near, d = np.take_along_axis(near, keep, axis=1), np.take_along_axis(d, keep, axis=1)
    near[d > limit] = -1
    near = np.sort(near, axis=1)
    fresh = np.concatenate([np.ones((len(x), 1), bool), near[:, 1:] != near[:, :-1]], axis=1) & (near >= 0)
    point, slot = np.nonzero(fresh)
    return point, near[point, slot]


def _least(best: np.ndarray, row: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The smallest distances of each row, sorted: those of `best` and the new ones d."""
    order = np.lexsort((d, row))
    row, d = row[order], d[order]
    turn = np.arange(len(row)) - np.searchsorted(row, row)
    row, d, turn = (x[turn < best.shape[1]] for x in (row, d, turn))
    new = np.full(best.shape, np.inf)
    new[row, turn] = d
    return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, : best.shape[1]]


def lists_of_queries(index: Index, x: np.ndarray, ratio: float, rank: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) pairs: every list found within `ratio` of the distance of the query's `rank`-th nearest list.

    The graph is searched outwards from the query's own leaf and some scattered lists, all queries at once; a
    list is left as soon as it is farther than that.
    """
    c, graph, n = index.centroids, index.graph, len(index.centroids)
    scattered = np.unique(np.linspace(0, n - 1, min(n, 24)).astype(np.int64))
    starts = np.concatenate([index.number[index.tree.leaf(x)][:, None], np.broadcast_to(scattered, (len(x), len(scattered)))], axis=1)
    seen, best = np.zeros(len(x) * n, bool), np.full((len(x), min(rank, n)), np.inf)
    key, found = np.unique(starts + np.arange(len(x))[:, None] * n), []
    while len(key):
        seen[key] = True
        row, at = key // n, key % n
        d = _squared(x[row], c[at])
        best = _least(best, row, d)
        near = d <= ratio * ratio * best[row, -1] + 1e-12
        found.append((row[near], at[near], d[near]))
        key = np.unique((row[near] * n)[:, None] + graph[at[near]])
        key = key[~seen[key]]
    row, at, d = (np.concatenate(part) for part in zip(*found, strict=True))
    near = d <= ratio * ratio * best[row, -1] + 1e-12
    return row[near], at[near]


def grow(points: DataFrame, scale: float, dim: int, list_size: int, sample_rows: int, fan: int, rounds: int = 12) -> tuple[Tree, np.ndarray]:
    """The tree over `points` (p, v), and the number of points of every node that is a leaf.

    In each round Spark counts the points of the leaves and takes about `sample_rows` points of each leaf that is too
    full, chosen by their hash p where they lie; its children are fitted in the task that gets them. A leaf that is still
    too full after the last round stays so: its list is longer, and the search reads all of it.
    """
    spark = points.sparkSession
    tree = Tree.root(dim + 1)
    while True:
        shared = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = shared.value.leaf(lift(_matrix(batch.column("v")) / scale, 1.0))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("p"), batch.column("v")], ["leaf", "p", "v"])

        placed = points.select("p", "v").mapInArrow(place, "leaf long, p long, v array<double>")
        held = np.zeros(len(tree.count), np.int64)
        for leaf, n in placed.groupBy("leaf").count().collect():  # a row for each list at most
            held[leaf] = n
        full = np.flatnonzero(held > 2 * list_size)
        rounds -= 1
        if not len(full) or not rounds:
            return tree, held
        wanted = spark.sparkContext.broadcast(held)

        def fit(group: pa.Table) -> pa.Table:
            leaf = group.column("leaf")[0].as_py()
            group = group.sort_by("p")
            c = balanced_centroids(lift(_matrix(group.column("v").combine_chunks()) / scale, 1.0), min(fan, -(-int(wanted.value[leaf]) // list_size)))
            return pa.table({"leaf": pa.array([leaf] * len(c), pa.int64()), "c": pa.array(list(c), pa.list_(pa.float32()))})

        share = [(leaf, int(min(1.0, sample_rows / held[leaf]) * (1 << 30))) for leaf in full.tolist()]
        crowded = spark.createDataFrame(share, "leaf long, share long")  # a row for each list at most
        sample = placed.join(F.broadcast(crowded), "leaf").where(F.pmod("p", F.lit(1 << 30)) < F.col("share")).drop("share")
        fitted = sample.groupBy("leaf").applyInArrow(fit, "leaf long, c array<float>").toArrow()  # as many rows as new lists
        of, c = fitted.column("leaf").to_numpy(), _matrix(fitted.column("c").combine_chunks())
        tree = tree.split({int(leaf): c[of == leaf] for leaf in np.unique(of)})


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    sample_rows: int = 20_000,
    list_size: int = 24,
    most_lists: int = 400_000,
    copies: int = 3,
    closure: float = 0.01,
    rank: int = 8,
    ratio: float = 1.14,
    block: int = 4096,
    query_block: int = 16_384,
) -> DataFrame:
    """The k nearest of `vectors` for each of `queries` (same columns): query_id, rank from 1, vec_id, score.

    A candidate with the query's own id is left out. Nearest first, equal scores by the smaller id;
    all candidates found, if fewer than k. Vectors that are null, empty, zero, of another length than
    most rows have, or that hold null or non-finite components take no part on either side; a repeated
    (id, vector) row counts once; other columns do not matter. Centroids are fitted on bounded samples
    (about `sample_rows` points of each part of the tree); every row is indexed. `most_lists` bounds the centroids
    that driver and workers hold (400,000 of 65 floats are 104 MB, and 42 MB of graph): beyond list_size * most_lists points, lists get longer.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vector_column).cast("array<double>")
        sound = F.col(vector_column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(id_column).isNotNull() & sound).select(F.col(id_column).cast("long").alias(name), v.alias("v"))

    rows = usable(vectors, "id")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0]["dim"]
    rows = rows.where(F.size("v") == dim)
    asked = usable(queries, "id").where(F.size("v") == dim)
    by_vector = Window.partitionBy("v").orderBy("id")
    # the smallest k + 1 ids of each distinct vector; the limit is applied before the shuffle too
    points = (
        rows.distinct()
        .withColumn("n", F.row_number().over(by_vector))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.xxhash64("v").alias("p"), "v", "ids")
    )
    shared_dir(spark)
    points = points.checkpoint()
    size = points.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("most")).collect()[0]
    scale = size["most"] or 1.0
    tree, held = grow(points, scale, dim, max(list_size, -(-size["n"] // most_lists)), sample_rows, 128)
    index = Index.of(tree, spark=spark)
    # shards: runs of neighbouring lists with about `block` points
    shard = np.cumsum(held[tree.count == 0]) // block
    shared, shards = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(shard)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                point, at = lists_of_points(shared.value, lift(_matrix(batch.column("v")) / scale, 1.0), copies, closure)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards.value[at], pa.int64()), pa.array(at, pa.int64()), *(batch.column(x).take(pa.array(point)) for x in ("p", "v", "ids"))], ["shard", "list", "p", "v", "ids"]
                )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                x = lift(_matrix(batch.column("v")) / scale, 1.0)
                x[:, -1] = 0  # a query is a direction: only the inner product with the original part counts
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                row, at = lists_of_queries(shared.value, x, ratio, rank)
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                to = shards.value[at]
                start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (to[1:] != to[:-1])))
                wanted = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(at, pa.int64()))
                take = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([pa.array(to[start], pa.int64()), batch.column("p").take(take), batch.column("v").take(take), wanted], ["shard", "p", "v", "wanted"])

    posted = points.mapInArrow(post, "shard long, list long, p long, v array<double>, ids array<bigint>")
    questions = asked.groupBy("v").agg(F.lit(1).alias("_")).select(F.xxhash64("v").alias("p"), "v")
    questions = questions.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p")  # few bytes, but much work each
    routed = questions.mapInArrow(route, "shard long, p long, v array<double>, wanted array<bigint>").checkpoint()
    # a shard that more than `query_block` questions want is copied for each block of them
    turns = routed.groupBy("shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("turns"))
    routed = routed.join(turns, "shard").withColumn("turn", F.pmod("p", "turns").cast("int")).drop("turns")
    posted = posted.join(turns, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"qp": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by("list")
        _, one, column = np.unique(right.column("p").to_numpy(), return_index=True, return_inverse=True)  # a point may be in several lists
        x, lists = _matrix(right.column("v").combine_chunks()), right.column("list").to_numpy()
        keep, out = min(k + 1, len(one)), []
        for a in range(0, left.num_rows, 256):
            some = left.slice(a, 256)
            q, wanted = _matrix(some.column("v").combine_chunks()), some.column("wanted").combine_chunks()
            of, at = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
            order = np.argsort(at, kind="stable")
            of, at = of[order], at[order]
            score = np.full((len(q), len(one)), -np.inf)
            for which in np.unique(at).tolist():
                rows = of[np.searchsorted(at, which) : np.searchsorted(at, which, side="right")]
                y = slice(np.searchsorted(lists, which), np.searchsorted(lists, which, side="right"))
                score[rows[:, None], column[y]] = q[rows] @ x[y].T
            # all that reach the (k + 1)-th score: ties at the border must not be lost
            least = np.partition(score, len(one) - keep, axis=1)[:, len(one) - keep]
            row, p = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            place = pa.array(one[p])
            out.append(pa.table({"qp": some.column("p").take(pa.array(row)), "p": right.column("p").take(place), "score": pa.array(score[row, p]), "ids": right.column("ids").take(place)}))
        return pa.concat_tables(out).cast(empty.schema)

    met = routed.groupBy("shard", "turn").cogroup(posted.groupBy("shard", "turn")).applyInArrow(meet, "qp long, p long, score double, ids array<bigint>")
    # a point may come from several shards: once, then the best k + 1 points of each question
    best = Window.partitionBy("qp").orderBy(F.desc("score"), F.element_at("ids", 1))
    found = met.dropDuplicates(["qp", "p"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ids = found.select("qp", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("qp").orderBy(F.desc("score"), "vec_id")
    answers = ids.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    answers = answers.groupBy("qp").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    each = asked.distinct().select(F.col("id").alias("query_id"), F.xxhash64("v").alias("qp")).join(answers, "qp")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(own).alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
