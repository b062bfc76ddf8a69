"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links (a, b), and the smallest end reachable from it."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return ends, ends[root]


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root: every end of `links` (a, b: long) with the smallest end of its component.

    Each partition first joins its own links into stars; then labels spread along the remaining links and
    along each other (pointer jumping), so long chains take few rounds. Every round is checkpointed.
    """
    shared_dir(links.sparkSession)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, root = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    stars = links.where("a <> b").select("a", "b").mapInArrow(shrink, "a long, b long")
    edges = stars.where("a <> b").unionByName(stars.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")).checkpoint()
    for _ in range(rounds):
        near = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, label["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        # what a node learns, its former root learns too, and then all jump to their root's root
        told = hooked.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        low = hooked.join(told, "node", "left").select("node", "root", F.least("low", F.coalesce("told", "low")).alias("low"))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        new = low.join(up, "low", "left").select("node", F.col("root").alias("was"), F.coalesce("jump", "low").alias("root")).checkpoint()
        moved = new.where("was <> root").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
