"""Signed top-k similarity, class ranking, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dot


def health(frames: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """frame_id, health: the sum of w * similarity over the k most similar rules.

    rules: rule_id, w, emb: a pool of fixed size (some hundred rows), held as one array constant, so that a
    frame is scored in its own row, without a join, a shuffle or a Python worker.
    """
    pool = rules.agg(F.array_sort(F.collect_list(F.struct("rule_id", "w", "emb"))).alias("pool"))
    scored = frames.withColumn("_pool", pool.scalar()).select(
        "frame_id", F.transform("_pool", lambda r: F.struct((-dot(F.col("emb"), r["emb"])).alias("d"), r["rule_id"].alias("rule_id"), r["w"].alias("w"))).alias("s")
    )
    return scored.select("frame_id", F.aggregate(F.slice(F.array_sort("s"), 1, k), F.lit(0.0), lambda a, r: a - r["w"] * r["d"]).alias("health"))


def shortlist(vectors: DataFrame, owners: DataFrame, k: int = 5, learned: DataFrame | None = None) -> DataFrame:
    """vector_id, class, best, rank: the k classes with the most similar owned vector; ties by class order. owners: class, emb, a fixed pool.

    learned: vector_id, class, p: a probe's opinions; a vector that has some is ranked by them alone, normal left out, and a
    column `learned` says so.
    """
    pool = owners.agg(F.collect_list(F.struct("class", "emb")).alias("pool"))
    each = vectors.withColumn("_pool", pool.scalar()).select("vector_id", F.explode(F.transform("_pool", lambda o: F.struct(o["class"].alias("class"), dot(F.col("emb"), o["emb"]).alias("sim")))).alias("o"))
    best = each.groupBy("vector_id", F.col("o.class").alias("class")).agg(F.max("o.sim").alias("best"))
    if learned is not None:
        known = learned.select("vector_id").distinct()
        own = learned.where("class <> 'normal'").select("vector_id", "class", F.col("p").alias("best"), F.lit(True).alias("learned"))
        best = best.join(known, "vector_id", "left_anti").withColumn("learned", F.lit(False)).unionByName(own)
    rank = F.row_number().over(Window.partitionBy("vector_id").orderBy(F.desc("best"), "class"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_vector(vectors: DataFrame, key: str) -> DataFrame:
    """key, mean: element-wise mean of emb in double precision, by position and so with partial aggregation."""
    by_place = vectors.select(key, F.posexplode("emb").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by_place.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
