"""The linear probe: balanced multinomial logistic regression, and what is read from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rounded
from tidemark.operators import intervals, windows


def capped_sample(rows: DataFrame, label: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each label, those with the smallest hash of their key: the same in every run."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def split(rows: DataFrame, label: str, key: str, share: float = 0.75, seed: int = 0) -> DataFrame:
    """`rows` with `train`: in each label the first `share` by hash."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("train", F.percent_rank().over(order) < share)


def fit(rows: DataFrame, c: float = 100.0, iterations: int = 300) -> LogisticRegressionModel:
    """rows: emb, label (integers from 0). Balanced class weights n / (K * n_c), so that they add up to n."""
    total = rows.count()
    counts = rows.groupBy("label").count()
    k = counts.count()
    weighted = rows.join(F.broadcast(counts), "label").select(
        F.col("label").cast("double").alias("label"), array_to_vector(F.col("emb").cast("array<double>")).alias("features"), (F.lit(float(total)) / (k * F.col("count"))).alias("weight")
    )
    return LogisticRegression(family="multinomial", standardization=False, weightCol="weight", regParam=1.0 / (c * total), maxIter=iterations).fit(weighted)


def predict(model: LogisticRegressionModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` with p, the probability of each label."""
    features = rows.withColumn("features", array_to_vector(F.col("emb").cast("array<double>")))
    return model.transform(features).select(*keep, vector_to_array("probability").alias("p"))


def anomaly(p: Column, normal: int = 0) -> Column:
    """1 - p(normal); 0 where there is no opinion."""
    return F.coalesce(1 - F.get(p, F.lit(normal)), F.lit(0.0))


def curve(frames: DataFrame, weights: DataFrame, span: float, step: float, k: int = 8) -> DataFrame:
    """video_id, t, score: a linear score of the mean vector of the frames within span / 2 of every step-th time, of k even ones where there are more.

    frames: video_id, event_id, t, emb; weights: one row with w (array<double>) and b.
    """
    bounds = frames.groupBy("video_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    at = bounds.select("video_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int")), lambda i: F.col("lo") + i * step)).alias("c"))
    spans = at.withColumns({"lo": F.col("c") - span / 2, "hi": F.col("c") + span / 2})
    keys = frames.select("video_id", "event_id", "t")  # vectors come in only for the frames that are picked
    near = windows.pick(intervals.points_in(keys, spans, "lo", "hi", span), k, ("video_id", "c")).select("video_id", "c", "event_id")
    near = near.join(frames.select("video_id", "event_id", "emb"), ["video_id", "event_id"])
    mean = near.select("video_id", "c", F.posexplode("emb").alias("i", "x")).groupBy("video_id", "c", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    scored = mean.groupBy("video_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.col("b"), lambda s, x: s + x)
    return scored.withColumns({"w": weights.select("w").scalar(), "b": weights.select("b").scalar()}).select("video_id", rounded("c", 2).alias("t"), rounded(1 / (1 + F.exp(-score)), 4).alias("score"))


#: A model slot: takes and returns batches; `None` from a slot means no opinion.
Encoder = Callable[[pd.Series], pd.Series]


def embed(rows: DataFrame, encoder: Encoder, column: str = "payload") -> DataFrame:
    """`rows` with emb, from a pluggable encoder that runs on Arrow batches and is loaded once in each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    return rows.withColumn("emb", run.asNondeterministic()(F.col(column)))  # so that no later filter calls the model again


def verify(windows: DataFrame, verifier: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """`windows` with reply, the text of a pluggable verifier on each window; a window on which it fails is dropped."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return verifier(rows)

    return windows.withColumn("reply", run.asNondeterministic()(F.struct(*columns))).where("reply is not null")
