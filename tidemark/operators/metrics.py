"""Scoring and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import marks, rounded
from tidemark.operators.frames import percentiles


def truth_rollup(truth: DataFrame) -> DataFrame:
    """video_id, is_anomaly, classes (sorted, without normal and null)."""
    named = F.when(F.col("class_name") != "normal", F.col("class_name"))
    return truth.groupBy("video_id").agg(F.bool_or("is_anomaly").alias("is_anomaly"), F.array_sort(F.collect_set(named)).alias("classes"))


def truth_label(rollup: DataFrame) -> DataFrame:
    """video_id, label: the anomaly classes joined by a comma, else normal."""
    return rollup.select("video_id", F.when(F.size("classes") > 0, F.array_join("classes", ", ")).otherwise("normal").alias("label"))


def truth_labels(videos: DataFrame, rollup: DataFrame) -> DataFrame:
    """video_id, label of every video: that of the roll-up, or that it has no truth, or that nothing has."""
    any_truth = rollup.agg(F.count("*")).scalar() > 0
    none = F.when(any_truth, "no ground truth").otherwise("unknown (no truth in this pack)")
    return videos.select("video_id").join(truth_label(rollup), "video_id", "left").select("video_id", F.coalesce("label", none).alias("label"))


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs: truth, said (boolean): tp, fp, fn, tn, precision, recall, f1, false_alarm_rate."""
    counts = pairs.agg(
        F.count_if(F.col("truth") & F.col("said")).alias("tp"),
        F.count_if(~F.col("truth") & F.col("said")).alias("fp"),
        F.count_if(F.col("truth") & ~F.col("said")).alias("fn"),
        F.count_if(~F.col("truth") & ~F.col("said")).alias("tn"),
    )
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    counts = counts.withColumns({"precision": p, "recall": r, "false_alarm_rate": F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))})
    return counts.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def video_outcomes(rollup: DataFrame, predictions: DataFrame) -> DataFrame:
    """video_id, outcome: found, wrong-class, missed, false-alarm or true-normal; videos without a prediction are unanswered."""
    both = rollup.join(predictions.select("video_id", "said_anomaly", "said_class"), "video_id", "left")
    return both.select(
        "video_id",
        "is_anomaly",
        F.when(F.col("said_anomaly").isNull(), "unanswered")
        .when(F.col("is_anomaly") & F.col("said_anomaly"), F.when(F.array_contains("classes", F.col("said_class")), "found").otherwise("wrong-class"))
        .when(F.col("is_anomaly"), "missed")
        .when(F.col("said_anomaly"), "false-alarm")
        .otherwise("true-normal")
        .alias("outcome"),
    )


def video_score(outcomes: DataFrame) -> DataFrame:
    """found, total (all anomalous videos, answered or not), fa (wrong classes too), missed, tn, wrong_class."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count_if(o == "found").alias("found"),
        F.count_if("is_anomaly").alias("total"),
        F.count_if(o.isin("wrong-class", "false-alarm")).alias("fa"),
        F.count_if(o == "missed").alias("missed"),
        F.count_if(o == "true-normal").alias("tn"),
        F.count_if(o == "wrong-class").alias("wrong_class"),
    )


def level_scores(scores: DataFrame) -> DataFrame:
    """scores (level, found, total, fa) with precision, recall and estimated marks."""
    return scores.select(
        "level",
        "found",
        "total",
        "fa",
        (F.col("found") / F.greatest(F.col("found") + F.col("fa"), F.lit(1))).alias("precision"),
        (F.col("found") / F.greatest("total", F.lit(1))).alias("recall"),
        marks(F.col("level"), F.col("found"), F.col("fa")).alias("marks"),
    )


def score_table(scores: DataFrame) -> DataFrame:
    """level_scores of `scores` and a total row (level null): counts and marks added up, precision and recall of the sums."""
    each = level_scores(scores)
    found, total, fa = (F.sum(c) for c in ("found", "total", "fa"))
    whole = each.agg(
        F.lit(None).cast("int").alias("level"),
        found.alias("found"),
        total.alias("total"),
        fa.alias("fa"),
        (found / F.greatest(found + fa, F.lit(1))).alias("precision"),
        (found / F.greatest(total, F.lit(1))).alias("recall"),
        F.sum("marks").alias("marks"),
    )
    return each.unionByName(whole)


def realtime(runs: DataFrame, places: int | None = 2) -> DataFrame:
    """video_id, realtime_factor of runs (video_id, duration, seconds): duration over time taken, to so many places (None: as it is); 0 where none was taken."""
    factor = F.col("duration") / F.col("seconds")
    return runs.select("video_id", F.when(F.col("seconds") > 0, factor if places is None else rounded(factor, places)).otherwise(F.lit(0.0)).alias("realtime_factor"))


def call_statistics(calls: DataFrame, keys: tuple[str, ...] = ("model_name",), places: int | None = 1) -> DataFrame:
    """Count, total, mean, exact median and 95th percentile, maximum of elapsed_ms, to so many places (None: as they are)."""
    shown = (lambda c: c) if places is None else (lambda c: rounded(c, places))
    sums = calls.groupBy(*keys).agg(
        F.count("*").alias("call_count"), shown(F.sum("elapsed_ms")).alias("total_time_ms"), shown(F.avg("elapsed_ms")).alias("average_time_ms"), shown(F.max("elapsed_ms")).alias("max_time_ms")
    )
    ranks = percentiles(calls, "elapsed_ms", {"p50": 0.5, "p95": 0.95}, keys)
    return sums.join(ranks, list(keys), "left").select(
        *keys, "call_count", "total_time_ms", "average_time_ms", shown(F.col("p50")).alias("p50_time_ms"), shown(F.col("p95")).alias("p95_time_ms"), "max_time_ms"
    )


def confusion_matrix(pairs: DataFrame, labels: list) -> DataFrame:
    """One row for each label with a column of counts for each predicted label."""
    return pairs.groupBy("label").pivot("pred", labels).count().na.fill(0)


def class_report(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support."""
    hit = pairs.groupBy(F.col("label")).agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("pred")).alias("tp"))
    said = pairs.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("said"))
    both = hit.join(said, "label", "full").na.fill(0)
    p, r = F.col("tp") / F.greatest("said", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return both.select("label", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"), "support")
