"""Matching predicted against labelled intervals (video_id, class, s, e)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import interval_iou
from tidemark.operators import intervals
from tidemark.sources import shared_folder


def overlapping(truth: DataFrame, predicted: DataFrame, same_class: bool = True, width: float = 8.0) -> DataFrame:
    """All overlapping pairs of a video (and class), with iou, joined by video and time bucket of `width`."""
    p = predicted.select("video_id", "pred_id", F.col("class").alias("pred_class"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    keys = ["video_id"]
    if same_class:
        truth, p, keys = truth.withColumn("_class", F.col("class")), p.withColumn("_class", F.col("pred_class")), ["video_id", "_class"]
    pairs = intervals.overlapping(truth, p, keys, ("s", "e"), ("ps", "pe"), width).drop("_class")
    return pairs.withColumn("iou", interval_iou(F.col("ps"), F.col("pe"), F.col("s"), F.col("e"))).where("iou > 0")


def match_disjoint(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches (video_id, truth_id, pred_id, iou) by window functions; exact where truths of a class do not overlap."""
    best = Window.partitionBy("video_id", "truth_id").orderBy(F.desc("iou"), "ps", "pred_id")
    first = Window.partitionBy("video_id", "pred_id").orderBy("s", "truth_id")
    near = overlapping(truth, predicted).where(F.col("iou") >= least)
    once = near.withColumn("_b", F.row_number().over(best)).where("_b = 1").withColumn("_f", F.row_number().over(first)).where("_f = 1")
    return once.select("video_id", "truth_id", "pred_id", "iou")


def match_greedy(truth: DataFrame, predicted: DataFrame, least: float = 0.5, rounds: int = 8) -> DataFrame:
    """The exact sequential rule: in order of truths, the free prediction of greatest overlap, if that reaches `least`.

    All predictions would rather have the earlier truth, so there is one stable matching, and it is that of the rule. It is found by deferred
    acceptance: every truth asks its best prediction left, a prediction holds the earliest that asks and will never have a later one,
    whose pairs with it go. A round is a few sums over pairs, whatever overlaps; it is over when nobody is refused. A chain in which each
    truth displaces the next takes as many rounds as it has links: what is open after `rounds` rounds is read in order instead.
    """
    by = ["video_id", "class"]
    pairs = overlapping(truth, predicted).where(F.col("iou") >= least)
    wish, turn = F.struct((-F.col("iou")).alias("d"), "ps", "pred_id", "iou"), F.struct("s", "truth_id")
    pairs = pairs.select(*by, "truth_id", "pred_id", F.least("s", "ps").alias("lo"), F.greatest("e", "pe").alias("hi"), wish.alias("wish"), turn.alias("turn"))
    shared_folder(truth.sparkSession)
    for _ in range(rounds):
        pairs = pairs.checkpoint()
        asked = pairs.groupBy(*by, "truth_id").agg(F.min("wish").alias("wish"), F.min("turn").alias("turn"))
        asked = asked.select(*by, "truth_id", "turn", F.col("wish.pred_id").alias("pred_id"), F.col("wish.iou").alias("iou"))
        held = asked.groupBy(*by, "pred_id").agg(F.min("turn").alias("first"), F.count("*").alias("n"))
        if not held.where("n > 1").limit(1).count():
            return asked.select("video_id", "truth_id", "pred_id", "iou")
        pairs = pairs.join(held.drop("n"), [*by, "pred_id"], "left").where(F.col("first").isNull() | (F.col("turn") <= F.col("first"))).drop("first")
    return _in_order(pairs)


def _in_order(pairs: DataFrame) -> DataFrame:
    """The sequential rule over pairs (video_id, class, truth_id, pred_id, lo, hi, wish, turn) by reading them.

    The pairs of a class are cut where one begins after all earlier ones have ended, the runs are dealt out, and each is read once in order; what a task
    holds is one Arrow batch, and the predictions taken so far of one run.
    """
    by_time = Window.partitionBy("video_id", "class").orderBy("lo", "hi", "truth_id", "pred_id")
    reached = F.max("hi").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    cut = pairs.withColumn("_cut", F.coalesce((F.col("lo") > reached).cast("int"), F.lit(0)))
    runs = cut.withColumn("run", F.sum("_cut").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["video_id", "class", "run"]
    dealt = runs.repartition(*keys).sortWithinPartitions(*keys, "turn", "wish").select(*keys, "truth_id", "pred_id", F.col("wish.iou").alias("iou"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, truth, taken = None, None, set()
        for batch in batches:
            rows = []
            for i, (*key, t, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "truth_id", "pred_id")), strict=True)):
                if key != run:
                    run, truth, taken = key, None, set()
                if t != truth and p not in taken:
                    truth = t
                    taken.add(p)
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64())).select(["video_id", "truth_id", "pred_id", "iou"])

    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return dealt.mapInArrow(take, ", ".join(f"{c} {types[c]}" for c in ("video_id", "truth_id", "pred_id", "iou")))


def per_video(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """video_id, truth, pred, found, near_miss, wrong_class, false_alarm, unmatched."""
    pairs = overlapping(truth, predicted, same_class=False)
    t = truth.join(matches.select("video_id", "truth_id", F.lit(1).alias("hit")), ["video_id", "truth_id"], "left")
    t = t.join(pairs.select("video_id", "truth_id").distinct().withColumn("met", F.lit(1)), ["video_id", "truth_id"], "left")
    t = t.groupBy("video_id").agg(F.count("*").alias("truth"), F.count("hit").alias("found"), F.count_if(F.col("hit").isNull() & F.col("met").isNotNull()).alias("near_miss"))
    other = pairs.groupBy("video_id", "pred_id").agg(F.bool_and(F.col("pred_class") != F.col("class")).alias("wrong"))
    p = predicted.join(matches.select("video_id", "pred_id", F.lit(1).alias("hit")), ["video_id", "pred_id"], "left").join(other, ["video_id", "pred_id"], "left")
    free = F.col("hit").isNull()
    p = p.groupBy("video_id").agg(
        F.count("*").alias("pred"), F.count_if(free & F.coalesce("wrong", F.lit(False))).alias("wrong_class"), F.count_if(free & ~F.coalesce("wrong", F.lit(False))).alias("false_alarm")
    )
    both = t.join(p, "video_id", "full").na.fill(0)
    return both.select("video_id", "truth", "pred", "found", "near_miss", "wrong_class", "false_alarm", (F.col("wrong_class") + F.col("false_alarm")).alias("unmatched"))


def loose_evaluation(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Each truth's best overlap of its class, without one-to-one: video_id, truth_id, best, hit, fragments."""
    pairs = overlapping(truth, predicted)
    best = pairs.groupBy("video_id", "truth_id").agg(F.max("iou").alias("best"))
    same = predicted.groupBy("video_id", "class").agg(F.count("*").alias("n"))
    out = truth.join(best, ["video_id", "truth_id"], "left").join(same, ["video_id", "class"], "left")
    return out.select(
        "video_id",
        "truth_id",
        F.coalesce("best", F.lit(0.0)).alias("best"),
        (F.coalesce("best", F.lit(0.0)) >= least).alias("hit"),
        F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - 1).alias("fragments"),
    )


def quiet_false_alarms(levels: DataFrame, predicted: DataFrame) -> DataFrame:
    """Normal videos (level, video_id, is_normal) for which any event is predicted."""
    return levels.where("is_normal").join(predicted.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "level")
