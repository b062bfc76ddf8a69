"""Verdicts to incidents: clustering, extent, roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import least_duration, rounded
from tidemark.operators import intervals


def override(verdicts: DataFrame, at: float) -> DataFrame:
    """A normal verdict becomes the probe's top class where its anomaly probability reaches `at`; probe_override says so.

    With columns second_class, second_confidence, second_description (a second call's answer, or null), that call names
    the class if it found one, and bounds the confidence; its description goes before the first's.
    """
    strong = (F.col("class") == "normal") & F.col("probe_top").isNotNull() & (F.col("probe_anomaly") >= at)
    name, sure, extra = F.col("probe_top"), F.col("probe_anomaly"), {}
    if "second_class" in verdicts.columns:
        again = F.col("second_class").isNotNull() & (F.col("second_class") != "normal")
        name = F.when(again, F.col("second_class")).otherwise(name)
        sure = F.when(again, F.least("second_confidence", "probe_anomaly")).otherwise(sure)
        said = F.coalesce(F.nullif("second_description", F.lit("")), F.nullif("description", F.lit("")), F.concat(F.lit("Probe: "), F.replace(name, F.lit("_"), F.lit(" "))))
        extra = {"description": F.when(strong, said).otherwise(F.col("description"))}
    return verdicts.withColumns(
        {
            "probe_override": F.coalesce(strong, F.lit(False)),
            "confidence": F.when(strong, rounded(F.greatest(F.lit(0.5), sure), 3)).otherwise(F.col("confidence")),
            "class": F.when(strong, name).otherwise(F.col("class")),
            **extra,
        }
    )


def clusters(verdicts: DataFrame) -> DataFrame:
    """Hits (class other than normal) with cluster: it splits only where a normal window lies between two hits.

    Between hit p and the next hit w lies a normal x if p.t1 <= x.t0 and x.t1 <= w.t0. With normals placed at
    their t1 and hits at their t0, the latest t0 among the normals so far answers that in one ordered pass.
    """
    normal = F.col("class") == "normal"
    keyed = verdicts.withColumns({"_at": F.when(normal, F.col("t1")).otherwise(F.col("t0")), "_hit": (~normal).cast("int")})
    order = Window.partitionBy("video_id").orderBy("_at", "_hit", "event_id")
    quiet = F.max(F.when(normal, F.col("t0"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    hits = keyed.withColumn("_quiet", quiet).where(~normal)
    by_time = Window.partitionBy("video_id").orderBy("t0", "event_id")
    split = F.coalesce((F.col("_quiet") >= F.lag("t1").over(by_time)).cast("int"), F.lit(0))
    numbered = hits.withColumn("_split", split).withColumn("cluster", F.sum("_split").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return numbered.drop("_at", "_hit", "_quiet", "_split")


def _reach(spans: DataFrame, curves: DataFrame, loose: float) -> DataFrame:
    """`spans` with lo and hi: the times to which a depression around s and e reaches on the curve; null without a curve.

    Each sample first learns how far a walk from it would go: back to the sample after the last calm one before it, and
    on to the sample before the next calm one. A span then takes that of its first sample at or after s and of
    its last at or before e, or of the last and first sample where there is none: ordered passes, no join with the curve.
    """
    forward, back = Window.partitionBy("video_id").orderBy("t", "event_id"), Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("event_id"))
    past = (Window.unboundedPreceding, -1)
    calm = ~(F.col("health") < loose)
    walked = curves.withColumns({"_next": F.lead("t").over(forward), "_prior": F.lag("t").over(forward)}).select(
        "video_id",
        F.col("t").alias("_at"),
        "event_id",
        F.lit(0).alias("_kind"),
        F.coalesce(F.last(F.when(calm, F.col("_next")), True).over(forward.rowsBetween(*past)), F.first("t").over(forward.rowsBetween(Window.unboundedPreceding, 0))).alias("_lo"),
        F.coalesce(F.last(F.when(calm, F.col("_prior")), True).over(back.rowsBetween(*past)), F.first("t").over(back.rowsBetween(Window.unboundedPreceding, 0))).alias("_hi"),
        F.lit(None).cast(spans.select(F.struct("*")).schema[0].dataType).alias("_span"),
    )
    none = F.lit(None).cast("double")
    # each span stands in the order of time twice, by its start and by its end, and carries its columns along
    ends = F.array(F.struct(F.lit(1).alias("_kind"), F.col("s").alias("_at")), F.struct(F.lit(2).alias("_kind"), F.col("e").alias("_at")))
    asked = spans.select(F.struct("*").alias("_span"), F.explode(ends).alias("_end")).select("_span.video_id", "_end._at", F.lit(None).cast("long").alias("event_id"), "_end._kind", none.alias("_lo"), none.alias("_hi"), "_span")
    merged = walked.unionByName(asked)
    up, down = Window.partitionBy("video_id").orderBy("_at", "_kind", "event_id"), Window.partitionBy("video_id").orderBy(F.desc("_at"), "_kind", F.desc("event_id"))
    sofar, whole = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, Window.unboundedFollowing)
    lo = F.coalesce(F.last("_lo", True).over(down.rowsBetween(*sofar)), F.first("_lo", True).over(down.rowsBetween(*whole)))
    hi = F.coalesce(F.last("_hi", True).over(up.rowsBetween(*sofar)), F.first("_hi", True).over(up.rowsBetween(*whole)))
    found = merged.withColumns({"_from": lo, "_to": hi}).where("_kind > 0")
    found = found.groupBy("video_id", F.col("_span.cluster").alias("cluster")).agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_from"))).alias("lo"), F.max(F.when(F.col("_kind") == 2, F.col("_to"))).alias("hi"), F.first("_span").alias("_span")
    )
    return found.select("_span.*", "lo", "hi")


def extent(spans: DataFrame, curves: DataFrame | None, threshold: float, config: Config, duration: bool = False) -> DataFrame:
    """`spans` (video_id, cluster, s, e, probed) with s, e, source: extended along the curve while it is depressed, then buffered and clamped.

    curves: video_id, t, event_id, health; or video_id, curve = array<struct<t, health>> in order of t. duration: `spans` has a
    column of that name.
    """
    out = spans.withColumn("source", F.when(F.col("probed"), "probe-span").otherwise("windows"))
    if curves is not None:
        if "curve" in curves.columns:
            curves = curves.select("video_id", F.posexplode("curve").alias("event_id", "_p")).select("video_id", F.col("event_id").cast("long").alias("event_id"), "_p.t", "_p.health")
        out = _reach(out, curves, threshold * config.loose_factor)
        some = F.col("lo").isNotNull()
        out = out.withColumns(
            {
                "s": F.when(some, F.least("s", "lo")).otherwise(F.col("s")),
                "e": F.when(some, F.greatest("e", "hi")).otherwise(F.col("e")),
                "source": F.when(some, "measured").otherwise(F.col("source")),
            }
        ).drop("lo", "hi")
    buffer = F.lit(config.extent_buffer)
    out = out.withColumns({"s": F.greatest(F.lit(0.0), F.col("s") - buffer), "e": F.col("e") + buffer})
    if duration:
        past = F.col("e") > F.col("duration")
        out = out.withColumns(
            {"s": F.when(past, F.least("s", F.greatest(F.lit(0.0), F.col("duration") - 1e-3))).otherwise(F.col("s")), "e": F.when(past, F.col("duration")).otherwise(F.col("e"))}
        )
    return out


def incidents(verdicts: DataFrame, config: Config, curves: DataFrame | None = None, durations: DataFrame | None = None, adjudicated: DataFrame | None = None) -> DataFrame:
    """One row for each incident: video_id, cluster, class_name, start, end, confidence, peak, n_windows, source, reason, description, sub_tags.

    verdicts: video_id, event_id, t0, t1, class, confidence, description, and span (struct<lo, hi>) if there is one.
    adjudicated: video_id, cluster, primary, primary_confidence, primary_reason: decisions on clusters of several classes.
    """
    v = verdicts if "span" in verdicts.columns else verdicts.withColumn("span", F.lit(None).cast("struct<lo:double,hi:double>"))
    hits = clusters(v).withColumn("strong", F.col("confidence") >= config.enter_confidence)
    by_time = Window.partitionBy("video_id", "cluster").orderBy("t0", "event_id")
    best_first = Window.partitionBy("video_id", "cluster").orderBy(F.desc("strong"), F.desc("confidence"), "t0", "event_id")
    ranked = hits.withColumns({"_best": F.row_number().over(best_first), "_turn": F.row_number().over(by_time)})
    rolled = ranked.groupBy("video_id", "cluster").agg(
        F.count("*").alias("n_windows"),
        F.avg(F.when(F.col("strong"), F.col("confidence"))).alias("mean"),
        F.max(F.when(F.col("_best") == 1, F.struct("strong", "class", "confidence", "description"))).alias("top"),
        F.min(F.when(F.col("strong"), F.coalesce("span.lo", "t0"))).alias("s"),
        F.max(F.when(F.col("strong"), F.coalesce("span.hi", "t1"))).alias("e"),
        F.bool_or(F.col("strong") & F.col("span").isNotNull()).alias("probed"),
    )
    rolled = rolled.where("top.strong").withColumns({"class_name": F.col("top.class"), "peak": F.col("top.confidence"), "reason": F.lit("highest confidence"), "description": F.col("top.description")}).drop("top")
    tags = ranked.groupBy("video_id", "cluster", "class").agg(F.max("confidence").alias("p"), F.count("*").alias("n"), F.min(F.struct("_turn", "t0", "description")).alias("f"))
    tags = tags.groupBy("video_id", "cluster").agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("p")).alias("order"), F.col("f._turn").alias("turn"), F.col("class").alias("class_name"), F.col("p").alias("peak_confidence"), F.col("n").alias("n_windows"), F.col("f.t0").alias("first_seen"), F.col("f.description").alias("description"))
            )
        ).alias("tags")
    )
    rolled = rolled.join(tags, ["video_id", "cluster"])
    if adjudicated is not None:
        rolled = rolled.join(adjudicated, ["video_id", "cluster"], "left")
        said = F.col("primary").isNotNull() & (F.size("tags") > 1)
        rolled = rolled.withColumns(
            {
                "reason": F.when(said, F.coalesce("primary_reason", F.lit("adjudicated"))).otherwise(F.col("reason")),
                "peak": F.when(said, F.greatest("peak", F.coalesce("primary_confidence", F.lit(0.0)))).otherwise(F.col("peak")),
                "class_name": F.when(said, F.col("primary")).otherwise(F.col("class_name")),
            }
        )
    if durations is not None:
        rolled = rolled.join(durations, "video_id", "left")
    measured = extent(rolled, curves, config.health_threshold, config, durations is not None)
    long_enough = measured.where(F.col("e") - F.col("s") + 1e-6 >= least_duration(F.col("class_name")))
    sub_tags = F.transform(
        F.filter("tags", lambda x: x["class_name"] != F.col("class_name")),
        lambda x: F.struct(x["class_name"].alias("class_name"), x["peak_confidence"].alias("peak_confidence"), x["n_windows"].alias("n_windows"), x["first_seen"].alias("first_seen_sec"), x["description"].alias("description")),
    )
    return long_enough.select(
        "video_id", "cluster", "class_name", F.col("s").alias("start"), F.col("e").alias("end"), F.col("mean").alias("confidence"), "peak", "n_windows", "source", "reason", "description", sub_tags.alias("sub_tags")
    )


def recovered_between(frames: DataFrame, gaps: DataFrame, threshold: float, factor: float, width: float = 24.0) -> DataFrame:
    """gaps (video_id, gap_id, lo, hi) with recovered: most curve samples strictly between are not depressed (a retired diagnostic)."""
    inner = intervals.points_in(frames.select("video_id", "t", "health"), gaps, "lo", "hi", width).where("t > lo and t < hi")
    seen = inner.groupBy("video_id", "gap_id").agg((2 * F.count_if(F.col("health") >= F.lit(threshold * factor)) > F.count("*")).alias("recovered"))
    return gaps.join(seen, ["video_id", "gap_id"], "left").select("video_id", "gap_id", F.coalesce("recovered", F.lit(False)).alias("recovered"))
