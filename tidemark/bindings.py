"""The operators' inputs, taken from the driver's tables (in hours since 2024-01-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# Event types as classes.
CLASS_OF = {"view": "normal", "error": "traffic_accident", "click": "smoke", "purchase": "fire", "signup": "traffic_congestion"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_of(event_type: Column) -> Column:
    out = F.lit("normal")
    for kind, name in CLASS_OF.items():
        out = F.when(event_type == kind, name).otherwise(out)
    return out


def hours(ts: Column) -> Column:
    """Hours since the start of 2024, without any time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), ts) / F.lit(3600000000.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, event_id, t, signal, health."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("video_id"), "event_id", hours(F.col("ts")).alias("t"), F.col("value").alias("signal"), (1 - F.col("value") / 50).alias("health"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, event_id, t0, t1, class, confidence, description, health."""
    e = table(spark, sf_dir, "events")
    t = hours(F.col("ts"))
    return e.select(
        F.col("user_id").alias("video_id"),
        "event_id",
        t.alias("t0"),
        (t + 1).alias("t1"),
        class_of(F.col("event_type")).alias("class"),
        (F.col("value") / (F.col("value") + 50)).alias("confidence"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"),
        (1 - F.col("value") / 50).alias("health"),
    )


def truth(spark: SparkSession, sf_dir: str, clip: bool = True) -> DataFrame:
    """Labelled intervals from error events: video_id, truth_id, class, s, e. Clipped, those of a video do not overlap."""
    e = frames(spark, sf_dir).join(table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id"), "event_id", "left_semi")
    end = F.col("t") + F.col("signal") / 10
    if clip:
        end = F.least(end, F.lead("t").over(Window.partitionBy("video_id").orderBy("t", "event_id")))
    return e.select("video_id", F.col("event_id").alias("truth_id"), F.lit("traffic_accident").alias("class"), F.col("t").alias("s"), end.alias("e"))


def predicted(spark: SparkSession, sf_dir: str, clip: bool = True) -> DataFrame:
    """The truth shifted by (id % 5 - 2) hours, every seventh with another class: video_id, pred_id, class, s, e."""
    shift = F.col("truth_id") % 5 - 2
    return truth(spark, sf_dir, clip).select(
        "video_id",
        F.col("truth_id").alias("pred_id"),
        F.when(F.col("truth_id") % 7 == 0, "fire").otherwise(F.col("class")).alias("class"),
        (F.col("s") + shift).alias("s"),
        (F.col("e") + shift).alias("e"),
    )


#: The same bindings in DuckDB.
CTE = {
    "frames": "frames AS (SELECT user_id AS video_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS t, value AS signal, 1 - value / 50 AS health FROM events)",
    "verdicts": """verdicts AS (SELECT user_id AS video_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS t0,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 + 1 AS t1,
        CASE event_type WHEN 'error' THEN 'traffic_accident' WHEN 'click' THEN 'smoke' WHEN 'purchase' THEN 'fire' WHEN 'signup' THEN 'traffic_congestion' ELSE 'normal' END AS class,
        value / (value + 50) AS confidence, 'event ' || event_id AS description, 1 - value / 50 AS health FROM events)""",
    "truth": """truth AS (SELECT f.video_id, f.event_id AS truth_id, 'traffic_accident' AS class, f.t AS s,
        least(f.t + f.signal / 10, lead(f.t) OVER (PARTITION BY f.video_id ORDER BY f.t, f.event_id)) AS e
        FROM frames f JOIN events ev ON ev.event_id = f.event_id AND ev.event_type = 'error')""",
    "pred": """pred AS (SELECT video_id, truth_id AS pred_id, CASE WHEN truth_id % 7 = 0 THEN 'fire' ELSE class END AS class,
        s + (truth_id % 5 - 2) AS s, e + (truth_id % 5 - 2) AS e FROM truth)""",
}


def ctes(*names: str) -> str:
    return ",\n".join(CTE[n] for n in names)
