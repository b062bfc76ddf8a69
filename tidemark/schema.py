"""Fixed values and row types."""

from __future__ import annotations

from pyspark.sql import types as T

# The label vocabulary, in its scoring order.
CLASSES = [
    "normal",
    "traffic_accident",
    "traffic_congestion",
    "stalled_or_broken_down_vehicle",
    "vehicle_blocking_traffic",
    "wrong_way_driving",
    "road_spill_or_debris",
    "waterlogging_or_flood",
    "fire",
    "smoke",
    "fighting_or_violence",
    "loitering_or_suspicious_presence",
]

# The least duration of an incident by class, and of any other class.
LEAST_DURATION = {
    "traffic_accident": 1.0,
    "traffic_congestion": 2.5,
    "stalled_or_broken_down_vehicle": 4.0,
    "vehicle_blocking_traffic": 3.0,
    "wrong_way_driving": 1.5,
    "road_spill_or_debris": 2.0,
    "waterlogging_or_flood": 2.0,
    "fire": 1.5,
    "smoke": 2.0,
    "fighting_or_violence": 1.5,
    "loitering_or_suspicious_presence": 3.0,
}
LEAST_DURATION_ELSE = 2.0

# Marks by level: intercept, per match, per log1p of false alarms; and the greatest mark.
MARKS = {1: (3.46, 1.005, 1.047, 25.0), 2: (19.37, 2.135, -0.778, 35.0), 3: (9.09, 4.994, -1.569, 40.0)}
MARKS_FLOOR = 2.0

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "w", "h")])
FRAME = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("motion", T.DoubleType()),
        T.StructField("box", BOX),
        T.StructField("why", T.StringType()),
        T.StructField("health", T.DoubleType()),
        T.StructField("emb", T.ArrayType(T.FloatType())),
    ]
)
TRUTH = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("start_time_sec", T.DoubleType()),
        T.StructField("end_time_sec", T.DoubleType()),
        T.StructField("description_summary", T.StringType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "videos",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("video_id", T.StringType()),
                        T.StructField("level", T.IntegerType()),
                        T.StructField("difficulty", T.IntegerType()),
                        T.StructField("domain", T.StringType()),
                        T.StructField("duration_sec", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
