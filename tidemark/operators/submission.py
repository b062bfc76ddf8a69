"""Submission rows and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import explanation
from tidemark.schema import CLASSES


def video_class(events: DataFrame) -> DataFrame:
    """video_id, class_name of the event of greatest peak (the first, on ties)."""
    order = Window.partitionBy("video_id").orderBy(F.desc("peak"), "start", "cluster")
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("video_id", "class_name")


def project(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Events as submitted: level 1 keeps the event of greatest peak, without times; other levels keep all with times."""
    order = Window.partitionBy("video_id").orderBy(F.desc("peak"), "start", "cluster")
    ranked = events.join(manifest.select("video_id", "level"), "video_id").withColumn("_n", F.row_number().over(order))
    kept = ranked.where((F.col("level") > 1) | (F.col("_n") == 1))
    timed = F.col("level") > 1
    others = F.transform("sub_tags", lambda s: s["class_name"])
    return kept.select(
        "video_id",
        "level",
        "class_name",
        F.when(timed, F.col("start")).alias("start_time_sec"),
        F.when(timed, F.col("end")).alias("end_time_sec"),
        F.col("peak").alias("confidence"),
        explanation(F.col("description"), others).alias("explanation"),
    )


def _answers(manifest: DataFrame, predictions: DataFrame, events: DataFrame) -> DataFrame:
    """p: the answer of each video of the manifest that has a prediction."""
    listed = events.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_time_sec", "end_time_sec", "class_name", "confidence", "explanation"))).alias("events"))
    rows = manifest.select("video_id").join(predictions.select("video_id", "runtime_metadata"), "video_id").join(listed, "video_id", "left")
    fallback = F.struct(F.lit(0).cast("long").alias("frames_processed"), F.lit(0).cast("long").alias("chunks_processed"), F.lit(0.0).alias("end_to_end_internal_time_ms"))
    empty = F.array().cast("array<struct<start_time_sec:double,end_time_sec:double,class_name:string,confidence:double,explanation:string>>")
    return rows.select(F.struct("video_id", F.coalesce("events", empty).alias("events"), F.coalesce("runtime_metadata", fallback).alias("runtime_metadata")).alias("p"))


def build(manifest: DataFrame, predictions: DataFrame, events: DataFrame, submission_id: str, model_name: str) -> DataFrame:
    """One row with `document`, the submission as JSON; videos without a prediction are left out, nulls are kept. `write` is for what is too large for a row."""
    whole = _answers(manifest, predictions, events).agg(F.array_sort(F.collect_list("p")).alias("predictions"))
    return whole.select(
        F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(submission_id).alias("submission_id"), F.lit(model_name).alias("model_name"), "predictions"), {"ignoreNullFields": "false"}).alias("document")
    )


def write(manifest: DataFrame, predictions: DataFrame, events: DataFrame, submission_id: str, model_name: str, path: str) -> dict:
    """The document of `build` as the file `path`, written from ordered partitions; its manifest of parts: order, name, rows, bytes.

    Each task streams the answers of its range of videos to a part of its own; what a lost or repeated task has left is named nowhere. One task then
    streams the named parts into the file, so no task holds more than a batch of rows or a block of bytes. A file of that name is an error.
    """
    import json
    import uuid
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs

    spark = manifest.sparkSession
    store, target = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if store.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    folder = f"{target}.parts-{uuid.uuid4().hex}"
    lines = _answers(manifest, predictions, events).select(F.col("p.video_id").alias("video_id"), F.to_json("p", {"ignoreNullFields": "false"}).alias("line"))
    ordered = lines.repartitionByRange("video_id").sortWithinPartitions("video_id").select("line", F.spark_partition_id().alias("part"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.create_dir(folder, recursive=True)
        name, out, part, rows, size = uuid.uuid4().hex, None, 0, 0, 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                if out is None:
                    out, part = store.open_output_stream(f"{folder}/{name}"), batch.column("part")[0].as_py()
                data = (b"," if rows else b"") + line.encode()
                out.write(data)
                rows, size = rows + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, rows, size)], ["part", "name", "rows", "bytes"])

    parts = sorted(tuple(r) for r in ordered.mapInArrow(put, "part long, name string, rows long, bytes long").collect())  # a row for each partition
    fields = {"schema_version": "1.0", "submission_id": submission_id, "model_name": model_name}
    head = json.dumps(fields, separators=(",", ":"), ensure_ascii=False)[:-1] + ',"predictions":['

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = f"{folder}/whole"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(whole) as out:
                out.write(head.encode())
                for i, (_, name, _, _) in enumerate(parts):
                    out.write(b"," if i else b"")
                    with store.open_input_stream(f"{folder}/{name}") as file:
                        while block := file.read(1 << 20):
                            out.write(block)
                out.write(b"]}")
            store.move(whole, target)
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(join, "id long").collect()
    store.delete_dir(folder)
    return {"parts": [dict(zip(("part", "name", "rows", "bytes"), p, strict=True)) for p in parts], "rows": sum(p[2] for p in parts)}


def problems(manifest: DataFrame, answers: DataFrame, events: DataFrame) -> DataFrame:
    """video_id, problem: every broken rule of a submission.

    manifest: video_id, level, duration; answers: video_id, has_metadata, one row for each answer; events: video_id,
    class_name, start_time_sec, end_time_sec.
    """

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select("video_id", F.lit(name).alias("problem"))

    known = answers.join(manifest, "video_id", "left_semi")
    e = events.join(manifest, "video_id")
    timed = e.where("level > 1")
    whole = timed.where("start_time_sec is not null and end_time_sec is not null")
    found = [
        rule(answers.groupBy("video_id").count().where("count > 1"), "more than one answer"),
        rule(answers.join(manifest, "video_id", "left_anti"), "not in manifest"),
        rule(known.where("not has_metadata"), "no runtime metadata"),
        rule(e.where(~F.col("class_name").isin(CLASSES[1:])), "not an event class"),
        rule(e.where("level = 1 and (start_time_sec is not null or end_time_sec is not null)"), "level 1 with times"),
        rule(timed.where("start_time_sec is null or end_time_sec is null"), "times missing"),
        rule(whole.where("end_time_sec <= start_time_sec"), "ends before it starts"),
        rule(whole.where("end_time_sec > start_time_sec and end_time_sec > duration + 0.5"), "ends after the video"),
        rule(manifest.join(answers, "video_id", "left_anti"), "never answered"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
