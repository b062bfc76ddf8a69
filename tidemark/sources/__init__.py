"""Readers, audits and sinks."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stem
from tidemark.schema import CLASSES, MANIFEST

# Folders that are never looked into, and the folders that mark a root.
SKIPPED = ("videos", "__MACOSX", ".ipynb_checkpoints")
DATA_MARKS = ("train", "test")
EVAL_MARKS = ("L1", "L2", "L3")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only on a single machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(told)
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared folder, removed when what runs inside is done; results that outlive it are checkpointed before."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside; afterwards it is as it was, set or not."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _folders(spark: SparkSession | None, base: str) -> tuple[str, Callable[[str], list[str]]]:
    """The full name of `base`, and a function that lists the folders in a folder: of any store that Spark reads, or of this machine."""
    if spark is None:
        return os.path.realpath(base), lambda folder: sorted(e.name for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def below(folder: str) -> list[str]:
        return sorted(e.getPath().getName() for e in files.listStatus(hadoop.Path(folder)) if e.isDirectory())

    return files.resolvePath(hadoop.Path(base)).toString(), below


def find_roots(bases: Iterable[str], marks: tuple[str, ...] = DATA_MARKS, max_depth: int = 8, spark: SparkSession | None = None) -> list[str]:
    """Folders that hold one of `marks`, each once; nothing below a root is searched, nor more than `max_depth` folders down.

    With a session the folders may be in any store that Spark reads.
    """
    found: dict[str, None] = {}
    for base in bases:
        top, below = _folders(spark, base)
        ahead = [(top, 0)]
        while ahead:
            folder, depth = ahead.pop()
            names = below(folder)
            if any(m in names for m in marks):
                found.setdefault(folder)
            elif depth < max_depth:
                ahead += [(f"{folder}/{n}", depth + 1) for n in reversed(names) if n not in SKIPPED]
    return list(found)


def video_index(spark: SparkSession, roots: list[str], pattern: str = "*.mp4") -> DataFrame:
    """video_id, path, length: one file for each stem, from the first root that has it. Contents are not read."""
    parts = []
    for order, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        parts.append(files.select(F.lit(order).alias("root"), "path", "length"))
    if not parts:
        return spark.createDataFrame([], "video_id string, path string, length bigint")
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    first = Window.partitionBy("video_id").orderBy("root", "path")
    return files.withColumn("video_id", stem(F.col("path"))).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("video_id", "path", "length")


def looks_like_download_page(content: Column, length: Column) -> Column:
    """A small file that begins as the web page of a file host instead of data."""
    head = F.lower(F.decode(F.substring(content, 1, 400), "ISO-8859-1"))
    return (length < 2_000_000) & F.contains(head, F.lit("<!doctype html")) & F.contains(head, F.lit("google drive"))


def stem_path(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub("^file:/+", "/", path)


def read_truth(spark: SparkSession, paths: list[str], index: DataFrame | None = None) -> DataFrame:
    """Labelled intervals from CSV files: union by name, source_csv, first row of equal keys, times or null, path if an index is given."""
    # one scan finds the first line of all files; then there is a plan for each header, not for each file
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    found = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("head")).collect()
    heads: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(found, key=lambda r: r["file"]):
        heads.setdefault(tuple(c.strip() for c in r["head"].split(",")), []).append(r["file"])
    given = {stem_path(path).rstrip("/"): i for i, path in reversed(list(enumerate(paths)))}
    files = [re.sub("^file:/+", "/", r["file"]) for r in found]
    places = {f: next((given[g] for g in (f, os.path.dirname(f)) if g in given), len(paths)) for f in files}
    order = F.create_map(*(F.lit(x) for f, i in places.items() for x in (f, i))) if places else F.create_map(F.lit(""), F.lit(0))
    rows = None
    for head, files in heads.items():
        one = spark.read.csv(files, header=True, schema=", ".join(f"`{c}` string" for c in head) if head else "video_id string", enforceSchema=True)
        where = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        one = one.withColumns({"source_csv": where, "_line": F.monotonically_increasing_id(), "_file": F.coalesce(F.element_at(order, where), F.lit(len(paths)))})
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is None:  # no file has a line
        rows = spark.createDataFrame([], "video_id string, source_csv string, _line long, _file int")
    for c in ("start_time_sec", "end_time_sec", "level", "is_anomaly", "class_name", "description_summary"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    keys = ["video_id", "class_name", "start_time_sec", "end_time_sec"]
    first = Window.partitionBy(*keys).orderBy("_file", "_line")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    out = rows.select(
        "video_id",
        F.col("level").try_cast("int").alias("level"),
        (F.lower("is_anomaly") == "true").alias("is_anomaly"),
        "class_name",
        F.col("start_time_sec").try_cast("double").alias("start_time_sec"),
        F.col("end_time_sec").try_cast("double").alias("end_time_sec"),
        "description_summary",
        "source_csv",
    )
    return out if index is None else out.join(index.select("video_id", "path"), "video_id", "left")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, level, domain, duration_sec from a manifest document, or from a bare list; a duration of 0 is null."""
    lines = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    inner = MANIFEST["videos"].dataType
    videos = F.when(F.startswith("value", F.lit("[")), F.from_json("value", inner)).otherwise(F.from_json("value", MANIFEST)["videos"])
    each = lines.select(F.inline(videos))
    return each.select("video_id", F.coalesce("level", "difficulty").alias("level"), "domain", F.nullif("duration_sec", F.lit(0.0)).alias("duration_sec"))


def eval_index(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """video_id, path, level, duration_sec of every file: the level of the manifest, or else the number in the name of a folder L1, L2 or L3."""
    folder = F.nullif(F.regexp_extract("path", r"/L([123])/", 1), F.lit("")).cast("int")
    both = index.select("video_id", "path").join(manifest.select("video_id", "level", "duration_sec"), "video_id", "left")
    return both.select("video_id", "path", F.coalesce("level", folder).alias("level"), "duration_sec")


def compare_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """video_id, difference: ids on one side only, and levels that differ."""
    both = a.select("video_id", F.col("level").alias("la"), F.lit(1).alias("ina")).join(b.select("video_id", F.col("level").alias("lb"), F.lit(1).alias("inb")), "video_id", "full")
    what = F.when(F.col("inb").isNull(), "only in first").when(F.col("ina").isNull(), "only in second").when(~F.equal_null("la", "lb"), "level differs")
    return both.select("video_id", what.alias("difference")).where("difference is not null")


def audit(files: DataFrame) -> DataFrame:
    """files (root, class_name, length): counts and bytes of each root."""
    return files.groupBy("root").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_distinct("class_name").alias("classes"))


def data_ok(audited: DataFrame, differences: DataFrame, truth_files: int, evaluation: bool = False) -> DataFrame:
    """One row with ok: whether a run may begin. Files and truth are there and no label is missing; to evaluate, files are enough."""
    files = audited.agg(F.coalesce(F.sum("files"), F.lit(0))).scalar() > 0
    whole = differences.where("difference = 'missing'").agg(F.count("*")).scalar() == 0
    return audited.sparkSession.range(1).select((files if evaluation else files & whole & F.lit(truth_files > 0)).alias("ok"))


def label_differences(spark: SparkSession, seen: DataFrame) -> DataFrame:
    """class_name, difference: labels of the vocabulary not seen, and labels seen that it does not have."""
    known = spark.createDataFrame([(c,) for c in CLASSES], "class_name string")
    seen = seen.select("class_name").distinct()
    missing = known.join(seen, "class_name", "left_anti").select("class_name", F.lit("missing").alias("difference"))
    return missing.unionByName(seen.join(known, "class_name", "left_anti").select("class_name", F.lit("extra").alias("difference")))


def not_yet_extracted(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Entries (path, size) that are not there with the same size: what a resumed ingest still has to do."""
    return listed.join(present, ["path", "size"], "left_anti")


def check_cache(cache: DataFrame, least_rows: int = 200) -> DataFrame:
    """One row: rows, bad_vectors (null, empty or not finite), unknown_labels, usable."""
    known = F.col("label").isin(CLASSES)
    good = F.col("emb").isNotNull() & (F.size("emb") > 0) & F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = cache.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_vectors"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_labels"))
    return out.withColumn("usable", (F.col("rows") >= least_rows) & (F.col("bad_vectors") == 0) & (F.col("unknown_labels") == 0))


def write_cache(cache: DataFrame, path: str) -> None:
    cache.select("video_id", "label", "emb").write.mode("overwrite").option("compression", "zstd").parquet(path)


def stamped(folder: str, name: str, run_id: str, suffix: str = ".json") -> str:
    return f"{folder}/{name}_{run_id}{suffix}"


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls kept; refuses to overwrite an earlier run."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_document(document: DataFrame, path: str) -> None:
    """One JSON document (a single row with a single string column)."""
    document.coalesce(1).write.mode("errorifexists").text(path)
