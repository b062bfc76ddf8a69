"""The folder that driver and executors share, and files handed to every executor."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(told)
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(docs: DataFrame, keep: list[str], results: list[str]) -> tuple[list[str], list[Column], str]:
    """Names of `keep` that no result takes (those are replaced by the results), as columns k0, k1, ..., and their types as DDL."""
    names = [c for c in keep if c.lower() not in results]
    types = [f.dataType.simpleString() for f in docs.select(*map(column, names)).schema]
    return names, [column(c).alias(f"k{i}") for i, c in enumerate(names)], ", ".join(f"k{i} {t}" for i, t in enumerate(types))


def with_text(docs: DataFrame, names: list[str], columns: list[Column]) -> tuple[list[Column], str]:
    """`columns` and the text as a string, and its name there; a text that is kept anyway is sent to Python once, not twice."""
    if "text" in names and docs.schema["text"].dataType.simpleString() == "string":
        return columns, f"k{names.index('text')}"
    return [*columns, F.col("text").cast("string").alias("text")], "text"


def hand_out(spark: SparkSession, content: bytes, stem: str) -> str:
    """Make `content` a file on every executor; returns its name for SparkFiles.get.

    It is written to the shared folder by Hadoop's file system, under a name made of its contents, and
    each executor fetches it once, also one that joins later or replaces a lost one. The name appears only
    when the file is whole.
    """
    name = f"{stem}-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark), name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(shared_dir(spark), f"{name}.{uuid.uuid4().hex}")
        out = files.create(part, True)
        for a in range(0, len(content), 1 << 20):
            out.write(bytearray(content[a : a + (1 << 20)]))
        out.close()
        if not files.rename(part, path):  # another driver was first with the same contents
            files.delete(part, False)
    spark.sparkContext.addFile(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return name


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own in the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting for the jobs that run inside; afterwards it is what it was."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of `rows` rows at most in what runs inside; for operators that end all Python work before they return."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    return setting(spark, name, min(now, rows) if now > 0 else rows)


def dealt(df: DataFrame, slot: Column, parts: int, key: str) -> DataFrame:
    """`df` with a column `key`, dealt by it into `parts` and written to the shared folder; later groupings by `key` find it so and move nothing.

    slot: numbers from 0 to parts - 1; each stands for a partition of its own, as its key is a number that Spark
    sends there. Spark remembers how a checkpointed table is dealt only if it was planned without adaptive execution.
    """
    spark = df.sparkSession
    shared_dir(spark)
    keys = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).cast("long").alias("_slot")).agg(F.min("id").alias("_key"))
    named = df.withColumn("_slot", slot.cast("long")).join(F.broadcast(keys), "_slot", "left")  # a row for each part
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        return named.withColumn(key, F.coalesce("_key", "_slot")).drop("_slot", "_key").repartition(parts, key).checkpoint()


def give_back() -> None:
    """Returns memory that this process no longer uses to the machine; a Python worker lives on after its task, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def slim(run: Callable) -> Callable:
    """`run`, a function of one group or of two, that gives its memory back afterwards."""
    if len(inspect.signature(run).parameters) == 1:

        def one(group: pa.Table) -> pa.Table:
            try:
                return run(group)
            finally:
                give_back()

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return two


def counted_only(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` with Python's cycle collector at rest: it makes no cycles, and the collector would walk all that it remembers again and again.

    At the end memory is given back.
    """

    @functools.wraps(run)
    def quiet(batches: Iterator) -> Iterator:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()
            give_back()

    return quiet


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
