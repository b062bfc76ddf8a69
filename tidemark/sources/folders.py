"""Folders of very many files: listed and read in tasks, so that the driver holds neither names nor contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that are looked up or read at a time, and the bytes read after which they are sent on.
STEP, BYTES = 4096, 4 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many files: each core has some, and none has more than a few thousand."""
    return max(1, min(rows, max(spark.sparkContext.defaultParallelism, rows // STEP)))


def below(spark: SparkSession, folder: str, deep: bool = True) -> DataFrame:
    """rel, size of the files below a folder, or, if not deep, of those right in it; none, if it is not there. A folder is listed by one task, a level of them side by side."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for batch in batches:
            for rel in batch.column("rel").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base, allow_not_found=True))
                for a in range(0, len(found), STEP):
                    some = found[a : a + STEP]
                    columns = [pa.array([f.path[len(base) + 1 :] for f in some], pa.string()), pa.array([f.size for f in some], pa.int64()), pa.array([f.is_file for f in some], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["rel", "size", "file"])

    ahead, files = spark.createDataFrame([("",)], "rel string"), None
    while (n := ahead.count()) > 0:
        level = ahead.repartition(tasks_for(spark, n)).mapInArrow(look, "rel string, size long, file boolean").checkpoint()
        here, ahead = level.where("file").select("rel", "size"), level.where("NOT file").select("rel")
        files = here if files is None else files.unionByName(here)
        if not deep:
            break
    return files


def sizes(names: DataFrame, folder: str, name: str, types: str) -> DataFrame:
    """The rows of `names` with old: the size of the file called by `name` below the folder; null where there is none. types: those of `names` as DDL."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for batch in batches:
            rel = batch.column(name).to_pylist()
            info = store.get_file_info([f"{base}/{r}" if r else base for r in rel])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([i.size if i.is_file else None for i in info], pa.int64())], [*batch.schema.names, "old"])

    return names.mapInArrow(look, f"{types}, old long")


def contents(files: DataFrame, folder: str) -> DataFrame:
    """rel, content (binary) of files (rel, size) below a folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for batch in batches:
            rels, got, held = [], [], 0
            for rel in batch.column("rel").to_pylist():
                with store.open_input_file(f"{base}/{rel}") as file:
                    got.append(file.read())
                rels.append(rel)
                held += len(got[-1])
                if held >= BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(got, pa.binary())], ["rel", "content"])
                    rels, got, held = [], [], 0
            if rels:
                yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(got, pa.binary())], ["rel", "content"])

    spark = files.sparkSession
    return files.select("rel").repartition(tasks_for(spark, files.count())).mapInArrow(read, "rel string, content binary")
