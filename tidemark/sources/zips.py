"""Ingest of zip archives: entries listed, checked, set against what is there, and unpacked in tasks.

An archive's directory is read once, by the task that lists it: every entry carries along where it lies and how it is packed, so those that unpack
go straight to it. What is there already is looked up in tasks, by the entries' own paths.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.folders import STEP, sizes, store_of, tasks_for

ENTRIES = "zip string, turn long, entry long, name string, rel string, size long, header long, packed long, method int, crc long, flags int, outcome string"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
NAMES = [c.split()[0] for c in ENTRIES.split(", ")]


def inside(name: str, strip: str) -> tuple[str, bool]:
    """An entry's path below the destination, without the prefix `strip`, and whether it stays there."""
    rel = name.replace("\\", "/").removeprefix(strip)
    clean = posixpath.normpath(rel) if rel else ""
    return (clean, True) if rel and not (clean.startswith(("/", "../")) or clean == ".." or clean[1:2] == ":") else (clean, False)


def entries(spark: SparkSession, zips: list[str], strip: str = "") -> DataFrame:
    """zip, turn (of the zip), entry, name, rel, size, header, packed, method, crc, flags, outcome: every file in the archives, from their directories alone.

    outcome: null, or outside for a path that would leave the destination, or unreadable, one row for an archive that is none. Folders and
    names that are nothing but the prefix are left out.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, turn in zip(batch.column("zip").to_pylist(), batch.column("turn").to_pylist(), strict=True):
                store, at = store_of(path)
                try:
                    with store.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
                        infos = archive.infolist()
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # too short to have a directory
                    yield batch_of([(path, turn, 0, *[None] * 8, "unreadable")])
                    continue
                rows = []
                for i, info in enumerate(infos):
                    if not info.is_dir() and info.filename != strip:
                        rel, good = inside(info.filename, strip)
                        rows.append((path, turn, i, info.filename, rel, info.file_size, info.header_offset, info.compress_size, info.compress_type, info.CRC, info.flag_bits, None if good else "outside"))
                    if len(rows) >= STEP:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    listed = spark.createDataFrame([(path, turn) for turn, path in enumerate(zips)], "zip string, turn long")
    return listed.repartition(max(1, len(zips))).mapInArrow(read, ENTRIES)


def planned(listed: DataFrame, destination: str, force: bool = False) -> DataFrame:
    """`listed` with outcome: outside, unreadable, present, replaced or write.

    As if entries were unpacked one after the other: one whose file has its size already is present; of several that would be
    written to one place the last stays and the others are replaced. force: nothing counts as present.
    """
    there = sizes(listed.repartition("rel", "entry"), destination, "rel", ENTRIES)
    # entries that have an outcome already stand apart and keep it
    order = Window.partitionBy("outcome", "rel").orderBy("turn", "entry")
    last = Window.partitionBy("outcome", "rel").orderBy(F.desc("turn"), F.desc("entry"))
    before = F.coalesce(F.lag("size").over(order), "old")
    fresh = there.withColumn("fresh", F.lit(force) | before.isNull() | (before != F.col("size")))
    turned = fresh.withColumn("later", F.coalesce(F.sum(F.col("fresh").cast("int")).over(last.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    outcome = F.coalesce("outcome", F.when(~F.col("fresh"), "present").when(F.col("later") > 0, "replaced").otherwise("write"))
    return turned.withColumn("outcome", outcome).select(*NAMES)


def _opened(file: pa.NativeFile, name: str, size: int, header: int, packed: int, method: int, crc: int, flags: int) -> zipfile.ZipExtFile:
    """An entry's unpacked stream, checked against its sum at its end; found by its place, without the archive's directory."""
    if flags & 1:
        raise RuntimeError(f"{name} is encrypted")
    file.seek(header)
    raw = file.read(30)
    if len(raw) != 30 or raw[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no entry where {name} should be")
    file.seek(header + 30 + sum(struct.unpack_from("<HH", raw, 26)))
    info = zipfile.ZipInfo(name)
    info.compress_type, info.compress_size, info.file_size, info.CRC, info.flag_bits = method, packed, size, crc, flags
    return zipfile.ZipExtFile(file, "r", info)


def ingest(spark: SparkSession, zips: list[str], destination: str, strip: str = "", force: bool = False) -> DataFrame:
    """Unpacks archives below `destination`: zip, name, rel, size, outcome (written, present, replaced, outside, unreadable) of every entry.

    Entries are dealt out one by one, so a large archive fills many tasks, and each streams to a file that appears under its name when it is
    whole: what runs again after a lost executor finds it present or writes the same.
    """
    plan = planned(entries(spark, zips, strip), destination, force).checkpoint()
    needs = ["name", "size", "header", "packed", "method", "crc", "flags"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(destination)
        open_, file, made = None, None, set()
        for batch in batches:
            for path, rel, *entry in zip(*(batch.column(c).to_pylist() for c in ("zip", "rel", *needs)), strict=True):
                if path != open_:
                    if file:
                        file.close()
                    source, at = store_of(path)
                    open_, file = path, source.open_input_file(at)
                target = f"{base}/{rel}"
                if (folder := posixpath.dirname(target)) not in made:
                    store.create_dir(folder, recursive=True)
                    made = {*made, folder} if len(made) < STEP else {folder}
                part = f"{target}.{uuid.uuid4().hex}.part"
                with _opened(file, *entry) as unpacked, store.open_output_stream(part) as out:
                    while block := unpacked.read(1 << 20):
                        out.write(block)
                store.move(part, target)
            yield batch.select(["zip", "entry"])
        if file:
            file.close()

    due = plan.where("outcome = 'write'").select("zip", "entry", "rel", *needs)
    dealt = due.repartition(tasks_for(spark, due.count()), "zip", "entry").sortWithinPartitions("zip", "entry")
    done = dealt.mapInArrow(write, "zip string, entry long").withColumn("written", F.lit(True)).checkpoint()
    both = plan.join(done, ["zip", "entry"], "left")
    return both.select("zip", "name", "rel", "size", F.when(F.col("written"), "written").otherwise(F.col("outcome")).alias("outcome"))
