"""Substring dedup by fixed-block anchors.

Any window of W words holds a whole block of B = (W + 1) // 2 words that begins at a multiple of B
in its document. So the non-overlapping blocks of all documents are the index, and every rolling
window of B words probes it:

1. Documents are cut into chunks once, and chunks are dealt into blocks, which are written to the shared folder.
   Each chunk's distinct B-word hashes, in compact sorted form, go to hash buckets, with a mark on those that
   are reference blocks; a block sends one message to a bucket for all its chunks. A bucket answers which
   of them occur elsewhere too and are a reference block somewhere: the anchors.
2. Anchors are extended: the W-word windows around them are the candidates. Their 64-bit hashes (with the
   bucket's bits on top) go to buckets again, which answer those that start at two places at least.
3. Overlapping repeated windows join to maximal exact repeats, which are cut from the texts.

A hash that a third of all documents share is sent once by each chunk, never once by each document, and
nothing is ever paired, so hot passages cost no more than others. Answers are bit masks over a block's
message. Blocks and buckets both grow with the square root of the text, so that messages stay long: there
are about text bytes / `LEAST_MESSAGE` of them at any size, not chunks times buckets.

Chunks stay where they were written, dealt by block: the answers are sent to them, and only the first cut moves texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import counted_only, dealt, kept, release, shared_dir, slim
from tidemark.llm.wordhash import Words, flat, slices

#: Text bytes of a chunk; numpy needs about fifty times as much for a moment.
CHUNK = 3 << 20
#: Text bytes whose hashes make a message from a block to a bucket, at least.
LEAST_MESSAGE = 4096


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted integers as byte planes, compressed: the upper planes shrink to almost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(packed: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(packed[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[4:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + pa.compress(np.packbits(flags).tobytes(), codec="zstd", asbytes=True)


def _flags(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    return np.unpackbits(np.frombuffer(pa.decompress(packed[4:], decompressed_size=-(-n // 8), codec="zstd", asbytes=True), np.uint8), count=n).astype(bool)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class _Sent:
    """A chunk's distinct hashes as they are sent, bucket by bucket, and how windows map to them."""

    def __init__(self, h: np.ndarray, buckets: int, bits: int):
        low = h & np.uint64(0xFFFFFFFF) if bits == 32 else h
        bucket = _bucket(h, buckets)
        order = np.lexsort((low, bucket))
        low, bucket = low[order], bucket[order]
        new = np.ones(len(h), bool)
        new[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
        self.start = np.flatnonzero(new)
        self.order, self.group = order, np.cumsum(new) - 1
        self.values = low[self.start].astype(np.uint32 if bits == 32 else np.uint64)
        self.count = np.diff(np.append(self.start, len(h)))
        self.edges = np.searchsorted(bucket[self.start], np.arange(buckets + 1))

    def any(self, flags: np.ndarray) -> np.ndarray:
        """For each distinct hash, whether `flags` holds for one of its windows."""
        return np.logical_or.reduceat(flags[self.order], self.start) if len(self.start) else np.zeros(0, bool)

    def back(self, hits: np.ndarray) -> np.ndarray:
        """For each window, what holds for its hash."""
        out = np.zeros(len(self.order), bool)
        out[self.order] = hits[self.group] if len(self.order) else False
        return out

    def sizes(self) -> np.ndarray:
        """How many distinct hashes go to each bucket."""
        return np.diff(self.edges)


class _Chunk:
    def __init__(self, payload: bytes, window: int, buckets: int):
        self.table = pa.ipc.open_stream(payload).read_all()
        self.window, self.anchor, self.buckets = window, (window + 1) // 2, buckets
        self.words = Words(*flat(self.table.column("text")))

    @cached_property
    def _blocks(self) -> tuple[np.ndarray, _Sent]:
        at, h = self.words.windows(self.anchor)
        return at, _Sent(h, self.buckets, 32)

    @property
    def at(self) -> np.ndarray:
        return self._blocks[0]

    @property
    def anchors(self) -> _Sent:
        return self._blocks[1]

    def reference(self) -> np.ndarray:
        first = np.repeat(self.words.first[:-1], self.words.counts)[self.at]
        return self.anchors.any((self.at - first) % self.anchor == 0)

    def candidates(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows that hold an anchor; answers: of each distinct hash sent, in order."""
        total = np.zeros(len(self.words.hash) + 1, np.int32)
        hit = np.zeros(len(self.words.hash), bool)
        hit[self.at] = self.anchors.back(answers)
        np.cumsum(hit, out=total[1:])
        at, h = self.words.windows(self.window)
        keep = total[at + self.window - self.anchor + 1] > total[at]
        return at[keep], h[keep]

    def covered(self, first: _Masks, second: _Masks) -> np.ndarray:
        """Which words lie in a repeated window."""
        if not first.masks:
            return np.zeros(len(self.words.hash), bool)
        at, h = self.candidates(first.next(self.anchors.sizes()))
        sent = _Sent(h, self.buckets, 64)
        at = at[sent.back(second.next(sent.sizes()))]
        edge = np.zeros(len(self.words.hash) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


class _Message:
    """What the chunks of a block send, each its own part after the other, gathered by bucket."""

    def __init__(self, block: int, chunks: int, buckets: int):
        self.block, self.sizes = block, np.zeros((chunks, buckets), np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, found: _Sent, marks: np.ndarray) -> None:
        self.sizes[len(self.parts)] = found.sizes()
        self.parts.append((found.values, marks, found.count > 1))

    def batches(self) -> pa.RecordBatch:
        """One row for each bucket that gets anything."""
        bucket = np.concatenate([np.repeat(np.arange(self.sizes.shape[1]), n) for n in self.sizes])
        order = np.argsort(bucket, kind="stable")
        values, marks, several = (np.concatenate(x)[order] for x in zip(*self.parts, strict=True))
        total = self.sizes.sum(axis=0)
        full, ends = np.flatnonzero(total), np.cumsum(total)
        cut = [slice(ends[b] - total[b], ends[b]) for b in full]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.block] * len(full), pa.int64()),
                pa.array(full, pa.int32()),
                pa.array([_squeeze(values[c]) for c in cut], pa.binary()),
                pa.array([_bits(marks[c]) for c in cut], pa.binary()),
                pa.array([_bits(several[c]) for c in cut], pa.binary()),
            ],
            ["block", "bucket", "values", "marks", "several"],
        )


class _Masks:
    """A block's answers of one kind by bucket, read part by part in the order in which its chunks were sent."""

    def __init__(self, answers: pa.Table, kind: int, buckets: int):
        rows = zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True)
        self.masks = {bucket: _flags(body) for k, bucket, body in rows if k == kind}
        self.used = np.zeros(buckets, np.int64)

    def next(self, sizes: np.ndarray) -> np.ndarray:
        """The answers to the distinct hashes of the next chunk, which sends `sizes` of them to the buckets."""
        out = np.zeros(sizes.sum(), bool)
        ends = np.cumsum(sizes)
        for bucket, mask in self.masks.items():
            n, at = sizes[bucket], self.used[bucket]
            out[ends[bucket] - n : ends[bucket]] = mask[at : at + n]
        self.used += sizes
        return out


def remove_repeats(docs: DataFrame, keep: list[str], window: int = 35, bucket_bytes: int = 8 << 20, leave_clean: bool = False) -> DataFrame:
    """Columns `keep` of `docs` with kept, n_words, n_removed and spans.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Every word covered by a window of `window` words whose
    sequence also starts anywhere else, in the same document or another, is removed at all its places;
    windows are judged on the input. kept: the other words joined by one space, or, with `leave_clean`,
    the text as it is where nothing is removed; spans: the maximal exact repeats as (first word, words).

    Edge cases: a null or empty text has no word and keeps nothing (kept is empty); a document of fewer
    than `window` words loses nothing; a repeated row is a repeat like any other; a kept column named like a
    result is replaced by it; other columns of `docs` do not matter. `docs` is read once for its size and
    once for its rows, so that a session setting that changes later, or an input whose rows come in another order, changes nothing.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    size = docs.select(F.octet_length(F.col("text").cast("string")).cast("long").alias("bytes"), F.spark_partition_id().alias("part")).agg(F.sum("bytes").alias("bytes"), F.max("part").alias("last")).collect()[0]
    text_bytes, parts = size["bytes"] or 0, (size["last"] or 0) + 1
    side = int((text_bytes * LEAST_MESSAGE) ** 0.5)
    buckets = max(4, -(-text_bytes // max(bucket_bytes, side)))
    blocks = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // max(CHUNK, side))))
    names, columns, types = kept(docs, keep, ["kept", "n_words", "n_removed", "spans"])
    rows = docs.select(*columns, F.col("text").cast("string").alias("text"))

    def payload(part: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        return sink.getvalue().to_pybytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([payload(part)], pa.binary())], ["body"])

    def chunks_of(group: pa.Table) -> Iterator[_Chunk]:
        for body in group.sort_by("chunk").column("body"):
            yield _Chunk(body.as_py(), window, buckets)

    def probe(group: pa.Table) -> pa.Table:
        message = _Message(group.column("block")[0].as_py(), group.num_rows, buckets)
        for chunk in chunks_of(group):
            message.add(chunk.anchors, chunk.reference())
        return pa.Table.from_batches([message.batches()])

    def answer(kind: int):
        number = np.uint32 if kind == 1 else np.uint64

        def run(group: pa.Table) -> pa.Table:
            columns = {c: group.column(c).to_pylist() for c in group.column_names}
            parts = [_expand(x, number) for x in columns["values"]]
            marks, several = (np.concatenate([_flags(x) for x in columns[c]]) for c in ("marks", "several"))
            values = np.concatenate(parts)
            order = np.argsort(values, kind="stable")
            new = np.ones(len(values), bool)
            new[1:] = values[order][1:] != values[order][:-1]
            start = np.flatnonzero(new)
            repeated = (np.diff(np.append(start, len(values))) > 1) | np.logical_or.reduceat(several[order], start)
            hits = repeated & np.logical_or.reduceat(marks[order], start)
            flags = np.zeros(len(values), bool)
            flags[order] = hits[np.cumsum(new) - 1]
            ends = np.cumsum([0, *map(len, parts)])
            some = [i for i in range(len(parts)) if flags[ends[i] : ends[i + 1]].any()]
            return pa.table(
                {
                    "block": pa.array([columns["block"][i] for i in some], pa.int64()),
                    "kind": pa.array([kind] * len(some), pa.int32()),
                    "bucket": pa.array([columns["bucket"][i] for i in some], pa.int32()),
                    "body": pa.array([_bits(flags[ends[i] : ends[i + 1]]) for i in some], pa.binary()),
                }
            )

        return run

    def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("values", "marks", "several")}})
        message, masks = _Message(group.column("block")[0].as_py(), group.num_rows, buckets), _Masks(answers, 1, buckets)
        for chunk in chunks_of(group):
            _, h = chunk.candidates(masks.next(chunk.anchors.sizes()))
            candidates = _Sent(h, buckets, 64)
            message.add(candidates, np.ones(len(candidates.values), bool))
        return pa.Table.from_batches([message.batches()])

    def cut_out(group: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        first, second = _Masks(answers, 1, buckets), _Masks(answers, 2, buckets)
        for chunk in chunks_of(group):
            words, gone = chunk.words, chunk.covered(first, second)
            raw = words.data.tobytes()
            _, offsets = flat(chunk.table.column("text"))
            left, removed, spans = [], np.zeros(words.rows, np.int64), []
            for row in range(words.rows):
                a, z = words.first[row], words.first[row + 1]
                own = gone[a:z]
                whole = raw[offsets[row] : offsets[row + 1]]
                if own.any():
                    removed[row] = own.sum()
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans.append([{"first": int(x), "words": int(y - x)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    left.append(b" ".join([w for w, g in zip(whole.split(), own.tolist(), strict=True) if not g]))
                else:
                    spans.append([])
                    left.append(whole if leave_clean else b" ".join(whole.split()))
            table = chunk.table.drop_columns(["text"])
            table = table.append_column("kept", pa.array(left, pa.binary()).cast(pa.string()))
            table = table.append_column("n_words", pa.array(words.counts, pa.int64())).append_column("n_removed", pa.array(removed))
            out.append(table.append_column("spans", pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))))
        return pa.concat_tables(out)

    sent_ddl = "block long, bucket int, values binary, marks binary, several binary"
    answer_ddl = "block long, kind int, bucket int, body binary"
    # chunks get their names and blocks here, once, and are read from the shared folder ever after
    named = rows.mapInArrow(counted_only(pack), "body binary").select(F.monotonically_increasing_id().alias("chunk"), "body")
    # the first chunks of all partitions, then their second ones, and so on, in turn to the blocks
    turn = F.col("chunk").bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright("chunk", 33)
    chunks = dealt(named, F.pmod(turn, F.lit(blocks)), blocks, "block")
    release(spark)
    by_block = chunks.groupBy("block")
    anchors = by_block.applyInArrow(slim(probe), sent_ddl).groupBy("bucket").applyInArrow(slim(answer(1)), answer_ddl).checkpoint()
    candidates = by_block.cogroup(anchors.groupBy("block")).applyInArrow(slim(extend), sent_ddl)
    repeats = candidates.groupBy("bucket").applyInArrow(slim(answer(2)), answer_ddl).checkpoint()
    ddl = ", ".join([*([types] if types else []), "kept string, n_words long, n_removed long, spans array<struct<first:int,words:int>>"])
    done = by_block.cogroup(anchors.unionByName(repeats).groupBy("block")).applyInArrow(slim(cut_out), ddl)
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), "kept", "n_words", "n_removed", "spans")
