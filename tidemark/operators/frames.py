"""Frame-level operators: stride sampling, the stateful gate, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import rounded


def stride(source_rate: Column, target: float) -> Column:
    """Every how many-th frame is sampled; a rate that is missing, NaN or not positive counts as 25."""
    rate = F.when(F.isnan(source_rate) | (source_rate <= 0), None).otherwise(source_rate)
    return F.greatest(F.lit(1), F.rint(F.coalesce(rate, F.lit(25.0)) / target).cast("int"))


def sample(frames: DataFrame, target: float, rate: str = "source_rate") -> DataFrame:
    """Every stride-th frame of each video, from the first."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "event_id")) - 1
    return frames.withColumn("_n", n).where(F.col("_n") % stride(F.col(rate), target) == 0).drop("_n")


def motion(frames: DataFrame) -> DataFrame:
    """`frames` with motion: the change of signal against the frame before; 0 for a video's first."""
    before = F.lag("signal").over(Window.partitionBy("video_id").orderBy("t", "event_id"))
    return frames.withColumn("motion", F.coalesce(F.abs(F.col("signal") - before), F.lit(0.0)))


def _cut(frames: DataFrame, config: Config) -> DataFrame:
    """`frames` with sure, the reason where a frame passes whatever was before, and part, the number of its stretch: a video is cut at such frames."""
    by_time = Window.partitionBy("video_id").orderBy("t", "event_id")
    before = F.lag("t").over(by_time)
    why = F.when(before.isNull(), "first").when(F.col("motion") >= config.gate_signal, "motion").when(F.col("t") - before >= config.gate_keepalive, "keepalive")
    cut = frames.select("video_id", "event_id", "t", "motion", why.alias("sure"))
    return cut.withColumn("part", F.count("sure").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))


def gate(frames: DataFrame, config: Config) -> DataFrame:
    """`frames` (video_id, event_id, t, motion) with why: first, motion, keepalive, or skipped.

    A frame passes if it moves enough or if the last *passed* frame is long ago, which is a recursion. But a frame that
    moves enough, or that comes so long after the frame before it, passes whatever was before. So a video is cut at
    those, and each quiet stretch between them is a fold: over pieces of about the root of its length, each a fold of its own, so that no
    array grows step by step over the whole stretch. `gate_grouped` suits stretches that are too long for one row.
    """
    ordered = _cut(frames, config).groupBy("video_id", "part").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "motion", "sure"))).alias("rows"))

    def step(state: Column, row: Column) -> Column:
        why = F.coalesce(row["sure"], F.when(row["t"] - state["last"] >= config.gate_keepalive, "keepalive").otherwise("skipped"))
        return F.struct(F.when(why == "skipped", state["last"]).otherwise(row["t"]).alias("last"), F.array_append(state["why"], why).alias("why"))

    def piece(done: Column, rows: Column) -> Column:
        start = F.struct(F.get(done, F.size(done) - 1)["last"].alias("last"), F.array().cast("array<string>").alias("why"))
        return F.array_append(done, F.aggregate(rows, start, step))

    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size("rows"))).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / F.col("size")).cast("int")), lambda k: F.slice("rows", k * F.col("size") + 1, F.col("size")))
    none = F.array().cast("array<struct<last:double,why:array<string>>>")
    folded = ordered.withColumn("size", size).select("video_id", "rows", F.flatten(F.aggregate(pieces, none, piece)["why"]).alias("why"))
    return folded.select("video_id", F.explode(F.arrays_zip("rows", "why")).alias("z")).select("video_id", "z.rows.event_id", "z.rows.t", "z.rows.motion", "z.why")


def gate_grouped(frames: DataFrame, config: Config) -> DataFrame:
    """The same gate, its stretches dealt out and each read once in order of time.

    From one passed frame it jumps to the first that is late enough. A stretch may be of any length: a task holds one Arrow batch of it.
    """
    cut = _cut(frames, config).withColumnRenamed("sure", "why")
    keepalive = config.gate_keepalive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            video, part, t = (batch.column(c).to_numpy() for c in ("video_id", "part", "t"))
            start = np.flatnonzero(np.append(True, (video[1:] != video[:-1]) | (part[1:] != part[:-1])))
            end = np.append(start[1:], len(t))
            why = np.array(["skipped" if w is None else w for w in batch.column("why").to_pylist()], object)
            goes_on = held == (video[0], part[0])
            # a stretch is new but for the first of a batch; a new one that is short has no further frame to pass
            for a, b in zip(*(x[(t[end - 1] - t[start] >= keepalive) | (goes_on & (start == 0))].tolist() for x in (start, end)), strict=True):
                now = last if goes_on and a == 0 else t[a]
                i = a if goes_on and a == 0 else a + 1
                while True:
                    i += int(np.searchsorted(t[i:b], now + keepalive))
                    while i > a and t[i - 1] - now >= keepalive:  # the difference decides, not the rounded sum
                        i -= 1
                    while i < b and t[i] - now < keepalive:
                        i += 1
                    if i >= b:
                        break
                    why[i], now = "keepalive", t[i]
                    i += 1
                if b == len(t):
                    held, last = (video[a], part[a]), now
            if held != (video[-1], part[-1]):
                held, last = (video[-1], part[-1]), t[start[-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("video_id", "event_id", "t", "motion")), pa.array(why, pa.string())], ["video_id", "event_id", "t", "motion", "why"])

    dealt = cut.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "t", "event_id")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select("video_id", "event_id", "t", "motion").schema)
    return dealt.mapInArrow(run, f"{types}, why string")


#: Rows from which on a group is not put together in one task.
LARGE = 1 << 20


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], keys: tuple[str, ...] = (), cells: int = 256) -> DataFrame:
    """One row for each of `keys` with the exact percentiles (linear between ranks) of `column` under the names of `shares`.

    A quantile sketch of each group, summed up from partial ones, gives two borders around each wanted rank, one part in `cells` of the
    ranks below and above it. The cells between borders are counted exactly, and equal values are counted, not ranked; only the different
    values of cells that hold a wanted rank are put in order: a part in cells / 2 of a group's, wherever they lie. If a border were wrong, the next
    cell would hold the rank and be ordered: the result is exact in any case. Nulls do not count, NaN comes last.
    Groups of more than LARGE rows, of which there are few, have their borders broadcast, so that none is put together in one task.
    """
    rows = rows.select(*keys, F.col(column).cast("double").alias("x")).where("x is not null")
    if not keys:
        return _ranked(rows.withColumn("_all", F.lit(0)), shares, ("_all",), cells, True).drop("_all")
    large = F.broadcast(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select(*keys))
    many, few = rows.join(large, list(keys), "left_semi"), rows.join(large, list(keys), "left_anti")
    return _ranked(many, shares, keys, cells, True).unionByName(_ranked(few, shares, keys, cells, False))


def _ranked(rows: DataFrame, shares: dict[str, float], keys: tuple[str, ...], cells: int, spread: bool) -> DataFrame:
    """`percentiles` of rows (`keys`, x). spread: rows stay where they are and what is known of their groups is broadcast."""
    around = sorted({min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-1 / cells, 1 / cells)})
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan("x"), F.col("x")), F.lit(4096))
    borders = rows.groupBy(*keys).agg(sketch.alias("_s"), F.count("*").alias("n"), F.count_if(~F.isnan("x")).alias("_m"))
    borders = borders.select(*keys, "n", F.when(F.col("_m") > 0, F.kll_sketch_get_quantile_double("_s", F.array(*map(F.lit, around)))).alias("_b"))
    # the number of borders below a value is its cell; a cell is known by its borders from here on, as another sketch has others
    below = [F.coalesce((F.col("x") > F.get("_b", F.lit(i))).cast("int"), F.lit(0)) for i in range(len(around))]
    celled = rows.join(F.broadcast(borders) if spread else borders, list(keys)).withColumn("cell", sum(below[1:], below[0]))
    cell = [*keys, "n", "cell", F.get("_b", F.col("cell") - 1).alias("lo"), F.get("_b", F.col("cell")).alias("hi")]
    sofar = (Window.unboundedPreceding, 0)
    held = celled.select(*cell).groupBy(*keys, "n", "cell", "lo", "hi").agg(F.count("*").alias("m"))
    held = held.withColumn("end", F.sum("m").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(*sofar))).withColumn("begin", F.col("end") - F.col("m"))
    # a value between two ranks needs both; they may lie in two cells
    at = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    wanted = [F.struct(F.lit(name).alias("name"), (x - F.floor(x)).alias("part"), F.lit(turn).alias("turn"), (F.floor(x).cast("long") + turn).alias("rank")) for name, x in at.items() for turn in (0, 1)]
    held = held.withColumn("wanted", F.filter(F.array(*wanted), lambda w: (w["rank"] >= F.col("begin")) & (w["rank"] < F.col("end")))).where(F.size("wanted") > 0)
    asked = held.select(*keys, "cell", "lo", "hi", "begin", "wanted")
    inside = rows.join(F.broadcast(asked) if spread else asked, list(keys)).where((F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") <= F.col("hi"))))
    counted = inside.groupBy(*keys, "cell", "x").agg(F.count("*").alias("m"), F.max("begin").alias("begin"), F.first("wanted").alias("wanted"))
    upto = F.col("begin") + F.sum("m").over(Window.partitionBy(*keys, "cell").orderBy("x").rowsBetween(*sofar))
    ordered = counted.withColumn("to", upto).withColumn("from", F.col("to") - F.col("m"))
    found = ordered.select(*keys, "x", "from", "to", F.explode("wanted").alias("w")).where((F.col("w.rank") >= F.col("from")) & (F.col("w.rank") < F.col("to")))
    values = found.groupBy(*keys, F.col("w.name").alias("name"), F.col("w.part").alias("part")).agg(F.max(F.when(F.col("w.turn") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("w.turn") == 1, F.col("x"))).alias("b"))
    value = F.when((F.col("part") == 0) | F.col("b").isNull(), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    return values.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares))


def normal_videos(truth: DataFrame, n: int = 12, order: str = "video_id") -> DataFrame:
    """video_id: the first n different videos, by `order`, that have a label normal and a path; truth: video_id, class_name, path."""
    normal = truth.where("class_name = 'normal' AND path IS NOT NULL AND video_id IS NOT NULL")
    return normal.groupBy("video_id").agg(F.min(order).alias("_first")).orderBy("_first", "video_id").limit(n).select("video_id")


def calibrate(frames: DataFrame, percentile: float, videos: DataFrame | None = None) -> DataFrame:
    """One row: exact threshold at `percentile` (linear), mean, 1st and 50th and 99th percentile of health; of the frames of `videos` only, where given.

    Without frames there is no row, and the threshold stays as it was.
    """
    if videos is not None:
        frames = frames.join(videos.select("video_id"), "video_id", "left_semi")
    ranks = percentiles(frames, "health", {"threshold": percentile, "p1": 0.01, "p50": 0.5, "p99": 0.99})
    mean = frames.agg(F.avg("health").alias("mean"))
    return ranks.withColumn("_one", F.lit(1)).join(F.broadcast(mean.withColumn("_one", F.lit(1))), "_one").select("threshold", "mean", "p1", "p50", "p99")


def thresholds(frames: DataFrame, percentile: float) -> DataFrame:
    """video_id, threshold: each video's own percentile, for want of a calibrated one."""
    return frames.groupBy("video_id").agg(F.percentile("health", percentile).alias("threshold"))


def escalation_rate(windows: DataFrame, frames: DataFrame, places: int | None = 4) -> DataFrame:
    """video_id, rate: frames in escalated windows over all frames, to so many places (None: as it is)."""
    inside = windows.where("source = 'escalated'").groupBy("video_id").agg(F.sum("n_frames").alias("inside"))
    rate = F.coalesce("inside", F.lit(0)) / F.greatest("count", F.lit(1))
    return frames.groupBy("video_id").count().join(inside, "video_id", "left").select("video_id", (rate if places is None else rounded(rate, places)).alias("rate"))
