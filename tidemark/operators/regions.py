"""The largest moving region of a frame difference: threshold, dilation, labelled regions, the box of the largest.

Frames are rows with a grid of absolute differences as an array column; each is labelled on its own, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end column of every run of true cells, in reading order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """The number (from 1) of each true cell's connected region, 0 elsewhere: row runs are joined where they touch the row above's."""
    row, first, end = runs_of(mask)
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach, above = int(diagonal), 0
    for i in range(len(row)):
        while above < i and (row[above] < row[i] - 1 or row[above] == row[i] - 1 and end[above] + reach <= first[i]):
            above += 1
        j = above
        while j < i and row[j] == row[i] - 1 and first[j] < end[i] + reach:
            root[max(find(i), find(j))] = min(find(i), find(j))
            j += 1
    out, number = np.zeros(mask.shape, np.int64), {}
    for i in range(len(row)):
        out[row[i], first[i] : end[i]] = number.setdefault(find(i), len(number) + 1)
    return out


def dilate(mask: np.ndarray, reach: int) -> np.ndarray:
    """True wherever a true cell is within `reach` rows and columns."""
    for axis in (0, 1):
        wide = np.pad(mask, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=axis).any(axis=-1)
    return mask


def enclosed_area(region: np.ndarray) -> float:
    """Area within the outline through the outermost cells' centres, holes included: a square of four filled cells counts 1, of three one half."""
    outside = label(np.pad(~region, 1, constant_values=True), diagonal=False)
    filled = (outside != outside[0, 0]).astype(np.int64)
    square = filled[:-1, :-1] + filled[1:, :-1] + filled[:-1, 1:] + filled[1:, 1:]
    return float((square == 4).sum() + (square == 3).sum() / 2)


def largest(diff: np.ndarray, threshold: float, reach: int, least: int) -> tuple[int, int, int, int] | None:
    """x, y, w, h of the region of greatest enclosed area among cells above the threshold, dilated; none where w * h is below `least`."""
    labels = label(dilate(diff > threshold, reach))
    best = None
    for n in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == n)
        y0, x0, h, w = y.min(), x.min(), y.max() - y.min() + 1, x.max() - x.min() + 1
        found = (-enclosed_area(labels[y0 : y0 + h, x0 : x0 + w] == n), int(y0), int(x0), int(w), int(h))
        best = found if best is None or found < best else best
    if best is None or best[3] * best[4] < least:
        return None
    return best[2], best[1], best[3], best[4]


def moving_regions(frames: DataFrame, height: int, width: int, threshold: float = 18.0, reach: int = 4, least: int = 12, frame_size: tuple[int, int] | None = None) -> DataFrame:
    """`frames` with box: x, y, w, h of the largest moving region of `diff`, height * width differences row by row, or null.

    Two dilations by five cells reach 4. Of equal areas the one whose box is higher, then farther left, counts. frame_size: (height, width) of the
    whole frame, to which the box is then scaled and cut to whole pixels. A diff that is null, of another length, or without a cell
    above the threshold has no box; null and NaN cells are still.
    """
    down, right = (frame_size[0] / height, frame_size[1] / width) if frame_size else (1, 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = []
            for diff in batch.column(batch.num_columns - 1):
                cells = np.array(diff.as_py() or [], np.float64)
                box = largest(np.nan_to_num(cells, nan=-np.inf).reshape(height, width), threshold, reach, least) if len(cells) == height * width else None
                boxes.append(None if box is None else {"x": int(box[0] * right), "y": int(box[1] * down), "w": int(box[2] * right), "h": int(box[3] * down)})
            kind = pa.struct([(c, pa.int32()) for c in "xywh"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(boxes, kind)], [*batch.schema.names[:-1], "box"])

    others = [c for c in frames.columns if c not in ("diff", "box")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*others).schema)
    return frames.select(*others, F.col("diff").cast("array<double>")).mapInArrow(find, f"{types}, box struct<x:int,y:int,w:int,h:int>")
