"""Moving regions against plain flood fills, and their areas against outlines that are followed."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import regions


def flood(mask, steps):
    """The regions of a mask as sets of cells, by plain flood filling."""
    left, out = {tuple(c) for c in np.argwhere(mask).tolist()}, []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            c = todo.pop()
            if c in left:
                left.remove(c)
                part.add(c)
                todo += [(c[0] + dy, c[1] + dx) for dy, dx in steps]
        out.append(part)
    return out


EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def outline_area(cells):
    """Area within the outer border followed cell by cell from its first cell, by the trapezoid rule."""
    turns = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    start = at = min(cells)
    came, path = 6, [start]
    if len(cells) == 1:
        return 0.0
    first = None
    while True:
        for k in range(8):
            way = (came + 6 + k) % 8 if path[1:] else (k + 4) % 8
            y, x = at[0] + turns[way][0], at[1] + turns[way][1]
            if (y, x) in cells:
                break
        if first is None:
            first = way
        elif at == start and way == first:
            break
        at, came = (y, x), way
        path.append(at)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:]))) / 2


def test_labels_are_flood_fills():
    r = np.random.default_rng(1)
    for share in (0.1, 0.35, 0.5, 0.7, 1.0, 0.0):
        mask = r.random((17, 23)) < share
        for diagonal, steps in ((True, EIGHT), (False, [(0, 1), (1, 0), (0, -1), (-1, 0)])):
            labels = regions.label(mask, diagonal)
            got = {frozenset(map(tuple, np.argwhere(labels == n).tolist())) for n in range(1, labels.max() + 1)}
            assert got == {frozenset(p) for p in flood(mask, steps)} and ((labels > 0) == mask).all()


def test_area_is_that_of_the_outline():
    r = np.random.default_rng(2)
    for share in (0.02, 0.1, 0.2, 0.4):
        for _ in range(20):
            mask = regions.dilate(r.random((14, 16)) < share, int(r.integers(0, 3)))
            for part in flood(mask, EIGHT):
                one = np.zeros(mask.shape, bool)
                one[tuple(np.array(sorted(part)).T)] = True
                assert regions.enclosed_area(one) == outline_area(part)


def test_dilation_reaches_as_far_as_two_squares_of_five():
    mask = np.zeros((90, 160), bool)
    mask[40, 80] = mask[0, 0] = True
    wide = regions.dilate(mask, 4)
    assert wide.sum() == 81 + 25 and wide[36:45, 76:85].all() and wide[:5, :5].all()


def test_boxes_of_frames(spark):
    r = random.Random(4)
    still, one, two = [0.0] * 14400, [0.0] * 14400, [r.random() * 18 for _ in range(14400)]
    for y in range(20, 30):
        one[y * 160 + 50] = 200.0
        two[y * 160 + 50] = 19.0
    two[80 * 160 + 150] = 255.0
    rows = [(1, still, "a"), (2, one, "b"), (3, two, None), (4, None, "d"), (5, [1.0], "e"), (6, [float("nan")] * 14400, "f")]
    df = spark.createDataFrame(rows, "id long, diff array<double>, box string")
    got = {r["id"]: r["box"] and tuple(r["box"]) for r in regions.moving_regions(df, 90, 160, frame_size=(360, 640)).collect()}
    assert got == {1: None, 2: (46 * 4, 16 * 4, 9 * 4, 18 * 4), 3: (46 * 4, 16 * 4, 9 * 4, 18 * 4), 4: None, 5: None, 6: None}
    small = spark.createDataFrame([(1, [9.0, 0.0, 0.0, 9.0])], "id long, diff array<double>")
    assert regions.moving_regions(small, 2, 2, 5.0, 0).where(F.col("box").isNotNull()).count() == 0
    assert regions.moving_regions(small, 2, 2, 5.0, 0, 4).first()["box"] == (0, 0, 2, 2)
    assert regions.moving_regions(df.limit(0), 90, 160).count() == 0
