"""Runs: maximal stretches of matching pixels on one row, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.functions.color import Predicate
from vistalake.functions.rect import clipped
from vistalake.operators.folds import ordered_fold


def row_runs(pixels: DataFrame, predicate: Predicate, min_width: int, region: tuple[int, int, int, int] | None = None, keys=("frame_id",)) -> DataFrame:
    """``keys, y, x0, x1`` of the runs of at least ``min_width`` pixels, ends included."""
    inside = pixels if region is None else pixels.where(clipped(F.col("x"), F.col("y"), region))
    return islands(inside.where(predicate(*(F.col(c) for c in "rgba"))).select(*keys, "y", "x"), min_width, keys)


def islands(marked: DataFrame, min_width: int, keys=("frame_id",)) -> DataFrame:
    """Runs of neighbouring ``x`` among marked pixels: x minus its rank is constant in a run."""
    over = f"PARTITION BY {', '.join(keys)}, y ORDER BY x"
    numbered = marked.withColumn("island", F.expr(f"x - row_number() OVER ({over})"))
    runs = numbered.groupBy(*keys, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= min_width).select(*keys, F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"))


class RectFold:
    """Groups runs, row by row, into rectangles.

    A run continues the live rectangle that it overlaps most if a third of the wider of both is shared. Runs that
    continue the same rectangle widen one copy of it. Rectangles without a run in a row that has any are closed;
    ``max_gap`` bridges rows where the whole frame has none. The right edge is taken after the left one has moved.
    """

    def __init__(self, min_height: int, max_gap: int):
        self.min_height, self.max_gap = min_height, max_gap
        self.live: list[list[int]] = []  # x, y, w, h
        self.row: int | None = None
        self.pending: list[tuple[int, int]] = []
        self.last: int | None = None

    def push(self, y: int, x0: int, x1: int) -> list[list[int]]:
        closed: list[list[int]] = []
        if self.row is not None and y != self.row:
            closed = self._close_row()
        self.row = y
        self.pending.append((x0, x1))
        return closed

    def finish(self) -> list[list[int]]:
        closed = self._close_row() if self.pending else []
        closed += self._tall(self.live)
        self.live = []
        return closed

    def _tall(self, rects: list[list[int]]) -> list[list[int]]:
        return [r for r in rects if r[3] >= self.min_height]

    def _close_row(self) -> list[list[int]]:
        y, closed = self.row, []
        if self.last is not None and y > self.last + self.max_gap + 1:
            closed += self._tall(self.live)
            self.live = []
        carried: dict[int, list[int]] = {}
        rows: list[list[int]] = []
        for x0, x1 in self.pending:
            shared = [max(0, min(x1, r[0] + r[2] - 1) - max(x0, r[0]) + 1) for r in self.live]
            most = max(shared, default=0)
            which = shared.index(most) if most else -1
            if most and 3 * most >= max(x1 - x0 + 1, self.live[which][2]):
                if which not in carried:
                    carried[which] = list(self.live[which])
                    rows.append(carried[which])
                r = carried[which]
                r[0] = min(r[0], x0)
                r[2] = max(r[0] + r[2] - 1, x1) - r[0] + 1
                r[3] = y - r[1] + 1
            else:
                rows.append([x0, y, x1 - x0 + 1, 1])
        closed += self._tall([r for i, r in enumerate(self.live) if i not in carried])
        self.live, self.pending, self.last = rows, [], y
        return closed


def group_runs(runs: DataFrame, min_height: int, max_gap: int, keys=("frame_id",)) -> DataFrame:
    """``keys, ord, x, y, w, h`` of the rectangles; ``ord`` numbers them in order of completion."""

    def start():
        fold, count = RectFold(min_height, max_gap), [0]

        def rows(rects):
            out = [(count[0] + i, *r) for i, r in enumerate(rects)]
            count[0] += len(rects)
            return out

        return (lambda row: rows(fold.push(*row[-3:]))), (lambda: rows(fold.finish()))

    kinds = {f.name: f.dataType for f in runs.schema}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(n, T.LongType()) for n in ("ord", "x", "y", "w", "h")])
    return ordered_fold(runs.select(*keys, "y", "x0", "x1"), list(keys), ["y", "x0"], start, schema)
