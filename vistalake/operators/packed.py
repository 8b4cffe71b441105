"""The operators over packed frames (``width, height, data`` with RGBA bytes): one narrow numpy pass, no pixel rows.

A frame is read once and gives a few values, so nothing but these is shuffled. Only motion needs frames in order; it
deals whole frames by stream once and holds one previous frame and one tracker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vistalake.functions.arrays import ArrayPredicate, clip, color_mask, frame_array, luma, runs_of, similar
from vistalake.operators.bars import BOUNDARY_TOLERANCE, GROOVE_TOLERANCE
from vistalake.operators.folds import ordered_fold
from vistalake.operators.motion import RESIZED, SOURCE, WARMING_UP, MotionConfig, detect_schema, fold_runs, judge, packed_blobs, packed_mask
from vistalake.operators.quality import BLURRED, HARD_STEP, LEGIBLE_SHARPNESS, MIN_EDGES, NO_TEXT, NOISE_STEP, SHARP
from vistalake.operators.regions import Region
from vistalake.operators.tracking import Tracker

Rect = tuple[int, int, int, int]
_f = np.float32
RECT = "x long, y long, w long, h long"
FRAME = ("width", "height", "data")


def per_frame(frames: DataFrame, kernel: Callable[..., list[tuple]], schema: str, keys=("frame_id",), also: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and the rows that ``kernel(image, *also)`` gives for each frame, as ``schema`` says."""
    kinds = T.StructType([frames.schema[k] for k in keys] + T.StructType.fromDDL(schema).fields)
    target, n = to_arrow_schema(kinds), len(keys)

    def run(batches):
        for batch in batches:
            rows = []
            for key_and_frame in zip(*(c.to_pylist() for c in batch.columns)):
                width, height, data = key_and_frame[n : n + 3]
                rows += [key_and_frame[:n] + tuple(r) for r in kernel(frame_array(data, width, height), *key_and_frame[n + 3 :])]
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return frames.select(*keys, *FRAME, *also).mapInArrow(run, kinds)


# ---------------------------------------------------------------- kernels


def rects_of(mask: np.ndarray, min_width: int, min_height: int, max_gap: int, x: int = 0, y: int = 0) -> list[Rect]:
    """The rectangles of a mask's runs in order of completion, moved by ``x, y``."""
    return [(r[0] + x, r[1] + y, r[2], r[3]) for r in fold_runs(runs_of(mask, min_width), min_height, max_gap)]


def largest(rects: list[Rect]) -> Rect | None:
    """The largest; of equals the one that was completed last."""
    return max(reversed(rects), key=lambda r: r[2] * r[3], default=None)


def color_bar(image: np.ndarray, region: Region, predicate: ArrayPredicate) -> Rect | None:
    part, x, y = clip(image, region)
    return largest(rects_of(predicate(part), max(region[2] // 20, 8), 2, 2, x, y))


def _upper_median(pixels: np.ndarray) -> np.ndarray | None:
    return np.sort(pixels[:, :3], axis=0)[len(pixels) // 2] if len(pixels) else None


def _walked(kinds: np.ndarray) -> tuple[int, int]:
    """Filled and all columns of one walk: 1 filled, 2 empty, 0 unclear.

    A fourth unclear column in a row ends it; fewer take the kind of the next clear one.
    """
    if not len(kinds):
        return 0, 0
    unclear = np.convolve(kinds == 0, np.ones(BOUNDARY_TOLERANCE + 1, dtype=int))[: len(kinds)]
    stops = np.nonzero(unclear > BOUNDARY_TOLERANCE)[0]
    kinds = kinds[: stops[0]] if len(stops) else kinds
    clear = np.nonzero(kinds)[0]
    share = np.diff(clear, prepend=-1)  # each clear column and the unclear ones before it
    return int(share[kinds[clear] == 1].sum()), int(share.sum())


def bar_fill(image: np.ndarray, bar: Rect, searched: tuple[int, int], is_filled: ArrayPredicate) -> tuple[float | None, str | None]:
    """Percent of the bar's track that is filled, or null and why."""
    (x, y, w, h), (sx, sw) = bar, searched
    height, width = image.shape[:2]
    if w <= 0 or h <= 0 or y >= height or x < sx or x >= width:
        return None, "bar has no usable area"
    right, quarter = min(sx + sw, width), h // 4
    top = min(y + quarter, max(height - 1, 0))
    core = image[top : max(min(y + h - quarter, height), min(top + 1, height))]
    behind = core[:, x + w + 2 : min(x + w + 8, right)]
    groove = _upper_median(behind[(behind[..., 3] >= 128) & ~is_filled(behind)])
    outside = _upper_median(image[y - 3, x : min(x + w, width)]) if y >= 3 else None
    if groove is not None and outside is not None and similar(groove, outside, GROOVE_TOLERANCE):
        groove = None
    track = core[:, sx : max(right, x + 1)]
    filled = is_filled(track)
    empty = ~filled & similar(track, groove, GROOVE_TOLERANCE) if groove is not None else np.zeros_like(filled)
    kinds = np.select([2 * filled.sum(0) > len(core), 2 * empty.sum(0) > len(core)], [1, 2], 0)
    left, rest = _walked(kinds[: x - sx + 1][::-1]), _walked(kinds[x - sx + 1 :])
    if not left[1] + rest[1]:
        return None, "no track found"
    return float(min(max(_f(left[0] + rest[0]) / _f(left[1] + rest[1]) * _f(100), _f(0)), _f(100))), None


def dominant_bucket(image: np.ndarray, region: Region, step: int) -> tuple[int, int, int, int] | None:
    """The most frequent colour bucket (r, g, b) among opaque pixels and its count; of equals the smallest."""
    part = clip(image, region)[0]
    buckets = part[part[..., 3] >= 200][:, :3].astype(np.int64) // step
    codes, counts = np.unique(buckets @ np.array([1 << 16, 1 << 8, 1]), return_counts=True)
    if not len(codes):
        return None
    best = int(codes[counts.argmax()])
    return best >> 16, best >> 8 & 255, best & 255, int(counts.max())


def uniform_panel(image: np.ndarray, region: Region, bucket: tuple[int, int, int], step: int) -> Rect | None:
    """The largest rectangle of pixels in the bucket."""
    part, x, y = clip(image, region)
    mask = (part[..., :3] // step == np.array(bucket)).all(-1) & (part[..., 3] >= 200)
    return largest(rects_of(mask, 20, 12, 2, x, y))


def text_quality(image: np.ndarray, region: Region) -> tuple[float, int, str]:
    """Sharpness, brightness steps and legibility of a region."""
    steps = np.abs(np.diff(luma(clip(image, region)[0]), axis=1))
    edges, hard = int((steps >= NOISE_STEP).sum()), int((steps >= HARD_STEP).sum())
    if edges < MIN_EDGES:
        return 0.0, edges, NO_TEXT
    sharpness = _f(hard) / _f(edges)
    return float(sharpness), edges, SHARP if sharpness >= _f(LEGIBLE_SHARPNESS) else BLURRED


# ---------------------------------------------------------------- operators


def _some(value) -> list[tuple]:
    return [] if value is None else [value]


def find_color_bars(frames: DataFrame, region: Region, hue: tuple[float, float], min_s: float, min_v: float, keys=("frame_id",)) -> DataFrame:
    """``keys, x, y, w, h`` of the bar of each frame that shows one."""
    test = color_mask(hue, min_s, min_v)
    return per_frame(frames, lambda image: _some(color_bar(image, region, test)), RECT, keys)


def measure_bars(frames: DataFrame, region: Region, hue: tuple[float, float], min_s: float, min_v: float, keys=("frame_id",)) -> DataFrame:
    """``keys, fill, failure_reason`` of every frame: its bar is found and measured in one pass."""
    test = color_mask(hue, min_s, min_v)

    def kernel(image):
        bar = color_bar(image, region, test)
        return [(None, "no bar found") if bar is None else bar_fill(image, bar, (region[0], region[2]), test)]

    return per_frame(frames, kernel, "fill float, failure_reason string", keys)


def dominant_buckets(frames: DataFrame, region: Region, step: int, keys=("frame_id",)) -> DataFrame:
    return per_frame(frames, lambda image: _some(dominant_bucket(image, region, step)), "bucket_r long, bucket_g long, bucket_b long, n long", keys)


def uniform_panels(frames: DataFrame, region: Region, step: int, keys=("frame_id",)) -> DataFrame:
    """``keys, x, y, w, h`` of the largest rectangle in the dominant colour of the frame's region."""

    def kernel(image):
        found = dominant_bucket(image, region, step)
        return _some(found and uniform_panel(image, region, found[:3], step))

    return per_frame(frames, kernel, RECT, keys)


def assess_frames(frames: DataFrame, region: Region, keys=("frame_id",)) -> DataFrame:
    return per_frame(frames, lambda image: [text_quality(image, region)], "sharpness float, edge_samples long, legibility string", keys)


def changed_fraction(mask: np.ndarray) -> float:
    """The share of moved pixels, in single precision."""
    return float(_f(mask.sum()) / (_f(mask.shape[1]) * _f(mask.shape[0]))) if mask.size else 0.0


def _pairwise(status_of: Callable, frames: DataFrame, stream: str, schema: T.StructType) -> DataFrame:
    """Folds each stream's frames in order; ``status_of()`` gives a function of (number, status, before, now)."""

    def start():
        last: list = [None]
        judge_pair = status_of()

        def push(row):
            number, width, height, data = row[1:5]
            now, before = frame_array(data, width, height), last[0]
            last[0] = now
            status = WARMING_UP if before is None else RESIZED if before.shape != now.shape else "ok"
            return judge_pair(number, status, before, now)

        return push, lambda: []

    partitions = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered_fold(frames.select(stream, "frame_no", *FRAME), [stream], ["frame_no"], start, schema, partitions)


def motion_of(frames: DataFrame, config: MotionConfig = MotionConfig(), stream: str = "stream_id") -> DataFrame:
    """``stream, frame_no, width, height, status, moved_pixels, changed_fraction, rects`` of every frame, from one pass."""

    def start():
        def pair(number, status, before, now):
            height, width = now.shape[:2]
            moved, fraction, rects = 0, 0.0, []
            if status == "ok":
                mask = packed_mask(before, now, config.threshold)
                moved, fraction, rects = int(mask.sum()), changed_fraction(mask), packed_blobs(mask, config)
            return [(number, width, height, status, moved, fraction, [dict(zip("xywh", r)) for r in rects])]

        return pair

    kinds = T.StructType.fromDDL(f"width int, height int, status string, moved_pixels long, changed_fraction float, rects array<struct<{RECT.replace(' ', ':').replace(',:', ',')}>>").fields
    return _pairwise(start, frames, stream, T.StructType([frames.schema[stream], frames.schema["frame_no"], *kinds]))


def detect_motion_frames(frames: DataFrame, config: MotionConfig = MotionConfig(), stream: str = "stream_id") -> DataFrame:
    """One detection for each frame of each stream, by one pass over its frames."""

    def start():
        tracker = Tracker(config.max_match_distance, config.grace_frames)

        def pair(number, status, before, now):
            rects, fraction = [], 0.0
            if status == "ok":
                mask = packed_mask(before, now, config.threshold)
                rects, fraction = packed_blobs(mask, config), changed_fraction(mask)
            blobs, sure, grade, reason = judge(status, rects, tracker)
            return [(number, blobs, sure, SOURCE, grade, reason, fraction, len(tracker))]

        return pair

    return _pairwise(start, frames, stream, detect_schema(frames.schema[stream], frames.schema["frame_no"].dataType))


def packed_frames(rows: DataFrame, draw: Callable[..., np.ndarray], columns: list[str], keys: list[str]) -> DataFrame:
    """Packed frames that ``draw(*columns)`` makes of each row, in place."""
    schema = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL("width int, height int, data binary").fields)
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                images = [draw(*values) for values in zip(*(part.column(c).to_pylist() for c in columns))]
                sizes = [pa.array([i.shape[d] for i in images], pa.int32()) for d in (1, 0)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *sizes, pa.array([i.tobytes() for i in images], pa.binary())], schema=target)

    return rows.select(*dict.fromkeys([*keys, *columns])).mapInArrow(run, schema)
