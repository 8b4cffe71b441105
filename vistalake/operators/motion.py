"""Motion: what changed between frames, as blobs with stable identities.

Differencing, runs and rectangles are stateless per pair of frames and run in parallel; only the last step, the
tracker, goes through a stream's frames in order, on a few rectangles each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.functions.arrays import runs_of
from vistalake.functions.confidence import f32
from vistalake.functions.rect import area
from vistalake.model import BLOB, CORROBORATED, HEURISTIC, PREDICTED, UNRELIABLE
from vistalake.operators.folds import ordered_fold
from vistalake.operators.runs import RectFold, group_runs, islands
from vistalake.operators.tracking import Tracker

#: Why a frame has no motion (fixed values).
WARMING_UP = "warming up: no previous frame to diff against yet"
RESIZED = "frame size changed since previous frame"
STILL = "no motion above threshold"
SOURCE = "motion"


@dataclass(frozen=True)
class MotionConfig:
    threshold: int = 28
    min_run_width: int = 4
    min_blob_height: int = 4
    min_blob_area: int = 24
    max_match_distance: float = 48.0
    grace_frames: int = 5


def moved(before: Column, now: Column, threshold: int) -> Column:
    """Whether the luminance of the channels' differences, cut to a whole number, reaches the threshold."""
    d = [f32(F.abs(before.getField(c).cast("int") - now.getField(c).cast("int"))) for c in "rgb"]
    luma = f32(0.2126) * d[0] + f32(0.7152) * d[1] + f32(0.0722) * d[2]
    return luma.cast("int") >= threshold


def frame_pairs(pixels: DataFrame, stream: str = "stream_id") -> DataFrame:
    """``stream, frame_no, width, height, previous_no, status``: one row for each frame; status is ``ok`` or a reason."""
    frames = pixels.groupBy(stream, "frame_no").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    over = f"OVER (PARTITION BY {stream} ORDER BY frame_no)"
    paired = frames.withColumn("previous_no", F.expr(f"lag(frame_no) {over}")).withColumn("same", F.expr(f"lag(width) {over} = width AND lag(height) {over} = height"))
    return paired.withColumn("status", F.when(F.col("previous_no").isNull(), WARMING_UP).when(~F.col("same"), RESIZED).otherwise("ok")).drop("same")


def motion_mask(pixels: DataFrame, threshold: int = 28, stream: str = "stream_id") -> DataFrame:
    """The moved pixels ``stream, frame_no, x, y`` of frames that have a previous one of their size.

    One exchange deals pixels by place; the previous frame's value is a lag, not a second scan.
    """
    now = F.struct("r", "g", "b")
    over = f"OVER (PARTITION BY {stream}, x, y ORDER BY frame_no)"
    held = pixels.select(stream, "frame_no", "x", "y", now.alias("now")).withColumn("before", F.expr(f"lag(now) {over}")).withColumn("before_no", F.expr(f"lag(frame_no) {over}"))
    hits = held.where(moved(F.col("before"), F.col("now"), threshold)).select(stream, "frame_no", "x", "y", "before_no")
    usable = frame_pairs(pixels, stream).where("status = 'ok'").select(stream, "frame_no", F.col("previous_no").alias("before_no"))
    return hits.join(usable, [stream, "frame_no", "before_no"]).select(stream, "frame_no", "x", "y")


def motion_stats(pixels: DataFrame, threshold: int = 28, stream: str = "stream_id") -> DataFrame:
    """``stream, frame_no, status, moved_pixels, changed_fraction`` of every frame (fraction 0 where not comparable)."""
    counts = motion_mask(pixels, threshold, stream).groupBy(stream, "frame_no").agg(F.count(F.lit(1)).alias("moved_pixels"))
    frames = frame_pairs(pixels, stream).join(counts, [stream, "frame_no"], "left")
    n = F.coalesce("moved_pixels", F.lit(0).cast("long"))
    total = f32(F.col("width")) * f32(F.col("height"))
    return frames.select(stream, "frame_no", "width", "height", "status", n.alias("moved_pixels"), F.when(total > 0, F.try_divide(f32(n), total).cast("float")).otherwise(f32(0)).alias("changed_fraction"))


def extract_blobs(mask: DataFrame, config: MotionConfig = MotionConfig(), keys=("stream_id", "frame_no")) -> DataFrame:
    """``keys, ord, x, y, w, h`` of the moved rectangles."""
    rects = group_runs(islands(mask, config.min_run_width, keys), config.min_blob_height, 1, keys)
    return rects.where(area(F.struct("x", "y", "w", "h")) >= config.min_blob_area)


def blob(t: dict) -> dict:
    """A track as a value of ``BLOB``: its box about the position, cut at 0."""
    x, y = (max(np.float32(t[k]) - np.float32(t[s]) / np.float32(2), np.float32(0)) for k, s in (("x", "w"), ("y", "h")))
    return {
        "id": t["id"], "bounds": {"x": int(x), "y": int(y), "w": int(max(t["w"], 1)), "h": int(max(t["h"], 1))},
        "velocity": {"x": t["vx"], "y": t["vy"]}, "age_frames": t["age"], "is_predicted": t["missed"] > 0,
    }


def judge(status: str, rects: list[tuple[int, int, int, int]], tracker: Tracker) -> tuple:
    """(blobs, confidence, reliability, failure reason) of one frame; frames that can't be compared leave the tracker alone."""
    if status != "ok":
        return None, 0.0, UNRELIABLE, status
    boxes = np.array(rects, dtype=np.float32).reshape(-1, 4)
    tracker.update(np.concatenate([boxes[:, :2] + boxes[:, 2:] / np.float32(2), boxes[:, 2:]], axis=1))
    if not len(tracker):
        return [], float(np.float32(0.6)), HEURISTIC, STILL
    tracks = tracker.rows()
    grade = PREDICTED if all(t["missed"] for t in tracks) else CORROBORATED if any(t["age"] > 3 for t in tracks) else HEURISTIC
    return [blob(t) for t in tracks], float(tracker.mean_confidence()), grade, None


def detect_schema(stream: T.StructField, number: T.DataType) -> T.StructType:
    return T.StructType(
        [
            stream,
            T.StructField("frame_no", number),
            T.StructField("blobs", T.ArrayType(BLOB)),
            T.StructField("confidence", T.FloatType()),
            T.StructField("source", T.StringType()),
            T.StructField("reliability", T.StringType()),
            T.StructField("failure_reason", T.StringType()),
            T.StructField("changed_fraction", T.FloatType()),
            T.StructField("tracked_blobs", T.IntegerType()),
        ]
    )


def detect_motion(pixels: DataFrame, config: MotionConfig = MotionConfig(), stream: str = "stream_id") -> DataFrame:
    """One detection for each frame of each stream."""
    mask = motion_mask(pixels, config.threshold, stream)
    keys = (stream, "frame_no")
    rects = extract_blobs(mask, config, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("rects"))
    frames = motion_stats(pixels, config.threshold, stream).join(rects, list(keys), "left").select(*keys, "status", "rects", "changed_fraction")

    def start():
        tracker = Tracker(config.max_match_distance, config.grace_frames)

        def push(row):
            _, number, status, found, fraction = row
            blobs, sure, grade, reason = judge(status, [(r["x"], r["y"], r["w"], r["h"]) for r in found or []], tracker)
            return [(number, blobs, sure, SOURCE, grade, reason, fraction, len(tracker))]

        return push, lambda: []

    return ordered_fold(frames, [stream], ["frame_no"], start, detect_schema(pixels.schema[stream], pixels.schema["frame_no"].dataType))


# ---------------------------------------------------------------- packed frames, by numpy


def packed_mask(before: np.ndarray, now: np.ndarray, threshold: int) -> np.ndarray:
    d = np.abs(before[..., :3].astype(np.int16) - now[..., :3].astype(np.int16)).astype(np.float32)
    luma = np.float32(0.2126) * d[..., 0] + np.float32(0.7152) * d[..., 1] + np.float32(0.0722) * d[..., 2]
    return luma.astype(np.int32) >= threshold


def fold_runs(runs: list[tuple[int, int, int]], min_height: int, max_gap: int) -> list[list[int]]:
    fold = RectFold(min_height, max_gap)
    out = [r for run in runs for r in fold.push(*run)]
    return out + fold.finish()


def packed_blobs(mask: np.ndarray, config: MotionConfig) -> list[tuple[int, int, int, int]]:
    return [tuple(r) for r in fold_runs(runs_of(mask, config.min_run_width), config.min_blob_height, 1) if r[2] * r[3] >= config.min_blob_area]
