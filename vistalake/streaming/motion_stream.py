"""Motion and tracking over streams, with keyed state in Structured Streaming.

State per stream is the last frame (packed) and the tracker. Micro-batches don't promise order, so frames are sorted
within a batch, and frames at or before the last one seen are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from vistalake.functions.arrays import frame_array
from vistalake.model import TRACK
from vistalake.operators.motion import SOURCE, MotionConfig, WARMING_UP, RESIZED, detect_schema, judge, packed_blobs, packed_mask
from vistalake.operators.packed import changed_fraction
from vistalake.operators.tracking import Tracker, track_struct

_MOTION_STATE = "frame_no long, width int, height int, data binary, tracker string"
_TRACK_STATE = "frame_no long, tracker string"


def detect_motion_stream(frames: DataFrame, config: MotionConfig = MotionConfig()) -> DataFrame:
    """Detections for a stream of packed frames (``stream_id, frame_no, width, height, data``)."""
    schema = detect_schema(T.StructField("stream_id", T.StringType()), T.LongType())

    def step(key, parts, state):
        last, width, height, data, saved = state.get if state.exists else (None, 0, 0, b"", None)
        tracker = Tracker.from_json(saved, config.max_match_distance, config.grace_frames) if saved else Tracker(config.max_match_distance, config.grace_frames)
        rows = []
        # One copy of each frame of the micro-batch, in order; each is let go once it has been compared.
        waiting = sorted((r for part in parts for r in part[["frame_no", "width", "height", "data"]].itertuples(index=False, name=None)), key=lambda r: r[0], reverse=True)
        while waiting:
            number, w, h, now = waiting.pop()
            if last is not None and number <= last:
                continue
            status, rects, fraction = "ok", [], 0.0
            if last is None:
                status = WARMING_UP
            elif (width, height) != (w, h):
                status = RESIZED
            else:
                mask = packed_mask(frame_array(data, width, height), frame_array(now, w, h), config.threshold)
                rects, fraction = packed_blobs(mask, config), changed_fraction(mask)
            blobs, sure, grade, reason = judge(status, rects, tracker)
            rows.append((key[0], number, blobs, sure, SOURCE, grade, reason, fraction, len(tracker)))
            last, width, height, data = int(number), int(w), int(h), bytes(now)
        state.update((last, width, height, data, tracker.to_json()))
        yield pd.DataFrame(rows, columns=schema.names)

    keyed = frames.select("stream_id", "frame_no", "width", "height", "data").groupBy("stream_id")
    return keyed.applyInPandasWithState(step, schema, _MOTION_STATE, "append", GroupStateTimeout.NoTimeout)


def track_objects_stream(detections: DataFrame, max_distance: float = 48.0, grace: int = 5) -> DataFrame:
    """Live tracks after each frame, for a stream of ``stream_id, frame_no, ord, cx, cy, w, h``."""
    schema = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("frame_no", T.LongType()), T.StructField("track", TRACK)])

    def step(key, parts, state):
        last, saved = state.get if state.exists else (None, None)
        tracker = Tracker.from_json(saved, max_distance, grace) if saved else Tracker(max_distance, grace)
        rows = []
        for number, some in pd.concat(list(parts)).sort_values(["frame_no", "ord"], kind="stable").groupby("frame_no"):
            if last is not None and number <= last:
                continue
            seen = some[some["cx"].notna()]
            tracker.update(seen[["cx", "cy", "w", "h"]].to_numpy(dtype="float32"))
            rows += [(key[0], number, track_struct(t)) for t in tracker.rows()]
            last = int(number)
        state.update((last, tracker.to_json()))
        yield pd.DataFrame(rows, columns=schema.names)

    keyed = detections.select("stream_id", "frame_no", "ord", "cx", "cy", "w", "h").groupBy("stream_id")
    return keyed.applyInPandasWithState(step, schema, _TRACK_STATE, "append", GroupStateTimeout.NoTimeout)
