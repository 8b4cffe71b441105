"""Tracks of objects over frames: stable ids by nearest predicted position, with a grace period.

The state is one small object per stream; matching within a frame is greedy and ordered, so it runs in Python over
rows in frame order. All arithmetic is in single precision.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.model import TRACK
from vistalake.operators.folds import ordered_fold

_f = np.float32
GAIN, WEAR, LOSS, FIRST = _f(0.35), _f(0.995), _f(0.6), _f(0.3)


def combine(a: np.ndarray, b: np.float32) -> np.ndarray:
    """Independent evidence, within [0, 1]."""
    return np.clip(a + b - a * b, _f(0), _f(1))


def decay(a: np.ndarray, factor: np.float32) -> np.ndarray:
    return np.clip(a * factor, _f(0), _f(1))


class Tracker:
    """Tracks of one stream as arrays. ``update`` takes a frame's detections (centre x, centre y, width, height)."""

    FLOATS = ("x", "y", "vx", "vy", "w", "h", "confidence")
    COUNTS = ("id", "seen", "missed", "age")

    def __init__(self, max_distance: float = 48.0, grace: int = 5):
        self.max_distance, self.grace = _f(max_distance), grace
        self.next_id, self.frame_index = 1, 0
        self.real = np.zeros((0, len(self.FLOATS)), dtype=np.float32)
        self.count = np.zeros((0, len(self.COUNTS)), dtype=np.int64)

    def __len__(self) -> int:
        return len(self.real)

    def _claims(self, spots: np.ndarray) -> np.ndarray:
        """For each track the detection it takes, or -1: nearest free one to where it should be, tracks in order."""
        claimed = np.full(len(self), -1)
        if not len(self) or not len(spots):
            return claimed
        gap = spots[None] - (self.real[:, None, 0:2] + self.real[:, None, 2:4])
        far = np.sqrt(gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1])
        far[far > self.max_distance] = np.inf
        for i in np.nonzero(np.isfinite(far).any(1))[0].tolist():
            at = int(far[i].argmin())  # the first of equals
            if far[i, at] < np.inf:
                claimed[i] = at
                far[:, at] = np.inf
        return claimed

    def update(self, detections) -> None:
        self.frame_index += 1
        found = np.array(detections, dtype=np.float32).reshape(-1, 4)
        claimed = self._claims(found[:, :2])
        hit, lost = np.nonzero(claimed >= 0)[0], np.nonzero(claimed < 0)[0]
        real, count = self.real, self.count
        took = found[claimed[hit]]
        real[hit, 2:4] = took[:, :2] - real[hit, :2]
        real[hit, :2], real[hit, 4:6] = took[:, :2], took[:, 2:]
        real[hit, 6] = decay(combine(real[hit, 6], GAIN), WEAR)
        count[hit, 1], count[hit, 2] = self.frame_index, 0
        count[hit, 3] += 1
        count[lost, 2] += 1
        real[lost, :2] += real[lost, 2:4]
        real[lost, 6] = decay(real[lost, 6], LOSS)
        stay = count[:, 2] <= self.grace
        fresh = np.setdiff1d(np.arange(len(found)), claimed)
        born = np.zeros((len(fresh), len(self.FLOATS)), dtype=np.float32)
        born[:, :2], born[:, 4:6], born[:, 6] = found[fresh, :2], found[fresh, 2:], FIRST
        marks = np.stack([self.next_id + np.arange(len(fresh)), np.full(len(fresh), self.frame_index), np.zeros(len(fresh), int), np.ones(len(fresh), int)], axis=1)
        self.next_id += len(fresh)
        self.real, self.count = np.concatenate([real[stay], born]), np.concatenate([count[stay], marks.astype(np.int64)])

    def rows(self) -> list[dict]:
        """The live tracks in order."""
        names = (*self.FLOATS, *self.COUNTS)
        return [dict(zip(names, (*r, *c))) for r, c in zip(self.real.tolist(), self.count.tolist())]

    def mean_confidence(self) -> np.float32:
        """The mean, summed in order in single precision."""
        return np.cumsum(self.real[:, 6], dtype=np.float32)[-1] / _f(len(self)) if len(self) else _f(0)

    def to_json(self) -> str:
        return json.dumps([self.next_id, self.frame_index, self.real.tolist(), self.count.tolist()])

    @classmethod
    def from_json(cls, text: str, max_distance: float, grace: int) -> Tracker:
        out = cls(max_distance, grace)
        out.next_id, out.frame_index, real, count = json.loads(text)
        out.real = np.array(real, dtype=np.float32).reshape(-1, len(cls.FLOATS))
        out.count = np.array(count, dtype=np.int64).reshape(-1, len(cls.COUNTS))
        return out


def track_struct(t: dict) -> dict:
    """A track as a value of ``TRACK``."""
    return {
        "id": t["id"], "position": {"x": t["x"], "y": t["y"]}, "velocity": {"x": t["vx"], "y": t["vy"]},
        "width": t["w"], "height": t["h"], "last_seen_frame": t["seen"], "missed_frames": t["missed"], "age_frames": t["age"], "confidence": t["confidence"],
    }


def is_predicted(track):
    """Column test: the track was not seen in its last frame."""
    return track["missed_frames"] > 0


def frame_index(track):
    """Column: how many frames the track's stream has had."""
    return track["last_seen_frame"] + track["missed_frames"]


def distance(a, b):
    """Column: the distance of two points, in single precision."""
    dx, dy = ((a[c] - b[c]).cast("float") for c in "xy")
    return F.sqrt(dx * dx + dy * dy).cast("float")


def track_objects(detections: DataFrame, max_distance: float = 48.0, grace: int = 5, stream: str = "stream_id") -> DataFrame:
    """``stream, frame_no, track`` rows: the live tracks after each frame that has a row in ``detections``.

    ``detections`` has ``frame_no, ord, cx, cy, w, h``; a row with a null ``cx`` marks a frame without objects. Rows
    are dealt by stream and sorted by Spark; Python holds one stream's tracks.
    """

    def start():
        tracker = Tracker(max_distance, grace)
        frame: list = [None, []]

        def close():
            if frame[0] is None:
                return []
            tracker.update(frame[1])
            return [(frame[0], track_struct(t)) for t in tracker.rows()]

        def push(row):
            number, cx = row[1], row[3]
            out = []
            if number != frame[0]:
                out = close()
                frame[0], frame[1] = number, []
            if cx is not None:
                frame[1].append(tuple(row[3:7]))
            return out

        return push, close

    kind = detections.schema[stream].dataType
    number = detections.schema["frame_no"].dataType
    schema = T.StructType([T.StructField(stream, kind), T.StructField("frame_no", number), T.StructField("track", TRACK)])
    return ordered_fold(detections.select(stream, "frame_no", "ord", "cx", "cy", "w", "h"), [stream], ["frame_no", "ord"], start, schema)
