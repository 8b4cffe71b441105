"""Pixel predicates and colours over numpy images (height, width, 4), in single precision like the column functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A test of an image's pixels: RGBA in, a mask out.
ArrayPredicate = Callable[[np.ndarray], np.ndarray]
_f = np.float32


def frame_array(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)


def clip(image: np.ndarray, region: tuple[int, int, int, int] | None) -> tuple[np.ndarray, int, int]:
    """The part of an image inside a region, and where it starts."""
    if region is None:
        return image, 0, 0
    x, y, w, h = region
    return image[y : y + h, x : x + w], x, y


def hsv_arrays(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in [0, 360), saturation and value in [0, 1] of every pixel."""
    r, g, b = (image[..., k].astype(_f) / _f(255) for k in range(3))
    top = np.maximum(np.maximum(r, g), b)
    delta = top - np.minimum(np.minimum(r, g), b)
    span = np.where(delta == 0, _f(1), delta)
    by_sector = np.select([top == r, top == g], [(g - b) / span, (b - r) / span + _f(2)], (r - g) / span + _f(4))
    hue = np.where(delta == 0, _f(0), _f(60) * by_sector)
    return np.where(hue < 0, hue + _f(360), hue), np.where(top == 0, _f(0), delta / np.where(top == 0, _f(1), top)), top


def color_mask(hue: tuple[float, float], min_s: float, min_v: float) -> ArrayPredicate:
    """Opaque enough (alpha at least half) and within the colour range; a range with low over high goes through 0."""
    low, high = map(_f, hue)

    def test(image: np.ndarray) -> np.ndarray:
        # Value and saturation are decided first, on whole numbers; the hue only where it matters.
        out = image[..., 3] >= 128
        at = np.nonzero(out & (image[..., :3].max(-1).astype(_f) / _f(255) >= _f(min_v)))
        h, s, _ = hsv_arrays(image[at])
        inside = (h >= low) & (h <= high) if low <= high else (h >= low) | (h <= high)
        out = np.zeros_like(out)
        out[at] = inside & (s >= _f(min_s))
        return out

    return test


def luma(image: np.ndarray) -> np.ndarray:
    """Integer luminance."""
    return (image[..., :3].astype(np.int32) @ np.array([299, 587, 114], dtype=np.int32)) // 1000


def similar(image: np.ndarray, colour: np.ndarray, tolerance: int) -> np.ndarray:
    """Where all channels are within ``tolerance`` of the colour's."""
    return (np.abs(image[..., :3].astype(np.int16) - colour.astype(np.int16)) <= tolerance).all(-1)


def runs_of(mask: np.ndarray, min_width: int) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of the runs of a mask of at least ``min_width`` pixels, in scan order, ends included."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]
    wide = x1 - x0 >= min_width
    return list(zip(y[wide].tolist(), x0[wide].tolist(), (x1[wide] - 1).tolist()))
