"""Text recognition with an engine that may be absent: a missing engine gives nulls, never an error."""

from __future__ import annotations

import math
import os
import shutil
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.functions.text import normalize_text, tsv_words

MIN_TEXT_HEIGHT = 48
#: Where Windows installers put the program (fixed values).
WINDOWS_PATHS = (r"C:\Program Files\Tesseract-OCR\tesseract.exe", r"C:\Program Files (x86)\Tesseract-OCR\tesseract.exe")


# The options' names and order are the program's (fixed values).
@dataclass(frozen=True)
class OcrConfig:
    psm: int = 11
    whitelist: str | None = None

    def to_args(self) -> list[str]:
        allowed = ["-c", f"tessedit_char_whitelist={self.whitelist}"] if self.whitelist is not None else []
        return ["--oem", "3", "--psm", str(self.psm), *allowed, "-c", "preserve_interword_spaces=1"]


def tesseract_args(image: str, config: OcrConfig = OcrConfig()) -> list[str]:
    """The command line without the program; ``tsv`` comes last, or the options would be taken for file names."""
    return [image, "stdout", *config.to_args(), "tsv"]


def command(image: Column, psm: Column, whitelist: Column) -> Column:
    """``tesseract_args`` of columns: an array of strings; a null ``whitelist`` allows everything."""
    allowed = F.when(whitelist.isNotNull(), F.array(F.lit("-c"), F.concat(F.lit("tessedit_char_whitelist="), whitelist))).otherwise(F.array().cast("array<string>"))
    fixed = lambda *words: [F.lit(w) for w in words]
    return F.concat(F.array(image, *fixed("stdout", "--oem", "3", "--psm"), psm.cast("string")), allowed, F.array(*fixed("-c", "preserve_interword_spaces=1", "tsv")))


def find_engine() -> str | None:
    own = os.environ.get("TESSERACT_BIN")
    if own and os.path.isfile(own):
        return own
    return shutil.which("tesseract") or next((p for p in WINDOWS_PATHS if os.path.isfile(p)), None)


def is_ocr_available() -> bool:
    return find_engine() is not None


@contextmanager
def temp_image(data: bytes) -> Iterator[str]:
    """A file that is gone afterwards, whatever happens."""
    handle, path = tempfile.mkstemp(suffix=".png")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        yield path
    finally:
        if os.path.exists(path):
            os.unlink(path)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray | None:
    """The region, clipped to the image; null without any area inside."""
    height, width = image.shape[:2]
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x >= width or y >= height:
        return None
    return image[y : min(y + h, height), x : min(x + w, width)]


def upscale_factor(height: int) -> int:
    """How much a low crop is enlarged: to at least 48 rows, 2 to 8 times."""
    return min(max(math.ceil(MIN_TEXT_HEIGHT / height), 2), 8) if 0 < height < MIN_TEXT_HEIGHT else 1


def upscale_factor_column(height: Column) -> Column:
    return F.when((height > 0) & (height < MIN_TEXT_HEIGHT), F.least(F.greatest(F.ceil(F.lit(float(MIN_TEXT_HEIGHT)) / height), F.lit(2)), F.lit(8))).otherwise(F.lit(1)).cast("int")


def _resample(image: np.ndarray, factor: int, axis: int) -> np.ndarray:
    """Lanczos resampling with three lobes along one axis."""
    n = image.shape[axis]
    at = (np.arange(n * factor) + 0.5) / factor - 0.5
    base = np.floor(at).astype(int)
    taps = base[:, None] + np.arange(-2, 4)[None]
    far = at[:, None] - taps
    weight = np.where(np.abs(far) < 3, np.sinc(far) * np.sinc(far / 3), 0.0)
    weight /= weight.sum(1, keepdims=True)
    moved = np.moveaxis(image, axis, 0)[np.clip(taps, 0, n - 1)]
    return np.moveaxis((moved * weight[:, :, None]).sum(1), 0, axis)


def _blur(image: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = sum(k * np.take(padded, np.arange(i, i + image.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return image


def preprocess(image: np.ndarray) -> np.ndarray:
    """Grey, enlarged, contrast raised by 45 %, unsharp-masked; uint8."""
    grey = image[..., 0] * 0.2126 + image[..., 1] * 0.7152 + image[..., 2] * 0.0722
    factor = upscale_factor(grey.shape[0])
    if factor > 1:
        grey = _resample(_resample(grey, factor, 0), factor, 1)
    grey = np.clip(((grey / 255 - 0.5) * (1.45**2) + 0.5) * 255, 0, 255)
    detail = grey - _blur(grey)
    return np.clip(np.where(np.abs(detail) > 1, grey + detail, grey), 0, 255).astype(np.uint8)


def png(grey: np.ndarray) -> bytes:
    """A grey image as PNG."""
    h, w = grey.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + grey[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def run_tesseract(image: np.ndarray, config: OcrConfig = OcrConfig()) -> str | None:
    """The engine's TSV for an RGBA crop, or null."""
    engine = find_engine()
    if engine is None:
        return None
    try:
        with temp_image(png(preprocess(image))) as path:
            return subprocess.run([engine, *tesseract_args(path, config)], capture_output=True, timeout=120, check=False).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError):
        return None


def ocr_region(frames: DataFrame, region: tuple[int, int, int, int], config: OcrConfig = OcrConfig(), engine: Callable[[np.ndarray, OcrConfig], str | None] = run_tesseract) -> DataFrame:
    """Packed frames with ``ocr`` (text, available, words) for a region; null where nothing was read.

    Word boxes are in pixels of the enlarged crop; ``ocr_scale`` is by how much it was enlarged. Only the engine runs
    in Python; its table is parsed by column functions.
    """

    @F.pandas_udf("string")
    def read(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for d, w, h in zip(data, width, height):
            part = crop(np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4), *region) if d is not None else None
            out.append(None if part is None or part.size == 0 else engine(part, config))
        return pd.Series(out, dtype=object)

    x, y, w, h = region
    rows = F.least(F.lit(y + h), F.col("height")) - F.lit(y)
    words = tsv_words(F.col("_tsv"))
    text = normalize_text(F.array_join(F.transform("_words", lambda v: v["text"]), " "))
    parsed = frames.withColumn("_tsv", read("data", "width", "height")).withColumn("_words", words).withColumn("_text", text)
    result = F.when(F.col("_text") != "", F.struct(F.col("_text").alias("text"), F.lit(True).alias("available"), F.col("_words").alias("words")))
    return parsed.withColumn("ocr", result).withColumn("ocr_scale", upscale_factor_column(rows)).drop("_tsv", "_words", "_text")


def scaled_words(words: Column, scale: Column) -> Column:
    """Word boxes in pixels of the crop itself."""
    part = lambda v: F.floor(v / scale).cast("long")
    return F.transform(words, lambda v: F.struct(v["text"].alias("text"), *(part(v[n]).alias(n) for n in "xywh")))


def native_engine():
    """The operating system's own engine, for the user's languages; there is none outside Windows."""
    return None


def native_engine_available() -> bool:
    return native_engine() is not None


def recognize_native(image: np.ndarray) -> str | None:
    """What the system's engine reads in an RGBA image; null without one."""
    engine = native_engine()
    return engine(swizzle(image)) if engine else None


def swizzle(pixels: np.ndarray) -> np.ndarray:
    """RGBA to opaque BGRA, or back."""
    out = pixels[..., [2, 1, 0, 3]].copy()
    out[..., 3] = 255
    return out
