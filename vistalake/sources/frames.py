"""Packed frames and pixels: readers, converters, writers."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

PIXELS = "frame_id string, x int, y int, r int, g int, b int, a int, width int, height int"


UNREADABLE = "image could not be read"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``frame_id, width, height, data`` (RGBA), ``failure_reason`` of image files; Spark decodes them, in BGR order.

    A file that can't be read has null size and data and a reason.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches):
        for batch in batches:
            out = []
            for w, h, n, d in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if w is None or w < 0 or not n or n < 0:
                    out.append((None, None, None, UNREADABLE))
                    continue
                raw = np.frombuffer(d, dtype=np.uint8).reshape(h, w, n)
                rgba = np.full((h, w, 4), 255, dtype=np.uint8)
                rgba[..., :3] = raw[..., [2, 1, 0]] if n >= 3 else raw[..., :1]
                if n == 4:
                    rgba[..., 3] = raw[..., 3]
                out.append((w, h, rgba.tobytes(), None))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            columns = [pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["frame_id", "width", "height", "data", "failure_reason"])

    return images.select("origin", "width", "height", "nChannels", "data").mapInArrow(run, "frame_id string, width int, height int, data binary, failure_reason string")


def write_images(frames: DataFrame, more: list[tuple[str, bytes]] = ()) -> str:
    """Writes a few packed frames (``frame_id, width, height, data``) as PNG files through Hadoop's file system.

    For small sets, such as test images: the files go through the driver. ``more`` are further names and contents.
    Returns the folder, a new one in the session's shared folder.
    """
    spark = frames.sparkSession
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='vistalake-images-')}"
    folder = f"{root.rstrip('/')}/images-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    shown = [(str(r.frame_id), png_rgba(np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, 4))) for r in frames.toLocalIterator()]
    for name, content in [*shown, *more]:
        out = files.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.png"))
        out.write(bytearray(content))
        out.close()
    files.deleteOnExit(jvm.org.apache.hadoop.fs.Path(folder))
    return folder


def png_rgba(image: np.ndarray) -> bytes:
    """An RGBA image as PNG."""
    h, w = image.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + image[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def to_pixels(frames: DataFrame, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A row for each pixel (of a region, if given) of packed frames ``frame_id, width, height, data``."""

    def run(batches):
        for batch in batches:
            for f, w, h, d in zip(*(batch.column(i).to_pylist() for i in range(4))):
                image = np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4)
                x, y, rw, rh = region or (0, 0, w, h)
                part = image[y : y + rh, x : x + rw]
                ys, xs = np.indices(part.shape[:2])
                flat = part.reshape(-1, 4).astype(np.int32)
                columns = [pa.array([f] * len(flat)), pa.array((xs.ravel() + x).astype(np.int32)), pa.array((ys.ravel() + y).astype(np.int32))]
                columns += [pa.array(flat[:, i]) for i in range(4)] + [pa.array(np.full(len(flat), v, dtype=np.int32)) for v in (w, h)]
                yield pa.RecordBatch.from_arrays(columns, ["frame_id", "x", "y", "r", "g", "b", "a", "width", "height"])

    return frames.select(F.col("frame_id").cast("string"), "width", "height", "data").mapInArrow(run, PIXELS)


class WindowSource(DataSource):
    """Windows of the desktop: ``title, width, height, data``. Live capture exists on one platform only.

    Option ``query``: only the first window whose title contains it, with its picture. Elsewhere there are no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "windows"

    def schema(self) -> str:
        return "title string, width int, height int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _NoWindows()


class _NoWindows(DataSourceReader):
    def read(self, partition):
        return iter(())


def _windows(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(WindowSource)
    return spark.read.format("windows").options(**options).load()


def list_windows(spark: SparkSession) -> DataFrame:
    """Titles of visible windows."""
    return _windows(spark).select("title")


def capture_window(spark: SparkSession, query: str) -> DataFrame:
    """The first window whose title contains ``query``: no rows where capture isn't possible."""
    found = _windows(spark, query=query)
    return found.where(title_matches(F.col("title"), query)).limit(1)


def title_matches(title: Column, query: str) -> Column:
    """Containment after lowering A-Z of the title (and all of the query)."""
    lowered = F.translate(title, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (F.char_length(title) > 0) & F.contains(lowered, F.lit(query.lower()))


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixels as Parquet, sorted by frame so that a frame or region prunes row groups."""
    pixels.repartitionByRange("frame_id").sortWithinPartitions("frame_id", "y", "x").write.parquet(path)
