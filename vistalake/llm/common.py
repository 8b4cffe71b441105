"""Shared helpers of the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls 0x09 to 0x0D. ``bytes.split()`` cuts at exactly these.
ASCII_SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is held several times over, in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on the rows and bytes of an Arrow batch where they are larger.

    They are read when a query is planned, after the operator has returned, so they have to be the session's.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def crc_bucket(doc_id, modulus: int):
    """``crc32(doc_id as text) mod modulus`` as a column; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of its own only in local mode, where none is set."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="vistalake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the scratch scope around the call or when the driver exits."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _OPEN.get().append(path)
    return path


#: The paths that the innermost scratch scope will delete.
_OPEN: ContextVar[list[str]] = ContextVar("open_scratch", default=[])


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that are materialized inside, but for those appended to the list that it gives."""
    kept: list[DataFrame] = []
    outer = _OPEN.get()
    token = _OPEN.set([])
    try:
        yield kept
    finally:
        paths = _OPEN.get()
        _OPEN.reset(token)
        stay = {getattr(t, "scratch", None) for t in kept}
        for path in paths:
            if path in stay:
                outer.append(path)
            else:
                remove_path(spark, path)


def materialize(df: DataFrame, label: str, gather: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    ``gather``: rows that many tasks make a few of are dealt anew by their bytes, into few files. On a local file system
    without Hadoop's native library each file costs the JVM two processes (``chmod``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.hint("rebalance") if gather else df).write.parquet(path)
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, wherever it lives."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for t in tables:
        if getattr(t, "scratch", None):
            remove_path(t.sparkSession, t.scratch)


def broadcast_small(rows: DataFrame, most: int) -> DataFrame:
    """A broadcast of the rows if there are at most ``most``, which is counted; else the rows as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lean_worker() -> None:
    """In a Python worker: forgets what the tokenizer's tasks remembered, before a task of another kind.

    Memory that earlier tasks have freed goes back to the system, as workers outlive their tasks.
    """
    packing = sys.modules.get("vistalake.llm.packing")
    if packing is not None and packing.encoder_of.cache_info().currsize:
        packing.encoder_of.cache_clear()
        gc.collect()
    pa.system_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


def fresh_name(taken, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``taken`` has that name (case ignored)."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def word_ids(words: list) -> tuple[list[int], int]:
    """Each word's number in order of first appearance, and how many numbers there are."""
    seen: dict = {}
    number = seen.setdefault
    return [number(w, len(seen)) for w in words], len(seen)
