"""Types of the engine: explicit schemas and the result vocabulary.

A result is a struct of value, confidence, timestamp, source, reliability and failure reason, so "nothing there" and
"could not look" are different answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORROBORATED, HEURISTIC, PREDICTED, UNRELIABLE = "Corroborated", "Heuristic", "Predicted", "Unreliable"
RELIABILITY = (CORROBORATED, HEURISTIC, PREDICTED, UNRELIABLE)

RECT = T.StructType([T.StructField(n, T.LongType()) for n in "xywh"])
POINT = T.StructType([T.StructField(n, T.FloatType()) for n in "xy"])
PIXEL_COLUMNS = ("x", "y", "r", "g", "b", "a")
TRACK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("position", POINT),
        T.StructField("velocity", POINT),
        T.StructField("width", T.FloatType()),
        T.StructField("height", T.FloatType()),
        T.StructField("last_seen_frame", T.LongType()),
        T.StructField("missed_frames", T.LongType()),
        T.StructField("age_frames", T.LongType()),
        T.StructField("confidence", T.FloatType()),
    ]
)
BLOB = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("bounds", RECT),
        T.StructField("velocity", POINT),
        T.StructField("age_frames", T.LongType()),
        T.StructField("is_predicted", T.BooleanType()),
    ]
)

def detection_type(value: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("value", value),
            T.StructField("confidence", T.FloatType()),
            T.StructField("timestamp_ms", T.LongType()),
            T.StructField("source", T.StringType()),
            T.StructField("reliability", T.StringType()),
            T.StructField("failure_reason", T.StringType()),
        ]
    )


def timestamp_ms(ts: Column | None = None) -> Column:
    """Milliseconds since the epoch, never negative; of the frame if it has a time, else of the query's start."""
    return F.greatest(F.unix_millis(ts if ts is not None else F.current_timestamp()), F.lit(0).cast("long"))


def _detection(value: Column, confidence: Column, at: Column | None, source: str, reliability, reason: Column) -> Column:
    return F.struct(
        value.alias("value"),
        confidence.cast("float").alias("confidence"),
        (at if at is not None else timestamp_ms()).cast("long").alias("timestamp_ms"),
        F.lit(source).alias("source"),
        (reliability if isinstance(reliability, Column) else F.lit(reliability)).alias("reliability"),
        reason.cast("string").alias("failure_reason"),
    )


def found(value: Column, confidence: Column, source: str, reliability=HEURISTIC, at: Column | None = None) -> Column:
    from vistalake.functions.confidence import confidence as clamp

    return _detection(value, clamp(confidence), at, source, reliability, F.lit(None))


def missing(kind: T.DataType | str, source: str, reason, at: Column | None = None) -> Column:
    return _detection(F.lit(None).cast(kind), F.lit(0.0), at, source, UNRELIABLE, reason if isinstance(reason, Column) else F.lit(reason))


def is_present(detection: Column) -> Column:
    """True if there is a value; an empty array is one."""
    return detection.getField("value").isNotNull()


def as_ref(detection: Column) -> Column:
    """The detection itself: values are never owned twice here."""
    return detection


def map_value(detection: Column, f) -> Column:
    """The detection with ``f`` applied to its value, all else unchanged."""
    value = detection.getField("value")
    return F.struct(
        F.when(value.isNotNull(), f(value)).alias("value"),
        *(detection.getField(n).alias(n) for n in ("confidence", "timestamp_ms", "source", "reliability", "failure_reason")),
    )
