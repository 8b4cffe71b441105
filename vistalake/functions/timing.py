"""Moving averages over the last samples, by a bounded window frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def moving_average(value: Column, size: int, window: WindowSpec) -> Column:
    """Sum of the last ``size`` samples over ``size``, from the first sample on (missing ones count as 0)."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return F.sum(value.cast("double")).over(window.rowsBetween(1 - size, 0)) / F.lit(float(size))


def fps(seconds: Column, samples: int, window: WindowSpec) -> Column:
    """Frames per second from frame times: the inverse of their moving average, 0 where that isn't positive."""
    average = moving_average(seconds, samples, window)
    return F.when(average <= 0, F.lit(0.0)).otherwise(F.lit(1.0) / average)
