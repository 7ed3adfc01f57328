"""Beyond the file-based builders: samples that arrive as a stream, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, as it arrives first; keys are forgotten after the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def split_of(key: str, train: int = 85, val: int = 10):
    """A split that needs no count of all rows: by a hash of the key, in hundredths."""
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(100))
    return F.when(place < train, "train").when(place < train + val, "val").otherwise("test")


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and group; rows later than the watermark are left out."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, length), by)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
