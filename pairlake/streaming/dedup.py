"""Keep-first deduplication of an arriving pair stream: an extension of the batch mixer."""

from __future__ import annotations

from pyspark.sql import DataFrame


def deduplicated(stream: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first arrival of each key; state of keys older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
