"""The mosaic of a stream of pixels or tiles: state keyed by place, brought up to date as scenes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_valid(stream: DataFrame, keys=("row", "col"), time: str | None = None, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """The last valid value of each key: ``update`` mode emits a key whenever a later scene changes it.

    With ``time``, per tumbling window of event time with a watermark, so that state ends and ``append`` mode works.
    """
    by = list(keys)
    if time:
        stream = stream.withWatermark(time, delay)
        by = [F.window(time, window).alias("window"), *by]
    return stream.groupBy(*by).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ord"))).alias("value"))


def complete_blocks(stream: DataFrame, expected: DataFrame, keys=("top", "left")) -> DataFrame:
    """keys, arrived, expected of blocks all of whose inputs have arrived; ``expected`` (keys, expected) is static.

    Repeated arrivals of a scene count once.
    """
    seen = stream.groupBy(*keys).agg(F.size(F.collect_set("scene_id")).alias("arrived"))
    return seen.join(expected, list(keys)).where("arrived >= expected")
