"""Lists of input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_filelist(path: str) -> list[str]:
    """One path a line without surrounding white space; blank lines stay, as ''."""
    with open(path) as f:
        return [line.strip() for line in f]


def filelist_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    """scene_id, ord: the order of the list is that of precedence."""
    return spark.createDataFrame(list(enumerate(paths)), "ord int, scene_id string").select("scene_id", "ord")
