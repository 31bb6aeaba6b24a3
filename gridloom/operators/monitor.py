"""Analytics over named time spans.

stamps: name, phase ("start" or "end"), t in seconds. spans: name, started, ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.prefix import running

SEPARATOR = ":"


def parse_stamps(keyed: DataFrame) -> DataFrame:
    """name, phase, t of rows (key "name:phase", t)."""
    parts = F.split("key", SEPARATOR)
    return keyed.select(parts[0].alias("name"), parts[1].alias("phase"), "t")


def names_with_prefix(stamps: DataFrame, prefix: str) -> DataFrame:
    return stamps.where(F.col("name").startswith(prefix)).select("name").distinct()


def spans(stamps: DataFrame, prefix: str = "") -> DataFrame:
    """Start and end stamp of a name side by side; names without either are left out."""
    s = stamps.where(F.col("name").startswith(prefix)) if prefix else stamps
    t = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("t")))
    return s.groupBy("name").agg(t("start").alias("started"), t("end").alias("ended")).where("started IS NOT NULL AND ended IS NOT NULL")


def time_spent(spans: DataFrame, by=()) -> DataFrame:
    return spans.groupBy(*by).agg(F.round(F.sum(F.col("ended") - F.col("started")), 2).alias("spent"))


def time_average(spans: DataFrame, by=()) -> DataFrame:
    """NULL where there are no spans."""
    return spans.groupBy(*by).agg(F.round(F.avg(F.col("ended") - F.col("started")), 3).alias("average"))


def sweep(spans: DataFrame, by=()) -> DataFrame:
    """by, t, active, until: spans that are active from t until the next event. At a tie ends come before starts."""
    events = spans.select(*by, F.explode(F.array(F.struct(F.col("started").alias("t"), F.lit(1).alias("d")), F.struct(F.col("ended").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.*")
    # Events of one time and direction are summed first, so that a span of equal starts is one row.
    events = events.groupBy(*by, F.col("t").cast("double").alias("t"), "d").agg(F.sum("d").alias("n"))
    return running(events, by, ["t", "d"], "n").select(*by, "t", F.col("running").alias("active"), F.col("following").alias("until"))


def time_elapsed(spans: DataFrame, by=()) -> DataFrame:
    """Time with at least one span active."""
    return sweep(spans, by).groupBy(*by).agg(F.round(F.sum(F.when((F.col("active") > 0) & F.col("until").isNotNull(), F.col("until") - F.col("t")).otherwise(0.0)), 2).alias("elapsed"))


def overlap_percent(spans: DataFrame, by=()) -> DataFrame:
    """Share of the time from first to last event with two spans or more active, in percent."""
    s = sweep(spans, by).groupBy(*by).agg(F.sum(F.when((F.col("active") > 1) & F.col("until").isNotNull(), F.col("until") - F.col("t")).otherwise(0.0)).alias("both"), F.min("t").alias("a"), F.max("t").alias("b"))
    return s.select(*by, F.when(F.col("b") > F.col("a"), 100 * F.col("both") / (F.col("b") - F.col("a"))).alias("overlap"))


def merge_stamps(*sets: DataFrame) -> DataFrame:
    """Stamps of several runs in one; the later set wins for the same name and phase."""
    tagged = [s.select("name", "phase", "t", F.lit(i).alias("_set")) for i, s in enumerate(sets)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out.groupBy("name", "phase").agg(F.max_by("t", "_set").alias("t"))
