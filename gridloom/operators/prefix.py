"""Running sums over the ordered rows of groups of any size.

A window over a whole group would put it into one task. Here each group's rows fall into ranges of the order
column: sums of ranges are run over first, one row a range, and then the rows within each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def beside(a: DataFrame, b: DataFrame, by) -> DataFrame:
    """``a`` with the columns of ``b``, which has one row a group; null keys are a group too. Without keys ``b`` is one row."""
    if not by:
        return a.join(F.broadcast(b))
    keys = {c: f"_key_{c}" for c in by}
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return a.join(b.withColumnsRenamed(keys), on, "left").drop(*keys.values())


def _range(t: Column) -> Column:
    """Which of ``RANGES`` equal ranges between the least and the greatest finite value holds t; NaN comes last."""
    share = (t - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES
    return F.when(F.isnan(t), RANGES - 1).when(F.col("_hi") > F.col("_lo"), F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(RANGES - 1.0)))).otherwise(0).cast("int")


def running(df: DataFrame, by, order, add: str) -> DataFrame:
    """``df`` with running, the sum of ``add`` up to and including a row, and following, the next row's first order column.

    Rows of a group differ in ``order``, whose first column is a double without nulls; following is NULL in a group's last row.
    """
    by, t = list(by), F.col(order[0])
    finite = F.when(~F.isnan(t) & (F.abs(t) != float("inf")), t)
    x = beside(df, df.agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi")), ()).withColumn("_range", _range(t)).drop("_lo", "_hi")
    sums = x.groupBy(*by, "_range").agg(F.sum(add).alias("_sum"), F.min(t).alias("_first"))
    ranges = Window.partitionBy(*by).orderBy("_range")
    before = F.coalesce(F.sum("_sum").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_range", before.alias("_before"), F.lead("_first").over(ranges).alias("_after"))
    rows = Window.partitionBy(*by, "_range").orderBy(*order)
    x = x.withColumn("_own", F.sum(add).over(rows.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lead", F.lead(t).over(rows))
    x = beside(x, sums, [*by, "_range"])
    return x.withColumn("running", F.col("_before") + F.col("_own")).withColumn("following", F.coalesce("_lead", "_after")).drop("_range", "_own", "_lead", "_before", "_after")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by=()) -> DataFrame:
    """by, one column for each share with linear interpolation, count of the values; exact, NULL where there are none."""
    by = list(by)
    v = df.select(*by, F.col(value).cast("double").alias("_v"))
    counts = v.where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    ranked = running(counts, by, ["_v"], "_c")
    totals = v.groupBy(*by).agg(F.count("_v").alias("count"))
    x = beside(ranked, totals, by)
    at = lambda k: F.max(F.when((F.col("running") - F.col("_c") <= k) & (k < F.col("running")), F.col("_v")))
    places = {name: F.lit(q) * (F.col("count") - 1) for name, q in shares.items()}
    found = x.groupBy(*by).agg(*[c for name, p in places.items() for c in (at(F.floor(p)).alias(f"_low_{name}"), at(F.ceil(p)).alias(f"_high_{name}"))])
    out = beside(totals, found, by)
    return out.select(*by, *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (p - F.floor(p))).alias(n) for n, p in places.items()], "count")
