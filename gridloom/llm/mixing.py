"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same copy number, target / source size: a whole part
and a fraction. The fractions are rounded in pairs. Two documents of a source exchange
words until the fraction of one of them is whole; the direction is drawn so that each
keeps its expected copies, and the words the pair takes stay the same. So a source's taken
words differ from its target by no more than its last document.

Rounding runs as a reduction tree. A bucket of documents (by hash, their number set by the
number of documents alone) leaves at most one unrounded document a source; these residuals
are paired in groups of ``FAN`` buckets, level by level, until one a source is left, which is
drawn. A hot source is spread over all buckets, and no group holds more than a bucket or
``FAN`` residuals of each of about ``SOURCES`` sources. Draws come from hashes of doc_id, so reruns agree whatever the
partitions are.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_DOCS, FAN, SOURCES = 4096, 64, 1000
_UNIT = "row_id string, source string, size long, bucket long, draw double, fraction double, copies long, share long"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of ``docs`` (source, size): one row a source.

    Sources in code point order, null last, take the weights in turn. Targets share all sizes by weight; one
    above ``most`` times its source's size stops there, and its excess goes to the others by weight.
    With limits l and weights w, the targets are min(l, c * w): sources stop in order of l / w, so
    running sums over that order give c. Both windows run over one row a source.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # UTF8_BINARY order is code point order.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_sizes = F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # The factor if this source and those after it in the order were the ones not stopped.
    w = w.withColumn("factor", (all_sizes - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.col("factor") * F.col("w") <= F.col("limit")
    # The first source that need not stop sets the factor for all.
    w = w.withColumn("c", F.first(F.when(free, F.col("factor")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "source_size", F.least("limit", F.coalesce(F.col("c") * F.col("w"), F.col("limit"))).alias("target"))


def _pair(size, fraction, copies, draw):
    """Pivotal rounding along the given order; returns the position left unrounded, or -1."""
    open_ = -1
    for j in range(len(size)):
        if not 1e-9 < fraction[j] < 1 - 1e-9:
            copies[j] += int(round(fraction[j]))
            fraction[j] = 0.0
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        a, b = size[i], size[j]
        # Words move from j to i, or from i to j, until one of the two is whole.
        up = min((1 - fraction[i]) * a, fraction[j] * b)
        down = min(fraction[i] * a, (1 - fraction[j]) * b)
        move = up if draw[j] < down / (up + down) else -down
        fraction[i] += move / a
        fraction[j] -= move / b
        open_ = -1
        for k in (i, j):
            if fraction[k] < 1e-9 or fraction[k] > 1 - 1e-9:
                copies[k] += int(round(fraction[k]))
                fraction[k] = 0.0
            else:
                open_ = k
    return open_


def _round(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["source", "size", "draw", "row_id"], na_position="last", ignore_index=True)
    size, fraction, copies, draw = (pdf[c].to_numpy(dtype=t).copy() for c, t in (("size", float), ("fraction", float), ("copies", np.int64), ("draw", float)))
    left = np.zeros(len(pdf), bool)
    for _, at in pdf.groupby("source", dropna=False, sort=False).indices.items():
        f, c = fraction[at], copies[at]
        k = _pair(size[at], f, c, draw[at])
        if k >= 0 and last:
            c[k] += int(draw[at][k] < f[k])
            f[k] = 0.0
        elif k >= 0:
            left[at[k]] = True
        fraction[at], copies[at] = f, c
    pdf["copies"], pdf["fraction"] = copies, np.where(left, fraction, 0.0)
    return pdf


def copy_numbers(units: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``units`` (row_id, source, size) with source_size, target, copies; row_id is unique."""
    units = units.select("row_id", "source", "size")
    goal = cut(targets(units, weights, most))
    n = units.count()
    buckets = max(1, n // BUCKET_DOCS)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.pmod(F.xxhash64("row_id", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)
    # Sources are spread too, so that neither very many nor a hot one make a large group.
    share = F.pmod(F.xxhash64("source"), F.lit(goal.count() // SOURCES + 1)).alias("share")
    x = units.join(goal, units.source.eqNullSafe(goal.source)).select("row_id", units.source, "size", F.pmod(F.xxhash64("row_id", F.lit(31)), F.lit(buckets)).alias("bucket"), draw.alias("draw"), (copies - F.floor(copies)).alias("fraction"), F.floor(copies).cast("long").alias("copies")).select("*", share)
    # Rows without words take nothing and need no rounding.
    idle = x.where("size = 0").select("row_id", F.lit(0).cast("long").alias("copies"))
    done = cut(x.where("size > 0").groupBy("bucket", "share").applyInPandas(partial(_round, last=buckets == 1), _UNIT))
    result, rest, level = done.where("fraction = 0").select("row_id", "copies").union(idle), done.where("fraction > 0"), buckets
    while level > 1:
        level = -(-level // FAN)
        rest = rest.withColumn("bucket", F.pmod(F.col("bucket"), F.lit(level)))
        rest = cut(rest.groupBy("bucket", "share").applyInPandas(partial(_round, last=level == 1), _UNIT))
        result, rest = result.union(rest.where("fraction = 0").select("row_id", "copies")), rest.where("fraction > 0")
    return units.join(result, "row_id").join(goal, units.source.eqNullSafe(goal.source)).select("row_id", units.source, "size", "source_size", "target", "copies")


def _units(docs: DataFrame) -> DataFrame:
    """A row for each distinct (doc_id, source, size, text), counted: repeated rows are one unit with their joint size."""
    keyed = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("words"), F.xxhash64("text").alias("th"))
    return keyed.groupBy("doc_id", "source", "words", "th").agg(F.count("*").alias("rows")).select(
        row_key().alias("row_id"), "doc_id", "source", "words", "th", "rows", (F.col("words") * F.col("rows")).alias("size"))


def row_key(words="words", th="th") -> F.Column:
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat_ws(":", null("doc_id"), null("source"), F.col(words).cast("string"), F.hex(F.col(th)))


def mixture(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken.

    size is the number of words (null and empty: 0) and taken is size times the copies of the document, which
    are at most ``most``. Rows that repeat a document take the same copies each. A null source is a source of its
    own, last in order; a source without words has target 0. An empty table gives an empty result; other columns are ignored.
    """
    units = cut(_units(docs))
    got = copy_numbers(units, weights, most).select("row_id", "source_size", "target", "copies")
    return (units.join(got, "row_id").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
            .select("doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("words") * F.col("copies")).alias("taken")))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, or not at all.

    Rows without words (null, empty, blank) take nothing and always go, whatever the factor of their source; a source of such rows only goes whole.
    """
    got = copy_numbers(cut(_units(docs)), weights, most).where("copies > 0").select("row_id", F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("copies"))
    # Whole rows in one column, whatever theirs are named.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("words"), F.xxhash64("text").alias("th"))
    return keyed.select("row", row_key().alias("row_id")).join(got, "row_id").select("row", F.explode("copies")).select("row.*")
