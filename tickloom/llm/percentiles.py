"""Exact percentiles per group by bisection on counts, combinable over parts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut

#: Values of a summary's bucket differ by at most this share.
RELATIVE = 0.02


def section_counts(rows: DataFrame, intervals: DataFrame, groups: Sequence[str], sections: int, signed_log: bool) -> DataFrame:
    """Rows of each interval per section: groups, lo, hi, section, n, least, most.

    ``rows`` has the groups and ``v``; ``intervals`` the groups, ``lo`` and ``hi``. The counts are sums and the bounds are
    minima and maxima, so results of separate parts combine by ``merge_counts``. Sections are of equal width in value
    or, every other pass, in signed logarithm, so neither even nor long-tailed values need many passes.
    """
    scale = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if signed_log else (lambda c: F.col(c) / 2)
    near = rows.join(intervals, list(groups)).where("v BETWEEN lo AND hi")
    width = scale("hi") - scale("lo")
    place = F.coalesce(F.floor((scale("v") - scale("lo")) / F.when(width > 0, width) * sections), F.when(F.col("v") < F.col("hi"), 0).otherwise(sections - 1))
    section = F.greatest(F.lit(0), F.least(place, F.lit(sections - 1)))
    return near.groupBy(*groups, "lo", "hi", section.alias("section")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def merge_counts(parts: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The counts of all parts together."""
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*groups, "lo", "hi", "section").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def summarise(rows: DataFrame, groups: Sequence[str], value: str, relative: float = RELATIVE) -> DataFrame:
    """A summary of a part (a day, a file) that can be stored: groups, bucket, n, least, most.

    Buckets are of equal width in signed logarithm, so a bucket's values differ by a share of at most ``relative``; their number
    follows from the values' span and not from how many there are. Counts, minima and maxima are added map-side. Summaries of separate
    parts made with the same ``relative`` combine by ``merge_summaries``, in any order and at any later time. NULL, NaN and infinite values are left out.
    """
    v = F.col(value).cast("double")
    size = F.floor(F.ln(F.abs(v)) / math.log1p(relative))
    # Zero is a bucket of its own; the sign goes into the number, so that values of both signs never share one.
    bucket = F.when(v > 0, size * 2).when(v < 0, size * 2 + 1)
    kept = rows.select(*groups, v.alias("_v"), bucket.cast("bigint").alias("bucket")).where("NOT isnan(_v) AND abs(_v) < double('infinity')")
    return kept.groupBy(*groups, "bucket").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def merge_summaries(parts: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The summary of all parts together."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _placed(summary: DataFrame, groups: Sequence[str], probabilities: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(groups, p, n, h) wanted, h being the place from 0 that may lie between two ranks; and (groups, rank, lo, hi, below): where each rank needed
    must lie, from the buckets' counts in the order of their values. Groups must not be NULL."""
    size = summary.groupBy(*groups).agg(F.sum("n").alias("n"))
    wanted = size.select(*groups, "n", F.explode(F.array(*map(F.lit, probabilities))).alias("p")).withColumn("h", (F.col("n") - 1) * F.col("p"))
    ranks = wanted.select(*groups, F.explode(F.array(F.floor("h") + 1, F.ceil("h") + 1)).alias("rank")).distinct()
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy("least").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = summary.withColumn("upto", upto)
    start = F.col("upto") - F.col("n")
    hit = ranks.join(counted, list(groups)).where(F.col("rank").between(start + 1, F.col("upto")))
    return wanted, hit.select(*groups, "rank", *_narrowed(start), start.alias("below"))


def _narrowed(start: Column) -> list[Column]:
    """lo and hi of a rank within a stretch of n values from least to most, ``start`` values lying before it: the first is the least, the last the greatest."""
    low = F.when(F.col("rank") == start + F.col("n"), F.col("most")).otherwise(F.col("least"))
    high = F.when(F.col("rank") == start + 1, F.col("least")).otherwise(F.col("most"))
    return [F.least(low, high).alias("lo"), high.alias("hi")]


def _interpolated(wanted: DataFrame, intervals: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, p, n, value, error: between the two ranks around each place, each taken as the middle of its interval."""
    low, high = (intervals.select(*groups, F.col("rank").alias(f"{s}_rank"), ((F.col("lo") + F.col("hi")) / 2).alias(f"{s}_v"), (F.col("hi") - F.col("lo")).alias(f"{s}_e")) for s in ("a", "b"))
    ends = wanted.withColumn("a_rank", F.floor("h") + 1).withColumn("b_rank", F.ceil("h") + 1).join(low, [*groups, "a_rank"]).join(high, [*groups, "b_rank"])
    between = F.col("a_v") + (F.col("h") - F.floor("h")) * (F.col("b_v") - F.col("a_v"))
    return ends.select(*groups, "p", "n", between.alias("value"), (F.greatest("a_e", "b_e") / 2).alias("error"))


def _keyed(df: DataFrame, groups: Sequence[str], names: Sequence[str], *more: Column) -> DataFrame:
    """NULL keys never join, so every key is written with a mark in front."""
    return df.select(*[F.concat(F.when(F.col(g).isNull(), "-").otherwise("+"), F.coalesce(F.col(g).cast("string"), F.lit(""))).alias(a) for g, a in zip(groups, names)], *more)


def _unkeyed(df: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(F.col(a).startswith("+"), F.expr(f"substr({a}, 2)")).alias(g) for g, a in zip(groups, names)], "p", "n", "value", "error")


def summary_percentiles(summary: DataFrame, groups: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Percentiles from stored summaries alone, without the rows: groups, p, n, value, and the bound on the error, at most half ``relative`` of the value."""
    gs = [f"g{i}" for i in range(len(groups))]
    keyed = _keyed(summary, groups, gs, F.col("n"), F.col("least"), F.col("most"))
    return _unkeyed(_interpolated(*_placed(keyed, gs, probabilities), gs), groups, gs)


def exact_percentiles(
    parts: DataFrame | Sequence[DataFrame], groups: Sequence[str], value: str, probabilities: Sequence[float], tolerance: float = 0.0, sections: int = 64
) -> DataFrame:
    """Linearly interpolated percentiles of ``value`` per group over all ``parts`` (days, files) together.

    For each group and wanted rank an interval is kept that surely holds the value of that rank. The first one comes from the parts'
    merged summaries; only the rows in such an interval, which is narrow, are kept for what follows. One pass over them counts
    those below each of ``sections - 1`` points of every open interval (six bisections at once for 64), keeps the
    section that the rank falls into and narrows it to the values really in it. It ends when every interval is a single
    value, or no wider than ``tolerance``: the stated bound on the error. Only counts are shuffled, after map-side
    addition, so a group of any size is spread over all tasks; the intervals are one row per group and rank. Each part is read twice.

    Returns groups, ``p``, ``n`` (rows with a value), ``value`` and ``error`` (0 if exact). NULL, NaN and infinite values
    are left out, and a group without any value has no row; NULL groups form a group; repeated rows count each; an
    empty table gives no rows.
    """
    parts = [parts] if isinstance(parts, DataFrame) else list(parts)
    gs = [f"g{i}" for i in range(len(groups))]
    columns = [_keyed(p, groups, gs, F.col(value).cast("double").alias("v")).where(~F.isnan("v") & (F.abs("v") < float("inf"))) for p in parts]
    summary = cut(merge_summaries([summarise(c, gs, "v") for c in columns], gs))
    wanted, intervals = _placed(summary, gs, probabilities)
    wanted, intervals = cut(wanted), cut(intervals)
    wide = lambda: intervals.where(F.col("hi") - F.col("lo") > tolerance)
    if not wide().isEmpty():
        open_ = wide().select(*gs, "lo", "hi").distinct()
        rows = [cut(c.join(open_, gs).where("v BETWEEN lo AND hi").select(*gs, "v", "lo", "hi")) for c in columns]
        first = [r.select(*gs, F.col("lo").alias("first_lo"), F.col("hi").alias("first_hi"), "v") for r in rows]
        intervals = intervals.withColumn("first_lo", F.col("lo")).withColumn("first_hi", F.col("hi"))
        # Buckets don't overlap, so a row is in one first interval, and only meets the ranks of that one.
        own = [*gs, "first_lo", "first_hi"]
        key = [*own, "lo", "hi"]
        for attempt in range(10_000):
            left = wide()
            if left.isEmpty():
                break
            distinct = left.select(*key).distinct()
            counts = merge_counts([section_counts(r, distinct, own, sections, attempt % 2 == 1) for r in first], own)
            upto = Window.partitionBy(*key).orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            counts = counts.withColumn("upto", F.sum("n").over(upto))
            hit = left.join(counts, key).where("rank > below + upto - n AND rank <= below + upto")
            start = F.col("below") + F.col("upto") - F.col("n")
            hit = hit.select(*own, "rank", *_narrowed(start), start.alias("below"))
            intervals = cut(intervals.where(F.col("hi") - F.col("lo") <= tolerance).unionByName(hit))
    return _unkeyed(_interpolated(wanted, intervals, gs), groups, gs)
