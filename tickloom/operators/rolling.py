"""Totals and averages over trailing periods, for every calendar day of every entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_totals(daily: DataFrame, keys: Sequence[str], day: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and each calendar day from its first to its last, totals and averages of ``value`` over trailing periods.

    A range join: each calendar day meets the daily totals from ``day - (max(periods) - 1)`` to ``day``. Both sides carry a
    coarse bucket of ``max(periods)`` days, and a total is offered to its own bucket and the next, so the equality part of
    the join admits all candidates and few others. A join group holds at most that many calendar days and twice as many
    totals, whatever the history's length, so no entity is hot; several rows of one day are summed before the join.

    Returns keys, day, and for each period p ``total_p``, ``days_p`` (days with a row), ``avg_p`` (total over days with a
    row, NULL if none) and ``calendar_avg_p`` (total over the p calendar days), and ``span_day`` (1 on the first day).
    NULL or NaN values count as no row; rows with a NULL day or key are left out; an empty table gives an empty result.
    """
    width = max(periods)
    keys = list(keys)
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = daily.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.unix_date(F.col(day).cast("date")).alias("d"), number.alias("v"))
    rows = rows.where(" AND ".join([*(f"k{i} IS NOT NULL" for i in range(len(keys))), "d IS NOT NULL", "v IS NOT NULL"]))
    ks = [f"k{i}" for i in range(len(keys))]
    totals = rows.groupBy(*ks, "d").agg(F.sum("v").alias("v"))
    spans = totals.groupBy(*ks).agg(F.min("d").alias("first"), F.max("d").alias("last"))
    calendar = spans.select(*ks, "first", F.explode(F.sequence("first", "last")).alias("at")).withColumn("bucket", F.floor(F.col("at") / width))
    own = F.floor(F.col("d") / width)
    offered = totals.withColumn("bucket", F.explode(F.array(own, own + 1)))
    # The join keeps only candidates of the same bucket; days without a row in reach survive through the left side.
    near = calendar.join(offered.withColumnRenamed("d", "of"), [*ks, "bucket"], "left").withColumn(
        "age", F.when(F.col("of") <= F.col("at"), F.col("at") - F.col("of"))
    )
    sums = []
    for p in periods:
        inside = F.col("age") < p
        sums += [F.coalesce(F.sum(F.when(inside, F.col("v"))), F.lit(0.0)).alias(f"total_{p}"), F.count(F.when(inside, 1)).alias(f"days_{p}")]
    out = near.groupBy(*ks, "bucket", "at").agg(F.first("first").alias("first"), *sums)
    columns = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)] + [F.date_from_unix_date("at").alias(day), (F.col("at") - F.col("first") + 1).alias("span_day")]
    for p in periods:
        columns += [F.col(f"total_{p}"), F.col(f"days_{p}"), F.try_divide(F.col(f"total_{p}"), F.col(f"days_{p}")).alias(f"avg_{p}"), (F.col(f"total_{p}") / p).alias(f"calendar_avg_{p}")]
    return out.select(*columns)
