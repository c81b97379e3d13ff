"""Looking at the row before, without a source's whole history in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column, prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + column``: the values of the row before in the order of ``order`` within ``keys``.

    ``chunk`` must not decrease along the order (a day number, say). Windows run within (keys, chunk); the first row of a
    chunk takes over the last row of the chunk before, from a table with one row per chunk. So a hot source is spread over
    its chunks, and only chunk summaries are ordered per source.
    """
    rows = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    values = F.struct(*columns)
    # The chunk's last row; keys are compared null-safely because NULL keys make a group too.
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by(values, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_end")
    inside = rows.withColumn("_before", F.lag(values).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    a, b = inside.alias("a"), ends.alias("b")
    same = F.col("a._chunk") == F.col("b._chunk")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, same, "left").select("a.*", "b._carry")
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    return joined.select(*df.columns, *[before.getField(c).alias(prefix + c) for c in columns])


def day_of(ms: Column | str) -> Column:
    return F.floor((F.col(ms) if isinstance(ms, str) else ms) / 86_400_000)


def running_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, chunk: Column, name: str) -> DataFrame:
    """Number the groups that begin where ``starts`` holds, within keys and order: running sums per chunk plus the sums of earlier chunks."""
    rows = df.withColumn("_chunk", chunk).withColumn("_start", F.coalesce(starts, F.lit(False)).cast("bigint"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_start").alias("_n"))
    sums = sums.withColumn("_offset", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_n")).drop("_n")
    a, b = rows.withColumn("_at", F.sum("_start").over(w)).alias("a"), sums.alias("b")
    same = F.col("a._chunk") == F.col("b._chunk")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, same).select("a.*", "b._offset")
    return joined.select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))
