"""Irregular readings onto a regular grid by local polynomial regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def regular_series(
    readings: DataFrame,
    keys: Sequence[str],
    time_ms: str,
    values: Sequence[str],
    step_ms: int = 300_000,
    bandwidth_ms: int = 450_000,
    min_support: float = 1.5,
) -> DataFrame:
    """A complete series per entity and UTC day: one row per grid cell from the first to the last cell with a reading.

    Each cell is evaluated at its middle by locally linear regression with the compact Epanechnikov kernel of half-width
    ``bandwidth_ms``. A reading reaches only the cells whose middle lies within the bandwidth (at most
    ``2 * bandwidth / step + 1``, three by default), so it is sent to those cells and nowhere else and only the kernel's
    moment sums are shuffled, after map-side addition. A hot entity is spread over its cells.

    Columns: keys, ``cell_ms`` (the cell's start), ``n`` (readings inside the cell), ``support`` (effective number of
    readings, (sum w)^2 / sum w^2, 0 if none is in reach), ``<value>_fit`` and ``status``: ``observed`` (n > 0),
    ``filled`` (none inside, support of at least ``min_support``) or ``missing`` (fit NULL). If the readings in reach have
    no spread in time, their weighted mean is the fit. Rows that lack the time or a value are left out; NULL keys form
    an entity of their own; repeated rows weigh twice; an empty table gives an empty series.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    vs = [f"v{i}" for i in range(len(values))]
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = readings.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(time_ms).cast("bigint").alias("t"), *[clean(v).alias(a) for v, a in zip(values, vs)])
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ["t", *vs]))
    half = step_ms // 2
    # Cells whose middle m satisfies |m - t| < bandwidth.
    lowest = F.floor((F.col("t") - half - bandwidth_ms) / step_ms) + 1
    highest = F.ceil((F.col("t") - half + bandwidth_ms) / step_ms) - 1
    own = F.floor(F.col("t") / step_ms)
    sent = rows.select("*", F.explode(F.sequence(F.least(lowest, own), F.greatest(highest, own))).alias("cell"), own.alias("own"))
    u = (F.col("t") - (F.col("cell") * step_ms + half)) / F.lit(float(bandwidth_ms))
    sent = sent.withColumn("u", u).withColumn("w", F.greatest(F.lit(0.0), 1 - F.col("u") * F.col("u")))
    w, x = F.col("w"), F.col("u")
    day = F.floor(F.col("cell") * step_ms / DAY_MS)
    moments = [F.count(F.when(F.col("cell") == F.col("own"), 1)).alias("n"), F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * w).alias("sq")]
    for v in vs:
        moments += [F.sum(w * F.col(v)).alias(f"{v}0"), F.sum(w * x * F.col(v)).alias(f"{v}1"), F.avg(F.when(F.col("cell") == F.col("own"), F.col(v))).alias(f"{v}m")]
    cells = sent.groupBy(*ks, day.alias("day"), "cell").agg(*moments)
    span = Window.partitionBy(*ks, "day")
    seen = F.when(F.col("n") > 0, F.col("cell"))
    cells = cells.withColumn("first", F.min(seen).over(span)).withColumn("last", F.max(seen).over(span)).where("cell BETWEEN first AND last")
    following = F.coalesce(F.lead("cell").over(span.orderBy("cell")) - 1, F.col("cell"))
    # Cells that no reading reaches have no row yet: each row also stands for the empty cells up to the next row.
    full = cells.withColumn("following", following).withColumn("at", F.explode(F.sequence("cell", "following")))
    real = F.col("at") == F.col("cell")
    support = F.when(real, F.coalesce(F.try_divide(F.col("s0") * F.col("s0"), F.col("sq")), F.lit(0.0))).otherwise(0.0)
    n = F.when(real, F.col("n")).otherwise(0)
    out = full.withColumn("n_at", n).withColumn("support", support)
    ok = (F.col("n_at") > 0) | (F.col("support") >= min_support)
    determinant = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fits = []
    for name, v in zip(values, vs):
        slope = (F.col("s2") * F.col(f"{v}0") - F.col("s1") * F.col(f"{v}1")) / F.when(determinant > 1e-6 * F.col("s0") * F.col("s0"), determinant)
        level = F.col(f"{v}0") / F.when(F.col("s0") > 0, F.col("s0"))
        fits.append(F.when(ok, F.coalesce(slope, level, F.col(f"{v}m"))).alias(f"{name}_fit"))
    status = F.when(F.col("n_at") > 0, "observed").when(ok, "filled").otherwise("missing")
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], (F.col("at") * step_ms).alias("cell_ms"), F.col("n_at").cast("bigint").alias("n"), "support", *fits, status.alias("status"))
