"""Seeded synthetic quotes: a Gaussian walk on a 30-second grid inside both session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.frozen import FROZEN

#: pair: (pip, level, spread in pips). Fixed values.
PAIRS = {
    "EURUSD": (0.0001, 1.10, 0.6), "GBPUSD": (0.0001, 1.27, 0.9), "USDJPY": (0.01, 150.0, 0.7),
    "AUDUSD": (0.0001, 0.66, 0.9), "USDCAD": (0.0001, 1.35, 1.5), "USDCHF": (0.0001, 0.92, 1.1),
}


def generate(spark: SparkSession, first: str, last: str, seed: int = 42, compressed: float = 0.30, pairs: dict | None = None) -> DataFrame:
    """sym, utc_ms, seq, tick_id, bid, ask on weekdays. On Fridays the Asia window moves by ``compressed`` of the usual step.

    A row's step is drawn from a hash of (seed, pair, time), so the data don't depend on partitioning. The walk adds up
    within a day and starts each day at the pair's level.
    """
    table = F.array(*[F.struct(F.lit(p).alias("sym"), *[F.lit(float(x)).alias(n) for n, x in zip(("pip", "level", "spread"), v)]) for p, v in sorted((pairs or PAIRS).items())])
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS day").where(F.weekday("day") < 5)
    a, z = FROZEN.asia_minutes[0], FROZEN.london_minutes[1]
    grid = days.withColumn("slot", F.explode(F.sequence(F.lit(a * 2), F.lit(z * 2 - 1))))
    start = F.unix_millis(F.to_utc_timestamp(F.col("day").cast("timestamp"), FROZEN.session_zone))
    rows = grid.withColumn("of", F.explode(table)).select("day", "slot", "of.*").withColumn("utc_ms", start + F.col("slot") * 30_000)
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "sym", "utc_ms"), F.lit(2**52)) + 0.5) / float(2**52)
    normal = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))
    calm = (F.weekday("day") == 4) & (F.col("slot") < FROZEN.asia_minutes[1] * 2)
    step = normal * F.col("pip") * F.when(calm, compressed).otherwise(1.0)
    w = Window.partitionBy("sym", "day").orderBy("slot")
    bid = F.col("level") + F.sum(step).over(w)
    seq = F.row_number().over(w).cast("bigint") - 1
    return rows.select("sym", "utc_ms", seq.alias("seq"), seq.alias("tick_id"), bid.alias("bid"), (bid + F.col("spread") * F.col("pip")).alias("ask"))
