"""Session calendars and session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.frozen import FROZEN, Frozen
from tickloom.functions.scalar import local, summer_time
from tickloom.operators.quotes import as_of

MINUTE = 60_000


def calendar(spark: SparkSession, first: str, last: str, p: Frozen = FROZEN) -> DataFrame:
    """One row per weekday of the session zone: both windows as half-open UTC instants, and whether summer time holds."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS london_date").where(F.weekday("london_date") < 5)
    midnight = F.col("london_date").cast("timestamp")
    at = lambda minute: F.to_utc_timestamp(midnight + F.make_dt_interval(mins=F.lit(minute)), p.session_zone)
    out = days.select("london_date", at(p.asia_minutes[0]).alias("asia_start"), at(p.asia_minutes[1]).alias("asia_end"), at(p.london_minutes[0]).alias("ldn_start"), at(p.london_minutes[1]).alias("ldn_end"))
    return out.withColumn("dst_summer", summer_time(F.col("ldn_start"), p.session_zone))


def owning_month(asia_start: Column) -> Column:
    """The month a session belongs to: that of its Asia start in UTC, so in summer the first of a month may belong to the one before."""
    return F.date_format(asia_start, "yyyyMM").cast("int")


def session_table(bars: DataFrame, p: Frozen = FROZEN, asia_bars: int | None = None, london_bars: int | None = None, age_minutes: float | None = None, bounded: bool = True, out_of_slice: bool = True) -> DataFrame:
    """One row per sym and weekday: ranges of both windows, their ratio, forward returns and validity. ``bars`` are one-minute closes.

    Both windows and all forward quotes of a session share one local date, so the whole table is one grouping by (sym,
    date) with conditional aggregates; no range join and no loop over days. Bars are grouped with map-side combination,
    and a group holds a day's minutes however hot the sym is. Every weekday between a sym's first and last bar has a row.

    ``bounded`` (the second version): windows need their floors of bars, a forward quote may be at most ``age_minutes`` old
    (exactly that passes); reasons are out-of-slice (the sym's data begin after
    the Asia start or end before the London end), window-coverage, zero-asia-range. Otherwise (the first version): fewer
    than 10 bars is no-data, an empty window is missing-window-data, and a quote may be of any age, over days.
    """
    age = p.quote_age if age_minutes is None else age_minutes
    floors = (p.asia_bars if asia_bars is None else asia_bars, p.london_bars if london_bars is None else london_bars)
    wall = local("bar_ms", p.session_zone)
    b = bars.withColumn("london_date", F.to_date(wall)).withColumn("m", F.hour(wall) * 60 + F.minute(wall)).where(F.weekday("london_date") < 5)
    asia, ldn = (F.col("m").between(w[0], w[1] - 1) for w in (p.asia_minutes, p.london_minutes))
    origin = p.london_minutes[0] - 1
    near = lambda at: F.max_by("mid_c", F.when(F.col("m").between(at - age, at), F.col("bar_ms")))
    when = lambda c, x: F.when(c, F.col(x))
    day = b.groupBy("sym", "london_date").agg(
        F.count(F.when(F.col("m") < p.london_minutes[1], 1)).alias("n_bars"), F.count(when(asia, "m")).alias("asia_n"), F.count(when(ldn, "m")).alias("ldn_n"),
        F.max(when(asia, "bid_h")).alias("asia_hi"), F.min(when(asia, "bid_l")).alias("asia_lo"), F.max(when(ldn, "bid_h")).alias("ldn_hi"), F.min(when(ldn, "bid_l")).alias("ldn_lo"),
        near(origin).alias("p0"), *[near(origin + h).alias(f"p{h}") for h in p.horizons],
    )
    # Where bars don't say when their quotes came, their data last from the bar's start to its end.
    first, last = ("first_ms", "last_ms") if "last_ms" in bars.columns else ("bar_ms", F.col("bar_ms") + MINUTE)
    span = bars.groupBy("sym").agg(F.min(first).alias("first_ms"), F.max(last).alias("end_ms"), F.max("bar_ms").alias("last_ms"))
    dates = span.select("sym", "first_ms", "end_ms", F.explode(F.sequence(F.to_date(local("first_ms", p.session_zone)), F.to_date(local("last_ms", p.session_zone)))).alias("london_date")).where(F.weekday("london_date") < 5)
    utc_minute = lambda minute: F.unix_millis(F.to_utc_timestamp(F.col("london_date").cast("timestamp") + F.make_dt_interval(mins=F.lit(minute)), p.session_zone))
    t = dates.join(day, ["sym", "london_date"], "left").na.fill(0, ["n_bars", "asia_n", "ldn_n"])
    t = t.withColumn("dst_summer", summer_time(F.timestamp_millis(utc_minute(p.london_minutes[0])), p.session_zone))
    if not bounded:
        # All lookups of a session in one as-of join, brought back to one row per session by their offset.
        names = ["p0", *(f"p{h}" for h in p.horizons)]
        offsets = F.array(*[F.struct(F.lit(c).alias("name"), utc_minute(m).alias("at")) for c, m in zip(names, [origin, *(origin + h for h in p.horizons)])])
        looks = t.select("sym", "london_date", F.explode(offsets).alias("o")).select("sym", "london_date", "o.*")
        found = as_of(looks, bars.select("sym", "bar_ms", "mid_c"), ("sym",), "at", "bar_ms", "mid_c")
        found = found.groupBy("sym", "london_date").agg(*[F.max(F.when(F.col("name") == c, F.col("mid_c"))).alias(c) for c in names])
        t = t.drop(*names).join(found, ["sym", "london_date"], "left")
    t = t.withColumn("asia_range", F.col("asia_hi") - F.col("asia_lo")).withColumn("ldn_range", F.col("ldn_hi") - F.col("ldn_lo"))
    if bounded:
        outside = (F.col("first_ms") > utc_minute(p.asia_minutes[0])) | (F.col("end_ms") < utc_minute(p.london_minutes[1]))
        reason = F.when(F.lit(out_of_slice) & outside, "out-of-slice").when((F.col("asia_n") < floors[0]) | (F.col("ldn_n") < floors[1]), "window-coverage")
    else:
        reason = F.when(F.col("n_bars") < 10, "no-data").when((F.col("asia_n") == 0) | (F.col("ldn_n") == 0), "missing-window-data")
    reason = reason.when(F.col("asia_range") <= 0, "zero-asia-range").otherwise("")
    t = t.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")
    ok = lambda c: F.when(F.col("valid"), c)
    columns = ["sym", "london_date", "dst_summer", "valid", "reason"]
    for h in p.horizons:
        columns.append((F.col("valid") & F.col("p0").isNotNull() & F.col(f"p{h}").isNotNull()).alias(f"valid_for_h{h}m"))
    columns += [ok(F.col(c)).alias(c) for c in ("asia_hi", "asia_lo", "asia_range", "ldn_hi", "ldn_lo", "ldn_range")]
    columns.append(ok(F.try_divide("ldn_range", "asia_range")).alias("expansion_ratio"))
    for h in p.horizons:
        r = ok(F.try_divide(F.col(f"p{h}"), F.col("p0")) - 1)
        columns += [r.alias(f"r_{h}m"), F.abs(r).alias(f"absr_{h}m")]
    return t.select(*columns)


def coverage(bars: DataFrame, least: int = 10, p: Frozen = FROZEN) -> DataFrame:
    """sym, window: weekdays in the sym's span, and how many of them have fewer than ``least`` bars in the window."""
    t = session_table(bars, p, 0, 0)
    wall = local("bar_ms", p.session_zone)
    b = bars.select("sym", F.to_date(wall).alias("london_date"), (F.hour(wall) * 60 + F.minute(wall)).alias("m"))
    name = F.when(F.col("m").between(p.asia_minutes[0], p.asia_minutes[1] - 1), "asia").when(F.col("m").between(p.london_minutes[0], p.london_minutes[1] - 1), "london")
    counts = b.withColumn("window", name).where("window IS NOT NULL").groupBy("sym", "london_date", "window").agg(F.count("*").alias("n"))
    every = t.select("sym", "london_date", F.explode(F.array(F.lit("asia"), F.lit("london"))).alias("window"))
    return every.join(counts, ["sym", "london_date", "window"], "left").groupBy("sym", "window").agg(F.count("*").alias("windows"), F.count(F.when(F.coalesce("n", F.lit(0)) < least, 1)).alias("missing"))
