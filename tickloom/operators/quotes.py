"""Bars, quality counters and cleaning of quotes. Quotes have sym, utc_ms, seq, tick_id, bid and ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import is_close
from tickloom.operators.ordered import day_of, running_groups, with_previous

ORDER = ("utc_ms", "seq", "tick_id")


def mid() -> Column:
    return (F.col("bid") + F.col("ask")) / 2


def spread() -> Column:
    return F.col("ask") - F.col("bid")


def clean(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): quotes with positive prices and no crossed spread, and the log of what was taken out, by reason."""
    reason = F.when(F.col("bid") <= 0, "bid").when(F.col("ask") <= 0, "ask").when(F.col("ask") < F.col("bid"), "crossed")
    marked = quotes.withColumn("_reason", reason)
    return marked.where("_reason IS NULL").drop("_reason"), marked.where("_reason IS NOT NULL").groupBy("sym", F.col("_reason").alias("reason")).agg(F.count("*").alias("removed"))


def bars(quotes: DataFrame, minutes: int, strict: bool = True) -> DataFrame:
    """Epoch-aligned bars: bid and mid open, high, low, close, closing ask, least, median and greatest spread, ticks.

    Open and close follow (utc_ms, seq, tick_id), never row order. With ``strict`` a crossed quote raises. Bars without a
    quote don't exist; an empty input gives no bars. The exact median buffers one bar's spreads, nothing more.
    """
    step = minutes * 60_000
    at = F.struct(*ORDER)
    if strict:
        quotes = quotes.withColumn("ask", F.when(F.col("ask") >= F.col("bid"), F.col("ask")).otherwise(F.raise_error(F.lit("negative spread"))))
    m, s = mid(), spread()
    return quotes.groupBy("sym", (F.floor(F.col("utc_ms") / step) * step).alias("bar_ms")).agg(
        F.min_by("bid", at).alias("bid_o"), F.max("bid").alias("bid_h"), F.min("bid").alias("bid_l"), F.max_by("bid", at).alias("bid_c"),
        F.max_by("ask", at).alias("ask_c"),
        F.min_by(m, at).alias("mid_o"), F.max(m).alias("mid_h"), F.min(m).alias("mid_l"), F.max_by(m, at).alias("mid_c"),
        F.min(s).alias("spread_min"), F.percentile(s, F.lit(0.5)).alias("spread_med"), F.max(s).alias("spread_max"),
        F.count("*").alias("n_ticks"),
    )


def closes(quotes: DataFrame, minutes: int = 1) -> DataFrame:
    """What sessions need of bars, without the spread's median: bid high and low, closing mid, and the times of the bar's first and last quote."""
    step = minutes * 60_000
    at = F.struct(*ORDER)
    return quotes.groupBy("sym", (F.floor(F.col("utc_ms") / step) * step).alias("bar_ms")).agg(F.max("bid").alias("bid_h"), F.min("bid").alias("bid_l"), F.max_by(mid(), at).alias("mid_c"), F.count("*").alias("n_ticks"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms"))


def dedup_consecutive(quotes: DataFrame) -> DataFrame:
    """Drop quotes equal to the one immediately before in time and both prices; A, B, A stays. NULL prices equal nothing."""
    seen = with_previous(quotes, ("sym",), ORDER, ("utc_ms", "bid", "ask"), day_of("utc_ms"))
    same = (F.col("prev_utc_ms") == F.col("utc_ms")) & (F.col("prev_bid") == F.col("bid")) & (F.col("prev_ask") == F.col("ask"))
    return seen.where(~F.coalesce(same, F.lit(False))).select(*quotes.columns)


def _one_per(quotes: DataFrame, keys: tuple[str, ...], pick) -> DataFrame:
    """One row per key, chosen by (seq, tick_id): an aggregation, so that groups of copies shrink before they are shuffled."""
    rest = [c for c in quotes.columns if c not in keys]
    chosen = quotes.groupBy(*keys).agg(pick(F.struct(*rest), F.struct("seq", "tick_id")).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in quotes.columns])


def dedup_global(quotes: DataFrame) -> DataFrame:
    """Keep the first of equal (time, bid, ask) per sym, whatever lies between."""
    return _one_per(quotes, ("sym", "utc_ms", "bid", "ask"), F.min_by)


def last_per_time(quotes: DataFrame) -> DataFrame:
    """Keep the last quote of each millisecond."""
    return _one_per(quotes, ("sym", "utc_ms"), F.max_by)


def gaps(quotes: DataFrame, over_minutes: float = 60.0) -> DataFrame:
    """Steps between consecutive quotes of more than so many minutes; a step of exactly that isn't one."""
    seen = with_previous(quotes, ("sym",), ORDER, ("utc_ms",), day_of("utc_ms"))
    return seen.where(F.col("utc_ms") - F.col("prev_utc_ms") > over_minutes * 60_000).select("sym", F.col("prev_utc_ms").alias("from_ms"), F.col("utc_ms").alias("to_ms"))


def longest_gaps(quotes: DataFrame) -> DataFrame:
    """Per sym and month, the longest step between two quotes of that month, in whole minutes."""
    month = F.date_format(F.timestamp_millis("utc_ms"), "yyyyMM").cast("int")
    seen = with_previous(quotes.withColumn("yyyymm", month), ("sym", "yyyymm"), ORDER, ("utc_ms",), day_of("utc_ms"))
    return seen.groupBy("sym", "yyyymm").agg(F.max(F.floor((F.col("utc_ms") - F.col("prev_utc_ms")) / 60_000)).alias("longest_min"))


def jumps(quotes: DataFrame, over: float = 0.02, zero_is_jump: bool = False) -> DataFrame:
    """Quotes whose mid moved by more than ``over`` in logarithm since the one before. A mid that isn't positive has no
    logarithm: it and the quote after it are no jumps, or with ``zero_is_jump`` both are."""
    seen = with_previous(quotes.withColumn("mid", mid()), ("sym",), ORDER, ("mid",), day_of("utc_ms"))
    move = F.abs(F.ln(F.when((F.col("mid") > 0) & (F.col("prev_mid") > 0), F.col("mid") / F.col("prev_mid"))))
    odd = (F.col("mid") <= 0) | (F.col("prev_mid") <= 0)
    return seen.where((move > over) | (odd if zero_is_jump else F.lit(False))).select("sym", "tick_id", "utc_ms", "prev_mid", "mid")


def blocks(quotes: DataFrame, legacy: bool) -> DataFrame:
    """sym, block, n, start_ms, end_ms: runs of unchanged (bid, ask).

    ``legacy`` numbers blocks by unchanged rows instead of changed ones, as the first tool did: a constant feed then has
    blocks of one and a moving one a single long block.
    """
    seen = with_previous(quotes, ("sym",), ORDER, ("bid", "ask"), day_of("utc_ms"))
    same = F.coalesce((F.col("bid") == F.col("prev_bid")) & (F.col("ask") == F.col("prev_ask")), F.lit(False))
    numbered = running_groups(seen, ("sym",), ORDER, same if legacy else ~same, day_of("utc_ms"), "block")
    return numbered.groupBy("sym", "block").agg(F.count("*").alias("n"), F.min("utc_ms").alias("start_ms"), F.max("utc_ms").alias("end_ms"))


def daily_counts(quotes: DataFrame, stale: int = 300) -> DataFrame:
    """One row per sym and UTC day with what the gates count, from one pass over the quotes: rows of a day meet in one window each, and
    what goes on over days (the step into a day, a block that a day doesn't end) is in the day's first and last figures.

    ``first_start`` and ``last_start`` are the first and last row of the day, from 1, that is equal to the row before it in the day;
    ``stale_in`` counts the legacy blocks between two such rows with at least ``stale`` rows.
    """
    w = Window.partitionBy("sym", "_day").orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kept = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    seen = quotes.select("sym", *ORDER, "bid", "ask", day_of("utc_ms").alias("_day")).withColumns({"_pb": F.lag("bid").over(w), "_pa": F.lag("ask").over(w), "_n": F.row_number().over(w)})
    start = F.when((F.col("bid") == F.col("_pb")) & (F.col("ask") == F.col("_pa")), F.col("_n"))
    seen = seen.withColumn("_start", start).withColumns({"_last_start": F.max("_start").over(before), "_last_kept": F.max(F.when(kept, F.col("utc_ms"))).over(before)})
    at, row = F.struct(*ORDER), F.struct("bid", "ask")
    return seen.groupBy("sym", "_day").agg(
        F.count("*").alias("n"), F.count_if(F.col("ask") < F.col("bid")).alias("n_crossed"), F.count_if((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("n_zero"),
        F.count_if(_jumped(F.col("_pb"), F.col("_pa"), F.col("bid"), F.col("ask"))).alias("jumps_in"), F.count_if(F.col("_start") - F.col("_last_start") >= stale).alias("stale_in"),
        F.min("_start").alias("first_start"), F.max("_start").alias("last_start"), F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"),
        F.min(F.when(kept, F.col("utc_ms"))).alias("first_kept"), F.max(F.when(kept, F.col("utc_ms"))).alias("last_kept"),
        F.max(F.when(kept, F.floor((F.col("utc_ms") - F.col("_last_kept")) / 60_000))).alias("longest_in"),
    )


def _jumped(pb: Column, pa: Column, b: Column, a: Column, over: float = 0.02) -> Column:
    was, now = (pb + pa) / 2, (b + a) / 2
    return F.coalesce(F.abs(F.ln(F.when((now > 0) & (was > 0), now / was))) > over, F.lit(False))


def _gate_counts(quotes: DataFrame, stale: int = 300) -> DataFrame:
    """Per sym the counters of ``integrity``, the longest gap within a month and the months that have quotes, from one row per day."""
    days = daily_counts(quotes, stale)
    w = Window.partitionBy("sym").orderBy("_day")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    month = F.date_format(F.timestamp_millis(F.col("_day") * 86_400_000), "yyyyMM").cast("int")
    days = days.withColumn("_was", F.lag("last").over(w)).withColumn("_base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("_month", month)
    # The day's first row is a start too if it equals the last row of the day before.
    days = days.withColumn("_opens", F.coalesce((F.col("first.bid") == F.col("_was.bid")) & (F.col("first.ask") == F.col("_was.ask")), F.lit(False)))
    days = days.withColumn("_gs", F.col("_base") + F.when(F.col("_opens"), 1).otherwise(F.col("first_start")))
    days = days.withColumn("_gl", F.col("_base") + F.coalesce(F.col("last_start"), F.when(F.col("_opens"), 1)))
    last_start = F.coalesce(F.last("_gl", ignorenulls=True).over(earlier), F.lit(1))  # rows before any start are a block from row 1
    days = days.withColumn("_closed", F.col("_gs") - last_start).withColumn("_kept_before", F.max("last_kept").over(Window.partitionBy("sym", "_month").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    across = yes(F.col("_closed") >= stale) + yes(F.col("_opens") & (F.col("first_start") - 1 >= stale))
    gap = F.greatest("longest_in", F.floor((F.col("first_kept") - F.col("_kept_before")) / 60_000))
    out = days.groupBy("sym").agg(
        F.sum("n").alias("n"), F.sum("n_crossed").alias("n_crossed"), F.sum("n_zero").alias("n_zero"),
        F.sum(F.col("stale_in") + across).alias("stale_blocks"), F.coalesce(F.max("_gl"), F.lit(1)).alias("_open"),
        (F.sum("jumps_in") + F.count_if(_jumped(F.col("_was.bid"), F.col("_was.ask"), F.col("first.bid"), F.col("first.ask")))).alias("n_jumps"),
        F.max(gap).alias("longest_gap_min"), F.collect_set("_month").alias("months"),
    )
    return out.withColumn("stale_blocks", F.col("stale_blocks") + (F.col("n") - F.col("_open") + 1 >= stale).cast("int")).drop("_open")


def integrity(quotes: DataFrame, stale: int = 300) -> DataFrame:
    """Per sym: quotes, crossed and zero quotes, legacy stale blocks and jumps. ``invalid_total`` counts crossed quotes twice, as the report it replaces does."""
    c = _gate_counts(quotes, stale)
    total = F.col("n_crossed") * 2 + F.col("n_zero")
    return c.select("sym", "n", F.col("n_crossed").alias("n_negative_spread"), "n_crossed", "n_zero", "stale_blocks", "n_jumps", total.alias("invalid_total"))


def bar_consistency(quotes: DataFrame, minutes: int = 5, atol: float = 1e-9) -> DataFrame:
    """Per sym, bars held against the extrema of their quotes, the bars being rolled up from one-minute bars. One pass: a bar's minutes are
    conditional aggregates beside the extrema of all its quotes."""
    step = minutes * 60_000
    minute = F.floor(F.col("utc_ms") / 60_000) - F.floor(F.col("utc_ms") / step) * minutes
    in_minute = [(f(F.when(minute == k, F.col("bid"))), f"{n}{k}") for k in range(minutes) for f, n in ((F.max, "h"), (F.min, "l"))]
    bars = quotes.groupBy("sym", F.floor(F.col("utc_ms") / step).alias("bar")).agg(F.max("bid").alias("raw_h"), F.min("bid").alias("raw_l"), *[c.alias(n) for c, n in in_minute])
    high, low = (f(*[F.col(f"{n}{k}") for k in range(minutes)], F.lit(None)) for f, n in ((F.greatest, "h"), (F.least, "l")))
    off = lambda a, b: F.count(F.when(~F.coalesce(is_close(a, F.col(b), atol, 0.0), F.lit(False)), 1))
    return bars.groupBy("sym").agg(F.count("*").alias("bars_checked"), off(high, "raw_h").alias("high_mismatch"), off(low, "raw_l").alias("low_mismatch"))


def shared_bars(bars: DataFrame, quotes: DataFrame, minutes: int) -> DataFrame:
    """Bars that both sides have, an inner join on (sym, bar_ms): the bar's bid extrema and those of its quotes. ``bars`` has sym, bar_ms, bid_h and bid_l."""
    step = minutes * 60_000
    raw = quotes.groupBy("sym", (F.floor(F.col("utc_ms") / step) * step).alias("bar_ms")).agg(F.max("bid").alias("raw_h"), F.min("bid").alias("raw_l"))
    return bars.select("sym", "bar_ms", "bid_h", "bid_l").join(raw, ["sym", "bar_ms"])


def month_of(ms: str = "utc_ms") -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMM").cast("int")


def inventory(quotes: DataFrame) -> DataFrame:
    """Per sym: months stored, first, last, and the months in between that are missing."""
    months = quotes.select("sym", month_of().alias("ym")).distinct().groupBy("sym").agg(F.count("*").alias("n_months"), F.min("ym").alias("first"), F.max("ym").alias("last"), F.collect_set("ym").alias("has"))
    date = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMM")
    every = F.transform(F.sequence(date("first"), date("last"), F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyyMM").cast("int"))
    return months.select("sym", "n_months", "first", "last", F.size(F.array_except(every, "has")).alias("n_missing"))


def missing_months(quotes: DataFrame, first: int, last: int) -> DataFrame:
    """sym, yyyymm expected between two months but without any quote: an anti join with the calendar."""
    if first > last:
        raise ValueError("the span is reversed")
    month = lambda ym: F.to_date(F.lit(str(ym)), "yyyyMM")
    present = quotes.select("sym", month_of().alias("yyyymm")).distinct()
    every = present.select("sym").distinct().withColumn("d", F.explode(F.sequence(month(first), month(last), F.expr("INTERVAL 1 MONTH"))))
    return every.select("sym", F.date_format("d", "yyyyMM").cast("int").alias("yyyymm")).join(present, ["sym", "yyyymm"], "left_anti")


def store_gate(quotes: DataFrame, first: int, last: int) -> DataFrame:
    """One row per sym with all counters and whether its data pass: nothing crossed, no bar mismatch, no month missing, quotes and bars present.

    Two passes over the quotes: one by day for everything that looks at the quote before, one by bar."""
    if first > last:
        raise ValueError("the span is reversed")
    month = lambda ym: F.to_date(F.lit(str(ym)), "yyyyMM")
    expected = F.transform(F.sequence(month(first), month(last), F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyyMM").cast("int"))
    counts = _gate_counts(quotes).select("sym", "n", "n_crossed", "n_zero", "n_jumps", "longest_gap_min", F.size(F.array_except(expected, "months")).cast("bigint").alias("months_missing"))
    gate = counts.join(bar_consistency(quotes.where("bid > 0 AND ask >= bid")), "sym", "left").na.fill(0, ["bars_checked", "high_mismatch", "low_mismatch"])
    gate = gate.select("sym", "n", "n_crossed", "n_zero", "n_jumps", "bars_checked", "high_mismatch", "low_mismatch", "months_missing", "longest_gap_min")
    return gate.withColumn("data_pass", F.expr("n > 0 AND bars_checked > 0 AND n_crossed = 0 AND n_zero = 0 AND high_mismatch = 0 AND low_mismatch = 0 AND months_missing = 0"))


def as_of(lookups: DataFrame, facts: DataFrame, keys: tuple[str, ...], at: str, time: str, value: str, max_age_ms: int | None = None) -> DataFrame:
    """For each lookup the latest non-NULL value at or before its time, at most ``max_age_ms`` old; NULL if there is none.

    With a bound, the facts of the lookup's time bucket and of the one before are joined on equality and reduced by max_by:
    no ordering, and a hot key is spread over its buckets. Without one, both sides are laid on one time line per key and day
    and carried forward, days by their last value.
    """
    known = facts.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"))
    if max_age_ms is not None:
        width = max(max_age_ms, 1)
        near = lookups.select(*keys, at).distinct().withColumn("_b", F.explode(F.array(F.floor(F.col(at) / width), F.floor(F.col(at) / width) - 1)))
        found = near.join(known.withColumn("_b", F.floor(F.col("_t") / width)), [*keys, "_b"]).where(F.col("_t").between(F.col(at) - max_age_ms, F.col(at)))
        found = found.groupBy(*keys, at).agg(F.max_by("_v", "_t").alias(value))
        return lookups.join(found, [*keys, at], "left")
    line = known.select(*keys, "_t", "_v", F.lit(0).alias("_look")).unionByName(lookups.select(*keys, F.col(at).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_look")).distinct())
    line = line.withColumn("_day", F.floor(F.col("_t") / 86_400_000))
    ends = line.groupBy(*keys, "_day").agg(F.max_by(F.when(F.col("_look") == 0, F.col("_v")), F.when(F.col("_look") == 0, F.col("_t"))).alias("_end"))
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_day", "_carry")
    w = Window.partitionBy(*keys, "_day").orderBy("_t", "_look").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = line.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_look = 1").join(ends, [*keys, "_day"], "left")
    filled = filled.select(*keys, F.col("_t").alias(at), F.coalesce("_in", "_carry").alias(value))
    return lookups.join(filled, [*keys, at], "left")
