"""Rules on daily and five-minute bars: signals, levels, races, matches and performance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import local
from tickloom.operators.stats import flags


def _by_day():
    """Windows run over one row per sym and day."""
    return Window.partitionBy("sym").orderBy("day")


def momentum(daily: DataFrame, days: int, skip: int = 0) -> DataFrame:
    """sign of close / close ``days`` earlier - 1, both ``skip`` days back; NULL until there are so many days."""
    now = F.lag("close", skip).over(_by_day()) if skip else F.col("close")
    return daily.select("sym", "day", F.signum(now / F.lag("close", days + skip).over(_by_day()) - 1).alias("signal"))


def blended_momentum(daily: DataFrame, spans: tuple[int, ...] = (21, 63, 252)) -> DataFrame:
    signs = [F.signum(F.col("close") / F.lag("close", n).over(_by_day()) - 1) for n in spans]
    return daily.select("sym", "day", (sum(signs[1:], signs[0]) / len(spans)).alias("signal"))


def moving_average_cross(daily: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """1 if the fast mean is above the slow one, else -1; NULL until the slow one is full."""
    mean = lambda n: F.avg("close").over(_by_day().rowsBetween(-(n - 1), 0))
    full = F.count("close").over(_by_day().rowsBetween(-(slow - 1), 0)) == slow
    return daily.select("sym", "day", F.when(full, F.when(mean(fast) > mean(slow), 1).otherwise(-1)).alias("signal"))


def donchian_levels(daily: DataFrame, entry: int = 55, leave: int = 20) -> DataFrame:
    before = lambda n: _by_day().rowsBetween(-n, -1)
    full = F.count("close").over(before(entry)) == entry
    cols = [F.when(full, x).alias(n) for n, x in (("entry_hi", F.max("close").over(before(entry))), ("entry_lo", F.min("close").over(before(entry))), ("exit_lo", F.min("close").over(before(leave))), ("exit_hi", F.max("close").over(before(leave))))]
    return daily.select("sym", "day", "close", *cols)


def donchian_positions(daily: DataFrame, entry: int = 55, leave: int = 20, stop_n: float = 2.0) -> DataFrame:
    """Position after each day: entries at 55-day extremes, exits at 20-day ones or at a stop of two average ranges.

    A position depends on the one before, so this walks each sym's days in order: one task per sym, one row per day.
    """

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day")
        c = g.close.to_numpy(float)
        out = np.zeros(len(c), dtype=np.int32)
        at, paid, atr = 0, 0.0, np.nan
        for i in range(len(c)):
            if i:
                move = abs(c[i] - c[i - 1])
                atr = move if np.isnan(atr) else (atr * 19 + move) / 20
            if i >= entry:
                if at > 0 and (c[i] < c[i - leave : i].min() or c[i] < paid - stop_n * atr):
                    at = 0
                elif at < 0 and (c[i] > c[i - leave : i].max() or c[i] > paid + stop_n * atr):
                    at = 0
                if at == 0 and c[i] > c[i - entry : i].max():
                    at, paid = 1, c[i]
                elif at == 0 and c[i] < c[i - entry : i].min():
                    at, paid = -1, c[i]
            out[i] = at
        return pd.DataFrame({"sym": g.sym, "day": g.day, "position": out})

    return daily.where("close IS NOT NULL").groupBy("sym").applyInPandas(walk, "sym string, day date, position int")


def ewma_volatility(daily: DataFrame, decay: float = 60 / 61, year: int = 261) -> DataFrame:
    """Yearly volatility from exponentially weighted squared returns, as a ratio of two running sums with growing weights.

    The weights are taken relative to blocks of 4,096 days, far inside what a double can hold.
    """
    r = F.col("close") / F.lag("close").over(_by_day()) - 1
    t = daily.withColumn("r", r).withColumn("i", F.row_number().over(_by_day())).where("r IS NOT NULL")
    g = F.pow(F.lit(1 / decay), F.pmod(F.col("i"), F.lit(4096)))
    block = F.floor(F.col("i") / 4096)
    t = t.withColumn("b", block).withColumn("g", g)
    w = Window.partitionBy("sym", "b").orderBy("i")
    return t.select("sym", "day", F.sqrt(F.sum(F.col("g") * F.col("r") * F.col("r")).over(w) / F.sum("g").over(w) * year).alias("sigma"))


def yearly_momentum(daily: DataFrame, target: float = 0.40) -> DataFrame:
    """On each month's last day: sign of the 252-day return, sized by target volatility."""
    s = momentum(daily, 252).join(ewma_volatility(daily), ["sym", "day"])
    last = F.row_number().over(Window.partitionBy("sym", F.trunc("day", "MM")).orderBy(F.desc("day")))
    return s.withColumn("n", last).where("n = 1 AND signal IS NOT NULL").select("sym", "day", "signal", "sigma", F.try_divide(F.col("signal") * target, F.col("sigma")).alias("size"))


def ny_daily(quotes: DataFrame, zone: str = "America/New_York", close_hour: int = 17) -> DataFrame:
    """Daily bid bars that end at 17:00 New York: sym, day, open, high, low, close."""
    at = F.struct("utc_ms", "seq", "tick_id")
    day = F.to_date(local("utc_ms", zone) + F.make_dt_interval(hours=F.lit(24 - close_hour)))
    return quotes.groupBy("sym", day.alias("day")).agg(F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"))


def bar_labels(days: DataFrame) -> DataFrame:
    """1 inside the bar before, 2u or 2d beyond it on one side, 3 on both."""
    h, lo = F.lag("high").over(_by_day()), F.lag("low").over(_by_day())
    up, down = F.col("high") > h, F.col("low") < lo
    return days.select("sym", "day", F.when(up & down, "3").when(up, "2u").when(down, "2d").when(h.isNotNull(), "1").alias("label"))


def turtle_soup(days: DataFrame, span: int = 20, apart: int = 4) -> DataFrame:
    """Days with a new low of ``span`` days whose previous low of that span lies at least ``apart`` days back."""
    before = _by_day().rowsBetween(-span, -1)
    i = F.row_number().over(_by_day())
    t = days.withColumn("i", i)
    t = t.withColumn("low_before", F.min("low").over(before)).withColumn("at", F.max_by("i", F.struct(-F.col("low"), "i")).over(before)).withColumn("n", F.count("*").over(before))
    return t.where((F.col("n") == span) & (F.col("low") < F.col("low_before")) & (F.col("i") - F.col("at") >= apart)).select("sym", "day", "low", "low_before")


def swings(days: DataFrame, side: int = 2) -> DataFrame:
    """Highs above, and lows below, those of ``side`` days before and after."""
    around = lambda c, f: F.greatest(f(c).over(_by_day().rowsBetween(-side, -1)), f(c).over(_by_day().rowsBetween(1, side)))
    least = F.least(F.min("low").over(_by_day().rowsBetween(-side, -1)), F.min("low").over(_by_day().rowsBetween(1, side)))
    full = F.count("*").over(_by_day().rowsBetween(-side, side)) == 2 * side + 1
    kind = F.when(F.col("high") > around("high", F.max), "high").when(F.col("low") < least, "low")
    return days.select("sym", "day", F.when(full, kind).alias("swing")).where("swing IS NOT NULL")


def gaps_between_bars(bars: DataFrame) -> DataFrame:
    """Fair-value gaps within a day: a low above the high two bars earlier, or a high below that low. Bars have bar_ms, bid_h, bid_l."""
    w = Window.partitionBy("sym", F.floor(F.col("bar_ms") / 86_400_000)).orderBy("bar_ms")
    h, lo = F.lag("bid_h", 2).over(w), F.lag("bid_l", 2).over(w)
    side = F.when(F.col("bid_l") > h, "up").when(F.col("bid_h") < lo, "down")
    mid = F.when(F.col("bid_l") > h, (F.col("bid_l") + h) / 2).otherwise((F.col("bid_h") + lo) / 2)
    return bars.select("sym", "bar_ms", side.alias("side"), mid.alias("entry")).where("side IS NOT NULL")


def sweeps(bars: DataFrame, sessions: DataFrame, depth: float = 0.05, within: int = 3, zone: str = "Europe/London", side: str = "low") -> DataFrame:
    """First sweep of the Asia low (or, with ``side`` high, of the Asia high) per session: a London bar trades ``depth`` ranges beyond it and one of
    the next bars closes back inside.

    ``sessions``: sym, london_date, asia_lo (or asia_hi), asia_range. The decision is at the confirming bar, which is what is returned.
    """
    wall = local("bar_ms", zone)
    level, extreme = ("asia_lo", "bid_l") if side == "low" else ("asia_hi", "bid_h")
    sign = 1 if side == "low" else -1
    b = bars.select("sym", "bar_ms", extreme, "bid_c", F.to_date(wall).alias("london_date"), (F.hour(wall) * 60 + F.minute(wall)).alias("m")).where("m >= 420 AND m < 601")
    b = b.join(sessions.where("asia_range > 0"), ["sym", "london_date"])
    w = Window.partitionBy("sym", "london_date").orderBy("bar_ms")
    back = F.min(F.when(sign * F.col("bid_c") > sign * F.col(level), F.col("bar_ms"))).over(w.rowsBetween(1, within))
    hit = b.withColumn("confirmed_ms", back).where((sign * F.col(extreme) <= sign * (F.col(level) - sign * depth * F.col("asia_range"))) & F.col("confirmed_ms").isNotNull())
    return hit.groupBy("sym", "london_date").agg(F.min("bar_ms").alias("sweep_ms"), F.min_by("confirmed_ms", "bar_ms").alias("confirmed_ms"))


def direction_tests(bars: DataFrame, sessions: DataFrame, zone: str = "Europe/London") -> DataFrame:
    """Per session: where in the Asia range the last Asia bar closed (0 at the low, 1 at the high), which side of it a London bar left first (``up``,
    ``down``, ``both`` in one bar, NULL for neither), and where in the previous session's London range the first Asia bar closed.

    ``bars``: sym, bar_ms, bid_h, bid_l, bid_c. ``sessions``: sym, london_date, asia_hi, asia_lo, asia_range, ldn_hi, ldn_lo. Bars and session share a date.
    """
    wall = local("bar_ms", zone)
    b = bars.select("sym", "bar_ms", "bid_h", "bid_l", "bid_c", F.to_date(wall).alias("london_date"), (F.hour(wall) * 60 + F.minute(wall)).alias("m")).where("m < 601")
    before = Window.partitionBy("sym").orderBy("london_date")
    s = sessions.where("asia_range > 0").withColumns({"_hi": F.lag("ldn_hi").over(before), "_lo": F.lag("ldn_lo").over(before)})
    t = b.join(s, ["sym", "london_date"])
    asia, london = F.col("m") < 420, F.col("m") >= 420
    up = F.min(F.when(london & (F.col("bid_h") > F.col("asia_hi")), F.col("bar_ms")))
    down = F.min(F.when(london & (F.col("bid_l") < F.col("asia_lo")), F.col("bar_ms")))
    t = t.groupBy("sym", "london_date", "asia_lo", "asia_range", "_hi", "_lo").agg(F.max_by("bid_c", F.when(asia, F.col("bar_ms"))).alias("close"), F.min_by("bid_c", F.when(asia, F.col("bar_ms"))).alias("open"), up.alias("up"), down.alias("down"))
    side = F.when(F.col("up") == F.col("down"), "both").when(F.col("up") < F.coalesce("down", F.lit(2**62)), "up").when(F.col("down").isNotNull(), "down")
    return t.select("sym", "london_date", F.try_divide(F.col("close") - F.col("asia_lo"), F.col("asia_range")).alias("close_location"), side.alias("first_break"), F.try_divide(F.col("open") - F.col("_lo"), F.col("_hi") - F.col("_lo")).alias("prior_location"))


def barrier_race(starts: DataFrame, bars: DataFrame, width: Column, horizon_ms: int = 3_600_000, least_bars: int = 10) -> DataFrame:
    """Which of start price ± width is met first within the horizon: up, down, both in one bar, neither, or unknown for want of bars.

    ``starts``: sym, at_ms, p0. Starts and bars meet on (sym, time bucket of one horizon), so every candidate is found in two buckets.
    """
    s = starts.withColumn("w", width).withColumn("b", F.explode(F.array(F.floor(F.col("at_ms") / horizon_ms), F.floor(F.col("at_ms") / horizon_ms) + 1)))
    near = s.join(bars.select("sym", "bar_ms", "bid_h", "bid_l", F.floor(F.col("bar_ms") / horizon_ms).alias("b")), ["sym", "b"], "left")
    inside = (F.col("bar_ms") >= F.col("at_ms")) & (F.col("bar_ms") < F.col("at_ms") + horizon_ms)
    up = F.min(F.when(inside & (F.col("bid_h") >= F.col("p0") + F.col("w")), F.col("bar_ms")))
    down = F.min(F.when(inside & (F.col("bid_l") <= F.col("p0") - F.col("w")), F.col("bar_ms")))
    t = near.groupBy("sym", "at_ms").agg(F.first("p0").alias("p0"), up.alias("up"), down.alias("down"), F.count(F.when(inside, 1)).alias("n"))
    who = F.when(F.col("p0").isNull(), "unknown").when(F.col("up") == F.col("down"), "both").when(F.col("up") < F.coalesce("down", F.lit(2**62)), "up").when(F.col("down").isNotNull(), "down")
    return t.select("sym", "at_ms", who.when(F.col("n") < least_bars, "unknown").otherwise("neither").alias("outcome"))


FIX = ((-120, -60), (-60, -30), (-30, 0), (0, 30), (30, 60))


def fix_windows(bars: DataFrame, hour: int = 16, zone: str = "Europe/London") -> DataFrame:
    """Move of the mid in each window around the fix, in basis points: sym, day, window (its first minute)."""
    wall = local("bar_ms", zone)
    off = F.hour(wall) * 60 + F.minute(wall) - hour * 60
    name = None
    for a, z in FIX:
        hit = (off >= a) & (off < z)
        name = F.when(hit, a) if name is None else name.when(hit, a)
    t = bars.select("sym", F.to_date(wall).alias("day"), name.alias("window"), "bar_ms", "mid_c").where("window IS NOT NULL")
    t = t.groupBy("sym", "day", "window").agg(F.min_by("mid_c", "bar_ms").alias("a"), F.max_by("mid_c", "bar_ms").alias("z"))
    return t.select("sym", "day", "window", ((F.col("z") / F.col("a") - 1) * 1e4).alias("move_bp"))


def performance(daily: DataFrame, year: int = 261) -> DataFrame:
    """Per sym: days, mean and deviation of returns, Sharpe ratio, hit rate and greatest drawdown of the close."""
    r = F.col("close") / F.lag("close").over(_by_day()) - 1
    top = F.max("close").over(_by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = daily.withColumn("r", r).withColumn("fall", 1 - F.col("close") / top)
    return t.groupBy("sym").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), (F.avg("r") / F.stddev_samp("r") * float(np.sqrt(year))).alias("sharpe"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.max("fall").alias("max_drawdown"),
    )


def rolling_health(daily: DataFrame, spans: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    t = daily.withColumn("r", F.col("close") / F.lag("close").over(_by_day()) - 1)
    return t.select("sym", "day", *[F.when(F.count("r").over(_by_day().rowsBetween(-(n - 1), 0)) == n, F.avg("r").over(_by_day().rowsBetween(-(n - 1), 0))).alias(f"mean_{n}") for n in spans])


def currency_exposure(signals: DataFrame) -> DataFrame:
    """day, currency, net: each pair's signal counts for its first currency and against its second. ``sym`` ends with the pair."""
    pair = F.substring_index("sym", ":", -1)
    legs = F.array(F.struct(F.substring(pair, 1, 3).alias("currency"), F.col("signal").alias("v")), F.struct(F.substring(pair, 4, 3).alias("currency"), (-F.col("signal")).alias("v")))
    return signals.select("day", F.explode(legs).alias("l")).groupBy("day", F.col("l.currency").alias("currency")).agg(F.sum("l.v").alias("net"))


def chronological_split(panel: DataFrame, shares: tuple[float, float] = (0.60, 0.20)) -> DataFrame:
    """Dates in order: the first 60% train, the next 20% validate, the rest test. Only the dates are ranked."""
    days = panel.select("day").distinct()
    place = F.row_number().over(Window.orderBy("day")) / F.count("*").over(Window.partitionBy())
    part = F.when(place <= shares[0], "train").when(place <= shares[0] + shares[1], "validate").otherwise("test")
    return panel.join(days.withColumn("part", part), "day")


def walk_forward(flagged: DataFrame, value: str, least: int = 1) -> DataFrame:
    """Per calendar year the mean difference in it and in all years before it: an expanding training span, from sums per year. Years with
    fewer than ``least`` years before them are left out."""
    yes, no = F.when(F.col("compressed"), F.col(value)), F.when(~F.col("compressed"), F.col(value))
    years = flagged.groupBy(F.year("day").alias("year")).agg(*[f(c).alias(f"{n}{k}") for n, c in (("a", yes), ("b", no)) for k, f in (("s", F.sum), ("n", F.count))])
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
    mean = lambda n, x: F.try_divide(x(f"{n}s"), x(f"{n}n"))
    past = lambda c: F.sum(c).over(w)
    t = years.withColumn("train_years", F.count("*").over(w)).withColumn("train", mean("a", past) - mean("b", past)).withColumn("test", mean("a", F.col) - mean("b", F.col))
    return t.where(F.col("train_years") >= least).select("year", "train_years", "train", "test")


def concentration(daily: DataFrame, share: float = 0.05) -> DataFrame:
    """Per sym: the share of all gains that its best days give, the best ``share`` of the days with a return."""
    t = daily.withColumn("r", F.col("close") / F.lag("close").over(_by_day()) - 1).where("r IS NOT NULL")
    w = Window.partitionBy("sym")
    t = t.withColumn("place", F.row_number().over(w.orderBy(F.desc("r"), "day"))).withColumn("n", F.count("*").over(w))
    gain = F.when(F.col("r") > 0, F.col("r"))
    return t.groupBy("sym").agg(F.max("n").alias("days"), F.try_divide(F.sum(F.when(F.col("place") <= F.ceil(F.col("n") * share), gain)), F.sum(gain)).alias("best_share"))


def true_ranges(days: DataFrame, span: int = 14) -> DataFrame:
    """sym, day, true range and its mean over ``span`` days (NULL until there are so many). ``days``: high, low, close."""
    was = F.lag("close").over(_by_day())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was))
    t = days.withColumn("true_range", tr)
    w = _by_day().rowsBetween(-(span - 1), 0)
    return t.select("sym", "day", "true_range", F.when(F.count("true_range").over(w) == span, F.avg("true_range").over(w)).alias("atr"))


def median_ratio(panel: DataFrame, value: str, span: int = 20) -> DataFrame:
    """sym, day and the value over the median of the ``span`` values before it; NULL until there are so many."""
    w = _by_day().rowsBetween(-span, -1)
    return panel.select("sym", "day", F.when(F.count(value).over(w) == span, F.try_divide(F.col(value), F.percentile(value, F.lit(0.5)).over(w))).alias("ratio"))


def value_weights(daily: DataFrame, near: int = 54, far: int = 66) -> DataFrame:
    """At each month's end: ln(mean close of ``near`` to ``far`` months ago / close) and rank weights over the syms, longs and shorts adding up to 1 each.

    The spot half of the value rule; no price indices are known here. Months are counted by the calendar; a sym needs every month of the span.
    """
    month = F.year("day") * 12 + F.month("day")
    ends = daily.where("close IS NOT NULL").groupBy("sym", month.alias("month")).agg(F.max("day").alias("day"), F.max_by("close", "day").alias("close"))
    w = Window.partitionBy("sym").orderBy("month").rangeBetween(-far, -near)
    full = F.count("*").over(w) == far - near + 1
    t = ends.withColumn("value", F.when(full, F.ln(F.avg("close").over(w) / F.col("close")))).where("value IS NOT NULL")
    every = Window.partitionBy("month")
    t = t.withColumn("rank", F.rank().over(every.orderBy("value")).cast("double"))
    t = t.withColumn("off", F.col("rank") - F.avg("rank").over(every))
    return t.select("sym", "day", "value", F.try_divide(F.col("off") * 2, F.sum(F.abs("off")).over(every)).alias("weight"))


def weekly_sweeps(days: DataFrame) -> DataFrame:
    """Weeks that trade below the week before and close above its low: sym, week, low, low_before, high_before."""
    at = F.struct("day")
    weeks = days.groupBy("sym", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"))
    w = Window.partitionBy("sym").orderBy("week")
    t = weeks.withColumns({"low_before": F.lag("low").over(w), "high_before": F.lag("high").over(w)})
    return t.where("low < low_before AND close > low_before").select("sym", "week", "low", "low_before", "high_before")


def spread_distribution(quotes: DataFrame, zone: str = "Europe/London") -> DataFrame:
    """Per pair and session (asia, london, other by local time): quotes and quantiles of the spread. ``sym`` is feed:pair."""
    wall = local("utc_ms", zone)
    m = F.hour(wall) * 60 + F.minute(wall)
    t = quotes.select(F.substring_index("sym", ":", -1).alias("pair"), F.when(m < 420, "asia").when(m < 601, "london").otherwise("other").alias("session"), F.round(F.col("ask") - F.col("bid"), 9).alias("s"))
    # Spreads are few different values: counted first, so a hot pair shrinks before it meets.
    t = t.groupBy("pair", "session", "s").agg(F.count("*").alias("c"))
    q = [F.percentile("s", F.lit(x), F.col("c")).alias(n) for n, x in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))]
    return t.groupBy("pair", "session").agg(F.sum("c").alias("n"), *q)


def purged(panel: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """Rows outside a test span by more than a horizon of ``days`` on both sides."""
    return panel.where((F.col("day") < F.date_sub(F.to_date(F.lit(first)), days)) | (F.col("day") > F.date_add(F.to_date(F.lit(last)), days)))


def terciles(panel: DataFrame, value: str) -> DataFrame:
    """1 to 3 by the previous day's value within each sym."""
    before = F.lag(value).over(_by_day())
    t = panel.withColumn("before", before).where("before IS NOT NULL")
    return t.select("sym", "day", F.ntile(3).over(Window.partitionBy("sym").orderBy("before", "day")).alias("tercile"))


def lookback_plateau(panel: DataFrame, value: str, lookbacks: tuple[int, ...]) -> DataFrame:
    """For each lookback of the rolling percentile: flagged rows, and the difference of medians. The lookbacks are a handful of parameters."""
    out = []
    for n in lookbacks:
        f = flags(panel, n).where("comp_pct IS NOT NULL")
        yes = F.col("compressed")
        difference = F.percentile(F.when(yes, F.col(value)), F.lit(0.5)) - F.percentile(F.when(~yes, F.col(value)), F.lit(0.5))
        out.append(f.agg(F.lit(n).alias("lookback"), F.count_if(yes).alias("n_compressed"), difference.alias("difference")))
    return reduce(DataFrame.unionByName, out)


def plateau(flagged: DataFrame, value: str, thresholds: tuple[float, ...]) -> DataFrame:
    """For each threshold: compressed rows, and the difference of medians. The thresholds are a handful of parameters."""
    t = flagged.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    low = F.col("comp_pct") <= F.col("threshold")
    return t.groupBy("threshold").agg(F.count_if(low).alias("n_compressed"), (F.percentile(F.when(low, F.col(value)), F.lit(0.5)) - F.percentile(F.when(~low, F.col(value)), F.lit(0.5))).alias("difference"))


def leave_one_out(flagged: DataFrame, value: str) -> DataFrame:
    """The pooled mean difference without each sym in turn, from per-sym sums: nothing is joined to everything."""
    s = lambda flag: [F.sum(F.when(flag, F.col(value))), F.count(F.when(flag, F.col(value)))]
    sums = flagged.groupBy("sym").agg(*[x.alias(n) for x, n in zip([*s(F.col("compressed")), *s(~F.col("compressed"))], ("sa", "na", "sb", "nb"))])
    every = Window.partitionBy()
    rest = {c: F.coalesce(F.sum(c).over(every), F.lit(0)) - F.coalesce(F.col(c), F.lit(0)) for c in ("sa", "na", "sb", "nb")}
    return sums.select("sym", (F.try_divide(rest["sa"], rest["na"]) - F.try_divide(rest["sb"], rest["nb"])).alias("difference"))


def feed_replication(bars: DataFrame) -> DataFrame:
    """Per pair, bars that several feeds have, and how far their closing mids lie apart. ``sym`` is feed:pair."""
    t = bars.withColumn("pair", F.substring_index("sym", ":", -1)).groupBy("pair", "bar_ms").agg(F.count("*").alias("feeds"), (F.max("mid_c") - F.min("mid_c")).alias("apart"))
    return t.groupBy("pair").agg(F.count("*").alias("bars"), F.count_if(F.col("feeds") > 1).alias("shared"), F.percentile(F.when(F.col("feeds") > 1, F.col("apart")), F.lit(0.5)).alias("median_apart"))


def parity(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str, atol: float = 0.0) -> DataFrame:
    """Per first key: rows in both, only in one, and differing, of two implementations of one signal."""
    x, y = (t.select(*keys, F.col(value).alias(n)) for t, n in ((a, "va"), (b, "vb")))
    both = x.withColumn("ina", F.lit(1)).join(y.withColumn("inb", F.lit(1)), list(keys), "full")
    return both.groupBy(keys[0]).agg(F.count_if((F.col("ina") == 1) & (F.col("inb") == 1)).alias("both"), F.count_if(F.col("inb").isNull()).alias("only_a"), F.count_if(F.col("ina").isNull()).alias("only_b"), F.count_if(F.abs(F.col("va") - F.col("vb")) > atol).alias("differ"))


def greedy_matches(cases: DataFrame, controls: DataFrame, keys: tuple[str, ...], at: str, most: int) -> DataFrame:
    """Pair each case with the nearest unused control of its keys, at most ``most`` away; ties go to the earlier control.

    ``cases`` and ``controls``: keys, id, ``at``. Without reuse the pairing is sequential, so it runs per group of keys (a date and
    direction, say), whose candidates the keys bound.
    """
    both = cases.select(*keys, "id", at, F.lit(0).alias("side")).unionByName(controls.select(*keys, "id", at, F.lit(1).alias("side")))

    def match(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g.side == 0].sort_values([at, "id"]), g[g.side == 1].sort_values([at, "id"])
        free, out = np.ones(len(b), dtype=bool), []
        times, ids = b[at].to_numpy(), b.id.to_numpy()
        for i, t in zip(a.id, a[at]):
            lo, hi = np.searchsorted(times, t - most), np.searchsorted(times, t + most, side="right")
            near = [j for j in range(lo, hi) if free[j]]
            if near:
                j = min(near, key=lambda j: (abs(times[j] - t), times[j]))
                free[j] = False
                out.append((i, ids[j], abs(times[j] - t)))
        return pd.DataFrame(out, columns=["case_id", "control_id", "apart"]).astype("int64")

    return both.groupBy(*keys).applyInPandas(match, "case_id bigint, control_id bigint, apart bigint")
