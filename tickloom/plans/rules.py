"""Queries over rules, streams, sources and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import governance as G
from tickloom.frozen import FROZEN
from tickloom.operators import quotes as Q
from tickloom.operators import sessions as X
from tickloom.operators import strategies as Y
from tickloom.operators.stats import block_length_check, flags
from tickloom.plans.catalogue import THIN, WITH_D, WITH_F, WITH_Q, _sessions_sql, _text
from tickloom.session import scratch_path
from tickloom.sources import exports, synthetic
from tickloom.sources.adapters import EXPORTED_SQL, OHLC_SQL, daily, daily_bars, exported, panel, quotes
from tickloom.streaming import bars as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
W = "OVER (PARTITION BY sym ORDER BY day)"
DAY = "strftime(day, '%Y-%m-%d') AS day"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _frame(n: int, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN {n} PRECEDING AND {end})"


@query(WITH_D + f"SELECT sym, {DAY}, sign(close / lag(close, 63) {W} - 1)::DOUBLE AS signal FROM daily")
def sp_10_trend63(spark, d):
    return Y.momentum(daily(spark, d), 63).withColumn("day", _text("day"))


@query(WITH_D + f"SELECT sym, {DAY}, sign(lag(close, 1) {W} / lag(close, 21) {W} - 1)::DOUBLE AS signal FROM daily")
def sp_05_trend20(spark, d):
    return Y.momentum(daily(spark, d), 20, 1).withColumn("day", _text("day"))


@query(WITH_D + f"SELECT sym, {DAY}, round((sign(close / lag(close, 21) {W} - 1) + sign(close / lag(close, 63) {W} - 1) + sign(close / lag(close, 252) {W} - 1))::DOUBLE / 3, 9) AS signal FROM daily")
def sp_12_blend(spark, d):
    return Y.blended_momentum(daily(spark, d)).withColumns({"day": _text("day"), "signal": F.round("signal", 9)})


@query(WITH_D + f"SELECT sym, {DAY}, coalesce(CASE WHEN count(close) {_frame(199)} = 200 THEN CASE WHEN avg(close) {_frame(49)} > avg(close) {_frame(199)} THEN 1 ELSE -1 END END, 0) AS signal FROM daily")
def sp_11_ma_cross(spark, d):
    return Y.moving_average_cross(daily(spark, d)).na.fill(0, ["signal"]).withColumn("day", _text("day"))


_B55, _B20 = _frame(55, "1 PRECEDING"), _frame(20, "1 PRECEDING")


@query(WITH_D + f"SELECT sym, {DAY}, close, " + ", ".join(f"CASE WHEN count(close) {_B55} = 55 THEN {x} END AS {n}" for n, x in (("entry_hi", f"max(close) {_B55}"), ("entry_lo", f"min(close) {_B55}"), ("exit_lo", f"min(close) {_B20}"), ("exit_hi", f"max(close) {_B20}"))) + " FROM daily")
def sp_11_donchian_levels(spark, d):
    return Y.donchian_levels(daily(spark, d)).withColumn("day", _text("day"))


@query()
def sp_11_donchian_positions(spark, d):
    return Y.donchian_positions(daily(spark, d))


@query(
    WITH_D + f""", r AS (SELECT *, close / lag(close) {W} - 1 AS r, row_number() {W} AS i FROM daily),
g AS (SELECT *, pow(61.0::DOUBLE / 60, i % 4096) AS g, i // 4096 AS b FROM r WHERE r IS NOT NULL),
v AS (SELECT sym, day, sqrt(sum(g * r * r) OVER w / sum(g) OVER w * 261) AS sigma FROM g WINDOW w AS (PARTITION BY sym, b ORDER BY i)),
m AS (SELECT sym, day, sign(close / lag(close, 252) {W} - 1)::DOUBLE AS signal FROM daily),
j AS (SELECT m.sym, m.day, signal, sigma, row_number() OVER (PARTITION BY m.sym, date_trunc('month', m.day) ORDER BY m.day DESC) AS n FROM m JOIN v ON m.sym = v.sym AND m.day = v.day)
SELECT sym, {DAY}, signal, round(sigma, 7) AS sigma, round(signal * 0.4 / sigma, 7) AS size FROM j WHERE n = 1 AND signal IS NOT NULL"""
)
def sp_11_tsmom252(spark, d):
    return Y.yearly_momentum(daily(spark, d)).withColumns({"day": _text("day"), "sigma": F.round("sigma", 7), "size": F.round("size", 7)})


@query(
    WITH_D + f""", r AS (SELECT *, close / lag(close) {W} - 1 AS r, 1 - close / max(close) OVER (PARTITION BY sym ORDER BY day ROWS UNBOUNDED PRECEDING) AS fall FROM daily)
SELECT sym, count(r) AS n, round(avg(r), 9) AS mean, round(stddev_samp(r), 9) AS sd, round(avg(r) / stddev_samp(r) * sqrt(261), 7) AS sharpe, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r IS NOT NULL THEN 0.0::DOUBLE END), 9) AS hit_rate, round(max(fall), 9) AS max_drawdown FROM r GROUP BY 1"""
)
def sp_15_metrics(spark, d):
    digits = {"mean": 9, "sd": 9, "sharpe": 7, "hit_rate": 9, "max_drawdown": 9}
    return Y.performance(daily(spark, d)).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(WITH_D + f", r AS (SELECT *, close / lag(close) {W} - 1 AS r FROM daily) SELECT sym, {DAY}, " + ", ".join(f"CASE WHEN count(r) {_frame(n - 1)} = {n} THEN round(avg(r) {_frame(n - 1)}, 9) END AS mean_{n}" for n in (20, 50, 100)) + " FROM r")
def sp_15_rolling_health(spark, d):
    return Y.rolling_health(daily(spark, d)).withColumns({"day": _text("day"), **{f"mean_{n}": F.round(f"mean_{n}", 9) for n in (20, 50, 100)}})


@query(WITH_F + f", s AS (SELECT day, right(sym, 6) AS pair, sign(r_60m)::DOUBLE AS v FROM panel WHERE r_60m IS NOT NULL), l AS (SELECT day, pair[1:3] AS currency, v FROM s UNION ALL SELECT day, pair[4:6], -v FROM s) SELECT {DAY}, currency, sum(v) AS net FROM l GROUP BY day, currency")
def sp_15_exposure(spark, d):
    s = panel(spark, d).where("r_60m IS NOT NULL").select("sym", "day", F.signum("r_60m").alias("signal"))
    return Y.currency_exposure(s).withColumn("day", _text("day"))


@query(WITH_F + ", o AS (SELECT day, row_number() OVER (ORDER BY day)::DOUBLE / count(*) OVER () AS p FROM (SELECT DISTINCT day FROM panel)) SELECT CASE WHEN p <= 0.6::DOUBLE THEN 'train' WHEN p <= 0.6::DOUBLE + 0.2::DOUBLE THEN 'validate' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT panel.day) AS days FROM panel JOIN o USING (day) GROUP BY 1")
def sp_09_split(spark, d):
    return Y.chronological_split(panel(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


@query(WITH_F + "SELECT sym, count(*) AS n FROM panel WHERE day < DATE '2024-01-01' - 5 OR day > DATE '2024-06-30' + 5 GROUP BY 1")
def sp_21_purged(spark, d):
    return Y.purged(panel(spark, d), "2024-01-01", "2024-06-30", 5).groupBy("sym").agg(F.count("*").alias("n"))


@query(WITH_F + f", b AS (SELECT sym, day, lag(asia_range) {W} AS before FROM panel) SELECT sym, {DAY}, CAST(ntile(3) OVER (PARTITION BY sym ORDER BY before, day) AS INT) AS tercile FROM b WHERE before IS NOT NULL")
def sp_02_terciles(spark, d):
    return Y.terciles(panel(spark, d), "asia_range").withColumn("day", _text("day"))


@query(WITH_F + ", t AS (SELECT *, unnest([0.2, 0.25, 0.3, 0.35, 0.4])::DOUBLE AS threshold FROM flagged) SELECT threshold, count(*) FILTER (WHERE comp_pct <= threshold) AS n_compressed, round(quantile_cont(expansion_ratio, 0.5) FILTER (WHERE comp_pct <= threshold) - quantile_cont(expansion_ratio, 0.5) FILTER (WHERE comp_pct > threshold), 9) AS difference FROM t GROUP BY 1")
def sp_03_plateau(spark, d):
    f = flags(panel(spark, d)).where("comp_pct IS NOT NULL")
    return Y.plateau(f, "expansion_ratio", FROZEN.plateau).withColumn("difference", F.round("difference", 9))


@query(WITH_F + ", g AS (SELECT s.sym, avg(f.expansion_ratio) FILTER (WHERE f.compressed) - avg(f.expansion_ratio) FILTER (WHERE NOT f.compressed) AS x FROM (SELECT DISTINCT sym FROM flagged) s JOIN flagged f ON f.sym <> s.sym GROUP BY 1) SELECT sym, round(x, 8) AS difference FROM g")
def sp_09_leave_one_out(spark, d):
    f = flags(panel(spark, d)).where("comp_pct IS NOT NULL")
    return Y.leave_one_out(f, "expansion_ratio").withColumn("difference", F.round("difference", 8))


_NY = WITH_Q + ", days AS (SELECT sym, CAST(timezone('America/New_York', timezone('UTC', make_timestamp(utc_ms * 1000))) + INTERVAL 7 HOUR AS DATE) AS day, arg_min(bid, (utc_ms, seq, tick_id)) AS open, max(bid) AS high, min(bid) AS low, arg_max(bid, (utc_ms, seq, tick_id)) AS close FROM q GROUP BY 1, 2)"


@query(_NY + f"SELECT sym, {DAY}, open, high, low, close FROM days")
def sp_14_ny_daily(spark, d):
    return Y.ny_daily(quotes(spark, d)).withColumn("day", _text("day"))


@query(_NY + f", l AS (SELECT *, lag(high) {W} AS h, lag(low) {W} AS l FROM days) SELECT sym, {DAY}, CASE WHEN high > h AND low < l THEN '3' WHEN high > h THEN '2u' WHEN low < l THEN '2d' WHEN h IS NOT NULL THEN '1' END AS label FROM l")
def sp_13_bar_labels(spark, d):
    return Y.bar_labels(Y.ny_daily(quotes(spark, d))).withColumn("day", _text("day"))


@query(WITH_D + f", days AS (SELECT sym, day, close AS low, row_number() {W} AS i FROM daily), b AS (SELECT *, min(low) {_B20} AS low_before, arg_max(i, (-low, i)) {_B20} AS place, count(*) {_B20} AS n FROM days) SELECT sym, {DAY}, low, low_before FROM b WHERE n = 20 AND low < low_before AND i - place >= 4")
def sp_13_turtle_soup(spark, d):
    return Y.turtle_soup(daily(spark, d).withColumnRenamed("close", "low")).withColumn("day", _text("day"))


@query(WITH_D + f", days AS (SELECT sym, day, close AS high, close AS low FROM daily), s AS (SELECT *, greatest(max(high) {_frame(2, '1 PRECEDING')}, max(high) OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS h, least(min(low) {_frame(2, '1 PRECEDING')}, min(low) OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS l, count(*) {_frame(2, '2 FOLLOWING')} AS n FROM days) SELECT sym, {DAY}, CASE WHEN high > h THEN 'high' ELSE 'low' END AS swing FROM s WHERE n = 5 AND (high > h OR low < l)")
def sp_17_swings(spark, d):
    c = daily(spark, d)
    return Y.swings(c.select("sym", "day", F.col("close").alias("high"), F.col("close").alias("low"))).withColumn("day", _text("day"))


_B5 = WITH_Q + ", b5 AS (SELECT sym, (utc_ms // 300000) * 300000 AS bar_ms, max(bid) AS bid_h, min(bid) AS bid_l, arg_max(bid, (utc_ms, seq, tick_id)) AS bid_c, arg_max((bid+ask)/2, (utc_ms, seq, tick_id)) AS mid_c FROM q GROUP BY 1, 2)"


def _five(spark, d):
    return Q.bars(quotes(spark, d), 5)


@query(_B5 + ", g AS (SELECT *, lag(bid_h, 2) OVER w AS h, lag(bid_l, 2) OVER w AS l FROM b5 WINDOW w AS (PARTITION BY sym, bar_ms // 86400000 ORDER BY bar_ms)) SELECT sym, bar_ms, CASE WHEN bid_l > h THEN 'up' ELSE 'down' END AS side, CASE WHEN bid_l > h THEN (bid_l + h) / 2 ELSE (bid_h + l) / 2 END AS entry FROM g WHERE bid_l > h OR bid_h < l")
def sp_06_fair_value_gaps(spark, d):
    return Y.gaps_between_bars(_five(spark, d))


@query(
    "WITH ses AS (" + _sessions_sql(True) + "), " + _B5[5:] + """, w AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(bar_ms * 1000))) AS lt FROM b5),
x AS (SELECT w.*, s.london_date, asia_lo, asia_range FROM w JOIN ses s ON s.sym = w.sym AND s.london_date = strftime(lt, '%Y-%m-%d') WHERE asia_range > 0 AND hour(lt) * 60 + minute(lt) BETWEEN 420 AND 600),
y AS (SELECT *, min(CASE WHEN bid_c > asia_lo THEN bar_ms END) OVER (PARTITION BY sym, london_date ORDER BY bar_ms ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS c FROM x)
SELECT sym, london_date, min(bar_ms) AS sweep_ms, arg_min(c, bar_ms) AS confirmed_ms FROM y WHERE bid_l <= asia_lo - 0.05 * asia_range AND c IS NOT NULL GROUP BY 1, 2"""
)
def sp_06_sweeps(spark, d):
    q = quotes(spark, d)
    s = X.session_table(Q.closes(q), **THIN).select("sym", "london_date", "asia_lo", "asia_range")
    return Y.sweeps(Q.bars(q, 5), s).withColumn("london_date", _text("london_date"))


@query(
    _B5 + """, s AS (SELECT sym, bar_ms AS at_ms, mid_c AS p0 FROM b5),
r AS (SELECT s.sym, s.at_ms, any_value(p0) AS p0, min(bar_ms) FILTER (WHERE bid_h >= p0 + p0 * 0.0005::DOUBLE) AS up, min(bar_ms) FILTER (WHERE bid_l <= p0 - p0 * 0.0005::DOUBLE) AS down, count(bar_ms) AS n
  FROM s LEFT JOIN b5 ON b5.sym = s.sym AND b5.bar_ms >= at_ms AND b5.bar_ms < at_ms + 3600000 GROUP BY 1, 2)
SELECT sym, at_ms, CASE WHEN up = down THEN 'both' WHEN up < coalesce(down, 4611686018427387904) THEN 'up' WHEN down IS NOT NULL THEN 'down' WHEN n < 10 THEN 'unknown' ELSE 'neither' END AS outcome FROM r"""
)
def sp_18_barrier_race_all(spark, d):
    """The race from every five-minute bar."""
    b = _five(spark, d)
    return Y.barrier_race(b.select("sym", F.col("bar_ms").alias("at_ms"), F.col("mid_c").alias("p0")), b, F.col("p0") * F.lit(0.0005))


@query(
    _B5 + f""", w AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(bar_ms * 1000))) AS lt FROM b5), o AS (SELECT sym, CAST(lt AS DATE) AS day, hour(lt) * 60 + minute(lt) - 540 AS m, bar_ms, mid_c FROM w),
f AS (SELECT *, CAST(CASE WHEN m >= -120 AND m < -60 THEN -120 WHEN m >= -60 AND m < -30 THEN -60 WHEN m >= -30 AND m < 0 THEN -30 WHEN m >= 0 AND m < 30 THEN 0 WHEN m >= 30 AND m < 60 THEN 30 END AS INT) AS win FROM o)
SELECT sym, {DAY}, win AS "window", round((arg_max(mid_c, bar_ms) / arg_min(mid_c, bar_ms) - 1) * 10000, 6) + 0.0 AS move_bp FROM f WHERE win IS NOT NULL GROUP BY sym, day, win"""
)
def sp_10_fix_windows(spark, d):
    """Around 09:00 London: the test quotes end before the afternoon's fix."""
    return Y.fix_windows(_five(spark, d), hour=9).withColumns({"day": _text("day"), "move_bp": F.round("move_bp", 6) + 0.0})


@query(_B5 + ", p AS (SELECT right(sym, 6) AS pair, bar_ms, count(*) AS feeds, max(mid_c) - min(mid_c) AS apart FROM b5 GROUP BY 1, 2) SELECT pair, count(*) AS bars, count(*) FILTER (WHERE feeds > 1) AS shared, round(quantile_cont(apart, 0.5) FILTER (WHERE feeds > 1), 9) AS median_apart FROM p GROUP BY 1")
def sp_01_replication(spark, d):
    return Y.feed_replication(_five(spark, d)).withColumn("median_apart", F.round("median_apart", 9))


@query(_B5 + "SELECT sym, count(*) AS \"both\", CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, CAST(0 AS BIGINT) AS differ FROM b5 GROUP BY 1")
def sp_16_parity(spark, d):
    """Closing bids of five-minute bars, built directly and rolled up from one-minute bars."""
    q = quotes(spark, d)
    rolled = Q.bars(q, 1).groupBy("sym", (F.floor(F.col("bar_ms") / 300_000) * 300_000).alias("bar_ms")).agg(F.max_by("bid_c", "bar_ms").alias("bid_c"))
    return Y.parity(Q.bars(q, 5), rolled, ("sym", "bar_ms"), "bid_c")


@query()
def sp_19_matches(spark, d):
    """Large five-minute moves matched with quiet bars of the same sym and day, each used once."""
    b = _five(spark, d).withColumn("date", F.floor(F.col("bar_ms") / 86_400_000)).withColumn("r", F.abs(F.col("mid_c") / F.col("mid_o") - 1)).withColumn("id", F.col("bar_ms"))
    return Y.greedy_matches(b.where("r > 0.0002"), b.where("r < 0.00002"), ("sym", "date"), "bar_ms", 7_200_000)


# --- further rules ---
@query(WITH_Q + ", m AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(utc_ms * 1000))) AS lt FROM q), s AS (SELECT right(sym, 6) AS pair, CASE WHEN hour(lt) * 60 + minute(lt) < 420 THEN 'asia' WHEN hour(lt) * 60 + minute(lt) < 601 THEN 'london' ELSE 'other' END AS session, round(ask - bid, 9) AS s FROM m) SELECT pair, session, count(*) AS n, round(quantile_cont(s, 0.1), 9) AS p10, round(quantile_cont(s, 0.5), 9) AS median, round(quantile_cont(s, 0.9), 9) AS p90 FROM s GROUP BY 1, 2")
def sp_01_spreads(spark, d):
    return Y.spread_distribution(quotes(spark, d)).withColumns({c: F.round(c, 9) for c in ("p10", "median", "p90")})


def _lookback_sql(n: int) -> str:
    return f"""k{n} AS (SELECT *, list(asia_range) FILTER (WHERE asia_range IS NOT NULL) OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS seen FROM panel),
c{n} AS (SELECT expansion_ratio, (len(list_filter(seen, lambda x: x < asia_range)) + 0.5::DOUBLE * len(list_filter(seen, lambda x: x = asia_range))) / {n}.0::DOUBLE <= 0.30::DOUBLE AS low FROM k{n} WHERE len(seen) = {n})"""


_LOOKBACKS = (20, 60, 120)


@query(
    WITH_F + ", " + ", ".join(map(_lookback_sql, _LOOKBACKS)) + " "
    + " UNION ALL ".join(f"SELECT CAST({n} AS INT) AS lookback, count(*) FILTER (WHERE low) AS n_compressed, round(quantile_cont(expansion_ratio, 0.5) FILTER (WHERE low) - quantile_cont(expansion_ratio, 0.5) FILTER (WHERE NOT low), 9) AS difference FROM c{n}" for n in _LOOKBACKS)
)
def sp_03_lookbacks(spark, d):
    return Y.lookback_plateau(panel(spark, d), "expansion_ratio", _LOOKBACKS).withColumn("difference", F.round("difference", 9))


@query(WITH_F + f", m AS (SELECT sym, day, asia_range, list(asia_range) OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seen FROM panel) SELECT sym, {DAY}, CASE WHEN len(seen) = 20 THEN round(asia_range / list_aggregate(seen, 'median'), 9) END AS ratio FROM m")
def sp_04_median_ratio(spark, d):
    return Y.median_ratio(panel(spark, d), "asia_range").withColumns({"day": _text("day"), "ratio": F.round("ratio", 9)})


_OHLC = "WITH " + OHLC_SQL


@query(_OHLC + f", p AS (SELECT *, lag(close) {W} AS was FROM ohlc), t AS (SELECT sym, day, greatest(high - low, abs(high - was), abs(low - was)) AS true_range FROM p) SELECT sym, {DAY}, true_range, CASE WHEN count(true_range) {_frame(13)} = 14 THEN round(avg(true_range) {_frame(13)}, 6) END AS atr FROM t")
def sp_04_true_ranges(spark, d):
    return Y.true_ranges(daily_bars(spark, d)).withColumns({"day": _text("day"), "atr": F.round("atr", 6)})


@query(
    "WITH ses AS (" + _sessions_sql(True) + "), " + _B5[5:] + """, w AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(bar_ms * 1000))) AS lt FROM b5),
s AS (SELECT *, lag(ldn_hi) OVER v AS ph, lag(ldn_lo) OVER v AS pl FROM ses WHERE asia_range > 0 WINDOW v AS (PARTITION BY sym ORDER BY london_date)),
x AS (SELECT w.*, hour(lt) * 60 + minute(lt) AS m, s.london_date, asia_hi, asia_lo, asia_range, ph, pl FROM w JOIN s ON s.sym = w.sym AND s.london_date = strftime(lt, '%Y-%m-%d')),
g AS (SELECT sym, london_date, any_value(asia_lo) AS lo, any_value(asia_range) AS rg, any_value(ph) AS ph, any_value(pl) AS pl, arg_max(bid_c, bar_ms) FILTER (WHERE m < 420) AS c, arg_min(bid_c, bar_ms) FILTER (WHERE m < 420) AS o,
  min(bar_ms) FILTER (WHERE m BETWEEN 420 AND 600 AND bid_h > asia_hi) AS up, min(bar_ms) FILTER (WHERE m BETWEEN 420 AND 600 AND bid_l < asia_lo) AS down FROM x WHERE m < 601 GROUP BY 1, 2)
SELECT sym, london_date, round((c - lo) / rg, 9) AS close_location, CASE WHEN up = down THEN 'both' WHEN up < coalesce(down, 4611686018427387904) THEN 'up' WHEN down IS NOT NULL THEN 'down' END AS first_break, round(CASE WHEN ph <> pl THEN (o - pl) / (ph - pl) END, 9) AS prior_location FROM g"""
)
def sp_05_direction(spark, d):
    q = quotes(spark, d)
    s = X.session_table(Q.closes(q), **THIN).select("sym", "london_date", "asia_hi", "asia_lo", "asia_range", "ldn_hi", "ldn_lo")
    out = Y.direction_tests(Q.bars(q, 5), s)
    return out.withColumns({"london_date": _text("london_date"), "close_location": F.round("close_location", 9), "prior_location": F.round("prior_location", 9)})


@query(
    "WITH ses AS (" + _sessions_sql(True) + "), " + _B5[5:] + """, w AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(bar_ms * 1000))) AS lt FROM b5),
x AS (SELECT w.*, s.london_date, asia_hi, asia_range FROM w JOIN ses s ON s.sym = w.sym AND s.london_date = strftime(lt, '%Y-%m-%d') WHERE asia_range > 0 AND hour(lt) * 60 + minute(lt) BETWEEN 420 AND 600),
y AS (SELECT *, min(CASE WHEN bid_c < asia_hi THEN bar_ms END) OVER (PARTITION BY sym, london_date ORDER BY bar_ms ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS c FROM x)
SELECT sym, london_date, min(bar_ms) AS sweep_ms, arg_min(c, bar_ms) AS confirmed_ms FROM y WHERE bid_h >= asia_hi + 0.05 * asia_range AND c IS NOT NULL GROUP BY 1, 2"""
)
def sp_06_sweeps_short(spark, d):
    q = quotes(spark, d)
    s = X.session_table(Q.closes(q), **THIN).select("sym", "london_date", "asia_hi", "asia_range")
    return Y.sweeps(Q.bars(q, 5), s, side="high").withColumn("london_date", _text("london_date"))


@query(WITH_F + ", y AS (SELECT CAST(year(day) AS INT) AS year, sum(expansion_ratio) FILTER (WHERE compressed) AS sa, count(expansion_ratio) FILTER (WHERE compressed) AS na, sum(expansion_ratio) FILTER (WHERE NOT compressed) AS sb, count(expansion_ratio) FILTER (WHERE NOT compressed) AS nb FROM flagged GROUP BY 1), t AS (SELECT year, count(*) OVER w AS train_years, sum(sa) OVER w / nullif(sum(na) OVER w, 0) - sum(sb) OVER w / nullif(sum(nb) OVER w, 0) AS train, sa / nullif(na, 0) - sb / nullif(nb, 0) AS test FROM y WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT year, train_years, round(train, 8) AS train, round(test, 8) AS test FROM t WHERE train_years >= 1")
def sp_09_walk_forward(spark, d):
    f = flags(panel(spark, d)).where("comp_pct IS NOT NULL")
    return Y.walk_forward(f, "expansion_ratio").withColumns({"train": F.round("train", 8), "test": F.round("test", 8)})


@query(
    _B5 + f""", w AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(bar_ms * 1000))) AS lt FROM b5), o AS (SELECT sym, CAST(lt AS DATE) AS day, hour(lt) * 60 + minute(lt) - 960 AS m, bar_ms, mid_c FROM w),
f AS (SELECT *, CAST(CASE WHEN m >= -120 AND m < -60 THEN -120 WHEN m >= -60 AND m < -30 THEN -60 WHEN m >= -30 AND m < 0 THEN -30 WHEN m >= 0 AND m < 30 THEN 0 WHEN m >= 30 AND m < 60 THEN 30 END AS INT) AS win FROM o)
SELECT sym, {DAY}, win AS "window", round((arg_max(mid_c, bar_ms) / arg_min(mid_c, bar_ms) - 1) * 10000, 6) + 0.0 AS move_bp FROM f WHERE win IS NOT NULL GROUP BY sym, day, win"""
)
def sp_10_fix_windows_16(spark, d):
    """Around the fix itself at 16:00 London."""
    return Y.fix_windows(_five(spark, d)).withColumns({"day": _text("day"), "move_bp": F.round("move_bp", 6) + 0.0})


@query(WITH_D + f", e AS (SELECT sym, year(day) * 12 + month(day) AS month, max(day) AS day, arg_max(close, day) AS close FROM daily WHERE close IS NOT NULL GROUP BY 1, 2), v AS (SELECT *, CASE WHEN count(*) OVER w = 13 THEN ln(avg(close) OVER w / close) END AS value FROM e WINDOW w AS (PARTITION BY sym ORDER BY month RANGE BETWEEN 66 PRECEDING AND 54 PRECEDING)), r AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY value)::DOUBLE AS rk FROM v WHERE value IS NOT NULL), o AS (SELECT *, rk - avg(rk) OVER (PARTITION BY month) AS off FROM r) SELECT sym, {DAY}, round(value, 9) AS value, round(off * 2 / nullif(sum(abs(off)) OVER (PARTITION BY month), 0), 9) AS weight FROM o")
def sp_11_value(spark, d):
    return Y.value_weights(daily(spark, d)).withColumns({"day": _text("day"), "value": F.round("value", 9), "weight": F.round("weight", 9)})


@query(_OHLC + ", w AS (SELECT sym, CAST(date_trunc('week', day) AS DATE) AS week, max(high) AS high, min(low) AS low, arg_max(close, day) AS close FROM ohlc GROUP BY 1, 2), l AS (SELECT *, lag(low) OVER v AS low_before, lag(high) OVER v AS high_before FROM w WINDOW v AS (PARTITION BY sym ORDER BY week)) SELECT sym, strftime(week, '%Y-%m-%d') AS week, low, low_before, high_before FROM l WHERE low < low_before AND close > low_before")
def sp_13_weekly_sweeps(spark, d):
    return Y.weekly_sweeps(daily_bars(spark, d)).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query(WITH_D + f", r AS (SELECT sym, day, close / lag(close) {W} - 1 AS r FROM daily), p AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY r DESC, day) AS place, count(*) OVER (PARTITION BY sym) AS n FROM r WHERE r IS NOT NULL) SELECT sym, max(n) AS days, round(sum(r) FILTER (WHERE r > 0 AND place <= ceil(n * 0.05::DOUBLE)) / sum(r) FILTER (WHERE r > 0), 9) AS best_share FROM p GROUP BY 1")
def sp_15_concentration(spark, d):
    return Y.concentration(daily(spark, d)).withColumn("best_share", F.round("best_share", 9))


@query()
def sp_20_block_lengths(spark, d):
    """The six statistics at the evidence level of 98.33%, with blocks of 10, 20 and 40 dates."""
    return block_length_check(flags(panel(spark, d)).where("comp_pct IS NOT NULL"))


# --- streams, run until they are drained ---
_O = "(utc_ms, seq, tick_id)"


@query(WITH_Q + f"SELECT sym, (utc_ms // 300000) * 300000 AS bar_ms, arg_min(bid, {_O}) AS bid_o, max(bid) AS bid_h, min(bid) AS bid_l, arg_max(bid, {_O}) AS bid_c, count(*) AS n_ticks FROM q GROUP BY 1, 2")
def str_01_stream_bars(spark, d):
    return stream.drained(stream.read_ticks(spark, f"{d}/ticks.parquet"), stream.tumbling, "bars")


@query(WITH_Q + ", w AS (SELECT *, unnest(generate_series((utc_ms // 900000) * 900000 - 2700000, (utc_ms // 900000) * 900000, 900000)) AS from_ms FROM q) SELECT sym, from_ms, max(bid) AS bid_h, min(bid) AS bid_l, count(*) AS n_ticks FROM w GROUP BY 1, 2")
def str_sliding(spark, d):
    return stream.drained(stream.read_ticks(spark, f"{d}/ticks.parquet"), stream.sliding, "sliding")


@query(WITH_Q + ", s AS (SELECT *, CASE WHEN utc_ms - lag(utc_ms) OVER (PARTITION BY sym ORDER BY utc_ms) <= 3600000 THEN 0 ELSE 1 END AS new FROM q), g AS (SELECT *, sum(new) OVER (PARTITION BY sym ORDER BY utc_ms, seq, tick_id) AS k FROM s) SELECT sym, min(utc_ms) AS from_ms, max(utc_ms) AS to_ms, count(*) AS n_ticks FROM g GROUP BY sym, k")
def str_session_gap(spark, d):
    return stream.drained(stream.read_ticks(spark, f"{d}/ticks.parquet"), stream.between_gaps, "gaps")


# --- sources and governance ---
@query(WITH_Q + "SELECT sym, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm, count(*) AS n, min(utc_ms) AS first_ms, max(utc_ms) AS last_ms FROM q GROUP BY 1, 2")
def snk_01_store_round_trip(spark, d):
    """All quotes written to the month-partitioned store and read back."""
    root = scratch_path(spark, "store")
    exports.write_store(quotes(spark, d).withColumn("yyyymm", Q.month_of()), root)
    return exports.read_store(spark, root).groupBy("sym", "yyyymm").agg(F.count("*").alias("n"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms"))


@query(WITH_Q + "SELECT sym, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm, utc_ms, seq, bid, ask FROM q")
def snk_01_store_rows(spark, d):
    """Every row, price and seq of the store, written and read back."""
    root = scratch_path(spark, "store")
    exports.write_store(quotes(spark, d).withColumn("yyyymm", Q.month_of()), root)
    return exports.read_store(spark, root).select("sym", "yyyymm", "utc_ms", "seq", "bid", "ask")


@query(WITH_Q + "SELECT sym, utc_ms, seq, bid, ask FROM q WHERE sym = 'hub:EURUSD' AND utc_ms BETWEEN 1757000000000 AND 1759999999000")
def src_06_store_range(spark, d):
    """A closed range of one pair from the stored months that it touches."""
    root = scratch_path(spark, "store")
    exports.write_store(quotes(spark, d).withColumn("yyyymm", Q.month_of()), root)
    return exports.read_store(spark, root, "hub:EURUSD", 1757000000000, 1759999999000, required=True).select("sym", "utc_ms", "seq", "bid", "ask")


@query(WITH_Q + "SELECT sym, utc_ms, seq, bid, ask FROM q WHERE sym = 'hub:EURUSD' AND strftime(make_timestamp(utc_ms * 1000), '%Y%m') BETWEEN '202509' AND '202511'")
def src_06_padded_range(spark, d):
    """The same range's month with one whole month more on either side."""
    root = scratch_path(spark, "store")
    exports.write_store(quotes(spark, d).withColumn("yyyymm", Q.month_of()), root)
    return exports.read_store(spark, root, "hub:EURUSD", 1760000000000, 1760000000001, pad_months=1).select("sym", "utc_ms", "seq", "bid", "ask")


@query()
def src_10_synthetic(spark, d):
    return synthetic.generate(spark, "2024-01-01", "2024-01-12").groupBy("sym").agg(F.count("*").alias("n"), F.min("bid").alias("low"), F.max("bid").alias("high"))


@query("SELECT feed || ':' || pair AS sym, count(*) AS \"rows\" FROM data_gates GROUP BY 1")
def gov_01_snapshot_rows(spark, d):
    t = spark.read.parquet(f"{d}/data_gates.parquet").withColumn("sym", F.concat_ws(":", "feed", "pair"))
    return G.content_hash(t, ["sym"]).select("sym", "rows")


@query()
def gov_01_content_hash(spark, d):
    return G.content_hash(spark.read.parquet(f"{d}/region.parquet").withColumn("sym", F.lit("region")), ["sym"])


_PART = " + ".join(f"CAST(strpos('0123456789abcdef', h[{{0}} + {k}]) - 1 AS HUGEINT) * {16 ** (11 - k)}" for k in range(12))


@query(
    "WITH t AS (SELECT feed || ':' || pair AS sym, yyyymm, total_ticks, negative_spread, jump_gt_2pct FROM data_gates), "
    + "x AS (SELECT sym, sha256(" + " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in ("jump_gt_2pct", "negative_spread", "sym", "total_ticks", "yyyymm")) + ") AS h FROM t), "
    + "s AS (SELECT sym, count(*) AS n, " + ", ".join(f"sum({_PART.format(1 + 12 * i)}) AS s{i}" for i in range(5)) + " FROM x GROUP BY 1) "
    + "SELECT sym, n AS \"rows\", sha256(CAST(n AS VARCHAR) || ':' || " + " || ':' || ".join(f"CAST(s{i} AS VARCHAR)" for i in range(5)) + ") AS hash FROM s"
)
def gov_01_hashes(spark, d):
    """The hash itself, per source, of the gate table's counts: rows hashed one by one and added up."""
    t = spark.read.parquet(f"{d}/data_gates.parquet").select(F.concat_ws(":", "feed", "pair").alias("sym"), "yyyymm", "total_ticks", "negative_spread", "jump_gt_2pct")
    return G.content_hash(t, ["sym"])


@query(WITH_Q + EXPORTED_SQL + ", a AS (SELECT sym, (utc_ms // 300000) * 300000 AS bar_ms, arg_max(bid, (utc_ms, seq, tick_id)) AS va FROM q GROUP BY 1, 2), b AS (SELECT sym, (utc_ms // 300000) * 300000 AS bar_ms, arg_max(bid, (utc_ms, seq, tick_id)) AS vb FROM x GROUP BY 1, 2) SELECT sym, count(*) FILTER (WHERE va IS NOT NULL AND vb IS NOT NULL) AS \"both\", count(*) FILTER (WHERE vb IS NULL) AS only_a, count(*) FILTER (WHERE va IS NULL) AS only_b, count(*) FILTER (WHERE abs(va - vb) > 1e-9) AS differ FROM a FULL JOIN b USING (sym, bar_ms) GROUP BY 1")
def sp_16_disagreement(spark, d):
    """The difference report where there is something to report: closing bids of the accepted quotes against those of the exported lines."""
    return Y.parity(_five(spark, d), Q.bars(exported(spark, d), 5), ("sym", "bar_ms"), "bid_c", 1e-9)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


