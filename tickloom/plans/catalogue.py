"""Named queries over the quote and session operators, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.frozen import FROZEN
from tickloom.functions import scalar as S
from tickloom.operators import quotes as Q
from tickloom.operators import refresh as R
from tickloom.operators import sessions as X
from tickloom.operators import stats as T
from tickloom.session import cut
from tickloom.sources.adapters import DAILY_SQL, EXPORTED_SQL, FLAGGED_SQL, PANEL_SQL, QUOTES_SQL, dirty_quotes, exported, panel, quotes
from tickloom.sources.tables import finite, number, six_capitals, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def _text(c: str) -> Column:
    """Dates are given as ISO text."""
    return F.date_format(c, "yyyy-MM-dd").alias(c)


WITH_Q = "WITH " + QUOTES_SQL
WITH_P = "WITH " + PANEL_SQL
WITH_F = "WITH " + FLAGGED_SQL
WITH_D = "WITH " + DAILY_SQL
ORDER = "ORDER BY utc_ms, seq, tick_id"


# --- scans, projections, filters ---
@query(WITH_Q + "SELECT sym, tick_id, utc_ms, bid, ask FROM q WHERE sym LIKE '%:EURUSD' AND utc_ms BETWEEN 1757000000000 AND 1759999999000")
def src_06_scan_range(spark: SparkSession, d: str) -> DataFrame:
    return quotes(spark, d).where("sym LIKE '%:EURUSD' AND utc_ms BETWEEN 1757000000000 AND 1759999999000").select("sym", "tick_id", "utc_ms", "bid", "ask")


@query(WITH_Q + "SELECT tick_id, (bid + ask) / 2 AS mid, ask - bid AS spread FROM d")
def prj_mid_spread(spark, d):
    return dirty_quotes(spark, d).select("tick_id", Q.mid().alias("mid"), Q.spread().alias("spread"))


@query(WITH_Q + f", s AS (SELECT *, lag(utc_ms) OVER w AS t, lag(bid) OVER w AS b, lag(ask) OVER w AS a FROM d WINDOW w AS (PARTITION BY sym {ORDER})) SELECT sym, tick_id FROM s WHERE NOT coalesce(t = utc_ms AND b = bid AND a = ask, false)")
def flt_01_dedup_consecutive(spark, d):
    return Q.dedup_consecutive(dirty_quotes(spark, d)).select("sym", "tick_id")


@query(WITH_Q + "SELECT sym, tick_id FROM (SELECT *, row_number() OVER (PARTITION BY sym, utc_ms, bid, ask ORDER BY seq, tick_id) AS n FROM d) WHERE n = 1")
def flt_02_dedup_global(spark, d):
    return Q.dedup_global(dirty_quotes(spark, d)).select("sym", "tick_id")


@query(WITH_Q + "SELECT sym, tick_id FROM (SELECT *, row_number() OVER (PARTITION BY sym, utc_ms ORDER BY seq DESC, tick_id DESC) AS n FROM d) WHERE n = 1")
def flt_03_last_per_ts(spark, d):
    return Q.last_per_time(dirty_quotes(spark, d)).select("sym", "tick_id")


@query(WITH_Q + "SELECT sym, CASE WHEN bid <= 0 THEN 'bid' WHEN ask <= 0 THEN 'ask' ELSE 'crossed' END AS reason, count(*) AS removed FROM d WHERE bid <= 0 OR ask <= 0 OR ask < bid GROUP BY 1, 2")
def flt_clean_log(spark, d):
    return Q.clean(dirty_quotes(spark, d))[1]


# --- bars and quality ---
def _bars_sql(minutes: int) -> str:
    s = minutes * 60_000
    o = "(utc_ms, seq, tick_id)"
    return WITH_Q + f"""SELECT sym, (utc_ms // {s}) * {s} AS bar_ms, arg_min(bid, {o}) AS bid_o, max(bid) AS bid_h, min(bid) AS bid_l, arg_max(bid, {o}) AS bid_c, arg_max(ask, {o}) AS ask_c,
  arg_min((bid+ask)/2, {o}) AS mid_o, max((bid+ask)/2) AS mid_h, min((bid+ask)/2) AS mid_l, arg_max((bid+ask)/2, {o}) AS mid_c,
  min(ask-bid) AS spread_min, quantile_cont(ask-bid, 0.5) AS spread_med, max(ask-bid) AS spread_max, count(*) AS n_ticks FROM q GROUP BY 1, 2"""


for _m in (1, 5, 15):
    query(_bars_sql(_m), f"agg_01_bars_{_m}m")(lambda spark, d, m=_m: Q.bars(quotes(spark, d), m))


@query(WITH_Q + f", s AS (SELECT sym, utc_ms, lag(utc_ms) OVER (PARTITION BY sym {ORDER}) AS p FROM q) SELECT sym, p AS from_ms, utc_ms AS to_ms FROM s WHERE utc_ms - p > 3600000")
def win_07_gaps(spark, d):
    return Q.gaps(quotes(spark, d))


@query(WITH_Q + f", m AS (SELECT *, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm FROM q), s AS (SELECT sym, yyyymm, utc_ms - lag(utc_ms) OVER (PARTITION BY sym, yyyymm {ORDER}) AS g FROM m) SELECT sym, yyyymm, max(g // 60000) AS longest_min FROM s GROUP BY 1, 2")
def win_08_longest_gap(spark, d):
    return Q.longest_gaps(quotes(spark, d))


_STEPS = f", s AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa FROM d WINDOW w AS (PARTITION BY sym {ORDER})), f AS (SELECT *, coalesce(bid = pb AND ask = pa, false) AS same, (bid+ask)/2 AS mid, (pb+pa)/2 AS prev_mid FROM s)"
_JUMP = "mid > 0 AND prev_mid > 0 AND abs(ln(mid / prev_mid)) > 0.02"


def _blocks_sql(legacy: bool) -> str:
    return _STEPS + f", g AS (SELECT *, sum(CASE WHEN {'same' if legacy else 'NOT same'} THEN 1 ELSE 0 END) OVER (PARTITION BY sym {ORDER}) AS block FROM f), blocks AS (SELECT sym, CAST(block AS BIGINT) AS block, count(*) AS n, min(utc_ms) AS start_ms, max(utc_ms) AS end_ms FROM g GROUP BY 1, 2)"


@query(WITH_Q + _blocks_sql(True) + f", b AS (SELECT sym, count(*) AS n, count(*) FILTER (WHERE ask < bid) AS c, count(*) FILTER (WHERE bid <= 0 OR ask <= 0) AS z FROM d GROUP BY 1), st AS (SELECT sym, count(*) AS k FROM blocks WHERE n >= 300 GROUP BY 1), j AS (SELECT sym, count(*) AS k FROM f WHERE {_JUMP} GROUP BY 1) SELECT b.sym, b.n, c AS n_negative_spread, c AS n_crossed, z AS n_zero, coalesce(st.k, 0) AS stale_blocks, coalesce(j.k, 0) AS n_jumps, c + c + z AS invalid_total FROM b LEFT JOIN st USING (sym) LEFT JOIN j USING (sym)")
def dq_02_integrity(spark, d):
    return Q.integrity(dirty_quotes(spark, d))


@query(WITH_Q + _blocks_sql(True) + "SELECT sym, count(*) AS blocks, max(n) AS longest FROM blocks GROUP BY 1")
def win_06_stale_legacy(spark, d):
    return Q.blocks(dirty_quotes(spark, d), legacy=True).groupBy("sym").agg(F.count("*").alias("blocks"), F.max("n").alias("longest"))


@query(WITH_Q + _blocks_sql(False) + "SELECT sym, n, start_ms, end_ms FROM blocks WHERE n >= 5")
def win_06_stale_runs(spark, d):
    return Q.blocks(dirty_quotes(spark, d), legacy=False).where("n >= 5").select("sym", "n", "start_ms", "end_ms")


@query(WITH_Q + _STEPS + f"SELECT sym, tick_id, utc_ms, prev_mid, mid FROM f WHERE {_JUMP}")
def win_03_jumps(spark, d):
    return Q.jumps(dirty_quotes(spark, d))


@query(WITH_Q + "SELECT sym, count(DISTINCT utc_ms // 300000) AS bars_checked, CAST(0 AS BIGINT) AS high_mismatch, CAST(0 AS BIGINT) AS low_mismatch FROM q GROUP BY 1")
def dq_03_bar_consistency(spark, d):
    return Q.bar_consistency(quotes(spark, d))


@query(WITH_Q + EXPORTED_SQL + ", a AS (SELECT sym, (utc_ms // 300000) * 300000 AS bar_ms, max(bid) AS bid_h, min(bid) AS bid_l FROM q GROUP BY 1, 2), b AS (SELECT sym, (utc_ms // 300000) * 300000 AS bar_ms, max(bid) AS raw_h, min(bid) AS raw_l FROM x GROUP BY 1, 2) SELECT * FROM a JOIN b USING (sym, bar_ms)")
def jn_06_shared_bars(spark, d):
    """Bars of the accepted quotes beside the extrema of the exported lines, where both have the bar."""
    return Q.shared_bars(Q.closes(quotes(spark, d), 5), exported(spark, d), 5)


@query(WITH_Q + ", m AS (SELECT DISTINCT sym, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS ym FROM q) SELECT sym, count(*) AS n_months, min(ym) AS first, max(ym) AS last, CAST((max(ym) // 100 - min(ym) // 100) * 12 + max(ym) % 100 - min(ym) % 100 + 1 - count(*) AS INT) AS n_missing FROM m GROUP BY 1")
def agg_21_inventory(spark, d):
    return Q.inventory(quotes(spark, d))


_MONTHS = ", m AS (SELECT DISTINCT sym, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm FROM {t}), missing AS (SELECT s.sym, e.yyyymm FROM (SELECT DISTINCT sym FROM m) s, (SELECT unnest([202508, 202509, 202510, 202511, 202512]) AS yyyymm) e ANTI JOIN m ON m.sym = s.sym AND m.yyyymm = e.yyyymm)"


@query(WITH_Q + _MONTHS.format(t="q") + "SELECT sym, yyyymm FROM missing")
def jn_09_missing_months(spark, d):
    return Q.missing_months(quotes(spark, d), 202508, 202512)


@query(
    WITH_Q + _STEPS + _MONTHS.format(t="d") + f""", c AS (SELECT sym, count(*) AS n, count(*) FILTER (WHERE ask < bid) AS n_crossed, count(*) FILTER (WHERE bid <= 0 OR ask <= 0) AS n_zero, count(*) FILTER (WHERE {_JUMP}) AS n_jumps FROM f GROUP BY 1),
b AS (SELECT sym, count(DISTINCT utc_ms // 300000) AS bars_checked FROM d WHERE bid > 0 AND ask >= bid GROUP BY 1),
mm AS (SELECT sym, count(*) AS k FROM missing GROUP BY 1),
g0 AS (SELECT *, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm FROM d WHERE bid > 0 AND ask >= bid),
g AS (SELECT sym, max(x // 60000) AS longest_gap_min FROM (SELECT sym, utc_ms - lag(utc_ms) OVER (PARTITION BY sym, yyyymm {ORDER}) AS x FROM g0) GROUP BY 1)
SELECT c.sym, n, n_crossed, n_zero, n_jumps, coalesce(bars_checked, 0) AS bars_checked, CAST(0 AS BIGINT) AS high_mismatch, CAST(0 AS BIGINT) AS low_mismatch, coalesce(k, 0) AS months_missing, longest_gap_min,
  n > 0 AND coalesce(bars_checked, 0) > 0 AND n_crossed = 0 AND n_zero = 0 AND coalesce(k, 0) = 0 AS data_pass
FROM c LEFT JOIN b USING (sym) LEFT JOIN mm USING (sym) LEFT JOIN g USING (sym)"""
)
def dq_06_store_gate(spark, d):
    return Q.store_gate(dirty_quotes(spark, d), 202508, 202512)


# --- calendar and sessions ---
_CAL = "SELECT CAST(x AS DATE) AS london_date FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6"
_UTC = "timezone('UTC', timezone('Europe/London', london_date::TIMESTAMP + INTERVAL {m} MINUTE))"


@query(f"WITH c AS ({_CAL}) SELECT strftime(london_date, '%Y-%m-%d') AS london_date, " + ", ".join(f"epoch_ms({_UTC.format(m=m)}) AS {n}" for m, n in ((0, "asia_start"), (420, "asia_end"), (420, "ldn_start"), (601, "ldn_end"))) + f", epoch_ms({_UTC.format(m=420)}) <> epoch_ms(london_date::TIMESTAMP + INTERVAL 420 MINUTE) AS dst_summer FROM c")
def cal_01_sessions(spark, d):
    c = X.calendar(spark, "2024-01-01", "2024-12-31")
    return c.select(_text("london_date"), *[F.unix_millis(n).alias(n) for n in ("asia_start", "asia_end", "ldn_start", "ldn_end")], "dst_summer")


_BARS1 = WITH_Q + ", b1 AS (SELECT sym, (utc_ms // 60000) * 60000 AS bar_ms, max(bid) AS bid_h, min(bid) AS bid_l, arg_max((bid+ask)/2, (utc_ms, seq, tick_id)) AS mid_c FROM q GROUP BY 1, 2), l AS (SELECT *, timezone('Europe/London', timezone('UTC', make_timestamp(bar_ms * 1000))) AS lt FROM b1), lb AS (SELECT *, CAST(lt AS DATE) AS london_date, hour(lt) * 60 + minute(lt) AS m FROM l)"


def _sessions_sql(bounded: bool, floors: tuple[int, int] = (60, 30)) -> str:
    hs = FROZEN.horizons
    # Unbounded: the last close at or before the instant, over days.
    if bounded:
        near = "".join(f", arg_max(mid_c, bar_ms) FILTER (WHERE m BETWEEN {419 + h - 5} AND {419 + h}) AS p{h}" for h in (0, *hs))
    else:
        near = ""
    day = f"SELECT sym, london_date, count(*) FILTER (WHERE m < 601) AS n_bars, count(*) FILTER (WHERE m < 420) AS asia_n, count(*) FILTER (WHERE m BETWEEN 420 AND 600) AS ldn_n, max(bid_h) FILTER (WHERE m < 420) AS ah, min(bid_l) FILTER (WHERE m < 420) AS al, max(bid_h) FILTER (WHERE m BETWEEN 420 AND 600) AS lh, min(bid_l) FILTER (WHERE m BETWEEN 420 AND 600) AS ll{near} FROM lb GROUP BY 1, 2"
    sql = _BARS1 + f", day AS ({day}), span AS (SELECT sym, f, e, min(london_date) AS a, max(london_date) AS z FROM lb JOIN (SELECT sym, min(utc_ms) AS f, max(utc_ms) AS e FROM q GROUP BY 1) USING (sym) GROUP BY 1, 2, 3), dates AS (SELECT sym, f, e, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS london_date FROM span), j AS (SELECT dates.sym, dates.f, dates.e, dates.london_date, day.* EXCLUDE (sym, london_date), epoch_ms({_UTC.format(m=0)}) AS a0, epoch_ms({_UTC.format(m=420)}) AS l0, epoch_ms({_UTC.format(m=601)}) AS l1 FROM dates LEFT JOIN day USING (sym, london_date) WHERE isodow(dates.london_date) < 6)"
    if not bounded:
        last = "j"
        for h in (0, *hs):
            sql += f", x{h} AS (SELECT {last}.*, b.mid_c AS p{h} FROM {last} ASOF LEFT JOIN b1 b ON {last}.sym = b.sym AND {last}.l0 + {h - 1} * 60000 >= b.bar_ms)"
            last = f"x{h}"
        sql += f", y AS (SELECT * FROM {last})"
        reason = "CASE WHEN coalesce(n_bars, 0) < 10 THEN 'no-data' WHEN coalesce(asia_n, 0) = 0 OR coalesce(ldn_n, 0) = 0 THEN 'missing-window-data' WHEN ah - al <= 0 THEN 'zero-asia-range' ELSE '' END"
    else:
        sql += ", y AS (SELECT * FROM j)"
        reason = f"CASE WHEN f > a0 OR e < l1 THEN 'out-of-slice' WHEN coalesce(asia_n, 0) < {floors[0]} OR coalesce(ldn_n, 0) < {floors[1]} THEN 'window-coverage' WHEN ah - al <= 0 THEN 'zero-asia-range' ELSE '' END"
    v = lambda x: f"CASE WHEN reason = '' THEN {x} END"
    cols = [f"reason = '' AND p0 IS NOT NULL AND p{h} IS NOT NULL AS valid_for_h{h}m" for h in hs]
    cols += [f"{v(x)} AS {n}" for x, n in (("ah", "asia_hi"), ("al", "asia_lo"), ("ah - al", "asia_range"), ("lh", "ldn_hi"), ("ll", "ldn_lo"), ("lh - ll", "ldn_range"), ("(lh - ll) / (ah - al)", "expansion_ratio"))]
    for h in hs:
        cols += [f"{v(f'p{h} / p0 - 1')} AS r_{h}m", f"{v(f'abs(p{h} / p0 - 1)')} AS absr_{h}m"]
    return sql + f", s AS (SELECT *, {reason} AS reason FROM y) SELECT sym, strftime(london_date, '%Y-%m-%d') AS london_date, l0 <> epoch_ms(london_date::TIMESTAMP + INTERVAL 420 MINUTE) AS dst_summer, reason = '' AS valid, reason, {', '.join(cols)} FROM s"


@query(_sessions_sql(False))
def ses_01_sessions_v1(spark, d):
    t = X.session_table(Q.closes(quotes(spark, d)), bounded=False)
    return t.withColumn("london_date", _text("london_date"))


#: The test quotes are thinner than a live feed, so the floors of bars are too.
THIN = {"asia_bars": 60, "london_bars": 30}


def _v2(spark, d):
    t = X.session_table(Q.closes(quotes(spark, d)), **THIN)
    return t.withColumn("london_date", _text("london_date"))


@query(_sessions_sql(True))
def ses_02_sessions_v2(spark, d):
    return _v2(spark, d)


@query(_sessions_sql(True, (FROZEN.asia_bars, FROZEN.london_bars)))
def ses_02_frozen_floors(spark, d):
    """The same with the frozen floors of 350 and 150 bars, which few of the test quotes' sessions reach."""
    return X.session_table(Q.closes(quotes(spark, d))).withColumn("london_date", _text("london_date"))


_V2 = "WITH ses AS (" + _sessions_sql(True) + ") "


@query(_V2 + "SELECT CAST(replace(london_date[1:7], '-', '') AS INT) AS yyyymm, reason, count(*) AS n FROM ses WHERE NOT valid GROUP BY 1, 2")
def agg_16_reasons(spark, d):
    return _v2(spark, d).where("NOT valid").groupBy(F.regexp_replace(F.substring("london_date", 1, 7), "-", "").cast("int").alias("yyyymm"), "reason").agg(F.count("*").alias("n"))


@query(_V2 + "SELECT sym, " + ", ".join(f"count(*) FILTER (WHERE valid_for_h{h}m) AS h{h}" for h in FROZEN.horizons) + " FROM ses GROUP BY 1")
def agg_17_eligibility(spark, d):
    return _v2(spark, d).groupBy("sym").agg(*[F.count_if(f"valid_for_h{h}m").alias(f"h{h}") for h in FROZEN.horizons])


@query("SELECT feed, pair, london_date, count(*) AS n FROM sessions GROUP BY 1, 2, 3 HAVING count(*) > 1")
def agg_18_duplicates(spark, d):
    return spark.read.parquet(f"{d}/sessions.parquet").groupBy("feed", "pair", "london_date").agg(F.count("*").alias("n")).where("n > 1")


@query(_BARS1 + ", w AS (SELECT sym, london_date, CASE WHEN m < 420 THEN 'asia' WHEN m < 601 THEN 'london' END AS win, count(*) AS n FROM lb GROUP BY 1, 2, 3), span AS (SELECT sym, min(london_date) AS a, max(london_date) AS z FROM lb GROUP BY 1), e AS (SELECT sym, london_date, win FROM (SELECT sym, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS london_date FROM span), (SELECT unnest(['asia', 'london']) AS win) WHERE isodow(london_date) < 6) SELECT sym, e.win AS window, count(*) AS windows, count(*) FILTER (WHERE coalesce(n, 0) < 10) AS missing FROM e LEFT JOIN w USING (sym, london_date, win) GROUP BY 1, 2")
def dq_04_session_coverage(spark, d):
    return X.coverage(Q.closes(quotes(spark, d)))


# --- as-of joins: the hours of a sym's own days, one-minute closes ---
def _looks(spark, d):
    b = Q.closes(quotes(spark, d))
    hours = b.select("sym", (F.floor(F.col("bar_ms") / 3_600_000) * 3_600_000 + 3_600_000).alias("at_ms")).distinct()
    return hours.unionByName(hours.select("sym", (F.col("at_ms") + 7_200_000).alias("at_ms"))).distinct(), b


_LOOKS = _BARS1 + ", h AS (SELECT DISTINCT sym, (bar_ms // 3600000) * 3600000 + 3600000 AS at_ms FROM b1), looks AS (SELECT * FROM h UNION SELECT sym, at_ms + 7200000 FROM h)"


@query(_LOOKS + "SELECT looks.sym, looks.at_ms, b1.mid_c FROM looks ASOF LEFT JOIN b1 ON looks.sym = b1.sym AND looks.at_ms >= b1.bar_ms")
def jn_02_asof_unbounded(spark, d):
    looks, b = _looks(spark, d)
    return Q.as_of(looks, b, ("sym",), "at_ms", "bar_ms", "mid_c")


@query(_LOOKS + "SELECT looks.sym, looks.at_ms, CASE WHEN looks.at_ms - b1.bar_ms <= 300000 THEN b1.mid_c END AS mid_c FROM looks ASOF LEFT JOIN b1 ON looks.sym = b1.sym AND looks.at_ms >= b1.bar_ms")
def jn_03_asof_bounded(spark, d):
    looks, b = _looks(spark, d)
    return Q.as_of(looks, b, ("sym",), "at_ms", "bar_ms", "mid_c", 300_000)


# --- statistics on the session panel ---
def _stats_sql(v: str) -> str:
    return f"count({v}) AS n, round(avg({v}), 9) AS mean, round(quantile_cont({v}, 0.5), 12) AS median, round(stddev_samp({v}), 9) AS sd, " + ", ".join(f"round(quantile_cont({v}, {q}), 12) AS p{round(q * 100)}" for q in T.QUANTILES)


def _rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; means, deviations and quantiles are compared rounded."""
    digits = {"mean": 9, "sd": 9, "median": 12, "p10": 12, "p25": 12, "p75": 12, "p90": 12}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("SELECT session_id, expansion_ratio, ldn_range FROM sessions WHERE isfinite(expansion_ratio) AND isfinite(ldn_range)")
def flt_12_finite(spark, d):
    """Rows whose figures are numbers: neither NULL nor NaN nor infinite."""
    figures = ("expansion_ratio", "ldn_range")
    t = table(spark, d, "sessions").select("session_id", *[finite(c).alias(c) for c in figures])
    return t.where(" AND ".join(f"{c} IS NOT NULL" for c in figures))


@query(WITH_P + f"SELECT sym, {_stats_sql('expansion_ratio')} FROM panel GROUP BY 1")
def agg_06_stats(spark, d):
    return _rounded(panel(spark, d).groupBy("sym").agg(*T.describe("expansion_ratio")))


@query(WITH_P + f"SELECT sym, CAST(grouping(sym) AS TINYINT) AS pooled, {_stats_sql('expansion_ratio')}, round(avg(CASE WHEN expansion_ratio > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS p_gt_1, round(avg(CASE WHEN expansion_ratio > 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS p_gt_15 FROM panel GROUP BY GROUPING SETS ((sym), ())")
def agg_07_08_grouping_sets(spark, d):
    out = _rounded(T.summaries(panel(spark, d), "expansion_ratio"))
    return out.withColumns({c: F.round(c, 9) for c in ("p_gt_1", "p_gt_15")})


@query(WITH_P + f", y AS (SELECT *, year(day) AS year FROM panel) SELECT sym, CAST(year AS VARCHAR) AS year, CAST(grouping(sym, year) AS BIGINT) AS level, {_stats_sql('expansion_ratio')} FROM y GROUP BY ROLLUP (sym, year)")
def agg_09_rollup_year(spark, d):
    return _rounded(T.rollup_year(panel(spark, d), "expansion_ratio")).withColumn("year", F.col("year").cast("string"))


@query(WITH_P + f"SELECT CAST(year(day) AS INT) AS year, {_stats_sql('expansion_ratio')} FROM panel GROUP BY 1")
def agg_10_by_year(spark, d):
    return _rounded(T.by_year(panel(spark, d), "expansion_ratio"))


@query(
    "WITH t AS (SELECT feed || ':' || upper(regexp_replace(pair, '[^A-Za-z]', '', 'g')) AS sym, coalesce(valid, false) AS ok, CASE WHEN valid AND NOT isnan(expansion_ratio) THEN expansion_ratio END AS v, CASE WHEN valid THEN dst_summer::INT END AS s FROM sessions) "
    f"SELECT sym, CAST(grouping(sym) AS TINYINT) AS pooled, {_stats_sql('v')}, round(avg(CASE WHEN v > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE ok), 9) AS p_gt_1, round(avg(CASE WHEN v > 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE ok), 9) AS p_gt_15, round(avg(s), 9) AS dst_share, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_invalid FROM t GROUP BY GROUPING SETS ((sym), ())"
)
def agg_07_pair_summary(spark, d):
    """Per sym and pooled: the figures of the ratio, share of summer time, valid and invalid sessions, over all rows of the table."""
    t = table(spark, d, "sessions").select(F.concat_ws(":", "feed", six_capitals("pair")).alias("sym"), "valid", number("expansion_ratio").alias("expansion_ratio"), "dst_summer")
    out = _rounded(T.pair_summaries(t))
    return out.withColumns({c: F.round(c, 9) for c in ("p_gt_1", "p_gt_15", "dst_share")})


def _flagged(spark, d):
    return T.flags(panel(spark, d)).where("comp_pct IS NOT NULL")


@query(WITH_F + "SELECT sym, strftime(day, '%Y-%m-%d') AS day, comp_pct, ldn_pct FROM flagged0")
def win_01_midrank60(spark, d):
    return T.flags(panel(spark, d)).select("sym", _text("day"), "comp_pct", "ldn_pct")


@query(WITH_F + "SELECT sym, count(*) AS n, count(*) FILTER (WHERE compressed) AS n_compressed FROM flagged GROUP BY 1")
def win_02_compressed(spark, d):
    return _flagged(spark, d).groupBy("sym").agg(F.count("*").alias("n"), F.count_if("compressed").alias("n_compressed"))


def _diff_sql(v: str, keys: str, scale: str = "1") -> str:
    return WITH_F + f", k AS (SELECT *, CAST(year(day) AS INT) AS year FROM flagged), g AS (SELECT {keys}, count(CASE WHEN compressed THEN {v} END) AS n_compressed, count(CASE WHEN NOT compressed THEN {v} END) AS n_other, round((avg(CASE WHEN compressed THEN {v} END) - avg(CASE WHEN NOT compressed THEN {v} END)) * {scale}, 9) AS difference FROM k GROUP BY {keys}) SELECT * FROM g WHERE n_compressed > 0 AND n_other > 0"


@query(_diff_sql("expansion_ratio", "sym"))
def agg_11_sign_table(spark, d):
    return T.mean_difference(_flagged(spark, d), "expansion_ratio").withColumn("difference", F.round("difference", 9))


@query(_diff_sql("absr_60m", "year", "10000"))
def agg_12_yearly(spark, d):
    return T.mean_difference(_flagged(spark, d).withColumn("year", F.year("day")), "absr_60m", ("year",)).withColumn("difference", F.round(F.col("difference") * 10000, 9))


@query(_diff_sql("expansion_ratio", "dst_summer"))
def agg_13_split(spark, d):
    return T.mean_difference(_flagged(spark, d), "expansion_ratio", ("dst_summer",)).withColumn("difference", F.round("difference", 9))


@query(WITH_F + ", m AS (SELECT sym, compressed, avg((asia_hi - asia_lo) / (asia_hi + asia_lo) * 2 * 10000) AS m FROM flagged GROUP BY 1, 2) SELECT compressed, round(avg(m), 7) AS mean_of_means, count(*) AS syms FROM m GROUP BY 1")
def agg_14_mean_of_means(spark, d):
    bp = _flagged(spark, d).withColumn("bp", T.relative_range_bp("asia_hi", "asia_lo"))
    return T.mean_of_means(bp, "bp").withColumn("mean_of_means", F.round("mean_of_means", 7))


@query(WITH_F + "SELECT compressed, round(quantile_cont(expansion_ratio, 0.5), 12) AS ratio, round(quantile_cont(absr_60m, 0.5), 12) AS r60, round(quantile_cont(absr_180m, 0.5), 12) AS r180 FROM flagged GROUP BY 1")
def agg_19_medians(spark, d):
    return _flagged(spark, d).groupBy("compressed").agg(*[F.round(F.percentile(c, F.lit(0.5)), 12).alias(n) for c, n in (("expansion_ratio", "ratio"), ("absr_60m", "r60"), ("absr_180m", "r180"))])


@query(WITH_F + "SELECT sym, strftime(day, '%Y-%m-%d') AS day, rank() OVER (ORDER BY expansion_ratio) + (count(*) OVER (PARTITION BY expansion_ratio) - 1) / 2.0::DOUBLE AS rank FROM flagged WHERE expansion_ratio IS NOT NULL")
def win_09_avg_rank(spark, d):
    return T.average_rank(_flagged(spark, d).where("expansion_ratio IS NOT NULL"), "expansion_ratio").select("sym", _text("day"), "rank")


@query(WITH_F + ", r AS (SELECT compressed, rank() OVER (ORDER BY expansion_ratio) + (count(*) OVER (PARTITION BY expansion_ratio) - 1) / 2.0::DOUBLE AS rank FROM flagged WHERE expansion_ratio IS NOT NULL), t AS (SELECT count(*) FILTER (WHERE compressed) AS n1, count(*) FILTER (WHERE NOT compressed) AS n2, sum(rank) FILTER (WHERE compressed) AS rank_sum FROM r) SELECT n1, n2, rank_sum, CASE WHEN n1 >= 20 AND n2 >= 20 THEN rank_sum - n1::DOUBLE * (n1 + 1) / 2 END AS u, CASE WHEN n1 >= 20 AND n2 >= 20 THEN round((rank_sum - n1::DOUBLE * (n1 + 1) / 2 - n1::DOUBLE * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12), 9) END AS z FROM t")
def sta_01_mann_whitney_z(spark, d):
    return T.mann_whitney(_flagged(spark, d), "expansion_ratio").withColumn("z", F.round("z", 9))


@query(WITH_F + ", t AS (SELECT count(*) FILTER (WHERE compressed AND expansion_ratio > 1) AS x1, count(*) FILTER (WHERE compressed) AS n1, count(*) FILTER (WHERE NOT compressed AND expansion_ratio > 1) AS x2, count(*) FILTER (WHERE NOT compressed) AS n2 FROM flagged) SELECT x1, n1, x2, n2, CASE WHEN n1 > 0 AND n2 > 0 AND x1 + x2 BETWEEN 1 AND n1 + n2 - 1 THEN round((x1::DOUBLE / n1 - x2::DOUBLE / n2) / sqrt(((x1 + x2)::DOUBLE / (n1 + n2)) * (1 - (x1 + x2)::DOUBLE / (n1 + n2)) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 9) END AS z FROM t")
def sta_02_two_prop_z(spark, d):
    return T.two_proportions(_flagged(spark, d), F.col("expansion_ratio") > 1).withColumn("z", F.round("z", 9))


@query(
    WITH_F
    + f""", r AS (SELECT compressed, ldn_pct, {", ".join(f"absr_{h}m" for h in FROZEN.horizons)}, expansion_ratio FROM flagged), """
    + ", ".join(
        f"""k{i} AS (SELECT compressed, {v} AS v, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE AS rank FROM r WHERE {v} IS NOT NULL),
t{i} AS (SELECT '{v}' AS value, avg(v) FILTER (WHERE compressed) AS a, avg(v) FILTER (WHERE NOT compressed) AS b, count(*) FILTER (WHERE compressed) AS n1, count(*) FILTER (WHERE NOT compressed) AS n2, sum(rank) FILTER (WHERE compressed) AS rs FROM k{i})"""
        for i, v in enumerate((*(f"absr_{h}m" for h in FROZEN.horizons), "ldn_pct", "expansion_ratio"))
    )
    + ", t AS ("
    + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(FROZEN.horizons) + 2))
    + ") SELECT value, round(a, 12) AS mean_compressed, round(b, 12) AS mean_other, n1, n2, CASE WHEN n1 >= 20 AND n2 >= 20 THEN round((rs - n1::DOUBLE * (n1 + 1) / 2 - n1::DOUBLE * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12), 9) END AS z FROM t"
)
def sta_03_tests(spark, d):
    """Rank tests of the absolute returns at every horizon, of the London range's percentile and of the ratio."""
    flagged = cut(_flagged(spark, d))
    out = T.difference_tests(flagged, (*(f"absr_{h}m" for h in FROZEN.horizons), "ldn_pct", "expansion_ratio"))
    return out.withColumns({"mean_compressed": F.round("mean_compressed", 12), "mean_other": F.round("mean_other", 12), "z": F.round("z", 9)})


@query(
    WITH_F
    + """, s AS (SELECT *, CASE WHEN expansion_ratio > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o1, CASE WHEN expansion_ratio > 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o15 FROM flagged),
p AS (SELECT median(expansion_ratio) FILTER (WHERE compressed) - median(expansion_ratio) FILTER (WHERE NOT compressed) AS ratio_median, """
    + ", ".join(f"avg({v}) FILTER (WHERE compressed) - avg({v}) FILTER (WHERE NOT compressed) AS {n}" for v, n in (("expansion_ratio", "ratio_mean"), ("absr_60m", "r60_mean"), ("absr_180m", "r180_mean"), ("o1", "share_over"), ("o15", "share_over_15")))
    + " FROM s) SELECT statistic, round(point, 12) AS point FROM p UNPIVOT (point FOR statistic IN (ratio_median, ratio_mean, r60_mean, r180_mean, share_over, share_over_15))"
)
def bst_02_points(spark, d):
    """The joint bootstrap's point differences, through its own sums per date and medians by class."""
    return T.point_differences(_flagged(spark, d)).withColumn("point", F.round("point", 12))


@query()
def bst_02_joint_block(spark, d):
    return T.joint_block_bootstrap(_flagged(spark, d), draws=FROZEN.draws)


@query()
def bst_01_block_ci(spark, d):
    """Mean difference of the ratio, flagged rows against others, with overlapping blocks of rows."""
    return T.moving_block_interval(_flagged(spark, d), "expansion_ratio", draws=FROZEN.draws)


@query(WITH_F + "SELECT 'absr_60m' AS value, count(absr_60m) FILTER (WHERE compressed) AS n_compressed, count(absr_60m) FILTER (WHERE NOT compressed) AS n_other, round(avg(absr_60m) FILTER (WHERE compressed) - avg(absr_60m) FILTER (WHERE NOT compressed), 12) AS difference FROM flagged")
def bst_01_points(spark, d):
    """The point of the moving blocks' interval, from its running sums (one draw: the draws don't matter to it)."""
    found = T.moving_block_interval(_flagged(spark, d), "absr_60m", draws=1)
    return found.select("value", "n_compressed", "n_other", F.round("difference", 12).alias("difference"))


def _signs(flagged: DataFrame, value: str) -> dict[str, float]:
    return {r.sym: r.difference for r in T.mean_difference(flagged, value).collect()}


@query()
def gat_02_decision(spark, d):
    """The second version's verdict and its four checks."""
    flagged = _flagged(spark, d)
    found = {r.statistic: r.asDict() for r in T.joint_block_bootstrap(flagged, draws=FROZEN.draws).collect()}
    said, checks = T.decide(found, _signs(flagged, "absr_60m"))
    return spark.createDataFrame([(said, *checks.values())], "verdict string, " + ", ".join(f"{c} boolean" for c in checks))


@query()
def gat_01_decision(spark, d):
    """The first version's verdict and its five checks."""
    flagged = cut(_flagged(spark, d))
    said, checks = T.decide_first(T.summarize(flagged, FROZEN.draws), T.sign_counts(flagged, {"ratio": "expansion_ratio", "60": "absr_60m", "180": "absr_180m"}))
    return spark.createDataFrame([(said, *checks.values())], "verdict string, " + ", ".join(f"{c} boolean" for c in checks))


# --- refresh of stored months ---
_HALF = WITH_Q + ", n AS (SELECT q.*, a, z FROM q JOIN (SELECT sym, min(utc_ms) AS a, max(utc_ms) AS z FROM q GROUP BY 1) USING (sym)), old AS (SELECT * FROM n WHERE (utc_ms - a) * 10 <= (z - a) * 8), new AS (SELECT * FROM n WHERE (utc_ms - a) * 10 > (z - a) * 5)"


def _halves(spark, d):
    """The first four fifths of each sym's time as stored, and an export of the last half: they overlap."""
    q = quotes(spark, d).withColumn("yyyymm", Q.month_of())
    n = q.join(q.groupBy("sym").agg(F.min("utc_ms").alias("a"), F.max("utc_ms").alias("z")), "sym")
    return n.where("(utc_ms - a) * 10 <= (z - a) * 8").drop("a", "z"), n.where("(utc_ms - a) * 10 > (z - a) * 5").drop("a", "z")


@query(WITH_Q + "SELECT sym, utc_ms, bid, ask, count(*) AS n FROM d GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def agg_15_multiset(spark, d):
    return R.multiset(dirty_quotes(spark, d)).where("n > 1")


@query(_HALF + ", a AS (SELECT sym, utc_ms, bid, ask, count(*) AS n_old FROM old GROUP BY 1, 2, 3, 4), b AS (SELECT sym, utc_ms, bid, ask, count(*) AS n_new FROM new GROUP BY 1, 2, 3, 4) SELECT sym, utc_ms, bid, ask, n_old, coalesce(n_new, 0) AS n_new FROM a LEFT JOIN b USING (sym, utc_ms, bid, ask) WHERE coalesce(n_new, 0) < n_old")
def jn_07_lost_quotes(spark, d):
    return R.lost(*_halves(spark, d))


@query(_HALF + "SELECT sym, utc_ms, bid, ask FROM old EXCEPT ALL SELECT sym, utc_ms, bid, ask FROM new")
def set_05_except_all(spark, d):
    old, new = (x.select("sym", "utc_ms", "bid", "ask") for x in _halves(spark, d))
    return old.exceptAll(new)


@query(_HALF + ", l AS (SELECT sym, utc_ms FROM old EXCEPT SELECT sym, utc_ms FROM new) SELECT sym, count(*) AS n_times, array_to_string(list(utc_ms ORDER BY utc_ms)[1:5], ',') AS head FROM l GROUP BY 1")
def lim_02_lost_head(spark, d):
    return _lost_head(*_halves(spark, d))


@query(_HALF + ", a AS (SELECT sym, utc_ms, bid, ask, count(*) AS n FROM old GROUP BY 1, 2, 3, 4), b AS (SELECT sym, utc_ms, bid, ask, count(*) AS n FROM new GROUP BY 1, 2, 3, 4), l AS (SELECT DISTINCT a.sym, a.utc_ms FROM a LEFT JOIN b USING (sym, utc_ms, bid, ask) WHERE coalesce(b.n, 0) < a.n) SELECT sym, count(*) AS n_times, array_to_string(list(utc_ms ORDER BY utc_ms)[1:5], ',') AS head FROM l GROUP BY 1")
def lim_02_lost_times(spark, d):
    """The first times of contents that the new export has fewer times than the store."""
    return R.lost_times(*_halves(spark, d)).select("sym", "n_times", F.array_join(F.col("head").cast("array<string>"), ",").alias("head"))


def _lost_head(old, new):
    gone = old.select("sym", "utc_ms").subtract(new.select("sym", "utc_ms"))
    return gone.groupBy("sym").agg(F.count("*").alias("n_times"), F.array_join(F.slice(F.array_sort(F.collect_set("utc_ms")), 1, 5).cast("array<string>"), ",").alias("head"))


_NUM = ", om AS (SELECT *, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm FROM old), nm AS (SELECT *, CAST(strftime(make_timestamp(utc_ms * 1000), '%Y%m') AS INT) AS yyyymm FROM new), st AS (SELECT sym, yyyymm, min(utc_ms) AS s FROM nm GROUP BY 1, 2), tail AS (SELECT om.*, row_number() OVER (PARTITION BY om.sym, om.yyyymm ORDER BY utc_ms, seq) AS pos FROM om JOIN st USING (sym, yyyymm) WHERE utc_ms >= s), head AS (SELECT nm.*, row_number() OVER (PARTITION BY sym, yyyymm ORDER BY utc_ms, seq) AS pos FROM nm)"


@query(_HALF + _NUM + "SELECT sym, yyyymm, t.pos AS position, t.utc_ms AS old_utc_ms, h.utc_ms AS new_utc_ms FROM tail t LEFT JOIN head h USING (sym, yyyymm, pos) WHERE NOT coalesce(t.utc_ms = h.utc_ms AND t.bid = h.bid AND t.ask = h.ask, false)")
def jn_08_prefix_match(spark, d):
    return R.prefix_mismatches(*_halves(spark, d)).select("sym", "yyyymm", "position", "old_utc_ms", "new_utc_ms")


@query(_HALF + _NUM + ", ov AS (SELECT sym, yyyymm, count(*) AS o FROM tail GROUP BY 1, 2), la AS (SELECT sym, yyyymm, max(seq) AS l FROM om GROUP BY 1, 2) SELECT sym, yyyymm, utc_ms, bid, ask, seq FROM om UNION ALL SELECT h.sym, h.yyyymm, utc_ms, bid, ask, greatest(coalesce(l, -1), -1) + pos - coalesce(o, 0) AS seq FROM head h LEFT JOIN ov USING (sym, yyyymm) LEFT JOIN la USING (sym, yyyymm) WHERE pos > coalesce(o, 0)")
def str_04_refresh(spark, d):
    old, new = _halves(spark, d)
    return R.refresh(old, new, check=False)


@query(_HALF + _NUM + ", ov AS (SELECT sym, yyyymm, count(*) AS o FROM tail GROUP BY 1, 2), la AS (SELECT sym, yyyymm, max(seq) AS l FROM om GROUP BY 1, 2) SELECT sym, yyyymm, utc_ms, bid, ask, seq FROM om UNION ALL SELECT h.sym, h.yyyymm, utc_ms, bid, ask, greatest(coalesce(l, -1), 7) + pos - coalesce(o, 0) AS seq FROM head h LEFT JOIN ov USING (sym, yyyymm) LEFT JOIN la USING (sym, yyyymm) WHERE pos > coalesce(o, 0)")
def str_04_refresh_checked(spark, d):
    """The same with the checks on and a watermark of 7: the overlap agrees, so nothing is refused. An export that starts a month earlier than
    the stored rows would be; here it starts within them, month by month."""
    old, new = _halves(spark, d)
    begins = old.groupBy("sym", "yyyymm").agg(F.min("utc_ms").alias("_a"))
    kept = new.join(begins, ["sym", "yyyymm"], "left").where("_a IS NULL OR utc_ms >= _a").drop("_a")
    return R.refresh(old, kept, watermark=7)


# --- scalar families ---
@query("SELECT DISTINCT src_file, regexp_extract(src_file, '^([A-Z]{6})_ticks_(\\d{6})\\.csv$', 1) AS pair, CAST(regexp_extract(src_file, '^([A-Z]{6})_ticks_(\\d{6})\\.csv$', 2) AS INT) AS yyyymm FROM ticks WHERE regexp_matches(src_file, '^([A-Z]{6})_ticks_(\\d{6})\\.csv$')")
def scl_filename(spark, d):
    names = spark.read.parquet(f"{d}/ticks.parquet").select("src_file").distinct().where(F.col("src_file").rlike(S.EXPORT_NAME))
    return names.select("src_file", S.export_pair("src_file").alias("pair"), S.export_month("src_file").alias("yyyymm"))


@query("WITH g AS (SELECT DISTINCT yyyymm FROM data_gates), n AS (SELECT yyyymm, yyyymm // 100 * 12 + yyyymm % 100 - 1 AS k FROM g) SELECT yyyymm, CAST((k - 1) // 12 * 100 + (k - 1) % 12 + 1 AS INT) AS before, CAST((k + 1) // 12 * 100 + (k + 1) % 12 + 1 AS INT) AS after, epoch_us(make_date(CAST((k + 1) // 12 AS INT), CAST((k + 1) % 12 + 1 AS INT), 1)::TIMESTAMP) - 1 AS end_us FROM n")
def scl_06_pad(spark, d):
    g = spark.read.parquet(f"{d}/data_gates.parquet").select("yyyymm").distinct()
    ym = F.col("yyyymm")
    return g.select("yyyymm", S.padded_month(ym, -1).alias("before"), S.padded_month(ym, 1).alias("after"), F.unix_micros(S.month_end(ym)).alias("end_us"))


@query("WITH s AS (SELECT feed, pair, min(CAST(strptime(left(regexp_replace(london_date, '\\D', '', 'g'), 8), '%Y%m%d') AS DATE)) AS a, max(CAST(strptime(left(regexp_replace(london_date, '\\D', '', 'g'), 8), '%Y%m%d') AS DATE)) AS z FROM sessions GROUP BY 1, 2) SELECT feed, pair, array_to_string(list_transform(generate_series(date_trunc('month', a)::DATE, z, INTERVAL 1 MONTH), lambda x: strftime(x, '%Y%m')), ',') AS months FROM s")
def scl_months(spark, d):
    from tickloom.sources.tables import leading_date

    s = spark.read.parquet(f"{d}/sessions.parquet").groupBy("feed", "pair").agg(F.min(leading_date("london_date")).alias("a"), F.max(leading_date("london_date")).alias("z"))
    return s.select("feed", "pair", F.array_join(S.months_between(F.col("a"), F.col("z")).cast("array<string>"), ",").alias("months"))


@query()
def scl_p_values(spark, d):
    """z of the ratio's rank test per sym's year as a column, with its p-value from a vectorised erfc."""
    z = T.two_proportions(_flagged(spark, d), F.col("expansion_ratio") > 1).select("z")
    return z.select("z", S.two_sided_p("z").alias("p"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
