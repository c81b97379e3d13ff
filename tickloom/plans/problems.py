"""The queries of the general problems 1, 2 and 6, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.regular_grid import regular_series
from tickloom.operators.rolling import trailing_totals
from tickloom.operators.spikes import count_cases, quote_cases
from tickloom.sources.tables import SOURCE, counting_sessions, table, usable_ticks

WEEK_SHARE = 0.4871


def _asia(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(counting_sessions(table(spark, d, "sessions")), SOURCE, "day", "asia_range", (7, 30))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    days = _asia(spark, d).where((F.col("span_day") >= 30) & (F.col("total_7") > WEEK_SHARE * F.col("total_30")))
    return days.select("feed", "pair", F.date_format("day", "yyyy-MM-dd").alias("london_date"))


def p1_trailing(spark: SparkSession, d: str) -> DataFrame:
    days = _asia(spark, d)
    return days.select("feed", "pair", F.date_format("day", "yyyy-MM-dd").alias("london_date"), *[F.round(c, 9).alias(c) for c in ("total_7", "avg_7", "total_30", "avg_30")], "days_7", "days_30")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return regular_series(usable_ticks(table(spark, d, "ticks")), SOURCE, "utc_ms", ("bid", "ask")).withColumnRenamed("cell_ms", "bar_ms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The bars that the regression has filled, with enough support for both fits, or marked as missing, without a fit."""
    filled = "status = 'filled' AND support >= 1.5 AND bid_fit IS NOT NULL AND ask_fit IS NOT NULL"
    missing = "status = 'missing' AND bid_fit IS NULL AND ask_fit IS NULL"
    return _bars(spark, d).where(f"{filled} OR {missing}").select("feed", "pair", "bar_ms")


def p2_series(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("feed", "pair", "bar_ms", "n", F.round("support", 6).alias("support"), F.round("bid_fit", 6).alias("bid_fit"), F.round("ask_fit", 6).alias("ask_fit"), "status")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    quotes = quote_cases(table(spark, d, "ticks"), table(spark, d, "quote_sources")).select(F.lit("ticks").alias("tbl"), F.col("tick_id").alias("row_id"))
    gates = count_cases(table(spark, d, "data_gates")).select(F.lit("data_gates").alias("tbl"), F.col("gate_id").alias("row_id"))
    return quotes.unionByName(gates).distinct()


def p6_gates(spark: SparkSession, d: str) -> DataFrame:
    return count_cases(table(spark, d, "data_gates"))


def p6_prices_and_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The cases that need no forecast, with their reasons: what SQL can state of the quotes' cases."""
    return quote_cases(table(spark, d, "ticks"), table(spark, d, "quote_sources")).where("reason <> 'excursion'")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_trailing, p2_found, p2_series, p6_found, p6_gates, p6_prices_and_stuck)}


_SESSIONS = """
WITH usable AS (
  SELECT feed, upper(regexp_replace(pair, '[^A-Za-z]', '', 'g')) AS pair,
         CAST(strptime(left(regexp_replace(london_date, '\\D', '', 'g'), 8), '%Y%m%d') AS DATE) AS day, asia_range, loaded_at, session_id
  FROM sessions WHERE valid AND asia_range IS NOT NULL AND NOT isnan(asia_range) AND asia_range > 0),
daily AS (SELECT feed, pair, day, arg_max(asia_range, (loaded_at, session_id)) AS v FROM usable GROUP BY 1, 2, 3),
span AS (SELECT feed, pair, min(day) AS first, max(day) AS last FROM daily GROUP BY 1, 2),
cal AS (SELECT feed, pair, first, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
filled AS (SELECT c.feed, c.pair, c.first, c.day, d.v FROM cal c LEFT JOIN daily d USING (feed, pair, day)),
rolled AS (SELECT feed, pair, first, day,
    coalesce(sum(v) OVER w7, 0) AS total_7, avg(v) OVER w7 AS avg_7, count(v) OVER w7 AS days_7,
    coalesce(sum(v) OVER w30, 0) AS total_30, avg(v) OVER w30 AS avg_30, count(v) OVER w30 AS days_30
  FROM filled WINDOW w7 AS (PARTITION BY feed, pair ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                    w30 AS (PARTITION BY feed, pair ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

_BARS = """
WITH t AS (SELECT feed, pair, utc_ms, bid, ask FROM ticks
  WHERE utc_ms IS NOT NULL AND bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)),
b AS (SELECT feed, pair, (utc_ms // 300000) * 300000 AS bar_ms, count(*) AS n, avg(bid) AS mb, avg(ask) AS ma FROM t GROUP BY 1, 2, 3),
s AS (SELECT feed, pair, bar_ms // 86400000 AS day, min(bar_ms) AS a, max(bar_ms) AS z FROM b GROUP BY 1, 2, 3),
grid AS (SELECT feed, pair, unnest(generate_series(a, z, 300000)) AS bar_ms FROM s)
"""


_GATES = """
WITH g AS (SELECT gate_id, feed, pair, yyyymm, total_ticks, 'negative_spread' AS field, negative_spread AS n FROM data_gates
  UNION ALL SELECT gate_id, feed, pair, yyyymm, total_ticks, 'jump_gt_2pct', jump_gt_2pct FROM data_gates),
m AS (SELECT feed, pair, field, quantile_cont(n, 0.5) AS usual FROM g GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY feed, pair ORDER BY yyyymm) AS place FROM (SELECT DISTINCT feed, pair, yyyymm FROM data_gates)),
s AS (SELECT DISTINCT feed, pair, field, n, yyyymm, place FROM g JOIN r USING (feed, pair, yyyymm) WHERE n > 0),
i AS (SELECT *, place - row_number() OVER (PARTITION BY feed, pair, field, n ORDER BY yyyymm) AS island FROM s),
l AS (SELECT *, count(*) OVER (PARTITION BY feed, pair, field, n, island) AS months FROM i)
SELECT gate_id, field, 'impossible' AS reason FROM g WHERE n < 0 OR n > total_ticks
UNION ALL SELECT gate_id, field, 'spike' FROM g JOIN m USING (feed, pair, field) WHERE n > 200 AND n > 20 * usual
UNION ALL SELECT gate_id, field, 'stuck' FROM g JOIN l USING (feed, pair, field, n, yyyymm) WHERE months >= 5
"""

_STUCK = """
WITH t AS (SELECT feed, pair, utc_ms, seq, tick_id, bid, ask FROM ticks
  WHERE utc_ms IS NOT NULL AND bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)),
s AS (SELECT *, CASE WHEN bid = lag(bid) OVER w AND utc_ms - lag(utc_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS nb,
  CASE WHEN ask = lag(ask) OVER w AND utc_ms - lag(utc_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS na
  FROM t WINDOW w AS (PARTITION BY feed, pair ORDER BY utc_ms, seq, tick_id)),
r AS (SELECT *, sum(nb) OVER w AS rb, sum(na) OVER w AS ra FROM s WINDOW w AS (PARTITION BY feed, pair ORDER BY utc_ms, seq, tick_id)),
l AS (SELECT *, count(*) OVER b AS cb, max(utc_ms) OVER b - min(utc_ms) OVER b AS db, count(*) OVER a AS ca, max(utc_ms) OVER a - min(utc_ms) OVER a AS da
  FROM r WINDOW b AS (PARTITION BY feed, pair, rb), a AS (PARTITION BY feed, pair, ra))
SELECT tick_id, 'price' AS reason FROM t WHERE bid <= 0 OR ask <= 0 OR ask < bid
UNION ALL SELECT tick_id, 'stuck_bid' FROM l WHERE cb >= 30 AND db >= 1200000
UNION ALL SELECT tick_id, 'stuck_ask' FROM l WHERE ca >= 30 AND da >= 1200000
"""


def oracle_sql() -> dict[str, str]:
    fit = "CASE WHEN coalesce(b.n, 0) > 0 OR k.support >= 1.5 THEN round(coalesce(CASE WHEN s0*s2 - s1*s1 > 1e-6*s0*s0 THEN (s2*{c}0 - s1*{c}1) / (s0*s2 - s1*s1) END, CASE WHEN s0 > 0 THEN {c}0 / s0 END, b.m{c}), 6) END AS {n}_fit"
    return {
        "p1_found": _SESSIONS + f"SELECT feed, pair, strftime(day, '%Y-%m-%d') AS london_date FROM rolled WHERE day >= first + 29 AND total_7 > {WEEK_SHARE} * total_30",
        "p1_trailing": _SESSIONS + "SELECT feed, pair, strftime(day, '%Y-%m-%d') AS london_date, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("total_7", "avg_7", "total_30", "avg_30")) + ", days_7, days_30 FROM rolled",
        "p6_gates": _GATES,
        "p6_prices_and_stuck": _STUCK,
        "p2_found": _BARS + "SELECT g.feed, g.pair, g.bar_ms FROM grid g ANTI JOIN b USING (feed, pair, bar_ms)",
        "p2_series": _BARS + """, near AS (
  SELECT g.feed, g.pair, g.bar_ms, (t.utc_ms - (g.bar_ms + 150000)) / 450000.0 AS u, t.bid, t.ask FROM grid g JOIN t
  ON t.feed = g.feed AND t.pair = g.pair AND t.utc_ms BETWEEN g.bar_ms - 300000 AND g.bar_ms + 600000),
kernel AS (SELECT feed, pair, bar_ms, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w)*sum(w)/sum(w*w) AS support,
  sum(w*bid) AS b0, sum(w*u*bid) AS b1, sum(w*ask) AS a0, sum(w*u*ask) AS a1
  FROM (SELECT *, 1 - u*u AS w FROM near) WHERE w > 0 GROUP BY 1, 2, 3)
SELECT g.feed, g.pair, g.bar_ms, CAST(coalesce(b.n, 0) AS BIGINT) AS n, round(coalesce(k.support, 0), 6) AS support,
  """ + fit.format(c="b", n="bid") + ", " + fit.format(c="a", n="ask") + """,
  CASE WHEN b.n > 0 THEN 'observed' WHEN k.support >= 1.5 THEN 'filled' ELSE 'missing' END AS status
FROM grid g LEFT JOIN b USING (feed, pair, bar_ms) LEFT JOIN kernel k USING (feed, pair, bar_ms)""",
    }
