"""The shapes the quote operators work on, made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.quotes import clean
from tickloom.sources.tables import counting_sessions, number, table, usable_ticks


def dirty_quotes(spark: SparkSession, d: str) -> DataFrame:
    """sym, utc_ms, seq, tick_id, bid, ask of all ticks that have a time and both prices."""
    return usable_ticks(table(spark, d, "ticks")).select(F.concat_ws(":", "feed", "pair").alias("sym"), "utc_ms", "seq", "tick_id", "bid", "ask")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes after the cleaning step."""
    return clean(dirty_quotes(spark, d))[0]


def exported(spark: SparkSession, d: str) -> DataFrame:
    """The lines of newly exported files as quotes: sound prices only, seq being the place in the file."""
    lines = table(spark, d, "tick_exports").select(F.concat_ws(":", "feed", "pair").alias("sym"), "utc_ms", F.col("line_no").cast("bigint").alias("seq"), F.col("export_id").alias("tick_id"), number("bid").alias("bid"), number("ask").alias("ask"))
    return clean(lines.where("utc_ms IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL"))[0]


def panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per sym and day: the usable session loaded last."""
    figures = ("ldn_range", "expansion_ratio", "r_60m", "absr_15m", "absr_30m", "absr_60m", "absr_180m", "asia_hi", "asia_lo", "dst_summer")
    t = counting_sessions(table(spark, d, "sessions"), *figures)
    return t.select(F.concat_ws(":", "feed", "pair").alias("sym"), "day", "asia_range", *figures[:-1], (F.col("dst_summer") > 0).alias("dst_summer"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """sym, day, close: daily closes with long histories, made from orders."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("sym"), F.to_date("o_orderdate").alias("day")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


QUOTES_SQL = """
d AS (SELECT feed || ':' || pair AS sym, utc_ms, seq, tick_id, bid, ask FROM ticks
  WHERE utc_ms IS NOT NULL AND bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)),
q AS (SELECT * FROM d WHERE bid > 0 AND ask > 0 AND ask >= bid)
"""

def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """sym, day, high, low, close: daily bars with long histories, made from orders."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("sym"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"))


EXPORTED_SQL = """,
x AS (SELECT feed || ':' || pair AS sym, utc_ms, line_no AS seq, export_id AS tick_id, bid, ask FROM tick_exports
  WHERE utc_ms IS NOT NULL AND NOT isnan(bid) AND NOT isnan(ask) AND bid > 0 AND ask > 0 AND ask >= bid)
"""

PANEL_SQL = """
u AS (SELECT feed || ':' || upper(regexp_replace(pair, '[^A-Za-z]', '', 'g')) AS sym,
    CAST(strptime(left(regexp_replace(london_date, '\\D', '', 'g'), 8), '%Y%m%d') AS DATE) AS day, * EXCLUDE (pair)
  FROM sessions WHERE valid AND asia_range IS NOT NULL AND NOT isnan(asia_range) AND asia_range > 0),
pick AS (SELECT sym, day, max((loaded_at, session_id)) AS m FROM u GROUP BY 1, 2),
panel AS (SELECT u.sym, u.day, asia_range, dst_summer, asia_hi, asia_lo, """ + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("ldn_range", "expansion_ratio", "r_60m", "absr_15m", "absr_30m", "absr_60m", "absr_180m")) + """
  FROM u JOIN pick ON u.sym = pick.sym AND u.day = pick.day AND u.loaded_at = pick.m[1] AND u.session_id = pick.m[2])
"""

FLAGGED_SQL = PANEL_SQL + """,
seen AS (SELECT *, list(asia_range) FILTER (WHERE asia_range IS NOT NULL) OVER w AS la, list(ldn_range) FILTER (WHERE ldn_range IS NOT NULL) OVER w AS ll
  FROM panel WINDOW w AS (PARTITION BY sym ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
flagged0 AS (SELECT * EXCLUDE (la, ll),
  CASE WHEN len(la) = 60 THEN (len(list_filter(la, lambda x: x < asia_range)) + 0.5::DOUBLE * len(list_filter(la, lambda x: x = asia_range))) / 60.0::DOUBLE END AS comp_pct,
  CASE WHEN len(ll) = 60 AND ldn_range IS NOT NULL THEN (len(list_filter(ll, lambda x: x < ldn_range)) + 0.5::DOUBLE * len(list_filter(ll, lambda x: x = ldn_range))) / 60.0::DOUBLE END AS ldn_pct FROM seen),
flagged AS (SELECT *, coalesce(comp_pct <= 0.30::DOUBLE, false) AS compressed FROM flagged0 WHERE comp_pct IS NOT NULL)
"""

OHLC_SQL = """
ohlc AS (SELECT o_orderpriority AS sym, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2)
"""

DAILY_SQL = """
daily AS (SELECT o_orderpriority AS sym, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2)
"""
