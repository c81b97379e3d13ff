"""Readers for the tables the queries run on, with the normalisations every operator relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = ("feed", "pair")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(c: Column | str) -> Column:
    """A double whose missing values are all NULL: NaN sorts above every number in Spark and poisons sums."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(c: Column | str) -> Column:
    """The same without infinities."""
    c = number(c)
    return F.when(F.abs(c) < float("inf"), c)


def usable_ticks(ticks: DataFrame, *more: str) -> DataFrame:
    """Ticks that have a time and both prices. Only the named columns are kept, so extra columns never clash."""
    return ticks.select(*SOURCE, "tick_id", "utc_ms", "seq", number("bid").alias("bid"), number("ask").alias("ask"), *more).where(
        "utc_ms IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL"
    )


def with_pip(df: DataFrame, quote_sources: DataFrame) -> DataFrame:
    """Add each source's pip size. Sources without one keep NULL. Spark picks the join by the measured size of the source list."""
    pips = quote_sources.groupBy(*SOURCE).agg(F.max(number("pip")).alias("pip"))
    return df.join(pips, [*SOURCE], "left")


def six_capitals(pair: Column | str) -> Column:
    """``eur/usd`` and ``EURUSD`` are one pair."""
    return F.upper(F.regexp_replace(pair, "[^A-Za-z]", ""))


def leading_date(text: Column | str) -> Column:
    """The date at the start of any form that begins with year, month and day; NULL if there is none."""
    digits = F.regexp_extract(F.trim(text), r"^(\d{4})\D?(\d{2})\D?(\d{2})", 0)
    return F.to_date(F.try_to_timestamp(F.regexp_replace(digits, r"\D", ""), F.lit("yyyyMMdd")))


def counting_sessions(sessions: DataFrame, *figures: str) -> DataFrame:
    """One row per source and London date: the usable session that was loaded last.

    Usable: valid, with an asia_range that is present and above 0. Of equally late rows the larger session_id counts.
    Returns feed, pair (six capitals), day (DATE), asia_range and the named figures (NaN as NULL).
    """
    kept = [number(c).alias(c) for c in ("asia_range", *figures)]
    rows = sessions.where("valid").select("feed", six_capitals("pair").alias("pair"), leading_date("london_date").alias("day"), "loaded_at", "session_id", *kept)
    rows = rows.where("asia_range > 0 AND day IS NOT NULL")
    best = F.max_by(F.struct("asia_range", *figures), F.struct("loaded_at", "session_id"))
    return rows.groupBy("feed", "pair", "day").agg(best.alias("best")).select("feed", "pair", "day", "best.*")
