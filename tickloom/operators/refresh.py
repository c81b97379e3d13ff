"""Refreshing a stored month with a new export: multiset, prefix and sequence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("sym", "yyyymm")
QUOTE = ("utc_ms", "bid", "ask")


class Conflict(ValueError):
    """The export contradicts what is stored."""


def multiset(quotes: DataFrame) -> DataFrame:
    """How often each (time, bid, ask) occurs per sym."""
    return quotes.groupBy("sym", *QUOTE).agg(F.count("*").alias("n"))


def lost(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contents that the new set has fewer times than the old one, with both counts."""
    a, b = multiset(old).withColumnRenamed("n", "n_old"), multiset(new).withColumnRenamed("n", "n_new")
    return a.join(b, ["sym", *QUOTE], "left").select("sym", *QUOTE, "n_old", F.coalesce("n_new", F.lit(0)).cast("bigint").alias("n_new")).where("n_new < n_old")


def lost_times(old: DataFrame, new: DataFrame, head: int = 5) -> DataFrame:
    """Per sym, the first times of lost contents: a short list for a message."""
    return lost(old, new).groupBy("sym").agg(F.count_distinct("utc_ms").alias("n_times"), F.slice(F.array_sort(F.collect_set("utc_ms")), 1, head).alias("head"))


def _numbered(quotes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("utc_ms", "seq")
    return quotes.withColumn("_at", F.row_number().over(w))


def prefix_mismatches(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Positions at which the stored tail, from the export's first time on, differs from the export's beginning.

    Positional, row by row: repeated quotes are legal, so no key identifies a row. Work is per (sym, month), which is the
    unit of storage and bounds a task; other months aren't read.
    """
    start = new.groupBy(*keys).agg(F.min("utc_ms").alias("_start"))
    tail = old.join(start, list(keys)).where(F.col("utc_ms") >= F.col("_start")).drop("_start")
    a = _numbered(tail, keys).select(*keys, "_at", *[F.col(c).alias(f"old_{c}") for c in QUOTE])
    b = _numbered(new, keys).select(*keys, "_at", *[F.col(c).alias(f"new_{c}") for c in QUOTE])
    both = a.join(b, [*keys, "_at"], "left")
    same = F.lit(True)
    for c in QUOTE:
        same &= F.coalesce(F.col(f"old_{c}") == F.col(f"new_{c}"), F.lit(False))
    return both.where(~same).select(*keys, F.col("_at").alias("position"), *[f"{s}_{c}" for c in QUOTE for s in ("old", "new")])


def refresh(old: DataFrame, new: DataFrame, watermark: int = -1, keys: tuple[str, ...] = KEY, check: bool = True) -> DataFrame:
    """Stored rows followed by the export's rows beyond the overlap, numbered on from the larger of the stored maximum and ``watermark``.

    The overlap (stored rows from the export's first time on) must equal the export's beginning in order; an export that starts
    before the stored rows or contradicts them raises Conflict. Refreshing twice with one export changes nothing. Both
    empty: empty. ``watermark`` is a sequence number, not a time.
    """
    if check:
        begins = old.groupBy(*keys).agg(F.min("utc_ms").alias("_a")).join(new.groupBy(*keys).agg(F.min("utc_ms").alias("_b")), list(keys)).where("_b < _a")
        if not begins.isEmpty():
            raise Conflict("the export starts before the stored rows")
        if not prefix_mismatches(old, new, keys).isEmpty():
            raise Conflict("the export contradicts the stored order")
    start = new.groupBy(*keys).agg(F.min("utc_ms").alias("_start"))
    overlap = old.join(start, list(keys)).where(F.col("utc_ms") >= F.col("_start")).groupBy(*keys).agg(F.count("*").alias("_overlap"))
    last = old.groupBy(*keys).agg(F.max("seq").alias("_last"))
    fresh = _numbered(new, keys).join(overlap, list(keys), "left").join(last, list(keys), "left").na.fill(0, ["_overlap"])
    fresh = fresh.where(F.col("_at") > F.col("_overlap")).withColumn("seq", F.greatest(F.coalesce("_last", F.lit(-1)), F.lit(watermark)) + F.col("_at") - F.col("_overlap"))
    return old.select(*keys, *QUOTE, "seq").unionByName(fresh.select(*keys, *QUOTE, "seq"))


def recover(old: DataFrame, new: DataFrame, allow_loss: bool = False) -> tuple[DataFrame, int]:
    """Rebuild from a full export: (rows in the export's order, quotes lost). Raises Conflict on any loss unless allowed."""
    gone = lost(old, new).agg(F.sum(F.col("n_old") - F.col("n_new")).alias("n")).first()["n"] or 0
    if gone and not allow_loss:
        raise Conflict(f"{gone} stored quotes are missing from the export")
    return new, int(gone)


def first_per_session(sessions: DataFrame) -> DataFrame:
    """One row per (sym, london_date): the one that came first in the order of months. ``sessions`` has a yyyymm column, the month whose run gave the row."""
    rest = [c for c in sessions.columns if c not in ("sym", "london_date")]
    kept = sessions.groupBy("sym", "london_date").agg(F.min_by(F.struct(*rest), F.struct("yyyymm")).alias("_row"))
    return kept.select(*[F.col(c) if c not in rest else F.col(f"_row.{c}").alias(c) for c in sessions.columns])
