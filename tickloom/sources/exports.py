"""Tick files: monthly CSV exports, the month-partitioned store, and older layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import EXPORT_NAME, export_month, export_pair
from tickloom.governance import mark_shards
from tickloom.operators.quotes import dedup_consecutive
from tickloom.operators.refresh import Conflict, lost
from tickloom.session import cut
from tickloom.sources.tables import number

EXPORT = T.StructType([T.StructField("utc_ms", T.LongType()), T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType())])
STORE = T.StructType([*EXPORT.fields, T.StructField("seq", T.LongType()), T.StructField("sym", T.StringType()), T.StructField("yyyymm", T.IntegerType())])


def located(df: DataFrame) -> DataFrame:
    """Pair and month from the file's name, and where in the file a split begins."""
    name = F.col("_metadata.file_name")
    df = df.select("*", export_pair(name).alias("sym"), export_month(name).alias("file_month"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return df.where("sym IS NOT NULL")


def in_place(df: DataFrame) -> DataFrame:
    """Number rows in the order in which their split has them, so arrival order survives splitting."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def read_exports(spark: SparkSession, path: str, pairs: list[str] | None = None, strict: bool = True) -> DataFrame:
    """All export files under a directory: sym, yyyymm, utc_ms, bid, ask, seq, tick_id.

    A header is skipped; with ``strict`` a malformed line fails the read, otherwise it is dropped. The month is that of the
    timestamp, not of the file: exports overlap the next month's first minute. Consecutive equal quotes collapse, and seq
    numbers each (sym, month) from 0 in order of time, then file, then place in the file.
    """
    df = spark.read.schema(EXPORT).option("header", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("pathGlobFilter", "*_ticks_*.csv").csv(path)
    df = in_place(located(df))
    if pairs is not None:
        df = df.where(F.col("sym").isin([p.strip().upper() for p in pairs]))
    return numbered(df, ("file_month", "_file", "_block", "_row"))


def numbered(df: DataFrame, arrival: tuple[str, ...]) -> DataFrame:
    """Assign months by timestamp, collapse consecutive equal quotes and number what stays, per (sym, month)."""
    df = df.withColumn("yyyymm", F.date_format(F.timestamp_millis("utc_ms"), "yyyyMM").cast("int"))
    w = Window.partitionBy("sym", "yyyymm").orderBy("utc_ms", *arrival)
    df = df.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).withColumn("tick_id", F.col("seq"))
    kept = dedup_consecutive(df.select("sym", "yyyymm", "utc_ms", "bid", "ask", "seq", "tick_id"))
    again = Window.partitionBy("sym", "yyyymm").orderBy("utc_ms", "seq")
    return kept.withColumn("seq", (F.row_number().over(again) - 1).cast("bigint")).withColumn("tick_id", F.col("seq"))


def read_exports_last_wins(spark: SparkSession, path: str) -> DataFrame:
    """The older reader: malformed lines are dropped and of several quotes in a millisecond the last one stays."""
    df = in_place(located(spark.read.schema(EXPORT).option("header", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*_ticks_*.csv").csv(path)))
    w = Window.partitionBy("sym", "utc_ms").orderBy(F.desc("file_month"), F.desc("_file"), F.desc("_block"), F.desc("_row"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("sym", "utc_ms", "bid", "ask")


def from_storage(df: DataFrame) -> DataFrame:
    """utc_ms, seq, bid, ask from the store's layout or the older one (a timestamp column and no seq); anything else raises ValueError.
    Values that aren't numbers become NULL."""
    as_long = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    prices = [number(F.expr(f"try_cast({c} AS DOUBLE)")).alias(c) for c in ("bid", "ask")]
    if {"utc_ms", "seq", "bid", "ask"} <= set(df.columns):
        return df.select(as_long("utc_ms").alias("utc_ms"), as_long("seq").alias("seq"), *prices)
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)]
    if len(times) == 1 and {"bid", "ask"} <= set(df.columns):
        place = F.col("_metadata.row_index") if "row_index" not in df.columns else F.col("row_index")
        return df.select(F.unix_millis(F.col(times[0]).cast("timestamp")).alias("utc_ms"), place.cast("bigint").alias("seq"), *prices)
    raise ValueError(f"unknown tick layout: {df.columns}")


def to_storage(df: DataFrame) -> DataFrame:
    return df.select("utc_ms", "seq", "bid", "ask", "sym", "yyyymm")


def write_store(df: DataFrame, root: str) -> None:
    """Overwrite just the (sym, month) partitions that ``df`` has, sorted by time and seq."""
    out = to_storage(df).repartition("sym", "yyyymm").sortWithinPartitions("sym", "yyyymm", "utc_ms", "seq")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sym", "yyyymm").parquet(root)


def read_store(spark: SparkSession, root: str, pair: str | None = None, first_ms: int | None = None, last_ms: int | None = None, pad_months: int = 0, required: bool = False) -> DataFrame:
    """The store, or a closed time range of one pair, or that with ``pad_months`` whole months more on either side.

    The range also becomes a filter on the month, so only its directories are opened. With ``required``, a pair that the store
    doesn't have raises LookupError.
    """
    df = spark.read.schema(STORE).parquet(root)
    if pair is not None:
        df = df.where(F.col("sym") == pair)
        if required and df.select("sym").limit(1).isEmpty():
            raise LookupError(f"the store has no {pair}")
    day = lambda ms: F.timestamp_millis(F.lit(ms))
    month = lambda ms, pad: F.date_format(F.add_months(day(ms), pad), "yyyyMM").cast("int")
    if first_ms is not None:
        low = F.lit(first_ms) if not pad_months else F.unix_millis(F.date_trunc("month", F.add_months(day(first_ms), -pad_months)))
        df = df.where((F.col("yyyymm") >= month(first_ms, -pad_months)) & (F.col("utc_ms") >= low))
    if last_ms is not None:
        df = df.where(F.col("yyyymm") <= month(last_ms, pad_months))
        df = df.where(F.col("utc_ms") <= last_ms) if not pad_months else df.where(F.col("utc_ms") < F.unix_millis(F.date_trunc("month", F.add_months(day(last_ms), pad_months + 1))))
    return df


def write_pairs(df: DataFrame, root: str) -> None:
    """The simple store: one directory per pair."""
    df.repartition("sym").sortWithinPartitions("sym", "utc_ms", "seq").write.mode("overwrite").partitionBy("sym").parquet(root)


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def stored_months(spark: SparkSession, root: str, pair: str) -> list[int]:
    """The months a pair has in the store, from its directories: no data are read."""
    months = read_store(spark, root, pair).select("yyyymm").distinct()
    return sorted(r.yyyymm for r in months.collect())


def recover_store(spark: SparkSession, exports: str, root: str, pairs: list[str] | None = None, allow_loss: bool = False) -> dict[str, dict]:
    """Rebuild the stored months that full exports cover, in the exports' order, and note it in the store's manifest.

    Every stored quote must be in the export as often as it is stored; else Conflict is raised and nothing is changed, unless ``allow_loss``,
    which records per month how many are lost, of how many contents, and the first times. Exports without any quote raise Conflict.
    Returns the marks per ``sym/yyyymm``.
    """
    new = cut(read_exports(spark, exports, pairs))
    months = new.groupBy("sym", "yyyymm").agg(F.count("*").alias("rows"))
    counted = {f"{r.sym}/{r.yyyymm}": r.rows for r in months.collect()}  # one row per pair and month
    if not counted:
        raise Conflict("the exports hold no quotes")
    old = read_store(spark, root).join(months.select("sym", "yyyymm"), ["sym", "yyyymm"], "left_semi")
    gone = lost(old, new).withColumn("yyyymm", F.date_format(F.timestamp_millis("utc_ms"), "yyyyMM").cast("int"))
    gone = gone.groupBy("sym", "yyyymm").agg(F.sum(F.col("n_old") - F.col("n_new")).alias("lost"), F.count("*").alias("contents"), F.slice(F.array_sort(F.collect_set("utc_ms")), 1, 5).alias("head")).collect()
    if gone and not allow_loss:
        raise Conflict("; ".join(f"{r.lost} stored quotes of {r.sym}/{r.yyyymm} are missing from the export" for r in gone))
    marks = {k: {"rebuilt_rows": n, "chronology": "source-arrival"} for k, n in counted.items()}
    for r in gone:
        marks[f"{r.sym}/{r.yyyymm}"] |= {"lost_occurrences": r.lost, "distinct_lost_quotes": r.contents, "lost_ms": list(r.head)}
    write_store(new, root)
    mark_shards(spark, root, marks)
    return marks


def normalize_store(spark: SparkSession, old: dict[str, str], root: str) -> dict[str, dict]:
    """Rewrite older shards (pair to path) in the store's layout. Their order within a millisecond is lost, which the returned marks say, month by month."""
    marks = {}
    for pair, path in sorted(old.items()):
        df = from_storage(spark.read.parquet(path)).withColumn("sym", F.lit(pair)).withColumn("yyyymm", F.date_format(F.timestamp_millis("utc_ms"), "yyyyMM").cast("int"))
        write_store(df, root)
        marks |= {f"{pair}/{m}": {"chronology": "recovered-unordered"} for m in stored_months(spark, root, pair)}
    mark_shards(spark, root, marks)
    return marks


__all__ = ["EXPORT", "EXPORT_NAME", "STORE", "from_storage", "in_place", "located", "normalize_store", "numbered", "read_exports", "read_exports_last_wins", "read_pairs", "read_store", "recover_store", "stored_months", "to_storage", "write_pairs", "write_store"]
