"""Streams of quotes: tumbling bars, sliding windows, sessions between gaps, and ingest with per-file isolation."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import is_export_name
from tickloom.operators.refresh import Conflict, refresh
from tickloom.session import cut, remove_path, scratch_path
from tickloom.sources.exports import STORE, read_exports, read_store, write_store
from tickloom.sources.tables import number


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the tick table's files. A path to one file is read through its directory."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        stream = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    else:
        stream = reader.parquet(path)
    ok = "utc_ms IS NOT NULL AND bid > 0 AND ask >= bid"
    return stream.select(F.concat_ws(":", "feed", "pair").alias("sym"), F.timestamp_millis("utc_ms").alias("ts"), "utc_ms", "seq", "tick_id", number("bid").alias("bid"), number("ask").alias("ask")).where(ok)


#: The time of the row that closes a drained stream: later than any quote, so every window of quotes ends before it.
CLOSING_MS = 253_370_764_800_000


def tumbling(stream: DataFrame, minutes: int = 5, lateness: str = "1 day") -> DataFrame:
    """Bars with a watermark. Quotes later than the lateness are dropped from bars only; ingest never drops them."""
    at = F.struct("utc_ms", "seq", "tick_id")
    w = stream.withWatermark("ts", lateness).groupBy("sym", F.window("ts", f"{minutes} minutes"))
    out = w.agg(F.min_by("bid", at).alias("bid_o"), F.max("bid").alias("bid_h"), F.min("bid").alias("bid_l"), F.max_by("bid", at).alias("bid_c"), F.count("*").alias("n_ticks"))
    return out.select("sym", F.unix_millis("window.start").alias("bar_ms"), "bid_o", "bid_h", "bid_l", "bid_c", "n_ticks")


def sliding(stream: DataFrame, minutes: int = 60, every: int = 15, lateness: str = "1 day") -> DataFrame:
    w = stream.withWatermark("ts", lateness).groupBy("sym", F.window("ts", f"{minutes} minutes", f"{every} minutes"))
    return w.agg(F.max("bid").alias("bid_h"), F.min("bid").alias("bid_l"), F.count("*").alias("n_ticks")).select("sym", F.unix_millis("window.start").alias("from_ms"), "bid_h", "bid_l", "n_ticks")


def between_gaps(stream: DataFrame, gap: str = "60 minutes", lateness: str = "1 day") -> DataFrame:
    """Activity sessions: maximal stretches without a gap of more than ``gap``."""
    w = stream.withWatermark("ts", lateness).groupBy("sym", F.session_window("ts", gap))
    return w.agg(F.min("utc_ms").alias("from_ms"), F.max("utc_ms").alias("to_ms"), F.count("*").alias("n_ticks")).select("sym", "from_ms", "to_ms", "n_ticks")


def drained(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Run ``shape(stream)`` over all that is there now, in append mode, and return the rows written in the shared folder.

    Each window is written once, when the watermark has passed it, and leaves the state. The windows that the watermark still holds
    back at the end are closed by a second run over one closing row, which only comes after everything else.
    """
    spark = stream.sparkSession
    out, state, late = (scratch_path(spark, f"{label}{x}") for x in ("", "-state", "-closing"))
    closing = spark.createDataFrame([("", CLOSING_MS)], "sym string, utc_ms bigint").withColumn("ts", F.timestamp_millis("utc_ms"))
    closing = closing.select(*[F.col(f.name) if f.name in ("sym", "ts", "utc_ms") else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema])
    closing.limit(0).write.parquet(late)
    result = shape(stream.unionByName(spark.readStream.schema(closing.schema).parquet(late)))
    for last in (False, True):
        if last:
            closing.write.mode("append").parquet(late)
        run = result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    for path in (state, late):
        remove_path(spark, path)
    return spark.read.schema(result.schema).parquet(out)


class Sweep:
    """What one pass over an inbox did, by file: rows stored for those taken in, reasons for those refused, and those left for later."""

    def __init__(self):
        self.taken: dict[str, int] = {}
        self.refused: dict[str, str] = {}
        self.young: list[str] = []

    def awaitTermination(self, timeout: float | None = None) -> bool:
        """A pass is over when it returns; for callers that wait for either kind of run."""
        return True


def sweep_exports(spark: SparkSession, inbox: str, store: str, on_conflict: Callable[[str, str], None], idle_seconds: float = 120, most: int | None = None, pairs: list[str] | None = None, archive: str | None = None) -> Sweep:
    """One pass: take the inbox's export files into the store, oldest first, at most ``most``, each on its own.

    Per file: read, compare with the stored month, append what is new, write the month back. Only then is the file done: it is
    moved to ``archive`` or, without one, remembered by name, length and time in the store's ``_taken`` folder, so it isn't read
    again. A file younger than ``idle_seconds`` may still be written and is left for a later pass. Whatever goes wrong with a file is
    reported to ``on_conflict`` (file, reason), the file stays where it is, and the others go on. Contradictions and malformed files are
    reported once until the file changes; after other errors it is tried again in the next pass. A pass that breaks off between
    storing and moving takes the file once more, which changes nothing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(inbox).getFileSystem(conf)
    done = Sweep()
    if not files.exists(path(inbox)):
        return done
    wanted = {p.strip().upper() for p in pairs} if pairs else None
    found = [f for f in files.listStatus(path(inbox)) if f.isFile() and is_export_name(f.getPath().getName())]
    found = sorted((f.getModificationTime(), f.getPath().toString(), f.getLen()) for f in found if wanted is None or f.getPath().getName()[:6] in wanted)
    known = path(f"{store}/_taken")
    ledger = known.getFileSystem(conf)
    for modified, file, size in found:
        if most is not None and len(done.taken) >= most:
            break
        if time.time() - modified / 1000 < idle_seconds:
            done.young.append(file)
            continue
        entry = path(known, hashlib.sha256(f"{file}:{modified}:{size}".encode()).hexdigest())
        if ledger.exists(entry):
            continue
        try:
            done.taken[file] = take_in(spark, read_exports(spark, file), store)
            if archive:
                files.mkdirs(path(archive))
                target = path(archive, path(file).getName())
                if files.exists(target):  # an earlier export of the same month
                    target = path(archive, f"{path(file).getName()}.{modified}")
                if not files.rename(path(file), target):
                    raise OSError(f"can't move it to {target.toString()}")
            else:
                ledger.create(entry, True).close()
        except Exception as why:
            done.refused[file] = str(why)
            if isinstance(why, Conflict) or "MALFORMED" in str(why).upper():
                ledger.create(entry, True).close()
            on_conflict(file, str(why))
    return done


def watch_exports(spark: SparkSession, inbox: str, store: str, on_conflict: Callable[[str, str], None], idle_seconds: float = 120, files_per_trigger: int = 16, once: bool = True, archive: str | None = None, pairs: list[str] | None = None, every: str = "30 seconds"):
    """Passes of ``sweep_exports``: one, at once, or one at every tick of a clock stream until the returned query is stopped.

    The stream is only the clock, so a file that is left in the inbox (young, refused, beyond ``files_per_trigger``) comes up again in
    the next pass, and what has been taken in is known from the store and the archive, across restarts.
    """
    if once:
        return sweep_exports(spark, inbox, store, on_conflict, idle_seconds, None, pairs, archive)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def pass_over(_: DataFrame, __: int) -> None:
        sweep_exports(spark, inbox, store, on_conflict, idle_seconds, files_per_trigger, pairs, archive)

    return clock.writeStream.foreachBatch(pass_over).option("checkpointLocation", f"{store}/_clock").trigger(processingTime=every).start()


def take_in(spark: SparkSession, new: DataFrame, store: str, watermark: int = -1) -> int:
    """Refresh the stored months that ``new`` touches; returns the rows stored in them. Raises Conflict and changes nothing if they disagree."""
    months = new.select("sym", "yyyymm").distinct()
    try:
        old = read_store(spark, store).join(months, ["sym", "yyyymm"], "left_semi").select("sym", "yyyymm", "utc_ms", "bid", "ask", "seq")
        old.isEmpty()
    except Exception as why:  # no store yet
        if "PATH_NOT_FOUND" not in str(why):
            raise
        old = spark.createDataFrame([], STORE).select("sym", "yyyymm", "utc_ms", "bid", "ask", "seq")
    merged = cut(refresh(old, new, watermark))
    write_store(merged, store)
    return merged.count()
