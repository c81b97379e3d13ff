"""New batches held against everything accepted so far, by hashes in a bucketed table."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.pieces import map_sorted
from tickloom.session import cut, remove_path, scratch_path

SOURCE = ("feed", "pair")
NEAR_MS, NEAR_PIPS = 1000, 0.05
#: A cell is this many tolerances wide: the wider, the fewer second cells a line has to look into.
CELL = 8
#: The time that a paragraph of a file covers, and the lines that one sweep over dependent lines takes.
PARAGRAPH_MS, SWEEP = 900_000, 100_000
#: Stands for a line known to be accepted.
ACCEPTED = -(1 << 62)
LINES, CONTENTS = "h BIGINT, feed STRING, pair STRING, utc_ms BIGINT, bid DOUBLE, ask DOUBLE, id BIGINT", "h BIGINT, kind STRING"


def _steps() -> list[tuple[Column, Column]]:
    near = F.lit(NEAR_PIPS) * F.col("pip")
    return [(F.col("utc_ms").cast("double"), F.lit(float(NEAR_MS))), (F.col("bid"), near), (F.col("ask"), near)]


def _hash(cells: list[Column]) -> Column:
    return F.xxhash64(*SOURCE, *cells)


def entries(rows: DataFrame) -> DataFrame:
    """The history entries of ``rows`` (SOURCE, utc_ms, bid, ask, id, pip): the hash of the normalised content, which is the
    source and the cell that time and prices fall into, with the content itself. Copies are one entry with the least id."""
    cells = [F.floor(x / (tolerance * CELL)).cast("bigint") for x, tolerance in _steps()]
    one = rows.groupBy(*SOURCE, "utc_ms", "bid", "ask").agg(F.min("id").alias("id"), F.max("pip").alias("pip"))
    return one.select(_hash(cells).alias("h"), *SOURCE, "utc_ms", "bid", "ask", "id")


def probes(lines: DataFrame, *more: str) -> DataFrame:
    """One row per line and cell that can hold a row within the tolerances: mostly one or two, at most eight."""
    found = lines
    for i, (x, tolerance) in enumerate(_steps()):
        reach, width = tolerance * (1 + 1e-6), tolerance * CELL
        found = found.withColumn(f"c{i}", F.explode(F.sequence(F.floor((x - reach) / width).cast("bigint"), F.floor((x + reach) / width).cast("bigint"))))
    return found.select(_hash([F.col(f"c{i}") for i in range(3)]).alias("h"), *SOURCE, "utc_ms", "bid", "ask", (F.lit(NEAR_PIPS) * F.col("pip")).alias("near"), *more)


def _near() -> Column:
    """The candidate ``l`` (a probe) really is as near to ``o`` as the hash suggests.

    The hash alone is the join key, so that the history's buckets serve as they are; the source is compared by order,
    which the planner doesn't turn into further keys.
    """
    near = F.col("l.h") == F.col("o.h")
    for c in SOURCE:
        near &= (F.col(f"l.{c}") >= F.col(f"o.{c}")) & (F.col(f"l.{c}") <= F.col(f"o.{c}"))
    for c in ("bid", "ask"):
        near &= F.abs(F.col(f"l.{c}") - F.col(f"o.{c}")) < F.col("l.near")
    return near & (F.abs(F.col("l.utc_ms") - F.col("o.utc_ms")) < NEAR_MS)


def _content() -> Column:
    """A line's normalised content: its time and its prices to a tenth of a pip."""
    tenths = [F.round(F.col(c) / F.col("pip") * 10).cast("bigint") for c in ("bid", "ask")]
    return F.xxhash64(*SOURCE, "utc_ms", *tenths)


def contents(lines: DataFrame, batch: Column) -> DataFrame:
    """(kind, batch, h, n): hashes of whole files and of their paragraphs, and how many different lines each has.

    A file is what ``batch`` names. A paragraph is what a file has of one source in one PARAGRAPH_MS of time: its borders follow from the
    content, so files that overlap share paragraphs however they are cut. Either hash is that of the set of normalised lines: order and
    repeated lines don't matter. Lines lacking time, price or pip have no content. Lines are hashed where they are and the hashes added up,
    so no file or paragraph is gathered.
    """
    rows = lines.where("utc_ms IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND pip IS NOT NULL")
    rows = rows.select(batch.cast("bigint").alias("batch"), *SOURCE, F.floor(F.col("utc_ms") / PARAGRAPH_MS).alias("at"), _content().alias("c")).distinct()
    sums = (F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    parts = rows.groupBy("batch", *SOURCE, "at").agg(*sums)
    files = parts.groupBy("batch").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    one = parts.select(F.lit("paragraph").alias("kind"), "batch", F.xxhash64(*SOURCE, "at", "n", "s").alias("h"), "n")
    return one.unionByName(files.select(F.lit("file").alias("kind"), "batch", F.xxhash64(F.lit("file"), "n", "s").alias("h"), "n"))


class History:
    """Bucketed tables of content hashes: of lines, and of paragraphs and files. Probing them shuffles the batch only: the history's
    buckets stay where they are.

    The tables lie in the shared folder, or under ``path`` if the history is to outlast the application; a lost executor costs nothing
    but re-reading its files. A kept history is opened by giving the same name, path and number of buckets again.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None, path: str | None = None):
        """``buckets`` stays for the tables' life: by default as many as the cluster shuffles into, 64 at least."""
        self.spark, self.buckets = spark, buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = name or f"accepted_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, self.name)
        self.made = False
        if path:
            for table, columns in (("lines", LINES), ("contents", CONTENTS)):
                if _exists(spark, f"{path}/{table}"):
                    spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}) USING parquet CLUSTERED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}/{table}'")
                    self.made = True

    def _write(self, rows: DataFrame, table: str) -> None:
        """Each bucket gets one more file."""
        writer = rows.repartition(self.buckets, "h").write.mode("append").format("parquet").bucketBy(self.buckets, "h").option("path", f"{self.path}/{table}")
        writer.saveAsTable(f"{self.name}_{table}")
        self.made = True

    def append(self, rows: DataFrame) -> None:
        """Add the rows' hashes."""
        self._write(entries(rows), "lines")

    def append_contents(self, found: DataFrame) -> None:
        """Add the hashes of paragraphs and files."""
        self._write(found.select("h", "kind").distinct(), "contents")

    def read(self) -> DataFrame:
        return self.spark.table(f"{self.name}_lines")

    def read_contents(self) -> DataFrame:
        return self.spark.table(f"{self.name}_contents")

    def drop(self) -> None:
        if self.made:
            for table in ("lines", "contents"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
            remove_path(self.spark, self.path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def coverage(found: DataFrame, history: History) -> DataFrame:
    """(batch, contents, known_contents, covered_share, full_copy) of the files in ``found`` (see ``contents``), held against the history and
    against earlier files of the same delivery: different lines, those in paragraphs that are known as a whole, their share, and whether the
    whole file is known. Semi-joins on the hash, in the history's buckets; nothing of the history is shuffled."""
    earlier = found.groupBy("kind", "h").agg(F.min("batch").alias("first"))
    stored = found.select("kind", "h").distinct().alias("l").join(history.read_contents().alias("o"), (F.col("l.h") == F.col("o.h")) & (F.col("l.kind") >= F.col("o.kind")) & (F.col("l.kind") <= F.col("o.kind")), "left_semi")
    marked = found.join(earlier, ["kind", "h"]).join(stored.withColumn("stored", F.lit(True)), ["kind", "h"], "left")
    marked = marked.withColumn("known", F.coalesce("stored", F.lit(False)) | (F.col("first") < F.col("batch")))
    paragraph = F.col("kind") == "paragraph"
    out = marked.groupBy("batch").agg(F.sum(F.when(paragraph, F.col("n"))).alias("contents"), F.coalesce(F.sum(F.when(paragraph & F.col("known"), F.col("n"))), F.lit(0)).alias("known_contents"), F.max(~paragraph & F.col("known")).alias("full_copy"))
    return out.withColumn("covered_share", F.col("known_contents") / F.col("contents"))


def _decided(rows: pa.Table) -> list[bool | None]:
    """Whether each line is a copy, as far as it can be told from these lines alone: in the order of ranks, a line is a copy if one of the
    earlier lines near it is accepted, and accepted if all of them are copies."""
    ids, ons = rows.column("id").to_pylist(), rows.column("ons").to_pylist()
    state: dict[int, bool | None] = {ACCEPTED: False}
    out: list[bool | None] = [None] * len(ids)
    for i in np.lexsort((rows.column("r1").to_numpy(), rows.column("r0").to_numpy())).tolist():
        told = [state.get(on) for on in ons[i]]
        state[ids[i]] = out[i] = True if False in told else None if None in told else False
    return out


def _greedy(links: DataFrame) -> DataFrame:
    """Decide lines that depend on each other. ``links``: (id, on) with SOURCE, utc_ms, r0, r1 of ``id``, ``on`` being an earlier line near ``id``.

    A line is a copy if one of the earlier lines is accepted and accepted if all of them are copies; lines without earlier
    ones are accepted. Lines near each other are close in time, so the open lines are sorted by source and time and swept in
    pieces of about SWEEP lines, each in the order of ranks. A piece decides all its lines but those that depend on a line of
    another piece; these go into the next round, with what has been decided. A chain of dependent lines takes as many rounds as it
    fills pieces, whatever its number of links. Returns (id, copy) for every ``id``.
    """
    spark = links.sparkSession
    links = cut(links)
    decided = spark.createDataFrame([], "id bigint, copy boolean")
    left = links
    while True:
        # What depends on a line that isn't listed, or is known to be accepted, is a copy; what depends on copies only is accepted.
        ids = left.select(F.col("id").alias("on")).distinct().withColumn("listed", F.lit(True))
        told = decided.select(F.col("id").alias("on"), F.col("copy").alias("of"))
        ahead = left.join(ids, "on", "left").join(told, "on", "left")
        accepted = F.when(F.col("of").isNotNull(), ~F.col("of")).otherwise(F.col("listed").isNull())
        group = ["id", *SOURCE, "utc_ms", "r0", "r1"]
        state = cut(ahead.groupBy(*group).agg(F.max(accepted).alias("near"), F.collect_list(F.when(F.col("of").isNull() & F.col("listed"), F.col("on"))).alias("ons")))
        known = state.where("near OR size(ons) = 0").select("id", F.col("near").alias("copy"))
        open_ = state.where("NOT near AND size(ons) > 0")
        n = open_.count()
        if not n:
            return cut(decided.unionByName(known))
        settled = known.select(F.col("id").alias("on"), F.col("copy").alias("of"))
        # Lines decided just now count in the sweep: copies fall away, accepted ones are written as ACCEPTED, which every sweep knows.
        ons = open_.select("id", F.explode("ons").alias("on")).join(settled, "on", "left").where("of IS NULL OR NOT of")
        ons = ons.groupBy("id").agg(F.collect_list(F.when(F.col("of").isNull(), F.col("on")).otherwise(ACCEPTED)).alias("ons"))
        swept = open_.drop("ons", "near").join(ons, "id", "left").withColumn("ons", F.coalesce("ons", F.array().cast("array<bigint>")))

        def sweep(rows: pa.Table, _: int):
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().cast(pa.int64()), pa.array(_decided(rows), pa.bool_())], names=["id", "copy"])

        order = (*SOURCE, "utc_ms", "id")
        result = cut(map_sorted(swept.select(*order, "r0", "r1", "ons"), order, sweep, "id bigint, copy boolean", -(-n // SWEEP)))
        decided = cut(decided.unionByName(known).unionByName(result.where("copy IS NOT NULL")))
        left = cut(left.join(result.where("copy IS NULL").select("id"), "id", "left_semi"))


def admit(lines: DataFrame, history: History, append: bool = True) -> tuple[DataFrame, DataFrame]:
    """Hold new lines against the history and against earlier lines; returns (copies, accepted).

    ``lines``: SOURCE, utc_ms, bid, ask, pip, id, and ``rank``, a number or a struct of two by which lines come. A line is a copy if an accepted
    row of its source lies less than NEAR_MS and, in bid and in ask, less than NEAR_PIPS pips from it: copies has its
    ``id`` and ``accepted_id``, the least id of such rows that came earlier. All others are accepted, and their hashes
    appended to the history if ``append``.

    The history isn't reprocessed: contents look up the few hash buckets they can be near to. Copies of one content are one
    entry on either side, so a group of copies never multiplies and never gathers on one hash. Lines lacking time, price or pip are neither copies nor accepted; no
    lines or an empty history give the obvious results.
    """
    content = [*SOURCE, "utc_ms", "bid", "ask"]
    lines = lines.where("utc_ms IS NOT NULL AND bid IS NOT NULL AND ask IS NOT NULL AND pip IS NOT NULL")
    # Everything is looked up per content; its lines, however many, meet the outcome by the content's number.
    texts = cut(lines.groupBy(*content).agg(F.min("id").alias("cid"), F.max("pip").alias("pip")))
    tagged = cut(lines.join(texts.drop("pip"), content).select("id", "rank", "cid"))
    look = probes(texts, "cid").alias("l")
    known = cut(look.join(history.read().alias("o"), _near()).groupBy(F.col("l.cid").alias("cid")).agg(F.min("o.id").alias("accepted_id")))
    # Of equal contents only the first line can be accepted: if it is not, what it copies is near to all of them.
    first = tagged.join(known, "cid", "left_anti").groupBy("cid").agg(F.min(F.struct("rank", "id")).alias("one")).select("cid", F.col("one.rank").alias("rank"), F.col("one.id").alias("id"))
    first = cut(first)
    cells = [F.floor(x / (tolerance * CELL)).cast("bigint") for x, tolerance in _steps()]
    earlier = texts.join(first, "cid").select(_hash(cells).alias("h"), *content, "rank", "id").alias("o")
    pairs = cut(look.join(earlier, _near()).select(F.col("l.cid").alias("cid"), F.col("o.id").alias("on"), F.col("o.rank").alias("on_rank")).distinct())
    kind = lines.schema["rank"].dataType
    parts = [F.col("rank").getField(n) for n in kind.fieldNames()] if isinstance(kind, StructType) else [F.col("rank"), F.lit(0)]
    r = [c.cast("bigint").alias(f"r{i}") for i, c in enumerate(parts)]
    links = first.join(pairs, "cid").where("on_rank < rank").join(texts.select("cid", *SOURCE, "utc_ms"), "cid").select("id", "on", *SOURCE, "utc_ms", *r)
    decided = _greedy(links)
    accepted_on = pairs.join(decided.where("copy").select(F.col("id").alias("on")), "on", "left_anti")
    late = tagged.join(accepted_on, "cid").where("on_rank < rank").select("id", F.col("on").alias("accepted_id"))
    copies = tagged.join(known, "cid").select("id", "accepted_id").unionByName(late).groupBy("id").agg(F.min("accepted_id").alias("accepted_id"))
    copies = cut(copies)
    accepted = lines.join(copies, "id", "left_anti")
    if append:
        accepted = cut(accepted)
        history.append(accepted.select(*SOURCE, "utc_ms", "bid", "ask", "id", "pip"))
    return copies, accepted
