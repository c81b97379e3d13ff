"""Descriptive statistics, ranks, tests and bootstraps on session panels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.frozen import FROZEN
from tickloom.functions.scalar import p_value
from tickloom.session import cut

QUANTILES = (0.10, 0.25, 0.75, 0.90)


def describe(value: str) -> list[Column]:
    """n, mean, median, sd (n - 1; NULL for one value) and quantiles, interpolated linearly."""
    q = [F.percentile(value, F.lit(x)).alias(f"p{round(x * 100)}") for x in QUANTILES]
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"), *q]


def event_share(value: str, over: float) -> Column:
    """Share of all rows whose value exceeds ``over``; rows without a value don't, but stay in the denominator."""
    return F.avg(F.coalesce((F.col(value) > over).cast("double"), F.lit(0.0)))


def summaries(panel: DataFrame, value: str, key: str = "sym") -> DataFrame:
    """The same figures per key and pooled (key NULL), in one pass over grouping sets."""
    panel = panel.withColumn("_k", F.col(key))
    return panel.groupingSets([["_k"], []], "_k").agg(F.grouping("_k").alias("pooled"), *describe(value), event_share(value, FROZEN.events[0]).alias("p_gt_1"), event_share(value, FROZEN.events[1]).alias("p_gt_15")).withColumnRenamed("_k", key)


def rollup_year(panel: DataFrame, value: str) -> DataFrame:
    """The figures of ``describe`` per sym and year (level 0), per sym (1), and of all (3)."""
    return panel.withColumn("year", F.year("day")).rollup("sym", "year").agg(F.grouping_id().alias("level"), *describe(value))


def by_year(panel: DataFrame, value: str) -> DataFrame:
    """The figures of ``describe`` per year, all syms together."""
    return panel.groupBy(F.year("day").alias("year")).agg(*describe(value))


def pair_summaries(sessions: DataFrame, value: str = "expansion_ratio", key: str = "sym") -> DataFrame:
    """Per key and pooled (key NULL), from all sessions in one pass: ``describe`` and event shares of the valid ones, the share of summer time
    among the valid ones, and how many sessions are valid and invalid."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    t = sessions.select(F.col(key).alias("_k"), ok.alias("_ok"), F.when(ok, F.col(value)).alias("_v"), F.when(ok, F.col("dst_summer").cast("double")).alias("_s"))
    share = lambda e: F.avg(F.when(F.col("_ok"), F.coalesce((F.col("_v") > e).cast("double"), F.lit(0.0))))
    out = t.groupingSets([["_k"], []], "_k").agg(
        F.grouping("_k").alias("pooled"), *describe("_v"), share(FROZEN.events[0]).alias("p_gt_1"), share(FROZEN.events[1]).alias("p_gt_15"),
        F.avg("_s").alias("dst_share"), F.count_if("_ok").alias("n_valid"), F.count_if(~F.col("_ok")).alias("n_invalid"),
    )
    return out.withColumnRenamed("_k", key)


def midrank(panel: DataFrame, value: str, lookback: int = FROZEN.lookback, name: str = "pct") -> DataFrame:
    """Rolling mid-rank percentile: the share of the previous ``lookback`` values below the current one, ties counting half.

    The current row is left out; NULL until there are that many previous rows, or if any of them or the current one is NULL.
    Windows run per sym over one row per day, so a partition is a history in days and not in quotes.
    """
    w = Window.partitionBy("sym").orderBy("day").rowsBetween(-lookback, -1)
    seen = F.collect_list(value).over(w)
    below = F.size(F.filter("_seen", lambda x: x < F.col(value)))
    equal = F.size(F.filter("_seen", lambda x: x == F.col(value)))
    full = (F.size("_seen") == lookback) & F.col(value).isNotNull()
    return panel.withColumn("_seen", seen).withColumn(name, F.when(full, (below + equal * F.lit(0.5)) / F.lit(float(lookback)))).drop("_seen")


def flags(panel: DataFrame, lookback: int = FROZEN.lookback, threshold: float = FROZEN.threshold) -> DataFrame:
    """comp_pct and ldn_pct, and compressed: comp_pct at most the threshold; no percentile, not compressed."""
    out = midrank(midrank(panel, "asia_range", lookback, "comp_pct"), "ldn_range", lookback, "ldn_pct")
    return out.withColumn("compressed", F.coalesce(F.col("comp_pct") <= F.lit(threshold), F.lit(False)))


def _groups(value: str) -> tuple[Column, Column]:
    return F.when(F.col("compressed"), F.col(value)), F.when(~F.col("compressed"), F.col(value))


def mean_difference(panel: DataFrame, value: str, keys: Sequence[str] = ("sym",)) -> DataFrame:
    """Mean of the compressed minus mean of the others per key, and the group sizes; keys that lack a group are skipped."""
    a, b = _groups(value)
    out = panel.groupBy(*keys).agg(F.count(a).alias("n_compressed"), F.count(b).alias("n_other"), (F.avg(a) - F.avg(b)).alias("difference"))
    return out.where("n_compressed > 0 AND n_other > 0")


def sign_counts(panel: DataFrame, values: Mapping[str, str]) -> dict[str, tuple[int, int]]:
    """Per name of ``values`` (name: column): how many syms have a positive ``mean_difference``, and how many have one. All in one pass, counted
    in tasks: syms grow with the data, so a row of each doesn't come to the driver."""
    by_sym = panel.groupBy("sym").agg(*[(F.avg(a) - F.avg(b)).alias(k) for k, v in values.items() for a, b in (_groups(v),)])
    # A sym that lacks a group has no difference: NULL. Spark takes NaN for more than any number.
    found = by_sym.agg(*[x for k in values for x in (F.count_if((F.col(k) > 0) & ~F.isnan(k)), F.count(k))]).first()
    return {k: (found[2 * i], found[2 * i + 1]) for i, k in enumerate(values)}


def mean_of_means(panel: DataFrame, value: str) -> DataFrame:
    """Equal-weight pool: the mean over syms of their means, per flag."""
    return panel.groupBy("sym", "compressed").agg(F.avg(value).alias("m")).groupBy("compressed").agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("syms"))


def relative_range_bp(hi: str, lo: str) -> Column:
    return F.try_divide(F.col(hi) - F.col(lo), F.col(hi) + F.col(lo)) * 2 * 1e4


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties averaged, over all rows, without sorting everything in one task.

    Equal values are counted, the counts are range-partitioned by value, and each value's rank follows from how many lie in
    earlier partitions (one total per partition) and before it in its own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id())
    placed = cut(placed)
    totals = placed.groupBy("_part").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_base", F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).select("_part", "_base")
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy("_v"))
    ranks = placed.withColumn("_upto", upto).join(totals, "_part").select("_v", (F.col("_base") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def mann_whitney(panel: DataFrame, value: str, least: int = 20) -> DataFrame:
    """n of both groups, rank sum, U and z of the compressed against the others: normal approximation, no tie or continuity correction."""
    ranked = average_rank(panel.where(F.col(value).isNotNull()).select("compressed", value), value)
    t = ranked.agg(F.count(F.when(F.col("compressed"), 1)).alias("n1"), F.count(F.when(~F.col("compressed"), 1)).alias("n2"), F.sum(F.when(F.col("compressed"), F.col("rank"))).alias("rank_sum"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    enough = (F.col("n1") >= least) & (F.col("n2") >= least)
    return t.select("n1", "n2", "rank_sum", F.when(enough, u).alias("u"), F.when(enough, z).alias("z"))


def two_proportions(panel: DataFrame, event: Column) -> DataFrame:
    """Pooled z of an event's share among the compressed against the others."""
    hit = F.coalesce(event, F.lit(False))
    c = F.col("compressed")
    t = panel.agg(*[F.count(F.when(x, 1)).alias(a) for a, x in (("x1", c & hit), ("n1", c), ("x2", ~c & hit), ("n2", ~c))])
    p = F.try_divide(F.col("x1") + F.col("x2"), F.col("n1") + F.col("n2"))
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    return t.withColumn("z", F.try_divide(F.try_divide("x1", "n1") - F.try_divide("x2", "n2"), se))


def block_layout(n: int, length: int) -> list[tuple[int, int]]:
    return [(i, min(i + length, n)) for i in range(0, n, length)]


def replicate(n: int, length: int, seed: int, r: int) -> np.ndarray:
    """How often each of n dates is drawn in replicate r: disjoint blocks with replacement until they cover n dates, then cut to n."""
    rng = np.random.default_rng((seed, r))
    blocks = block_layout(n, length)
    times, have = np.zeros(n, dtype=np.int64), 0
    while have < n:
        a, b = blocks[int(rng.integers(0, len(blocks)))]
        b = min(b, a + n - have)
        times[a:b] += 1
        have += b - a
    return times


def date_multiplicities(spark: SparkSession, n: int, draws: int, length: int, seed: int) -> DataFrame:
    """(replicate, i, times) of every date drawn. Each replicate has a seed of its own, so they are drawn where they are used."""

    def draw(batches):
        for b in batches:
            for r in b.column(0).to_pylist():
                times = replicate(n, length, seed, r)
                at = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r)), pa.array(at), pa.array(times[at])], names=["replicate", "i", "times"])

    return spark.range(draws).mapInArrow(draw, "replicate bigint, i bigint, times bigint")


STATISTICS = ("ratio_median", "ratio_mean", "r60_mean", "r180_mean", "share_over", "share_over_15")


def _terms() -> list[tuple[str, Column]]:
    """The statistics that are differences of means, and what is averaged: a row without a ratio counts as not over, one without a return not at all."""
    er = F.col("expansion_ratio")
    over = [(n, F.coalesce((er > e).cast("double"), F.lit(0.0))) for n, e in zip(("share_over", "share_over_15"), FROZEN.events)]
    return [("ratio_mean", er), ("r60_mean", F.col("absr_60m")), ("r180_mean", F.col("absr_180m")), *over]


def _statistics(panel: DataFrame, days: DataFrame, replicas: int, times_of: Callable[[int], np.ndarray], drawn: DataFrame) -> DataFrame:
    """Per replicate six differences compressed minus other.

    ``panel`` has ``class``, which numbers ranges of the ratio in order; ``days`` numbers its dates (day, i); ``times_of`` gives in a task how often a
    replicate has each date, and ``drawn`` the same as rows (replicate, day, times). Sums per date, and counts per date, flag and class, are tables of a
    calendar's length, so they are sent to the tasks, and all sums of a replicate are its times multiplied by them: draws never meet rows. The counts say
    in which class a replicate's two middle ranks lie; only that class's rows then meet the draws, for the median, exact and interpolated.
    Any ranges give the same medians; even ones make the classes small. The table of middle classes has a few rows per replicate, a
    parameter, so it may be broadcast.
    """
    spark = panel.sparkSession
    sides = (("c", F.col("compressed")), ("o", ~F.col("compressed")))
    kept = [(f"{name}_{s}", F.when(flag & c.isNotNull(), c)) for name, c in _terms() for s, flag in sides]
    sums = panel.groupBy("day").agg(*[f(c).alias(f"{n}_{k}") for n, c in kept for f, k in ((F.sum, "sum"), (F.count, "n"))]).join(days, "day").drop("day").toPandas()
    cells = panel.where("expansion_ratio IS NOT NULL AND compressed IS NOT NULL").groupBy("day", "compressed", "class").agg(F.count("*").alias("n")).join(days, "day").drop("day").toPandas()
    length = len(sums)
    by_date = np.zeros((length, 2 * len(kept)))
    by_date[sums.i.to_numpy(int)] = sums.drop(columns="i").fillna(0).to_numpy(float)
    classes = int(cells["class"].max()) + 1 if len(cells) else 1
    counts = np.zeros((length, 2 * classes))
    counts[cells.i.to_numpy(int), cells["class"].to_numpy(int) + classes * cells.compressed.to_numpy(bool)] = cells.n.to_numpy(float)
    names = [n for n, _ in _terms()]
    schema = "replicate bigint, " + ", ".join(f"{n} double" for n in names) + ", compressed boolean, class int, before bigint, h double"
    columns = ["replicate", *names, "compressed", "class", "before", "h"]
    types = [pa.int64(), *[pa.float64()] * len(names), pa.bool_(), pa.int32(), pa.int64(), pa.float64()]

    def work(batches):
        for b in batches:
            every = b.column(0).to_numpy()
            for ids in np.array_split(every, len(every) // 64 + 1):
                if not len(ids):
                    continue
                times = np.stack([times_of(int(r)) for r in ids]).astype(np.float64)
                total, weight = times @ by_date, (times @ counts).reshape(len(ids), 2, classes)
                s, n = total[:, 0::2], total[:, 1::2]
                mean = np.divide(s, n, out=np.full(s.shape, np.nan), where=n > 0)
                rows = [(int(r), *(None if np.isnan(v) else float(v) for v in m[0::2] - m[1::2]), None, None, None, None) for r, m in zip(ids, mean)]
                upto = weight.cumsum(axis=2)
                for k, r in enumerate(ids):
                    for flag in (0, 1):
                        h = (upto[k, flag, -1] - 1) / 2
                        if h >= 0:
                            for c in sorted({int(np.searchsorted(upto[k, flag], rank, side="right")) for rank in (np.floor(h), np.ceil(h))}):
                                rows.append((int(r), *[None] * len(names), bool(flag), c, int(upto[k, flag, c] - weight[k, flag, c]), float(h)))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=columns)

    found = cut(spark.range(replicas).mapInArrow(work, schema))
    key = ["replicate", "compressed"]
    middle = found.where("compressed IS NOT NULL").select(*key, "class", "before", "h")
    near = panel.where("expansion_ratio IS NOT NULL").select("day", "compressed", "class", "expansion_ratio").join(F.broadcast(middle), ["compressed", "class"]).join(drawn, ["replicate", "day"])
    near = near.groupBy(*key, "class", "before", "h", "expansion_ratio").agg(F.sum("times").alias("w"))
    near = near.withColumn("last", F.col("before") + F.sum("w").over(Window.partitionBy(*key, "class").orderBy("expansion_ratio"))).withColumn("first", F.col("last") - F.col("w"))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("last") > rank), F.col("expansion_ratio")))
    ends = near.groupBy(*key).agg(at(F.floor("h")).alias("a"), at(F.ceil("h")).alias("b"), F.max(F.col("h") - F.floor("h")).alias("part"))
    medians = ends.select(*key, (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("median"))
    yes, no = F.col("compressed"), ~F.col("compressed")
    medians = medians.groupBy("replicate").agg((F.max(F.when(yes, F.col("median"))) - F.max(F.when(no, F.col("median")))).alias("ratio_median"))
    return found.where("compressed IS NULL").select("replicate", *names).join(medians, "replicate", "left")


def _stacked(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in STATISTICS])).alias("s")).select("s.*")


def _classed(panel: DataFrame) -> DataFrame:
    panel = cut(panel.select("day", "compressed", "expansion_ratio", "absr_60m", "absr_180m"))
    bounds = panel.agg(F.percentile_approx("expansion_ratio", [i / 128 for i in range(1, 128)]).alias("b")).first()["b"] or []
    return cut(panel.withColumn("class", F.size(F.filter(F.lit(bounds), lambda b: b < F.col("expansion_ratio"))) if bounds else F.lit(0)))


def _dates(classed: DataFrame) -> DataFrame:
    """(day, i) of all dates, numbered in order: days of a calendar."""
    return classed.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)


def point_differences(panel: DataFrame, classed: DataFrame | None = None) -> DataFrame:
    """(statistic, point) of the six differences, every date taken once."""
    classed = _classed(panel) if classed is None else classed
    days = _dates(classed)
    n = days.count()
    once = days.select(F.lit(0).cast("bigint").alias("replicate"), "day", F.lit(1).cast("bigint").alias("times"))
    return _stacked(_statistics(classed, days, 1, lambda _: np.ones(n), once)).withColumnRenamed("v", "point")


def _ends(level: float) -> tuple[float, float]:
    """The quantiles that bound an interval of this level; rounded, because 1 - level isn't exact in binary."""
    return round((1 - level) / 2, 12), round((1 + level) / 2, 12)


def _excludes_zero() -> Column:
    return (F.col("low") > 0) | (F.col("high") < 0)


def joint_block_bootstrap(panel: DataFrame, draws: int = FROZEN.draws, length: int = FROZEN.block, seed: int = FROZEN.seed, level: float = 0.95, least_valid: int = 100) -> DataFrame:
    """Point differences and intervals by resampling blocks of dates, the whole panel of a date staying together.

    The draws are (replicate, date, times); a date's rows are summed once and the sums weighted, so no sample is ever written
    out. Dates are days of a calendar, numbered in order. Returns statistic, point, low, high, valid draws and excludes_zero; no interval
    under max(``least_valid``, 0.9 draws) valid ones.
    """
    classed = _classed(panel)
    days = _dates(classed)
    n = days.count()
    drawn = cut(date_multiplicities(panel.sparkSession, n, draws, length, seed).join(days, "i").select("replicate", "day", "times"))
    found = _statistics(classed, days, draws, lambda r: replicate(n, length, seed, r), drawn)
    low, high = _ends(level)
    ci = _stacked(found).groupBy("statistic").agg(F.count("v").alias("valid"), F.percentile("v", F.lit(low)).alias("low"), F.percentile("v", F.lit(high)).alias("high"))
    ci = ci.select("statistic", "valid", *[F.when(F.col("valid") >= max(least_valid, int(0.9 * draws)), F.col(c)).alias(c) for c in ("low", "high")])
    return point_differences(panel, classed).join(ci, "statistic", "left").withColumn("excludes_zero", _excludes_zero())


def block_length_check(panel: DataFrame, lengths: Sequence[int] = (10, 20, 40), draws: int = FROZEN.draws, seed: int = FROZEN.seed, level: float = 0.9833, **more) -> DataFrame:
    """The joint bootstrap at an evidence level, repeated with other block lengths: its columns and ``length``."""
    out = [joint_block_bootstrap(panel, draws, n, seed, level, **more).withColumn("length", F.lit(n)) for n in lengths]
    return reduce(DataFrame.unionByName, out)


def evidence_gate(states: DataFrame, intervals: DataFrame, floor: float = 0.05, matches: int = 500, dates: int = 200, years: int = 3) -> DataFrame:
    """Per state whether its evidence is enough: state, n_matches, n_dates, n_years, effect, low, enough, passes.

    ``states`` has a row per matched pair: state, day, effect (as a share, so that five points are 0.05). ``intervals`` has state, low
    and high of each block length tried. Enough: at least so many matches, dates and calendar years. A state passes if there is enough,
    its mean effect is at least ``floor`` and every interval of it lies above 0. States without an interval don't pass; rows
    without an effect aren't counted.
    """
    rows = states.where("effect IS NOT NULL")
    out = rows.groupBy("state").agg(F.count("*").alias("n_matches"), F.count_distinct("day").alias("n_dates"), F.count_distinct(F.year("day")).alias("n_years"), F.avg("effect").alias("effect"))
    out = out.join(intervals.groupBy("state").agg(F.min(F.coalesce("low", F.lit(float("-inf")))).alias("low")), "state", "left")
    out = out.withColumn("enough", (F.col("n_matches") >= matches) & (F.col("n_dates") >= dates) & (F.col("n_years") >= years))
    return out.withColumn("passes", F.col("enough") & (F.col("effect") >= floor) & F.coalesce(F.col("low") > 0, F.lit(False)))


#: Rows of a packed piece, rows of pieces that a task holds at once, and replicates that a task draws.
PIECE, SPAN, REPLICATES = 1 << 16, 1 << 22, 250


def _packed(rows: DataFrame) -> DataFrame:
    """compressed, part, k, n, s, held: the rows of each flag in the order of sym and day, PIECE or a few more of them as one packed array, with
    their count and sum. Rows are range-partitioned, so no flag is in one task; ``part`` and ``k`` give the order of a flag's pieces."""

    def pack(batches):
        part, k, held = None, 0, {False: [], True: []}

        def piece(flag):
            nonlocal k
            v, k = np.concatenate(held[flag]), k + 1
            held[flag] = []
            cells = [pa.array([flag]), pa.array([part], pa.int32()), pa.array([k], pa.int64()), pa.array([len(v)], pa.int64()), pa.array([v.sum()]), pa.array([v.tobytes()])]
            return pa.RecordBatch.from_arrays(cells, names=["compressed", "part", "k", "n", "s", "held"])

        for b in batches:
            if not b.num_rows:
                continue
            flags, v, part = b.column(0).to_numpy(zero_copy_only=False).astype(bool), b.column(1).to_numpy(), b.column(2)[0].as_py()
            for flag in held:
                held[flag].append(v[flags == flag])
                if sum(map(len, held[flag])) >= PIECE:
                    yield piece(flag)
        for flag in held:
            if sum(map(len, held[flag])):
                yield piece(flag)

    order = ["compressed", "sym", "day"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "v").select("compressed", "v", F.spark_partition_id().alias("part"))
    return cut(placed.mapInArrow(pack, "compressed boolean, part int, k bigint, n bigint, s double, held binary"))


def moving_block_interval(panel: DataFrame, value: str, draws: int = FROZEN.draws, length: int = FROZEN.block, seed: int = FROZEN.seed, level: float = 0.95) -> DataFrame:
    """Mean difference of ``value``, compressed minus other rows, with its interval: overlapping blocks of rows, each group on its own.

    Rows are numbered by sym and day within their group; those without a value are left out. A replicate of n rows draws ceil(n / length)
    starts and cuts the last block so that it has n rows, from a seed of its own. A task has the running sums of a span of rows, SPAN or a few
    more, and REPLICATES replicates: it draws all their starts, PIECE at a time, and adds up what of the blocks lies in its span. Draws never
    become rows: a replicate has one number per span, and nothing but counts reaches the driver. Drawing anew for each span costs
    draws / length numbers a row and span. Returns one row: value, n_compressed, n_other, difference, low, high, excludes_zero; NULLs without rows in
    both groups. A group shorter than a block is one block.
    """
    rows = panel.where(F.col(value).isNotNull() & F.col("compressed").isNotNull()).select("compressed", "sym", "day", F.col(value).cast("double").alias("v"))
    pieces = _packed(rows)
    size = {r.compressed: r.n for r in pieces.groupBy("compressed").agg(F.sum("n").alias("n")).collect()}
    spark = panel.sparkSession
    schema = "value string, n_compressed bigint, n_other bigint, difference double, low double, high double, excludes_zero boolean"
    if len(size) < 2:
        return spark.createDataFrame([(value, size.get(True, 0), size.get(False, 0), None, None, None, None)], schema)

    def draw(key, table):
        flag, first = key[0].as_py(), key[2].as_py() * REPLICATES
        held = sorted(zip(table.column("first").to_pylist(), table.column("held").to_pylist()))
        lo, upto = held[0][0], np.cumsum(np.concatenate([[0.0], *(np.frombuffer(x) for _, x in held)]))
        n, here, many = size[flag], len(upto) - 1, np.arange(first, min(first + REPLICATES, draws))
        long = min(length, n)
        blocks = -(-n // long)
        found = np.zeros(len(many))
        for at, r in enumerate(many):
            rng = np.random.default_rng((seed, int(r), int(flag)))
            for i in range(0, blocks, PIECE):
                start = rng.integers(0, n - long + 1, min(PIECE, blocks - i)) - lo
                end = start + long
                if i + PIECE >= blocks:
                    end[-1] -= blocks * long - n
                if here < n:
                    inside = (end > 0) & (start < here)
                    start, end = np.maximum(start[inside], 0), np.minimum(end[inside], here)
                found[at] += (upto[end] - upto[start]).sum()
        return pa.table({"replicate": many, "compressed": np.full(len(many), flag), "s": found})

    ahead = Window.partitionBy("compressed").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    places = pieces.select("compressed", "part", "k", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    # Packed arrays look small to the planner; neither side may go through the driver.
    placed = pieces.select("compressed", "part", "k", "held").hint("merge").join(places, ["compressed", "part", "k"])
    spans = placed.select("compressed", F.floor(F.col("first") / SPAN).alias("span"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // REPLICATES))).alias("group"), "first", "held")
    drawn = spans.groupBy("compressed", "span", "group").applyInArrow(draw, "replicate bigint, compressed boolean, s double")
    side = lambda c, flag: F.max(F.when(F.col("compressed") == flag, F.col(c)))
    n = F.when(F.col("compressed"), float(size[True])).otherwise(float(size[False]))
    means = drawn.groupBy("replicate", "compressed").agg(F.sum("s").alias("s")).withColumn("m", F.col("s") / n)
    found = means.groupBy("replicate").agg((side("m", True) - side("m", False)).alias("d"))
    low, high = _ends(level)
    ci = found.agg(F.percentile("d", F.lit(low)).alias("low"), F.percentile("d", F.lit(high)).alias("high"))
    point = pieces.groupBy("compressed").agg(F.sum("s").alias("s")).withColumn("m", F.col("s") / n).agg((side("m", True) - side("m", False)).alias("difference"))
    both = point.withColumn("one", F.lit(1)).join(ci.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select(F.lit(value).alias("value"), F.lit(size[True]).alias("n_compressed"), F.lit(size[False]).alias("n_other"), "difference", "low", "high", _excludes_zero().alias("excludes_zero"))


def difference_tests(panel: DataFrame, values: Sequence[str]) -> DataFrame:
    """value, mean_compressed, mean_other, n1, n2, z: means of both groups and the rank test, for each of several columns. Means and ranks leave NULLs out."""
    out = []
    for v in values:
        a, b = _groups(v)
        means = panel.agg(F.avg(a).alias("mean_compressed"), F.avg(b).alias("mean_other"))
        out.append(means.join(mann_whitney(panel, v).select("n1", "n2", "z"), F.lit(True)).select(F.lit(v).alias("value"), "*"))  # one row each
    return reduce(DataFrame.unionByName, out)


def summarize(flagged: DataFrame, draws: int = FROZEN.draws, horizons: Sequence[int] = FROZEN.horizons, intervals: Sequence[int] = (60, 180)) -> dict:
    """The first version's bundle: medians and rank test of the ratio, shares over the events, absolute returns by horizon, and diagnostics."""
    yes, no = F.col("compressed"), ~F.col("compressed")
    med = lambda c, flag: F.percentile(F.when(flag, F.col(c)), F.lit(0.5))
    rank = lambda c: verdict(mann_whitney(flagged, c).first().z)
    boot = lambda c: moving_block_interval(flagged, c, draws).first().asDict()
    f = flagged.agg(
        F.count_if(yes).alias("n_compressed"), F.count_if(no).alias("n_other"), med("expansion_ratio", yes).alias("a"), med("expansion_ratio", no).alias("b"),
        med("expansion_ratio", F.lit(True)).alias("c"), med("ldn_pct", yes).alias("d"), med("ldn_pct", no).alias("e"), F.avg(F.when(yes, F.col("ldn_range")) * 1e4).alias("f"), F.avg(F.when(no, F.col("ldn_range")) * 1e4).alias("g"),
        *[F.avg(F.when(x, F.col(f"absr_{h}m")) * 1e4).alias(f"{k}{h}") for h in horizons for k, x in (("c", yes), ("o", no))],
    ).first()
    over = {n: two_proportions(flagged, F.col("expansion_ratio") > e).first() for n, e in zip(("over_1", "over_15"), FROZEN.events)}
    out = {"n_compressed": f.n_compressed, "n_other": f.n_other}
    out["ratio"] = {"median_compressed": f.a, "median_other": f.b, "median_all": f.c, "rank": rank("expansion_ratio"), "boot": boot("expansion_ratio")}
    out["shares"] = {k: {"compressed": r.x1 / r.n1 if r.n1 else None, "other": r.x2 / r.n2 if r.n2 else None, **verdict(r.z)} for k, r in over.items()}
    out["returns"] = {h: {"mean_bp_compressed": f[f"c{h}"], "mean_bp_other": f[f"o{h}"], "rank": rank(f"absr_{h}m"), **({"boot": boot(f"absr_{h}m")} if h in intervals else {})} for h in horizons}
    out["london_percentile"] = {"median_compressed": f.d, "median_other": f.e, "rank": rank("ldn_pct")}
    out["london_range_bp"] = {"mean_compressed": f.f, "mean_other": f.g}
    return out


def consistent(signs: Mapping[str, float] | tuple[int, int]) -> bool:
    """Whether at least five of six syms (5/6 of any number) have a positive difference; from the difference of each, or from ``sign_counts``."""
    positive, syms = signs if isinstance(signs, tuple) else (sum(v > 0 for v in signs.values()), len(signs))
    return syms > 0 and 6 * positive >= 5 * syms


def decide_first(pooled: Mapping, signs: Mapping[str, Mapping[str, float] | tuple[int, int]], level: float = 0.05) -> tuple[str, dict[str, bool]]:
    """The first version's verdict and its checks, from ``summarize`` and the signs (as ``consistent`` takes them) of ``ratio``, ``60`` and ``180``.

    The ratio and each return need a rank test below ``level``, an interval that excludes 0 and consistent signs; both shares need a
    test below ``level``. PASS if all hold, MECHANICAL if just the ratio's and the shares' do, else FAIL.
    """
    small = lambda t: t.get("p") is not None and t["p"] < level

    def holds(part: Mapping, s: Mapping[str, float] | tuple[int, int]) -> bool:
        return small(part["rank"]) and bool((part.get("boot") or {"excludes_zero": True})["excludes_zero"]) and consistent(s)

    checks = {"ratio": holds(pooled["ratio"], signs["ratio"])} | {k: small(t) for k, t in pooled["shares"].items()}
    checks |= {f"return_{h}": holds(pooled["returns"][h], signs[str(h)]) for h in (60, 180)}
    ratio = checks["ratio"] and checks["over_1"] and checks["over_15"]
    return "PASS" if all(checks.values()) else "MECHANICAL" if ratio and not (checks["return_60"] and checks["return_180"]) else "FAIL", checks


def decide(statistics: Mapping[str, Mapping], signs_60: Mapping[str, float]) -> tuple[str, dict[str, bool]]:
    """The second version's verdict and its checks, from the joint bootstrap's point and excludes_zero per statistic and the signs of |R_60| per sym.

    ratio: the median's difference is above 0, and its interval and that of the mean exclude 0; return_60 and return_180: above 0
    with an interval that excludes 0; signs_60: consistent. PASS if all four hold, MECHANICAL if the ratio's does and neither return's, else FAIL.
    """
    of = lambda k, what: statistics.get(k, {}).get(what)
    up = lambda k: (of(k, "point") or 0) > 0 and bool(of(k, "excludes_zero"))
    checks = {"ratio": up("ratio_median") and bool(of("ratio_mean", "excludes_zero")), "return_60": up("r60_mean"), "return_180": up("r180_mean"), "signs_60": consistent(signs_60)}
    if all(checks.values()):
        return "PASS", checks
    return "MECHANICAL" if checks["ratio"] and not (checks["return_60"] or checks["return_180"]) else "FAIL", checks


def verdict(z: float | None) -> dict:
    return {"z": z, "p": p_value(z)}
