"""Runs of repeated or nearly repeated consecutive events, each collapsed to one event."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.pieces import codes, doubles, longs, map_sorted
from tickloom.session import cut


def collapse_runs(
    events: DataFrame,
    keys: Sequence[str],
    time_ms: str,
    tie_break: Sequence[str],
    values: dict[str, Column],
    max_gap_ms: int,
    least: int = 1,
) -> DataFrame:
    """Maximal runs of consecutive events of an entity, as one row each.

    ``values`` maps each compared column to its tolerance: an event continues the run if every value differs from the
    event before by less than its tolerance and that event is at most ``max_gap_ms`` older. A run is summarised by its
    count and its first and last event, and two neighbouring summaries join by comparing one's last with the other's
    first event: an associative operation. So range-sorted chunks encode their runs locally, and only the first and last
    run of each chunk, two rows per partition, take part in the prefix merge across chunk borders. A hot entity is split
    over as many chunks as its rows need.

    Order within an entity: time, then ``tie_break`` (integers; NULL sorts first). Returns keys, ``start_ms``, ``end_ms``,
    ``n``, ``duration_ms``, ``first_<value>`` and ``last_<value>`` of the runs with at least ``least`` events. Events
    without a time are left out; a NULL or NaN value or tolerance matches nothing, so such an event is a run of its own;
    repeated rows count as events; NULL keys form an entity of their own; an empty table gives no runs.
    """
    ks, ts, vs = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(tie_break))], [f"v{i}" for i in range(len(values))]
    nan = F.lit(float("nan"))
    columns = [F.col(k).cast("string").alias(a) for k, a in zip(keys, ks)] + [F.col(time_ms).cast("bigint").alias("t")]
    columns += [F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**62))).alias(a) for c, a in zip(tie_break, ts)]
    columns += [F.coalesce(F.col(v).cast("double"), nan).alias(a) for v, a in zip(values, vs)]
    columns += [F.coalesce(tolerance.cast("double"), nan).alias(f"{a}x") for tolerance, a in zip(values.values(), vs)]
    rows = events.select(*columns).where("t IS NOT NULL")
    order = [*ks, "t", *ts]
    numbers = [f"{side}_{a}" for a in vs for side in ("first", "last")]
    names = [*ks, "start_ms", *ts, "end_ms", "n", *numbers, *(f"{a}x" for a in vs), "part", "side"]
    kinds = {**dict.fromkeys(ks, "string"), **dict.fromkeys(["start_ms", *ts, "end_ms", "n"], "bigint"), "part": "bigint", "side": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    arrow_schema = pa.schema([(c, arrow[kinds.get(c, "double")]) for c in names])

    def encode(table: pa.Table, part: int):
        time = longs(table, "t")
        new = np.zeros(table.num_rows, dtype=bool)
        new[codes(table, ks)[0]] = True
        new[1:] |= time[1:] - time[:-1] > max_gap_ms
        value = {a: doubles(table, a) for a in vs}
        for a in vs:
            new[1:] |= ~(np.abs(value[a][1:] - value[a][:-1]) < doubles(table, f"{a}x")[1:])
        start = np.flatnonzero(new)
        end = np.append(start[1:], table.num_rows)
        n = end - start
        # side: 0 open at the chunk's start, 1 at its end, 2 at both, -1 at none.
        side = np.full(len(start), -1, dtype=np.int32)
        side[0], side[-1] = 0, 1
        if len(start) == 1:
            side[0] = 2
        kept = np.flatnonzero((n >= least) | (side >= 0))
        first, last = pa.array(start[kept]), end[kept] - 1
        made = {"start_ms": time[start[kept]], "end_ms": time[last], "n": n[kept], "part": np.full(len(kept), part, dtype=np.int64), "side": side[kept]}
        made |= {f"first_{a}": value[a][start[kept]] for a in vs} | {f"last_{a}": value[a][last] for a in vs}
        yield from pa.Table.from_arrays([pa.array(made[c]) if c in made else table.column(c).take(first) for c in names], schema=arrow_schema).to_batches(100_000)

    runs = cut(map_sorted(rows, order, encode, schema))
    w = Window.partitionBy(*ks).orderBy("start_ms", *ts, "part", "side")
    before = lambda c: F.lag(c).over(w)
    joined = (before("part") != F.col("part")) & before("side").isin(1, 2) & F.col("side").isin(0, 2) & (F.col("start_ms") - before("end_ms") <= max_gap_ms)
    for a in vs:
        joined &= F.coalesce(F.abs(F.col(f"first_{a}") - before(f"last_{a}")) < F.nanvl(F.col(f"{a}x"), F.lit(-1.0)), F.lit(False))
    scan = runs.where("side >= 0").withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    at = F.struct("start_ms", *ts, "part", "side")
    merged = scan.groupBy(*ks, "run").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"),
        *[F.min_by(f"first_{a}", at).alias(f"first_{a}") for a in vs], *[F.max_by(f"last_{a}", at).alias(f"last_{a}") for a in vs],
    )
    kept = [*ks, "start_ms", "end_ms", "n", *numbers]
    out = runs.where("side < 0").select(*kept).unionByName(merged.select(*kept)).where(F.col("n") >= least)
    named = [F.col(a).alias(k) for k, a in zip(keys, ks)] + ["start_ms", "end_ms", "n", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms")]
    named += [F.nanvl(F.col(f"{side}_{a}"), F.lit(None).cast("double")).alias(f"{side}_{v}") for v, a in zip(values, vs) for side in ("first", "last")]
    return out.select(*named)
