"""Implausible readings: state-space forecasting per source, withheld updates, vanishing innovation variance.

Quotes. Every quote of a source is held against two forecasts. A local-level model with noise forecasts bid and ask; both share
one gain because they share noise settings in units of the source's own median step. A quote outside the model's support (a price
that isn't above 0, ask below bid) has no likelihood: its innovation counts as infinite and its update is withheld. An innovation above
the threshold marks a quote as a candidate, whose update is withheld too. When quotes agree with the forecast again, or candidates
go on for more than ``few`` quotes, the exact check follows: a run of candidates is an excursion if each lies more than ``steps`` median
steps away, to the same side, from the last sound quote before and the first after. The forecast doesn't choose the quote after: every
waiting quote is tried as one, and counts if it is within ``steps`` of the quote before or most of the ``few`` quotes behind it are within
``steps`` of it. If candidates go on the level has changed for good; the filter restarts behind their excursion, or else at the first of them.

The second forecast is that of the same model without noise, the quote before: its innovations are the steps of the price, and a
price is stuck where their variance vanishes over enough rows and time (``innovation_variance``).

Nothing here needs a whole source in one task: see ``pieces``. A chunk's first and last piece leave their outermost
``EDGE`` rows undecided and hand on twice as many; the edges on the two sides of a border, at most 4 * EDGE rows, are joined and
filtered again, border by border. A stretch of vanishing variance that touches a chunk's ends is summarised and merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.pieces import codes, doubles, longs, map_sorted
from tickloom.session import cut
from tickloom.sources.tables import SOURCE, number, usable_ticks, with_pip

ORDER = ("feed", "pair", "utc_ms", "seq", "tick_id")
EDGE = 256
FEW = 12
STEPS = 40.0
LEAST_STEP_PIPS = 0.05
STUCK_ROWS, STUCK_MS, STEP_MS = 30, 20 * 60_000, 60 * 60_000
# Noise of the local-level model in units of (1.4826 * median step)^2: a steady gain of 0.95, innovations of about unit variance.
PROCESS, NOISE, THRESHOLD = 0.95, 0.05, 6.0


def median_steps(ticks: DataFrame) -> DataFrame:
    """feed, pair, step: the exact median of a source's tick-to-tick changes of bid, changes under 0.05 pip left out.

    ``ticks`` has ORDER's columns, bid and pip. Each sorted partition sends counts of its distinct step sizes (in pips,
    to a millionth) and its two outermost rows, from which the steps across partition borders are added.
    """
    schema = "feed string, pair string, size double, n bigint, pip double, part bigint, side int, utc_ms bigint, seq bigint, tick_id bigint, bid double"

    def work(t: pa.Table, part: int):
        bid, pip = doubles(t, "bid"), doubles(t, "pip")
        start, end = codes(t, SOURCE)
        feed, pair = t.column("feed"), t.column("pair")
        size = np.full(t.num_rows, np.nan)
        size[1:] = np.abs(bid[1:] - bid[:-1]) / pip[1:]
        size[start] = np.nan
        rows: list[tuple] = []
        for s, e in zip(start.tolist(), end.tolist()):
            x = size[s:e]
            v, n = np.unique(np.round(x[x >= LEAST_STEP_PIPS], 6), return_counts=True)
            rows += [(feed[s].as_py(), pair[s].as_py(), a, b, float(pip[s]), part, None, None, None, None, None) for a, b in zip(v.tolist(), n.tolist())]
        for side, i in ((0, 0), (1, t.num_rows - 1)):
            rows.append((feed[i].as_py(), pair[i].as_py(), None, None, float(pip[i]), part, side, *(t.column(c)[i].as_py() for c in ("utc_ms", "seq", "tick_id", "bid"))))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        yield pa.RecordBatch.from_pandas(out, schema=_arrow(schema), preserve_index=False)

    found = cut(map_sorted(ticks.select(*ORDER, "bid", "pip"), ORDER, work, schema))
    before = Window.partitionBy(*SOURCE).orderBy("utc_ms", "seq", "tick_id", "part", "side")
    ends = found.where("side IS NOT NULL").withColumn("was", F.lag("bid").over(before)).withColumn("from", F.lag("part").over(before))
    across = ends.where("from <> part").select(*SOURCE, F.round(F.abs(F.col("bid") - F.col("was")) / F.col("pip"), 6).alias("size"), F.lit(1).cast("bigint").alias("n"), "pip")
    sizes = found.where("side IS NULL").select(*SOURCE, "size", "n", "pip").unionByName(across.where(f"size >= {LEAST_STEP_PIPS}"))
    return sizes.groupBy(*SOURCE).agg((F.percentile("size", F.lit(0.5), F.col("n")) * F.max("pip")).alias("step"))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def implausible(bid: np.ndarray, ask: np.ndarray) -> np.ndarray:
    return (bid <= 0) | (ask <= 0) | (ask < bid)


def excursions(bid: np.ndarray, ask: np.ndarray, step: float, steps: float = STEPS, few: int = FEW) -> np.ndarray:
    """Marks of the quotes that belong to an excursion; quotes that are impossible in themselves are passed over.

    Without a known median step there is no normal behaviour to compare with and nothing is marked. Candidates at the
    very start or end of the sequence have no sound quote on one side and are not marked. Of several possible ends of an
    excursion the last counts.
    """
    marks = np.zeros(len(bid), dtype=bool)
    if not step > 0:
        return marks
    at = np.flatnonzero(~implausible(bid, ask))
    b, a = bid[at].tolist(), ask[at].tolist()
    unit2, far = (1.4826 * step) ** 2, steps * step * (1 + 1e-9)
    process, noise, gate = PROCESS * unit2, NOISE * unit2, THRESHOLD**2
    waiting: list[int] = []
    spread = -1.0  # no state yet
    xb = xa = 0.0
    sound = i = 0
    n = len(b)

    def near(j: int, s: int) -> bool:
        return abs(b[j] - b[s]) <= far and abs(a[j] - a[s]) <= far

    def away(j: int, s: int, e: int) -> bool:
        b0, a0, b1, a1 = b[s], a[s], b[e], a[e]
        return (b[j] - b0 > far and b[j] - b1 > far) or (b0 - b[j] > far and b1 - b[j] > far) or (a[j] - a0 > far and a[j] - a1 > far) or (a0 - a[j] > far and a1 - a[j] > far)

    def lasting(j: int) -> bool:
        return 2 * sum(near(k, j) for k in range(j + 1, min(j + 1 + few, n))) > min(few, n - 1 - j)

    def end_of(w: list[int], x: int, s: int, closed: bool) -> int:
        """Place in ``w`` of the sound quote after the excursion that begins at place x; 0 if there is none. ``closed``: the last of ``w`` is sound."""
        if near(w[x], s):
            return 0
        for y in range(min(len(w) - 1, x + few), x, -1):
            if all(away(j, s, w[y]) for j in w[x:y]) and ((closed and y == len(w) - 1) or near(w[y], s) or lasting(w[y])):
                return y
        return 0

    while i < n or waiting:
        if i == n or len(waiting) > few:
            # Nothing has come back to the forecast: an excursion may still end at a level that differs from the one before.
            y = end_of(waiting, 0, sound, False)
            marks[at[waiting[:y]]] = True
            if i == n and not y and not near(waiting[0], sound) and not lasting(waiting[0]):
                break
            i, spread, waiting = waiting[y], -1.0, []
            continue
        if spread < 0:
            xb, xa, spread, sound = b[i], a[i], noise, i
            i += 1
            continue
        db, da = b[i] - xb, a[i] - xa
        ahead = spread + process
        total = ahead + noise
        bound = gate * total
        if db * db <= bound and da * da <= bound:
            if waiting:
                waiting.append(i)
                x = 0
                while x < len(waiting) - 1:
                    y = end_of(waiting, x, sound, True)
                    marks[at[waiting[x:y]]] = True
                    x = max(x, y)
                    sound = waiting[x]
                    x += 1
                waiting = []
            gain = ahead / total
            xb += gain * db
            xa += gain * da
            spread = ahead * (1 - gain)
            sound = i
        else:
            waiting.append(i)
        i += 1
    return marks


def innovation_variance(price: np.ndarray, time: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, variance) of the stretches of a price between the innovations of its noise-free local level.

    Without noise the gain is 1 and the forecast is the price before. A first quote and one after a step of over an hour have no
    forecast. A stretch goes on as long as its innovations stay at 0; ``variance`` is their mean square, so it is 0 for every stretch of
    at least two quotes, and NaN for one quote, which has no innovation of its own.
    """
    innovation = np.full(len(price), np.inf)
    innovation[1:] = np.where(time[1:] - time[:-1] > STEP_MS, np.inf, price[1:] - price[:-1])
    innovation[start] = np.inf
    first = np.flatnonzero(innovation != 0)
    end = np.append(first[1:], len(price))
    square = np.where(innovation == 0, innovation, 0.0) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return first, end, np.add.reduceat(square, first) / (end - first - 1) if len(first) else square


def quote_cases(ticks: DataFrame, quote_sources: DataFrame, few: int = FEW, steps: float = STEPS) -> DataFrame:
    """tick_id and reason (``price``, ``excursion``, ``stuck_bid``, ``stuck_ask``) of every implausible quote; one row per reason.

    Ticks without a time or a price are left out, as are no other rows; a source without a pip size has price and stuck
    cases only; repeated rows are rows of their own; an empty table gives no case. Columns of the inputs beyond the needed
    ones are never carried, so their names can't clash.
    """
    rows = with_pip(usable_ticks(ticks), quote_sources)
    scaled = rows.join(median_steps(rows.where("pip > 0")), [*SOURCE], "left").select(*ORDER, "bid", "ask", "step")
    schema = "kind string, reason string, feed string, pair string, tick_id bigint, utc_ms bigint, seq bigint, bid double, ask double, step double, part bigint, side int, n bigint, end_ms bigint, open boolean"
    arrow = _arrow(schema)

    def batch(t: pa.Table, rows: np.ndarray, **given) -> pa.RecordBatch:
        own = {c: t.column(c).take(pa.array(rows)).combine_chunks() for c in ("feed", "pair", "tick_id", "utc_ms", "seq", "bid", "ask", "step")}
        fill = lambda f: given[f.name] if isinstance(given.get(f.name), pa.Array) else pa.array(np.asarray(given[f.name]), f.type) if isinstance(given.get(f.name), np.ndarray) else pa.array([given.get(f.name)] * len(rows), f.type)
        return pa.RecordBatch.from_arrays([(own[f.name] if f.name in own and f.name not in given else fill(f)).cast(f.type) for f in arrow], schema=arrow)

    def work(t: pa.Table, part: int):
        size = t.num_rows
        bid, ask, time, step = doubles(t, "bid"), doubles(t, "ask"), longs(t, "utc_ms"), t.column("step").to_numpy()
        start, end = codes(t, SOURCE)
        yield batch(t, np.flatnonzero(implausible(bid, ask)), kind="case", reason="price")
        marks, undecided = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        edge, restart = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for s, e in zip(start.tolist(), end.tolist()):
            marks[s:e] = excursions(bid[s:e], ask[s:e], step[s], steps, few)
            if s == 0:
                undecided[: min(e, EDGE)] = edge[: min(e, 2 * EDGE)] = True
            if e == size:
                undecided[max(s, e - EDGE) :] = True
                if e - 2 * EDGE > s and not edge[e - 2 * EDGE - 1]:
                    restart[e - 2 * EDGE] = True
                edge[max(s, e - 2 * EDGE) :] = True
        yield batch(t, np.flatnonzero(marks & ~undecided), kind="case", reason="excursion")
        at = np.flatnonzero(edge)
        # side: 1 where the edge pass has to decide, else 0; open: the row before it in the source isn't among the edges.
        yield batch(t, at, kind="edge", part=part, side=undecided[at].astype(np.int32), open=restart[at])
        for name, price in (("stuck_bid", bid), ("stuck_ask", ask)):
            first, last, variance = innovation_variance(price, time, start)
            n, long = last - first, time[last - 1] - time[first]
            stuck = (variance == 0) & (n >= STUCK_ROWS) & (long >= STUCK_MS)
            outer = np.unique([0, len(first) - 1])
            stuck[outer] = False
            yield batch(t, np.flatnonzero(np.repeat(stuck, n)), kind="case", reason=name)
            # The outermost stretches may go on next door: a summary each, and their rows until the merged one is known.
            # side 0: only the chunk's start is open, 1: only its end, 2: the stretch fills the whole chunk.
            sides = np.array([2] if len(first) == 1 else [0, 1], dtype=np.int32)
            yield batch(t, first[outer], kind="run", reason=name, part=part, side=sides, n=n[outer], end_ms=time[last[outer] - 1], bid=price[first[outer]])
            for k, o in enumerate(outer.tolist()):
                yield batch(t, np.arange(first[o], last[o]), kind="member", reason=name, part=part, side=int(sides[k]))

    found = cut(map_sorted(scaled, ORDER, work, schema))
    cases = found.where("kind = 'case'").select("tick_id", "reason")

    # A stretch of edges is what the chunks on both sides of a border hand on; it begins where the row before isn't among the edges.
    # Two rows per chunk number the stretches, and each is filtered again on its own, however many borders its source has.
    at = ("utc_ms", "seq", "tick_id")
    edges = found.where("kind = 'edge'").select(*SOURCE, *at, "bid", "ask", "step", "side", "part", "open")
    restarts = edges.where("open").select(*SOURCE, "part", F.struct(*at).alias("from_row"))
    edges = edges.join(restarts, [*SOURCE, "part"], "left").withColumn("half", F.coalesce(F.struct(*at) >= F.col("from_row"), F.lit(False)).cast("int"))
    halves = edges.select(*SOURCE, "part", "half").distinct()
    halves = halves.withColumn("stretch", F.sum("half").over(Window.partitionBy(*SOURCE).orderBy("part", "half")))
    edges = edges.join(halves, [*SOURCE, "part", "half"]).select(*SOURCE, "stretch", *at, "bid", "ask", "step", "side")

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["utc_ms", "seq", "tick_id"])
        bid, ask, step = (rows[c].to_numpy(np.float64) for c in ("bid", "ask", "step"))
        return rows.loc[excursions(bid, ask, step[0], steps, few) & (rows["side"].to_numpy() == 1), ["tick_id"]]

    edge_cases = edges.groupBy(*SOURCE, "stretch").applyInPandas(again, "tick_id bigint").withColumn("reason", F.lit("excursion"))

    # At most four summaries per chunk: a segmented scan in source order merges those that continue each other.
    order = Window.partitionBy(*SOURCE, "reason").orderBy("utc_ms", "seq", "tick_id", "part", "side")
    joined = (F.lag("part").over(order) != F.col("part")) & F.lag("side").over(order).isin(1, 2) & F.col("side").isin(0, 2)
    joined &= (F.lag("bid").over(order) == F.col("bid")) & (F.col("utc_ms") - F.lag("end_ms").over(order) <= STEP_MS)
    summary = found.where("kind = 'run'").withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    of_run = Window.partitionBy(*SOURCE, "reason", "run")
    verdict = summary.withColumn("rows", F.sum("n").over(of_run)).withColumn("long", F.max("end_ms").over(of_run) - F.min("utc_ms").over(of_run))
    verdict = verdict.where(f"rows >= {STUCK_ROWS} AND long >= {STUCK_MS}").select("reason", "part", "side")
    late = found.where("kind = 'member'").select("tick_id", "reason", "part", "side").join(verdict, ["reason", "part", "side"], "left_semi")
    return cases.unionByName(edge_cases).unionByName(late.select("tick_id", "reason"))


#: The level of a gate count may leave the source's median by this much in log(1 + count), and a standardised innovation above this is a candidate.
DRIFT, COUNT_THRESHOLD = 1.0, 1.0


def count_candidates(y: np.ndarray, usual: float) -> np.ndarray:
    """Marks of the counts (as log(1 + count)) above the forecast of a slow local level that starts at the source's median ``usual``.

    Updates of marked counts are withheld and the level is held within DRIFT of the median, so a source that climbs step by step can't
    take its own forecast along. Innovations have a deviation of at most sqrt(2.01), so whatever exceeds the median by
    DRIFT + 1.418 = 2.418 is marked in any state of the filter; a count above both 200 and 20 medians exceeds it by
    log(201 / 11) = 2.905 at least. So the stated limits, checked behind this, are never vetoed by the filter.
    """
    marks = np.zeros(len(y), dtype=bool)
    level, spread = usual, 1.0
    for i, v in enumerate(y.tolist()):
        ahead = spread + 0.01
        total = ahead + 1.0
        if v > level and (v - level) ** 2 > COUNT_THRESHOLD**2 * total:
            marks[i] = True  # withheld
        else:
            gain = ahead / total
            level = min(max(level + gain * (v - level), usual - DRIFT), usual + DRIFT)
            spread = ahead * (1 - gain)
    return marks


def count_cases(gates: DataFrame, least: int = 200, times: float = 20.0, months: int = 5) -> DataFrame:
    """gate_id, field and reason (``impossible``, ``spike``, ``stuck``) of every implausible count in a gate report.

    Per source and count field a slow local-level filter on log(1 + count) marks counts above the forecast and withholds their
    update (``count_candidates``); the exact check keeps those above ``least`` and ``times`` the source's median, and leaves none out
    wherever a chunk splits a source. Impossible: below 0 or above total_ticks, outside the model's support. Stuck: the innovations
    of the noise-free model, whose forecast is the month before, vanish over at least ``months`` reported months in a row (the
    same count above 0; a month reported twice is one month, has each of its counts, and forecasts each of them).
    NULL counts are never cases; NULL feeds or pairs make a source too. ``least`` and ``times`` must not be under 200 and 20, which the filter is built for.
    """
    if least < 200 or times < 20:
        raise ValueError("the filter is built for limits of at least 200 and 20 medians")
    fields = ("negative_spread", "jump_gt_2pct")
    # NULL keys never join, so they are written with a mark in front; the names aren't returned.
    gates = gates.withColumns({k: F.coalesce(F.concat(F.lit("+"), F.col(k).cast("string")), F.lit("-")) for k in SOURCE})
    rows = gates.select("gate_id", *SOURCE, "yyyymm", "reported_at", "total_ticks", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("bigint") for f in fields)))).alias("field", "n")).where("n IS NOT NULL")
    counts = rows.groupBy(*SOURCE, "field", "n").agg(F.count("*").alias("rows"))
    medians = counts.groupBy(*SOURCE, "field").agg(F.percentile("n", F.lit(0.5), F.col("rows")).alias("usual"))
    rows = rows.join(medians, [*SOURCE, "field"])
    impossible = rows.where("n < 0 OR n > total_ticks").select("gate_id", "field", F.lit("impossible").alias("reason"))
    order = ("feed", "pair", "field", "yyyymm", "reported_at", "gate_id")
    schema = "gate_id bigint, field string, n bigint, usual double"

    def work(t: pa.Table, _: int):
        start, end = codes(t, ("feed", "pair", "field"))
        y, base = np.log1p(np.maximum(doubles(t, "n"), 0)), np.log1p(np.maximum(doubles(t, "usual"), 0))
        marks = np.zeros(t.num_rows, dtype=bool)
        for s, e in zip(start.tolist(), end.tolist()):
            marks[s:e] = count_candidates(y[s:e], float(base[s]))
        yield from t.filter(pa.array(marks)).select(["gate_id", "field", "n", "usual"]).cast(_arrow(schema)).to_batches()

    spikes = map_sorted(rows.select(*order, "n", "usual"), order, work, schema)
    spikes = spikes.where(f"n > {least} AND n > {times} * usual").select("gate_id", "field", F.lit("spike").alias("reason"))
    positive = rows.where("n > 0 AND yyyymm IS NOT NULL").select("gate_id", *SOURCE, "field", "yyyymm", "n")
    # A source's months, one row each: numbered, so that the month before is the reported one before.
    reported = gates.where("yyyymm IS NOT NULL").select(*SOURCE, "yyyymm").distinct().withColumn("at", F.row_number().over(Window.partitionBy(*SOURCE).orderBy("yyyymm")))
    same = positive.select(*SOURCE, "field", "n", "yyyymm").distinct().join(reported, [*SOURCE, "yyyymm"])
    series = [*SOURCE, "field", "n"]
    # The innovation is 0 where the month before has the count too; a stretch of such months has an innovation variance of 0.
    same = same.withColumn("innovation", F.when(F.col("at") - F.lag("at").over(Window.partitionBy(*series).orderBy("at")) == 1, 0.0))
    same = same.withColumn("stretch", F.count(F.when(F.col("innovation").isNull(), 1)).over(Window.partitionBy(*series).orderBy("at")))
    of = Window.partitionBy(*series, "stretch")
    same = same.withColumn("long", F.count("*").over(of)).withColumn("variance", F.avg(F.col("innovation") * F.col("innovation")).over(of))
    same = same.where(f"variance = 0 AND long >= {months}")
    stuck = positive.join(same.select(*SOURCE, "field", "n", "yyyymm"), [*SOURCE, "field", "n", "yyyymm"], "left_semi").select("gate_id", "field", F.lit("stuck").alias("reason"))
    return impossible.unionByName(spikes).unionByName(stuck)
