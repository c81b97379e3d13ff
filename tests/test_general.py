"""The general problems 1, 2 and 6 on small tables and their edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import pieces, spikes
from tickloom.operators.regular_grid import regular_series
from tickloom.operators.rolling import trailing_totals
from tickloom.operators.spikes import count_cases, quote_cases

D = dt.date


def test_trailing_totals_counts_days_without_rows(spark):
    rows = [("a", D(2024, 1, 1), 1.0, "x"), ("a", D(2024, 1, 1), 2.0, "x"), ("a", D(2024, 1, 10), 4.0, "x"), ("b", D(2024, 1, 5), 8.0, "x")]
    # Columns that clash with the operator's own names must not matter.
    df = spark.createDataFrame(rows, "key string, day date, v double, bucket string").withColumn("at", F.lit(1)).withColumn("k0", F.lit(2))
    got = {(r.key, r.day): r for r in trailing_totals(df, ["key"], "day", "v").collect()}
    assert len(got) == 11
    assert got["a", D(2024, 1, 1)].total_7 == 3 and got["a", D(2024, 1, 7)].total_7 == 3 and got["a", D(2024, 1, 8)].total_7 == 0
    assert got["a", D(2024, 1, 8)].avg_7 is None and got["a", D(2024, 1, 8)].total_30 == 3
    assert (got["a", D(2024, 1, 10)].total_30, got["a", D(2024, 1, 10)].days_30, got["a", D(2024, 1, 10)].span_day) == (7, 2, 10)
    assert got["b", D(2024, 1, 5)].total_7 == 8


def test_trailing_totals_against_brute_force_over_bucket_borders(spark):
    rng = random.Random(1)
    days = sorted(rng.sample(range(400), 120))
    base = D(2023, 1, 1)
    rows = [("k", base + dt.timedelta(d), float(rng.randint(1, 9))) for d in days]
    got = trailing_totals(spark.createDataFrame(rows, "key string, day date, v double"), ["key"], "day", "v").collect()
    values = {r[1]: r[2] for r in rows}
    assert len(got) == days[-1] - days[0] + 1
    for r in got:
        for p in (7, 30):
            assert r[f"total_{p}"] == sum(values.get(r.day - dt.timedelta(i), 0) for i in range(p))


def test_trailing_totals_of_nulls_and_nothing(spark):
    schema = "key string, day date, v double"
    assert trailing_totals(spark.createDataFrame([], schema), ["key"], "day", "v").count() == 0
    rows = [("a", None, 1.0), (None, D(2024, 1, 1), 1.0), ("a", D(2024, 1, 1), None), ("a", D(2024, 1, 2), float("nan"))]
    assert trailing_totals(spark.createDataFrame(rows, schema), ["key"], "day", "v").count() == 0


def test_regular_series_fills_and_marks(spark):
    m = 60_000
    line = lambda t: 1 + t / 1e9
    times = [0, m, 2 * m, 6 * m, 7 * m, 8 * m, 21 * m, 60 * m]
    rows = [("a", t, line(t), line(t), "x") for t in times] + [("a", None, 1.0, 1.0, "x"), ("a", 3 * m, float("nan"), 1.0, "x")]
    df = spark.createDataFrame(rows, "key string, t bigint, bid double, ask double, cell string")
    got = {r.cell_ms // (5 * m): r for r in regular_series(df, ["key"], "t", ["bid", "ask"]).collect()}
    assert sorted(got) == list(range(13))
    assert [got[i].status for i in (0, 1, 2, 3, 4, 6, 12)] == ["observed", "observed", "filled", "missing", "observed", "missing", "observed"]
    # A local line reproduces a line.
    assert got[1].bid_fit == pytest.approx(line(7.5 * m), abs=1e-9) and got[2].bid_fit == pytest.approx(line(12.5 * m), abs=1e-9)
    assert got[3].bid_fit is None and got[6].support == 0


def test_regular_series_is_per_day_and_empty_safe(spark):
    day = 86_400_000
    schema = "key string, t bigint, bid double"
    df = spark.createDataFrame([("a", day - 1000, 1.0), ("a", day + 7_200_000, 1.0), (None, 5, 2.0)], schema)
    got = regular_series(df, ["key"], "t", ["bid"]).collect()
    assert len(got) == 3 and all(r.n == 1 for r in got)
    assert regular_series(spark.createDataFrame([], schema), ["key"], "t", ["bid"]).count() == 0


def test_excursions_are_told_from_level_changes():
    rng = np.random.default_rng(0)
    bid = 1.1 + np.cumsum(rng.choice([-1e-5, 0, 1e-5], 400))
    bid[100:103] += 0.005  # excursion of copies
    bid[200:] += 0.005  # lasting change
    bid[250] -= 0.01
    bid[399] += 1.0  # no sound quote after
    marks = spikes.excursions(bid, bid + 6e-5, 1e-5)
    assert np.flatnonzero(marks).tolist() == [100, 101, 102, 250]
    assert not spikes.excursions(bid, bid + 6e-5, float("nan")).any()


def _excursions_by_search(bid, ask, step):
    """Every run of up to FEW quotes after the last sound one held against every possible sound quote after, without a forecast."""
    far, n, few, out = spikes.STEPS * step * (1 + 1e-9), len(bid), spikes.FEW, set()
    near = lambda i, j: abs(bid[i] - bid[j]) <= far and abs(ask[i] - ask[j]) <= far
    lasts = lambda i: sum(near(k, i) for k in range(i + 1, min(n, i + 1 + few))) * 2 > min(few, n - 1 - i)
    away = lambda j, s, e: any(min(g * (x[j] - x[s]), g * (x[j] - x[e])) > far for x in (bid, ask) for g in (1, -1))
    s, i = 0, 1
    while i < n:
        ends = [] if near(i, s) else [e for e in range(i + 1, min(n, i + few + 1)) if (near(e, s) or lasts(e)) and all(away(j, s, e) for j in range(i, e))]
        if ends:
            out |= set(range(i, ends[-1]))
            i = ends[-1]
        s, i = i, i + 1
    return out


@pytest.mark.parametrize("shift", [0, 9.7, 15, 39, 60, 100, -25])
def test_excursions_where_the_level_moves_across_them(shift):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        bid = 1.1 + np.cumsum(rng.choice([-1e-5, 0, 1e-5], 400))
        want = set()
        for k in (60, 150, 240, 330, 395):
            long = int(rng.integers(1, 4)) if k < 395 else 1
            bid[k + long :] += shift * 1e-5
            bid[k : k + long] += (1 if rng.random() < 0.5 else -1) * 216e-5
            want |= set(range(k, k + long))
        marks = set(np.flatnonzero(spikes.excursions(bid, bid + 6e-5, 1e-5)).tolist())
        assert marks == want == _excursions_by_search(bid, bid + 6e-5, 1e-5)


def _ticks(spark, rows):
    schema = "tick_id bigint, feed string, pair string, utc_ms bigint, seq bigint, bid double, ask double, part string, step double, kind string"
    return spark.createDataFrame([(i, "f", p, t, s, b, a, "x", 9.0, "y") for i, (p, t, s, b, a) in enumerate(rows)], schema)


def _brute(rows, pip):
    """The cases by definition, source by source, without any partitions."""
    out = set()
    for source in {r[0] for r in rows}:
        own = sorted((t, s, i, b, a) for i, (p, t, s, b, a) in enumerate(rows) if p == source and None not in (t, b, a))
        bid, ask = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        ids = [r[2] for r in own]
        out |= {(ids[k], "price") for k in np.flatnonzero(spikes.implausible(bid, ask))}
        size = np.abs(np.diff(bid)) / pip
        size = size[size >= 0.05]
        step = float(np.median(size)) * pip if len(size) else float("nan")
        out |= {(ids[k], "excursion") for k in np.flatnonzero(spikes.excursions(bid, ask, step))}
        for name, price in (("stuck_bid", bid), ("stuck_ask", ask)):
            k = 0
            while k < len(own):
                j = k
                while j + 1 < len(own) and price[j + 1] == price[j] and own[j + 1][0] - own[j][0] <= 3_600_000:
                    j += 1
                if j - k + 1 >= 30 and own[j][0] - own[k][0] >= 1_200_000:
                    out |= {(ids[x], name) for x in range(k, j + 1)}
                k = j + 1
    return out


@pytest.mark.parametrize(("edge", "chunk"), [(256, 1_000_000), (16, 1_000_000), (16, 150), (16, 1)])
def test_quote_cases_do_not_depend_on_partitions(spark, monkeypatch, edge, chunk):
    monkeypatch.setattr(spikes, "EDGE", edge)
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if chunk > 1000 else 37)
    rng = np.random.default_rng(3)
    rows = []
    for pair, n in (("AAABBB", 3000), ("CCCDDD", 150), ("EEEFFF", 1)):
        bid = np.round(1.1 + np.cumsum(rng.choice([-1e-5, 0, 1e-5, 2e-5, -2e-5], n)), 5)
        t = np.cumsum(rng.integers(20_000, 90_000, n))
        for k in range(40, n - 5, 97):
            bid[k : k + rng.integers(1, 4)] += rng.choice([-1, 1]) * 0.004
        if n > 1000:
            bid[700:1800] = bid[700]  # longer than a partition
            bid[2000] = -1
        rows += [(pair, int(a), i, float(b), float(b) + 6e-5) for i, (a, b) in enumerate(zip(t, bid))]
    rows += [("AAABBB", None, 1, 1.0, 1.0), ("AAABBB", 5, 1, None, 1.0), ("AAABBB", 6, 1, float("nan"), 1.0)]
    order = list(range(len(rows)))
    random.Random(2).shuffle(order)
    rows = [rows[i] for i in order]
    pips = spark.createDataFrame([("f", p, 0.0001) for p in ("AAABBB", "CCCDDD", "EEEFFF")], "feed string, pair string, pip double")
    got = {(r.tick_id, r.reason) for r in quote_cases(_ticks(spark, rows), pips).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    clean = [(p, t, s, None if b is not None and b != b else b, a) for p, t, s, b, a in rows]
    assert got == _brute(clean, 0.0001)


def test_quote_cases_of_unknown_pips_and_nothing(spark):
    pips = spark.createDataFrame([], "feed string, pair string, pip double")
    got = quote_cases(_ticks(spark, [("AAABBB", 1, 0, -1.0, 1.0), ("AAABBB", 2, 1, 1.0, 1.0)]), pips).collect()
    assert [(r.tick_id, r.reason) for r in got] == [(0, "price")]
    assert quote_cases(_ticks(spark, [("AAABBB", 1, 0, 1.0, 1.0)]).where("false"), pips).count() == 0


def test_count_cases(spark):
    schema = "gate_id bigint, feed string, pair string, yyyymm int, negative_spread bigint, jump_gt_2pct bigint, total_ticks bigint, reported_at timestamp, n int"
    at = dt.datetime(2024, 1, 1)
    counts = [50, 55, 60, 5000, 45, 50, -1, 40, 7, 7, 7, 7, 7, 52, 48, 190]
    rows = [(i, "f", "p", 202201 + i % 12 + 100 * (i // 12), c, 0, 100_000, at, 1) for i, c in enumerate(counts)]
    rows += [(100, "f", "p", 202209, 7, None, 100_000, at, 1), (101, "g", "p", 202201, 500, 3, 400, at, 1)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.gate_id, r.field, r.reason) for r in count_cases(df).collect()}
    stuck = {(i, "negative_spread", "stuck") for i in (8, 9, 10, 11, 12, 100)}
    assert got == {(3, "negative_spread", "spike"), (6, "negative_spread", "impossible"), (101, "negative_spread", "impossible")} | stuck
    assert count_cases(df.where("false")).count() == 0


def _gates(spark, counts, sources=("p",), total=100_000_000):
    schema = "gate_id bigint, feed string, pair string, yyyymm int, negative_spread bigint, jump_gt_2pct bigint, total_ticks bigint, reported_at timestamp"
    at = dt.datetime(2024, 1, 1)
    rows = [(1000 * k + i, "f", p, 201001 + i % 12 + 100 * (i // 12), c, 0, total, at) for k, p in enumerate(sources) for i, c in enumerate(counts)]
    return spark.createDataFrame(random.Random(3).sample(rows, len(rows)), schema)


def test_count_cases_of_a_source_that_climbs(spark):
    # 121 months whose counts climb in steps, the last ten far above the median: the forecast must not climb along.
    counts = [21] * 61 + [round(21 * 1.06**i) for i in range(50)] + list(range(500, 510))
    got = {r.gate_id for r in count_cases(_gates(spark, counts)).where("reason = 'spike'").collect()}
    assert got == {i for i, c in enumerate(counts) if c > 200 and c > 20 * np.median(counts)} and set(range(111, 121)) <= got


@pytest.mark.parametrize("chunk", [1_000_000, 1])
def test_count_cases_are_the_stated_ones_in_any_state_of_the_filter(spark, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    for usual in (0, 3, 9, 10, 11, 40, 900):
        walk = np.exp(np.cumsum(rng.normal(0, 0.8, 160)) / 2)
        counts = [int(usual * w) for w in walk] + [int(x) for x in rng.choice([0, 199, 200, 201, 20 * usual, 20 * usual + 1, 21 * usual + 1], 60)]
        med = float(np.median(counts))
        got = sorted(r.gate_id for r in count_cases(_gates(spark, counts, ("p", None), 10**12)).where("reason = 'spike'").collect())
        want = [i for i, c in enumerate(counts) if c > 200 and c > 20 * med]
        assert got == want + [1000 + i for i in want]


def test_innovation_variance():
    price, time = np.array([1.0, 1, 1, 2, 2, 3, 3]), np.array([0, 1, 2, 3, 4, 5, 5 + 3_600_001])
    first, end, variance = spikes.innovation_variance(price, time, np.array([0]))
    assert first.tolist() == [0, 3, 5, 6] and end.tolist() == [3, 5, 6, 7]
    assert variance[:2].tolist() == [0, 0] and np.isnan(variance[2:]).all()
