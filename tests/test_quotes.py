"""Bars, quality, as-of, sessions and statistics on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.frozen import FROZEN, Frozen, inconsistencies
from tickloom.functions import scalar as S
from tickloom.operators import quotes as Q
from tickloom.operators import refresh as R
from tickloom.operators import sessions as X
from tickloom.operators import stats as T
from tickloom.operators import strategies as Y

M = 60_000
BASE = 1_767_596_400_000  # 2026-01-05 07:00 UTC


def ticks(spark, rows, sym="P"):
    return spark.createDataFrame([(sym, BASE + int(t), s, s, b, a) for t, s, b, a in rows], "sym string, utc_ms bigint, seq bigint, tick_id bigint, bid double, ask double")


FIVE = [(0, 0, 1.1000, 1.1001), (0, 1, 1.1005, 1.1006), (0, 2, 1.1000, 1.1002), (40_000, 3, 1.0990, 1.0993), (130_000, 4, 1.1010, 1.1011)]


@pytest.mark.parametrize("reverse", [False, True])
def test_bars_follow_sequence_not_row_order(spark, reverse):
    df = ticks(spark, FIVE[::-1] if reverse else FIVE).repartition(3)
    a, b = sorted(Q.bars(df, 1).collect(), key=lambda r: r.bar_ms)
    assert (a.bid_o, a.bid_h, a.bid_l, a.bid_c, a.ask_c, a.n_ticks) == (1.1000, 1.1005, 1.0990, 1.0990, 1.0993, 4)
    assert (a.mid_o, a.mid_h, a.mid_l, a.mid_c) == pytest.approx((1.10005, 1.10055, 1.09915, 1.09915), abs=1e-12)
    assert (a.spread_min, a.spread_med, a.spread_max) == pytest.approx((0.0001, 0.00015, 0.0003), abs=1e-12)
    assert b.bar_ms - a.bar_ms == 2 * M and b.n_ticks == 1


def test_crossed_quotes_raise_unless_cleaned(spark):
    df = ticks(spark, [*FIVE, (200_000, 5, 1.2, 1.1)])
    with pytest.raises(Exception, match="negative spread"):
        Q.bars(df, 1).collect()
    kept, log = Q.clean(df)
    assert kept.count() == 5 and [(r.reason, r.removed) for r in log.collect()] == [("crossed", 1)]


def test_dedup(spark):
    a, b = (1.1, 1.2), (1.3, 1.4)
    df = ticks(spark, [(0, i, *p) for i, p in enumerate((a, a, b, a))])
    assert [r.bid for r in Q.dedup_consecutive(df).orderBy("seq").collect()] == [1.1, 1.3, 1.1]
    assert [r.bid for r in Q.dedup_global(df).orderBy("seq").collect()] == [1.1, 1.3]
    assert [r.seq for r in Q.last_per_time(df).collect()] == [3]


def test_dedup_carries_over_days(spark):
    day = 86_400_000
    df = ticks(spark, [(0, 0, 1.0, 1.1), (3 * day, 1, 2.0, 2.1)])
    seen = Q.gaps(df).collect()
    assert [(r.to_ms - r.from_ms) for r in seen] == [3 * day]


def test_gap_of_exactly_an_hour_is_none(spark):
    assert Q.gaps(ticks(spark, [(0, 0, 1.0, 1.1), (60 * M, 1, 1.0, 1.1)])).count() == 0
    assert Q.gaps(ticks(spark, [(0, 0, 1.0, 1.1), (60 * M + 1000, 1, 1.0, 1.1)])).count() == 1


def test_stale_blocks_both_ways(spark):
    still = ticks(spark, [(i * M, i, 1.0, 1.1) for i in range(6)])
    moving = ticks(spark, [(i * M, i, 1.0 + i, 1.1 + i) for i in range(6)])
    sizes = lambda df, legacy: sorted(r.n for r in Q.blocks(df, legacy).collect())
    assert sizes(still, False) == [6] and sizes(moving, False) == [1] * 6
    assert sizes(still, True) == [1] * 6 and sizes(moving, True) == [6]


def test_zero_mid_is_a_parameter(spark):
    df = ticks(spark, [(0, 0, 1.0, 1.0), (1, 1, 0.0, 0.0), (2, 2, 1.0, 1.0)])
    assert Q.jumps(df).count() == 0 and Q.jumps(df, zero_is_jump=True).count() == 2


def test_as_of_age(spark):
    facts = spark.createDataFrame([("P", BASE - 6 * M, 1.0), ("P", BASE - 7 * M, 0.5), ("P", BASE - 90_000_000, 0.1)], "sym string, bar_ms bigint, mid_c double")
    looks = spark.createDataFrame([("P", BASE - M), ("P", BASE), ("P", BASE - 8 * M), ("Q", BASE)], "sym string, at bigint")
    bounded = {(r.sym, r.at): r.mid_c for r in Q.as_of(looks, facts, ("sym",), "at", "bar_ms", "mid_c", 5 * M).collect()}
    assert bounded == {("P", BASE - M): 1.0, ("P", BASE): None, ("P", BASE - 8 * M): None, ("Q", BASE): None}
    free = {(r.sym, r.at): r.mid_c for r in Q.as_of(looks, facts, ("sym",), "at", "bar_ms", "mid_c").collect()}
    assert free == {("P", BASE - M): 1.0, ("P", BASE): 1.0, ("P", BASE - 8 * M): 0.1, ("Q", BASE): None}


def test_calendar_over_clock_changes(spark):
    c = {str(r.london_date): r for r in X.calendar(spark, "2026-03-27", "2026-10-26").collect()}
    hours = lambda r: [t.strftime("%m-%d %H:%M") for t in (r.asia_start, r.ldn_start, r.ldn_end)]
    assert hours(c["2026-03-27"]) == ["03-27 00:00", "03-27 07:00", "03-27 10:01"] and not c["2026-03-27"].dst_summer
    assert hours(c["2026-03-30"]) == ["03-29 23:00", "03-30 06:00", "03-30 09:01"] and c["2026-03-30"].dst_summer
    assert hours(c["2026-10-26"]) == ["10-26 00:00", "10-26 07:00", "10-26 10:01"] and not c["2026-10-26"].dst_summer
    assert "2026-03-28" not in c and "2026-03-29" not in c


def test_session_table_reasons_and_ages(spark):
    day = BASE - 7 * 60 * M  # London midnight
    bar = lambda minute, hi, lo, c: ("P", day + minute * M, hi, lo, c, 1)
    rows = [bar(m, 1.2, 1.1, 1.15) for m in range(0, 415)] + [bar(m, 1.3, 1.1, 1.25) for m in range(420, 601)] + [bar(1440 + m, 1.2, 1.2, 1.2) for m in range(0, 601)]
    bars = spark.createDataFrame(rows, "sym string, bar_ms bigint, bid_h double, bid_l double, mid_c double, n_ticks bigint")
    first, second = X.session_table(bars).orderBy("london_date").collect()
    assert first.valid and first.expansion_ratio == pytest.approx(2.0) and first.reason == ""
    assert first.r_60m == pytest.approx(1.25 / 1.15 - 1)  # the origin's quote is exactly five minutes old
    assert (second.valid, second.reason, second.asia_range) == (False, "zero-asia-range", None)
    late = X.session_table(bars, age_minutes=4).orderBy("london_date").first()
    assert late.valid and not late.valid_for_h60m and late.r_60m is None
    assert X.session_table(bars.where("false")).count() == 0
    v1 = X.session_table(bars, bounded=False).orderBy("london_date").first()
    assert v1.valid and v1.r_180m == pytest.approx(1.25 / 1.15 - 1)


def panel(spark, values, sym="P", **more):
    from datetime import date, timedelta

    return spark.createDataFrame([(sym, date(2024, 1, 1) + timedelta(i), v) for i, v in enumerate(values)], "sym string, day date, v double")


@pytest.mark.parametrize(("values", "want"), [([5, 1, 2, 2], 0.5), ([1, 2, 2, 2], 2 / 3), ([2, 2, 2, 9], 1.0), ([2, 2, 9, 1], 0.0)])
def test_midrank(spark, values, want):
    got = T.midrank(panel(spark, map(float, values)), "v", 3).orderBy("day").collect()
    assert [r.pct for r in got[:3]] == [None] * 3 and got[3].pct == pytest.approx(want)


def test_describe(spark):
    r = panel(spark, [1.0, 2.0, 4.0, 8.0, 16.0]).agg(*T.describe("v")).first()
    assert (r.n, r.mean, r.median, r.p10, r.p25, r.p75, r.p90) == pytest.approx((5, 6.2, 4, 1.4, 2, 8, 12.8))
    assert r.sd == pytest.approx(6.099180272790763)
    assert panel(spark, [1.0]).agg(*T.describe("v")).first().sd is None and panel(spark, []).agg(*T.describe("v")).first().n == 0


def test_two_proportions_and_rank_test(spark):
    rows = [(True, i < 30) for i in range(100)] + [(False, i < 10) for i in range(100)]
    r = T.two_proportions(spark.createDataFrame(rows, "compressed boolean, hit boolean"), F.col("hit")).first()
    assert r.z == pytest.approx(3.535533905932737) and S.p_value(r.z) == pytest.approx(0.0004069520174449609)
    rows = [(True, float(i)) for i in range(11, 31)] + [(False, float(i)) for i in range(1, 21)]
    r = T.mann_whitney(spark.createDataFrame(rows, "compressed boolean, v double"), "v").first()
    assert (r.rank_sum, r.u) == (560, 350) and r.z == pytest.approx(4.0575133560034455)
    assert T.mann_whitney(spark.createDataFrame(rows[1:], "compressed boolean, v double"), "v").first().z is None


def test_nan_is_not_greater_than_one(spark):
    from tickloom.sources.tables import number

    df = spark.createDataFrame([(float("nan"),), (2.0,)], "v double").select(number("v").alias("v"))
    assert df.agg(T.event_share("v", 1.0)).first()[0] == 0.5


def test_bootstrap_matches_direct_resampling(spark):
    import datetime as dt
    import random

    import numpy as np

    rng = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(45)]
    rows = [(s, d, rng.random() < 0.4, rng.random() * 2, rng.random(), rng.random()) for d in days for s in "AB"]
    df = spark.createDataFrame(rows, "sym string, day date, compressed boolean, expansion_ratio double, absr_60m double, absr_180m double")
    assert T.block_layout(45, 20) == [(0, 20), (20, 40), (40, 45)]
    draws = [tuple(r) for r in T.date_multiplicities(spark, 45, 20, 20, 42).collect()]
    assert all(sum(t for r, _, t in draws if r == k) == 45 for k in range(20))
    got = {r.statistic: r for r in T.joint_block_bootstrap(df, 20, 20, 42, least_valid=18).collect()}
    direct = []
    for k in range(20):
        sample = [x for r, i, t in draws if r == k for x in rows if x[1] == days[i] for _ in range(t)]
        direct.append(np.median([x[3] for x in sample if x[2]]) - np.median([x[3] for x in sample if not x[2]]))
    assert got["ratio_median"].low == pytest.approx(np.percentile(direct, 2.5), abs=1e-12)
    assert all(r.low is None and r.excludes_zero is None for r in T.joint_block_bootstrap(df, 20, 20, 42).collect())  # under 100 valid draws
    wide = {r.statistic: r for r in T.joint_block_bootstrap(df, 20, 20, 42, level=0.9833, least_valid=18).collect()}
    assert wide["ratio_median"].low <= got["ratio_median"].low and wide["ratio_median"].low == pytest.approx(np.percentile(direct, 0.835), abs=1e-12)
    checked = T.block_length_check(df, (5, 20), 20, level=0.9, least_valid=18)
    assert {(r.length, r.statistic) for r in checked.collect()} == {(n, s) for n in (5, 20) for s in T.STATISTICS}


def _found(**low):
    """Bootstrap results with these lower ends; the point and the upper end lie 1 and 2 above it."""
    return {k: {"point": low.get(k, 0.5) + 1, "excludes_zero": low.get(k, 0.5) > 0} for k in T.STATISTICS}


def test_second_gate():
    signs = {s: 1.0 for s in "ABCDE"} | {"F": -1.0}
    assert T.decide(_found(), signs)[0] == "PASS"
    assert T.decide(_found(r60_mean=-0.5), signs)[0] == "FAIL"  # one return is not enough, and not mechanical either
    assert T.decide(_found(r60_mean=-0.5, r180_mean=-0.5), signs)[0] == "MECHANICAL"
    assert T.decide(_found(ratio_mean=-0.5), signs)[0] == "FAIL"
    said, checks = T.decide(_found(), signs | {"E": -0.1})
    assert said == "FAIL" and not checks["signs_60"] and T.decide(_found(), {})[0] == "FAIL"
    below = _found()
    below["r60_mean"] = {"point": -1.0, "excludes_zero": True}
    assert T.decide(below, signs)[0] == "FAIL"
    none = _found()
    none["ratio_median"] = {"point": None, "excludes_zero": None}
    assert T.decide(none, signs)[0] == "FAIL"


def test_first_gate():
    part = lambda p, zero=True: {"rank": {"p": p}, "boot": {"excludes_zero": zero}}
    pooled = {"ratio": part(0.01), "shares": {"over_1": {"p": 0.01}, "over_15": {"p": 0.01}}, "returns": {60: part(0.01), 180: part(0.01)}}
    good, bad = {s: 1.0 for s in "ABCDEF"}, {s: 1.0 if s < "E" else -1.0 for s in "ABCDEF"}
    signs = {"ratio": good, "60": good, "180": good}
    assert T.decide_first(pooled, signs)[0] == "PASS"
    assert T.decide_first({**pooled, "returns": {60: part(0.01), 180: part(0.2)}}, signs)[0] == "MECHANICAL"
    assert T.decide_first(pooled, {**signs, "60": bad})[0] == "MECHANICAL"
    assert T.decide_first({**pooled, "ratio": part(0.01, False)}, signs)[0] == "FAIL"
    assert T.decide_first({**pooled, "shares": {"over_1": {"p": 0.01}, "over_15": {"p": None}}}, signs)[0] == "FAIL"


def test_moving_blocks_of_rows(spark):
    import datetime as dt
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(i), rng.random() < 0.4, rng.choice([None, rng.random()])) for s in "ABC" for i in range(70)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "sym string, day date, compressed boolean, v double")
    got = T.moving_block_interval(df, "v", draws=30, length=7, seed=3).first()
    group = {f: np.array([r[3] for r in sorted(rows, key=lambda r: r[:2]) if r[2] == f and r[3] is not None]) for f in (True, False)}
    found = []
    for r in range(30):
        means = []
        for flag, x in group.items():
            n = len(x)
            start = np.random.default_rng((3, r, int(flag))).integers(0, n - 7 + 1, -(-n // 7))
            means.append(np.concatenate([x[s : s + 7] for s in start])[:n].mean())
        found.append(means[0] - means[1])
    assert got.difference == pytest.approx(group[True].mean() - group[False].mean()) and (got.n_compressed, got.n_other) == (len(group[True]), len(group[False]))
    assert (got.low, got.high) == (pytest.approx(np.percentile(found, 2.5)), pytest.approx(np.percentile(found, 97.5)))
    assert got.excludes_zero == (got.low > 0 or got.high < 0)
    assert T.moving_block_interval(df.where("compressed"), "v").first().difference is None
    short = T.moving_block_interval(df.where("sym = 'A' AND day < '2024-01-06'"), "v", draws=5).first()
    assert short.low == pytest.approx(short.difference) == short.high  # one block each


@pytest.mark.parametrize("piece, span", [(1 << 16, 1 << 22), (8, 20)])
def test_moving_blocks_make_no_rows_of_draws(spark, monkeypatch, piece, span):
    """Any pieces and spans give the same interval, and no join's side grows with draws times rows: such a table was sent to the driver."""
    import datetime as dt
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(i), rng.random() < 0.3, rng.random()) for s in "AB" for i in range(150)]
    df = spark.createDataFrame(rows, "sym string, day date, compressed boolean, v double")
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "SPAN", span)
    monkeypatch.setattr(T, "REPLICATES", 7)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = T.moving_block_interval(df, "v", draws=40, length=9, seed=2)
        got = found.first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = []
    for r in range(40):
        means = []
        for flag in (True, False):
            x = np.array([v for *_, f, v in sorted(rows, key=lambda r: r[:2]) if f == flag])
            start = np.random.default_rng((2, r, int(flag))).integers(0, len(x) - 9 + 1, -(-len(x) // 9))
            means.append(np.concatenate([x[s : s + 9] for s in start])[: len(x)].mean())
        want.append(means[0] - means[1])
    assert (got.low, got.high) == (pytest.approx(np.percentile(want, 2.5)), pytest.approx(np.percentile(want, 97.5)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 40" not in plan and "times" not in plan


def test_the_first_gate_broadcasts_no_draws(spark, monkeypatch):
    """Each of the first version's three intervals: no table of draws, which the planner took for a small one."""
    import datetime as dt
    import random

    rng = random.Random(6)
    numbers = ("expansion_ratio", "ldn_pct", "ldn_range", *(f"absr_{h}m" for h in FROZEN.horizons))
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(i), rng.random() < 0.4, *(rng.random() for _ in numbers)) for s in "AB" for i in range(80)]
    df = spark.createDataFrame(rows, "sym string, day date, compressed boolean, " + ", ".join(f"{n} double" for n in numbers))
    found, real = [], T.moving_block_interval
    monkeypatch.setattr(T, "moving_block_interval", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    pooled = T.summarize(df, draws=40)
    assert pooled["ratio"]["boot"]["low"] <= pooled["ratio"]["boot"]["difference"] <= pooled["ratio"]["boot"]["high"]
    assert len(found) == 3 and not any("Range (0, 40" in f._jdf.queryExecution().optimizedPlan().toString() for f in found)


def test_the_first_gate_brings_no_row_per_sym_to_the_driver(spark, monkeypatch):
    """Syms grow with the data: their signs are counted in tasks. One verdict, whether from counts or from each sym's difference."""
    import datetime as dt
    import random

    from pyspark.sql.classic.dataframe import DataFrame

    from tickloom.plans import catalogue

    rng = random.Random(7)
    numbers = ("expansion_ratio", "ldn_pct", "ldn_range", *(f"absr_{h}m" for h in FROZEN.horizons))
    row = lambda s, i, flag: (f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(i), flag, *(rng.random() + (0.2 if flag else 0) for _ in numbers))
    rows = [row(s, i, i % 3 == 0) for s in range(40) for i in range(9)] + [row(99, i, False) for i in range(9)]
    rows.append(("S0", dt.date(2024, 3, 1), True, float("nan"), *[0.5] * (len(numbers) - 1)))
    df = spark.createDataFrame(rows, "sym string, day date, compressed boolean, " + ", ".join(f"{n} double" for n in numbers))
    columns = {"ratio": "expansion_ratio", "60": "absr_60m", "180": "absr_180m"}
    each = {k: {r.sym: r.difference for r in T.mean_difference(df, c).collect()} for k, c in columns.items()}
    assert T.sign_counts(df, columns) == {k: (sum(v > 0 for v in s.values()), len(s)) for k, s in each.items()}
    assert T.sign_counts(df.where("sym = 'S99'"), columns) == {k: (0, 0) for k in columns} and not T.consistent((0, 0))
    assert T.consistent((5, 6)) and not T.consistent((4, 5)) and not T.consistent((0, 1))
    most, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: most.append(len(out := real(self))) or out)
    monkeypatch.setattr(catalogue, "_flagged", lambda *_: df)
    monkeypatch.setattr(T, "summarize", lambda flagged, draws, real=T.summarize: real(flagged, 20))
    got = catalogue.gat_01_decision(spark, None).first()
    said, checks = T.decide_first(T.summarize(df, 20), each)
    assert tuple(got) == (said, *checks.values()) and max(most) <= 2


def test_evidence_gate(spark):
    import datetime as dt

    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(5 * i)
    rows = [("a", day(i % 250), 0.06) for i in range(500)] + [("b", day(i % 250), 0.04) for i in range(500)] + [("c", day(i % 30), 0.2) for i in range(600)] + [("d", day(i % 250), 0.06) for i in range(500)] + [("a", day(1), None)]
    ci = [("a", 0.01, 0.1), ("a", 0.02, 0.1), ("b", 0.01, 0.1), ("c", 0.01, 0.3), ("d", 0.01, 0.1), ("d", -0.01, 0.1)]
    got = {r.state: r for r in T.evidence_gate(spark.createDataFrame(rows, "state string, day date, effect double"), spark.createDataFrame(ci, "state string, low double, high double")).collect()}
    assert {s: (r.enough, r.passes) for s, r in got.items()} == {"a": (True, True), "b": (True, False), "c": (False, False), "d": (True, False)}
    assert got["a"].n_matches == 500 and got["a"].n_dates == 250 and got["a"].n_years == 4


def test_sessions_end_with_the_data(spark):
    day = BASE - 7 * 60 * M
    rows = [(day + m * M, 1.1 + m % 7 / 100) for m in range(0, 600)] + [(day + 86_400_000 + m * M, 1.1 + m % 7 / 100) for m in range(0, 601)] + [(day + 86_400_000 + 601 * M, 1.1)]
    q = spark.createDataFrame([("P", t, i, i, b, b + 0.001) for i, (t, b) in enumerate(rows)], "sym string, utc_ms bigint, seq bigint, tick_id bigint, bid double, ask double")
    reasons = lambda f: [r.reason for r in X.session_table(Q.closes(f)).orderBy("london_date").collect()]
    assert reasons(q) == ["", ""]
    assert reasons(q.where(f"utc_ms < {day + 86_400_000 + 601 * M}")) == ["", "out-of-slice"]


def test_bootstrap_has_the_share_over_one_and_a_half(spark):
    import datetime as dt

    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = [("A", d, i % 2 == 0, (1.6 if i % 8 == 0 else 1.2) if i % 2 == 0 else 0.5, 0.1, 0.1) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "sym string, day date, compressed boolean, expansion_ratio double, absr_60m double, absr_180m double")
    got = {r.statistic: r for r in T.joint_block_bootstrap(df, 20, 20, 42, least_valid=18).collect()}
    assert len(got) == 6 and got["share_over"].point == 1.0 and got["share_over_15"].point == pytest.approx(0.25)
    # Its two blocks have 3 and 2 of 10 such days.
    assert (got["share_over_15"].low, got["share_over_15"].high, got["share_over_15"].valid) == (pytest.approx(0.2), pytest.approx(0.3), 20)


def test_registered_bootstraps_draw_in_full(monkeypatch):
    from tickloom.plans import catalogue

    asked = []

    def stop(*_, draws=FROZEN.draws, **__):
        asked.append(draws)
        raise InterruptedError

    for name in ("joint_block_bootstrap", "moving_block_interval"):
        monkeypatch.setattr(T, name, stop)
    monkeypatch.setattr(catalogue, "_flagged", lambda *_: _Rows())
    for query in (catalogue.bst_02_joint_block, catalogue.bst_01_block_ci, catalogue.gat_02_decision):
        with pytest.raises(InterruptedError):
            query(None, None)
    assert asked == [FROZEN.draws] * 3 == [2000] * 3


class _Rows:
    """Stands for any table: each method gives it back, and it has no rows."""

    def __getattr__(self, _):
        return lambda *a, **k: self

    def __iter__(self):
        return iter(())


def month(spark, rows, start=0):
    return spark.createDataFrame([("P", 202601, BASE + t, b, b + 0.0001, start + i) for i, (t, b) in enumerate(rows)], "sym string, yyyymm int, utc_ms bigint, bid double, ask double, seq bigint")


def test_refresh(spark):
    old, new = month(spark, [(0, 1.1)]), month(spark, [(0, 1.1), (0, 1.1001), (0, 1.1)])
    once = R.refresh(old, new).orderBy("seq").collect()
    assert [(r.bid, r.seq) for r in once] == [(1.1, 0), (1.1001, 1), (1.1, 2)]
    again = R.refresh(spark.createDataFrame(once, old.select("sym", "yyyymm", "utc_ms", "bid", "ask", "seq").schema), new).orderBy("seq").collect()
    assert again == once
    with pytest.raises(R.Conflict):
        R.refresh(month(spark, [(0, 1.1002), (0, 1.1)]), month(spark, [(0, 1.1), (0, 1.1001)]))
    with pytest.raises(R.Conflict):
        R.refresh(month(spark, [(1000, 1.1)]), month(spark, [(0, 1.0), (1000, 1.1)]))
    assert [r.seq for r in R.refresh(old, month(spark, [(1000, 1.2)]), watermark=10).orderBy("seq").collect()] == [0, 11]
    assert R.refresh(old.where("false"), new.where("false")).count() == 0


def test_recover(spark):
    old, export = month(spark, [(0, 1.0), (0, 2.0), (0, 3.0)]), month(spark, [(0, 3.0), (0, 1.0), (0, 2.0)])
    assert [r.bid for r in R.recover(old, export)[0].orderBy("seq").collect()] == [3.0, 1.0, 2.0]
    with pytest.raises(R.Conflict):
        R.recover(old, month(spark, [(0, 1.0)]))
    assert R.recover(old, month(spark, [(0, 1.0)]), allow_loss=True)[1] == 2


def test_parameters():
    assert inconsistencies() == [] and FROZEN.lookback == 60
    assert inconsistencies(Frozen(threshold=0.31, split=(0.5, 0.2, 0.2)))


def test_scalars(spark):
    r = spark.sql("SELECT DATE'2025-12-05' a, DATE'2026-02-01' z, 202601 m, 'EURUSD_ticks_202601.csv' n, 'x.csv' o")
    r = r.select(S.months_between(F.col("a"), F.col("z")), S.months_between(F.col("z"), F.col("a")), S.padded_month(F.col("m"), -1), S.padded_month(F.col("m"), 12), S.export_pair("n"), S.export_month("n"), S.export_pair("o")).first()
    assert tuple(r) == ([202512, 202601, 202602], None, 202512, 202701, "EURUSD", 202601, None)
    p = spark.createDataFrame([(0.0,), (None,)], "z double").select(S.two_sided_p("z").alias("p")).collect()
    assert p[0].p == 1.0 and p[1].p is None or math.isnan(p[1].p)
    assert S.interval_text((0.1, 0.2)) == "[+0.100, +0.200]" and S.interval_text(None) == "n/a"


def test_matches_are_not_reused(spark):
    schema = "sym string, id bigint, t bigint"
    a, b = spark.createDataFrame([("P", 1, 100), ("P", 2, 101)], schema), spark.createDataFrame([("P", 7, 100), ("P", 8, 400)], schema)
    assert [tuple(r) for r in Y.greedy_matches(a, b, ("sym",), "t", 50).collect()] == [(1, 7, 0)]


def test_barrier_race(spark):
    rows = [("P", BASE + i * 5 * M, h, lo) for i, (h, lo) in enumerate([(1.0, 1.0), (1.05, 1.0), (1.2, 0.8)])]
    bars = spark.createDataFrame(rows, "sym string, bar_ms bigint, bid_h double, bid_l double")
    starts = spark.createDataFrame([("P", BASE, 1.0), ("P", BASE + 86_400_000, 1.0)], "sym string, at_ms bigint, p0 double")
    out = lambda w, n: [r.outcome for r in Y.barrier_race(starts, bars, F.lit(w), least_bars=n).orderBy("at_ms").collect()]
    assert out(0.04, 3) == ["up", "unknown"] and out(0.1, 3) == ["both", "unknown"] and out(0.5, 3) == ["neither", "unknown"] and out(0.5, 4) == ["unknown", "unknown"]


def test_every_bar_is_raced(spark, monkeypatch):
    import random

    from tickloom.plans import rules

    rng, at, level, rows = random.Random(4), BASE, 1.0, []
    for _ in range(150):
        at += rng.choice([5, 5, 5, 10, 40]) * M
        level *= 1 + rng.gauss(0, 2e-4)
        rows.append(("P", at, level * (1 + rng.random() * 3e-4), level * (1 - rng.random() * 3e-4), level))
    bars = spark.createDataFrame(rows, "sym string, bar_ms bigint, bid_h double, bid_l double, mid_c double")
    monkeypatch.setattr(rules, "_five", lambda *_: bars)
    want = {}
    for _, t, _, _, p0 in rows:
        inside = [r for r in rows if t <= r[1] < t + 60 * M]
        up, down = (min((r[1] for r in inside if hit(r)), default=None) for hit in (lambda r: r[2] >= p0 + p0 * 0.0005, lambda r: r[3] <= p0 - p0 * 0.0005))
        neither = "unknown" if len(inside) < 10 else "neither"
        want[t] = neither if up is None and down is None else "both" if up == down else "up" if down is None or (up is not None and up < down) else "down"
    assert len(set(want.values())) > 2 and {r.at_ms: r.outcome for r in rules.sp_18_barrier_race_all(None, None).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_gate_counts_over_days(spark, seed):
    """Blocks, jumps and gaps that go on over days, held against the operators that count them one by one."""
    import random

    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([1000, 60_000, 3_600_000, 7 * 3_600_000, 60 * 3_600_000])
        b = rng.choice([1.0, 1.0, 1.0, 1.1, -1.0]) if rng.random() < 0.3 or not rows else rows[-1][2]
        rows.append((t, i, b, b + rng.choice([0.1, 0.1, -0.1]) if rng.random() < 0.1 else b + 0.1))
    q = ticks(spark, rows).unionByName(ticks(spark, rows[:1], "Q")).unionByName(ticks(spark, [(0, i, 1.0, 1.1) for i in range(9)], "R"))
    stale = 4
    got = {r.sym: r for r in Q.integrity(q, stale).collect()}
    blocks = {(r.sym): r.k for r in Q.blocks(q, True).where(F.col("n") >= stale).groupBy("sym").agg(F.count("*").alias("k")).collect()}
    moved = {r.sym: r.k for r in Q.jumps(q).groupBy("sym").agg(F.count("*").alias("k")).collect()}
    gaps = {r.sym: r.k for r in Q.longest_gaps(q.where("bid > 0 AND ask >= bid")).groupBy("sym").agg(F.max("longest_min").alias("k")).collect()}
    gate = {r.sym: r for r in Q.store_gate(q, 202601, 202612).collect()}
    missing = {r.sym: r.k for r in Q.missing_months(q, 202601, 202612).groupBy("sym").agg(F.count("*").alias("k")).collect()}
    for sym in "PQR":
        assert (got[sym].stale_blocks, got[sym].n_jumps, gate[sym].longest_gap_min, gate[sym].months_missing) == (blocks.get(sym, 0), moved.get(sym, 0), gaps.get(sym), missing.get(sym, 0)), sym
    assert Q.integrity(q.where("false")).count() == 0 and Q.store_gate(q.where("false"), 202601, 202601).count() == 0
    plan = Q.store_gate(q, 202601, 202612)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2 * 3  # three tables in the union, two passes
