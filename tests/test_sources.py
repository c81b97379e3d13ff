"""Files, store, streams, governance and the query catalogue."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom import governance as G
from tickloom.operators import quotes as Q
from tickloom.sources import exports, synthetic
from tickloom.streaming import bars as stream

BASE = 1_767_596_400_000
DATA = "/root/testdata/sf0.001"


def export(path, rows, name="EURUSD_ticks_202601.csv", age=1000):
    os.makedirs(path, exist_ok=True)
    file = f"{path}/{name}"
    with open(file, "w") as f:
        f.write("utc_ms,bid,ask\n" + "".join(f"{t},{b},{b + 0.0001:.5f}\n" for t, b in rows))
    os.utime(file, (time.time() - age,) * 2)
    return file


def test_exports_keep_arrival_order(spark, tmp_path):
    export(tmp_path, [(BASE, 1.1), (BASE, 1.1001), (BASE, 1.1), (BASE, 1.1), (BASE - 5, 1.0)])
    export(tmp_path, [(BASE, 1.0)], "notes.csv")
    got = exports.read_exports(spark, str(tmp_path), ["eurusd "]).orderBy("seq").collect()
    assert [(r.bid, r.seq) for r in got] == [(1.0, 0), (1.1, 1), (1.1001, 2), (1.1, 3)] and got[0].yyyymm == 202601
    assert [r.bid for r in exports.read_exports_last_wins(spark, str(tmp_path)).orderBy("utc_ms").collect()] == [1.0, 1.1]
    assert exports.read_exports(spark, str(tmp_path), ["GBPUSD"]).count() == 0


def test_malformed_lines(spark, tmp_path):
    with open(export(tmp_path, [(BASE, 1.1)]), "a") as f:
        f.write("x,y,z\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        exports.read_exports(spark, str(tmp_path)).collect()
    assert exports.read_exports(spark, str(tmp_path), strict=False).where("utc_ms IS NOT NULL").count() == 1


def test_store_overwrites_only_touched_months_and_prunes(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("P", 202601, BASE, 0, 1.0, 1.1), ("P", 202602, BASE + 30 * 86_400_000, 0, 1.0, 1.1)], "sym string, yyyymm int, utc_ms bigint, seq bigint, bid double, ask double")
    exports.write_store(df, root)
    exports.write_store(df.where("yyyymm = 202601").withColumn("bid", F.lit(9.0)), root)
    assert {(r.yyyymm, r.bid) for r in exports.read_store(spark, root).collect()} == {(202601, 9.0), (202602, 1.0)}
    one = exports.read_store(spark, root, "P", BASE, BASE + 1)
    assert one.count() == 1 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()
    exports.write_pairs(df, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2


def test_layouts(spark, tmp_path):
    df = spark.createDataFrame([("7", "1.5", "x")], "utc_ms string, bid string, ask string").withColumn("seq", F.lit(1))
    assert tuple(exports.from_storage(df).first()) == (7, 1, 1.5, None)
    spark.sql("SELECT timestamp_millis(5) AS t, 1.0D AS bid, 1.1D AS ask").write.parquet(str(tmp_path / "old"))
    assert tuple(exports.from_storage(spark.read.parquet(str(tmp_path / "old"))).first())[:2] == (5, 0)
    with pytest.raises(ValueError, match="layout"):
        exports.from_storage(spark.sql("SELECT 1 AS a"))


def test_watch_isolates_conflicts(spark, tmp_path):
    inbox, store, said = str(tmp_path / "in"), str(tmp_path / "store"), []
    export(inbox, [(BASE, 1.1), (BASE, 1.2)])
    export(inbox, [(BASE, 5.1)], "GBPUSD_ticks_202601.csv")
    export(inbox, [(BASE, 7.1)], "USDJPY_ticks_202601.csv", age=1)  # still being written
    watch = lambda: stream.watch_exports(spark, inbox, store, lambda f, why: said.append(os.path.basename(f))).awaitTermination()
    watch()
    assert {r.sym for r in exports.read_store(spark, store).collect()} == {"EURUSD", "GBPUSD"} and not said
    export(inbox, [(BASE, 1.2), (BASE, 1.1)])  # contradicts
    export(inbox, [(BASE, 5.1), (BASE + 1, 5.2)], "GBPUSD_ticks_202601.csv")
    watch()
    assert said == ["EURUSD_ticks_202601.csv"]
    got = {(r.sym, r.bid, r.seq) for r in exports.read_store(spark, store).collect()}
    assert got == {("EURUSD", 1.1, 0), ("EURUSD", 1.2, 1), ("GBPUSD", 5.1, 0), ("GBPUSD", 5.2, 1)}


def test_watch_archives_only_what_is_stored(spark, tmp_path):
    inbox, store, old, said = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "old"), []
    export(inbox, [(BASE, 1.1)])
    export(inbox, [(BASE, 5.1)], "GBPUSD_ticks_202601.csv", age=1)  # young
    with open(export(inbox, [(BASE, 2.1)], "AUDUSD_ticks_202601.csv"), "a") as f:
        f.write("x,y,z\n")  # malformed
    os.utime(f"{inbox}/AUDUSD_ticks_202601.csv", (time.time() - 2000,) * 2)  # and first in line
    export(inbox, [], "USDCAD_ticks_202601.csv")  # empty
    export(inbox, [(BASE, 1.0)], "EURUSD_ticks_2026.csv")  # not an export's name
    sweep = lambda: stream.watch_exports(spark, inbox, store, lambda f, why: said.append(os.path.basename(f)), archive=old)
    done = sweep()
    assert said == ["AUDUSD_ticks_202601.csv"] and len(done.young) == 1 and {os.path.basename(f) for f in done.taken} == {"EURUSD_ticks_202601.csv", "USDCAD_ticks_202601.csv"}
    assert sorted(os.listdir(old)) == ["EURUSD_ticks_202601.csv", "USDCAD_ticks_202601.csv"]
    assert {"AUDUSD_ticks_202601.csv", "GBPUSD_ticks_202601.csv", "EURUSD_ticks_2026.csv"} <= set(os.listdir(inbox))
    export(inbox, [(BASE, 1.3)])  # contradicts what is stored
    os.utime(f"{inbox}/GBPUSD_ticks_202601.csv", (time.time() - 500,) * 2)  # old enough now
    sweep()
    assert said == ["AUDUSD_ticks_202601.csv", "EURUSD_ticks_202601.csv"]  # the malformed one isn't reported again
    assert os.path.exists(f"{inbox}/EURUSD_ticks_202601.csv") and not os.path.exists(f"{inbox}/GBPUSD_ticks_202601.csv")
    assert {(r.sym, r.bid) for r in exports.read_store(spark, store).collect()} == {("EURUSD", 1.1), ("GBPUSD", 5.1)}
    export(inbox, [(BASE, 2.1)], "AUDUSD_ticks_202601.csv", age=900)  # mended
    export(inbox, [(BASE, 1.1), (BASE + 1, 1.2)], age=800)
    sweep()
    assert {(r.sym, r.bid) for r in exports.read_store(spark, store).collect()} == {("EURUSD", 1.1), ("EURUSD", 1.2), ("GBPUSD", 5.1), ("AUDUSD", 2.1)}
    assert len(os.listdir(old)) == 5 and os.listdir(inbox) == ["EURUSD_ticks_2026.csv"]


def test_watch_goes_on_and_restarts(spark, tmp_path):
    inbox, store, said = str(tmp_path / "in"), str(tmp_path / "store"), []
    stored = lambda: {r.sym for r in exports.read_store(spark, store).collect()}
    names = ["EURUSD_ticks_202601.csv", "GBPUSD_ticks_202601.csv"]
    for turn, name in enumerate(names):
        query = stream.watch_exports(spark, inbox, store, lambda f, why: said.append(f), idle_seconds=0, once=False, every="1 second")
        try:
            export(inbox, [(BASE, 1.1)], name, age=5)
            until = time.time() + 60
            while time.time() < until and query.isActive:
                if os.path.isdir(f"{store}/_taken") and len([x for x in os.listdir(f"{store}/_taken") if not x.startswith(".")]) == turn + 1:
                    break
                time.sleep(0.2)
        finally:
            query.stop()
        assert stored() == {n[:6] for n in names[: turn + 1]} and not said


def test_drained_streams_append_each_window_once(spark, tmp_path):
    rows = [("f", "P", BASE + 60_000 * i, i, i, 1.0 + i, 2.0 + i) for i in range(0, 4000, 7)]
    ticks = spark.createDataFrame(rows, "feed string, pair string, utc_ms bigint, seq bigint, tick_id bigint, bid double, ask double")
    for part in range(4):  # files in order of time, one per trigger
        ticks.where(f"seq >= {part * 1000} AND seq < {part * 1000 + 1000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    got = stream.drained(stream.read_ticks(spark, str(tmp_path / "ticks"), 1), lambda s: stream.tumbling(s, 60, "1 hour"), "test").collect()
    assert sum(r.n_ticks for r in got) == len(rows) and len(got) == len({(r.sym, r.bar_ms) for r in got}) == len({r[2] // 3_600_000 for r in rows})


def test_synthetic_is_seeded_and_calm_on_fridays(spark):
    a, b = (synthetic.generate(spark, "2024-01-01", "2024-01-05").repartition(n) for n in (2, 5))
    assert a.exceptAll(b).isEmpty() and a.where("ask <= bid").isEmpty()
    asia = a.where("seq < 840").groupBy("sym", F.weekday(F.timestamp_millis("utc_ms")).alias("d")).agg((F.max("bid") - F.min("bid")).alias("r")).groupBy("d").agg(F.avg("r").alias("r"))
    r = {x.d: x.r for x in asia.collect()}
    assert r[4] < 0.6 * r[1]


def quotes(spark, n=4):
    return spark.createDataFrame([("P", "2024-01-01", i, 1.0 + i) for i in range(n)], "sym string, london_date string, utc_ms bigint, bid double")


def test_content_hash_ignores_order_and_sees_changes(spark):
    a = quotes(spark)
    assert G.snapshot(a) == G.snapshot(a.orderBy(F.desc("bid")).repartition(3))
    assert G.snapshot(a) != G.snapshot(a.withColumn("bid", F.when(F.col("utc_ms") == 1, 9.0).otherwise(F.col("bid"))))
    with pytest.raises(G.Mismatch):
        G.reject_mismatch(G.snapshot(a), G.snapshot(quotes(spark, 5)), "store")


def test_preconditions(spark):
    q = quotes(spark)
    s = spark.createDataFrame([("P", "2024-01-01"), ("P", "2024-01-02")], "sym string, london_date string")
    run = G.manifest(q, s, [202401], True)
    gates = {"store": run["store"], "expected_months": [202401], "pairs": {"P": {"data_pass": True, "total_ticks": 4, "bars_checked": 1, "months_missing": []}}}
    check = lambda r=run, g=gates, t=s, live=run["store"]: G.preconditions(r, g, t, live, ("P",))
    assert check() == []
    assert check(r={**run, "store": None}) and check(r={**run, "universe_complete": False}) and check(g={**gates, "expected_months": [1]})
    assert check(live=G.snapshot(quotes(spark, 3)))
    for k in ("total_ticks", "bars_checked", "data_pass"):
        assert check(g={**gates, "pairs": {"P": {**gates["pairs"]["P"], k: 0}}})
    assert check(g={**gates, "pairs": {"P": {**gates["pairs"]["P"], "months_missing": [202402]}}})
    assert check(t=s.union(s)) and check(t=s.limit(1)) and check(r={**run, "shards": {"P/202401": {"chronology": "recovered-unordered"}}})


def test_render_needs_its_binding():
    report = {"title": "T", "verdict": "FAIL", "snapshot_id": "x", "statistics": {"a": {"point": 1.0, "ci": (0.5, 1.5)}}}
    assert "[+0.500, +1.500]" in G.render(report, "x")
    for bound in (None, "y"):
        with pytest.raises(G.Mismatch):
            G.render(report, bound)


def test_missing_months(spark):
    q = spark.createDataFrame([("P", BASE), ("P", BASE + 60 * 86_400_000)], "sym string, utc_ms bigint")
    assert [(r.sym, r.yyyymm) for r in Q.missing_months(q, 202601, 202603).collect()] == [("P", 202602)]
    with pytest.raises(ValueError, match="reversed"):
        Q.missing_months(q, 202602, 202601)


CORE = [n for n in entry.queries() if not n.startswith(("p3", "p4", "p5", "p7", "p8", "p9"))]


@pytest.mark.parametrize("name", CORE)
def test_queries_agree_with_their_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in sorted(df.columns))} FROM ({sql})').fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scratch_folder():
    """On a cluster a machine-local folder is refused; scratch is gone after the driver."""
    import subprocess
    import sys

    code = """
import sys
from types import SimpleNamespace
from pyspark.sql import SparkSession
from tickloom import session
conf = SimpleNamespace(get=lambda k, d=None: None, set=lambda k, v: None)
for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
    try:
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
        raise SystemExit(master)
    except RuntimeError:
        pass
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = session.cut(spark.range(5))
spark.range(3).write.parquet(session.scratch_path(spark, "x"))
assert df.count() == 5
print("SCRATCH", session.shared_dir(spark))
spark.stop()
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    root = next(line.split(" ", 1)[1] for line in ran.stdout.splitlines() if line.startswith("SCRATCH"))
    assert not [f for _, _, files in os.walk(root) for f in files]


def test_queries_without_the_subpackage(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "tickloom.llm.queries", None)  # importing it raises ImportError
    names = entry.queries()
    assert "p1_found" in names and "dq_06_store_gate" in names and not [n for n in names if n.startswith(("p3", "p4", "p5", "p7", "p8", "p9"))]
    assert set(entry.oracle_sql()) <= set(names)
