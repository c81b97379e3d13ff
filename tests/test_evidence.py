"""The evidence chain end to end on synthetic quotes, through the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom import governance as G
from tickloom.__main__ import main
from tickloom.frozen import Frozen
from tickloom.operators.quotes import month_of
from tickloom.plans import evidence as V
from tickloom.sources import exports, synthetic


def _quotes(spark, pairs=2, last="2024-01-31"):
    names = dict(list(synthetic.PAIRS.items())[:pairs])
    return synthetic.generate(spark, "2024-01-01", last, pairs=names).withColumn("yyyymm", month_of()), tuple(sorted(names))


def test_gates_name_pairs_without_quotes(spark):
    q, pairs = _quotes(spark, 1, "2024-01-03")
    report = V.gates(q, 202401, 202401, (*pairs, "ZZZZZZ"))
    assert report["pairs"][pairs[0]]["data_pass"] and not report["pairs"]["ZZZZZZ"]["data_pass"] and not report["data_pass"]
    crossed = V.gates(q.withColumn("ask", F.when(F.col("seq") == 5, F.col("bid") - 1).otherwise(F.col("ask"))), 202401, 202402)
    assert not crossed["data_pass"] and crossed["pairs"][pairs[0]]["months_missing"] == 1


def test_whole_run(spark, tmp_path):
    q, pairs = _quotes(spark)
    exports.write_store(q, str(tmp_path / "store"))
    read = lambda: exports.read_store(spark, str(tmp_path / "store")).withColumn("tick_id", F.col("seq"))
    table, run = V.session_run(read(), 202401, 202401, pairs, london_bars=100)
    report = V.gates(read(), 202401, 202401, pairs)
    live = G.snapshot(read().select("sym", "utc_ms", "seq", "bid", "ask"))
    p = Frozen(lookback=5)
    found = V.inference(table, run, report, live, pairs, p, draws=120)
    assert found["verdict"] in ("PASS", "MECHANICAL", "FAIL") and set(found["signs"]) <= set(pairs) and live["snapshot_id"] in G.render(found, live["snapshot_id"])
    assert found["first_version"]["verdict"] in ("PASS", "MECHANICAL", "FAIL") and set(found["first_version"]["pooled"]["returns"]) == {15, 30, 60, 180} and not found["promotable"]
    assert {"draws", "point"} - set(found["statistics"]["ratio_mean"]) == {"draws"} and found["code"]["files"]
    with pytest.raises(G.Mismatch, match="changed since the run"):
        V.inference(table.withColumn("asia_range", F.col("asia_range") * 2), run, report, live, pairs, p)
    with pytest.raises(ValueError, match="reversed"):
        V.session_run(read(), 202402, 202401, pairs)
    with pytest.raises(ValueError, match="overlap"):
        V.session_run(read(), 202401, 202401, pairs, Frozen(asia_minutes=(0, 500)))
    assert main(["run", str(tmp_path / "store"), str(tmp_path / "out"), "202401", "202401", "--pairs", ", ".join(pairs).lower(), "--draws", "10"]) == 0
    assert json.loads((tmp_path / "out/data_gates.json").read_text())["data_pass"] is True
    assert json.loads((tmp_path / "out/manifest.json").read_text())["universe_complete"] is True
    assert spark.read.parquet(str(tmp_path / "out/sessions.parquet")).count() == 46
    assert main(["run", str(tmp_path / "store"), str(tmp_path / "out"), "202401", "202401", "--pairs", "QQQQQQ"]) == 1


def test_ingest_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "store")]) == 1
    (tmp_path / "in/EURUSD_ticks_202401.csv").write_text("utc_ms,bid,ask\n1704100000000,1.1,1.2\n1704100000000,1.3,1.4\n")
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "store"), "--pairs", "eurusd"]) == 0
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "store")]) == 0  # again: nothing changes
    assert [(r.bid, r.seq) for r in exports.read_store(spark, str(tmp_path / "store")).orderBy("seq").collect()] == [(1.1, 0), (1.3, 1)]


def test_normalised_store_is_marked(spark, tmp_path):
    spark.sql("SELECT timestamp_millis(1704100000000 + id) AS t, 1.0D + id AS bid, 2.0D + id AS ask FROM range(3)").write.parquet(str(tmp_path / "old/EURUSD"))
    marks = exports.normalize_store(spark, {"EURUSD": str(tmp_path / "old/EURUSD")}, str(tmp_path / "store"))
    assert marks == {"EURUSD/202401": {"chronology": "recovered-unordered"}}
    assert exports.read_store(spark, str(tmp_path / "store")).count() == 3
    assert exports.stored_months(spark, str(tmp_path / "store"), "EURUSD") == [202401]


def test_evidence_is_read_back_from_files(spark, tmp_path):
    q, pairs = _quotes(spark)
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    exports.write_store(q, root)
    read = lambda: exports.read_store(spark, root).withColumn("tick_id", F.col("seq"))
    p = Frozen(lookback=5, primary=pairs)
    assert "missing" in V.infer_from_files(spark, read(), out, root=root, p=p, draws=120)["refused"]
    found = V.whole_run(spark, read(), 202401, 202401, out, pairs, 120, root, p, london_bars=100)
    assert found["verdict"] in ("PASS", "MECHANICAL", "FAIL") and found["promotable"]
    assert spark.read.parquet(f"{out}/sessions_flagged.parquet").columns[-1] == "compressed"
    assert "| all |" in (tmp_path / "out/sessions.md").read_text() and "Verdict" in (tmp_path / "out/entry.md").read_text()
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    table = spark.read.parquet(f"{out}/sessions.parquet")
    assert manifest["unique_sessions"] == {s: table.where(f"valid AND sym = '{s}'").count() for s in pairs} and manifest["months_missing"] == {}
    # A saved store manifest binds; once bound it doesn't change.
    live = G.snapshot(read().select(*V.STORED))
    assert G.store_manifest(spark, root, live)["snapshot_id"] == live["snapshot_id"] == G.store_manifest(spark, root, live)["snapshot_id"]
    with pytest.raises(G.Mismatch):
        G.store_manifest(spark, root, {**live, "snapshot_id": "other"})
    again = lambda: V.infer_from_files(spark, read(), out, root=root, p=p, draws=120)
    assert again()["verdict"] == found["verdict"]
    for change in ({"universe_complete": False}, {"months_missing": {pairs[0]: [202401]}}, {"unique_sessions": {}}, {"store": {}}, {"expected_months": []}):
        (tmp_path / "out/manifest.json").write_text(json.dumps({**manifest, **change}))
        assert again()["verdict"] is None
    (tmp_path / "out/manifest.json").write_text(json.dumps(manifest))
    G.mark_shards(spark, root, {f"{pairs[0]}/202401": {"chronology": "recovered-unordered"}})
    assert "settled order" in again()["refused"]
    with pytest.raises(G.Mismatch):
        G.render_sessions(V.summary(table), manifest, "other")


def test_recovery_rewrites_the_store(spark, tmp_path):
    from tickloom.operators.refresh import Conflict, first_per_session

    root, inbox = str(tmp_path / "store"), tmp_path / "in"
    inbox.mkdir()
    file = inbox / "EURUSD_ticks_202401.csv"
    write = lambda rows: file.write_text("utc_ms,bid,ask\n" + "".join(f"{t},{b},{b + 1}\n" for t, b in rows))
    t = 1704100000000
    write([(t, 1.0), (t, 2.0), (t, 3.0)])
    exports.write_store(exports.read_exports(spark, str(inbox)), root)
    write([(t, 3.0), (t, 1.0), (t, 2.0)])
    assert exports.recover_store(spark, str(inbox), root) == {"EURUSD/202401": {"rebuilt_rows": 3, "chronology": "source-arrival"}}
    stored = lambda: [r.bid for r in exports.read_store(spark, root).orderBy("seq").collect()]
    assert stored() == [3.0, 1.0, 2.0]
    write([(t, 1.0)])
    with pytest.raises(Conflict, match="2 stored quotes"):
        exports.recover_store(spark, str(inbox), root)
    assert stored() == [3.0, 1.0, 2.0]
    assert exports.recover_store(spark, str(inbox), root, allow_loss=True)["EURUSD/202401"]["lost_occurrences"] == 2 and stored() == [1.0]
    assert json.loads((tmp_path / "store/_manifest.json").read_text())["shards"]["EURUSD/202401"]["lost_ms"] == [t]
    write([])
    with pytest.raises(Conflict, match="no quotes"):
        exports.recover_store(spark, str(inbox), root)
    rows = spark.createDataFrame([("P", "2024-02-01", 202402, 2.0), ("P", "2024-02-01", 202401, 1.0), ("P", "2024-02-02", 202402, 3.0)], "sym string, london_date string, yyyymm int, v double")
    assert sorted((r.london_date, r.v) for r in first_per_session(rows).collect()) == [("2024-02-01", 1.0), ("2024-02-02", 3.0)]


def test_store_ranges_with_padding(spark, tmp_path):
    root, month = str(tmp_path / "store"), 86_400_000 * 31
    rows = [("P", 202312 if i == 0 else 202400 + i, 1703500000000 + i * month, i, 1.0, 1.1) for i in range(4)]
    exports.write_store(spark.createDataFrame(rows, "sym string, yyyymm int, utc_ms bigint, seq bigint, bid double, ask double"), root)
    seqs = lambda **k: sorted(r.seq for r in exports.read_store(spark, root, "P", rows[2][2], rows[2][2], **k).collect())
    assert seqs() == [2] and seqs(pad_months=1) == [1, 2, 3] and seqs(pad_months=9) == [0, 1, 2, 3]
    with pytest.raises(LookupError):
        exports.read_store(spark, root, "Q", required=True)
