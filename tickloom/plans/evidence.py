"""The evidence chain: gates, sessions, inference. Each step writes its result bound to the snapshot it was made from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import governance as G
from tickloom.frozen import FROZEN, Frozen, inconsistencies
from tickloom.operators import quotes as Q
from tickloom.operators import sessions as X
from tickloom.operators import stats as T
from tickloom.session import cut, listing, read_text, write_text


def _months(first: int, last: int) -> list[int]:
    if first > last:
        raise ValueError("the span is reversed")
    a, z = (m // 100 * 12 + m % 100 - 1 for m in (first, last))
    return [k // 12 * 100 + k % 12 + 1 for k in range(a, z + 1)]


STORED = ("sym", "utc_ms", "seq", "bid", "ask")


def gates(quotes: DataFrame, first: int, last: int, pairs: tuple[str, ...] | None = None, strict: bool = True, store: dict | None = None) -> dict:
    """The gate report: one entry per pair. A pair without any quote is there and fails; ``strict=False`` overlooks bar mismatches.

    ``store`` is the quotes' snapshot where it has been taken already. The store must not change meanwhile: its files are
    listed before and after, and only hashed again if the listings differ.
    """
    files = listing(quotes)
    snapshot = store or G.snapshot(quotes.select(*STORED))
    found = {}
    for r in Q.store_gate(quotes, first, last).toLocalIterator():  # one row per pair
        mismatch = r.high_mismatch + r.low_mismatch
        ok = r.data_pass or (not strict and r.n > 0 and r.bars_checked > 0 and not (r.n_crossed or r.n_zero or r.months_missing))
        found[r.sym] = {"data_pass": bool(ok), "total_ticks": r.n, "bars_checked": r.bars_checked, "months_missing": r.months_missing, "n_crossed": r.n_crossed, "n_zero": r.n_zero, "n_jumps": r.n_jumps, "bar_mismatch": mismatch, "longest_gap_min": r.longest_gap_min}
    for p in pairs or ():
        found.setdefault(p, {"data_pass": False, "total_ticks": 0, "bars_checked": 0, "months_missing": len(_months(first, last))})
    if listing(quotes) != files and G.snapshot(quotes.select(*STORED)) != snapshot:
        raise G.Mismatch("the store changed during the gates")
    return {"store": snapshot, "expected_months": _months(first, last), "pairs": found, "data_pass": bool(found) and all(x["data_pass"] for x in found.values())}


def session_run(quotes: DataFrame, first: int, last: int, pairs: tuple[str, ...] | None = None, p: Frozen = FROZEN, store: dict | None = None, **profile) -> tuple[DataFrame, dict]:
    """(session table, manifest). A pair without quotes leaves the universe incomplete instead of ending the run."""
    wrong = inconsistencies(p)
    if wrong:
        raise ValueError("; ".join(wrong))
    table = cut(X.session_table(Q.closes(quotes), p, **profile).withColumn("london_date", F.date_format("london_date", "yyyy-MM-dd")))
    # One row per pair and calendar month at most.
    missing: dict[str, list[int]] = {}
    for r in Q.missing_months(quotes, first, last).orderBy("sym", "yyyymm").collect():
        missing.setdefault(r.sym, []).append(r.yyyymm)
    have = {r.sym for r in table.select("sym").distinct().collect()}
    run = G.manifest(store or quotes.select(*STORED), table, _months(first, last), not missing and have >= set(pairs or have), missing)
    run["exclusions"] = {r.reason: r.n for r in table.where("NOT valid").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    return table, run


def flagged_sessions(sessions: DataFrame, p: Frozen = FROZEN) -> DataFrame:
    """The valid sessions with both percentiles and the flag, from the first session that has a percentile on."""
    returns = [f"absr_{h}m" for h in p.horizons]
    panel = sessions.where("valid").select("sym", F.to_date("london_date").alias("day"), "dst_summer", "asia_hi", "asia_lo", "ldn_hi", "ldn_lo", "asia_range", "ldn_range", "expansion_ratio", *returns)
    return T.flags(panel, p.lookback, p.threshold).where("comp_pct IS NOT NULL")


def inference(sessions: DataFrame, run: dict, gate_report: dict, live: dict, pairs: tuple[str, ...], p: Frozen = FROZEN, draws: int | None = None, store: dict | None = None, flagged: DataFrame | None = None) -> dict:
    """The report with statistics, tests and both versions' verdicts; raises Mismatch with all reasons if the evidence doesn't belong together."""
    bad = G.preconditions(run, gate_report, sessions, live, pairs, store)
    if bad:
        raise G.Mismatch("; ".join(bad))
    flagged = cut(flagged_sessions(sessions, p)) if flagged is None else flagged
    found = {r.statistic: r.asDict() for r in T.joint_block_bootstrap(flagged, draws or p.draws, p.block, p.seed).collect()}
    stats = {k: {"point": r["point"], "ci": (r["low"], r["high"]) if r["low"] is not None else None, "excludes_zero": r["excludes_zero"], "valid_draws": r["valid"]} for k, r in found.items()}
    signs = {k: {r.sym: r.difference for r in T.mean_difference(flagged, c).collect()} for k, c in (("ratio", "expansion_ratio"), ("60", "absr_60m"), ("180", "absr_180m"))}
    said, checks = T.decide(found, signs["60"])
    pooled = T.summarize(flagged, draws or p.draws, p.horizons)
    first, first_checks = T.decide_first(pooled, signs)
    relative = {r.compressed: r.mean_of_means for r in T.mean_of_means(flagged.withColumn("bp", T.relative_range_bp("ldn_hi", "ldn_lo")), "bp").collect()}
    report = {
        "title": "Quiet mornings and the session after", "verdict": said, "checks": checks, "promotable": G.promotable(pairs, p.primary),
        "statistics": {k: v for k, v in stats.items() if v["point"] is not None}, "signs": signs["60"], "signs_by_value": signs,
        "first_version": {"verdict": first, "checks": first_checks, "pooled": pooled}, "london_relative_range_bp": {"compressed": relative.get(True), "other": relative.get(False)},
        "by_summer_time": [r.asDict() for r in T.mean_difference(flagged, "absr_60m", ("dst_summer",)).collect()],
    }
    return G.bind(report, live)


def summary(sessions: DataFrame) -> dict:
    """Per pair, pooled and per pair and year: the figures of the expansion ratio, shares of summer time, and counts of valid and invalid sessions."""
    rows = [r.asDict() for r in T.pair_summaries(sessions).collect()]
    valid = sessions.where("valid").withColumn("day", F.to_date("london_date"))
    years = [r.asDict() for r in T.rollup_year(valid, "expansion_ratio").where("level = 0").collect()]
    return {"summaries": rows, "sessions": {r["sym"]: (r["n_valid"], r["n_invalid"], r["dst_share"]) for r in rows if not r["pooled"]}, "years": years}


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str, sort_keys=True))


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON document of an earlier step; Mismatch if the step hasn't run."""
    text = read_text(spark, path)
    if text is None:
        raise G.Mismatch(f"{path} is missing: run the step before")
    return json.loads(text)


def infer_from_files(spark: SparkSession, quotes: DataFrame, out: str, pairs: tuple[str, ...] | None = None, root: str | None = None, p: Frozen = FROZEN, draws: int | None = None, live: dict | None = None) -> dict:
    """Inference on the evidence that earlier steps left in ``out``: nothing but the files and the store as it is now is believed.

    Without ``pairs`` the frozen universe is required; ``root`` is the store's folder, whose own manifest then counts too. Writes the
    flagged sessions and report.json, and entry.md if there is a verdict.
    """
    required = pairs or p.primary
    flagged = None
    try:
        run, report = read_json(spark, f"{out}/manifest.json"), read_json(spark, f"{out}/data_gates.json")
        if read_text(spark, f"{out}/summary.json") is None:
            raise G.Mismatch(f"{out}/sessions.parquet is missing: run the step before")
        sessions = spark.read.parquet(f"{out}/sessions.parquet")
        saved = json.loads(read_text(spark, f"{root.rstrip('/')}/{G.STORE_MANIFEST}") or "{}") if root else None
        live = live or G.snapshot(quotes.select(*STORED))
        flagged = cut(flagged_sessions(sessions, p))
        found = inference(sessions, run, report, live, required, p, draws, saved, flagged)
    except G.Mismatch as why:
        found = {"verdict": None, "refused": str(why), "promotable": False}
    else:
        flagged.write.mode("overwrite").parquet(f"{out}/sessions_flagged.parquet")
        write_text(spark, f"{out}/entry.md", G.render(found, live["snapshot_id"]))
    write_json(spark, found, f"{out}/report.json")
    return found


def whole_run(spark: SparkSession, quotes: DataFrame, first: int, last: int, out: str, pairs: tuple[str, ...], draws: int | None = None, root: str | None = None, p: Frozen = FROZEN, **profile) -> dict:
    """All steps over a store's quotes; a failing gate doesn't stop the sessions, but it does stop the inference.

    The quotes are hashed once. If the store's files are the same at the end, so is the snapshot; otherwise it is taken again, and inference refuses.
    """
    kept, log = Q.clean(quotes)
    removed = {f"{r.sym}/{r.reason}": r.removed for r in log.collect()}
    files = listing(kept)
    store = G.snapshot(kept.select(*STORED))
    report = gates(kept, first, last, pairs, store=store)
    write_json(spark, {**report, "removed": removed}, f"{out}/data_gates.json")
    sessions, run = session_run(kept, first, last, pairs, p, store, **profile)
    sessions.write.mode("overwrite").parquet(f"{out}/sessions.parquet")
    write_json(spark, run, f"{out}/manifest.json")
    figures = summary(sessions)
    write_json(spark, figures, f"{out}/summary.json")
    write_text(spark, f"{out}/sessions.md", G.render_sessions(figures, run, store["snapshot_id"]))
    live = store if listing(kept) == files else None
    return infer_from_files(spark, kept, out, pairs, root, p, draws, live)
