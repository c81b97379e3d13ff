"""The queries of the problems 3, 4, 5, 7, 8 and 9, and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.increment import PARAGRAPH_MS, History, admit, contents, coverage
from tickloom.llm.leakage import leaks
from tickloom.llm.mixing import mix, token_counts
from tickloom.llm.percentiles import exact_percentiles
from tickloom.llm.runs import collapse_runs
from tickloom.llm.truncation import truncated
from tickloom.session import cut
from tickloom.sources.tables import SOURCE, counting_sessions, number, table, usable_ticks, with_pip


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    ticks = with_pip(usable_ticks(table(spark, d, "ticks")), table(spark, d, "quote_sources"))
    near = 0.04 * F.col("pip")
    return collapse_runs(ticks, SOURCE, "utc_ms", ("seq", "tick_id"), {"bid": near, "ask": near}, 60 * 60_000, least)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 3).select("feed", "pair", "start_ms", "end_ms")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 1).select("feed", "pair", "start_ms", "end_ms", "n", "duration_ms", "first_bid", "first_ask")


def _exports(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "tick_exports").select(*SOURCE, "utc_ms", number("bid").alias("bid"), number("ask").alias("ask"), F.col("export_id").alias("id"), F.struct("batch_no", "line_no").alias("rank"))
    return with_pip(lines, table(spark, d, "quote_sources"))


def _deliveries(lines: DataFrame, least: int = 2) -> list[DataFrame]:
    """The files in deliveries of consecutive batch numbers, so that later ones meet the hashes that earlier ones have left in the history."""
    batch = F.col("rank.batch_no")
    ends = lines.agg(F.percentile_approx(batch, [i / least for i in range(1, least)], 10_000).alias("e")).first()["e"] or []
    ends = sorted(set(ends))
    parts = [lines.where(batch <= ends[0])] + [lines.where((batch > a) & (batch <= b)) for a, b in zip(ends, ends[1:])] + [lines.where(batch > ends[-1])] if ends else [lines]
    return parts


def _history(spark: SparkSession, d: str) -> tuple[History, DataFrame]:
    ticks = with_pip(usable_ticks(table(spark, d, "ticks")), table(spark, d, "quote_sources")).withColumnRenamed("tick_id", "id").where("pip IS NOT NULL")
    return History(spark), ticks


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    history, ticks = _history(spark, d)
    try:
        history.append(ticks)
        parts = _deliveries(_exports(spark, d))
        # The last delivery's hashes would only be read by a next one.
        found = [admit(part, history, append=i + 1 < len(parts))[0] for i, part in enumerate(parts)]
    finally:
        history.drop()
    return reduce(DataFrame.unionByName, found).select("accepted_id", F.col("id").alias("export_id"))


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """Per file: its lines, those with both prices, how many of them are copies, whether it brings nothing new, and how much of it stands in
    paragraphs that the accepted quotes or earlier files have as a whole, up to the whole file."""
    history, ticks = _history(spark, d)
    lines = _exports(spark, d)
    found, covered = [], []
    try:
        history.append(ticks)
        history.append_contents(contents(ticks, F.lit(-1)))
        parts = _deliveries(lines)
        for i, part in enumerate(parts):
            own = cut(contents(part, F.col("rank.batch_no")))
            covered.append(cut(coverage(own, history)))
            found.append(admit(part, history, append=i + 1 < len(parts))[0])
            if i + 1 < len(parts):
                history.append_contents(own)
    finally:
        history.drop()
    copies, covered = (reduce(DataFrame.unionByName, x) for x in (found, covered))
    priced = F.count(F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), 1))
    per = lines.join(copies, "id", "left").groupBy(F.col("rank.batch_no").alias("batch_no"))
    per = per.agg(F.count("*").alias("lines"), priced.alias("priced"), F.count("accepted_id").alias("copies"), (priced == F.count("accepted_id")).alias("nothing_new"))
    per = per.join(covered.withColumnRenamed("batch", "batch_no"), "batch_no", "left").na.fill(0, ["contents", "known_contents"]).na.fill(False, ["full_copy"])
    return per.select("batch_no", "lines", "priced", "copies", "nothing_new", "contents", "known_contents", F.round("covered_share", 9).alias("covered_share"), "full_copy")


METRICS = ("expansion_ratio", "ldn_range")


def _figures(spark: SparkSession, d: str) -> DataFrame:
    counting = counting_sessions(table(spark, d, "sessions"), *METRICS)
    return counting.select("feed", "pair", F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*METRICS))).alias("metric", "v"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    figures = cut(_figures(spark, d))
    found = exact_percentiles(figures, ("feed", "pair", "metric"), "v", (0.5, 0.9)).groupBy("feed", "pair", "metric")
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    tails = found.agg(at(0.5).alias("median"), at(0.9).alias("p90")).where("p90 >= 4 * median")
    enough = figures.groupBy("feed", "pair", "metric").agg(F.count("*").alias("sessions")).where("sessions >= 40")
    return tails.join(enough, ["feed", "pair", "metric"], "left_semi").select("feed", "pair", "metric")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per source and, as feed ``*``, per pair."""
    figures = cut(_figures(spark, d))
    both = figures.unionByName(figures.withColumn("feed", F.lit("*")))
    found = exact_percentiles(both, ("feed", "pair", "metric"), "v", (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))
    return found.select("feed", "pair", "metric", "p", "n", F.round("value", 9).alias("value"), "error")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", "answer").where("kind = 'passage'").select("item_id", "doc_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: the documents that give it away, those that hold the answer too, paraphrases, and the longest stretch."""
    found = leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", "answer")
    whole, answered = F.col("kind") == "passage", F.col("answer") >= 0.9
    return found.groupBy("item_id").agg(F.count_if(whole).alias("documents"), F.count_if(whole & answered).alias("with_answer"), F.count_if(~whole).alias("paraphrases"), F.max("span").alias("longest_span"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix(token_counts(table(spark, d, "documents"), "doc_id", "text", "source"), "doc_id", table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture, per target source that has files: every file counted, the rows add up to the report, none is used more often
    than allowed, the budget is never exceeded, and no file that was used less often than others would still fit what is left of it."""
    counts = cut(token_counts(table(spark, d, "documents"), "doc_id", "text", "source"))
    mixture, report = mix(counts, "doc_id", table(spark, d, "mix_targets"))
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_by_rows"), F.max("copies").alias("most"), F.count_distinct("doc_id").alias("ids"), F.count("*").alias("rows"))
    plan = report.where("files > 0").withColumn("residual", F.col("budget") - F.col("used")).withColumn("whole", F.floor(F.col("budget") / F.col("available")))
    spare = counts.where("tokens > 0").join(mixture.select("doc_id", "copies"), "doc_id", "left").join(plan.select("source", "residual", "whole", "max_repeats"), "source")
    spare = spare.where("coalesce(copies, 0) = whole AND whole < max_repeats AND tokens <= residual").groupBy("source").agg(F.count("*").alias("fitting"))
    rows = plan.join(used, "source", "left").join(spare, "source", "left").na.fill(0, ["used_by_rows", "most", "ids", "rows", "fitting"])
    return rows.select(
        "source", "files", (F.col("used_by_rows") == F.col("used")).alias("adds_up"), (F.col("ids") == F.col("rows")).alias("one_row_per_file"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"),
        (F.col("residual") >= 0).alias("within_budget"), (F.col("fitting") == 0).alias("nothing_fits"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents"), "doc_id", "text", "source").where("cut").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source: files, cut files and their share, and the cut files by reason."""
    judged = truncated(table(spark, d, "documents"), "doc_id", "text", "source")
    reasons = [F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in ("copy", "structure", "pace", "limit", "open")]
    return judged.groupBy("source").agg(F.count("*").alias("files"), F.count_if("cut").alias("cut_files"), F.avg(F.col("cut").cast("double")).alias("cut_share"), *reasons)


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_runs, p4_found, p4_batches, p5_found, p5_percentiles, p7_found, p7_items, p8_mix, p8_shares, p8_checks, p9_found, p9_sources)}


_RUNS = """
WITH t AS (SELECT t.feed, t.pair, utc_ms, seq, tick_id, bid, ask, pip FROM ticks t LEFT JOIN quote_sources q ON t.feed = q.feed AND t.pair = q.pair
  WHERE utc_ms IS NOT NULL AND bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)),
s AS (SELECT *, CASE WHEN abs(bid - lag(bid) OVER w) < 0.04 * pip AND abs(ask - lag(ask) OVER w) < 0.04 * pip AND utc_ms - lag(utc_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS new
  FROM t WINDOW w AS (PARTITION BY feed, pair ORDER BY utc_ms, seq, tick_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY feed, pair ORDER BY utc_ms, seq, tick_id) AS run FROM s),
runs AS (SELECT feed, pair, run, min(utc_ms) AS start_ms, max(utc_ms) AS end_ms, count(*) AS n, max(utc_ms) - min(utc_ms) AS duration_ms,
  arg_min(bid, (utc_ms, seq, tick_id)) AS first_bid, arg_min(ask, (utc_ms, seq, tick_id)) AS first_ask FROM r GROUP BY 1, 2, 3)
"""

_FIGURES = """
WITH usable AS (
  SELECT feed, upper(regexp_replace(pair, '[^A-Za-z]', '', 'g')) AS pair, left(regexp_replace(london_date, '\\D', '', 'g'), 8) AS day,
    expansion_ratio, ldn_range, loaded_at, session_id
  FROM sessions WHERE valid AND asia_range IS NOT NULL AND NOT isnan(asia_range) AND asia_range > 0),
counting AS (SELECT feed, pair, day, arg_max({'e': expansion_ratio, 'l': ldn_range}, (loaded_at, session_id)) AS x FROM usable GROUP BY 1, 2, 3),
figures AS (SELECT feed, pair, 'expansion_ratio' AS metric, CASE WHEN isnan(x.e) THEN NULL ELSE x.e END AS v FROM counting
  UNION ALL SELECT feed, pair, 'ldn_range', CASE WHEN isnan(x.l) THEN NULL ELSE x.l END FROM counting)
"""


_NEAR = "abs(l.utc_ms - {o}.utc_ms) < 1000 AND abs(l.bid - {o}.bid) < 0.05 * l.pip AND abs(l.ask - {o}.ask) < 0.05 * l.pip"

#: st holds, round by round, which lines are copies (1), accepted (0) or open (NULL): a line follows from the earlier lines near it.
_LINES = f"""
WITH RECURSIVE k AS (SELECT t.feed, t.pair, utc_ms, bid, ask, tick_id AS id, pip FROM ticks t JOIN quote_sources q ON t.feed = q.feed AND t.pair = q.pair
  WHERE utc_ms IS NOT NULL AND bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)),
l AS (SELECT e.feed, e.pair, utc_ms, bid, ask, export_id AS id, pip, batch_no, line_no FROM tick_exports e JOIN quote_sources q ON e.feed = q.feed AND e.pair = q.pair
  WHERE utc_ms IS NOT NULL AND bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)),
old AS (SELECT l.id, min(k.id) AS on_id FROM l JOIN k ON l.feed = k.feed AND l.pair = k.pair AND k.utc_ms BETWEEN l.utc_ms - 999 AND l.utc_ms + 999 AND {_NEAR.format(o="k")} GROUP BY 1),
new AS (SELECT l.id, o.id AS on_id FROM l JOIN l o ON l.feed = o.feed AND l.pair = o.pair AND o.utc_ms BETWEEN l.utc_ms - 999 AND l.utc_ms + 999 AND (o.batch_no, o.line_no) < (l.batch_no, l.line_no) AND {_NEAR.format(o="o")}),
st AS (SELECT l.id, CASE WHEN old.id IS NOT NULL THEN 1 WHEN NOT EXISTS (SELECT 1 FROM new WHERE new.id = l.id) THEN 0 END AS copy, 0 AS round FROM l LEFT JOIN old ON old.id = l.id
  UNION ALL SELECT s.id, coalesce(s.copy, CASE WHEN bool_or(o.copy = 0) THEN 1 WHEN bool_and(o.copy = 1 AND o.copy IS NOT NULL) THEN 0 END), s.round + 1
  FROM st s LEFT JOIN new n ON n.id = s.id LEFT JOIN st o ON o.id = n.on_id WHERE EXISTS (SELECT 1 FROM st WHERE copy IS NULL) GROUP BY s.id, s.copy, s.round),
done AS (SELECT id, copy FROM st WHERE round = (SELECT max(round) FROM st)),
copies AS (SELECT id, min(on_id) AS accepted_id FROM (SELECT * FROM old UNION ALL SELECT new.id, on_id FROM new JOIN done a ON a.id = new.id AND a.copy = 1 JOIN done o ON o.id = on_id AND o.copy = 0) GROUP BY 1)
"""

_CONTENTS = f""",
every AS (SELECT -1 AS batch_no, feed, pair, utc_ms, bid, ask, pip FROM k UNION ALL SELECT batch_no, feed, pair, utc_ms, bid, ask, pip FROM l),
c AS (SELECT DISTINCT batch_no, feed, pair, utc_ms // {PARAGRAPH_MS} AS place, utc_ms, CAST(round(bid / pip * 10) AS BIGINT) AS b, CAST(round(ask / pip * 10) AS BIGINT) AS a FROM every),
p AS (SELECT batch_no, feed, pair, place, count(*) AS n, list((utc_ms, b, a) ORDER BY utc_ms, b, a) AS body FROM c GROUP BY 1, 2, 3, 4),
f AS (SELECT batch_no, list((feed, pair, place, body) ORDER BY feed, pair, place) AS body FROM p GROUP BY 1),
pk AS (SELECT *, min(batch_no) OVER (PARTITION BY feed, pair, place, body) < batch_no AS known FROM p),
fk AS (SELECT batch_no, min(batch_no) OVER (PARTITION BY body) < batch_no AS known FROM f),
cover AS (SELECT batch_no, CAST(sum(n) AS BIGINT) AS contents, CAST(coalesce(sum(n) FILTER (WHERE known), 0) AS BIGINT) AS known_contents FROM pk GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _LINES + "SELECT accepted_id, id AS export_id FROM copies",
        "p4_batches": _LINES
        + _CONTENTS
        + """SELECT batch_no, count(*) AS lines, count(*) FILTER (WHERE bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)) AS priced, count(accepted_id) AS copies,
  count(*) FILTER (WHERE bid IS NOT NULL AND NOT isnan(bid) AND ask IS NOT NULL AND NOT isnan(ask)) = count(accepted_id) AS nothing_new,
  coalesce(any_value(cover.contents), 0) AS contents, coalesce(any_value(known_contents), 0) AS known_contents, round(any_value(known_contents)::DOUBLE / any_value(cover.contents), 9) AS covered_share, coalesce(any_value(fk.known), false) AS full_copy
FROM tick_exports e LEFT JOIN copies ON copies.id = export_id LEFT JOIN cover USING (batch_no) LEFT JOIN fk USING (batch_no) GROUP BY 1""",
        "p3_found": _RUNS + "SELECT feed, pair, start_ms, end_ms FROM runs WHERE n >= 3",
        "p3_runs": _RUNS + "SELECT feed, pair, start_ms, end_ms, n, duration_ms, first_bid, first_ask FROM runs",
        "p8_checks": """
WITH g AS (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, max(max_repeats) AS max_repeats FROM mix_targets WHERE target_share > 0 GROUP BY 1),
f AS (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, count(*) AS files FROM documents WHERE length(text) > 0 GROUP BY 1)
SELECT source, files, true AS adds_up, true AS one_row_per_file, true AS within_repeats, true AS within_budget, true AS nothing_fits FROM g JOIN f USING (source) WHERE max_repeats > 0""",
        "p5_found": _FIGURES + "SELECT feed, pair, metric FROM figures GROUP BY 1, 2, 3 HAVING count(*) >= 40 AND quantile_cont(v, 0.9) >= 4 * quantile_cont(v, 0.5)",
        "p5_percentiles": _FIGURES
        + """, both_ AS (SELECT * FROM figures UNION ALL SELECT '*', pair, metric, v FROM figures)
SELECT feed, pair, metric, CAST(p AS DOUBLE) AS p, n, round(value, 9) AS value, CAST(0 AS DOUBLE) AS error FROM (
  SELECT feed, pair, metric, count(v) AS n, unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p, unnest(quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])) AS value
  FROM both_ WHERE v IS NOT NULL GROUP BY 1, 2, 3)""",
    }
