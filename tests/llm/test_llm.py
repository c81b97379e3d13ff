"""The problems of training data on small tables: against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import leakage as L
from tickloom.llm import truncation as C
from tickloom.llm.increment import History, admit
from tickloom.llm.mixing import fit_budget, mix, token_counts
from tickloom.llm.percentiles import exact_percentiles
from tickloom.llm.runs import collapse_runs
from tickloom.llm.subtitles import repaired, shape, words

HOUR = 3_600_000


def _runs(spark, rows, least=1):
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, v double, w double, part int, n bigint, side string")
    found = collapse_runs(df, ["k"], "t", ["seq"], {"v": F.lit(0.5), "w": F.lit(0.5)}, HOUR, least).collect()
    return sorted((r.k or "", r.start_ms, r.end_ms, r.n) for r in found)


@pytest.mark.parametrize("constant", [False, True])
def test_runs_over_chunk_borders(spark, constant):
    rng = random.Random(1)
    rows, want = [], []
    for k, n in (("a", 2000), ("b", 7), (None, 50)):
        t, v, run = 0, 0.0, None
        for i in range(n):
            step = 0 if i == 0 else rng.choice([0, 1000, 60_000, 60_000, HOUR, HOUR + 1])
            if constant:
                step = min(step, HOUR)
            t += step
            move = 0.0 if constant else rng.choice([0.0, 0.0, 0.25, 0.5])
            new = i == 0 or step > HOUR or move >= 0.5
            v += move
            rows.append((k, t, i, v, 1.0, 1, 1, "x"))
            if new:
                run = [k or "", t, t, 0]
                want.append(run)
            run[2], run[3] = t, run[3] + 1
    rng.shuffle(rows)
    assert _runs(spark, rows) == sorted(map(tuple, want))
    assert _runs(spark, rows, 3) == sorted(tuple(w) for w in want if w[3] >= 3)


def test_runs_of_missing_values(spark):
    nan = float("nan")
    rows = [("a", 1, 0, 1.0, 1.0, 0, 0, ""), ("a", 2, 1, nan, 1.0, 0, 0, ""), ("a", 3, 2, None, 1.0, 0, 0, ""), ("a", None, 3, 1.0, 1.0, 0, 0, ""), ("a", 4, None, 1.0, 1.0, 0, 0, ""), ("a", 4, None, 1.0, 1.0, 0, 0, "")]
    assert _runs(spark, rows) == [("a", 1, 1, 1), ("a", 2, 2, 1), ("a", 3, 3, 1), ("a", 4, 4, 2)]
    assert _runs(spark, []) == []


def _greedy(ticks, lines):
    """Line by line, by definition."""
    accepted, out = list(ticks), set()
    for i, s, t, b, a in lines:
        if None in (t, b, a):
            continue
        near = [x[0] for x in accepted if x[1] == s and abs(x[2] - t) < 1000 and abs(x[3] - b) < 0.05 and abs(x[4] - a) < 0.05]
        if near:
            out.add((i, min(near)))
        else:
            accepted.append((i, s, t, b, a))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_new_lines_against_history_and_each_other(spark, seed):
    rng = random.Random(seed)
    value = lambda s: (s, rng.randrange(0, 30_000, 100), round(rng.choice([1.0, 1.03, 1.06, 1.2]) + rng.choice([0, 0.049, 0.0501]), 6), rng.choice([2.0, 2.04]))
    ticks = [(i, *value(rng.choice("ab"))) for i in range(60)]
    lines = [(1000 + i, *value(rng.choice("abc"))) for i in range(250)]
    lines += [(2000 + i, "a", 5, 9.0, 9.0) for i in range(40)] + [(3000, "a", 5, None, 9.0), (3001, "a", None, 1.0, 9.0)]
    schema = "id bigint, feed string, utc_ms bigint, bid double, ask double, rank bigint, pair string, pip double"
    rows = [(*x, k, "p", 1.0) for k, x in enumerate(lines)]
    old = spark.createDataFrame([(*x, 0, "p", 1.0) for x in ticks], schema)
    history = History(spark, buckets=4)
    try:
        history.append(old)
        copies, accepted = admit(spark.createDataFrame(random.Random(0).sample(rows, len(rows)), schema), history)
        want = _greedy(ticks, lines)
        assert {(r.id, r.accepted_id) for r in copies.collect()} == want
        assert accepted.count() == len(lines) - 2 - len(want)
        # A second time everything is known, from the appended hashes.
        again, none = admit(spark.createDataFrame(rows, schema), history)
        assert again.count() == len(lines) - 2 and none.count() == 0
        assert admit(spark.createDataFrame([], schema), history)[0].count() == 0
    finally:
        history.drop()


def test_history_is_not_shuffled_when_probed(spark):
    from tickloom.llm.increment import _near, probes

    schema = "id bigint, feed string, utc_ms bigint, bid double, ask double, rank bigint, pair string, pip double"
    df = spark.createDataFrame([(1, "a", 5, 1.0, 1.0, 0, "p", 1.0)], schema)
    history = History(spark, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        history.append(df)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = probes(df, "id", "rank").alias("l").join(history.read().alias("o"), _near())._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        history.drop()


@pytest.mark.parametrize("sweep", [100_000, 300])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, sweep):
    """10,000 lines 900 ms apart at one price: each depends on the one before, so every second one is a copy."""
    from tickloom.llm import increment

    n = 10_000 if sweep > 1000 else 1200
    monkeypatch.setattr(increment, "SWEEP", sweep)
    written = []
    monkeypatch.setattr(increment, "cut", lambda df, own=increment.cut: written.append(1) or own(df))
    schema = "id bigint, feed string, utc_ms bigint, bid double, ask double, rank bigint, pair string, pip double"
    lines = spark.createDataFrame([(i, "a", 900 * i, 1.0, 2.0, i, "p", 1.0) for i in range(n)], schema)
    history = History(spark, buckets=4)
    try:
        history.append(lines.where("false"))
        copies, accepted = admit(lines, history, append=False)
        assert {(r.id, r.accepted_id) for r in copies.collect()} == {(i, i - 1) for i in range(1, n, 2)} and accepted.count() == n // 2
        if sweep > 1000:
            assert len(written) <= 15
    finally:
        history.drop()


def test_chains_of_any_shape(spark, monkeypatch):
    from tickloom.llm import increment

    monkeypatch.setattr(increment, "SWEEP", 40)
    rng = random.Random(7)
    lines = [(i, rng.choice("ab"), rng.randrange(0, 90_000, 50), rng.choice([1.0, 1.03]), 2.0) for i in range(500)]
    schema = "id bigint, feed string, utc_ms bigint, bid double, ask double, rank bigint, pair string, pip double"
    history = History(spark, buckets=4)
    try:
        history.append(spark.createDataFrame([], schema))
        copies, _ = admit(spark.createDataFrame([(*x, k, "p", 1.0) for k, x in enumerate(lines)], schema), history)
        assert {(r.id, r.accepted_id) for r in copies.collect()} == _greedy([], lines)
    finally:
        history.drop()


def test_files_and_paragraphs_against_a_kept_history(spark, tmp_path):
    from tickloom.llm.increment import PARAGRAPH_MS, contents, coverage

    schema = "id bigint, feed string, pair string, utc_ms bigint, bid double, ask double, pip double, batch bigint"
    file = lambda batch, times, bid=1.0: [(1000 * batch + i, "f", "p", t, bid, 2.0, 0.1, batch) for i, t in enumerate(times)]
    early, late = [0, 5, 9], [PARAGRAPH_MS + 1, PARAGRAPH_MS + 2]
    rows = file(1, early) + file(2, early + late) + file(3, [9, 5, 0, 0]) + file(4, late) + file(5, early, 1.5) + [(9, "f", "p", None, 1.0, 1.0, 0.1, 6)]
    lines = spark.createDataFrame(rows, schema)
    own = contents(lines, F.col("batch"))
    history = History(spark, buckets=4, name="kept", path=str(tmp_path / "kept"))
    try:
        history.append_contents(contents(spark.createDataFrame(file(-1, late), schema), F.lit(-1)))
        again = History(spark, buckets=4, name="kept", path=str(tmp_path / "kept"))  # opened a second time
        got = {r.batch: (r.contents, r.known_contents, r.full_copy) for r in coverage(own, again).collect()}
        assert got == {1: (3, 0, False), 2: (5, 5, False), 3: (3, 3, True), 4: (2, 2, True), 5: (3, 0, False)}
        again.append_contents(own)
        assert all(r.full_copy and r.covered_share == 1 for r in coverage(own, history).collect())
        assert contents(lines.where("false"), F.col("batch")).count() == 0
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = coverage(own, history)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert "Bucketed: true" in plan and "LeftSemi" in plan
    finally:
        history.drop()


@pytest.mark.parametrize("kind", ["even", "tails", "ties", "single"])
def test_percentiles(spark, kind):
    rng = np.random.default_rng(2)
    make = {"even": lambda n: rng.random(n), "tails": lambda n: np.exp(rng.normal(0, 8, n)) * rng.choice([-1, 1], n), "ties": lambda n: rng.integers(0, 3, n).astype(float), "single": lambda n: rng.random(1)}[kind]
    data = {g: make(n) for g, n in (("a", 999), ("b", 20), (None, 2))}
    rows = [(g, float(v), 1) for g, x in data.items() for v in x] + [("a", None, 1), ("a", float("nan"), 1), ("a", float("inf"), 1), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    ps = (0.0, 0.1, 0.5, 0.9, 1.0)
    for parts in (df, [df.where("x > 0"), df.where("NOT x > 0 OR x IS NULL")]):
        got = {(r.g, r.p): (r.n, r.value, r.error) for r in exact_percentiles(parts, ["g"], "x", ps).collect()}
        assert set(got) == {(g, p) for g in data for p in ps}
        for (g, p), (n, v, e) in got.items():
            assert n == len(data[g]) and e == 0 and v == pytest.approx(np.quantile(data[g], p), rel=1e-12, abs=1e-300)
    rough = exact_percentiles(df, ["g"], "x", (0.5,), tolerance=0.25).collect()
    assert all(abs(r.value - np.quantile(data[r.g], 0.5)) <= 0.25 for r in rough)
    assert exact_percentiles(df.where("false"), ["g"], "x", ps).count() == 0


def test_stored_summaries_are_merged_later(spark, tmp_path):
    from tickloom.llm.percentiles import merge_summaries, summarise, summary_percentiles

    rng = np.random.default_rng(8)
    data = {"a": np.exp(rng.normal(0, 5, 4000)) * rng.choice([-1, 1], 4000), "b": np.zeros(30), None: np.array([3.0])}
    rows = [(g, float(v), i % 5) for g, x in data.items() for i, v in enumerate(x)] + [("a", None, 0), ("a", float("nan"), 1), ("c", float("inf"), 2)]
    df = spark.createDataFrame(rows, "g string, x double, day int")
    for day in range(5):
        summarise(df.where(f"day = {day}"), ["g"], "x").write.parquet(str(tmp_path / f"{day}"))
    merged = merge_summaries([spark.read.parquet(str(tmp_path / f"{day}")) for day in range(5)], ["g"])
    assert merged.count() < 2500  # by the values' span, not by the rows
    found = summary_percentiles(merged, ["g"], (0.0, 0.1, 0.5, 0.9, 1.0)).collect()
    assert {r.g for r in found} == set(data)
    for r in found:
        true = np.quantile(data[r.g], r.p)
        assert r.n == len(data[r.g]) and abs(r.value - true) <= r.error * (1 + 1e-9) + 1e-300 and r.error <= 0.0101 * max(abs(true), abs(r.value)) * 1.05


def test_shapes():
    assert shape("spoon") == shape("sp0on") and shape("modern") == shape("rnodem".replace("rnodem", "modem")[:2] + "dern") and shape("theatre") == shape("théâtre")
    assert shape("hill") == shape("lii1i") and repaired("Ã©tÃ© â€™ cafÃƒÂ©") == "été ’ café" and repaired("tâche") == "tâche"
    assert words("12\n00:00:01,5 --> 00:00:02,5\n<i>Don't</i> {x}stop") == ["don", "t", "stop"]


WORDS = [a + b for a in ("ba", "ko", "ri", "mu", "te", "so", "la", "fe", "ni", "du") for b in ("lar", "mer", "ton", "vik", "sen", "pol", "gat", "rus")]


def _texts():
    rng = random.Random(4)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passages = [say(60) for _ in range(8)]
    docs, want = [(1, None), (2, ""), (3, "..."), (4, " ".join(say(20_000)))], set()
    for i in range(10, 60):
        text = say(150)
        if i % 5 == 0:
            p = rng.randrange(8)
            at, n = rng.randrange(0, 30), rng.randrange(24, 31)
            piece = passages[p][at : at + n]
            for _ in range(2):
                piece[rng.randrange(3, n - 3)] = rng.choice(WORDS)
            piece = [w.replace("o", "0").replace("i", "1") for w in piece]
            cut = rng.randrange(8, 16)
            text[70:70] = piece[:cut] + say(5) + piece[cut:]
            want.add((p, i))
        elif i % 5 == 1:  # too short a piece
            p = rng.randrange(8)
            text[70:70] = passages[p][10:19]
        docs.append((i, " ".join(text)))
    docs.append((100, docs[-1][1]))
    return passages, docs, want


def test_leaks(spark):
    passages, docs, want = _texts()
    items = [(i, " ".join(p), 7) for i, p in enumerate(passages)] + [(50, " ".join(passages[3]), 7), (51, None, 7), (52, "short text", 7)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id bigint, text string, score double").repartition(3)
    found = L.leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, passage string, doc_id bigint"), "item_id", "passage")
    want |= {(50, d) for p, d in want if p == 3}
    assert {(r.item_id, r.doc_id) for r in found.collect()} == want
    assert L.leaks(df.where("false"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, passage string, x bigint"), "item_id", "passage").count() == 0
    assert L.leaks(df, "doc_id", "text", spark.createDataFrame([], "item_id bigint, passage string"), "item_id", "passage").count() == 0


def _syllables(rng, n):
    found = set()
    while len(found) < n:
        found.add("".join(rng.choice("bcdfgjkmnprsvz") + rng.choice("aeio") for _ in range(4)))
    return sorted(found)


def test_reworded_passages_that_come_with_their_answer(spark):
    """Passages told in another order and partly in other words: no stretch of them is left, but the words and the answer are."""
    rng = random.Random(21)
    lexicon = _syllables(rng, 6000)
    say = lambda n: [rng.choice(lexicon) for _ in range(n)]
    passages, answers = [say(70) for _ in range(60)], [say(8) for _ in range(60)]
    docs, reworded = [], set()
    for i in range(240):
        p, text = i % 60, say(150)
        pieces = [passages[p][j : j + 2] for j in range(0, 70, 2)]
        rng.shuffle(pieces)
        told = [w if rng.random() < 0.8 else rng.choice(lexicon) for piece in pieces for w in piece]
        if i < 60:
            text[60:60] = told + say(5) + answers[p]
            reworded.add((p, i))
        elif i < 120:
            text[60:60] = told  # no answer
        elif i < 180:
            text[60:60] = answers[p]  # nothing of the passage
        docs.append((i, " ".join(text)))
    items = [(i, " ".join(p), " ".join(a)) for i, (p, a) in enumerate(zip(passages, answers))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = L.leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, passage string, answer string"), "item_id", "passage", "answer").collect()
    got = {(r.item_id, r.doc_id) for r in found if r.kind == "paraphrase"}
    assert len(got & reworded) >= 0.9 * len(reworded) and got <= reworded and all(r.kind == "paraphrase" and r.answer >= 0.9 for r in found)


def test_passages_of_any_number_of_words(spark, monkeypatch):
    """60,000 different words in one block; and the same in blocks, with a basis that isn't kept."""
    rng = random.Random(22)
    lexicon = _syllables(rng, 60_000)
    rng.shuffle(lexicon)
    passages = [lexicon[i : i + 40] for i in range(0, 60_000, 40)]
    docs, want = [], set()
    for i in range(40):
        text = [rng.choice(lexicon) for _ in range(100)]
        if i % 2:
            text[30:30] = passages[31 * i][5:35]
            want.add((31 * i, i))
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id bigint, passage string")
    run = lambda t: {(r.item_id, r.doc_id) for r in L.leaks(df, "doc_id", "text", t, "item_id", "passage").collect()}
    assert run(items) == want
    monkeypatch.setattr(L, "BLOCK", 100)
    monkeypatch.setattr(L, "KEPT_BASIS", 0)
    assert run(items.where("item_id < 310")) == {x for x in want if x[0] < 310}


def test_the_latent_space_is_that_of_the_whole_decomposition(spark):
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(300, 12, replace=False)), rng.random(12)) for _ in range(40)]
    dense = np.zeros((40, 300))
    for i, (f, v) in enumerate(rows):
        dense[i, f] = v
    _, sigma, right = np.linalg.svd(dense, full_matrices=False)
    space = L.latent_space(spark, rows, 300, rank=30)
    x = rng.random(300)
    ours, theirs = x @ space.basis(np.arange(300)), x @ right[:30].T
    assert np.linalg.norm(ours) == pytest.approx(np.linalg.norm(theirs), rel=0.02)
    cosine = space.unit @ ours / np.linalg.norm(ours)
    own = dense @ right[:30].T
    assert np.abs(cosine - own @ theirs / np.linalg.norm(own, axis=1) / np.linalg.norm(theirs)).max() < 0.05


def test_alignment_by_hand():
    passage = np.array([list(range(1, 11))])
    score, span = L.align(passage, np.array([[99, 1, 2, 3, 98, 97, 4, 5, 6, 96, 8, 9, 10, 95]]))
    assert span[0] == 10 and score[0] == pytest.approx(9 + L.LOST + 2 * L.BETWEEN, abs=0.2)
    assert L.align(passage, np.zeros((1, 5), dtype=int))[0][0] == 0
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(1, 9, (4, 12)), rng.integers(0, 9, (4, 30))
        assert np.allclose(L.align(a, b)[0], L.align_score(a, b))


def test_budgets_are_met_to_the_token():
    rng = random.Random(6)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 6) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randrange(0, total + 20)
        take = fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        reach = {0}
        for x, c in zip(lengths, counts):
            reach = {r + x * k for r in reach for k in range(c + 1)}
        assert sum(int(x) * int(t) for x, t in zip(lengths, take)) == max(r for r in reach if r <= budget)


def test_mix(spark):
    rows = [(i, " A ", 3 + i % 5) for i in range(300)] + [(i, "b", 10) for i in range(300, 310)] + [(400, None, 5), (401, "other", 5), (402, "b", 0), (None, "a", 4)]
    counts = spark.createDataFrame(rows, "id bigint, source string, tokens bigint").withColumn("source", F.lower(F.trim("source")))
    targets = spark.createDataFrame([("A", 0.5, 1), ("b ", 0.3, 3), ("c", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix(counts, "id", targets)
    got = {r.source: r for r in report.collect()}
    assert got["b"].used == 300 and got["b"].most_copies == 3 and got["a"].used == 500 and got["c"].used == 0
    assert got["a"].reached_share == pytest.approx(0.625) and got["a"].most_copies == 1
    assert mixture.groupBy("id").count().where("count > 1").isEmpty()
    assert mix(counts, "id", targets)[0].exceptAll(mixture).isEmpty()  # seeded
    capped = {r.source: r.used for r in mix(counts, "id", targets, total=10_000)[1].collect()}
    assert capped["b"] == 300 and capped["a"] == sum(r[2] for r in rows if r[1] in (" A ", "a"))
    assert mix(counts.where("false"), "id", targets)[0].count() == 0 and mix(counts, "id", targets.where("false"))[1].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", " X  y"), (2, None, None), (3, "", "x")], "id bigint, text string, source string")
    got = {r.id: (r.source, r.tokens) for r in token_counts(df, "id", "text", "source").collect()}
    assert got == {1: ("x y", 2), 2: (None, 0), 3: ("x", 0)}


def _file(rng, n, end="."):
    out, t = [], 1.0
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 9))).capitalize() + (end if i == n - 1 else ".")
        dur = 1.1 + 0.045 * len(text) + rng.uniform(-0.4, 0.4)
        stamp = lambda x: f"00:{int(x) // 60:02d}:{int(x) % 60:02d},{int(x * 1000) % 1000:03d}"
        out.append(f"{i + 1}\n{stamp(t)} --> {stamp(t + dur)}\n{text}\n")
        t += dur + 0.3
    return "\n".join(out)


def test_truncation(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(400):
        text, kind = _file(rng, rng.randrange(6, 12)), i % 8
        if kind == 0:  # in the time line
            text = text[: text.rindex("-->")]
        elif kind == 1:  # in the words, early
            text = text[: text.rindex("\n", 0, -1) + 4]
        elif kind == 2:
            text = text.rstrip() + "\n\n9\n00:59:00,000 --> 00:59:01,400\n" + rng.choice(["THE END", "To be continued"])
        elif kind == 3:
            text = text.rstrip()[:-1] + "…"
        elif kind == 4:
            text = text.replace("\n", "\r\n")
        if kind in (0, 1):
            want.add(i)
        rows.append((i, text, " SITE a" if i % 2 else "site A"))
    full = _file(rng, 20)
    rows += [(1000 + k, full[: len(full) - 12], "b") for k in range(2)] + [(1010, full, "b")]  # ends early in a near copy
    want |= {1000, 1001}
    for k in range(12):  # a field limit
        text = _file(rng, 30)[:900]
        rows.append((2000 + k, text, "c"))
        if not text.rstrip().endswith("."):  # else its last cue happens to be complete
            want.add(2000 + k)
    rows += [(3000, None, "c"), (3001, "", "c"), (3002, "no cues here", None), (3003, "x" * 300_000, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, length int").repartition(3)
    got = {r.doc_id: r for r in C.truncated(df, "doc_id", "text", "source").collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.cut} == want
    assert got[0].source == "site a" and got[0].reason == "structure"
    assert C.truncated(df.where("false"), "doc_id", "text", "source").count() == 0


def test_near_copies_link_the_shorter(spark):
    rng = random.Random(9)
    full = _file(rng, 20)
    rows = [(1, full[:-9], "b"), (2, full, "b"), (3, full, "b"), (4, _file(rng, 20), "b")]
    found = C._summaries(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    assert [r.id for r in _early(found)] == [1]


def test_texts_cut_in_their_first_cue(spark):
    cut = ["1", "1\r\n", "\ufeff1\n00:0", "1\n00:00:01,000 -->", "1\n00:00:01,000 --> 00:00:0…"]
    whole = ["", None, " \n", "no cues here", "1 of 3", "\ufeff"]
    df = spark.createDataFrame([(i, x, "a") for i, x in enumerate([*cut, *whole])], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.reason for r in C.truncated(df, "doc_id", "text", "source").collect()}
    assert got == {i: "structure" if i < len(cut) else None for i in range(len(cut) + len(whole))}


def _early(found):
    """The documents whose alignment with a near copy ends early."""
    rows = found.where("row IS NOT NULL")
    return C.near_copies(rows).where("verdict = 'early'").join(rows.select("row", "id"), "row").collect()


def _timed(bodies, last=2000):
    """A file of these cues, each 2 s but the last ``last`` ms."""
    stamp = lambda ms: f"00:{ms // 60_000:02}:{ms // 1000 % 60:02},{ms % 1000:03}"
    return "\n".join(f"{i + 1}\n{stamp(3000 * i)} --> {stamp(3000 * i + (last if i + 1 == len(bodies) else 2000))}\n{b}\n" for i, b in enumerate(bodies))


def _near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return sorted(r.id for r in _early(C._summaries(df, "doc_id", "text", "source")))


def test_near_copies_meet_every_continuation(spark):
    body = list(range(100, 120))
    schema = "row bigint, chars bigint, broken boolean, content bigint, hashes array<bigint>, durations array<int>, lengths array<int>, codes array<binary>, bands array<bigint>, asks array<bigint>"
    code = [bytes([1, 2, 3])] * 20
    cut = [(i, 500 + i, False, 1000 + i, [*body, 7], [2000] * 21, [20] * 21, [*code, bytes([5, 6])], [1, 2], [2]) for i in range(1, 6)]  # the same words last, of different content
    full, longest = (10, 600, False, 1010, [*body, 8], [2000] * 21, [30] * 21, [*code, bytes([5, 9, 8])], [1, 2], [2]), (11, 700, False, 1011, [*body, 8, 9], [1900] * 22, [30] * 22, [*code, bytes([5, 9, 8]), b"a"], [1, 2], [2])
    rows = spark.createDataFrame([*cut, full, longest], schema)
    assert {r.row: (r.of, r.verdict) for r in C.near_copies(rows).collect()} == {i: (10, "early") for i in range(1, 6)}


@pytest.mark.parametrize("others", [0, 1, 2, 12])
def test_near_copies_lose_no_partner_to_a_longer_text(spark, others):
    """Longer texts with the same words behind the same cue, but nothing else in common, stand before the one that is the near copy; it may
    be shorter than the text that asks. Of two more texts one is only met by a copy that shows it to be whole, and one by none."""
    body = list(range(100, 120))
    schema = "row bigint, chars bigint, broken boolean, content bigint, hashes array<bigint>, durations array<int>, lengths array<int>, codes array<binary>, bands array<bigint>, asks array<bigint>"
    code = [bytes([1, 2, 3])] * 20
    text = lambda row, chars, hashes, length, last: (row, chars, False, 1000 + row, hashes, [2000] * len(hashes), [length] * len(hashes), [*code[: len(hashes) - 1], last], [1, 2], [2])
    rows = [text(1, 650, [*body, 7], 20, bytes([5, 6])), text(2, 600, [*body, 8], 30, bytes([5, 9, 8]))]
    rows += [text(10 + i, 900 + i, [*range(1000 * i + 1000, 1000 * i + 1019), 119, 8], 30, bytes([5, 9, 8])) for i in range(others)]
    rows += [text(30, 500, list(range(200, 221)), 20, bytes([5])), text(31, 400, [*range(200, 222)], 20, bytes([6]))]
    got = {r.row: (r.of, r.verdict) for r in C.near_copies(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, "early"), 30: (31, "whole")}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7, 0.9])
def test_copies_cut_anywhere_meet_their_whole_text(spark, share):
    """150 files, each with a copy cut at about that share: what the method's first half finds alone, wherever the cut falls."""
    rng = random.Random(int(100 * share))
    rows = []
    for i in range(150):
        text = _file(rng, rng.randrange(12, 40), rng.choice([".", ""]))
        at = int(len(text.rstrip()) * share)
        rows += [(2 * i, text, "a"), (2 * i + 1, text[:at], "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    early = {r.id for r in _early(C._summaries(df, "doc_id", "text", "source"))}
    # A copy that stops between two cues, or behind a last cue's last word, isn't cut.
    inside = {i for i in range(1, 300, 2) if _inside(rows[i][1], rows[i - 1][1])}
    assert len(inside) > 100 and early <= inside and len(early) >= 0.9 * len(inside)
    found = {r.doc_id: r for r in C.truncated(df, "doc_id", "text", "source").collect()}
    assert {i for i in early if found[i].reason == "copy"} == early


def _inside(cut, whole):
    """Whether a prefix of a file stops inside a cue: in its number, its times or its words."""
    return not re.search(r"\n\s*$", cut) and not re.match(r"\s*\n\s*(\n|$)", whole[len(cut) :] + "\n\n") or bool(re.search(r"\n\d+\n\s*$", cut)) or bool(re.search(r"-->[^\n]*\n$", cut))


def test_complete_near_copies_are_not_cut(spark):
    rng = random.Random(3)
    body = [" ".join(rng.choice(WORDS) for _ in range(7)) + "." for _ in range(20)]
    body[9] = "and then she went"  # ends openly, and with little for its time
    rows = [(1, _timed(body[:10], 9000), "a"), (2, _timed(body, 2000).replace("00:00:27,000 --> 00:00:29,000", "00:00:27,000 --> 00:00:36,000"), "a")]
    rows += [(10 + i, _file(rng, 15), "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.cut, r.reason) for r in C.truncated(df, "doc_id", "text", "source").collect()}
    assert got[1] == (False, None)
    alone = {r.doc_id: (r.cut, r.reason) for r in C.truncated(df.where("doc_id <> 2"), "doc_id", "text", "source").collect()}
    assert alone[1][0]


def test_truncation_takes_keys_as_they_are(spark):
    rng = random.Random(2)
    text = _file(rng, 8)
    df = spark.createDataFrame([("a", text, "x"), (None, text[:-30], "x"), ("a", text[: text.rindex("-->")], None), (None, None, None)], "k string, text string, source string")
    got = sorted((r.k or "", r.cut) for r in C.truncated(df, "k", "text", "source").collect())
    assert got == [("", False), ("", True), ("a", False), ("a", True)]


def test_terminality_on_held_out_cuts(spark):
    """Files without any copy, half of them cut inside the words of their last cue: closing words, durations and structure alone."""
    rng = random.Random(12)
    rows, cut = [], set()
    for i in range(600):
        text = _file(rng, rng.randrange(8, 30))
        if i % 2:
            last = text.rindex("\n", 0, -1) + 1
            text = text[: last + int((len(text) - last) * rng.uniform(0.15, 0.85))]
            cut.add(i)
        rows.append((i, text, "a"))
    got = {r.doc_id for r in C.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source").where("cut").collect()}
    assert len(got & cut) >= 0.98 * len(cut) and len(got - cut) <= 0.01 * len(cut)


def test_near_copies_with_a_repeated_line(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    body = [" ".join(words[10 * i : 10 * i + 10]) + "." for i in range(30)]
    for repeated in ("Yes.", "♪"):
        body[4] = body[29] = repeated
        end = " ".join(words[300:310])
        assert _near(spark, [(1, _timed([*body, end[:20] + "."], 2500), "a"), (2, _timed([*body, end + "."], 2500), "a")]) == [1]
