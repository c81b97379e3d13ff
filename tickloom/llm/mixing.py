"""Mixing sources to target weights, exactly to the token."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut

#: Split pattern of the public byte-level vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Hash classes per (source, length) for ranking without a group in one task.
CLASSES = 4096


def plain_source(c: str) -> Column:
    """A source however it was written: blanks around it and case don't count."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def token_counts(documents: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, source (plain), tokens: the length of each text under a public byte-level vocabulary; NULL texts have 0 tokens."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def count(batches):
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encode = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("s"), pa.array(n, pa.int64())], names=[key, "source", "tokens"])

    rows = documents.select(F.col(key).alias("k"), plain_source(source).alias("s"), F.col(text).alias("t"))
    return rows.mapInArrow(count, f"{key} {documents.schema[key].dataType.simpleString()}, source string, tokens bigint")


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = 65_536) -> np.ndarray:
    """How many records of each length to take, at most ``counts``, so that their total is as near to ``budget`` as can be from below.

    The bulk is taken in proportion to the counts, then from the longest down until what is left fits the window; there a
    bounded knapsack over the remaining counts (binary-split multiplicities on a bit set of reachable sums) finds the
    largest reachable total, which is the budget itself whenever small lengths are left.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(counts), dtype=np.int64)
    # In whole numbers, so that no rounding can exceed the budget.
    take = np.array([int(n) * budget // total for n in counts], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= window:
            break
        k = min(int(counts[i] - take[i]), (left - window) // int(lengths[i]))
        take[i] += k
        left -= k * int(lengths[i])
    # As much as the window holds is given back, shortest first, so that the last step can choose; small budgets are all choice.
    room = min(window, budget)
    for i in order[::-1]:
        if left >= room:
            break
        k = min(int(take[i]), -(-(room - left) // int(lengths[i])))
        take[i] -= k
        left += k * int(lengths[i])
    reach, steps = 1, []
    mask = (1 << (left + 1)) - 1
    for i in order[::-1]:
        spare, c = int(counts[i] - take[i]), 1
        while spare > 0 and not reach >> left & 1 and int(lengths[i]) <= left:
            c = min(c, spare)
            steps.append((i, c, reach))
            reach |= reach << (int(lengths[i]) * c) & mask
            spare -= c
            c *= 2
    at = reach.bit_length() - 1
    for i, c, before in reversed(steps):
        if not before >> at & 1:
            take[i] += c
            at -= int(lengths[i]) * c
    return take


def mix(counts: DataFrame, key: str, targets: DataFrame, total: int | None = None, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """Returns the mixture (key, source, tokens, copies) and the report on shares.

    ``counts`` is what ``token_counts`` gives; ``targets`` has source, target_share and max_repeats. Sources with a target
    but no tokens can't supply anything: their share falls to the others in proportion, and the report says so. Without
    ``total``, it is the largest that every source with tokens can supply its share of within its repeats; with one, sources
    that fall short supply all they may. Every record of a source is repeated equally often, and those repeated once more
    are chosen by length count and, within a length, by seeded hash; no record exceeds max_repeats.

    Lengths are counted before anything is collected into one place, so a task sees a source's distinct lengths and never
    its records. Records of other sources, without a source or without tokens are left out; of targets listed twice the
    larger counts; NULL keys hash like any other; no documents or no targets give an empty mixture.
    """
    spark = counts.sparkSession
    goal = targets.groupBy(plain_source("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = goal.where("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL")
    rows = cut(counts.where("tokens > 0").join(goal.select("source"), "source", "left_semi"))
    lengths = rows.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    # One row per target source, a stated set: small whatever the corpus is.
    supply = goal.join(lengths.groupBy("source").agg(F.sum(F.col("n")).alias("files"), F.sum(F.col("n") * F.col("tokens")).alias("available")), "source", "left").toPandas()
    supply = supply.fillna({"files": 0, "available": 0}).sort_values("source")
    there = supply[supply.available > 0]
    whole = float(there.target_share.sum())
    if total is None and len(there):
        total = int(min(int(a) * int(m) / (s / whole) for a, m, s in zip(there.available, there.max_repeats, there.target_share)))
    budget = {s: int((total or 0) * share / whole) for s, share in zip(there.source, there.target_share)}
    plan = [(s, min(budget[s], int(a) * int(m)), int(a)) for s, a, m in zip(there.source, there.available, there.max_repeats)]
    limits = spark.createDataFrame(plan, "source string, budget bigint, available bigint")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        full, rest = divmod(int(group.budget.iloc[0]), int(group.available.iloc[0]))
        extra = fit_budget(group.tokens.to_numpy(), group.n.to_numpy(), rest) if rest else np.zeros(len(group), dtype=np.int64)
        return pd.DataFrame({"source": group.source, "tokens": group.tokens, "whole": full, "extra": extra})

    fitted = cut(lengths.join(limits, "source").groupBy("source").applyInPandas(fit, "source string, tokens bigint, whole bigint, extra bigint"))
    spread = rows.withColumn("hash", F.xxhash64(F.lit(seed), key)).withColumn("class", F.shiftrightunsigned(F.col("hash"), 64 - CLASSES.bit_length() + 1))
    group = ["source", "tokens"]
    sizes = spread.groupBy(*group, "class").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("class")) - F.col("n"))
    placed = sizes.join(fitted, group).select(*group, "class", "before", "whole", "extra")
    ranked = spread.withColumn("place", F.row_number().over(Window.partitionBy(*group, "class").orderBy("hash", key)))
    chosen = ranked.join(placed, [*group, "class"])
    copies = F.col("whole") + F.when(F.col("before") + F.col("place") <= F.col("extra"), 1).otherwise(0)
    mixture = chosen.select(key, "source", "tokens", copies.alias("copies")).where("copies > 0")
    goals = spark.createDataFrame(
        [(r.source, float(r.target_share), int(r.max_repeats), int(r.files), int(r.available), budget.get(r.source, 0)) for r in supply.itertuples()],
        "source string, target_share double, max_repeats int, files bigint, available bigint, budget bigint",
    )
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.count("*").alias("files_used"))
    report = goals.join(used, "source", "left").na.fill(0, ["used", "most_copies", "files_used"])
    report = report.withColumn("every", F.sum("used").over(Window.partitionBy()))  # one row per target source
    report = report.select("source", "target_share", F.coalesce(F.try_divide(F.col("used"), F.col("every")), F.lit(0.0)).alias("reached_share"), "max_repeats", "most_copies", "files", "files_used", "available", "budget", "used")
    return mixture, report
