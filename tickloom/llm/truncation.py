"""Subtitle files whose text stops before the end of their last cue."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.subtitles import WORD, Shapes, repaired, shape
from tickloom.session import cut

TIME = re.compile(r"(\d+):(\d\d):(\d\d)[,.](\d+)[ \t]*-->[ \t]*(\d+):(\d\d):(\d\d)[,.](\d+)")
#: Number and times of a cue that never got its words: nothing but digits and the signs of a time line, and what was put after.
BROKEN = re.compile(r"(?:^|\n)[ \t]*\n\s*\d[\d:,.> \t\n-]*…?\s*$")
NUMBER = re.compile(r"\n\s*\d*\s*$")
#: Characters that end a sentence, a description or a song; and those that a transfer or an export puts after a cut.
CLOSING = re.compile(r"(?:[.!?…:;\])}♪♫\"»”“']|--|—|–)$")
FILLER = "\x00 \t\n\r"
ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")

#: Min-hash over openings: the first FIRST_SCALE, FIRST_SCALE * SCALE_STEP, FIRST_SCALE * SCALE_STEP^2, ... shingles of a text.
SHINGLE, BANDS, ROWS = 5, 6, 3
FIRST_SCALE, SCALE_STEP = 2, 4
LEAST_SIMILARITY = 0.8
#: A length is a field limit if this many texts of the source have it, and this many times as many as have lengths around it.
LIMIT_ROWS, LIMIT_TIMES, LIMIT_SPAN = 5, 12, 50
#: Without closing punctuation an ending is terminal if its cue begins or closes with words that at least this share of the
#: time begin or close a file's last cue, and that do so in this many, and this share, of the files with such endings.
LEAST_TERMINALITY, LEAST_FORMULAS, LEAST_FORMULA_SHARE = 0.5, 3, 0.01
MOST_LENGTH, STEP, MOST_STEPS, RARE = 400, 0.01, 10_000, 5_000


def cues(text: str) -> tuple[list[float], list[str], bool]:
    """(durations, texts, whether an unfinished number or time line follows) of the cues, in order."""
    text = repaired(text).replace("\r\n", "\n").replace("\r", "\n").rstrip(FILLER)
    marks = list(TIME.finditer(text))
    seconds, bodies = [], []
    for i, m in enumerate(marks):
        a, b, c, d, e, f, g, h = m.groups()
        seconds.append((int(e) - int(a)) * 3600 + (int(f) - int(b)) * 60 + int(g) - int(c) + float("0." + h) - float("0." + d))
        body = text[m.end() : marks[i + 1].start()] if i + 1 < len(marks) else text[m.end() :]
        if i + 1 < len(marks):
            body = NUMBER.sub("", body)
        bodies.append(body)
    broken = False
    tail = bodies[-1] if bodies else "\n\n" + text.lstrip("\ufeff")
    if m := BROKEN.search(tail):
        broken = True
        if bodies:
            bodies[-1] = tail[: m.start()]
    return seconds, [b.strip(FILLER) for b in bodies], broken


def _key(c: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))



def _ends(found: list[str], shapes: Shapes) -> tuple[str, str]:
    """The shapes of a cue's first two and last two words."""
    return " ".join(shapes[w] for w in found[:2]), " ".join(shapes[w] for w in found[-2:])


def scales(n: int) -> list[int]:
    """Lengths of the openings, in shingles, that a text of n shingles has."""
    out, k = [], FIRST_SCALE
    while k <= n:
        out.append(k)
        k *= SCALE_STEP
    return out


def opening_bands(mixed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(scales x BANDS) min-hash bands of the openings of a sequence of shingle hashes, from the running minima of seeded permutations."""
    import xxhash

    ends = scales(len(mixed))
    if not ends:
        return np.zeros((0, BANDS), dtype=np.int64)
    # The last scale covers at least a SCALE_STEP-th of the text; what lies behind it isn't hashed.
    cells = [np.min([(part[:, None] * a + b).min(axis=0) for part in np.array_split(mixed[i:j], (j - i) // 8_192 + 1)], axis=0) for i, j in zip([0, *ends], ends)]
    least = np.minimum.accumulate(np.stack(cells), axis=0).reshape(len(ends), BANDS, ROWS)
    return np.array([[xxhash.xxh64_intdigest(bytes([i, k]) + r.tobytes()) - (1 << 63) for k, r in enumerate(row)] for i, row in enumerate(least)], dtype=np.int64)


def summary_schema(kind: str) -> str:
    return (
        f"row bigint, id {kind}, source string, chars bigint, bytes bigint, cues int, broken boolean, seconds double, length int, bare boolean, closed boolean, ellipsis boolean, lost boolean, "
        "opener string, closer string, content bigint, hashes array<bigint>, durations array<int>, lengths array<int>, codes array<binary>, bands array<bigint>, asks array<bigint>, x int, y int, n bigint, last bigint"
    )


def _summaries(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One pass over the texts: per document what its ending looks like, hashes of its cues and min-hash bands of its openings; and per
    task counts of (cue length, duration), of openers and of closers, as rows with ``row`` NULL. Texts themselves go no further.

    ``row`` numbers the documents, whatever their key is; the result is written at once, so the numbers stay.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = summary_schema(kind)
    columns = [c.split(" ", 1) for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}

    def work(batches):
        import xxhash

        rng = np.random.default_rng(9)
        a, b = rng.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, BANDS * ROWS, dtype=np.uint64)
        hashed, shapes = Shapes(lambda w: xxhash.xxh64_intdigest(w)), Shapes(shape)
        timing, openers, lasts, closers = Counter(), Counter(), Counter(), Counter()
        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([(c, batch.schema.field("i").type if c == "id" else kinds[t]) for c, t in columns])
            rows = []
            for n_row, t, s in zip(*(batch.column(c).to_pylist() for c in ("r", "t", "s"))):
                seconds, bodies, broken = cues(t or "")
                every: list[int] = []
                cue_hashes, codes = [], []
                for j, body in enumerate(bodies):
                    found = WORD.findall(body.lower())
                    mine = [hashed[w] for w in found]
                    every += mine
                    # Equal words, equal hash: what stands between them may differ from copy to copy.
                    cue_hashes.append(hash(tuple(mine)))
                    codes.append(bytes([h & 255 for h in mine]))
                    first, final = _ends(found, shapes)
                    openers[first] += 1
                    openers[first.split(" ")[0]] += " " in first
                    closers[final] += 1
                    if j + 1 < len(bodies) and body and seconds[j] > 0:
                        timing[min(len(body), MOST_LENGTH), min(round(seconds[j] / STEP), MOST_STEPS)] += 1
                body = bodies[-1] if bodies else ""
                plain = re.sub(r"</?\w*>?$", "", body).rstrip(FILLER)
                ellipsis = bool(ELLIPSIS.search(plain))
                lost = plain.endswith("�")
                closed = bool(CLOSING.search(plain))
                found = WORD.findall(body.lower())
                opener, closer = _ends(found, shapes)
                if bodies:
                    lasts[opener] += 1
                    lasts[opener.split(" ")[0]] += " " in opener
                x = np.array(every, dtype=np.uint64)
                durations = [round(v * 1000) for v in seconds]
                bands, asks, content = [], [], None
                if len(x):
                    content = xxhash.xxh64_intdigest(np.array([*cue_hashes, *durations, broken, len(body)], dtype=np.int64).tobytes()) - (1 << 63)
                if len(x) >= SHINGLE:
                    # Wrapping products of the words' hashes: a shingle depends on the order of its words.
                    mixed = np.zeros(len(x) - SHINGLE + 1, dtype=np.uint64)
                    for k in range(SHINGLE):
                        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ x[k : len(x) - SHINGLE + 1 + k]
                    found_bands = opening_bands(mixed ^ (mixed >> np.uint64(29)), a, b)
                    bands, asks = found_bands.ravel().tolist(), found_bands[-1:].ravel().tolist()
                raw = t or ""
                rows.append((n_row, None, s, len(raw), len(raw.encode("utf-8", "replace")), len(bodies), broken, seconds[-1] if seconds else None, len(body), len(body) <= 3 * plain.endswith("..."), closed, ellipsis, lost, opener, closer, content, cue_hashes, durations, [len(x) for x in bodies], codes, bands, asks, None, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column("i") if f.name == "id" else pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        extra = [(x, y, None, None, n, None) for (x, y), n in timing.items()]
        extra += [(None, None, o, None, n, lasts[o]) for o, n in openers.items()] + [(None, None, None, c, n, None) for c, n in closers.items()]
        if extra:
            x, y, o, c, n, last = zip(*extra)
            given = {"x": x, "y": y, "opener": o, "closer": c, "n": n, "last": last}
            yield pa.RecordBatch.from_arrays([pa.array(list(given.get(f.name, [None] * len(extra))), f.type) for f in arrow], schema=arrow)

    rows = documents.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("i"), F.col(text).alias("t"), _key(source).alias("s"))
    return cut(rows.mapInArrow(work, schema))


def _pace(found: DataFrame) -> tuple[float, float, float]:
    """(seconds a cue lasts at no length, seconds per character, largest usual excess) from counts of all cues but the last.

    The counts are a table of lengths up to MOST_LENGTH by durations up to MOST_STEPS hundredths of a second, longer ones in the
    outermost cells: bounded whatever the corpus is. The line is fitted again without its outliers until it holds; the excess is what
    one cue in RARE exceeds. Fewer cues than that don't show it: then the largest is carried on as far as an exponential tail goes.
    """
    table = found.where("x IS NOT NULL").groupBy("x", "y").agg(F.sum("n").alias("n")).toPandas()
    if not len(table):
        return 0.0, 0.0, float("inf")
    x, y, n = table.x.to_numpy(float), table.y.to_numpy(float) * STEP, table.n.to_numpy(float)
    keep = np.ones(len(n), dtype=bool)
    for _ in range(5):
        w = n * keep
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        slope = (w * (x - mx) * (y - my)).sum() / max((w * (x - mx) ** 2).sum(), 1e-9)
        base = my - slope * mx
        off = np.abs(y - base - slope * x)
        order = np.argsort(off)
        usual = off[order][np.searchsorted(np.cumsum(n[order]), 0.68 * n.sum())]
        keep = off <= 3 * usual
    order = np.argsort(off[keep])
    seen = n[keep].sum()
    most = off[keep][order][min(keep.sum() - 1, np.searchsorted(np.cumsum(n[keep][order]), (1 - 1 / RARE) * seen))]
    return float(base), float(slope), float(most + usual * max(0.0, np.log(RARE / seen))) + 2 * STEP


def _limited(rows: DataFrame) -> DataFrame:
    """row, limited, crowd: documents whose length is a field limit, in characters or bytes, that shows as a spike among their source's lengths.

    A limit in bytes makes small spikes in characters and the other way round, so each document counts for the larger of
    its two spikes and the spikes are counted again. Copies of one text have one length and count once. ``crowd`` is how many
    texts such a length usually has, as a share of those that have it.
    """
    unit = lambda c: F.struct(F.lit(c).alias("unit"), F.col(c).alias("size"))
    source = F.coalesce("source", F.lit("")).alias("source")
    sizes = rows.select("row", source, "content", F.explode(F.array(unit("chars"), unit("bytes"))).alias("u")).select("row", "source", "content", "u.*")
    spot = ["source", "unit", "size"]
    counts = sizes.groupBy(*spot).agg(F.count_distinct("content").alias("n"))
    around = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-LIMIT_SPAN, LIMIT_SPAN)
    # Spikes don't make their neighbourhood dense: each length counts as at most the usual one.
    usual = F.sum(F.least("n", F.lit(2) + F.col("typical"))).over(around) / (2.0 * LIMIT_SPAN)
    counts = counts.withColumn("typical", F.percentile("n", F.lit(0.9)).over(Window.partitionBy("source", "unit"))).withColumn("usual", usual)
    spikes = counts.where((F.col("n") >= LIMIT_ROWS) & (F.col("n") >= LIMIT_TIMES * (F.col("usual") + 0.1))).select(*spot, "n", "usual")
    own = sizes.join(spikes, spot).groupBy("row", "content").agg(F.max(F.struct("n", *spot, "usual")).alias("s")).select("row", "content", "s.source", "s.unit", "s.size", "s.usual")
    again = own.groupBy(*spot).agg(F.count_distinct("content").alias("n"), F.max("usual").alias("usual")).where((F.col("n") >= LIMIT_ROWS) & (F.col("n") >= LIMIT_TIMES * (F.col("usual") + 0.1)))
    return own.join(again.select(*spot, "n"), spot).select("row", F.lit(True).alias("limited"), (F.col("usual") / F.col("n")).alias("crowd"))


def alignment(own: list[int], other: list[int]) -> tuple[int, int]:
    """(cues matched, place in ``other`` of the match of the last own cue or -1) of the longest common subsequence of two cue sequences that
    ends as late as it can in ``own``."""
    a, b = np.array(own, dtype=np.int64), np.array(other, dtype=np.int64)
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for i, h in enumerate(a):
        last = row
        step = np.where(b == h, last[:-1] + 1, last[1:])
        row = np.concatenate([[0], np.maximum.accumulate(step)])
    at = np.flatnonzero(b == a[-1]) if len(a) else np.zeros(0, dtype=np.int64)
    if not len(at):
        return int(row[-1]), -1
    # The last own cue may stand at several places; the one with most matches before it counts, the earliest of those.
    return int(row[-1]), int(at[np.argmax(last[at])])


def ends_early(broken: bool, hashes: list[int], lengths: list[int], codes: list[bytes], other_hashes: list[int], other_lengths: list[int], other_codes: list[bytes]) -> str | None:
    """``early`` if the aligned other text goes on where this one stops, ``whole`` if it shows that the last cue is complete, else None.

    At least LEAST_SIMILARITY of the cues before the last must be found in the other, in order. A last cue is cut if its words, but for the
    last one, which may be cut itself, begin the other's cue and that is longer; it is whole if it is the other's cue and more cues follow there.
    """
    whole = broken or not codes[-1]
    sure = len(hashes) if broken and codes[-1] else len(hashes) - 1
    if sure < 1:
        return None
    if np.isin(hashes[:sure], other_hashes).sum() < LEAST_SIMILARITY * sure:  # no alignment can match more
        return None
    matched, at = alignment(hashes[:sure], other_hashes)
    if matched < LEAST_SIMILARITY * sure or at < 0 or at + 1 >= len(other_hashes):
        return None
    if whole:
        return "early"
    mine, theirs = codes[-1], other_codes[at + 1]
    if hashes[-1] == other_hashes[at + 1]:
        return "whole" if at + 2 < len(other_hashes) else None
    same = sum(x == y for x, y in zip(mine[:-1], theirs))
    if len(theirs) >= len(mine) and same >= LEAST_SIMILARITY * (len(mine) - 1) and other_lengths[at + 1] > lengths[-1]:
        return "early"
    return None


def near_copies(rows: DataFrame) -> DataFrame:
    """(row, of, verdict): documents with a near copy that goes on where they stop (``early``), or shows that they are complete (``whole``).

    A cut keeps its text's opening, so min-hash bands are taken over openings of several lengths: a text asks with the bands of its longest
    one, at least a quarter of it, and answers with those of all. Copies alike in every cue, duration and ending are one class with one
    representative, so a group of copies is never expanded. In a band, a representative asks with (last cue but one, duration of the
    last), or with its last cue if what follows it is unfinished, and every text answers with each of its cues and the duration behind
    it; only what is asked for in the band is kept. Each pair of an asker and an answer is aligned, whichever of both is longer, until one
    goes on: answers with the same words are ranked, the longest first, and rounds take the first two of each, the next two, the next four
    and so on, for the askers that have met none that goes on. So most askers take one round, and none loses a partner to another one.
    """
    kept = rows.where("content IS NOT NULL")
    classes = kept.groupBy("content").agg(F.min("row").alias("rep"))
    reps = kept.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "chars", "broken", "hashes", "durations", "lengths", "codes", "bands", "asks")
    band = reps.select("row", F.explode("bands").alias("band"), "asks").select("row", "band", F.array_contains("asks", F.col("band")).alias("asks"))
    shared = band.groupBy("band").agg(F.count("*").alias("n"), F.max("asks").alias("asks")).where("n > 1 AND asks").select("band")
    member = cut(band.join(shared, "band", "left_semi"))
    near = cut(reps.drop("bands", "asks").join(member.select("row").distinct(), "row", "left_semi"))
    unfinished = F.col("broken") & (F.length(F.element_at("codes", -1)) > 0)
    bare = F.when(unfinished, F.element_at("hashes", -1)).when(F.length(F.element_at("codes", -1)) == 0, F.try_element_at("hashes", F.lit(-2)))
    asked = near.where("size(hashes) >= 2 OR broken").select(
        "row", F.when(bare.isNotNull(), F.xxhash64(bare)).otherwise(F.xxhash64(F.try_element_at("hashes", F.lit(-2)), F.element_at("durations", -1))).alias("ask"),
        F.when(bare.isNull(), F.element_at("hashes", -1)).alias("last"),
    )
    steps = F.expr("transform(sequence(1, size(hashes) - 1), i -> struct(hashes[i - 1] AS cue, hashes[i] AS next, durations[i] AS lasts, i + 1 < size(hashes) AS more))")
    places = near.where("size(hashes) >= 2").select("row", "chars", F.explode(steps).alias("p"))
    worded = F.struct(F.xxhash64("p.cue", "p.lasts").alias("ask"), F.col("p.next").alias("next"), F.col("p.more").alias("more"))
    plain = F.struct(F.xxhash64("p.cue").alias("ask"), F.lit(None).cast("bigint").alias("next"), F.lit(True).alias("more"))
    places = places.select("row", "chars", F.explode(F.array(worded, plain)).alias("q")).select("row", "chars", "q.*").distinct()
    answers = places.join(asked.select("ask").distinct(), "ask", "left_semi").join(member.select("row", "band"), "row")
    left = cut(asked.join(member.where("asks").select("row", "band"), "row").select("row", "band", "ask", "last"))
    answers = answers.join(left.select("band", "ask").distinct(), ["band", "ask"], "left_semi")
    alike = Window.partitionBy("band", "ask", "next", "more").orderBy(F.desc("chars"), F.desc("row"))
    answers = cut(answers.select("band", "ask", "next", "more", F.col("row").alias("of"), F.row_number().over(alike).alias("rank")))
    own = near.select("row", "broken", "hashes", "lengths", "codes")
    other = near.select(F.col("row").alias("of"), *[F.col(c).alias(f"other_{c}") for c in ("hashes", "lengths", "codes")])

    def verify(batches):
        for b in batches:
            row, of, *rest = (b.column(i).to_pylist() for i in range(b.num_columns))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(of, pa.int64()), pa.array([ends_early(*r) for r in zip(*rest)], pa.string())], names=["row", "of", "verdict"])

    verified, low, high = near.sparkSession.createDataFrame([], "row bigint, of bigint, verdict string"), 0, 2
    most = answers.agg(F.max("rank")).first()[0] or 0
    while low < most:
        links = left.join(answers.where((F.col("rank") > low) & (F.col("rank") <= high)), ["band", "ask"]).where("of <> row")
        links = links.where("last IS NULL AND next IS NULL OR next <> last OR next = last AND more").select("row", "of").distinct()
        pairs = links.join(own, "row").join(other, "of").select("row", "of", "broken", "hashes", "lengths", "codes", "other_hashes", "other_lengths", "other_codes")
        found = cut(pairs.mapInArrow(verify, "row bigint, of bigint, verdict string").where("verdict IS NOT NULL"))
        verified, low, high = verified.unionByName(found), high, 2 * high
        if low < most:
            left = cut(left.join(found.where("verdict = 'early'").select("row"), "row", "left_anti"))
            most = answers.join(left.select("band", "ask").distinct(), ["band", "ask"], "left_semi").agg(F.max("rank")).first()[0] or 0
    # Any copy that goes on inside the last cue outweighs those that don't.
    best = verified.groupBy(F.col("row").alias("rep")).agg(F.min(F.struct("verdict", "of")).alias("v")).select("rep", "v.*")
    return kept.select("row", "content").join(classes, "content").join(best, "rep").select("row", "of", "verdict")


def truncated(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Every document with ``cut`` and the evidence: key, source, cut, reason, terminality.

    First near copies: ``copy``, a near copy in which the last cue, or the unfinished one behind it, goes on. A near copy with the same
    last cue and more behind it shows that the text is complete. Every other text is scored by the terminality of its closing words, the
    least of four shares, all counted over the whole corpus, and is cut if that is under LEAST_TERMINALITY. The least one is the reason:

    - ``structure``: no closing words at all, in a last cue without words or behind an unfinished number or time line (0);
    - ``pace``: the words stop before the time of their cue is spent: half the largest usual excess of duration, by the cue's own excess
      (three dots count as words there as in any other cue: a sentence may trail off, and only its length tells);
    - ``limit``: the words stop at a length that is a field limit of the source, and not in proper closing punctuation: how many
      texts of such a length are usual, by how many there are;
    - ``open``: no closing punctuation: how often its opening or closing words, if they close files at all, stand in last cues (credits,
      which many files share; else 0).

    NULL and empty texts and texts without any cue aren't cut, unless all they end in is the unfinished number or time line of their first
    cue; copies of a document are each judged; documents of an unknown source count as one source; keys of any type, NULL and repeated
    ones too, are returned as they are; an empty table gives none.
    """
    found = _summaries(documents, key, text, source)
    rows = found.where("row IS NOT NULL")
    base, slope, most = _pace(found)
    excess = F.col("seconds") - base - slope * F.col("length")
    unsure = rows.where(~F.col("closed") & ~F.col("lost") & (F.col("cues") > 0))
    enough = max(LEAST_FORMULAS, LEAST_FORMULA_SHARE * unsure.count())
    counts = found.where("row IS NULL")
    openers = counts.where("opener IS NOT NULL").groupBy("opener").agg(F.sum("n").alias("n"), F.sum("last").alias("ends"))
    ends = unsure.groupBy("closer").agg(F.count("*").alias("ends"))
    closers = counts.where("closer IS NOT NULL").groupBy("closer").agg(F.sum("n").alias("n")).join(ends, "closer")
    openers, closers = (x.where((F.col("ends") >= enough) & (F.col("ends") >= LEAST_TERMINALITY * F.col("n"))).select(c, (F.col("ends") / F.col("n")).alias(f"{c}_share")) for x, c in ((openers, "opener"), (closers, "closer")))
    first = openers.select(F.col("opener").alias("first"), F.col("opener_share").alias("first_share"))
    copies = near_copies(rows)
    judged = rows.join(_limited(rows), "row", "left").join(copies, "row", "left")
    judged = judged.withColumn("first", F.substring_index("opener", " ", 1)).join(openers, "opener", "left").join(closers, "closer", "left").join(first, "first", "left")
    words = F.when(F.col("closed") | F.col("lost"), 1.0).otherwise(F.greatest(F.coalesce("opener_share", F.lit(0.0)), F.coalesce("closer_share", F.lit(0.0)), F.coalesce("first_share", F.lit(0.0))))
    scores = [
        ("structure", F.when(F.col("broken") | (F.col("cues") > 0) & F.col("bare"), 0.0).otherwise(1.0)),
        ("pace", F.when((F.col("cues") > 0) & (excess > most), most / 2 / excess).otherwise(1.0)),
        ("limit", F.when((F.col("cues") > 0) & F.coalesce("limited", F.lit(False)) & (~F.col("closed") | F.col("ellipsis")), F.least(F.lit(LEAST_TERMINALITY) / 2, "crowd")).otherwise(1.0)),
        ("open", F.when(F.col("cues") > 0, words).otherwise(1.0)),
    ]
    score = F.least(*[x for _, x in scores])
    why = F.coalesce(*[F.when(x == score, F.lit(n)) for n, x in scores])
    terminality = F.when(F.col("verdict") == "early", 0.0).when(F.col("verdict") == "whole", 1.0).otherwise(score)
    reason = F.when(F.col("verdict") == "early", "copy").when(terminality < LEAST_TERMINALITY, why)
    return judged.select(F.col("id").alias(key), "source", reason.isNotNull().alias("cut"), reason.alias("reason"), terminality.alias("terminality"))
