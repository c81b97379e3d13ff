"""Evaluation passages inside a corpus: latent semantic retrieval, then alignment and answer checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.subtitles import UNREADABLE, Shapes, shape, words

#: Windows of the corpus and of the passages, in words; a stretch of 20 words fills most of some window.
WINDOW, STRIDE, PASSAGE_STRIDE = 20, 5, 5
RANK, OVERSAMPLING, SEED = 128, 16, 20
#: A window is a candidate for the passages whose windows have at least this cosine with it: the share of its length that its known n-grams
#: have, times the latent cosine of these.
LEAST_COSINE = 0.35
#: A candidate is aligned if the text shares this many different n-grams with the passage, as many as an alignment of LEAST_SCORE that loses
#: every fourth word.
LEAST_SHARED = 6
#: Alignment: a word found, a passage word altered or lost, and each word of the text in between.
FOUND, LOST, BETWEEN = 1.0, -0.75, -0.12
LEAST_SCORE, LEAST_SPAN = 14.0, 17
#: A text that isn't a passage in order is a paraphrase if it holds nearly all of the item's answer in order and either a weaker alignment or,
#: in some longer window, this latent cosine of its words with the whole passage.
PARAPHRASE_SCORE, ANSWER_SHARE = 9.0, 0.9
TOPIC_WINDOW, TOPIC_STRIDE, LEAST_TOPIC = 60, 20, 0.5
#: A text is looked at for an answer if it has this share of the answer's n-grams of ANSWER_GRAM words; shorter answers point to nothing.
ANSWER_GRAM, ANSWER_HITS = 3, 0.5
#: Passages are worked on in blocks, which bounds what is sent to the executors (some 130 MB for passages of 80 words) whatever the number of items.
BLOCK = 5_000
#: Features are word n-grams of these lengths and, for paraphrases, single words. Word numbers are mixed into 64-bit codes.
GRAMS = (3, 4)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A basis of up to this many numbers is kept by a task; a larger one is made batch by batch, for the features the batch has.
KEPT_BASIS = 1 << 25


def _codes(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, code) of the n-grams without a foreign word (0)."""
    if len(x) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = np.ones(len(x) - n + 1, dtype=bool)
    for i in range(n):
        good &= x[i : len(x) - n + 1 + i] > 0
    at = np.flatnonzero(good)
    code = x[at].astype(np.uint64)
    for i in range(1, n):
        code = (code ^ (code >> np.uint64(31))) * MIX + x[at + i].astype(np.uint64)
    return at, code


def _found(known: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``code``, place in the sorted ``known``) of the codes that are known."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, code), len(known) - 1)
    at = np.flatnonzero(known[place] == code)
    return at, place[at]


@dataclass
class Passages:
    """What the executors need to know of one block of passages: a function of the evaluation set, not of the corpus."""

    texts: list[str]
    answers: list[list[str]] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    ids: list[np.ndarray] = field(default_factory=list)
    known: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        number = lambda t: np.array([self.vocabulary.setdefault(shape(w), len(self.vocabulary) + 1) for w in words(t)], dtype=np.int64)
        self.ids = [number(t) for t in self.texts]
        self.words = len(self.vocabulary)  # words of answers alone come behind
        self.answer_ids = [[number(a) for a in own if words(a)] for own in self.answers] or [[] for _ in self.texts]
        none = [np.zeros(0, np.uint64)]
        self.known = [np.unique(np.concatenate([*none, *(_codes(x, n)[1] for x in self.ids)])) for n in GRAMS]
        # For each n-gram the passages that have it.
        of = [np.unique(self.hits(x)[1]) for x in self.ids]
        feature, passage = np.concatenate([np.zeros(0, np.int64), *of]), np.repeat(np.arange(len(of)), [len(f) for f in of])
        order = np.argsort(feature, kind="stable")
        self.passage_of, self.passage_start = passage[order], np.searchsorted(feature[order], np.arange(self.features + 1))
        # Answers by their n-grams: for each, the passages and answers it belongs to.
        grams = [(c, i, k) for i, own in enumerate(self.answer_ids) for k, a in enumerate(own) for c in np.unique(_codes(a, ANSWER_GRAM)[1]).tolist()]
        table = pd.DataFrame(grams, columns=["code", "passage", "answer"]).sort_values("code", kind="stable")
        self.answer_known, self.answer_start = np.unique(table.code.to_numpy(np.uint64), return_index=True)
        self.answer_start = np.append(self.answer_start, len(table)).astype(np.int64)
        number = table.groupby(["passage", "answer"], sort=True).ngroup().to_numpy(np.int64)
        self.answer_of = number
        self.answer_size = np.bincount(number, minlength=1)
        self.answer_passage = table.groupby(["passage", "answer"], sort=True).passage.first().to_numpy(np.int64)

    @property
    def features(self) -> int:
        return sum(map(len, self.known))

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, feature) of the passages' n-grams in the word sequence ``x`` (0 is any other word), by position."""
        ats, features, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for n, known in zip(GRAMS, self.known):
            at, code = _codes(x, n)
            i, place = _found(known, code)
            ats.append(at[i])
            features.append(place + base)
            base += len(known)
        at, feature = np.concatenate(ats), np.concatenate(features)
        order = np.argsort(at, kind="stable")
        return at[order], feature[order]

    def sharing(self, doc: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Codes document * passages + passage, sorted, of the documents that share at least LEAST_SHARED n-grams with the passage."""
        seen = np.unique(doc * max(1, self.features) + feature)
        doc, feature = seen // max(1, self.features), seen % max(1, self.features)
        n = self.passage_start[feature + 1] - self.passage_start[feature]
        place = np.repeat(self.passage_start[feature] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        found, times = np.unique(np.repeat(doc, n) * len(self.ids) + self.passage_of[place], return_counts=True)
        return found[times >= LEAST_SHARED]

    def answered(self, x: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
        """(document, passage) where a document has at least ANSWER_HITS of the n-grams of one of the passage's answers."""
        at, code = _codes(x, ANSWER_GRAM)
        i, place = _found(self.answer_known, code)
        doc = np.searchsorted(begin, at[i], side="right") - 1
        some, every = max(1, len(self.answer_known)), max(1, len(self.answer_passage))
        seen = np.unique(doc * some + place)
        doc, gram = seen // some, seen % some
        n = self.answer_start[gram + 1] - self.answer_start[gram]
        spots = np.repeat(self.answer_start[gram] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        found, times = np.unique(np.repeat(doc, n) * every + self.answer_of[spots], return_counts=True)
        found = found[times >= ANSWER_HITS * self.answer_size[found % every]] if len(found) else found
        return sorted(set(zip((found // every).tolist(), self.answer_passage[found % every].tolist() if len(found) else [])))


def _starts(n: int, stride: int) -> np.ndarray:
    """Window starts that cover n words, the last one ending with the last word."""
    last = max(0, n - WINDOW)
    return np.unique(np.append(np.arange(0, last + 1, stride), last))


def _read(batch: pa.RecordBatch, text: str, memo: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one sequence of word numbers with a 0 after each, and where each begins."""
    found: list[int] = []
    begin = [0]
    get = memo.__getitem__
    for t in batch.column(text).to_pylist():
        found.extend(map(get, words(t or "")))
        found.append(0)
        begin.append(len(found))
    return np.array(found, dtype=np.int64), np.array(begin)


def _numbers(p: Passages) -> Shapes:
    """A word's number by its shape; a word with unreadable characters is the only passage word that it can be, if there is one."""
    known, every = p.vocabulary.get, f" {' '.join(p.vocabulary)} "

    def number(word: str) -> int:
        if UNREADABLE not in word:
            return known(shape(word), 0)
        pattern = "[a-z]{1,2}".join(re.escape(shape(part)) for part in word.split(UNREADABLE))
        found = set(re.findall(f"(?<= ){pattern}(?= )", every)) if len(word) > 2 else set()
        return known(found.pop()) if len(found) == 1 else 0

    return Shapes(number)


def document_frequencies(documents: DataFrame, text: str, p: Passages) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents, and for each n-gram and for each word of the passages the number of documents with it: over the whole corpus,
    counted per task and added up, so what comes back is bounded by the passages."""

    def count(batches):
        memo = _numbers(p)
        n, single, total = np.zeros(p.features, dtype=np.int64), np.zeros(p.words + 1, dtype=np.int64), 0
        for b in batches:
            x, begin = _read(b, text, memo)
            at, feature = p.hits(x)
            doc = np.searchsorted(begin, at, side="right") - 1
            n += np.bincount(np.unique(doc * p.features + feature) % max(1, p.features), minlength=p.features)
            # Words are many, so they are marked in a table of documents by words, some documents at a time.
            some = max(1, (1 << 24) // (p.words + 1))
            for first in range(0, b.num_rows, some):
                last = min(first + some, b.num_rows)
                mine = x[begin[first] : begin[last]]
                marks = np.zeros((last - first, p.words + 1), dtype=bool)
                own = np.repeat(np.arange(last - first), np.diff(begin[first : last + 1]))
                kept = mine <= p.words
                marks[own[kept], mine[kept]] = True
                single += marks.sum(axis=0)
            total += b.num_rows
        kept, alone = np.flatnonzero(n), np.flatnonzero(single)
        kinds = np.repeat([0, 1, 2], [len(kept), len(alone), 1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([kept, alone, [0]])), pa.array(np.concatenate([n[kept], single[alone], [total]]))], names=["kind", "feature", "n"])

    rows = documents.select(text).mapInArrow(count, "kind int, feature bigint, n bigint").groupBy("kind", "feature").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(p.features, dtype=np.int64), np.zeros(p.words + 1, dtype=np.int64)]
    for k, found in enumerate(out):
        own = rows[rows.kind == k]
        found[own.feature.to_numpy()] = own.n.to_numpy()
    return int(rows[rows.kind == 2].n.sum()), out[0], out[1]


@dataclass
class Space:
    """A latent space of weighted rows: its right singular vectors as products of the rows, so that nothing dense is as long as the features are many.

    A feature's vector is the sum over the rows that have it of their values times ``left``, the rows' left singular vectors over the singular
    values. ``unit`` has the rows' own unit vectors.
    """

    start: np.ndarray
    row: np.ndarray
    value: np.ndarray
    left: np.ndarray
    unit: np.ndarray

    def __post_init__(self):
        self.whole = None

    def basis(self, features: np.ndarray) -> np.ndarray:
        """The vectors of these features, one row each."""
        if (len(self.start) - 1) * self.left.shape[1] <= KEPT_BASIS:
            if self.whole is None:
                self.whole = self._made(np.arange(len(self.start) - 1))
            return self.whole[features]
        every, back = np.unique(features, return_inverse=True)
        return self._made(every)[back]

    def _made(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), self.left.shape[1]), dtype=np.float32)
        for part in np.array_split(np.arange(len(features)), len(features) // 20_000 + 1):
            lo, hi = self.start[features[part]], self.start[features[part] + 1]
            take = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e) for s, e in zip(lo.tolist(), hi.tolist()))])
            own = np.repeat(part, hi - lo)
            np.add.at(out, own, self.left[self.row[take]] * self.value[take, None])
        return out


def latent_space(spark, rows: list[tuple[np.ndarray, np.ndarray]], features: int, rank: int = RANK) -> Space:
    """Randomised SVD of sparse rows (features, values), without a matrix that is dense in features anywhere.

    The left singular vectors span what the rows' Gram matrix G maps a seeded Gaussian matrix to. G itself is never made: entries are
    partitioned by feature, a task sums its features' vectors over the rows that have them and hands each row its share, so a product
    with G is linear in the entries however common a feature is. Two products are made: one gives the range, the other G within it, whose
    eigenvectors are wanted. What the driver holds is rows by rank, bounded by the block of passages.
    """
    n = len(rows)
    size = np.array([len(f) for f, _ in rows], dtype=np.int64)
    entry = pd.DataFrame({"feature": np.concatenate([np.zeros(0, np.int64), *(f for f, _ in rows)]), "row": np.repeat(np.arange(n), size), "value": np.concatenate([np.zeros(0, np.float64), *(v for _, v in rows)]).astype(np.float64)})
    entry = entry.groupby(["feature", "row"], as_index=False).value.sum().sort_values(["feature", "row"])
    start = np.searchsorted(entry.feature.to_numpy(), np.arange(features + 1))
    if not len(entry):
        return Space(start, np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((n, 1), np.float32), np.zeros((n, 1), np.float32))
    k = min(n, rank + OVERSAMPLING)
    entries = spark.createDataFrame(entry).repartition("feature")

    def times(make) -> np.ndarray:
        """G times the matrix that ``make()`` gives in the task."""

        def product(batches):
            x = make()
            out = np.zeros((n, k))
            t = pa.Table.from_batches(list(batches), schema=pa.schema([("feature", pa.int64()), ("row", pa.int64()), ("value", pa.float64())]))
            f, r, v = (t.column(i).to_numpy() for i in range(3))
            order = np.argsort(f, kind="stable")
            f, r, v = f[order], r[order], v[order]
            edge = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
            for part in np.array_split(edge, len(edge) // 20_000 + 1):
                if len(part):
                    last = edge[np.searchsorted(edge, part[-1]) + 1] if part[-1] != edge[-1] else len(f)
                    own = slice(part[0], last)
                    sums = np.add.reduceat(x[r[own]] * v[own, None], part - part[0], axis=0)
                    np.add.at(out, r[own], sums[np.repeat(np.arange(len(part)), np.diff(np.append(part, last)))] * v[own, None])
            used = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([y.tobytes() for y in out[used]], pa.binary())], names=["row", "y"])

        total = np.zeros((n, k))
        for found in entries.mapInArrow(product, "row bigint, y binary").toLocalIterator():
            total[found.row] += np.frombuffer(found.y)
        return total

    q, _ = np.linalg.qr(times(lambda: np.random.default_rng(SEED).standard_normal((n, k))))
    value, vector = np.linalg.eigh(q.T @ times(lambda: q))
    top = np.argsort(-value)[:rank]
    top = top[value[top] > max(value.max(), 0) * 1e-9]
    u, sigma = q @ vector[:, top], np.sqrt(value[top])
    own = u * sigma
    unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    return Space(start, entry.row.to_numpy(), entry.value.to_numpy(np.float32), (u / sigma).astype(np.float32), unit.astype(np.float32))


def align(passage: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row's passage with its text: a longest common subsequence whose losses and gaps cost.

    Rows hold word numbers; passages are filled up with -1 and texts with 0. Returns, per row, the score and the number of
    passage words that the best stretch spans.
    """
    (texts, m), n = passage.shape, text.shape[1]
    place = np.arange(n, dtype=np.float32) * -BETWEEN
    number = np.broadcast_to(np.arange(n, dtype=np.int32), (texts, n))
    score = np.zeros((texts, n + 1), dtype=np.float32)
    start = np.zeros((texts, n + 1), dtype=np.int32)
    best, span = np.zeros(texts, dtype=np.float32), np.zeros(texts, dtype=np.int32)
    every = np.arange(texts)
    for i in range(m):
        same = text == passage[:, i, None]
        fresh = score[:, :-1] <= 0
        diagonal = np.where(same, np.maximum(score[:, :-1], 0) + np.float32(FOUND), score[:, :-1] + np.float32(LOST))
        begun = np.where(fresh, np.int32(i), start[:, :-1])
        up = score[:, 1:] + np.float32(LOST)
        take = diagonal >= up
        now, since = np.where(take, diagonal, up), np.where(take, begun, start[:, 1:])
        now = np.maximum(now, 0)
        rising = now + place
        top = np.maximum.accumulate(rising, axis=1)
        source = np.maximum.accumulate(np.where(rising >= top, number, np.int32(0)), axis=1)
        since = np.take_along_axis(since, source, axis=1)
        # A stretch ends with a word found, so only such cells compete.
        ending = np.where(same & take, now, 0)
        at = ending.argmax(axis=1)
        reached = ending[every, at]
        better = reached > best
        best = np.where(better, reached, best)
        span = np.where(better, i + 1 - begun[every, at], span)
        score[:, 1:], start[:, 1:] = np.maximum(top - place, 0), since
    return best, span


def align_score(passage: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The score of ``align`` alone, without keeping where a stretch began."""
    (texts, m), n = passage.shape, text.shape[1]
    place = np.arange(n, dtype=np.float32) * np.float32(-BETWEEN)
    score, best = np.zeros((texts, n + 1), dtype=np.float32), np.zeros(texts, dtype=np.float32)
    for i in range(m):
        same = text == passage[:, i, None]
        diagonal = np.where(same, np.maximum(score[:, :-1], 0) + np.float32(FOUND), score[:, :-1] + np.float32(LOST))
        up = score[:, 1:] + np.float32(LOST)
        now = np.maximum(np.maximum(diagonal, up), 0)
        best = np.maximum(best, np.where(same & (diagonal >= up), now, 0).max(axis=1, initial=0))
        score[:, 1:] = np.maximum(np.maximum.accumulate(now + place, axis=1) - place, 0)
    return best


def verified(p: Passages, x: np.ndarray, begin: np.ndarray, pairs: list[tuple[int, int]], least: float = 0.0) -> list[tuple[int, int, float, int]]:
    """(document, passage, score, span) of the candidate pairs whose score is at least ``least``, aligned whole and several at a time. Most
    candidates score little, so spans are only found where the score is enough."""
    out = []
    size = np.diff(begin) - 1
    pairs = sorted(pairs, key=lambda r: (size[r[0]], len(p.ids[r[1]])))
    while pairs:
        n = int(size[pairs[0][0]])
        block = pairs[: max(1, min(64, 60_000 // max(1, n)))]
        pairs = pairs[len(block) :]
        n, m = max(int(size[d]) for d, _ in block), max(len(p.ids[i]) for _, i in block)
        text, passage = np.zeros((len(block), n), dtype=np.int32), np.full((len(block), m), -1, dtype=np.int32)
        for k, (d, i) in enumerate(block):
            text[k, : size[d]] = x[begin[d] : begin[d + 1] - 1]
            passage[k, : len(p.ids[i])] = p.ids[i]
        if least > 0:
            enough = np.flatnonzero(align_score(passage, text) >= least)
            if not len(enough):
                continue
            block, text, passage = [block[k] for k in enough], text[enough], passage[enough]
        score, span = align(passage, text)
        out += [(d, i, float(a), int(b)) for (d, i), a, b in zip(block, score, span)]
    return out


def answer_share(p: Passages, i: int, x: np.ndarray) -> float:
    """The largest share of one of a passage's answers that a text holds in one place, in order."""
    scores = [align(a[None], x[None])[0][0] / (FOUND * len(a)) for a in p.answer_ids[i]]
    return float(max(scores, default=0.0))


def topic_cosine(space: Space, weight: np.ndarray, x: np.ndarray, passage: int) -> float:
    """The largest latent cosine of a whole passage with a TOPIC_WINDOW of the text, single words as features. Foreign words count in the window's length."""
    foreign = float(np.median(weight[1:])) if len(weight) > 1 else 1.0
    best = 0.0
    vectors = space.basis(np.where(x < len(weight), x, 0))
    w = np.where((x > 0) & (x < len(weight)), weight[np.where(x < len(weight), x, 0)], 0.0)
    full = np.where(w > 0, w, foreign)
    for s in range(0, max(1, len(x) - TOPIC_WINDOW + TOPIC_STRIDE), TOPIC_STRIDE):
        own = slice(s, s + TOPIC_WINDOW)
        # Repeated words add up before they are squared, as in the passage's own row.
        number, at = np.unique(np.where(w[own] > 0, x[own], -1 - np.arange(len(x[own]))), return_inverse=True)
        length = np.sqrt((np.bincount(at, full[own], len(number)) ** 2).sum())
        z = (vectors[own] * w[own, None]).sum(axis=0)
        best = max(best, float(z @ space.unit[passage]) / max(float(length), 1e-9))
    return best


def passage_leaks(documents: DataFrame, key: str, text: str, passages: Sequence[str], answers: Sequence[Sequence[str]] = (), least_score: float = LEAST_SCORE, least_span: int = LEAST_SPAN) -> DataFrame:
    """(key, passage number, score, span, answer, kind) of every document that holds a long stretch of a passage, or a paraphrase of it with its answer.

    ``kind`` is ``passage``, or ``paraphrase`` for a document that holds the answer and either a weaker alignment or the passage's words
    in another order or wording; ``answer`` is the share of an answer found. ``answers`` has the answers that go with each passage.

    1. Words become numbers by canonical shape, so look-alike characters, accents and wrong encodings don't matter; altered
       words stay what they are, and the alignment passes over them.
    2. Document frequencies of the passages' n-grams and words are counted over all documents.
    3. Every window of every document is weighted by TF-IDF (n-grams foreign to the passages get the passages' median weight) and compared
       with all windows of all passages: its cosine is the share of its length that its known n-grams have times the latent cosine of
       these. A window whose share alone is below LEAST_COSINE can't reach it and isn't projected.
    4. Each candidate document that shares LEAST_SHARED n-grams with the passage is aligned in whole with it.
    5. A document that has most n-grams of an answer is also held against the whole passage in a latent space of single words,
       which knows no order, and the answer is aligned.

    Documents are read twice and never shuffled; there is no cap on candidates. NULL and empty texts hold nothing; repeated
    documents are each reported; passages shorter than ``least_span`` words can't be reported as passages.
    """
    p = Passages(list(passages), [list(a) for a in answers])
    spark = documents.sparkSession
    total, df, df_word = document_frequencies(documents, text, p)
    weight, word_weight = (np.log((total + 1) / (n + 0.5)).astype(np.float32) for n in (df, df_word))
    word_weight[0] = 0  # any other word
    windows, of = [], []
    for i, x in enumerate(p.ids):
        for s in _starts(len(x), PASSAGE_STRIDE).tolist():
            f = p.hits(x[s : s + WINDOW])[1]
            windows.append((f, weight[f]))
            of.append(i)
    of = np.array(of, dtype=np.int64)
    space = latent_space(spark, windows, p.features)
    topics = latent_space(spark, [(x, word_weight[x]) for x in p.ids], p.words + 1)
    foreign = float(np.median(weight[df > 0])) if (df > 0).any() else 1.0
    kind = documents.schema[key].dataType.simpleString()

    def search(batches):
        memo = _numbers(p)
        square = weight * weight
        for b in batches:
            x, begin = _read(b, text, memo)
            at, feature = p.hits(x)
            asked = set(p.answered(x, begin))
            if not len(at) and not asked:
                continue
            n = len(x)
            # TF-IDF square length of each position's n-grams: the known ones, and all if the others weigh as a usual known one.
            known = np.bincount(at, square[feature], n)
            length = known + foreign * foreign * (len(GRAMS) - np.bincount(at, minlength=n))
            size = np.diff(begin) - 1
            start = np.concatenate([np.zeros(0, np.int64), *(s + _starts(k, STRIDE) for s, k in zip(begin.tolist(), size.tolist()) if k > 0)])
            end = np.minimum(start + WINDOW, begin[np.searchsorted(begin, start, side="right")] - 1)
            a, c = np.concatenate([[0], np.cumsum(known)]), np.concatenate([[0], np.cumsum(length)])
            mass = np.sqrt(np.maximum(a[end - 1] - a[start], 0) / np.maximum(c[end - 1] - c[start], 1e-9))
            kept = np.flatnonzero(mass >= LEAST_COSINE)
            pairs: set[tuple[int, int]] = set()
            shared = p.sharing(np.searchsorted(begin, at, side="right") - 1, feature)
            for part in np.array_split(kept, len(kept) // 2_000 + 1):
                if not len(part):
                    continue
                lo, hi = np.searchsorted(at, start[part]), np.searchsorted(at, end[part] - 1)
                some = hi > lo
                part, lo, hi = part[some], lo[some], hi[some]
                if not len(part):
                    continue
                take = np.concatenate([np.arange(s, e) for s, e in zip(lo.tolist(), hi.tolist())])
                z = np.add.reduceat(space.basis(feature[take]) * weight[feature[take], None], np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), axis=0)
                z *= (mass[part] / np.maximum(np.linalg.norm(z, axis=1), 1e-9))[:, None]
                near_w, near_p = np.nonzero(z @ space.unit.T >= LEAST_COSINE)
                doc = np.searchsorted(begin, start[part[near_w]], side="right") - 1
                pair = np.unique(doc * len(p.ids) + of[near_p])
                pair = pair[_found(shared, pair)[0]]
                pairs |= set(zip((pair // len(p.ids)).tolist(), (pair % len(p.ids)).tolist()))
            rows = []
            for d, i, score, span in verified(p, x, begin, sorted(pairs - asked), min(least_score, PARAPHRASE_SCORE)) + verified(p, x, begin, sorted(asked)):
                own = x[begin[d] : begin[d + 1] - 1]
                if score >= least_score and span >= least_span:
                    rows.append((d, i, score, span, answer_share(p, i, own), "passage"))
                elif score >= PARAPHRASE_SCORE or (d, i) in asked:
                    share = answer_share(p, i, own)
                    if share >= ANSWER_SHARE and (score >= PARAPHRASE_SCORE or topic_cosine(topics, word_weight, own, i) >= LEAST_TOPIC):
                        rows.append((d, i, score, span, share, "paraphrase"))
            if rows:
                d, i, score, span, share, kinds = zip(*rows)
                columns = [b.column(key).take(pa.array(d)), pa.array(i, pa.int32()), pa.array(score, pa.float64()), pa.array(span, pa.int32()), pa.array(share, pa.float64()), pa.array(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "passage", "score", "span", "answer", "kind"])

    return documents.select(key, text).mapInArrow(search, f"{key} {kind}, passage int, score double, span int, answer double, kind string")


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, answer: str | None = None) -> DataFrame:
    """One row per leaked item and document: ``item``, ``key``, score, span, answer, kind. Items that share a passage are all reported.

    The evaluation set is a stated query set, taken in blocks of BLOCK passages against all documents; items without a
    passage are never leaked; an empty set gives an empty result.
    """
    spark = documents.sparkSession
    given = items.select(item, passage, F.col(answer) if answer else F.lit(None).cast("string")).where(F.col(passage).isNotNull())
    rows = [tuple(r) for r in given.toLocalIterator()]
    own: dict[str, set[str]] = {}
    for _, t, a in rows:
        own.setdefault(t, set()).update([a] if a else [])
    texts = sorted(own)
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((items, item), (documents, key))]
    out = spark.createDataFrame([], f"{kinds[0]}, {kinds[1]}, score double, span int, answer double, kind string")
    for first in range(0, len(texts), BLOCK):
        block = {t: i for i, t in enumerate(texts[first : first + BLOCK])}
        owners = spark.createDataFrame([(block[t], i) for i, t, _ in rows if t in block], f"passage int, {kinds[0]}")
        found = passage_leaks(documents, key, text, list(block), [sorted(own[t]) for t in block])
        found = found.join(owners, "passage").select(item, key, "score", "span", "answer", "kind")
        out = found if first == 0 else out.unionByName(found)
    return out
