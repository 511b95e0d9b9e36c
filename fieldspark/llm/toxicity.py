"""Toxic spans by a linear-chain conditional random field.

Labels are on documents. A feature is a word, or the beginning of words (four to
six characters). It stands for toxicity if labelled documents that have it are
toxic more often than not at the labels' own proportions, and more often than
chance allows, by a bound over all features at once. Words with such features, and
gaps of a word or two between them, are the labelled tokens of toxic documents;
every other token is clean. The field has two states, a weight for every word, one
for each feature, which add up over the features of a word, and transition
weights, trained on the likelihood of the labelled sequences.

A text's marginals come from the forward and backward passes over all its words.
Marginals above ``FLOOR`` add up; their sum and maximum go through a logistic
curve fitted to the document labels, which never falls. Runs of marginals of a
half or more are the offending spans, in code points.

The fit uses at most ``SAMPLE`` labelled documents of each class, taken by hash of
their number and read whole; of documents with equal numbers the one with the
smallest text. Features are counted on the cluster, and the driver gets the
``FEATURES`` strongest and the distinct segments of ``SEGMENT`` words, as numbers
of features with their frequency (at most ``SEGMENTS`` of them, taken by hash).

Null, empty and wordless texts get the score of a text without features.
Without labels of both kinds nothing is marked and every score is the share of
toxic labels (0 without labels). Of several labels of a document the largest
counts; null labels are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialise
from .common import append, fresh, plain_words

SAMPLE = 3000
FEATURES = 4096
SEGMENTS = 100_000
SEGMENT = 64
# Segments in a training step's block.
BLOCK = 2048
RIDGE = 1e-4
BEGINNINGS = (6, 5, 4)
# Features that a word has at most.
SLOTS = 1 + len(BEGINNINGS)
NO_FEATURES = (0,) * SLOTS
# Words whose factor a scoring task remembers.
REMEMBERED = 100_000
FLOOR = 0.02
THRESHOLD = 0.7
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features_of(word: bytes) -> list[bytes]:
    """The word and its beginnings. A star, which no word has, marks a beginning."""
    letters = word.decode()
    return [word, *[letters[:k].encode() + b"*" for k in BEGINNINGS if len(letters) > k]]


class Remembered(dict):
    """``make`` of the values that ``found`` has for the features of a word; None without any."""

    def __init__(self, found: dict, make: Callable):
        super().__init__()
        self.found, self.make = found, make

    def __missing__(self, word: bytes):
        values = [self.found[f] for f in features_of(word) if f in self.found]
        value = self.make(values) if values else None
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


@dataclass
class Field:
    """Potentials relative to the clean state: the toxic state's factor of a word, ``other``, times that of each feature; moves[from][to]."""

    words: dict[bytes, float] = field(default_factory=dict)
    other: float = 1e-4
    moves: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 1.0), (1.0, 1.0))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @cached_property
    def memory(self) -> Remembered:
        return Remembered(self.words, lambda factors: self.other * math.prod(factors))

    def pass_over(self, n: int, marked: dict[int, float], moves) -> list[float]:
        """Normalised share of the toxic state at each place, all words up to it taken in."""
        (m00, m01), (m10, m11) = moves
        out: list[float] = []
        stops = [*sorted(marked), n]
        at, stop, toxic = 0, 0, None
        while at < n:
            factor = marked.get(at)
            if factor is not None:
                stop += 1
            e = self.other if factor is None else factor
            if toxic is None:
                clean_in, toxic_in = 1.0, 1.0
            else:
                clean_in, toxic_in = (1 - toxic) * m00 + toxic * m10, (1 - toxic) * m01 + toxic * m11
            share = toxic_in * e / (clean_in + toxic_in * e)
            out.append(share)
            settled = factor is None and toxic is not None and abs(share - toxic) < 1e-15
            toxic = share
            at += 1
            if settled:  # nothing changes before the next marked word
                out.extend([share] * (stops[stop] - at))
                at = stops[stop]
        return out

    def marginals(self, words: list[bytes]) -> list[float]:
        """Probability of the toxic state of each word; empty if no word is marked."""
        look = self.memory
        marked = {i: e for i, e in enumerate(map(look.__getitem__, words)) if e is not None}
        if not marked:
            return []
        n = len(words)
        (m00, m01), (m10, m11) = self.moves
        ahead = self.pass_over(n, marked, self.moves)
        back = self.pass_over(n, {n - 1 - i: e for i, e in marked.items()}, ((m00, m10), (m01, m11)))[::-1]
        out = []
        for i in range(n):
            toxic = ahead[i] * back[i] / marked.get(i, self.other)
            clean = (1 - ahead[i]) * (1 - back[i])
            out.append(toxic / (toxic + clean))
        return out

    def evidence(self, words: list[bytes]) -> tuple[float, float, list[float]]:
        p = self.marginals(words)
        seen = [x for x in p if x > FLOOR]
        return (sum(seen), max(seen), p) if seen else (0.0, 0.0, p)

    def score(self, total: float, most: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-(a + b * np.log1p(total) + c * most))))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the documents to fit on, stored, and the number of labels of each kind there are."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    found = texts.join(F.broadcast(chosen), "doc_id")  # 2 * sample rows
    return materialise(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")), counts


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, k, n): documents with a feature, toxic ones and all; features of fewer than three are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update({f for w in set(plain_words(text)) for f in features_of(w)})
            names = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([toxic[f] + clean[f] for f in names], pa.int64())],
                names=["feature", "k", "n"],
            )

    counted = rows.select("text", "toxic").mapInArrow(count, "feature binary, k bigint, n bigint")
    return counted.groupBy("feature").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).where("n >= 3")


def telling(counted: DataFrame, share: float, clean_each: float) -> list[bytes]:
    """The strongest features whose documents are toxic too often for chance (Chernoff bound, over all features together).

    ``share`` of the sampled documents is toxic; each clean one stands for ``clean_each`` times as many labels as a toxic one.
    """
    counted = materialise(counted)
    bound = float(np.log(max(1, counted.count()) / 0.05))
    rate = F.col("k") / F.col("n")
    rest = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    mostly = F.col("k") > (F.col("n") - F.col("k")) * max(clean_each, 1.0)
    gain = F.when(mostly & (rate > share), F.col("n") * (rate * F.log(rate / share) + rest))
    best = counted.select("feature", gain.alias("gain")).where(F.col("gain") > bound).orderBy(F.desc("gain"), "feature").limit(FEATURES)
    return sorted(bytes(r.feature) for r in best.collect())


def numbered(found: list[int]) -> tuple[int, ...]:
    return (*found, *[0] * (SLOTS - len(found)))


def labelled_tokens(words: list[bytes], label: int, look: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Features (0: none) and state of each token."""
    features = np.array([look[w] or NO_FEATURES for w in words], np.uint16).reshape(-1, SLOTS)
    states = features.any(1).astype(np.uint8) if label else np.zeros(len(words), np.uint8)
    at = np.flatnonzero(states)
    for a, b in zip(at, at[1:], strict=False):
        if b - a <= 3:
            states[a:b] = 1
    return features, states


def segment_counts(rows: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(features, states, n): the distinct segments and how often they occur."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # FEATURES numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Remembered(shared.value, numbered)
        for batch in batches:
            found = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, s = labelled_tokens(plain_words(text), label, look)
                found.update((f[i : i + SEGMENT].tobytes(), s[i : i + SEGMENT].tobytes()) for i in range(0, len(f), SEGMENT))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["features", "states", "n"],
            )

    return rows.select("text", "toxic").mapInArrow(cut, "features binary, states binary, n bigint").groupBy("features", "states").agg(F.sum("n").alias("n"))


@dataclass
class Sequences:
    """Segments, padded: features of each place, states, and places that are there; ``times`` each occurs."""

    x: np.ndarray
    y: np.ndarray
    there: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[bytes, bytes, int]]) -> Sequences:
        x, y = np.zeros((len(parts), SEGMENT, SLOTS), np.uint16), np.zeros((len(parts), SEGMENT), np.uint8)
        there = np.zeros((len(parts), SEGMENT), bool)
        for i, (f, s, _) in enumerate(parts):
            x[i, : len(s)], y[i, : len(s)], there[i, : len(s)] = np.frombuffer(f, np.uint16).reshape(-1, SLOTS), np.frombuffer(s, np.uint8), True
        return cls(x, y, there, np.array([n for *_, n in parts], float))

    def blocks(self) -> Iterator[Sequences]:
        for i in range(0, len(self.x), BLOCK):
            part = slice(i, i + BLOCK)
            yield Sequences(self.x[part], self.y[part], self.there[part], self.times[part])


def likelihood(block: Sequences, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a block's labels and its derivatives by feature and transition weight. ``w[0]`` is the weight of every word."""
    x, y, there, times = block.x, block.y, block.there, block.times
    pairs = there[:, 1:]
    often = np.broadcast_to(times[:, None], y.shape)
    each = np.concatenate([[0.0], w[1:]])
    e, m = np.exp(w[0] + each[x].sum(2)), np.exp(t)
    ahead, back = np.empty((*y.shape, 2)), np.ones((*y.shape, 2))
    norm = np.zeros(len(x))
    for i in range(SEGMENT):
        into = ahead[:, i - 1] @ m if i else np.ones((len(x), 2))
        now = np.stack([into[:, 0], into[:, 1] * e[:, i]], 1)
        size = now.sum(1)
        norm += np.where(there[:, i], np.log(size), 0.0)
        ahead[:, i] = now / size[:, None]
    for i in range(SEGMENT - 2, -1, -1):
        out = np.stack([back[:, i + 1, 0], back[:, i + 1, 1] * e[:, i + 1]], 1) @ m.T
        back[:, i] = np.where(pairs[:, i, None], out / out.sum(1, keepdims=True), 1.0)
    both = ahead * back
    p = both[..., 1] / both.sum(2)
    right = np.stack([back[:, 1:, 0], back[:, 1:, 1] * e[:, 1:]], 2)
    joint = ahead[:, :-1, :, None] * m * right[:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    used = x[there]

    def by_feature(mass: np.ndarray) -> np.ndarray:
        out = np.bincount(used.ravel(), np.repeat(mass[there], SLOTS), len(w))
        out[0] = mass[there].sum()
        return out

    gold = by_feature(often * y)
    gold_moves = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pairs) @ np.ones(SEGMENT - 1) @ times for j in (0, 1)] for i in (0, 1)])
    by_word = gold - by_feature(often * p)
    by_move = gold_moves - (joint * (often[:, 1:] * pairs)[:, :, None, None]).sum((0, 1))
    return float(gold @ w + (gold_moves * t).sum() - norm @ times), by_word, by_move


def train(sequences: Sequences, n_features: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the toxic state by feature, and the 2 x 2 transition weights, by gradient steps, a block of segments at a time."""
    w, t = np.full(n_features, 1.0), np.zeros((2, 2))
    w[0] = -3.0
    size = float(sequences.times.sum())
    mean, square = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for step in range(1, rounds + 1):
        slope = np.zeros(n_features + 4)
        for block in sequences.blocks():
            _, by_word, by_move = likelihood(block, w, t)
            slope += np.concatenate([by_word, by_move.ravel()])
        slope = slope / size - RIDGE * np.concatenate([w, t.ravel()])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:n_features], t + move[n_features:].reshape(2, 2)
    return w, t - t[0, 0]


def fit_curve(evidence: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, slightly ridged; evidence whose weight would be negative is left out."""
    x = np.column_stack([np.ones(len(labels)), np.log1p(evidence[:, 0]), evidence[:, 1]])
    used = [0, 1, 2]
    while True:
        z, b = x[:, used], np.zeros(len(used))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            ridge = np.diag([1e-6, 0.01, 0.01][: len(used)]) * weights.sum() / len(labels)
            b = b + np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weights * (labels - p)) - ridge @ b)
        negative = [i for i, v in zip(used[1:], b[1:], strict=True) if v < 0]
        if not negative:
            full = np.zeros(3)
            full[used] = b
            return tuple(float(v) for v in full)
        used.remove(min(negative, key=lambda i: b[used.index(i)]))


def evidence_rows(rows: DataFrame, model: Field) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model_ = replace(shared.value)
            seen = [model_.evidence(plain_words(t))[:2] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a for a, _ in seen], pa.float64()), pa.array([b for _, b in seen], pa.float64())], names=["toxic", "total", "most"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, total double, most double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on a bounded sample of labelled documents outside the held-out third."""
    rows, counts = sampled(docs, labels, sample)
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    share = n_toxic / max(1, n_toxic + n_clean)
    prior = (float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0, 0.0)
    there = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not there.get(1) or not there.get(0):
        return Field(curve=prior)
    listed = telling(feature_counts(rows), there[1] / (there[0] + there[1]), (n_clean / there[0]) / (n_toxic / there[1]))
    if not listed:
        return Field(curve=prior)
    index = {f: i + 1 for i, f in enumerate(listed)}
    segments = segment_counts(rows, index).orderBy(F.xxhash64("features", "states"), "features", "states").limit(SEGMENTS).toArrow()
    w, t = train(Sequences.of(sorted(zip(*(segments.column(c).to_pylist() for c in ("features", "states", "n")), strict=True))), len(index) + 1)
    moves = tuple(tuple(float(v) for v in r) for r in np.exp(t))
    model = Field({f: float(np.exp(w[i])) for f, i in index.items()}, float(np.exp(w[0])), moves)
    seen = sorted((r.total, r.most, r.toxic) for r in evidence_rows(rows, model).collect())  # 2 * sample rows
    evidence, known = np.array([s[:2] for s in seen]), np.array([s[2] for s in seen], float)
    n1 = known.sum()
    weights = np.where(known == 1, n_toxic / max(n1, 1), n_clean / max(len(known) - n1, 1))
    model.curve = fit_curve(evidence, known, weights / weights.mean())
    return model


def spans_of(text: str, marginals: list[float]) -> list[tuple[int, int]]:
    """Code point intervals of runs of words that are more likely toxic than not."""
    out: list[tuple[int, int]] = []
    last = -2
    for i, match in enumerate(WORD.finditer(text)):
        if marginals[i] >= 0.5:
            if last == i - 1:
                out[-1] = (out[-1][0], match.end())
            else:
                out.append(match.span())
            last = i
    return out


def score(docs: DataFrame, model: Field, names: tuple[str, str, str] = ("score", "predicted", "toxic_spans")) -> DataFrame:
    """Add score, predicted and toxic_spans, under these names, to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def open_batch():
        field_ = replace(shared.value)  # remembers words for this task alone
        nothing = field_.score(0.0, 0.0)

        def work(texts: list[bytes]) -> list[list]:
            scores, spans = [], []
            for text in texts:
                total, most, p = field_.evidence(plain_words(text))
                scores.append(field_.score(total, most) if most else nothing)
                spans.append([{"start": a, "stop": b} for a, b in spans_of(text.decode(), p)] if most >= 0.5 else [])
            return [scores, [int(s >= THRESHOLD) for s in scores], spans]

        return work

    value, mark, spans_ = names
    return append(docs, "text", f"`{value}` double, `{mark}` int, `{spans_}` array<struct<start:int,stop:int>>", open_batch)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending spans as start:stop, comma-joined, of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score(rows, fit(docs, labels))
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", spans.alias("toxic_spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with the columns they came with."""
    names = tuple(fresh(n, docs.columns) for n in ("score", "predicted", "toxic_spans"))
    return score(docs, fit(docs, labels), names).where(F.col(names[1]) == 0).select(*docs.columns)
