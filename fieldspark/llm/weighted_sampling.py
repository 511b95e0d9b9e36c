"""Document fingerprints by consistent weighted sampling.

Terms are the lower-cased words of a text, weighted by how often they occur.
For each of ``SAMPLES`` draws a term of weight ``w`` has fixed random values from
its hash: ``r`` and ``c`` from a gamma law of shape two, ``b`` uniform. With
``t = floor(ln w / r + b)`` and ``ln y = r (t - b)``, the term with the smallest
``ln c - ln y - r`` is drawn, together with its ``t``. Two texts draw alike with
the probability of their generalised Jaccard similarity, the sum of smaller over
the sum of larger weights. A fingerprint holds 16 bits of each draw in hex.

Null, empty and blank texts have no terms: their fingerprint is empty, alike (1)
to another empty one and unlike (0) any other.

Neighbours in descending doc_id are found without a global sort: cut points
split the numbers into ranges, each range is sorted in one task, and the rows
that begin a range are also sent to the range before it (the very first row to
the last range). Null doc_ids come last; rows of equal doc_id are ordered by a
hash of their text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, spaced_words

SAMPLES = 64
# Draws of (word, weight) that a worker remembers, 0.4 KB each.
REMEMBERED = 250_000
U = np.uint64
NONE = -(2**63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """For each term and sample: the value whose minimum is drawn, and 16 bits naming term and level."""
    place = _mix(np.arange(1, samples + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    base = hashes[:, None] ^ place[None, :]
    u = []
    for i in range(5):
        base = _mix(base + U(0x9E3779B97F4A7C15))
        u.append(((base >> U(40)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24))
    r, c, b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    value = np.log(c) - r * (t - b) - r
    name = _mix(base ^ t.astype(np.int64).astype(U)) >> U(48)
    return value.astype(np.float32), name.astype(np.uint16)


class Fingerprints:
    """Fingerprints of batches of texts, with a bounded memory of draws."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.columns = np.arange(samples)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[tuple[bytes, int], int] = {}
        self.values = np.empty((4096, self.samples), np.float32)
        self.names = np.empty((4096, self.samples), np.uint16)

    def _add(self, new: list[tuple[bytes, int]]) -> None:
        need = len(self.rows) + len(new)
        if need > len(self.values):
            size = max(need, min(2 * len(self.values), REMEMBERED))
            self.values = np.concatenate([self.values, np.empty((size - len(self.values), self.samples), np.float32)])
            self.names = np.concatenate([self.names, np.empty((size - len(self.names), self.samples), np.uint16)])
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            at = len(self.rows)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in part), U, len(part))
            self.values[at : at + len(part)], self.names[at : at + len(part)] = draws(hashes, np.array([n for _, n in part]), self.samples)
            self.rows.update(zip(part, range(at, at + len(part)), strict=True))

    def of(self, text: bytes) -> str:
        terms = list(Counter(spaced_words(text)).items())
        if not terms:
            return ""
        rows = self.rows
        if len(terms) > 50_000:  # term blocks of a very long text, the smallest value of all counts
            best, names = None, None
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                value, name = draws(np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in part), U, len(part)), np.array([n for _, n in part]), self.samples)
                at = value.argmin(0)
                value, name = value[at, self.columns], name[at, self.columns]
                if best is None:
                    best, names = value, name
                else:
                    names = np.where(value < best, name, names)
                    best = np.minimum(value, best)
            return names.astype(">u2").tobytes().hex()
        new = [t for t in terms if t not in rows]
        if new:
            if len(rows) + len(new) > REMEMBERED:
                self.clear()
                rows, new = self.rows, terms
            self._add(new)
        at = np.fromiter(map(rows.__getitem__, terms), np.int64, len(terms))
        first = self.values[at].argmin(0)
        return self.names[at[first], self.columns].astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal draws."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), np.uint16), np.frombuffer(bytes.fromhex(b), np.uint16)
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text."""


    def open_batch():
        prints = Fingerprints()
        return lambda texts: [[prints.of(t) for t in texts]]

    return append(df, text, f"`{out}` string", open_batch)


def in_descending_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, copy, doc_id, text): in each bucket all rows in order, then copies of the row or rows that come next."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(NONE)).alias("id"))
    cuts = np.unique(np.array(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], np.float64)).astype(np.int64)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cuts, batch.column(0).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], names=["bucket", "id"])

    tops = ids.mapInArrow(numbered, "bucket int, id bigint").groupBy("bucket").agg(F.max("id").alias("top"))
    heads = sorted((r.bucket, r.top) for r in tops.collect())  # one row for each range
    above = [b for b, _ in heads[1:]] + [heads[0][0]] if heads else []
    goes_to = {top: b for (_, top), b in zip(heads, above, strict=True)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).fill_null(NONE).to_numpy()
            at = np.searchsorted(cuts, key, "right").astype(np.int32)
            n = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(n, bool)), *batch.columns], names=["bucket", "copy", "doc_id", "text"])
            again = [i for i, k in enumerate(key.tolist()) if k in goes_to]
            if again:
                part = batch.take(pa.array(again))
                to = pa.array([goes_to[int(key[i])] for i in again], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(again), bool)), *part.columns], names=["bucket", "copy", "doc_id", "text"])

    spread = rows.mapInArrow(placed, "bucket int, copy boolean, doc_id bigint, text string").repartition(parts, "bucket")
    return spread.sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


PRINTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and how alike these and the next document's are."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_descending_order(docs, parts)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        prints = Fingerprints()
        held = None  # the row before, whose next one is still to come
        for bucket, copy, doc_id, text in rows(batches):
            if held is not None and held[0] == bucket:
                mine = prints.of(text.encode())
                changed = edited(held[2], text)
                other = prints.of(changed.encode())
                sha = hashlib.sha256(changed.encode()).hexdigest()
                yield held[1], len(held[2]), sha, held[3], other, likeness(held[3], other), likeness(held[3], mine)
                held = None if copy else (bucket, doc_id, text, mine)
            elif not copy:
                held = (bucket, doc_id, text, prints.of(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for row in compared(batches):
            found.append(row)
            if len(found) >= 1000:
                yield _batch(found)
                found = []
        if found:
            yield _batch(found)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return ordered.mapInArrow(run, PRINTS)
