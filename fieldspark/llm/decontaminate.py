"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``WINDOW`` words of a benchmark item is a test string; an item with
fewer words is one by itself. Test strings of equal length form a table set:

* *shift*: for each block of two words, how far the search may move on when it
  ends in that block; a block in no test string lets it jump past all of them;
* *buckets*: test strings by their last block, looked at when the shift is zero;
* words are then compared directly, by equality of the whole test string.

Items are taken in groups of bounded size, so the tables sent to the workers
never grow with the benchmark: one pass over the documents for each group, each
written to the shared folder. Within a document nothing but hit intervals and
item ids is kept; documents are never shuffled.

Null or wordless texts have no words and no hits; a wordless item has no test
string. Rows with equal item_id are one item. A test string of an item without
item_id marks words, but names no item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialise
from .common import append, fresh, plain_words, utf8

WINDOW = 10
# Bytes of benchmark text behind one set of tables.
GROUP_BYTES = 4 << 20


class WordSearch:
    """Wu-Manber tables over test strings that all have ``length`` words."""

    def __init__(self, length: int, strings: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}
        for words, items in strings.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.buckets.setdefault(words[length - self.block :], {})[words] = items

    def find(self, words: list[bytes]):
        """(first word, items) of every occurrence."""
        shift, jump, length, block, n = self.shift.get, self.jump, self.length, self.block, len(words)
        end = length
        while end <= n:
            last = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift(last, jump)
            if step:
                end += step
                continue
            items = self.buckets[last].get(tuple(words[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


def test_strings(rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[int, dict]:
    """By length: each test string with the ids of its items."""
    out: dict[int, dict] = {}
    for item, text in rows:
        words = plain_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            items = out.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set())
            if item is not None:
                items.add(item)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


NAMES = ("n_words", "hit_spans", "hit_items")


def _search(docs: DataFrame, rows: list[tuple[str | None, bytes]], window: int, names: tuple[str, str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(test_strings(rows, window))

    def open_batch():
        searches = [WordSearch(n, strings) for n, strings in shared.value.items()]

        def work(texts: list[bytes]) -> list[list]:
            counts, spans, found = [], [], []
            for text in texts:
                words, hits, items = plain_words(text), [], set()
                for s in searches:
                    for at, names in s.find(words):
                        hits.append((at, at + s.length))
                        items |= names
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in merged(hits)])
                found.append(sorted(items))
            return [counts, spans, found]

        return work

    return append(docs, "text", f"`{names[0]}` bigint, `{names[1]}` array<struct<start:int,stop:int>>, `{names[2]}` array<string>", open_batch)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, names: tuple[str, str, str] = NAMES
) -> DataFrame:
    """Add n_words, hit_spans (word intervals inside test strings) and hit_items (ids, sorted), under these names, to every row of ``docs``."""
    _, hit_spans, hit_items = names
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8("text").alias("words")).distinct()
    size = items.agg(F.sum(F.length("words"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    spans, found = fresh("spans", docs.columns), fresh("items", docs.columns)
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == g)
        rows = [(r.item, bytes(r.words)) for r in part.toLocalIterator()]  # one group, of bounded size
        before = docs
        if g:
            before = docs.withColumnsRenamed({hit_spans: spans, hit_items: found})
        docs = _search(before, rows, window, names)
        if g:
            docs = docs.withColumns(
                {hit_spans: F.concat(spans, hit_spans), hit_items: F.array_sort(F.array_union(found, hit_items))}
            ).drop(spans, found)
        if groups > 1:
            docs = materialise(docs)
    return docs


def overlap_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items per document. Spans of several groups may overlap, so each word counts at the first span over it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = find_overlaps(rows, benchmark)
    fold = """aggregate(array_sort(hit_spans), named_struct('hit', 0L, 'reached', 0),
        (s, x) -> named_struct('hit', s.hit + greatest(0, x.stop - greatest(x.start, s.reached)), 'reached', greatest(s.reached, x.stop)), s -> s.hit)"""
    return found.select(
        "doc_id",
        "n_words",
        F.expr(fold).alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )



def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a hit, with the columns they came with."""
    names = tuple(fresh(n, docs.columns) for n in NAMES)
    return find_overlaps(docs, benchmark, names=names).where(F.size(names[1]) == 0).select(*docs.columns)
