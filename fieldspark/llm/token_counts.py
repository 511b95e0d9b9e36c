"""Token counts with a whole-token shortcut.

Ahead of the run, every vocabulary string is merged alone; those that give
exactly their own token are proven whole. A pre-token among them counts one
without any merging, and only the rest is merged, once per distinct string and
worker while it stays in a bounded memory.

Null and empty texts have no tokens. Strings of special tokens inside a text
count as that token, as the file's own library takes them by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .bytebpe import ByteBpe, PreTokens, stand_ins
from .common import append

# Merged strings that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000


def token_counter(bpe: ByteBpe, other_class: dict[int, str]):
    whole, merge, pre, counts = bpe.whole, bpe.merge, PreTokens(bpe.specials, other_class), {}

    def rest(words: list[str]) -> int:
        total = 0
        for w in words:
            n = counts.get(w)
            if n is None:
                if len(counts) >= REMEMBERED:
                    counts.clear()
                n = len(merge(w.encode()))
                if len(w) <= 64:
                    counts[w] = n
            total += n
        return total

    def count(text: str) -> int:
        total = 0
        for section, special in pre.sections(text):
            if special is not None:
                total += 1
                continue
            for words in pre.blocks(section):
                others = [w for w in words if w not in whole]
                total += len(words) - len(others) + rest(others)
        return total

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to every row. ``path`` names a byte-level ``tokenizers`` file, read by the driver."""
    bpe = ByteBpe.read(path)
    bpe.whole  # proven before the run, sent along
    tables = docs.sparkSession.sparkContext.broadcast((bpe.ids, bpe.ranks, bpe.specials, bpe.whole, stand_ins()))  # as large as the file

    def open_batch():
        ids, ranks, specials, whole, other_class = tables.value
        mine = ByteBpe(ids, ranks, specials)
        mine.__dict__["whole"] = whole
        count = token_counter(mine, other_class)

        def work(texts: list[bytes]) -> list[list]:
            tokens = [count(t.decode()) for t in texts]
            return [[len(t) for t in texts], tokens, [n > limit for n in tokens]]

        return work

    return append(docs, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", open_batch)
