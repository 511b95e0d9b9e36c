"""BPE encoding by a prefix-sharing trie, and decoding.

The distinct words of a batch form a trie. A depth-first walk gives each node
the last token of the encoding of its prefix: the token that ends there and may
follow the last token of the prefix before it. Two tokens may follow each other
if merging their joined bytes leaves them as they are; a sequence in which all
neighbours may follow each other is the encoding, and there is only one. So a
prefix shared by many words is worked out once, and a word's tokens are read
back along its path. The sorted list of words is the trie's preorder; the stack
of states holds the path from the root, so no node objects are made.

Null and empty texts have no tokens. Encodings of words stay in a bounded
memory per worker.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from os.path import commonprefix

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, PreTokens, stand_ins
from .common import append

REMEMBERED = 500_000
# Bytes of text whose distinct words share a trie.
SLICE = 1 << 20
# Words beyond this length are encoded but not remembered.
LONG = 64


class TrieEncoder:
    def __init__(self, bpe: ByteBpe, alone: set[int], other_class: dict[int, str]):
        """``alone``: ids whose bytes merge into exactly that token."""
        self.tokens = {token: i for token, i in bpe.ids.items() if i in alone}
        self.pieces, self.ranks = bpe.pieces, bpe.ranks
        self.parts = {made: pair for pair, (_, made) in bpe.ranks.items()}
        # For the last bytes of a prefix: the lengths of tokens that end so, longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in self.tokens:
            lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {end: sorted(found, reverse=True) for end, found in lengths.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        # Words seen of late, and those seen before them; a word that comes up again moves over.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pre = PreTokens(bpe.specials, other_class)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two tokens.

        Along the border only the right edge of the left token's merge tree and
        the left edge of the right one's take part. Going up from the bytes, a
        crossing pair wins if its rank is below that of the next merge on the
        left, and not above that on the right (which lies further right).
        """
        answer = self.follows.get((left, right))
        if answer is not None:
            return answer
        parts, ranks, never = self.parts, self.ranks, 1 << 30
        edge_l, edge_r = [left], [right]
        while edge_l[-1] in parts:
            edge_l.append(parts[edge_l[-1]][1])
        while edge_r[-1] in parts:
            edge_r.append(parts[edge_r[-1]][0])
        i, j, answer = len(edge_l) - 1, len(edge_r) - 1, True
        while True:
            grow_l = ranks[parts[edge_l[i - 1]]][0] if i else never
            grow_r = ranks[parts[edge_r[j - 1]]][0] if j else never
            cross = ranks.get((edge_l[i], edge_r[j]), (never, 0))[0]
            if cross < never and cross < grow_l and cross <= grow_r:
                answer = False
                break
            if not i and not j:
                break
            if grow_l <= grow_r:
                i -= 1
            else:
                j -= 1
        if len(self.follows) >= REMEMBERED:
            self.follows.clear()
        self.follows[left, right] = answer
        return answer

    def walk(self, words: list[str]):
        """(word, its ids) for distinct words, over the trie in preorder."""
        tokens, lengths, follows, may_follow = self.tokens, self.lengths, self.follows, self.may_follow
        last: list[int] = [-1]  # by depth: the last token of the prefix
        size: list[int] = [0]  # and its length
        previous = b""
        for word, raw in sorted(((w, w.encode()) for w in words), key=lambda x: x[1]):
            depth = len(commonprefix((previous, raw)))
            del last[depth + 1 :], size[depth + 1 :]
            for end in range(depth + 1, len(raw) + 1):
                for n in lengths.get(raw[max(0, end - 2) : end], ()) if end > 1 else (1,):
                    if n > end:
                        continue
                    token = tokens.get(raw[end - n : end])
                    if token is not None and (n == end or follows.get((last[end - n], token)) or may_follow(last[end - n], token)):
                        break
                else:
                    n, token = 1, tokens[raw[end - 1 : end]]  # one byte always ends a prefix
                last.append(token)
                size.append(n)
            previous = raw
            ids, end = [], len(raw)
            while end:
                ids.append(last[end])
                end -= size[end]
            yield word, ids[::-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = [[] for _ in texts]
        for group in self._groups(texts):
            if len(self.known) >= REMEMBERED // 2:
                self.older, self.known = self.known, {}
            known, older = self.known, self.older
            new = set().union(*[words for _, words in group if not isinstance(words, int)]) - known.keys()
            again = new & older.keys()
            known.update((word, older.pop(word)) for word in again)
            new -= again
            for word, ids in self.walk(list(new)):
                known[word] = struct.pack(f"<{len(ids)}I", *ids)
            for at, words in group:
                out[at].append(struct.pack("<I", words) if isinstance(words, int) else b"".join(map(known.__getitem__, words)))
            for word in new:
                if len(word) > LONG:
                    del known[word]
        return [b"".join(parts) for parts in out]

    def _groups(self, texts: list[str]):
        """Blocks of pre-tokens of successive texts, a bounded number of words at a time."""
        group, size = [], 0
        for at, text in enumerate(texts):
            for section, special in self.pre.sections(text):
                for words in [special] if special is not None else self.pre.blocks(section):
                    group.append((at, words))
                    size += 1 if isinstance(words, int) else len(words)
                    if size >= 1_000_000:
                        yield group
                        group, size = [], 0
        if group:
            yield group

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that form no character become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids))).decode("utf-8", "replace")


def sliced(texts: list[bytes], most: int = SLICE) -> Iterator[list[bytes]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text: what a trie holds at once."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def tables(spark, path: str):
    """Broadcast parts of an encoder: as large as the vocabulary file. ``path`` is read by the driver alone."""
    bpe = ByteBpe.read(path)
    alone = {i for token, i in bpe.ids.items() if bpe.merge(token) == [i]}
    return spark.sparkContext.broadcast((bpe.ids, bpe.ranks, bpe.specials, alone, stand_ins()))


def encoder(shared) -> TrieEncoder:
    ids, ranks, specials, alone, other_class = shared.value
    return TrieEncoder(ByteBpe(ids, ranks, specials), alone, other_class)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of every text as a binary column of little-endian unsigned 32-bit integers."""
    shared = tables(df.sparkSession, path)

    def open_batch():
        mine = encoder(shared)
        return lambda texts: [[ids for part in sliced(texts) for ids in mine.encode([t.decode() for t in part])]]

    return append(df, text, f"`{out}` binary", open_batch)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of a binary column of ids; null gives the empty text."""
    shared = tables(df.sparkSession, path)

    def open_batch():
        mine = encoder(shared)
        return lambda rows: [[mine.decode(r) for r in rows]]

    return append(df, ids, f"`{out}` string", open_batch)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and the number and digest of a text's ids and the digest of the decoded text, in one pass over the rows."""
    shared = tables(docs.sparkSession, path)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def open_batch():
        mine = encoder(shared)

        def work(texts: list[bytes]) -> list[list]:
            made: list[tuple] = []
            for part in sliced(texts):
                ids = mine.encode([t.decode() for t in part])
                made += [(len(x) // 4, sha(x), sha(mine.decode(x).encode())) for x in ids]
            return [[m[i] for m in made] for i in range(3)]

        return work

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return append(rows, text, fields, open_batch, keep=["doc_id"])
