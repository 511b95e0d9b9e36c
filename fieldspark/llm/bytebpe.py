"""Byte-level BPE vocabularies: file reading, pre-tokens, and merging by rank."""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass
from functools import cache, cached_property

import regex
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

# How byte-level BPE of this family splits text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts are split in blocks of about this many characters, at places where no pre-token crosses.
BLOCK = 1 << 20


# A character of each class that both packages know.
STAND_INS = {r"\p{L}": "\u00e9", r"\p{N}": "\u00b2", r"\s": "\u00a0", "": "\u00a4"}


@cache
def stand_ins() -> dict[int, str]:
    """For every character that the ``tokenizers`` library puts into another class than ``regex`` does, one of the class that it has there.

    The two packages know different versions of Unicode. All characters that
    ``regex`` knows are shown to the library once; those unknown to it have no class.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = regex.findall(r"[^\p{Cn}\p{Co}]", everything)
    there, here = dict.fromkeys(known, ""), dict.fromkeys(known, "")
    for kind, between in ((r"\p{L}", "\n"), (r"\p{N}", "\n"), (r"\s", "a")):
        here.update(dict.fromkeys(regex.findall(kind, everything), kind))
        split = Split(Regex(kind), "isolated")
        for i in range(0, len(known), 1024):
            line = between.join(known[i : i + 1024])  # a match is one character at an even place, all else is longer or lies between
            there.update((c, kind) for c, (a, b) in split.pre_tokenize_str(line) if b - a == 1 and a % 2 == 0)
    return {ord(c): STAND_INS[there[c]] for c in known if there[c] != here[c]}


def byte_letters() -> dict[str, int]:
    """Letter standing for each byte in vocabulary files: visible Latin-1 for itself, the rest from U+0100 on in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class ByteBpe:
    """``ids``: token bytes to id. ``ranks``: pair of ids to (rank, merged id). ``specials``: strings taken out of texts first."""

    ids: dict[bytes, int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]

    @classmethod
    def read(cls, path: str) -> ByteBpe:
        """A ``tokenizers`` file with the plain byte-level set-up; any other set-up is refused."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space along are not supported")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        named = model["vocab"]
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[named[a], named[b]] = (rank, named[a + b])
        return cls(ids, ranks, {t["content"]: t["id"] for t in spec["added_tokens"]})

    @cached_property
    def byte_ids(self) -> list[int]:
        return [self.ids[bytes([b])] for b in range(256)]

    @cached_property
    def pieces(self) -> dict[int, bytes]:
        """Bytes of each id, special tokens included."""
        return {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in self.specials.items()}

    @cached_property
    def whole(self) -> dict[str, int]:
        """Vocabulary strings that merging alone turns into exactly their own token."""
        out = {}
        for token, i in self.ids.items():
            if self.merge(token) == [i]:
                try:
                    out[token.decode()] = i
                except UnicodeDecodeError:  # part of a character; no pre-token equals it
                    continue
        return out

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left. O(n log n)."""
        ids = [self.byte_ids[b] for b in word]
        ranks = self.ranks
        if len(ids) < 60:
            none = (1 << 30, 0)
            found = [ranks.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
            while found:
                best = min(found)
                if best is none:
                    break
                at = found.index(best)
                ids[at : at + 2] = [best[1]]
                del found[at]
                if at:
                    found[at - 1] = ranks.get((ids[at - 1], best[1]), none)
                if at < len(found):
                    found[at] = ranks.get((best[1], ids[at + 1]), none)
            return ids
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(*ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heap = [(r, i, p, made) for r, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i] if alive[i] else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (p := (ids[left], ids[right])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], left, p, ranks[p][1]))
        return [t for t, there in zip(ids, alive, strict=True) if there]


class PreTokens:
    """Splits texts into special tokens and pre-tokens, a bounded block at a time."""

    def __init__(self, specials: dict[str, int], other_class: dict[int, str]):
        self.find = regex.compile(PRETOKEN).findall
        self.other_class = other_class
        # Two searches, each cheap per character: a set within the basic plane, and one range for all beyond it.
        low = "".join(f"\\u{c:04x}" for c in sorted(other_class) if c < 0x10000)
        self.odd = [re.compile(f"[{low}]")] if low else []
        if any(c >= 0x10000 for c in other_class):
            self.odd.append(re.compile("[\U00010000-\U0010ffff]"))
        self.specials = specials
        longest_first = sorted(specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if specials else None
        self.border = regex.compile(r"(?<=\S)\s")

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a block, with the library's character classes."""
        if text.isascii() or not any(odd.search(text) for odd in self.odd):
            return self.find(text)
        out, at = [], 0
        for piece in self.find(text.translate(self.other_class)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def sections(self, text: str):
        """(text, None) and ('', id of a special token), in order."""
        if self.special is None or not any(s in text for s in self.specials):
            yield text, None
            return
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                yield "", self.specials[part]
            elif part:
                yield part, None

    def blocks(self, text: str):
        """Lists of pre-tokens. White space after anything else always starts a pre-token."""
        at = 0
        while len(text) - at > BLOCK:
            border = self.border.search(text, at + BLOCK)
            if border is None:
                break
            yield self.words(text[at : border.start()])
            at = border.start()
        yield self.words(text[at:] if at else text)
