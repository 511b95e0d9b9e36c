"""Secrets in texts: fixed patterns, and strings that a tokenizer finds hard.

Fixed patterns give the spans ``assign`` (a value given to a name such as
``password``), ``access`` (access key numbers) and ``hex`` (long lower-case
hexadecimal runs). Runs of characters that keys are written in give the spans
``random``: natural words are few tokens under a vocabulary learnt from text,
random strings many, so a run of at most ``MOST_RATIO`` characters a token is
taken for a secret, unless it is

* without a digit, or a number only (numbers and words are no keys),
* a digest: hexadecimal digits of the length of a common hash, in one case, or
  the value of an integrity attribute (``sha256-...`` and the like),
* an identifier: part of a URL, host or e-mail address, a UUID, a date or version, or
  words and numbers put together by ``-``, ``_``, ``.``, ``/`` or capitals.

Runs of any length are read whole; tokens are counted in blocks of ``BLOCK``
characters. Spans of several kinds may overlap. Spans are in code points, the
end exclusive. Null and empty texts have none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 16
MOST_RATIO = 2.0
BLOCK = 1024

# The base patterns. Letters of ASCII only change case.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

RUN = re.compile(r"[A-Za-z0-9+/_.=@:-]{%d,}" % SHORTEST)
KEY = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
DIGITS = re.compile(r"[0-9]")
LETTERS = re.compile(r"[A-Za-z]")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
# Hexadecimal lengths of digests of 128, 160, 192, 224, 256, 384 and 512 bits.
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
INTEGRITY = re.compile(r"sha(?:1|224|256|384|512)[-:=][A-Za-z0-9+/=]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
MOMENT = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9:.]{4,15}(?:Z|[+-][0-9:]{2,5})?")
ADDRESS = re.compile(r"://|@|^www\.|[A-Za-z]\.[A-Za-z]{2,6}(?:[/:]|$)")
# Words (all small, all capital, or with a first capital) and numbers up to eight digits.
NAMED = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,8}(?![0-9]))[-_./=+:]*)++")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def vocabulary(lines: bytes, pattern: str) -> tiktoken.Encoding:
    """From a tiktoken file: a base64 token and its rank on each line."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns: leftmost matches of each kind, without those whose value is short.

    Runs that end where their characters end need no look at shorter matches: the
    leftmost match of the open-ended pattern is the longest of its run.
    """
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            yield m.start(), m.end(), 0
    for m in ACCESS.finditer(text):
        yield m.start(), m.end(), 1
    for m in HEX.finditer(text):
        yield m.start(), m.end(), 2


def n_tokens(encoding: tiktoken.Encoding, run: str) -> int:
    return sum(len(encoding.encode_ordinary(run[i : i + BLOCK])) for i in range(0, len(run), BLOCK))


def known(run: str) -> bool:
    """Digests and identifiers."""
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or any(p.fullmatch(run) for p in (UUID, MOMENT, INTEGRITY)):
        return True
    if NAMED.fullmatch(run):  # words put together; short pieces on average are no words
        pieces = WORD.findall(run)
        return not pieces or sum(map(len, pieces)) >= 4 * len(pieces)
    return False


def random_spans(text: str, encoding: tiktoken.Encoding, most: float = MOST_RATIO) -> Iterator[tuple[int, int, int]]:
    for whole in RUN.finditer(text):
        outer = whole.group()
        if not DIGITS.search(outer) or not LETTERS.search(outer) or ADDRESS.search(outer):
            continue
        for m in KEY.finditer(outer):
            run = m.group().strip("=-_/+")
            if len(run) < SHORTEST or not DIGITS.search(run) or not LETTERS.search(run) or known(run) or known(outer):
                continue
            if len(run) <= most * n_tokens(encoding, run):
                start = whole.start() + m.start() + m.group().index(run)
                yield start, start + len(run), 3


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def scan(
    docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "secrets", most: float = MOST_RATIO, keep: list[str] | None = None
) -> DataFrame:
    """Add an array of (kind, start, stop) to every row, in order of start, then kind. A column called ``out`` is replaced."""
    open_vocabulary = shared_vocabulary(docs.sparkSession, path, pattern)

    def open_batch():
        encoding = open_vocabulary()

        def work(texts: list[bytes]) -> list[list]:
            found = []
            for raw in texts:
                t = raw.decode()
                spans = sorted([*base_spans(t), *random_spans(t, encoding, most)], key=lambda s: (s[0], s[2], s[1]))
                found.append([{"kind": KINDS[k], "start": a, "stop": b} for a, b, k in spans])
            return [found]

        return work

    return append(docs, text, f"`{out}` array<struct<kind:string,start:int,stop:int>>", open_batch, keep)


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def shared_vocabulary(spark: SparkSession, path: str, pattern: str) -> Callable[[], tiktoken.Encoding]:
    """A function that gives the vocabulary on any executor, built once per worker process. The driver reads the file."""
    with open(path, "rb") as file:
        lines = file.read()
    shared = spark.sparkContext.broadcast(lines)  # as large as the vocabulary file
    name = hashlib.md5(lines + pattern.encode()).hexdigest()

    def get() -> tiktoken.Encoding:
        if name not in _ENCODINGS:
            _ENCODINGS[name] = vocabulary(shared.value, pattern)
        return _ENCODINGS[name]

    return get


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts and digests of the spans of every row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = scan(rows, path, pattern, keep=["doc_id"])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
    )
