"""N-gram Jaccard join by parity sketches.

The shingles of a document (five words; the whole text if it has fewer) are
hashed to 64 bits. A parity sketch folds them by exclusive or, so equal tokens
cancel and each token of the symmetric difference changes one place at most:
the Hamming distance of two sketches never exceeds that difference. Documents of
``a`` and ``b`` shingles that share three quarters of their union differ in
``(a + b) / 7`` shingles or fewer.

*Pigeonhole.* In a size band the hash range is cut into parts; the exclusive or
of a part's hashes is its word in the sketch. Every part that is not empty is a
join key. If a document has more such parts than the pair may differ in
shingles, one part agrees and the pair meets. Bands are powers of two, and a
band astride each border takes the pairs that it separates. The few documents
with too few parts (mostly tiny ones) also emit single shingles in hash order,
as many as a prefix filter needs, so pairs of two such documents meet as well.

*Keys* travel packed: a task gathers them, cuts them by bucket and writes one
binary row per bucket. A bucket is as large as some 16 MB of text at any scale.

*Verification.* Equal shingle sets are one node from the start. Documents that
meet in a part first pair with the smallest node there only. Pairs are sifted by
size and by the Hamming distance of dense bit sketches, then the sets themselves
are compared. Linked nodes become components; only where a part still holds
several components are further pairs taken: of those that pass the sift first as
many, nearest first, as would join these components, then all that remain. A part
with very many nodes is compared in blocks of bounded size. So a group of n copies costs about n comparisons, and
no link between different texts is lost.

Null, empty and wordless texts have no shingles and no links. A null doc_id
never names a component unless all its members have none; rows with equal
doc_id are separate documents of that number. Equality of shingles is equality
of their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialise
from .common import CASE, bounded_batches, release, utf8

SHINGLE = 5
# Two sets link if 100 * shared >= LINK * union. The bounds below (7, 3/4) follow from it.
LINK = 75
BUCKET_BYTES = 16 << 20
# Packed keys that a task holds before it writes them out.
HELD_KEYS = 2_000_000
HELD_DOCS = 60_000
# Nodes of a part that are compared with each other in one task.
BLOCK_NODES = 2048
# Documents to verify up to this many are picked out by a broadcast list of their numbers (8 bytes each).
SENT_IDS = 1_000_000
TEXT_BLOCK = 4 << 20

U = np.uint64
SPACE = CASE.translate(bytes(32 if 9 <= b <= 13 else b for b in range(256)))
ODD = [U(int.from_bytes(xxhash.xxh3_64_digest(b"place %d" % i)) | 1) for i in range(SHINGLE)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words, read in blocks cut at spaces."""
    plain, parts, at = text.translate(SPACE), [], 0
    while at < len(plain):
        end = plain.find(b" ", at + TEXT_BLOCK) if len(plain) - at > TEXT_BLOCK else -1
        words = plain[at : end if end >= 0 else len(plain)].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words)))
        at = end if end >= 0 else len(plain)
    return np.concatenate(parts) if parts else np.empty(0, U)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = word_hashes(text)
    n = min(SHINGLE, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, U(n))
    for i in range(n):
        total += mix(words[i : len(words) - n + 1 + i]) * ODD[i]
    return np.unique(mix(total))


def node_of(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return int(np.int64(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), U).view(np.int64)))


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits, a power of two of at least 64 and four times as many as there are hashes."""
    bits = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold_to(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, halved by exclusive or to ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), U)
    for i, s in enumerate(sketches):
        row = np.frombuffer(s, U)
        while len(row) * 8 > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def schemes(n: int) -> list[tuple[int, int, int]]:
    """(tag, parts, shingles by which a pair with this document may differ) of every band that a set of ``n`` belongs to."""
    partner = 4 * n // 3
    low = 1 << (n.bit_length() - 1)
    high = 2 * low
    out = [(2 * high, int(0.32 * high) + 2, (n + min(partner, high - 1)) // 7)]
    if partner >= high:  # pairs with larger sets across the upper border
        out.append((2 * high + 1, int(0.38 * high) + 2, (n + partner) // 7))
    if 3 * n <= 4 * (low - 1):  # with smaller ones across the lower border
        out.append((2 * low + 1, int(0.38 * low) + 2, (n + low - 1) // 7))
    return out


def _tagged(tag: int, place: int) -> np.uint64:
    return U(tag * int(ODD[place]) % 2**64)


def join_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys under which a set meets every set that may link with it."""
    out, n = [], len(hashes)
    for tag, parts, differ in schemes(n):
        part = ((hashes >> U(32)) * U(parts)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        words = np.bitwise_xor.reduceat(hashes, starts)
        out.append(mix(words + mix(part[starts] + _tagged(tag, 0))))
        if len(starts) <= differ:
            out.append(mix(hashes[: n - (3 * n + 3) // 4 + 1] + _tagged(tag, 1)))
    return np.concatenate(out)


# --- first pass: documents to packed keys ------------------------------------

DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
MET = pa.schema([("kind", pa.int32()), *DOC, ("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary())])
MET_FIELDS = "kind int, doc_id bigint, n bigint, node bigint, sketch binary, a bigint, b bigint, members binary"
KEY = np.dtype([("low", "<u4"), ("high", "u1"), ("at", "<u2")])


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class _Packer:
    """Gathers the keys of distinct nodes and the rows of documents."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.nodes: list[int] = []
        self.seen: set[int] = set()
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        hashes = shingles(text)
        if not len(hashes):
            self.docs.append((doc_id, 0, None, None))
            return
        node = node_of(hashes)
        self.docs.append((doc_id, len(hashes), node, bit_sketch(hashes)))
        if node not in self.seen:
            self.seen.add(node)
            self.nodes.append(node)
            self.keys.append(join_keys(hashes))
            self.held += len(self.keys[-1])

    def full(self) -> bool:
        return self.held >= HELD_KEYS or len(self.docs) >= HELD_DOCS

    def rows(self) -> Iterator[pa.RecordBatch]:
        docs = _ipc(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.docs, strict=True), DOC, strict=True)], schema=DOC))
        yield _one((xxhash.xxh3_64_intdigest(docs[:4096]) % self.buckets, None, docs), PACKED)
        if not self.keys:
            return
        keys = np.concatenate(self.keys)
        at = np.repeat(np.arange(len(self.nodes), dtype=np.uint16), [len(k) for k in self.keys])
        bucket = ((keys >> U(40)) % U(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        names = np.array(self.nodes, np.int64)
        for part in np.split(order, cuts):
            used, local = np.unique(at[part], return_inverse=True)
            packed = np.empty(len(part), KEY)
            packed["low"], packed["high"], packed["at"] = keys[part], (keys[part] >> U(32)) & U(255), local
            blob = len(used).to_bytes(4, "little") + names[used].tobytes() + packed.tobytes()
            yield _one((int(bucket[part[0]]), blob, None), PACKED)


def _one(row: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    names = np.frombuffer(blob, np.int64, n, 4)
    packed = np.frombuffer(blob, KEY, offset=4 + 8 * n)
    return (packed["high"].astype(U) << U(32)) | packed["low"], names[packed["at"]]


def meetings(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct pairs (smallest node of a part, other node), and the distinct node lists of parts with three nodes or more."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
    keys, nodes = keys[fresh], nodes[fresh]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.repeat(nodes[starts], sizes)
    others = np.ones(len(keys), bool)
    others[starts] = False
    pairs = np.unique(np.stack([first[others], nodes[others]], 1), axis=0)
    lists = {}
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        members = nodes[s : s + n]
        lists.setdefault(xxhash.xxh3_64_intdigest(members.tobytes()), members)
    return pairs, list(lists.values())


def _meet(table: pa.Table) -> pa.Table:
    release()  # what the bucket before left
    made = []
    for blob in table["docs"].to_pylist():
        if blob is not None:
            docs = pa.ipc.open_stream(blob).read_all().combine_chunks()
            n = docs.num_rows
            columns = [pa.array(np.zeros(n, np.int32)), *docs.columns, *[pa.nulls(n, f.type) for f in list(MET)[5:]]]
            made.append(pa.Table.from_arrays(columns, schema=MET))
    blobs = [_unpack(b) for b in table["keys"].to_pylist() if b is not None]
    if blobs:
        pairs, lists = meetings(np.concatenate([k for k, _ in blobs]), np.concatenate([n for _, n in blobs]))
        n = len(pairs)
        columns = [pa.array(np.ones(n, np.int32)), *[pa.nulls(n, f.type) for f in DOC], pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.binary())]
        made.append(pa.Table.from_arrays(columns, schema=MET))
        n = len(lists)
        columns = [pa.array(np.full(n, 2, np.int32)), *[pa.nulls(n, f.type) for f in list(MET)[1:-1]], pa.array([m.tobytes() for m in lists], pa.binary())]
        made.append(pa.Table.from_arrays(columns, schema=MET))
    return pa.concat_tables(made) if made else MET.empty_table()


def meet(docs: DataFrame) -> DataFrame:
    """Stored rows of three kinds: 0 documents, 1 pairs of nodes, 2 node lists of parts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("words"))
    size = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    buckets = size // BUCKET_BYTES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, text.as_py())
                if packer.full():
                    yield from packer.rows()
                    packer.clear()
        if packer.docs:
            yield from packer.rows()
        del packer
        release()

    packed = rows.mapInArrow(run, "bucket int, keys binary, docs binary")
    return materialise(packed.groupBy("bucket").applyInArrow(_meet, MET_FIELDS))


# --- verification ------------------------------------------------------------


def near_enough(n_a: int, n_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    """Neither sizes nor sketches rule the pair out."""
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    rows = fold_to([sketch_a, sketch_b], min(len(sketch_a), len(sketch_b)))
    return 7 * int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= n_a + n_b


def linked(a: bytes, b: bytes) -> bool:
    """Whether two sets of sorted hashes link."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= LINK * (len(x) + len(y) - shared)


def _filtered(df: DataFrame, test, n_tested: int) -> DataFrame:
    """Rows (a, b) whose remaining columns pass a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(2, 2 + n_tested)]
            mask = pa.array([test(*[v.as_py() for v in row]) for row in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return df.mapInArrow(run, "a bigint, b bigint")


def sets_of(docs: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingle sets of some nodes, made anew from the texts of documents that have them."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    wanted = ids.select(key.alias("__id")).distinct()
    few = wanted.limit(SENT_IDS + 1).count() <= SENT_IDS
    rows = docs.select(key.alias("__id"), utf8("text").alias("words")).join(F.broadcast(wanted) if few else wanted, "__id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py()) for t in batch.column(0)]
            made = [h for h in made if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in made], pa.int64()), pa.array([h.tobytes() for h in made], pa.binary())], names=["node", "set"])
        release()

    found = rows.select("words").mapInArrow(run, "node bigint, set binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, for every node with an edge. Alternating large and small stars until nothing moves."""
    now = materialise(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    while True:
        stars = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if stars == mark or not stars.n:
            return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp")).union(
                now.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("comp")).distinct()
            )
        mark = stars
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(moved.union(least.select("a", F.col("m").alias("b"))).distinct())


def _spanning(node_a: np.ndarray, node_b: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Places of the pairs, nearest first, that would join components not yet joined by nearer ones."""
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while c in root:
            if root[c] in root:
                root[c] = root[root[c]]
            c = root[c]
        return c

    left = len(np.unique(np.concatenate([comp_a, comp_b]))) - 1
    chosen = []
    for at in np.lexsort((node_b, node_a, near)).tolist():
        x, y = top(int(comp_a[at])), top(int(comp_b[at]))
        if x != y:
            root[x] = y
            chosen.append(at)
            left -= 1
            if not left:
                break
    return np.array(chosen, np.int64)


def _cross_pairs(spanning: bool):
    """For the nodes of a block of a part: pairs of different components that pass the sift, or only those that would join all of them."""

    def run(table: pa.Table) -> pa.Table:
        node, n, comp, side = [table[c].to_numpy() for c in ("node", "n", "comp", "side")]
        sketches = table["sketch"].to_pylist()
        rows = None
        pairs, distances = [], []
        one_block = table["i"][0].as_py() == table["j"][0].as_py()
        for x in range(len(node)):
            if not one_block and side[x]:
                continue
            may = (comp != comp[x]) & (4 * np.minimum(n, n[x]) >= 3 * np.maximum(n, n[x]))
            may &= node > node[x] if one_block else side == 1
            if not may.any():
                continue
            if rows is None:  # many blocks have no pair to compare
                rows = fold_to(sketches, min(map(len, sketches)))
            near = np.bitwise_count(rows[may] ^ rows[x]).sum(1).astype(np.int64)
            fits = 7 * near <= n[may] + n[x]
            found = np.flatnonzero(may)[fits]
            pairs.append(np.stack([np.full(len(found), x), found], 1))
            distances.append(near[fits])
        pair = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        cut = False
        if spanning and len(pair):
            chosen = _spanning(node[pair[:, 0]], node[pair[:, 1]], comp[pair[:, 0]], comp[pair[:, 1]], np.concatenate(distances))
            cut = len(chosen) < len(pair)
            pair = pair[chosen]
        ends = np.sort(node[pair], axis=1)
        part = pa.array(np.full(len(pair), table["run"][0].as_py(), np.int64))
        return pa.Table.from_arrays([part, pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64()), pa.array(np.full(len(pair), cut))], names=["run", "a", "b", "cut"])

    return run


class Join:
    """The state of one join: documents, nodes, pairs already tested and links found."""

    def __init__(self, docs: DataFrame):
        bounded_batches(docs.sparkSession)
        self.docs, self.met = docs, meet(docs)
        self.rows = self.met.where("kind = 0").select("doc_id", "n", "node", "sketch")
        self.nodes = materialise(
            self.rows.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
        )
        self.tested = self.links = None

    def labelled(self) -> DataFrame:
        """Nodes with the component known so far."""
        if self.links is None:
            return self.nodes.withColumn("comp", F.col("node"))
        return self.nodes.join(self.parts, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def test(self, pairs: DataFrame) -> None:
        """Verify pairs and bring the components up to date."""
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
        sifted = materialise(_filtered(sized.select("a", "b", "n_a", "n_b", "s_a", "s_b"), near_enough, 4))
        wanted = sifted.select(F.col("a").alias("node")).union(sifted.select(F.col("b").alias("node"))).distinct()
        ids = self.nodes.join(wanted, "node", "left_semi").select("doc_id")
        sets = materialise(sets_of(self.docs, ids, wanted))
        both = sifted.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        found = materialise(_filtered(both.select("a", "b", "x", "y"), linked, 2))
        self.tested = sifted if self.tested is None else self.tested.union(sifted)
        self.links = found if self.links is None else self.links.union(found)
        self.parts = materialise(components(self.links))

    def left_over(self, spanning: bool, parts: DataFrame | None = None) -> DataFrame:
        """Pairs of different components that share a part and pass the sift, with their part (``run``), stored.

        ``cut`` tells that a block has more of them. ``parts`` names the parts to look at, all if absent.
        """
        lists = self.met.where("kind = 2").select("members").distinct()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for members in batch.column(0).to_pylist():
                    nodes = np.frombuffer(members, np.int64)
                    run_id = np.array(xxhash.xxh3_64_intdigest(members), U).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), run_id)), pa.array(nodes), pa.array(np.full(len(nodes), len(nodes)))], names=["run", "node", "size"])

        in_parts = lists.mapInArrow(run, "run bigint, node bigint, size bigint")
        if parts is not None:
            in_parts = in_parts.join(parts, "run", "left_semi")
        in_parts = in_parts.join(self.labelled(), "node")
        mixed = in_parts.groupBy("run").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("run")
        blocks = F.ceil(F.col("size") / BLOCK_NODES)
        here = F.pmod(F.xxhash64("node"), blocks)
        spread = in_parts.join(mixed, "run", "left_semi").withColumn("k", here).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = spread.select("run", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).cast("int").alias("side"), "node", "n", "sketch", "comp")
        return materialise(placed.groupBy("run", "i", "j").applyInArrow(_cross_pairs(spanning), "run bigint, a bigint, b bigint, cut boolean"))

    def untested(self, found: DataFrame) -> DataFrame:
        return found.select("a", "b").distinct().join(self.tested, ["a", "b"], "left_anti")


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    state = Join(docs)
    state.test(state.met.where("kind = 1").select("a", "b").distinct())
    # A block that is not cut hands over all its pairs, so only parts with a cut block are looked at again.
    parts = None
    for spanning in (True, False):
        found = state.left_over(spanning, parts)
        rest = materialise(state.untested(found))
        if not rest.isEmpty():
            state.test(rest)
        parts = found.where("cut").select("run").distinct()
        if parts.isEmpty():
            break
    labels = state.labelled().select("node", "comp", "doc_id")
    smallest = labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = labels.select("node", "comp").join(smallest, "comp").select("node", "component_id")
    return state.rows.join(classes, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those that a document with a smaller doc_id stands for.

    Rows with one doc_id and different texts are documents of their own, in an
    order fixed by their texts. Of rows equal in doc_id and text one stays; rows
    without doc_id stay and stand for none with one.
    """
    found = materialise(join_documents(docs))
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _keep_one_of_repeated(docs)
    removed = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = removed.limit(SENT_IDS + 1).count() <= SENT_IDS
    return docs.join(F.broadcast(removed) if few else removed, "doc_id", "left_anti").select(*docs.columns)


def _keep_one_of_repeated(docs: DataFrame) -> DataFrame:
    """As ``keep_one``, for numbers that occur more than once: rows are first numbered by doc_id (null last) and text."""
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("old"), "text", digest.alias("digest"))
    order = [F.col("old").asc_nulls_last(), F.col("digest")]
    kinds = rows.select("old", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = materialise(kinds.withColumn("doc_id", F.monotonically_increasing_id()))
    numbered = rows.join(kinds.withColumnsRenamed({"old": "old_", "digest": "digest_"}), F.expr("old <=> old_ AND digest = digest_")).drop("old_", "digest_")
    numbered = materialise(numbered)
    removed = join_documents(numbered.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    named = numbered.where("old IS NOT NULL").join(removed, "doc_id", "left_anti").groupBy("doc_id").agg(F.any_value("row").alias("row"))
    return named.select("row.*").union(numbered.where("old IS NULL").select("row.*"))
