"""Prefix trie of conversations.

A turn becomes an id of 16 bytes (MD5 of role and text), so that only ids, word
counts and conversation numbers are shuffled, never texts. Conversations, as
arrays of ids, are sorted over the cluster into ranges ("shards") by array and
number; equal sequences may be split between shards.

Within a shard the ids form matrices of ``BLOCK`` columns, padded with zeros
where a conversation is over. They are sorted with ``numpy.lexsort``; a mask of
the columns that differ from the row before, OR-accumulated from left to right,
has a one wherever a row starts a node; ``reduceat`` over these starts sums up
every depth. Conversations longer than a block go on in the next one under the
number of the node they reached, so the padding stays small.

A node that the last row of one shard shares with the first row of the next is
open: the shards give their parts of it, which are added up by the hash of its
prefix. All other nodes are final where they are. The member list of an open
node is hashed as a stream, shard by shard.

Turns are taken in order of their number, null first, then by id. Null roles and
texts are empty; rows without conversation number belong to none and are left
out. Repeated rows are turns of their own. An empty table has no nodes. One
conversation is one array: its length is bounded by the size of a row, its
neighbours' is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialise

BLOCK = 32
# Turns in a shard, about.
SHARD_TURNS = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): for every conversation the ids and word counts of its turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn"),
            F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
            F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"),
        ).alias("turn"),
    )
    listed = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the head of its group."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def rebuilt(listed: DataFrame, group: int = 20) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the conversation whose number is the next lower multiple of ``group``."""
    heads = listed.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, 3).alias("first"))
    h = borrowed(F.col("conv_id"))
    joined = listed.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left")
    empty = F.slice("turns", 1, 0)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("first", empty), F.lit(1), h), own).alias("turns"))


@dataclass
class Level:
    """Nodes of one depth: places in the sorted rows, number of the parent in the level above, and sums over members."""

    depth: int
    parent: np.ndarray
    least: np.ndarray
    members: np.ndarray
    ends: list[bytes]
    words: np.ndarray
    ids: list[bytes]


def levels_of(convs: np.ndarray, ids: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> Iterator[Level]:
    """The levels of a shard's trie, from the root on. ``ids``: n x 2 big-endian halves of all turn ids end to end."""
    starts = np.cumsum(lengths) - lengths

    def level(depth: int, rows: np.ndarray, first: np.ndarray, parent: np.ndarray) -> Level:
        """``rows`` in order of node and number; ``first``: places where nodes start."""
        at = rows[first]
        over = lengths[rows] == depth
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        ends = [b""] * len(first)
        done, last = node[over], convs[rows[over]]
        cuts = np.flatnonzero(np.diff(done, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(done)], strict=False):
            ends[done[a]] = ",".join(map(str, np.sort(last[a:b]).tolist())).encode()
        turn = starts[at] + depth - 1
        return Level(
            depth,
            parent,
            np.minimum.reduceat(convs[rows], first),
            np.diff(np.append(first, len(rows))),
            ends,
            words[turn] if depth else np.zeros(1, np.int64),
            [ids[t].tobytes() for t in turn] if depth else [b""],
        )

    rows = np.arange(len(convs))
    yield level(0, rows, np.zeros(1, np.int64), np.full(1, -1))
    base, label = 0, np.zeros(len(convs), np.int64)
    while len(rows := rows[lengths[rows] > base]):
        label = label[rows]
        wide = np.minimum(lengths[rows] - base, BLOCK)
        width = int(wide.max())
        place = np.arange(width)
        there = place < wide[:, None]
        turn = np.where(there, starts[rows][:, None] + base + place, 0)
        matrix = np.where(there[..., None], ids[turn], 0).astype(np.uint64)
        keys = [convs[rows]]
        for j in range(width - 1, -1, -1):
            keys += [matrix[:, j, 1], matrix[:, j, 0], there[:, j]]
        order = np.lexsort([*keys, label])
        rows, label, matrix, there = rows[order], label[order], matrix[order], there[order]
        change = np.ones((len(rows), width), bool)
        change[1:] = (matrix[1:] != matrix[:-1]).any(2) | (there[1:] != there[:-1])
        change[1:, 0] |= label[1:] != label[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        above = label
        for j in range(width):
            inside = np.flatnonzero(there[:, j])
            starting = change[inside, j]
            first = np.flatnonzero(starting)
            yield level(base + j + 1, rows[inside], first, above[inside][first])
            here = np.full(len(rows), -1)
            here[inside] = np.cumsum(starting) - 1
            above = here
        full = np.zeros(len(convs), np.int64)
        full[rows] = above
        label, base = full, base + width


def shard_rows(turns: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (n x 2), word counts, and lengths of a column of turn lists."""
    column = turns.combine_chunks()
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = column.flatten()
    raw = b"".join(flat.field("id").to_pylist())
    return np.frombuffer(raw, ">u8").reshape(-1, 2), np.asarray(flat.field("words")).astype(np.int64), lengths


def _shard(table: pa.Table) -> pa.Table:
    """Nodes of a shard; open ones carry key, path and the part of the member list, children of open ones the parent's key."""
    shard = table.column("shard")[0].as_py()
    before, after = table.column("before")[0].as_py(), table.column("after")[0].as_py()
    convs = table.column("conv_id").to_numpy().astype(np.int64)
    ids, words, lengths = shard_rows(table.column("turns"))
    levels = list(levels_of(convs, ids, words, lengths))
    # Nodes of each level are numbered in sorted order, so the first and last row's paths go by first and last children.
    children = [np.zeros(len(v.least), np.int64) for v in levels]
    for v, up in zip(levels[1:], children, strict=False):
        np.add.at(up, v.parent, 1)
    left = _path(levels, before, first=True)
    right = _path(levels, after, first=False)
    opened = [np.zeros(len(v.least), bool) for v in levels]
    for path in (left, right):
        for d, node in enumerate(path):
            opened[d][node] = True
    leaves = [(c == 0).astype(np.int64) for c in children]
    saved = [(v.members - 1) * v.words for v in levels]
    for d, mark in enumerate(opened):  # their own share is known once the parts are added up
        leaves[d][mark], saved[d][mark] = 0, 0
    for d in range(len(levels) - 1, 0, -1):
        closed = ~opened[d]
        np.add.at(leaves[d - 1], levels[d].parent[closed], leaves[d][closed])
        np.add.at(saved[d - 1], levels[d].parent[closed], saved[d][closed])
    keys: dict[tuple[int, int], list[bytes]] = {}
    for path in (left, right):
        chain = [b"root"]
        for d, node in enumerate(path):
            if d:
                chain = [*chain, hashlib.md5(chain[-1] + levels[d].ids[node]).digest()]
            keys[d, node] = chain
    out: dict[str, list] = {name: [] for name in SHARD.names}
    for d, v in enumerate(levels):
        closed_children = np.zeros(len(v.least), np.int64)
        if d + 1 < len(levels):
            np.add.at(closed_children, levels[d + 1].parent[~opened[d + 1]], 1)
        parents = v.parent.tolist()
        least_above = levels[d - 1].least if d else None
        open_above = opened[d - 1] if d else None
        for node, (conv, n, is_open) in enumerate(zip(v.least.tolist(), v.members.tolist(), opened[d].tolist(), strict=True)):
            p = parents[node]
            under_open = bool(d and open_above[p])
            out["shard"].append(shard)
            out["open"].append(is_open)
            out["conv_id"].append(conv)
            out["depth"].append(d)
            out["parent_conv_id"].append(int(least_above[p]) if d and not under_open else None)
            out["parent_key"].append(keys[d - 1, p][-1] if under_open else None)
            out["path"].append(keys[d, node] if is_open else None)
            out["words"].append(int(v.words[node]))
            out["n_convs"].append(n)
            out["n_children"].append(int((closed_children if is_open else children[d])[node]))
            out["n_leaves"].append(int(leaves[d][node]))
            out["saved_tokens"].append(int(saved[d][node]))
            out["ends"].append(v.ends[node] if is_open else None)
            out["ends_sha256"].append(None if is_open else hashlib.sha256(v.ends[node]).hexdigest())
    return pa.table({name: pa.array(out[name], SHARD.field(name).type) for name in SHARD.names}, schema=SHARD)


SHARD = pa.schema(
    [
        ("shard", pa.int64()), ("open", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
        ("parent_key", pa.binary()), ("path", pa.list_(pa.binary())), ("words", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.binary()), ("ends_sha256", pa.string()),
    ]
)
SHARD_SQL = (
    "shard bigint, open boolean, conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, path array<binary>, words bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary, ends_sha256 string"
)


def _path(levels: list[Level], depth: int, first: bool) -> list[int]:
    """Node numbers along the path of the shard's first or last row down to a depth; none below depth 0."""
    if depth < 0:
        return []
    path = [0]
    for v in levels[1 : depth + 1]:
        below = np.flatnonzero(v.parent == path[-1])
        path.append(int(below[0 if first else -1]))
    return path


def shared_depth(a: str, b: str) -> Column:
    """Number of leading turns that two lists have in common."""
    pairs = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    n = F.least(F.size(a), F.size(b))
    differing = F.filter(F.slice(F.transform(pairs, lambda p, i: F.struct((i + 1).alias("i"), (p["a"] != p["b"]).alias("x"))), F.lit(1), n), lambda s: s["x"])
    return F.when(F.size(differing) > 0, differing[0]["i"] - 1).otherwise(n)


def sharded(rows: DataFrame, turns_each: int) -> DataFrame:
    """Rows with their shard and the depths it shares with the shards before and after (-1 without such a shard)."""
    stored = materialise(rows.withColumn("ids", F.transform("turns", lambda t: t["id"])))
    size = stored.agg(F.sum(F.size("ids") + 1).alias("n")).first().n or 0
    parts = max(1, -(-size // turns_each))
    ranged = stored.repartitionByRange(parts, "ids", "conv_id").withColumn("shard", F.spark_partition_id().cast("bigint"))
    ranged = materialise(ranged)
    ends = ranged.groupBy("shard").agg(F.min(F.struct("ids", "conv_id"))["ids"].alias("low"), F.max(F.struct("ids", "conv_id"))["ids"].alias("high"))
    ends = materialise(ends)
    # One number per shard: the only thing that meets in a task.
    nexts = ends.select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("next")).where("next IS NOT NULL")
    borders = nexts.join(ends.select("shard", "high"), "shard").join(ends.select(F.col("shard").alias("next"), "low"), "next")
    borders = materialise(borders.select("shard", "next", shared_depth("high", "low").alias("depth")))
    known = (
        ends.select("shard")
        .join(borders.select("shard", F.col("depth").alias("after")), "shard", "left")
        .join(borders.select(F.col("next").alias("shard"), F.col("depth").alias("before")), "shard", "left")
        .select("shard", F.coalesce("before", F.lit(-1)).cast("int").alias("before"), F.coalesce("after", F.lit(-1)).cast("int").alias("after"))
    )
    return ranged.drop("ids").join(known, "shard")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of each key, given in order."""
    key, digest, any_ = None, None, False
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, any_ = k, hashlib.sha256(), False
            digest.update(b"," + part if any_ else part)
            any_ = True
    if digest is not None:
        done.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])


def trie(rows: DataFrame, turns_each: int = SHARD_TURNS) -> DataFrame:
    """One row per node, as ``NODE``, of the trie of (conv_id, turns: array<struct<id: binary, words: bigint>>)."""
    found = materialise(sharded(rows, turns_each).groupBy("shard").applyInArrow(_shard, SHARD_SQL))
    key = F.element_at("path", -1)
    parts = found.where("open").withColumn("key", key)
    added = materialise(
        parts.groupBy("key").agg(
            F.first("path").alias("path"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
    )
    above = F.try_element_at("path", F.lit(-2))
    branches = added.where("depth > 0").groupBy(above.alias("key")).agg(F.count(F.lit(1)).alias("open_children"))
    whole = added.join(branches, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    whole = whole.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    shares = whole.select(F.explode("path").alias("key"), (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"))
    shares = shares.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    lists = parts.where(F.length("ends") > 0).select("key", "ends", "shard").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    digests = lists.mapInArrow(_streamed, "key binary, ends_sha256 string")
    parents = added.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    opened = (
        whole.drop("n_leaves", "saved_tokens")
        .join(shares, "key")
        .join(digests, "key", "left")
        .withColumn("parent_key", above)
        .join(parents, "parent_key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    )
    names = [f.split()[0] for f in NODE.split(", ")]
    closed = found.where("NOT open")
    # Children of an open node find its smallest member by shard, so that no node is a hot key.
    local = parts.select("shard", "key").join(added.select("key", "conv_id"), "key").select("shard", F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    under = closed.where("parent_key IS NOT NULL").join(local, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    return closed.where("parent_key IS NULL").select(names).union(under.select(names)).union(opened.select(names))


def conversation_trie(turns: DataFrame, turns_each: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); see ``rebuilt``."""
    return trie(rebuilt(materialise(sequences(turns))), turns_each)
