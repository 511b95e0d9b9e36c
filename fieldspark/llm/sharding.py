"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` from a hash of the key and the child's name, and the smallest
draw wins, so a child receives its share of the weights and a changed weight
moves keys between that child and its siblings only.

A shard that joins a built tree brings weight to its rack and region. Left to
the plain descent, keys won by the heavier region could land on its old shards.
So a later shard draws at the root on its own behalf: a key that it wins goes
straight down to it, every other key descends as before, and rows move into the
new shard alone.

Null keys share one shard; equal keys always meet. Everything is column
expressions: no shuffle to place rows, two narrow ones to number them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a hash that a double holds exactly.
DRAW_BITS = 52
# Hash buckets in which the rows of one shard are numbered; a shard's rows divide into so many tasks.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0
    joined: bool = False  # after the tree was built


def even_tree(shards: int, per_rack: int = 5, racks: int = 2) -> list[Shard]:
    """Equal shards, ``per_rack`` to a rack and ``racks`` to a region."""
    return [Shard(i, f"region{i // (per_rack * racks)}", f"rack{i // per_rack}") for i in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard in the last rack."""
    last = tree[-1]
    return [*tree, Shard(max(s.shard for s in tree) + 1, last.region, last.rack, weight, joined=True)]


def _names(children: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in children.items()])


def _winner(key: Column, children: Column) -> Column:
    def draw(child: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 64 - DRAW_BITS) + 1) / F.lit(float(2**DRAW_BITS + 1))
        return F.struct((-F.log(unit) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def place(df: DataFrame, key: str, tree: list[Shard], out: str = "shard") -> DataFrame:
    """Add the shard of every row. Weights must be positive; at least one shard belongs to the built tree."""
    built = [s for s in tree if not s.joined]
    if not built or any(s.weight <= 0 for s in tree):
        raise ValueError("the tree needs built shards and positive weights")
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for s in built:
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        inside = racks.setdefault(s.region, {})
        inside[s.rack] = inside.get(s.rack, 0.0) + s.weight
        shards.setdefault(f"{s.region}/{s.rack}", {})[str(s.shard)] = s.weight
    late = {f"+{s.shard}": s.weight for s in tree if s.joined}
    by_region = F.create_map(*[x for r, c in racks.items() for x in (F.lit(r), _names(c))])
    by_rack = F.create_map(*[x for r, c in shards.items() for x in (F.lit(r), _names(c))])

    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00null"))
    steps = (
        df.withColumn("__root", _winner(text, _names(regions | late)))
        .withColumn("__rack", _winner(F.concat(text, F.lit("/"), "__root"), F.element_at(by_region, F.col("__root"))))
        .withColumn("__path", F.concat_ws("/", "__root", "__rack"))
        .withColumn("__leaf", _winner(F.concat(text, F.lit("//"), "__path"), F.element_at(by_rack, F.col("__path"))))
    )
    won = F.when(F.col("__root").startswith("+"), F.substring("__root", 2, 20)).otherwise(F.col("__leaf"))
    return steps.withColumn(out, won.cast("int")).drop("__root", "__rack", "__path", "__leaf")


def number(rows: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    A shard's rows are split into hash buckets; each bucket starts where the
    earlier ones end. Equal rows are counted before the shuffle and unfolded
    after it, so many copies of a row do not meet in a task. The order is fixed
    by the row values alone, so a lost task numbers its rows alike again.
    """
    columns = rows.columns
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.lit(SLOT_BUCKETS)))
    here = Window.partitionBy(shard, "__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = bucketed.groupBy("__bucket", *columns).agg(F.count("*").alias("__copies"))
    starts = (
        bucketed.groupBy(shard, "__bucket")
        .agg(F.count("*").alias("__rows"))
        .select(shard, "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    )
    placed = groups.withColumn("__offset", F.coalesce(F.sum("__copies").over(here), F.lit(0))).join(starts, [shard, "__bucket"])
    first = F.col("__start") + F.col("__offset")
    unfolded = F.explode(F.sequence(first, first + F.col("__copies") - 1))
    return placed.select(*columns, unfolded.alias(out))


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """The shard and slot of every document under the law ``key``, and its shard in the grown tree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = place(place(rows, "doc_id", tree), "doc_id", grown, "grown_shard")
    return number(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
