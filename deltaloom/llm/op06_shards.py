"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends from the root; at each level the child with the largest draw wins.  A shard draws ln(u) / weight, with
the uniform number u from a hash of (key, the shard's own name).  A rack's draw is the largest of its shards', a
region's the largest of its racks': the largest of such draws is distributed like one draw with the summed weight, so
each child of a node wins in proportion to the weight below it.  A draw depends on nothing outside its subtree, so a
changed weight, or a shard more or less, moves rows only into or out of the subtree whose weight changed, and in it only
into or out of the shards that changed, however shards are grouped.  Law: `key`; a row's shard depends on its key and
the number of shards, and one shard more takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import drop, indexed, stage


@dataclass(frozen=True)
class Node:
    """A subtree; leaves have a shard number and a weight."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    leaf_weight: float = 1.0


def tree(shards: int, per_rack: int = 2, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards 0, 1, ... in racks of per_rack and regions of `racks` racks, filled in order; weights: 1 unless given."""
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        rack = s // per_rack
        regions.setdefault(rack // racks, {}).setdefault(rack, []).append(Node(f"s{s}", shard=s, leaf_weight=(weights or {}).get(s, 1.0)))
    return Node("", tuple(
        Node(f"g{g}", tuple(Node(f"g{g}/k{k}", tuple(leaves)) for k, leaves in held.items())) for g, held in regions.items()))


def _draw(key: Column, node: Node) -> Column:
    """ln(u) / weight with u from 53 bits of a hash, never 0; the hash is bare xxhash64 of (key, name)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return F.log((bits + 1.0) / float(1 << 53)) / node.leaf_weight


def descend(key: Column, node: Node, path: tuple[str, ...] = ()) -> Column:
    """struct<draw, shard, region, rack> of the shard that a key reaches below node.  A null key hashes like the name
    alone, so it has a shard too.  Equal draws go to the larger shard number."""
    if not node.children:
        region, rack = (*path, None, None)[:2]
        return F.struct(
            _draw(key, node).alias("draw"), F.lit(node.shard).alias("shard"), F.lit(region).cast("string").alias("region"), F.lit(rack).cast("string").alias("rack"))
    found = [descend(key, c, path if not c.children else (*path, c.name)) for c in node.children]
    return found[0] if len(found) == 1 else F.greatest(*found)


def assign(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, region, rack for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1.  slot: place in the shard in the order of the key, from
    an exchange by (shard, key) ranges; ties and repeated rows have slots of their own.  Null keys sort first.
    grown_shard: the shard with one shard more.  An empty relation gives an empty one; columns other than key and text
    are not looked at, whatever their names.
    """
    k = F.col(key)
    narrow = docs.select(
        k.alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(k, tree(shards)).alias("_own"),
        descend(k, tree(shards + 1))["shard"].cast("int").alias("grown_shard"),
    )
    rows = stage(narrow.select(
        key, "size", "text_crc32", "law", F.col("_own.shard").cast("int").alias("shard"), "grown_shard", "_own.region", "_own.rack"), "op6-rows")
    placed = indexed(rows, ["shard", key], "op6-order", "_at")
    drop(rows)
    starts = placed.groupBy("shard").agg(F.min("_at").alias("_start"))  # one row for each shard
    return (
        placed.join(F.broadcast(starts), "shard")
        .select(key, "size", "text_crc32", "law", "shard", (F.col("_at") - F.col("_start")).alias("slot"), "grown_shard", "region", "rack")
    )
