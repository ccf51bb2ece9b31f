"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards is descended level by level.  At each node
every child draws ``-ln(u) / weight`` with ``u`` a hash of (key, child); the
smallest draw wins.  A child's share is its weight's share, and changing the
weight of a child moves keys only into or out of that child's subtree.  A new
shard joins as a new region, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Node:
    """A leaf carries ``shard`` and its own weight; an inner node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(regions: int = 2, racks: int = 2, per_rack: int = 2) -> Node:
    """A regular tree; shards are numbered from 0 in tree order."""
    number = iter(range(regions * racks * per_rack))
    return Node("root", tuple(
        Node(f"r{r}", tuple(Node(f"r{r}/k{k}", tuple(Node(f"r{r}/k{k}/s{s}", shard=next(number)) for s in range(per_rack))) for k in range(racks)))
        for r in range(regions)
    ))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    name = f"r{len(tree.children)}"
    leaf = Node(f"{name}/k0/s0", shard=shard, own_weight=weight)
    return Node(tree.name, (*tree.children, Node(name, (Node(f"{name}/k0", (leaf,)),))))


def _draw(key: Column, child: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(child.weight))


def place(key: Column, tree: Node) -> Column:
    """Shard of a key as one column expression (no shuffle, no UDF)."""
    if not tree.children:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if not live:
        raise ValueError(f"no shard below {tree.name} has a weight above 0")
    if len(live) == 1:
        return place(key, live[0])
    best = F.least(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])["i"]
    out = place(key, live[-1])
    for i in range(len(live) - 2, -1, -1):
        out = F.when(best == i, place(key, live[i])).otherwise(out)
    return out


def assign_shards(docs: DataFrame, tree: Node | None = None, key: str = "doc_id", text: str = "text", rows_per_run: int = 20_000) -> DataFrame:
    """Per row: the key, size, text_crc32, law, shard, slot and grown_shard.

    Law ``key``: only the key and the tree decide, so a row never moves because
    of other rows.  Slots are gapless from 0 in each shard: rows are dealt into
    hash runs of about ``rows_per_run`` rows, numbered inside a run and shifted
    by a prefix sum over the (small) table of run sizes, so no task holds a
    shard.  A null key is a key like any other; a null text has size 1 and the
    CRC of the empty string; repeated rows get slots of their own.
    """
    tree = tree or topology()
    n_shards = _leaves(tree)
    out = docs.select(
        key,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col(key), tree).cast("int").alias("shard"),
        place(F.col(key), grown(tree, n_shards)).cast("int").alias("grown_shard"),
    )
    runs = max(1, -(-docs.count() // (n_shards * rows_per_run)))
    slim = out.select(key, "size", "text_crc32", "law", "shard", "grown_shard").withColumn("run", F.pmod(F.xxhash64(key, "text_crc32", "size", F.lit("run")), F.lit(runs)).cast("int"))
    counts = slim.groupBy("shard", "run").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    inner = F.row_number().over(W.partitionBy("shard", "run").orderBy(key, "text_crc32", "size")) - 1
    return (
        slim.withColumn("inner", inner)
        .join(starts, ["shard", "run"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("start") + F.col("inner")).cast("long").alias("slot"), "grown_shard")
    )


def _leaves(tree: Node) -> int:
    return sum(map(_leaves, tree.children)) if tree.children else 1
