"""Hierarchical weighted hash tree: a key descends region, rack and shard by weighted hash draws.

At each level every child draws ``-ln(u) / weight`` with u a hash of the key and the child's path;
the least draw wins, so a child is chosen in proportion to its weight. A change of one subtree's
weight moves keys only into or out of that subtree. A shard added as a region of its own leaves
all other weights as they are: keys move into it and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole


@dataclass(frozen=True)
class Node:
    """A subtree: its name within its parent, and either children or a shard's weight and number."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def tree(base: int, added: int = 0, weights: tuple[float, ...] = ()) -> Node:
    """Regions of two racks of two shards for the ``base`` shards, and a region for each added one.

    Trees of one base differ, added shard by added shard, by one region only.
    """
    weights = weights or (1.0,) * (base + added)
    leaves = [Node(f"shard{k}", shard=k, leaf_weight=w) for k, w in enumerate(weights)]
    racks = [Node(f"rack{k // 2}", tuple(leaves[k : min(k + 2, base)])) for k in range(0, base, 2)]
    regions = [Node(f"region{k // 2}", tuple(racks[k : k + 2])) for k in range(0, len(racks), 2)]
    regions += [Node(f"region-of-{x.name}", (Node("rack", (x,)),)) for x in leaves[base:]]
    return Node("root", tuple(regions))


def uniform(key: Column, path: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of seed, path and key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), path, F.lit("/"), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def descend(key: Column, root: Node, seed: int) -> Column:
    """The shard that the key reaches from ``root``.

    Each level is one constant array of its subtrees' children, from which the row's own are drawn
    by path and weight, so the expression grows with the levels and not with the shards.
    """
    level, at = [(root, "")], F.lit(0)
    while any(node.children for node, _ in level):
        below, tables = [], []
        for node, path in level:
            # A shard above the last level goes down as it is.
            family = [(c, f"{path}/{c.name}") for c in node.children] or [(node, path)]
            tables.append(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(c.weight)).alias("weight"), F.lit(len(below) + k).alias("child")) for k, (c, p) in enumerate(family)]))
            below += family
        draws = F.transform(F.get(F.array(*tables), at), lambda c: F.struct((-F.ln(uniform(key, c["path"], seed)) / c["weight"]).alias("draw"), c["child"].alias("child")))
        level, at = below, F.array_min(draws)["child"]
    return F.get(F.array(*[F.lit(node.shard) for node, _ in level]), at)


def assign(docs: DataFrame, shards: Node, key: str = "doc_id", seed: int = 17, name: str = "shard") -> DataFrame:
    """``docs`` with the int column ``name``: the shard of each row by its key and the tree alone.

    A null key counts as the text "null"; equal keys share a shard; nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    return docs.withColumn(name, descend(text, shards, seed).cast("int"))


def number(placed: DataFrame, by: str, order: list[str], name: str = "slot", block_rows: int = 20_000, seed: int = 17) -> DataFrame:
    """``placed`` with gapless numbers from 0 within each value of ``by``.

    Rows fall into hashed blocks of about ``block_rows``; blocks are counted, their starts are
    running sums over the counts, and only a block's rows are sorted in one task. Rows that are
    equal in ``order`` get neighbouring numbers in any order. Order columns may be null.
    """
    rows = placed.count()
    blocks = max(1, rows // block_rows)
    block = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order]), F.lit(blocks)).cast("int")
    blocked = placed.withColumn("_block", block)
    counts = blocked.groupBy(by, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.expr(f"sum(_rows) OVER (PARTITION BY `{by}` ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    starts = counts.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_rows")
    within = F.expr(f"row_number() OVER (PARTITION BY `{by}`, _block ORDER BY {', '.join(f'`{c}`' for c in order)}) - 1")
    ranked = blocked.withColumn("_within", within)
    joined = ranked.alias("r").join(starts.withColumnRenamed(by, "_by").withColumnRenamed("_block", "_b"), (F.col(f"r.`{by}`") == F.col("_by")) & (F.col("r._block") == F.col("_b")))
    return joined.select(*[F.col(f"r.`{c}`") for c in placed.columns], (F.col("_start") + F.col("_within")).cast("long").alias(name))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    size is the UTF-8 bytes of the text plus 1 and text_crc32 their CRC-32; a null text has no
    bytes (size 1, CRC 0). The law is "key": key and shard count decide. slot numbers a shard's
    rows from 0 without gaps. grown_shard is the shard with one more shard in the tree. Equal
    texts under equal keys share a shard. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{key}`"), (F.octet_length(whole(text)) + 1).cast("long").alias("size"), F.crc32(whole(text).cast("binary")).alias("text_crc32"))
    placed = assign(assign(slim, tree(shards), key, seed), tree(shards, added=1), key, seed, "grown_shard")
    return number(placed.withColumn("law", F.lit("key")), "shard", [key, "text_crc32", "size"]).select(F.col(f"`{key}`"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
