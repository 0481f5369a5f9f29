"""Sharding by a hierarchical weighted hash tree: at each level a document draws a number
for every child of the node it is at - the logarithm of a hash, divided by the child's
weight - and descends to the child with the greatest. A child's draw doesn't depend on its
siblings, so a changed weight moves documents only into or out of the subtree whose weight
changes. A projection: no shuffle, no state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. An inner node weighs what its children weigh together."""

    name: str
    children: tuple[Node, ...] = ()
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


#: Three regions, of three racks each, of four shards; weights are capacities.
CLUSTER = Node(
    "root",
    tuple(
        Node(f"r{a}", tuple(Node(f"r{a}k{b}", tuple(Node(f"r{a}k{b}s{c}", (), 1.0 + (c == 0) * 1.0 + 0.5 * (a == 1)) for c in range(4))) for b in range(3)))
        for a in range(3)
    ),
)
LEVELS = ("region", "rack", "shard")


def draw(key: Column, name: str, weight: float) -> Column:
    """In (-inf, 0]; the greatest of some draws is a child's with probability weight / sum."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + name))), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return F.log(u) / F.lit(weight)


def descend(key: Column, node: Node) -> Column:
    """Name of the child that ``key`` draws; ties go to the greater name. A child without
    weight is never drawn."""
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return F.lit(live[0].name)
    return F.greatest(*[F.struct(draw(key, c.name, c.weight).alias("d"), F.lit(c.name).alias("n")) for c in live])["n"]


def _live(node: Node) -> list[Node]:
    return [c for c in node.children if c.weight > 0]


def assign(docs: DataFrame, tree: Node = CLUSTER, *, key: str = "doc_id") -> DataFrame:
    """key, region, rack and shard of every row of ``docs``.

    A null key gets null at every level; equal keys go to one shard; the text isn't read, so
    its length or absence doesn't matter; other columns, of whatever name, aren't read; an
    empty table gives an empty result. A child of weight 0 or less gets nothing; a tree
    without weight is an error."""
    if tree.weight <= 0:
        raise ValueError("the tree has no weight")
    out = docs.select(F.col(key).alias("__key")).withColumn("__k", F.col("__key").cast("string"))
    at = [tree]
    above = None
    for level in LEVELS:
        if above is None:
            found = descend(F.col("__k"), tree)
        else:
            found = None
            for node in at:
                branch = descend(F.col("__k"), node)
                found = F.when(F.col(above) == node.name, branch) if found is None else found.when(F.col(above) == node.name, branch)
        out = out.withColumn(level, F.when(F.col("__k").isNotNull(), found))
        above, at = level, [c for n in at for c in _live(n)]
    return out.select(F.col("__key").alias(key), *LEVELS)


def assign_sql(tree: Node = CLUSTER, key: str = "doc_id", table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    rows = []

    def walk(node: Node, depth: int) -> None:
        for c in _live(node):
            rows.append(f"({depth}, '{node.name}', '{c.name}', {c.weight!r}::double)")
            walk(c, depth + 1)

    walk(tree, 0)
    pick = "max_by(c.name, struct_pack(d := ln((('0x' || substr(md5(k || '/' || c.name), 1, 12))::bigint::double + 1) / 281474976710656.0) / c.weight, n := c.name))"
    return f"""
with tree(depth, above, name, weight) as (values {', '.join(rows)}),
keys as (select distinct {key}::varchar as k from {table} where {key} is not null),
l0 as (select k, {pick} as region from keys join tree c on c.depth = 0 group by k),
l1 as (select l0.k, region, {pick.replace('md5(k', 'md5(l0.k')} as rack from l0 join tree c on c.depth = 1 and c.above = region group by l0.k, region),
l2 as (select l1.k, region, rack, {pick.replace('md5(k', 'md5(l1.k')} as shard from l1 join tree c on c.depth = 2 and c.above = rack group by l1.k, region, rack)
select {key}, region, rack, shard from {table} left join l2 on {key}::varchar = k"""
