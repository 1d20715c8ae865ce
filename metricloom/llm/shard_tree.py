"""Shards picked by a hierarchical weighted hash tree: region, then rack, then shard.

``descend`` goes down level by level. Every child of a node draws an exponential number from the row's key and its own path, divided
by its weight (the sum of the shards below it); the smallest draw wins. So each level is followed in proportion to its weights, a
key costs as many draws as the nodes on its way have children, and a changed weight moves rows only into or out of subtrees
that hold the change: other regions exchange nothing, nor do the other racks of its region, nor the other shards of its rack.
A shard that ``grow`` adds has a region of its own, so it takes rows only into itself.

``pick`` is the form for trees in which a shard is added to a rack that has others: one draw per shard, a subtree's draw being the
smallest below it. There a changed weight moves rows only into or out of that shard, at the cost of a draw per shard.

Inputs: a null key is a key like any other, so are empty and very long texts, of which only the hash is used. Repeated rows get
the same shard and different slots. An empty table stays empty. Columns called region, rack, shard and slot are replaced; all
others pass, whatever their names.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.llm.ranks import running_sum
from metricloom.llm.tables import unused

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards 0 to ``shards`` - 1 of weight 1, filled in order into racks and regions."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def _draw(key: list[Column], shard: int, weight: float) -> Column:
    """Exponential draw of rate ``weight``: -ln(u) / weight, u from 53 bits of a hash, never 0."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(f"shard {shard}")), 11) + 1) * F.lit(2.0**-53)
    return -F.ln(u) / F.lit(float(weight))


def pick(key: list[str], tree: Tree) -> Column:
    """struct<region, rack, shard> for the key columns; shards of weight 0 get nothing."""
    keys = [F.col(k) for k in key]
    paths = [
        [[(region, rack, s, w) for s, w in shards.items() if w > 0] for rack, shards in in_region.items()]
        for region, in_region in tree.items()
    ]
    paths = [kept for in_region in paths if (kept := [rack for rack in in_region if rack])]
    if not paths:
        raise ValueError("no shard has a positive weight")

    def best(nodes: list[Column]) -> Column:
        return nodes[0] if len(nodes) == 1 else F.least(*nodes)

    def leaf(region: str, rack: str, shard: int, weight: float) -> Column:
        names = F.lit(region).alias("region"), F.lit(rack).alias("rack"), F.lit(shard).alias("shard")
        return F.struct(_draw(keys, shard, weight).alias("draw"), *names)

    racks = [[best([leaf(*path) for path in rack]) for rack in in_region] for in_region in paths]
    return best([best(in_region) for in_region in racks])


_SHARDS = "array<struct<shard: int, weight: double>>"
_RACKS = f"array<struct<rack: string, weight: double, shards: {_SHARDS}>>"
_REGIONS = f"array<struct<region: string, weight: double, racks: {_RACKS}>>"


def _levels(tree: Tree) -> list[dict]:
    """The tree as nested lists; what weighs nothing is left out, as nothing can come there."""
    regions = []
    for region, in_region in tree.items():
        racks = []
        for rack, in_rack in in_region.items():
            shards = [{"shard": s, "weight": float(w)} for s, w in in_rack.items() if w > 0]
            if shards:
                racks.append({"rack": rack, "weight": sum(s["weight"] for s in shards), "shards": shards})
        if racks:
            regions.append({"region": region, "weight": sum(r["weight"] for r in racks), "racks": racks})
    if not regions:
        raise ValueError("no shard has a positive weight")
    return regions


def _winner(keys: list[Column], path: list[Column], children: Column, name: str) -> Column:
    """The child of the smallest weighted draw; each draws from the key, the path to it and its own name."""

    def race(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*keys, *path, child[name]), 11) + 1) * F.lit(2.0**-53)
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child.alias("child"))

    return F.array_min(F.transform(children, race))["child"]


def descend(rows: DataFrame, key: list[str], tree: Tree) -> DataFrame:
    """Add region, rack and shard (columns of these names are replaced): one race among the children per level.

    The tree is one literal that all rows share, of as many entries as it has nodes.
    """
    keys, mark = [F.col(k) for k in key], unused(rows)
    regions = F.from_json(F.lit(json.dumps(_levels(tree))), _REGIONS)
    region, rack, shard = f"{mark}region", f"{mark}rack", f"{mark}shard"
    down = rows.withColumn(region, _winner(keys, [], regions, "region"))
    down = down.withColumn(rack, _winner(keys, [F.col(region)["region"]], F.col(region)["racks"], "rack"))
    path = [F.col(region)["region"], F.col(rack)["rack"]]
    down = down.withColumn(shard, _winner(keys, path, F.col(rack)["shards"], "shard"))
    names = {"region": F.col(region)["region"], "rack": F.col(rack)["rack"], "shard": F.col(shard)["shard"]}
    return down.withColumns(names).drop(region, rack, shard)


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return {**tree, f"region of shard {shard}": {f"rack of shard {shard}": {shard: weight}}}


def assign_shards(rows: DataFrame, key: list[str], tree: Tree) -> DataFrame:
    """Add region, rack and shard by ``descend``."""
    return descend(rows, key, tree)


def add_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``: the place within the shard by ``order``, from 0, without gaps."""
    return running_sum(rows, ["shard"], order, F.lit(1).cast("long"), "slot")


def movement(rows: DataFrame, key: list[str], before: Tree, after: Tree) -> DataFrame:
    """Rows per old and new shard that ``pick`` gives, for those that move when the tree changes."""
    moved = rows.select(pick(key, before)["shard"].alias("old"), pick(key, after)["shard"].alias("new"))
    return moved.filter("old != new").groupBy("old", "new").agg(F.count("*").alias("moved"))


def total_weight(tree: Tree) -> float:
    return reduce(add, (w for racks in tree.values() for shards in racks.values() for w in shards.values()), 0.0)
