"""Filling fixed-capacity containers by sum-of-squares packing.

An item goes where the sum of the squared counts of open containers per residual gap becomes smallest: into an open
container of some gap, or into a new one.  The rule needs only counts per gap, so one shard of items is packed in one
pass over an array of ``capacity`` counts.  Shards are of bounded size and chosen by hash; their number grows with the
data.  Containers that a shard leaves with more than ``slack`` of their space open are broken up and their items packed
again across shards, so the loss does not grow with the number of shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

#: Items per shard; also the most rows one task holds (three integers each).
SHARD = 50_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the given order; every size is between 1 and the capacity."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        have = open_at[s:capacity]
        # Moving a container from gap g to g - s changes the sum by 2 (N[g - s] - N[g]) + 2; filling one by 1 - 2 N[g].
        cost = 2 * (open_at[: capacity - s] - have) + 2
        if len(cost):
            cost[0] = 1 - 2 * have[0]
            cost = np.where(have > 0, cost, np.iinfo(np.int64).max)
            j = int(cost.argmin())
        fresh = 2 * open_at[capacity - s] + 1 if s < capacity else 0
        if len(cost) and cost[j] <= fresh:
            gap = s + j
            c = stacks[gap].pop()
            open_at[gap] -= 1
        else:
            gap, c = capacity, n
            n += 1
        out[i] = c
        left = gap - s
        if left:
            open_at[left] += 1
            stacks[left].append(c)
    return out


def _round(items: DataFrame, n: int, capacity: int, tag: str, largest_first: bool) -> DataFrame:
    shards = max(1, -(-n // SHARD))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "order", "id", "piece"], ascending=[False, True, True, True]) if largest_first else g.sort_values(["order", "id", "piece"])
        bins = pack(g["size"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=g["size"].to_numpy()).astype("int64")
        return pd.DataFrame({"id": g["id"].to_numpy(), "piece": g["piece"].to_numpy(), "size": g["size"].to_numpy(), "container": [f"{tag}-{s}-{b}" for s, b in zip(g["shard"].to_numpy(), bins)], "fill": fill[bins]})

    order = F.xxhash64("id", "piece", F.lit(tag))
    sharded = items.select("id", "piece", "size", order.alias("order")).withColumn("shard", F.pmod("order", F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(one, "id long, piece int, size long, container string, fill long")


def containers(df: DataFrame, item: str, size: str, scratch: Scratch, capacity: int = 2048, slack: float = 0.01) -> DataFrame:
    """``(id, piece, start, size, container, fill)`` of every piece of every item.

    An item above the capacity is divided into full pieces and a rest, ``start`` being the offset of the piece in it;
    no other item is divided.  Items of size 0 or null come out once, with size 0 and no container.  Ids are unique
    (of a repeated id each row is packed).  An empty table gives an empty result.
    """
    rows = scratch.put(df.select(F.col(item).cast("long").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("all")).withColumn("row", F.monotonically_increasing_id()))
    cap = F.lit(capacity)
    pieces = rows.filter("all > 0").select("id", "row", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / cap).cast("int"))).alias("piece"), "all")
    pieces = pieces.select("id", "row", "piece", F.least(cap.cast("long"), F.col("all") - F.col("piece") * cap).alias("size"))
    full = pieces.filter(F.col("size") == capacity).select("id", "piece", "size", F.concat(F.lit("f-"), "row", F.lit("-"), "piece").alias("container"), F.col("size").alias("fill"))
    part = pieces.filter(F.col("size") < capacity)
    n = part.count()
    first = scratch.put(_round(part, n, capacity, "a", False))
    loose = first.filter(F.col("fill") < capacity * (1 - slack))
    again = _round(loose.select("id", "piece", "size"), loose.count(), capacity, "b", True)
    packed = first.filter(F.col("fill") >= capacity * (1 - slack)).unionByName(again).unionByName(full)
    none = rows.filter("all = 0").select("id", F.lit(0).alias("piece"), F.col("all").alias("size"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("fill"))
    return packed.unionByName(none).select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size", "container", "fill")
