"""Groups of records linked directly or indirectly.

The giant component is peeled first: breadth-first frontier joins from the vertex of highest degree, then an
anti-join removes it.  What is left are small components, labelled by minimum propagation.  Two additions keep the
number of rounds logarithmic.  Frontiers that have thinned out (long tails) end the peeling early; the visited part is
then contracted to one vertex and takes part in the propagation.  And each propagation round contracts the graph to
its labels and follows each label three steps, so a chain of n records takes about log(n) rounds.

All state is written per round to the shared folder; only row counts and one vertex id reach the driver.  Joins whose
left side is skewed by a hub have a unique right side and are split by adaptive execution; minima per vertex are
combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

#: Peeling ends when a frontier holds less than this share of the visited vertices, or after so many rounds.
THIN = 0.02
PEEL_ROUNDS = 12
JUMPS = 3


def _peel(links: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, bool]:
    """Vertices reached from the vertex of highest degree, and whether that is its whole component."""
    top = links.groupBy("a").count().agg(F.max_by("a", F.struct("count", "a"))).first()[0]
    if top is None:
        return None, True
    spark = links.sparkSession
    visited = frontier = scratch.put(spark.createDataFrame([(top,)], "v string"))
    n = 1
    for _ in range(PEEL_ROUNDS):
        reached = links.join(frontier.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        frontier = scratch.put(reached.join(visited, "v", "left_anti"))
        new = frontier.count()
        if new == 0:
            return visited, True
        visited = visited.unionByName(frontier)  # written parts, not written again
        n += new
        if new < THIN * n:
            return visited, False
    return visited, False


def _propagate(links: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Contraction maps ``(v, to)`` round by round until no link joins two labels."""
    maps = []
    while True:
        low = links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("to"))
        hop = scratch.put(low)
        if hop.limit(1).count() == 0:
            return maps
        for _ in range(JUMPS):
            hop = hop.join(hop.select(F.col("v").alias("to"), F.col("to").alias("to2")), "to").select("v", F.col("to2").alias("to"))
            hop = scratch.put(hop)
        maps.append(hop)
        end = lambda c: hop.select(F.col("v").alias(c), F.col("to").alias(c + "2"))
        nxt = links.join(end("a"), "a").join(end("b"), "b").filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
        old, links = links, scratch.put(nxt)
        scratch.drop(old)


def components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """``(id, group_id)`` of every id in an edge; group_id is the smallest id of its component.

    Direction, repeats and all other columns are ignored; a self-pair, or an edge whose other end is null, gives a
    record of its own; null ids have no row; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    ids = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).filter("id is not null").distinct()
    pairs = e.filter("a <> b")
    links = scratch.put(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    giant, whole = _peel(links, scratch)
    if giant is None:
        return ids.select("id", F.col("id").alias("group_id"))
    least = giant.agg(F.min("v")).first()[0]
    inside = lambda c: giant.select(F.col("v").alias(c))
    if whole:
        rest = links.join(inside("a"), "a", "left_anti")
    else:
        mark = lambda c: giant.select(F.col("v").alias(c), F.lit(least).alias(c + "g"))
        rest = (
            links.join(mark("a"), "a", "left").join(mark("b"), "b", "left")
            .select(F.coalesce("ag", "a").alias("a"), F.coalesce("bg", "b").alias("b")).filter("a <> b").distinct()
        )
    maps = _propagate(scratch.put(rest), scratch)
    label = None
    for hop in reversed(maps):
        if label is None:
            label = hop
        else:
            after = label.select(F.col("v").alias("to"), F.col("to").alias("end"))
            label = scratch.put(hop.join(after, "to", "left").select("v", F.coalesce("end", "to").alias("to")))
    peeled = giant.select(F.col("v").alias("id"), F.lit(least).alias("via"))
    out = ids.join(peeled, "id", "left").select("id", F.coalesce("via", "id").alias("via"))
    if label is None:
        return out.select("id", F.col("via").alias("group_id"))
    # The peeled vertices share one label: it is resolved once, not joined a third of all rows at a time.
    final = label.filter(F.col("v") == least).select("to").first()
    far = final[0] if final else least
    small = out.join(inside("id"), "id", "left_anti").select("id").join(label.select(F.col("v").alias("id"), "to"), "id", "left").select("id", F.coalesce("to", "id").alias("group_id"))
    return small.unionByName(giant.select(F.col("v").alias("id"), F.lit(far).alias("group_id")))
