"""Concept graph: co-occurrence, clusters, bridges, taxonomy holes, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch


#: Concepts of one source that are held in one array; a source of more is cut into blocks.
BLOCK = 2_048


def cooccurrence(sources: DataFrame, min_shared: int = 1) -> DataFrame:
    """``(a, b, shared)`` for concepts met in the same sources, a < b, counting distinct sources.

    ``sources`` is already distinct per (concept, source).  Concepts are gathered per source once and pairs are made
    from the sorted array, which spares the self-join and its two shuffles; of a source with many concepts every two
    blocks are paired in a row of their own.
    """
    count = sources.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = sources.select("source_id", "concept_id").join(count, "source_id").withColumn("block", F.pmod(F.xxhash64("concept_id"), F.col("blocks")).cast("int"))
    sets = placed.groupBy("source_id", "block").agg(F.array_sort(F.collect_set("concept_id")).alias("c"), F.max("blocks").alias("blocks"))
    heads = sets.select("c", F.posexplode("c").alias("i", "a")).filter(F.col("i") < F.size("c") - 1)
    pairs = heads.select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    many = sets.filter("blocks > 1")
    across = many.join(many.select("source_id", F.col("block").alias("block2"), F.col("c").alias("c2")), "source_id").filter("block < block2").select(F.explode("c").alias("x"), "c2").select("x", F.explode("c2").alias("y"))
    both = pairs.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)


def groups(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(v, l)``: every vertex of the links ``(a, b)`` with the smallest vertex of its connected component.

    Each round every label takes its smallest neighbour, labels follow each other for three steps, and the links are
    contracted to what still joins two labels, so the table shrinks and a chain of n vertices takes about log(n) rounds.
    """
    one = links.select("a", "b").filter("a is not null and b is not null")
    ends = scratch.put(one.select(F.col("a").alias("v")).unionByName(one.select(F.col("b").alias("v"))).distinct())
    rest = scratch.put(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while rest.limit(1).count():
        hop = scratch.put(rest.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")))
        for _ in range(3):
            hop = hop.join(hop.select(F.col("v").alias("l"), F.col("l").alias("l2")), "l").select("v", F.col("l2").alias("l"))
        maps.append(scratch.put(hop))
        end = lambda c: maps[-1].select(F.col("v").alias(c), F.col("l").alias(c + "2"))
        old, rest = rest, scratch.put(rest.join(end("a"), "a").join(end("b"), "b").filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
        scratch.drop(old)
    label = ends.withColumn("l", F.col("v"))
    for hop in maps:
        label = scratch.put(label.join(hop.select(F.col("v").alias("l"), F.col("l").alias("l2")), "l", "left").select("v", F.coalesce("l2", "l").alias("l")))
    return label


def clusters(links: DataFrame, scratch: Scratch, min_size: int = 2) -> DataFrame:
    """``(concept_id, cluster_id, size)``: connected components, the smallest member naming each."""
    label = groups(links, scratch)
    sizes = label.groupBy("l").count()
    return label.join(sizes, "l").filter(F.col("count") >= min_size).select(F.col("v").alias("concept_id"), F.col("l").alias("cluster_id"), F.col("count").alias("size"))


def rewritten(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct edges with those of an older run of the corpus statistics replaced by ``pairs`` (a, b, shared)."""
    mine = (F.col("relation") == "co_occurs") & (F.col("provenance") == "corpus_stats")
    kept = edge.filter(~F.coalesce(mine, F.lit(False))).select("from_concept", "to_concept", "relation", "provenance", "weight").distinct()
    return kept.unionByName(pairs.select(F.col("a").alias("from_concept"), F.col("b").alias("to_concept"), F.lit("co_occurs").alias("relation"), F.lit("corpus_stats").alias("provenance"), F.col("shared").cast("double").alias("weight")))


def bridge_gaps(cluster: DataFrame, limit: int = 10) -> DataFrame:
    """Pairs of clusters by the product of their sizes, largest first.

    Only the ``limit + 1`` largest clusters can be in the answer, so the pairing is of a bounded few.
    """
    top = cluster.select("cluster_id", "size").distinct().orderBy(F.desc("size"), "cluster_id").limit(limit + 1)
    a, b = top.select(F.col("cluster_id").alias("a"), F.col("size").alias("size_a")), top.select(F.col("cluster_id").alias("b"), F.col("size").alias("size_b"))
    return F.broadcast(a).join(b, F.col("a") < F.col("b")).withColumn("strength", F.col("size_a") * F.col("size_b")).orderBy(F.desc("strength"), "a", "b").limit(limit)


def taxonomy_holes(edge: DataFrame, coverage: DataFrame, min_covered: int = 2, limit: int = 25) -> DataFrame:
    """Uncovered siblings of well covered concepts under the same vocabulary parent, by concept, anchor and parent."""
    e = edge.filter("relation = 'subclass_of' and provenance = 'vocabulary'").select("from_concept", "to_concept").distinct()
    known = e.join(coverage.filter(F.col("distinct_sources") >= min_covered).select(F.col("concept_id").alias("from_concept")), "from_concept").select(F.col("from_concept").alias("anchor_id"), F.col("to_concept").alias("parent_id"))
    sibling = e.select(F.col("from_concept").alias("concept_id"), F.col("to_concept").alias("parent_id")).join(coverage.select("concept_id"), "concept_id", "left_anti")
    return sibling.join(known, "parent_id").filter("concept_id <> anchor_id").select("concept_id", "anchor_id", "parent_id", F.lit("sibling").alias("kind")).orderBy("concept_id", "anchor_id", "parent_id").limit(limit)


def neighbourhood(edge: DataFrame, start: str, scratch: Scratch, hops: int = 2, max_nodes: int = 150, min_weight: float = 0.0, provenance: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(concept_id, distance)`` within ``hops``, nearest first then by id, and the edges among them.

    Edges count in both directions; a null weight counts as 1.
    """
    e = edge.filter(F.coalesce("weight", F.lit(1.0)) >= min_weight).filter("from_concept is not null and to_concept is not null")
    if provenance:
        e = e.filter(F.col("provenance") == provenance)
    links = e.select(F.col("from_concept").alias("a"), F.col("to_concept").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = edge.sparkSession.createDataFrame([(start, 0)], "concept_id string, distance int")
    frontier = seen
    for hop in range(1, hops + 1):
        step = links.join(F.broadcast(frontier.select(F.col("concept_id").alias("a"))), "a", "left_semi").select(F.col("b").alias("concept_id")).distinct()
        frontier = scratch.put(step.join(F.broadcast(seen.select("concept_id")), "concept_id", "left_anti").withColumn("distance", F.lit(hop)).orderBy("concept_id").limit(max_nodes))
        seen = seen.unionByName(frontier)
    nodes = seen.orderBy("distance", "concept_id").limit(max_nodes)
    inside = lambda c: F.broadcast(nodes.select(F.col("concept_id").alias(c)))
    return nodes, e.join(inside("from_concept"), "from_concept", "left_semi").join(inside("to_concept"), "to_concept", "left_semi")
