"""Parent-child rows to full hierarchies with nested-set ranges and cycle reports.

Subtree sizes are computed upward, sibling ranges downward, both by ancestor doubling: after round k every node
knows its 2^k-th ancestor, so a tree of depth d takes log2(d) rounds instead of d.  A node that still has an
ancestor once a round finishes no more nodes is unprocessed: it lies on a cycle or below one.  Finished nodes leave the
rounds; each round looks the others up in the state so far.

A node may have several parents.  Its place in the tree is under the smallest; all others are reported as links beside
the tree, and count for cycles and descendants.  For cycles the forest is cut at such nodes, and what is left is a graph
of them alone, peeled round by round.

Ancestors, descendants and paths are read off the ranges: a range is cut into blocks of positions, so a tree with a third
of all nodes is joined in many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import Scratch

#: Buckets of a parent's children in the two-level prefix sum; fixed, so no parent's children meet in one task.
SIBLING_BUCKETS = 1024


#: Positions in one block of the range join.
RANGE_BLOCK = 256


def links(edges: DataFrame, child: str, parent: str, forest: str) -> DataFrame:
    """Distinct ``(forest, node, parent)``; rows with a null end are dropped."""
    e = edges.select(F.col(forest).alias("forest"), F.col(child).alias("node"), F.col(parent).alias("parent"))
    return e.filter("node is not null and parent is not null").distinct()


def _tree(links: DataFrame) -> DataFrame:
    """One row per node ``(forest, node, parent)`` with the smallest parent; null for roots."""
    both = links.unionByName(links.select("forest", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    return both.groupBy("forest", "node").agg(F.min("parent").alias("parent"))


def parents(edges: DataFrame, child: str, parent: str, forest: str) -> DataFrame:
    """One row per node ``(forest, node, parent)``; parent null for roots.

    Null ends are dropped.  A child of several parents keeps the smallest; repeats count once.
    """
    return _tree(links(edges, child, parent, forest))


def sizes_upward(tree: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """``(forest, node, parent, anc, depth, root, low)`` of every node, ``(forest, node, size)``, and whether any is unprocessed.

    For processed nodes anc is null, size counts the node and its descendants and low is the smallest id from the node up
    to its root; for unprocessed nodes anc is some node above them.  A round passes the size so far of each node to its
    ancestor; what finished nodes get is summed once, after the rounds, from the tables of the rounds.
    """
    one = F.lit(1).cast("long").alias("size")
    active = scratch.put(
        tree.select("forest", "node", "parent", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "node").alias("root"), F.least("node", "parent").alias("low"), one)
    )
    passed = [active.select("forest", "node", one)]
    done: DataFrame | None = None
    left = None
    while True:
        before, left = left, active.filter("anc is not null").count()
        if left == 0 or left == before:
            break
        state = active if done is None else done.unionByName(active)
        up = state.select("forest", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"), F.col("low").alias("low2"))
        going = active.filter("anc is not null")
        given = going.select("forest", F.col("anc").alias("node"), "size")
        gain = given.groupBy("forest", "node").agg(F.sum("size").alias("gain"))
        nxt = going.join(up, ["forest", "anc"], "left").join(gain, ["forest", "node"], "left")
        ended = active.filter("anc is null")
        done = ended if done is None else done.unionByName(ended)
        passed.append(given)
        active = scratch.put(
            nxt.select("forest", "node", "parent", F.col("anc2").alias("anc"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root"), F.least("low", "low2").alias("low"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        )
    state = (active if done is None else done.unionByName(active)).drop("size")
    every = passed[0]
    for x in passed[1:]:
        every = every.unionByName(x)
    return state, every.groupBy("forest", "node").agg(F.sum("size").alias("size")), left > 0


def cycles(state: DataFrame, scratch: Scratch) -> DataFrame:
    """``(forest, node, cycle_id)`` of every unprocessed node; cycle_id is the smallest id on its cycle."""
    far = scratch.put(state.filter(F.col("anc").isNotNull()).select("forest", "node", "parent", "anc"))
    images = None
    while True:  # the ancestors of long tails are moved on until all lie on cycles
        before, images = images, far.select("forest", "anc").distinct().count()
        if images == before:
            break
        step = far.select("forest", F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        nxt = scratch.put(far.join(step, ["forest", "anc"]).select("forest", "node", "parent", F.col("anc2").alias("anc")))
        scratch.drop(far)
        far = nxt
    on = far.select("forest", F.col("anc").alias("node")).distinct()
    ring = scratch.put(far.join(on, ["forest", "node"], "left_semi").select("forest", "node", F.col("parent").alias("to"), F.col("node").alias("low")))
    while True:
        ahead = ring.select("forest", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        step = ring.join(ahead, ["forest", "to"]).select("forest", "node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        nxt = scratch.put(step)
        scratch.drop(ring)
        ring = nxt.drop("moved")
        ring._lumenfold_path = nxt._lumenfold_path
        if nxt.filter("moved").limit(1).count() == 0:
            break
    return far.select("forest", "node", "anc").join(ring.select("forest", F.col("node").alias("anc"), F.col("low").alias("cycle_id")), ["forest", "anc"]).select("forest", "node", "cycle_id")


def _junctions(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(forest, node, root, low)`` edges between nodes of several parents: root is the next such node above by one of
    the parents, or the end of that way; ``cycle_id`` is set if the way ends in a cycle of nodes of one parent."""
    many = scratch.put(edges.groupBy("forest", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("forest", "node"))
    single = edges.join(many, ["forest", "node"], "left_anti")
    ends = edges.select("forest", "node").unionByName(edges.select("forest", F.col("parent").alias("node"))).distinct()
    tree = ends.join(single, ["forest", "node"], "left")
    state, _, some = sizes_upward(tree, scratch)
    state = scratch.put(state)
    lost = scratch.put(cycles(state, scratch)) if some else None
    way = state.select("forest", "node", "parent", "anc", "root", "low")
    way = way.join(lost, ["forest", "node"], "left") if lost is not None else way.withColumn("cycle_id", F.lit(None).cast("string"))
    return scratch.put(way.join(many.withColumn("many", F.lit(True)), ["forest", "node"], "left"))


def _knots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(forest, node, cycle_id)`` for edges ``(forest, node, to, low)`` all of whose nodes reach a cycle.

    Cycles are found colour by colour: every node takes the greatest id it reaches, and the nodes that such an id reaches
    within its colour are its knot.  Rounds grow with the length of cycles through nodes of several parents.
    """
    found = None
    rest = edges
    while True:
        # Nodes nothing leads to, and nodes that lead nowhere, are on no cycle.
        while True:
            n = rest.count()
            rest = scratch.put(rest.join(rest.select("forest", F.col("to").alias("node")).distinct(), ["forest", "node"], "left_semi").join(rest.select("forest", F.col("node").alias("to")).distinct(), ["forest", "to"], "left_semi").select("forest", "node", "to", "low"))
            if rest.count() == n:
                break
        if n == 0:
            break
        colour = scratch.put(rest.select("forest", "node").distinct().withColumn("c", F.col("node")))
        while True:
            ahead = rest.join(colour.select("forest", F.col("node").alias("to"), F.col("c").alias("c2")), ["forest", "to"]).groupBy("forest", "node").agg(F.max("c2").alias("c2"))
            nxt = scratch.put(colour.join(ahead, ["forest", "node"]).select("forest", "node", F.greatest("c", "c2").alias("c"), (F.col("c2") > F.col("c")).alias("moved")))
            colour = nxt.drop("moved")
            if nxt.filter("moved").limit(1).count() == 0:
                break
        inner = scratch.put(rest.join(colour, ["forest", "node"]).join(colour.select("forest", F.col("node").alias("to"), F.col("c").alias("c2")), ["forest", "to"]).filter("c = c2").select("forest", "node", "to", "low", "c"))
        knot = scratch.put(colour.filter("node = c").select("forest", "node", "c"))
        while True:
            n = knot.count()
            reached = inner.join(knot, ["forest", "node", "c"], "left_semi").select("forest", F.col("to").alias("node"), "c")
            knot = scratch.put(knot.unionByName(reached).distinct())
            if knot.count() == n:
                break
        ring = inner.join(knot, ["forest", "node", "c"], "left_semi").join(knot.select("forest", F.col("node").alias("to"), "c"), ["forest", "to", "c"], "left_semi")
        ids = scratch.put(ring.groupBy("forest", "c").agg(F.min("low").alias("cycle_id")).join(knot, ["forest", "c"]).select("forest", "node", "cycle_id"))
        found = ids if found is None else found.unionByName(ids)
        rest = scratch.put(rest.join(knot.select("forest", "node"), ["forest", "node"], "left_anti").join(knot.select("forest", F.col("node").alias("to")), ["forest", "to"], "left_anti"))
    return found if found is not None else edges.select("forest", "node", F.col("low").alias("cycle_id")).filter("false")


def unprocessed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(forest, node, cycle_id)`` of every node from which some parents never end, for distinct ``links``.

    cycle_id is the smallest id on the cycle it leads to, of several cycles the smallest.
    """
    if edges.groupBy("forest", "node").count().filter("count > 1").limit(1).count() == 0:
        state, _, lost = sizes_upward(_tree(edges), scratch)
        return cycles(state, scratch) if lost else state.select("forest", "node", F.lit(None).cast("string").alias("cycle_id")).filter("false")
    way = _junctions(edges, scratch)
    end = way.select("forest", F.col("node").alias("parent"), "root", "low", F.col("cycle_id").alias("end_id"), F.col("anc").isNotNull().alias("endless"))
    many = way.filter("many").select("forest", "node")
    up = edges.join(many, ["forest", "node"], "left_semi").join(end, ["forest", "parent"])
    arcs = up.join(many.select("forest", F.col("node").alias("root"), F.lit(True).alias("on")), ["forest", "root"], "left")
    arcs = scratch.put(arcs.select("forest", "node", F.when(~F.col("endless") & F.col("on"), F.col("root")).alias("to"), "low", "end_id"))
    # Peeled from above: a node stays while one of its ways leads to a cycle or to a node that stays.
    stay = scratch.put(arcs.select("forest", "node").distinct())
    while True:
        n = stay.count()
        hit = arcs.join(stay.select("forest", F.col("node").alias("to"), F.lit(True).alias("held")), ["forest", "to"], "left").filter("held or end_id is not null")
        stay = scratch.put(hit.select("forest", "node").distinct())
        if stay.count() == n:
            break
    inside = scratch.put(arcs.join(stay, ["forest", "node"], "left_semi").join(stay.select("forest", F.col("node").alias("to")), ["forest", "to"], "left_semi").select("forest", "node", "to", "low"))
    known = arcs.filter("end_id is not null").select("forest", "node", F.col("end_id").alias("cycle_id")).unionByName(_knots(inside, scratch))
    best = scratch.put(known.groupBy("forest", "node").agg(F.min("cycle_id").alias("cycle_id")))
    while True:  # the smallest id travels down
        below = inside.join(best.select("forest", F.col("node").alias("to"), "cycle_id"), ["forest", "to"]).select("forest", "node", "cycle_id")
        nxt = scratch.put(best.unionByName(below).groupBy("forest", "node").agg(F.min("cycle_id").alias("cycle_id")))
        same = nxt.join(best, ["forest", "node", "cycle_id"], "left_anti").limit(1).count() == 0
        best = nxt
        if same:
            break
    under = way.filter("anc is null").select("forest", "node", F.col("root").alias("top")).join(best.select("forest", F.col("node").alias("top"), "cycle_id"), ["forest", "top"]).select("forest", "node", "cycle_id")
    return way.filter("cycle_id is not null").select("forest", "node", "cycle_id").unionByName(under)


def ranges_downward(state: DataFrame, scratch: Scratch) -> DataFrame:
    """``(forest, node, parent, root, depth, size, lo, hi)`` of processed nodes.

    ``[lo, hi)`` is the preorder range inside the root's tree: x is a descendant of y iff their roots agree and
    ``y.lo <= x.lo < y.hi``.  Siblings are ordered by a hash bucket, then by id, so that a parent with a third of all
    nodes is summed in 1,024 pieces.
    """
    done = state.filter(F.col("anc").isNull()).select("forest", "node", "parent", "root", "depth", "size")
    kids = done.filter(F.col("parent").isNotNull()).withColumn("b", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)))
    in_bucket = Window.partitionBy("forest", "parent", "b").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy("forest", "parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = kids.groupBy("forest", "parent", "b").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(over_buckets), F.lit(0))).drop("s")
    offset = kids.withColumn("o", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(base, ["forest", "parent", "b"]).select("forest", "node", (F.lit(1) + F.col("base") + F.col("o")).alias("off"))
    active = scratch.put(done.join(offset, ["forest", "node"], "left").select("forest", "node", F.col("parent").alias("anc"), F.coalesce("off", F.lit(0)).alias("lo")))
    placed: DataFrame | None = None
    while True:
        ended = active.filter("anc is null")
        state_so_far = active if placed is None else placed.unionByName(active)
        placed = ended if placed is None else placed.unionByName(ended)
        going = active.filter("anc is not null")
        if going.limit(1).count() == 0:
            break
        up = state_so_far.select("forest", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("lo").alias("lo2"))
        active = scratch.put(going.join(up, ["forest", "anc"]).select("forest", "node", F.col("anc2").alias("anc"), (F.col("lo") + F.col("lo2")).alias("lo")))
    out = done.join(placed.select("forest", "node", "lo"), ["forest", "node"])
    return scratch.put(out.select("forest", "node", "parent", "root", "depth", "size", "lo", (F.col("lo") + F.col("size")).alias("hi")))


def _pairs(ranges: DataFrame) -> DataFrame:
    """``(forest, ancestor, depth_a, node)`` of all proper descendants along the tree, by a range join in blocks."""
    block = lambda c: F.floor(F.col(c) / RANGE_BLOCK)
    outer = ranges.filter("size > 1").select("forest", "root", F.col("node").alias("ancestor"), F.col("depth").alias("depth_a"), F.col("lo").alias("lo_a"), "hi")
    outer = outer.withColumn("block", F.explode(F.sequence(block("lo_a"), F.floor((F.col("hi") - 1) / RANGE_BLOCK))))
    inner = ranges.select("forest", "root", "node", "lo", block("lo").alias("block"))
    return outer.join(inner, ["forest", "root", "block"]).filter("lo > lo_a and lo < hi").select("forest", "ancestor", "depth_a", "node")


def hierarchy(edges: DataFrame, child: str, parent: str, forest: str, scratch: Scratch) -> DataFrame:
    """Every node with parent, root, depth, size, range and path, or with the ``cycle_id`` that prevents them.

    ``path`` lists the ids from the root down to the node, by the smallest parent each; ``n_parents`` counts all parents.
    Rows with a null end are ignored, repeats count once, a node that is its own parent is a cycle, a node is reported with
    a cycle if any of its parents leads to one, an empty table gives an empty result, and further columns are not looked at.
    """
    all_links = scratch.put(links(edges, child, parent, forest))
    bad = scratch.put(unprocessed(all_links, scratch))
    good = all_links.join(bad.select("forest", "node"), ["forest", "node"], "left_anti")
    # Parents of processed nodes are processed, but a root may have lost children only.
    tree = _tree(all_links).join(bad.select("forest", "node"), ["forest", "node"], "left_anti")
    state, sizes, _ = sizes_upward(tree, scratch)
    ranges = ranges_downward(scratch.put(state.join(sizes, ["forest", "node"])), scratch)
    above = _pairs(ranges).groupBy("forest", "node").agg(F.array_sort(F.collect_list(F.struct("depth_a", "ancestor"))).alias("above"))
    n = good.groupBy("forest", "node").agg(F.count(F.lit(1)).alias("n_parents"))
    path = F.concat(F.coalesce(F.transform("above", lambda x: x["ancestor"]), F.array().cast("array<string>")), F.array("node"))
    out = ranges.join(above, ["forest", "node"], "left").join(n, ["forest", "node"], "left")
    out = out.select("forest", "node", "parent", "root", "depth", "size", "lo", "hi", path.alias("path"), F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.lit(None).cast("string").alias("cycle_id"))
    lost = all_links.join(bad, ["forest", "node"]).groupBy("forest", "node").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_parents"), F.min("cycle_id").alias("cycle_id"))
    return out.unionByName(lost, allowMissingColumns=True)


def links_in_tree(edges: DataFrame, child: str, parent: str, forest: str) -> DataFrame:
    """Every distinct parent link with ``in_tree``: whether the node hangs under that parent."""
    smallest = F.min("parent").over(Window.partitionBy("forest", "node"))
    return links(edges, child, parent, forest).withColumn("in_tree", F.col("parent") == smallest)


def descendants(tree: DataFrame, beside: DataFrame, scratch: Scratch) -> DataFrame:
    """``(forest, ancestor, node)`` of all proper descendants of the processed nodes of ``tree`` (as from ``hierarchy``).

    Read off the ranges; ``beside`` holds the links ``(forest, node, parent)`` that are not in the tree: what hangs below
    them is added round by round until nothing is new.
    """
    done = tree.filter("cycle_id is null")
    pairs = _pairs(done).select("forest", "ancestor", "node")
    ok = done.select("forest", "node")
    extra = scratch.put(beside.select("forest", "node", "parent").join(ok, ["forest", "node"], "left_semi"))
    if extra.limit(1).count() == 0:
        return pairs
    pairs = scratch.put(pairs)
    self_too = scratch.put(ok.select("forest", F.col("node").alias("ancestor"), "node"))
    n = pairs.count()
    while True:
        every = pairs.unionByName(self_too)
        top = extra.join(every.select("forest", "ancestor", F.col("node").alias("parent")), ["forest", "parent"]).select("forest", "ancestor", "node")
        new = top.join(every.select("forest", F.col("ancestor").alias("node"), F.col("node").alias("below")), ["forest", "node"]).select("forest", "ancestor", F.col("below").alias("node"))
        pairs = scratch.put(pairs.unionByName(new).distinct())
        before, n = n, pairs.count()
        if n == before:
            return pairs


def subtree(tree: DataFrame, forest: str, node: str) -> DataFrame:
    """All nodes in the range of ``node``: one filter on root and range, no recursion."""
    top = tree.filter((F.col("forest") == forest) & (F.col("node") == node) & F.col("cycle_id").isNull()).select("forest", "root", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
    return tree.join(F.broadcast(top), ["forest", "root"]).filter("lo >= lo0 and lo < hi0").drop("lo0", "hi0")
