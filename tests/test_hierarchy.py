from __future__ import annotations

import random

from lumenfold.operators import hierarchy as H

SCHEMA = "f string, c string, p string, depth long"


def build(spark, scratch, pairs):
    df = spark.createDataFrame([("r", a, b, 9) for a, b in pairs], SCHEMA)
    return {r["node"]: r for r in H.hierarchy(df, "c", "p", "f", scratch).collect()}


def brute(pairs):
    up = {}
    for a, b in pairs:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    nodes = set(up) | {b for a, b in pairs if a is not None and b is not None}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        reach[n] = seen
    on = {n for n in nodes if n in reach[n]}
    out = {}
    for n in nodes:
        hit = (reach[n] | {n}) & on
        if hit:
            out[n] = ("cycle", min(hit))
        else:
            path = [n]
            while path[-1] in up:
                path.append(min(up[path[-1]]))
            out[n] = ("tree", path[::-1])
    return out


def verify(got, pairs):
    want = brute(pairs)
    assert set(got) == set(want)
    for n, (kind, x) in want.items():
        r = got[n]
        if kind == "cycle":
            assert r["cycle_id"] == x and r["path"] is None
        else:
            assert r["cycle_id"] is None and r["path"] == x and r["depth"] == len(x) - 1 and r["root"] == x[0]
            below = {m for m, (k, y) in want.items() if k == "tree" and n in y}
            assert r["size"] == len(below)
            assert below == {m for m in got if got[m]["root"] == r["root"] and got[m]["lo"] is not None and r["lo"] <= got[m]["lo"] < r["hi"]}


def test_small_shapes(spark, scratch):
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "b"), ("x", "x"), ("y", "x"), ("p", "q"), ("q", "s"), ("s", "p"), ("t", "s"), (None, "a"), ("z", None), ("d", "c")]
    verify(build(spark, scratch, pairs), pairs)


def test_random_forest_with_deep_chain_and_cycles(spark, scratch):
    rng = random.Random(3)
    pairs = [(f"n{i:03}", f"n{rng.randrange(i):03}") for i in range(1, 60)] + [(f"k{i:03}", f"k{i - 1:03}") for i in range(1, 70)] + [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [(f"d{i}", f"c{i % 7}") for i in range(9)]
    got = build(spark, scratch, pairs)
    verify(got, pairs)


def test_empty(spark, scratch):
    assert build(spark, scratch, []) == {}


def test_several_parents_and_cycles_through_the_larger(spark, scratch):
    pairs = [("b", "a"), ("c", "b"), ("a", "0"), ("a", "c"), ("d", "c"), ("e", "0"), ("e", "z"), ("f", "e"), ("f", "y"), ("g", "f"), ("x", "x"), ("w", "0"), ("w", "x"), ("v", "w")]
    verify(build(spark, scratch, pairs), pairs)
    got = build(spark, scratch, pairs)
    assert got["a"]["cycle_id"] == got["d"]["cycle_id"] == "a" and got["v"]["cycle_id"] == "x" and got["f"]["n_parents"] == 2


def test_random_graphs_of_several_parents(spark, scratch):
    for seed, n, m in ((1, 30, 40), (4, 24, 26)):
        rng = random.Random(seed)
        pairs = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)] if seed == 1 else [(f"n{i:02}", f"n{rng.randrange(i):02}") for i in range(1, n) for _ in range(2)] + [("n00", "n09")] * (seed == 9)
        verify(build(spark, scratch, pairs), pairs)


def test_descendants_by_other_parents(spark, scratch):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("c", "q"), ("q", "p"), ("e", "d"), ("e", "z")]
    df = spark.createDataFrame([("r", a, b, 1) for a, b in pairs], SCHEMA)
    tree = H.hierarchy(df, "c", "p", "f", scratch)
    beside = H.links_in_tree(df, "c", "p", "f").filter("not in_tree")
    assert sorted((r.node, r.parent) for r in beside.collect()) == [("c", "q"), ("e", "z")]
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    want = set()
    for x in "abcdeqpz":
        todo = list(up.get(x, ()))
        while todo:
            y = todo.pop()
            want.add((y, x))
            todo += up.get(y, ())
    got = [(r.ancestor, r.node) for r in H.descendants(tree, beside, scratch).collect()]
    assert set(got) == want and len(got) == len(want)


def test_descendants_and_subtree(spark, scratch):
    df = spark.createDataFrame([("r", a, b, 1) for a, b in [("b", "a"), ("c", "b"), ("d", "a")]], SCHEMA)
    tree = H.hierarchy(df, "c", "p", "f", scratch)
    assert sorted((r.ancestor, r.node) for r in H.descendants(tree, df.filter("false").selectExpr("f as forest", "c as node", "p as parent"), scratch).collect()) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")]
    assert sorted(r.node for r in H.subtree(tree, "r", "b").collect()) == ["b", "c"]
