"""Mixing sources to target weights by min-cost flow over membership patterns.

A text may occur in several sources, so texts are aggregated by the set of listed sources that hold them.  Token
capacity flows from patterns to source quotas; the r-th use of a text costs r - 1, which makes repetition convex, and a
pattern can be used as often as its most permissive source allows, for one source as often as that source allows.  The
network has one node per pattern and source and is solved on the driver; its size depends on the number of sources, not
on the texts.  Selection then lays the texts of a pattern on a ring in seeded order and gives each source a run of it;
a text is used once per time its position falls into the run, so no document is divided and every source is met up to
one text per run.  Positions are two-level prefix sums over hash buckets whose number grows with the data.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import Scratch

#: Texts per bucket of the prefix sum.
BUCKET = 20_000


class Flow:
    """Successive cheapest paths on integer capacities; Bellman-Ford labels suffice for a few hundred arcs."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # [to, room, cost]; arc i and i ^ 1 are each other's reverse
        self.out: dict[object, list[int]] = defaultdict(list)

    def add(self, a: object, b: object, room: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, room, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, s: object, t: object) -> int:
        total = 0
        while True:
            dist, via, queue = {s: 0}, {}, [s]
            while queue:
                nxt = []
                for a in queue:
                    for i in self.out[a]:
                        b, room, cost = self.arcs[i]
                        if room > 0 and dist[a] + cost < dist.get(b, 1 << 60):
                            dist[b], via[b] = dist[a] + cost, i
                            nxt.append(b)
                queue = nxt
            if t not in dist:
                return total
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.arcs[via[b] ^ 1][0]
            room = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= room
                self.arcs[i ^ 1][1] += room
            total += room


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Largest flow of least repetition: tokens of each pattern given to each source."""
    f, given = Flow(), {}
    for p, tokens in patterns.items():
        for r in range(max(repeats[s] for s in p)):
            f.add("from", ("p", p), tokens, r)
        for s in p:
            given[p, s] = f.add(("p", p), ("s", s), tokens * repeats[s], 0)
    for s, q in quotas.items():
        f.add(("s", s), "to", q, 0)
    total = f.run("from", "to")
    return total, {k: f.arcs[i ^ 1][1] for k, i in given.items() if f.arcs[i ^ 1][1]}


def plan(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, dict]:
    """Total tokens and routed flow.  Without ``total``: the largest at which every source that has texts meets its share."""
    have = {s for p, t in patterns.items() if t for s in p}
    quota = lambda n: {s: int(shares[s] * n) for s in have}
    if not have:
        return 0, {}
    if total is None:
        lo, hi = 0, sum(t * max(repeats[s] for s in p) for p, t in patterns.items()) * 2 + 1
        while hi - lo > max(1, lo // 1_000_000):
            mid = (lo + hi) // 2
            q = quota(mid)
            if route(patterns, q, repeats)[0] == sum(q.values()):
                lo = mid
            else:
                hi = mid
        total = lo
    return total, route(patterns, quota(total), repeats)[1]


def mixture(texts: DataFrame, targets: DataFrame, scratch: Scratch, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Chosen texts ``(source, doc_id, n_tokens, uses)`` and shares ``(source, target_share, tokens, share, texts, most_uses)``.

    ``texts`` has ``(doc_id, source, key, n_tokens)``, key being equal for equal texts; of equal texts the smallest
    doc_id stands for all, so a text captured twice counts as one.  Rows with null source, with a source no target
    lists, with null text (key) or no tokens give nothing; a target of no texts is reported with 0 tokens.  A target
    listed twice, with null or non-positive share or fewer than one use counts as its largest share and uses or not
    at all.  Without ``total`` the mixture is the largest in which every source that has texts meets its share.
    """
    spark = texts.sparkSession
    listed = {r[0]: (r[1], r[2]) for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()}
    usable = texts.filter(F.col("source").isin(*listed) & F.col("key").isNotNull() & (F.col("n_tokens") > 0)) if listed else texts.filter("false")
    units = scratch.put(
        usable.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set("source")).alias("pattern")).withColumn("place", F.xxhash64("key", F.lit(seed)))
    )
    sums = units.groupBy("pattern").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()  # one row per set of sources
    patterns = {tuple(r[0]): int(r[1]) for r in sums}
    size, flow = plan(patterns, {s: v[0] for s, v in listed.items()}, {s: v[1] for s, v in listed.items()}, total)
    runs, at = [], defaultdict(int)
    for (p, s), tokens in sorted(flow.items()):
        runs.append((list(p), s, at[p], at[p] + tokens, patterns[p]))
        at[p] += tokens
    runs_df = F.broadcast(spark.createDataFrame(runs, "pattern array<string>, source string, lo long, hi long, ring long"))
    buckets = max(16, sum(r[2] for r in sums) // BUCKET)
    placed = units.withColumn("b", F.pmod(F.shiftrightunsigned("place", 8), F.lit(buckets)))
    before = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("pattern", "b").agg(F.sum("n_tokens").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inner = Window.partitionBy("pattern", "b").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.withColumn("o", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(base, ["pattern", "b"]).withColumn("at", F.col("base") + F.col("o"))
    laps = lambda c: F.ceil((F.col(c) - F.col("at")) / F.col("ring"))
    chosen = start.join(runs_df, "pattern").withColumn("uses", (laps("hi") - laps("lo")).cast("int")).filter("uses > 0").select("source", "doc_id", "n_tokens", "uses")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    target = spark.createDataFrame([(s, float(v[0]), int(v[1]), int(v[0] * size)) for s, v in sorted(listed.items())], "source string, target_share double, max_repeats int, target_tokens long")
    whole = Window.partitionBy()
    shares = F.broadcast(target).join(got, "source", "left").select("source", "target_share", "max_repeats", "target_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    return chosen, shares.withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(whole)), F.lit(0.0)))
