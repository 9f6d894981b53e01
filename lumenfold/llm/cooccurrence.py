"""Items that appear together, by collapsing identical baskets.

1.  Items get dense ids ordered by frequency, rarest first.  2.  Baskets are deduplicated id arrays; identical arrays
are collapsed to one with a weight.  3.  Each distinct basket sends, for each item, the array of its more frequent
partners to the task of that item: a pair is shuffled as one id, and a frequent item has few partners, so no item's
task outgrows the others.  4.  Weights are summed per pair inside that partitioning, without another shuffle; pairs of the few items
that hold a large share of all places are summed in many tasks.  Pairs are scored by lift and conviction.

With a minimum of shared baskets and a minimum lift, items in more than baskets / lift baskets cannot take part in any
pair and are left out before pairs are made; this is exact, as shared <= the smaller count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

#: A dictionary of at most so many items is broadcast; larger ones are joined by shuffle.
BROADCAST_ITEMS = 100_000
#: Items that hold more than 1 / HOT of all places in baskets are summed in many tasks.
HOT = 500
#: Baskets of more rows than this are kept as blocks of about this many items.
BLOCK = 4_096


def dictionary(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(item, code, rows)`` with dense codes 0.. in order of (rows, item)."""
    ranked = scratch.put(rows.filter("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("rows")).orderBy("rows", "item").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("p")).count().collect())  # one row per partition
    starts, n = [], 0
    for p, k in sizes:
        starts.append((p, n))
        n += k
    first = F.create_map(*[x for p, s in starts for x in (F.lit(p), F.lit(s))])[part] if starts else F.lit(0)
    return scratch.put(ranked.select("item", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("code"), "rows"))


def _encode(rows: DataFrame, codes: DataFrame) -> DataFrame:
    n, total = codes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    both = codes.select("item", "code")
    if n <= BROADCAST_ITEMS:
        return rows.join(F.broadcast(both), "item", "left").select("basket", "code")
    hot_from = max(100_000, (total or 0) // 1000)  # at most 1,000 items
    hot = codes.filter(F.col("rows") > hot_from).select("item", "code")
    flagged = rows.join(F.broadcast(hot.withColumnRenamed("code", "hot")), "item", "left")
    cold = flagged.filter("hot is null").join(codes.filter(F.col("rows") <= hot_from).select("item", "code"), "item", "left").select("basket", "code")
    return cold.unionByName(flagged.filter("hot is not null").select("basket", F.col("hot").alias("code")))


def cooccurrence(df: DataFrame, basket: str, item: str, scratch: Scratch, min_shared: int = 1, min_lift: float | None = None) -> DataFrame:
    """``(item_a, item_b, n_a, n_b, n_ab, n_baskets, lift, conviction)`` of every pair that shares a basket, a < b.

    Counts are of distinct baskets.  Rows without a basket are ignored, rows without an item only count their
    basket.  ``conviction`` is that of the rule from the rarer to the more frequent item, null where it is infinite.
    Repeats count once; an empty table gives an empty result.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket is not null")
    codes = dictionary(rows, scratch)
    coded = _encode(rows, codes)
    sizes = rows.groupBy("basket").count().filter(F.col("count") > BLOCK)
    big = scratch.put(sizes.select("basket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    n_big = big.count()
    if n_big:
        big_side = F.broadcast(big) if n_big <= BROADCAST_ITEMS else big
        coded = coded.join(big_side, "basket", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("code"), F.col("blocks"))).cast("int"))
    else:
        coded = coded.withColumn("block", F.lit(0)).withColumn("blocks", F.lit(None).cast("int"))
    sets = scratch.put(coded.groupBy("basket", "block").agg(F.collect_set("code").alias("codes"), F.max("blocks").alias("blocks")))
    n = sets.agg(F.count_distinct("basket") if n_big else F.count(F.lit(1))).first()[0]
    counts = scratch.put(sets.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    keep = F.col("codes")
    if min_lift:
        # Counts add up to baskets * (mean basket size), so at most lift * (mean basket size) items lie above this bound.
        often = [r[0] for r in counts.filter(F.col("n") * F.lit(min_lift) > n).select("code").collect()]
        if often:
            keep = F.array_except("codes", F.array(*[F.lit(x).cast("long") for x in often]))
    sets = sets.select("basket", "block", "blocks", F.array_sort(keep).alias("codes"))

    small = sets.filter("blocks is null and size(codes) > 1").groupBy("codes").agg(F.count(F.lit(1)).alias("w"))
    sends = small.select("w", "codes", F.posexplode("codes").alias("i", "a")).filter(F.col("i") < F.size("codes") - 1).select("a", F.slice("codes", F.col("i") + 2, F.size("codes")).alias("more"), "w")
    if n_big:
        blocks = sets.filter("blocks is not null")
        other = blocks.select("basket", F.col("codes").alias("codes2"))
        wide = blocks.join(other, "basket").select("codes2", F.explode("codes").alias("a")).select("a", F.filter("codes2", lambda x: x > F.col("a")).alias("more"), F.lit(1).cast("long").alias("w")).filter("size(more) > 0")
        sends = sends.unionByName(wide)
    # Items in more than this share of all (basket, item) places, at most HOT of them, send to many tasks instead of one.
    places = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") * HOT > places).select(F.col("code").alias("a")))
    summed = lambda rows: rows.select("a", F.explode("more").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("n_ab"))
    pairs = summed(sends.join(hot, "a", "left_anti").repartition("a")).unionByName(summed(sends.join(hot, "a", "left_semi"))).filter(F.col("n_ab") >= min_shared)

    named = counts.join(codes, "code").select("code", "item", "n")
    side = lambda c: named.select(F.col("code").alias(c), F.col("item").alias("item_" + c), F.col("n").alias("n_" + c))
    out = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n_baskets", F.lit(n).cast("long"))
    if min_lift:
        out = out.filter(F.col("n_ab") * F.col("n_baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    conviction = F.try_divide(F.col("n_a") * (F.col("n_baskets") - F.col("n_b")) / F.col("n_baskets"), (F.col("n_a") - F.col("n_ab")).cast("double"))
    swap = F.col("item_a") > F.col("item_b")
    return out.select(
        F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n_ab", "n_baskets", lift.alias("lift"), conviction.alias("conviction"),
    )
