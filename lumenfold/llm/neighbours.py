"""Most similar vectors for every vector, by multi-index hashing of learned binary codes.

Per model, rotations are learned (principal axes, then the alternating quantisation of iterative rotation fitting, from
different starts) on a bounded sample; every vector becomes a code of 64 signs per rotation.  The codes are split into
substrings, each indexed, and every substring is probed: codes within a Hamming distance below the number of substrings
agree in some substring (pigeonhole) and are retrieved.  A substring has log2(n) bits, so a cell holds a few of n random
codes at every size, and there are as many substrings as it takes for a pair at the threshold to share one with
probability 1 - ``MISS``: bits of two vectors at angle a differ with probability a / pi.  For cosine 0.92 that is about
3.5 n^0.2 substrings.  Pairs whose first 64 bits differ in more places than a pair at the threshold ever does are
dropped inside the join; the rest are reranked with the float vectors.

Cells of more than ``DENSE`` codes (clouds of near copies) are cut into blocks, and every two blocks are compared as a
matrix product in a task of their own that keeps the k best of each row: no cell is one task, and its pairs are not
shuffled.  That is exact, at a cost that grows with the square of the cell.

Exact copies (same direction) are one class: only its representative is indexed, and the result is expanded per
member from at most k + 1 listed members of a class, so a class with a third of all rows costs k rows per member.

Without a threshold the codes are of no use (the k-th neighbour of most vectors lies far beyond any radius worth
probing), so every class is compared with every other: blocks of bounded size are broadcast one after the other, all
classes stream past each as a matrix product, and only k candidates a class and block are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import Scratch

BITS = 64
#: Share of pairs at the threshold that may share no substring.
MISS = 0.02
#: Codes in a cell, and in a block of a larger cell.
DENSE, ROWS = 512, 1024
#: The rotation of a model is learned on at most so many vectors, those with the smallest hash of their id.
SAMPLE = 4096
ROUNDS = 30
#: Numbers (of eight bytes) in a broadcast block, and in the similarities held at a time, of the search without threshold.
BLOCK = 1 << 22
#: Vectors a task compares with a block.
TASK = 2048


def learn_rotation(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to 64 columns) for unit vectors ``x``; fewer than 64 dimensions are padded with random axes."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    dim = x.shape[1]
    _, axes = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(dim))
    axes = axes[:, ::-1][:, :BITS]
    if axes.shape[1] < BITS:
        axes = np.hstack([axes, rng.normal(size=(dim, BITS - axes.shape[1])) / np.sqrt(dim)])
    y = (x - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(ROUNDS if len(x) > 1 else 0):
        u, _, vt = np.linalg.svd(np.sign(y @ turn).T @ y)
        turn = (u @ vt).T
    return mean, axes @ turn


def shape(n: int, min_similarity: float) -> tuple[int, int, int]:
    """(bits of a substring, substrings, greatest distance of the first 64 bits) for n vectors."""
    differ = math.acos(min_similarity) / math.pi
    width = min(40, max(4, math.ceil(math.log2(max(n, 2)))))
    tables = max(1, math.ceil(math.log(MISS) / math.log1p(-((1 - differ) ** width))))
    return width, tables, math.ceil(BITS * differ + 4.5 * math.sqrt(BITS * differ * (1 - differ)))


def encode(x: np.ndarray, turns: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Signs of unit vectors after each rotation, 64 columns per rotation."""
    return np.hstack([(x - mean) @ axes > 0 for mean, axes in turns])


def cells(signs: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Substring values, one column for each substring."""
    cut = signs[:, : width * tables].reshape(len(signs), tables, width)
    return cut @ (1 << np.arange(width, dtype=np.int64))


def usable(df: DataFrame, model: str, key: str, vector: str, dim: str, at: str) -> DataFrame:
    """One row ``(model, key, v)`` per model and key; of several usable vectors the latest, then the greatest, stays.

    Not usable: null, another length than ``dim``, a null, NaN or infinite number in it, or all zero.
    """
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(model).isNotNull() & F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == F.col(dim)) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = df.filter(ok).select(F.col(model).alias("model"), F.col(key).alias("key"), F.struct(F.col(at).alias("at"), v.cast("array<float>").alias("v")).alias("s"))
    return rows.groupBy("model", "key").agg(F.max("s").alias("s")).select("model", "key", F.col("s.v").alias("v"))


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype("float64")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(q: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of s, similarity) of the k rows of ``s`` most similar to each row of ``q``; ties at the end stay in."""
    sims = q @ s.T
    k = min(k, len(s))
    least = np.partition(sims, len(s) - k, axis=1)[:, len(s) - k]
    i, j = np.nonzero(sims >= least[:, None] - 1e-12)
    return i, j, sims[i, j]


def exhaustive(classes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``(id, id2, sim)``: at least the k most similar other classes of every class, by comparison with all."""
    total, numbers = classes.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    n_blocks = max(1, -(-(numbers or 0) // BLOCK))
    spread = classes.select("m", "id", "v").repartition(max(1, -(-total // TASK)), "id")
    parts = []
    for b in range(n_blocks):
        block = classes.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).select("m", "id", "key", "v").toPandas()
        held = scratch.spark.sparkContext.broadcast({m: (g["id"].to_numpy(), g["key"].to_numpy(), _units(g["v"])) for m, g in block.groupby("m")})

        def compare(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            blocks = held.value
            for batch in batches:
                for m, g in batch.groupby("m"):
                    if m not in blocks:
                        continue
                    ids, keys, s = blocks[m]
                    own, x = g["id"].to_numpy(), _units(g["v"])
                    step = max(1, BLOCK // len(s))
                    for at in range(0, len(x), step):
                        i, j, sim = _best(x[at : at + step], s, k + 1)
                        a = own[at : at + step][i]
                        out = pd.DataFrame({"id": a, "id2": ids[j], "sim": np.clip(np.round(sim, 12), -1.0, 1.0), "key": keys[j]})[a != ids[j]]
                        out = out.sort_values(["id", "sim", "key"], ascending=[True, False, True], kind="stable")
                        yield out[out.groupby("id").cumcount() < k][["id", "id2", "sim"]]

        parts.append(scratch.put(spread.mapInPandas(compare, "id long, id2 long, sim double")))
        held.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _indexed(classes: DataFrame, min_similarity: float, radius: int, k: int, scratch: Scratch) -> DataFrame:
    """``(id, id2, sim)`` of the pairs of classes of cosine >= ``min_similarity`` that the index finds, both ways round."""
    index = classes.select("id", "code", F.explode("cells").alias("cell"))
    crowded = scratch.put(index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE))
    some = crowded.limit(1).count() > 0
    open_cells = index.join(crowded, "cell", "left_anti") if some else index
    probes = open_cells.select(F.col("id").alias("id2"), F.col("code").alias("code2"), "cell")
    near = F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= radius
    pairs = open_cells.join(probes, "cell").filter((F.col("id") < F.col("id2")) & near).select("id", "id2").distinct()
    vec = lambda i, v: classes.select(F.col("id").alias(i), F.col("v").alias(v), F.sqrt(_dot("v", "v")).alias(v + "n"))
    sim = F.least(F.round(_dot("v", "v2") / (F.col("vn") * F.col("v2n")), 12), F.lit(1.0))
    close = pairs.join(vec("id", "v"), "id").join(vec("id2", "v2"), "id2").select("id", "id2", sim.alias("sim")).filter(F.col("sim") >= min_similarity)
    if some:
        close = close.unionByName(_crowds(index.join(crowded, "cell"), classes, min_similarity, k))
    close = scratch.put(close)
    both = close.unionByName(close.select(F.col("id2").alias("id"), F.col("id").alias("id2"), "sim"))
    return both.groupBy("id", "id2").agg(F.max("sim").alias("sim")) if some else both


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _crowds(members: DataFrame, classes: DataFrame, min_similarity: float, k: int) -> DataFrame:
    """``(id, id2, sim)``: for each member of a large cell its k best in every block of the cell, if above the threshold."""
    blocks = F.ceil(F.col("n") / ROWS).cast("int")
    placed = members.select("id", "cell", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    each = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "cell", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g["own"] == g["i"]], g[g["own"] == g["j"]]
        out = []
        for a, b in ((left, right), (right, left))[: 1 if g["i"].iloc[0] == g["j"].iloc[0] else 2]:
            if len(a) and len(b):
                x, y, at, to = _units(a["v"]), _units(b["v"]), a["id"].to_numpy(), b["id"].to_numpy()
                i, j, sim = _best(x, y, k + 1)
                keep = (sim >= min_similarity) & (at[i] != to[j])
                found = pd.DataFrame({"id": at[i][keep], "id2": to[j][keep], "sim": np.minimum(np.round(sim[keep], 12), 1.0)}).sort_values(["id", "sim", "id2"], ascending=[True, False, True])
                out.append(found[found.groupby("id").cumcount() < k])
        return pd.concat(out) if out else pd.DataFrame({"id": [], "id2": [], "sim": []})

    return each.join(classes.select("id", "v"), "id").groupBy("cell", "i", "j").applyInPandas(compare, "id long, id2 long, sim double").distinct()


def nearest(df: DataFrame, model: str, key: str, vector: str, dim: str, at: str, scratch: Scratch, k: int = 10, min_similarity: float | None = 0.92) -> DataFrame:
    """``(model, key, neighbour, similarity, rank)``: up to k most similar other keys of the same model.

    Only neighbours of cosine >= ``min_similarity`` are sought (recall measured in the README).  With None every vector gets its k nearest, however far, exactly; that costs the
    square of the number of distinct vectors.  Ties go to the smaller key.  Vectors of one model with different ``dim`` are
    never compared.  Repeats count once; an empty table gives an empty result.
    """
    rows = usable(df, model, key, vector, dim, at).withColumn("dim", F.size("v"))
    rows = scratch.put(rows)
    pick = Window.partitionBy("model", "dim").orderBy(F.xxhash64("key"), "key")
    chosen = rows.select("model", "dim", "key").withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= SAMPLE).select("model", "key")
    sample = rows.join(F.broadcast(chosen), ["model", "key"]).select("model", "dim", "v").toPandas()  # SAMPLE keys a model
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("model", "dim").count().collect()}  # one row a model
    level = min_similarity if min_similarity is not None else 0.92
    shapes = {name: shape(n, level) for name, n in sizes.items()}
    models = {}
    for name, g in sample.groupby(["model", "dim"]):
        width, tables, _ = shapes[name]
        unit = _units(g["v"])
        models[name] = [learn_rotation(unit, seed) for seed in range(-(-width * tables // BITS) if min_similarity is not None else 1)]
    number = {name: i for i, name in enumerate(sorted(models))}
    held = df.sparkSession.sparkContext.broadcast((models, number, shapes))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, number, shapes = held.value
        import hashlib

        for b in batches:
            for name, g in b.groupby(["model", "dim"]):
                x = _units(g["v"])
                unit = (np.round(x, 6) + 0.0).astype("float32")
                signs = encode(x, models[name])
                width, tables, _ = shapes[name]
                place = ((number[name] << 10) + np.arange(tables, dtype=np.int64)) << 40
                own = list(cells(signs, width, tables) + place) if min_similarity is not None else [[]] * len(x)
                first = np.packbits(signs[:, :BITS], axis=1).view(">i8").ravel().astype("int64")
                yield pd.DataFrame({"m": number[name], "model": g["model"].to_numpy(), "key": g["key"].to_numpy(), "code": first, "cells": own, "same": [hashlib.md5(u.tobytes()).hexdigest() for u in unit], "v": g["v"].to_numpy()})

    coded = scratch.put(rows.mapInPandas(code, "m int, model string, key string, code long, cells array<long>, same string, v array<float>"))
    scratch.drop(rows)
    rank = Window.partitionBy("m", "same").orderBy("key")
    heads = coded.select("m", "same", "key").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1).groupBy("m", "same").agg(F.array_sort(F.collect_list("key")).alias("heads"))
    found = coded.groupBy("m", "same").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    classes = scratch.put(found.join(heads, ["m", "same"]).join(coded.select("m", "key", "code", "cells", "v"), ["m", "key"]).withColumn("id", F.monotonically_increasing_id()))

    if min_similarity is None:
        both = exhaustive(classes, k, scratch)
    else:
        both = _indexed(classes, min_similarity, shape(2, min_similarity)[2], k, scratch)
    lists = both.join(classes.select(F.col("id").alias("id2"), F.slice("heads", 1, k).alias("heads")), "id2").select("id", "sim", F.explode("heads").alias("neighbour"))
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    outside = lists.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "sim"))).alias("outside"))
    empty = F.array().cast("array<struct<r:int,neighbour:string,sim:double>>")
    info = classes.select("id", "m", "same", "n", "heads").join(outside, "id", "left").filter("n > 1 or outside is not null").select("m", "same", F.when(F.col("n") > 1, F.col("heads")).otherwise(F.array().cast("array<string>")).alias("heads"), F.coalesce("outside", empty).alias("outside"))
    own = F.transform(F.array_remove("heads", F.col("key")), lambda h: F.struct(h.alias("neighbour"), F.lit(1.0).alias("sim")))
    far = F.transform("outside", lambda s: F.struct(s["neighbour"].alias("neighbour"), s["sim"].alias("sim")))
    full = coded.select("m", "model", "same", "key").join(info, ["m", "same"]).select("model", "key", F.posexplode(F.slice(F.concat(own, far), 1, k)).alias("i", "s"))
    return full.select("model", "key", F.col("s.neighbour").alias("neighbour"), F.col("s.sim").alias("similarity"), (F.col("i") + 1).alias("rank"))
