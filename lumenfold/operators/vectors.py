"""Vector reads, similarity, novelty and centroids, on ``array<float>`` columns with sums in double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType
from pyspark.sql.window import Window

from lumenfold.session import Scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v scaled to length 1; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def vectors(meta: DataFrame, model: str, exclude: DataFrame | None = None, versions: list[str] | None = None) -> DataFrame:
    """Usable vectors of one model as unit vectors, one per chunk, without the chunks in ``exclude``."""
    v = meta.filter((F.col("model_id") == model) & F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")))
    if versions is not None:
        v = v.filter(F.col("document_version_id").isin(versions))
    if exclude is not None:
        v = v.join(exclude.select("chunk_id"), "chunk_id", "left_anti")
    out = v.select("chunk_id", "document_version_id", unit(F.col("vector")).alias("u")).filter("u is not null")
    return out.groupBy("chunk_id").agg(F.max(F.struct("document_version_id", "u")).alias("s")).select("chunk_id", "s.document_version_id", "s.u")


def counts(meta: DataFrame) -> DataFrame:
    return meta.filter("vector is not null").groupBy("model_id").agg(F.count_distinct("chunk_id").alias("vectors"), F.count_distinct("dim").alias("dims"))


def top_k(store: DataFrame, query: list[float], k: int = 10, min_score: float = 0.0) -> DataFrame:
    """The k chunks most similar to one query vector; of equal scores the smaller chunk id wins."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.select("chunk_id", "document_version_id", clamp(dot(F.col("u"), unit(q))).alias("score")).filter(F.col("score") >= min_score).orderBy(F.desc("score"), "chunk_id").limit(k)


#: Numbers in a broadcast block of vectors, and vectors a task compares with a block.
BLOCK, TASK = 1 << 22, 2048


def _matrix(u: pd.Series) -> np.ndarray:
    return np.stack(u.to_numpy()).astype("float64")


def _past_blocks(held: DataFrame, stream: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, scratch: Scratch) -> DataFrame:
    """``compare(block, batch)`` for every block of ``held`` and every batch of ``stream``, as matrix products.

    Blocks hold at most BLOCK numbers and are broadcast one after the other, so what is broadcast does not grow with the
    data; the results of each block are written before the next.
    """
    n, numbers = held.agg(F.count(F.lit(1)), F.sum(F.size("u"))).first()
    blocks = max(1, -(-(numbers or 0) // BLOCK))
    spread = stream.repartition(max(1, -(-stream.count() // TASK)), "chunk_id")
    parts = []
    for k in range(blocks if n else 0):
        rows = held.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == k).toPandas()
        if rows.empty:
            continue
        sent = scratch.spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield compare(sent.value, b)

        parts.append(scratch.put(spread.mapInPandas(run, schema)))
        sent.unpersist()
    out = parts[0] if parts else spread.mapInPandas(lambda batches: iter(()), schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def novelty(store: DataFrame, scratch: Scratch) -> DataFrame:
    """1 - the greatest similarity of a version's chunks to chunks of other versions, for every version.

    Every chunk is compared with every block of the store and keeps one number a block; without other chunks novelty is 1
    and not comparable.
    """

    def nearest(block: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        sims = _matrix(batch["u"]) @ _matrix(block["u"]).T
        other = batch["document_version_id"].to_numpy()[:, None] != block["document_version_id"].to_numpy()[None, :]
        best = np.where(other, sims, -np.inf).max(1)
        return pd.DataFrame({"document_version_id": batch["document_version_id"], "s": best})[np.isfinite(best)]

    own = store.select("chunk_id", "document_version_id", "u")
    best = _past_blocks(own, own, nearest, "document_version_id string, s double", scratch).groupBy("document_version_id").agg(F.max("s").alias("s"))
    out = store.select("document_version_id").distinct().join(best, "document_version_id", "left")
    return out.select("document_version_id", (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0))))).alias("novelty"), F.col("s").isNotNull().alias("comparable"))


def record_novelty(event: DataFrame, version: DataFrame, found: DataFrame, model: str) -> DataFrame:
    """Events with the novelty of their source's least novel version; only comparable values are recorded, and an event keeps
    what it had where there is none."""
    per = version.select(F.col("id").alias("document_version_id"), "source_id").distinct().join(found.filter("comparable"), "document_version_id").groupBy("source_id").agg(F.min("novelty").alias("fresh"))
    e = event.join(per, "source_id", "left")
    return e.withColumn("novelty", F.coalesce("fresh", "novelty")).withColumn("novelty_model_id", F.when(F.col("fresh").isNotNull(), F.lit(model)).otherwise(F.col("novelty_model_id"))).drop("fresh")


def top_k_each(store: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the k chunks most similar to each chunk in ``queries`` (itself left out)."""

    def best(block: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        sims = np.clip(np.round(_matrix(block["u"]) @ _matrix(batch["u"]).T, 12), -1.0, 1.0)
        q, c = block["chunk_id"].to_numpy(), batch["chunk_id"].to_numpy()
        at = min(k + 1, sims.shape[1])
        least = np.partition(sims, sims.shape[1] - at, axis=1)[:, sims.shape[1] - at]
        i, j = np.nonzero(sims >= np.maximum(least, min_score)[:, None])
        out = pd.DataFrame({"query_id": q[i], "chunk_id": c[j], "score": sims[i, j]})
        out = out[out["query_id"] != out["chunk_id"]].sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
        return out[out.groupby("query_id").cumcount() < k]

    near = _past_blocks(queries.select("chunk_id", "u"), store.select("chunk_id", "u"), best, "query_id string, chunk_id string, score double", scratch)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def put(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vector rows after an upsert by (chunk, model): the incoming row replaces the stored one; of several incoming rows of
    one key the one computed last stays.  Rows without a vector or of another length than ``dim`` are refused."""
    cols = ["document_version_id", "dim", "vector", "computed_at"]
    bad = F.col("vector").isNull() | (F.size("vector") != F.col("dim"))
    rows = existing.select("chunk_id", "model_id", *cols, F.lit(0).alias("_n")).unionByName(incoming.filter(~bad).select("chunk_id", "model_id", *cols, F.lit(1).alias("_n")))
    return rows.groupBy("chunk_id", "model_id").agg(F.max_by(F.struct(*cols), F.struct("_n", "computed_at", "vector")).alias("r")).select("chunk_id", "model_id", "r.*")


def guard_one_model(meta: DataFrame) -> DataFrame:
    """``(models, mixed)``: vectors of several models cannot be compared."""
    return meta.filter("vector is not null").agg(F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("models"), (F.count_distinct("model_id") > 1).alias("mixed"))


@F.pandas_udf(BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def _from_blob(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))


def from_blob(blob: Column, dim: Column) -> Column:
    """The vector of a blob; a blob of another length than ``dim`` fails the job."""
    return F.when(F.octet_length(blob) == 4 * dim, _from_blob(blob)).when(blob.isNotNull(), F.raise_error(F.lit("blob of another length")).cast("array<float>"))


def centroids(store: DataFrame, mention: DataFrame) -> DataFrame:
    """Mean direction of the distinct chunks that mention each concept, as a unit vector.

    Vectors are summed in two steps, by concept and hash of the chunk and then by concept, element by element inside the
    row, so a frequent concept is summed in many tasks and no row is made per dimension.
    """
    m = mention.filter("concept_id is not null").select("concept_id", "chunk_id").distinct()
    rows = m.join(store.select("chunk_id", "u"), "chunk_id").select("concept_id", "u", F.pmod(F.xxhash64("chunk_id"), F.lit(64)).alias("b"))
    add = lambda c: F.aggregate(F.collect_list(c), F.array().cast("array<double>"), lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda a, b: a + b)))
    part = rows.groupBy("concept_id", "b", F.pmod(F.xxhash64("u"), F.lit(8)).alias("b2")).agg(add("u").alias("u")).groupBy("concept_id", "b").agg(add("u").alias("u"))
    return part.groupBy("concept_id").agg(add("u").alias("u")).select("concept_id", unit(F.col("u")).alias("u")).filter("u is not null")


def neighbour_concepts(centroid: DataFrame, coverage: DataFrame, concept: DataFrame, well: int = 2, thin: int = 1, min_similarity: float = 0.3, anchors: int = 20, targets: int = 200, limit: int = 10) -> DataFrame:
    """Thinly covered concepts near well covered ones: at most 20 anchors and 200 targets, best anchor per target."""
    c = centroid.join(coverage.select("concept_id", "distinct_sources"), "concept_id", "left")
    a = c.filter(F.col("distinct_sources") >= well).orderBy(F.desc("distinct_sources"), "concept_id").limit(anchors)
    t = c.join(concept.filter("scheme <> 'local'").select(F.col("id").alias("concept_id")), "concept_id").filter(F.coalesce("distinct_sources", F.lit(0)) <= thin).orderBy("concept_id").limit(targets)
    pair = t.select("concept_id", "u").join(F.broadcast(a.select(F.col("concept_id").alias("anchor_id"), F.col("u").alias("q"))), F.col("concept_id") != F.col("anchor_id"))
    pair = pair.select("concept_id", "anchor_id", clamp(dot(F.col("u"), F.col("q"))).alias("similarity")).filter(F.col("similarity") >= min_similarity)
    w = Window.partitionBy("concept_id").orderBy(F.desc("similarity"), "anchor_id")
    return pair.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").orderBy(F.desc("similarity"), "concept_id").limit(limit)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal_search(rows: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """Rows whose text holds the query, ASCII letters compared without case, by key."""
    hit = rows.filter(ascii_lower(F.col(text)).contains(ascii_lower(F.lit(query)))).select(key, F.lit(1.0).alias("score")).distinct().orderBy(key)
    return hit.limit(limit) if limit else hit


#: FNV-1a of 32 bits, and the seeds of the two hash functions of the embedder.
FNV_PRIME, SEED_1, SEED_2 = 16777619, 0x811C9DC5, 0x1000193


def hash32(word: Column, seed: int) -> Column:
    """FNV-1a over the code points of a word (the UTF-16 units inside the basic plane)."""
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """Deterministic text vectors in sparse form ``(key, i, x)``, of unit length per key."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    n = rows.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    weight = 1 + F.ln("n")
    slots = F.array(F.struct((hash32(F.col("w"), SEED_1) % dim).alias("i"), weight.alias("x")), F.struct((hash32(F.col("w"), SEED_2) % dim).alias("i"), (-0.5 * weight).alias("x")))
    sums = n.select(key, F.explode(slots).alias("s")).groupBy(key, F.col("s.i").alias("i")).agg(F.sum("s.x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return sums.withColumn("x", F.try_divide(F.col("x"), length)).filter("x is not null")


def rebuilt(existing: DataFrame, fresh: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows after a rebuild of a scope: all rows of the keys in ``scope`` are replaced by the fresh ones."""
    return existing.join(scope.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def semantic_search(index: DataFrame, query: str, dim: int = 128, limit: int = 10) -> DataFrame:
    """``(chunk_id, score)``: the chunks whose sparse embedding (``hash_embedding`` with key chunk_id) is most similar to that
    of the query text; only the slots of the query are joined."""
    spark = index.sparkSession
    q = hash_embedding(spark.createDataFrame([("q", query)], "k string, t string"), "k", F.col("t"), dim).select("i", F.col("x").alias("y"))
    hits = index.join(F.broadcast(q), "i").groupBy("chunk_id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    return hits.filter("score > 0").orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(limit)
