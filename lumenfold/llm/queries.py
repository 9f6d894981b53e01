"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.boilerplate import extract
from lumenfold.llm.chunks import chunk
from lumenfold.llm.components import components
from lumenfold.llm.cooccurrence import cooccurrence
from lumenfold.llm.mixture import mixture
from lumenfold.llm.mojibake import recover
from lumenfold.llm.neighbours import nearest
from lumenfold.llm.packing import containers
from lumenfold.llm.tokens import n_tokens
from lumenfold.session import Scratch
from lumenfold.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "edge").filter("relation = 'user_linked'")
    return components(linked, "from_concept", "to_concept", Scratch(spark, "groups")).select(F.col("id").alias("concept_id"), "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence(table(spark, d, "mention"), "chunk_id", "concept_id", Scratch(spark, "pairs"), min_shared=5, min_lift=10)
    return pairs.select(F.col("item_a").alias("concept_a"), F.col("item_b").alias("concept_b"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of concepts with its counts, beside the weight that an edge of co_occurs records for it."""
    pairs = cooccurrence(table(spark, d, "mention"), "chunk_id", "concept_id", Scratch(spark, "pairs"))
    a, b = F.least("from_concept", "to_concept"), F.greatest("from_concept", "to_concept")
    known = table(spark, d, "edge").filter("relation = 'co_occurs'").groupBy(a.alias("item_a"), b.alias("item_b")).agg(F.max("weight").alias("edge_weight"))
    return pairs.join(known, ["item_a", "item_b"], "left").select(
        F.col("item_a").alias("concept_a"), F.col("item_b").alias("concept_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), "edge_weight"
    )


def _nearest(spark: SparkSession, d: str, **how: float | None) -> DataFrame:
    return nearest(table(spark, d, "embedding_meta"), "model_id", "chunk_id", "vector", "dim", "computed_at", Scratch(spark, "nearest"), **how)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select(F.col("model").alias("model_id"), F.least("key", "neighbour").alias("chunk_a"), F.greatest("key", "neighbour").alias("chunk_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every usable vector, however far they are."""
    return _nearest(spark, d, min_similarity=None).select(F.col("model").alias("model_id"), F.col("key").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", n_tokens(F.col("text")).alias("n"))
    return containers(docs, "doc_id", "n", Scratch(spark, "pack")).withColumnRenamed("id", "doc_id")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing: every text has its place, no container is over its capacity, only texts above it are
    divided and into adjoining pieces, and the containers are at most one per cent more than the tokens need."""
    scratch = Scratch(spark, "packed")
    packed = scratch.put(p8_containers(spark, d))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("n"), F.count_distinct("piece").alias("numbers"), F.max(F.col("start") + F.col("size")).alias("end"))
    bins = packed.filter("container is not null").groupBy("container").agg(F.sum("size").alias("n"), F.max("fill").alias("fill"))
    a = docs.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("wrongly_divided"), F.count_if((F.col("numbers") != F.col("pieces")) | (F.col("end") != F.col("n"))).alias("with_gaps"), F.sum("n").alias("tokens")).withColumn("k", F.lit(1))
    b = bins.agg(F.count_if(F.col("n") > 2048).alias("overfull"), F.count_if(F.col("n") != F.col("fill")).alias("misreported"), F.count(F.lit(1)).alias("containers")).withColumn("k", F.lit(1))
    tight = F.coalesce(F.col("containers") <= F.ceil(F.col("tokens") / 2048) * 1.01 + 1, F.lit(True))
    return a.join(b, "k").select("texts", "wrongly_divided", "with_gaps", "overfull", "misreported", tight.alias("tight"))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: every target is reported, no text is used more than its source allows or under a source
    that does not hold it, and each source with texts has its tokens and at most one text more for each set of sources that
    its texts are in."""
    chosen, shares = _mixture(spark, d)
    scratch = Scratch(spark, "mixed")
    chosen, shares = scratch.put(chosen), scratch.put(shares)
    texts = table(spark, d, "documents").filter("text <> ''").select(F.sha2("text", 256).alias("key"), "doc_id", "source")
    holds = texts.join(texts.select("doc_id", "key").withColumnRenamed("doc_id", "first"), "key").select(F.col("first").alias("doc_id"), "source").distinct()
    strange = chosen.join(holds, ["doc_id", "source"], "left_anti").agg(F.count(F.lit(1)).alias("strange")).withColumn("k", F.lit(1))
    sets = texts.groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("pattern")).select("pattern", F.explode("pattern").alias("source")).groupBy("source").agg(F.count_distinct("pattern").alias("runs"))
    most = chosen.groupBy("source").agg(F.max("n_tokens").alias("most"))
    excess = F.col("tokens") - F.col("target_tokens")
    off = shares.filter("tokens > 0").join(most, "source").join(sets, "source").filter((excess < 0) | (excess > F.col("most") * F.col("runs"))).agg(F.count(F.lit(1)).alias("off_target")).withColumn("k", F.lit(1))
    over = chosen.join(F.broadcast(shares.select("source", "max_repeats")), "source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("overused")).withColumn("k", F.lit(1))
    n = shares.agg(F.count(F.lit(1)).alias("targets")).withColumn("k", F.lit(1))
    return n.join(over, "k").join(strange, "k").join(off, "k").drop("k")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "mix")
    # Written first, so that no later filter counts the tokens of a text a second time.
    docs = scratch.put(table(spark, d, "documents").filter("text <> ''").select("doc_id", "source", F.sha2("text", 256).alias("key"), n_tokens(F.col("text")).alias("n_tokens")))
    return mixture(docs, table(spark, d, "mix_target"), scratch)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk(table(spark, d, "document_version").select("id", "text"), "id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).filter("kind = 'paragraph'").select(F.col("key").alias("document_version_id"), "start_char")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).filter("kind = 'piece'").select(F.col("key").alias("document_version_id"), "ordinal", "start_char", "end_char", "section_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fetched = table(spark, d, "fetched_document").filter("fetch_id is not null")
    versions = table(spark, d, "document_version")
    key = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string")).alias("key")
    pages = fetched.select(key("f", "fetch_id"), "body", F.coalesce(F.col("content_type").startswith("text/html"), F.col("body").rlike("(?i)<html")).alias("markup"))
    pages = pages.unionByName(versions.filter("producer = 'rawstrip'").select(key("v", "id"), F.col("text").alias("body"), F.lit(False).alias("markup")))
    out = extract(pages, "key", "body", "markup", versions.filter("producer <> 'rawstrip'"), "text", Scratch(spark, "pages"))
    kind = F.when(F.col("key").startswith("f"), "fetched_document").otherwise("document_version")
    return out.select(kind.alias("record_table"), F.expr("substr(key, 2)").alias("record_id"), "line_no")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return recover(table(spark, d, "documents"), "doc_id", "text", Scratch(spark, "encoding")).filter("found").select(F.col("key").alias("doc_id"))


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The damaged documents with their text as far as restored."""
    return recover(table(spark, d, "documents"), "doc_id", "text", Scratch(spark, "encoding")).filter("found").select(F.col("key").alias("doc_id"), "text", "codecs", "lost")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_pieces, p4_found, p5_found, p5_pairs, p6_found, p6_neighbours, p8_containers, p8_invariants, p9_mixture, p9_shares, p9_invariants, p10_found, p10_repaired)}

_P5 = """
WITH m AS (SELECT DISTINCT chunk_id, concept_id FROM mention WHERE chunk_id IS NOT NULL),
t AS (SELECT count(DISTINCT chunk_id) AS n FROM m),
c AS (SELECT concept_id, count(*) AS k FROM m WHERE concept_id IS NOT NULL GROUP BY 1),
p AS (SELECT a.concept_id AS concept_a, b.concept_id AS concept_b, count(*) AS n_ab FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.concept_id < b.concept_id GROUP BY 1, 2),
s AS (SELECT p.*, ca.k AS n_a, cb.k AS n_b, t.n FROM p JOIN c ca ON ca.concept_id = concept_a JOIN c cb ON cb.concept_id = concept_b, t)
"""
_P6 = """
WITH v AS (SELECT DISTINCT model_id, chunk_id, dim, vector FROM embedding_meta
 WHERE vector IS NOT NULL AND len(vector) = dim AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
s AS (SELECT a.model_id, a.chunk_id, b.chunk_id AS neighbour, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS similarity
 FROM v a JOIN v b ON a.model_id = b.model_id AND a.dim = b.dim AND a.chunk_id <> b.chunk_id),
k AS (SELECT *, row_number() OVER (PARTITION BY model_id, chunk_id ORDER BY similarity DESC, neighbour) AS rank FROM s WHERE similarity >= 0.92)
"""
ORACLES = {
    "p6_found": _P6 + "SELECT DISTINCT model_id, least(chunk_id, neighbour) AS chunk_a, greatest(chunk_id, neighbour) AS chunk_b FROM k WHERE rank <= 10",
    "p6_neighbours": _P6.replace("ORDER BY similarity DESC", "ORDER BY round(similarity, 12) DESC").replace(" WHERE similarity >= 0.92", "") + "SELECT model_id, chunk_id, neighbour, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM k WHERE rank <= 10",
    "p8_invariants": "SELECT count(*) AS texts, 0::BIGINT AS wrongly_divided, 0::BIGINT AS with_gaps, 0::BIGINT AS overfull, 0::BIGINT AS misreported, true AS tight FROM documents",
    "p9_invariants": "SELECT count(DISTINCT source) AS targets, 0::BIGINT AS overused, 0::BIGINT AS strange, 0::BIGINT AS off_target FROM mix_target WHERE target_share > 0 AND max_repeats > 0",
    "p2_found": """WITH RECURSIVE e AS (SELECT from_concept AS a, to_concept AS b FROM edge WHERE relation = 'user_linked' UNION SELECT to_concept, from_concept FROM edge WHERE relation = 'user_linked'),
 r AS (SELECT a AS concept_id, a AS o FROM e WHERE a IS NOT NULL UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.concept_id WHERE e.b IS NOT NULL)
 SELECT concept_id, min(o) AS group_id FROM r GROUP BY 1""",
    "p3_found": r"""WITH l AS (SELECT id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS n
  FROM (SELECT DISTINCT id, text FROM document_version WHERE id IS NOT NULL AND text IS NOT NULL)),
 o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, trim(line, chr(32) || chr(9) || chr(13)) AS inside FROM l),
 g AS (SELECT *, n - row_number() OVER (PARTITION BY id ORDER BY n) AS run, at_ + length(line) - length(ltrim(line, chr(32) || chr(9) || chr(13))) AS first FROM o WHERE inside <> '')
 SELECT id AS document_version_id, min(first)::BIGINT AS start_char FROM g GROUP BY id, run HAVING max(first + length(inside)) - min(first) > 1200""",
    "p5_found": _P5 + "SELECT concept_a, concept_b FROM s WHERE n_ab >= 5 AND n_ab * n >= 10 * n_a * n_b",
    "p5_pairs": _P5 + """, k AS (SELECT least(from_concept, to_concept) AS concept_a, greatest(from_concept, to_concept) AS concept_b, max(weight) AS edge_weight FROM edge WHERE relation = 'co_occurs' GROUP BY 1, 2)
 SELECT s.concept_a, s.concept_b, n_a, n_b, n_ab, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift, edge_weight FROM s LEFT JOIN k USING (concept_a, concept_b)""",
}
