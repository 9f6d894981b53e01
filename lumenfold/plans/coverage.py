"""Queries of coverage, concept graph, citations, suggestions and vectors over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import citations as C
from lumenfold.operators import coverage as V
from lumenfold.operators import graph as G
from lumenfold.operators import suggest as U
from lumenfold.operators import vectors as E
from lumenfold.operators.sync import merged_sources
from lumenfold.plans.dealt import DOI_SQL
from lumenfold.plans.learning import _REV, _TOP40, domain_reviews
from lumenfold.session import Scratch
from lumenfold.tables import iso, table

MODEL = "lex-64"


def _concept(s: SparkSession, d: str) -> DataFrame:
    """One live row per concept: the latest row, deletions left out."""
    c = table(s, d, "concept").filter("id is not null")
    key = F.struct("recorded_at", F.col("deleted_at").isNull(), "label")
    one = c.groupBy("id").agg(F.max_by(F.struct("scheme", "label", "deleted_at"), key).alias("r"))
    return one.select("id", "r.scheme", "r.label", "r.deleted_at").filter("deleted_at is null").drop("deleted_at")


def _sources(s: SparkSession, d: str) -> DataFrame:
    return V.concept_sources(table(s, d, "mention"), table(s, d, "chunk"), table(s, d, "document_version"))


def _coverage(s: SparkSession, d: str, sources: DataFrame | None = None) -> DataFrame:
    noted = table(s, d, "documents").filter("source = 'annotation' and source_id is not null").select("source_id")
    return V.rollup_from(sources if sources is not None else _sources(s, d), table(s, d, "ingestion_event"), noted)


def coverage_rollup(s: SparkSession, d: str) -> DataFrame:
    return _coverage(s, d).withColumns({c: iso(c) for c in ("first_contact_at", "last_contact_at")})


def uncovered_but_recurring(s: SparkSession, d: str) -> DataFrame:
    src = Scratch(s, "recurring").put(_sources(s, d))  # once for the rollup and once for the answer
    out = V.recurring_gaps(_coverage(s, d, src), _concept(s, d), src)
    return out.select("concept_id", "label", "distinct_sources", "temporal_spread_days", F.array_join("source_ids", ",").alias("source_ids"))


def stale_coverage(s: SparkSession, d: str) -> DataFrame:
    return V.stale(_coverage(s, d), _concept(s, d), F.to_timestamp(F.lit("2025-06-01"))).select("concept_id", "label", iso("last_contact_at").alias("last_contact_at"), "distinct_sources")


def taxonomy(s: SparkSession, d: str) -> DataFrame:
    return V.taxonomy(table(s, d, "edge"), _concept(s, d), _coverage(s, d))


def taxonomy_covered(s: SparkSession, d: str) -> DataFrame:
    return V.taxonomy(table(s, d, "edge"), _concept(s, d), _coverage(s, d), include_uncovered=False)


def taxonomy_holes(s: SparkSession, d: str) -> DataFrame:
    return G.taxonomy_holes(table(s, d, "edge"), _coverage(s, d))


def taxonomy_holes_deep(s: SparkSession, d: str) -> DataFrame:
    """The same where only concepts of thirty sources count as covered."""
    return G.taxonomy_holes(table(s, d, "edge"), _coverage(s, d).filter("distinct_sources >= 30"))


def timeline(s: SparkSession, d: str) -> DataFrame:
    span = [F.to_timestamp(F.lit(x)) for x in ("2024-01-01", "2026-01-01")]
    cov = Scratch(s, "timeline").put(_coverage(s, d))
    t = V.timeline(_sources(s, d), table(s, d, "ingestion_event"), cov, _concept(s, d), domain_reviews(s, d), *span)
    return t.withColumns({c: iso(c) for c in ("first_at", "last_at")})


def _root(s: SparkSession, d: str) -> str:
    e = table(s, d, "edge").filter("relation = 'subclass_of' and provenance = 'vocabulary'")
    return e.groupBy("to_concept").agg(F.count_distinct("from_concept").alias("n")).orderBy(F.desc("n"), "to_concept").limit(1).first()[0]


def taxonomy_rooted(s: SparkSession, d: str) -> DataFrame:
    """The concepts below the one with most subclasses."""
    e = table(s, d, "edge")
    return V.taxonomy(e, _concept(s, d), _coverage(s, d), within=V.rooted(e, _root(s, d), Scratch(s, "rooted")))


def coverage_for(s: SparkSession, d: str) -> DataFrame:
    """Coverage of the smallest covered concept."""
    cov = Scratch(s, "one").put(_coverage(s, d))
    return V.coverage_for(cov, cov.agg(F.min("concept_id")).first()[0]).select("concept_id", "distinct_sources", "primary_sources", "contact_count", "max_engagement")


def source_detail(s: SparkSession, d: str) -> DataFrame:
    out = V.source_detail(table(s, d, "ingestion_event"), merged_sources(table(s, d, "reading_source")), table(s, d, "document_version"), table(s, d, "chunk"), table(s, d, "mention"))
    return out.withColumn("last_event_at", iso("last_event_at"))


def neighbourhood_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """The edges of the neighbourhood of the same start by vocabulary edges alone."""
    start = table(s, d, "edge").groupBy("from_concept").count().agg(F.max_by("from_concept", F.struct("count", "from_concept"))).first()[0]
    nodes, edges = G.neighbourhood(table(s, d, "edge"), start, Scratch(s, "near"), provenance="vocabulary")
    return edges.select("id", "from_concept", "to_concept", "relation").distinct()


def timeline_buckets(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "ingestion_event").select("id", "occurred_at").filter("occurred_at is not null").distinct()
    parts = [e.groupBy(V.bucket(F.col("occurred_at"), g).alias("bucket")).agg(F.count(F.lit(1)).alias("events")).withColumn("grain", F.lit(g)) for g in ("day", "week", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prior_coverage(s: SparkSession, d: str) -> DataFrame:
    return V.prior_coverage(table(s, d, "ingestion_event"))


def recent_events(s: SparkSession, d: str) -> DataFrame:
    out = V.recent_events(table(s, d, "ingestion_event"), merged_sources(table(s, d, "reading_source")))
    return out.select("id", "source_id", iso("occurred_at").alias("occurred_at"), "engagement", "status", "title")


def engagement_high_water(s: SparkSession, d: str) -> DataFrame:
    return V.engagement_high_water(table(s, d, "ingestion_event")).select("source_id", "id", "engagement")


def top_concepts(s: SparkSession, d: str) -> DataFrame:
    c = _coverage(s, d).join(_concept(s, d).select(F.col("id").alias("concept_id"), "label"), "concept_id")
    return c.select("concept_id", "label", "distinct_sources", "primary_sources").orderBy(F.desc("distinct_sources"), "concept_id").limit(25)


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "ingestion_event").select("id", "occurred_at", "status").distinct().agg(F.count_distinct("id").alias("events"), F.count_if(F.col("status") == "extraction_failed").alias("failed"), F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b"))
    v = table(s, d, "document_version").select("id", "source_id", "word_count").distinct().agg(F.count_distinct("id").alias("versions"), F.sum("word_count").alias("words"))
    c = table(s, d, "chunk").agg(F.count_distinct("id").alias("chunks"))
    m = table(s, d, "mention").agg(F.count_distinct("id").alias("mentions"), F.count_distinct("concept_id").alias("concepts"))
    r = table(s, d, "reading_source").agg(F.count_distinct("id").alias("sources"))
    one = F.lit(1).alias("one")
    out = r.select("*", one)
    for x in (e, v, c, m):  # single rows
        out = out.join(x.select("*", one), "one")
    out = out.drop("one")
    return out.withColumns({"first_at": iso("a"), "last_at": iso("b")}).drop("a", "b")


def vectors_by_model(s: SparkSession, d: str) -> DataFrame:
    return E.counts(table(s, d, "embedding_meta"))


def index_pending(s: SparkSession, d: str) -> DataFrame:
    """Versions without any vector of the model (work-list)."""
    v = table(s, d, "document_version").filter("id is not null and text <> ''").select(F.col("id").alias("document_version_id")).distinct()
    return v.join(table(s, d, "embedding_meta").filter(F.col("model_id") == MODEL).select("document_version_id"), "document_version_id", "left_anti")


def link_pending(s: SparkSession, d: str) -> DataFrame:
    """Versions none of whose chunks has a mention."""
    v = table(s, d, "document_version").filter("id is not null").select(F.col("id").alias("document_version_id")).distinct()
    linked = table(s, d, "chunk").join(table(s, d, "mention").select(F.col("chunk_id").alias("id")), "id", "left_semi").select("document_version_id")
    return v.join(linked, "document_version_id", "left_anti")


def cooccurrence(s: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence(_sources(s, d))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "edge").filter("relation = 'co_occurs' and provenance = 'corpus_stats' and from_concept <> to_concept").select(F.col("from_concept").alias("a"), F.col("to_concept").alias("b"))
    return G.clusters(links.filter("a is not null and b is not null"), Scratch(s, "clusters"))


def concept_clusters(s: SparkSession, d: str) -> DataFrame:
    return _clusters(s, d)


def bridge_gaps(s: SparkSession, d: str) -> DataFrame:
    return G.bridge_gaps(_clusters(s, d))


def neighbourhood(s: SparkSession, d: str) -> DataFrame:
    start = table(s, d, "edge").groupBy("from_concept").count().agg(F.max_by("from_concept", F.struct("count", "from_concept"))).first()[0]
    nodes, _ = G.neighbourhood(table(s, d, "edge"), start, Scratch(s, "near"))
    return nodes


def _works(s: SparkSession, d: str) -> DataFrame:
    return C.works(table(s, d, "scholar_work"))


def work_upsert(s: SparkSession, d: str) -> DataFrame:
    return _works(s, d).select("doi", "title", F.col("published_year").cast("long").alias("published_year"), "open_access", "cited_by_count", "source_id")


def work_backfill(s: SparkSession, d: str) -> DataFrame:
    return C.backfill_sources(_works(s, d), table(s, d, "reading_source")).filter("source_id is not null").select("doi", "source_id")


def _held(s: SparkSession, d: str) -> DataFrame:
    return C.backfill_sources(_works(s, d), table(s, d, "reading_source")).filter("source_id is not null")


def convergent_references(s: SparkSession, d: str) -> DataFrame:
    out = C.convergent(C.citations(table(s, d, "citation")), _works(s, d), _held(s, d))
    return out.withColumn("source_ids", F.array_join("source_ids", ","))


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(s, "slate")
    src = scratch.put(_sources(s, d))
    cov = scratch.put(_coverage(s, d, src))
    cl = scratch.put(_clusters(s, d))
    w = scratch.put(_works(s, d))
    held = C.backfill_sources(w, table(s, d, "reading_source")).filter("source_id is not null")
    cand = U.candidates(C.convergent(C.citations(table(s, d, "citation")), w, held), V.recurring_gaps(cov, _concept(s, d), src), G.bridge_gaps(cl), G.taxonomy_holes(table(s, d, "edge"), cov), w)
    near = E.neighbour_concepts(E.centroids(_store(s, d), table(s, d, "mention")), cov, _concept(s, d), well=5, thin=3)
    return scratch.put(cand.unionByName(U.neighbour_candidates(near))), cl


def suggestion_candidates(s: SparkSession, d: str) -> DataFrame:
    return U.scored(_candidates(s, d)[0]).select("kind", "target", F.round("score", 6).alias("score"))


def suggestion_slate(s: SparkSession, d: str) -> DataFrame:
    cand, cl = _candidates(s, d)
    return U.slate(cand, _dismissed(s, d), cl).select("kind", "target", F.round("score", 6).alias("score"), "serendipity")


def _dismissed(s: SparkSession, d: str) -> DataFrame:
    """Dismissed targets: concepts the user linked to another, as the assertion that they are known; works without a title
    for dismissed suggestions."""
    known = table(s, d, "edge").filter("relation = 'user_linked' and provenance = 'user'").select(F.lit("known_already").alias("kind"), F.col("from_concept").alias("subject_id"))
    return U.dismissed_targets(_works(s, d).filter("title is null").select(F.col("doi").alias("target")), known)


def dismissed_targets(s: SparkSession, d: str) -> DataFrame:
    return _dismissed(s, d)


def active_suggestions(s: SparkSession, d: str) -> DataFrame:
    """Candidates stored as suggestions that expire a day after 2025 began per character of their target, as of 1 February."""
    new_year = F.to_timestamp(F.lit("2025-01-01"))
    rows = U.scored(_candidates(s, d)[0]).select(F.concat_ws(":", "kind", "target").alias("id"), "kind", "target", "score", (new_year + F.make_dt_interval(F.length("target"))).alias("expires_at"), F.when(F.col("target").like("%0"), new_year).alias("dismissed_at"))
    return U.active(rows, F.to_timestamp(F.lit("2025-01-12"))).select("id", F.round("score", 6).alias("score"))


def _store(s: SparkSession, d: str) -> DataFrame:
    return E.vectors(table(s, d, "embedding_meta"), MODEL)


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """The ten chunks nearest to every chunk whose id has an md5 below 0d, one in twenty."""
    scratch = Scratch(s, "topk")
    store = scratch.put(_store(s, d))
    out = E.top_k_each(store, store.filter(F.substring(F.md5("chunk_id"), 1, 2) < "0d"), scratch)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def novelty(s: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(s, "novelty")
    return E.novelty(scratch.put(_store(s, d)), scratch).select("document_version_id", F.round("novelty", 6).alias("novelty"), "comparable")


def recorded_novelty(s: SparkSession, d: str) -> DataFrame:
    """Events with novelty as recorded from the vectors."""
    scratch = Scratch(s, "record")
    e = table(s, d, "ingestion_event").select("id", "source_id", "novelty", "novelty_model_id").distinct()
    out = E.record_novelty(e, table(s, d, "document_version"), E.novelty(scratch.put(_store(s, d)), scratch), MODEL)
    return out.select("id", "source_id", F.round("novelty", 6).alias("novelty"), "novelty_model_id")


def concept_centroid(s: SparkSession, d: str) -> DataFrame:
    c = E.centroids(_store(s, d), table(s, d, "mention"))
    return c.select("concept_id", F.posexplode("u").alias("i", "x")).select("concept_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def neighbour_concepts(s: SparkSession, d: str) -> DataFrame:
    c = Scratch(s, "centroid").put(E.centroids(_store(s, d), table(s, d, "mention")))
    return E.neighbour_concepts(c, _coverage(s, d), _concept(s, d), well=5, thin=3).select("concept_id", "anchor_id", F.round("similarity", 6).alias("similarity"))


def literal_search(s: SparkSession, d: str) -> DataFrame:
    return E.literal_search(table(s, d, "documents"), "doc_id", "text", "Practice Session")


def _chunk_texts(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "document_version").filter("id is not null").groupBy(F.col("id").alias("document_version_id")).agg(F.min("text").alias("text"))
    c = table(s, d, "chunk").filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("document_version_id", "start_char", "end_char", "section_path")).alias("c")).select("chunk_id", "c.*")
    return c.join(v, "document_version_id").withColumn("text", F.expr("substring(text, cast(start_char + 1 as int), cast(end_char - start_char as int))"))


def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    """Embeddings of the texts of all chunks."""
    return E.hash_embedding(_chunk_texts(s, d), "chunk_id", F.col("text")).select("chunk_id", "i", F.round("x", 6).alias("x"))


def rebuilt_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Rows per chunk and model after the chunks of all English versions were embedded anew."""
    old = table(s, d, "embedding_meta").filter("chunk_id is not null").select("chunk_id", "model_id").distinct()
    english = table(s, d, "document_version").filter("lang = 'en'").select(F.col("id").alias("document_version_id")).distinct()
    scope = _chunk_texts(s, d).join(english, "document_version_id", "left_semi")
    fresh = E.hash_embedding(scope, "chunk_id", F.col("text")).select("chunk_id", F.lit("hash-128").alias("model_id")).distinct()
    return E.rebuilt(old, fresh, scope, "chunk_id").groupBy("model_id").agg(F.count(F.lit(1)).alias("chunks"))


SEARCH = "the practice session repeats the older margin note"


def semantic_search(s: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(s, "semantic")
    texts = scratch.put(_chunk_texts(s, d))
    hits = E.semantic_search(E.hash_embedding(texts, "chunk_id", F.col("text")), SEARCH)
    return hits.join(texts.select("chunk_id", "document_version_id", "section_path"), "chunk_id").select("chunk_id", "document_version_id", "section_path", F.round("score", 6).alias("score"))


def vector_put(s: SparkSession, d: str) -> DataFrame:
    """Vectors computed from 2025 on put into a store of the earlier ones."""
    m = table(s, d, "embedding_meta").filter("chunk_id is not null and model_id is not null")
    late = F.coalesce(F.col("computed_at") >= F.to_timestamp(F.lit("2025-01-01")), F.lit(False))
    out = E.put(m.filter(~late), m.filter(late))
    return out.groupBy("model_id").agg(F.count(F.lit(1)).alias("vectors"), iso(F.max("computed_at")).alias("latest"))


def model_guard(s: SparkSession, d: str) -> DataFrame:
    return E.guard_one_model(table(s, d, "embedding_meta"))


def blob_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Vectors after a way through blobs: their length and sum."""
    m = table(s, d, "embedding_meta").filter("chunk_id is not null and model_id is not null and vector is not null").select("chunk_id", "model_id", E.to_blob(F.col("vector")).alias("blob"), F.size("vector").alias("n"))
    v = m.select("chunk_id", "model_id", E.from_blob(F.col("blob"), F.col("n")).alias("v"))
    return v.select("chunk_id", "model_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")).distinct()


def edges_rewritten(s: SparkSession, d: str) -> DataFrame:
    """Edges after the corpus statistics were computed anew."""
    return G.rewritten(table(s, d, "edge"), G.cooccurrence(_sources(s, d), 2)).select("from_concept", "to_concept", "relation", "provenance", "weight")


_FNS = (
    coverage_rollup, coverage_for, source_detail, taxonomy_rooted, neighbourhood_vocabulary, uncovered_but_recurring, stale_coverage, taxonomy, taxonomy_covered, taxonomy_holes, taxonomy_holes_deep, timeline, timeline_buckets, prior_coverage, recent_events, engagement_high_water, top_concepts, corpus_stats, vectors_by_model,
    index_pending, link_pending, cooccurrence, concept_clusters, bridge_gaps, neighbourhood, work_upsert, work_backfill, convergent_references, suggestion_candidates, suggestion_slate, dismissed_targets, active_suggestions, vector_topk, novelty, recorded_novelty, concept_centroid, rebuilt_embeddings, semantic_search, vector_put, model_guard, blob_round_trip, edges_rewritten, neighbour_concepts,
    literal_search, hash_embedding,
)
QUERIES = {f.__name__: f for f in _FNS}

_RANK = "list_position(['skim', 'read', 'annotate', 'apply', 'teach'], engagement)"
_TS = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
_NBR = f"""vs AS (SELECT chunk_id, max(document_version_id) AS document_version_id, any_value(vector)::DOUBLE[] AS v FROM embedding_meta WHERE model_id = '{MODEL}' AND vector IS NOT NULL AND len(vector) = dim AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY 1),
cu AS (SELECT chunk_id, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) AS i FROM vs), cmn AS (SELECT DISTINCT concept_id, chunk_id FROM mention WHERE concept_id IS NOT NULL),
ce AS (SELECT concept_id, list(x ORDER BY i) AS v, any_value(distinct_sources) AS ds FROM (SELECT concept_id, i, sum(x) AS x FROM cmn JOIN cu USING (chunk_id) GROUP BY 1, 2) LEFT JOIN cov USING (concept_id) GROUP BY 1),
an AS (SELECT * FROM ce WHERE ds >= 5 ORDER BY ds DESC, concept_id LIMIT 20), tgt AS (SELECT ce.* FROM ce JOIN co ON co.id = ce.concept_id WHERE scheme <> 'local' AND coalesce(ds, 0) <= 3 ORDER BY concept_id LIMIT 200),
nbr AS (SELECT concept_id, anchor_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY similarity DESC, anchor_id) AS n FROM (SELECT tgt.concept_id, an.concept_id AS anchor_id, list_cosine_similarity(tgt.v, an.v) AS similarity FROM tgt JOIN an ON tgt.concept_id <> an.concept_id) WHERE similarity >= 0.3) q WHERE n = 1 ORDER BY q.similarity DESC, concept_id LIMIT 10),
"""
_CTE = f"""
WITH RECURSIVE co AS (SELECT id, scheme, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST, (deleted_at IS NULL) DESC, label DESC NULLS LAST) AS n FROM concept WHERE id IS NOT NULL) WHERE n = 1 AND deleted_at IS NULL),
ev AS (SELECT DISTINCT * FROM ingestion_event),
cs AS (SELECT m.concept_id, v.source_id, bool_or(coalesce(m.is_primary, false)) AS is_primary
 FROM mention m JOIN (SELECT DISTINCT id, document_version_id FROM chunk) c ON c.id = m.chunk_id JOIN (SELECT DISTINCT id, source_id FROM document_version) v ON v.id = c.document_version_id
 WHERE m.concept_id IS NOT NULL AND v.source_id IS NOT NULL GROUP BY 1, 2),
cov AS (SELECT concept_id, count(DISTINCT cs.source_id) AS distinct_sources, count(DISTINCT CASE WHEN is_primary THEN cs.source_id END) AS primary_sources, min(occurred_at) AS f, max(occurred_at) AS l,
 greatest(floor((epoch(max(occurred_at)) - epoch(min(occurred_at))) / 86400 + 0.5), 0)::BIGINT AS temporal_spread_days,
 ['skim', 'read', 'annotate', 'apply', 'teach'][max({_RANK})] AS max_engagement, count(DISTINCT (cs.source_id, ev.id)) AS contact_count,
 bool_or(cs.source_id IN (SELECT source_id FROM documents WHERE source = 'annotation' AND source_id IS NOT NULL)) AS has_user_annotation
 FROM cs JOIN ev ON ev.source_id = cs.source_id GROUP BY 1),
up AS (SELECT from_concept AS concept_id, min(to_concept) AS parent_id FROM edge WHERE relation = 'subclass_of' AND provenance = 'vocabulary' GROUP BY 1),
gap AS (SELECT cov.*, label FROM cov JOIN co ON co.id = cov.concept_id WHERE scheme <> 'local' AND distinct_sources >= 3 AND primary_sources <= 0 ORDER BY distinct_sources DESC, temporal_spread_days DESC, concept_id LIMIT 25),
sub AS (SELECT DISTINCT from_concept, to_concept FROM edge WHERE relation = 'subclass_of' AND provenance = 'vocabulary' AND from_concept IS NOT NULL AND to_concept IS NOT NULL),
hole AS (SELECT b.from_concept AS concept_id, a.from_concept AS anchor_id, a.to_concept AS parent_id, 'sibling' AS kind FROM sub a JOIN cov ON cov.concept_id = a.from_concept AND distinct_sources >= 2
 JOIN sub b ON b.to_concept = a.to_concept AND b.from_concept <> a.from_concept WHERE NOT EXISTS (SELECT 1 FROM cov x WHERE x.concept_id = b.from_concept) ORDER BY 1, 2, 3 LIMIT 25),
lk AS (SELECT from_concept AS a, to_concept AS b FROM edge WHERE relation = 'co_occurs' AND provenance = 'corpus_stats' AND from_concept <> to_concept),
l2 AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
rc AS (SELECT a AS v, a AS o FROM l2 UNION SELECT l2.b, rc.o FROM rc JOIN l2 ON l2.a = rc.v),
c1 AS (SELECT v AS concept_id, min(o) AS cluster_id FROM rc GROUP BY 1),
cl AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM c1),
cz AS (SELECT DISTINCT cluster_id, size FROM cl),
br AS (SELECT x.cluster_id AS a, x.size AS size_a, y.cluster_id AS b, y.size AS size_b, x.size * y.size AS strength FROM cz x JOIN cz y ON x.cluster_id < y.cluster_id ORDER BY strength DESC, a, b LIMIT 10),
wr AS (SELECT *, {DOI_SQL.format("doi")} AS k FROM scholar_work),
wk AS (SELECT k AS doi, arg_max(title, (recorded_at, fetched_at, title)) FILTER (WHERE title IS NOT NULL) AS title, arg_max(published_year, (recorded_at, fetched_at, published_year::VARCHAR)) FILTER (WHERE published_year IS NOT NULL)::BIGINT AS published_year,
 coalesce(bool_or(open_access), false) AS open_access, arg_max(cited_by_count, (recorded_at, fetched_at, cited_by_count::VARCHAR)) FILTER (WHERE cited_by_count IS NOT NULL) AS cited_by_count, arg_max(source_id, (recorded_at, fetched_at, source_id)) FILTER (WHERE source_id IS NOT NULL) AS source_id,
 arg_max(deleted_at IS NOT NULL, (recorded_at, fetched_at, coalesce(title, ''))) AS gone FROM wr WHERE k IS NOT NULL GROUP BY 1),
wo AS (SELECT * FROM wk WHERE NOT gone),
sd AS (SELECT k, min(id) AS found FROM (SELECT id, {DOI_SQL.format("doi")} AS k FROM reading_source) WHERE k IS NOT NULL GROUP BY 1),
held AS (SELECT doi, coalesce(source_id, found) AS source_id FROM wo LEFT JOIN sd ON sd.k = wo.doi WHERE coalesce(source_id, found) IS NOT NULL),
ct AS (SELECT DISTINCT * FROM (SELECT {DOI_SQL.format("from_doi")} AS from_doi, {DOI_SQL.format("to_doi")} AS to_doi FROM citation) WHERE from_doi <> to_doi),
cv AS (SELECT wo.doi, any_value(title) AS title, any_value(cited_by_count) AS cited_by_count, count(DISTINCT ct.from_doi) AS citing_works, array_to_string(list_sort(list(DISTINCT h.source_id)), ',') AS source_ids
 FROM ct JOIN held h ON h.doi = ct.from_doi JOIN wo ON wo.doi = ct.to_doi WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.doi = ct.to_doi) GROUP BY 1 HAVING count(DISTINCT ct.from_doi) >= 2
 ORDER BY citing_works DESC, cited_by_count DESC NULLS LAST, doi LIMIT 25),
{_NBR}
cand AS (SELECT 'citation' AS kind, cv.doi AS target, NULL AS concept_id, 1.0 * least(1, log2(1.0 + citing_works) / 3) + 0.8 + 0.3 * CASE WHEN wo.open_access THEN 1.0 ELSE 0.4 END AS score FROM cv JOIN wo USING (doi)
 UNION ALL SELECT 'coverage_gap', concept_id, concept_id, 0.85 * least(1, distinct_sources / 5.0) + 0.8 * least(1, 0.5 + temporal_spread_days / 180.0) + 0.3 * 0.8 FROM gap
 UNION ALL SELECT 'bridge', a || '|' || b, a, 0.7 * least(1, strength / 25.0) + 0.8 + 0.3 * 0.6 FROM br
 UNION ALL SELECT 'taxonomy_hole', concept_id, concept_id, 0.55 * 0.5 + 0.8 + 0.3 * 0.8 FROM (SELECT DISTINCT concept_id FROM hole)
 UNION ALL SELECT 'neighbour', concept_id, concept_id, 0.3 * similarity + 0.8 * 0.5 + 0.3 * 0.7 - 0.6 * similarity FROM nbr),
dis AS (SELECT from_concept AS target FROM edge WHERE relation = 'user_linked' AND provenance = 'user' AND from_concept IS NOT NULL UNION SELECT doi FROM wo WHERE title IS NULL),
cb AS (SELECT c.*, coalesce(c.concept_id IN (SELECT concept_id FROM cl WHERE cluster_id = (SELECT cluster_id FROM cz ORDER BY size DESC, cluster_id LIMIT 1)), false) AS big FROM cand c WHERE target NOT IN (SELECT target FROM dis)),
rk AS (SELECT *, row_number() OVER (PARTITION BY big ORDER BY score DESC, kind, target) AS g FROM cb),
al AS (SELECT *, NOT big OR g <= 4 AS allowed FROM rk),
ch AS (SELECT *, allowed AND row_number() OVER (PARTITION BY allowed ORDER BY score DESC, kind, target) <= 9 AS chosen FROM al),
lu AS (SELECT *, NOT chosen AND row_number() OVER (PARTITION BY chosen ORDER BY CASE WHEN NOT big AND kind IN ('bridge', 'taxonomy_hole') THEN 0 ELSE 1 END, score DESC, kind, target) = 1 AS lucky FROM ch)
"""
_HASH = "list_reduce(list_prepend({seed}::BIGINT, list_transform(str_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT)"
_NOV = """nb AS (SELECT a.document_version_id, max(list_cosine_similarity(a.v, b.v)) AS s FROM vs a JOIN vs b ON b.document_version_id <> a.document_version_id GROUP BY 1),
 nv AS (SELECT d.document_version_id, 1 - greatest(0, least(1, coalesce(s, 0))) AS novelty, s IS NOT NULL AS comparable FROM (SELECT DISTINCT document_version_id FROM vs WHERE document_version_id IS NOT NULL) d LEFT JOIN nb USING (document_version_id))"""
_TEXTS = """tx AS (SELECT c.chunk_id, c.document_version_id, c.section_path, substr(v.text, c.start_char + 1, c.end_char - c.start_char) AS text FROM (SELECT id AS chunk_id, unnest(min(struct_pack(document_version_id, start_char, end_char, section_path))) FROM chunk WHERE id IS NOT NULL GROUP BY 1) c
 JOIN (SELECT id, min(text) AS text FROM document_version WHERE id IS NOT NULL GROUP BY 1) v ON v.id = c.document_version_id)"""
_EMBED = f"""n AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM l) WHERE length(w) > 1 GROUP BY 1, 2), hw AS (SELECT w, {_HASH.format(seed=E.SEED_1)} % 128 AS h1, {_HASH.format(seed=E.SEED_2)} % 128 AS h2 FROM (SELECT DISTINCT w FROM n)),
 p AS (SELECT id, h1 AS i, 1 + ln(n) AS x FROM n JOIN hw USING (w) UNION ALL SELECT id, h2, -0.5 * (1 + ln(n)) FROM n JOIN hw USING (w)), s AS (SELECT id, i, sum(x) AS x FROM p GROUP BY 1, 2), e0 AS (SELECT id, i, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS y FROM s), em AS (SELECT * FROM e0 WHERE y IS NOT NULL)"""
ORACLES = {
    "coverage_rollup": _CTE + f"SELECT concept_id, distinct_sources, primary_sources, {_TS('f')} AS first_contact_at, {_TS('l')} AS last_contact_at, temporal_spread_days, max_engagement, contact_count, has_user_annotation FROM cov",
    "uncovered_but_recurring": _CTE + "SELECT concept_id, label, distinct_sources, temporal_spread_days, (SELECT array_to_string(list_sort(list(DISTINCT source_id)), ',') FROM cs WHERE cs.concept_id = gap.concept_id) AS source_ids FROM gap",
    "stale_coverage": _CTE + f"SELECT concept_id, label, {_TS('l')} AS last_contact_at, distinct_sources FROM cov JOIN co ON co.id = concept_id WHERE l < TIMESTAMP '2025-06-01' ORDER BY l, concept_id LIMIT 25",
    "taxonomy": _CTE + "SELECT co.id AS concept_id, label, parent_id, coalesce(distinct_sources, 0) AS distinct_sources, coalesce(primary_sources, 0) AS primary_sources FROM co LEFT JOIN up ON up.concept_id = co.id LEFT JOIN cov ON cov.concept_id = co.id",
    "taxonomy_covered": _CTE + "SELECT co.id AS concept_id, label, parent_id, distinct_sources, primary_sources FROM co LEFT JOIN up ON up.concept_id = co.id JOIN cov ON cov.concept_id = co.id WHERE distinct_sources > 0",
    "taxonomy_holes_deep": _CTE + """SELECT b.from_concept AS concept_id, a.from_concept AS anchor_id, a.to_concept AS parent_id, 'sibling' AS kind FROM sub a JOIN cov ON cov.concept_id = a.from_concept AND distinct_sources >= 30
 JOIN sub b ON b.to_concept = a.to_concept AND b.from_concept <> a.from_concept WHERE NOT EXISTS (SELECT 1 FROM cov x WHERE x.concept_id = b.from_concept AND x.distinct_sources >= 30) ORDER BY 1, 2, 3 LIMIT 25""",
    "taxonomy_holes": _CTE + "SELECT * FROM hole",
    "timeline": _CTE + "," + _REV.replace("WITH RECURSIVE", "") + _TOP40 + f""", tp AS (SELECT cov.concept_id, label FROM cov JOIN co ON co.id = cov.concept_id WHERE l >= TIMESTAMP '2024-01-01' AND f <= TIMESTAMP '2026-01-01' ORDER BY distinct_sources DESC, l DESC, cov.concept_id LIMIT 50),
 en AS (SELECT DISTINCT concept_id, source_id, occurred_at AS o, engagement, capture_path FROM tp JOIN cs USING (concept_id) JOIN ev USING (source_id) WHERE occurred_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2026-01-01'),
 rv AS (SELECT tp.concept_id, at_ AS o, coalesce(override, machine, self) AS g FROM rev JOIN top40 ON top40.k = rev.concept_id JOIN tp ON tp.concept_id = top40.concept_id WHERE at_ BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2026-01-01'),
 mk AS (SELECT concept_id, o, lag(o) OVER (PARTITION BY concept_id ORDER BY o) AS p FROM (SELECT concept_id, o FROM en UNION SELECT concept_id, o FROM rv)),
 gp AS (SELECT concept_id, coalesce(max(greatest(floor((epoch(date_trunc('second', o)) - epoch(date_trunc('second', p))) / 86400 + 0.5), 0)), 0)::BIGINT AS largest_gap_days, {_TS('min(o)')} AS first_at, {_TS('max(o)')} AS last_at FROM mk GROUP BY 1)
 SELECT tp.concept_id, label, (SELECT count(*) FROM en WHERE en.concept_id = tp.concept_id) AS encounters, (SELECT count(*) FROM rv WHERE rv.concept_id = tp.concept_id) AS reviews, (SELECT count(*) FILTER (WHERE g >= 3) FROM rv WHERE rv.concept_id = tp.concept_id) AS passed,
 coalesce(largest_gap_days, 0) AS largest_gap_days, first_at, last_at FROM tp LEFT JOIN gp USING (concept_id)""",
    "coverage_for": _CTE + "SELECT concept_id, distinct_sources, primary_sources, contact_count, max_engagement FROM cov ORDER BY concept_id LIMIT 1",
    "source_detail": _CTE + f"""SELECT s.id AS source_id, title, (SELECT {_TS('max(occurred_at)')} FROM ev WHERE ev.source_id = s.id) AS last_event_at, (SELECT count(DISTINCT ev.id) FROM ev WHERE ev.source_id = s.id) AS events, (SELECT count(DISTINCT v.id) FROM document_version v WHERE v.source_id = s.id) AS versions,
 (SELECT count(DISTINCT c.id) FROM chunk c JOIN document_version v ON v.id = c.document_version_id WHERE v.source_id = s.id) AS chunks, (SELECT count(DISTINCT concept_id) FROM cs WHERE cs.source_id = s.id) AS concepts FROM (SELECT id, min(title) AS title FROM reading_source WHERE id IS NOT NULL GROUP BY 1) s""",
    "taxonomy_rooted": _CTE + """, rt AS (SELECT to_concept AS v FROM edge WHERE relation = 'subclass_of' AND provenance = 'vocabulary' GROUP BY 1 ORDER BY count(DISTINCT from_concept) DESC, v LIMIT 1),
 un AS (SELECT v FROM rt UNION SELECT sub.from_concept FROM un JOIN sub ON sub.to_concept = un.v)
 SELECT co.id AS concept_id, label, parent_id, coalesce(distinct_sources, 0) AS distinct_sources, coalesce(primary_sources, 0) AS primary_sources FROM co JOIN un ON un.v = co.id LEFT JOIN up ON up.concept_id = co.id LEFT JOIN cov ON cov.concept_id = co.id""",
    "neighbourhood_vocabulary": """WITH s AS (SELECT from_concept AS v FROM edge GROUP BY 1 ORDER BY count(*) DESC, v DESC LIMIT 1), x AS (SELECT * FROM edge WHERE provenance = 'vocabulary' AND coalesce(weight, 1) >= 0 AND from_concept IS NOT NULL AND to_concept IS NOT NULL), e AS (SELECT from_concept AS a, to_concept AS b FROM x UNION SELECT to_concept, from_concept FROM x),
 h1 AS (SELECT DISTINCT b AS v FROM e WHERE a IN (SELECT v FROM s) AND b NOT IN (SELECT v FROM s)), h1t AS (SELECT v FROM h1 ORDER BY v LIMIT 150), h2 AS (SELECT DISTINCT b AS v FROM e WHERE a IN (SELECT v FROM h1t) AND b NOT IN (SELECT v FROM s) AND b NOT IN (SELECT v FROM h1t)),
 n AS (SELECT v FROM (SELECT v, 0 AS q FROM s UNION ALL SELECT v, 1 FROM h1t UNION ALL SELECT v, 2 FROM h2) ORDER BY q, v LIMIT 150) SELECT DISTINCT id, from_concept, to_concept, relation FROM x WHERE from_concept IN (SELECT v FROM n) AND to_concept IN (SELECT v FROM n)""",
    "timeline_buckets": """WITH e AS (SELECT DISTINCT id, occurred_at AS o FROM ingestion_event WHERE occurred_at IS NOT NULL)
 SELECT grain, bucket, count(*) AS events FROM (SELECT 'day' AS grain, strftime(date_trunc('day', o), '%Y-%m-%d') AS bucket FROM e UNION ALL SELECT 'week', strftime(date_trunc('week', o), '%Y-%m-%d') FROM e UNION ALL SELECT 'month', strftime(date_trunc('month', o), '%Y-%m-%d') FROM e) GROUP BY 1, 2""",
    "prior_coverage": "WITH e AS (SELECT DISTINCT id, source_id, occurred_at, novelty FROM ingestion_event WHERE source_id IS NOT NULL) SELECT source_id, count(*) AS events, count(*) > 1 AS seen_before, arg_max(novelty, (occurred_at, id)) FILTER (WHERE novelty IS NOT NULL) AS latest_novelty FROM e GROUP BY 1",
    "recent_events": f"""WITH s AS (SELECT id, min(title) AS title FROM reading_source GROUP BY 1) SELECT e.id, e.source_id, {_TS('occurred_at')} AS occurred_at, engagement, status, s.title FROM (SELECT DISTINCT * FROM ingestion_event WHERE occurred_at IS NOT NULL ORDER BY occurred_at DESC, id DESC LIMIT 50) e LEFT JOIN s ON s.id = e.source_id""",
    "engagement_high_water": f"SELECT source_id, id, engagement FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {_RANK} DESC, occurred_at NULLS FIRST, id, engagement_source) AS n FROM ingestion_event WHERE source_id IS NOT NULL AND {_RANK} > 0) WHERE n = 1",
    "top_concepts": _CTE + "SELECT concept_id, label, distinct_sources, primary_sources FROM cov JOIN co ON co.id = concept_id ORDER BY distinct_sources DESC, concept_id LIMIT 25",
    "corpus_stats": f"""SELECT (SELECT count(DISTINCT id) FROM reading_source) AS sources, (SELECT count(DISTINCT id) FROM ingestion_event) AS events, (SELECT count(*) FROM (SELECT DISTINCT id, occurred_at, status FROM ingestion_event) WHERE status = 'extraction_failed') AS failed,
 (SELECT count(DISTINCT id) FROM document_version) AS versions, (SELECT sum(word_count)::BIGINT FROM (SELECT DISTINCT id, source_id, word_count FROM document_version)) AS words, (SELECT count(DISTINCT id) FROM chunk) AS chunks, (SELECT count(DISTINCT id) FROM mention) AS mentions, (SELECT count(DISTINCT concept_id) FROM mention) AS concepts,
 (SELECT {_TS('min(occurred_at)')} FROM ingestion_event) AS first_at, (SELECT {_TS('max(occurred_at)')} FROM ingestion_event) AS last_at""",
    "vectors_by_model": "SELECT model_id, count(DISTINCT chunk_id) AS vectors, count(DISTINCT dim) AS dims FROM embedding_meta WHERE vector IS NOT NULL GROUP BY 1",
    "index_pending": f"SELECT DISTINCT id AS document_version_id FROM document_version v WHERE id IS NOT NULL AND text <> '' AND NOT EXISTS (SELECT 1 FROM embedding_meta m WHERE m.model_id = '{MODEL}' AND m.document_version_id = v.id)",
    "link_pending": "SELECT DISTINCT id AS document_version_id FROM document_version v WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk c JOIN mention m ON m.chunk_id = c.id WHERE c.document_version_id = v.id)",
    "cooccurrence": _CTE + "SELECT x.concept_id AS a, y.concept_id AS b, count(*) AS shared FROM cs x JOIN cs y ON x.source_id = y.source_id AND x.concept_id < y.concept_id GROUP BY 1, 2",
    "concept_clusters": _CTE + "SELECT concept_id, cluster_id, size FROM cl WHERE size >= 2",
    "bridge_gaps": _CTE + "SELECT * FROM br",
    "neighbourhood": """WITH s AS (SELECT from_concept AS v FROM edge GROUP BY 1 ORDER BY count(*) DESC, v DESC LIMIT 1), e AS (SELECT from_concept AS a, to_concept AS b FROM edge WHERE coalesce(weight, 1) >= 0 UNION SELECT to_concept, from_concept FROM edge WHERE coalesce(weight, 1) >= 0),
 h1 AS (SELECT DISTINCT b AS v FROM e WHERE a IN (SELECT v FROM s) AND b NOT IN (SELECT v FROM s)), h1t AS (SELECT v FROM h1 ORDER BY v LIMIT 150), h2 AS (SELECT DISTINCT b AS v FROM e WHERE a IN (SELECT v FROM h1t) AND b NOT IN (SELECT v FROM s) AND b NOT IN (SELECT v FROM h1t)),
 n AS (SELECT v, 0 AS distance FROM s UNION ALL SELECT v, 1 FROM h1t UNION ALL SELECT v, 2 FROM h2) SELECT v AS concept_id, distance FROM n ORDER BY distance, v LIMIT 150""",
    "work_upsert": _CTE + "SELECT doi, title, published_year, open_access, cited_by_count, source_id FROM wo",
    "work_backfill": _CTE + "SELECT * FROM held",
    "convergent_references": _CTE + "SELECT * FROM cv",
    "suggestion_candidates": _CTE + "SELECT kind, target, round(score, 6) AS score FROM cand",
    "suggestion_slate": _CTE + "SELECT kind, target, round(score, 6) AS score, lucky AS serendipity FROM lu WHERE chosen OR lucky",
    "vector_topk": _CTE + """, q AS (SELECT * FROM vs WHERE substr(md5(chunk_id), 1, 2) < '0d'), p AS (SELECT q.chunk_id AS query_id, vs.chunk_id, round(list_cosine_similarity(q.v, vs.v), 12) AS s FROM q JOIN vs ON vs.chunk_id <> q.chunk_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id)::INTEGER AS rank FROM p WHERE s >= 0) SELECT query_id, chunk_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""",
    "novelty": _CTE + ", " + _NOV + " SELECT document_version_id, round(novelty, 6) AS novelty, comparable FROM nv",
    "recorded_novelty": _CTE + ", " + _NOV + f""", fr AS (SELECT source_id, min(nv.novelty) AS fresh FROM (SELECT DISTINCT id, source_id FROM document_version) d JOIN nv ON nv.document_version_id = d.id WHERE comparable GROUP BY 1)
 SELECT e.id, e.source_id, round(coalesce(fresh, novelty), 6) AS novelty, CASE WHEN fresh IS NOT NULL THEN '{MODEL}' ELSE novelty_model_id END AS novelty_model_id FROM (SELECT DISTINCT id, source_id, novelty, novelty_model_id FROM ingestion_event) e LEFT JOIN fr ON fr.source_id = e.source_id""",
    "rebuilt_embeddings": f"WITH {_TEXTS}, sc AS (SELECT chunk_id, text FROM tx WHERE document_version_id IN (SELECT id FROM document_version WHERE lang = 'en')), o AS (SELECT DISTINCT chunk_id, model_id FROM embedding_meta WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM sc) UNION ALL SELECT DISTINCT chunk_id, 'hash-128' FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM sc) WHERE length(w) > 1) SELECT model_id, count(*) AS chunks FROM o GROUP BY 1",
    "semantic_search": f"WITH {_TEXTS}, l AS (SELECT chunk_id AS id, text AS t FROM tx UNION ALL SELECT 'q', '{SEARCH}'), {_EMBED}, z AS (SELECT a.id AS chunk_id, sum(a.y * q.y) AS s FROM em a JOIN em q ON q.id = 'q' AND q.i = a.i WHERE a.id <> 'q' GROUP BY 1) SELECT z.chunk_id, tx.document_version_id, tx.section_path, round(z.s, 6) AS score FROM z JOIN tx USING (chunk_id) WHERE z.s > 0 ORDER BY round(z.s, 9) DESC, z.chunk_id LIMIT 10",
    "vector_put": f"""WITH m AS (SELECT *, coalesce(computed_at >= TIMESTAMP '2025-01-01', false) AS late FROM embedding_meta WHERE chunk_id IS NOT NULL AND model_id IS NOT NULL), k AS (SELECT * FROM m WHERE NOT late OR (vector IS NOT NULL AND len(vector) = dim)),
 o AS (SELECT model_id, chunk_id, arg_max(computed_at, (late, computed_at)) AS c FROM (SELECT model_id, chunk_id, late, coalesce(computed_at, TIMESTAMP '1970-01-01') AS computed_at FROM k) GROUP BY 1, 2) SELECT model_id, count(*) AS vectors, {_TS('max(c)')} AS latest FROM o GROUP BY 1""",
    "model_guard": "SELECT string_agg(DISTINCT model_id, ',' ORDER BY model_id) AS models, count(DISTINCT model_id) > 1 AS mixed FROM embedding_meta WHERE vector IS NOT NULL",
    "blob_round_trip": "SELECT DISTINCT chunk_id, model_id, len(vector) AS n, round(coalesce(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 0), 4) AS total FROM embedding_meta WHERE chunk_id IS NOT NULL AND model_id IS NOT NULL AND vector IS NOT NULL",
    "edges_rewritten": _CTE + "SELECT DISTINCT from_concept, to_concept, relation, provenance, weight FROM edge WHERE NOT (relation = 'co_occurs' AND provenance = 'corpus_stats') OR relation IS NULL OR provenance IS NULL UNION ALL SELECT x.concept_id, y.concept_id, 'co_occurs', 'corpus_stats', count(*)::DOUBLE FROM cs x JOIN cs y ON x.source_id = y.source_id AND x.concept_id < y.concept_id GROUP BY 1, 2 HAVING count(*) >= 2",
    "concept_centroid": _CTE + """, u AS (SELECT chunk_id, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) - 1 AS i FROM vs), m AS (SELECT DISTINCT concept_id, chunk_id FROM mention WHERE concept_id IS NOT NULL),
 s AS (SELECT concept_id, i, sum(x) AS x FROM m JOIN u USING (chunk_id) GROUP BY 1, 2) SELECT concept_id, i::BIGINT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY concept_id)), 6) AS x FROM s""",
    "neighbour_concepts": _CTE + "SELECT concept_id, anchor_id, round(similarity, 6) AS similarity FROM nbr",
    "dismissed_targets": _CTE + "SELECT DISTINCT target FROM dis",
    "active_suggestions": _CTE + "SELECT kind || ':' || target AS id, round(score, 6) AS score FROM cand WHERE target NOT LIKE '%0' AND TIMESTAMP '2025-01-01' + to_days(length(target)::INTEGER) > TIMESTAMP '2025-01-12' ORDER BY cand.score DESC, id LIMIT 10",
    "literal_search": "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'practice session')",
    "hash_embedding": f"WITH {_TEXTS}, l AS (SELECT chunk_id AS id, text AS t FROM tx), {_EMBED} SELECT id AS chunk_id, i, round(y, 6) AS x FROM em",
}
