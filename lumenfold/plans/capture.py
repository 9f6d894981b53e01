"""Queries of capture, deletion, egress, evidence and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schema
from lumenfold.functions import identity as I
from lumenfold.functions import privacy as P
from lumenfold.functions.spotter import STOP
from lumenfold.operators import capture as C
from lumenfold.operators import citations as K
from lumenfold.operators import items as Q
from lumenfold.operators.sync import merged_sources
from lumenfold.plans.coverage import _CTE, _concept, _coverage
from lumenfold.plans.dealt import DOI_SQL
from lumenfold.plans.learning import _REV, _TOP40, domain_reviews
from lumenfold.plans.text import _canon
from lumenfold.session import Scratch
from lumenfold.sources import pages as P_
from lumenfold.tables import iso, table

TABLES = ("ingestion_event", "document_version", "chunk", "mention", "embedding_meta", "concept", "citation", "reading_source", "edge")


def _all(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(s, d, t) for t in TABLES}


def capture_fold(s: SparkSession, d: str) -> DataFrame:
    return C.captured(table(s, d, "reading_source"), Scratch(s, "capture")).select("source_id", "kind", iso("first_seen_at").alias("first_seen_at"), "is_private", "ids")


def delete_counts(s: SparkSession, d: str) -> DataFrame:
    """What deleting all private sources would remove."""
    return C.cascade(_all(s, d), merged_sources(table(s, d, "reading_source")).filter("is_private"))[1].select(F.col("table").alias("tab"), F.col("rows").alias("n"))


def egress_summary(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "fetched_document").distinct()
    return C.egress_summary(f.select(I.url_host(F.col("final_url")).alias("destination"), F.col("content_type").alias("purpose"), F.col("n_bytes").alias("bytes_sent")))


def redacted_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fetched_document").select(F.col("final_url").alias("url"), P.redact_url(F.col("final_url")).alias("redacted")).distinct()


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return Q.evidence(table(s, d, "mention"), table(s, d, "chunk"), table(s, d, "document_version"), merged_sources(table(s, d, "reading_source")))


def evidence_spans(s: SparkSession, d: str) -> DataFrame:
    return _evidence(s, d).select("concept_id", "chunk_id", "is_primary", "confidence", "rank")


def _drafts(s: SparkSession, d: str) -> DataFrame:
    return Q.drafts(_evidence(s, d), table(s, d, "document_version"), _concept(s, d))


def item_drafts(s: SparkSession, d: str) -> DataFrame:
    return _drafts(s, d).select("concept_id", "kind", "prompt", F.size("points").cast("long").alias("n_points"))


def item_groundedness(s: SparkSession, d: str) -> DataFrame:
    """Groundedness of drafts, of which those of concepts whose id has an md5 below 8 cite a span that is one character off."""
    off = F.when(F.substring(F.md5("concept_id"), 1, 1) < "8", 1).otherwise(0)
    moved = F.transform("points", lambda p: p.withField("start", p["start"] + F.col("off")).withField("end", p["end"] + F.col("off")))
    draft = _drafts(s, d).withColumn("off", off.cast("long")).withColumn("points", moved)
    return Q.grounded(draft, table(s, d, "document_version"))


def generated_items(s: SparkSession, d: str) -> DataFrame:
    """Grounded items of the fifty concepts that need some most; concepts whose id has an md5 below 4 have items."""
    scratch = Scratch(s, "generate")
    cov = _coverage(s, d)
    have = cov.filter(F.substring(F.md5("concept_id"), 1, 1) < "4").select("concept_id", F.lit(None).cast("timestamp").alias("retired_at"))
    draft = scratch.put(_drafts(s, d).join(F.broadcast(Q.wanting(cov, have)), "concept_id", "left_semi"))
    ok = Q.grounded(draft, table(s, d, "document_version")).filter("grounded")
    return draft.join(ok, ["concept_id", "kind"], "left_semi").select("concept_id", "kind", F.size("points").cast("long").alias("n_points"))


def forgotten(s: SparkSession, d: str) -> DataFrame:
    """What forgetting the most mentioned concept removes."""
    m = table(s, d, "mention")
    top = m.filter("concept_id is not null").groupBy("concept_id").count().orderBy(F.desc("count"), "concept_id").limit(1).first()[0]
    tables = {"mention": m, "edge": table(s, d, "edge"), "review": domain_reviews(s, d), "concept": table(s, d, "concept")}
    return C.forget_concept(tables, top)[1]


def privacy_state(s: SparkSession, d: str) -> DataFrame:
    return C.privacy(table(s, d, "reading_source"))


def annotations_for(s: SparkSession, d: str) -> DataFrame:
    """The annotations of the source with most of them."""
    notes = table(s, d, "documents").filter("source = 'annotation' and source_id is not null")
    top = notes.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(1).first()
    return C.annotations_for(notes, top[0] if top else "", "doc_id").select("doc_id", "title")


def resolved_captures(s: SparkSession, d: str) -> DataFrame:
    """Every DOI, URL and hash of the sources taken for a capture of each kind."""
    r = table(s, d, "reading_source").select("doi", "canonical_url", "title")
    kinds = [("doi", "doi"), ("url", "canonical_url"), ("pdf", "canonical_url"), ("url", "title"), ("pdf", "title"), ("text", "title"), ("doi", "title")]
    parts = [r.select(F.lit(k).alias("kind"), F.col(c).alias("payload")).filter("payload is not null") for k, c in kinds]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return C.resolved(out.distinct())


def ingested_citations(s: SparkSession, d: str) -> DataFrame:
    """Public sources with a DOI, at most 500 by DOI: references found, or that the work is not known."""
    return K.ingest(merged_sources(table(s, d, "reading_source")), K.works(table(s, d, "scholar_work")), K.citations(table(s, d, "citation")))


def ingested_pages(s: SparkSession, d: str) -> DataFrame:
    """Fetched pages as they are ingested: outcome, source, title and words of each."""
    return P_.ingest(table(s, d, "fetched_document")).select("fetch_id", "source_id", "outcome", "title", "words")


def keyword_grade(s: SparkSession, d: str) -> DataFrame:
    """Whether a document's text covers the terms of its title."""
    return table(s, d, "documents").select("doc_id", Q.keyword_grade(F.col("text"), F.col("title")).alias("met"))


def validation_report(s: SparkSession, d: str) -> DataFrame:
    return schema.report(_all(s, d))


_FNS = (
    capture_fold, delete_counts, egress_summary, redacted_urls, evidence_spans, item_drafts, item_groundedness, generated_items, forgotten, privacy_state, annotations_for, resolved_captures, ingested_citations, ingested_pages,
    keyword_grade, validation_report,
)
QUERIES = {f.__name__: f for f in _FNS}

_D = DOI_SQL.format
_ARX = "('10.48550/arxiv.' || nullif(regexp_extract(canonical_url, '(?i)arxiv\\.org/(?:abs|pdf)/([0-9]{4}\\.[0-9]{4,5})', 1), ''))"
_PRIV = "(SELECT id FROM reading_source WHERE id IS NOT NULL GROUP BY id HAVING coalesce(bool_or(is_private), false))"
_TERMS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 3 AND w NOT IN ({', '.join(repr(x) for x in sorted(STOP))})))"
_EV = f"""WITH m AS (SELECT concept_id, chunk_id, max(coalesce(is_primary, false)) AS is_primary, max(confidence) AS confidence FROM mention WHERE concept_id IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT id, any_value(document_version_id) AS dv, any_value(start_char) AS a, any_value(end_char) AS b FROM chunk GROUP BY 1), v AS (SELECT id, any_value(source_id) AS source_id, any_value(text) AS text FROM document_version GROUP BY 1),
 e AS (SELECT m.*, c.a, c.b, c.dv, v.source_id, v.text, row_number() OVER (PARTITION BY concept_id ORDER BY is_primary DESC, confidence DESC NULLS LAST, chunk_id)::INTEGER AS rank FROM m JOIN c ON c.id = m.chunk_id JOIN v ON v.id = c.dv WHERE v.source_id IN (SELECT id FROM reading_source) AND v.source_id NOT IN {_PRIV})
"""
_DRAFTS = _EV + """, cc AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST, (deleted_at IS NULL) DESC, label DESC NULLS LAST) AS n FROM concept WHERE id IS NOT NULL) WHERE n = 1 AND deleted_at IS NULL),
 pt AS (SELECT concept_id, rank, struct_pack(t := trim(s, chr(32) || chr(9) || chr(10) || chr(13)), dv := dv, a := a + position(s IN body) - 1, b := a + position(s IN body) - 1 + length(s)) AS p FROM (SELECT concept_id, rank, dv, a, substr(text, a + 1, b - a) AS body, nullif(regexp_extract(substr(text, a + 1, b - a), '(?s)([^.!?]{25,400}[.!?])', 1), '') AS s FROM e WHERE rank <= 3) WHERE s IS NOT NULL),
 sr AS (SELECT concept_id, count(DISTINCT source_id) AS k FROM e WHERE rank <= 8 GROUP BY 1), pp AS (SELECT concept_id, list(p ORDER BY rank) AS pts FROM pt GROUP BY 1),
 dr AS (SELECT concept_id, pts, kind, CASE kind WHEN 'cloze' THEN 'Fill in: ' || regexp_replace(pts[1].t, regexp_escape(label), '_____', 'gi') WHEN 'synthesis' THEN 'Compare what your sources say about ' || label ELSE 'What is claimed about ' || label || '?' END AS prompt
  FROM (SELECT *, unnest(CASE WHEN k >= 2 THEN ['free_recall', 'cloze', 'synthesis'] ELSE ['free_recall', 'cloze'] END) AS kind FROM pp JOIN sr USING (concept_id) JOIN cc ON cc.id = pp.concept_id))
"""
_VISIBLE = lambda c: f"regexp_replace(regexp_replace({c}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_OUTCOME = "CASE WHEN body IS NULL OR body = '' THEN 'no_content' WHEN http_status <> 200 THEN 'http_error' WHEN NOT starts_with(coalesce(content_type, ''), 'text/') THEN 'not_text' WHEN words < 50 THEN 'too_short' ELSE 'ok' END"
ORACLES = {
    "capture_fold": f"""WITH RECURSIVE {_canon('reading_source', 'canonical_url')}, k AS (SELECT *, coalesce({_D('doi')}, {_D('canonical_url')}, {_ARX}) AS nd FROM cu WHERE id IS NOT NULL),
 x AS (SELECT DISTINCT id, 'd:' || nd AS y FROM k WHERE nd IS NOT NULL UNION SELECT id, 'u:' || canonical FROM k WHERE canonical IS NOT NULL UNION SELECT id, 'h:' || content_hash FROM k WHERE content_hash IS NOT NULL),
 n AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.y = b.y), r AS (SELECT DISTINCT id AS v, id AS o FROM k UNION SELECT n.b, r.o FROM r JOIN n ON n.a = r.v), g AS (SELECT v AS id, min(o) AS g FROM r GROUP BY 1),
 z AS (SELECT g, min(nd) AS nd, min(canonical) AS canonical, min(content_hash) AS content_hash, min(kind) AS kind, min(first_seen_at) AS f, coalesce(bool_or(is_private), false) AS is_private, count(DISTINCT k.id) AS ids FROM k JOIN g ON g.id = k.id GROUP BY 1)
 SELECT coalesce('s-doi-' || substr(sha256('doi:' || nd), 1, 24), 's-url-' || substr(sha256('url:' || canonical), 1, 24), 's-cnt-' || substr(sha256('content:' || content_hash), 1, 24), 's-loc-' || g) AS source_id,
 CASE WHEN nd IS NOT NULL THEN 'paper' ELSE kind END AS kind, strftime(f, '%Y-%m-%d %H:%M:%S') AS first_seen_at, is_private, ids FROM z""",
    "delete_counts": f"""WITH p AS {_PRIV}, dv AS (SELECT DISTINCT id FROM document_version WHERE source_id IN (SELECT id FROM p)), ch AS (SELECT DISTINCT id FROM chunk WHERE document_version_id IN (SELECT id FROM dv))
 SELECT 'ingestion_event' AS tab, count(*) AS n FROM ingestion_event WHERE source_id IN (SELECT id FROM p) UNION ALL SELECT 'document_version', count(*) FROM document_version WHERE source_id IN (SELECT id FROM p) UNION ALL SELECT 'chunk', count(*) FROM chunk WHERE document_version_id IN (SELECT id FROM dv)
 UNION ALL SELECT 'mention', count(*) FROM mention WHERE chunk_id IN (SELECT id FROM ch) UNION ALL SELECT 'embedding_meta', count(*) FROM embedding_meta WHERE chunk_id IN (SELECT id FROM ch)""",
    "egress_summary": "SELECT regexp_replace(lower(regexp_extract(final_url, '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1, 'i')), '^www\\.', '') AS destination, content_type AS purpose, count(*) AS calls, coalesce(sum(n_bytes), 0)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM fetched_document) GROUP BY 1, 2",
    "evidence_spans": _EV + "SELECT concept_id, chunk_id, is_primary, confidence, rank FROM e WHERE rank <= 8",
    "item_drafts": _DRAFTS + "SELECT concept_id, kind, prompt, len(pts) AS n_points FROM dr",
    "item_groundedness": _DRAFTS + """, ck AS (SELECT concept_id, kind, unnest(pts) AS p FROM dr) SELECT concept_id, kind, bool_and(coalesce(trim(substr(v.text, p.a + 1 + o, p.b - p.a), chr(32) || chr(9) || chr(10) || chr(13)) = p.t, false)) AS grounded
 FROM (SELECT *, CASE WHEN substr(md5(concept_id), 1, 1) < '8' THEN 1 ELSE 0 END AS o FROM ck) LEFT JOIN (SELECT id, min(text) AS text FROM document_version GROUP BY 1) v ON v.id = p.dv AND p.b + o <= length(v.text) GROUP BY 1, 2""",
    "generated_items": _DRAFTS.replace("WITH m AS", _CTE + ", m AS") + ", wn AS (SELECT concept_id FROM cov WHERE substr(md5(concept_id), 1, 1) >= '4' ORDER BY primary_sources DESC, distinct_sources DESC, concept_id LIMIT 50) SELECT concept_id, kind, len(pts) AS n_points FROM dr WHERE concept_id IN (SELECT concept_id FROM wn)",
    "forgotten": _REV + _TOP40 + ", t AS (SELECT concept_id FROM top40 WHERE k = 0) SELECT 'mention' AS tab, count(*) AS n FROM mention WHERE concept_id IN (SELECT * FROM t) UNION ALL SELECT 'edge', count(*) FROM edge WHERE from_concept IN (SELECT * FROM t) OR to_concept IN (SELECT * FROM t) UNION ALL SELECT 'review', count(*) FROM rev WHERE concept_id = 0 UNION ALL SELECT 'concept', count(*) FROM concept WHERE id IN (SELECT * FROM t)",
    "privacy_state": "SELECT id, arg_max(is_private, (coalesce(recorded_at, TIMESTAMP '1900-01-01'), is_private)) AS is_private FROM reading_source WHERE id IS NOT NULL AND is_private IS NOT NULL GROUP BY 1",
    "annotations_for": "WITH n AS (SELECT * FROM documents WHERE source = 'annotation' AND source_id IS NOT NULL) SELECT doc_id, title FROM n WHERE source_id = (SELECT source_id FROM n GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 1)",
    "resolved_captures": f"""WITH z AS (SELECT DISTINCT * FROM (SELECT 'doi' AS kind, doi AS payload FROM reading_source UNION ALL SELECT unnest(['url', 'pdf']), canonical_url FROM reading_source UNION ALL SELECT unnest(['url', 'pdf', 'text', 'doi']), title FROM reading_source) WHERE payload IS NOT NULL), {_canon('z', 'payload')},
 y AS (SELECT kind, payload, CASE WHEN kind IN ('url', 'pdf') THEN canonical END AS url FROM cu), x AS (SELECT *, CASE WHEN kind = 'doi' THEN {_D('payload')} WHEN url IS NOT NULL THEN coalesce({_D('payload')}, {_ARX.replace('canonical_url', 'payload')}) END AS doi FROM y),
 w AS (SELECT *, CASE WHEN kind = 'doi' AND doi IS NULL THEN 'not_a_doi' WHEN kind = 'url' AND url IS NULL THEN 'not_a_url' END AS problem FROM x) SELECT kind, payload, doi, url, CASE WHEN problem IS NULL THEN CASE WHEN doi IS NOT NULL THEN 'paper' WHEN kind = 'text' THEN 'note' WHEN kind = 'pdf' THEN 'pdf' WHEN kind = 'url' THEN 'web' END END AS source_kind, problem FROM w""",
    "ingested_citations": _CTE + f""", so AS (SELECT {_D('doi')} AS doi FROM (SELECT id, min(doi) AS doi, coalesce(bool_or(is_private), false) AS p FROM reading_source WHERE id IS NOT NULL GROUP BY 1) WHERE NOT p), s5 AS (SELECT DISTINCT doi FROM so WHERE doi IS NOT NULL ORDER BY doi LIMIT 500)
 SELECT s5.doi, (SELECT count(*) FROM ct WHERE ct.from_doi = s5.doi AND wo.doi IS NOT NULL) AS n_references, CASE WHEN wo.doi IS NULL THEN 'unknown_work' ELSE 'ok' END AS state FROM s5 LEFT JOIN wo ON wo.doi = s5.doi""",
    "ingested_pages": f"""WITH z AS (SELECT DISTINCT * FROM fetched_document WHERE fetch_id IS NOT NULL), {_canon('z', 'final_url')}, y AS (SELECT fetch_id, canonical, body, http_status, content_type, {_VISIBLE('body')} AS vis FROM cu), x AS (SELECT *, len(list_filter(regexp_split_to_array(vis, '\\s+'), lambda w: w <> '')) AS words FROM y)
 SELECT fetch_id, coalesce('s-url-' || substr(sha256('url:' || canonical), 1, 24), 's-cnt-' || substr(sha256('content:' || sha256(body)), 1, 24)) AS source_id, {_OUTCOME} AS outcome, CASE WHEN {_OUTCOME} = 'ok' THEN nullif(trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') END AS title, CASE WHEN {_OUTCOME} = 'ok' THEN words END AS words FROM x""",
    "keyword_grade": f"SELECT doc_id, CASE WHEN len({_TERMS('title')}) > 0 THEN len(list_intersect({_TERMS('title')}, {_TERMS('text')})) >= 0.4 * len({_TERMS('title')}) END AS met FROM documents",
    "validation_report": f"""SELECT 'novelty_without_model' AS rule, count(*) FILTER (WHERE novelty IS NOT NULL AND novelty_model_id IS NULL) AS violations FROM ingestion_event
 UNION ALL SELECT 'unknown_engagement', count(*) FILTER (WHERE engagement NOT IN ('skim', 'read', 'annotate', 'apply', 'teach')) FROM ingestion_event UNION ALL SELECT 'local_concept_without_prefix', count(*) FILTER (WHERE scheme = 'local' AND NOT starts_with(id, 'local:')) FROM concept
 UNION ALL SELECT 'empty_span', count(*) FILTER (WHERE end_char <= start_char) FROM mention UNION ALL SELECT 'confidence_out_of_range', count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 1) FROM mention UNION ALL SELECT 'empty_chunk', count(*) FILTER (WHERE end_char <= start_char) FROM chunk
 UNION ALL SELECT 'self_citation', count(*) FILTER (WHERE f = t) FROM (SELECT {_D('from_doi')} AS f, {_D('to_doi')} AS t FROM citation) UNION ALL SELECT 'dimension_mismatch', count(*) FILTER (WHERE len(vector) <> dim) FROM embedding_meta
 UNION ALL SELECT 'no_identity', count(*) FILTER (WHERE canonical_url IS NULL AND doi IS NULL AND content_hash IS NULL) FROM reading_source UNION ALL SELECT 'unknown_relation', count(*) FILTER (WHERE relation NOT IN ('subclass_of', 'part_of', 'co_occurs', 'user_linked', 'cites')) FROM edge
 UNION ALL SELECT 'unknown_provenance', count(*) FILTER (WHERE provenance NOT IN ('vocabulary', 'corpus_stats', 'user', 'citation_graph')) FROM edge""",
}
