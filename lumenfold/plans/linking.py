"""Queries of linking: candidates, mentions, corrections, merges, hierarchy import and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import ports as O
from lumenfold.functions import privacy as P
from lumenfold.functions.spotter import spot
from lumenfold.operators import linking as L
from lumenfold.operators import vectors as E
from lumenfold.operators.sync import merged_sources
from lumenfold.plans.coverage import MODEL, _concept
from lumenfold.session import Scratch
from lumenfold.tables import table


def _forms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mention").select(F.col("surface_form").alias("form"))


def _names(s: SparkSession, d: str) -> DataFrame:
    return L.names(table(s, d, "concept"))


def rule_link(s: SparkSession, d: str) -> DataFrame:
    return L.link(_forms(s, d), _names(s, d))


def link_candidates(s: SparkSession, d: str) -> DataFrame:
    return L.candidates(_forms(s, d), _names(s, d)).select("form", F.array_join("concepts", ",").alias("concepts"), "exact")


def _targets(s: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    e = table(s, d, "edge").filter("relation = 'user_linked' and from_concept <> to_concept")
    return L.resolve_merges(e, "from_concept", "to_concept", scratch)


def merge_resolution(s: SparkSession, d: str) -> DataFrame:
    return _targets(s, d, Scratch(s, "merges"))


def _chunks(s: SparkSession, d: str, public: bool = True) -> DataFrame:
    """``(chunk_id, start_char, text, title)`` of every chunk, without those of private sources."""
    source = merged_sources(table(s, d, "reading_source"))
    source = source.filter("not is_private") if public else source
    v = table(s, d, "document_version").filter("id is not null").groupBy(F.col("id").alias("document_version_id")).agg(F.min(F.struct("source_id", "text")).alias("v"))
    c = table(s, d, "chunk").filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("document_version_id", "start_char", "end_char")).alias("c")).select("chunk_id", "c.*")
    titles = source.select(F.col("id").alias("source_id"), "title")
    full = c.hint("merge").join(v.hint("merge"), "document_version_id").join(titles.hint("merge"), F.col("v.source_id") == F.col("source_id"))  # by the size of their files, planners broadcast them
    return full.select("chunk_id", "start_char", F.expr("substring(v.text, cast(start_char + 1 as int), cast(end_char - start_char as int))").alias("text"), "title")


def _public_chunks(s: SparkSession, d: str) -> DataFrame:
    """``chunk_id`` of what ``_chunks`` has, found without texts and titles; of rows of one id the same counts."""
    source = merged_sources(table(s, d, "reading_source")).filter("not is_private").select(F.col("id").alias("source_id"))
    v = table(s, d, "document_version").filter("id is not null").groupBy(F.col("id").alias("document_version_id")).agg(F.min(F.struct("source_id")).alias("v")).select("document_version_id", "v.source_id")
    c = table(s, d, "chunk").filter("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("document_version_id")).alias("c")).select("chunk_id", "c.document_version_id")
    return c.hint("merge").join(v.hint("merge").join(source.hint("merge"), "source_id", "left_semi"), "document_version_id", "left_semi").select("chunk_id")


def link_mentions(s: SparkSession, d: str) -> DataFrame:
    """The spans of all mentions linked anew."""
    spans = table(s, d, "mention").filter("surface_form is not null").select("chunk_id", "start_char", "end_char", "surface_form").distinct()
    return L.link_spots(spans, _chunks(s, d), _names(s, d), _targets(s, d, Scratch(s, "link"))).select("chunk_id", "concept_id", "start_char", "end_char", "confidence", "is_primary")


def link_all(s: SparkSession, d: str) -> DataFrame:
    """Every chunk of every public version spotted as it stands, so places are those of the version, and linked by its redacted text."""
    scratch = Scratch(s, "linkall")
    c = _chunks(s, d)
    chunks = scratch.put(c.select("chunk_id", "start_char", F.col("text").alias("whole"), P.redact(F.col("text"))[0].alias("text"), "title")).hint("merge")
    found = spot(chunks, "chunk_id", "whole").withColumnRenamed("key", "chunk_id").join(chunks.select("chunk_id", F.col("start_char").alias("at")), "chunk_id")
    spans = found.select("chunk_id", (F.col("start_char") + F.col("at")).alias("start_char"), (F.col("end_char") + F.col("at")).alias("end_char"), "surface_form")
    return L.link_spots(spans, chunks, _names(s, d), _targets(s, d, scratch))


def link_egress(s: SparkSession, d: str) -> DataFrame:
    """What a model-backed linker would be sent per public chunk: characters and redactions."""
    text, n = P.redact(F.col("text"))
    out = _chunks(s, d).withColumn("redactions", sum(n.values(), F.lit(0)))
    return out.select("chunk_id", F.lit("model_proxy").alias("destination"), F.lit("link").alias("purpose"), F.col("redactions").cast("long").alias("redactions"), F.length(text).cast("long").alias("chars"))


def local_concepts(s: SparkSession, d: str) -> DataFrame:
    """Local concepts that linking the mentions makes and that are not known yet."""
    spots = table(s, d, "mention").filter("surface_form is not null").select("chunk_id", "surface_form")
    made = L.local_mentions(spots, _public_chunks(s, d), _names(s, d), table(s, d, "concept"))
    return L.new_locals(made, table(s, d, "concept")).select("id", "scheme")


def _model(s: SparkSession, d: str, like: str) -> DataFrame:
    return table(s, d, "mention").filter(F.col("model_id").like(like) & F.col("id").isNotNull()).dropDuplicates(["id"])


def overridden_mentions(s: SparkSession, d: str) -> DataFrame:
    """The rule model's mentions corrected by the judge model: what it doubts is rejected, what it is sure of is added."""
    judge = _model(s, d, "judge%").filter("concept_id is not null")
    rejected, added = judge.filter("confidence < 0.7").select("chunk_id", "concept_id"), judge.filter("confidence >= 0.95").select("chunk_id", "concept_id")
    return L.apply_overrides(_model(s, d, "rule%").filter("concept_id is not null"), rejected, added, _targets(s, d, Scratch(s, "over")), _chunks(s, d, public=False), _concept(s, d))


def reconciled_decisions(s: SparkSession, d: str) -> DataFrame:
    """The judge model's mentions taken for its decisions about those of the rule model."""
    return L.reconcile(_model(s, d, "rule%"), _model(s, d, "judge%"), L.candidates(_forms(s, d), _names(s, d)))


def port_decisions(s: SparkSession, d: str) -> DataFrame:
    """The rule model's mentions decided anew through the ports; they are made unique once and written, as ports read them often."""
    scratch = Scratch(s, "ports")
    asked = scratch.put(_model(s, d, "rule%").select("id", "chunk_id", "surface_form", "start_char", "end_char"))
    return O.linked(O.RuleLinker(), asked, O.TableVocabulary(table(s, d, "concept"), table(s, d, "edge"), scratch)).select("id", "concept_id", "confidence")


def imported_hierarchy(s: SparkSession, d: str) -> DataFrame:
    """Vocabulary edges above every concept that is mentioned, as they are stored: weight 1."""
    used = table(s, d, "mention").select(F.col("concept_id").alias("id"))
    return L.ancestors(table(s, d, "edge"), used, Scratch(s, "up")).select("from_concept", "to_concept", "relation", F.lit(1.0).alias("weight"))


def _proposals(s: SparkSession, d: str, *least: float) -> DataFrame:
    centroid = E.centroids(E.vectors(table(s, d, "embedding_meta"), MODEL), table(s, d, "mention"))
    kept_apart = table(s, d, "edge").filter("provenance = 'user' and weight = 0").select(F.col("from_concept").alias("a"), F.col("to_concept").alias("b"))
    out = L.proposed_merges(_concept(s, d), centroid, kept_apart, *least)
    return out.select("from_id", "to_id", F.round("label_similarity", 6).alias("label_similarity"), F.round("centroid_similarity", 6).alias("centroid_similarity"), "auto_applicable")


def merge_proposals(s: SparkSession, d: str) -> DataFrame:
    return _proposals(s, d)


def merge_proposals_wide(s: SparkSession, d: str) -> DataFrame:
    """The same with thresholds of 0.3 for labels and 0.1 for centroids."""
    return _proposals(s, d, 0.3, 0.1, 0.5)


def label_classes(s: SparkSession, d: str) -> DataFrame:
    return L.similar_labels(table(s, d, "concept"))[1]


def _judged(s: SparkSession, d: str, least: float = L.NIL_BELOW) -> DataFrame:
    """The judge model's mentions as gold for the rule model's."""
    return L.judged(_model(s, d, "judge%"), _model(s, d, "rule%"), least)


def linking_errors(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).filter("kind not in ('correct', 'correct_nil')").select("g_id", "expected", "actual", "kind")


def linking_eval(s: SparkSession, d: str) -> DataFrame:
    exact = ["precision", "recall", "f1", "nil_accuracy", "primary_accuracy"]
    return L.evaluation(_judged(s, d)).withColumns({c: F.round(c, 6) for c in exact})


def linking_report(s: SparkSession, d: str) -> DataFrame:
    return L.report(L.evaluation(_judged(s, d)))


def identity_stability(s: SparkSession, d: str) -> DataFrame:
    """Two runs of the rule model: everything it links, and only what it is surer of."""
    scratch = Scratch(s, "stability")
    return L.stability(scratch.put(_judged(s, d)), scratch.put(_judged(s, d, 0.8))).withColumn("stability", F.round("stability", 6))


_FNS = (
    rule_link, link_candidates, link_mentions, link_all, link_egress, local_concepts, overridden_mentions, reconciled_decisions, port_decisions, imported_hierarchy, merge_resolution, merge_proposals, merge_proposals_wide, label_classes,
    linking_errors, linking_eval, linking_report, identity_stability,
)
QUERIES = {f.__name__: f for f in _FNS}

_FOLD = lambda c: f"trim(regexp_replace(lower({c}), '[\\s\\x{{A0}}]+', ' ', 'g'))"
_CO = """co AS (SELECT id, scheme, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST, (deleted_at IS NULL) DESC, label DESC NULLS LAST) AS n FROM concept WHERE id IS NOT NULL) WHERE n = 1 AND deleted_at IS NULL)"""
_CAND = f"""nm AS (SELECT DISTINCT {_FOLD('f')} AS alias, id AS concept_id FROM (SELECT id, unnest(list_concat([label], coalesce(aliases, []))) AS f FROM concept WHERE id IS NOT NULL) WHERE {_FOLD('f')} <> ''),
 fo AS (SELECT DISTINCT {_FOLD('surface_form')} AS form FROM mention WHERE {_FOLD('surface_form')} <> ''),
 mt AS (SELECT form, concept_id, true AS exact FROM fo JOIN nm ON nm.alias = fo.form UNION SELECT form, concept_id, false FROM fo JOIN nm ON contains(nm.alias, fo.form) OR contains(fo.form, nm.alias) WHERE fo.form NOT IN (SELECT alias FROM nm)),
 cd AS (SELECT form, list(concept_id ORDER BY concept_id) AS ids, any_value(exact) AS exact FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY concept_id) AS n FROM mt) WHERE n <= 8 GROUP BY 1)"""
_MERGE = """me AS (SELECT from_concept AS a, min(to_concept) AS b FROM edge WHERE relation = 'user_linked' AND from_concept <> to_concept GROUP BY 1),
 mw AS (SELECT a AS start, b AS cur, [a] AS seen FROM me UNION ALL SELECT mw.start, me.b, list_append(mw.seen, mw.cur) FROM mw JOIN me ON me.a = mw.cur WHERE NOT list_contains(mw.seen, mw.cur)),
 mx AS (SELECT start, arg_max(cur, len(seen)) AS cur, arg_max(seen, len(seen)) AS seen FROM mw GROUP BY 1),
 tg AS (SELECT start AS concept_id, CASE WHEN list_contains(seen, cur) THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS target_id FROM mx)"""
_CHUNKS = """ps AS (SELECT id, min(title) AS title, coalesce(bool_or(is_private), false) AS private FROM reading_source WHERE id IS NOT NULL GROUP BY 1),
 dv AS (SELECT id, unnest(min(struct_pack(source_id, text))) FROM document_version WHERE id IS NOT NULL GROUP BY 1), cc AS (SELECT id AS chunk_id, unnest(min(struct_pack(document_version_id, start_char, end_char))) FROM chunk WHERE id IS NOT NULL GROUP BY 1),
 ch AS (SELECT chunk_id, start_char AS at_, substr(text, start_char + 1, end_char - start_char) AS text, title, private FROM cc JOIN dv ON dv.id = cc.document_version_id JOIN ps ON ps.id = dv.source_id)"""
_SLUG = "('local:' || nullif(regexp_replace(regexp_replace(lower(surface_form), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''))"
_LINKED = f"""sp AS (SELECT DISTINCT chunk_id, start_char, end_char, surface_form, {_FOLD('surface_form')} AS form FROM mention WHERE {_FOLD('surface_form')} <> ''),
 lk AS (SELECT sp.*, cd.ids[1] AS found, CASE WHEN cd.ids IS NULL OR cd.exact THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence, cd.ids IS NOT NULL AND (coalesce(contains({_FOLD('title')}, sp.form), false) OR (length({_FOLD('text')}) - length(replace({_FOLD('text')}, sp.form, ''))) // length(sp.form) >= 2) AS is_primary
  FROM sp JOIN ch ON ch.chunk_id = sp.chunk_id AND NOT private LEFT JOIN cd ON cd.form = sp.form), ln AS (SELECT *, coalesce(found, {_SLUG}) AS c0 FROM lk WHERE coalesce(found, {_SLUG}) IS NOT NULL)"""
_STEM = "CASE WHEN regexp_full_match(x, '[a-z0-9_]+ies') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_full_match(x, '[a-z0-9_]+es') THEN regexp_replace(x, 'es$', '') WHEN regexp_full_match(x, '[a-z0-9_]+s') THEN regexp_replace(x, 's$', '') ELSE x END"
_LAB = lambda rel: f"""t0 AS (SELECT id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''), lambda x: {_STEM}))) AS t FROM {rel} WHERE label IS NOT NULL),
 t AS (SELECT id, min(t) AS t FROM t0 WHERE len(t) > 0 GROUP BY 1), c AS (SELECT t, min(id) AS class_id FROM t GROUP BY 1)"""  # noqa: E731


def _merges_sql(label: float, centroid: float, auto: float) -> str:
    return f"""WITH {_CO}, lo AS (SELECT * FROM co WHERE scheme = 'local'), {_LAB('lo')}, vs AS (SELECT chunk_id, any_value(vector)::DOUBLE[] AS v FROM embedding_meta WHERE model_id = '{MODEL}' AND vector IS NOT NULL AND len(vector) = dim AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY 1),
 u AS (SELECT chunk_id, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) AS i FROM vs), m AS (SELECT DISTINCT concept_id, chunk_id FROM mention WHERE concept_id IN (SELECT id FROM lo)),
 ce AS (SELECT concept_id, list(x ORDER BY i) AS v FROM (SELECT concept_id, i, sum(x) AS x FROM m JOIN u USING (chunk_id) GROUP BY 1, 2) GROUP BY 1),
 pr AS (SELECT x.class_id AS a, y.class_id AS b, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))::DOUBLE AS s FROM c x JOIN c y ON x.class_id < y.class_id UNION ALL SELECT class_id, id, 1.0 FROM t JOIN c USING (t) WHERE id <> class_id),
 bl AS (SELECT least(from_concept, to_concept) AS a, greatest(from_concept, to_concept) AS b FROM edge WHERE provenance = 'user' AND weight = 0),
 z AS (SELECT pr.*, list_cosine_similarity(p.v, q.v) AS cs FROM pr JOIN ce p ON p.concept_id = a JOIN ce q ON q.concept_id = b WHERE s >= {label} AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.a = pr.a AND bl.b = pr.b))
 SELECT b AS from_id, a AS to_id, round(s, 6) AS label_similarity, round(cs, 6) AS centroid_similarity, s >= {auto} AND cs >= {auto} AS auto_applicable FROM z WHERE cs >= {centroid}"""


def _judged_sql(name: str, least: float) -> str:
    """CTE ``name`` of judged mentions; needs ``go``, ``pd`` and ``mtc``."""
    return f"""{name} AS (SELECT *, CASE WHEN kind = 'wrong_primary' THEN 'primary=' || p_primary::VARCHAR ELSE actual0 END AS actual FROM (SELECT *, CASE WHEN expected IS NULL THEN CASE WHEN actual0 IS NULL THEN 'correct_nil' ELSE 'spurious_link' END WHEN p_id IS NULL THEN 'not_spotted' WHEN actual0 IS NULL THEN 'missed_link'
  WHEN actual0 <> expected THEN 'wrong_concept' WHEN g_primary = p_primary THEN 'correct' ELSE 'wrong_primary' END AS kind FROM (SELECT go.id AS g_id, go.chunk_id, go.start_char, go.end_char, go.surface_form, go.concept_id AS expected, coalesce(go.is_primary, false) AS g_primary, pd.id AS p_id,
  CASE WHEN pd.confidence >= {least} THEN pd.concept_id END AS actual0, coalesce(pd.is_primary, false) AS p_primary FROM go LEFT JOIN mtc ON mtc.g_id = go.id LEFT JOIN pd ON pd.id = mtc.p_id)))"""


_ONE = lambda like: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS n_ FROM mention WHERE model_id LIKE '{like}' AND id IS NOT NULL) WHERE n_ = 1)"
_MATCH = f"""WITH RECURSIVE go AS {_ONE('judge%')}, pd AS {_ONE('rule%')},
 ov AS (SELECT go.chunk_id, go.id AS gid, pd.id AS pid, row_number() OVER (PARTITION BY go.chunk_id ORDER BY go.start_char, go.end_char, go.id, pd.start_char, pd.end_char, pd.id) AS k FROM go JOIN pd ON pd.chunk_id = go.chunk_id AND go.start_char < pd.end_char AND pd.start_char < go.end_char),
 rc AS (SELECT DISTINCT chunk_id, 0::BIGINT AS k, []::VARCHAR[] AS gs, []::VARCHAR[] AS xs FROM ov UNION ALL SELECT rc.chunk_id, ov.k, CASE WHEN list_contains(gs, gid) OR list_contains(xs, pid) THEN gs ELSE list_append(gs, gid) END, CASE WHEN list_contains(gs, gid) OR list_contains(xs, pid) THEN xs ELSE list_append(xs, pid) END
  FROM rc JOIN ov ON ov.chunk_id = rc.chunk_id AND ov.k = rc.k + 1),
 mtc AS (SELECT unnest(gs) AS g_id, unnest(xs) AS p_id FROM (SELECT arg_max(gs, k) AS gs, arg_max(xs, k) AS xs FROM rc GROUP BY chunk_id)), {_judged_sql('ju', 0.55)}, {_judged_sql('j2', 0.8)}
"""
_COUNTS = lambda rel: f"(SELECT count(expected) AS linkable, count(*) FILTER (WHERE kind IN ('correct', 'wrong_primary')) AS tp, count(*) FILTER (WHERE kind IN ('wrong_concept', 'spurious_link')) AS fp, count(*) FILTER (WHERE kind IN ('not_spotted', 'missed_link', 'wrong_concept')) AS fn, count(*) FILTER (WHERE kind IN ('correct_nil', 'spurious_link')) AS nil_total, count(*) FILTER (WHERE kind = 'correct_nil') AS nil_correct, count(*) FILTER (WHERE kind = 'correct') AS primary_correct, count(*) FILTER (WHERE kind = 'not_spotted') AS missed_by_spotter FROM {rel})"
_RATIOS = "SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(nil_correct / nullif(nil_total, 0)::DOUBLE, 0) AS nil_accuracy, coalesce(primary_correct / nullif(tp, 0)::DOUBLE, 0) AS primary_accuracy FROM "
ORACLES = {
    "rule_link": f"WITH {_CAND} SELECT fo.form, ids[1] AS concept_id, CASE WHEN ids IS NULL OR exact THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM fo LEFT JOIN cd USING (form)",
    "link_candidates": f"WITH {_CAND} SELECT form, array_to_string(ids, ',') AS concepts, exact FROM cd",
    "merge_resolution": f"WITH RECURSIVE {_MERGE} SELECT * FROM tg",
    "link_mentions": f"WITH RECURSIVE {_CAND}, {_MERGE}, {_CHUNKS}, {_LINKED} SELECT chunk_id, coalesce(target_id, c0) AS concept_id, start_char, end_char, max(struct_pack(confidence, is_primary)).confidence AS confidence, max(struct_pack(confidence, is_primary)).is_primary AS is_primary FROM ln LEFT JOIN tg ON tg.concept_id = c0 GROUP BY 1, 2, 3, 4",
    "local_concepts": f"WITH {_CAND}, {_CHUNKS}, {_LINKED} SELECT DISTINCT c0 AS id, 'local' AS scheme FROM ln WHERE c0 LIKE 'local:%' AND c0 NOT IN (SELECT id FROM concept WHERE id IS NOT NULL)",
    "overridden_mentions": f"""WITH RECURSIVE {_MERGE}, {_CHUNKS}, {_CO}, ju AS (SELECT DISTINCT chunk_id, concept_id, confidence FROM {_ONE('judge%')} WHERE concept_id IS NOT NULL), ba AS (SELECT DISTINCT chunk_id, concept_id, start_char, end_char, confidence, is_primary FROM {_ONE('rule%')} WHERE concept_id IS NOT NULL),
 m AS (SELECT * FROM ba WHERE NOT EXISTS (SELECT 1 FROM ju WHERE ju.confidence < 0.7 AND ju.chunk_id = ba.chunk_id AND ju.concept_id = ba.concept_id)),
 fr AS (SELECT DISTINCT chunk_id, concept_id FROM ju WHERE confidence >= 0.95 AND NOT EXISTS (SELECT 1 FROM m WHERE m.chunk_id = ju.chunk_id AND m.concept_id = ju.concept_id)),
 fo AS (SELECT fr.chunk_id, fr.concept_id, at_ + greatest(position(lower(label) IN lower(text)) - 1, 0) AS start_char, at_ + CASE WHEN position(lower(label) IN lower(text)) > 0 THEN position(lower(label) IN lower(text)) - 1 + length(label) ELSE 1 END AS end_char, 1.0::DOUBLE AS confidence, true AS is_primary FROM fr JOIN ch USING (chunk_id) JOIN co ON co.id = fr.concept_id),
 bo AS (SELECT x.*, tg.target_id FROM (SELECT * FROM m UNION ALL SELECT * FROM fo) x LEFT JOIN tg ON tg.concept_id = x.concept_id), st AS (SELECT * FROM bo WHERE target_id IS NULL OR target_id = concept_id),
 mv AS (SELECT chunk_id, target_id AS concept_id, start_char, end_char, confidence, is_primary, row_number() OVER (PARTITION BY chunk_id, target_id ORDER BY start_char, end_char, confidence DESC NULLS LAST, is_primary DESC NULLS LAST) AS n FROM bo WHERE target_id <> concept_id AND NOT EXISTS (SELECT 1 FROM st WHERE st.chunk_id = bo.chunk_id AND st.concept_id = bo.target_id))
 SELECT chunk_id, concept_id, start_char, end_char, confidence, is_primary FROM st UNION ALL SELECT chunk_id, concept_id, start_char, end_char, confidence, is_primary FROM mv WHERE n = 1""",
    "reconciled_decisions": f"""WITH {_CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, surface_form ORDER BY start_char, end_char, id) AS k FROM {_ONE('rule%')}), b AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, surface_form ORDER BY start_char, end_char, id) AS k FROM {_ONE('judge%')}),
 x AS (SELECT a.id, b.concept_id, b.confidence, b.is_primary, coalesce(list_contains(cd.ids, b.concept_id), false) AS ok FROM a LEFT JOIN b ON b.chunk_id = a.chunk_id AND b.surface_form = a.surface_form AND b.k = a.k LEFT JOIN cd ON cd.form = {_FOLD('a.surface_form')})
 SELECT id, CASE WHEN ok THEN concept_id END AS concept_id, CASE WHEN ok THEN greatest(0.0, least(1.0, coalesce(confidence, 0.0))) ELSE 0.0 END::DOUBLE AS confidence, ok AND coalesce(is_primary, false) AS is_primary FROM x""",
    "port_decisions": f"WITH {_CAND}, a AS {_ONE('rule%')} SELECT a.id, cd.ids[1] AS concept_id, CASE WHEN cd.ids IS NULL THEN 0.0 WHEN cd.exact THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM a LEFT JOIN cd ON cd.form = {_FOLD('a.surface_form')}",
    "imported_hierarchy": """WITH RECURSIVE u AS (SELECT DISTINCT from_concept, to_concept, relation FROM edge WHERE provenance = 'vocabulary' AND from_concept IS NOT NULL AND to_concept IS NOT NULL), r AS (SELECT DISTINCT concept_id AS v, 0 AS k FROM mention WHERE concept_id IS NOT NULL UNION SELECT u.to_concept, r.k + 1 FROM r JOIN u ON u.from_concept = r.v WHERE r.k < 3)
 SELECT DISTINCT u.*, 1.0::DOUBLE AS weight FROM u JOIN r ON r.v = u.from_concept""",
    "merge_proposals": _merges_sql(0.5, 0.6, 0.9),
    "merge_proposals_wide": _merges_sql(0.3, 0.1, 0.5),
    "label_classes": f"WITH {_LAB('concept')} SELECT t.id AS concept_id, c.class_id FROM t JOIN c USING (t)",
    "linking_errors": _MATCH + "SELECT g_id, expected, actual, kind FROM ju WHERE kind NOT IN ('correct', 'correct_nil')",
    "linking_eval": _MATCH + "SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(nil_accuracy, 6) AS nil_accuracy, round(primary_accuracy, 6) AS primary_accuracy) FROM (" + _RATIOS + _COUNTS("ju") + ")",
    "linking_report": _MATCH + ", e AS (" + _RATIOS + _COUNTS("ju") + """) SELECT (generate_subscripts(l, 1) - 1)::INTEGER AS n, unnest(l) AS line FROM (SELECT ['linkable ' || linkable || ', without concept ' || nil_total, 'precision ' || printf('%.1f', precision * 100) || '% (' || tp || ' right, ' || fp || ' wrong)',
 'recall ' || printf('%.1f', recall * 100) || '% (' || fn || ' missed, ' || missed_by_spotter || ' not spotted)', 'f1 ' || printf('%.1f', f1 * 100) || '%', 'nil accuracy ' || printf('%.1f', nil_accuracy * 100) || '%', 'primary accuracy ' || printf('%.1f', primary_accuracy * 100) || '%'] AS l FROM e)""",
    "identity_stability": _MATCH + f""", l1 AS (SELECT chunk_id, surface_form, arg_max(struct_pack(v := actual), (start_char, end_char, g_id)).v AS a FROM ju WHERE kind NOT IN ('correct', 'correct_nil') GROUP BY 1, 2), l2 AS (SELECT chunk_id, surface_form, arg_max(struct_pack(v := actual), (start_char, end_char, g_id)).v AS b FROM j2 WHERE kind NOT IN ('correct', 'correct_nil') GROUP BY 1, 2),
 sh AS (SELECT count(*) AS n, count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS same FROM l1 JOIN l2 USING (chunk_id, surface_form)), ag AS (SELECT least(x.tp, y.tp) AS n FROM {_COUNTS('ju')} x, {_COUNTS('j2')} y)
 SELECT sh.n + ag.n AS comparable, sh.same + ag.n AS stable, round(coalesce((sh.same + ag.n) / nullif(sh.n + ag.n, 0)::DOUBLE, 0), 6) AS stability FROM sh, ag""",
}
