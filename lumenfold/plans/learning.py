"""Queries of retention, reading telemetry, merging of device logs and event-time windows.

No review log is among the tables: ``events`` stands for one, an item per user and a grade per event type.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import identity as I
from lumenfold.functions import scheduler as S
from lumenfold.functions.spotter import STOP
from lumenfold.operators import items as Q
from lumenfold.operators import retention as R
from lumenfold.operators import sync as Y
from lumenfold.operators import telemetry as T
from lumenfold.plans.dealt import DOI_SQL
from lumenfold.plans.text import _canon
from lumenfold.session import Scratch
from lumenfold.tables import iso, table

AS_OF = "2024-02-01 00:00:00"
_LEVEL = "element_at(array('skim', 'read', 'annotate', 'apply', 'teach'), cast(k % 5 as int) + 1)"


def reviews(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    grade = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4)
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("quiz_item_id"), (F.col("user_id") % 40).alias("concept_id"), F.col("ts").alias("presented_at"), grade.alias("machine_rating"),
        F.when(F.col("k") == 7, 3).alias("user_grade_override"), F.when(F.col("k") >= 50, 2).alias("self_rating"), F.when(F.col("value") <= 100, F.col("value") / 100).alias("predicted_recall"),
        F.floor(F.col("value") / 5).cast("double").alias("interval_days"), F.expr(_LEVEL).alias("engagement"),
    )


def _items(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "events").select(F.col("user_id").alias("quiz_item_id"), (F.col("user_id") % 40).alias("concept_id")).distinct()
    return u.withColumn("retired_at", F.when(F.col("quiz_item_id") % 11 == 0, F.to_timestamp(F.lit(AS_OF))))


def memory_state_replay(s: SparkSession, d: str) -> DataFrame:
    m = R.memory_states(reviews(s, d))
    return m.select("quiz_item_id", F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "reps", "lapses", "interval_days", iso("due_at").alias("due_at"))


def due_items(s: SparkSession, d: str) -> DataFrame:
    as_of = F.to_timestamp(F.lit(AS_OF))
    states = Scratch(s, "states").put(R.memory_states(reviews(s, d)))
    return R.due_items(_items(s, d), states, as_of).select("quiz_item_id", "concept_id", F.round("priority", 6).alias("priority"), "round")


def due_count(s: SparkSession, d: str) -> DataFrame:
    return R.due_on(R.memory_states(reviews(s, d)), "2024-02-01")


def next_due(s: SparkSession, d: str) -> DataFrame:
    return R.next_due(R.memory_states(reviews(s, d))).select(iso("next_due_at").alias("next_due_at"))


def retention_evidence(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d)
    out = R.evidence(r, R.memory_states(r), _items(s, d), F.to_timestamp(F.lit(AS_OF)))
    return out.select("concept_id", "outcomes", "passes", iso("last_success_at").alias("last_success_at"), "longest_interval", "recent", F.round("modelled_recall", 6).alias("modelled_recall"), "sufficient", "durably_known")


def calibration_bins(s: SparkSession, d: str) -> DataFrame:
    return R.calibration_bins(reviews(s, d)).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


def calibration_summary(s: SparkSession, d: str) -> DataFrame:
    return R.calibration(reviews(s, d)).select("scored", "excluded", F.round("brier", 6).alias("brier"), F.round("bias", 6).alias("bias"))


def anomalous_items(s: SparkSession, d: str) -> DataFrame:
    """Every five events in a row taken for the reviews of one item."""
    return R.anomalous(reviews(s, d).withColumn("quiz_item_id", F.floor(F.col("id") / 5))).select("quiz_item_id", "reviews", F.round("pass_rate", 6).alias("pass_rate"), F.round("override_rate", 6).alias("override_rate"))


def domain_reviews(s: SparkSession, d: str) -> DataFrame:
    """The reviews, those of concept number k being of the k-th most mentioned concept."""
    top = table(s, d, "mention").filter("concept_id is not null").groupBy("concept_id").count().orderBy(F.desc("count"), "concept_id").limit(40)
    number = top.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "concept_id")) - 1).select(F.col("k").cast("long").alias("k"), F.col("concept_id").alias("concept"))  # 40 rows
    return reviews(s, d).join(F.broadcast(number), F.col("concept_id") == F.col("k")).drop("k", "concept_id").withColumnRenamed("concept", "concept_id")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    """Reports of reading sessions, the n-th event being one of the n-th ingestion event."""
    ids = table(s, d, "ingestion_event").filter("id is not null").select("id").distinct()
    by_id = ids.withColumn("n", F.row_number().over(Window.partitionBy(F.substring("id", 1, 4)).orderBy("id"))).withColumn("p", F.substring("id", 1, 4))
    before = by_id.groupBy("p").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "base")
    numbered = by_id.join(before, "p").select((F.col("n") + F.col("base")).alias("n"), F.col("id").alias("ingestion_event_id"))
    return T.assess(_reports(s, d)).join(numbered, F.col("event_id") == F.col("n")).drop("n")


def _contacts(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "mention").filter("concept_id is not null and id is not null").select("id", "concept_id", "chunk_id").distinct()
    c = table(s, d, "chunk").select(F.col("id").alias("chunk_id"), "document_version_id").distinct()
    v = table(s, d, "document_version").select(F.col("id").alias("document_version_id"), "source_id").distinct()
    per = m.join(c, "chunk_id").join(v, "document_version_id").groupBy("concept_id", "source_id").agg(F.count(F.lit(1)).alias("mentions"))
    e = table(s, d, "ingestion_event").filter("id is not null").groupBy("id", "source_id").agg(F.max("occurred_at").alias("occurred_at"), F.max("engagement").alias("engagement"))
    return per.join(e, "source_id").select("concept_id", F.col("id").alias("event_id"), "occurred_at", "engagement", "mentions")


def _replay_rows(s: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(s, d).select(F.col("ingestion_event_id").alias("event_id"), "plausible")
    return R.replay_rows(domain_reviews(s, d), _contacts(s, d), sessions)


def replay_rows(s: SparkSession, d: str) -> DataFrame:
    return _replay_rows(s, d).select("id", "quiz_item_id", "concept_id", "rating", "engagement", "telemetry_backed")


def counterfactual_replay(s: SparkSession, d: str) -> DataFrame:
    out = R.counterfactual(_replay_rows(s, d), T.multiplier(F.col("engagement")))
    exact = ["brier_with", "brier_without", "bias_with", "bias_without"]
    return out.select("scored_with", "scored_without", *[F.round(c, 6).alias(c) for c in exact], F.round("brier_delta", 6).alias("brier_delta"), "improves", "telemetry_backed_reviews", "engaged_reviews", "sufficient", "notes")


def reading_sessions(s: SparkSession, d: str) -> DataFrame:
    return T.sessionise(table(s, d, "events"), "user_id", "ts").select("user_id", "events", iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"))


def derived_engagement(s: SparkSession, d: str) -> DataFrame:
    """Every event taken for a client's report of a reading session."""
    return T.engagement(T.assess(_reports(s, d))).select("event_id", "expected_ms", "reject", "plausible", "capped_ms", "engagement")


def _reports(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").select(
        "event_id", F.col("ts").alias("started_at"), F.timestamp_millis(F.unix_millis("ts") + (F.col("value") * 2000).cast("long")).alias("ended_at"), (F.col("value") * 1500).cast("long").alias("active_ms"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("double") / 100).alias("max_scroll_pct"), (k * 10).alias("word_count"),
        F.when(k % 3 == 0, k % 4).cast("int").alias("scroll_reversals"),
    )


def daily_windows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return e.select(iso("w.start").alias("day"), "event_type", "events")


def merged_sources(s: SparkSession, d: str) -> DataFrame:
    m = Y.merged_sources(table(s, d, "reading_source"))
    return m.select("id", "kind", "canonical_url", "doi", "title", F.array_join("authors", ";").alias("authors"), iso("first_seen_at").alias("first_seen_at"), "is_private", iso("deleted_at").alias("deleted_at"))


def merged_events(s: SparkSession, d: str) -> DataFrame:
    return Y.merged_events(table(s, d, "ingestion_event")).withColumn("occurred_at", iso("occurred_at"))


def deferred_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "ingestion_event").select("id", "source_id").distinct()
    return Y.deferred(e, "source_id", table(s, d, "reading_source"), "id").select("id", "source_id")


def sealed_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Edges sealed with a key made for the occasion and opened again."""
    key = secrets.token_bytes(32)
    e = table(s, d, "edge")
    return Y.opened(Y.sealed(e, "edge", key), e.schema.simpleString(), key).withColumn("recorded_at", iso("recorded_at"))


def merged_reviews(s: SparkSession, d: str) -> DataFrame:
    """Reviews of two devices, one of which knows the overrides."""
    r = reviews(s, d).select("id", "quiz_item_id", "machine_rating", "user_grade_override")
    other = r.withColumn("user_grade_override", F.lit(None).cast("int"))
    return Y.merged_reviews(r.unionByName(other))


DEVICE_CUT = "2025-01-01 00:00:00"


def relay_page(s: SparkSession, d: str) -> DataFrame:
    """The second page of a hundred rows of the log of ingestion events."""
    log = table(s, d, "ingestion_event").filter("id is not null").select("id").distinct().withColumn("device", F.substring("id", 1, 2))
    one = Y.numbered(log, "id")
    return Y.since(one, 100, 100).select("device", "id", "cursor")


def pushed_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows per table that a push after the cut carries, counted after they were opened."""
    key, cut = secrets.token_bytes(32), F.to_timestamp(F.lit(DEVICE_CUT))
    names = ("reading_source", "ingestion_event", "mention", "edge")
    changed = {t: Y.dirty(table(s, d, t).select("id", "recorded_at"), cut) for t in names}
    batches = Y.received(Y.push(changed, "here", key), "there")
    opened = [Y.opened(batches.filter(F.col("table") == t), "id string, recorded_at timestamp", key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).withColumn("tab", F.lit(t)) for t in names]
    return opened[0].unionByName(opened[1]).unionByName(opened[2]).unionByName(opened[3])


def pulled_events(s: SparkSession, d: str) -> DataFrame:
    """Events of another device: sources and events are split by the hash of their id, references follow known sources."""
    src, ev = table(s, d, "reading_source").filter("id is not null"), table(s, d, "ingestion_event").filter("id is not null").select("id", "source_id").distinct()
    here = F.substring(F.md5("id"), 1, 1) < "8"
    local = {"source": Y.merged_sources(src.filter(here)), "event": ev.filter(here)}
    _, events = Y.pulled({"source": Y.merged_sources(src.filter(~here & (F.substring(F.md5("id"), 2, 1) < "8"))), "event": ev.filter(~here)}, local)
    return events.select("id", "source_id", "state")


def telemetry_recorded(s: SparkSession, d: str) -> DataFrame:
    out = T.record(_sessions(s, d).drop("word_count", "expected_ms", "reject", "plausible", "capped_ms"), table(s, d, "ingestion_event"), table(s, d, "document_version"))
    return out.select("ingestion_event_id", "word_count", "reject", "derived", "applied", "engagement")


def live_items(s: SparkSession, d: str) -> DataFrame:
    """Items per concept that are live after the items of every seventh user were retired too."""
    i = _items(s, d)
    out = Q.retire(i, i.filter("quiz_item_id % 7 = 0"), F.to_timestamp(F.lit(AS_OF)))
    return out.filter("retired_at is null").groupBy("concept_id").agg(F.count(F.lit(1)).alias("items"))


def submitted_reviews(s: SparkSession, d: str) -> DataFrame:
    """Every document taken for an answer to the rubric of its title and first sentence."""
    a = table(s, d, "documents").filter("text <> ''").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("quiz_item_id"), F.col("doc_id").alias("concept_id"), F.col("captured_at").alias("presented_at"), (F.col("captured_at") + F.expr("interval 25 seconds")).alias("answered_at"),
        F.col("text").alias("answer_text"), F.filter(F.array("title", Q.first_sentence(F.col("text"))), lambda x: x.isNotNull()).alias("points"), F.lit(None).cast("double").alias("predicted_recall"), F.lit(None).cast("double").alias("interval_days"),
    )
    r = Q.submit(a, S.score_rating(F.col("machine_grade")))
    m = R.memory_states(r).select(F.col("quiz_item_id").alias("id"), "interval_days")
    return r.select("id", F.round("machine_grade", 6).alias("score"), F.col("machine_rating").alias("rating"), "latency_ms").join(m, "id", "left")


def natural_matches(s: SparkSession, d: str) -> DataFrame:
    """Works and fetched pages found among the sources, by DOI or by URL."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    works = table(s, d, "scholar_work").select(F.concat(F.lit("w:"), "doi").alias("id"), I.normal_doi(F.col("doi")).alias("doi"), none("canonical_url"), none("content_hash")).filter("id is not null").distinct()
    pages = table(s, d, "fetched_document").select(F.concat(F.lit("p:"), F.col("fetch_id").cast("string")).alias("id"), none("doi"), I.canonical_url(F.col("final_url")).alias("canonical_url"), none("content_hash")).filter("id is not null").distinct()
    known = Y.merged_sources(table(s, d, "reading_source")).select("id", I.normal_doi(F.col("doi")).alias("doi"), I.canonical_url(F.col("canonical_url")).alias("canonical_url"), "content_hash")
    return Y.natural_matches(works.unionByName(pages), known)


_FNS = (
    memory_state_replay, due_items, due_count, next_due, retention_evidence, calibration_bins, calibration_summary, anomalous_items, replay_rows, counterfactual_replay, reading_sessions, derived_engagement, daily_windows, merged_sources, merged_events,
    deferred_events, sealed_round_trip, natural_matches, merged_reviews, relay_page, pushed_rows, pulled_events, telemetry_recorded, live_items, submitted_reviews,
)
QUERIES = {f.__name__: f for f in _FNS}

_W, _F = S.W, repr(S.FACTOR)
_TS = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
_clamp = lambda x: f"greatest(1.0, least(10.0, {x}))"
_d0 = lambda g: _clamp(f"{_W[4]} - exp({_W[5]} * ({g} - 1)) + 1")
_rec = lambda t, s: f"pow(1 + {_F} * ({t}) / {s}, {-_W[20]})"
_DAYS = "floor((epoch(date_trunc('second', x.at_)) - epoch(date_trunc('second', r.at_))) / 86400)"
_NEXT_S = f"""CASE WHEN {_DAYS} <= 0 THEN r.s * CASE WHEN x.g >= 3 THEN greatest(1.0, exp({_W[17]} * (x.g - 3 + {_W[18]})) * pow(r.s, {-_W[19]})) ELSE exp({_W[17]} * (x.g - 3 + {_W[18]})) * pow(r.s, {-_W[19]}) END
 WHEN x.g >= 2 THEN r.s * (1 + exp({_W[8]}) * (11 - r.d) * pow(r.s, {-_W[9]}) * (exp({_W[10]} * (1 - {_rec(_DAYS, "r.s")})) - 1) * CASE x.g WHEN 2 THEN {_W[15]} WHEN 4 THEN {_W[16]} ELSE 1.0 END)
 ELSE least(r.s, {_W[11]} * pow(r.d, {-_W[12]}) * (pow(r.s + 1, {_W[13]}) - 1) * exp({_W[14]} * (1 - {_rec(_DAYS, "r.s")}))) END"""
_NEXT_D = _clamp(f"{_W[7]} * {_d0(4)} + (1 - {_W[7]}) * (r.d - {_W[6]} * (x.g - 3) * (10 - r.d) / 9)")
_REV = """WITH RECURSIVE rev AS (SELECT event_id AS id, user_id AS item, user_id % 40 AS concept_id, ts AS at_, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS machine,
 CASE WHEN k = 7 THEN 3 END AS override, CASE WHEN k >= 50 THEN 2 END AS self, CASE WHEN value <= 100 THEN value / 100 END AS predicted, floor(value / 5) AS interval_days, ['skim', 'read', 'annotate', 'apply', 'teach'][k % 5 + 1] AS engagement
 FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)),
"""
_STATE = _REV + f"""
gr AS (SELECT *, coalesce(override, machine, self) AS g FROM rev),
lg AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY at_, id) AS n, CASE engagement WHEN 'skim' THEN 0.8 WHEN 'read' THEN 1.0 WHEN 'annotate' THEN 1.25 WHEN 'apply' THEN 1.5 ELSE 1.8 END AS m FROM gr WHERE g IS NOT NULL AND item IS NOT NULL AND at_ IS NOT NULL),
r AS (SELECT 'neutral' AS variant, item, n, at_, [{", ".join(map(str, _W[:4]))}][g]::DOUBLE AS s, {_d0("g")}::DOUBLE AS d, 0 AS lapses, NULL::DOUBLE AS p, NULL::DOUBLE AS ok FROM lg WHERE n = 1
 UNION ALL SELECT 'prior', item, n, at_, ([{", ".join(map(str, _W[:4]))}][g] * m)::DOUBLE, {_d0("g")}::DOUBLE, 0, NULL, NULL FROM lg WHERE n = 1
 UNION ALL SELECT r.variant, x.item, x.n, x.at_, {_NEXT_S}, {_NEXT_D}, r.lapses + CASE WHEN x.g = 1 THEN 1 ELSE 0 END, {_rec(_DAYS, "r.s")}, CASE WHEN x.g >= 3 THEN 1.0 ELSE 0.0 END FROM r JOIN lg x ON x.item = r.item AND x.n = r.n + 1),
st AS (SELECT item, arg_max(s, n) AS s, arg_max(d, n) AS d, arg_max(at_, n) AS at_, max(n) AS reps, arg_max(lapses, n) AS lapses FROM r WHERE variant = 'neutral' GROUP BY 1),
s2 AS (SELECT *, greatest(1, floor(s / {_F} * (pow(0.9, {-1 / _W[20]}) - 1) + 0.5))::BIGINT AS days FROM st),
s3 AS (SELECT *, at_ + to_days(days::INTEGER) AS due_at FROM s2)
"""
_REPORTS = """e AS (SELECT event_id, trunc(value * 2000)::BIGINT AS el, trunc(value * 1500)::BIGINT AS active_ms, CASE WHEN event_type <> 'signup' THEN json_extract(props, '$.k')::DOUBLE / 100 END AS sc, json_extract(props, '$.k')::BIGINT * 10 AS wc, CASE WHEN json_extract(props, '$.k')::BIGINT % 3 = 0 THEN json_extract(props, '$.k')::BIGINT % 4 END AS rv FROM events),
 x AS (SELECT *, greatest(1000, floor(wc / 240.0 * 60000 + 0.5))::BIGINT AS expected_ms FROM e),
 y AS (SELECT *, CASE WHEN active_ms < 3000 THEN 'too_short' WHEN coalesce(sc, 0) <= 0 AND coalesce(rv, 0) <= 0 THEN 'no_scroll' WHEN active_ms > 3 * expected_ms THEN 'too_long' WHEN active_ms > el + 1000 THEN 'beyond_wall_clock' END AS reject FROM x)"""
_TOP40 = "top40 AS (SELECT concept_id, row_number() OVER (ORDER BY count(*) DESC, concept_id) - 1 AS k FROM mention WHERE concept_id IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 40)"
_REPLAY = _REV + _TOP40 + ", " + _REPORTS + """,
 pe AS (SELECT concept_id, source_id, count(*) AS mentions FROM (SELECT DISTINCT id, concept_id, chunk_id FROM mention WHERE concept_id IS NOT NULL AND id IS NOT NULL) m JOIN (SELECT DISTINCT id, document_version_id FROM chunk) c ON c.id = m.chunk_id JOIN (SELECT DISTINCT id, source_id FROM document_version) v ON v.id = c.document_version_id GROUP BY 1, 2),
 ie AS (SELECT id, source_id, max(occurred_at) AS occurred_at, max(engagement) AS engagement FROM ingestion_event WHERE id IS NOT NULL GROUP BY 1, 2),
 ct AS (SELECT concept_id, id AS event_id, occurred_at, engagement, mentions FROM pe JOIN ie USING (source_id)),
 lv AS (SELECT concept_id, arg_max(engagement, (occurred_at, engagement)) FILTER (WHERE engagement IS NOT NULL) AS engagement FROM ct GROUP BY 1),
 nm AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM ingestion_event WHERE id IS NOT NULL)),
 be AS (SELECT nm.id AS event_id, count(*) AS n FROM y JOIN nm ON nm.n = y.event_id WHERE reject IS NULL GROUP BY 1),
 bk AS (SELECT concept_id, sum(n * mentions)::BIGINT AS telemetry_backed FROM ct JOIN be USING (event_id) GROUP BY 1),
 rr AS (SELECT rev.id, item, t.concept_id, at_, machine, override, self, lv.engagement, coalesce(telemetry_backed, 0) AS telemetry_backed FROM rev JOIN top40 t ON t.k = rev.concept_id LEFT JOIN lv ON lv.concept_id = t.concept_id LEFT JOIN bk ON bk.concept_id = t.concept_id
  WHERE item IS NOT NULL AND coalesce(override, machine, self) IS NOT NULL)
"""
_P = f"CASE WHEN s3.item IS NULL THEN 0.5 ELSE 1 - abs({_rec(f'''greatest(0, (epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', s3.at_))) / 86400.0)''', 's3.s')} - 0.9) END"
_RANK = "list_position(['skim', 'read', 'annotate', 'apply', 'teach'], engagement)"
_PR = "list_position(['captured', 'extraction_failed', 'extracted', 'chunked', 'embedded', 'linked', 'rolled_up', 'itemised'], status)"
_SRC = "m AS (SELECT id, coalesce(max(CASE WHEN kind = 'paper' THEN 'paper' END), min(kind)) AS kind, min(canonical_url) AS canonical_url, min(doi) AS doi, min(content_hash) AS content_hash, min(title) AS title, min(authors) AS authors, min(first_seen_at) AS f, coalesce(bool_or(is_private), false) AS is_private, min(deleted_at) AS del FROM reading_source WHERE id IS NOT NULL GROUP BY 1)"
_TERMS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 3 AND x NOT IN ({', '.join(repr(x) for x in sorted(STOP))})))"
ORACLES = {
    "memory_state_replay": _STATE + f"SELECT item AS quiz_item_id, round(s, 6) AS stability, round(d, 6) AS difficulty, reps::INTEGER AS reps, lapses, days AS interval_days, {_TS('due_at')} AS due_at FROM s3",
    "stream_memory": _STATE.replace("coalesce(override, machine, self) AS g", "machine AS g") + "SELECT item, round(s, 6) AS stability, round(d, 6) AS difficulty, reps, lapses::BIGINT AS lapses FROM st",
    "due_items": _STATE + f""", it AS (SELECT DISTINCT user_id AS item, user_id % 40 AS concept_id FROM events WHERE user_id % 11 <> 0),
 du AS (SELECT it.item, it.concept_id, {_P} AS priority FROM it LEFT JOIN s3 ON s3.item = it.item WHERE s3.item IS NULL OR s3.due_at <= TIMESTAMP '{AS_OF}'),
 tr AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY priority DESC, item) AS rd FROM du), ld AS (SELECT *, max(priority) OVER (PARTITION BY concept_id) AS lead_, min(CASE WHEN rd = 1 THEN item END) OVER (PARTITION BY concept_id) AS lead_id FROM tr WHERE rd <= 20)
 SELECT item AS quiz_item_id, concept_id, round(priority, 6) AS priority, rd::INTEGER AS round FROM ld ORDER BY rd, lead_ DESC, lead_id LIMIT 20""",
    "due_count": _STATE + "SELECT count(*) AS due FROM s3 WHERE due_at >= TIMESTAMP '2024-02-01' AND due_at < TIMESTAMP '2024-02-02'",
    "next_due": _STATE + f"SELECT {_TS('min(due_at)')} AS next_due_at FROM s3",
    "retention_evidence": _STATE + f""", oc AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY at_ DESC, id DESC) AS rn FROM gr WHERE g > 0),
 e AS (SELECT concept_id, count(*) AS outcomes, count(*) FILTER (WHERE g >= 3) AS passes, max(at_) FILTER (WHERE g >= 3) AS ls, max(interval_days) FILTER (WHERE g >= 3) AS longest_interval, string_agg(g::VARCHAR, '' ORDER BY rn) FILTER (WHERE rn <= 10) AS recent FROM oc GROUP BY 1),
 mo AS (SELECT item % 40 AS concept_id, avg({_rec(f'''greatest(0, (epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', at_))) / 86400.0)''', 's')}) AS p FROM s3 WHERE item % 11 <> 0 GROUP BY 1)
 SELECT e.concept_id, outcomes, passes, {_TS('ls')} AS last_success_at, longest_interval, recent, round(p, 6) AS modelled_recall, outcomes >= 2 AS sufficient, coalesce(longest_interval >= 21, false) AS durably_known FROM e LEFT JOIN mo USING (concept_id)""",
    "calibration_bins": _REV + "x AS (SELECT *, coalesce(override, machine) AS g FROM rev) SELECT least(9, floor(predicted * 10))::INTEGER AS bin, count(*) AS n, round(avg(predicted), 6) AS predicted, round(avg(CASE WHEN g >= 3 THEN 1.0 ELSE 0.0 END), 6) AS actual FROM x WHERE g IS NOT NULL AND predicted IS NOT NULL GROUP BY 1",
    "calibration_summary": _REV + "x AS (SELECT predicted, CASE WHEN coalesce(override, machine) IS NOT NULL THEN predicted - CASE WHEN coalesce(override, machine) >= 3 THEN 1.0 ELSE 0.0 END END AS e FROM rev) SELECT count(e) AS scored, count(*) FILTER (WHERE predicted IS NULL) AS excluded, round(coalesce(avg(e * e), 0), 6) AS brier, round(coalesce(avg(e), 0), 6) AS bias FROM x",
    "anomalous_items": _REV + "x AS (SELECT (id // 5)::BIGINT AS item, count(*) AS reviews, avg(CASE WHEN coalesce(override, machine) >= 3 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN override IS NOT NULL THEN 1.0 ELSE 0.0 END) AS o FROM rev GROUP BY 1) SELECT item AS quiz_item_id, reviews, round(p, 6) AS pass_rate, round(o, 6) AS override_rate FROM x WHERE reviews >= 4 AND (p = 0 OR p = 1 OR o >= 0.5)",
    "replay_rows": _REPLAY + "SELECT id, item AS quiz_item_id, concept_id, coalesce(override, machine, self)::INTEGER AS rating, engagement, telemetry_backed FROM rr",
    "counterfactual_replay": _REPLAY + f""", lg AS (SELECT *, coalesce(override, machine, self) AS g, row_number() OVER (PARTITION BY item ORDER BY at_, id) AS n, CASE engagement WHEN 'skim' THEN 0.8 WHEN 'annotate' THEN 1.25 WHEN 'apply' THEN 1.5 WHEN 'teach' THEN 1.8 ELSE 1.0 END AS m FROM rr WHERE at_ IS NOT NULL),
 r AS (SELECT 'without' AS variant, item, n, at_, [{", ".join(map(str, _W[:4]))}][g]::DOUBLE AS s, {_d0("g")}::DOUBLE AS d, NULL::DOUBLE AS p, NULL::DOUBLE AS ok FROM lg WHERE n = 1
 UNION ALL SELECT 'with', item, n, at_, ([{", ".join(map(str, _W[:4]))}][g] * m)::DOUBLE, {_d0("g")}::DOUBLE, NULL, NULL FROM lg WHERE n = 1
 UNION ALL SELECT r.variant, x.item, x.n, x.at_, {_NEXT_S}, {_NEXT_D}, {_rec(_DAYS, "r.s")}, CASE WHEN x.g >= 3 THEN 1.0 ELSE 0.0 END FROM r JOIN lg x ON x.item = r.item AND x.n = r.n + 1),
 a AS (SELECT count(p) FILTER (WHERE variant = 'with') AS sw, count(p) FILTER (WHERE variant = 'without') AS so, avg((p - ok) ** 2) FILTER (WHERE variant = 'with') AS bw, avg((p - ok) ** 2) FILTER (WHERE variant = 'without') AS bo,
  avg(p - ok) FILTER (WHERE variant = 'with') AS iw, avg(p - ok) FILTER (WHERE variant = 'without') AS io FROM r), t AS (SELECT count(*) FILTER (WHERE telemetry_backed > 0) AS tb, count(engagement) AS en FROM rr)
 SELECT sw AS scored_with, so AS scored_without, round(bw, 6) AS brier_with, round(bo, 6) AS brier_without, round(iw, 6) AS bias_with, round(io, 6) AS bias_without, round(bw - bo, 6) AS brier_delta, bw < bo AS improves, tb AS telemetry_backed_reviews, en AS engaged_reviews,
 sw >= 50 AND tb > 0 AS sufficient, concat_ws(';', CASE WHEN sw < 50 THEN 'few_reviews' END, CASE WHEN tb = 0 THEN 'no_telemetry' END, CASE WHEN tb = 0 AND en > 0 THEN 'self_asserted' END) AS notes FROM a, t""",
    "reading_sessions": f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, count(*) AS events, {_TS('min(ts)')} AS started_at, {_TS('max(ts)')} AS ended_at FROM g GROUP BY user_id, s""",
    "derived_engagement": """WITH e AS (SELECT event_id, trunc(value * 2000)::BIGINT AS el, trunc(value * 1500)::BIGINT AS active_ms, CASE WHEN event_type <> 'signup' THEN json_extract(props, '$.k')::DOUBLE / 100 END AS sc, json_extract(props, '$.k')::BIGINT * 10 AS wc, CASE WHEN json_extract(props, '$.k')::BIGINT % 3 = 0 THEN json_extract(props, '$.k')::BIGINT % 4 END AS rv FROM events),
 x AS (SELECT *, greatest(1000, floor(wc / 240.0 * 60000 + 0.5))::BIGINT AS expected_ms FROM e),
 y AS (SELECT *, CASE WHEN active_ms < 3000 THEN 'too_short' WHEN coalesce(sc, 0) <= 0 AND coalesce(rv, 0) <= 0 THEN 'no_scroll' WHEN active_ms > 3 * expected_ms THEN 'too_long' WHEN active_ms > el + 1000 THEN 'beyond_wall_clock' END AS reject FROM x)
 SELECT event_id, expected_ms, reject, reject IS NULL AS plausible, least(active_ms, 3 * expected_ms) AS capped_ms, CASE WHEN reject IS NULL THEN CASE WHEN least(active_ms, 3 * expected_ms) >= 0.5 * expected_ms AND coalesce(sc, 0) >= 0.8 THEN 'read' ELSE 'skim' END END AS engagement FROM y""",
    "daily_windows": f"SELECT {_TS('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)')} AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "merged_sources": f"WITH {_SRC} SELECT id, kind, canonical_url, doi, title, array_to_string(authors, ';') AS authors, {_TS('f')} AS first_seen_at, is_private, {_TS('del')} AS deleted_at FROM m",
    "merged_events": f"""SELECT id, min(source_id) AS source_id, {_TS('min(occurred_at)')} AS occurred_at, (max(struct_pack(r := {_RANK}, e := engagement)) FILTER (WHERE {_RANK} > 0)).e AS engagement,
 arg_max(engagement_source, ({_RANK}, coalesce(engagement_source, ''))) FILTER (WHERE {_RANK} > 0) AS engagement_source, arg_max(status, (greatest({_PR} - 2, 0), status, coalesce(status_reason, ''))) FILTER (WHERE {_PR} > 0) AS status,
 arg_max(status_reason, (greatest({_PR} - 2, 0), status, coalesce(status_reason, ''))) FILTER (WHERE {_PR} > 0) AS status_reason, max(novelty) AS novelty, arg_max(novelty_model_id, (novelty, coalesce(novelty_model_id, ''))) FILTER (WHERE novelty IS NOT NULL) AS novelty_model_id
 FROM ingestion_event WHERE id IS NOT NULL GROUP BY 1""",
    "deferred_events": "SELECT DISTINCT id, source_id FROM ingestion_event e WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reading_source s WHERE s.id = e.source_id)",
    "sealed_round_trip": f"SELECT id, from_concept, to_concept, relation, provenance, weight, {_TS('recorded_at')} AS recorded_at FROM edge",
    "natural_matches": f"""WITH {_SRC}, {_canon('m', 'canonical_url')}, kn AS (SELECT id, {DOI_SQL.format('doi')} AS doi, canonical FROM cu), {_canon('(SELECT DISTINCT fetch_id, final_url FROM fetched_document WHERE fetch_id IS NOT NULL)', 'final_url').replace('c0', 'f0').replace('c1', 'f1').replace('c2', 'f2').replace('cu AS', 'fu AS')},
 p AS (SELECT 'w:' || w.doi AS id, 0 AS n, min(kn.id) AS known_id, 'doi' AS "by" FROM (SELECT DISTINCT doi, {DOI_SQL.format('doi')} AS k FROM scholar_work WHERE doi IS NOT NULL) w JOIN kn ON kn.doi = w.k GROUP BY 1 UNION ALL SELECT 'p:' || fetch_id, 1, min(kn.id), 'canonical_url' FROM fu JOIN kn ON kn.canonical = fu.canonical GROUP BY 1)
 SELECT id, known_id, "by" FROM p""",
    "merged_reviews": _REV + "z AS (SELECT 1) SELECT id, item AS quiz_item_id, machine AS machine_rating, override AS user_grade_override FROM rev",
    "relay_page": "SELECT device, id, cursor FROM (SELECT substr(id, 1, 2) AS device, id, row_number() OVER (PARTITION BY substr(id, 1, 2) ORDER BY id) AS cursor FROM (SELECT DISTINCT id FROM ingestion_event WHERE id IS NOT NULL)) WHERE cursor > 100 ORDER BY cursor LIMIT 100",
    "pushed_rows": " UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n, count(DISTINCT id) AS ids FROM {t} WHERE coalesce(recorded_at > TIMESTAMP '{DEVICE_CUT}', true)" for t in ("reading_source", "ingestion_event", "mention", "edge")),
    "pulled_events": f"""WITH {_SRC}, here AS (SELECT * FROM m WHERE substr(md5(id), 1, 1) < '8'), them AS (SELECT * FROM m WHERE substr(md5(id), 1, 1) >= '8' AND substr(md5(id), 2, 1) < '8'),
 p AS (SELECT a.id, 0 AS n, min(b.id) AS l FROM them a JOIN here b ON a.doi = b.doi GROUP BY 1 UNION ALL SELECT a.id, 1, min(b.id) FROM them a JOIN here b ON a.canonical_url = b.canonical_url GROUP BY 1), rm AS (SELECT id, arg_min(l, n) AS l FROM p GROUP BY 1),
 kn AS (SELECT id FROM here UNION SELECT coalesce(rm.l, them.id) FROM them LEFT JOIN rm USING (id)), ev AS (SELECT DISTINCT id, source_id FROM ingestion_event WHERE id IS NOT NULL),
 x AS (SELECT ev.id, coalesce(rm.l, ev.source_id) AS source_id FROM ev LEFT JOIN rm ON rm.id = ev.source_id WHERE substr(md5(ev.id), 1, 1) >= '8')
 SELECT id, source_id, CASE WHEN source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM kn) THEN 'deferred' ELSE 'applied' END AS state FROM x""",
    "telemetry_recorded": f"""WITH {_REPORTS}, nm AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM ingestion_event WHERE id IS NOT NULL)), wo AS (SELECT source_id, arg_max(word_count, (extracted_at, id)) AS words FROM document_version WHERE source_id IS NOT NULL GROUP BY 1),
 ie AS (SELECT id, unnest(min(struct_pack(source_id, engagement))) FROM ingestion_event WHERE id IS NOT NULL GROUP BY 1), z AS (SELECT nm.id AS ingestion_event_id, coalesce(nullif(words, 0), 400) AS word_count, e.*, ie.engagement AS held FROM e JOIN nm ON nm.n = e.event_id JOIN ie ON ie.id = nm.id LEFT JOIN wo USING (source_id)),
 z2 AS (SELECT *, greatest(1000, floor(word_count / 240.0 * 60000 + 0.5))::BIGINT AS ex FROM z), z3 AS (SELECT *, CASE WHEN active_ms < 3000 THEN 'too_short' WHEN coalesce(sc, 0) <= 0 AND coalesce(rv, 0) <= 0 THEN 'no_scroll' WHEN active_ms > 3 * ex THEN 'too_long' WHEN active_ms > el + 1000 THEN 'beyond_wall_clock' END AS reject FROM z2),
 z4 AS (SELECT *, CASE WHEN reject IS NULL THEN CASE WHEN least(active_ms, 3 * ex) >= 0.5 * ex AND coalesce(sc, 0) >= 0.8 THEN 'read' ELSE 'skim' END END AS derived FROM z3), z5 AS (SELECT *, coalesce(nullif(list_position(['skim', 'read', 'annotate', 'apply', 'teach'], derived), 0), 0) > coalesce(nullif(list_position(['skim', 'read', 'annotate', 'apply', 'teach'], held), 0), 0) AS applied FROM z4)
 SELECT ingestion_event_id, word_count, reject, derived, applied, CASE WHEN applied THEN derived ELSE held END AS engagement FROM z5""",
    "live_items": "SELECT user_id % 40 AS concept_id, count(DISTINCT user_id) AS items FROM events WHERE user_id % 11 <> 0 AND user_id % 7 <> 0 GROUP BY 1",
    "submitted_reviews": f"""WITH a AS (SELECT doc_id, captured_at, {_TERMS('text')} AS w, {_TERMS('title')} AS t1, title, nullif(regexp_extract(text, '(?s)([^.!?]{{25,400}}[.!?])', 1), '') AS fs FROM documents WHERE text <> ''), b AS (SELECT *, {_TERMS('fs')} AS t2 FROM a),
 c AS (SELECT *, (CASE WHEN len(t1) > 0 AND len(list_intersect(t1, w)) >= 0.4 * len(t1) THEN 1 ELSE 0 END + CASE WHEN len(t2) > 0 AND len(list_intersect(t2, w)) >= 0.4 * len(t2) THEN 1 ELSE 0 END) / nullif((title IS NOT NULL)::INTEGER + (fs IS NOT NULL)::INTEGER, 0)::DOUBLE AS sc FROM b),
 g AS (SELECT *, coalesce(sc, 0) AS score, CASE WHEN coalesce(sc, 0) >= 0.92 THEN 4 WHEN coalesce(sc, 0) >= 0.7 THEN 3 WHEN coalesce(sc, 0) >= 0.4 THEN 2 ELSE 1 END AS rating FROM c)
 SELECT doc_id AS id, round(score, 6) AS score, rating, CASE WHEN captured_at IS NOT NULL THEN 25000::BIGINT END AS latency_ms, CASE WHEN captured_at IS NOT NULL THEN greatest(1, floor([{", ".join(map(str, _W[:4]))}][rating] / {_F} * (pow(0.9, {-1 / _W[20]}) - 1) + 0.5))::BIGINT END AS interval_days FROM g""",
}
