"""Queries of identity, privacy, pages, linking, exchange and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import identity as I
from lumenfold.functions import privacy as P
from lumenfold.functions.spotter import spot
from lumenfold.plans.dealt import DOI_SQL
from lumenfold.session import Scratch
from lumenfold.sources import exchange as X
from lumenfold.sources import pages as G
from lumenfold.streaming import streams as T
from lumenfold.tables import iso, table


def canonical_url(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "fetched_document").select("fetch_id", F.col("final_url").alias("url")).distinct()
    return u.select("fetch_id", I.canonical_url(F.col("url")).alias("canonical"), F.array_join(I.dropped_params(F.col("url")), ",").alias("dropped"))


def source_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "reading_source").select("id", I.source_id(F.col("doi"), F.col("canonical_url"), F.col("content_hash")).alias("derived")).distinct()


def doi_normalise(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citation").select("to_doi", I.normal_doi(F.col("to_doi")).alias("doi"), I.doi_url(I.normal_doi(F.col("to_doi"))).alias("url")).distinct()


def ulid_times(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ingestion_event").select("id", I.ulid_millis(F.col("id")).alias("millis")).distinct()


def local_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "mention").select("surface_form", I.local_key(F.col("surface_form")).alias("local_id")).distinct()


def text_fingerprint_copies(s: SparkSession, d: str) -> DataFrame:
    """Groups of documents whose folded texts agree."""
    f = table(s, d, "documents").filter("text <> ''").select("doc_id", I.fingerprint(F.col("text")).alias("fp"))
    return f.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id")).filter("copies > 1").select("first_doc_id", "copies")


def classify_url(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "reading_source").filter("canonical_url is not null").select("id", "canonical_url", P.classify_url(F.col("canonical_url")).alias("rule")).distinct()


def redact_counts(s: SparkSession, d: str) -> DataFrame:
    text, n = P.redact(F.col("text"))
    return table(s, d, "documents").filter("text is not null").select("doc_id", *[c.cast("long").alias(k) for k, c in n.items()], F.length(text).cast("long").alias("chars"))


def html_meta(s: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return table(s, d, "fetched_document").filter("body is not null").select("fetch_id", G.html_title(b).alias("title"), G.html_canonical(b).alias("canonical"), G.html_lang(b).alias("lang")).distinct()


def page_outcomes(s: SparkSession, d: str) -> DataFrame:
    return G.page_status(table(s, d, "fetched_document").distinct()).groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))


def text_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_version").filter("text is not null").select("id", G.text_title(F.col("text")).alias("title"), G.word_count(F.col("text")).alias("words")).distinct()


def normal_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_version").filter("text is not null").select("id", F.md5(G.normal_text(F.col("text"))).alias("digest")).distinct()


def version_dedupe(s: SparkSession, d: str) -> DataFrame:
    """One version per (source, text hash): the earliest recorded."""
    v = table(s, d, "document_version").filter("source_id is not null and text_hash is not null")
    return v.groupBy("source_id", "text_hash").agg(F.min_by("id", F.struct("recorded_at", "id")).alias("id"), F.count_distinct("id").alias("versions"))


def spots(s: SparkSession, d: str) -> DataFrame:
    """Spots of every chunk of every version, in any language, with offsets in the version's text."""
    v = table(s, d, "document_version").filter("id is not null and text <> ''").select(F.col("id").alias("document_version_id"), "text").dropDuplicates(["document_version_id"])
    c = table(s, d, "chunk").select("document_version_id", "start_char", "end_char").distinct()
    # A version without chunks counts as one.
    part = v.join(c, "document_version_id", "left").withColumns({"at": F.coalesce("start_char", F.lit(0)), "to": F.coalesce("end_char", F.length("text"))})
    part = part.select(F.struct(F.col("document_version_id").alias("id"), "at").alias("k"), F.expr("substring(text, cast(at + 1 as int), cast(to - at as int))").alias("text"))
    found = spot(part.select(F.to_json("k").alias("k"), "text"), "k", "text").withColumn("k", F.from_json("key", "id string, at long"))
    return found.select(F.col("k.id").alias("key"), *[(F.col(x) + F.col("k.at")).alias(x) for x in ("start_char", "end_char")], "surface_form", "signal").distinct()


EXPORTED = {"edge": ["id", "from_concept", "to_concept", "relation", "provenance"], "citation": ["from_doi", "to_doi", "producer_version"], "concept": ["id", "scheme", "label", "description"]}


def _exported(s: SparkSession, d: str) -> dict[str, tuple[DataFrame, list[str]]]:
    return {t: (table(s, d, t).select(*c).distinct(), c[:1]) for t, c in EXPORTED.items()}


def export_lines(s: SparkSession, d: str) -> DataFrame:
    """Header and rows of three tables."""
    return X.export_lines(_exported(s, d)).select("value")


def import_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Rows per table after a way through an exported file, and what its header declares."""
    tables, path = _exported(s, d), f"{Scratch(s, 'export').base}/lines"
    X.export_jsonl(tables, path)
    back, wrong = X.import_jsonl(s, path, {t: df.schema for t, (df, _) in tables.items()})
    parts = [back[t].exceptAll(df).agg(F.count(F.lit(1)).alias("changed")).select(F.lit(t).alias("t"), "changed").join(back[t].agg(F.count(F.lit(1)).alias("rows")).withColumn("t", F.lit(t)), "t") for t, (df, _) in tables.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.join(wrong.select("t", F.lit(True).alias("differs")), "t", "left").select("t", "rows", "changed", F.coalesce("differs", F.lit(False)).alias("differs"))


def manifest_gaps(s: SparkSession, d: str) -> DataFrame:
    """Columns of the exported tables that the export leaves out."""
    gaps = X.uncovered({t: table(s, d, t).columns for t in EXPORTED}, EXPORTED)
    return s.createDataFrame([(g,) for g in gaps], "gap string")


def stream_daily_windows(s: SparkSession, d: str) -> DataFrame:
    w = T.windowed(T.read_stream(s, f"{d}/events.parquet"), "ts", "event_type")
    return T.run_once(w, "complete", Scratch(s, "stream")).select(iso("start").alias("day"), "event_type", "events")


def stream_deduplicated(s: SparkSession, d: str) -> DataFrame:
    """Late rows are kept: the log is read once, in any order."""
    e = T.deduplicated(T.read_stream(s, f"{d}/ingestion_event.parquet"), "id", "recorded_at", "3650 days")
    return T.run_once(e.select("id", "source_id"), "append", Scratch(s, "stream"))


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark of one day has closed."""
    e = T.sessions(T.read_stream(s, f"{d}/events.parquet"), "user_id", "ts")
    return T.run_once(e, "append", Scratch(s, "stream")).select("user_id", iso("started_at").alias("started_at"), "events")


def stream_memory(s: SparkSession, d: str) -> DataFrame:
    """Memory states from the stream of events as a review log, graded by their type."""
    e = T.read_stream(s, f"{d}/events.parquet")
    kind = F.col("event_type")
    rated = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("item"), "ts", F.when(kind == "error", 1).when(kind == "view", 2).when(kind == "click", 3).when(kind == "purchase", 4).alias("g"))
    out = T.run_once(T.memory(rated, "item", "ts", "g"), "update", Scratch(s, "stream"), ["key"])
    return out.select(F.col("key").alias("item"), F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"), "reps", "lapses")


def stream_redelivered(s: SparkSession, d: str) -> DataFrame:
    """Ingestion events as soon as their source is there."""
    e = T.read_stream(s, f"{d}/ingestion_event.parquet").select("id", "source_id").dropDuplicates(["id", "source_id"])
    return T.run_once(T.redelivered(e, "source_id", T.read_stream(s, f"{d}/reading_source.parquet"), "id"), "append", Scratch(s, "stream"))


_FNS = (
    canonical_url, source_ids, doi_normalise, ulid_times, local_keys, text_fingerprint_copies, classify_url, redact_counts, html_meta, page_outcomes, text_titles, normal_texts, version_dedupe, spots, export_lines, import_round_trip, manifest_gaps, stream_daily_windows, stream_deduplicated, stream_sessions, stream_memory, stream_redelivered,
)
QUERIES = {f.__name__: f for f in _FNS}

_SHAPE = r"^(https?)://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PART = lambda u, n: f"regexp_extract(trim({u}), '{_SHAPE}', {n}, 'i')"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_TRACKS = (
    "(lower(split_part(p, '=', 1)) IN " + _LIST(I.TRACKING) + "".join(f" OR starts_with(lower(split_part(p, '=', 1)), '{x}')" for x in I.TRACKING_PREFIXES)
    + "".join(f" OR (host = '{h}' AND lower(split_part(p, '=', 1)) IN {_LIST(n)})" for h, n in I.HOST_TRACKING.items()) + ")"
)


def _canon(rel: str, url: str) -> str:
    """CTEs c0..cu that give ``(rel.*, canonical, dropped)`` for the URL column of a relation."""
    return f"""c0 AS (SELECT *, regexp_replace(lower({_PART(url, 3)}), '^www\\.', '') AS host, {_PART(url, 4)} AS port, regexp_replace({_PART(url, 5)}, '/{{2,}}', '/', 'g') AS path0, list_filter(str_split({_PART(url, 6)}, '&'), lambda p: p <> '') AS q FROM {rel}),
 c1 AS (SELECT *, list_filter(q, lambda p: NOT {_TRACKS}) AS kept, list_transform(list_filter(q, lambda p: {_TRACKS}), lambda p: split_part(p, '=', 1)) AS gone, CASE WHEN length(path0) > 1 THEN regexp_replace(path0, '/$', '') ELSE '/' END AS path FROM c0),
 c2 AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(kept, lambda p, i: struct_pack(k := split_part(p, '=', 1), i := i, p := p))), lambda x: x.p), '&') AS tail FROM c1),
 cu AS (SELECT *, CASE WHEN regexp_matches(trim({url}), '{_SHAPE}', 'i') THEN 'https://' || host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path || CASE WHEN coalesce(tail, '') = '' THEN '' ELSE '?' || tail END END AS canonical, coalesce(array_to_string(gone, ','), '') AS dropped FROM c2)"""


_ROWS = lambda t, c: f"SELECT to_json(struct_pack(t := '{t}', r := struct_pack({', '.join(f'{x} := {x}' for x in c)})))::VARCHAR AS value FROM (SELECT DISTINCT {', '.join(c)} FROM {t})"
_EXPORT = " UNION ALL ".join(_ROWS(t, c) for t, c in EXPORTED.items()) + f""" UNION ALL SELECT '{{"format":"{X.FORMAT}","version":{X.VERSION},"counts":{{' || string_agg('"' || t || '":' || n, ',' ORDER BY t) || '}}}}' FROM ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM (SELECT DISTINCT {', '.join(c)} FROM {t})" for t, c in EXPORTED.items())})"""
_LUHN = "list_sum(list_transform(list_reverse(str_split(regexp_replace(c, '[^0-9]', '', 'g'), '')), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER WHEN x::INTEGER * 2 > 9 THEN x::INTEGER * 2 - 9 ELSE x::INTEGER * 2 END)) % 10 = 0"
_REDACT = f"""WITH a AS (SELECT doc_id, text AS t0 FROM documents WHERE text IS NOT NULL), b AS (SELECT *, '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]*[A-Za-z0-9_]\\b' AS p1, '(?i)\\b(?:bearer|token|api[_-]?key|secret)\\s*[:=]\\s*\\S+' AS p2, '(?i)\\b[0-9a-f]{{32,}}\\b' AS p3, '\\beyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*[A-Za-z0-9_]\\b' AS p4 FROM a),
 c1 AS (SELECT *, len(regexp_extract_all(t0, p1)) AS email, regexp_replace(t0, p1, '[email]', 'g') AS t1 FROM b), c2 AS (SELECT *, len(regexp_extract_all(t1, p2)) AS bearer_token, regexp_replace(t1, p2, '[token]', 'g') AS t2 FROM c1), c3 AS (SELECT *, len(regexp_extract_all(t2, p3)) AS long_hex, regexp_replace(t2, p3, '[hex]', 'g') AS t3 FROM c2),
 c4 AS (SELECT *, len(regexp_extract_all(t3, p4)) AS jwt, regexp_replace(t3, p4, '[jwt]', 'g') AS t4 FROM c3), c5 AS (SELECT *, list_filter(regexp_extract_all(t4, '\\b(?:[0-9][ -]?){{12,18}}[0-9]\\b'), lambda c: length(regexp_replace(c, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {_LUHN}) AS cards FROM c4)
 SELECT doc_id, email, bearer_token, long_hex, jwt, len(cards) AS card_number, list_reduce(list_prepend(t4, cards), lambda t, c: replace(t, c, '[card]')).length() AS chars FROM c5"""
ORACLES = {
    "canonical_url": f"WITH u AS (SELECT DISTINCT fetch_id, final_url AS url FROM fetched_document), {_canon('u', 'url')} SELECT fetch_id, canonical, dropped FROM cu",
    "source_ids": f"WITH {_canon('reading_source', 'canonical_url')} SELECT DISTINCT id, coalesce('s-doi-' || substr(sha256('doi:' || {DOI_SQL.format('doi')}), 1, 24), 's-url-' || substr(sha256('url:' || canonical), 1, 24), 's-cnt-' || substr(sha256('content:' || content_hash), 1, 24)) AS derived FROM cu",
    "doi_normalise": f"SELECT DISTINCT to_doi, doi, 'https://doi.org/' || doi AS url FROM (SELECT to_doi, {DOI_SQL.format('to_doi')} AS doi FROM citation)",
    "ulid_times": "SELECT DISTINCT id, CASE WHEN regexp_full_match(id, '(?i)[0-7][0-9A-HJKMNP-TV-Z]{25}') THEN list_reduce(list_prepend(0::BIGINT, list_transform(str_split(substr(upper(id), 1, 10), ''), lambda c: (position(c IN '0123456789ABCDEFGHJKMNPQRSTVWXYZ') - 1)::BIGINT)), lambda a, x: a * 32 + x) END AS millis FROM ingestion_event",
    "local_keys": "SELECT DISTINCT surface_form, 'local:' || nullif(regexp_replace(regexp_replace(lower(surface_form), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS local_id FROM mention",
    "classify_url": f"""WITH u AS (SELECT DISTINCT id, canonical_url, lower({_PART('canonical_url', 3)}) AS h, lower({_PART('canonical_url', 5)}) AS p, {_PART('canonical_url', 2)} AS u FROM reading_source WHERE canonical_url IS NOT NULL)
 SELECT id, canonical_url, CASE WHEN h = '' THEN NULL WHEN NOT contains(h, '.') OR h = 'localhost' OR regexp_full_match(h, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') {"".join(f" OR ends_with(h, '{x}')" for x in P.INTERNAL)} THEN 'internal_host'
 WHEN {" OR ".join(f"h = '{x}' OR ends_with(h, '.{x}') OR starts_with(h || p, '{x}')" for x in P.SUFFIXES)} THEN 'service' WHEN list_has_any(list_slice(str_split(h, '.'), 1, greatest(len(str_split(h, '.')) - 2, 0)), [{", ".join(f"'{x}'" for x in P.LABELS)}]) THEN 'label'
 WHEN {" OR ".join(f"p = '{x}' OR starts_with(p, '{x}/')" for x in P.PATHS)} THEN 'path' WHEN u <> '' THEN 'credentials' END AS rule FROM u""",
    "html_meta": """SELECT DISTINCT fetch_id, nullif(trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title,
 nullif(regexp_extract(body, '(?i)<link[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']+)["'']', 1), '') AS canonical, nullif(regexp_extract(body, '(?i)<html[^>]*\\slang=["'']([A-Za-z-]+)["'']', 1), '') AS lang FROM fetched_document WHERE body IS NOT NULL""",
    "normal_texts": "SELECT DISTINCT id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM document_version WHERE text IS NOT NULL",
    "version_dedupe": "SELECT source_id, text_hash, arg_min(id, (recorded_at, id)) AS id, count(DISTINCT id) AS versions FROM document_version WHERE source_id IS NOT NULL AND text_hash IS NOT NULL GROUP BY 1, 2",
    "export_lines": _EXPORT,
    "import_round_trip": " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS \"rows\", 0::BIGINT AS changed, false AS differs FROM (SELECT DISTINCT {', '.join(c)} FROM {t})" for t, c in EXPORTED.items()),
    "manifest_gaps": "SELECT table_name || '.' || column_name AS gap FROM information_schema.columns WHERE " + " OR ".join(f"(table_name = '{t}' AND column_name NOT IN ({', '.join(repr(x) for x in c)}))" for t, c in EXPORTED.items()),
    "page_outcomes": f"SELECT outcome, count(*) AS pages FROM (SELECT CASE WHEN body IS NULL OR body = '' THEN 'no_content' WHEN http_status <> 200 THEN 'http_error' WHEN NOT starts_with(coalesce(content_type, ''), 'text/') THEN 'not_text' WHEN len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(body, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+'), lambda w: w <> '')) < 50 THEN 'too_short' ELSE 'ok' END AS outcome FROM (SELECT DISTINCT * FROM fetched_document)) GROUP BY 1",
    "text_titles": r"""SELECT DISTINCT id, left(trim(regexp_replace(trim(regexp_replace(list_filter(str_split(text, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '')[1], '[\r\t]', ' ', 'g')), '^#+ *', '')), 200) AS title, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM document_version WHERE text IS NOT NULL""",
    "text_fingerprint_copies": r"""SELECT min(doc_id) AS first_doc_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')) AS f FROM documents WHERE text <> '') GROUP BY f HAVING count(*) > 1""",
    "redact_counts": _REDACT,
    "redacted_urls": f"SELECT DISTINCT final_url AS url, regexp_replace(regexp_replace(regexp_replace(final_url, '^(https?://)[^/?#@]*@', '\\1'), '([?&])(?:{'|'.join(P.CREDENTIALS)})=[^&#]*&?', '\\1', 'gi'), '[?&]+($|#)', '\\1') AS redacted FROM fetched_document",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e), z AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS events FROM g GROUP BY user_id, s) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, events FROM z WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_redelivered": "SELECT DISTINCT id, source_id FROM ingestion_event WHERE source_id IN (SELECT id FROM reading_source WHERE id IS NOT NULL)",
    "stream_daily_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "stream_deduplicated": "SELECT id, min(source_id) AS source_id FROM ingestion_event WHERE recorded_at IS NOT NULL GROUP BY 1",
}
