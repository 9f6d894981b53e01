"""Capture as a fold over an append-only log, counted cascading deletes, egress of private sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import identity as I
from lumenfold.operators.graph import groups
from lumenfold.session import Scratch


def captured(log: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per source from all captures of it: captures that share a DOI, a canonical URL or a content hash, directly or
    through others, are one source, so a capture by URL alone attaches to the source known by DOI.

    First sighting is the earliest, privacy only ratchets on, a known DOI makes it a paper, and the strongest key of any
    capture names the source; captures without any key stay apart under their own id.
    """
    doi = F.coalesce(I.normal_doi(F.col("doi")), I.resolved_doi(F.col("canonical_url")))
    rows = scratch.put(
        log.filter("id is not null").select("id", "kind", "first_seen_at", "is_private", doi.alias("doi"), I.canonical_url(F.col("canonical_url")).alias("url"), F.col("content_hash").alias("content"))
    )
    key = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(tag), c))
    links = rows.select(F.concat(F.lit("i:"), "id").alias("a"), F.explode(F.array(key("d:", "doi"), key("u:", "url"), key("h:", "content"), F.concat(F.lit("i:"), "id"))).alias("b")).filter("b is not null")
    of = groups(links, scratch).select(F.expr("substring(v, 3)").alias("id"), F.col("l").alias("group")).filter("v like 'i:%'")
    keep = lambda c: F.min(c).alias(c)
    one = rows.join(of, "id").groupBy("group").agg(keep("doi"), keep("url"), keep("content"), keep("kind"), keep("first_seen_at"), F.coalesce(F.bool_or("is_private"), F.lit(False)).alias("is_private"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"))
    name = F.coalesce(I.source_id(F.col("doi"), F.col("url"), F.col("content")), F.concat(F.lit("s-loc-"), "first_id"))
    return one.select(name.alias("source_id"), "doi", F.when(F.col("doi").isNotNull(), "paper").otherwise(F.col("kind")).alias("kind"), "first_seen_at", "is_private", "ids")


#: Tables that fall with a source: (table, its key to the parent, the parent, the parent's key), parents first.
CASCADE = (
    ("ingestion_event", "source_id", "source", "id"), ("document_version", "source_id", "source", "id"), ("chunk", "document_version_id", "document_version", "id"), ("mention", "chunk_id", "chunk", "id"),
    ("embedding_meta", "chunk_id", "chunk", "id"),
)


def cascade(tables: dict[str, DataFrame], doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table once the sources in ``doomed`` (column id) are gone, and ``(table, rows)`` deleted."""
    gone = {"source": doomed.select("id").distinct()}
    left, counts = {}, []
    for t, key, parent, pk in CASCADE:
        ids = gone[parent].select(F.col(pk).alias(key)).distinct()
        hit = tables[t].join(ids, key, "left_semi")
        left[t] = tables[t].join(ids, key, "left_anti")
        if "id" in tables[t].columns:
            gone[t] = hit.select("id")
        counts.append(hit.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return left, out


#: Tables that speak of a concept, and the columns that name it.
SPEAKS = {"mention": ("concept_id",), "edge": ("from_concept", "to_concept"), "quiz_item": ("concept_id",), "review": ("concept_id",), "memory_state": ("concept_id",), "suggestion": ("concept_id",), "concept": ("id",)}


def forget_concept(tables: dict[str, DataFrame], concept: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table once everything about a concept is gone, last the concept itself, and ``(tab, n)``, the rows
    deleted; sources stay."""
    left, counts = {}, []
    for t, columns in SPEAKS.items():
        if t in tables:
            hit = F.lit(False)
            for c in columns:
                hit = hit | F.col(c).eqNullSafe(concept)
            left[t] = tables[t].filter(~hit)
            counts.append(tables[t].agg(F.count_if(hit).alias("n")).select(F.lit(t).alias("tab"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return left, out


def privacy(log: DataFrame) -> DataFrame:
    """``(id, is_private)`` from a log of settings: the latest one counts, so privacy can be taken back."""
    return log.filter("id is not null and is_private is not null").groupBy("id").agg(F.max_by("is_private", F.struct("recorded_at", "is_private")).alias("is_private"))


def annotations_for(notes: DataFrame, source_id: str, key: str) -> DataFrame:
    """The annotations of one source by id."""
    return notes.filter(F.col("source_id") == source_id).orderBy(key)


#: Kinds of captures and of the sources they make.
CAPTURES = ("url", "pdf", "text", "doi")


def resolved(captures: DataFrame) -> DataFrame:
    """Captures ``(kind, payload)`` with ``doi``, ``url``, ``source_kind`` and ``problem``.

    A DOI must be one and makes a paper; text is a note; a URL that names a DOI or an arXiv id makes a paper; what claims
    to be a URL and is none is a problem, a file path of a pdf is not.
    """
    kind, p = F.col("kind"), F.col("payload")
    by_url = kind.isin("url", "pdf")
    url = F.when(by_url, I.canonical_url(p))
    doi = F.when(kind == "doi", I.normal_doi(p)).when(by_url & url.isNotNull(), I.resolved_doi(p))
    problem = F.when(~kind.isin(*CAPTURES) | kind.isNull(), "unknown_kind").when((kind == "doi") & doi.isNull(), "not_a_doi").when((kind == "url") & url.isNull(), "not_a_url")
    made = F.when(doi.isNotNull(), "paper").when(kind == "text", "note").when(kind == "pdf", "pdf").when(kind == "url", "web")
    return captures.select("*", doi.alias("doi"), url.alias("url"), F.when(problem.isNull(), made).alias("source_kind"), problem.alias("problem"))


def guard_private(outgoing: DataFrame, source: DataFrame) -> DataFrame:
    """The outgoing rows; the job fails if any belongs to a private source, before a row leaves."""
    private = source.filter("is_private").select(F.col("id").alias("source_id")).distinct().withColumn("_private", F.lit(True))
    return outgoing.join(private, "source_id", "left").filter(F.when(F.col("_private"), F.raise_error(F.lit("a private source must not leave"))).otherwise(F.lit(True)).cast("boolean")).drop("_private")


def egress_summary(log: DataFrame) -> DataFrame:
    """Calls and bytes per destination and purpose."""
    return log.groupBy("destination", "purpose").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes"))
