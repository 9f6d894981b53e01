"""Works and citations: upserts, back-fill, references that several read works share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.identity import normal_doi


def works(rows: DataFrame) -> DataFrame:
    """One row per DOI normal form from a log of fetches: the latest non-null value of each field wins, open access
    once seen stays, and a work whose latest row is a deletion is left out."""
    seq = F.struct("recorded_at", "fetched_at", "title")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("recorded_at", "fetched_at", F.col(c).cast("string")))).alias(c)
    return (
        rows.withColumn("doi", normal_doi(F.col("doi"))).filter("doi is not null").groupBy("doi")
        .agg(latest("title"), latest("published_year"), F.coalesce(F.bool_or("open_access"), F.lit(False)).alias("open_access"), latest("cited_by_count"), latest("source_id"), F.max("fetched_at").alias("fetched_at"), F.max_by(F.col("deleted_at").isNotNull(), seq).alias("gone"))
        .filter("not gone").drop("gone")
    )


def backfill_sources(work: DataFrame, source: DataFrame) -> DataFrame:
    """Fills a work's source by DOI where it has none."""
    by = source.withColumn("doi", normal_doi(F.col("doi"))).filter("doi is not null").groupBy("doi").agg(F.min("id").alias("found"))
    return work.join(by, "doi", "left").withColumn("source_id", F.coalesce("source_id", "found")).drop("found")


def citations(rows: DataFrame) -> DataFrame:
    """Distinct citations between DOI normal forms; a work does not cite itself."""
    return rows.select(normal_doi(F.col("from_doi")).alias("from_doi"), normal_doi(F.col("to_doi")).alias("to_doi")).filter("from_doi <> to_doi").distinct()


def convergent(citation: DataFrame, work: DataFrame, held: DataFrame, min_citing: int = 2, limit: int = 25) -> DataFrame:
    """Works not held that several held works cite, the most cited first, with the citing sources.

    The citing sources are gathered for the answer only, after the limit.
    """
    own = held.select(F.col("doi").alias("from_doi"), F.col("source_id").alias("citing"))
    cited = citation.join(own, "from_doi").join(held.select(F.col("doi").alias("to_doi")), "to_doi", "left_anti")
    counts = cited.groupBy("to_doi").agg(F.count_distinct("from_doi").alias("citing_works")).filter(F.col("citing_works") >= min_citing)
    info = work.select(F.col("doi").alias("to_doi"), "title", "cited_by_count")
    top = counts.join(info, "to_doi").orderBy(F.desc("citing_works"), F.desc_nulls_last("cited_by_count"), "to_doi").limit(limit)
    who = cited.join(F.broadcast(top.select("to_doi")), "to_doi").groupBy("to_doi").agg(F.array_sort(F.collect_set("citing")).alias("source_ids"))
    return top.join(who, "to_doi").select(F.col("to_doi").alias("doi"), "title", "cited_by_count", "citing_works", "source_ids")


def ingest(source: DataFrame, work: DataFrame, citation: DataFrame, limit: int = 500) -> DataFrame:
    """``(doi, n_references, state)`` of the public sources with a DOI, the first ``limit`` by DOI: the references of a known
    work, or that the work is unknown."""
    asked = source.filter(~F.coalesce("is_private", F.lit(False))).select(normal_doi(F.col("doi")).alias("doi")).filter("doi is not null").distinct().orderBy("doi").limit(limit)
    n = citation.join(F.broadcast(asked.select(F.col("doi").alias("from_doi"))), "from_doi").groupBy(F.col("from_doi").alias("doi")).agg(F.count(F.lit(1)).alias("n"))
    out = asked.join(work.select("doi", F.lit(True).alias("known")), "doi", "left").join(n, "doi", "left")
    return out.select("doi", F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n_references"), F.when(F.col("known"), "ok").otherwise("unknown_work").alias("state"))
