"""How often, how deeply and from how many sources each concept has been met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import Scratch

#: Engagement levels from the lightest to the deepest.
LEVELS = ("skim", "read", "annotate", "apply", "teach")


def level_rank(c: Column) -> Column:
    """1 for the lightest level; null for null and unknown levels."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), c), F.lit(0))


def level_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.try_element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int")))


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b, halves up, never negative."""
    return F.greatest(F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 86400 + 0.5), F.lit(0)).cast("long")


def concept_sources(mention: DataFrame, chunk: DataFrame, version: DataFrame) -> DataFrame:
    """Distinct ``(concept_id, source_id, is_primary)``: the fan-out of mentions, chunks and versions ends here."""
    m = mention.filter("concept_id is not null").groupBy("chunk_id", "concept_id").agg(F.max(F.coalesce("is_primary", F.lit(False))).alias("is_primary"))
    c = chunk.select(F.col("id").alias("chunk_id"), "document_version_id").distinct()
    v = version.filter("source_id is not null").select(F.col("id").alias("document_version_id"), "source_id").distinct()
    return m.join(c, "chunk_id").join(v, "document_version_id").groupBy("concept_id", "source_id").agg(F.max("is_primary").alias("is_primary"))


def source_contacts(event: DataFrame) -> DataFrame:
    """Per source: events, first and last contact, deepest engagement.  Repeated event rows count once."""
    e = event.filter("source_id is not null").select("id", "source_id", "occurred_at", level_rank(F.col("engagement")).alias("rank")).distinct()
    return e.groupBy("source_id").agg(F.count_distinct("id").alias("contacts"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.max("rank").alias("rank"))


def rollup(mention: DataFrame, chunk: DataFrame, version: DataFrame, event: DataFrame, annotated: DataFrame) -> DataFrame:
    """Coverage per concept, see ``rollup_from``."""
    return rollup_from(concept_sources(mention, chunk, version), event, annotated)


def rollup_from(sources: DataFrame, event: DataFrame, annotated: DataFrame) -> DataFrame:
    """Coverage per concept from its distinct sources.  A contact is one (source, event) pair, however often the source
    mentions the concept.

    Events are aggregated per source before they meet the concepts, so a re-encountered source does not multiply rows.
    ``annotated`` lists source ids with a user's annotation.
    """
    per = sources.join(source_contacts(event), "source_id").join(annotated.select("source_id").distinct().withColumn("noted", F.lit(True)), "source_id", "left")
    return (
        per.groupBy("concept_id")
        .agg(
            F.count(F.lit(1)).alias("distinct_sources"), F.count_if("is_primary").alias("primary_sources"), F.min("first_at").alias("first_contact_at"), F.max("last_at").alias("last_contact_at"),
            F.max("rank").alias("rank"), F.sum("contacts").alias("contact_count"), F.coalesce(F.bool_or("noted"), F.lit(False)).alias("has_user_annotation"),
        )
        .select("concept_id", "distinct_sources", "primary_sources", "first_contact_at", "last_contact_at", days_between(F.col("first_contact_at"), F.col("last_contact_at")).alias("temporal_spread_days"), level_name(F.col("rank")).alias("max_engagement"), "contact_count", "has_user_annotation")
    )


def recurring_gaps(coverage: DataFrame, concept: DataFrame, sources: DataFrame, min_distinct: int = 3, max_primary: int = 0, limit: int = 25, include_local: bool = False) -> DataFrame:
    """Concepts met in several sources but the subject of none, with the sources that met them."""
    c = concept if include_local else concept.filter("scheme <> 'local'")
    top = coverage.filter((F.col("distinct_sources") >= min_distinct) & (F.col("primary_sources") <= max_primary)).join(c.select(F.col("id").alias("concept_id"), "label", "scheme"), "concept_id")
    top = top.orderBy(F.desc("distinct_sources"), F.desc("temporal_spread_days"), "concept_id").limit(limit)
    met = sources.select("concept_id", "source_id").join(F.broadcast(top.select("concept_id")), "concept_id").groupBy("concept_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return top.join(met, "concept_id")


def stale(coverage: DataFrame, concept: DataFrame, before: Column, limit: int = 25) -> DataFrame:
    """Concepts last met before a moment, the longest ago first; local concepts included."""
    c = concept.select(F.col("id").alias("concept_id"), "label", "scheme")
    return coverage.filter(F.col("last_contact_at") < before).join(c, "concept_id").orderBy("last_contact_at", "concept_id").limit(limit)


def taxonomy(edge: DataFrame, concept: DataFrame, coverage: DataFrame, include_uncovered: bool = True, within: DataFrame | None = None) -> DataFrame:
    """Every concept with its one parent (the smallest vocabulary subclass_of target) and its source count; only those of
    ``within`` (as from ``rooted``) if it is given."""
    up = edge.filter("relation = 'subclass_of' and provenance = 'vocabulary'").groupBy(F.col("from_concept").alias("concept_id")).agg(F.min("to_concept").alias("parent_id"))
    t = concept.select(F.col("id").alias("concept_id"), "label").join(up, "concept_id", "left").join(coverage.select("concept_id", "distinct_sources", "primary_sources"), "concept_id", "left")
    t = t.select("concept_id", "label", "parent_id", F.coalesce("distinct_sources", F.lit(0)).alias("distinct_sources"), F.coalesce("primary_sources", F.lit(0)).alias("primary_sources"))
    if within is not None:
        t = t.join(within, "concept_id", "left_semi")
    return t if include_uncovered else t.filter("distinct_sources > 0")


def coverage_for(coverage: DataFrame, concept_id: str) -> DataFrame:
    """The coverage row of one concept."""
    return coverage.filter(F.col("concept_id") == concept_id)


def source_detail(event: DataFrame, source: DataFrame, version: DataFrame, chunk: DataFrame, mention: DataFrame) -> DataFrame:
    """Per source its title, events, versions, chunks and concepts; each child is counted before it is joined."""
    n_events = event.filter("source_id is not null").groupBy("source_id").agg(F.count_distinct("id").alias("events"), F.max("occurred_at").alias("last_event_at"))
    v = version.filter("source_id is not null").select(F.col("id").alias("document_version_id"), "source_id").distinct()
    c = chunk.select(F.col("id").alias("chunk_id"), "document_version_id").distinct().join(v, "document_version_id")
    n_versions = v.groupBy("source_id").agg(F.count(F.lit(1)).alias("versions"))
    n_chunks = c.groupBy("source_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    n_concepts = mention.filter("concept_id is not null").select("chunk_id", "concept_id").distinct().join(c.select("chunk_id", "source_id").distinct(), "chunk_id").groupBy("source_id").agg(F.count_distinct("concept_id").alias("concepts"))
    out = source.select(F.col("id").alias("source_id"), "title")
    for n in (n_events, n_versions, n_chunks, n_concepts):
        out = out.join(n, "source_id", "left")
    return out.select("source_id", "title", "last_event_at", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("events", "versions", "chunks", "concepts")])


def bucket(at: Column, grain: str) -> Column:
    """Day, Monday of the week, or first of the month, as a date string."""
    return F.date_format(F.date_trunc({"day": "day", "week": "week", "month": "month"}[grain], at), "yyyy-MM-dd")


def largest_gaps(points: DataFrame, key: str, at: str) -> DataFrame:
    """Largest distance in days between adjacent points of each key, with the first and last point."""
    w = Window.partitionBy(key).orderBy(at)
    step = points.select(key, at).filter(F.col(at).isNotNull()).distinct().withColumn("prev", F.lag(at).over(w))
    return step.groupBy(key).agg(F.coalesce(F.max(days_between(F.col("prev"), F.col(at))), F.lit(0)).alias("largest_gap_days"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("points"))


def timeline(sources: DataFrame, event: DataFrame, coverage: DataFrame, concept: DataFrame, reviews: DataFrame, since: Column, until: Column, limit: int = 50, concepts: list[str] | None = None) -> DataFrame:
    """Encounters and reviews per concept in a period, the concepts of most sources first, with the largest gap between
    any two neighbouring marks.  ``concepts`` restricts the answer."""
    c = coverage.filter((F.col("last_contact_at") >= since) & (F.col("first_contact_at") <= until)).join(concept.select(F.col("id").alias("concept_id"), "label"), "concept_id")
    if concepts is not None:
        c = c.filter(F.col("concept_id").isin(concepts))
    top = F.broadcast(c.orderBy(F.desc("distinct_sources"), F.desc("last_contact_at"), "concept_id").limit(limit).select("concept_id", "label", "distinct_sources"))
    e = event.filter(F.col("occurred_at").between(since, until)).select("source_id", "occurred_at", "engagement", "capture_path").distinct()
    met = sources.select("concept_id", "source_id").join(top.select("concept_id"), "concept_id").join(e, "source_id")
    said = reviews.filter(F.col("presented_at").between(since, until)).join(top.select("concept_id"), "concept_id")
    rating = F.coalesce("user_grade_override", "machine_rating", "self_rating")
    n_met = met.groupBy("concept_id").agg(F.count(F.lit(1)).alias("encounters"))
    n_said = said.groupBy("concept_id").agg(F.count(F.lit(1)).alias("reviews"), F.count_if(rating >= 3).alias("passed"))
    marks = met.select("concept_id", F.col("occurred_at").alias("at")).unionByName(said.select("concept_id", F.col("presented_at").alias("at")))
    out = top.join(largest_gaps(marks, "concept_id", "at").drop("points"), "concept_id", "left").join(n_met, "concept_id", "left").join(n_said, "concept_id", "left")
    return out.select("concept_id", "label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("encounters", "reviews", "passed", "largest_gap_days")], "first_at", "last_at")


def rooted(edge: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """``concept_id`` of a root and all its vocabulary subclasses, found breadth-first; cycles end the walk."""
    down = edge.filter("relation = 'subclass_of' and provenance = 'vocabulary' and from_concept is not null").select(F.col("to_concept").alias("concept_id"), F.col("from_concept").alias("kid")).distinct()
    seen = frontier = scratch.put(edge.sparkSession.createDataFrame([(root,)], "concept_id string"))
    while frontier.limit(1).count():
        frontier = scratch.put(down.join(frontier, "concept_id", "left_semi").select(F.col("kid").alias("concept_id")).distinct().join(seen, "concept_id", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def prior_coverage(event: DataFrame) -> DataFrame:
    """Per source: seen before or not, number of events, latest known novelty."""
    e = event.filter("source_id is not null").select("id", "source_id", "occurred_at", "novelty").distinct()
    latest = F.max_by("novelty", F.when(F.col("novelty").isNotNull(), F.struct("occurred_at", "id")))
    return e.groupBy("source_id").agg(F.count(F.lit(1)).alias("events"), (F.count(F.lit(1)) > 1).alias("seen_before"), latest.alias("latest_novelty"))


def recent_events(event: DataFrame, source: DataFrame, limit: int = 50) -> DataFrame:
    """The latest events with the title of their source; ties by id."""
    top = event.filter("occurred_at is not null").distinct().orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)
    return top.join(source.select(F.col("id").alias("source_id"), "title"), "source_id", "left")


def engagement_high_water(event: DataFrame) -> DataFrame:
    """Deepest engagement per source; among equals the earliest row wins, as only a strictly greater level replaces."""
    e = event.filter("source_id is not null").withColumn("rank", level_rank(F.col("engagement"))).filter("rank is not null").select("source_id", "id", "occurred_at", "engagement", "engagement_source", "rank").distinct()
    w = Window.partitionBy("source_id").orderBy(F.desc("rank"), "occurred_at", "id", "engagement_source")
    return e.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
