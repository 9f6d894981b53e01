"""Evidence for concepts, drafts of quiz items from it, their groundedness, and keyword grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.spotter import STOP


def evidence(mention: DataFrame, chunk: DataFrame, version: DataFrame, source: DataFrame, limit: int = 8) -> DataFrame:
    """The best chunks per concept from sources that are not private: primary first, then confidence, then chunk id.

    Chunks are ranked per concept with a group limit, so a frequent concept keeps ``limit`` rows per task before the shuffle.
    """
    open_sources = source.filter(~F.coalesce("is_private", F.lit(False))).select(F.col("id").alias("source_id"))
    c = chunk.select(F.col("id").alias("chunk_id"), "document_version_id", "start_char", "end_char").dropDuplicates(["chunk_id"])
    v = version.select(F.col("id").alias("document_version_id"), "source_id").distinct().join(open_sources, "source_id", "left_semi")
    m = mention.filter("concept_id is not null").groupBy("concept_id", "chunk_id").agg(F.max(F.coalesce("is_primary", F.lit(False))).alias("is_primary"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy("concept_id").orderBy(F.desc("is_primary"), F.desc_nulls_last("confidence"), "chunk_id")
    return m.join(c, "chunk_id").join(v, "document_version_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


#: Kinds of items in the order they are made, evidence that gives points, items of one concept.
KINDS = ("free_recall", "cloze", "synthesis", "application")
POINTS, MAX_ITEMS = 3, 3
SENTENCE = r"(?s)([^.!?]{25,400}[.!?])"


def first_sentence(text: Column) -> Column:
    """The first sentence of acceptable length as it stands in the text, or null."""
    return F.nullif(F.regexp_extract(text, SENTENCE, 1), F.lit(""))


def points(found: DataFrame, version: DataFrame) -> DataFrame:
    """``(concept_id, points, sources)``: the first sentences of the best evidence of each concept with their spans in the
    version's text, and the number of sources of all its evidence."""
    texts = version.filter("id is not null").groupBy(F.col("id").alias("document_version_id")).agg(F.min("text").alias("text"))
    body = F.expr("substr(text, cast(start_char + 1 as int), cast(end_char - start_char as int))")
    best = found.filter(F.col("rank") <= POINTS).join(texts, "document_version_id").withColumn("body", body).withColumn("s", first_sentence(F.col("body"))).filter("s is not null")
    at = (F.col("start_char") + F.position(F.col("s"), F.col("body")) - 1).cast("long")
    p = F.struct("rank", F.trim(F.regexp_replace("s", r"^\s+|\s+$", "")).alias("text"), "document_version_id", at.alias("start"), (at + F.length("s")).cast("long").alias("end"))
    sources = found.groupBy("concept_id").agg(F.count_distinct("source_id").alias("sources"))
    return best.groupBy("concept_id").agg(F.array_sort(F.collect_list(p)).alias("points")).join(sources, "concept_id")


def drafts(found: DataFrame, version: DataFrame, concept: DataFrame, kinds: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """``(concept_id, kind, prompt, points)``: one item per concept and kind; an item on how sources differ needs two."""
    p = points(found, version).join(concept.select(F.col("id").alias("concept_id"), "label"), "concept_id")
    first = F.col("points")[0]["text"]
    hidden = F.regexp_replace(first, F.concat(F.lit("(?i)\\Q"), F.col("label"), F.lit("\\E")), F.lit("_____"))
    prompt = (
        F.when(F.col("kind") == "cloze", F.concat(F.lit("Fill in: "), hidden)).when(F.col("kind") == "synthesis", F.concat(F.lit("Compare what your sources say about "), F.col("label")))
        .when(F.col("kind") == "application", F.concat(F.lit("Where would you apply "), F.col("label"), F.lit("?"))).otherwise(F.concat(F.lit("What is claimed about "), F.col("label"), F.lit("?")))
    )
    every = p.withColumn("kind", F.explode(F.slice(F.filter(F.array(*map(F.lit, kinds)), lambda k: (k != "synthesis") | (F.col("sources") >= 2)), 1, MAX_ITEMS)))
    return every.select("concept_id", "kind", prompt.alias("prompt"), "points")


def grounded(draft: DataFrame, version: DataFrame) -> DataFrame:
    """``(concept_id, kind, grounded)``: whether every point of a draft cites a span of a known version that holds its text."""
    texts = version.filter("id is not null").groupBy(F.col("id").alias("v")).agg(F.min("text").alias("whole"))
    each = draft.select("concept_id", "kind", F.explode_outer("points").alias("p")).join(texts, F.col("p.document_version_id") == F.col("v"), "left")
    cited = F.expr("substring(whole, cast(p.start + 1 as int), cast(p.end - p.start as int))")
    ok = F.col("whole").isNotNull() & (F.col("p.start") >= 0) & (F.col("p.end") > F.col("p.start")) & (F.col("p.end") <= F.length("whole")) & (F.trim(F.regexp_replace(cited, r"^\s+|\s+$", "")) == F.col("p.text"))
    return each.groupBy("concept_id", "kind").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("grounded"))


def wanting(coverage: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """``concept_id`` of covered concepts without a live item, those with primary sources and then most sources first."""
    live = items.filter("retired_at is null").select("concept_id").distinct()
    return coverage.join(live, "concept_id", "left_anti").orderBy(F.desc("primary_sources"), F.desc("distinct_sources"), "concept_id").limit(limit).select("concept_id")


def retire(items: DataFrame, retired: DataFrame, at: Column) -> DataFrame:
    """Items after some were retired: nothing is removed, and a retirement once made stays."""
    gone = retired.select("quiz_item_id").distinct().withColumn("_gone", F.lit(True))
    return items.join(gone, "quiz_item_id", "left").withColumn("retired_at", F.coalesce("retired_at", F.when(F.col("_gone"), at))).drop("_gone")


def terms(text: Column) -> Column:
    """Distinct words of more than three letters, function words left out."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 3) & ~w.isin(*sorted(STOP))))


def keyword_grade(answer: Column, point: Column, needed: float = 0.4) -> Column:
    """Whether the answer holds enough of a rubric point's terms; null if the point has none."""
    t = terms(point)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, terms(answer))) >= needed * F.size(t))


def grade(answer: Column, rubric: Column, needed: float = 0.4) -> Column:
    """Share of the points of a rubric that an answer meets; a point without terms is not met, no points give 0."""
    met = F.filter(rubric, lambda p: F.coalesce(keyword_grade(answer, p, needed), F.lit(False)))
    return F.coalesce(F.try_divide(F.size(met), F.nullif(F.size(rubric), F.lit(0))), F.lit(0.0))


def submit(answers: DataFrame, rating: Column) -> DataFrame:
    """Reviews of answers ``(id, quiz_item_id, concept_id, presented_at, answered_at, answer_text, points, predicted_recall,
    interval_days)`` as they are appended to the log; the state follows from replaying it."""
    return answers.withColumn("machine_grade", grade(F.col("answer_text"), F.col("points"))).withColumn("machine_rating", rating).withColumn("user_grade_override", F.lit(None).cast("int")).withColumn("self_rating", F.lit(None).cast("int")).withColumn(
        "latency_ms", (F.unix_millis("answered_at") - F.unix_millis("presented_at")).cast("long")
    )
