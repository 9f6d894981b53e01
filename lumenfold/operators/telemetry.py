"""Plausibility of reading sessions and the engagement derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.coverage import level_rank

#: Words per minute, least active time, cap as a multiple of the expected time, slack of the clock.
WPM, MIN_ACTIVE_MS, CAP, CLOCK_SLACK_MS = 240, 3000, 3, 1000
READ_SHARE, READ_SCROLL = 0.5, 0.8
#: How far a level of engagement stretches the first interval.
PRIOR = {"skim": 0.8, "read": 1.0, "annotate": 1.25, "apply": 1.5, "teach": 1.8}


def expected_ms(words: Column) -> Column:
    return F.greatest(F.lit(1000), F.floor(words / WPM * 60000 + 0.5)).cast("long")


def assess(sessions: DataFrame) -> DataFrame:
    """Adds ``expected_ms``, ``reject`` (the first rule that fails, or null), ``plausible`` and ``capped_ms``.

    Scrolling back counts as scrolling, also where no depth was reported.
    """
    e = expected_ms(F.col("word_count"))
    elapsed = (F.unix_millis("ended_at") - F.unix_millis("started_at")).cast("long")
    reject = (
        F.when(F.col("active_ms") < MIN_ACTIVE_MS, "too_short").when((F.coalesce("max_scroll_pct", F.lit(0.0)) <= 0) & (F.coalesce("scroll_reversals", F.lit(0)) <= 0), "no_scroll")
        .when(F.col("active_ms") > CAP * F.col("expected_ms"), "too_long").when(F.col("active_ms") > elapsed + CLOCK_SLACK_MS, "beyond_wall_clock")
    )
    return sessions.withColumn("expected_ms", e).withColumn("reject", reject).withColumn("plausible", F.col("reject").isNull()).withColumn("capped_ms", F.least("active_ms", CAP * F.col("expected_ms")))


def engagement(assessed: DataFrame) -> DataFrame:
    """Adds ``engagement``: null if implausible, ``read`` for enough time and scroll, else ``skim``."""
    enough = (F.col("capped_ms") >= READ_SHARE * F.col("expected_ms")) & (F.coalesce("max_scroll_pct", F.lit(0.0)) >= READ_SCROLL)
    return assessed.withColumn("engagement", F.when(F.col("plausible"), F.when(enough, "read").otherwise("skim")))


def multiplier(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in PRIOR.items()], F.lit(1.0))


def record(sessions: DataFrame, event: DataFrame, version: DataFrame, fallback_words: int = 400) -> DataFrame:
    """Reports of sessions judged by the words of the latest version of their event's source, and the engagement that the
    event has afterwards: only a deeper level replaces a level."""
    words = version.filter("source_id is not null").groupBy("source_id").agg(F.max_by("word_count", F.struct("extracted_at", "id")).alias("words"))
    e = event.filter("id is not null").groupBy(F.col("id").alias("ingestion_event_id")).agg(F.min(F.struct("source_id", "engagement")).alias("e"))
    known = e.select("ingestion_event_id", "e.*").join(words, "source_id", "left")
    rows = sessions.drop("engagement").join(known, "ingestion_event_id").withColumn("word_count", F.coalesce(F.nullif("words", F.lit(0)), F.lit(fallback_words)))
    judged = engagement(assess(rows.withColumnRenamed("engagement", "held"))).withColumnRenamed("engagement", "derived")
    deeper = F.coalesce(level_rank(F.col("derived")), F.lit(0)) > F.coalesce(level_rank(F.col("held")), F.lit(0))
    return judged.withColumn("applied", deeper).withColumn("engagement", F.when(deeper, F.col("derived")).otherwise(F.col("held")))


def sessionise(events: DataFrame, user: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each user: runs of events no further apart than the gap."""
    w = F.session_window(F.col(at), f"{gap_minutes} minutes")
    return events.filter(F.col(user).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(user), w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("started_at"), F.max(at).alias("ended_at")).drop("w")
