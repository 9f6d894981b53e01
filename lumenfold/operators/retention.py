"""Memory states replayed from the review log, due items, evidence of retention, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import scheduler as S

#: Fixed value: the lowest grade that counts as recalled.
PASS = 3


def rating(with_self: bool = True) -> Column:
    """The grade that counts: the user's override, else the machine's, else (where it counts) the self-rating."""
    cols = ["user_grade_override", "machine_rating"] + (["self_rating"] if with_self else [])
    return F.coalesce(*cols)


def _fold(reviews: DataFrame, multiplier: Column | None = None) -> DataFrame:
    """Per item the ordered fold of its graded reviews; the state array keeps the state before each review.

    An item's reviews are folded in one row, the size of which is one learner's history with one item.
    """
    scale = multiplier if multiplier is not None else F.lit(1.0)
    graded = reviews.filter("quiz_item_id is not null and presented_at is not null").withColumn("g", rating().cast("int")).withColumn("m", scale.cast("double")).filter("g is not null")
    logs = graded.groupBy("quiz_item_id").agg(F.array_sort(F.collect_list(F.struct("presented_at", "id", "g", "m"))).alias("log"))
    zero = F.struct(
        F.lit(None).cast("timestamp").alias("at"), F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"),
        F.array().cast("array<struct<p:double,pass:boolean>>").alias("scored"),
    )

    def step(a: Column, x: Column) -> Column:
        g = x["g"]
        days = F.floor((F.unix_timestamp(x["presented_at"]) - F.unix_timestamp(a["at"])) / 86400).cast("double")
        first = a["reps"] == 0
        return F.struct(
            x["presented_at"].alias("at"),
            F.when(first, S.first_stability(g) * x["m"]).otherwise(S.next_stability(a["s"], a["d"], g, days)).alias("s"),
            F.when(first, S.first_difficulty(g)).otherwise(S.next_difficulty(a["d"], g)).alias("d"),
            (a["reps"] + 1).alias("reps"),
            (a["lapses"] + F.when(~first & (g == 1), 1).otherwise(0)).alias("lapses"),
            F.when(first, a["scored"]).otherwise(F.concat(a["scored"], F.array(F.struct(S.recall(days, a["s"]).alias("p"), (g >= PASS).alias("pass"))))).alias("scored"),
        )

    return logs.select("quiz_item_id", F.aggregate("log", zero, step).alias("f")).select("quiz_item_id", "f.*")


def memory_states(reviews: DataFrame) -> DataFrame:
    """State of every item, replayed from the log: the log alone defines it, an override being one more column of it."""
    f = _fold(reviews)
    days = S.interval(F.col("s"))
    return f.select("quiz_item_id", F.col("s").alias("stability"), F.col("d").alias("difficulty"), F.col("at").alias("last_review_at"), "reps", "lapses", days.alias("interval_days"), (F.col("at") + F.make_dt_interval(days)).alias("due_at"))


def due_items(items: DataFrame, states: DataFrame, as_of: Column, limit: int = 20, include_new: bool = True) -> DataFrame:
    """Live items that are new or due, most uncertain first, interleaved round-robin by concept."""
    live = items.filter("retired_at is null").join(states, "quiz_item_id", "left")
    due = live.filter((F.col("due_at") <= as_of) | (F.col("due_at").isNull() & F.lit(include_new)))
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp("last_review_at")) / 86400)
    p = due.withColumn("recall", S.recall(days, F.col("stability"))).withColumn("priority", F.when(F.col("due_at").isNull(), 0.5).otherwise(1 - F.abs(F.col("recall") - 0.9)))
    turn = Window.partitionBy("concept_id").orderBy(F.desc("priority"), "quiz_item_id")
    p = p.withColumn("round", F.row_number().over(turn)).filter(F.col("round") <= limit)
    lead = Window.partitionBy("concept_id")
    p = p.withColumn("lead", F.max(F.struct("priority", F.lit(1))).over(lead)["priority"]).withColumn("lead_id", F.min(F.when(F.col("round") == 1, F.col("quiz_item_id"))).over(lead))
    return p.orderBy("round", F.desc("lead"), "lead_id").limit(limit).select("quiz_item_id", "concept_id", "priority", "round")


def next_due(states: DataFrame) -> DataFrame:
    return states.agg(F.min("due_at").alias("next_due_at"))


def due_on(states: DataFrame, day: str) -> DataFrame:
    """Items due on one day (retired ones included)."""
    d = F.to_timestamp(F.lit(day))
    return states.filter((F.col("due_at") >= d) & (F.col("due_at") < d + F.expr("interval 1 day"))).agg(F.count(F.lit(1)).alias("due"))


def evidence(reviews: DataFrame, states: DataFrame, items: DataFrame, as_of: Column, recent: int = 10) -> DataFrame:
    """Per concept: outcomes, passes, last success, longest successful interval, the ten latest outcomes, modelled recall.

    The recall is modelled over items that are not retired.  The latest outcomes are ranked with a group limit, apart from
    the counts, so a concept with a third of all reviews is cut down before it is sorted.
    """
    r = reviews.withColumn("g", rating().cast("int")).filter("g > 0 and concept_id is not null")
    rank = Window.partitionBy("concept_id").orderBy(F.desc("presented_at"), F.desc("id"))
    ok = F.col("g") >= PASS
    latest = r.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= recent).groupBy("concept_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("g").cast("string").alias("g")))), lambda x: x["g"]), "").alias("recent"))
    per = r.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("outcomes"), F.count_if(ok).alias("passes"), F.max(F.when(ok, F.col("presented_at"))).alias("last_success_at"), F.max(F.when(ok, F.col("interval_days"))).alias("longest_interval"),
    )
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp("last_review_at")) / 86400)
    owner = items.filter("retired_at is null").select("quiz_item_id", "concept_id").distinct()
    model = states.join(owner, "quiz_item_id").withColumn("p", S.recall(days, F.col("stability"))).groupBy("concept_id").agg(F.avg("p").alias("modelled_recall"))
    return per.join(latest, "concept_id").join(model, "concept_id", "left").withColumn("sufficient", F.col("outcomes") >= 2).withColumn("durably_known", F.coalesce(F.col("longest_interval") >= 21, F.lit(False)))


def calibration_bins(reviews: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted against actual recall per bin.  Reviews without override and machine grade are in no bin and no count."""
    r = reviews.withColumn("g", rating(False)).filter("g is not null and predicted_recall is not null").withColumn("ok", F.when(F.col("g") >= PASS, 1.0).otherwise(0.0))
    b = F.least(F.lit(bins - 1), F.floor(F.col("predicted_recall") * bins)).cast("int")
    return r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted_recall").alias("predicted"), F.avg("ok").alias("actual"))


def calibration(reviews: DataFrame) -> DataFrame:
    """Brier score and bias of the scored reviews (graded, with a prediction), and the number excluded because nothing was
    predicted, graded or not; zeros for an empty log."""
    g = rating(False)
    r = reviews.withColumn("ok", F.when(g.isNotNull() & F.col("predicted_recall").isNotNull(), F.when(g >= PASS, 1.0).otherwise(0.0)))
    d = F.col("predicted_recall") - F.col("ok")
    return r.agg(F.count("ok").alias("scored"), F.count_if(F.col("predicted_recall").isNull()).alias("excluded"), F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier"), F.coalesce(F.avg(d), F.lit(0.0)).alias("bias"))


def anomalous(reviews: DataFrame, min_reviews: int = 4) -> DataFrame:
    """Items always passed, never passed, or overridden at least half the time; a review without a grade is no pass."""
    r = reviews.withColumn("g", rating(False)).filter("quiz_item_id is not null")
    per = r.groupBy("quiz_item_id").agg(F.count(F.lit(1)).alias("reviews"), F.avg(F.when(F.col("g") >= PASS, 1.0).otherwise(0.0)).alias("pass_rate"), F.avg(F.when(F.col("user_grade_override").isNotNull(), 1.0).otherwise(0.0)).alias("override_rate"))
    return per.filter((F.col("reviews") >= min_reviews) & ((F.col("pass_rate") == 0) | (F.col("pass_rate") == 1) | (F.col("override_rate") >= 0.5)))


def replay_rows(reviews: DataFrame, contacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Graded reviews of items with ``engagement``, the latest level of an event that met their concept, and
    ``telemetry_backed``, how many plausible reading sessions back it.

    ``contacts`` are distinct ``(concept_id, event_id, occurred_at, engagement, mentions)`` and ``sessions`` have
    ``(event_id, plausible)``; both are aggregated per concept before they meet the reviews.
    """
    graded = reviews.withColumn("rating", rating().cast("int")).filter("quiz_item_id is not null and rating is not null")
    level = contacts.groupBy("concept_id").agg(F.max_by("engagement", F.when(F.col("engagement").isNotNull(), F.struct("occurred_at", "engagement"))).alias("engagement"))
    believed = sessions.filter("plausible").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    backed = contacts.join(believed, "event_id").groupBy("concept_id").agg(F.sum(F.col("n") * F.col("mentions")).alias("telemetry_backed"))
    return graded.drop("engagement").join(level, "concept_id", "left").join(backed, "concept_id", "left").withColumn("telemetry_backed", F.coalesce("telemetry_backed", F.lit(0)))


def counterfactual(rows: DataFrame, multiplier: Column, min_reviews: int = 50) -> DataFrame:
    """One row: Brier score and bias of the replay with and without a prior that scales stability after the first review,
    their difference, and whether there are enough scored reviews and any telemetry behind them.

    ``rows`` come from ``replay_rows``.  The first review of an item predicts nothing.
    """
    out = []
    for name, m in (("without", None), ("with", multiplier)):
        x = _fold(rows, m).select(F.explode("scored").alias("x")).select("x.p", F.when(F.col("x.pass"), 1.0).otherwise(0.0).alias("ok"))
        d = F.col("p") - F.col("ok")
        out.append(x.agg(F.count(F.lit(1)).alias("scored_" + name), F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier_" + name), F.coalesce(F.avg(d), F.lit(0.0)).alias("bias_" + name)).withColumn("k", F.lit(1)))
    backed = rows.agg(F.count_if(F.col("telemetry_backed") > 0).alias("telemetry_backed_reviews"), F.count("engagement").alias("engaged_reviews")).withColumn("k", F.lit(1))
    both = out[0].join(out[1], "k").join(backed, "k").drop("k")
    few, none = F.col("scored_with") < min_reviews, F.col("telemetry_backed_reviews") == 0
    notes = F.concat_ws(";", F.when(few, "few_reviews"), F.when(none, "no_telemetry"), F.when(none & (F.col("engaged_reviews") > 0), "self_asserted"))
    return both.withColumn("brier_delta", F.col("brier_with") - F.col("brier_without")).withColumn("improves", F.col("brier_delta") < 0).withColumn("sufficient", ~few & ~none).withColumn("notes", notes)
