"""Ranked, diverse suggestions from citations, coverage gaps, bridges and taxonomy holes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weight of each kind, and of the parts of a score.
BASE = {"citation": 1.0, "coverage_gap": 0.85, "bridge": 0.7, "taxonomy_hole": 0.55, "neighbour": 0.3}
W_EVIDENCE, W_GAP, W_REACH, W_REDUNDANCY = 1.0, 0.8, 0.3, 0.6


def _row(df: DataFrame, kind: str, target, evidence, gap, reach, concept=None, redundancy=0.0) -> DataFrame:
    col = lambda x: x if hasattr(x, "alias") else F.lit(float(x))
    return df.select(
        F.lit(kind).alias("kind"), target.alias("target"), (concept if concept is not None else F.lit(None).cast("string")).alias("concept_id"),
        col(evidence).cast("double").alias("evidence"), col(gap).cast("double").alias("gap"), col(reach).cast("double").alias("reach"), col(redundancy).cast("double").alias("redundancy"),
    )


def candidates(citations: DataFrame, gaps: DataFrame, bridges: DataFrame, holes: DataFrame, open_access: DataFrame) -> DataFrame:
    """All candidates with the strength of their evidence.  ``open_access`` has ``(doi, open_access)``."""
    oa = F.when(F.coalesce("open_access", F.lit(False)), 1.0).otherwise(0.4)
    c = citations.join(open_access.select("doi", "open_access"), "doi", "left")
    parts = [
        _row(c, "citation", F.col("doi"), F.least(F.lit(1.0), F.log2(1.0 + F.col("citing_works")) / 3), 1, oa),
        _row(gaps, "coverage_gap", F.col("concept_id"), F.least(F.lit(1.0), F.col("distinct_sources") / 5), F.least(F.lit(1.0), 0.5 + F.col("temporal_spread_days") / 180), 0.8, F.col("concept_id")),
        _row(bridges, "bridge", F.concat_ws("|", "a", "b"), F.least(F.lit(1.0), F.col("strength") / 25), 1, 0.6, F.col("a")),
        _row(holes.select("concept_id").distinct(), "taxonomy_hole", F.col("concept_id"), 0.5, 1, 0.8, F.col("concept_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbour_candidates(found: DataFrame) -> DataFrame:
    return _row(found, "neighbour", F.col("concept_id"), F.col("similarity"), 0.5, 0.7, F.col("concept_id"), F.col("similarity"))


def scored(cand: DataFrame) -> DataFrame:
    base = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in BASE.items()])
    return cand.withColumn("score", W_EVIDENCE * base * F.col("evidence") + W_GAP * F.col("gap") + W_REACH * F.col("reach") - W_REDUNDANCY * F.col("redundancy"))


def slate(cand: DataFrame, dismissed: DataFrame, cluster: DataFrame, limit: int = 10) -> DataFrame:
    """The best candidates, at most max(1, 40 %) from the largest cluster, one place kept for serendipity.

    The kept place goes to the best bridge or hole outside the largest cluster that is not chosen yet, else to the best
    unseen candidate.  Dismissed targets are left out, repeated (kind, target) keep their best score, ties go by kind
    and target.  Only the ``limit`` best inside and outside the largest cluster matter, so ranking is a bounded top-k.
    """
    best = F.row_number().over(Window.partitionBy("kind", "target").orderBy(F.desc("score"), F.col("concept_id").asc_nulls_last()))
    live = scored(cand).join(dismissed.select("target").distinct(), "target", "left_anti").withColumn("n", best).filter("n = 1").drop("n")
    largest = cluster.select("cluster_id", "size").distinct().orderBy(F.desc("size"), "cluster_id").limit(1)
    members = cluster.join(F.broadcast(largest.select("cluster_id")), "cluster_id").select("concept_id", F.lit(True).alias("big"))
    live = live.join(members, "concept_id", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    order = [F.desc("score"), F.col("kind"), F.col("target")]
    cap, places = max(1, int(limit * 0.4)), max(limit - 1, 0)
    # At most `limit` rows of each of these bounded heads can be chosen; windows over them hold at most 3 * limit rows.
    heads = live.filter("big").orderBy(*order).limit(limit).unionByName(live.filter("not big").orderBy(*order).limit(2 * limit))
    heads = heads.unionByName(live.filter("not big and kind in ('bridge', 'taxonomy_hole')").orderBy(*order).limit(limit + 1)).distinct()
    everything = Window.partitionBy("big").orderBy(*order)
    ranked = heads.withColumn("in_group", F.row_number().over(everything)).withColumn("allowed", ~F.col("big") | (F.col("in_group") <= cap))
    pos = F.row_number().over(Window.partitionBy("allowed").orderBy(*order))
    ranked = ranked.withColumn("pos", F.when(F.col("allowed"), pos)).withColumn("chosen", F.coalesce(F.col("pos") <= places, F.lit(False)))
    apart = F.when(~F.col("big") & F.col("kind").isin("bridge", "taxonomy_hole"), 0).otherwise(1)
    lucky = F.row_number().over(Window.partitionBy("chosen").orderBy(apart, *order))
    ranked = ranked.withColumn("lucky", (~F.col("chosen")) & (lucky == 1))
    return ranked.filter("chosen or lucky").select("kind", "target", "concept_id", "score", F.col("lucky").alias("serendipity"))


def dismissed_targets(dismissals: DataFrame, assertions: DataFrame) -> DataFrame:
    """Targets of dismissed suggestions and of the assertions that a subject is known or of no interest."""
    said = assertions.filter("kind in ('not_interested', 'known_already')").select(F.col("subject_id").alias("target"))
    return dismissals.select("target").unionByName(said).filter("target is not null").distinct()


def active(suggestions: DataFrame, now, limit: int = 10) -> DataFrame:
    """Undismissed, unexpired suggestions by score."""
    return suggestions.filter(F.col("dismissed_at").isNull() & (F.col("expires_at") > now)).orderBy(F.desc("score"), "id").limit(limit)
