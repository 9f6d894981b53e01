"""References to records that do not exist, kept as signed counts per key.

Every change of a child table is a delta ``(space, key, d_ref, d_live, d_dead)``: +1 for an added reference or
record, -1 for a retracted one.  ``ledger`` folds deltas into a state, ``advance`` folds a later batch into an earlier
state, and ``save`` and ``load`` keep a state per epoch in a folder, so the report never needs the history again.  Live
records are counted per key and time, so that retracting the earliest one moves a key's first time of existence to the
next.  Keys whose reference count is positive and whose existence count is zero are the current orphans; keys referenced
before their first live record are those that arrive late.

Scale: the fold is a map-side combined aggregation, so a key holding a third of all references shuffles one row
per map task.  The way back from keys to child rows joins only orphaned keys; those that hold more than a
thousandth of all references (at most 1,000 keys) are broadcast, all others are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.identity import normal_doi
from lumenfold.session import Scratch

#: A key is hot from this many references on, if it also holds a thousandth of all.
HOT_ROWS = 200_000
HOT_SHARE = 1000


def references(df: DataFrame, table: str, key: str, parent_key: str, space: str, at: str = "recorded_at", doi: bool = False) -> DataFrame:
    """Child rows ``(child_table, child_key, parent_key, space, key, at)``.

    Rows without a reference are none.  A DOI without a normal form equals no record: it keeps a key of its own.
    """
    raw = F.col(parent_key)
    norm = F.coalesce(normal_doi(raw), F.concat(F.lit("\u0001"), raw)) if doi else raw
    return df.filter(raw.isNotNull()).select(
        F.lit(table).alias("child_table"), F.col(key).alias("child_key"), raw.alias("parent_key"), F.lit(space).alias("space"), norm.alias("key"), F.col(at).alias("at")
    )


def records(df: DataFrame, key: str, space: str, at: str = "recorded_at", deleted: str = "deleted_at", doi: bool = False) -> DataFrame:
    """Parent rows ``(space, key, at, live)``; rows without a key (or DOI without a normal form) hold no record."""
    k = normal_doi(F.col(key)) if doi else F.col(key)
    return df.select(F.lit(space).alias("space"), k.alias("key"), F.col(at).alias("at"), F.col(deleted).isNull().alias("live")).filter(F.col("key").isNotNull())


def deltas(refs: DataFrame | None = None, recs: DataFrame | None = None, sign: int | Column = 1) -> DataFrame:
    """Change deltas of added (``sign`` 1) or retracted (-1) child and parent rows; a column gives each row its own sign."""
    parts = []
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("timestamp")
    by = (sign if isinstance(sign, Column) else F.lit(sign)).cast("long")
    if refs is not None:
        parts.append(refs.select("space", "key", none.alias("live_at"), by.alias("d_ref"), zero.alias("d_live"), zero.alias("d_dead"), F.when(by > 0, F.col("at")).alias("ref_at")))
    if recs is not None:
        live = F.col("live")
        parts.append(recs.select("space", "key", F.when(live, F.col("at")).alias("live_at"), zero.alias("d_ref"), F.when(live, by).otherwise(zero).alias("d_live"), F.when(live, zero).otherwise(by).alias("d_dead"), none.alias("ref_at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ledger(changes: DataFrame) -> DataFrame:
    """State ``(space, key, live_at, n_ref, n_live, n_dead, first_ref_at)``: one row per key and time of live records.

    ``first_ref_at`` does not move back when a reference is retracted; it only says which keys are looked at.
    """
    return changes.groupBy("space", "key", "live_at").agg(F.sum("d_ref").alias("n_ref"), F.sum("d_live").alias("n_live"), F.sum("d_dead").alias("n_dead"), F.min("ref_at").alias("first_ref_at"))


def advance(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after one more batch of deltas; rows whose counts are all zero again are dropped."""
    old = state.select("space", "key", "live_at", F.col("n_ref").alias("d_ref"), F.col("n_live").alias("d_live"), F.col("n_dead").alias("d_dead"), F.col("first_ref_at").alias("ref_at"))
    return ledger(old.unionByName(changes)).filter("n_ref <> 0 or n_live <> 0 or n_dead <> 0")


def save(state: DataFrame, folder: str, epoch: int) -> None:
    """Writes the state of an epoch; writing it again replaces it, so a repeated batch does no harm."""
    state.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def load(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/epoch={epoch}")


def keys(state: DataFrame) -> DataFrame:
    """Per key ``(space, key, n_ref, n_live, n_dead, first_ref_at, first_live_at)``."""
    return state.groupBy("space", "key").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_live").alias("n_live"), F.sum("n_dead").alias("n_dead"), F.min("first_ref_at").alias("first_ref_at"), F.min(F.when(F.col("n_live") > 0, F.col("live_at"))).alias("first_live_at")
    )


def open_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence, or referenced before they first existed."""
    return keys(state).filter((F.col("n_ref") > 0) & ((F.col("n_live") <= 0) | (F.col("first_ref_at") < F.col("first_live_at"))))


def orphans(refs: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """Orphan references ``(child_table, child_key, parent_key, at, reason)``, one row per row of ``refs``.

    ``reason`` is ``missing`` (no row of the key), ``deleted`` (only deleted rows) or ``late`` (the earliest live row
    was recorded after the reference).  Null ``at`` on either side is never late.  Repeated rows are
    left to the caller, who drops them together with the columns that are not wanted; an empty ``refs`` or state gives an empty result.
    """
    found = scratch.put(open_keys(state))
    total = found.agg(F.sum("n_ref")).first()[0] or 0
    hot_from = max(HOT_ROWS, total // HOT_SHARE)
    cols = ["space", "key", "n_live", "n_dead", "first_live_at"]
    hot, cold = found.filter(F.col("n_ref") > hot_from).select(cols), found.filter(F.col("n_ref") <= hot_from).select(cols)
    if found.filter(F.col("n_ref") > hot_from).limit(1).count():
        rest = refs.join(F.broadcast(hot.select("space", "key")), ["space", "key"], "left_anti")
        joined = refs.join(F.broadcast(hot), ["space", "key"]).unionByName(rest.join(cold, ["space", "key"]))
    else:
        joined = refs.join(cold, ["space", "key"])
    reason = F.when(F.col("n_live") > 0, "late").when(F.col("n_dead") > 0, "deleted").otherwise("missing")
    return joined.filter((F.col("n_live") <= 0) | (F.col("at") < F.col("first_live_at"))).select("child_table", "child_key", "parent_key", "at", reason.alias("reason"))


def by_period(found: DataFrame) -> DataFrame:
    """Orphan references per child table, month of ``at`` and reason (month null where ``at`` is)."""
    keys = found.select("child_table", "child_key", "parent_key", F.date_format("at", "yyyy-MM").alias("month"), "reason").distinct()
    return keys.groupBy("child_table", "month", "reason").agg(F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("parent_key").alias("n_keys"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
