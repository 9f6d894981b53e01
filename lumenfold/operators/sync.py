"""Order-free merge of the logs of several devices, and their exchange as encrypted payloads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.coverage import level_name, level_rank

#: Processing states from the earliest to the latest; the first two are of one rank.
STATES = ("captured", "extraction_failed", "extracted", "chunked", "embedded", "linked", "rolled_up", "itemised")


def merged_sources(rows: DataFrame) -> DataFrame:
    """One row per source id from all versions: nulls are filled (of several values the smallest), the first sighting is
    the earliest, privacy once set stays, a paper stays a paper, and a deletion stays.  The result does not depend on
    the order or grouping of the versions."""
    keep = lambda c: F.min(c).alias(c)
    return rows.filter("id is not null").groupBy("id").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "paper", "paper")), F.min("kind")).alias("kind"), keep("canonical_url"), keep("doi"), keep("content_hash"), keep("title"), keep("authors"), keep("published_at"), keep("first_seen_at"),
        F.coalesce(F.bool_or("is_private"), F.lit(False)).alias("is_private"), F.min("deleted_at").alias("deleted_at"),
    )


def _state_rank(c: Column) -> Column:
    p = F.array_position(F.array(*map(F.lit, STATES)), c)
    return F.when(p > 0, F.greatest(p - 2, F.lit(0)))


def merged_events(rows: DataFrame) -> DataFrame:
    """One row per event id: deepest engagement with its origin, furthest state with its reason, novelty with its model."""
    r = rows.filter("id is not null").withColumn("e", level_rank(F.col("engagement"))).withColumn("p", _state_rank(F.col("status")))
    top = lambda k, *cs: F.max(F.when(F.col(k).isNotNull(), F.struct(k, *cs)))
    g = r.groupBy("id").agg(F.min("source_id").alias("source_id"), F.min("occurred_at").alias("occurred_at"), top("e", "engagement_source").alias("x"), top("p", "status", "status_reason").alias("y"), top("novelty", "novelty_model_id").alias("z"))
    return g.select("id", "source_id", "occurred_at", level_name(F.col("x.e")).alias("engagement"), F.col("x.engagement_source").alias("engagement_source"), F.col("y.status").alias("status"), F.col("y.status_reason").alias("status_reason"), F.col("z.novelty").alias("novelty"), F.col("z.novelty_model_id").alias("novelty_model_id"))


def merged_reviews(rows: DataFrame) -> DataFrame:
    """One row per review id: an override and an answer fill where they are missing, all else is as first written."""
    keep = lambda c: F.min(c).alias(c)
    own = [c for c in rows.columns if c != "id"]
    return rows.filter("id is not null").groupBy("id").agg(*map(keep, own))


def natural_matches(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, known_id, by)``: each incoming source with the known source of the same DOI, else URL, else content hash.

    One equi-join per key instead of one join on alternatives; the best key and then the smallest id wins.
    """
    parts = []
    for n, k in enumerate(("doi", "canonical_url", "content_hash")):
        a = incoming.filter(F.col(k).isNotNull()).select("id", k)
        b = known.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("known_id"))
        parts.append(a.join(b, k).select("id", "known_id", F.lit(n).alias("n"), F.lit(k).alias("by")))
    best = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.min(F.struct("n", "known_id", "by")).alias("m"))
    return best.select("id", "m.known_id", "m.by")


def deferred(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent has not arrived: kept for the next round, keyed by what they wait for."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def since(rows: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next rows of an append-only relay."""
    return rows.filter(F.col("cursor") > cursor).orderBy("cursor").limit(limit)


def derive_key(passphrase: str, salt: bytes, rounds: int = 600_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def sealed(rows: DataFrame, table: str, key: bytes) -> DataFrame:
    """Rows as encrypted JSON payloads ``(table, payload)`` (AES-256-GCM, a nonce per row)."""
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(F.lit(table).alias("table"), F.base64(F.aes_encrypt(body, F.lit(key), F.lit("GCM"))).alias("payload"))


def opened(payloads: DataFrame, schema: str, key: bytes) -> DataFrame:
    """Rows back from payloads; a payload of another key fails the job."""
    body = F.aes_decrypt(F.unbase64("payload"), F.lit(key), F.lit("GCM")).cast("string")
    return payloads.select(F.from_json(body, schema).alias("r")).select("r.*")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Cursor per device for an append-only log."""
    return rows.withColumn("cursor", F.row_number().over(Window.partitionBy("device").orderBy(*order)).cast("long"))


def dirty(rows: DataFrame, since: Column | None, at: str = "recorded_at") -> DataFrame:
    """Rows that changed after the last push; all of them before the first.  An unknown time counts as changed."""
    return rows if since is None else rows.filter(F.coalesce(F.col(at) > since, F.lit(True)))


#: Fixed value: the version of the exchange; a payload of another one is refused.
PROTOCOL = 1


def push(tables: dict[str, DataFrame], device: str, key: bytes) -> DataFrame:
    """``(device, version, table, payload)``: the changed rows of all tables as sealed payloads for the relay."""
    parts = [sealed(df, name, key) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(device).alias("device"), F.lit(PROTOCOL).alias("version"), "table", "payload")


def received(batches: DataFrame, own: str) -> DataFrame:
    """Batches of other devices; the job fails on one of another version."""
    same = F.when(F.col("version") == PROTOCOL, True).otherwise(F.raise_error(F.lit("payload of another version")).cast("boolean"))
    return batches.filter(F.col("device") != own).filter(same)


def remapped(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """``(id, local_id)`` of incoming sources that are known here under another id, by DOI or else by URL."""
    new = incoming.filter("id is not null").join(local.select("id"), "id", "left_anti")
    return natural_matches(new.withColumn("content_hash", F.lit(None).cast("string")), local).select("id", F.col("known_id").alias("local_id"))


def pulled(incoming: dict[str, DataFrame], local: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Sources and events after a pull: sources known under another id are merged into it and references rewritten; events
    whose source is unknown are deferred.  ``(sources, events)``, events with ``state`` applied, merged or deferred."""
    names = remapped(incoming["source"], local["source"])
    theirs = incoming["source"].join(names, "id", "left").withColumn("id", F.coalesce("local_id", "id")).drop("local_id")
    sources = merged_sources(local["source"].unionByName(theirs, allowMissingColumns=True))
    e = incoming["event"].join(names.select(F.col("id").alias("source_id"), "local_id"), "source_id", "left").withColumn("source_id", F.coalesce("local_id", "source_id")).drop("local_id")
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("_known"))
    mine = local["event"].select("id").distinct().withColumn("_mine", F.lit(True))
    state = F.when(F.col("source_id").isNotNull() & F.col("_known").isNull(), "deferred").when(F.col("_mine"), "merged").otherwise("applied")
    return sources, e.join(known, "source_id", "left").join(mine, "id", "left").withColumn("state", state).drop("_known", "_mine")
