"""Semantic constraints of the tables as validation expressions: each yields its violations instead of failing a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.identity import normal_doi

#: Columns that each version of the tables added: version, table, column, type.
ADDED = ((2, "ingestion_event", "novelty_model_id", "string"), (2, "mention", "model_id", "string"), (3, "document_version", "lang", "string"))
VERSION = max(v for v, *_ in ADDED)


def upgraded(df: DataFrame, table: str, version: int) -> DataFrame:
    """A table as written by an older version, with the columns added since as nulls; a newer version is refused."""
    if version > VERSION:
        raise ValueError(f"{table} was written by version {version}; this is {VERSION}")
    new = [(c, t) for v, name, c, t in ADDED if name == table and v > version and c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(t) for c, t in new}) if new else df


def rules() -> dict[str, tuple[str, Column]]:
    """Rule name to (table, condition that holds for a violating row)."""
    c = F.col
    return {
        "novelty_without_model": ("ingestion_event", c("novelty").isNotNull() & c("novelty_model_id").isNull()),
        "unknown_engagement": ("ingestion_event", c("engagement").isNotNull() & ~c("engagement").isin("skim", "read", "annotate", "apply", "teach")),
        "local_concept_without_prefix": ("concept", (c("scheme") == "local") & ~c("id").startswith("local:")),
        "empty_span": ("mention", c("end_char") <= c("start_char")),
        "confidence_out_of_range": ("mention", ~c("confidence").between(0, 1)),
        "empty_chunk": ("chunk", c("end_char") <= c("start_char")),
        "self_citation": ("citation", normal_doi(c("from_doi")) == normal_doi(c("to_doi"))),
        "dimension_mismatch": ("embedding_meta", c("vector").isNotNull() & (F.size("vector") != c("dim"))),
        "no_identity": ("reading_source", c("canonical_url").isNull() & c("doi").isNull() & c("content_hash").isNull()),
        "unknown_relation": ("edge", ~c("relation").isin("subclass_of", "part_of", "co_occurs", "user_linked", "cites")),
        "unknown_provenance": ("edge", ~c("provenance").isin("vocabulary", "corpus_stats", "user", "citation_graph")),
    }


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations)``; each table is scanned once for all of its rules."""
    parts = []
    for t, df in tables.items():
        own = {n: cond for n, (table, cond) in rules().items() if table == t}
        if own:
            counts = df.agg(*[F.count_if(cond).alias(n) for n, cond in own.items()])
            parts.append(counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*own))).alias("rule", "violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
