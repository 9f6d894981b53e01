"""Export to and import from line-delimited JSON, one header and one ``{t, r}`` line per row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT, VERSION = "lumenfold-export", 1


def export_lines(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``(ord, k, value)`` lines of all tables in the given order, rows by key, after a header with the row counts.

    Ordering by ``(ord, k)`` makes equal content equal text.  Nulls are written; keys are the order of rows.
    """
    parts = []
    for n, (name, (df, key)) in enumerate(tables.items(), 1):
        body = F.to_json(F.struct(F.lit(name).alias("t"), F.struct(*df.columns).alias("r")), {"ignoreNullFields": "false"})
        parts.append(df.select(F.lit(n).alias("ord"), F.to_json(F.struct(*key)).alias("k"), F.lit(name).alias("t"), body.alias("value")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("t").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "count")))).alias("counts"))
    head = counts.select(F.lit(0).alias("ord"), F.lit("").alias("k"), F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), "counts")).alias("value"))
    return head.unionByName(rows.select("ord", "k", "value"))


def export_jsonl(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    export_lines(tables).orderBy("ord", "k", "value").select("value").write.mode("overwrite").text(path)


def import_jsonl(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables, and ``(t, declared, found)`` where header and content differ.  Foreign formats and tables are refused."""
    lines = spark.read.text(path)
    head = lines.filter(F.get_json_object("value", "$.format").isNotNull()).first()
    meta = json.loads(head[0]) if head else {}
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise ValueError("not an export of this format and version")
    if unknown := set(meta.get("counts", {})) - set(schemas):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    tagged = lines.withColumn("t", F.get_json_object("value", "$.t")).filter("t is not null")
    out = {t: tagged.filter(F.col("t") == t).select(F.from_json("value", StructType().add("r", s)).alias("x")).select("x.r.*") for t, s in schemas.items()}
    declared = spark.createDataFrame(list(meta.get("counts", {}).items()), "t string, declared long")
    found = tagged.groupBy("t").agg(F.count(F.lit(1)).alias("found"))
    return out, declared.join(found, "t", "full").filter(~F.col("declared").eqNullSafe(F.col("found")))


def uncovered(schema: dict[str, list[str]], manifest: dict[str, list[str]]) -> list[str]:
    """Tables and columns of a catalogue that an export manifest leaves out."""
    return sorted([t for t in schema if t not in manifest] + [f"{t}.{c}" for t, cols in schema.items() if t in manifest for c in cols if c not in manifest[t]])
