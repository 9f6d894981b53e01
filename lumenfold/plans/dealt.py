"""Queries of the general problems: orphan references (p1) and hierarchies (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import hierarchy as H
from lumenfold.operators import references as R
from lumenfold.session import Scratch
from lumenfold.tables import iso, table


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return R.union_all(
        [
            R.references(table(spark, d, "ingestion_event"), "ingestion_event", "id", "source_id", "source"),
            R.references(table(spark, d, "mention"), "mention", "id", "concept_id", "concept"),
            R.references(table(spark, d, "citation"), "citation", "from_doi", "to_doi", "work", doi=True),
        ]
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.union_all(
        [
            R.records(table(spark, d, "reading_source"), "id", "source"),
            R.records(table(spark, d, "concept"), "id", "concept"),
            R.records(table(spark, d, "scholar_work"), "doi", "work", doi=True),
        ]
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    return R.orphans(refs, R.ledger(R.deltas(refs, _records(spark, d))), Scratch(spark, "orphans"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("child_table", "child_key", "parent_key").distinct()


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    return R.by_period(_orphans(spark, d))


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The state kept up by changes: rows recorded before 2025, then the later ones, then the retraction of all repeats."""
    scratch = Scratch(spark, "ledger")
    refs, recs = _refs(spark, d), _records(spark, d)
    early = F.coalesce(F.col("at") < F.to_timestamp(F.lit("2025-01-01")), F.lit(False))
    R.save(R.ledger(R.deltas(refs.filter(early), recs.filter(early))), scratch.base, 0)
    R.save(R.advance(R.load(spark, scratch.base, 0), R.deltas(refs.filter(~early), recs.filter(~early))), scratch.base, 1)
    extra = lambda t: t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    R.save(R.advance(R.load(spark, scratch.base, 1), R.deltas(extra(refs), extra(recs), sign=1 - F.col("n"))), scratch.base, 2)
    return R.keys(R.load(spark, scratch.base, 2)).select("space", "key", "n_ref", "n_live", "n_dead", iso("first_live_at").alias("first_live_at"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge").filter("provenance = 'vocabulary' and relation in ('subclass_of', 'part_of')")


_P7_COLUMNS = ("from_concept", "to_concept", "relation")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "cycles")
    lost = H.unprocessed(scratch.put(H.links(_vocabulary(spark, d), *_P7_COLUMNS)), scratch)
    return lost.select(F.col("forest").alias("relation"), F.col("node").alias("concept_id"), "cycle_id")


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    t = H.hierarchy(_vocabulary(spark, d), *_P7_COLUMNS, Scratch(spark, "tree"))
    return t.select(F.col("forest").alias("relation"), F.col("node").alias("concept_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", (F.col("size") - 1).alias("n_descendants"), F.array_join("path", " > ").alias("path"), "n_parents", "cycle_id")


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Every parent link, also those beside the tree."""
    return H.links_in_tree(_vocabulary(spark, d), *_P7_COLUMNS).select(F.col("forest").alias("relation"), F.col("node").alias("concept_id"), F.col("parent").alias("parent_id"), "in_tree")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "below")
    e = _vocabulary(spark, d)
    tree = scratch.put(H.hierarchy(e, *_P7_COLUMNS, scratch).drop("path"))
    out = H.descendants(tree, H.links_in_tree(e, *_P7_COLUMNS).filter("not in_tree"), scratch)
    return out.select(F.col("forest").alias("relation"), F.col("ancestor").alias("concept_id"), F.col("node").alias("descendant_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_month, p1_ledger, p7_found, p7_hierarchy, p7_links, p7_descendants)}

#: DuckDB text of the DOI normal form of ``{}``.
DOI_SQL = r"""(SELECT CASE WHEN regexp_matches(x, '/.') THEN lower(x) END FROM (SELECT regexp_replace(regexp_extract(
 regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^[\s\x{{A0}}\x{{FEFF}}]+|[\s\x{{A0}}\x{{FEFF}}]+$', '', 'g'), '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i'), '^info:doi/', '', 'i'),
 '(?i)(?:^|[^A-Za-z0-9_])(10\.[0-9]{{4,9}}/[-._;()/:a-z0-9<>+\[\]]+)', 1), '[.,;:)\]>''"]+$', '') AS x))"""

_P1 = f"""
WITH refs AS (
 SELECT 'ingestion_event' AS child_table, id AS child_key, source_id AS parent_key, 'source' AS space, source_id AS k, recorded_at AS ts FROM ingestion_event WHERE source_id IS NOT NULL
 UNION ALL SELECT 'mention', id, concept_id, 'concept', concept_id, recorded_at FROM mention WHERE concept_id IS NOT NULL
 UNION ALL SELECT 'citation', from_doi, to_doi, 'work', coalesce({DOI_SQL.format("to_doi")}, '?' || to_doi), recorded_at FROM citation WHERE to_doi IS NOT NULL),
recs AS (
 SELECT 'source' AS space, id AS k, recorded_at AS ts, deleted_at IS NULL AS live FROM reading_source
 UNION ALL SELECT 'concept', id, recorded_at, deleted_at IS NULL FROM concept
 UNION ALL SELECT 'work', {DOI_SQL.format("doi")}, recorded_at, deleted_at IS NULL FROM scholar_work),
st AS (SELECT space, k, count(*) FILTER (WHERE live) AS n_live, min(ts) FILTER (WHERE live) AS first_live FROM recs WHERE k IS NOT NULL GROUP BY space, k),
found AS (SELECT DISTINCT r.child_table, r.child_key, r.parent_key, r.ts,
 CASE WHEN st.k IS NULL THEN 'missing' WHEN st.n_live = 0 THEN 'deleted' ELSE 'late' END AS reason
 FROM refs r LEFT JOIN st ON st.space = r.space AND st.k = r.k
 WHERE st.k IS NULL OR st.n_live = 0 OR r.ts < st.first_live)
"""
_P7 = """
WITH RECURSIVE l AS (SELECT DISTINCT relation, from_concept AS node, to_concept AS parent FROM edge
 WHERE provenance = 'vocabulary' AND relation IN ('subclass_of', 'part_of') AND from_concept IS NOT NULL AND to_concept IS NOT NULL),
n AS (SELECT relation, node FROM l UNION SELECT relation, parent FROM l),
r AS (SELECT relation, node AS start, parent AS x FROM l UNION SELECT r.relation, r.start, l.parent FROM r JOIN l ON l.relation = r.relation AND l.node = r.x),
o AS (SELECT relation, start AS node FROM r WHERE start = x),
c AS (SELECT relation, node, min(cycle_id) AS cycle_id FROM (SELECT relation, node, node AS cycle_id FROM o UNION ALL SELECT r.relation, r.start, o.node FROM r JOIN o ON o.relation = r.relation AND o.node = r.x) GROUP BY 1, 2),
e AS (SELECT relation, node, min(parent) AS parent, count(*) AS n_parents FROM l GROUP BY 1, 2),
t AS (SELECT n.relation, n.node, NULL::VARCHAR AS parent, n.node AS root, 0::BIGINT AS depth, [n.node] AS path FROM n LEFT JOIN e USING (relation, node) WHERE e.node IS NULL
 UNION ALL SELECT e.relation, e.node, e.parent, t.root, t.depth + 1, list_append(t.path, e.node) FROM t JOIN e ON e.relation = t.relation AND e.parent = t.node WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.relation = e.relation AND c.node = e.node))
"""
ORACLES = {
    "p1_found": _P1 + "SELECT DISTINCT child_table, child_key, parent_key FROM found",
    "p1_by_month": _P1 + """, m AS (SELECT DISTINCT child_table, child_key, parent_key, strftime(ts, '%Y-%m') AS month, reason FROM found)
 SELECT child_table, month, reason, count(*) AS n_orphans, count(DISTINCT parent_key) AS n_keys FROM m GROUP BY 1, 2, 3""",
    "p1_ledger": _P1 + """, a AS (SELECT space, k, 1 AS r, 0 AS l, 0 AS x, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT * FROM refs)
 UNION ALL SELECT space, k, 0, CASE WHEN live THEN 1 ELSE 0 END, CASE WHEN live THEN 0 ELSE 1 END, CASE WHEN live THEN ts END FROM (SELECT DISTINCT * FROM recs WHERE k IS NOT NULL))
 SELECT space, replace(k, '?', chr(1)) AS key, sum(r)::BIGINT AS n_ref, sum(l)::BIGINT AS n_live, sum(x)::BIGINT AS n_dead, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_live_at FROM a GROUP BY space, k""",
    "p7_found": _P7 + "SELECT relation, node AS concept_id, cycle_id FROM c",
    "p7_hierarchy": _P7 + """SELECT t.relation, t.node AS concept_id, t.parent AS parent_id, t.root AS root_id, t.depth,
 (SELECT count(*) FROM t d WHERE d.relation = t.relation AND list_contains(d.path, t.node)) - 1 AS n_descendants, array_to_string(t.path, ' > ') AS path, coalesce(e.n_parents, 0) AS n_parents, NULL::VARCHAR AS cycle_id FROM t LEFT JOIN e USING (relation, node)
 UNION ALL SELECT c.relation, c.node, e.parent, NULL, NULL, NULL, NULL, e.n_parents, c.cycle_id FROM c JOIN e USING (relation, node)""",
    "p7_links": _P7 + "SELECT l.relation, l.node AS concept_id, l.parent AS parent_id, l.parent = e.parent AS in_tree FROM l JOIN e USING (relation, node)",
    "p7_descendants": _P7 + "SELECT relation, x AS concept_id, start AS descendant_id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.relation = r.relation AND c.node = r.start)",
}
