"""Queries on references, log entries, nested records and packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators import logparse, nested, orphans, packed
from siftwarden.sources.tables import still_there, stored, table


def _referring(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("mvp_audit", "mvp_findings", "sample_bundle")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved references of audit rows and bundle edges."""
    return orphans.orphans(*_referring(spark, folder))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved references per table, field, month and state."""
    return orphans.orphan_counts(*_referring(spark, folder))


def p2_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Log entries with message and template, by the templates of both tables."""
    requests, gold = table(spark, folder, "analyze_request", spread=True), table(spark, folder, "gold_set")
    tree = logparse.learned(requests.select(F.col("raw_log").alias("text")), gold.select(F.col("raw").alias("text")))
    return logparse.log_entries(requests, "analyze_request", "request_id", "raw_log", tree).unionByName(logparse.log_entries(gold, "gold_set", "id", "raw", tree))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Log entries by their lines, once each."""
    return p2_entries(spark, folder).select("table_name", "row_key", "first_line", "last_line", "entry_ts", "entry_level", "component").distinct()


def p3_triples(spark: SparkSession, folder: str) -> DataFrame:
    """All path-value-ordinal triples."""
    return nested.triples(table(spark, folder, "mvp_findings", spread=True))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Objects in the lists of findings, by path."""
    return nested.objects(p3_triples(spark, folder)).select(F.col("record_id").alias("finding_id"), F.col("row_path").alias("path")).distinct()


#: Triples by application and folder: all flat tables are made from one stored stage.
_STAGES: dict[tuple[str, str], DataFrame] = {}


def _stage(spark: SparkSession, folder: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STAGES or not still_there(_STAGES[key]):
        _STAGES[key] = stored(p3_triples(spark, folder))
    return _STAGES[key]


def _flat(table_path: str, fields: list[str]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_tables(_stage(spark, folder), {table_path: fields})[table_path]

    query.__doc__ = f"Flat table of {table_path} with all its fields, its parent and position."
    return query


_SIGNALS = "failed_logins successful_logins privilege_escalation malware c2_or_exfil lateral_movement account_creation foreign_geo".split()
_OUTPUT = "severity is_anomaly risk_score confidence rationale control_ids nist_subcategories priority executive_summary attack_narrative top_factors anomaly_type explanation".split()

#: The fields that are listed are columns on every input; others that occur are added after them.
#: The parent of an agent is its record, that of a hit, piece of evidence or token the root's row.
FLAT_TABLES = {
    "p3_findings": _flat("finding", ["log_type", "summary", "rule_controls", "candidate_controls", "intel", "entities.usernames", "entities.source_ip", "entities.cve_ids", "entities.domains", *(f"signals.{s}" for s in _SIGNALS)]),
    "p3_hits": _flat("finding.intel.ioc_hits", ["type", "value", "feed.name", "feed.tags"]),
    "p3_sightings": _flat("finding.intel.ioc_hits.sightings", ["ts", "sensor"]),
    "p3_agents": _flat("agents", ["agent", "ok", "latency_ms", "source", "error", "output", *(f"output.{f}" for f in _OUTPUT)]),
    "p3_steps": _flat("agents.output.steps", ["order", "action", "control_ref"]),
    "p3_substeps": _flat("agents.output.steps.substeps", ["n", "do"]),
    "p3_verdicts": _flat("verdict", ["severity", "risk_score", "confidence", "is_anomaly", "summary", "control_ids", "decision.by", "decision.engine.name", "decision.engine.deterministic"]),
    "p3_evidence": _flat("verdict.evidence", ["control_id", "tier"]),
    "p3_evidence_nist": _flat("verdict.evidence.nist", ["id", "via"]),
    "p3_dal": _flat("dal", ["redacted_count", "by_kind"]),
    "p3_tokens": _flat("dal.tokens", ["kind", "n"]),
}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per value of the packed framework cells."""
    return packed.packed_items(table(spark, folder, "scf_sample", spread=True))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_entries": p2_entries, "p3_found": p3_found, "p3_triples": p3_triples, **FLAT_TABLES, "p5_found": p5_found}

_P1_SQL = r"""
WITH f AS (
  SELECT lower(regexp_replace(finding_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS k, min(created_at) AS first_at
  FROM mvp_findings GROUP BY 1),
a AS (
  SELECT DISTINCT CAST(id AS VARCHAR) AS ref_key, ts, event,
         nullif(lower(regexp_replace(finding_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') AS k
  FROM mvp_audit),
d AS (SELECT DISTINCT k FROM a WHERE event = 'finding_deleted'),
audit AS (
  SELECT 'mvp_audit' AS table_name, 'finding_id' AS field_name, ref_key,
         CASE WHEN f.k IS NOT NULL THEN CASE WHEN f.first_at > a.ts THEN 'late' END
              WHEN d.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state,
         coalesce(strftime(a.ts AT TIME ZONE 'UTC', '%Y-%m'), '') AS ref_month
  FROM a LEFT JOIN f ON a.k = f.k LEFT JOIN d ON a.k = d.k WHERE a.k IS NOT NULL),
b AS (
  SELECT DISTINCT manifest.bundle_id AS bundle_id, manifest.tenant_id AS tenant, graph.edges AS edges, graph.nodes AS nodes,
         CAST(manifest.created_at || CASE WHEN regexp_matches(manifest.created_at, '(Z|[+-]\d\d:\d\d)$') THEN '' ELSE 'Z' END AS TIMESTAMPTZ) AS made_at
  FROM sample_bundle),
n AS (
  SELECT DISTINCT bundle_id, tenant, made_at, lower(trim(u.node.id, E' \t\r\n')) AS k
  FROM b, unnest(b.nodes) AS u(node)),
e AS (
  SELECT bundle_id, tenant, made_at, i - 1 AS pos, edges[i] AS edge
  FROM (SELECT bundle_id, tenant, made_at, edges, unnest(range(1, len(edges) + 1)) AS i FROM b)),
r AS (
  SELECT bundle_id, tenant, made_at, pos, 'graph.edges.src' AS field_name, nullif(lower(trim(edge.src, E' \t\r\n')), '') AS k FROM e
  UNION ALL
  SELECT bundle_id, tenant, made_at, pos, 'graph.edges.dst', nullif(lower(trim(edge.dst, E' \t\r\n')), '') FROM e),
t AS (SELECT tenant, k, min(made_at) AS first_at, max(made_at) AS last_at FROM n GROUP BY tenant, k),
bundle AS (
  SELECT DISTINCT 'sample_bundle' AS table_name, field_name, r.bundle_id || ':' || CAST(pos AS VARCHAR) AS ref_key,
         CASE WHEN t.first_at < r.made_at THEN 'deleted' WHEN t.last_at > r.made_at THEN 'late' ELSE 'missing' END AS ref_state,
         strftime(r.made_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
  FROM r LEFT JOIN n ON r.bundle_id = n.bundle_id AND r.made_at = n.made_at AND r.k = n.k
         LEFT JOIN t ON r.tenant = t.tenant AND r.k = t.k
  WHERE r.k IS NOT NULL AND n.k IS NULL),
cases AS (
  SELECT DISTINCT * FROM audit WHERE ref_state IS NOT NULL UNION ALL SELECT * FROM bundle)
"""
ORACLES = {
    "p1_found": _P1_SQL + "SELECT table_name, field_name, ref_key, ref_state, ref_month FROM cases",
    "p1_counts": _P1_SQL + "SELECT table_name, field_name, ref_month, ref_state, count(*) AS n_orphans FROM cases GROUP BY ALL",
}
