"""Queries of this subpackage."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.llm import packing, pairs, pii, quantiles, repetition, tokens
from siftwarden.sources.tables import table


def _pii_sources(spark: SparkSession, folder: str) -> list[tuple]:
    return [(table(spark, folder, "analyze_request", spread=True), "analyze_request", "request_id", "raw_log"), (table(spark, folder, "agent_results", spread=True), "agent_results", "result_id", "prompt")]


def _listed(spark: SparkSession, folder: str) -> dict:
    """The reference list: to every task while it is short, joined beyond that."""
    roster = table(spark, folder, "staff_roster")
    names = pii.roster_names(roster)
    return {"roster": names} if names is not None else {"families": roster}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information by table, row, type and value, once each."""
    listed = _listed(spark, folder)
    a, b = (pii.find_pii(*s, **listed) for s in _pii_sources(spark, folder))
    return a.unionByName(b).distinct()


_KEYS: dict[str, bytes] = {}


def _pseudonym_key(spark: SparkSession) -> bytes:
    """The session's ``siftwarden.pseudonym.key``; without one, a random key of the application."""
    given = spark.conf.get("siftwarden.pseudonym.key", "")
    return given.encode() if given else _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed, linked placeholders."""
    key, names = _pseudonym_key(spark), pii.roster_names(table(spark, folder, "staff_roster"))
    if names is None:
        raise ValueError(f"redaction takes reference lists of at most {pii.MOST_NAMES} names")
    a, b = (pii.redact(*s, pseudonym_key=key, roster=names) for s in _pii_sources(spark, folder))
    return a.unionByName(b)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective prompt and answer pairs."""
    return pairs.broken_pairs(table(spark, folder, "agent_results", spread=True))


def _latencies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "agent_results").where("latency_ms >= 0").select("result_id", "agent", F.to_date("created_at").alias("day"), "latency_ms")
    return quantiles.once_per_id(rows, "result_id", ["agent", "day", "latency_ms"])


def p7_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Latency percentiles per agent and day."""
    return quantiles.percentiles(quantiles.digests(_latencies(spark, folder), ["agent", "day"], "latency_ms"), ["agent", "day"])


def p7_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Latency percentiles per agent, merged from the days' digests."""
    days = quantiles.digests(_latencies(spark, folder), ["agent", "day"], "latency_ms")
    return quantiles.percentiles(quantiles.merge_digests(days, ["agent"]), ["agent"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.encode_documents(table(spark, folder, "documents", spread=True))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of each document or piece."""
    return packing.pack_documents(table(spark, folder, "documents", spread=True))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p9_containers(spark, folder))


#: The share that defines a case of p10_found. Only there it bounds the adaptive thresholds, so
#: that no case is filtered out before the exact check.
_CASE_SHARE = 0.25


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which at least a quarter is repeated: the flagged ones, checked exactly."""
    flagged = repetition.flagged(table(spark, folder, "documents", spread=True), ceiling=_CASE_SHARE)
    return flagged.where("4 * n_repeated >= n_words").select("doc_id").distinct()


def p10_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents over the adaptive threshold of their language and source."""
    return repetition.flagged(table(spark, folder, "documents", spread=True))


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated content of each document."""
    return repetition.shares(table(spark, folder, "documents", spread=True)).select("doc_id", "n_words", "n_repeated", "share")


QUERIES = {
    "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p7_percentiles": p7_percentiles, "p7_merged": p7_merged,
    "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_flagged": p10_flagged, "p10_shares": p10_shares,
}
_REPEATS = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lower(trim(lang)), '') AS lang, coalesce(trim(source), '') AS source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, string_agg(word, ' ') OVER n AS run, count(*) OVER n AS k FROM p WINDOW n AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
d AS (SELECT r, i, row_number() OVER (PARTITION BY r, run ORDER BY i) AS seen FROM g WHERE k = 10),
c AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, i + unnest(range(0, 10)) AS place FROM d WHERE seen > 1) GROUP BY r),
s AS (SELECT doc_id, lang, source, len(ws) AS n_words, coalesce(n, 0) AS n_repeated, CASE WHEN len(ws) > 0 THEN coalesce(n, 0) / len(ws) ELSE 0.0::DOUBLE END AS share FROM w LEFT JOIN c USING (r))
"""
_LATENCIES = """
WITH r AS (SELECT result_id, agent, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, latency_ms FROM agent_results WHERE latency_ms >= 0),
o AS (SELECT unnest(x) FROM (SELECT min({'agent': agent, 'day': day, 'latency_ms': latency_ms}) AS x FROM r WHERE result_id IS NOT NULL GROUP BY result_id)
  UNION ALL SELECT DISTINCT agent, day, latency_ms FROM r WHERE result_id IS NULL),
"""


def _ranked_sql(keys: str) -> str:
    """Nearest ranks of sorted lists; digests of fewer values than their compression are exact."""
    ranks = ", ".join(f"v[CAST(least(len(v) - 1, round_even({p} * (len(v) - 1), 0)) AS BIGINT) + 1] AS {quantiles.share_name(p)}" for p in quantiles.PERCENTILES)
    return _LATENCIES + f"g AS (SELECT {keys}, list_sort(list(latency_ms)) AS v FROM o GROUP BY ALL) SELECT {keys}, len(v) AS n_values, {ranks}, CASE WHEN len(v) < {quantiles.COMPRESSION} THEN 0::BIGINT END AS rank_error FROM g"


_FLAGGED = f"""
, gq AS (SELECT lang, source, list_sort(list(share)) AS v FROM s GROUP BY ALL),
lq AS (SELECT lang, list_sort(list(share)) AS v FROM s GROUP BY ALL),
eq AS (SELECT list_sort(list(share)) AS v FROM s),
t AS (SELECT gq.lang, gq.source, greatest({repetition.FLOOR}, CASE WHEN len(gq.v) >= {repetition.LEAST} THEN %(gq)s WHEN len(lq.v) >= {repetition.LEAST} THEN %(lq)s ELSE %(eq)s END) AS threshold FROM gq JOIN lq USING (lang), eq)
SELECT doc_id, lang, source, n_words, n_repeated, share, threshold::DOUBLE AS threshold FROM s JOIN t USING (lang, source) WHERE share >= threshold AND n_repeated > 0
""" % {t: f"{t}.v[CAST(round_even({repetition.QUANTILE} * (len({t}.v) - 1), 0) AS BIGINT) + 1]" for t in ("gq", "lq", "eq")}
ORACLES = {
    "p7_percentiles": _ranked_sql("agent, day"),
    "p7_merged": _ranked_sql("agent"),
    "p10_flagged": _REPEATS + _FLAGGED,
    "p10_shares": _REPEATS + "SELECT doc_id, n_words, n_repeated, share FROM s",
    "p10_found": _REPEATS + "SELECT DISTINCT doc_id FROM s WHERE n_words > 0 AND 4 * n_repeated >= n_words",
}
