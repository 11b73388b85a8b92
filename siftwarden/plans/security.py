"""Queries of the detection and compliance pipeline, and the same in SQL.

The SQL is rendered from the rule packs (data), with its own way of evaluating them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden import agents
from siftwarden.functions.text import exploded
from siftwarden.operators import catalog, graphs, mapping, metrics, normalise, policy, redaction, scoring, vectors, verdicts
from siftwarden.packs import frameworks, rules
from siftwarden.plans.rawlogs import RAW_LOGS_SQL, SNAPSHOT_SQL, raw_logs, snapshots
from siftwarden.sources.tables import checkpointed, table


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.normalise(raw_logs(spark, folder), "hint")


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.resolve(_findings(spark, folder))


def lane_counts(spark, folder):
    lanes = raw_logs(spark, folder).select(normalise.lane(F.lower("raw")).alias("lane"))
    return lanes.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


def lane_drain_order(spark, folder):
    rows = raw_logs(spark, folder).select("event_seq", normalise.lane(F.lower("raw")).alias("lane"))
    return metrics.drain_order(rows).select("event_seq", "lane", "drain_pos")


def request_lane_counts(spark, folder):
    rows = table(spark, folder, "analyze_request", spread=True).where("raw_log is not null").select(normalise.lane(F.lower("raw_log")).alias("lane"), normalise.log_type(F.lower("raw_log")).alias("log_type"))
    return rows.groupBy("lane", "log_type").agg(F.count(F.lit(1)).alias("n"))


def request_controls(spark, folder):
    rows = table(spark, folder, "analyze_request", spread=True).where("raw_log is not null").select(exploded(normalise.keyword_controls(F.lower("raw_log"))).alias("control_id")).where("control_id is not null")
    return rows.groupBy("control_id").agg(F.count(F.lit(1)).alias("n"))


def log_type_counts(spark, folder):
    return _findings(spark, folder).groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


def entity_extract(spark, folder):
    return normalise.entity_rows(_findings(spark, folder), "event_seq")


def signal_matrix(spark, folder):
    f = _findings(spark, folder)
    return f.groupBy(*(F.col(f"signals.{s}").alias(s) for s in rules.SIGNALS)).agg(F.count(F.lit(1)).alias("n"))


def control_hits(spark, folder):
    return _findings(spark, folder).select("event_seq", exploded(F.col("rule_controls")).alias("control_id")).where("control_id is not null")


def ioc_join(spark, folder):
    feed = spark.createDataFrame([(k, v) for k, vs in rules.INDICATORS.items() for v in vs], "kind string, value string")
    return normalise.enrich(_findings(spark, folder), feed, "event_seq")


def known_cve_hits(spark, folder):
    known = F.array(*map(F.lit, mapping.known_vulnerabilities()))
    hits = _findings(spark, folder).select(exploded(F.array_intersect(F.col("entities.cve_ids"), known)).alias("cve")).where("cve is not null")
    return hits.groupBy("cve").agg(F.count(F.lit(1)).alias("n"))


def detection_alerts(spark, folder):
    return normalise.alerts(_findings(spark, folder), "event_seq")


def detection_alert_counts(spark, folder):
    return detection_alerts(spark, folder).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def first_rule(spark, folder):
    return _findings(spark, folder).select("event_seq", F.coalesce(normalise.first_rule(), F.lit("")).alias("rule"))


def severity_distribution(spark, folder):
    s = _findings(spark, folder).select(normalise.severity_score().alias("s"), normalise.is_anomaly().alias("is_anomaly"))
    return s.groupBy("s.severity", "s.risk_score", "is_anomaly").agg(F.count(F.lit(1)).alias("n"))


def top_factors(spark, folder):
    return _findings(spark, folder).select("event_seq", F.array_join(normalise.top_factors(), ",").alias("factors"))


def crosswalk_nist(spark, folder):
    hits = control_hits(spark, folder).join(mapping.control_nist(spark), "control_id")
    return hits.groupBy("nist_id").agg(F.count_distinct("event_seq").alias("n_events"))


def crosswalk_hipaa(spark, folder):
    hits = control_hits(spark, folder).join(mapping.control_hipaa(spark), "control_id")
    return hits.groupBy("section").agg(F.count_distinct("event_seq").alias("n_events"))


def mapping_resolve(spark, folder):
    m = F.col("mapping")
    return _resolved(spark, folder).select(
        "event_seq", F.array_join(m["control_ids"], ",").alias("controls"), F.array_join(m["nist_subcategories"], ",").alias("nist"), F.array_join(m["hipaa_sections"], ",").alias("hipaa"),
        F.coalesce(m["primary_tier"], F.lit("")).alias("primary_tier"), F.array_join(m["tiers_used"], ",").alias("tiers"), m["confidence"].alias("confidence"), m["needs_llm"].alias("needs_llm"), m["benign"].alias("benign"),
    )


def decision_tier(spark, folder):
    d = _resolved(spark, folder).select(mapping.decision().alias("d"))
    return d.groupBy("d.decided_by", "d.decision_detail").agg(F.count(F.lit(1)).alias("n"))


def verdict_shape(spark, folder):
    return _findings(spark, folder).groupBy(mapping.verdict_shape().alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def verdict_cache(spark, folder):
    rows = _findings(spark, folder).select("event_seq", "ts", mapping.verdict_shape().alias("shape"))
    return verdicts.cached(rows)


def suggestion_merge(spark, folder):
    proposed = F.when(F.col("event_seq") % 3 != 0, F.array(F.lit("Control 13"), F.lit("Control 99")))
    rows = mapping.with_suggestion(_resolved(spark, folder), proposed).where("needs_review")
    m = F.col("mapping")
    return rows.select("event_seq", F.array_join(m["control_ids"], ",").alias("controls"), F.array_join(m["hipaa_sections"], ",").alias("hipaa"), m["confidence"].alias("confidence"), F.coalesce(m["primary_tier"], F.lit("")).alias("primary_tier"))


def scan_match(spark, folder):
    parts = table(spark, folder, "supplier").select("s_suppkey", F.explode(F.array(F.when(F.col("s_suppkey") % 2 == 0, "openssh 7.9p1").otherwise("nginx 1.18"), F.when(F.col("s_suppkey") % 3 == 0, "Microsoft Exchange smtpd").otherwise("ms-wbt-server"))).alias("service"))
    known = spark.createDataFrame(rules.VULNERABILITIES, "signature string, cve string, severity string, summary string")
    return normalise.scan(parts, known, "s_suppkey").select("s_suppkey", "service", "cve", "severity")


def config_checks(spark, folder):
    return policy.evaluate(snapshots(spark, folder)).select("snapshot_id", "check_id", "control_id", "status", "severity", F.array_join("evidence", ",").alias("evidence"))


def config_posture(spark, folder):
    return policy.posture(policy.evaluate(snapshots(spark, folder)))


def config_score(spark, folder):
    return policy.score(policy.evaluate(snapshots(spark, folder)))


def _judged(spark, folder):
    gold = table(spark, folder, "gold_set", spread=True).select("id", F.col("raw"), F.coalesce("controls", F.array().cast("array<string>")).alias("truth"))
    m = F.col("mapping")
    return mapping.resolve(normalise.normalise(gold, use_intel=False)).select("id", "truth", m["control_ids"].alias("pred"), m["provenance"].alias("provenance"), m["needs_llm"].alias("needs_llm"))


def eval_micro(spark, folder):
    out = scoring.micro(scoring.set_counts(_judged(spark, folder)))
    return out.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def eval_per_control(spark, folder):
    return scoring.per_id(_judged(spark, folder))


def eval_per_tier(spark, folder):
    return scoring.per_tier(_judged(spark, folder))


def eval_benign(spark, folder):
    judged = _judged(spark, folder)
    return scoring.benign_rate(scoring.set_counts(judged)).join(judged.agg(F.count_if("needs_llm").alias("escalated")))


def eval_worst(spark, folder):
    counted = scoring.set_counts(_judged(spark, folder))
    return counted.orderBy(F.desc("n_fp"), "id").limit(6).where("n_fp > 0").select("id", "n_fp", "n_fn")


def feed_sample(spark, folder):
    """Events of a replay: all that are not benign and the first 80 benign ones."""
    return scoring.sampled_feed(raw_logs(spark, folder).select("event_seq", "label"), 80)


def grounded_mapping(spark, folder):
    """Mapping where every fifth event has retrieved controls, every third weak retrieval."""
    found = _findings(spark, folder)
    n = F.col("event_seq")
    g = mapping.grounding(n % 3 != 1, F.when(n % 5 == 0, F.array(F.lit("Control 13"))), F.col("candidate_controls"))
    rows = mapping.resolve(found.withColumn("g", g), F.when(n % 3 != 1, F.col("g.controls")).otherwise(F.array().cast("array<string>")))
    m = F.col("mapping")
    return rows.groupBy("g.reason", m["primary_tier"].alias("primary_tier"), m["confidence"].alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def eval_macro(spark, folder):
    return scoring.macro(scoring.set_counts(_judged(spark, folder)))


def routing_summary(spark, folder):
    return scoring.routing(_resolved(spark, folder).select(mapping.decision()["decided_by"].alias("decided_by")))


def call_stats(spark, folder):
    return metrics.level_stats(table(spark, folder, "agent_results").dropDuplicates(["result_id"]), "agent")


def queue_depth(spark, folder):
    """Pending events of each lane over the whole queue."""
    rows = raw_logs(spark, folder).select(normalise.lane(F.lower("raw")).alias("lane"))
    return rows.groupBy("lane").agg(F.count(F.lit(1)).alias("pending"))


def narrative_gate(spark, folder):
    """Findings for which a report would be written from severity high on."""
    s = normalise.severity_score()["severity"]
    rows = _findings(spark, folder).select(s.alias("severity"), normalise.at_least(s, "high").alias("report"))
    return rows.groupBy("severity", "report").agg(F.count(F.lit(1)).alias("n"))


def json_repair(spark, folder):
    """Model answers read as JSON, as they are or repaired."""
    rows = table(spark, folder, "agent_results", spread=True).where("prompt is not null and raw is not null").select("result_id", "raw")
    return agents.repaired(rows, "result_id", "raw")


def agent_outputs(spark, folder):
    """Deterministic and offline agents over the findings that reach them."""
    found = _resolved(spark, folder)
    runs = [agents.run_agent(found, a, "event_seq") for a in ("risk_scorer", "anomaly_detector", "compliance_mapper")]
    out = runs[0].unionByName(runs[1]).unionByName(runs[2])
    return out.groupBy("agent", "source", "ok").agg(F.count(F.lit(1)).alias("n"))


def numbered_prompts(spark, folder):
    return agents.numbered_batches(raw_logs(spark, folder), "event_seq", "raw")


def graph_hashes(spark, folder):
    return graphs.checked_hash(table(spark, folder, "sample_bundle").where("manifest is not null and graph is not null"))


def bundle_sample(spark, folder):
    return graphs.sample(table(spark, folder, "sample_bundle"))


def frameworks_present(spark, folder):
    return catalog.frameworks_present(catalog.crosswalk(table(spark, folder, "scf_sample")))


def timeline_recent(spark, folder):
    return metrics.last_n(_findings(spark, folder).select("event_seq", "log_type"), 10_000, ["event_seq"])


def _replayed(spark, folder):
    f = _findings(spark, folder)
    s = normalise.severity_score()
    rows = f.select("event_seq", "label", scoring.correlation_ids(F.col("raw")).alias("corr"), (s["severity"].isin("critical", "high") | normalise.is_anomaly()).alias("alerted"))
    return scoring.linked(checkpointed(rows))


def replay_confusion(spark, folder):
    return scoring.outcomes(_replayed(spark, folder))


def replay_outcomes(spark, folder):
    return _replayed(spark, folder).groupBy("label", "alerted", "via_corr").agg(F.count(F.lit(1)).alias("n"))


def event_id_extract(spark, folder):
    n = F.col("event_seq")
    hexa = F.lpad(F.lower(F.hex(n)), 32, "a")
    guid = F.concat_ws("-", *(F.substring(hexa, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    text = (
        F.when(n % 5 == 0, F.concat(F.lit('{"event_id": "Evt-'), guid, F.lit('", "id": 7}')))
        .when(n % 5 == 1, F.concat(F.lit('{"id": 12, "auditID": "'), F.upper(guid), F.lit('"}')))
        .when(n % 5 == 2, F.concat(F.lit('{"output_fields": {"evt.id": "'), hexa, F.lit('"}}')))
        .when(n % 5 == 3, F.concat(F.lit("broken { id "), guid, F.lit(" end")))
        .otherwise("no id here")
    )
    return raw_logs(spark, folder).select("event_seq", F.coalesce(scoring.event_id(text), F.lit("")).alias("event_id"))


def _neighbours(spark, folder):
    v = table(spark, folder, "embeddings", spread=True)
    return vectors.top_k_each(v, v.where("vec_id % 100 = 0"))


def vector_topk(spark, folder):
    """The nearest vectors of every vector whose id is divisible by 100."""
    return _neighbours(spark, folder).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"))


def vector_floor(spark, folder):
    """As ``vector_topk``, by the second score and above the floor of the first."""
    return vectors.reranked(_neighbours(spark, folder), F.lit(100) - F.col("label") * 7 - F.col("vec_id") % 5, floor=0.1, by=("query_id",)).select("query_id", "vec_id", "label")


def graph_type_counts(spark, folder):
    return graphs.type_counts(table(spark, folder, "sample_bundle"))


def graph_one_hop(spark, folder):
    return graphs.hops(table(spark, folder, "sample_bundle"))


def scf_crosswalk(spark, folder):
    return catalog.crosswalk(table(spark, folder, "scf_sample"))


def scf_expand(spark, folder):
    controls = spark.createDataFrame([(c,) for c in frameworks.CONTROLS], "control_id string")
    return catalog.expanded(catalog.crosswalk(table(spark, folder, "scf_sample")), controls).groupBy("control_id", "framework").agg(F.count(F.lit(1)).alias("n_ids"))


def scf_strm(spark, folder):
    return catalog.relations(table(spark, folder, "scf_sample"))


def latency_percentiles(spark, folder):
    return metrics.latency_summary(table(spark, folder, "events"), "value", ["event_type"], ["event_id"])


def saturation_point(spark, folder):
    hours = table(spark, folder, "events").groupBy(F.hour("ts").alias("level")).agg(F.count(F.lit(1)).cast("double").alias("rate"))
    return metrics.saturation(hours)


def recent_n(spark, folder):
    return metrics.last_n(table(spark, folder, "events"), 200, ["event_id"]).select("event_id", "event_type", "user_id")


def ring_buffer(spark, folder):
    return metrics.last_n(table(spark, folder, "events"), 500, ["event_id"], "event_type").select("event_id", "event_type")


def alert_counters(spark, folder):
    return metrics.exposition(metrics.counters(detection_alerts(spark, folder), "detections_total", "rule"))


def redaction_counts(spark, folder):
    found = redaction.redact(table(spark, folder, "documents", spread=True), "doc_id", "text")
    return found.select("doc_id", F.explode("tokens").alias("t")).groupBy("t.kind").agg(F.count(F.lit(1)).alias("n"))


def redaction_round_trip(spark, folder):
    """Texts redacted by all rules and put back: as they were."""
    found = redaction.redact(table(spark, folder, "analyze_request"), "request_id", "raw_log", health_mode=True)
    return found.select("request_id", redaction.rehydrate(F.col("redacted"), F.col("tokens")).alias("restored"))


_NAMES = """lane_counts lane_drain_order request_lane_counts request_controls log_type_counts entity_extract signal_matrix control_hits ioc_join known_cve_hits
 detection_alerts detection_alert_counts first_rule severity_distribution top_factors crosswalk_nist crosswalk_hipaa mapping_resolve decision_tier verdict_shape
 verdict_cache suggestion_merge scan_match config_checks config_posture config_score eval_micro eval_per_control eval_per_tier eval_benign eval_worst replay_confusion
 replay_outcomes event_id_extract vector_topk vector_floor graph_type_counts graph_one_hop scf_crosswalk scf_expand scf_strm latency_percentiles saturation_point
 recent_n ring_buffer feed_sample grounded_mapping eval_macro routing_summary call_stats queue_depth narrative_gate json_repair agent_outputs numbered_prompts graph_hashes bundle_sample frameworks_present timeline_recent alert_counters redaction_counts redaction_round_trip""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# -- SQL ------------------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _lane_sql(raw: str) -> str:
    return _case([(f"regexp_matches({raw}, {_q(p)}, 'i')", _q(n)) for n, p in rules.LANES.items()], "'COLD'")


def _type_sql(low: str) -> str:
    return _case([(" OR ".join(f"contains({low}, {_q(p)})" for p in parts), _q(n)) for n, parts in rules.LOG_TYPES], "'generic'")


def _controls_sql(low: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, {_q(p)}) THEN {_q(c)} END" for c, p in rules.CONTROL_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"


def _entity_sql(name: str, raw: str) -> str:
    pattern, exact, group, case, most = rules.ENTITIES[name]
    found = f"regexp_extract_all({raw}, {_q(pattern)}, {group}{'' if exact else ', ' + _q('i')})"
    if case:
        found = f"list_transform({found}, lambda x: {case}(x))"
    found = f"list_sort(list_distinct({found}))"
    return f"{found}[1:{most}]" if most else found


_HITS = " + ".join(f"len(list_filter({e}, lambda v: list_contains({_list([x.lower() for x in rules.INDICATORS[k]])}, lower(v))))" for k, e in rules.INDICATOR_ENTITY.items())
_SIGNAL_COLUMNS = ", ".join(f"regexp_matches(low, {_q(p)}) AS s_{s}" for s, p in rules.SIGNALS.items() if s != "c2_or_exfil")


def _finding_sql(source: str, intel: bool = True) -> str:
    hits = _HITS if intel else "0"
    entities = ", ".join(f"{_entity_sql(e, 'raw')} AS {e}" for e in rules.ENTITIES)
    return f"""src AS ({source}), low AS (SELECT *, lower(raw) AS low, {entities} FROM src),
 f0 AS (SELECT *, {hits} AS n_ioc, {_controls_sql("low")} AS rule_controls, {_SIGNAL_COLUMNS}, regexp_matches(low, {_q(rules.SIGNALS["c2_or_exfil"])}) AS c2 FROM low),
 f AS (SELECT *, c2 OR n_ioc > 0 AS s_c2_or_exfil, CASE WHEN len(rule_controls) > 0 THEN rule_controls ELSE ['{rules.FALLBACK_CONTROL}'] END AS candidates FROM f0)"""


_TYPED = RAW_LOGS_SQL.replace("AS label FROM events", "AS label FROM events")
_F = "WITH " + _finding_sql(_TYPED) + ", "
_FT = f"t AS (SELECT *, CASE WHEN hint <> 'auto' THEN hint ELSE {_type_sql('low')} END AS log_type FROM f)"


def _detect(name: str, some: list[str], every: list[str], ioc: bool) -> str:
    parts = [f"s_{s}" for s in every]
    if some or ioc:
        parts.append("(" + " OR ".join([f"s_{s}" for s in some] + (["n_ioc > 0"] if ioc else [])) + ")")
    return " AND ".join(parts)


_RULES = [(n, sev, _detect(n, some, every, ioc)) for n, sev, some, every, ioc in rules.DETECTIONS]
_ALERTS = "a AS (" + " UNION ALL ".join(f"SELECT event_seq, '{n}' AS rule, '{sev}' AS severity FROM f WHERE {p}" for n, sev, p in _RULES) + ")"
_FIRST = _case([(p, _q(n)) for n, _, p in _RULES], "''")


def _any(names: list[str]) -> str:
    return "(" + " OR ".join(f"s_{n}" for n in names) + ")"


_SCORES = [
    (_any(["malware", "c2_or_exfil"]), "critical", 90), (f"s_foreign_geo AND {_any(['successful_logins', 'failed_logins'])}", "high", 74), (_any(["account_creation", "lateral_movement"]), "high", 72),
    ("s_successful_logins", "informational", 8), ("s_privilege_escalation", "high", 68), ("s_failed_logins", "medium", 50), (_any(list(rules.SIGNALS)), "medium", 45),
]
# Quiet logins come after the first three cases; only foreign_geo is left to exclude there.
_SCORES[3] = ("s_successful_logins AND NOT s_foreign_geo", "informational", 8)
_SEVERITY, _SCORE = _case([(c, _q(v)) for c, v, _ in _SCORES], "'low'"), _case([(c, str(n)) for c, _, n in _SCORES], "20")
_NIST_DIM = "cn(control_id, nist_id, ord) AS (VALUES " + ", ".join(f"('{c}', '{n}', {i})" for c, ns in frameworks.CONTROL_NIST.items() for i, n in enumerate(ns)) + ")"
_HIPAA_DIM = "hn(section, nist_id) AS (VALUES " + ", ".join(f"('{s}', '{n}')" for s, ns in frameworks.HIPAA_NIST.items() for n in ns) + ")"
_PAIRS = "ch AS (SELECT DISTINCT control_id, section FROM cn JOIN hn USING (nist_id))"
_RISKY = f"({_any(rules.RISK_SIGNALS)} OR n_ioc > 0)"
_SHAPE = (
    """substr(sha256('{"controls": [' || array_to_string(list_transform(list_sort(candidates), lambda c: '"' || c || '"'), ', ') || '], "log_type": "' || log_type || '", "signals": {' || """
    + " || ', ' || ".join(f"""'"{s}": ' || CAST(s_{s} AS VARCHAR)""" for s in sorted(rules.SIGNALS))
    + """ || '}}'), 1, 16)"""
)
_UNNEST = "h AS (SELECT event_seq, unnest(rule_controls) AS control_id FROM f)"
_MAPPED = f"""{_UNNEST}, {_NIST_DIM}, {_HIPAA_DIM}, {_PAIRS},
 o AS (SELECT event_seq, unnest(rule_controls) AS control_id, generate_subscripts(rule_controls, 1) AS pos FROM f),
 nn AS (SELECT event_seq, nist_id, min(pos * 100 + ord) AS k FROM o JOIN cn USING (control_id) GROUP BY ALL),
 nl AS (SELECT event_seq, string_agg(nist_id, ',' ORDER BY k) AS nist FROM nn GROUP BY 1),
 hl AS (SELECT event_seq, string_agg(section, ',' ORDER BY section) AS hipaa FROM (SELECT DISTINCT event_seq, section FROM o JOIN ch USING (control_id)) GROUP BY 1)"""
_KNOWN = _list(mapping.known_vulnerabilities())
_CVE = f"list_filter(cve_ids, lambda c: list_contains({_KNOWN}, c))"
_GOLD = _finding_sql("SELECT id, raw, coalesce(controls, []) AS truth FROM gold_set", intel=False)
_JUDGE = "WITH " + _GOLD + ", j AS (SELECT id, list_distinct(truth) AS truth, rule_controls AS pred FROM f), c AS (SELECT *, len(list_intersect(pred, truth)) AS tp, len(pred) - len(list_intersect(pred, truth)) AS fp, len(truth) - len(list_intersect(pred, truth)) AS fn FROM j)"
_ANOMALY = _any(rules.ANOMALY_SIGNALS)
_REPLAY = f"""e AS (SELECT event_seq, label, {_SEVERITY} IN ('critical', 'high') OR {_ANOMALY} AS alerted,
  list_distinct(list_transform(regexp_extract_all(raw, {_q(rules.CORRELATION)}, 1), lambda x: lower(x))) AS corr FROM f),
 hot AS (SELECT DISTINCT unnest(corr) AS id FROM e WHERE alerted),
 x AS (SELECT event_seq, unnest(corr) AS id FROM e WHERE NOT alerted),
 l AS (SELECT e.*, NOT alerted AND event_seq IN (SELECT event_seq FROM x JOIN hot USING (id)) AS via_corr FROM e)"""


def _flag_sql(path: str) -> str:
    return f"CASE WHEN json_exists(snapshot, '{path}') THEN coalesce(CAST(json_extract_string(snapshot, '{path}') AS BOOLEAN), false) END"


def _word_sql(path: str) -> str:
    return f"CASE WHEN json_exists(snapshot, '{path}') THEN coalesce(json_extract_string(snapshot, '{path}'), 'null') END"


_LISTS = "FROM (SELECT unnest(CAST(json_extract(snapshot, '$.{0}') AS JSON[])) AS x)"


def _bad_names(section: str, bad: str) -> str:
    return f"(SELECT string_agg(coalesce(json_extract_string(x, '$.name'), '?'), ',') FROM (SELECT unnest(CAST(json_extract(snapshot, '$.{section}') AS JSON[])) AS x) WHERE {bad})"


_CHECKS = [
    ("CFG-ROOT-MFA", "Control 6", "critical", _flag_sql("$.aws_account.root_mfa_enabled"), _word_sql("$.aws_account.root_mfa_enabled")),
    ("CFG-IAM-MFA", "Control 6", "high", None, ("iam_users", "coalesce(json_extract_string(x, '$.mfa_enabled'), 'false') = 'false'")),
    ("CFG-PW-LEN", "Control 5", "medium", "CAST(json_extract_string(snapshot, '$.aws_account.password_policy.min_length') AS INT) >= 14", "json_extract_string(snapshot, '$.aws_account.password_policy.min_length')"),
    ("CFG-S3-PUBLIC", "Control 3", "high", None, ("s3_buckets", "json_extract_string(x, '$.public') = 'true'")),
    ("CFG-S3-ENC", "Control 3", "high", None, ("s3_buckets", "coalesce(json_extract_string(x, '$.encrypted'), 'false') = 'false'")),
    ("CFG-AUDIT-LOG", "Control 8", "high", _flag_sql("$.cloudtrail.enabled"), _word_sql("$.cloudtrail.enabled")),
    ("CFG-NET-SSH", "Control 12", "critical", "CASE WHEN json_extract(snapshot, '$.security_groups') IS NOT NULL THEN NOT (contains(snapshot, '\"0.0.0.0/0\",\"port\":22') OR contains(snapshot, '\"0.0.0.0/0\",\"port\":3389')) END", "CASE WHEN contains(snapshot, '\"0.0.0.0/0\",\"port\":22') THEN 'g:22' ELSE '' END"),
    ("CFG-TLS-MIN", "Control 4", "medium", None, ("tls_endpoints", "CASE WHEN json_exists(x, '$.min_version') THEN coalesce(json_extract_string(x, '$.min_version'), 'None') ELSE '0' END < '1.2'")),
    ("CFG-BACKUP", "Control 11", "high", _flag_sql("$.backups.configured"), _word_sql("$.backups.configured")),
]


def _checks_sql() -> str:
    parts = []
    for check, control, severity, passed, evidence in _CHECKS:
        if passed is None:
            section, bad = evidence
            evidence = _bad_names(section, bad)
            passed = f"CASE WHEN json_extract(snapshot, '$.{section}') IS NOT NULL THEN {evidence} IS NULL END"
        parts.append(f"SELECT snapshot_id, '{check}' AS check_id, '{control}' AS control_id, '{severity}' AS level, {passed} AS ok, {evidence} AS ev FROM s")
    return (
        f"WITH s AS ({SNAPSHOT_SQL}), r AS ({' UNION ALL '.join(parts)}), k AS (SELECT snapshot_id, check_id, control_id, CASE WHEN ok IS NULL THEN 'na' WHEN ok THEN 'pass' ELSE 'fail' END AS status, "
        "CASE WHEN NOT ok THEN level ELSE 'informational' END AS severity, CASE WHEN ok IS NULL THEN '' ELSE coalesce(ev, '') END AS evidence FROM r)"
    )


_TRIM = r"regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_SCF = (
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT trim(scf_id) AS scf_id, '{fw}' AS framework, unnest(regexp_split_to_array(coalesce({c}, ''), '[\\n;,]+')) AS x FROM scf_sample" for fw, c in (("nist_csf", "nist_csf_v2_0"), ("cis", "cis_csc_v8_1"), ("hipaa", "hipaa"), ("iso_27001", "iso_27001_v2022"), ("pci_dss", "pci_dss_v4_0")))
    + f"), w AS (SELECT DISTINCT scf_id, framework, {_TRIM} AS ext_id, CASE WHEN framework = 'cis' THEN nullif(regexp_extract({_TRIM}, '(\\d{{1,2}})', 1), '') ELSE {_TRIM} END AS norm_id FROM c WHERE scf_id <> '' AND {_TRIM} <> '')"
)
_NODES = "nodes AS (SELECT bundle_id, n.id AS id, arg_max(n.type, pos) AS type FROM (SELECT DISTINCT manifest.bundle_id AS bundle_id, unnest(graph.nodes) AS n, generate_subscripts(graph.nodes, 1) AS pos FROM sample_bundle) WHERE n IS NOT NULL GROUP BY ALL)"
_EDGES = "edges AS (SELECT DISTINCT bundle_id, pos, e.src AS src, e.dst AS dst, e.rel AS rel FROM (SELECT manifest.bundle_id AS bundle_id, unnest(graph.edges) AS e, generate_subscripts(graph.edges, 1) AS pos FROM sample_bundle) WHERE e IS NOT NULL)"
_COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"
_TOP = f"q AS (SELECT DISTINCT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL), k AS (SELECT query_id, vec_id, label, {_COSINE} AS similarity FROM embeddings e, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE} DESC, vec_id) <= 35)"
_HEX = "lpad(lower(printf('%x', event_id)), 32, 'a')"


def _nearest(p: float) -> str:
    return f"v[CAST(least(len(v) - 1, round_even({p} * (len(v) - 1), 0)) AS INT) + 1]"


ORACLES = {
    "lane_counts": f"SELECT {_lane_sql('raw')} AS lane, count(*) AS n FROM ({_TYPED}) GROUP BY 1",
    "lane_drain_order": f"SELECT event_seq, lane, row_number() OVER (ORDER BY CASE lane WHEN 'HOT' THEN 1 WHEN 'WARM' THEN 2 ELSE 3 END, event_seq) AS drain_pos FROM (SELECT event_seq, {_lane_sql('raw')} AS lane FROM ({_TYPED}))",
    "request_lane_counts": f"SELECT {_lane_sql('raw_log')} AS lane, {_type_sql('lower(raw_log)')} AS log_type, count(*) AS n FROM analyze_request WHERE raw_log IS NOT NULL GROUP BY ALL",
    "request_controls": f"SELECT control_id, count(*) AS n FROM (SELECT unnest({_controls_sql('lower(raw_log)')}) AS control_id FROM analyze_request WHERE raw_log IS NOT NULL) GROUP BY 1",
    "log_type_counts": _F + _FT + " SELECT log_type, count(*) AS n FROM t GROUP BY 1",
    "entity_extract": _F + "x AS (" + " UNION ALL ".join(f"SELECT event_seq, '{e}' AS kind, unnest({e}) AS value FROM f" for e in rules.ENTITIES) + ") SELECT event_seq, kind, value FROM x",
    "signal_matrix": _F + "x AS (SELECT 1) SELECT " + ", ".join(f"s_{s} AS {s}" for s in rules.SIGNALS) + ", count(*) AS n FROM f GROUP BY ALL",
    "control_hits": _F + _UNNEST + " SELECT event_seq, control_id FROM h",
    "ioc_join": _F + "x AS (" + " UNION ALL ".join(f"SELECT event_seq, '{k}' AS type, unnest(list_filter({e}, lambda v: list_contains({_list([i.lower() for i in rules.INDICATORS[k]])}, lower(v)))) AS value FROM f" for k, e in rules.INDICATOR_ENTITY.items()) + ") SELECT event_seq, type, value FROM x",
    "known_cve_hits": _F + f"x AS (SELECT unnest({_CVE}) AS cve FROM f) SELECT cve, count(*) AS n FROM x GROUP BY 1",
    "detection_alerts": _F + _ALERTS + " SELECT event_seq, rule, severity FROM a",
    "detection_alert_counts": _F + _ALERTS + " SELECT rule, severity, count(*) AS n FROM a GROUP BY ALL",
    "first_rule": _F + f"x AS (SELECT 1) SELECT event_seq, {_FIRST} AS rule FROM f",
    "severity_distribution": _F + f"x AS (SELECT {_SEVERITY} AS severity, {_SCORE} AS risk_score, {_ANOMALY} AS is_anomaly FROM f) SELECT severity, risk_score, is_anomaly, count(*) AS n FROM x GROUP BY ALL",
    "top_factors": _F + "x AS (SELECT event_seq, list_filter([" + ", ".join(f"CASE WHEN s_{s} THEN '{s}' END" for s in rules.SIGNALS) + "], lambda x: x IS NOT NULL)[1:3] AS l FROM f) SELECT event_seq, array_to_string(l, ',') AS factors FROM x",
    "crosswalk_nist": _F + f"{_UNNEST}, {_NIST_DIM} SELECT nist_id, count(DISTINCT event_seq) AS n_events FROM h JOIN cn USING (control_id) GROUP BY 1",
    "crosswalk_hipaa": _F + f"{_UNNEST}, {_NIST_DIM}, {_HIPAA_DIM}, {_PAIRS} SELECT section, count(DISTINCT event_seq) AS n_events FROM h JOIN ch USING (control_id) GROUP BY 1",
    "mapping_resolve": _F + f"{_MAPPED} SELECT f.event_seq, array_to_string(rule_controls, ',') AS controls, coalesce(nist, '') AS nist, coalesce(hipaa, '') AS hipaa, CASE WHEN len(rule_controls) > 0 THEN 'rules' WHEN {_RISKY} THEN '' ELSE 'benign' END AS primary_tier, "
    f"CASE WHEN len(rule_controls) > 0 THEN 'rules,crosswalk' WHEN {_RISKY} THEN '' ELSE 'benign' END AS tiers, CASE WHEN len(rule_controls) > 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence, len(rule_controls) = 0 AND {_RISKY} AS needs_llm, len(rule_controls) = 0 AND NOT {_RISKY} AS benign FROM f LEFT JOIN nl USING (event_seq) LEFT JOIN hl USING (event_seq)",
    "decision_tier": _F + f"x AS (SELECT CASE WHEN len({_CVE}) > 0 THEN 'scan_engine' WHEN {_FIRST} <> '' THEN 'siem_rule' WHEN len(rule_controls) > 0 THEN 'compliance_rule' WHEN {_RISKY} THEN 'llm' ELSE 'deterministic' END AS decided_by, CASE WHEN len({_CVE}) > 0 THEN ({_CVE})[1] ELSE {_FIRST} END AS decision_detail FROM f) SELECT decided_by, decision_detail, count(*) AS n FROM x GROUP BY ALL",
    "verdict_shape": _F + _FT + f" SELECT {_SHAPE} AS shape, count(*) AS n FROM t GROUP BY 1",
    "verdict_cache": "WITH RECURSIVE " + _finding_sql(_TYPED) + ", " + _FT + f""", e AS (SELECT event_seq, ts, {_SHAPE} AS shape FROM t),
 o AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY ts, event_seq) AS k FROM e),
 g AS (SELECT shape, event_seq, ts FROM o WHERE k = 1
  UNION ALL SELECT n.shape, n.event_seq, n.ts FROM (SELECT o.shape, o.event_seq, o.ts, row_number() OVER (PARTITION BY o.shape ORDER BY o.k) AS r FROM g JOIN o ON o.shape = g.shape AND o.ts > g.ts + INTERVAL 1 DAY) n WHERE r = 1),
 l AS (SELECT shape, event_seq AS leader_seq, ts AS lts FROM g)
 SELECT o.event_seq, arg_max(l.leader_seq, l.lts) AS leader_seq, arg_max(l.leader_seq, l.lts) <> o.event_seq AS is_hit FROM o JOIN l ON l.shape = o.shape AND (l.lts < o.ts OR (l.lts = o.ts AND l.leader_seq <= o.event_seq)) GROUP BY o.event_seq""",
    "suggestion_merge": _F + f"{_NIST_DIM}, {_HIPAA_DIM}, {_PAIRS} SELECT event_seq, CASE WHEN event_seq % 3 <> 0 THEN 'Control 13' ELSE '' END AS controls, CASE WHEN event_seq % 3 <> 0 THEN (SELECT string_agg(section, ',' ORDER BY section) FROM ch WHERE control_id = 'Control 13') ELSE '' END AS hipaa, "
    f"CASE WHEN event_seq % 3 <> 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN event_seq % 3 <> 0 THEN 'llm_fallback' ELSE '' END AS primary_tier FROM f WHERE len(rule_controls) = 0 AND {_RISKY}",
    "scan_match": "WITH v(signature, cve, severity) AS (VALUES " + ", ".join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c, _ in rules.VULNERABILITIES) + "), p AS (SELECT s_suppkey, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'openssh 7.9p1' ELSE 'nginx 1.18' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Microsoft Exchange smtpd' ELSE 'ms-wbt-server' END]) AS service FROM supplier) SELECT s_suppkey, service, cve, severity FROM p JOIN v ON contains(lower(service), lower(signature))",
    "config_checks": _checks_sql() + " SELECT snapshot_id, check_id, control_id, status, severity, evidence FROM k",
    "config_posture": _checks_sql() + " SELECT snapshot_id, control_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'na' END AS posture FROM k GROUP BY ALL",
    "config_score": _checks_sql() + " SELECT snapshot_id, count_if(status = 'pass') AS n_pass, count_if(status = 'fail') AS n_fail, count_if(status = 'na') AS n_na, count(*) AS n_total, round_even(count_if(status = 'pass') / nullif(count_if(status <> 'na'), 0), 3) AS score, coalesce(string_agg(DISTINCT CASE WHEN status = 'fail' THEN control_id END, ',' ORDER BY CASE WHEN status = 'fail' THEN control_id END), '') AS failed_controls FROM k GROUP BY 1",
    "eval_micro": _JUDGE + ", s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec FROM s) SELECT tp, fp, fn, round(p, 6) AS precision, round(rec, 6) AS recall, round(coalesce(2 * p * rec / nullif(p + rec, 0), 0.0), 6) AS f1 FROM r",
    "eval_per_control": _JUDGE + ", p AS (SELECT id, unnest(pred) AS k FROM j), t AS (SELECT id, unnest(truth) AS k FROM j), b AS (SELECT coalesce(p.k, t.k) AS control_id, p.k IS NOT NULL AS a, t.k IS NOT NULL AS b FROM p FULL JOIN t ON p.id = t.id AND p.k = t.k) SELECT control_id, count_if(a AND b) AS tp, count_if(a AND NOT b) AS fp, count_if(b AND NOT a) AS fn FROM b GROUP BY 1",
    "eval_per_tier": _JUDGE + " SELECT 'rules' AS tier, sum(tp)::BIGINT AS correct, sum(fp)::BIGINT AS wrong FROM c HAVING sum(tp + fp) > 0",
    "eval_benign": "WITH " + _GOLD + f" SELECT count_if(len(truth) = 0 AND len(rule_controls) > 0) AS benign_fp, count_if(len(truth) = 0) AS benign_total, count_if(len(rule_controls) = 0 AND {_RISKY}) AS escalated FROM f",
    "eval_worst": _JUDGE + ", w AS (SELECT id, fp AS n_fp, fn AS n_fn FROM c ORDER BY fp DESC, id LIMIT 6) SELECT id, n_fp, n_fn FROM w WHERE n_fp > 0",
    "replay_confusion": _F + _REPLAY + ", c AS (SELECT count_if(label = 'malicious') AS malicious, count_if(label = 'malicious' AND (alerted OR via_corr)) AS tp, count_if(label = 'malicious' AND NOT (alerted OR via_corr)) AS fn, count_if(label = 'benign' AND (alerted OR via_corr)) AS fp, count_if(label = 'benign' AND NOT (alerted OR via_corr)) AS tn, count_if(label = 'benign_suspicious' AND (alerted OR via_corr)) AS sus_alert, count_if(label = 'malicious' AND alerted) AS tp_single, count_if(label = 'malicious' AND via_corr) AS via_corr FROM l) SELECT *, round_even(coalesce(tp / nullif(tp + fp, 0), 0.0), 2) AS precision, round_even(coalesce(tp / nullif(malicious, 0), 0.0), 2) AS recall, round_even(coalesce(tp_single / nullif(malicious, 0), 0.0), 2) AS recall_single FROM c",
    "replay_outcomes": _F + _REPLAY + " SELECT label, alerted, via_corr, count(*) AS n FROM l GROUP BY ALL",
    "event_id_extract": f"SELECT event_id AS event_seq, CASE event_id % 5 WHEN 0 THEN 'e' || {_HEX} WHEN 4 THEN '' ELSE {_HEX} END AS event_id FROM events",
    "vector_topk": f"WITH {_TOP} SELECT query_id, vec_id, round(similarity, 5) AS similarity FROM k",
    "vector_floor": f"WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 100 - label * 7 - vec_id % 5 DESC, vec_id) AS p FROM k) SELECT query_id, vec_id, label FROM r WHERE p <= 6 AND similarity >= 0.1",
    "graph_type_counts": f"WITH {_NODES}, {_EDGES} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY ALL",
    "graph_one_hop": f"WITH {_NODES}, {_EDGES} SELECT DISTINCT e.bundle_id, e.src AS start, e.dst AS reached, b.type AS reached_type FROM edges e JOIN nodes a ON a.bundle_id = e.bundle_id AND a.id = e.src AND a.type = 'control' JOIN nodes b ON b.bundle_id = e.bundle_id AND b.id = e.dst",
    "scf_crosswalk": _SCF + " SELECT scf_id, framework, ext_id, norm_id FROM w",
    "scf_expand": _SCF + ", d(control_id) AS (VALUES " + ", ".join(f"('{c}')" for c in frameworks.CONTROLS) + "), p AS (SELECT DISTINCT control_id, scf_id FROM w JOIN d ON framework = 'cis' AND norm_id = regexp_extract(control_id, '(\\d{1,2})', 1)) SELECT control_id, framework, count(DISTINCT ext_id) AS n_ids FROM p JOIN w USING (scf_id) WHERE framework <> 'cis' GROUP BY ALL",
    "scf_strm": "WITH x AS (SELECT trim(scf_id) AS scf_id, scf_row, replace(lower(trim(CASE WHEN coalesce(strm_relationship, '') = '' THEN 'intersects_with' ELSE strm_relationship END)), ' ', '_') AS r, coalesce(CAST(trunc(TRY_CAST(strength_score AS DOUBLE)) AS INT), 5) AS s FROM scf_sample WHERE trim(scf_id) <> '') SELECT scf_id, arg_max(r, scf_row) AS relationship, arg_max(s, scf_row) AS strength FROM x GROUP BY 1",
    "latency_percentiles": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL), g AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE k <= 5000 GROUP BY 1) SELECT event_type, len(v) AS n, "
    + ", ".join(f"round({_nearest(p)}, 1) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + ", round(list_max(v), 1) AS max, round(list_sum(v) / len(v), 1) AS avg FROM g",
    "saturation_point": "WITH h AS (SELECT CAST(hour(ts) AS INT) AS level, count(*)::DOUBLE AS rate FROM events GROUP BY 1), b AS (SELECT *, max(rate) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h) SELECT (SELECT min(level) FROM b WHERE best > 0 AND rate < best * 1.10) AS saturation_level, level AS best_level, rate AS best_rate FROM h ORDER BY rate DESC, level LIMIT 1",
    "feed_sample": f"WITH r AS (SELECT event_seq, label, row_number() OVER (PARTITION BY label ORDER BY event_seq) AS k FROM ({_TYPED})) SELECT event_seq, label FROM r WHERE label <> 'benign' OR k <= 80",
    "grounded_mapping": _F + f"x AS (SELECT CASE WHEN event_seq % 3 = 1 THEN 'static' WHEN event_seq % 5 = 0 THEN 'ok' ELSE 'weak' END AS reason, len(rule_controls) > 0 AS r, event_seq % 3 <> 1 AS e, {_RISKY} AS k FROM f) SELECT reason, CASE WHEN r THEN 'rules' WHEN e THEN 'embedding' WHEN NOT k THEN 'benign' END AS primary_tier, CASE WHEN r AND e THEN 0.95::DOUBLE WHEN r THEN 0.9::DOUBLE WHEN e THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence, count(*) AS n FROM x GROUP BY ALL",
    "eval_macro": _JUDGE + ", p AS (SELECT tp, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c) SELECT round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0.0)), 6) AS macro_f1, count_if(tp > 0) AS covered, count(*) AS n FROM p",
    "routing_summary": _F + f"x AS (SELECT CASE WHEN len({_CVE}) > 0 THEN 'scan_engine' WHEN {_FIRST} <> '' THEN 'siem_rule' WHEN len(rule_controls) > 0 THEN 'compliance_rule' WHEN {_RISKY} THEN 'llm' ELSE 'deterministic' END AS decided_by FROM f) SELECT decided_by, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct, decided_by <> 'llm' AS deterministic FROM x GROUP BY 1",
    "call_stats": "WITH d AS (SELECT DISTINCT result_id, agent, ok, completion_tokens, latency_ms FROM agent_results) SELECT agent, count(*) AS completed, count_if(NOT coalesce(ok, false)) AS errors, round_even(count_if(NOT coalesce(ok, false)) / count(*), 3) AS error_rate, coalesce(sum(completion_tokens), 0)::BIGINT AS tokens, round_even(coalesce(sum(completion_tokens), 0) / count(*), 1) AS avg_tokens, max(CASE WHEN latency_ms >= 0 THEN latency_ms END) AS max_ms FROM d GROUP BY 1",
    "queue_depth": f"SELECT {_lane_sql('raw')} AS lane, count(*) AS pending FROM ({_TYPED}) GROUP BY 1",
    "narrative_gate": _F + f"x AS (SELECT {_SEVERITY} AS severity FROM f) SELECT severity, severity IN ('critical', 'high') AS report, count(*) AS n FROM x GROUP BY ALL",
    "bundle_sample": "WITH n AS (SELECT manifest.bundle_id AS bundle_id, unnest(graph.nodes) AS n, generate_subscripts(graph.nodes, 1) AS pos FROM sample_bundle), f AS (SELECT bundle_id, n.id AS name, min(pos) AS pos FROM n WHERE n.id <> '' GROUP BY ALL), e AS (SELECT DISTINCT manifest.bundle_id AS bundle_id, unnest(graph.edges) AS e, generate_subscripts(graph.edges, 1) AS pos FROM sample_bundle) "
    "SELECT bundle_id, 'node' AS kind, row_number() OVER (PARTITION BY bundle_id ORDER BY pos) - 1 AS pos, name FROM f QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY pos) <= 10 UNION ALL SELECT DISTINCT bundle_id, 'edge', pos - 1, coalesce(e.src, '') || ' -> ' || coalesce(e.dst, '') FROM e WHERE pos <= 10 AND e IS NOT NULL",
    "graph_hashes": "WITH g AS (SELECT manifest.bundle_id AS bundle_id, manifest.graph_sha256 AS said, coalesce(manifest.signature, '') AS signature, sha256(CAST(to_json({'edges': list_transform(graph.edges, lambda e: CASE WHEN e IS NOT NULL THEN {'dst': e.dst, 'rel': e.rel, 'src': e.src} END), "
    "'nodes': list_transform(graph.nodes, lambda n: CASE WHEN n IS NOT NULL THEN {'framework': n.framework, 'id': n.id, 'label': n.label, 'props': map_from_entries(list_sort(map_entries(n.props))), 'type': n.type} END)}) AS VARCHAR)) AS own FROM sample_bundle WHERE manifest IS NOT NULL AND graph IS NOT NULL) "
    "SELECT bundle_id, own AS sha256, coalesce(own = said, false) AS agrees, coalesce(own = said, false) AND signature IN ('', 'STUB', 'STUBBED') AS verified, CASE WHEN coalesce(said, '') = '' THEN 'no graph_sha256 in manifest' WHEN own <> said THEN 'graph hash mismatch' END AS error FROM g",
    "redaction_round_trip": "SELECT request_id, raw_log AS restored FROM analyze_request",
    "frameworks_present": _SCF + " SELECT DISTINCT framework FROM w",
    "timeline_recent": _F + _FT + " SELECT event_seq, log_type FROM t ORDER BY event_seq DESC LIMIT 10000",
    "numbered_prompts": f"SELECT event_seq // 6 AS batch, string_agg('[' || (event_seq % 6 + 1) || '] ' || substr(raw, 1, 1500), chr(10) ORDER BY event_seq) AS prompt FROM ({_TYPED}) GROUP BY 1",
    "agent_outputs": _F + f"x AS (SELECT count(*) AS n, count_if(len(rule_controls) = 0 AND {_RISKY}) AS k FROM f) SELECT 'risk_scorer' AS agent, 'deterministic' AS source, true AS ok, n FROM x UNION ALL SELECT 'anomaly_detector', 'deterministic', true, n FROM x UNION ALL SELECT 'compliance_mapper', 'mock', true, k FROM x",
    "recent_n": "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 200",
    "ring_buffer": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500",
    "alert_counters": _F + _ALERTS + """ SELECT 'detections_total{rule="' || rule || '"} ' || count(*) AS line FROM a GROUP BY rule""",
}
