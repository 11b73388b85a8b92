"""Queries on readers, writers, streams and reports around the pipeline, and the same in SQL.

Round trips write tables of the data folder in the form that a reader takes (lines of text, JSON
lines, catalogs as CSV or JSON, bundles) into the shared folder and read them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden import api
from siftwarden.operators import catalog, graphs, mapping, metrics, normalise, policy, redaction, scoring, vectors
from siftwarden.packs import frameworks, rules
from siftwarden.plans import security as sec
from siftwarden.plans.rawlogs import raw_logs, snapshots
from siftwarden.sources import logs, sinks
from siftwarden.sources.tables import shared_folder, stored, table
from siftwarden.streaming import pipeline


def _place(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


# -- configuration and mapping ----------------------------------------------------------------


def config_evidence(spark, folder):
    """What each check says about each snapshot."""
    return policy.evaluate(snapshots(spark, folder)).select("snapshot_id", "check_id", "status", "evidence_text")


def config_frameworks(spark, folder):
    """Ids of every framework that failed checks touch."""
    failed = policy.evaluate(snapshots(spark, folder)).where("status = 'fail'")
    return failed.select("snapshot_id", "check_id", F.explode("frameworks").alias("framework", "ids")).select("snapshot_id", "check_id", "framework", F.array_join("ids", ",").alias("ids"))


def mapping_rationale(spark, folder):
    return sec._resolved(spark, folder).select(mapping.rationale().alias("rationale")).groupBy("rationale").agg(F.count(F.lit(1)).alias("n"))


def mapping_catalog(spark, folder):
    """Mappings by the loaded catalog instead of the built-in tables. They depend on the set of
    controls alone, so findings are counted by set before the catalog's ids are looked up."""
    walk = catalog.crosswalk(table(spark, folder, "scf_sample"))
    m = F.col("mapping")
    rows = mapping.with_catalog(stored(mapping.by_set(sec._resolved(spark, folder))), walk)
    return rows.select(F.array_join(F.array_sort(m["control_ids"]), ",").alias("controls"), F.size(m["nist_subcategories"]).alias("n_nist"), F.get(m["nist_subcategories"], F.lit(0)).alias("first_nist"), F.size(m["hipaa_sections"]).alias("n_hipaa"), F.array_join(F.array_sort(F.map_keys("frameworks")), ",").alias("frameworks"), "n")


def scf_nist_fallback(spark, folder):
    """CSF ids of each control, else those of 800-53: here only low controls keep a CSF column."""
    rows = table(spark, folder, "scf_sample")
    low = catalog.control_number(F.col("cis_csc_v8_1")).cast("int") < 8
    shaped = rows.withColumns({"nist_csf_v2_0": F.when(low, F.col("nist_csf_v2_0")), "NIST 800-53 rev5": F.col("iso_27001_v2022")})
    controls = spark.createDataFrame([(c,) for c in frameworks.CONTROLS], "control_id string")
    return catalog.nist_of(catalog.crosswalk(shaped), controls).select("control_id", F.array_join("nist", ",").alias("nist"))


def severity_clamps(spark, folder):
    """Words and numbers of any kind as severities and scores."""
    n = F.col("event_id")
    word = F.when(n % 4 == 0, F.lit(" HIGH ")).when(n % 4 == 1, F.col("event_type")).when(n % 4 == 2, F.lit("Critical"))
    score = F.when(n % 3 == 0, F.col("value").cast("string")).when(n % 3 == 1, F.lit("n/a")).otherwise((F.col("value") * -1).cast("string"))
    rows = table(spark, folder, "events").select(normalise.clamped_severity(word).alias("severity"), normalise.clamped_score(score).alias("risk_score"))
    return rows.groupBy("severity", "risk_score").agg(F.count(F.lit(1)).alias("n"))


def analyze_agents(spark, folder):
    """Which agents each log would run."""
    return api.analyze(raw_logs(spark, folder), "hint").groupBy(F.array_join("agents", ",").alias("agents"), "severity").agg(F.count(F.lit(1)).alias("n"))


def analyze_chosen(spark, folder):
    """The same where agents are chosen: only those, in canonical order."""
    return api.analyze(raw_logs(spark, folder), "hint", chosen=["report_generator", "risk_scorer", "unknown"]).groupBy(F.array_join("agents", ",").alias("agents")).agg(F.count(F.lit(1)).alias("n"))


def api_batch(spark, folder):
    """The sample logs as a list in one call."""
    rows = [raw for _, raw in logs.SAMPLES]
    return _verdicts(api.analyze_batch(spark, rows))


def api_single(spark, folder):
    """One log text in, one verdict out."""
    return _verdicts(api.analyze_text(spark, "Failed password for invalid user x from 203.0.113.55"))


def _verdicts(found: DataFrame) -> DataFrame:
    return found.select("event_seq", "severity", "risk_score", "is_anomaly", F.col("decision.decided_by").alias("decided_by"), F.array_join("mapping.control_ids", ",").alias("controls"))


def api_pipeline(spark, folder):
    """What the sample logs leave in the timeline in pipeline mode."""
    rows = api.run_batch(spark, [raw for _, raw in logs.SAMPLES], "pipeline")["timeline"]
    return rows.select("event_seq", "step", "severity", (F.col("finding_id") != "").alias("has_id"))


def vector_controls(spark, folder):
    """Controls (labels here) that the nearest vectors of every hundredth one stand for, once each."""
    score = F.lit(100) - F.col("label") * 7 - F.col("vec_id") % 5
    return vectors.reranked(sec._neighbours(spark, folder), score, floor=0.1, by=("query_id",), once="label").select("query_id", "vec_id", "label")


def scan_lines(spark, folder):
    """Scan findings of the default services as log lines."""
    return api.scan(spark, "10.0.0.7").select("raw")


def redacted_findings(spark, folder):
    """Findings as a model may see them, and whether any value of theirs is still in sight."""
    found = sec._findings(spark, folder)
    r = redaction.redact_findings(found, "event_seq")
    hidden = F.filter(F.col("tokens"), lambda t: t["kind"] == "IPV4")
    leak = F.exists(hidden, lambda t: F.contains(F.col("redacted"), t["original"]))
    return r.select("event_seq", "ioc_hit_count", F.array_join("kinds", ",").alias("kinds"), F.array_join("entities.cve_ids", ",").alias("cves"), F.size("entities.source_ip").alias("n_ips"), leak.alias("leaks"))


def rehydrated_findings(spark, folder):
    """Redacted entities as JSON with the values put back: as they were."""
    found = sec._findings(spark, folder)
    r = redaction.redact_findings(found, "event_seq")
    back = redaction.rehydrate_json(r.withColumn("doc", F.to_json("entities")), "event_seq", "doc")
    return back.select("event_seq", F.from_json("restored", "source_ip array<string>, domains array<string>").alias("e")).select("event_seq", F.array_join("e.source_ip", ",").alias("ips"), F.array_join("e.domains", ",").alias("domains"))


# -- replay -----------------------------------------------------------------------------------


def label_join(spark, folder):
    """Events with their labels by normalised id; benign ones have no label row here."""
    ids = sec.event_id_extract(spark, folder)
    known = raw_logs(spark, folder).where("label <> 'benign'").select(F.col("event_seq").alias("_s"), "label")
    labels = ids.join(known, F.col("event_seq") == F.col("_s")).where("event_id <> ''").select("event_id", "label")
    return scoring.labelled(ids, labels).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def verdict_zip(spark, folder):
    """Inputs beside their verdicts."""
    s = normalise.severity_score()
    verdicts = sec._findings(spark, folder).select("event_seq", s["severity"].alias("severity"), normalise.is_anomaly().alias("is_anomaly"))
    pairs = scoring.zipped(raw_logs(spark, folder).select("event_seq", "source", "label"), verdicts)
    return pairs.groupBy("source", "label", "severity", "is_anomaly").agg(F.count(F.lit(1)).alias("n"))


def replay_hot_groups(spark, folder):
    """Campaign ids on alerted events."""
    f = sec._findings(spark, folder)
    s = normalise.severity_score()
    rows = f.select(scoring.correlation_ids(F.col("raw")).alias("corr"), (s["severity"].isin("critical", "high") | normalise.is_anomaly()).alias("alerted"))
    return scoring.hot_ids(rows)


def eval_worst_missed(spark, folder):
    """The logs with most missed controls."""
    return scoring.worst(scoring.set_counts(sec._judged(spark, folder)), "n_fn").select("id", "n_fp", "n_fn")


# -- load and routing -------------------------------------------------------------------------


def _calls(spark, folder) -> DataFrame:
    """Agent calls, each result once."""
    columns = ["result_id", "finding_id", "agent", "created_at", "ok", "source", "latency_ms", "completion_tokens"]
    rows = table(spark, folder, "agent_results").where("result_id is not null")
    return rows.groupBy("result_id").agg(F.min(F.struct(*columns[1:])).alias("x")).select("result_id", "x.*")


def load_levels(spark, folder):
    """Rates, errors, tokens and latencies per agent."""
    return metrics.load_stats(_calls(spark, folder), ["agent"])


def _routed(spark, folder) -> DataFrame:
    """Findings with their model calls and milliseconds."""
    model = F.lower(F.trim("source")).isin("llm", "mock")
    ms = F.when(model & (F.col("latency_ms") > 0), F.col("latency_ms")).otherwise(F.lit(0))
    return _calls(spark, folder).where("finding_id is not null").groupBy("finding_id").agg(
        F.min("created_at").alias("seen_at"), F.max("result_id").alias("last_id"), F.count_if(model).alias("model_calls"), F.sum(ms).alias("model_ms"), F.min(F.coalesce("ok", F.lit(False))).alias("ok"), F.max(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))).alias("latency_ms"),
    )


def ingest_summary(spark, folder):
    """One run's summary over all findings."""
    return metrics.ingest_summary(_routed(spark, folder), "seen_at", "latency_ms", "ok", "model_calls", "last_id")


def routing_model_ms(spark, folder):
    """Findings decided with and without a model, and what the model took."""
    n, calls = F.count(F.lit(1)), F.sum("model_calls")
    return _routed(spark, folder).agg(
        n.alias("findings"), F.count_if(F.col("model_calls") == 0).alias("deterministic_only"), F.count_if(F.col("model_calls") > 0).alias("hit_model"),
        F.round(100 * F.count_if(F.col("model_calls") == 0) / n, 1).alias("deterministic_pct"), calls.alias("model_calls"), F.sum("model_ms").alias("model_ms"),
        F.when(calls > 0, F.bround(F.sum("model_ms") / calls, 0)).otherwise(F.lit(0.0)).alias("avg_model_ms"),
    )


def routing_rows(spark, folder):
    """The first rows of the routing report."""
    rows = _routed(spark, folder).select("finding_id", (F.col("model_calls") == 0).alias("deterministic"), "model_calls", "model_ms")
    return metrics.scored_rows(rows, "deterministic", "model_ms", "finding_id")


def engine_load(spark, folder):
    """Events per tier and how many of them need a model."""
    m = F.col("mapping")
    rows = sec._resolved(spark, folder).groupBy(F.coalesce(m["primary_tier"], F.lit("none")).alias("tier"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(m["needs_llm"]).alias("llm_calls"), F.count_if(m["benign"]).alias("benign_suppressed"))


def latency_exposition(spark, folder):
    """Quantile lines of latencies."""
    summary = metrics.latency_summary(table(spark, folder, "events"), "value", ["event_type"], ["event_id"])
    return metrics.quantile_lines(summary, "ingest", "event_type")


# -- graphs -----------------------------------------------------------------------------------


def node_lookup(spark, folder):
    """The nodes that edges start from."""
    bundles = table(spark, folder, "sample_bundle")
    return graphs.lookup(bundles, graphs.edges(bundles).select("bundle_id", F.col("src").alias("id"))).select("bundle_id", "id", "type")


def graph_load(spark, folder):
    """The built-in crosswalk as graph edges."""
    return sinks.graph_edges(spark)


def corpus_load(spark, folder):
    """Control texts of the vector store, per framework."""
    return sinks.corpus(spark).groupBy("framework").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


# -- readers ----------------------------------------------------------------------------------


def read_lines(spark, folder):
    """Log lines from text files."""
    path = _place(spark, "lines")
    raw_logs(spark, folder).select("raw").write.text(path)
    return logs.lines(spark, path).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


def read_blocks(spark, folder):
    """Logs from files of blocks: six lines to a block, between lines of dashes."""
    path = _place(spark, "blocks")
    blocks = raw_logs(spark, folder).groupBy(F.floor(F.col("event_seq") / 6).alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_seq", "raw"))), lambda x: x["raw"]), "\n").alias("value"))
    blocks.select(F.concat("value", F.lit("\n---")).alias("value")).write.text(path)
    return logs.blocks(spark, path).groupBy(F.size(F.split("raw", "\n")).alias("n_lines")).agg(F.count(F.lit(1)).alias("n"))


def read_labels(spark, folder):
    """Labels from JSON lines, broken ones left out, the last of an id kept."""
    path = _place(spark, "labels")
    ids = F.concat(F.lit("E-"), F.lpad(F.hex("event_seq"), 8, "0"))
    rows = raw_logs(spark, folder).select(F.when(F.col("event_seq") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(ids.alias("event_id"), "label"))).alias("value"))
    rows.write.text(path)
    return logs.labels(spark, path).select("event_id", "label")


def read_gold(spark, folder):
    path = _place(spark, "gold")
    table(spark, folder, "gold_set").write.json(path)
    return logs.gold_set(spark, path).select("id", F.coalesce("log_type", F.lit("")).alias("log_type"), F.coalesce(F.array_join("controls", ","), F.lit("")).alias("controls"))


def _read_catalog(kind: str):
    def query(spark, folder):
        path = f"{_place(spark, 'catalog')}.{kind}"
        rows = table(spark, folder, "scf_sample").select("scf_id", "nist_csf_v2_0", "cis_csc_v8_1", "hipaa", "iso_27001_v2022", "pci_dss_v4_0")
        if kind == "csv":
            rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
        else:
            rows.write.json(path)
        read = logs.catalog(spark, path) if kind == "csv" else spark.read.json(path)
        return catalog.crosswalk(read).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))

    query.__doc__ = f"Catalogs from {kind} files."
    return query


read_catalog_csv, read_catalog_json = _read_catalog("csv"), _read_catalog("json")


def read_bundles(spark, folder):
    """Bundles from files of one each."""
    path = _place(spark, "bundles")
    table(spark, folder, "sample_bundle").write.option("maxRecordsPerFile", 1).json(path)
    return graphs.type_counts(logs.bundles(spark, path))


def newest_release(spark, folder):
    """The newest release by the numbers in its tag."""
    return logs.newest_release(table(spark, folder, "scf_sample").where("release_tag is not null").select(F.col("release_tag").alias("path")).distinct())


# -- writers ----------------------------------------------------------------------------------


def write_findings(spark, folder):
    """Findings written twice over: once each, and one audit row for each."""
    f, a = _place(spark, "findings"), _place(spark, "audit")
    rows = stored(table(spark, folder, "mvp_findings").where("finding_id is not null"))
    sinks.save_findings(rows, f, a)
    sinks.save_findings(rows, f, a)
    held = spark.read.parquet(f).groupBy("finding_id").agg(F.count(F.lit(1)).alias("n_findings"))
    told = spark.read.parquet(a).groupBy("finding_id").agg(F.count(F.lit(1)).alias("n_audit"))
    return held.join(told, "finding_id", "full_outer")


def write_timeline(spark, folder):
    path = _place(spark, "timeline")
    sinks.append_timeline(raw_logs(spark, folder).select("event_seq", "ts"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def write_backup(spark, folder):
    """A backup with its manifest, read again: rows and whether they are as they were."""
    path = _place(spark, "backup")
    made = sinks.backup({t: table(spark, folder, t) for t in ("gold_set", "scf_sample")}, path)
    rows = [(t, x["rows"], bool(made["verified"]), sinks.backups(spark, path).count()) for t, x in made["tables"].items()]
    return spark.createDataFrame(rows, "table_name string, n bigint, verified boolean, n_backups int")


def write_report(spark, folder):
    path = _place(spark, "report")
    sinks.report(sec.eval_micro(spark, folder), path)
    return spark.read.schema("tp bigint, fp bigint, fn bigint").json(path)


# -- streams ----------------------------------------------------------------------------------


def _envelopes(spark, folder) -> DataFrame:
    path = _place(spark, "envelopes")
    raw_logs(spark, folder).select("event_seq", "ts", "source", "hint", "raw").repartition(4).write.json(path)
    return pipeline.file_envelopes(spark, path)


def stream_verdicts(spark, folder):
    """Events through the stream: what its verdict sink holds."""
    out = _place(spark, "verdicts")
    sink = lambda df, epoch: df.select("event_seq", "severity", F.col("decision.decided_by").alias("decided_by")).write.mode("append").parquet(out)
    pipeline.run_pipeline(_envelopes(spark, folder), _place(spark, "cp"), {"verdicts": sink}).awaitTermination()
    return spark.read.parquet(out).groupBy("severity", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def stream_intel(spark, folder):
    """Indicator hits of a stream against a feed that is read anew for every batch."""
    out, feed = _place(spark, "intel"), _place(spark, "feed")
    api.intel_feed(spark).write.parquet(feed)
    sink = lambda df, epoch: df.drop("ts").write.mode("append").parquet(out)
    pipeline.run_pipeline(_envelopes(spark, folder), _place(spark, "cp"), {"intel": sink}, feed=lambda: spark.read.parquet(feed)).awaitTermination()
    return spark.read.parquet(out)


_NAMES = """config_evidence config_frameworks mapping_rationale mapping_catalog scf_nist_fallback severity_clamps analyze_agents analyze_chosen api_batch api_single api_pipeline vector_controls scan_lines redacted_findings rehydrated_findings
 label_join verdict_zip replay_hot_groups eval_worst_missed load_levels ingest_summary routing_model_ms routing_rows engine_load latency_exposition node_lookup graph_load corpus_load
 read_lines read_blocks read_labels read_gold read_catalog_csv read_catalog_json read_bundles newest_release write_findings write_timeline write_backup write_report stream_verdicts stream_intel""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# -- SQL --------------------------------------------------------------------------------------

_F, _FT, _q = sec._F, sec._FT, sec._q

def _listed(names: str) -> str:
    return f"'[' || list_aggregate(list_transform({names}, lambda x: '''' || x || ''''), 'string_agg', ', ') || ']'"


def _py(path: str) -> str:
    word = f"coalesce(json_extract_string(snapshot, '{path}'), 'null')"
    return f"CASE {word} WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' WHEN 'null' THEN 'None' ELSE {word} END"


def _evidence_sql() -> str:
    """The sentences by check, from the snapshots' JSON."""
    parts = []
    flags = {"CFG-ROOT-MFA": "$.aws_account.root_mfa_enabled", "CFG-PW-LEN": "$.aws_account.password_policy.min_length", "CFG-AUDIT-LOG": "$.cloudtrail.enabled", "CFG-BACKUP": "$.backups.configured"}
    for check, _, _, _ in policy.CHECKS:
        absent, passed, failed = policy.SENTENCES[check]
        if check in flags:
            text = " || ".join(_py(flags[check]) if x == "{v}" else _q(x) for x in passed.replace("{v}", "\0{v}\0").split("\0") if x)
            parts.append((check, text, text, absent))
            continue
        section = {"CFG-IAM-MFA": "iam_users", "CFG-S3-PUBLIC": "s3_buckets", "CFG-S3-ENC": "s3_buckets", "CFG-NET-SSH": "security_groups", "CFG-TLS-MIN": "tls_endpoints"}[check]
        count = f"CAST(json_array_length(snapshot, '$.{section}') AS VARCHAR)"

        def text(sentence: str, count: str = count) -> str:
            return " || ".join({"{n}": count, "{l}": _listed("string_split(evidence, ',')")}.get(x, _q(x)) for x in sentence.replace("{n}", "\0{n}\0").replace("{l}", "\0{l}\0").split("\0") if x)

        parts.append((check, text(passed), text(failed), absent))
    case = " ".join(f"WHEN '{c}' THEN CASE status WHEN 'na' THEN {_q(a)} WHEN 'pass' THEN {p} ELSE {f} END" for c, p, f, a in parts)
    return sec._checks_sql() + f" SELECT snapshot_id, check_id, status, CASE check_id {case} END AS evidence_text FROM k JOIN s USING (snapshot_id)"


def _verdict_sql(rows: list[str]) -> str:
    values = ", ".join(f"({i}, {_q(r)})" for i, r in enumerate(rows))
    source = f"SELECT event_seq, raw, 'auto' AS hint FROM (VALUES {values}) AS t(event_seq, raw)"
    return "WITH " + sec._finding_sql(source) + f" SELECT event_seq, {sec._SEVERITY} AS severity, {sec._SCORE} AS risk_score, {sec._ANOMALY} AS is_anomaly, {_DECIDED} AS decided_by, array_to_string(rule_controls, ',') AS controls FROM f"


_DECIDED = f"CASE WHEN len({sec._CVE}) > 0 THEN 'scan_engine' WHEN {sec._FIRST} <> '' THEN 'siem_rule' WHEN len(rule_controls) > 0 THEN 'compliance_rule' WHEN {sec._RISKY} THEN 'llm' ELSE 'deterministic' END"
_CALLS = """c AS (SELECT result_id, unnest(x) FROM (SELECT result_id, min({'finding_id': finding_id, 'agent': agent, 'created_at': created_at, 'ok': ok, 'source': source, 'latency_ms': latency_ms, 'completion_tokens': completion_tokens}) AS x FROM agent_results WHERE result_id IS NOT NULL GROUP BY 1))"""
_ROUTED = f"""{_CALLS}, m AS (SELECT *, coalesce(lower(trim(source)) IN ('llm', 'mock'), false) AS model FROM c WHERE finding_id IS NOT NULL),
 r AS (SELECT finding_id, min(created_at) AS seen_at, max(result_id) AS last_id, count_if(model) AS model_calls, sum(CASE WHEN model AND latency_ms > 0 THEN latency_ms ELSE 0 END)::BIGINT AS model_ms, bool_and(coalesce(ok, false)) AS ok, max(CASE WHEN latency_ms >= 0 THEN latency_ms END) AS latency_ms FROM m GROUP BY 1)"""
_NAMES_DIM = "names(control_id, title) AS (VALUES " + ", ".join(f"({_q(c)}, {_q(t)})" for c, t in frameworks.CONTROLS.items()) + ")"
_CONTROLS_DIM = "d(control_id) AS (VALUES " + ", ".join(f"('{c}')" for c in frameworks.CONTROLS) + ")"
_EXPANDED = sec._SCF + f", {_CONTROLS_DIM}, p AS (SELECT DISTINCT control_id, scf_id FROM w JOIN d ON framework = 'cis' AND norm_id = regexp_extract(control_id, '(\\d{{1,2}})', 1)), x AS (SELECT DISTINCT control_id, framework, ext_id FROM p JOIN w USING (scf_id) WHERE framework <> 'cis')"
_MICROS = "(epoch_us(max({0})) - epoch_us(min({0}))) / 1e6"
_NIST_IDS = sorted({n for ns in [*frameworks.CONTROL_NIST.values(), *frameworks.HIPAA_NIST.values()] for n in ns})


def _nearest(v: str, p: float) -> str:
    return f"round({v}[CAST(least(len({v}) - 1, round_even({p} * (len({v}) - 1), 0)) AS INT) + 1], 1)"


_P = ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
ORACLES = {
    "config_evidence": _evidence_sql(),
    "config_frameworks": sec._checks_sql() + f", {sec._NIST_DIM}, {sec._HIPAA_DIM}, {sec._PAIRS}, fw AS (SELECT control_id, 'nist_csf' AS framework, string_agg(nist_id, ',' ORDER BY ord) AS ids FROM cn GROUP BY 1 UNION ALL SELECT control_id, 'hipaa', string_agg(section, ',' ORDER BY section) FROM ch GROUP BY 1) SELECT snapshot_id, check_id, framework, ids FROM k JOIN fw USING (control_id) WHERE status = 'fail'",
    "mapping_rationale": _F + f"{_NAMES_DIM}, o AS (SELECT event_seq, unnest(rule_controls) AS control_id, generate_subscripts(rule_controls, 1) AS pos FROM f), n3 AS (SELECT event_seq, string_agg(title, ', ' ORDER BY pos) AS l FROM o JOIN names USING (control_id) WHERE pos <= 3 GROUP BY 1), "
    f"x AS (SELECT CASE WHEN len(rule_controls) > 0 THEN 'keyword/signature rules matched ' || l || '; NIST/HIPAA expanded via the deterministic crosswalk table.' WHEN {sec._RISKY} THEN 'No rule/embedding match but risk signals are present — escalating to LLM fallback for a reviewable suggestion (non-authoritative).' ELSE 'No rule or embedding match and no deterministic risk signals — treated as benign (no applicable control); LLM not consulted.' END AS rationale FROM f LEFT JOIN n3 USING (event_seq)) SELECT rationale, count(*) AS n FROM x GROUP BY 1",
    "mapping_catalog": _EXPANDED.replace("WITH ", f"WITH {sec._finding_sql(sec._TYPED)}, ".replace("low AS (SELECT", "lo AS (SELECT").replace("FROM low)", "FROM lo)"), 1)
    + ", sets AS (SELECT event_seq, list_sort(rule_controls) AS cs FROM f), u AS (SELECT DISTINCT cs FROM sets), e AS (SELECT cs, unnest(cs) AS control_id FROM u), g AS (SELECT DISTINCT cs, framework, ext_id FROM e JOIN x USING (control_id)), a AS (SELECT cs, count(*) FILTER (framework = 'nist_csf') AS n_nist, min(ext_id) FILTER (framework = 'nist_csf') AS first_nist, count(*) FILTER (framework = 'hipaa') AS n_hipaa, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks FROM g GROUP BY 1) "
    "SELECT array_to_string(cs, ',') AS controls, coalesce(n_nist, 0)::INT AS n_nist, first_nist, coalesce(n_hipaa, 0)::INT AS n_hipaa, coalesce(frameworks, '') AS frameworks, count(*) AS n FROM sets LEFT JOIN a USING (cs) GROUP BY ALL",
    "scf_nist_fallback": _EXPANDED.replace("'nist_csf' AS framework, unnest(regexp_split_to_array(coalesce(nist_csf_v2_0, '')", "'nist_csf' AS framework, unnest(regexp_split_to_array(coalesce(CASE WHEN CAST(nullif(regexp_extract(cis_csc_v8_1, '(\\d{1,2})', 1), '') AS INT) < 8 THEN nist_csf_v2_0 END, '')")
    + ", n AS (SELECT control_id, string_agg(ext_id, ',' ORDER BY ext_id) FILTER (framework = 'nist_csf') AS a, string_agg(ext_id, ',' ORDER BY ext_id) FILTER (framework = 'iso_27001') AS b FROM x GROUP BY 1) SELECT control_id, coalesce(a, b, '') AS nist FROM d LEFT JOIN n USING (control_id)",
    "severity_clamps": "WITH x AS (SELECT CASE event_id % 4 WHEN 0 THEN 'high' WHEN 2 THEN 'critical' ELSE 'medium' END AS severity, CASE WHEN event_id % 3 = 0 THEN greatest(0, least(100, CAST(trunc(value) AS BIGINT))) WHEN event_id % 3 = 1 THEN 0 ELSE greatest(0, least(100, CAST(trunc(-value) AS BIGINT))) END AS risk_score FROM events) SELECT severity, risk_score::INT AS risk_score, count(*) AS n FROM x GROUP BY ALL",
    "analyze_agents": _F + f"x AS (SELECT {sec._SEVERITY} AS severity, CASE WHEN len(rule_controls) = 0 AND {sec._RISKY} THEN 'risk_scorer,compliance_mapper,anomaly_detector' ELSE 'risk_scorer,anomaly_detector' END AS agents FROM f) SELECT agents, severity, count(*) AS n FROM x GROUP BY ALL",
    "analyze_chosen": "SELECT 'risk_scorer,report_generator' AS agents, count(*) AS n FROM events",
    "api_batch": _verdict_sql([raw for _, raw in logs.SAMPLES]),
    "api_single": _verdict_sql(["Failed password for invalid user x from 203.0.113.55"]),
    "api_pipeline": "WITH v AS (" + _verdict_sql([raw for _, raw in logs.SAMPLES]) + ") SELECT event_seq, 0 AS step, '' AS severity, false AS has_id FROM v UNION ALL SELECT event_seq, 1, severity, true FROM v",
    "vector_controls": f"WITH {sec._TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 100 - label * 7 - vec_id % 5 DESC, vec_id) AS p FROM k) SELECT query_id, vec_id, label FROM r WHERE p <= 6 AND similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY p) = 1",
    "scan_lines": "SELECT raw FROM (VALUES " + ", ".join("(" + _q(f"Scan finding on 10.0.0.7: {s} vulnerable to {c} ({v}) — {t}") + ")" for s in rules.DEFAULT_SERVICES for g, c, v, t in rules.VULNERABILITIES if g.lower() in s.lower()) + ") AS t(raw)",
    "redacted_findings": _F + "x AS (SELECT event_seq, n_ioc::INT AS ioc_hit_count, array_to_string(list_filter([" + ", ".join(f"CASE WHEN len(list_filter({sec.rules.INDICATOR_ENTITY[k]}, lambda v: list_contains({sec._list([i.lower() for i in rules.INDICATORS[k]])}, lower(v)))) > 0 THEN '{k}' END" for k in sorted(rules.INDICATORS)) + "], lambda y: y IS NOT NULL), ',') AS kinds, array_to_string(cve_ids, ',') AS cves, len(source_ip)::INT AS n_ips FROM f) SELECT *, false AS leaks FROM x",
    "rehydrated_findings": _F + "x AS (SELECT 1) SELECT event_seq, array_to_string(source_ip, ',') AS ips, array_to_string(domains, ',') AS domains FROM f",
    "label_join": f"WITH i AS (SELECT event_id AS event_seq, CASE event_id % 5 WHEN 0 THEN 'e' || {sec._HEX} WHEN 4 THEN '' ELSE {sec._HEX} END AS id FROM events), l AS (SELECT id, label FROM i JOIN ({sec._TYPED}) USING (event_seq) WHERE label <> 'benign' AND id <> '') SELECT coalesce(label, 'unlabeled') AS label, count(*) AS n FROM i LEFT JOIN l USING (id) GROUP BY 1",
    "verdict_zip": _F + f"x AS (SELECT source, label, {sec._SEVERITY} AS severity, {sec._ANOMALY} AS is_anomaly FROM f) SELECT source, label, severity, is_anomaly, count(*) AS n FROM x GROUP BY ALL",
    "replay_hot_groups": _F + sec._REPLAY + ", y AS (SELECT event_seq, alerted, unnest(corr) AS id FROM e) SELECT id, count(*) AS n_events, count_if(alerted) AS n_alerted FROM y GROUP BY 1 HAVING count_if(alerted) > 0",
    "eval_worst_missed": sec._JUDGE + ", w AS (SELECT id, fp AS n_fp, fn AS n_fn FROM c ORDER BY fn DESC, id LIMIT 6) SELECT id, n_fp, n_fn FROM w WHERE n_fn > 0",
    "load_levels": f"WITH {_CALLS}, s AS (SELECT agent, list_sort(list(latency_ms::DOUBLE)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY result_id DESC) AS k FROM c WHERE latency_ms >= 0) WHERE k <= 5000 GROUP BY 1), "
    f"a AS (SELECT agent, count(*) AS completed, count_if(NOT coalesce(ok, false)) AS errors, round_even(count_if(NOT coalesce(ok, false)) / count(*), 3) AS error_rate, coalesce(round_even(count(*) / nullif({_MICROS.format('created_at')}, 0), 4), 0) AS calls_per_s, coalesce(round_even(coalesce(sum(completion_tokens), 0) / nullif({_MICROS.format('created_at')}, 0), 3), 0) AS tokens_per_s, round_even(coalesce(sum(completion_tokens), 0) / count(*), 1) AS avg_tokens FROM c GROUP BY 1) "
    "SELECT a.*, " + ", ".join(f"{_nearest('v', p)} AS {n}" for p, n in _P) + ", round(list_max(v), 1) AS max_ms FROM a LEFT JOIN s ON a.agent IS NOT DISTINCT FROM s.agent",
    "ingest_summary": f"WITH {_ROUTED}, v AS (SELECT list_sort(list(l)) AS v FROM (SELECT latency_ms::DOUBLE AS l FROM r WHERE latency_ms >= 0 ORDER BY last_id DESC LIMIT 5000)), "
    f"a AS (SELECT count(*) AS events, count_if(NOT ok) AS errors, round_even({_MICROS.format('seen_at')}, 2) AS wall_s, coalesce(round_even(count(*) / nullif({_MICROS.format('seen_at')}, 0), 4), 0) AS throughput_eps, sum(model_calls)::BIGINT AS model_calls, round_even(sum(model_calls) / count(*), 3) AS calls_per_event, round_even(100 * count_if(model_calls = 0) / count(*), 1) AS deterministic_pct FROM r) SELECT a.*, " + ", ".join(f"{_nearest('v.v', p)} AS {n}" for p, n in _P) + " FROM a, v",
    "routing_model_ms": f"WITH {_ROUTED} SELECT count(*) AS findings, count_if(model_calls = 0) AS deterministic_only, count_if(model_calls > 0) AS hit_model, round(100 * count_if(model_calls = 0) / count(*), 1) AS deterministic_pct, sum(model_calls)::BIGINT AS model_calls, sum(model_ms)::BIGINT AS model_ms, coalesce(round_even(sum(model_ms) / nullif(sum(model_calls), 0), 0), 0) AS avg_model_ms FROM r",
    "routing_rows": f"WITH {_ROUTED} SELECT finding_id, model_calls = 0 AS deterministic, model_calls, model_ms, row_number() OVER (ORDER BY model_calls > 0, model_ms, finding_id) AS pos FROM r QUALIFY pos <= 150",
    "engine_load": _F + f"x AS (SELECT CASE WHEN len(rule_controls) > 0 THEN 'rules' WHEN {sec._RISKY} THEN 'none' ELSE 'benign' END AS tier FROM f) SELECT tier, count(*) AS events, count_if(tier = 'none') AS llm_calls, count_if(tier = 'benign') AS benign_suppressed FROM x GROUP BY 1",
    "latency_exposition": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL), g AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE k <= 5000 GROUP BY 1) "
    + " UNION ALL ".join(f"""SELECT 'ingest_ms{{event_type="' || event_type || '",quantile="{q}"}} ' || CAST({_nearest('v', p)} AS VARCHAR) AS line FROM g""" for q, p in (("0.5", 0.5), ("0.95", 0.95), ("0.99", 0.99))),
    "node_lookup": f"WITH {sec._NODES}, {sec._EDGES} SELECT DISTINCT n.bundle_id, n.id, n.type FROM nodes n JOIN edges e ON n.bundle_id = e.bundle_id AND n.id = e.src",
    "graph_load": f"WITH {sec._NIST_DIM} SELECT control_id AS src, nist_id AS dst, 'MAPS_TO' AS rel FROM cn",
    "corpus_load": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {len(t)}, {sum(map(len, t))})" for f, t in (("cis_v8", list(frameworks.CONTROLS.values())), ("hipaa", list(frameworks.HIPAA.values())), ("nist_csf", _NIST_IDS))) + ") AS t(framework, n, n_chars)",
    "read_lines": f"SELECT raw, count(*) AS n FROM ({sec._TYPED}) GROUP BY 1",
    "read_blocks": "SELECT n_lines, count(*) AS n FROM (SELECT event_id // 6 AS b, count(*)::INT AS n_lines FROM events GROUP BY 1) GROUP BY 1",
    "read_labels": f"SELECT 'e' || lower(lpad(printf('%X', event_seq), 8, '0')) AS event_id, label FROM ({sec._TYPED}) WHERE event_seq % 50 <> 0",
    "read_gold": "SELECT id, coalesce(log_type, '') AS log_type, coalesce(array_to_string(controls, ','), '') AS controls FROM gold_set WHERE id IS NOT NULL",
    "read_catalog_csv": sec._SCF + " SELECT framework, count(*) AS n FROM w GROUP BY 1",
    "read_catalog_json": sec._SCF + " SELECT framework, count(*) AS n FROM w GROUP BY 1",
    "read_bundles": sec.ORACLES["graph_type_counts"],
    "newest_release": "SELECT release_tag AS path FROM (SELECT DISTINCT release_tag FROM scf_sample WHERE release_tag IS NOT NULL) ORDER BY list_transform(regexp_extract_all(release_tag, '(\\d+)', 1), lambda x: CAST(x AS BIGINT)) DESC, release_tag LIMIT 1",
    "write_findings": "SELECT DISTINCT finding_id, 1::BIGINT AS n_findings, 1::BIGINT AS n_audit FROM mvp_findings WHERE finding_id IS NOT NULL",
    "write_timeline": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1",
    "write_backup": "SELECT 'gold_set' AS table_name, count(*) AS n, true AS verified, 1 AS n_backups FROM gold_set UNION ALL SELECT 'scf_sample', count(*), true, 1 FROM scf_sample",
    "write_report": sec._JUDGE + " SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c",
    "stream_verdicts": _F + f"x AS (SELECT {sec._SEVERITY} AS severity, {_DECIDED} AS decided_by FROM f) SELECT severity, decided_by, count(*) AS n FROM x GROUP BY ALL",
    "stream_intel": sec.ORACLES["ioc_join"],
}
