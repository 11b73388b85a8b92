"""The library's surface: each call takes and gives DataFrames; nothing is served over HTTP."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden import agents
from siftwarden.operators import graphs, mapping, metrics, normalise, policy, redaction
from siftwarden.packs import rules
from siftwarden.sources import logs, sinks


def analyze(logs_df: DataFrame, hint: str | None = None, force_llm: bool = False, chosen: list[str] | None = None, narrative_from: str | None = None) -> DataFrame:
    """Findings with mapping and verdict for logs with a column ``raw``.

    ``agents`` lists what would run: the mapper only for undecided findings, the report only
    when chosen, forced, or from a severity on; ``skipped_agents`` are the others.
    """
    resolved = mapping.resolve(normalise.normalise(logs_df, hint))
    s, d = normalise.severity_score(), mapping.decision()
    out = resolved.withColumns({"severity": s["severity"], "risk_score": s["risk_score"], "is_anomaly": normalise.is_anomaly(), "decision": d, "shape": mapping.verdict_shape()})
    explicit, force = bool(chosen), F.lit(force_llm)
    gates = {
        "risk_scorer": F.lit(True), "anomaly_detector": F.lit(True), "remediation_generator": F.lit(explicit) | force, "compliance_mapper": F.col("mapping.needs_llm") | F.lit(explicit) | force,
        "report_generator": F.lit(explicit) | force | (normalise.at_least(F.col("severity"), narrative_from) if narrative_from else F.lit(False)),
    }
    run = F.array_compact(F.array(*(F.when(gates[a], a) for a in agents.selected(chosen))))
    content = F.concat(F.col("raw"), F.coalesce(F.col("event_seq").cast("string"), F.lit(""))) if "event_seq" in logs_df.columns else F.col("raw")
    wanted = F.array(*(F.lit(a) for a in agents.selected(chosen)))
    out = out.withColumns({"agents": run, "skipped_agents": F.array_except(wanted, run), "raw_excerpt": F.substring("raw", 1, 600)})
    return out.withColumn("finding_id", F.concat(F.lit("F-"), F.substring(F.sha2(content, 256), 1, 12)))


def analyze_text(spark: SparkSession, raw: str, hint: str = "auto", **options) -> DataFrame:
    return analyze(logs.single(spark, raw, hint), "hint", **options)


def analyze_batch(spark: SparkSession, raws: list[str], **options) -> DataFrame:
    return analyze(logs.batch(spark, raws), "hint", **options)


def run_batch(spark: SparkSession, raws: list[str], mode: str = "direct") -> dict[str, DataFrame]:
    """A batch of logs in one of two modes.

    ``direct`` gives findings only. ``pipeline`` also gives what the bus would leave behind: alerts
    of every rule, and a timeline of two rows per log, the normalised one without id and
    severity and the one of the verdict.
    """
    if mode not in ("direct", "pipeline"):
        raise ValueError(f"unknown mode {mode}")
    found = analyze_batch(spark, raws)
    if mode == "direct":
        return {"findings": found}
    steps = F.array(F.struct(F.lit("").alias("finding_id"), F.lit("").alias("severity")), F.struct("finding_id", "severity"))
    rows = found.select("event_seq", "log_type", F.posexplode(steps).alias("step", "x")).select("event_seq", "step", "log_type", "x.finding_id", "x.severity")
    return {"findings": found, "alerts": normalise.alerts(found, "event_seq"), "timeline": rows}


def config_scan(snapshots: DataFrame, key: str = "snapshot_id", text: str = "snapshot") -> dict[str, DataFrame]:
    found = policy.evaluate(snapshots, key, text)
    return {"findings": found, "posture": policy.posture(found, key), "summary": policy.score(found, key)}


def scan(spark: SparkSession, target: str, services: list[str] | None = None) -> DataFrame:
    rows = spark.createDataFrame([(target, s) for s in services or rules.DEFAULT_SERVICES], "target string, service string")
    known = spark.createDataFrame(rules.VULNERABILITIES, "signature string, cve string, severity string, summary string")
    hits = normalise.scan(rows, known, "target")
    line = F.format_string("Scan finding on %s: %s vulnerable to %s (%s) — %s", "target", "service", "cve", "severity", "summary")
    return hits.withColumn("raw", line)


def redact(rows: DataFrame, key: str, text: str, health_mode: bool = False) -> DataFrame:
    return redaction.redact(rows, key, text, health_mode)


def intel_feed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v.lower()) for k, vs in rules.INDICATORS.items() for v in vs], "kind string, value string")


def alerts(findings: DataFrame, most: int = 50) -> DataFrame:
    """Recent alerts of analysed logs, newest first."""
    return metrics.last_n(normalise.alerts(findings, "event_seq"), most, ["event_seq"])


def timeline(findings: DataFrame, most: int = 10_000) -> DataFrame:
    return metrics.last_n(findings.select("event_seq", "finding_id", "log_type", "severity"), most, ["event_seq"])


def recent(findings: DataFrame, most: int = 50) -> DataFrame:
    """The newest analysed findings."""
    return metrics.last_n(findings.select("event_seq", "finding_id", "log_type", "severity", "risk_score", "decision"), most, ["event_seq"])


def assess(logs_df: DataFrame, make_client=None, key: str = "event_seq", text: str = "raw") -> DataFrame:
    """A model's own view of raw logs, several per call."""
    return agents.assessed(logs_df, key, text, make_client)


def intel_refresh(feed: DataFrame) -> DataFrame:
    """A feed as it takes effect: distinct lower-cased indicators, counted per kind."""
    return feed.select("kind", F.lower("value").alias("value")).where("value <> ''").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def bundle_load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Bundles of a file or folder, checked and summarised."""
    return bundle_status(logs.bundles(spark, path))


def bundle_status(bundles: DataFrame) -> dict[str, DataFrame]:
    return {"counts": graphs.type_counts(bundles), "sample": graphs.sample(bundles), "hashes": graphs.checked_hash(bundles)}


def ops(findings: DataFrame, latency: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counters of detections and, with a frame (name, value, seq), latency summaries per name."""
    out = {"counters": metrics.counters(normalise.alerts(findings, "event_seq"), "detections_total", "rule")}
    if latency is not None:
        out["latency"] = metrics.latency_summary(latency, "value", ["name"], ["seq"])
    return out


def metrics_text(findings: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """The same as lines of the usual exposition format."""
    held = ops(findings, latency)
    lines = metrics.exposition(held["counters"])
    return lines if latency is None else lines.unionByName(metrics.quantile_lines(held["latency"], "latency", "name"))


def health(stores: dict[str, DataFrame]) -> dict[str, dict]:
    """Probes each store; a failing probe is reported, not raised."""
    out = {}
    for name, df in stores.items():
        ok, reason = sinks.Probe(lambda df=df: df)()
        out[name] = {"ok": ok} | ({"error": reason} if reason.startswith("error") else {})
    return out


def health_table(spark: SparkSession, stores: dict[str, DataFrame]) -> DataFrame:
    """The probes as rows: (store, ok, error)."""
    rows = [(name, x["ok"], x.get("error")) for name, x in health(stores).items()]
    return spark.createDataFrame(rows, "store string, ok boolean, error string")


def backup(tables: dict[str, DataFrame], path: str) -> dict:
    return sinks.backup(tables, path)
