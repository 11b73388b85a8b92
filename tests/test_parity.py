"""Policy sentences, rationale, catalogs, hashes, nested redaction, summaries, writers and jobs."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siftwarden import agents, api
from siftwarden.operators import catalog, graphs, mapping, metrics, normalise, policy, redaction, scoring
from siftwarden.packs import frameworks
from siftwarden.plans import surface
from siftwarden.sources import sinks
from siftwarden.streaming import pipeline

INSECURE = {
    "aws_account": {"root_mfa_enabled": None, "password_policy": {"min_length": 8}}, "iam_users": [{"name": "svc", "mfa_enabled": False}, {"name": "a", "mfa_enabled": True}], "s3_buckets": [{"name": "b", "public": True, "encrypted": False}],
    "cloudtrail": {"enabled": False}, "security_groups": [{"name": "sg", "open_ingress": [{"cidr": "0.0.0.0/0", "port": 22}]}], "tls_endpoints": [{"name": "api", "min_version": "1.0"}], "backups": {"configured": None},
}


def test_null_flags_fail_and_checks_say_why(spark):
    partial = {"backups": {}, "iam_users": [], "s3_buckets": [{}], "aws_account": {"password_policy": {"min_length": None}}}
    df = spark.createDataFrame([(1, json.dumps(INSECURE)), (2, json.dumps(partial)), (3, None)], "snapshot_id int, snapshot string")
    got = {(r.snapshot_id, r.check_id): (r.status, r.evidence_text) for r in policy.evaluate(df).collect()}
    assert [got[1, c][1] for c, *_ in policy.CHECKS] == [
        "root_mfa_enabled=None", "users without MFA: ['svc']", "min_length=8 (require >=14)", "public buckets: ['b']", "unencrypted buckets: ['b']", "cloudtrail.enabled=False", "world-open admin ports: ['sg:22']", "weak TLS endpoints: ['api']", "backups.configured=None",
    ]
    assert {s for (i, _), (s, _) in got.items() if i == 1} == {"fail"}
    assert got[2, "CFG-BACKUP"] == ("na", "no backups.configured") and got[2, "CFG-IAM-MFA"] == ("pass", "all 0 users have MFA")
    assert got[2, "CFG-S3-PUBLIC"] == ("pass", "1 buckets non-public") and got[2, "CFG-S3-ENC"] == ("fail", "unencrypted buckets: ['?']") and got[2, "CFG-PW-LEN"][0] == "fail"
    assert {s for (i, _), (s, _) in got.items() if i == 3} == {"na"}
    summary = {r.snapshot_id: r for r in policy.score(policy.evaluate(df)).collect()}
    assert (summary[1].n_total, summary[1].n_fail, summary[1].score) == (9, 9, 0.0) and summary[3].score is None
    found = policy.evaluate(df).where("snapshot_id = 1 and check_id = 'CFG-PW-LEN'").collect()[0]
    assert found.frameworks["nist_csf"] == frameworks.CONTROL_NIST["Control 5"] and sorted(found.frameworks) == ["hipaa", "nist_csf"]


def test_rationale_names_what_matched(spark):
    found = normalise.normalise(spark.createDataFrame([(0, "Failed password for sudo"), (1, "lateral movement via psexec"), (2, "all quiet")], "event_seq int, raw string"))
    plain = [r[0] for r in mapping.resolve(found).orderBy("event_seq").select(mapping.rationale()).collect()]
    assert plain[0].startswith("keyword/signature rules matched ") and plain[0].endswith("; NIST/HIPAA expanded via the deterministic crosswalk table.")
    assert "escalating to LLM fallback" in plain[1] and "treated as benign" in plain[2]
    near = mapping.resolve(found, F.array(F.lit("Control 13"), F.lit("Control 99"))).where("event_seq = 2").select(mapping.rationale()).collect()[0][0]
    assert near == "embedding similarity added Control 13; NIST/HIPAA expanded via the deterministic crosswalk table."


def test_a_loaded_catalog_replaces_the_tables(spark):
    rows = [("A-1", "PR.B\nPR.A", "6.8; 7", "h2", "3.1"), ("A-2", None, "Control 9", "h1", "3.2, 3.1"), ("A-3", "", "7", "h1", "3.9")]
    walk = catalog.crosswalk(spark.createDataFrame(rows, ["scf_id", "NIST CSF v2.0", "CIS CSC v8.1", "HIPAA", "NIST 800-53 rev5"]))
    controls = spark.createDataFrame([(f"Control {i}",) for i in (6, 7, 9, 10)], "control_id string")
    assert {r.control_id: r.nist for r in catalog.nist_of(walk, controls).collect()} == {"Control 6": ["PR.A", "PR.B"], "Control 7": ["PR.A", "PR.B"], "Control 9": ["3.1", "3.2"], "Control 10": []}
    events = spark.createDataFrame([(1, ["Control 9", "Control 6"]), (2, ["Control 9"]), (3, []), (4, ["Control 10"])], "event_seq int, ids array<string>")
    m = F.struct(F.col("ids").alias("control_ids"), F.array(F.lit("x")).alias("nist_subcategories"), F.array(F.lit("x")).alias("hipaa_sections"))
    got = {r.event_seq: (r.mapping.nist_subcategories, r.mapping.hipaa_sections, r.frameworks) for r in mapping.with_catalog(events.withColumn("mapping", m), walk).collect()}
    assert got[1] == (["PR.A", "PR.B"], ["h1", "h2"], {"nist_csf": ["PR.A", "PR.B"], "hipaa": ["h1", "h2"], "nist_80053": ["3.1", "3.2"]})
    assert got[2][:2] == (["3.1", "3.2"], ["h1"]) and got[3] == got[4] == ([], [], {})
    assert mapping.with_catalog(events.withColumn("mapping", m), walk.limit(0)).where("size(frameworks) > 0").count() == 0


def test_the_catalog_is_looked_up_for_sets_not_for_findings(spark, data, monkeypatch):
    given, plain = [], mapping.with_catalog
    monkeypatch.setattr(mapping, "with_catalog", lambda found, walk: given.append(found.count()) or plain(found, walk))
    rows = surface.mapping_catalog(spark, data).collect()
    assert given == [len(rows)] and sum(r.n for r in rows) == spark.read.parquet(f"{data}/events.parquet").count()


def test_findings_by_set_of_controls(spark):
    events = spark.createDataFrame([(["B", "A"],), (["A", "B"],), (["A"],), ([],), ([],)], "ids array<string>").select(F.struct(F.col("ids").alias("control_ids")).alias("mapping"))
    assert {(*r.mapping.control_ids, r.n) for r in mapping.by_set(events).collect()} == {("A", "B", 2), ("A", 1), (2,)}
    assert mapping.by_set(events.limit(0)).count() == 0


def test_hash_of_canonical_json(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "a", 'q"\\/\n\t\x01\x7f', "é", "日本", "😀 x"])
    rows = []
    for i in range(40):
        nodes = rng.choice([None, [rng.choice([None, {"id": text(), "type": text(), "label": text(), "framework": None, "props": rng.choice([None, {}, {"b": "1", "a": text(), "é": "x"}])}]) for _ in range(3)]])
        edges = rng.choice([None, [], [{"src": text(), "dst": text(), "rel": "R"}, None]])
        graph = {"nodes": nodes, "edges": edges}
        sha = hashlib.sha256(json.dumps(graph, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append((({"bundle_id": f"b{i}", "graph_sha256": None if i == 0 else "bad" if i == 1 else sha, "signature": "x" if i == 2 else "STUB"}), graph))
    schema = "manifest struct<bundle_id string, graph_sha256 string, signature string>, graph struct<nodes array<struct<id string, type string, label string, framework string, props map<string,string>>>, edges array<struct<src string, dst string, rel string>>>"
    got = {r.bundle_id: (r.agrees, r.verified, r.error) for r in graphs.checked_hash(spark.createDataFrame(rows, schema)).collect()}
    assert got["b0"] == (False, False, "no graph_sha256 in manifest") and got["b1"] == (False, False, "graph hash mismatch") and got["b2"] == (True, False, None)
    assert {v for k, v in got.items() if k not in ("b0", "b1", "b2")} == {(True, True, None)}


def test_nested_findings_share_placeholders_and_come_back(spark):
    raw = "user=root login for username=root from 203.0.113.55 and 203.0.113.55 to db.corp CVE-2024-3400"
    found = normalise.normalise(spark.createDataFrame([(1, raw), (2, None)], "event_seq int, raw string"))
    r = {x.event_seq: x for x in redaction.redact_findings(found, "event_seq").collect()}
    one = r[1]
    assert "203.0.113.55" not in one.redacted and one.entities.source_ip == ["{IPV4_001}"] and one.entities.cve_ids == ["CVE-2024-3400"] and one.entities.usernames == ["{USER_001}"]
    assert (one.ioc_hit_count, one.kinds) == (2, ["cve_kev", "ip"]) and r[2].redacted is None
    doc = json.dumps({"a": ["seen {IPV4_001}", {"u": "{USER_001}"}], "n": 1, "{USER_001}": None})
    tokens = [{"placeholder": t.placeholder, "kind": t.kind, "original": t.original} for t in one.tokens] + [{"placeholder": "{X_001}", "kind": "X", "original": 'q"'}]
    rows = spark.createDataFrame([(1, doc, tokens), (2, "no json {USER_001}", tokens), (3, None, None), (4, '["{X_001}"]', tokens)], f"k int, doc string, tokens {redaction.TOKENS}")
    back = {x.k: x.restored for x in redaction.rehydrate_json(rows, "k", "doc").collect()}
    assert json.loads(back[1]) == {"a": ["seen 203.0.113.55", {"u": "root"}], "n": 1, "{USER_001}": None}
    assert back[2] == "no json root" and back[3] is None and json.loads(back[4]) == ['q"']


def test_load_and_ingest_summaries(spark):
    rows = [(i, "a", f"2025-01-01 00:00:{i:02d}", i % 4 > 0, 10 * i if i else -1, 5) for i in range(11)] + [(99, None, "2025-01-01 00:00:00", True, None, None)]
    calls = spark.createDataFrame(rows, "result_id int, agent string, at string, ok boolean, latency_ms bigint, completion_tokens bigint").withColumn("created_at", F.col("at").cast("timestamp"))
    got = {r.agent: r for r in metrics.load_stats(calls, ["agent"]).collect()}
    assert (got["a"].completed, got["a"].errors, got["a"].calls_per_s, got["a"].tokens_per_s, got["a"].p50, got["a"].max_ms) == (11, 3, 1.1, 5.5, 50.0, 100.0)
    assert (got[None].completed, got[None].calls_per_s, got[None].p50) == (1, 0.0, None)
    one = metrics.ingest_summary(calls.withColumn("n", F.col("result_id") % 2), "created_at", "latency_ms", "ok", "n", "result_id").collect()[0]
    assert (one.events, one.errors, one.wall_s, one.model_calls, one.p99) == (12, 3, 10.0, 6, 100.0)
    assert metrics.ingest_summary(calls.limit(0).withColumn("n", F.lit(0)), "created_at", "latency_ms", "ok", "n", "result_id").collect()[0].events == 0
    assert metrics.quantile_lines(spark.createDataFrame([(1.0, 2.0, 3.5)], "p50 double, p95 double, p99 double"), "x").collect()[2].line == 'x_ms{quantile="0.99"} 3.5'


def test_hot_ids_zip_and_worst(spark):
    rows = [(1, True, ["a", "b", "b"]), (2, False, ["b", "c"]), (3, False, [])]
    events = spark.createDataFrame(rows, "event_seq int, alerted boolean, corr array<string>")
    assert {tuple(r) for r in scoring.hot_ids(events).collect()} == {("a", 1, 1), ("b", 2, 1)}
    assert {tuple(r) for r in scoring.zipped(events.select("event_seq", "alerted"), spark.createDataFrame([(1, "high", False)], "event_seq int, severity string, alerted boolean")).collect()} == {(1, True, "high"), (2, False, None), (3, False, None)}
    counted = spark.createDataFrame([(i, i % 3, 0) for i in range(9)], "id int, n_fn int, n_fp int")
    assert [r.id for r in scoring.worst(counted, "n_fn").orderBy(F.desc("n_fn"), "id").collect()] == [2, 5, 8, 1, 4, 7] and scoring.worst(counted, "n_fp").count() == 0


def test_audit_rows_follow_findings(spark, tmp_path):
    f, a = str(tmp_path / "f"), str(tmp_path / "a")
    df = spark.createDataFrame([("F-1", "x", "high"), ("F-2", "y", "low")], "finding_id string, log_type string, severity string")
    sinks.append_new(df, f, "finding_id")  # a run that broke before its audit rows
    assert sinks.save_findings(df, f, a) == 0
    assert {(r.finding_id, json.loads(r.detail)["severity"]) for r in spark.read.parquet(a).collect()} == {("F-1", "high"), ("F-2", "low")}


def test_timeline_of_one_day_goes_to_many_tasks(spark, tmp_path):
    rows = spark.range(4000).select("id", F.timestamp_seconds(F.lit(1_735_700_000) + F.col("id")).alias("ts")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these are small
    sinks.append_timeline(rows, str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t").glob("day=*/*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_wrapped_messages(spark):
    assert [tuple(r) for r in pipeline.wrapped(spark.createDataFrame([("m",), (None,)], "value string")).collect()] == [("m", "vector", "raw.WARM")]


def test_a_sink_that_worked_is_not_called_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"event_seq": 1, "ts": "2025-01-01T00:00:00Z", "raw": "ping 203.0.113.55"}))
    calls: dict[str, int] = {}
    feeds = iter([api.intel_feed(spark)] * 5)

    def sink(name, fails):
        def run(df, epoch):
            calls[name] = calls.get(name, 0) + 1
            df.collect()
            if fails:
                raise ValueError("down")

        return run

    query = pipeline.run_pipeline(pipeline.file_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "cp"), {"intel": sink("intel", False), "alerts": sink("alerts", True)}, feed=lambda: next(feeds))
    with pytest.raises(Exception, match="alerts: down"):
        query.awaitTermination(120)
    assert calls == {"intel": 1, "alerts": 1} and pipeline.Job(query).status()["state"] == "failed"


def test_scheduled_action_and_stop(spark):
    done: list[int] = []
    job = pipeline.Job(pipeline.scheduled(spark, lambda: done.append(1), "1 second"))
    end = time.time() + 60
    while not done and time.time() < end:
        time.sleep(0.2)
    job.stop()
    assert done and job.status()["state"] == "stopped"


def test_hot_ids_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    raws = [(1, "quiet correlation_id=abcdef01"), (2, "mimikatz correlation_id=abcdef01"), (3, "psexec correlation_id=abcdef01"), (4, "quiet session_id=12345678")]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"event_seq": i, "ts": "2025-01-01T00:00:00Z", "raw": r}) for i, r in raws))
    q = pipeline.hot_ids(pipeline.file_envelopes(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("hot").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert [tuple(r) for r in spark.table("hot").collect()] == [("abcdef01", 2)]


def test_models_assess_several_logs_per_call(spark):
    df = spark.createDataFrame([(i, "x" * 700 if i == 1 else f"log {i}") for i in range(8)], "event_seq bigint, raw string")

    def client():
        def answer(text, t):
            lines = text.split("\n")[1:]
            assert all(len(x) <= 604 for x in lines)
            return json.dumps({"assessments": [{"n": i + 1, "verdict": "benign", "severity": "low"} for i in range(len(lines))]}) if len(lines) > 2 else "no"

        return answer

    got = api.assess(df, client).collect()
    assert sorted((r.batch, r.n) for r in got if r.source == "llm") == [(0, i) for i in range(1, 7)]
    assert [(r.batch, r.source, r.error) for r in got if r.source != "llm"] == [(1, "fallback", "no_json")]
    assert {r.source for r in api.assess(df).collect()} == {"mock"}


def test_prompts_hold_controls_and_evidence(spark):
    found = normalise.normalise(spark.createDataFrame([(0, "sudo")], "event_seq int, raw string"))
    text = found.select(agents.prompt("risk_scorer", F.array(F.lit("Control 6")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.repeat(F.lit("e"), 500))).alias("p")).collect()[0].p
    body = json.loads(text.split("\n", 1)[1])
    assert body["retrieved_controls"] == ["Control 6"] and [len(x) for x in body["evidence"]] == [400] * 4


def test_probes_recent_ops_and_feeds(spark):
    calls: list[int] = []
    probe = sinks.Probe(lambda: calls.append(1) or spark.range(0), keep=100)
    assert probe() == probe() == (False, "empty") and len(calls) == 1
    assert sinks.Probe(lambda: spark.table("no_such_table"))()[1].startswith("error")
    assert {tuple(r) for r in api.health_table(spark, {"a": spark.range(1), "b": spark.range(0)}).collect()} == {("a", True, None), ("b", False, None)}
    found = api.analyze_batch(spark, ["mimikatz", "nothing"])
    assert [r.event_seq for r in api.recent(found).orderBy("event_seq").collect()] == [0, 1]
    assert {tuple(r) for r in found.select("event_seq", F.array_join("skipped_agents", ",")).collect()} == {(0, "compliance_mapper,remediation_generator,report_generator"), (1, "compliance_mapper,remediation_generator,report_generator")}
    times = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2)], "name string, value double, seq int")
    lines = {r.line for r in api.metrics_text(found, times).collect()}
    assert 'detections_total{rule="malware_execution"} 1' in lines and 'latency_ms{name="a",quantile="0.99"} 3.0' in lines
    assert {tuple(r) for r in api.intel_refresh(spark.createDataFrame([("ip", "A"), ("ip", "a"), ("ip", "")], "kind string, value string")).collect()} == {("ip", 1)}


def test_answers_are_read_whole_or_repaired(spark):
    texts = ['{"b": 1, "a": [true, null]}', '```json\n{"b": 1, "a": [true, null]}\n```', 'text {"a": "é"} end', '{"a": 1, "a": 2}', '{"a": [{"b": "c', "[1]", "no", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id bigint, raw string")
    got = {r.result_id: (r.value, r.error) for r in agents.repaired(df, "result_id", "raw").collect()}
    assert got[0] == got[1] == ('{"a":[true,null],"b":1}', None) and got[2] == ('{"a":"é"}', None) and got[3] == ('{"a":2}', None) and got[4] == ('{"a":[{"b":"c"}]}', None)
    assert [got[i] for i in (5, 6, 7, 8)] == [(None, "no_json"), (None, "no_json"), (None, "empty_response"), (None, "empty_response")]


@pytest.mark.parametrize(("block", "group"), [(2, 2), (3, 1), (100, 1000)])
def test_drain_order_does_not_depend_on_blocks(spark, block, group):
    rng = random.Random(6)
    rows = [(i, rng.choice(["HOT", "WARM", "COLD"])) for i in range(0, 90, 3)]
    want = {s: k for k, (s, _) in enumerate(sorted(rows, key=lambda r: (["HOT", "WARM", "COLD"].index(r[1]), r[0])), 1)}
    got = metrics.drain_order(spark.createDataFrame(rows, "event_seq bigint, lane string"), block=block, group=group)
    assert {r.event_seq: r.drain_pos for r in got.collect()} == want


def test_batch_modes(spark):
    raws = ["mimikatz", "nothing"]
    assert set(api.run_batch(spark, raws)) == {"findings"}
    got = api.run_batch(spark, raws, "pipeline")
    assert [r.rule for r in got["alerts"].collect()] == ["malware_execution"] and got["timeline"].count() == 4
    with pytest.raises(ValueError):
        api.run_batch(spark, raws, "other")
