import json
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwarden import agents, api
from siftwarden.functions.text import required_literals
from siftwarden.operators import metrics, normalise, policy, redaction, scoring, verdicts
from siftwarden.packs import frameworks, rules


def one(spark, raw, **options):
    return api.analyze_text(spark, raw, **options).collect()[0]


def test_required_literals_are_in_every_match():
    assert required_literals(r"\bdhcp\b|unknown[- ]?mac") == ("dhcp", "unknown")
    assert required_literals(r"a|bcd") is None
    for p in [*rules.CONTROL_KEYWORDS.values(), *rules.SIGNALS.values()]:
        assert required_literals(p)


@pytest.mark.parametrize(
    ("raw", "severity", "decided", "needs"),
    [
        ("Failed password for invalid user x from 1.2.3.4", "medium", "compliance_rule", False),
        ("Accepted publickey for x sudo 4625", "informational", "siem_rule", False),
        ("psexec lateral movement", "high", "llm", True),
        ("seen CVE-2024-3400 at host", "critical", "scan_engine", False),
        ("nothing to see", "low", "deterministic", False),
        ("geo: RU sign-in", "high", "siem_rule", False),
    ],
)
def test_verdicts(spark, raw, severity, decided, needs):
    r = one(spark, raw)
    assert (r.severity, r.decision.decided_by, r.mapping.needs_llm) == (severity, decided, needs)
    assert ("compliance_mapper" in r.agents) == needs and "report_generator" not in r.agents


def test_indicator_is_a_signal_and_hint_passes(spark):
    r = one(spark, "ping 203.0.113.55", hint="dhcp")
    assert r.signals.c2_or_exfil and r.log_type == "dhcp" and [tuple(h) for h in r.ioc_hits] == [("ip", "203.0.113.55")]
    assert one(spark, "x", chosen=["report_generator"]).agents == ["report_generator"]
    assert "report_generator" in one(spark, "mimikatz", narrative_from="high").agents


def test_null_and_empty_logs(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "event_seq bigint, raw string")
    rows = api.analyze(df).collect()
    assert [r.severity for r in rows] == ["low", "low"] and all(r.mapping.benign for r in rows)
    assert api.analyze(df.limit(0)).count() == 0


def test_scorer_interface(spark):
    found = api.analyze_batch(spark, ["psexec lateral movement", "useradd x"])
    mock = agents.run_agent(found, "compliance_mapper", "event_seq").collect()
    assert [(r.request_id, r.source) for r in mock] == [(0, "mock")]

    def client():
        return lambda text, t: "```json\n{\"control_ids\": [\"Control 13\", \"Control 99\"], \"nist_subcategories\": [\"XX\"]}\n```" if t > 0.12 else ""

    live = agents.run_agent(found, "compliance_mapper", "event_seq", client)
    r = live.select("source", agents.mapped_output(F.col("output")).alias("m")).collect()[0]
    assert r.source == "llm" and r.m.control_ids == ["Control 13"] and r.m.nist_subcategories == frameworks.CONTROL_NIST["Control 13"]
    scored = agents.run_agent(found, "risk_scorer", "event_seq").orderBy("request_id").collect()
    assert json.loads(scored[1].output)["severity"] == "high" and scored[1].source == "deterministic"
    assert agents.numbered_batches(found, "event_seq", "raw").count() == 1


@pytest.mark.parametrize(
    ("raw", "value", "error"),
    [
        ('{"a": 1}', {"a": 1}, None), ('```json\n{"a": 1}\n```', {"a": 1}, None), ('text {"a": [1, 2]} end', {"a": [1, 2]}, None), ('{"a": [{"b": "c', {"a": [{"b": "c"}]}, None),
        ("", {}, "empty_response"), (None, {}, "empty_response"), ("no", {}, "no_json"), ("[1]", {}, "no_json"),
    ],
)
def test_read_json(raw, value, error):
    assert agents.read_json(raw) == (value, error)


def test_failing_client_falls_back():
    def broken(text, t):
        raise OSError("down")

    assert agents.with_retries(broken, "x", wait=0) == ({}, "fallback", "", "down")


SECURE = {
    "aws_account": {"root_mfa_enabled": True, "password_policy": {"min_length": 14}}, "iam_users": [], "s3_buckets": [{"name": "a", "public": False, "encrypted": True}], "cloudtrail": {"enabled": True},
    "security_groups": [{"name": "g", "open_ingress": [{"cidr": "::/0", "port": 22}]}], "tls_endpoints": [{"name": "t", "min_version": None}], "backups": {"configured": True},
}


def statuses(spark, cfg):
    df = spark.createDataFrame([(1, cfg if isinstance(cfg, str | None) else json.dumps(cfg))], "snapshot_id int, snapshot string")
    return {r.check_id: (r.status, r.evidence) for r in api.config_scan(df)["findings"].collect()}


def test_config_checks(spark):
    assert {s for s, _ in statuses(spark, SECURE).values()} == {"pass"}
    bad = SECURE | {"iam_users": [{"mfa_enabled": True}, {"mfa_enabled": False}, {"name": "n"}], "tls_endpoints": [{"name": "old", "min_version": "1.10"}, {"name": "none"}], "security_groups": [{"open_ingress": [{"cidr": "0.0.0.0/0", "port": 3389}]}, {"name": "x"}]}
    got = statuses(spark, bad)
    assert got["CFG-IAM-MFA"] == ("fail", ["?", "n"]) and got["CFG-TLS-MIN"] == ("fail", ["old", "none"]) and got["CFG-NET-SSH"] == ("fail", ["?:3389"])
    for empty in ({}, "no json", None):
        assert {s for s, _ in statuses(spark, empty).values()} == {"na"}
    df = spark.createDataFrame([(1, "{}")], "snapshot_id int, snapshot string")
    assert policy.score(policy.evaluate(df)).collect()[0].score is None


@pytest.mark.parametrize("text", ["mail a@b.com a@b.com host x.corp 10.0.0.1 aa:bb:cc:dd:ee:ff fe80::1", "", "SSN 123-45-6789 at https://x.org/a 2024-01-02 (212) 555-0100", "é 1.2.3.4 and 11.2.3.4"])
def test_redaction_round_trip(spark, text):
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    r = api.redact(df, "k", "t", health_mode=True).withColumn("back", redaction.rehydrate(F.col("redacted"), F.col("tokens"))).orderBy("k").collect()
    assert r[0].back == text and r[1].redacted is None
    assert "@" not in r[0].redacted and "555-0100" not in r[0].redacted


def test_every_hundredth_vector_is_searched_against_all(spark, tmp_path):
    from siftwarden.plans.security import vector_floor, vector_topk

    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], i % 10) for i in range(250)]
    rows[7], rows[8], rows[9] = (7, [0.0] * 8, 7), (8, None, 8), (9, rows[100][1], 9)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = {r.vec_id: (r.embedding, r.label) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect() if r.embedding}

    def cosine(a, b):
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0

    top, floor = set(), set()
    for q in (0, 100, 200):
        best = sorted((-cosine(held[q][0], e), i) for i, (e, _) in held.items())[:35]
        top |= {(q, i, round(-s, 5)) for s, i in best}
        second = sorted(best, key=lambda x: (-(100 - held[x[1]][1] * 7 - x[1] % 5), x[1]))[:6]
        floor |= {(q, i, held[i][1]) for s, i in second if -s >= 0.1}
    assert {(r.query_id, r.vec_id, r.similarity) for r in vector_topk(spark, str(tmp_path)).collect()} == top
    assert {tuple(r) for r in vector_floor(spark, str(tmp_path)).collect()} == floor


def test_queue_depth_counts_every_event(spark, data):
    from siftwarden.plans.rawlogs import raw_logs
    from siftwarden.plans.security import queue_depth

    def lane(raw):
        return next((n for n, p in rules.LANES.items() if re.search(p, raw, re.I)), "COLD")

    queue = {}
    for r in raw_logs(spark, data).select("raw").collect():
        queue[lane(r.raw)] = queue.get(lane(r.raw), 0) + 1
    assert {r.lane: r.pending for r in queue_depth(spark, data).collect()} == queue
    assert sum(queue.values()) == spark.read.parquet(f"{data}/events.parquet").count()


def test_redaction_counts_every_kind(spark, tmp_path):
    from siftwarden.plans.security import redaction_counts

    texts = ["a@b.com a@b.com c@d.org at x.corp", "aa:bb:cc:dd:ee:ff fe80::1 10.0.0.1 10.0.0.2 y.corp", "sk-abcdefgh12 AKIAABCDEFGHIJKL z.local", "", None, "x.corp"]
    want = {"EMAIL": 2, "HOST": 4, "MAC": 1, "IPV6": 1, "IPV4": 2, "SECRET": 2}
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.kind: r.n for r in redaction_counts(spark, str(tmp_path)).collect()} == want
    brute = {}
    for t in texts:
        own, rest = set(), t or ""
        for kind, pattern in rules.REDACTION:
            own |= {(kind, v) for v in re.findall(pattern, rest)}
            rest = re.sub(pattern, "", rest)
        for kind, _ in own:
            brute[kind] = brute.get(kind, 0) + 1
    assert brute == want


def test_a_value_keeps_its_first_placeholder():
    t = redaction.Tokenizer([])
    assert t.token("root", "USER") == t.token("root", "HOST") == "{USER_001}"


def test_verdict_cache_against_a_plain_fold(spark):
    start = datetime(2025, 1, 1)
    hours = [0, 1, 24, 24.5, 25, 47, 49, 49, 100, 124, 124.1]
    rows = [(i, start + timedelta(hours=h), "s") for i, h in enumerate(hours)] + [(50, start, "t")]
    got = {r.event_seq: (r.leader_seq, r.is_hit) for r in verdicts.cached(spark.createDataFrame(rows, "event_seq bigint, ts timestamp, shape string")).collect()}
    want, leader = {50: (50, False)}, None
    for i, h in enumerate(hours):
        if leader is None or h > hours[leader] + 24:
            leader = i
        want[i] = (leader, leader != i)
    assert got == want


def test_links_and_outcomes(spark):
    rows = [(1, "malicious", True, ["a", "b"]), (2, "malicious", False, ["b"]), (3, "benign", False, ["c"]), (4, "malicious", False, []), (5, "benign_suspicious", False, ["a", "a"])]
    got = scoring.linked(spark.createDataFrame(rows, "event_seq bigint, label string, alerted boolean, corr array<string>"))
    assert {r.event_seq for r in got.where("via_corr").collect()} == {2, 5}
    o = scoring.outcomes(got).collect()[0]
    assert (o.tp, o.fn, o.fp, o.tn, o.sus_alert, o.recall, o.recall_single) == (2, 1, 0, 1, 1, 0.67, 0.33)


def test_event_ids(spark):
    guid = "0F8FAD5B-D9CB-469F-A165-70867728950E"
    texts = [f'{{"id": "x-{guid}"}}', f'{{"event_id": 5, "auditID": "{guid}"}}', f"a {guid} b", "ab" * 16, "none", '{"id": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(scoring.event_id(F.col("t"))).collect()]
    bare = guid.lower().replace("-", "")
    assert got == [bare, bare, bare, "ab" * 16, None, None]


def test_drain_order_and_saturation(spark):
    df = spark.createDataFrame([(1, "COLD"), (2, "HOT"), (3, "WARM"), (4, "HOT"), (5, "COLD")], "event_seq bigint, lane string")
    assert [r.event_seq for r in metrics.drain_order(df, block=2).orderBy("drain_pos").collect()] == [2, 4, 3, 1, 5]
    levels = spark.createDataFrame([(1, 10.0), (2, 18.0), (4, 19.0), (8, 25.0)], "level int, rate double")
    assert tuple(metrics.saturation(levels).collect()[0]) == (8, 25.0, 4)


def test_severity_helpers(spark):
    df = spark.createDataFrame([("HIGH ", "140"), ("odd", "x"), (None, None)], "s string, n string")
    assert [tuple(r) for r in df.select(normalise.clamped_severity(F.col("s")), normalise.clamped_score(F.col("n")), normalise.at_least(F.col("s"), "high")).collect()] == [("high", 100, True), ("medium", 0, True), ("medium", 0, None)]
