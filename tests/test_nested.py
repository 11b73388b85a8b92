import json
import time

from siftwarden.operators import nested

SCHEMA = "finding_id string, finding string, agents string, verdict string, dal string, ordinal bigint"


def paths(spark, **columns):
    row = ("F", *(columns.get(c) for c in ("finding", "agents", "verdict", "dal")), 1)
    df = spark.createDataFrame([row, row], SCHEMA)
    return {r.row_path for r in nested.objects(nested.triples(df)).collect()}


def test_shapes_that_mean_the_same(spark):
    steps = [{"order": 1, "substeps": {"0": {"n": 1}, "1": None, "2": {}}}, None, 5, {"substeps": {"n": 7}}]
    agents = [{"output": json.dumps({"steps": json.dumps(steps)})}, None, {"output": {"steps": {"order": 9}}}]
    want = {"agents[0]", "agents[2]", "agents[0].output.steps[0]", "agents[0].output.steps[3]", "agents[2].output.steps[0]"}
    want |= {"agents[0].output.steps[0].substeps[0]", "agents[0].output.steps[0].substeps[2]", "agents[0].output.steps[3].substeps[0]"}
    assert paths(spark, agents=json.dumps(agents)) == want
    assert paths(spark, agents=json.dumps(json.dumps(agents))) == want
    assert paths(spark, agents=json.dumps({"agent": "x"})) == {"agents[0]"}


def test_incomplete_and_null_documents(spark):
    whole = json.dumps({"tokens": [{"kind": "A"}]})
    assert paths(spark, dal=whole[:-1]) == set()
    assert paths(spark, dal=whole + "x") == set()
    for empty in (None, "", "null", "[]", "3", '"x"', "{}", '{"tokens": null}', '{"tokens": "abc"}', '{"tokens": NaN}'):
        assert paths(spark, dal=empty) == set()
    assert paths(spark, dal="[" * 200_000) == set()


def test_depth_is_no_limit(spark):
    n = 100_000
    deep = '{"tokens": [{"kind": ' + "[" * n + "]" * n + ', "a": ' + '{"b": ' * n + "1" + "}" * n + "}]}"
    df = spark.createDataFrame([("F", None, None, None, deep, 1)], SCHEMA)
    began = time.perf_counter()
    got = {r.field: r.value for r in nested.triples(df).collect()}
    assert time.perf_counter() - began < 20
    assert got["kind"] == "[" * n + "]" * n and got["a." + ".".join(["b"] * n)] == "1"


def test_documents_that_differ_do_not_mix(spark):
    docs = [("F", "a", 2), ("F", "b", 1), (None, "ip", 1), (None, "dns", 2), (None, "dns", 2)]
    df = spark.createDataFrame([(k, None, None, None, json.dumps({"tokens": [{"kind": t, "n": v}]}), 1) for k, t, v in docs], SCHEMA)
    got = nested.pivoted(nested.triples(df), "dal.tokens", ["kind", "n"]).collect()
    assert sorted(((r.record_id, r.kind, r.n) for r in got), key=str) == sorted({(k, t, str(v)) for k, t, v in docs}, key=str)


def test_half_surrogate_pairs(spark):
    df = spark.createDataFrame([("F", None, None, None, '{"tokens": [{"a\\ud800": "x\\udfff", "n": 1}]}', 1)], SCHEMA)
    assert {(r.field, r.value) for r in nested.triples(df).where("field is not null").collect()} == {("a\ufffd", "x\ufffd"), ("n", "1")}


def test_deep_lists_and_long_texts(spark):
    evidence = [{"control_id": "x" * 100_000, "nist": [{"id": str(i)} for i in range(50)]}]
    assert len(paths(spark, verdict=json.dumps({"evidence": evidence}))) == 51


def test_pivot_keeps_parent_and_position(spark):
    doc = json.dumps({"intel": {"ioc_hits": [{"type": "ip", "feed": {"name": "n"}, "ordinal": 4, "sightings": [{"ts": "t"}]}, {"type": None}]}})
    df = spark.createDataFrame([("F", doc, None, None, None, 1), (None, doc, None, None, None, 1)], SCHEMA)
    t = nested.triples(df)
    hits = nested.pivoted(t, "finding.intel.ioc_hits", ["type", "feed.name", "ordinal"]).where("record_id = 'F'").orderBy("ordinal").collect()
    assert [(r.row_path, r.parent_path, r.ordinal, r.type, r.feed_name, r.f_ordinal) for r in hits] == [("finding.intel.ioc_hits[0]", "finding", 0, "ip", "n", "4"), ("finding.intel.ioc_hits[1]", "finding", 1, None, None, None)]
    seen = nested.pivoted(t, "finding.intel.ioc_hits.sightings", ["ts"]).where("record_id is null").collect()
    assert [(r.parent_path, r.ts) for r in seen] == [("finding.intel.ioc_hits[0]", "t")]
    assert nested.objects(nested.triples(df.limit(0))).count() == 0


def test_flat_tables_have_roots_and_every_field(spark, tmp_path):
    from siftwarden.plans.records import FLAT_TABLES

    finding = {"log_type": "web", "signals": {"malware": True}, "new": {"deep": 1}, "intel": {"ioc_hits": [{"value": "v", "Value": "w", "value_2": "x", "first.seen": "d"}]}}
    agents = [{"agent": "a", "output": {"severity": "high", "control_ids": ["C1"], "odd": None, "steps": [{"order": 1, "owner": "o"}]}}, {"ordinal": 7}]
    verdict = {"severity": "low", "decision": {"by": "r"}, "evidence": [{"control_id": "C"}]}
    dal = {"redacted_count": 2, "by_kind": {"IP": 1}, "tokens": [{"kind": "IP"}]}
    row = ("F", *map(json.dumps, (finding, agents, verdict, dal)), 1)
    spark.createDataFrame([row, row], SCHEMA).write.parquet(f"{tmp_path}/mvp_findings.parquet")
    got = {n: [r.asDict() for r in FLAT_TABLES[n](spark, str(tmp_path)).orderBy("row_path").collect()] for n in FLAT_TABLES}
    f, v, d = (got[n][0] for n in ("p3_findings", "p3_verdicts", "p3_dal"))
    assert (f["row_path"], f["log_type"], f["signals_malware"], f["new_deep"], f["summary"]) == ("finding", "web", "true", "1", None)
    assert (v["row_path"], v["severity"], v["decision_by"], v["decision_engine_name"]) == ("verdict", "low", "r", None)
    assert (d["row_path"], d["redacted_count"], d["by_kind_IP"]) == ("dal", "2", "1")
    a, b = got["p3_agents"]
    assert (a["output_severity"], a["output_control_ids"], a["output_odd"], b["f_ordinal"], b["agent"]) == ("high", '["C1"]', None, "7", None)
    assert got["p3_steps"][0]["owner"] == "o"
    assert sorted(str(x) for k, x in got["p3_hits"][0].items() if k not in ("record_id", "row_path", "parent_path", "ordinal", "version")) == ["None", "None", "None", "d", "v", "w", "x"]
    roots = {r["row_path"] for n in ("p3_findings", "p3_verdicts", "p3_dal") for r in got[n]}
    assert {r["parent_path"] for n in ("p3_hits", "p3_evidence", "p3_tokens") for r in got[n]} <= roots
