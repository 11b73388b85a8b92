import json

from pyspark.sql import functions as F

from siftwarden import api
from siftwarden.operators import catalog, graphs, scoring
from siftwarden.sources import logs, sinks


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\nmore\n---\ntwo\n")
    (tmp_path / "b.txt").write_text("x\n\ny\nz\n")
    got = sorted(map(tuple, logs.blocks(spark, str(tmp_path)).collect()))
    assert got == [("a", 0, "one\nmore"), ("a", 1, "two"), ("b", 0, "x"), ("b", 1, "y\nz")]
    assert logs.files(spark, str(tmp_path)).count() == 2
    assert sorted(r.raw for r in logs.lines(spark, str(tmp_path / "b.txt")).collect()) == ["x", "y", "z"]


def test_labels_skip_broken_lines_and_keep_the_last(spark, tmp_path):
    rows = ['{"event_id": "A-1", "label": "benign"}', "broken", '{"label": "x"}', '{"event_id": "a1", "label": "malicious", "mitre_technique": "T1"}']
    (tmp_path / "labels.jsonl").write_text("\n".join(rows))
    assert [tuple(r) for r in logs.labels(spark, str(tmp_path / "labels.jsonl")).collect()] == [("a1", "malicious", "T1")]


def test_catalog_csv_and_json(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿SCF #,SCF Control,NIST CSF v2.0,CIS CSC v8.1,STRM Relationship,Strength Score\nA-1,x,"P-1\nP-2; P-3",6.8,,\nA-1,x,P-4,Control 6,Equal To,7.9\n ,y,Q,1,,bad\n')
    df = logs.catalog(spark, str(tmp_path / "c.csv"))
    walk = catalog.crosswalk(df)
    assert {(r.framework, r.ext_id, r.norm_id) for r in walk.collect()} == {("nist_csf", f"P-{i}", f"P-{i}") for i in range(1, 5)} | {("cis", "6.8", "6"), ("cis", "Control 6", "6")}
    controls = spark.createDataFrame([("Control 6",), ("Control 7",)], "control_id string")
    assert {r.ext_id for r in catalog.expanded(walk, controls).collect()} == {"P-1", "P-2", "P-3", "P-4"}
    assert catalog.relations(df).count() == 1
    (tmp_path / "c.json").write_text(json.dumps([{"SCF #": "A-1", "CIS\nCSC\nv8.1": ["1", "2.3"], "US\nHIPAA": "h"}]))
    assert {(r.framework, r.norm_id) for r in catalog.crosswalk(logs.catalog(spark, str(tmp_path / "c.json"))).collect()} == {("cis", "1"), ("cis", "2"), ("hipaa", "h")}


def test_bundles(spark, tmp_path):
    nodes = [{"id": "a", "type": "control", "label": "1"}, {"id": "a", "type": "asset", "label": "2"}, {"id": "b", "type": "control"}, None]
    doc = {"manifest": {"bundle_id": "x"}, "graph": {"nodes": nodes, "edges": [{"src": "b", "dst": "a", "rel": "R"}, None]}}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    df = logs.bundles(spark, str(tmp_path / "b.json"))
    assert {(r.id, r.type) for r in graphs.nodes(df).collect()} == {("a", "asset"), ("b", "control")}
    assert [tuple(r) for r in graphs.hops(df).collect()] == [("x", "b", "a", "asset")]
    assert set(api.bundle_status(df)) == {"counts", "sample", "hashes"}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("F-1", 1), ("F-1", 1), ("F-2", 2)], "finding_id string, v int")
    assert sinks.append_new(df, str(tmp_path / "t"), "finding_id") == 2
    assert sinks.append_new(df, str(tmp_path / "t"), "finding_id") == 0
    sinks.save_findings(df, str(tmp_path / "f"), str(tmp_path / "a"))
    sinks.save_findings(df.union(spark.createDataFrame([("F-3", 1)], df.schema)), str(tmp_path / "f"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3 and spark.read.parquet(str(tmp_path / "f")).count() == 3


def test_backup_and_timeline(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    made = api.backup({"t": df}, str(tmp_path / "b"))
    assert made["verified"] and made["tables"]["t"]["rows"] == 2
    assert sinks.backups(spark, str(tmp_path / "b")).count() == 1
    assert sinks.digest(df.orderBy(F.desc("k"))) == sinks.digest(df)
    sinks.append_timeline(df, str(tmp_path / "tl"))
    assert spark.read.parquet(str(tmp_path / "tl")).where("day = '2025-01-01'").count() == 2


def test_other_surfaces(spark):
    assert {r.cve for r in api.scan(spark, "h").collect()} == {"CVE-2018-15473", "CVE-2020-1472", "CVE-2019-0708"}
    assert logs.newest_release(spark.createDataFrame([("r/2024.9/x",), ("r/2024.10/x",)], "path string")).collect()[0].path == "r/2024.10/x"
    assert api.health({"a": logs.samples(spark), "b": spark.range(0)}) == {"a": {"ok": True}, "b": {"ok": False}}
    assert sinks.corpus(spark).count() > 80 and sinks.graph_edges(spark).count() == 88
    found = api.analyze(logs.samples(spark).withColumn("event_seq", F.monotonically_increasing_id()))
    assert api.alerts(found).count() > 5 and api.timeline(found).count() == 10
    assert scoring.correlation_ids is not None
