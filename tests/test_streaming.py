import json
import time
from datetime import datetime, timedelta

from siftwarden.streaming import pipeline


def feed(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))


def envelope(n, raw, hours=0.0):
    at = datetime(2025, 1, 1) + timedelta(hours=hours)
    return {"event_seq": n, "ts": at.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "source": "s", "hint": "auto", "raw": raw}


def test_fan_out(spark, tmp_path):
    feed(tmp_path / "in", [envelope(1, "nothing"), envelope(2, "mimikatz beacon"), envelope(3, "login policy")])
    got = {}
    sinks = {name: (lambda df, epoch, name=name: got.setdefault(name, []).extend(df.collect())) for name in ("findings", "alerts", "timeline")}
    query = pipeline.run_pipeline(pipeline.file_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "cp"), sinks)
    query.awaitTermination(120)
    assert [r.lane for r in got["findings"]] == ["HOT", "WARM", "COLD"]
    assert {r.rule for r in got["alerts"]} == {"malware_execution"} and len(got["timeline"]) == 3


def test_redelivered_envelopes_and_lanes(spark, tmp_path):
    feed(tmp_path / "in", [envelope(1, "sudo"), envelope(1, "sudo"), envelope(2, "x", 30), envelope(3, "y", 60)])
    stream = pipeline.deduplicated(pipeline.file_envelopes(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 3
    lanes = pipeline.lane_counts(pipeline.file_envelopes(spark, str(tmp_path / "in")))
    q = lanes.writeStream.format("memory").queryName("lanes").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.lane, r.n) for r in spark.table("lanes").collect()} == {("HOT", 2), ("COLD", 1)}


def test_verdict_cache_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    feed(tmp_path / "in", [envelope(1, "sudo a"), envelope(2, "sudo b", 1), envelope(3, "sudo c", 25)])
    out = pipeline.cached_verdicts(pipeline.file_envelopes(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("cache").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    # State that expires by processing time keeps the query alive; it is stopped when all is out.
    end = time.monotonic() + 180
    while spark.table("cache").count() < 3 and time.monotonic() < end:
        time.sleep(0.5)
    q.stop()
    assert {(r.event_seq, r.leader_seq, r.is_hit) for r in spark.table("cache").collect()} == {(1, 1, False), (2, 1, True), (3, 3, False)}
