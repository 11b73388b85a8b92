"""The event bus as streaming queries: envelopes in, findings, alerts and timeline out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftwarden.operators import mapping, normalise, scoring

ENVELOPE_SCHEMA = "event_seq bigint, ts timestamp, source string, hint string, raw string"
TTL_MS = 24 * 3600 * 1000


def file_envelopes(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENVELOPE_SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)


def kafka_envelopes(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """JSON messages of a topic; offsets live in the query's checkpoint, not in a group."""
    read = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
    return read.select(F.from_json(F.col("value").cast("string"), ENVELOPE_SCHEMA).alias("e")).select("e.*")


def wrapped(messages: DataFrame, source: str = "vector") -> DataFrame:
    """Bare messages (a column ``value``) as envelopes of the WARM lane."""
    return messages.select(F.col("value").cast("string").alias("raw"), F.lit(source).alias("source"), F.lit("raw.WARM").alias("lane")).where("raw is not null")


def to_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Rows as JSON messages of a topic, acknowledged by all replicas; a stream needs a checkpoint."""
    body = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
    if rows.isStreaming:
        return body.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint or "").start()
    body.write.format("kafka").options(**options).save()
    return None


def deduplicated(envelopes: DataFrame, within: str = "1 hour") -> DataFrame:
    """Redelivered envelopes are dropped while their state lasts."""
    return envelopes.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_seq"])


def lane_counts(envelopes: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    lanes = envelopes.withWatermark("ts", late).withColumn("lane", normalise.lane(F.lower("raw")))
    return lanes.groupBy(F.window("ts", window), "lane").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "lane", "n")


def normalised(envelopes: DataFrame) -> DataFrame:
    return normalise.normalise(envelopes, "hint")


def run_pipeline(envelopes: DataFrame, checkpoint: str, sinks: dict[str, Callable[[DataFrame, int], None]], available_now: bool = True, feed: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Fans each micro-batch out to the sinks ``findings``, ``alerts``, ``timeline``, ``verdicts``
    and, with a ``feed``, ``intel``.

    The batch is normalised once and kept while the sinks read it. ``feed`` gives the indicators
    (kind, value); it is called anew for each batch, so a feed that was replaced takes effect with
    the next one. Each sink runs apart: one that fails is reported after the others have run, and
    the batch is tried again; sinks that had succeeded are not called again for that batch.
    """
    done: set[tuple[int, str]] = set()

    def each(batch: DataFrame, epoch: int) -> None:
        found = normalised(batch).withColumn("lane_rank", normalise.lane_rank(F.col("lane"))).persist()
        s = normalise.severity_score()
        views = {
            "findings": lambda: found.orderBy("lane_rank", "event_seq"),
            "alerts": lambda: normalise.alerts(found, "event_seq", "ts"),
            "timeline": lambda: found.select("event_seq", "ts", "log_type", s["severity"].alias("severity")),
            "verdicts": lambda: mapping.resolve(found).select("event_seq", "ts", s["severity"].alias("severity"), s["risk_score"].alias("risk_score"), normalise.is_anomaly().alias("is_anomaly"), mapping.decision().alias("decision"), "mapping"),
            "intel": lambda: normalise.enrich(found, feed(), "event_seq", "ts"),  # type: ignore[misc]
        }
        errors = []
        for name, sink in sinks.items():
            if (epoch, name) in done:
                continue
            try:
                sink(views[name](), epoch)
                done.add((epoch, name))
            except Exception as e:  # noqa: BLE001
                errors.append(f"{name}: {e}")
        found.unpersist()
        if errors:
            raise RuntimeError("; ".join(errors))
        done.difference_update({x for x in done if x[0] < epoch})

    writer = envelopes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def scheduled(spark: SparkSession, action: Callable[[], object], every: str = "24 hours") -> StreamingQuery:
    """Runs an action (a backup, a reload) now and then once per interval, until it is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, epoch: action() and None).trigger(processingTime=every).start()


class Job:
    """A running stream as a job: progress so far, failure, stop."""

    def __init__(self, query: StreamingQuery) -> None:
        self.query = query

    def status(self) -> dict:
        """State (running, stopped, done or failed), batches and rows so far, the error if any."""
        rows = sum(p.numInputRows for p in self.query.recentProgress)
        failed = self.query.exception()
        state = "running" if self.query.isActive else "failed" if failed else "stopped"
        return {"state": state, "batches": len(self.query.recentProgress), "rows": rows, "error": None if failed is None else str(failed)[:500]}

    def stop(self) -> None:
        self.query.stop()


class HotIds(StatefulProcessor):
    """Campaign ids: an id is hot from the first alerted event that carries it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        hot = self.since.exists()
        first = None
        for part in rows:
            alerted = part.loc[part["alerted"], "event_seq"]
            if not hot and len(alerted):
                first = int(alerted.min()) if first is None else min(first, int(alerted.min()))
        if first is not None:
            self.since.update((first,))
            yield pd.DataFrame([(key[0], first)], columns=["id", "since_seq"])

    def close(self) -> None:
        pass


def hot_ids(envelopes: DataFrame) -> DataFrame:
    """(id, since_seq) as a stream: each campaign id once, when it first becomes hot."""
    found = normalised(envelopes)
    alerted = normalise.severity_score()["severity"].isin("critical", "high") | normalise.is_anomaly()
    pairs = found.select("event_seq", alerted.alias("alerted"), F.explode(scoring.correlation_ids(F.col("raw"))).alias("id"))
    return pairs.groupBy("id").transformWithStateInPandas(HotIds(), "id string, since_seq bigint", "Append", "None")


class VerdictCache(StatefulProcessor):
    """One leader per shape for a day; its verdict serves the events that follow."""

    def __init__(self, ttl_ms: int = TTL_MS) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leader = handle.getValueState("leader", "seq bigint, at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        lead = self.leader.get() if self.leader.exists() else None
        seq, at = (lead[0], lead[1]) if lead else (None, None)
        # Parts of a micro-batch come in order of arrival; each is judged and given out on its own.
        for part in rows:
            out = []
            events = part.sort_values(["at", "event_seq"])
            for n, t in zip(events["event_seq"], events["at"], strict=True):
                hit = at is not None and t <= at + self.ttl_ms
                if not hit:
                    seq, at = int(n), int(t)
                out.append((key[0], int(n), seq, hit))
            yield pd.DataFrame(out, columns=["shape", "event_seq", "leader_seq", "is_hit"])
        self.leader.update((seq, at))

    def close(self) -> None:
        pass


def cached_verdicts(envelopes: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(shape, event_seq, leader_seq, is_hit) as a stream. State expires by processing time;
    events that arrive out of order are judged in order of arrival between batches, where the
    batch operator would order them all."""
    shaped = normalised(envelopes).select(mapping.verdict_shape().alias("shape"), "event_seq", F.unix_millis("ts").alias("at"))
    return shaped.groupBy("shape").transformWithStateInPandas(VerdictCache(ttl_ms), "shape string, event_seq bigint, leader_seq bigint, is_hit boolean", "Update", "ProcessingTime")
