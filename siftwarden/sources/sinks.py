"""Writers: idempotent appends, timeline, backups with manifests, reports, graph edges."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.operators.mapping import control_nist


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key is neither stored yet nor repeated in the batch; says how many.

    Only keys of the stored table are read, by an anti-join on the key.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    from pyspark.sql import Observation

    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def save_findings(rows: DataFrame, findings_path: str, audit_path: str) -> int:
    """Findings once per id, then an audit row for each stored finding that has none yet.

    Both steps compare with what is stored, so a run that broke between them is completed by
    the next one, and no audit row can name a finding that is not there. ``detail`` is the
    finding's log type and severity as JSON, where there are such columns.
    """
    spark = rows.sparkSession
    n = append_new(rows, findings_path, "finding_id")
    if not _exists(spark, findings_path):
        return n
    held = spark.read.parquet(findings_path)
    told = [c for c in ("log_type", "severity") if c in held.columns]
    detail = F.to_json(F.struct(*told)) if told else F.lit("{}")
    audit = held.select("finding_id", F.lit("analysis_completed").alias("event"), F.current_timestamp().alias("ts"), detail.alias("detail"))
    if _exists(spark, audit_path):
        known = spark.read.parquet(audit_path).where("event = 'analysis_completed'").select("finding_id")
        audit = audit.join(known, "finding_id", "left_anti")
    audit.write.mode("append").parquet(audit_path)
    return n


def append_timeline(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends by day, sorted by time inside files so that readers can skip row groups. Rows are
    dealt out by ranges of time, so a day that holds most of them goes to many tasks."""
    rows.withColumn("day", F.to_date(ts)).repartitionByRange("day", ts).sortWithinPartitions("day", ts).write.mode("append").partitionBy("day").parquet(path)


def graph_edges(spark: SparkSession) -> DataFrame:
    """The built-in crosswalk as edges: (src, dst, rel)."""
    return control_nist(spark).select(F.col("control_id").alias("src"), F.col("nist_id").alias("dst"), F.lit("MAPS_TO").alias("rel"))


def corpus(spark: SparkSession, embeddings: DataFrame | None = None) -> DataFrame:
    """Control texts for the vector store: (id, framework, control_id, section, content), with
    ``embedding`` joined where given as (id, embedding)."""
    from siftwarden.packs import frameworks

    rows = [(f"cis:{c}", "cis_v8", c, None, t) for c, t in frameworks.CONTROLS.items()] + [(f"hipaa:{s}", "hipaa", None, s, t) for s, t in frameworks.HIPAA.items()]
    nist = sorted({n for ns in [*frameworks.CONTROL_NIST.values(), *frameworks.HIPAA_NIST.values()] for n in ns})
    rows += [(f"nist:{n}", "nist_csf", None, n, n) for n in nist]
    df = spark.createDataFrame(rows, "id string, framework string, control_id string, section string, content string")
    return df if embeddings is None else df.join(embeddings, "id", "left")


def digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free hash of all rows, by one aggregation."""
    content = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    halves = [F.conv(F.substring(content, a, 12), 16, 10).cast("decimal(38,0)") for a in (1, 13, 25)]
    n, *sums = rows.select(*(h.alias(f"h{i}") for i, h in enumerate(halves))).agg(F.count(F.lit(1)), *(F.coalesce(F.sum(f"h{i}"), F.lit(0)) for i in range(3))).first()
    return n, hashlib.sha256("|".join(map(str, [n, *sums])).encode()).hexdigest()


def backup(tables: dict[str, DataFrame], path: str) -> dict:
    """Writes tables and a manifest with their hashes, reads them again and verifies."""
    spark = next(iter(tables.values())).sparkSession
    name = f"backup-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{uuid.uuid4().hex[:6]}"
    manifest = {"backup_id": name, "tables": {}, "verified": True}
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/{t}")
        n, sha = digest(df)
        again = digest(spark.read.parquet(f"{path}/{name}/{t}"))
        manifest["tables"][t] = {"rows": n, "sha256": sha}
        manifest["verified"] &= again == (n, sha)
    spark.createDataFrame([(name, json.dumps(manifest, sort_keys=True))], "backup_id string, manifest string").coalesce(1).write.mode("append").json(f"{path}/manifests")
    return manifest


def backups(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, newest first."""
    return spark.read.schema("backup_id string, manifest string").json(f"{path}/manifests").orderBy(F.desc("backup_id"))


def report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def non_empty(df: DataFrame) -> bool:
    """Availability probe of a store: whether it has a row."""
    return not df.isEmpty()


class Probe:
    """Whether a store can answer, with the reason where it cannot; asked again after ``keep`` seconds."""

    def __init__(self, store: Callable[[], DataFrame], keep: float = 60.0) -> None:
        self.store, self.keep = store, keep
        self._at, self._held = 0.0, (False, "not asked")

    def __call__(self) -> tuple[bool, str]:
        if not self._at or time.monotonic() - self._at > self.keep:
            try:
                self._held = (True, "ok") if non_empty(self.store()) else (False, "empty")
            except Exception as e:  # noqa: BLE001
                self._held = (False, f"error: {str(e)[:200]}")
            self._at = time.monotonic()
        return self._held


def jdbc_append(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends to a relational store where a driver is at hand."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
