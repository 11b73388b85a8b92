"""Readers of logs, labels, gold sets, catalogs and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_SCHEMA = "id string, log_type string, raw string, controls array<string>, note string"
LABEL_SCHEMA = "event_id string, label string, mitre_technique string, _corrupt_record string"
BUNDLE_SCHEMA = """manifest struct<bundle_id string, tenant_id string, version string, schema_version string, created_at string, frameworks array<string>, node_count int, edge_count int, graph_sha256 string, signature string>,
 graph struct<nodes array<struct<id string, type string, label string, framework string, props map<string,string>>>, edges array<struct<src string, dst string, rel string>>>"""


def single(spark: SparkSession, raw: str, hint: str = "auto") -> DataFrame:
    """One log text as a one-row frame for the same pipeline."""
    return batch(spark, [raw], hint)


def batch(spark: SparkSession, raws: list[str], hint: str = "auto") -> DataFrame:
    return spark.createDataFrame([(i, r, hint) for i, r in enumerate(raws)], "event_seq bigint, raw string, hint string")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Text files into logs: split at lines of ``---``, else at blank lines. (source, pos, raw).

    Each file is one value, so this is for many files of moderate size; line-oriented logs
    of any size are read by ``lines``.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("source"), F.col("value"))
    cut = F.when(F.col("value").rlike(r"(?m)^---\s*$"), F.split("value", r"(?m)^---\s*$")).otherwise(F.split("value", r"\r?\n[ \t]*\r?\n"))
    parts = F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return whole.select("source", F.posexplode(parts).alias("pos", "raw"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """One log per file: (source, raw)."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("source"), F.col("value").alias("raw"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One log per line that is not blank: (source, raw); source is the file's stem."""
    read = spark.read.text(path).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("source"), F.col("value").alias("raw"))
    return read.where(F.trim("raw") != "")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, label, mitre_technique) of JSON lines; broken lines and those without an id
    are left out, the last line of an id counts. Ids keep hex digits only."""
    read = spark.read.schema(LABEL_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    kept = read.where("_corrupt_record is null and event_id is not null").withColumn("_k", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    norm = F.regexp_replace(F.lower("event_id"), "[^0-9a-f]", "")
    last = kept.groupBy(norm.alias("event_id")).agg(F.max_by(F.struct("label", "mitre_technique"), "_k").alias("x"))
    return last.select("event_id", "x.label", "x.mitre_technique")


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).json(path).where("id is not null")


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalog with a header line, quoted cells over several lines, byte-order mark or not."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """A catalog as a JSON list of records; list cells are joined to lines."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(*(F.concat_ws("\n", F.col(f"`{c}`")).alias(c) if t.startswith("array") else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_json(spark, path) if path.lower().endswith(".json") else catalog_csv(spark, path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).json(path)


def newest_release(paths: DataFrame) -> DataFrame:
    """The path with the greatest version numbers, compared as numbers."""
    parts = F.transform(F.regexp_extract_all("path", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    return paths.orderBy(F.desc(parts), "path").limit(1)


SAMPLES = [
    ("ssh_login", "Jan  2 10:00:00 host1 sshd[7]: Accepted publickey for deploy from 10.1.2.3 port 22"),
    ("ssh_guess", "Jan  2 10:00:01 host1 sshd[7]: Failed password for invalid user admin from 203.0.113.55 port 22"),
    ("cloud_key", '{"eventSource": "iam.amazonaws.com", "eventName": "CreateAccessKey", "userName": "ops"}'),
    ("ids_alert", '{"event_type": "alert", "signature_id": 1, "msg": "ET MALWARE c2 checkin"}'),
    ("dns_tunnel", "queries: info: client 10.0.0.9 query data-exfil.base64encoded.attacker.com TXT"),
    ("port_scan", "Nmap scan report for 10.0.0.7\n22/tcp open OpenSSH 7.9\nCVE-2018-15473"),
    ("audit", "type=SYSCALL msg=audit(1): auditd execve /etc/shadow integrity changed"),
    ("directory", "EventID 4720 new user, EventID 4732 group administrators"),
    ("backup", "nightly backup finished in 41 s"),
    ("web", "GET /healthz 200"),
]


def samples(spark: SparkSession) -> DataFrame:
    """Short logs of several programs, for demonstrations: (name, raw)."""
    return spark.createDataFrame(SAMPLES, "name string, raw string")
