"""Configuration snapshots against policy checks.

A snapshot is a nested struct in which an absent section is null and an empty list is an empty
array; the difference decides between "not assessed" and "passed". The registry is data: an
id, title, control and severity, sentences, and a column that gives pass, fail or null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.operators import mapping

SNAPSHOT_SCHEMA = """aws_account struct<root_mfa_enabled boolean, password_policy struct<min_length int>>,
 iam_users array<struct<name string, mfa_enabled boolean>>, s3_buckets array<struct<name string, public boolean, encrypted boolean>>,
 cloudtrail struct<enabled boolean>, security_groups array<struct<name string, open_ingress array<struct<cidr string, port int>>>>,
 tls_endpoints array<struct<name string, min_version string>>, backups struct<configured boolean>"""
PASS, FAIL, NA = "pass", "fail", "na"


def _names(rows: Column, bad) -> Column:
    return F.transform(F.filter(rows, bad), lambda x: F.coalesce(x["name"], F.lit("?")))


def _none_bad(section: str, bad) -> tuple[Column, Column]:
    """Fails where a list has bad items; the evidence is their names."""
    rows = F.col(f"cfg.{section}")
    names = _names(rows, bad)
    return F.when(rows.isNotNull(), F.size(names) == 0), names


def _flag(path: str) -> tuple[Column, Column]:
    """A value that counts by its truth: absent is not assessed, null is false."""
    held = F.try_variant_get(F.col("doc"), f"$.{path}", "variant")
    word = F.to_json(held)
    return F.when(held.isNotNull(), ~word.isin(*_FALSE)), F.array(word)


#: JSON texts of values that count as false.
_FALSE = ("false", "null", "0", "0.0", '""', "[]", "{}")


def _weak_endpoints(text: Column) -> tuple[Column, Column]:
    """TLS versions compare as strings; an explicit null passes, a missing one fails."""
    listed = F.from_json(F.get_json_object(text, "$.tls_endpoints"), "array<map<string,string>>")
    bad = F.filter(listed, lambda e: (~F.map_contains_key(e, "min_version")) | (F.coalesce(e["min_version"], F.lit("None")) < "1.2"))
    return F.when(listed.isNotNull(), F.size(bad) == 0), F.transform(bad, lambda e: F.coalesce(e["name"], F.lit("?")))


def _open_admin() -> tuple[Column, Column]:
    groups = F.col("cfg.security_groups")
    spots = F.flatten(F.transform(groups, lambda g: F.transform(F.filter(F.coalesce(g["open_ingress"], F.array().cast("array<struct<cidr:string,port:int>>")), lambda r: (r["cidr"] == "0.0.0.0/0") & r["port"].isin(22, 3389)), lambda r: F.concat(F.coalesce(g["name"], F.lit("?")), F.lit(":"), r["port"].cast("string")))))
    return F.when(groups.isNotNull(), F.size(spots) == 0), spots


# What a check says when it was not assessed, passed and failed. {n} is the number of
# list items, {v} the value, {l} the list of names.
SENTENCES = {
    "CFG-ROOT-MFA": ("no aws_account.root_mfa_enabled in snapshot", "root_mfa_enabled={v}", "root_mfa_enabled={v}"),
    "CFG-IAM-MFA": ("no iam_users in snapshot", "all {n} users have MFA", "users without MFA: {l}"),
    "CFG-PW-LEN": ("no password_policy.min_length", "min_length={v} (require >=14)", "min_length={v} (require >=14)"),
    "CFG-S3-PUBLIC": ("no s3_buckets in snapshot", "{n} buckets non-public", "public buckets: {l}"),
    "CFG-S3-ENC": ("no s3_buckets in snapshot", "{n} buckets encrypted", "unencrypted buckets: {l}"),
    "CFG-AUDIT-LOG": ("no cloudtrail.enabled", "cloudtrail.enabled={v}", "cloudtrail.enabled={v}"),
    "CFG-NET-SSH": ("no security_groups in snapshot", "no world-open SSH/RDP", "world-open admin ports: {l}"),
    "CFG-TLS-MIN": ("no tls_endpoints in snapshot", "all endpoints TLS>=1.2", "weak TLS endpoints: {l}"),
    "CFG-BACKUP": ("no backups.configured", "backups.configured={v}", "backups.configured={v}"),
}
# Id, title, control, severity of each check.
CHECKS = [
    ("CFG-ROOT-MFA", "Root account uses MFA", "Control 6", "critical"),
    ("CFG-IAM-MFA", "All IAM users have MFA", "Control 6", "high"),
    ("CFG-PW-LEN", "Password policy >= 14 chars", "Control 5", "medium"),
    ("CFG-S3-PUBLIC", "No public object storage", "Control 3", "high"),
    ("CFG-S3-ENC", "Object storage encrypted at rest", "Control 3", "high"),
    ("CFG-AUDIT-LOG", "Audit logging (CloudTrail) enabled", "Control 8", "high"),
    ("CFG-NET-SSH", "No world-open SSH/RDP", "Control 12", "critical"),
    ("CFG-TLS-MIN", "TLS 1.2+ enforced", "Control 4", "medium"),
    ("CFG-BACKUP", "Backups configured", "Control 11", "high"),
]


def outcomes(text: Column) -> dict[str, tuple[Column, Column]]:
    """(passed or null, evidence) of each check."""
    false, length = F.lit(False), F.try_variant_get(F.col("doc"), "$.aws_account.password_policy.min_length", "variant")
    return {
        "CFG-ROOT-MFA": _flag("aws_account.root_mfa_enabled"),
        "CFG-IAM-MFA": _none_bad("iam_users", lambda u: ~F.coalesce(u["mfa_enabled"], false)),
        "CFG-PW-LEN": (F.when(length.isNotNull(), F.coalesce(F.col("cfg.aws_account.password_policy.min_length") >= 14, false)), F.array(F.to_json(length))),
        "CFG-S3-PUBLIC": _none_bad("s3_buckets", lambda b: F.coalesce(b["public"], false)),
        "CFG-S3-ENC": _none_bad("s3_buckets", lambda b: ~F.coalesce(b["encrypted"], false)),
        "CFG-AUDIT-LOG": _flag("cloudtrail.enabled"),
        "CFG-NET-SSH": _open_admin(),
        "CFG-TLS-MIN": _weak_endpoints(text),
        "CFG-BACKUP": _flag("backups.configured"),
    }


_SECTIONS = {"CFG-IAM-MFA": "iam_users", "CFG-S3-PUBLIC": "s3_buckets", "CFG-S3-ENC": "s3_buckets"}


def _sentence() -> Column:
    """A check's sentence from its id, status, evidence and number of items."""
    evidence, status = F.col("evidence"), F.col("status")
    word = F.get(evidence, F.lit(0))
    value = F.when(word == "true", "True").when(word == "false", "False").when(word == "null", "None").otherwise(F.regexp_replace(word, '^"|"$', ""))
    names = F.concat(F.lit("["), F.array_join(F.transform(evidence, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    def filled(sentence: str) -> Column:
        parts = [{"{n}": F.col("n_items").cast("string"), "{v}": value, "{l}": names}.get(x, F.lit(x)) for x in re.split(r"({[nvl]})", sentence) if x]
        return F.concat(*parts)

    out = F.lit(None).cast("string")
    for check, (absent, passed, failed) in SENTENCES.items():
        out = F.when(F.col("check_id") == check, F.when(status == NA, absent).when(status == PASS, filled(passed)).otherwise(filled(failed))).otherwise(out)
    return out


def evaluate(snapshots: DataFrame, key: str = "snapshot_id", text: str = "snapshot") -> DataFrame:
    """One row per snapshot and check: key, check_id, title, control_id, status, severity, evidence,
    evidence_text, frameworks (the control's ids by framework).

    Text that is no JSON object has every check not assessed. Sentences and frameworks are made
    after the checks are rows, so they cost nothing where nobody reads them.
    """
    parsed = snapshots.select(key, F.col(text).alias("_text"), F.from_json(text, SNAPSHOT_SCHEMA).alias("cfg"), F.try_parse_json(text).alias("doc"))
    rows = []
    found = outcomes(F.col("_text"))
    for check, title, control, severity in CHECKS:
        passed, evidence = found[check]
        status = F.when(passed.isNull(), NA).when(passed, PASS).otherwise(FAIL)
        count = F.size(f"cfg.{_SECTIONS[check]}") if check in _SECTIONS else F.lit(0)
        rows.append(
            F.struct(
                F.lit(check).alias("check_id"), F.lit(title).alias("title"), F.lit(control).alias("control_id"), status.alias("status"), F.when(status == FAIL, severity).otherwise("informational").alias("severity"),
                F.when(status == NA, F.array().cast("array<string>")).otherwise(evidence).alias("evidence"), count.alias("n_items"),
            )
        )
    out = parsed.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")
    return out.withColumns({"evidence_text": _sentence(), "frameworks": mapping.frameworks_of(F.array("control_id"))}).drop("n_items")


def posture(results: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Per control: fail before pass before na."""
    rank = F.when(F.col("status") == FAIL, 2).when(F.col("status") == PASS, 1).otherwise(0)
    return results.groupBy(key, "control_id").agg(F.max(rank).alias("r")).select(key, "control_id", F.element_at(F.array(F.lit(NA), F.lit(PASS), F.lit(FAIL)), F.col("r") + 1).alias("posture"))


def score(results: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Counts per snapshot, failed controls and pass / (pass + fail), null if none is assessed."""
    count = {s: F.count_if(F.col("status") == s) for s in (PASS, FAIL, NA)}
    failed = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == FAIL, F.col("control_id")))), ",")
    return results.groupBy(key).agg(*(c.alias(f"n_{s}") for s, c in count.items()), F.count(F.lit(1)).alias("n_total"), F.bround(F.try_divide(count[PASS], count[PASS] + count[FAIL]), 3).alias("score"), failed.alias("failed_controls"))
