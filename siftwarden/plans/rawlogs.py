"""Raw log lines and configuration snapshots derived from the star-schema tables.

The derivation is plain SQL that Spark and other engines read alike; what queries do with the
lines is written twice, in DataFrame operators and in each query's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwarden.sources.tables import table

#: (label, text). ``{ip}``, ``{user}``, ``{n}``, ``{corr}`` come from the event's columns.
TEMPLATES = [
    ("benign", "Accepted publickey for user{user} from {ip} port 22 sshd[{n}] login"),
    ("malicious", "Failed password for invalid user user{user} from {ip} sshd[{n}] correlation_id={corr}"),
    ("malicious", "eventName=CreateAccessKey eventSource=iam.amazonaws.com userName={user} sourceIPAddress={ip} session_id: {corr}"),
    ("malicious", "EventID 4688 powershell -enc AAAA mimikatz beacon to 203.0.113.55 user=user{user} correlation_id={corr}"),
    ("benign", "DHCP lease for unknown client {ip} granted by policy"),
    ("malicious", "suricata event_type alert ET MALWARE c2 checkin {ip} to 45.33.32.156 correlation_id={corr}"),
    ("benign_suspicious", "Nmap scan report for {ip}: OpenSSH 7.9 vulnerable to CVE-2018-15473"),
    ("malicious", "queries: info: client {ip} query data-exfil.base64encoded.attacker.com dns tunnel TXT query session_id={corr}"),
    ("benign", "type=SYSCALL auditd execve uid={user} checksum changed on /etc/shadow"),
    ("malicious", "okta eventType user.session.start outcome SUCCESS geo=RU username=user{user} from {ip} correlation_id={corr}"),
    ("malicious", "lateral movement via psexec from {ip} to 10.0.0.9 by acct user{user} correlation_id={corr}"),
    ("benign", "health check ok for node {n} in {user} ms"),
    ("benign", "GET /index.html 200 {n} bytes served by web{user}.corp"),
    ("malicious", "sudo: user{user} : privilege escalation to root; useradd backdoor correlation_id={corr}"),
    ("benign_suspicious", "phishing mail reported: clicked suspicious url http://malicious-domain.com/payload.sh by user{user}"),
    ("malicious", "S3 DeleteBucket backup-{n} deleted by contractor user{user} via storage.googleapis.com"),
    ("benign", "firewall ufw allow {ip} vpn tunnel config updated"),
    ("benign_suspicious", "WAF modsecurity blocked SQL injection and XSS from {ip} CVE-2024-3400"),
    ("benign", "penetration test: authorized scan by red team from {ip} within security assessment window"),
    ("benign", "certificate expired on {ip}; weak cipher sslv3 and default password found"),
    ("malicious", "new service was installed (7045) package encrypt.exe ransom note on host{user}.local correlation_id={corr}"),
    ("benign_suspicious", "sign-in of user{user}@corp.onmicrosoft.com result success mfa disabled conditional access"),
    ("malicious", "geo: CN authentication_failed for account name user{user} from {ip} correlationid={corr}"),
    ("benign", "id.orig_h={ip} zeek conn long-duration tls session intrusion detection quiet"),
]

_PARTS = {
    "ip": "concat('10.', CAST(event_id % 200 AS STRING), '.', CAST(user_id % 250 AS STRING), '.', CAST(event_id % 7 AS STRING))",
    "user": "CAST(user_id AS STRING)",
    "n": "CAST(event_id AS STRING)",
    "corr": "concat('abc', lpad(CAST(user_id % 97 AS STRING), 8, '0'))",
}


def _text(template: str) -> str:
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += ["'" + head.replace("'", "''") + "'", _PARTS[name]]
    return f"concat({', '.join([*out, chr(39) + rest.replace(chr(39), chr(39) * 2) + chr(39)])})"


_N = len(TEMPLATES)
_RAW = " ".join(f"WHEN {i} THEN {_text(t)}" for i, (_, t) in enumerate(TEMPLATES))
_LABEL = " ".join(f"WHEN {i} THEN '{label}'" for i, (label, _) in enumerate(TEMPLATES))
#: event_seq, ts, source, hint, raw, label over the view ``events``.
RAW_LOGS_SQL = f"""SELECT event_id AS event_seq, ts, event_type AS source,
  CASE WHEN event_id % 17 = 0 THEN 'vendor_hint' ELSE 'auto' END AS hint,
  CASE event_id % {_N} {_RAW} END AS raw, CASE event_id % {_N} {_LABEL} END AS label FROM events"""


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "events", spread=True).createOrReplaceTempView("events")
    out = spark.sql(RAW_LOGS_SQL)
    return out.withColumn("ts", out.ts.cast("timestamp"))


#: One configuration snapshot per supplier, as JSON built from key arithmetic; sections are
#: absent, empty or null for some.
SNAPSHOT_SQL = """SELECT s_suppkey AS snapshot_id, concat('{',
  CASE s_suppkey % 5 WHEN 0 THEN '"aws_account":{}' WHEN 1 THEN '"x":1' ELSE concat('"aws_account":{"root_mfa_enabled":', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END,
    ',"password_policy":{"min_length":', CAST(8 + s_suppkey % 12 AS STRING), '}}') END,
  CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',"iam_users":[]' ELSE concat(',"iam_users":[{"name":"u', CAST(s_suppkey AS STRING), '","mfa_enabled":', CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END, '},{"mfa_enabled":true}]') END,
  CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN ',"s3_buckets":[]' ELSE concat(',"s3_buckets":[{"name":"b","public":', CASE WHEN s_suppkey % 7 = 0 THEN 'true' ELSE 'false' END, ',"encrypted":', CASE WHEN s_suppkey % 4 = 2 THEN 'false' ELSE 'true' END, '}]') END,
  CASE s_suppkey % 3 WHEN 0 THEN '' ELSE concat(',"cloudtrail":{"enabled":', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END, '}') END,
  CASE s_suppkey % 5 WHEN 4 THEN '' ELSE concat(',"security_groups":[{"name":"g","open_ingress":[{"cidr":"', CASE WHEN s_suppkey % 3 = 1 THEN '0.0.0.0/0' ELSE '::/0' END, '","port":', CASE WHEN s_suppkey % 2 = 0 THEN '22' ELSE '443' END, '}]}]') END,
  CASE s_suppkey % 7 WHEN 0 THEN '' ELSE concat(',"tls_endpoints":[{"name":"t","min_version":', CASE s_suppkey % 4 WHEN 0 THEN '"1.10"' WHEN 1 THEN '"1.2"' WHEN 2 THEN 'null' ELSE '"1.3"' END, '},{"name":"u"', CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ',"min_version":"1.3"' END, '}]') END,
  CASE s_suppkey % 4 WHEN 3 THEN '' ELSE concat(',"backups":{"configured":', CASE WHEN s_suppkey % 5 = 1 THEN 'false' WHEN s_suppkey % 5 = 2 THEN 'null' ELSE 'true' END, '}') END,
  '}') AS snapshot FROM supplier"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(SNAPSHOT_SQL)
