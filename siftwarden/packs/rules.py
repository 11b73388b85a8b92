"""Rules on raw log text.

All tables in this module are fixed values that results have to agree with. Patterns are
matched without anchors; ``\\b`` and character classes have Unicode meaning.
"""

from __future__ import annotations

#: Lanes by urgency; the first that matches wins, COLD has no pattern. Case does not count.
LANES = {
    "HOT": r"failed password|invalid user|4625|4720|4672|sudo|privilege|mimikatz|beacon|cobalt|ransom|malware|exploit|cve-|c2|backdoor|getsecretvalue|eternalblue",
    "WARM": r"accepted|login|connect|policy|config|firewall|deny|allow|dns|scan|createuser|add member",
}
LANE_ORDER = ["HOT", "WARM", "COLD"]

#: Log type by the first substring found in the lower-cased text.
LOG_TYPES = [
    ("aws_cloudtrail", ["amazonaws.com"]),
    ("gcp_audit", ["googleapis.com"]),
    ("azure_ad", ["onmicrosoft"]),
    ("okta", ["eventtype"]),
    ("windows_evtx", ["eventid"]),
    ("suricata", ["event_type"]),
    ("zeek", ["id.orig_h"]),
    ("nmap", ["nmap scan report"]),
    ("dns", ["queries: info"]),
    ("auditd", ["type=syscall"]),
    ("linux_auth_syslog", ["sshd[", "sudo["]),
]
DEFAULT_LOG_TYPE = "generic"

#: Controls suggested by keywords, on lower-cased text. Control 17 has none.
CONTROL_KEYWORDS = {
    "Control 1": r"\bdhcp\b|\brogue\b|unknown[- ]?mac|unauthorized device|unknown client",
    "Control 2": r"\b7045\b|new service was installed|service installed|unauthorized software|unknown executable|installutil|new service|apt[\- ]?(get )?install|\bdpkg\b|yum install|package",
    "Control 3": r"getsecretvalue|getsecret|\bexfil|exfiltrat|sensitive (data|file|employee)|secretsmanager|credential dump|sekurlsa|redirectmessageto|auto[- ]?forward|\ballusers\b|publicly accessible",
    "Control 4": r"conditional access|legacy authentication|default password|certificate has expired|cert(ificate)? expired|misconfig|insecure config(uration)?|weak cipher|sslv3|policy.{0,20}disabled|disabled.{0,20}policy",
    "Control 5": r"\buseradd\b|net user .*\/add|createuser|create user|new[- ]?localuser|\b4720\b|\b4732\b|provision\.?user|add member to role|account created|\badduser\b|createserviceaccount|createaccesskey|service account|privilege\.grant|account\.privilege",
    "Control 6": r"\bsudo\b|privilege escalat|\bescalat|sebackup|\b4672\b|failed password|invalid user|accepted password|\b4625\b|\b4732\b|mfa.{0,20}(reset|deactivat|disabl|bypass|fail)|mfaused.{0,4}no|without mfa|no mfa|conditional access|roles/owner|global admin|super admin(istrator)?|administratoraccess|administrator access|attachuserpolicy|localgroup admin|group administrators|authorized_keys",
    "Control 7": r"\bcve-\d|\bnmap\b|vulnerab|\bexploit|\bvuln\b",
    "Control 8": r"\bauditd\b|\bexecve\b|\b4688\b|\b4698\b|integrity (checksum|changed)|checksum changed|type=syscall|/etc/shadow|audit log|auditctl",
    "Control 9": r"\bwget\b|\bcurl\b|malicious-domain|malware-c2|phishing|clicked .{0,30}(url|link)|\.ru\b|\bexfil|data-exfil|payload\.(sh|ps1)",
    "Control 10": r"mimikatz|\bbeacon\b|cobalt(strike)?|ransom|\.locked\b|encrypt\.exe|powershell\s+-?enc|powershell.{0,20}-enc|\bmalware\b|/payload\b|payload\.(sh|ps1|exe)",
    "Control 11": r"deletebucket|delete bucket|backup.{0,15}(delet|fail)|delet.{0,15}backup|snapshot delet|\bransom|no restore point|recovery (fail|point)",
    "Control 12": r"\bfirewall\b|\bufw\b|%asa|access-list|access-group|vpn (config|gateway|tunnel|policy)|network infrastructure",
    "Control 13": r"suricata|\bzeek\b|intrusion detection|intrusion prevention|\bids/ips\b|\bnids\b|\bbeacon\b|eternalblue|signature_id|et (exploit|malware|scan)|c2 checkin|command and control|dns tunnel|\bTXT\b query|long-duration",
    "Control 14": r"phishing|clicked .{0,30}(url|link|email)|social engineering|security awareness|awareness training",
    "Control 15": r"\biam\b|service account|gserviceaccount|createserviceaccount|consolelogin|\bcontractor\b",
    "Control 16": r"sql injection|\bsqli\b|modsecurity|\bwaf\b|remote code execution|\brce\b|\bxss\b|command injection|directory traversal",
    "Control 18": r"penetration test|\bpentest\b|red team|authorized scan|security assessment window",
}
#: Control named where no keyword matched.
FALLBACK_CONTROL = "Control 8"

#: Behavioural signals, on lower-cased text, in declared order.
SIGNALS = {
    "malware": r"mimikatz|\bbeacon\b|cobalt|ransom|encrypt\.exe|payload\.(sh|ps1|exe)|\bmalware\b|powershell\s+-?enc",
    "c2_or_exfil": r"\bc2\b|command and control|\bexfil|exfiltrat|getsecretvalue|/stage2|malicious-domain|malware-c2|filedownloaded|data-exfil",
    "privilege_escalation": r"\bsudo\b|privilege escalat|\bescalat|sebackup|\b4672\b|\b4732\b|roles/owner|global admin|super admin|administratoraccess|attachuserpolicy|localgroup admin|group administrators|privilege\.grant",
    "account_creation": r"\buseradd\b|net user .*\/add|createuser|new[- ]?localuser|\b4720\b|provision\.?user|add member to role|createaccesskey|createserviceaccount|\bbackdoor\b",
    "lateral_movement": r"lateral movement|psexec|netbios|\b3389\b|\bsmb\b|eternalblue",
    "failed_logins": r"failed password|invalid user|\b4625\b|res=failed|authentication_failed",
    "successful_logins": r"accepted publickey|consolelogin.{0,30}success|loggedin|aaa user authentication successful|sso_signin|user\.session\.start|sign-?in|result.{0,8}success|outcome.{0,12}success|\b4624\b",
    "foreign_geo": r'geo["\s:=]{1,4}"?(ru|cn|kp|ir|by|sy|ng)\b',
}

#: Entities: pattern, whether case counts, group, normalisation, most values kept (0: all).
ENTITIES = {
    "source_ip": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", True, 0, "", 10),
    "domains": (r"\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|ru|corp|local|internal)\b", False, 0, "lower", 10),
    "cve_ids": (r"CVE-\d{4}-\d{4,7}", False, 0, "upper", 0),
    "usernames": (r"""(?:user(?:name)?|account name|acct|userName|principalEmail)["'=: ]+([A-Za-z0-9._@\\-]+)""", False, 1, "", 10),
}

#: Indicators of compromise by kind.
INDICATORS = {
    "ip": ["203.0.113.55", "45.33.32.156", "172.16.40.50"],
    "domain": ["malware-c2.ru", "c2.malicious-domain.com", "data-exfil.base64encoded.attacker.com"],
    "cve_kev": ["CVE-2024-21410", "CVE-2024-3400", "CVE-2026-31431", "CVE-2024-21412"],
}
#: Entity column that holds the values of an indicator kind.
INDICATOR_ENTITY = {"ip": "source_ip", "domain": "domains", "cve_kev": "cve_ids"}

#: Vulnerability catalog: service signature, id, severity, summary.
VULNERABILITIES = [
    ("OpenSSH 7.9", "CVE-2018-15473", "medium", "OpenSSH username enumeration"),
    ("Apache httpd 2.4.41", "CVE-2021-41773", "high", "Apache path traversal / RCE"),
    ("Exchange", "CVE-2024-21410", "critical", "Exchange EoP (KEV-listed)"),
    ("Windows Server 2019", "CVE-2020-1472", "critical", "Zerologon domain takeover"),
    ("ms-wbt-server", "CVE-2019-0708", "critical", "BlueKeep RDP RCE"),
]
DEFAULT_SERVICES = ["OpenSSH 7.9", "ms-wbt-server", "Windows Server 2019"]

#: Detection rules: any of ``any`` and all of ``all``; ``ioc`` adds indicator hits to ``any``.
DETECTIONS = [
    ("malware_execution", "critical", ["malware"], [], False),
    ("c2_or_exfil_or_ioc", "critical", ["c2_or_exfil"], [], True),
    ("brute_force_success", "high", [], ["failed_logins", "successful_logins"], False),
    ("privilege_escalation", "high", ["privilege_escalation"], [], False),
    ("unauthorized_account", "high", ["account_creation"], [], False),
    ("suspicious_geo_auth", "high", ["successful_logins", "failed_logins"], ["foreign_geo"], False),
]

SEVERITIES = ["critical", "high", "medium", "low", "informational"]
ANOMALY_SIGNALS = ["malware", "c2_or_exfil", "lateral_movement", "account_creation", "foreign_geo"]
RISK_SIGNALS = ["malware", "c2_or_exfil", "privilege_escalation", "account_creation", "lateral_movement", "failed_logins"]

#: Redaction rules in the order in which they run: kind, pattern.
REDACTION = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("MAC", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("IPV6", r"\b(?=[0-9A-Fa-f:]*[A-Fa-f])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}\b"),
    ("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("HOST", r"\b(?:[a-zA-Z0-9-]+\.)+(?:com|net|org|io|ru|corp|local|internal|onmicrosoft\.com|gserviceaccount\.com)\b"),
    ("SECRET", r"\b(?:sk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{12,}|eyJ[A-Za-z0-9_-]{10,})\b"),
]
#: Additional rules of the health-data mode: before and after the ones above.
REDACTION_BEFORE = [("URL", r"\bhttps?://[^\s\"'<>]+")]
REDACTION_AFTER = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("DATE", r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2}\b"),
    ("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
]

#: Ids that link the events of one campaign, and ids of events.
CORRELATION = r'(?:correlation_id|correlationid|session_id|sessionid)["\s:=]{1,4}"?([0-9a-fA-F][0-9a-fA-F\-]{7,})'
EVENT_ID_KEYS = ["event_id", "eventID", "ReportId", "id", "auditID"]
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX32 = r"\b[0-9a-fA-F]{32}\b"
