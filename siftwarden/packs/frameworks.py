"""Control frameworks and their built-in crosswalk.

All tables in this module are fixed values that results have to agree with.
"""

from __future__ import annotations

CONTROLS = {
    "Control 1": "Inventory and Control of Enterprise Assets",
    "Control 2": "Inventory and Control of Software Assets",
    "Control 3": "Data Protection",
    "Control 4": "Secure Configuration of Enterprise Assets and Software",
    "Control 5": "Account Management",
    "Control 6": "Access Control Management",
    "Control 7": "Continuous Vulnerability Management",
    "Control 8": "Audit Log Management",
    "Control 9": "Email and Web Browser Protections",
    "Control 10": "Malware Defenses",
    "Control 11": "Data Recovery",
    "Control 12": "Network Infrastructure Management",
    "Control 13": "Network Monitoring and Defense",
    "Control 14": "Security Awareness and Skills Training",
    "Control 15": "Service Provider Management",
    "Control 16": "Application Software Security",
    "Control 17": "Incident Response Management",
    "Control 18": "Penetration Testing",
}

CONTROL_NIST = {
    "Control 1": ["ID.AM-01", "ID.AM-02", "ID.AM-05", "DE.CM-01"],
    "Control 2": ["ID.AM-02", "ID.AM-05", "ID.AM-08", "PR.PS-01"],
    "Control 3": ["PR.DS-01", "PR.DS-02", "PR.DS-11", "PR.DS-10", "GV.PO-01"],
    "Control 4": ["PR.PS-01", "PR.PS-02", "PR.PS-05", "PR.PS-03"],
    "Control 5": ["PR.AA-01", "PR.AA-05", "GV.RR-02", "PR.AA-02", "PR.AA-06"],
    "Control 6": ["PR.AA-01", "PR.AA-03", "PR.AA-05", "PR.AA-04", "PR.IR-01"],
    "Control 7": ["ID.RA-01", "ID.RA-04", "ID.RA-05", "ID.RA-07", "PR.PS-02"],
    "Control 8": ["PR.PS-04", "DE.CM-03", "DE.AE-02", "DE.CM-09"],
    "Control 9": ["PR.PS-05", "DE.CM-09", "PR.AT-01", "DE.CM-01", "PR.PS-06"],
    "Control 10": ["DE.CM-09", "DE.AE-02", "PR.PS-05", "DE.CM-01", "RS.MA-01"],
    "Control 11": ["PR.DS-11", "RC.RP-03", "RC.RP-05", "RC.RP-01", "PR.DS-01"],
    "Control 12": ["PR.IR-01", "PR.AA-05", "DE.CM-01", "PR.IR-02", "GV.SC-07"],
    "Control 13": ["DE.CM-01", "DE.CM-03", "DE.AE-03", "DE.CM-06", "DE.AE-06", "RS.AN-03"],
    "Control 14": ["PR.AT-01", "PR.AT-02", "GV.RR-04", "GV.OC-03"],
    "Control 15": ["GV.SC-04", "GV.SC-07", "GV.SC-09", "GV.SC-06", "GV.SC-01", "ID.RA-08"],
    "Control 16": ["PR.PS-06", "ID.RA-08", "PR.PS-02", "PR.PS-04", "ID.IM-02"],
    "Control 17": ["RS.MA-01", "RS.AN-03", "RC.RP-01", "RS.CO-02", "RS.MI-01", "GV.OV-01"],
    "Control 18": ["ID.RA-01", "ID.IM-02", "DE.AE-02", "ID.RA-05", "ID.IM-01"],
}

HIPAA = {
    "164.308a1": "Security Management Process",
    "164.308a3": "Workforce Security",
    "164.308a4": "Information Access Management",
    "164.308a5": "Security Awareness and Training",
    "164.308a6": "Security Incident Procedures",
    "164.308a7": "Contingency Plan",
    "164.310a1": "Facility Access Controls",
    "164.312a1": "Access Control",
    "164.312a2": "Access Control — Emergency / Encryption",
    "164.312b": "Audit Controls",
    "164.312c1": "Integrity",
    "164.312d": "Person or Entity Authentication",
    "164.312e1": "Transmission Security",
    "164.312e2": "Transmission Security — Encryption",
}

HIPAA_NIST = {
    "164.308a1": ["ID.RA-01", "ID.RA-04", "GV.RM-03"],
    "164.308a3": ["PR.AA-01", "PR.AA-02", "PR.AA-05"],
    "164.308a4": ["PR.AA-03", "PR.AA-06", "PR.IR-01"],
    "164.308a5": ["PR.AT-01", "PR.AT-02", "GV.RR-04"],
    "164.308a6": ["RS.MA-01", "RS.CO-02", "RS.AN-03"],
    "164.308a7": ["RC.RP-01", "RC.RP-03", "PR.DS-11"],
    "164.310a1": ["PR.IR-01", "PR.DS-01"],
    "164.312a1": ["PR.AA-01", "PR.AA-03", "PR.AA-05"],
    "164.312a2": ["PR.AA-02", "PR.AA-04"],
    "164.312b": ["DE.CM-03", "PR.PS-04", "DE.AE-02"],
    "164.312c1": ["PR.DS-01", "PR.DS-02", "DE.CM-09"],
    "164.312d": ["PR.AA-01", "PR.AA-03"],
    "164.312e1": ["PR.DS-02", "PR.DS-10"],
    "164.312e2": ["PR.DS-02", "PR.IR-02"],
}

#: Names of catalog columns by framework, the preferred one first.
CATALOG_COLUMNS = {
    "scf_id": ["SCF #", "scf_id"],
    "nist_csf": ["NIST CSF v2.0", "NIST\nCSF\nv2.0", "NIST CSF v1.1", "NIST\nCSF\nv1.1", "nist_csf_v2_0"],
    "nist_80053": ["NIST 800-53 rev5", "NIST\n800-53\nrev5", "NIST\n800-53\nrev4", "NIST 800-53 R5"],
    "cis": ["CIS CSC v8.1", "CIS\nCSC\nv8.1", "CIS\nCSC\nv8.0", "CIS\nCSC\nv8", "cis_csc_v8_1"],
    "hipaa": ["HIPAA", "US\nHIPAA", "hipaa"],
    "iso_27001": ["ISO 27001 v2022", "ISO\n27001\nv2022", "ISO\n27001\nv2013", "iso_27001_v2022"],
    "pci_dss": ["PCI DSS v4.0", "PCIDSS\nv4.0", "PCIDSS\nv3.2", "pci_dss_v4_0"],
    "soc2": ["AICPA\nTSC 2017\n(SOC 2)", "AICPA TSC 2017"],
}
CATALOG_RELATION = ["STRM Relationship", "strm_relationship"]
CATALOG_STRENGTH = ["Strength Score", "strength_score"]
