"""Findings to control frameworks: crosswalk, resolver tiers, decision tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwarden.functions.text import any_of, evaluated_once, literal_map
from siftwarden.operators import catalog
from siftwarden.operators.normalise import FINDING_COLUMNS, first_rule
from siftwarden.packs import frameworks, rules

RULES, EMBEDDING, CROSSWALK, MODEL, BENIGN = "rules", "embedding", "crosswalk", "llm_fallback", "benign"


def control_nist(spark: SparkSession) -> DataFrame:
    """(control_id, nist_id, ord)."""
    return spark.createDataFrame([(c, n, i) for c, ns in frameworks.CONTROL_NIST.items() for i, n in enumerate(ns)], "control_id string, nist_id string, ord int")


def hipaa_nist(spark: SparkSession) -> DataFrame:
    """(section, nist_id)."""
    return spark.createDataFrame([(s, n) for s, ns in frameworks.HIPAA_NIST.items() for n in ns], "section string, nist_id string")


def control_hipaa(spark: SparkSession) -> DataFrame:
    """(control_id, section) pairs whose NIST sets overlap."""
    return control_nist(spark).join(hipaa_nist(spark), "nist_id").select("control_id", "section").distinct()


def _overlaps() -> dict[str, list[str]]:
    return {c: sorted(s for s, other in frameworks.HIPAA_NIST.items() if set(ns) & set(other)) for c, ns in frameworks.CONTROL_NIST.items()}


def valid(ids: Column, catalog: list[str]) -> Column:
    """The ids that are in a closed set, order kept."""
    return F.filter(ids, lambda x: x.isin(*catalog))


def nist_of(controls: Column) -> Column:
    """NIST ids of an array of controls, in order of first sight."""
    table = literal_map(frameworks.CONTROL_NIST)
    return F.array_distinct(F.flatten(F.transform(controls, lambda c: F.coalesce(table[c], F.array().cast("array<string>")))))


def hipaa_of(controls: Column) -> Column:
    """Sorted HIPAA sections of an array of controls, by overlap of NIST sets."""
    table = literal_map(_overlaps())
    return F.array_sort(F.array_distinct(F.flatten(F.transform(controls, lambda c: F.coalesce(table[c], F.array().cast("array<string>"))))))


def frameworks_of(controls: Column) -> Column:
    """Ids by framework of an array of controls, by the built-in tables; frameworks without an id
    are left out."""
    parts = F.array(F.struct(F.lit("nist_csf"), nist_of(controls)), F.struct(F.lit("hipaa"), hipaa_of(controls)))
    return F.map_from_entries(F.filter(parts, lambda x: F.size(x["col2"]) > 0))


def by_set(findings: DataFrame) -> DataFrame:
    """(mapping, n): each set of controls once, sorted, and the number of its findings."""
    sets = findings.groupBy(F.array_sort("mapping.control_ids").alias("control_ids")).agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.struct("control_ids").alias("mapping"), "n")


def with_catalog(findings: DataFrame, walk: DataFrame) -> DataFrame:
    """Mappings whose NIST and HIPAA ids come from a loaded catalog (``catalog.crosswalk``) instead of
    the built-in tables, and a column ``frameworks`` with the ids of all its frameworks, sorted.

    Findings share few different sets of controls. The catalog is expanded once per set, by
    joins of any size, and findings look their set up. They are read twice for that, so store
    them first where their columns are costly. Every row gets all ids of its set, which of a
    large catalog are megabytes: where only numbers of findings are wanted, hand in ``by_set``.
    """
    spark = walk.sparkSession
    controls = spark.createDataFrame([(c,) for c in frameworks.CONTROLS], "control_id string")
    m, none = F.col("mapping"), F.array().cast("array<string>")
    keyed = findings.withColumn("_set", F.array_join(F.array_sort(m["control_ids"]), ","))
    sets = keyed.select("_set").where("_set <> ''").distinct()
    pairs = sets.select("_set", F.explode(F.split("_set", ",")).alias("control_id")).join(catalog.expanded(walk, controls), "control_id")
    ids = pairs.groupBy("_set", "framework").agg(F.array_sort(F.collect_set("ext_id")).alias("ids"))
    maps = ids.groupBy("_set").agg(F.map_from_entries(F.collect_list(F.struct("framework", "ids"))).alias("frameworks"))
    out = keyed.drop("frameworks").join(maps, "_set", "left").drop("_set")
    held = F.coalesce("frameworks", F.create_map().cast("map<string,array<string>>"))
    nist = F.coalesce(held["nist_csf"], held["nist_80053"], none)
    return out.withColumn("frameworks", held).withColumn("mapping", m.withField("nist_subcategories", nist).withField("hipaa_sections", F.coalesce(F.col("frameworks")["hipaa"], none)))


# The sentences of a rationale.
MATCHED = "keyword/signature rules matched "
ADDED = "embedding similarity added "
EXPANDED = "NIST/HIPAA expanded via the deterministic crosswalk table"
QUIET = "No rule or embedding match and no deterministic risk signals — treated as benign (no applicable control); LLM not consulted."
ESCALATED = "No rule/embedding match but risk signals are present — escalating to LLM fallback for a reviewable suggestion (non-authoritative)."


def rationale(most: int = 3) -> Column:
    """Why a mapping is as it is: the first names of what matched by rule, the first further
    controls that are near, and the crosswalk; or why there is none."""
    m = F.col("mapping")
    names = F.create_map(*(F.lit(x) for c, t in frameworks.CONTROLS.items() for x in (c, t)))
    by_rule = F.filter(m["control_ids"], lambda c: F.array_contains(m["provenance"][c], RULES))
    further = F.array_except(m["control_ids"], by_rule)

    def first(ids: Column, lead: str, told=lambda c: c) -> Column:
        return F.when(F.size(ids) > 0, F.concat(F.lit(lead), F.array_join(F.transform(F.slice(ids, 1, most), told), ", ")))

    parts = F.array_compact(F.array(first(by_rule, MATCHED, lambda c: F.coalesce(names[c], c)), first(further, ADDED), F.lit(EXPANDED)))
    found = F.concat(F.array_join(parts, "; "), F.lit("."))
    return F.when(F.size(m["control_ids"]) > 0, found).when(m["benign"], QUIET).otherwise(ESCALATED)


def resolve(findings: DataFrame, grounded: Column | None = None) -> DataFrame:
    """Adds a struct ``mapping``; ``grounded`` are controls of the embedding tier.

    Rules come before embeddings; provenance names the tiers of each control. The scorer is
    needed only where there is risk but no control.
    """
    catalog = list(frameworks.CONTROLS)
    ruled = valid(F.col("rule_controls"), catalog)
    near = valid(grounded, catalog) if grounded is not None else F.array().cast("array<string>")
    out = findings.withColumns({"_r": ruled, "_e": near})
    out = out.withColumn("_c", F.array_union("_r", "_e"))
    risky = any_of([F.col(f"signals.{s}") for s in rules.RISK_SIGNALS]) | (F.size("ioc_hits") > 0)
    some, by_rule, by_near = F.size("_c") > 0, F.size("_r") > 0, F.size("_e") > 0
    provenance = F.map_from_entries(F.transform("_c", lambda c: F.struct(c, F.array_compact(F.array(F.when(F.array_contains("_r", c), RULES), F.when(F.array_contains("_e", c), EMBEDDING))))))
    tiers = F.when(some, F.array_compact(F.array(F.when(by_near, EMBEDDING), F.when(by_rule, RULES), F.lit(CROSSWALK)))).when(risky, F.array().cast("array<string>")).otherwise(F.array(F.lit(BENIGN)))
    mapping = F.struct(
        F.col("_c").alias("control_ids"), nist_of(F.col("_c")).alias("nist_subcategories"), hipaa_of(F.col("_c")).alias("hipaa_sections"),
        F.when(by_rule, RULES).when(by_near, EMBEDDING).when(~risky, BENIGN).alias("primary_tier"), tiers.alias("tiers_used"), provenance.alias("provenance"),
        F.when(by_rule & by_near, 0.95).when(by_rule, 0.90).when(by_near, 0.70).otherwise(0.0).alias("confidence"),
        (~some & risky).alias("needs_llm"), (some | ~risky).alias("authoritative"), (~some & ~risky).alias("benign"),
    )
    out = out.withColumn("mapping", mapping).drop("_r", "_e", "_c")
    return evaluated_once(out, [c for c in out.columns if c in FINDING_COLUMNS or c == "mapping"])


def grounding(available: Column, retrieved: Column, candidates: Column) -> Column:
    """(controls, reason) that ground a finding: strong retrieval, else valid candidates.

    Where retrieval is available but nothing reached its floor, the candidates are still
    credited to the embedding tier by callers that pass them to ``resolve``; that is how results
    are expected to be, though it lends weak evidence weight.
    """
    strong = F.coalesce(available, F.lit(False)) & (F.size(F.coalesce(retrieved, F.array().cast("array<string>"))) > 0)
    controls = F.when(strong, retrieved).otherwise(valid(candidates, list(frameworks.CONTROLS)))
    reason = F.when(strong, "ok").when(F.coalesce(available, F.lit(False)), "weak").otherwise("static")
    return F.struct(controls.alias("controls"), reason.alias("reason"))


def with_suggestion(findings: DataFrame, suggested: Column) -> DataFrame:
    """Folds a scorer's suggestion into mappings that need one: validated, expanded by the same
    crosswalk, with low confidence and marked for review. Others stay as they are."""
    m, none = F.col("mapping"), F.array().cast("array<string>")
    ids = valid(F.coalesce(suggested, none), list(frameworks.CONTROLS))
    tiers = F.when(suggested.isNull(), none).when(F.size(ids) > 0, F.array(F.lit(MODEL), F.lit(CROSSWALK))).otherwise(F.array(F.lit(MODEL)))
    new = {
        "control_ids": ids, "nist_subcategories": nist_of(ids), "hipaa_sections": hipaa_of(ids), "primary_tier": F.when(suggested.isNotNull(), MODEL), "tiers_used": tiers,
        "provenance": F.map_from_entries(F.transform(ids, lambda c: F.struct(c, F.array(F.lit(MODEL))))), "confidence": F.when(suggested.isNotNull(), 0.4).otherwise(0.0), "authoritative": F.lit(False),
    }
    kept = ["control_ids", "nist_subcategories", "hipaa_sections", "primary_tier", "tiers_used", "provenance", "confidence", "needs_llm", "authoritative", "benign"]
    open_ = F.coalesce(m["needs_llm"], F.lit(False))
    folded = F.struct(*((F.when(open_, new[k]).otherwise(m[k]) if k in new else m[k]).alias(k) for k in kept))
    return findings.withColumn("needs_review", open_).withColumn("mapping", folded)


def known_vulnerabilities() -> list[str]:
    return sorted({c.upper() for c in rules.INDICATORS["cve_kev"]} | {v[1].upper() for v in rules.VULNERABILITIES})


def decision() -> Column:
    """(decided_by, decision_detail): known vulnerability, rule, control, scorer, benign."""
    known = F.array(*map(F.lit, known_vulnerabilities()))
    rule, m = first_rule(), F.col("mapping")

    def tier(name: str, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("decided_by"), detail.alias("decision_detail"))

    hit = F.size(F.array_intersect(F.col("entities.cve_ids"), known)) > 0
    return (
        F.when(hit, tier("scan_engine", F.get(F.filter("entities.cve_ids", lambda c: F.array_contains(known, c)), F.lit(0))))
        .when(rule.isNotNull(), tier("siem_rule", rule))
        .when((F.size(m["control_ids"]) > 0) & ~m["needs_llm"], tier("compliance_rule", F.lit("")))
        .when(m["needs_llm"], tier("llm", F.lit("")))
        .otherwise(tier("deterministic", F.lit("")))
    )


def verdict_shape() -> Column:
    """Key of findings that are alike: type, signals and sorted candidate controls.

    The text that is hashed is a JSON object with sorted keys, ``", "`` and ``": "``.
    """
    controls = F.concat_ws(", ", F.transform(F.array_sort("candidate_controls"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))))
    flags = F.concat_ws(", ", *(F.concat(F.lit(f'"{s}": '), F.col(f"signals.{s}").cast("string")) for s in sorted(rules.SIGNALS)))
    shape = F.concat(F.lit('{"controls": ['), controls, F.lit('], "log_type": "'), F.col("log_type"), F.lit('", "signals": {'), flags, F.lit("}}"))
    return F.substring(F.sha2(shape, 256), 1, 16)
