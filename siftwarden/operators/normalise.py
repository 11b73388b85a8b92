"""Raw log text into canonical findings: lane, log type, entities, signals, controls.

Everything is built-in column expressions, so a scan of raw text stays in one stage without a
shuffle; the indicator lookup is against literal sets while the feed is a small fixed table,
and a join for feeds of any size (``enrich``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions.text import all_of, any_of, exploded, extracted, matches
from siftwarden.packs import rules


#: Columns that ``normalise`` adds.
FINDING_COLUMNS = ("lane", "log_type", "entities", "ioc_hits", "signals", "rule_controls", "candidate_controls")


def lane(low: Column) -> Column:
    """Lane of lower-cased text."""
    out = None
    for name, pattern in rules.LANES.items():
        hit = matches(low, pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rules.LANE_ORDER[-1])


def lane_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, rules.LANE_ORDER)), name)


def log_type(low: Column, hint: Column | None = None) -> Column:
    """Detected type of lower-cased text; a hint other than ``auto`` passes unchecked."""
    out = None
    for name, parts in rules.LOG_TYPES:
        hit = any_of([low.contains(p) for p in parts])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    found = out.otherwise(rules.DEFAULT_LOG_TYPE)
    return found if hint is None else F.when(F.coalesce(hint, F.lit("auto")) != "auto", hint).otherwise(found)


def signals(low: Column) -> Column:
    return F.struct(*(matches(low, p).alias(name) for name, p in rules.SIGNALS.items()))


def keyword_controls(low: Column) -> Column:
    """Controls whose keywords occur, in rule order."""
    return F.array_compact(F.array(*(F.when(matches(low, p), c) for c, p in rules.CONTROL_KEYWORDS.items())))


def indicator_hits(entities: Column) -> Column:
    """Entities that are in the built-in feed: array of (type, value), by kind and value."""
    parts = []
    for kind, entity in rules.INDICATOR_ENTITY.items():
        hits = F.filter(entities[entity], _among([v.lower() for v in rules.INDICATORS[kind]]))
        parts.append(F.transform(hits, _tagged("type", kind)))
    return F.concat(*parts)


def _among(known: list[str]):
    return lambda v: F.lower(v).isin(*known)


def _tagged(field: str, name: str):
    return lambda v: F.struct(F.lit(name).alias(field), v.alias("value"))


def normalise(logs: DataFrame, hint: str | None = None, use_intel: bool = True) -> DataFrame:
    """Adds the columns of a finding to logs with a column ``raw``.

    Null text counts as ''. Extra columns are kept; names of the added ones are lane,
    log_type, entities, ioc_hits, signals, rule_controls, candidate_controls.
    """
    out = logs.withColumn("_raw", F.coalesce("raw", F.lit(""))).withColumn("_low", F.lower("_raw"))
    entities = F.struct(*(extracted(F.col("_raw"), p, not exact, group, case, most).alias(name) for name, (p, exact, group, case, most) in rules.ENTITIES.items()))
    out = out.withColumns({"lane": lane(F.col("_low")), "log_type": log_type(F.col("_low"), F.col(hint) if hint else None), "entities": entities, "signals": signals(F.col("_low")), "rule_controls": keyword_controls(F.col("_low"))})
    empty = F.array().cast("array<struct<type:string,value:string>>")
    out = out.withColumn("ioc_hits", indicator_hits(F.col("entities")) if use_intel else empty)
    # A known-bad indicator is itself a signal.
    out = out.withColumn("signals", F.col("signals").withField("c2_or_exfil", F.col("signals.c2_or_exfil") | (F.size("ioc_hits") > 0)))
    fallback = F.array(F.lit(rules.FALLBACK_CONTROL))
    return out.withColumn("candidate_controls", F.when(F.size("rule_controls") > 0, F.col("rule_controls")).otherwise(fallback)).drop("_raw", "_low")


def entity_rows(findings: DataFrame, *keys: str) -> DataFrame:
    """One row per entity: (keys, kind, value)."""
    parts = F.concat(*(F.transform(F.col(f"entities.{e}"), _tagged("kind", e)) for e in rules.ENTITIES))
    return findings.select(*keys, exploded(parts).alias("x")).where("x is not null").select(*keys, "x.kind", "x.value")


def enrich(findings: DataFrame, feed: DataFrame, *keys: str) -> DataFrame:
    """Hits against a feed (kind, value) of any size, by a join on lower-cased values."""
    kinds = F.create_map(*(F.lit(x) for kind, entity in rules.INDICATOR_ENTITY.items() for x in (entity, kind)))
    values = entity_rows(findings, *keys).withColumn("kind", kinds[F.col("kind")]).where("kind is not null").withColumn("_v", F.lower("value"))
    known = feed.select(F.col("kind").alias("_k"), F.lower("value").alias("_f")).distinct()
    return values.join(known, (F.col("kind") == F.col("_k")) & (F.col("_v") == F.col("_f"))).select(*keys, F.col("kind").alias("type"), "value")


def detections() -> list[tuple[str, str, Column]]:
    """(rule, severity, predicate) over the columns of a finding."""
    out = []
    for name, severity, some, every, ioc in rules.DETECTIONS:
        flags = [F.col(f"signals.{s}") for s in some] + ([F.size("ioc_hits") > 0] if ioc else [])
        out.append((name, severity, all_of([F.col(f"signals.{s}") for s in every]) & (any_of(flags) if flags else F.lit(True))))
    return out


def alerts(findings: DataFrame, *keys: str) -> DataFrame:
    """Every rule that fires: (keys, rule, severity)."""
    fired = F.array_compact(F.array(*(F.when(p, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in detections())))
    return findings.select(*keys, exploded(fired).alias("a")).where("a is not null").select(*keys, "a.rule", "a.severity")


def first_rule() -> Column:
    """The first rule that fires, in priority order; null if none does."""
    return F.coalesce(*(F.when(p, n) for n, _, p in detections()))


def severity_score() -> Column:
    """(severity, risk_score) from the signals."""

    def s(*names: str) -> Column:
        return any_of([F.col(f"signals.{n}") for n in names])

    def level(name: str, score: int) -> Column:
        return F.struct(F.lit(name).alias("severity"), F.lit(score).alias("risk_score"))

    quiet = s("successful_logins") & ~s("malware", "c2_or_exfil", "account_creation", "lateral_movement", "foreign_geo")
    return (
        F.when(s("malware", "c2_or_exfil"), level("critical", 90))
        .when(s("foreign_geo") & s("successful_logins", "failed_logins"), level("high", 74))
        .when(s("account_creation", "lateral_movement"), level("high", 72))
        .when(quiet, level("informational", 8))
        .when(s("privilege_escalation"), level("high", 68))
        .when(s("failed_logins"), level("medium", 50))
        .when(s(*rules.SIGNALS), level("medium", 45))
        .otherwise(level("low", 20))
    )


def top_factors(most: int = 3) -> Column:
    """The first true signals in declared order."""
    return F.slice(F.array_compact(F.array(*(F.when(F.col(f"signals.{n}"), n) for n in rules.SIGNALS))), 1, most)


def is_anomaly() -> Column:
    return any_of([F.col(f"signals.{n}") for n in rules.ANOMALY_SIGNALS])


def clamped_severity(word: Column) -> Column:
    bare = F.lower(F.trim(word))
    return F.when(bare.isin(*rules.SEVERITIES), bare).otherwise("medium")


def clamped_score(value: Column) -> Column:
    number = F.coalesce(value.try_cast("double").cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), number))


def at_least(severity: Column, threshold: str) -> Column:
    """Ordinal comparison; unknown severities pass."""
    order = F.array(*map(F.lit, rules.SEVERITIES))
    at = F.array_position(order, F.lower(severity))
    return (at == 0) | (at <= rules.SEVERITIES.index(threshold) + 1)


def scan(assets: DataFrame, catalog: DataFrame, *keys: str) -> DataFrame:
    """Services against a vulnerability catalog, by case-insensitive containment.

    Containment has no equi-key, so the catalog is broadcast; it is a short reference table
    whose size is checked first.
    """
    hit = F.lower("service").contains(F.lower("signature"))
    return assets.join(F.broadcast(checked_small(catalog)), hit).select(*keys, "service", "cve", "severity", "summary")


def checked_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A reference table as a local relation, or an error if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"reference table has more than {most} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
