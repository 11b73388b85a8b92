"""Model agents behind one interface: prompts, a mock, batched live scorers, JSON repair.

The library never needs a model: findings that a deterministic tier decides are filtered out
before a scorer runs, and the default scorer answers offline.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.operators import mapping, normalise
from siftwarden.packs import frameworks, rules

AGENTS = ["risk_scorer", "compliance_mapper", "remediation_generator", "anomaly_detector", "report_generator"]
MOST_PROMPT = 8000
RESULT_SCHEMA = "request_id bigint, agent string, ok boolean, output string, latency_ms bigint, source string, error string, prompt string, raw string"


def selected(names: list[str] | None = None) -> list[str]:
    """Chosen agents in canonical order; all where nothing valid is chosen."""
    return [a for a in AGENTS if a in names] if names else list(AGENTS)


# -- JSON out of model answers --------------------------------------------------------------

_OPEN_CLOSE = {"{": "}", "[": "]"}


def closed(text: str) -> str:
    """Cut-off JSON with its open string, lists and objects closed, innermost first."""
    start = text.find("{")
    if start < 0:
        return text
    stack, quoted, skip = [], False, False
    for c in text[start:]:
        if skip:
            skip = False
        elif quoted:
            skip = c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in _OPEN_CLOSE:
            stack.append(_OPEN_CLOSE[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return text[start:] + '"' * quoted + "".join(reversed(stack))


def read_json(raw: str | None) -> tuple[dict, str | None]:
    """(object, error): the answer as it is, without fences, from its outermost braces, closed."""
    bare = re.sub(r"(?m)^\s*```\w*\s*|\s*```\s*$", "", raw or "").strip()
    outer = bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare and "}" in bare else ""
    for attempt in (bare, outer, closed(bare)):
        try:
            value = json.loads(attempt)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return value, None
    return {}, "no_json" if bare else "empty_response"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, JSON object or null, text of those without) into (key, JSON, error)."""
    for batch in batches:
        values, errors = batch.column(1).to_pylist(), []
        for i, (value, raw) in enumerate(zip(values, batch.column(2).to_pylist(), strict=True)):
            error = None
            if value is None:
                found, error = read_json(raw)
                values[i] = json.dumps(found) if error is None else None
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(errors, pa.string())], ["_k", "_value", "error"])


def repaired(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, value, error): model answers as compact JSON objects with sorted keys.

    Answers that are objects as they stand are read by the built-in parser; only the others go
    through the repair. Empty answers and those without an object have a null value and an error.
    """
    doc = F.try_parse_json(raw)
    whole = F.when(F.schema_of_variant(doc).startswith("OBJECT"), F.to_json(doc))
    picked = rows.select(F.col(key).alias("_k"), whole.alias("_value"), F.when(whole.isNull(), F.col(raw)).alias("_raw"))
    done = picked.mapInArrow(_repaired, f"_k {dict(rows.dtypes)[key]}, _value string, error string")
    return done.select(F.col("_k").alias(key), F.to_json(F.try_parse_json("_value")).alias("value"), "error")


# -- prompts --------------------------------------------------------------------------------

TASKS = {
    "risk_scorer": "Score the risk of the finding: severity, risk_score 0-100, confidence, rationale, top_factors. Answer with one JSON object.",
    "compliance_mapper": "Name the controls that the finding touches, from the catalog only: control_ids, nist_subcategories, hipaa_sections, rationale, confidence. Answer with one JSON object.",
    "remediation_generator": "List the next steps in order of urgency: priority, effort, steps, containment. Answer with one JSON object.",
    "anomaly_detector": "Decide whether the finding is anomalous: is_anomaly, anomaly_type, confidence, explanation, indicators. Answer with one JSON object.",
    "report_generator": "Write a short incident report: executive_summary, attack_narrative, business_impact, remediation_roadmap, compliance_posture. Answer with one JSON object.",
}


MOST_EVIDENCE, MOST_CONTENT = 4, 400


def prompt(agent: str, retrieved: Column | None = None, evidence: Column | None = None) -> Column:
    """Instruction and context as compact JSON, cut at MOST_PROMPT characters: the finding,
    controls that were retrieved for it, and the first pieces of evidence (texts, each cut too)."""
    finding = F.struct("log_type", F.col("signals"), F.col("candidate_controls"), F.col("entities"))
    parts = [finding.alias("finding")]
    if retrieved is not None:
        parts.append(F.when(F.size(retrieved) > 0, retrieved).alias("retrieved_controls"))
    if evidence is not None:
        cut = F.transform(F.slice(evidence, 1, MOST_EVIDENCE), lambda x: F.substring(x, 1, MOST_CONTENT))
        parts.append(F.when(F.size(evidence) > 0, cut).alias("evidence"))
    return F.concat(F.lit(TASKS[agent] + "\n"), F.substring(F.to_json(F.struct(*parts)), 1, MOST_PROMPT))


# -- answers --------------------------------------------------------------------------------


def deterministic(agent: str) -> Column:
    """The two agents that need no model, as JSON from the signals."""
    s = normalise.severity_score()
    if agent == "risk_scorer":
        return F.to_json(F.struct(s["severity"].alias("severity"), s["risk_score"].alias("risk_score"), F.lit(0.9).alias("confidence"), normalise.top_factors().alias("top_factors")))
    odd = normalise.is_anomaly()
    return F.to_json(F.struct(odd.alias("is_anomaly"), F.when(odd, "process").otherwise("none").alias("anomaly_type"), F.lit(0.9).alias("confidence"), normalise.top_factors().alias("indicators")))


def mock(agent: str) -> str:
    """Offline answers."""
    return json.dumps(
        {
            "compliance_mapper": {"control_ids": [rules.FALLBACK_CONTROL], "nist_subcategories": frameworks.CONTROL_NIST[rules.FALLBACK_CONTROL][:4], "hipaa_sections": ["164.312b"], "rationale": "offline", "confidence": 0.6},
            "remediation_generator": {"priority": "high", "effort": "medium", "steps": [{"order": 1, "action": "Isolate the host and rotate its credentials.", "control_ref": "Control 6"}], "containment": []},
        }.get(agent, {"rationale": "offline", "confidence": 0.6})
    )


Client = Callable[[str, float], str]


def with_retries(client: Client, text: str, tries: int = 3, temperature: float = 0.1, wait: float = 1.0) -> tuple[dict, str, str, str | None]:
    """(object, source, raw, error): a little warmer on each try, ``fallback`` after the last."""
    error: str | None = "unknown"
    for k in range(tries):
        try:
            raw = client(text, temperature + 0.05 * k).strip()
        except Exception as e:  # noqa: BLE001
            error = str(e)
            time.sleep(wait)
            continue
        value, error = read_json(raw)
        if value:
            return value, "llm", raw, None
    return {}, "fallback", "", error


def _run(agent: str, make: Callable[[], Client] | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make() if make else None
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                began = time.perf_counter()
                if client is None:
                    value, source, raw, error = json.loads(mock(agent)), "mock", "", None
                else:
                    value, source, raw, error = with_retries(client, text)
                took = int((time.perf_counter() - began) * 1000)
                rows.append({"request_id": key, "agent": agent, "ok": bool(value), "output": json.dumps(value), "latency_ms": took, "source": source, "error": error, "prompt": text, "raw": raw})
            types = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            names = ["request_id", "agent", "ok", "output", "latency_ms", "source", "error", "prompt", "raw"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return go


def run_agent(findings: DataFrame, agent: str, key: str, make_client: Callable[[], Client] | None = None) -> DataFrame:
    """RESULT_SCHEMA for one agent over findings with mappings. Rows that need no model are
    filtered before the scorer, so only undecided findings reach it."""
    if agent in ("risk_scorer", "anomaly_detector"):
        none = F.lit(None).cast("string")
        return findings.select(F.col(key).cast("bigint").alias("request_id"), F.lit(agent).alias("agent"), F.lit(True).alias("ok"), deterministic(agent).alias("output"), F.lit(0).cast("bigint").alias("latency_ms"), F.lit("deterministic").alias("source"), none.alias("error"), none.alias("prompt"), none.alias("raw"))
    needed = findings.where(F.col("mapping.needs_llm")) if agent == "compliance_mapper" else findings
    return needed.select(F.col(key).cast("bigint").alias("_k"), prompt(agent).alias("_p")).mapInArrow(_run(agent, make_client), RESULT_SCHEMA)


def mapped_output(output: Column) -> Column:
    """A mapper's answer with ids outside the catalogs dropped and NIST ids completed from the
    crosswalk, without repeats."""
    held = F.from_json(output, "control_ids array<string>, nist_subcategories array<string>, hipaa_sections array<string>")
    none = F.array().cast("array<string>")
    ids = mapping.valid(F.coalesce(held["control_ids"], none), list(frameworks.CONTROLS))
    allowed = sorted({n for ns in [*frameworks.CONTROL_NIST.values(), *frameworks.HIPAA_NIST.values()] for n in ns})
    nist = F.array_union(mapping.valid(F.coalesce(held["nist_subcategories"], none), allowed), mapping.nist_of(ids))
    return F.struct(ids.alias("control_ids"), nist.alias("nist_subcategories"), mapping.valid(F.coalesce(held["hipaa_sections"], none), list(frameworks.HIPAA)).alias("hipaa_sections"))


ASSESS_TASK = "Judge each numbered log line on its own: malicious, suspicious or benign, a severity, one sentence of reasoning and one step to contain it. Answer with one JSON object that holds a list assessments of n, verdict, severity, reasoning, remediation."
ASSESSED_SCHEMA = "batch bigint, n int, verdict string, severity string, reasoning string, remediation string, source string, error string"


def _assess(make: Callable[[], Client] | None):
    names = [x.split()[0] for x in ASSESSED_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.string()] * 6]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make() if make else None
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value, source, _, error = with_retries(client, f"{ASSESS_TASK}\n{text}") if client else ({}, "mock", "", None)
                listed = value.get("assessments")
                found = [x for x in listed if isinstance(x, dict)] if isinstance(listed, list) else []
                for x in found or [{}]:
                    n = x.get("n")
                    told = [None if x.get(c) is None else str(x[c]) for c in names[2:6]]
                    rows.append((key, n if isinstance(n, int) else None, *told, source, error))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return go


def assessed(logs: DataFrame, key: str, text: str, make_client: Callable[[], Client] | None = None, size: int = 6) -> DataFrame:
    """ASSESSED_SCHEMA: a model's own view of raw logs, ``size`` of them per call, numbered from 1.
    A call without a readable answer gives one row that names its source and error."""
    return numbered_batches(logs, key, text, size, 600).mapInArrow(_assess(make_client), ASSESSED_SCHEMA)


def numbered_batches(logs: DataFrame, key: str, text: str, size: int = 6, most: int = 1500) -> DataFrame:
    """Logs, cut at ``most`` characters, in numbered groups of ``size`` for one prompt each: (batch,
    prompt). The key is a
    dense sequence number, so groups come from arithmetic instead of a global sort."""
    numbered = logs.select(F.floor(F.col(key) / size).alias("batch"), (F.col(key) % size + 1).alias("k"), F.substring(text, 1, most).alias("t"))
    held = F.sort_array(F.collect_list(F.struct("k", "t")))
    return numbered.groupBy("batch").agg(F.array_join(F.transform(held, lambda x: F.concat(F.lit("["), x["k"].cast("string"), F.lit("] "), x["t"])), "\n").alias("prompt"))
