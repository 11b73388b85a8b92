"""Redaction of identifiers with numbered placeholders, and back.

A value keeps its placeholder inside a text, whatever rule meets it later, and numbers count
per kind in order of appearance, rule by rule. That state makes it an Arrow batch function;
everything around it (counts, putting values back) is built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import deepjson
from siftwarden.functions.arrow import text_array
from siftwarden.packs import rules

TOKENS = "array<struct<placeholder:string,kind:string,original:string>>"


def active_rules(health_mode: bool = False, kinds: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    chosen = rules.REDACTION_BEFORE + rules.REDACTION + rules.REDACTION_AFTER if health_mode else rules.REDACTION
    return [r for r in chosen if kinds is None or r[0] in kinds]


class Tokenizer:
    """Placeholders of one text or record."""

    def __init__(self, compiled: list[tuple[str, re.Pattern]]) -> None:
        self.compiled = compiled
        self.known: dict[str, tuple[str, str]] = {}
        self.counts: dict[str, int] = {}

    def token(self, value: str, kind: str) -> str:
        if not value:
            return value
        if value not in self.known:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.known[value] = (f"{{{kind}_{self.counts[kind]:03d}}}", kind)
        return self.known[value][0]

    def strip(self, text: str) -> str:
        for kind, pattern in self.compiled:
            text = pattern.sub(lambda m, kind=kind: self.token(m[0], kind), text)
        return text

    def tokens(self) -> list[dict]:
        return [{"placeholder": p, "kind": k, "original": v} for v, (p, k) in self.known.items()]


def _strip(chosen: list[tuple[str, str]], key: str, type_of_key: pa.DataType | None):
    kind = pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("original", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(p)) for k, p in chosen]
        for batch in batches:
            texts, found = [], []
            for t in batch.column(1).to_pylist():
                own = Tokenizer(compiled)
                texts.append(None if t is None else own.strip(t))
                found.append(own.tokens())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, kind)], [key, "redacted", "tokens"])

    return run


def redact(rows: DataFrame, key: str, text: str, health_mode: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(key, redacted, tokens); null text stays null, other columns are left out."""
    schema = f"`{key}` {dict(rows.dtypes)[key]}, redacted string, tokens {TOKENS}"
    return rows.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(_strip(active_rules(health_mode, kinds), key, None), schema)


#: Kinds of entity columns whose values are known by their field; identifiers that are public
#: stay, all others go through the patterns.
FIELD_KINDS = {"usernames": "USER", "hostnames": "HOST"}
PUBLIC = ("cve_ids",)


def _redact_findings(chosen: list[tuple[str, str]], names: list[str]):
    kind = pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("original", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(p)) for k, p in chosen]
        for batch in batches:
            texts, tokens = [], []
            fields: list[list] = [[] for _ in names]
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for text, *entities in zip(*columns, strict=True):
                own = Tokenizer(compiled)
                texts.append(None if text is None else own.strip(text))
                for name, held, values in zip(names, fields, entities, strict=True):
                    if values is None or name in PUBLIC:
                        held.append(values)
                    else:
                        held.append([own.token(v, FIELD_KINDS[name]) if name in FIELD_KINDS else own.strip(v) for v in values])
                tokens.append(own.tokens())
            out = [batch.column(0), pa.array(texts, pa.string()), *(pa.array(f, pa.list_(pa.string())) for f in fields), pa.array(tokens, kind)]
            yield pa.RecordBatch.from_arrays(out, [batch.schema.names[0], "redacted", *names, "tokens"])

    return run


def redact_findings(findings: DataFrame, key: str, text: str = "raw", health_mode: bool = False) -> DataFrame:
    """Findings as a model may see them: (key, redacted text, entities, ioc_hit_count, kinds, tokens).

    Text and entities share one set of placeholders per finding; users are replaced by their
    field, other entities by the patterns, public identifiers stay. Indicator hits are reduced
    to their number and sorted kinds. Null texts and entities stay null.
    """
    names = findings.schema["entities"].dataType.fieldNames()  # type: ignore[union-attr]
    picked = findings.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_text"), *(F.col(f"entities.{n}").alias(n) for n in names))
    schema = f"_k {dict(findings.dtypes)[key]}, redacted string, {', '.join(f'{n} array<string>' for n in names)}, tokens {TOKENS}"
    done = picked.mapInArrow(_redact_findings(active_rules(health_mode), names), schema)
    hits = findings.select(F.col(key).alias("_h"), F.size("ioc_hits").alias("ioc_hit_count"), F.array_sort(F.array_distinct(F.transform("ioc_hits", lambda h: h["type"]))).alias("kinds"))
    out = done.join(hits, F.col("_k") == F.col("_h"))
    return out.select(F.col("_k").alias(key), "redacted", F.struct(*names).alias("entities"), "ioc_hit_count", "kinds", "tokens")


def _restored(value: object, pairs: list[tuple[str, str]]) -> object:
    """Any JSON value with the placeholders in its strings replaced; names of fields stay."""
    root = [value]
    stack: list[tuple] = [(root, 0)]
    while stack:
        held, at = stack.pop()
        v = held[at]
        if isinstance(v, str):
            for placeholder, original in pairs:
                v = v.replace(placeholder, original)
            held[at] = v
        elif isinstance(v, list):
            stack += [(v, i) for i in range(len(v))]
        elif isinstance(v, dict):
            stack += [(v, k) for k in v]
    return root[0]


def _rehydrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            pairs = [(t["placeholder"], t["original"]) for t in reversed(tokens or [])]
            try:
                out.append(None if text is None else deepjson.dumps(_restored(deepjson.loads(text), pairs)))
            except ValueError:
                out.append(_restored(text, pairs))
        yield pa.RecordBatch.from_arrays([batch.column(0), text_array(out)], ["_k", "restored"])


def rehydrate_json(rows: DataFrame, key: str, document: str, tokens: str = "tokens") -> DataFrame:
    """(key, restored): JSON documents with the values put back in all their strings, at any depth
    and properly escaped; text that is no JSON is treated as one string."""
    picked = rows.select(F.col(key).alias("_k"), F.col(document).cast("string").alias("_d"), F.col(tokens).alias("_t"))
    return picked.mapInArrow(_rehydrated, f"_k {dict(rows.dtypes)[key]}, restored string").withColumnRenamed("_k", key)


def rehydrate(text: Column, tokens: Column) -> Column:
    """Puts the values back: the last placeholder given first, as values may hold earlier ones."""
    return F.aggregate(F.reverse(tokens), text, lambda s, t: F.replace(s, t["placeholder"], t["original"]))


def report(redacted: DataFrame) -> DataFrame:
    """Distinct values per kind over all texts' placeholders."""
    return redacted.select(F.explode("tokens").alias("t")).groupBy("t.kind").agg(F.count(F.lit(1)).alias("n"))
