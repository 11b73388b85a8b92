"""Deeply nested JSON records into related flat tables with parent-child links.

Each document is read once, with an explicit stack, so that no depth is too deep. The walk emits
path-value-ordinal triples: the path of a value, the value, and the position of every repeated
ancestor. Triples of the same repeated ancestor (the path without positions, as
``agents.output.steps``) form one table; a table is pivoted from them, one row per object with
its parent's path and its own position.

Shapes that mean the same are read alike: a single object where a list is expected is a list
of one, an object keyed by 0, 1, ... is a list, a string that holds JSON counts as what it
holds. A null element keeps its position and gives no row. A document that is not complete
JSON gives no triple at all.

``version`` is a fingerprint of the document that a triple came from. Copies of a record with
equal content therefore collapse as whole documents, and documents that differ under one key, or
under a null one, stay apart; no row mixes fields of two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions import deepjson
from siftwarden.functions.arrow import text_array

TRIPLE_SCHEMA = "record_id string, version bigint, table_path string, row_path string, parent_path string, ordinal bigint, field string, value string"
KEYS = ["record_id", "version", "row_path", "parent_path", "ordinal"]

#: Lists of objects in a finding's JSON columns, as paths without positions.
FINDING_LISTS = {
    "finding.intel.ioc_hits": "hits", "finding.intel.ioc_hits.sightings": "sightings",
    "agents": "agents", "agents.output.steps": "steps", "agents.output.steps.substeps": "substeps",
    "verdict.evidence": "evidence", "verdict.evidence.nist": "evidence_nist", "dal.tokens": "tokens",
}
FINDING_COLUMNS = ("finding", "agents", "verdict", "dal")
_UNREADABLE = object()


def _load(text: str) -> object:
    """What a string holds as JSON, through any number of quotings; _UNREADABLE if not JSON."""
    value: object = text
    while isinstance(value, str):
        bare = value.strip(" \t\r\n")
        if bare[:1] not in ("{", "[", '"'):
            return value if value is not text else _UNREADABLE
        try:
            value = deepjson.loads(bare)
        except ValueError:
            return value if value is not text else _UNREADABLE
    return value


def _open(value: object) -> object:
    """A value with JSON inside a string replaced by what it holds."""
    if isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        held = _load(value)
        return value if held is _UNREADABLE else held
    return value


def _elements(value: object) -> list[tuple[int, object]]:
    """(position, element) of a value where a list is expected."""
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict):
        if value and all(k.isascii() and k.isdigit() for k in value):
            return sorted((int(k), v) for k, v in value.items()) if len({int(k) for k in value}) == len(value) else [(int(k), v) for k, v in value.items()]
        return [(0, value)]
    return []


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return deepjson.dumps(value)


class Triples:
    """Triples as columns. What all triples of an object share is held once per object."""

    def __init__(self, lists: frozenset[str], fields: frozenset[str] | None = None) -> None:
        self.lists, self.fields = lists, fields
        #: Names below which a list may still come; deeper than that no path is compared.
        self.depth = max((x.count(".") for x in lists), default=0)
        self.clear()

    def clear(self) -> None:
        self.records: list[str | None] = []
        self.versions: list[int | None] = []
        self.tables: list[str] = []
        self.paths: list[str] = []
        self.parents: list[str] = []
        self.ordinals: list[int] = []
        self.owners: list[int] = []
        self.names: list[str | None] = []
        self.values: list[str | None] = []

    def __len__(self) -> int:
        return len(self.owners)

    def add(self, record: str | None, version: int | None, column: str, document: str | None) -> None:
        """Walks one document. Every object opens with a triple without a field. The document
        itself is a row of the table named by its column with ordinal 0, unless the column is
        itself a list."""
        if document is None:
            return
        value = _load(document)
        if value is _UNREADABLE or not isinstance(value, dict | list):
            return
        lists, fields, owners, names, values = self.lists, self.fields, self.owners, self.names, self.values
        # (list?, value, table, path, parent, ordinal): lists hold rows, rows hold fields and lists.
        stack: list[tuple] = [(column in lists, value, column, column, "", 0)]
        while stack:
            is_list, value, table, path, parent, ordinal = stack.pop()
            if is_list:
                stack += [(False, _open(x), table, f"{path}[{i}]", parent, i) for i, x in reversed(_elements(value))]
                continue
            if not isinstance(value, dict):
                continue
            owner = len(self.paths)
            self.records.append(record)
            self.versions.append(version)
            self.tables.append(table)
            self.paths.append(path)
            self.parents.append(parent)
            self.ordinals.append(ordinal)
            owners.append(owner)
            names.append(None)
            values.append(None)
            # Objects inside the row; names are put together where they are short and linked below.
            inside: list[tuple] = [(value, "", 0)]
            while inside:
                held, prefix, level = inside.pop()
                for name, x in held.items():
                    field = f"{prefix}{name}" if level < _LINKED else (prefix, name)
                    inner = _open(x) if isinstance(x, str) else x
                    if level < self.depth and (below := f"{table}.{field}") in lists:
                        stack.append((True, inner, below, f"{path}.{field}", path, 0))
                    elif isinstance(inner, dict) and inner:
                        inside.append((inner, f"{field}." if level < _LINKED else field, level + 1))
                    else:
                        label = field if level < _LINKED else _joined(field)
                        if fields is None or label in fields:
                            owners.append(owner)
                            names.append(label)
                            values.append(_scalar(x))

    def batch(self) -> pa.RecordBatch:
        at = pa.array(self.owners, pa.int64())
        shared = [pa.array(self.records, pa.string()), pa.array(self.versions, pa.int64()), pa.array(self.tables, pa.string()), text_array(self.paths), text_array(self.parents), pa.array(self.ordinals, pa.int64())]
        columns = [*(x.take(at) for x in shared), text_array(self.names), text_array(self.values)]
        out = pa.RecordBatch.from_arrays(columns, _COLUMNS)
        self.clear()
        return out


_COLUMNS = ["record_id", "version", "table_path", "row_path", "parent_path", "ordinal", "field", "value"]
#: Nesting from which a name is a chain of links: putting it together at every level would take
#: time with the square of the depth.
_LINKED = 64


def _joined(field: object) -> str:
    parts = []
    while isinstance(field, tuple):
        field, name = field
        parts.append(name)
    return str(field) + ".".join(reversed(parts))


#: Triples of an output batch; it bounds a task's memory.
_BATCH = 20_000


def _stream(lists: frozenset[str], columns: tuple[str, ...], fields: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Triples(lists, fields)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, column in enumerate(columns):
                versions = batch.column(2 * k + 2).to_pylist()
                for record, version, document in zip(ids, versions, batch.column(2 * k + 1), strict=True):
                    out.add(record, version, column, document.as_py())
                    if len(out) > _BATCH:
                        yield out.batch()
        yield out.batch()

    return run


def triples(records: DataFrame, key: str = "finding_id", columns: tuple[str, ...] = FINDING_COLUMNS, lists: tuple[str, ...] = tuple(FINDING_LISTS), fields: tuple[str, ...] | None = None) -> DataFrame:
    """Path-value-ordinal triples of JSON columns (TRIPLE_SCHEMA).

    ``lists``: paths, from the column's name on, at which a list of objects is expected.
    ``fields``: only values of these names are given out; objects always are. Null and incomplete
    documents give no triple; null keys are kept; other columns are ignored. A record delivered
    again gives its triples again.
    """
    documents = [x for i, c in enumerate(columns) for x in (F.col(c).cast("string").alias(f"_{i}"), F.xxhash64(F.col(c).cast("string")).alias(f"_v{i}"))]
    picked = records.select(F.col(key).cast("string").alias("record_id"), *documents)
    return picked.mapInArrow(_stream(frozenset(lists), tuple(columns), None if fields is None else frozenset(fields)), TRIPLE_SCHEMA)


def field_names(found: DataFrame) -> DataFrame:
    """Names of the fields that occur in each table of triples, once each: table_path, field."""
    return found.where("field is not null").select("table_path", "field").distinct()


def objects(found: DataFrame, tables: tuple[str, ...] = tuple(FINDING_LISTS)) -> DataFrame:
    """The objects of tables, once each, from their triples: record_id, version, table_path,
    row_path, parent_path, ordinal. All triples of an object are grouped by their repeated
    ancestor and position, as ``pivoted`` does, for all tables at once and without values."""
    return found.where(F.col("table_path").isin(*tables)).select("record_id", "version", "table_path", "row_path", "parent_path", "ordinal").distinct()


def column_names(fields: list[str], keys: list[str]) -> list[str]:
    """Names of the columns of fields: dots become underscores, clashes with the key columns get
    the prefix ``f_``, and names that are then equal without case get a number."""
    out: list[str] = []
    taken = {k.lower() for k in keys}
    for f in fields:
        name = f"f_{f}" if f in keys or not f else f.replace(".", "_")
        base, n = name, 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def pivoted(found: DataFrame, table_path: str, fields: list[str]) -> DataFrame:
    """One flat table from triples: KEYS and ``fields``.

    ``fields`` are named (see ``field_names`` for those that occur), so one pass makes the table.
    A field that an object lacks is null. Copies of a document collapse; documents that differ
    keep rows of their own, told apart by ``version``. Columns are named by ``column_names``.
    """
    named = zip(fields, column_names(fields, KEYS), strict=True)
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for f, c in named]
    kept = found.where(F.col("table_path") == table_path).groupBy(*KEYS)
    return kept.agg(*columns) if columns else kept.count().drop("count")


def flat_tables(found: DataFrame, listed: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A flat table for each path in ``listed``, with the listed fields first and always, then
    the others that occur. ``found`` is read several times, so it should be a stored stage."""
    occur: dict[str, set[str]] = {}
    for r in field_names(found).where(F.col("table_path").isin(*listed)).collect():  # names, not values
        occur.setdefault(r.table_path, set()).add(r.field)
    return {t: pivoted(found, t, [*fields, *sorted(occur.get(t, set()) - set(fields))]) for t, fields in listed.items()}
