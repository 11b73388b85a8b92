"""Several values packed in one field, one value per row with its position.

A finite-state tokenizer reads a cell in one pass over its special characters, which one compiled
pattern finds, so plain runs cost no Python step. It tracks quotes, doubled and backslashed quotes
and the nesting of brackets; delimiters count only outside of all of them. Which quotes and
brackets are closed is settled before, by one pass from the right and one with a stack, so a
cell takes time in proportion to its length, however broken it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.functions.arrow import text_array

ITEM_SCHEMA = "scf_row bigint, field_name string, pos bigint, item string"
FRAMEWORK_COLUMNS = ("nist_csf_v2_0", "cis_csc_v8_1", "hipaa", "iso_27001_v2022")

# Cells that mean "no value".
PLACEHOLDERS = {"n/a", "na", "n.a.", "none", "null", "nil", "nan", "-", "--", "---", "–", "—", "?", "tbd", "tbc", "not applicable", "not mapped", "no mapping", "unmapped", "unknown", ".", "#n/a", "empty", "(none)", "[]", "{}", '""'}
_SPACE = " \t\r\n\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
_SPECIAL = re.compile(r'["\\()\[\]{}]|[;,|\t\r\n\v\f\u2028\u2029]|(?<=[\s\xa0])/(?=[\s\xa0]|$)|^/(?=[\s\xa0])')
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_QUOTE = re.compile(r'["\\]')
_BULLETS = "•‣▪●◦∙○■□►▸*-–—+"
_BULLET = re.compile(r"^(?:[•‣▪●◦·∙○■□►▸*\-–—+](?=[\s\xa0\"])|\(?\d{1,2}[.)](?=[\s\xa0])|[a-z]\)(?=[\s\xa0]))[\s\xa0]*")
_GLUED_BULLET = re.compile(r"^[•‣▪●◦∙○■□►▸][\s\xa0]*")


def _clean(value: str) -> str:
    value = value.strip(_SPACE)
    value = _GLUED_BULLET.sub("", _BULLET.sub("", value, count=1), count=1).strip(_SPACE)
    if value in ("-", "*", "•"):
        return ""
    if len(value) > 1 and value[0] == value[-1] == '"' and _whole_quote(value):
        value = re.sub(r'""|\\"', '"', value[1:-1]).strip(_SPACE)
    return value


def _whole_quote(value: str) -> bool:
    """True if the quote at the start is closed by the one at the end."""
    return re.fullmatch(r'"(?:[^"\\]|""|\\.)*"', value, re.S) is not None


def _quote_ends(cell: str) -> dict[int, int]:
    """Where a quotation ends that has reached a quote or backslash: by the place of that character,
    from the right to the left. A doubled or backslashed quote goes on to the next one."""
    places = [m.start() for m in _QUOTE.finditer(cell)]
    ends: dict[int, int] = {}
    for k in range(len(places) - 1, -1, -1):
        at = places[k]
        if cell[at] == '"' and cell[at + 1 : at + 2] != '"':
            ends[at] = at
            continue
        k += 1
        while k < len(places) and places[k] < at + 2:
            k += 1
        if k < len(places) and places[k] in ends:
            ends[at] = ends[places[k]]
    return ends


def _opens(cell: str, at: int) -> bool:
    """True if a quote stands where a value or its bracketed part begins."""
    before = cell[at - 1 : at]
    if not before or before in _SPACE or before in ";,|([{":
        return True
    return before in _BULLETS and (at < 2 or cell[at - 2] in _SPACE or cell[at - 2] in ";,|")


def _outside_quotes(cell: str) -> list[tuple[int, str, int]]:
    """Brackets and delimiters outside quotations: (place, character, end)."""
    marks: list[tuple[int, str, int]] = []
    ends = _quote_ends(cell) if '"' in cell else {}
    skip = -1
    for m in _SPECIAL.finditer(cell):
        at, c = m.start(), m[0]
        if at <= skip or c == "\\":
            continue
        if c == '"':
            after = _QUOTE.search(cell, at + 1)
            if after and after.start() in ends and _opens(cell, at):
                skip = ends[after.start()]
            continue
        marks.append((at, c, m.end()))
    return marks


def _closed_brackets(marks: list[tuple[int, str, int]]) -> set[int]:
    """Places of the brackets that have a partner."""
    stack: list[tuple[str, int]] = []
    waiting = dict.fromkeys(_CLOSE, 0)
    closed: set[int] = set()
    for at, c, _ in marks:
        if c in _OPEN:
            stack.append((_OPEN[c], at))
            waiting[_OPEN[c]] += 1
        elif c in _CLOSE and waiting[c]:
            while True:
                wanted, start = stack.pop()
                waiting[wanted] -= 1
                if wanted == c:
                    break
            closed |= {start, at}
    return closed


def split_cell(cell: str | None) -> list[str]:
    """Values of a packed cell in order; none for null, blank and placeholder cells.

    An unclosed quote or bracket is taken as an ordinary character, so that a stray one does
    not swallow the delimiters behind it; a bracket that closes an outer one leaves those opened
    in between unclosed.
    """
    if cell is None:
        return []
    bare = cell.strip(_SPACE)
    if not bare or bare.lower() in PLACEHOLDERS:
        return []
    if bare[0] == "[" and bare[-1] == "]":
        try:
            listed = json.loads(bare)
            if isinstance(listed, list):
                flat = ["" if x is None else x if isinstance(x, str) else json.dumps(x) for x in listed]
                return [v for x in flat if (v := x.strip(_SPACE))]
        except (ValueError, RecursionError):
            pass  # no list; read as a packed cell
    marks = _outside_quotes(bare)
    closed = _closed_brackets(marks)
    out, start, depth = [], 0, 0
    for at, c, end in marks:
        if c in _OPEN or c in _CLOSE:
            depth += 0 if at not in closed else 1 if c in _OPEN else -1
        elif not depth:
            out.append(bare[start:at])
            start = end
    out.append(bare[start:])
    return [v for x in out if (v := _clean(x))]


def _items(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fields, places, items = [], [], [], []
            ids = batch.column(0).to_pylist()
            for k, name in enumerate(names, 1):
                for row, cell in zip(ids, batch.column(k).to_pylist(), strict=True):
                    values = split_cell(cell)
                    rows += [row] * len(values)
                    fields += [name] * len(values)
                    places += range(1, len(values) + 1)
                    items += values
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(fields, pa.string()), pa.array(places, pa.int64()), text_array(items)], ["scf_row", "field_name", "pos", "item"])

    return run


def packed_items(cells: DataFrame, key: str = "scf_row", columns: tuple[str, ...] = FRAMEWORK_COLUMNS) -> DataFrame:
    """One row per value of each packed cell (ITEM_SCHEMA), repeated rows once.

    Null keys are kept as null; other columns are ignored whatever their names; an empty table
    gives no row.
    """
    picked = cells.select(F.col(key).cast("bigint").alias("k"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)))
    return picked.mapInArrow(_items(tuple(columns)), ITEM_SCHEMA).distinct()
