"""Regular expressions with one meaning in Spark: Unicode classes, ``.`` stops at LF only.

The Unicode flag makes matching several times slower, so it is set only for patterns with a
class that it changes; word boundaries are Unicode-aware without it.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _parser as parser
from re._constants import LITERAL

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLASS = re.compile(r"\\[dDsSwW]")


def flagged(pattern: str, any_case: bool = False) -> str:
    """A pattern with the flags that it needs."""
    return f"(?d{'U' if _CLASS.search(pattern) else ''}{'i' if any_case else ''})" + pattern


def _alternatives(pattern: str) -> list[str]:
    """Alternatives at the top level of a pattern."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


@lru_cache(maxsize=1024)
def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals of which every match holds at least one: the longest run of plain characters
    of each alternative. None if an alternative has no such run."""
    out = []
    for alternative in _alternatives(pattern):
        runs, run = [], ""
        for op, value in parser.parse(alternative):
            if op is LITERAL:
                run += chr(value)
            else:
                runs.append(run)
                run = ""
        best = max([*runs, run], key=len)
        if len(best) < 2:
            return None
        out.append(best)
    # A literal that holds another one adds nothing.
    return tuple(a for a in dict.fromkeys(out) if not any(b != a and b in a for b in out))


def matches(text: Column, pattern: str, any_case: bool = False) -> Column:
    """Whether a pattern occurs. Plain substring tests for its required literals come first:
    they are many times cheaper than the pattern and rule out most texts."""
    hit = text.rlike(flagged(pattern, any_case))
    literals = None if any_case else required_literals(pattern)
    return any_of([text.contains(x) for x in literals]) & hit if literals else hit


def extracted(text: Column, pattern: str, any_case: bool = False, group: int = 0, case: str = "", most: int = 0) -> Column:
    """Sorted distinct matches of a pattern, at most ``most`` of them (0: all)."""
    found = F.regexp_extract_all(text, F.lit(flagged(pattern, any_case)), F.lit(group))
    if case:
        found = F.transform(found, F.lower if case == "lower" else F.upper)
    found = F.array_sort(F.array_distinct(found))
    return F.slice(found, 1, most) if most else found


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def exploded(array: Column) -> Column:
    """Explode whose input is evaluated once: the plain one gets a filter on the array's size
    that computes costly arrays a second time. Drop the null element of empty arrays after it."""
    return F.explode_outer(array)


def evaluated_once(df: DataFrame, computed: list[str]) -> DataFrame:
    """A frame whose columns ``computed`` are computed here and nowhere else.

    Filters on costly columns are else pushed below the projection that computes them, which
    copies the whole expression into the filter. A generator over a one-element array is a
    fence for that in the optimizer; it moves no data. All other columns stay outside of it, so
    filters on them reach the scan, and columns that nobody reads are not read.
    """
    fenced = F.explode_outer(F.array(F.struct(*(F.col(f"`{c}`") for c in computed)))).alias("_fenced")
    rest = [c for c in df.columns if c not in computed]
    return df.select(*(F.col(f"`{c}`") for c in rest), fenced).select(*(F.col(f"_fenced.`{c}`").alias(c) if c in computed else F.col(f"`{c}`") for c in df.columns))


def literal_map(table: dict[str, list[str]]) -> Column:
    """A map literal; for small fixed tables it saves a join."""
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def rank_percentile(values: Column, share: float) -> Column:
    """Nearest rank of a sorted array: the index is share * (n - 1), rounded half to even."""
    at = F.bround(F.lit(share) * (F.size(values) - 1).cast("double"))
    return F.element_at(values, (F.least(F.size(values) - 1, at.cast("int")) + 1).cast("int"))
