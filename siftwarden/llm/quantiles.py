"""Percentiles of very large numeric columns by mergeable digests with a true rank error.

Values are mapped to a bounded ordered universe, the signed 64-bit codes: integers are their own
code, other numbers take the bits of the double in an order-preserving form, so negatives and
fractions keep their place and no two values share a leaf. A digest (a q-digest) counts dyadic
ranges of codes, from single codes (span 0) up to half the universe (span HEIGHT). Light siblings are merged into
their parent while the three of them hold at most n/k values. Digests are merged by adding the
counts of equal nodes and merging light siblings again.

Every range that is more than one code holds at most n//k values and a code lies in at most
HEIGHT of them, so the rank of a reported value is off by at most HEIGHT * (n//k), whatever the
data and the order of merging. The error given with a result is the one that its own digest
proves, which is far smaller in general and 0 for groups of fewer than k values.

Each task builds digests of its own rows; only their nodes are shuffled. They are merged twice,
first by group and salt, then by group, in sorted order, so that a group with a third of all
rows costs no task more than a bounded number of nodes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of ranges over the leaves; above them the universe has two halves, by sign.
HEIGHT = 63
COMPRESSION = 10_000
PERCENTILES = (0.5, 0.9, 0.95, 0.99)
#: Ways into which a group's partial digests are dealt before they meet.
SALTS = 16
#: Nodes that a task holds over all groups before it gives its partial digests out.
HELD = 1_000_000
_BEHIND_SIGN = np.int64(2**63 - 1)
#: (lows, spans, counts): the ranges low .. low + 2**span - 1 and how many values are there.
Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


def codes_of(values: np.ndarray) -> np.ndarray:
    """Order-preserving 64-bit codes of integers or doubles; equal numbers have equal codes."""
    if values.dtype.kind in "iu":
        return values.astype(np.int64)
    bits = (values.astype(np.float64) + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return np.where(bits < 0, bits ^ _BEHIND_SIGN, bits)


def value_of(code: int, whole: bool) -> int | float:
    """The number of a code."""
    if whole:
        return int(code)
    bits = np.int64(code)
    return float((bits ^ _BEHIND_SIGN if bits < 0 else bits).view(np.float64))


def _mask(span: np.ndarray | int) -> np.ndarray:
    return (np.left_shift(np.uint64(1), np.asarray(span, np.uint64)) - np.uint64(1)).view(np.int64)


def nodes_of(codes: np.ndarray) -> Nodes:
    """Leaves of a list of codes."""
    low, n = np.unique(codes, return_counts=True)
    return low, np.zeros(len(low), np.int64), n.astype(np.int64)


def added(nodes: Nodes) -> Nodes:
    """Equal nodes added up."""
    low, span, n = nodes
    order = np.lexsort((span, low))
    low, span, n = low[order], span[order], n[order]
    if not len(low):
        return low, span, n
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (span[1:] != span[:-1])])
    return low[first], span[first], np.add.reduceat(n, first)


def compressed(nodes: Nodes, k: int = COMPRESSION) -> Nodes:
    """Adds equal nodes up and merges light siblings upwards."""
    low, span, n = added(nodes)
    most = int(n.sum()) // k
    if not most:
        return low, span, n
    kept: list[Nodes] = []
    here_low, here_n = low[span == 0], n[span == 0]
    for s in range(HEIGHT):
        above = span == s + 1
        up_low, up_n = low[above], n[above]
        if not len(here_low):
            here_low, here_n = up_low, up_n
            continue
        parent = here_low & ~_mask(s + 1)
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        heads, total = parent[first], np.add.reduceat(here_n, first)
        if len(up_low):
            at = np.minimum(np.searchsorted(up_low, heads), len(up_low) - 1)
            total = total + np.where(up_low[at] == heads, up_n[at], 0)
        light = total <= most
        stay = ~np.repeat(light, np.diff(np.r_[first, len(parent)]))
        kept.append((here_low[stay], np.full(int(stay.sum()), s, np.int64), here_n[stay]))
        # A merged parent takes the place of its children and of its own node.
        own = ~np.isin(up_low, heads[light])
        here_low, here_n = np.r_[up_low[own], heads[light]], np.r_[up_n[own], total[light]]
        order = np.argsort(here_low, kind="stable")
        here_low, here_n = here_low[order], here_n[order]
    kept.append((here_low, np.full(len(here_low), HEIGHT, np.int64), here_n))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))  # type: ignore[return-value]


def merged(*digests: Nodes, k: int = COMPRESSION) -> Nodes:
    """One digest for the union of several."""
    return compressed(tuple(np.concatenate(x) for x in zip(*digests, strict=True)), k)  # type: ignore[arg-type]


def wanted_rank(share: float, n: int) -> int:
    """Nearest rank, from 1: ``share * (n - 1)`` rounded half to even, plus 1."""
    return min(n - 1, round(share * (n - 1))) + 1


def percentile(nodes: Nodes, share: float) -> tuple[int, int] | None:
    """(code, rank error) for a share; None for an empty digest.

    Nodes are passed by the right end of their range until the wanted rank is reached; that end
    is the code. At least so many values are not above it. Below it are at most all values of
    nodes that begin below it: by so much the rank may be too high.
    """
    low, span, n = nodes
    total = int(n.sum())
    if not total:
        return None
    high = low | _mask(span)
    order = np.lexsort((span, high))
    rank = wanted_rank(share, total)
    code = high[order[np.searchsorted(np.cumsum(n[order]), rank)]]
    return int(code), max(0, int(n[low < code].sum()) + 1 - rank)


def rank_bound(n: int, k: int = COMPRESSION) -> int:
    """Greatest rank error of any digest of n values."""
    return HEIGHT * (n // k)


# -- frames ---------------------------------------------------------------------------------

_NODES = "array<struct<low:bigint,span:int,n:bigint>>"
_NODE_TYPE = pa.list_(pa.struct([("low", pa.int64()), ("span", pa.int32()), ("n", pa.int64())]))


def _groups(rows: pa.Table, keys: list[str]) -> tuple[pa.Table, list[Nodes]]:
    """Rows (keys, low, span, n) by key, in order of first sight."""
    held = rows.group_by(keys, use_threads=False).aggregate([("low", "list"), ("span", "list"), ("n", "list")])
    lists = [held[f"{c}_list"].combine_chunks() for c in ("low", "span", "n")]
    parts = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    at = [p.offsets.to_numpy() for p in parts]
    flat = [p.values.to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]
    out = [tuple(v[o[i] : o[i + 1]] for v, o in zip(flat, at, strict=True)) for i in range(held.num_rows)]
    return held.select(keys), out  # type: ignore[return-value]


def _ungrouped(heads: pa.Table, nodes: list[Nodes], keys: list[str]) -> pa.Table:
    counts = [len(x[0]) for x in nodes]
    at = pa.array(np.repeat(np.arange(len(nodes)), counts))
    joined = [np.concatenate([x[i] for x in nodes]) if nodes else np.empty(0, np.int64) for i in range(3)]
    columns = [*(heads[c].take(at) for c in keys), pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int32()), pa.array(joined[2], pa.int64())]
    return pa.table(columns, [*keys, "low", "span", "n"])


def _lightened(rows: pa.Table, keys: list[str], k: int) -> pa.Table:
    heads, nodes = _groups(rows, keys)
    return _ungrouped(heads, [compressed(x, k) for x in nodes], keys)


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=50_000)


def _partial(keys: list[str], k: int, most: int):
    """Values of a task into partial digests, as rows of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            codes = codes_of(batch.column(len(keys)).to_numpy(zero_copy_only=False))
            one = pa.table([*(batch.column(i) for i in range(len(keys))), pa.array(codes)], [*keys, "low"])
            counted = one.group_by([*keys, "low"], use_threads=False).aggregate([([], "count_all")])
            size = counted.num_rows
            rows = pa.table([*(counted[c] for c in keys), counted["low"], pa.array(np.zeros(size, np.int32)), counted["count_all"]], [*keys, "low", "span", "n"])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows > most:
                held = _lightened(held, keys, k)
                if held.num_rows > most // 2:
                    yield from _batches(held)
                    held = None
        if held is not None and held.num_rows:
            yield from _batches(_lightened(held, keys, k))

    return run


def _merge(keys: list[str], k: int, whole: bool):
    """Rows of nodes, sorted by group, into one digest per group: as rows of nodes, or
    (``whole``) one row per group with all its nodes. Only one group is open at a time and is
    compressed as it grows."""

    def out(heads: pa.Table, nodes: list[Nodes]) -> Iterator[pa.RecordBatch]:
        if not nodes:
            return
        if not whole:
            yield from _batches(_ungrouped(heads, nodes, keys))
            return
        counts = np.cumsum([0, *(len(x[0]) for x in nodes)])
        joined = [np.concatenate([x[i] for x in nodes]) for i in range(3)]
        struct = pa.StructArray.from_arrays([pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int32()), pa.array(joined[2], pa.int64())], ["low", "span", "n"])
        lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), struct)
        yield from pa.table([*(heads[c] for c in keys), lists], [*keys, "nodes"]).combine_chunks().to_batches(max_chunksize=64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table([batch.column(i) for i in range(len(keys) + 3)], [*keys, "low", "span", "n"])
            held = rows if held is None else pa.concat_tables([held, rows])
            heads, nodes = _groups(held, keys)
            nodes = [compressed(x, k) for x in nodes]
            yield from out(heads.slice(0, len(nodes) - 1), nodes[:-1])
            held = _ungrouped(heads.slice(len(nodes) - 1), nodes[-1:], keys)
        if held is not None:
            yield from out(*_groups(held, keys))

    return run


def _schema(of: DataFrame, keys: list[str], rest: str) -> str:
    types = dict(of.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keys), rest])


_ROWS = "low bigint, span int, n bigint"


def _to_digests(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (keys, low, span, n) into one digest per key."""
    salted = nodes.withColumn("_salt", (F.spark_partition_id() % SALTS)).select(*keys, "low", "span", "n", "_salt")
    dealt = salted.repartition(*keys, "_salt").drop("_salt").sortWithinPartitions(*keys)
    once = dealt.mapInArrow(_merge(keys, k, False), _schema(nodes, keys, _ROWS))
    return once.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys, k, True), _schema(nodes, keys, f"nodes {_NODES}"))


def _aliased(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    own = [f"_k{i}" for i in range(len(keys))]
    return df.withColumnsRenamed(dict(zip(keys, own, strict=True))), own


def _restored(df: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def digests(values: DataFrame, keys: list[str], value: str, k: int = COMPRESSION) -> DataFrame:
    """A digest per group: (keys, nodes). Null and NaN values are left out; null keys form a
    group of their own; other columns are ignored; an empty table gives no row. Decimals count
    as doubles."""
    kind = dict(values.dtypes)[value]
    number = F.col(f"`{value}`").cast("bigint" if kind in _WHOLE else "double")
    picked, own = _aliased(values.select(*keys, number.alias("_v")), keys)
    known = picked.where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    nodes = known.mapInArrow(_partial(own, k, HELD), _schema(known, own, _ROWS))
    return _restored(_to_digests(nodes, own, k), keys, own)


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def merge_digests(parts: DataFrame, keys: list[str], k: int = COMPRESSION) -> DataFrame:
    """Digests of finer groups, partitions or days, merged per ``keys``."""
    picked, own = _aliased(parts.select(*keys, F.explode("nodes").alias("_x")), keys)
    return _restored(_to_digests(picked.select(*own, "_x.low", "_x.span", "_x.n"), own, k), keys, own)


def _percentile_batches(n_keys: int, names: list[str], shares: tuple[float, ...], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(n_keys)
            at, flat = lists.offsets.to_numpy(), lists.values
            fields = [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            sizes, found, errors = [], [[] for _ in shares], []
            for i in range(len(lists)):
                nodes = tuple(x[at[i] : at[i + 1]] for x in fields)
                read = [percentile(nodes, s) for s in shares]
                sizes.append(int(nodes[2].sum()))
                for held, r in zip(found, read, strict=True):
                    held.append(None if r is None else value_of(r[0], whole))
                errors.append(max((r[1] for r in read if r), default=0))
            kind = pa.int64() if whole else pa.float64()
            columns = [*(batch.column(i) for i in range(n_keys)), pa.array(sizes, pa.int64()), *(pa.array(x, kind) for x in found), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def share_name(share: float) -> str:
    return f"p{share * 100:g}".replace(".", "_")


def percentiles(of: DataFrame, keys: list[str], shares: tuple[float, ...] = PERCENTILES, whole: bool = True) -> DataFrame:
    """(keys, n_values, p50, ..., rank_error) from digests; ``whole`` for digests of integers.

    A percentile is the value of the nearest rank (``wanted_rank``). ``rank_error`` holds for
    all of a row's values: the wanted rank is at most so many places away from those that the
    value has (or would have) among the group's sorted values.
    """
    names = [*keys, "n_values", *(share_name(s) for s in shares), "rank_error"]
    kind = "bigint" if whole else "double"
    rest = ", ".join(["n_values bigint", *(f"{share_name(s)} {kind}" for s in shares), "rank_error bigint"])
    return of.select(*keys, "nodes").mapInArrow(_percentile_batches(len(keys), names, shares, whole), _schema(of, keys, rest))


def once_per_id(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of one row per id, the least where rows of an id differ. Rows without an id
    count once for each distinct content."""
    held = F.struct(*columns)
    own = F.when(F.col(key).isNull(), F.xxhash64(*columns))
    picked = rows.groupBy(F.col(key).alias("_id"), own.alias("_own")).agg(F.min(held).alias("_x"))
    return picked.select("_x.*")
