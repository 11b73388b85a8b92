"""Filling containers of fixed capacity with documents, sized in tokens.

Each task packs the documents of its own partition, so nothing is shuffled and a partition
wastes less than one container. Documents are taken up in groups whose sizes add up to nearly
a whole number of containers. A group is divided by Karmarkar-Karp multiway differencing: every
item starts as a partial partition with one filled part; the two partial partitions with the
largest differences are merged, large parts with small ones, until one is left, whose parts
are near-equal.
In a group that is nearly full, an item of a part over capacity moves to the tightest part
that has room, else to the next group; the last group, and one where that does not help, gets
one more container until all parts fit.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm.tokens import TOKENIZER, encoder, read_vocabulary

CAPACITY = 2048
#: Containers of a group; more level the parts better and cost more time per item.
GROUP = 48
#: Share of a group's room that is left free for the differences between parts.
SLACK = 0.0015
PIECE_SCHEMA = "doc_id bigint, part bigint, token_start bigint, n_tokens bigint, container_id string"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Divides items into k near-equal parts: the positions of the items of each part."""
    if k == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(k - 1))]
    # A partial partition: its sums, largest first, and its parts as trees of positions.
    heap: list[tuple] = []
    for i, s in enumerate(sizes):
        if s:
            sums = np.zeros(k, np.int64)
            sums[0] = s
            heap.append((-s, i, sums, [i] + [None] * (k - 1)))
    if not heap:
        return [list(range(len(sizes))), *([] for _ in range(k - 1))]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        parts = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), serial, sums, [parts[j] for j in order.tolist()]))
        serial += 1
    out: list[list[int]] = []
    for tree in heap[0][3]:
        held, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            elif node is not None:
                held.append(node)
        out.append(sorted(held))
    out[-1] += [i for i, s in enumerate(sizes) if not s]  # empty items where most room is
    return out


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts of at most ``capacity`` for items of at most ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


class Packer:
    """Takes documents in order and gives back the pieces of full groups."""

    def __init__(self, name: str, capacity: int = CAPACITY, group: int = GROUP, slack: float = SLACK) -> None:
        self.name, self.capacity = name, capacity
        self.room = int(group * capacity * (1 - slack))
        self.serial = 0
        self.held: list[tuple] = []
        self.total = 0

    def _container(self) -> str:
        self.serial += 1
        return f"{self.name}-{self.serial:06d}"

    def add(self, doc: int | None, tokens: int) -> list[tuple]:
        out, part, start = [], 0, 0
        while tokens - start > self.capacity:  # only these are split
            out.append((doc, part, start, self.capacity, self._container()))
            part, start = part + 1, start + self.capacity
        size = tokens - start
        if self.total + size > self.room:
            out += self._full()
        self.held.append((doc, part, start, size))
        self.total += size
        return out

    def _full(self) -> list[tuple]:
        """Pieces of a group that is nearly full.

        Where a part comes out over capacity, its smallest item that is large enough goes where
        room is left, else waits for the next group. If too much had to wait, the group gets
        further containers instead.
        """
        items = self.held
        parts = differencing([x[3] for x in items], self.total // self.capacity + 1)
        waiting = []
        for p in parts:
            over = sum(items[i][3] for i in p) - self.capacity
            if over > 0:
                fit = min((i for i in p if items[i][3] >= over), key=lambda i: items[i][3], default=None)
                if fit is None:  # no single item makes room: more containers do
                    return self.flush()
                p.remove(fit)
                waiting.append(fit)
        room = sorted((self.capacity - sum(items[i][3] for i in p), j) for j, p in enumerate(parts))
        kept = []
        for i in sorted(waiting, key=lambda i: -items[i][3]):
            at = bisect_left(room, (items[i][3], -1))
            if at < len(room):
                gap, j = room.pop(at)
                parts[j].append(i)
                insort(room, (gap - items[i][3], j))
            else:
                kept.append(i)
        waiting = kept
        if sum(items[i][3] for i in waiting) > self.total // 4:
            return self.flush()
        self.held = [items[i] for i in sorted(waiting)]
        self.total = sum(x[3] for x in self.held)
        return self._named(items, parts)

    def _named(self, items: list[tuple], parts: list[list[int]]) -> list[tuple]:
        out = []
        for p in parts:
            if p:
                name = self._container()
                out += [(*items[i], name) for i in p]
        return out

    def flush(self) -> list[tuple]:
        """Pieces of all that is held."""
        out = self._named(self.held, pack([x[3] for x in self.held], self.capacity)) if self.held else []
        self.held, self.total = [], 0
        return out


def _pack(vocabulary: bytes, capacity: int, group: int, slack: float):
    names = ["doc_id", "part", "token_start", "n_tokens", "container_id"]
    types = [pa.int64()] * 4 + [pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(f"{context.partitionId() if context else 0:06d}", capacity, group, slack)
        own = encoder(vocabulary)
        for batch in batches:
            offsets, _ = own.encode_column(batch.column(1), ids=False)
            rows: list[tuple] = []
            for doc, n in zip(batch.column(0).to_pylist(), np.diff(offsets).tolist(), strict=True):
                rows += packer.add(doc, n)
            yield batch_of(rows)
        yield batch_of(packer.flush())

    return run


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group: int = GROUP, slack: float = SLACK) -> DataFrame:
    """PIECE_SCHEMA: the container of each document, or of each piece of those over capacity.

    Null and empty texts have size 0 and a container like all others; repeated rows are packed
    as often as they occur; null keys stay null; an empty table gives no row. Containers are
    named by partition and number, so they differ between different splits of the input.
    """
    picked = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(_pack(read_vocabulary(tokenizer), capacity, group, slack), PIECE_SCHEMA)


def fill(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, documents, tokens and unused share over all pieces."""
    per = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    room = F.count(F.lit(1)) * F.lit(capacity)
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round((room - F.sum("used")) / room, 4).alias("unused_share"))
