"""Verdict cache: which events are served by the verdict of an earlier one of their shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 24 * 3600


def _led(ttl: int):
    """Batches sorted by (shape, time, sequence) with their leaders. All that is kept between
    batches is one leader; within a batch the chain jumps from leader to leader by bisection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape: object = None
        lead_at = lead_seq = None
        for batch in batches:
            n = batch.num_rows
            shapes = batch.column(0).dictionary_encode()
            codes = shapes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            words = shapes.dictionary.to_pylist()
            at = batch.column(1).to_numpy(zero_copy_only=False)
            seq = batch.column(2).to_numpy(zero_copy_only=False)
            leaders = np.empty(n, np.int64)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n] if n else []
            for start, end in zip(edges, edges[1:], strict=False):
                own = words[codes[start]] if codes[start] >= 0 else None
                if own != shape or lead_at is None:
                    shape, lead_at = own, None
                i = start
                while i < end:
                    if lead_at is not None:
                        j = i + int(np.searchsorted(at[i:end], lead_at + ttl, side="right"))
                        leaders[i:j] = lead_seq
                        i = j
                    if i < end:
                        lead_at, lead_seq = int(at[i]), int(seq[i])
                        leaders[i] = lead_seq
                        i += 1
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(leaders)], ["seq", "leader"])

    return run


def cached(events: DataFrame, shape: str = "shape", seq: str = "event_seq", ts: str = "ts", ttl: int = TTL_SECONDS) -> DataFrame:
    """(seq, leader_seq, is_hit) of each event; ``seq`` is unique.

    A leader stores its verdict for ``ttl`` seconds; events of the shape within that time, the
    limit included, are hits and do not extend it. The next one is a leader again. Ties are
    ordered by ``seq``; an event without a time is its own leader; null shapes are one shape.

    Finding leaders is a chain (each depends on the one before), so a shape is one sorted stream.
    It carries three narrow columns, is sorted with spilling, and is passed with one leader in
    memory, whatever the number of its events.
    """
    narrow = events.select(F.col(shape).cast("string").alias("shape"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("bigint").alias("seq"))
    timed = narrow.where("at is not null").repartition("shape").sortWithinPartitions("shape", "at", "seq")
    led = timed.mapInArrow(_led(ttl * 1_000_000), "seq bigint, leader bigint")
    every = led.unionByName(narrow.where("at is null").select("seq", F.col("seq").alias("leader")))
    return every.select(F.col("seq").alias(seq), F.col("leader").alias("leader_seq"), (F.col("leader") != F.col("seq")).alias("is_hit"))
