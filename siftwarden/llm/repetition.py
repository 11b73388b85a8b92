"""Repetition inside single documents.

The measure: the share of a document's words that lie in runs of ten or more words that
already began earlier in the same text. Runs are found by window hashes over a whole batch at
once and confirmed word by word.

What counts as too much is not one fixed share: mergeable quantile sketches of the shares per
language and source give each group its own threshold. A group of few documents takes the one
of its language, a small language that of all documents; both come from the same sketches,
merged. Documents are then filtered by a join with the thresholds of their group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwarden.llm.quantiles import digests, merge_digests, percentiles, share_name
from siftwarden.sources.tables import checkpointed

RUN = 10
#: Least threshold: below it, repetition is common in ordinary texts.
FLOOR = 0.05
#: Documents that a group needs for a threshold of its own.
LEAST = 50
QUANTILE = 0.95
SHARE_SCHEMA = "doc_id bigint, lang string, source string, n_words bigint, n_repeated bigint"
_WORD = re.compile(r"[^\W_]+")
_SLICE_CHARS = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: str) -> list[str]:
    """Lower-cased words. A capital whose lower case has a combining mark must not be cut there,
    so such texts are divided first."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def repeated_words(texts: list[str | None], run: int = RUN) -> tuple[list[int], list[int]]:
    """(words, repeated words) of each text."""
    sizes: list[int] = []
    hits: list[int] = []
    words: list[str] = []
    pending: list[int] = []
    chars = 0

    def settle() -> None:
        nonlocal words, pending, chars
        hits.extend(_repeated(words, pending, run))
        words, pending, chars = [], [], 0

    for t in texts:
        found = _words(t) if t else []
        words += found
        pending.append(len(found))
        sizes.append(len(found))
        chars += len(t or "")
        if chars > _SLICE_CHARS:
            settle()
    settle()
    return sizes, hits


def _repeated(words: list[str], sizes: list[int], run: int) -> list[int]:
    n = len(words)
    if n < run + 1:
        return [0] * len(sizes)
    ids = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy().astype(np.uint64)
    size = np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(sizes)), size)
    last = np.repeat(np.cumsum(size), size)
    at = np.flatnonzero(np.arange(n) + run <= last)
    with np.errstate(over="ignore"):
        coded = _mix(ids)
        window = np.zeros(n - run + 1, np.uint64)
        for j in range(run):
            window = window * np.uint64(0xD6E8FEB86659FD93) + coded[j : n - run + 1 + j]
        keys = window[at] ^ _mix(doc[at].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.empty(len(ranked), bool)
    fresh[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))]
    again, earlier = at[order[~fresh]], at[first[~fresh]]
    if not len(again):
        return [0] * len(sizes)
    same = doc[again] == doc[earlier]  # equal hashes are confirmed by the words themselves
    for j in range(run):
        same &= ids[again + j] == ids[earlier + j]
    starts = again[same]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(sizes)).tolist()


def _measure(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hits = repeated_words(batch.column(3).to_pylist(), run)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "lang", "source", "n_words", "n_repeated"])

    return go


def shares(documents: DataFrame, run: int = RUN) -> DataFrame:
    """SHARE_SCHEMA plus ``share``, one row per input row. Null, empty and wordless texts have 0
    words and share 0; languages compare trimmed and in lower case, null ones are ''."""
    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), F.coalesce(F.trim("source"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    measured = picked.mapInArrow(_measure(run), SHARE_SCHEMA)
    return measured.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0)))


def thresholds(measured: DataFrame, quantile: float = QUANTILE, floor: float = FLOOR, ceiling: float = 1.0, least: int = LEAST) -> DataFrame:
    """(lang, source, threshold): the quantile of each group's shares, from ``floor`` to ``ceiling``.

    Groups of fewer than ``least`` documents take the quantile of their language, those of
    languages with fewer that of all documents. The sketches are made once and merged for both.
    """
    q = share_name(quantile)
    own = checkpointed(digests(measured, ["lang", "source"], "share")).withColumn("_all", F.lit(1))  # read three times

    def cut(sketches: DataFrame, keys: list[str], name: str) -> DataFrame:
        return percentiles(sketches, keys, (quantile,), whole=False).select(*keys, F.when(F.col("n_values") >= least, F.col(q)).alias(name))

    groups = cut(own, ["lang", "source"], "_own")
    languages = cut(merge_digests(own, ["lang"]), ["lang"], "_lang")
    every = percentiles(merge_digests(own, ["_all"]), ["_all"], (quantile,), whole=False).select(F.col(q).alias("_every"))
    held = groups.join(languages, "lang").join(F.broadcast(every))  # one row
    found = F.coalesce("_own", "_lang", "_every")
    return held.select("lang", "source", F.least(F.greatest(found, F.lit(floor)), F.lit(ceiling)).alias("threshold"))


def flagged(documents: DataFrame, quantile: float = QUANTILE, floor: float = FLOOR, ceiling: float = 1.0, run: int = RUN, least: int = LEAST) -> DataFrame:
    """Documents at or over their group's threshold: SHARE_SCHEMA, share, threshold.

    ``ceiling`` bounds the thresholds where documents of a certain share must be among the
    result. The measure is made once: its narrow result goes through the shared checkpoint
    folder. Documents without repeated words are never flagged; an empty table gives no row.
    """
    measured = checkpointed(shares(documents, run))
    return measured.join(thresholds(measured, quantile, floor, ceiling, least), ["lang", "source"]).where((F.col("share") >= F.col("threshold")) & (F.col("n_repeated") > 0))
