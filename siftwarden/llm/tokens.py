"""Encoding of a corpus by a public byte-level BPE tokenizer.

Two neighbouring bytes that occur inside no vocabulary token can never end up in one token, so
a cut between them is certain. All certain cuts of a batch are found at once by looking its
byte pairs up in a table; the fragments between them are encoded independently and their ids
concatenated. As most fragments are frequent words, each distinct fragment is encoded once,
and ids are put together with array arithmetic.

Cuts are only made where splitting cannot change how the tokenizer's own pattern divides the
text: never inside a character, never behind white space (the pattern looks ahead there) and
before an apostrophe only behind a letter or digit (a contraction could begin there).
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("SIFTWARDEN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of a batch are taken together up to so many bytes at once.
SLICE_BYTES = 4 << 20
#: Distinct fragments kept between slices; only speed depends on it.
MEMO = 400_000


class Encoder:
    """``vocabulary``: content of a rank file (base64 token and rank per line)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.certain = certain_cuts(ranks)
        self.memo: dict[bytes, np.ndarray] = {}

    def encode(self, text: str) -> list[int]:
        """The plain way, for one text."""
        return self.bpe.encode_ordinary(text)

    def _ids(self, fragments: list[bytes]) -> list[np.ndarray]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for f in fragments:
            ids = memo.get(f)
            if ids is None:
                ids = np.array(self.bpe.encode_ordinary(f.decode("utf-8", "replace")), np.int32)
                if len(f) < 64:
                    memo[f] = ids
            out.append(ids)
        return out

    def fragments(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Offsets of all fragments of bytes in which texts begin at ``starts``."""
        cut = np.zeros(len(data), bool)
        np.take(self.certain, data[:-1].astype(np.uint16) << 8 | data[1:], out=cut[1:])
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode_column(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, flat ids) of a column of strings; null is like ''. Without ``ids`` only the
        offsets are made, which give the number of tokens."""
        sizes, parts = [], []
        at = 0
        lengths = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        while at < len(texts):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            stop = max(stop, at + 1)
            n, flat = self._slice(texts.slice(at, stop - at), lengths[at:stop], ids)
            sizes.append(n)
            parts.append(flat)
            at = stop
        counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _slice(self, texts: pa.Array, lengths: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(x for x in texts.cast(pa.binary()).to_pylist() if x), np.uint8)
        if not len(data):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        offsets = self.fragments(data, np.unique(starts[lengths > 0]))
        bounds = np.append(offsets, len(data)).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        which = coded.indices.to_numpy()
        known = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter((len(x) for x in known), np.int64, len(known))
        per = size[which]
        total = np.concatenate([[0], np.cumsum(per)])
        # Tokens of a text: those of its fragments.
        first = np.searchsorted(offsets, starts)
        last = np.searchsorted(offsets, ends)
        counts = np.where(lengths > 0, total[last] - total[first], 0)
        if not ids:
            return counts, np.zeros(0, np.int32)
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        pool = np.concatenate(known)
        places = np.arange(total[-1]) - np.repeat(total[:-1] - base[which], per)
        return counts, pool[places]


_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)}


def certain_cuts(tokens: Iterable[bytes]) -> np.ndarray:
    """Table over byte pairs (first * 256 + second): whether a cut between them is certain."""
    out = np.ones(65_536, bool)
    for t in tokens:
        for a, b in zip(t, t[1:], strict=False):
            out[a << 8 | b] = False
    table = out.reshape(256, 256)
    table[:, 0x80:0xC0] = False  # inside a character
    # Behind white space; beyond ASCII it is told by its last byte, which errs on the safe side.
    for c in map(chr, range(0x3001)):
        if c.isspace() or unicodedata.category(c).startswith("Z"):
            table[c.encode()[-1], :] = False
    # Before an apostrophe, but for those behind an ASCII letter or digit.
    table[[b for b in range(256) if b not in _WORD_BYTES], 0x27] = False
    return out


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(vocabulary)


def read_vocabulary(path: str = TOKENIZER) -> bytes:
    """The rank file, read once by the driver and sent along with the tasks (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _encode(vocabulary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            offsets, flat = own.encode_column(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of each row, without special tokens. Null and empty texts give an empty
    list; null keys stay null; repeated rows stay; no shuffle."""
    picked = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(_encode(read_vocabulary(tokenizer)), "doc_id bigint, ids array<int>")


def _count(vocabulary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            offsets, _ = own.encode_column(batch.column(1), ids=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row."""
    picked = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(_count(read_vocabulary(tokenizer)), "doc_id bigint, n_tokens bigint")
