import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwarden.llm import packing, tokens

if not os.path.exists(tokens.TOKENIZER):
    pytest.skip("no tokenizer files", allow_module_level=True)
OWN = tokens.encoder(tokens.read_vocabulary())
TEXT = st.one_of(st.text(max_size=80), st.text("a B1 \n\t's.-ll 　\u0085é日😀!\"", max_size=60))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_ids_are_those_of_the_plain_encoder(texts):
    offsets, flat = OWN.encode_column(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == OWN.encode(t or "")


def test_long_texts_and_slices():
    texts = ["word " * 2_000_000, "", None, "x" * 100_000, "<|endoftext|>"]
    offsets, flat = OWN.encode_column(pa.array(texts))
    assert [offsets[i + 1] - offsets[i] for i in range(5)] == [len(OWN.encode(t or "")) for t in texts]
    assert OWN.bpe.decode(flat[offsets[4] :].tolist()) == "<|endoftext|>"


def test_cuts_are_certain():
    table = OWN.certain.reshape(256, 256)
    assert table[ord("a"), ord(" ")] and not table[ord("a"), ord("b")] and not table[ord(" "), ord("a")]
    for token in OWN.bpe._mergeable_ranks:
        assert not any(table[a, b] for a, b in zip(token, token[1:], strict=False))


def test_frames(spark):
    df = spark.createDataFrame([(1, "Control 7", 3), (1, "Control 7", 3), (2, "", 3), (3, None, 3), (None, "x", 3)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode_documents(df).collect()), key=str)
    want = OWN.encode("Control 7")
    assert got == sorted([(1, want), (1, want), (2, []), (3, []), (None, OWN.encode("x"))], key=str)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokens.count_tokens(df).collect()) == [(0, 1), (1, len(want)), (1, len(want)), (2, 0), (3, 0)]
    assert tokens.encode_documents(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_parts_hold_every_item_once(sizes):
    parts = packing.pack(sizes, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 100 for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=150), st.integers(1, 6))
def test_packer(sizes, group):
    p = packing.Packer("p", 100, group, 0.01)
    rows = [r for i, s in enumerate(sizes) for r in p.add(i, s)] + p.flush()
    used, pieces = {}, {}
    for doc, part, start, n, name in rows:
        used[name] = used.get(name, 0) + n
        pieces.setdefault(doc, []).append((part, start, n))
    assert all(v <= 100 for v in used.values()) and set(pieces) == set(range(len(sizes)))
    for doc, held in pieces.items():
        held.sort()
        assert sum(n for *_, n in held) == sizes[doc] and [s for _, s, _ in held] == [100 * k for k in range(len(held))]
        assert len(held) == max(1, -(-sizes[doc] // 100))


def test_little_room_is_left():
    import random

    rng = random.Random(4)
    sizes = [min(2048, int(rng.lognormvariate(5.7, 0.8))) for _ in range(3000)]
    p = packing.Packer("p")
    rows = [r for i, s in enumerate(sizes) for r in p.add(i, s)] + p.flush()
    assert sum(sizes) / (2048 * len({r[4] for r in rows})) > 0.97


def test_packed_frame(spark):
    df = spark.createDataFrame([(i, "word " * (i % 300), 1) for i in range(400)] + [(None, None, 1), (7, "a " * 5000, 1)], "doc_id bigint, text string, part int")
    pieces = packing.pack_documents(df)
    f = packing.fill(pieces).collect()[0]
    assert f.fullest <= 2048 and f.n_pieces == pieces.count() and pieces.select("doc_id").distinct().count() == 401
    assert packing.pack_documents(df.limit(0)).count() == 0
