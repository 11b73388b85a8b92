import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwarden.functions import deepjson

VALUES = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda x: st.one_of(st.lists(x), st.dictionaries(st.text(), x)), max_leaves=30)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1]))
def test_the_explicit_stack_reads_as_the_decoder_does(value, indent):
    text = json.dumps(value, indent=indent)
    assert deepjson._read(text, 0) == (value, len(text))


@given(st.text('{}[],:"0a1 -.e', max_size=12))
def test_broken_texts_are_rejected_alike(text):
    def outcome(read):
        try:
            return repr(read())
        except (ValueError, IndexError):
            return None

    bare = text.strip()
    want = outcome(lambda: json.loads(bare)) if bare else None
    got = outcome(lambda: deepjson._read(bare, 0))
    if want is not None:
        assert got == f"({want}, {len(bare)})"
    elif got is not None:
        assert not got.endswith(f", {len(bare)})")


@pytest.mark.parametrize(("head", "tail"), [('{"a":', "}"), ("[", "]")])
def test_depth_is_no_limit(head, tail):
    n = 200_000
    text = head * n + "1" + tail * n
    began = time.perf_counter()
    value = deepjson.loads(text)
    assert deepjson.dumps(value) == text
    assert time.perf_counter() - began < 10
    with pytest.raises(ValueError):
        deepjson.loads(text[:-1])
    with pytest.raises(ValueError):
        deepjson.loads(text + "1")
    while value != 1:  # taken apart from the outside, so that no destructor recurses
        value = value["a"] if isinstance(value, dict) else value[0]


@settings(max_examples=300, deadline=None)
@given(st.text('{}[]:,"a1 ', max_size=24))
def test_first_object_against_trying_every_place(text):
    def brute():
        for i, c in enumerate(text):
            if c == "{":
                try:
                    return i, json.JSONDecoder().raw_decode(text, i)[1]
                except ValueError:
                    pass
        return None

    got, want = deepjson.first_object(text), brute()
    assert (got is None) == (want is None)
    if got:
        assert json.loads(text[got[0] : got[1]]) is not None and got[0] >= want[0]


def test_first_object_takes_time_with_the_length():
    began = time.perf_counter()
    assert deepjson.first_object('{"a":' * 200_000) is None
    assert deepjson.first_object('{"a":' * 200_000 + "x") is None
    assert deepjson.first_object("{" * 200_000) is None
    assert deepjson.first_object('see {x} {"a": {"b": 1}, "c') == (14, 22)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("part", ["{", '{"a":x', '{"a" ', '{"\n'])
def test_many_failing_objects_take_time_with_the_length(part):
    def took(n):
        began = time.process_time()
        assert deepjson.first_object(part * n) is None
        return time.process_time() - began

    took(1000)
    assert took(320_000) < 50 * took(20_000)  # 16 times the length
