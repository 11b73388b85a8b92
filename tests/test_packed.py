import json

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftwarden.operators import packed

CASES = [
    (None, []), ("", []), ("  ", []), ("N/A", []), ("—", []), ("none", []), ("-", []),
    ("a,b;c|d\te\nf\r\ng", list("abcdefg")), ("a / b", ["a", "b"]), ("a/b", ["a/b"]), ("a,, ;b;", ["a", "b"]),
    ("x [p; q], y (r, s)", ["x [p; q]", "y (r, s)"]), ("164.308(a)(1)(ii)(A) ; 164.310(b)", ["164.308(a)(1)(ii)(A)", "164.310(b)"]),
    ('"a, b",c', ["a, b", "c"]), ('"a ""b; c""" | d', ['a "b; c"', "d"]), ('["a","b, c", null, ""]', ["a", "b, c"]),
    ("• a\n• b", ["a", "b"]), ("- a\n* b", ["a", "b"]), ('- "a; b"\n- c', ["a; b", "c"]), ("a (b, c", ["a (b", "c"]), ('a "b, c', ['a "b', "c"]), ("-5, -6", ["-5", "-6"]),
    ("x (a [b; c], d), e", ["x (a [b; c], d)", "e"]),
]


@pytest.mark.parametrize(("cell", "want"), CASES)
def test_cells(cell, want):
    assert packed.split_cell(cell) == want


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\\"), min_size=1).map(str.strip).filter(lambda x: x and x[0] not in "-–—+*•" and x.lower() not in packed.PLACEHOLDERS), min_size=2, max_size=6))
def test_quoted_values_come_back(values):
    values = [v for v in (packed._clean('"' + v.replace('"', '""') + '"') for v in values) if v]
    cell = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    if len(values) > 1:
        assert packed.split_cell(cell) == values


@given(st.text(max_size=60))
def test_any_text_is_read(cell):
    for v in packed.split_cell(cell):
        assert v == v.strip() and v


def test_json_lists_and_long_cells():
    assert packed.split_cell(json.dumps([str(i) for i in range(5000)])) == [str(i) for i in range(5000)]
    assert len(packed.split_cell("a(" * 300 + ",b" * 3000)) == 3001


def test_frame(spark):
    df = spark.createDataFrame([(1, "a;b", None, "n/a", "x", 9), (1, "a;b", None, "n/a", "x", 9), (None, "", "q", None, None, 9)], "scf_row bigint, nist_csf_v2_0 string, cis_csc_v8_1 string, hipaa string, iso_27001_v2022 string, pos int")
    got = sorted(map(tuple, packed.packed_items(df).collect()), key=str)
    assert got == [(1, "iso_27001_v2022", 1, "x"), (1, "nist_csf_v2_0", 1, "a"), (1, "nist_csf_v2_0", 2, "b"), (None, "cis_csc_v8_1", 1, "q")]
    assert packed.packed_items(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", ["(" * 1_000_000, '"' * 100_001, 'a"' * 300_000, "([{" * 200_000 + ")" * 200_000, '""' * 100_000 + '"a;b', ' "' * 300_000])
def test_a_broken_cell_takes_time_with_its_length(cell):
    began = time.perf_counter()
    assert packed.split_cell(cell)
    assert time.perf_counter() - began < 5


def test_what_is_not_closed_is_plain():
    assert packed.split_cell("a (b; c) (d; e [f; g) h") == ["a (b; c) (d; e [f; g) h"]
    assert packed.split_cell("a (b; c [d; e) f; g") == ["a (b; c [d; e) f", "g"]
    assert packed.split_cell('a; "b; c') == ["a", '"b', "c"]
    assert packed.split_cell("a]; b (c; d]; e") == ["a]", "b (c", "d]", "e"]
