import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwarden.llm import repetition

SCHEMA = "doc_id bigint, text string, lang string, source string, threshold double"


def brute(text, run=10):
    words = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
    seen, covered = set(), set()
    for i in range(len(words) - run + 1):
        window = tuple(words[i : i + run])
        if window in seen:
            covered.update(range(i, i + run))
        seen.add(window)
    return len(words), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab _.1", max_size=120)), max_size=6))
def test_against_brute_force(texts):
    sizes, hits = repetition.repeated_words(texts)
    assert list(zip(sizes, hits, strict=True)) == [brute(t) for t in texts]
    sizes, hits = repetition.repeated_words(texts, run=3)
    assert list(zip(sizes, hits, strict=True)) == [brute(t, 3) for t in texts]


def test_capitals_with_a_mark_in_lower_case():
    assert repetition.repeated_words(["İstanbul STRASSE"])[0] == [2]


def test_long_text_and_neighbours():
    a = " ".join(str(i) for i in range(300_000))
    assert repetition.repeated_words([a, a, "x " * 40]) == ([300_000, 300_000, 40], [0, 0, 39])


PLAIN = " ".join(f"w{i}" for i in range(200))


def test_a_ceiling_keeps_all_cases(spark):
    again = PLAIN + " " + " ".join(f"w{i}" for i in range(100))
    little = PLAIN + " " + " ".join(f"w{i}" for i in range(12))
    rows = [(i, PLAIN, "en", "a", 0.0) for i in range(30)] + [(100 + i, again, " EN", "a", 0.0) for i in range(30)] + [(200, little, None, None, 0.0), (201, None, None, None, 0.0), (202, "", "de", "b", 0.0), (203, again, "de", None, 0.0), (203, again, "de", None, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = repetition.flagged(df, ceiling=0.25, least=20).collect()
    assert {r.doc_id for r in got if 4 * r.n_repeated >= r.n_words} == {*range(100, 130), 203}
    assert all(repetition.FLOOR <= r.threshold <= 0.25 for r in got) and 202 not in {r.doc_id for r in got}
    shares = {r.doc_id: r.share for r in repetition.shares(df).collect()}
    assert shares[201] == 0 and shares[200] == 12 / 212
    assert repetition.flagged(df.limit(0)).count() == 0


def test_thresholds_are_those_of_the_group_its_language_or_all(spark):
    def text(k):
        return PLAIN + " " + " ".join(f"w{i}" for i in range(k))

    rows = [(i, text(60), "en", "a", 0.0) for i in range(40)] + [(100 + i, text(0 if i else 30), "en", "b", 0.0) for i in range(40)] + [(200, text(60), "en", "c", 0.0), (300, text(70), "xx", "d", 0.0)]
    cut = {(r["lang"], r["source"]): r["threshold"] for r in repetition.thresholds(repetition.shares(spark.createDataFrame(rows, SCHEMA)), least=20).collect()}
    assert cut["en", "a"] == 60 / 260 and cut["en", "b"] == repetition.FLOOR
    assert cut["en", "c"] == cut["xx", "d"] == 60 / 260
