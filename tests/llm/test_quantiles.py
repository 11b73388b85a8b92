import random
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwarden.llm import quantiles as q


def rank_distance(values, reported, share):
    """Places between the wanted rank and those that the reported value has among the values."""
    first, last = sum(v < reported for v in values) + 1, sum(v <= reported for v in values)
    want = min(len(values) - 1, round(share * (len(values) - 1))) + 1
    return max(0, first - want, want - last)


def digest(values, k):
    return q.compressed(q.nodes_of(q.codes_of(np.array(values))), k)


def check(values, d, k, whole):
    for share in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        code, error = q.percentile(d, share)
        assert rank_distance(values, q.value_of(code, whole), share) <= error <= q.rank_bound(len(values), k)


@given(st.lists(st.floats(allow_nan=False), min_size=2))
def test_codes_keep_the_order(values):
    codes = q.codes_of(np.array(values))
    assert all((a < b) == (x < y) for a, b, x, y in zip(values, values[1:], codes.tolist(), codes[1:].tolist(), strict=False))
    assert [q.value_of(c, False) for c in codes] == values


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(-(10**7), 10**7), min_size=1, max_size=400), st.lists(st.integers(1_000_000, 1_007_000), min_size=1, max_size=400), st.lists(st.sampled_from([-(2**63), -1, 0, 5, 2**63 - 1]), min_size=1, max_size=300)), st.integers(2, 200), st.integers(1, 6))
def test_rank_error_holds_for_the_value_after_any_merging(values, k, parts):
    pieces = [digest(values[i::parts], k) for i in range(parts) if values[i::parts]]
    random.Random(1).shuffle(pieces)
    whole = q.merged(*pieces, k=k)
    assert int(whole[2].sum()) == len(values)
    check(values, whole, k, True)


@pytest.mark.parametrize("kind", ["narrow", "heavy", "negative", "constant", "fraction"])
def test_rank_error_on_shapes(kind):
    rng = np.random.default_rng(2)
    values = {"narrow": rng.integers(1_000_000, 1_007_000, 20_000), "heavy": np.exp(rng.normal(8, 3, 20_000)).astype(np.int64), "negative": rng.integers(-5000, 5000, 20_000), "constant": np.full(20_000, 42), "fraction": rng.normal(0, 1e-3, 20_000)}[kind]
    d = digest(values, 500)
    assert len(d[0]) <= 3 * 500 + 2
    check(values.tolist(), d, 500, kind != "fraction")
    if kind == "constant":
        assert [q.value_of(q.percentile(d, s)[0], True) for s in q.PERCENTILES] == [42] * 4
    assert q.percentile(q.nodes_of(np.empty(0, np.int64)), 0.5) is None


def test_few_values_give_the_nearest_rank():
    values = [5, 1, 9, 7]
    assert [q.percentile(digest(values, 10), s) for s in (0.5, 0.99)] == [(7, 0), (9, 0)]
    assert q.wanted_rank(0.5, 4) == 3 and q.wanted_rank(0.5, 2) == 1  # 1.5 and 0.5, half to even


def test_tasks_give_partial_digests_out(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values, groups = rng.integers(0, 10**9, 30_000), rng.integers(0, 5, 30_000)
    batches = pa.table([pa.array(groups), pa.array(values)], ["_k0", "v"]).to_batches(max_chunksize=1000)
    parts = pa.Table.from_batches(list(q._partial(["_k0"], 50, 2000)(iter(batches))))
    assert parts.num_rows < 3000 and sum(parts["n"].to_pylist()) == 30_000
    done = pa.Table.from_batches(list(q._merge(["_k0"], 50, True)(iter(parts.sort_by("_k0").to_batches(max_chunksize=97)))))
    assert done["_k0"].to_pylist() == sorted(set(groups.tolist()))
    for g, held in zip(done["_k0"].to_pylist(), done["nodes"].to_pylist(), strict=True):
        nodes = tuple(np.array([x[f] for x in held]) for f in ("low", "span", "n"))
        check(values[groups == g].tolist(), nodes, 50, True)


def test_frames(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), date(2025, 1, 1 + i % 3), int(rng.lognormvariate(6, 2)), 0) for i in range(3000)]
    rows += rows[:500] + [(9000, "a", date(2025, 1, 1), None, 0), (9001, "a", date(2025, 1, 1), -5, 0), (None, "a", None, 7, 0), (None, "a", None, 7, 0), (None, "a", None, 8, 0)]
    df = spark.createDataFrame(rows, "result_id bigint, agent string, low date, v bigint, n int")
    once = q.once_per_id(df.where("v >= 0"), "result_id", ["agent", "low", "v"])
    assert once.count() == 3002
    days = q.digests(once, ["agent", "low"], "v", k=100)
    assert days.columns == ["agent", "low", "nodes"] and days.where("low is null").count() == 1
    merged = {r.agent: r for r in q.percentiles(q.merge_digests(days, ["agent"], k=100), ["agent"], (0.5, 0.99)).collect()}
    for agent in "ab":
        values = [r[3] for r in rows[:3000] if r[1] == agent] + ([7, 8] if agent == "a" else [])
        assert merged[agent].n_values == len(values)
        for share, got in ((0.5, merged[agent].p50), (0.99, merged[agent].p99)):
            assert rank_distance(values, got, share) <= merged[agent].rank_error <= q.rank_bound(len(values), 100)
    assert q.percentiles(q.digests(once.limit(0), ["agent"], "v"), ["agent"]).count() == 0
    halves = df.select("agent", (F.col("v") / -2).alias("h"), F.lit(float("nan")).alias("x"))
    exact = {r.agent: r.p50 for r in q.percentiles(q.digests(halves, ["agent"], "h"), ["agent"], whole=False).collect()}
    for agent in "ab":
        values = sorted(r[3] / -2 for r in rows if r[1] == agent and r[3] is not None)
        assert exact[agent] == values[q.wanted_rank(0.5, len(values)) - 1]
    assert q.digests(halves, ["agent"], "x").count() == 0
