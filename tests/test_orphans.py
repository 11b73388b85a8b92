import random
from datetime import datetime

import pytest
from pyspark.sql import Row

from siftwarden.operators import orphans

AUDIT = "id bigint, ts timestamp, finding_id string, event string, detail string"
FINDINGS = "finding_id string, created_at timestamp"
BUNDLE = """manifest struct<bundle_id string, tenant_id string, created_at string>, graph struct<nodes array<struct<id string, props map<string,string>>>, edges array<struct<src string, dst string, rel string>>>"""
T = [datetime(2025, m, 1) for m in range(1, 6)]


def cases(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("heavy_rows", [1, 3, 10**9])
def test_audit_states_do_not_depend_on_the_split(spark, heavy_rows):
    audit = spark.createDataFrame(
        [
            (1, T[1], "F-a", "x", None), (2, T[1], " f-A\t", "x", None), (3, T[0], "F-b", "x", None), (4, T[2], "F-gone", "finding_deleted", None), (5, T[3], "F-GONE ", "x", None),
            (6, T[1], "F-none", "x", None), (6, T[1], "F-none", "x", None), (7, T[1], None, "x", None), (8, T[1], "  ", "x", None), (9, None, "F-none", "x", None), (10, None, "F-a", "x", None),
            *((100 + i, T[2], "F-hot", "x", None) for i in range(20)),
        ],
        AUDIT,
    )
    findings = spark.createDataFrame([("F-A", T[0]), ("F-A", T[4]), ("f-b ", T[1]), (None, T[0]), ("", T[0]), ("F-a", None)], FINDINGS)
    got = cases(orphans.finding_orphans(audit, findings, heavy_rows))
    want = [("3", "late", "2025-01"), ("4", "deleted", "2025-03"), ("5", "deleted", "2025-04"), ("6", "missing", "2025-02"), ("9", "missing", "")]
    assert got == sorted(want + [(str(100 + i), "missing", "2025-03") for i in range(20)])


def bundle(bid, at, nodes, edges, tenant="t"):
    node_rows = None if nodes is None else [None if n is None else (n, None) for n in nodes]
    edge_rows = None if edges is None else [None if e is None else (*e, None) for e in edges]
    return ((bid, tenant, at), (node_rows, edge_rows))


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_edges_resolve_in_their_bundle_first(spark, heavy_rows):
    rows = [
        bundle("b1", "2025-01-31T23:30:00-01:00", ["A", "b", None, "b"], [("a", " B "), None, ("a", None), ("", "x")]),
        bundle("b2", "2025-02-02 00:00:00", ["a"], [("b", "c"), ("a", "zz")]),
        bundle("b3", "2025-03-01T00:00:00Z", ["c"], None),
        bundle("b3", "2025-03-01T00:00:00Z", ["c"], None),
        bundle("b4", "no date", None, [("q", "q")]),
        bundle("b5", "2025-02-02T00:00:00Z", ["zz"], [], tenant="u"),
        (None, None),
    ]
    got = cases(orphans.edge_orphans(spark.createDataFrame(rows, BUNDLE), heavy_rows))
    assert got == sorted(
        [
            ("graph.edges.dst", "b1:3", "missing", "2025-02"), ("graph.edges.src", "b2:0", "deleted", "2025-02"), ("graph.edges.dst", "b2:0", "late", "2025-02"),
            ("graph.edges.dst", "b2:1", "missing", "2025-02"), ("graph.edges.src", "b4:0", "missing", ""), ("graph.edges.dst", "b4:0", "missing", ""),
        ]
    )


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (AUDIT, FINDINGS, BUNDLE)]
    assert orphans.orphans(*empty).count() == 0
    counts = orphans.orphan_counts(*empty)
    assert counts.columns == ["table_name", "field_name", "ref_month", "ref_state", "n_orphans"] and counts.count() == 0


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_counts_of_keys_are_the_counts_of_rows(spark, heavy_rows):
    rng = random.Random(4)
    days = [datetime(2025, m, d) for m in (1, 2, 3) for d in (1, 10, 20)]
    rows = [(i, rng.choice([*days, None]), rng.choice(["a", "b ", "C", "d", "e", None]), rng.choice(["x", "finding_deleted"] if i < 3 else ["x"]), None) for i in range(200)]
    audit = spark.createDataFrame(rows + rows[:50], AUDIT)
    findings = spark.createDataFrame([("a", days[4]), ("B", days[8]), ("c", days[0]), ("c", None)], FINDINGS)
    bundles = spark.createDataFrame([bundle("b1", "2025-01-31T23:30:00Z", ["a"], [("x", "a"), ("x", "y")])], BUNDLE)
    got = cases(orphans.orphan_counts(audit, findings, bundles, heavy_rows=heavy_rows))
    every = orphans.orphans(audit, findings, bundles).groupBy("table_name", "field_name", "ref_month", "ref_state").count()
    assert got == cases(every) and any(r[3] == "late" for r in got)


def test_clashing_columns(spark):
    audit = spark.createDataFrame([Row(id=1, ts=T[0], finding_id="x", event="e", ref_id="r", found=True, _n=1)])
    findings = spark.createDataFrame([Row(finding_id="y", created_at=T[0], ref_id=3, ts=1)])
    assert cases(orphans.finding_orphans(audit, findings)) == [("1", "missing", "2025-01")]
