import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).columns == ["rule", "severity", "n"]


@pytest.mark.parametrize("name", sorted(n for n in ORACLES))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(str(plain(r[i])) for i in at) for r in result.fetchall())
    assert got == want


#: Queries without SQL and the columns that tell their rows apart.
KEYS = {
    "p2_found": ["table_name", "row_key", "first_line"], "p2_entries": None, "p3_found": ["finding_id", "path"], "p3_triples": None,
    **{n: ["record_id", "version", "row_path"] for n in QUERIES if n.startswith("p3_") and n not in ("p3_found", "p3_triples")},
    "p4_found": ["table_name", "row_id", "pii_type", "pii_text"], "p4_redacted": None, "p5_found": ["scf_row", "field_name", "pos"], "p6_found": ["result_id"],
    "p8_ids": None, "p9_containers": None, "p9_fill": [], "json_repair": None, "redaction_counts": ["kind"],
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES))
def test_rows_are_there_and_told_apart_by_their_key(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows
    if KEYS[name] is not None:
        assert max(Counter(tuple(r[c] for c in KEYS[name]) for r in rows).values()) == 1


def test_flat_tables_hold_the_found_objects_and_their_parents(spark, data):
    tables = {n: QUERIES[n](spark, data).select("record_id", "version", "row_path", "parent_path").collect() for n in KEYS if n.startswith("p3_") and n not in ("p3_found", "p3_triples")}
    rows = {(r.record_id, r.version, r.row_path) for held in tables.values() for r in held}
    assert all((r.record_id, r.version, r.parent_path) in rows for n, held in tables.items() for r in held if n not in ("p3_findings", "p3_verdicts", "p3_dal", "p3_agents"))
    lists = {(r.record_id, r.row_path) for n, held in tables.items() for r in held if n not in ("p3_findings", "p3_verdicts", "p3_dal")}
    assert lists == {(r.finding_id, r.path) for r in QUERIES["p3_found"](spark, data).collect()}


def test_containers_hold_every_token_once_and_are_never_over_full(spark, data):
    if "p9_containers" not in QUERIES:
        pytest.skip("optional queries are not installed")
    pieces, ids = QUERIES["p9_containers"](spark, data).collect(), QUERIES["p8_ids"](spark, data).collect()
    used = Counter()
    for r in pieces:
        used[r.container_id] += r.n_tokens
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(len(r.ids) for r in ids)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in ids}
