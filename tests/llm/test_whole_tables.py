"""Queries of this package over rows that differ in every awkward way."""

from siftwarden.llm import pairs, pii, quantiles, repetition, tokens

ODD = [None, "", " \n\t", "\x00", "é" * 3000, "😀" * 500, "﻿" + "a" * 50, '"' * 2000, "[" * 2000, "á " * 500, "9" * 5000, "İ" * 200]


def test_any_text_in_any_column(spark):
    rows = [(i, t, u, s, 0) for i, (t, u) in enumerate((t, u) for t in ODD for u in ODD) for s in ("llm",)]
    df = spark.createDataFrame(rows, "result_id bigint, prompt string, raw string, source string, text int")
    assert pairs.broken_pairs(df).count() > 0
    assert pii.find_pii(df, "t", "result_id", "raw").count() >= 0
    out = pii.redact(df, "t", "result_id", "raw", b"k")
    assert out.where("n_found = 0").join(df, out.row_id == df.result_id).where("not redacted <=> raw").count() == 0
    docs = df.selectExpr("result_id as doc_id", "raw as text", "prompt as lang", "source")
    ids = {r.doc_id: r.ids for r in tokens.encode_documents(docs).collect()}
    assert len(ids) == len(rows) and all(ids[r[0]] == [] for r in rows if not r[2])
    assert repetition.shares(docs).count() == len(rows) and repetition.flagged(docs).count() >= 0
    held = quantiles.digests(df, ["prompt", "source"], "text")
    assert quantiles.percentiles(held, ["prompt", "source"]).agg({"n_values": "sum"}).first()[0] == len(rows)
