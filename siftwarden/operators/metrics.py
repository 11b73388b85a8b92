"""Counters, latency summaries, ring buffers, drain order, saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwarden.functions.text import rank_percentile
from siftwarden.operators.normalise import lane_rank


def counters(rows: DataFrame, name: str, *labels: str) -> DataFrame:
    """Labelled counters: (name, labels as text, value)."""
    text = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in sorted(labels)))
    return rows.groupBy(text.alias("labels")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "labels", "value")


def last_n(rows: DataFrame, n: int, order: list[str], *by: str) -> DataFrame:
    """The last ``n`` rows per group; without a group this is a distributed top-n."""
    columns = [F.desc(c) for c in order]
    if not by:
        return rows.orderBy(*columns).limit(n)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*columns))).where(F.col("_k") <= n).drop("_k")


def latency_summary(rows: DataFrame, value: str, by: list[str], order: list[str], window: int = 5000, digits: int = 1) -> DataFrame:
    """count, p50, p95, p99, max, avg over the last ``window`` samples of each group.

    Percentiles are nearest ranks, so the samples of a group are sorted in an array; it holds at
    most ``window`` of them.
    """
    recent = last_n(rows.where(F.col(value).isNotNull()), window, order, *by)
    held = F.sort_array(F.collect_list(value))
    agg = recent.groupBy(*by).agg(held.alias("v"))
    out = [F.size("v").cast("bigint").alias("n"), *(F.round(rank_percentile(F.col("v"), s), digits).alias(f"p{int(s * 100)}") for s in (0.5, 0.95, 0.99))]
    return agg.select(*by, *out, F.round(F.array_max("v"), digits).alias("max"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), digits).alias("avg"))


def drain_order(envelopes: DataFrame, seq: str = "event_seq", block: int = 100_000, group: int = 1000) -> DataFrame:
    """Adds ``drain_pos``: HOT, then WARM, then COLD, first in first out inside a lane.

    No task sees a lane as a whole: rows are numbered inside blocks of the sequence, blocks are
    shifted by the counts before them inside groups of blocks, and groups by the counts of the
    groups before. Only the last step is one task, with a row per ``block * group`` numbers.
    """
    ranked = envelopes.withColumns({"_lane": lane_rank(F.col("lane")), "_block": F.floor(F.col(seq) / block)})
    sizes = ranked.groupBy("_lane", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.floor(F.col("_block") / group))
    inside = F.sum("_n").over(Window.partitionBy("_lane", "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("_g").over(Window.orderBy("_lane", "_group").rowsBetween(Window.unboundedPreceding, -1))
    groups = sizes.groupBy("_lane", "_group").agg(F.sum("_n").alias("_g")).select("_lane", "_group", F.coalesce(before, F.lit(0)).alias("_before"))
    shift = sizes.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(groups, ["_lane", "_group"]).select("_lane", "_block", (F.col("_before") + F.col("_inside")).alias("_s"))
    local = F.row_number().over(Window.partitionBy("_lane", "_block").orderBy(seq))
    return ranked.join(shift, ["_lane", "_block"]).withColumn("drain_pos", F.col("_s") + local).drop("_lane", "_block", "_s")


def saturation(levels: DataFrame, level: str = "level", rate: str = "rate", gain: float = 1.10) -> DataFrame:
    """First level whose rate is under ``gain`` times the best of the levels before it, and the
    best level. ``levels`` has a row per load level, a bounded list."""
    w = Window.orderBy(level)
    before = levels.withColumn("_best", F.max(rate).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flat = before.where((F.col("_best") > 0) & (F.col(rate) < F.col("_best") * gain)).agg(F.min(level).alias("saturation_level"))
    best = levels.orderBy(F.desc(rate), level).limit(1).select(F.col(level).alias("best_level"), F.col(rate).alias("best_rate"))
    return best.join(F.broadcast(flat))


def exposition(values: DataFrame) -> DataFrame:
    """Text lines of counters in the usual exposition format."""
    body = F.when(F.col("labels") == "", F.col("name")).otherwise(F.concat("name", F.lit("{"), "labels", F.lit("}")))
    return values.select(F.concat(body, F.lit(" "), F.col("value").cast("string")).alias("line"))


def quantile_lines(summary: DataFrame, name: str, *labels: str) -> DataFrame:
    """Exposition lines of a latency summary: one per label set and quantile."""
    text = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in sorted(labels)))
    rows = F.array(*(F.struct(F.lit(q).alias("q"), F.col(c).alias("v")) for q, c in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))))
    listed = summary.select(text.alias("_l"), F.explode(rows).alias("x"))
    return listed.select(F.concat(F.lit(f"{name}_ms{{"), F.when(F.col("_l") == "", "").otherwise(F.concat("_l", F.lit(","))), F.lit('quantile="'), F.col("x.q"), F.lit('"} '), F.col("x.v").cast("string")).alias("line"))


def _span(at: str) -> Column:
    """Seconds from the first to the last call of a group; null for one moment."""
    took = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / F.lit(1e6)
    return F.when(took > 0, took)


def load_stats(calls: DataFrame, by: list[str], at: str = "created_at", latency: str = "latency_ms", ok: str = "ok", tokens: str = "completion_tokens", order: str = "result_id", window: int = 5000) -> DataFrame:
    """Per group: completed, errors, error_rate, calls and tokens per second, p50, p95, p99, max of the
    last ``window`` latencies, tokens per call. Rates are over the span of the group's calls, 0 where
    that is one moment; null and negative latencies are no samples."""
    failed, n = F.count_if(~F.coalesce(F.col(ok), F.lit(False))), F.count(F.lit(1))
    held = F.coalesce(F.sum(tokens), F.lit(0))
    per = calls.groupBy(*by).agg(
        n.alias("completed"), failed.alias("errors"), F.bround(failed / n, 3).alias("error_rate"),
        F.coalesce(F.bround(n / _span(at), 4), F.lit(0.0)).alias("calls_per_s"), F.coalesce(F.bround(held / _span(at), 3), F.lit(0.0)).alias("tokens_per_s"), F.bround(held / n, 1).alias("avg_tokens"),
    )
    samples = calls.where(F.col(latency) >= 0).withColumn(latency, F.col(latency).cast("double"))
    times = latency_summary(samples, latency, by, [order], window).select(*by, "p50", "p95", "p99", "max")
    match = [per[c].eqNullSafe(times[c]) for c in by]
    return per.join(times, match, "left").select(*(per[c] for c in by), *(per[c] for c in per.columns if c not in by), "p50", "p95", "p99", F.col("max").alias("max_ms"))


def ingest_summary(events: DataFrame, at: str, latency: str, ok: str, calls: str, order: str, window: int = 5000) -> DataFrame:
    """One row over events: events, errors, wall_s, throughput, percentiles of the last ``window``
    latencies, model calls (column ``calls``) per event, share of events without any."""
    n, failed = F.count(F.lit(1)), F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    whole = events.agg(
        n.alias("events"), failed.alias("errors"), F.bround(_span(at), 2).alias("wall_s"), F.coalesce(F.bround(n / _span(at), 4), F.lit(0.0)).alias("throughput_eps"),
        F.coalesce(F.sum(calls), F.lit(0)).alias("model_calls"), F.bround(F.coalesce(F.sum(calls), F.lit(0)) / F.greatest(n, F.lit(1)), 3).alias("calls_per_event"), F.bround(100 * F.count_if(F.col(calls) == 0) / F.greatest(n, F.lit(1)), 1).alias("deterministic_pct"),
    )
    samples = events.where(F.col(latency) >= 0).select(F.lit(1).alias("_g"), F.col(latency).cast("double").alias("v"), order).orderBy(F.desc(order)).limit(window)
    held = samples.groupBy("_g").agg(F.sort_array(F.collect_list("v")).alias("v"))
    times = held.select(*(F.round(rank_percentile(F.col("v"), s), 1).alias(f"p{int(s * 100)}") for s in (0.5, 0.95, 0.99)))
    return whole.join(F.broadcast(times), how="left")  # one row each


def scored_rows(rows: DataFrame, deterministic: str, ms: str, key: str, most: int = 150) -> DataFrame:
    """The first rows of a routing report, undecided ones last, quick ones first: adds ``pos``."""
    first = rows.orderBy(~F.col(deterministic), ms, key).limit(most)
    w = Window.orderBy(~F.col(deterministic), ms, key)  # over at most ``most`` rows
    return first.withColumn("pos", F.row_number().over(w))


def level_stats(calls: DataFrame, level: str, latency: str = "latency_ms", ok: str = "ok", tokens: str = "completion_tokens") -> DataFrame:
    """Per level: calls, errors, error rate, tokens, mean and greatest latency."""
    failed = F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    n = F.count(F.lit(1))
    return calls.groupBy(level).agg(
        n.alias("completed"), failed.alias("errors"), F.bround(failed / n, 3).alias("error_rate"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.bround(F.coalesce(F.sum(tokens), F.lit(0)) / n, 1).alias("avg_tokens"), F.max(F.when(F.col(latency) >= 0, F.col(latency))).alias("max_ms"),
    )
