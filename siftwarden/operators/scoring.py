"""Results against labels: set metrics, attribution, alert outcomes with campaign links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.packs import rules


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def set_counts(rows: DataFrame, predicted: str = "pred", truth: str = "truth") -> DataFrame:
    """Adds n_tp, n_fp, n_fn of two sets of ids per row; null sets are empty."""
    empty = F.array().cast("array<string>")
    p, t = F.array_distinct(F.coalesce(predicted, empty)), F.array_distinct(F.coalesce(truth, empty))
    return rows.withColumns({"n_tp": F.size(F.array_intersect(p, t)), "n_fp": F.size(F.array_except(p, t)), "n_fn": F.size(F.array_except(t, p))})


def micro(counted: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over all rows."""
    sums = counted.agg(*(F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")))
    sums = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_id(rows: DataFrame, predicted: str = "pred", truth: str = "truth") -> DataFrame:
    """tp, fp, fn per id, by one exploded union (no self-join)."""
    marks = F.concat(*(F.transform(F.array_distinct(F.col(c)), _sided(k)) for k, c in ((1, predicted), (2, truth))))
    per_row = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode(marks).alias("m"))
    sides = per_row.groupBy("_row", "m.id").agg(F.sum("m.side").alias("s"))
    return sides.groupBy(F.col("id").alias("control_id")).agg(*(F.count_if(F.col("s") == s).alias(n) for n, s in (("tp", 3), ("fp", 1), ("fn", 2))))


def _sided(side: int):
    return lambda x: F.struct(x.alias("id"), F.lit(side).alias("side"))


def per_tier(rows: DataFrame, predicted: str = "pred", truth: str = "truth", provenance: str = "provenance") -> DataFrame:
    """Right and wrong ids per tier; each predicted id counts for every tier that found it."""
    ids = rows.select(F.col(truth).alias("t"), F.explode(F.array_distinct(F.col(predicted))).alias("id"), F.col(provenance).alias("p"))
    tiers = ids.select(F.array_contains("t", F.col("id")).alias("right"), F.explode(F.col("p")[F.col("id")]).alias("tier"))
    return tiers.groupBy("tier").agg(F.count_if("right").alias("correct"), F.count_if(~F.col("right")).alias("wrong"))


def benign_rate(counted: DataFrame, truth: str = "truth") -> DataFrame:
    clean = F.size(truth) == 0
    return counted.agg(F.count_if(clean & (F.col("n_fp") > 0)).alias("benign_fp"), F.count_if(clean).alias("benign_total"))


def correlation_ids(raw: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit("(?d)" + rules.CORRELATION), F.lit(1)), F.lower))


def event_id(raw: Column) -> Column:
    """Event id of a line: string values of JSON keys in priority, a nested one, a GUID, 32 hex
    digits; lower case, hex digits only."""
    bare = F.trim(raw)
    doc = F.try_parse_json(F.when(bare.startswith("{"), bare))

    def text(path: str) -> Column:
        value = F.try_variant_get(doc, path, "string")
        return F.when(F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING", value)

    keys = [text(f"$.{k}") for k in rules.EVENT_ID_KEYS] + [text("$.output_fields['evt.id']")]
    guid, hexa = (F.regexp_extract(bare, p, 0) for p in (rules.GUID, rules.HEX32))
    found = F.coalesce(*keys, F.when(guid != "", guid), F.when(hexa != "", hexa))
    return F.regexp_replace(F.lower(found), "[^0-9a-f]", "")


def linked(events: DataFrame, key: str = "event_seq", alerted: str = "alerted", ids: str = "corr") -> DataFrame:
    """Adds ``via_corr``: not alerted itself, but an id is shared with an alerted event.

    Events are exploded to distinct (event, id); the ids of alerted events are reduced before
    the semi-join, so an id that a third of all events share costs one row on that side, and
    AQE splits its partition on the other.
    """
    pairs = events.select(key, alerted, F.explode(F.array_distinct(F.col(ids))).alias("_id"))
    hot = pairs.where(alerted).select("_id").distinct()
    hit = pairs.where(~F.col(alerted)).join(hot, "_id", "left_semi").select(key).distinct().withColumn("_hit", F.lit(True))
    return events.join(hit, key, "left").withColumn("via_corr", F.coalesce("_hit", F.lit(False))).drop("_hit")


def hot_ids(events: DataFrame, alerted: str = "alerted", ids: str = "corr") -> DataFrame:
    """Ids of campaigns: those on any alerted event, once each, with how many events carry them."""
    pairs = events.select(alerted, F.explode(F.array_distinct(F.col(ids))).alias("id"))
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(alerted).alias("n_alerted")).where("n_alerted > 0")


def zipped(inputs: DataFrame, verdicts: DataFrame, key: str = "event_seq") -> DataFrame:
    """Inputs beside their verdicts by an explicit sequence number; inputs without one keep nulls."""
    clash = [c for c in verdicts.columns if c in inputs.columns and c != key]
    return inputs.join(verdicts.drop(*clash), key, "left")


def worst(counted: DataFrame, side: str, key: str = "id", most: int = 6) -> DataFrame:
    """The rows with most wrong (``n_fp``) or missed (``n_fn``) ids, ties by key; of the first
    ``most``, those that have any."""
    return counted.orderBy(F.desc(side), key).limit(most).where(F.col(side) > 0)


def outcomes(events: DataFrame, truth: str = "label") -> DataFrame:
    """Confusion counts with and without campaign links, precision and recall."""
    seen = F.col("alerted") | F.col("via_corr")
    bad, good, odd = (F.col(truth) == x for x in ("malicious", "benign", "benign_suspicious"))
    out = events.agg(
        F.count_if(bad).alias("malicious"), F.count_if(bad & seen).alias("tp"), F.count_if(bad & ~seen).alias("fn"), F.count_if(good & seen).alias("fp"), F.count_if(good & ~seen).alias("tn"),
        F.count_if(odd & seen).alias("sus_alert"), F.count_if(bad & F.col("alerted")).alias("tp_single"), F.count_if(bad & F.col("via_corr")).alias("via_corr"),
    )
    return out.withColumns({"precision": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 2), "recall": F.bround(ratio(F.col("tp"), F.col("malicious")), 2), "recall_single": F.bround(ratio(F.col("tp_single"), F.col("malicious")), 2)})


def macro(rows: DataFrame) -> DataFrame:
    """Mean of the rows' F1 and the share of rows with at least one right id, over rows with
    counts from ``set_counts``."""
    p, r = ratio(F.col("n_tp"), F.col("n_tp") + F.col("n_fp")), ratio(F.col("n_tp"), F.col("n_tp") + F.col("n_fn"))
    f1 = ratio(2 * p * r, p + r)
    return rows.agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count_if(F.col("n_tp") > 0).alias("covered"), F.count(F.lit(1)).alias("n"))


def routing(events: DataFrame, engine: str = "decided_by") -> DataFrame:
    """Events per deciding tier with their share in percent, and whether it is deterministic.

    The total is joined as one row instead of a window over all rows.
    """
    per = events.groupBy(engine).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_t"))
    return per.join(F.broadcast(total)).select(engine, "n", F.round(100 * F.col("n") / F.col("_t"), 1).alias("pct"), (F.col(engine) != "llm").alias("deterministic"))


def sampled_feed(events: DataFrame, most_benign: int, label: str = "label", order: str = "event_seq") -> DataFrame:
    """All malicious and suspicious events and the first benign ones; unlabelled ones are left
    out. The cut of benign events is a distributed top-n, not a sort of all of them."""
    odd = events.where(F.col(label).isin("malicious", "benign_suspicious"))
    return odd.unionByName(events.where(F.col(label) == "benign").orderBy(order).limit(most_benign))


def labelled(events: DataFrame, labels: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with their labels by normalised id, ``unlabeled`` where there is none."""
    return events.join(labels, key, "left").withColumn("label", F.coalesce("label", F.lit("unlabeled")))
