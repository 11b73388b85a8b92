"""References to records that do not exist.

A reference is orphaned when its target is absent (``missing``), was removed (``deleted``) or
came only after the reference (``late``). The work is arranged so that neither a popular key
nor a long history makes one task large:

1. references are pre-aggregated per key and period (map-side, so a key that holds a third of
   all rows leaves each task as one record);
2. the keys above ``heavy_rows`` references, at most ``heavy_keys`` of them, form the heavy
   set. It is cut by a limit, so its broadcast has a fixed bound whatever the input is;
3. heavy references look their target up in the broadcast set, the remaining ones go through
   a shuffled anti-join (``left`` join plus filter, as the target's time matters too);
4. both halves are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that str.strip() removes, for regexp_replace.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85\ufeff]+"

MISSING, DELETED, LATE = "missing", "deleted", "late"


def normal_key(key: Column) -> Column:
    """Key without surrounding white space and case; null where nothing is left."""
    out = F.lower(F.regexp_replace(F.regexp_replace(key, "^" + _SPACE, ""), _SPACE + "$", ""))
    return F.when(out != "", out)


def month_of(ts: Column) -> Column:
    """``yyyy-MM`` of an instant; '' where it is null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(""))


def instant(text: Column) -> Column:
    """Instant of an ISO text with ``T`` or a space; without a zone it is UTC. Null if unreadable."""
    bare = F.trim(text)
    zoned = bare.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$") & bare.rlike(r"\d:\d")
    return F.when(zoned, bare.try_cast("timestamp")).otherwise(F.concat(bare, F.lit("Z")).try_cast("timestamp"))


def pre_aggregate(refs: DataFrame, keys: list[str], at: str) -> DataFrame:
    """References per key and period (month of ``at``): (*keys, ref_month, n_refs)."""
    return refs.groupBy(*keys, month_of(F.col(at)).alias("ref_month")).agg(F.count(F.lit(1)).alias("n_refs"))


def with_status(refs: DataFrame, status: DataFrame, keys: list[str], at: str, heavy_rows: int = 50_000, heavy_keys: int = 512) -> DataFrame:
    """Left join of ``refs`` with ``status`` (unique on ``keys``), split by the weight of the keys.

    ``heavy_rows``: references above which a key counts as heavy. ``heavy_keys``: bound of the
    broadcast set; heavy keys beyond it go the shuffled way with all the others, so the result
    is the same for any setting. Null keys come out with null status columns. Extra columns of
    either side are kept; those of ``status`` must not clash with ``refs``.
    """
    per_key = pre_aggregate(refs, keys, at).groupBy(*keys).agg(F.sum("n_refs").alias("_n"))
    heavy = per_key.where((F.col("_n") >= heavy_rows) & F.col(keys[-1]).isNotNull()).orderBy(F.desc("_n"), *keys).limit(heavy_keys).select(*keys)
    known = F.broadcast(heavy.join(status, keys, "left").withColumn("_heavy", F.lit(True)))
    # One broadcast both marks the heavy rows and answers them; only the others are shuffled.
    marked = refs.join(known, keys, "left")
    extra = [c for c in status.columns if c not in keys]
    own = refs.columns
    done = marked.where("_heavy").select(*own, *extra)
    rest = marked.where("_heavy is null").select(*own).join(status, keys, "left").select(*own, *extra)
    return done.unionByName(rest)


def _finding_refs(audit: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references: ref_key, ts, ref_id; what is known of each finding: ref_id, found, first_seen,
    removed)."""
    refs = audit.select(F.col("id").cast("string").alias("ref_key"), "ts", normal_key(F.col("finding_id")).alias("ref_id"), F.col("event").alias("event")).where("ref_id is not null")
    targets = findings.select(normal_key(F.col("finding_id")).alias("ref_id"), F.col("created_at").alias("at")).where("ref_id is not null").groupBy("ref_id").agg(F.lit(True).alias("found"), F.min("at").alias("first_seen"))
    # Tombstones are reduced to distinct keys before they meet the targets.
    removed = refs.where(F.col("event") == "finding_deleted").groupBy("ref_id").agg(F.lit(True).alias("removed"))
    return refs.select("ref_key", "ts", "ref_id"), targets.join(removed, "ref_id", "full_outer")


def finding_orphans(audit: DataFrame, findings: DataFrame, heavy_rows: int = 50_000, heavy_keys: int = 512) -> DataFrame:
    """Audit rows whose finding is unresolved: ref_key, ref_state, ref_month, one row each.

    Null and blank ids are no references. A finding whose created_at is null throughout counts
    as existing from the start; an audit row without ts is never ``late`` and its month is ''.
    Repeated audit rows give one case. Empty tables give no case (without findings, every
    reference is missing or deleted).
    """
    refs, status = _finding_refs(audit, findings)
    keyed = with_status(refs.select("ref_key", "ts", "ref_id"), status, ["ref_id"], "ts", heavy_rows, heavy_keys)
    state = F.when(F.col("found"), F.when(F.col("first_seen") > F.col("ts"), LATE)).when(F.col("removed"), DELETED).otherwise(MISSING)
    return keyed.select("ref_key", state.alias("ref_state"), month_of(F.col("ts")).alias("ref_month")).where("ref_state is not null").distinct()


def finding_counts(audit: DataFrame, findings: DataFrame, heavy_rows: int = 50_000, heavy_keys: int = 512) -> DataFrame:
    """Orphans of audit rows per month and state: ref_month, ref_state, n_orphans.

    References (distinct by id, time and target) are pre-aggregated per key and month before
    they meet the findings, and whole keys and months are settled by their count, first and last
    time. Only months in which a finding appears are counted row by row, as there some
    references are late and others not.
    """
    refs, status = _finding_refs(audit, findings)
    once = refs.distinct()
    per = once.groupBy("ref_id", month_of(F.col("ts")).alias("ref_month")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"), F.max("ts").alias("last_ts"))
    keyed = with_status(per, status, ["ref_id"], "ts", heavy_rows, heavy_keys)
    found, first = F.col("found"), F.col("first_seen")
    mixed = found & (first > F.col("ts")) & (first <= F.col("last_ts"))
    state = F.when(found, F.when(first > F.col("last_ts"), LATE)).when(F.col("removed"), DELETED).otherwise(MISSING)
    whole = keyed.where(~F.coalesce(mixed, F.lit(False))).select("ref_month", state.alias("ref_state"), "n").where("ref_state is not null")
    split = keyed.where(mixed).select("ref_id", "ref_month", "first_seen")
    rows = once.withColumn("ref_month", month_of(F.col("ts"))).join(split, ["ref_id", "ref_month"]).where("ts < first_seen")
    late = rows.groupBy("ref_month").agg(F.count(F.lit(1)).alias("n")).select("ref_month", F.lit(LATE).alias("ref_state"), "n")
    return whole.unionByName(late).groupBy("ref_month", "ref_state").agg(F.sum("n").alias("n_orphans"))


def edge_orphans(bundles: DataFrame, heavy_rows: int = 50_000, heavy_keys: int = 512) -> DataFrame:
    """Edge ends that name no node of their bundle: field_name, ref_key, ref_state, ref_month.

    Most references resolve inside their own row, so they are settled there with hash-set array
    functions; only the unresolved distinct names of each bundle are joined with the first and
    last time that the tenant had such a node. Null bundles, graphs, edges, nodes and ends are
    no references; an unreadable created_at gives month '' and state ``missing``.
    """
    keyed, open_refs = _edge_states(bundles, heavy_rows, heavy_keys)
    # The ends are exploded alone; no row carries its bundle's names along.
    ends = open_refs.select("bundle_id", "at", F.posexplode("edges").alias("pos", "edge")).select("bundle_id", "at", "pos", F.explode(F.array(F.struct(F.lit("graph.edges.src").alias("field_name"), F.col("edge.src").alias("id")), F.struct(F.lit("graph.edges.dst").alias("field_name"), F.col("edge.dst").alias("id")))).alias("r"))
    spots = ends.select("bundle_id", "at", "pos", "r.field_name", normal_key(F.col("r.id")).alias("ref_id")).where("ref_id is not null")
    joined = spots.alias("s").join(keyed.alias("t"), F.col("s.bundle_id").eqNullSafe(F.col("t.bundle_id")) & F.col("s.at").eqNullSafe(F.col("t.at")) & (F.col("s.ref_id") == F.col("t.ref_id")))
    return joined.select("s.field_name", F.concat_ws(":", "s.bundle_id", F.col("s.pos").cast("string")).alias("ref_key"), "t.ref_state", month_of(F.col("s.at")).alias("ref_month")).distinct()


def _edge_states(bundles: DataFrame, heavy_rows: int, heavy_keys: int) -> tuple[DataFrame, DataFrame]:
    """(unresolved names with their state: bundle_id, at, ref_id, ref_state; bundles that have some:
    bundle_id, at, edges)."""
    b = bundles.select(
        F.col("manifest.bundle_id").alias("bundle_id"), F.col("manifest.tenant_id").alias("tenant"), instant(F.col("manifest.created_at")).alias("at"),
        F.coalesce(F.col("graph.edges"), F.array()).alias("edges"),
        F.array_compact(F.array_distinct(F.transform(F.coalesce(F.col("graph.nodes"), F.array()), lambda n: normal_key(n["id"])))).alias("ids"),
    )
    ends = F.flatten(F.transform("edges", lambda e: F.array(normal_key(e["src"]), normal_key(e["dst"]))))
    b = b.withColumn("open_ids", F.array_except(F.array_compact(F.array_distinct(ends)), "ids"))
    nodes = b.where("at is not null").select("tenant", "at", F.explode("ids").alias("ref_id")).groupBy("tenant", "ref_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    open_refs = b.where(F.size("open_ids") > 0)
    names = open_refs.select("bundle_id", "tenant", "at", F.explode("open_ids").alias("ref_id")).distinct()
    keyed = with_status(names, nodes, ["tenant", "ref_id"], "at", heavy_rows, heavy_keys)
    state = F.when(F.col("first_at") < F.col("at"), DELETED).when(F.col("last_at") > F.col("at"), LATE).otherwise(MISSING)
    return keyed.select("bundle_id", "at", "ref_id", state.alias("ref_state")), open_refs.select("bundle_id", "at", "edges")


def orphans(audit: DataFrame, findings: DataFrame, bundles: DataFrame, **weights: int) -> DataFrame:
    """All unresolved references: table_name, field_name, ref_key, ref_state, ref_month."""
    columns = ["table_name", "field_name", "ref_key", "ref_state", "ref_month"]
    a = finding_orphans(audit, findings, **weights).withColumns({"table_name": F.lit("mvp_audit"), "field_name": F.lit("finding_id")})
    e = edge_orphans(bundles, **weights).withColumns({"table_name": F.lit("sample_bundle")})
    return a.select(*columns).unionByName(e.select(*columns))


def orphan_counts(audit: DataFrame, findings: DataFrame, bundles: DataFrame, **weights: int) -> DataFrame:
    """Orphans per table, field, month and state: n_orphans. Both kinds of references are counted
    from pre-aggregated keys, and the counts united."""
    a = finding_counts(audit, findings, **weights).select(F.lit("mvp_audit").alias("table_name"), F.lit("finding_id").alias("field_name"), "ref_month", "ref_state", "n_orphans")
    e = edge_orphans(bundles, **weights).groupBy("field_name", "ref_month", "ref_state").agg(F.count(F.lit(1)).alias("n_orphans"))
    return a.unionByName(e.select(F.lit("sample_bundle").alias("table_name"), "field_name", "ref_month", "ref_state", "n_orphans"))
