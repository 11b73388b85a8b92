"""Bundle graphs: nodes and edges as tables, counts, lookup, hops, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes(bundles: DataFrame) -> DataFrame:
    """(bundle_id, pos, id, type, label, framework); of equal ids the last one counts."""
    rows = bundles.select(F.col("manifest.bundle_id").alias("bundle_id"), F.posexplode(F.col("graph.nodes")).alias("pos", "n")).where("n is not null")
    last = rows.groupBy("bundle_id", F.col("n.id").alias("id")).agg(F.max(F.struct("pos", F.col("n.type"), F.col("n.label"), F.col("n.framework"))).alias("x"))
    return last.select("bundle_id", "x.pos", "id", "x.type", "x.label", "x.framework")


def edges(bundles: DataFrame) -> DataFrame:
    """(bundle_id, pos, src, dst, rel) of edges that are not null, once each."""
    rows = bundles.select(F.col("manifest.bundle_id").alias("bundle_id"), F.posexplode(F.col("graph.edges")).alias("pos", "e")).where("e is not null")
    return rows.select("bundle_id", "pos", "e.src", "e.dst", "e.rel").distinct()


def type_counts(bundles: DataFrame) -> DataFrame:
    """Counts by kind of element and type or relation."""
    a = nodes(bundles).groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges(bundles).groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def hops(bundles: DataFrame, kind: str = "control") -> DataFrame:
    """(bundle_id, start, reached, reached_type): one hop from nodes of a type, in their bundle."""
    found = nodes(bundles).select("bundle_id", "id", "type")
    starts = found.where(F.col("type") == kind).select("bundle_id", F.col("id").alias("src"))
    ends = found.select("bundle_id", F.col("id").alias("dst"), F.col("type").alias("reached_type"))
    reached = edges(bundles).join(starts, ["bundle_id", "src"]).join(ends, ["bundle_id", "dst"])
    return reached.select("bundle_id", F.col("src").alias("start"), F.col("dst").alias("reached"), "reached_type").distinct()


def lookup(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes of the given (bundle_id, id), once each; ids without a node have none."""
    return nodes(bundles).join(wanted.select("bundle_id", "id").distinct(), ["bundle_id", "id"], "left_semi").select("bundle_id", "id", "type", "label", "framework")


def sample(bundles: DataFrame, most: int = 10) -> DataFrame:
    """The first nodes (by their first place, once per id) and edges of each bundle: (bundle_id, kind, pos, name)."""
    rows = bundles.select(F.col("manifest.bundle_id").alias("bundle_id"), F.posexplode("graph.nodes").alias("pos", "n")).where("n.id <> ''")
    first = rows.groupBy("bundle_id", F.col("n.id").alias("name")).agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("bundle_id").orderBy("pos")
    a = first.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < most).select("bundle_id", F.lit("node").alias("kind"), "pos", "name")
    cut = bundles.select(F.col("manifest.bundle_id").alias("bundle_id"), F.posexplode(F.slice("graph.edges", 1, most)).alias("pos", "e"))
    b = cut.select("bundle_id", F.lit("edge").alias("kind"), "pos", F.concat_ws(" -> ", F.coalesce("e.src", F.lit("")), F.coalesce("e.dst", F.lit(""))).alias("name")).distinct()
    return a.unionByName(b)


def _object(pairs: dict[str, Column]) -> Column:
    """Compact JSON of an object with sorted keys; values are JSON texts."""
    parts = [F.concat(F.lit(f'"{k}":'), pairs[k]) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


#: Characters that JSON escapes in ASCII output and how.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _text(value: Column) -> Column:
    """JSON text of a string, other than ASCII escaped by UTF-16 units; null stays ``null``."""
    units = F.hex(F.encode(value, "UTF-16BE"))
    escaped = F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(units, F.lit("(.{4})"), F.lit(1)), _unit), ""), F.lit('"'))
    plain = ~value.rlike(r'[^ !#-\[\]-~]')
    return F.when(value.isNull(), "null").when(plain, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(escaped)


def _unit(unit: Column) -> Column:
    code = F.conv(unit, 16, 10).cast("int")
    out = F.when((code >= 32) & (code < 127) & ~code.isin(34, 92), F.char(code))
    for c, short in _SHORT.items():
        out = out.when(code == ord(c), F.lit(short))
    return out.otherwise(F.concat(F.lit("\\u"), F.lower(unit)))


def graph_text(graph: Column) -> Column:
    """Canonical JSON of a graph: keys sorted at every level, no white space, ASCII. Fields of
    nodes and edges that are null are written as null, empty maps as {}."""
    props = lambda p: F.when(p.isNull(), "null").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(p)), lambda e: F.concat(_text(e["key"]), F.lit(":"), _text(e["value"]))), ","), F.lit("}")))
    node = lambda n: F.when(n.isNull(), "null").otherwise(_object({**{k: _text(n[k]) for k in ("id", "type", "label", "framework")}, "props": props(n["props"])}))
    edge = lambda e: F.when(e.isNull(), "null").otherwise(_object({k: _text(e[k]) for k in ("src", "dst", "rel")}))

    def listed(values: Column, of) -> Column:
        return F.when(values.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(values, of), ","), F.lit("]")))

    return _object({"nodes": listed(graph["nodes"], node), "edges": listed(graph["edges"], edge)})


def checked_hash(bundles: DataFrame) -> DataFrame:
    """sha256 of each graph's canonical JSON, whether the manifest says the same, and what is wrong
    where it does not. A signature other than an empty or stub one is not verified."""
    own, said = F.sha2(graph_text(F.col("graph")), 256), F.col("manifest.graph_sha256")
    stub = F.coalesce(F.col("manifest.signature"), F.lit("")).isin("", "STUB", "STUBBED")
    agrees = F.coalesce(own == said, F.lit(False))
    error = F.when(F.coalesce(said, F.lit("")) == "", "no graph_sha256 in manifest").when(~agrees, "graph hash mismatch")
    return bundles.select(F.col("manifest.bundle_id").alias("bundle_id"), own.alias("sha256"), agrees.alias("agrees"), (agrees & stub).alias("verified"), error.alias("error"))
