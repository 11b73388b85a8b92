"""Control catalogs (one row per control, one packed column per framework) as a crosswalk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwarden.packs import frameworks


def control_number(value: Column) -> Column:
    """First run of one or two digits; null without any."""
    out = F.regexp_extract(value, r"(\d{1,2})", 1)
    return F.when(out != "", out)


def split_ids(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[\n;,]+"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")


def _pick(columns: list[str], candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def crosswalk(catalog: DataFrame, columns: dict[str, list[str]] = frameworks.CATALOG_COLUMNS) -> DataFrame:
    """Long form: (scf_id, framework, ext_id, norm_id), each once. Columns are found by name;
    absent frameworks have no row. Rows without an id are left out."""
    key = _pick(catalog.columns, columns["scf_id"])
    if key is None:
        raise ValueError(f"no id column among {catalog.columns}")
    parts = []
    for fw, names in columns.items():
        if fw != "scf_id" and (c := _pick(catalog.columns, names)):
            parts.append(F.transform(split_ids(F.col(f"`{c}`")), _named(fw)))
    rows = catalog.select(F.trim(F.col(f"`{key}`")).alias("scf_id"), F.explode(F.concat(*parts)).alias("x")).where("scf_id <> ''")
    norm = F.when(F.col("x.framework") == "cis", control_number(F.col("x.ext_id"))).otherwise(F.col("x.ext_id"))
    return rows.select("scf_id", "x.framework", "x.ext_id", norm.alias("norm_id")).distinct()


def _named(framework: str):
    return lambda x: F.struct(F.lit(framework).alias("framework"), x.alias("ext_id"))


def relations(catalog: DataFrame) -> DataFrame:
    """(scf_id, relationship, strength) with defaults ``intersects_with`` and 5; the last row of
    an id counts where there is an order column ``scf_row``."""
    key = _pick(catalog.columns, frameworks.CATALOG_COLUMNS["scf_id"])
    rel, power = _pick(catalog.columns, frameworks.CATALOG_RELATION), _pick(catalog.columns, frameworks.CATALOG_STRENGTH)
    text = F.col(f"`{rel}`") if rel else F.lit(None).cast("string")
    bare = F.trim(F.when(F.coalesce(text, F.lit("")) == "", "intersects_with").otherwise(text))
    strength = F.coalesce((F.col(f"`{power}`") if power else F.lit(None)).try_cast("double").cast("int"), F.lit(5))
    order = F.col("scf_row") if "scf_row" in catalog.columns else F.lit(0)
    rows = catalog.select(F.trim(F.col(f"`{key}`")).alias("scf_id"), F.struct(order.alias("o"), F.regexp_replace(F.lower(bare), " ", "_").alias("relationship"), strength.alias("strength")).alias("x")).where("scf_id <> ''")
    return rows.groupBy("scf_id").agg(F.max("x").alias("x")).select("scf_id", "x.relationship", "x.strength")


def expanded(walk: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls to every other framework through the pivot: (control_id, framework, ext_id).

    Two equi-joins; a control on which a third of the catalog hangs is pre-aggregated to
    distinct pivot ids before the second one.
    """
    wanted = controls.select("control_id", control_number(F.col("control_id")).alias("norm_id")).distinct()
    pivot = walk.where("framework = 'cis'").join(wanted, "norm_id").select("control_id", "scf_id").distinct()
    return pivot.join(walk.where("framework <> 'cis'").select("scf_id", "framework", "ext_id"), "scf_id").select("control_id", "framework", "ext_id").distinct()


def nist_of(walk: DataFrame, controls: DataFrame) -> DataFrame:
    """(control_id, nist): sorted CSF ids of each control, else those of 800-53, else none."""
    ids = expanded(walk, controls).where(F.col("framework").isin("nist_csf", "nist_80053")).groupBy("control_id").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("framework") == f, F.col("ext_id")))).alias(f) for f in ("nist_csf", "nist_80053"))
    )
    best = F.when(F.size("nist_csf") > 0, F.col("nist_csf")).otherwise(F.col("nist_80053"))
    return controls.select("control_id").distinct().join(ids, "control_id", "left").select("control_id", F.coalesce(best, F.array().cast("array<string>")).alias("nist"))


def frameworks_present(walk: DataFrame) -> DataFrame:
    return walk.select("framework").distinct()
