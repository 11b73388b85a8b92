"""Vector search: exact top-k by cosine, a second-stage score, a floor on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int = 35, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query, ties by key; each task keeps k rows, the last merges
    them. Null vectors are left out."""
    scored = vectors.where(F.col(column).isNotNull()).withColumn("similarity", cosine(F.col(column), F.array(*map(F.lit, query))))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 35, key: str = "vec_id", column: str = "embedding", of: str = "query_id") -> DataFrame:
    """The k vectors nearest to each query, ties by key: ``of`` (the query's key) and the columns
    of ``vectors`` without the vector.

    Every query is scored against every vector, partition by partition; no side is collected or
    broadcast by size of the data. Each task keeps k rows of a query before they are merged.
    Null vectors are left out on both sides, a query given twice is taken once.
    """
    rest = [c for c in vectors.columns if c != column]
    asked = queries.where(F.col(column).isNotNull()).select(F.col(key).alias(of), F.col(column).alias("_q")).dropDuplicates([of])
    asked = asked.withColumn("_qn", F.sqrt(dot(F.col("_q"), F.col("_q"))))
    held = vectors.where(F.col(column).isNotNull()).withColumn("_n", F.sqrt(dot(F.col(column), F.col(column))))
    norms = F.col("_n") * F.col("_qn")
    scored = held.crossJoin(asked).select(of, *rest, F.when(norms > 0, dot(F.col(column), F.col("_q")) / norms).otherwise(F.lit(0.0)).alias("similarity"))
    ranked = scored.withColumn("_k", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("similarity"), key)))
    return ranked.where(F.col("_k") <= k).drop("_k")


def reranked(found: DataFrame, score: Column, keep: int = 6, floor: float = 0.0, key: str = "vec_id", by: tuple[str, ...] = (), once: str | None = None) -> DataFrame:
    """The best ``keep`` by the second score (of each group ``by``), then those whose first score
    reaches the floor. ``once``: of rows with the same value there, as a control, the best one only."""
    ranked = found.withColumn("rerank_score", score).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rerank_score"), key)))
    kept = ranked.where((F.col("_k") <= keep) & (F.col("similarity") >= floor))
    if once is not None:
        kept = kept.withColumn("_o", F.row_number().over(Window.partitionBy(*by, once).orderBy("_k"))).where("_o = 1").drop("_o")
    return kept.drop("_k")
