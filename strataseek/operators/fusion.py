"""Reciprocal rank fusion of two result lists, and how far a result is to be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the fusion and of the confidence levels.
RRF_K = 60
LITERAL_WEIGHT = 1.6
STRONG, WEAK = 0.55, 0.75


def ranked(top: DataFrame, *order) -> DataFrame:
    """A list of at most a pool's size with its rank from 0."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(semantic: DataFrame, keyword: DataFrame, limit: int, weight_keyword: float = 1.0, payload: list[str] = ()) -> DataFrame:
    """The best ids of two ranked lists (id, rank, distance / bm25).

    An id gets weight / (60 + rank) from each place it has, repeated places in one list
    add up. Columns: id, rrf, via (semantic, keyword or both), rank_semantic,
    rank_keyword, distance, bm25, and those of ``payload`` from the id's first place, of the
    semantic list if it is there. Ties: the semantic list's order, then the other's.
    Rows with a null id are left out; an empty list gives the other one.
    """
    kept = F.struct(*(payload or ["id"])).alias("kept")
    a = semantic.select("id", F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb"), (1.0 / (RRF_K + F.col("rank"))).alias("w"), "distance", F.lit(None).cast("double").alias("bm25"), kept)
    b = keyword.select("id", F.lit(None).cast("int").alias("ra"), F.col("rank").alias("rb"), (weight_keyword / (RRF_K + F.col("rank"))).alias("w"), F.lit(None).cast("double").alias("distance"), "bm25", kept)
    merged = (
        a.unionByName(b)
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(
            F.sum("w").alias("rrf"),
            F.min("ra").alias("rank_semantic"),
            F.min("rb").alias("rank_keyword"),
            F.min_by("distance", "ra").alias("distance"),
            F.min_by("bm25", "rb").alias("bm25"),
            F.min_by("kept", F.struct(F.coalesce("ra", F.lit(2**31 - 1)), "rb")).alias("kept"),
        )
    )
    via = F.when(F.col("rank_semantic").isNull(), "keyword").when(F.col("rank_keyword").isNull(), "semantic").otherwise("both")
    own = ["id", "rrf", "rank_semantic", "rank_keyword", "distance", "bm25"]
    best = merged.withColumn("via", via).orderBy(F.desc(F.round("rrf", 12)), F.asc_nulls_last("rank_semantic"), "rank_keyword").limit(limit)
    return best.select(*own, "via", *[F.col("kept")[c].alias(c) for c in payload])


def keyword_weight(literals: list[str], df: dict[str, int]) -> float:
    return LITERAL_WEIGHT if literals and any(df.get(t, 0) > 0 for t in literals) else 1.0


def confidence(has_literals: Column, literal_found: Column, first_distance: Column, keyword_mode: Column, rows: Column) -> Column:
    """high, medium or low; the first rule that holds decides."""
    near = F.coalesce(first_distance <= STRONG, F.lit(False))
    far = F.coalesce(first_distance > WEAK, F.lit(False))
    return (
        F.when(has_literals & ~literal_found, "low")
        .when(has_literals & near, "high")
        .when(has_literals & keyword_mode, "high")
        .when(has_literals, "medium")
        .when(near, "high")
        .when(far, "low")
        .when(first_distance.isNull() & keyword_mode & (rows > 0), "high")
        .otherwise("medium")
    )
