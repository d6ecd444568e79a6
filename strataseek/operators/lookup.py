"""Presence checks, lookups and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import holds


def matching(scoped: DataFrame, text: str, match: str = "contains") -> DataFrame:
    return scoped.where(holds(F.col("content"), text, match))


def exists_summary(scoped: DataFrame, text: str, match: str = "contains") -> DataFrame:
    """One row: matches and the files that hold them, both exact."""
    return matching(scoped, text, match).agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("path").alias("files"))


def exists_sample(scoped: DataFrame, text: str, limit: int, match: str = "contains") -> DataFrame:
    """The first places by path and line."""
    return matching(scoped, text, match).select("path", "start_line", "end_line").orderBy("path", "start_line", "end_line").limit(limit)


def language_stats(chunks: DataFrame) -> DataFrame:
    """Chunks of each language, of all rows."""
    return chunks.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def language_order(chunks: DataFrame) -> DataFrame:
    """The same, most chunks first."""
    return language_stats(chunks).orderBy(F.desc("n"), F.asc_nulls_last("language"))


def index_totals(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: chunks, file rows and distinct paths with chunks."""
    f = files.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("path").alias("paths_with_chunks")).select(
        "chunks", "paths_with_chunks", f.select("n").scalar().alias("file_rows"), f.select("paths").scalar().alias("files")
    )
