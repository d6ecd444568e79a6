"""What has changed, and snapshots after it: diffs by time, upserts, deletes, coalescing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.text import language


def stored_times(files: DataFrame) -> DataFrame:
    """One row for each stored path, of repeated ones the newest: path, stored, chunk_count."""
    return files.groupBy("path").agg(F.max("mtime").alias("stored"), F.max_by("chunk_count", F.struct("mtime", "chunk_count")).alias("chunk_count"))


def on_disk(listing: DataFrame) -> DataFrame:
    """Regular files of a known language, each path once: path, mtime_ms, language."""
    real = listing.where(F.col("is_file")).withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    return real.groupBy("path", "language").agg(F.max("mtime_ms").alias("mtime_ms"))


def changed_files(listing: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Files to index: not stored, or stored with another time (older or newer); with
    ``force`` all. A null time can't be proved equal and counts as changed."""
    both = on_disk(listing).join(stored_times(files).select("path", "stored"), "path", "left")
    differs = F.col("stored").isNull() | F.col("mtime_ms").isNull() | (F.floor("mtime_ms") != F.floor("stored"))
    return both.where(F.lit(force) | differs).select("path", "language", "mtime_ms", F.floor("stored").cast("bigint").alias("stored_ms"))


def stale_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files that are newer on disk. One moved back in time is changed, not stale."""
    both = stored_times(files).join(on_disk(listing), "path")
    return both.where(F.floor("mtime_ms") > F.floor("stored")).select("path", "mtime_ms", F.floor("stored").cast("bigint").alias("stored_ms"))


def missing_files(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Stored paths that are no file on disk any more."""
    return stored_times(files).select("path").join(listing.where("is_file").select("path"), "path", "left_anti")


def staleness(listing: DataFrame | Callable[[DataFrame], DataFrame], files: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: files looked at, stale and missing ones; of a sample drawn by the hash of the
    path where one is asked for. ``listing`` may be a function that lists given paths."""
    seen = stored_times(files).select("path", "stored")
    if sample:
        seen = seen.orderBy(F.md5("path"), "path").limit(sample)
    if not isinstance(listing, DataFrame):
        listing = listing(seen)
    disk = listing.where("is_file").groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"), F.lit(True).alias("there"))
    both = seen.join(disk, "path", "left")
    return both.agg(
        F.count(F.lit(1)).alias("looked_at"),
        F.count_if(F.floor("mtime_ms") > F.floor("stored")).alias("stale"),
        F.count_if(F.col("there").isNull()).alias("missing"),
    )


def freshness(paths: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """One row about the distinct paths of some results: looked_at, stale (newer on disk than
    stored), missing on disk, example (the first stale path)."""
    once = paths.select("path").distinct()
    stored = stored_times(files.join(once, "path", "left_semi")).select("path", "stored")
    disk = listing.where("is_file").join(once, "path", "left_semi").groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"), F.lit(True).alias("there"))
    newer = F.coalesce(F.floor("mtime_ms") > F.floor("stored"), F.lit(False))
    return once.join(stored, "path", "left").join(disk, "path", "left").agg(
        F.count(F.lit(1)).alias("looked_at"),
        F.count_if(newer).alias("stale"),
        F.count_if(F.col("there").isNull()).alias("missing"),
        F.min(F.when(newer, F.col("path"))).alias("example"),
    )


def run_counts(listing: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """One row: files of a known language on disk, those of them to index, those to skip."""
    changed = changed_files(listing, files, force).select("path", F.lit(1).alias("c"))
    return on_disk(listing).join(changed, "path", "left").agg(
        F.count(F.lit(1)).alias("on_disk"), F.count("c").alias("changed"), F.count_if(F.col("c").isNull()).alias("skipped")
    )


def deleted(table: DataFrame, paths: DataFrame) -> DataFrame:
    """A table without the rows of some paths."""
    return table.join(paths.select("path").distinct(), "path", "left_anti").select(*table.columns)


def upserted(table: DataFrame, changed: DataFrame, rows: DataFrame) -> DataFrame:
    """A table in which the rows of the changed paths are replaced by others."""
    return deleted(table, changed).unionByName(rows.select(*table.columns))


def file_rows(changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of ``files`` for indexed paths; a path without chunks is kept with 0, so that it
    isn't read again."""
    counted = chunks.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return changed.join(counted, "path", "left").select("path", F.floor("mtime_ms").cast("double").alias("mtime"), F.coalesce("n", F.lit(0)).alias("chunk_count"))



def coalesced(events: DataFrame) -> DataFrame:
    """The last kind of each path: by event time, then delivery number, so neither late nor
    repeated deliveries matter. Events without path or kind say nothing and are left out.
    Partial aggregation keeps one row of a path in each task: a hot path doesn't skew."""
    useful = events.where("path IS NOT NULL AND kind IS NOT NULL")
    last = F.struct("event_time", "seq", "kind")
    return useful.groupBy("path").agg(F.max(last).alias("l")).select("path", "l.kind", "l.event_time", "l.seq")


def split_changes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths to delete and paths to read again; a path is in one of them."""
    last = coalesced(events)
    return last.where("kind = 'unlink'").select("path"), last.where("kind <> 'unlink'").select("path")


def bursts(events: DataFrame, gap_seconds: int = 2) -> DataFrame:
    """Runs of a path's events that are less than the gap apart: path, started, ended, n.

    Events are counted once for each delivery number and first summed by slots of half
    the gap, which never hold a pause; only the slots are ordered by path, so a path of very
    many events costs no more than its slots.
    """
    once = events.where("path IS NOT NULL AND event_time IS NOT NULL").select("seq", "path", F.unix_micros(F.col("event_time").cast("timestamp")).alias("t")).distinct()
    slots = once.groupBy("path", F.floor(F.col("t") / (gap_seconds * 500_000)).alias("slot")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("path").orderBy("slot")
    new = F.coalesce((F.col("a") - F.lag("b").over(order) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    runs = slots.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("path", "run").agg(F.min("a").alias("started_us"), F.max("b").alias("ended_us"), F.sum("n").alias("n")).drop("run")
