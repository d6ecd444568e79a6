"""Change events of a local tree by comparing two listings, for trees without a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind) that turn one listing into the other: changed or new paths and unlinked ones."""
    a = before.where("is_file").groupBy("path").agg(F.max("mtime_ms").alias("old"))
    b = after.where("is_file").groupBy("path").agg(F.max("mtime_ms").alias("new"), F.lit(True).alias("there"))
    both = a.join(b, "path", "full")
    kind = F.when(F.col("there").isNull(), "unlink").when(~F.col("new").eqNullSafe(F.col("old")), "change")
    return both.select("path", kind.alias("kind")).where("kind IS NOT NULL")
