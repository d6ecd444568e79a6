"""Problem 5: how often every term occurs, and in how many records.

Every record emits one row for each occurrence of a term and one for each distinct
term. Spark's partial hash aggregation combines these inside each map task, so
the shuffle carries at most one row for each term and task: a term that occurs in
every record costs no more than a rare one. Everything stays on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.runtime import table

TERM = "[A-Za-z0-9_]{2,}"


def records(chunks: DataFrame) -> DataFrame:
    """Distinct (id, content) pairs; other columns are ignored."""
    return chunks.select(F.col("id"), F.col("content")).distinct()


def term_frequencies(chunks: DataFrame, rare_max: int = 1, common_one_in: int = 10) -> DataFrame:
    """Counts and marks for every term of ``chunks.content``.

    Columns: ``term``, ``occurrences``, ``records``, ``rare``, ``common``. A term is a
    longest run of ASCII letters, digits and underscores of two characters or more,
    lowercased after it is cut out (so no other letter can turn into an ASCII one).
    ``rare``: at most ``rare_max`` occurrences; ``common``: in at least one of
    ``common_one_in`` records. A null or empty content has no terms but counts as a
    record; repeated rows count once; an empty table gives no rows.
    """
    recs = records(chunks)
    words = recs.select(
        F.transform(F.regexp_extract_all(F.col("content"), F.lit(TERM), F.lit(0)), F.lower).alias("words")
    )
    emitted = words.select(
        F.explode(
            F.concat(
                F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(1).alias("o"), F.lit(0).alias("r"))),
                F.transform(
                    F.array_distinct("words"),
                    lambda w: F.struct(w.alias("term"), F.lit(0).alias("o"), F.lit(1).alias("r")),
                ),
            )
        ).alias("t")
    )
    counted = emitted.groupBy(F.col("t.term").alias("term")).agg(
        F.sum("t.o").cast("bigint").alias("occurrences"), F.sum("t.r").cast("bigint").alias("records")
    )
    total = recs.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        "term",
        "occurrences",
        "records",
        (F.col("occurrences") <= rare_max).alias("rare"),
        (F.col("records") * common_one_in >= total).alias("common"),
    )


def found(chunks: DataFrame) -> DataFrame:
    """(term, mark) rows; a term with both marks has two."""
    marks = F.filter(
        F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))),
        lambda m: m.isNotNull(),
    )
    return term_frequencies(chunks).select("term", F.explode(marks).alias("mark"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "chunks"))


def p5_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "chunks"))


_COUNTED = """
WITH recs AS (SELECT DISTINCT id, content FROM chunks),
numbered AS (SELECT row_number() OVER () AS r, content FROM recs),
occ AS (SELECT r, lower(unnest(regexp_extract_all(content, '[A-Za-z0-9_]{2,}'))) AS term FROM numbered),
counted AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT r) AS records FROM occ GROUP BY term),
marked AS (
  SELECT term, occurrences, records, occurrences <= 1 AS rare,
         records * 10 >= (SELECT count(*) FROM recs) AS common
  FROM counted)
"""

QUERIES = {"p5_found": p5_found, "p5_term_frequency": p5_term_frequency}
ORACLES = {
    "p5_found": _COUNTED
    + "SELECT term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT term, 'common' AS mark FROM marked WHERE common",
    "p5_term_frequency": _COUNTED + "SELECT term, occurrences, records, rare, common FROM marked",
}
