"""Keyword search: document frequencies in one pass, BM25 as an expression, top k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import holds, words
from strataseek.operators.filters import CANDIDATE_TOKENS, any_token

# Fixed values of the ranking.
K1, B, AVERAGE_LENGTH = 1.5, 0.75, 120.0


def document_frequency(scoped: DataFrame, tokens: list[str], match: str = "contains") -> dict[str, int]:
    """Rows that hold each token as a substring: one aggregate for all tokens."""
    return statistics(scoped, tokens, match)[0]


def statistics(scoped: DataFrame, tokens: list[str], match: str = "contains") -> tuple[dict[str, int], int]:
    """(rows that hold each token, all rows) in one pass."""
    row = scoped.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(holds(F.col("content"), t, match)).alias(f"t{i}") for i, t in enumerate(tokens)]).first()
    return {t: row[i + 1] for i, t in enumerate(tokens)}, row[0]


def idf(df: int, total: int) -> float:
    return math.log((total - df + 0.5) / (df + 0.5) + 1)


def term_count(word_list: Column, term: str) -> Column:
    """Places of a word in a list of words; removing it is compiled, a filter's lambda is not."""
    return F.size(word_list) - F.size(F.array_remove(word_list, term))


def _score(tokens: list[str], df: dict[str, int], total: int, length: Column, counts: list[Column]) -> Column:
    norm = 1 - B + B * (length / AVERAGE_LENGTH)
    score: Column = F.lit(0.0)
    for t, tf in zip(tokens, counts):
        weight = idf(df.get(t, 1), total)
        if weight > 0:
            score = score + F.when(tf > 0, F.lit(weight) * (tf * (K1 + 1)) / (tf + K1 * norm)).otherwise(0.0)
    return F.when(length > 0, score).otherwise(0.0)


def bm25(tokens: list[str], df: dict[str, int], total: int, word_list: Column) -> Column:
    """Score of a row from its words, terms in the tokens' order. Frequencies count whole
    words; a token without a document frequency counts as in one document."""
    return _score(tokens, df, total, F.size(word_list), [term_count(word_list, t) for t in tokens])


def with_bm25(rows: DataFrame, tokens: list[str], df: dict[str, int], total: int) -> DataFrame:
    """Rows with ``bm25`` of their content. Words and counts are columns of their own in
    between, each written once: as one expression the code of a row would be too large
    for the JVM to compile."""
    counted = rows.withColumn("_words", words(F.col("content"))).withColumns({"_n": F.size("_words"), **{f"_t{i}": term_count(F.col("_words"), t) for i, t in enumerate(tokens)}})
    scored = counted.withColumn("bm25", _score(tokens, df, total, F.col("_n"), [F.col(f"_t{i}") for i in range(len(tokens))]))
    return scored.select(*rows.columns, "bm25")


def candidates(scoped: DataFrame, tokens: list[str], match: str = "contains", limit: int | None = None, most: int | None = CANDIDATE_TOKENS) -> DataFrame:
    """Rows that hold any of the first ``most`` tokens (None: of all). All of them, unless a
    limit is asked for; then the first by path and line."""
    found = scoped.where(any_token(tokens, match, most))
    return found.orderBy("path", "start_line", "id").limit(limit) if limit else found


def top(scoped: DataFrame, tokens: list[str], df: dict[str, int], total: int, k: int, match: str = "contains", limit: int | None = None, min_score: float | None = None, most: int | None = CANDIDATE_TOKENS) -> DataFrame:
    """The k best candidates with ``bm25``; ties by id, then content. A candidate may score 0,
    since it is found by substring and scored by word."""
    scored = with_bm25(candidates(scoped, tokens, match, limit, most), tokens, df, total)
    if min_score is not None:
        scored = scored.where(F.col("bm25") >= min_score)
    return scored.orderBy(F.desc("bm25"), "id", "content").limit(k)
