"""Predicates of searches as Columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import glob_to_like, holds

CANDIDATE_TOKENS = 12


def scope(df: DataFrame, language: str | None = None, path_glob: str | None = None, path_glob_exclude: str | None = None) -> DataFrame:
    """Rows of a language and of paths that match one pattern and not another. ``*`` stands
    for any text, as do ``%`` and ``_`` in their usual way; patterns match whole paths; an
    absent or empty filter lets everything through; a null path matches neither pattern."""
    conds: list[Column] = []
    if language:
        conds.append(F.col("language") == language)
    if path_glob:
        conds.append(F.col("path").like(glob_to_like(path_glob)))
    if path_glob_exclude:
        conds.append(~F.col("path").like(glob_to_like(path_glob_exclude)))
    return df.where(reduce(and_, conds)) if conds else df


def any_token(tokens: list[str], match: str = "contains", most: int | None = CANDIDATE_TOKENS) -> Column:
    """Whether a content holds any of the first ``most`` tokens (None: of all); false without tokens."""
    return reduce(or_, [holds(F.col("content"), t, match) for t in tokens[:most]], F.lit(False))


def clamp(value, low: int, high: int, default: int) -> int:
    """A count argument: absent, zero or not a number gives the default."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    if number != number or not number:
        return default
    return int(max(low, min(high, number)))
