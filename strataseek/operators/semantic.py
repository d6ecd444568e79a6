"""Exact vector search: one query, or many against all rows in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("sqeuclidean", "l2", "cosine")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance_expr(vector: Column, query: list[float], metric: str = "sqeuclidean") -> Column:
    """Distance from a query as a JVM expression; null for a null or differently long vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        d = 1 - dot(vector, q) / F.sqrt(dot(vector, vector) * dot(q, q))
    else:
        d = F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
        d = F.sqrt(d) if metric == "l2" else d
    return F.when(F.size(vector) == len(query), d)


def _measure(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows from queries, in double precision."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (x @ q.T) / np.sqrt((x**2).sum(1)[:, None] * (q**2).sum(1)[None])
    d = np.stack([((x - row) ** 2).sum(1) for row in q], axis=1) if len(q) else np.zeros((len(x), 0))
    return np.sqrt(d) if metric == "l2" else d


def distance_udf(query: list[float], metric: str = "sqeuclidean"):
    """The same as an Arrow function: for long vectors, where lambdas are slow."""
    q = np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def measure(v: pa.Array) -> pa.Array:
        out = np.full(len(v), np.nan)
        rows = np.flatnonzero(v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == len(q))
        if len(rows):
            flat = v.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))
            out[rows] = _measure(flat.to_numpy(zero_copy_only=False).reshape(-1, len(q)), q[None], metric)[:, 0]
        return pa.array(out)

    return measure


#: Longer vectors are measured by NumPy in Arrow batches; the distances are the same.
LAMBDA_DIM = 96


def with_distance(df: DataFrame, vector: str, query: list[float], metric: str = "sqeuclidean") -> DataFrame:
    """Rows with a usable vector and their ``distance``; others (null, another length, not a
    number) are left out."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if len(query) > LAMBDA_DIM:
        got = df.withColumn("distance", distance_udf(query, metric)(F.col(vector)))
    else:
        got = df.withColumn("distance", distance_expr(F.col(vector), query, metric))
    return got.where(F.col("distance").isNotNull() & ~F.isnan("distance"))


def top(df: DataFrame, vector: str, query: list[float], k: int, ties: list[str], metric: str = "sqeuclidean") -> DataFrame:
    """The k nearest rows; filters of ``df`` apply before. Ties by the columns named."""
    return with_distance(df, vector, query, metric).orderBy("distance", *ties).limit(k)


#: Vectors of a block, and blocks that meet the queries under one key.
BLOCK_ROWS, BLOCKS_A_KEY = 4096, 8


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Rows packed by the block: keys and one matrix. Vectors that are null, empty or not
    finite are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, col = batch.column("k"), batch.column("v")
            size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                for i in range(0, len(at), rows):
                    part = at[i : i + rows]
                    m = col.take(pa.array(part)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
                    good = np.isfinite(m).all(1)
                    if good.any():
                        kept = keys.take(pa.array(part[good]))
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([m[good].tobytes()], pa.binary())], names=["dim", "keys", "m"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"dim int, keys array<{kind}>, m binary")


def batch_top(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, metric: str = "sqeuclidean") -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of every query, itself included.

    The queries are a stated, smaller set. They and the rows are packed into blocks, each
    pair of blocks is one matrix product that gives k rows for a query, and these are merged
    by rank; no pair of single rows is ever a row. The queries are repeated for each key, of
    which there are as many as the rows' number asks for. Ties by key.
    """
    spread = max(8, -(-vectors.count() // (BLOCK_ROWS * BLOCKS_A_KEY)))  # from the files' footers
    kind = vectors.schema[key].dataType.simpleString()
    q = _blocks(queries, key, vector, 256).select("dim", F.col("keys").alias("qkeys"), F.col("m").alias("qm"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("m"), F.lit(spread)).cast("int")
    pairs = _blocks(vectors, key, vector, BLOCK_ROWS).withColumn("salt", salt).join(q, ["dim", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x = np.frombuffer(row.m).reshape(-1, row.dim)
                d = _measure(x, np.frombuffer(row.qm).reshape(-1, row.dim), metric)
                order = np.argsort(np.asarray(row.keys), kind="stable")  # ties by key
                keys, d = np.asarray(row.keys)[order], d[order]
                near = np.argsort(d, axis=0, kind="stable")[:k]
                yield pd.DataFrame({"query": np.repeat(np.asarray(row.qkeys), len(near)), "neighbour": keys[near].T.ravel(), "distance": np.take_along_axis(d, near, 0).T.ravel()})

    near = pairs.mapInPandas(run, f"query {kind}, neighbour {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalized(vector: Column) -> Column:
    """A vector at unit length; one of zeros stays."""
    n = F.sqrt(dot(vector, vector))
    return F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector)
