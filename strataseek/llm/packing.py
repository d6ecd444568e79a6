"""Problem 6: texts put whole into containers of fixed capacity.

Pattern packing by non-negative least squares. Texts are sized in tokens of a public
tokenizer once; from then on only their length histogram (at most ``capacity`` bins)
decides. Patterns of lengths that fill a container exactly are enumerated, their
repeat counts are fitted to the histogram under x >= 0, rounded down to what the
histogram holds, and what is left is packed by patterns made largest length first,
each repeated as often as the rest allows. So the plan covers every text, is bounded
by the capacity and not by the number of texts, and a text finds its place from its
length and its rank among the texts of that length alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions.runtime import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Patterns of one capacity at most, and the sampled fillings they are taken from.
MOST_PATTERNS = 30_000
DRAWS = 20_000
#: Texts of one length are numbered in so many parts at least, and one for each so many texts.
SALTS, SALT_ROWS = 64, 50_000
SEED = 7


def _encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(n, np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens bigint")


def _enumerate(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Patterns ((length, times), ...) that fill the capacity exactly: all pairs, and
    longer ones whose lengths are drawn as the histogram has them and whose last one
    closes the gap."""
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    found: dict[tuple, None] = {}
    if have[capacity]:
        found[((capacity, 1),)] = None
    for a in sizes[(sizes * 2 >= capacity) & (sizes < capacity)]:
        if have[capacity - a]:
            b = capacity - int(a)
            found[((int(a), 2),) if a == b else ((int(a), 1), (b, 1))] = None
    rng = np.random.default_rng(SEED)
    mean = float(sizes @ counts) / counts.sum()
    width = int(min(64, max(3, 2 * capacity / mean)))
    drawn = rng.choice(sizes, (DRAWS, width), p=counts / counts.sum())
    total = drawn.cumsum(1)
    gap = capacity - total
    closes = (gap > 0) & have[np.clip(gap, 0, capacity)]
    rows, cols = np.nonzero(closes)
    for i in np.argsort(cols, kind="stable")[::-1]:  # longer patterns mix more lengths
        if len(found) >= MOST_PATTERNS:
            break
        r, c = rows[i], cols[i]
        lengths, times = np.unique(np.append(drawn[r, : c + 1], gap[r, c]), return_counts=True)
        found[tuple(zip(lengths.tolist()[::-1], times.tolist()[::-1]))] = None
    return list(found)


def _fit(patterns: list, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares for the repeat counts, by multiplicative updates until no
    count that matters changes by a hundredth of a repeat."""
    lens = np.array([len(p) for p in patterns])
    col = np.repeat(np.arange(len(patterns)), lens)
    row = np.array([a for p in patterns for a, _ in p])
    val = np.array([m for p in patterns for _, m in p], float)
    used = np.bincount(row, weights=val, minlength=len(histogram))
    x = np.maximum(np.minimum.reduceat(histogram[row] / np.maximum(used[row], 1), np.concatenate([[0], lens.cumsum()[:-1]])), 1e-3)
    target = np.bincount(col, weights=val * histogram[row], minlength=len(patterns))
    for _ in range(rounds):
        y = np.bincount(row, weights=val * x[col], minlength=len(histogram))
        new = x * target / np.maximum(np.bincount(col, weights=val * y[row], minlength=len(patterns)), 1e-12)
        moved, x = np.abs(new - x).max(initial=0), new
        if moved < 0.01:
            break
    return x


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(repeats, pattern) pairs that use up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    left[sizes] = counts
    out = []
    if len(sizes) and (patterns := _enumerate(sizes, counts, capacity)):
        x = _fit(patterns, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            times = min(int(x[i] + 0.5), *(int(left[a]) // m for a, m in patterns[i]))
            if times > 0:
                for a, m in patterns[i]:
                    left[a] -= times * m
                out.append((times, patterns[i]))
    active = np.flatnonzero(left)
    while len(active):
        gap, pattern, rest = capacity, [], left
        hi = len(active)
        while hi:
            a = int(active[hi - 1])
            if a <= gap:
                m = min(gap // a, int(rest[a]))
                pattern.append((a, m))
                gap -= m * a
                hi -= 1
            hi = min(hi, int(np.searchsorted(active, gap, "right")))
        times = min(int(left[a]) // m for a, m in pattern)
        for a, m in pattern:
            left[a] -= times * m
        out.append((times, tuple(pattern)))
        active = active[left[active] > 0]
    return out


def _intervals(made: list, sizes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """For every run of ranks of one length: its start among all texts ordered by length
    and rank, the first container, the texts it has there, the place of the first one."""
    start = dict(zip(sizes.tolist(), (counts.cumsum() - counts).tolist()))
    rows, base = [], 0
    for times, pattern in made:
        slot = 0
        for a, m in pattern:
            rows.append((start[a], base, m, slot))
            start[a] += times * m
            slot += m
        base += times
    rows.sort()
    return dict(zip(("start", "base", "times", "slot"), np.array(rows, np.int64).T))


def pack(docs: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Places of all texts for each container kind.

    Columns: container_kind, container_id, position, doc_id, piece, token_start, n_tokens.
    A text above the capacity is divided into pieces of exactly the capacity and a rest
    that is packed like any text; every other text is piece 0 and whole. A null or empty
    text takes no room: it has null container_id and position. A null kind is a kind like
    others; rows with a null or non-positive capacity are left out; of several capacities
    of a kind the smallest counts; repeated rows of ``docs`` are packed each. Extra columns
    are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    sized = cut(token_counts(docs, vocabulary))
    kinds = containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("c"))
    rows = sorted(((r[0], int(r[1])) for r in kinds.collect()), key=str)  # one row for each kind of container
    names, capacities = [r[0] for r in rows], [r[1] for r in rows]
    salts = max(SALTS, sized.count() // SALT_ROWS)
    doc = sized.schema["doc_id"].dataType.simpleString()
    out = f"container_kind string, container_id bigint, position int, doc_id {doc}, piece int, token_start bigint, n_tokens bigint"
    if not capacities:
        return spark.createDataFrame([], out)
    offered = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("c")) for k, c in enumerate(capacities)])
    by_kind = sized.select("doc_id", "n_tokens", F.explode(offered).alias("k")).select("doc_id", "n_tokens", "k.*")
    pieces = by_kind.select(
        "kind",
        "doc_id",
        "c",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("c")) - 1, F.lit(0)).cast("int"))).alias("piece"),
        "n_tokens",
    ).select(
        "kind",
        "doc_id",
        "piece",
        (F.col("piece") * F.col("c")).alias("token_start"),
        F.least(F.col("c"), F.col("n_tokens") - F.col("piece") * F.col("c")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt"),
    )
    held = pieces.where("n_tokens > 0")
    by_salt = cut(held.groupBy("kind", "n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")))
    bins = cut(by_salt.groupBy("kind", "n_tokens").agg(F.sum("n").alias("n")))  # at most the sum of the capacities

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kind = pdf.sort_values("n_tokens"), int(pdf["kind"].iloc[0])
        sizes, counts = pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        return pd.DataFrame({"kind": kind, **_intervals(plan(sizes, counts, capacities[kind]), sizes, counts)})

    # one plan for each kind, made from its histogram in a task of its own
    whole_plan = bins.repartition(len(names), "kind").groupBy("kind").applyInPandas(made, "kind int, start bigint, base bigint, times bigint, slot bigint").toPandas()
    plans = {kind: {c: part[c].to_numpy() for c in ("start", "base", "times", "slot")} for kind, part in whole_plan.sort_values("start").groupby("kind")}
    order = Window.partitionBy("kind", "n_tokens").orderBy("salt")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_salt.select("kind", "n_tokens", "salt", before.alias("before"))
    shorter = Window.partitionBy("kind").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    lengths = bins.select("kind", "n_tokens", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("first"))
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("kind", "n_tokens", "salt").orderBy("doc_id", "piece")) - 1)
    placed = ranked.join(offsets, ["kind", "n_tokens", "salt"]).join(lengths, ["kind", "n_tokens"])
    shared = spark.sparkContext.broadcast(plans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, part in pdf.groupby("kind"):
                p = shared.value[kind]
                g = part["g"].to_numpy()
                i = np.searchsorted(p["start"], g, "right") - 1
                k = g - p["start"][i]
                yield pd.DataFrame({
                    "container_kind": names[kind], "container_id": p["base"][i] + k // p["times"][i], "position": p["slot"][i] + k % p["times"][i],
                    "doc_id": part["doc_id"], "piece": part["piece"], "token_start": part["token_start"], "n_tokens": part["n_tokens"],
                })

    whole = placed.select("kind", "doc_id", "piece", "token_start", "n_tokens", (F.col("first") + F.col("before") + F.col("r")).alias("g"))
    named = F.array(*[F.lit(k).cast("string") for k in names])
    empty = pieces.where("n_tokens <= 0").select(named[F.col("kind")].alias("container_kind"), F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("position"), "doc_id", "piece", "token_start", "n_tokens")
    return whole.mapInPandas(run, out).unionByName(empty)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_containers"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused room of each kind."""
    kinds = table(spark, sf_dir, "pack_containers")
    used = pack(table(spark, sf_dir, "documents"), kinds).where("container_id IS NOT NULL").groupBy("container_kind").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")
    )
    sizes = kinds.where("capacity_tokens > 0").groupBy(F.col("container_kind").alias("k")).agg(F.min("capacity_tokens").alias("c"))
    return used.join(sizes, F.col("container_kind").eqNullSafe(F.col("k"))).select(
        "container_kind", "containers", "tokens", "pieces", (F.col("containers") * F.col("c") - F.col("tokens")).alias("unused_tokens")
    )


QUERIES = {"p6_packing": p6_packing, "p6_unused": p6_unused}
