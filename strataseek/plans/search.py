"""The engine's calls: search, presence, lookup, statistics, indexing."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataseek.functions.embedding import Embedder, HashEmbedder, with_vectors
from strataseek.functions.runtime import cut
from strataseek.functions.text import Query, occurrences, preview, tokenize
from strataseek.operators import chunking, fusion, incremental, keyword, lookup, semantic
from strataseek.operators.filters import CANDIDATE_TOKENS, clamp, scope
from strataseek.schema import CHUNKS
from strataseek.sources import files as sources
from strataseek.sources.store import Store
from strataseek.streaming import maintenance


@dataclass
class SearchResult:
    """Rows in order (``rank`` from 1) and what is known about them as one row: first_distance,
    min_distance, rows, confidence, paths (distinct ones), literals (rows of the index that
    hold each) and reasons of a confidence that isn't high."""

    rows: DataFrame
    summary: DataFrame
    query: Query
    mode: str


@dataclass(frozen=True)
class IndexRun:
    """What a run did: files on disk that have changed or not, those that were read and
    written, those that couldn't be read and stay as they were, new chunks, dropped files."""

    changed: int
    skipped: int
    processed: int
    unreadable: int
    chunks: int
    removed: int

    @property
    def percent(self) -> int:
        return round(100 * self.processed / self.changed) if self.changed else 100


def literal_hits(literals: list[str]):
    """Places of all literals in a content."""
    return reduce(lambda a, b: a + b, [occurrences(F.col("content"), t) for t in literals], F.lit(0)).cast("int")


def search(chunks: DataFrame, text: str, vector: list[float] | None, k=10, mode: str = "hybrid", language: str | None = None, path_glob: str | None = None, path_glob_exclude: str | None = None, metric: str = "sqeuclidean", match: str = "contains", corpus: str = "all", candidate_limit: int | None = None, min_score: float | None = None, candidate_tokens: int | None = CANDIDATE_TOKENS) -> SearchResult:
    """Search by meaning (``semantic``), words (``keyword``) or both (any other mode).

    A keyword search without tokens becomes a semantic one. Document frequencies respect
    the filters; the number of documents doesn't, unless ``corpus='filtered'``. One
    aggregate counts everything the ranking needs before the plan of the rows is built.
    """
    if not text or not isinstance(text, str):
        raise ValueError("query is required")
    k = clamp(k, 1, 50, 10)
    query = tokenize(text)
    if mode == "keyword" and not query.tokens:
        mode = "semantic"
    mode = mode if mode in ("semantic", "keyword") else "hybrid"
    scoped = scope(chunks, language, path_glob, path_glob_exclude)
    wanted = query.literals if mode == "semantic" else list(dict.fromkeys(query.tokens + query.literals))
    df, total = keyword.statistics(scoped, wanted, match)
    if scoped is not chunks and corpus != "filtered" and mode != "semantic":
        total = chunks.count()  # from the files' footers
    columns = ["id", "path", "language", "start_line", "end_line", "content"]
    pool = max(3 * k, 30)
    sem = kw = None
    if mode != "keyword":
        if vector is None:
            raise ValueError("this mode needs a query vector")
        sem = semantic.top(scoped.select(*columns, "vector"), "vector", vector, k if mode == "semantic" else pool, ["id", "content"], metric).drop("vector")
    if mode != "semantic":
        kw = keyword.top(scoped.select(*columns), query.tokens, df, total, k if mode == "keyword" else pool, match, candidate_limit, min_score, candidate_tokens)
    none = F.lit(None).cast("double")
    if mode == "semantic":
        got = fusion.ranked(sem, "distance", "id", "content").select(*columns, "distance", none.alias("bm25"), none.alias("rrf"), F.lit("semantic").alias("via"), (F.col("rank") + 1).alias("rank"))
    elif mode == "keyword":
        got = fusion.ranked(kw, F.desc("bm25"), "id", "content").select(*columns, none.alias("distance"), "bm25", none.alias("rrf"), F.lit("keyword").alias("via"), (F.col("rank") + 1).alias("rank"))
    else:
        a = fusion.ranked(sem, "distance", "id", "content")
        b = fusion.ranked(kw, F.desc("bm25"), "id", "content")
        fused = fusion.fuse(a, b, k, fusion.keyword_weight(query.literals, df), columns[1:])
        order = [F.desc(F.round("rrf", 12)), F.asc_nulls_last("rank_semantic"), F.col("rank_keyword")]
        got = fusion.ranked(fused, *order).select(*columns, "distance", "bm25", "rrf", "via", (F.col("rank") + 1).alias("rank"))
    got = got.withColumn("kw_hits", literal_hits(query.literals))
    seen = got.agg(F.min_by("distance", F.when(F.col("distance").isNotNull(), F.col("rank"))).alias("first_distance"), F.min("distance").alias("min_distance"), F.count(F.lit(1)).alias("rows"), F.count_distinct("path").alias("paths"))
    found = any(df.get(t, 0) > 0 for t in query.literals)
    level = fusion.confidence(F.lit(bool(query.literals)), F.lit(found), F.col("first_distance"), F.lit(mode == "keyword"), F.col("rows"))
    summary = seen.withColumn("confidence", level).select("first_distance", "min_distance", "rows", "confidence", "paths", _counts({t: df.get(t, 0) for t in query.literals}).alias("literals"), _reasons(query, found).alias("reasons"))
    return SearchResult(got, summary, query, mode)


def _counts(values: dict[str, int]):
    pairs = [x for t, n in values.items() for x in (F.lit(t), F.lit(n).cast("bigint"))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,bigint>)")


def _reasons(query: Query, found: bool):
    """Why a confidence isn't high; null if it is."""
    near = F.when(F.col("first_distance").isNotNull(), F.format_string("best dist=%.3f", F.col("first_distance")))
    none = F.lit("no chunk holds a literal of the query" if query.literals and not found else None).cast("string")
    return F.when(F.col("confidence") != "high", F.array_compact(F.array(near, none)))


def head(summary: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """(text): the lines above the results, fewer where there is nothing to say. ``stale``: the
    one row of ``Engine.freshness``."""
    both = summary.crossJoin(stale) if stale is not None else summary.withColumn("stale", F.lit(0)).withColumn("looked_at", F.lit(0)).withColumn("example", F.lit(None).cast("string"))  # one row each
    told = F.array_join(F.transform(F.map_entries("literals"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    lines = [
        F.when(F.size("literals") > 0, F.concat(F.lit("literal tokens: "), told)),
        F.when(F.col("confidence") != "high", F.concat_ws(" - ", F.concat(F.lit("confidence: "), F.col("confidence")), F.nullif(F.array_join("reasons", "; "), F.lit("")))),
        F.when(F.col("confidence") == "low", F.lit("  look for the exact text, search by keyword, or ask in other words")),
        F.when(F.col("stale") > 0, F.format_string("stale: %s of %s result files changed after indexing, such as %s", F.col("stale").cast("string"), F.col("looked_at").cast("string"), F.col("example"))),
        F.when(F.col("rows") == 0, F.lit("no matches")),
    ]
    return both.select(F.concat_ws("\n", *lines).alias("text"))


def format_chunk(chunk: DataFrame) -> DataFrame:
    """(text): one block for each chunk, with its whole content."""
    place = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  ("), F.coalesce("language", F.lit("")), F.lit(")"))
    return chunk.select(F.concat_ws("\n", place, F.concat(F.lit("```"), F.coalesce("language", F.lit(""))), F.coalesce("content", F.lit("")), F.lit("```")).alias("text"))


def search_all(chunks: DataFrame, texts: list[str], vectors: list[list[float] | None], **options) -> DataFrame:
    """The results of several questions, with ``query`` (from 1) and ``question``."""
    found = [search(chunks, t, v, **options).rows.select(F.lit(i).alias("query"), F.lit(t).alias("question"), "*") for i, (t, v) in enumerate(zip(texts, vectors), 1)]
    return reduce(DataFrame.unionByName, found)


def format_results(rows: DataFrame, literals: bool = False) -> DataFrame:
    """(rank, text): one formatted block for each result, with the scores it has."""
    bits = [
        F.concat(F.lit("via="), F.col("via")),
        F.concat(F.lit("kw_hits="), F.col("kw_hits").cast("string")) if literals else F.lit(None).cast("string"),
        F.when(F.col("distance").isNotNull(), F.format_string("dist=%.3f", F.col("distance"))),
        F.when(F.col("rrf").isNotNull(), F.format_string("rrf=%.4f", F.col("rrf"))),
        F.when(F.col("bm25").isNotNull() & F.col("rrf").isNull(), F.format_string("bm25=%.2f", F.col("bm25"))),
    ]
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  ("), F.concat_ws(", ", F.col("language"), *bits), F.lit(")"))
    return rows.select("rank", F.concat_ws("\n", head, F.concat(F.lit("id: "), F.col("id")), F.concat(F.lit("```"), F.coalesce("language", F.lit(""))), preview(F.coalesce("content", F.lit(""))), F.lit("```")).alias("text"))


class Engine:
    """An index in a folder: what a user calls. Changes of the index run one after another."""

    def __init__(self, spark: SparkSession, root: str, data_dir: str, make_embedder: Callable[[], Embedder] = HashEmbedder, watch: bool = True, startup_scan: bool = True, settle: float = 0.5, buckets: int = 64):
        self.spark, self.root, self.store, self.make = spark, root, Store(spark, data_dir, buckets), make_embedder
        self.ignore = sources.build_ignore(root, data_dir)
        self.watch, self.startup_scan, self.settle = watch, startup_scan, settle
        self._writing = threading.Lock()

    # questions

    def search(self, text: str, **options) -> SearchResult:
        vector = None if options.get("mode") == "keyword" and tokenize(text).tokens else self.make().embed([text])[0].tolist()
        return search(self.store.chunks(), text, vector, **options)

    def search_all(self, texts: list[str], **options) -> DataFrame:
        """The results of several questions: ``search_all``."""
        return search_all(self.store.chunks(), texts, self.make().embed(texts).tolist(), **options)

    def answer(self, text: str, **options) -> tuple[DataFrame, DataFrame]:
        """(the lines above the results, the results) as text."""
        got = self.search(text, **options)
        return head(got.summary, self.freshness(got.rows)), format_results(got.rows, bool(got.query.literals))

    def freshness(self, rows: DataFrame) -> DataFrame:
        """One row about the distinct paths of some results: looked_at, stale (newer on disk than
        in the index), missing, example (of a stale one). Only these paths are looked at."""
        paths = cut(rows.select("path").distinct())
        return incremental.freshness(paths, self.store.files(), sources.list_paths(paths, self.root))

    def exists(self, text: str, max_locations=20, match: str = "contains", **filters) -> tuple[DataFrame, DataFrame]:
        """(one row of counts, the first places)."""
        if not text or not isinstance(text, str):
            raise ValueError("query is required")
        scoped = scope(self.store.chunks(), **filters)
        return lookup.exists_summary(scoped, text, match), lookup.exists_sample(scoped, text, clamp(max_locations, 1, 200, 20), match)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        if not chunk_id or not isinstance(chunk_id, str):
            raise ValueError("id is required")
        return self.store.get_chunk(chunk_id)

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """(totals, chunks of each language, most first)."""
        return lookup.index_totals(self.store.chunks(), self.store.files()), lookup.language_order(self.store.chunks())

    def staleness(self, sample: int | None = 100) -> DataFrame:
        """Stale and missing files of a sample, or of all. Only the sampled paths are looked at."""
        return incremental.staleness(lambda paths: sources.list_paths(paths, self.root), self.store.files(), sample)

    # changes

    def chunk(self, contents: DataFrame) -> DataFrame:
        return with_vectors(chunking.chunk_files(contents), self.make).select(*CHUNKS.fieldNames())

    def _write(self, changed: DataFrame, gone: DataFrame | None) -> tuple[int, int]:
        """Read the changed files once, cut and embed them, and replace their rows; (files, chunks).
        A file that can't be read keeps the rows and the time it has, so it is tried again."""
        contents = cut(sources.read_contents(self.spark, self.root, changed))
        read = changed.join(contents.select("path"), "path", "left_semi").select("path", "mtime_ms")
        self.store.upsert(read, self.chunk(contents), gone)
        written = self.store.files().join(contents.select("path"), "path", "left_semi")
        return tuple(written.agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0))).first())

    def index(self, force: bool = False, prune_missing: bool = False) -> IndexRun:
        """Index what has changed since the last run (all with ``force``). Files that are gone
        stay, unless ``prune_missing``."""
        with self._writing:
            listing = cut(sources.list_tree(self.spark, self.root, self.ignore))
            changed = cut(incremental.changed_files(listing, self.store.files(), force))
            gone = cut(incremental.missing_files(listing, self.store.files())) if prune_missing else None
            n, removed = changed.count(), gone.count() if prune_missing else 0
            processed, chunks = self._write(changed, gone) if n or removed else (0, 0)
            return IndexRun(n, incremental.on_disk(listing).count() - n, processed, n - processed, chunks, removed)

    catch_up = index

    def apply(self, events: DataFrame) -> IndexRun:
        """One batch of changes (path, kind, event_time, seq): deletes first, then what is still
        there. Only the batch's own paths are looked at, each once it has rested."""
        with self._writing:
            gone, touched = (cut(x) for x in incremental.split_changes(events.where(F.col("path").isNotNull())))
            there = cut(incremental.on_disk(sources.list_paths(touched, self.root, self.ignore, self.settle)))
            n, removed = there.count(), gone.count()
            processed, chunks = self._write(there, gone) if n or removed else (0, 0)
            return IndexRun(n, 0, processed, n - processed, chunks, removed)

    def serve(self, log: str, checkpoint: str, since: datetime | None = None, interval: str | None = "2 seconds") -> Service:
        """Keep the index current in the background while questions are answered: what changed
        while nothing ran is indexed unless ``startup_scan`` is off, and events that are added
        to ``log`` are applied unless ``watch`` is off."""
        query = maintenance.maintain(maintenance.read_events(self.spark, log, since=since), self.apply, checkpoint, interval) if self.watch else None
        service = Service(query)
        if self.startup_scan:
            service.start(self.catch_up)
        return service


class Service:
    """The background work of ``Engine.serve``. A failed scan at the start doesn't end the
    service; its error is kept in ``error``."""

    def __init__(self, query: StreamingQuery | None):
        self.query, self.error, self.first_run, self._thread = query, None, None, None

    def start(self, scan: Callable[[], IndexRun]) -> None:
        def run():
            try:
                self.first_run = scan()
            except Exception as e:
                self.error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def await_idle(self) -> None:
        """Wait until the scan has ended and all events that are there are applied."""
        if self._thread:
            self._thread.join()
        if self.query:
            self.query.processAllAvailable()

    def stop(self) -> None:
        """Apply what has arrived, then end."""
        self.await_idle()
        if self.query:
            self.query.stop()
