"""Registered queries of the retrieval engine and their DuckDB oracles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions import text
from strataseek.functions.embedding import HashEmbedder, with_vectors
from strataseek.functions.runtime import cut, ensure_checkpoint_dir, table
from strataseek.operators import chunking, fusion, incremental, keyword, lookup, semantic
from strataseek.operators.filters import scope
from strataseek.plans import search
from strataseek.sources import changes, files
from strataseek.sources.store import Store
from strataseek.streaming import maintenance

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PLAIN = "load ledger token quota"
NAMED = "loadLedger quota cursor"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _query_embedding(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]


def _query_chunk_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first chunk that has one: looked for among the rows of the smallest
    ids, and among all only if none of those has one."""
    c = table(spark, d, "chunks")
    ids = [r[0] for r in c.select("id").orderBy(F.asc_nulls_last("id")).limit(32).collect()]
    if ids and ids[-1] is not None:
        for row in c.where(F.col("id") <= ids[-1]).where(F.size("vector") == 768).orderBy("id", "content").select("vector").limit(64).collect():
            if all(x is not None and math.isfinite(x) for x in row[0]):
                return row[0]
    usable = c.where(F.size("vector") == 768).where(F.forall("vector", lambda x: ~F.isnan(x) & x.isNotNull()))
    return usable.agg(F.min_by("vector", F.struct("id", "content"))).first()[0]


# vectors

_Q7 = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 7)"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_V = "embedding::DOUBLE[]"


@query(f"WITH {_Q7} SELECT vec_id, round({_SQ.format(a=_V, b='qv')}, 6) AS distance FROM embeddings, q ORDER BY {_SQ.format(a=_V, b='qv')}, vec_id LIMIT 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    got = semantic.top(table(spark, d, "embeddings"), "embedding", _query_embedding(spark, d), 10, ["vec_id"])
    return got.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q7} SELECT vec_id, label, round({_SQ.format(a=_V, b='qv')}, 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY {_SQ.format(a=_V, b='qv')}, vec_id LIMIT 10")
def semantic_topk_label_filter(spark: SparkSession, d: str) -> DataFrame:
    got = semantic.top(table(spark, d, "embeddings").where("label = 3"), "embedding", _query_embedding(spark, d), 10, ["vec_id"])
    return got.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q7}, m AS (SELECT vec_id, 1 - {_DOT.format(a=_V, b='qv')} / sqrt({_DOT.format(a=_V, b=_V)} * {_DOT.format(a='qv', b='qv')}) AS dd FROM embeddings, q) SELECT vec_id, round(dd, 6) AS distance FROM m ORDER BY round(dd, 9), vec_id LIMIT 10")
def semantic_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    got = semantic.with_distance(table(spark, d, "embeddings"), "embedding", _query_embedding(spark, d), "cosine")
    return got.orderBy(F.round("distance", 9), "vec_id").limit(10).select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, {_SQ.format(a='a.' + _V, b='b.' + _V)} AS dd FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dd, neighbour) AS rank FROM p)
SELECT query, neighbour, round(dd, 6) AS distance, rank FROM r WHERE rank <= 5""")
def semantic_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = semantic.batch_top(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return got.select("query", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


_NORM = f"sqrt({_DOT.format(a=_V, b=_V)})"


@query(f"WITH u AS (SELECT vec_id, {_NORM} AS n, list_transform({_V}, lambda x: x / {_NORM}) AS v FROM embeddings) SELECT vec_id, round(n, 5) AS norm_before, round(sqrt({_DOT.format(a='v', b='v')}), 5) AS norm_after FROM u")
def vector_normalize_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("n", semantic.normalized(F.col("embedding")))
    return e.select("vec_id", F.round(F.sqrt(semantic.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm_before"), F.round(F.sqrt(semantic.dot(F.col("n"), F.col("n"))), 5).alias("norm_after"))


_USABLE = "len(vector) = 768 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x) OR x IS NULL))"
_QV = f"qv AS (SELECT vector::DOUBLE[] AS qv FROM chunks WHERE {_USABLE} ORDER BY id, content LIMIT 1)"
_DIST = _SQ.format(a="vector::DOUBLE[]", b="qv")


@query(f"WITH {_QV}, m AS (SELECT id, content, {_DIST} AS dd FROM chunks, qv WHERE {_USABLE} AND isfinite({_DIST})) SELECT id, round(dd, 6) AS distance FROM m ORDER BY dd, id, content LIMIT 10")
def chunk_semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "content", "vector")
    return semantic.top(c, "vector", _query_chunk_vector(spark, d), 10, ["id", "content"]).select("id", F.round("distance", 6).alias("distance"))


def _embedded(spark, d):
    c = table(spark, d, "chunks").select("id", "content").where("content IS NOT NULL").distinct()
    return with_vectors(c, HashEmbedder)


@query("SELECT DISTINCT id, md5(content) AS content_md5, 768 AS dim, (CASE WHEN regexp_matches(content, '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END)::DOUBLE AS norm FROM chunks WHERE content IS NOT NULL")
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all whole contents by the hashing embedder, as a check of their length and norm."""
    e = _embedded(spark, d)
    return e.select("id", F.md5("content").alias("content_md5"), F.size("vector").alias("dim"), F.round(semantic.dot(F.col("vector"), F.col("vector")), 3).alias("norm"))


# keywords


def _duck_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _duck_holds(t: str) -> str:
    return f"contains(lower(content), '{t}')"


def _duck_df(tokens: list[str], where: str = "TRUE") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {_duck_holds(t)}) AS d{i}" for i, t in enumerate(tokens))
    return f"df AS (SELECT (SELECT count(*) FROM chunks) AS n, {counts} FROM chunks WHERE {where})"


def _duck_bm25(tokens: list[str], where: str = "TRUE") -> str:
    """CTEs df and scored (columns of chunks and bm25) of the candidates."""
    norm = f"({1 - keyword.B} + {keyword.B} * (len(w) / {keyword.AVERAGE_LENGTH}))"
    tf = "len(list_filter(w, lambda x: x = '{t}'))"
    terms = " + ".join(
        f"CASE WHEN {tf.format(t=t)} > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * ({tf.format(t=t)} * {keyword.K1 + 1}) / ({tf.format(t=t)} + {keyword.K1} * {norm}) ELSE 0.0 END" for i, t in enumerate(tokens)
    )
    any_ = " OR ".join(_duck_holds(t) for t in tokens[:12])
    return f"{_duck_df(tokens, where)}, cand AS (SELECT id, path, language, start_line, end_line, content, regexp_extract_all(lower(content), '[A-Za-z0-9_]+') AS w FROM chunks WHERE {where} AND ({any_})), scored AS (SELECT cand.*, CASE WHEN len(w) > 0 THEN 0.0 + {terms} ELSE 0.0 END AS bm25 FROM cand, df)"


_P = text.tokenize(PLAIN)
_N = text.tokenize(NAMED)


@query(f"SELECT id, md5(content) AS content_md5 FROM chunks WHERE {' OR '.join(_duck_holds(t) for t in _N.tokens)}")
def keyword_candidates(spark: SparkSession, d: str) -> DataFrame:
    return keyword.candidates(table(spark, d, "chunks").select("id", "content"), _N.tokens).select("id", F.md5("content").alias("content_md5"))


def _bm25_top(spark, d, q: text.Query, k: int, **filters):
    chunks = table(spark, d, "chunks").select("id", "path", "language", "start_line", "end_line", "content")
    scoped = scope(chunks, **filters)
    df, total = keyword.statistics(scoped, q.tokens)
    return keyword.top(scoped, q.tokens, df, chunks.count() if filters else total, k)


@query(f"WITH {_duck_bm25(_P.tokens)} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25 DESC, id, content LIMIT 20")
def keyword_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_top(spark, d, _P, 20).select("id", F.round("bm25", 6).alias("bm25"))


_FILTER = "language = 'python' AND path LIKE '%/src/%' AND path NOT LIKE '%/tests/%'"


@query(f"WITH {_duck_bm25(_P.tokens, _FILTER)} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25 DESC, id, content LIMIT 20")
def keyword_bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    got = _bm25_top(spark, d, _P, 20, language="python", path_glob="*/src/*", path_glob_exclude="*/tests/*")
    return got.select("id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_duck_bm25(_N.tokens)} SELECT count(*) AS candidates, count(*) FILTER (WHERE bm25 = 0) AS zero_score FROM scored")
def keyword_zero_score_rows(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "content")
    df, total = keyword.statistics(chunks, _N.tokens)
    scored = keyword.with_bm25(keyword.candidates(chunks, _N.tokens), _N.tokens, df, total)
    return scored.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("bm25") == 0).alias("zero_score"))


LONG = "loader resolves entry packet metric bucket filter worker schema parser buffer column ledger quota cursor retry"
_L = text.tokenize(LONG)


@query(f"WITH {_duck_bm25(_L.tokens)} SELECT id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25 DESC, id, content LIMIT 20")
def keyword_long_query_topk(spark: SparkSession, d: str) -> DataFrame:
    """More than twelve tokens: the first twelve find candidates, all score them."""
    return _bm25_top(spark, d, _L, 20).select("id", F.round("bm25", 6).alias("bm25"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS token, count(*) FILTER (WHERE {_duck_holds(t)}) AS df FROM chunks" for t in [*_P.tokens, *_N.tokens]))
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    tokens = [*_P.tokens, *_N.tokens]
    c = table(spark, d, "chunks")
    one = c.agg(F.array(*[F.struct(F.lit(t).alias("token"), F.count_if(text.holds(F.col("content"), t)).alias("df")) for t in tokens]).alias("a"))
    return one.select(F.inline("a"))


@query("SELECT language, count(*) AS chunks, sum(len(regexp_extract_all(lower(content), '[A-Za-z0-9_]+')))::BIGINT AS words, max(len(regexp_extract_all(lower(content), '[A-Za-z0-9_]+')))::BIGINT AS longest FROM chunks GROUP BY language")
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "chunks").select("language", F.size(text.words(F.col("content"))).alias("n"))
    return n.groupBy("language").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").cast("bigint").alias("words"), F.max("n").cast("bigint").alias("longest"))


@query(f"SELECT id, md5(content) AS content_md5, {', '.join(f'''len(list_filter(regexp_extract_all(lower(content), '[A-Za-z0-9_]+'), lambda x: x = '{t}'))::BIGINT AS tf_{t}''' for t in _P.tokens)} FROM chunks")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "content", text.words(F.col("content")).alias("w"))
    return c.select("id", F.md5("content").alias("content_md5"), *[keyword.term_count(F.col("w"), t).cast("bigint").alias(f"tf_{t}") for t in _P.tokens])


# fusion


def _duck_hybrid(q: text.Query, weight: str) -> str:
    """CTE fused: id, rrf, ra, rb, distance, bm25, via of the pools of 30."""
    return f"""WITH {_QV}, sem AS (SELECT id, content, {_DIST} AS distance FROM chunks, qv WHERE {_USABLE} AND isfinite({_DIST})),
a AS (SELECT *, row_number() OVER (ORDER BY distance, id, content) - 1 AS ra FROM sem ORDER BY distance, id, content LIMIT 30),
{_duck_bm25(q.tokens)},
b AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, id, content) - 1 AS rb FROM scored ORDER BY bm25 DESC, id, content LIMIT 30),
aa AS (SELECT id, sum(1.0 / (60 + ra)) AS w, min(ra) AS ra, arg_min(distance, ra) AS distance FROM a GROUP BY id),
bb AS (SELECT id, sum({weight} / (60 + rb)) AS w, min(rb) AS rb, arg_min(bm25, rb) AS bm25 FROM b GROUP BY id),
fused AS (SELECT coalesce(aa.id, bb.id) AS id, coalesce(aa.w, 0) + coalesce(bb.w, 0) AS rrf, ra, rb, distance, bm25,
  CASE WHEN ra IS NULL THEN 'keyword' WHEN rb IS NULL THEN 'semantic' ELSE 'both' END AS via FROM aa FULL JOIN bb ON aa.id = bb.id)
"""


_TOP = "SELECT id, round(rrf, 9) AS rrf, via, ra AS rank_semantic, rb AS rank_keyword, round(distance, 6) AS distance, round(bm25, 6) AS bm25 FROM fused ORDER BY round(fused.rrf, 12) DESC, ra NULLS LAST, rb LIMIT 10"


def _fused(spark, d, q: text.Query, weighted: bool, limit: int):
    chunks = table(spark, d, "chunks")
    columns = chunks.select("id", "path", "start_line", "content")
    sem = semantic.top(chunks.select("id", "content", "vector"), "vector", _query_chunk_vector(spark, d), 30, ["id", "content"])
    df, total = keyword.statistics(columns, list(dict.fromkeys(q.tokens + q.literals)))
    kw = keyword.top(columns, q.tokens, df, total, 30)
    weight = fusion.keyword_weight(q.literals, df) if weighted else 1.0
    return fusion.fuse(fusion.ranked(sem, "distance", "id", "content"), fusion.ranked(kw, F.desc("bm25"), "id", "content"), limit, weight)


def _top_columns(f):
    return f.select("id", F.round("rrf", 9).alias("rrf"), "via", F.col("rank_semantic").cast("bigint").alias("rank_semantic"), F.col("rank_keyword").cast("bigint").alias("rank_keyword"), F.round("distance", 6).alias("distance"), F.round("bm25", 6).alias("bm25"))


@query(_duck_hybrid(_P, "1.0") + _TOP)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _top_columns(_fused(spark, d, _P, False, 10))


_WEIGHT = f"(SELECT CASE WHEN {' OR '.join(f'count(*) FILTER (WHERE {_duck_holds(t)}) > 0' for t in _N.literals)} THEN 1.6 ELSE 1.0 END FROM chunks)"


@query(_duck_hybrid(_N, _WEIGHT) + _TOP)
def hybrid_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _top_columns(_fused(spark, d, _N, True, 10))


@query(_duck_hybrid(_P, "1.0") + "SELECT via, count(*) AS n FROM fused GROUP BY via")
def rrf_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, _P, False, 60).groupBy("via").agg(F.count(F.lit(1)).alias("n"))


@query(
    _duck_hybrid(_N, _WEIGHT)
    + f""", top AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, ra NULLS LAST, rb) AS rank FROM fused ORDER BY rank LIMIT 10),
s AS (SELECT arg_min(distance, rank) FILTER (WHERE distance IS NOT NULL) AS first_distance, min(distance) AS min_distance, count(*) AS n FROM top)
SELECT round(first_distance, 6) AS first_distance, round(min_distance, 6) AS min_distance, n AS rows,
CASE WHEN {_WEIGHT} = 1.0 THEN 'low' WHEN first_distance <= 0.55 THEN 'high' ELSE 'medium' END AS confidence FROM s"""
)
def confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    got = search.search(table(spark, d, "chunks"), NAMED, _query_chunk_vector(spark, d)).summary
    return got.select(F.round("first_distance", 6).alias("first_distance"), F.round("min_distance", 6).alias("min_distance"), "rows", "confidence")


@query(
    f"""WITH {_Q7}, m AS (SELECT vec_id, label % 2 = 0 AS lit, label % 3 <> 0 AS known, vec_id % 5 = 0 AS kw, vec_id % 3 AS n, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE {_SQ.format(a=_V, b="qv")} / 2.5 END AS dd FROM embeddings, q)
SELECT vec_id, CASE
WHEN lit THEN CASE WHEN NOT known THEN 'low' WHEN dd <= 0.55 OR kw THEN 'high' ELSE 'medium' END
WHEN dd IS NOT NULL THEN CASE WHEN dd <= 0.55 THEN 'high' WHEN dd > 0.75 THEN 'low' ELSE 'medium' END
WHEN kw AND n > 0 THEN 'high' ELSE 'medium' END AS confidence FROM m"""
)
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every branch of the confidence, over situations made from the vectors' ids, labels and distances."""
    e = semantic.with_distance(table(spark, d, "embeddings"), "embedding", _query_embedding(spark, d))
    distance = F.when(F.col("vec_id") % 7 != 0, F.col("distance") / 2.5)
    level = fusion.confidence(F.col("label") % 2 == 0, F.col("label") % 3 != 0, distance, F.col("vec_id") % 5 == 0, F.col("vec_id") % 3)
    return e.select("vec_id", level.alias("confidence"))


@query(f"SELECT id, md5(content) AS content_md5, ({' + '.join(f'''(length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)}''' for t in ['ledger', 'loadledger'])})::INT AS hits FROM chunks WHERE {_duck_holds('ledger')}")
def literal_hits(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where(text.holds(F.col("content"), "ledger"))
    return c.select("id", F.md5("content").alias("content_md5"), search.literal_hits(["ledger", "loadledger"]).alias("hits"))


# presence, lookup, statistics


@query("SELECT count(*) AS matches, count(DISTINCT path) AS files FROM chunks WHERE contains(lower(content), 'load_ledger')")
def exists_summary(spark: SparkSession, d: str) -> DataFrame:
    return lookup.exists_summary(table(spark, d, "chunks"), "load_ledger")


@query("SELECT path, start_line, end_line FROM chunks WHERE contains(lower(content), 'load_ledger') ORDER BY path, start_line, end_line LIMIT 20")
def exists_sample(spark: SparkSession, d: str) -> DataFrame:
    return lookup.exists_sample(table(spark, d, "chunks"), "load_ledger", 20)


@query("SELECT count(*) AS matches, count(DISTINCT path) AS files FROM chunks WHERE lower(content) LIKE '%load_ledger%'")
def exists_like_mode(spark: SparkSession, d: str) -> DataFrame:
    return lookup.exists_summary(table(spark, d, "chunks"), "load_ledger", "like")


@query("SELECT id, path, language, start_line, end_line, content FROM chunks WHERE id = (SELECT max(id) FROM chunks) ORDER BY content LIMIT 1")
def get_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    last = c.agg(F.max("id")).first()[0]
    return c.where(F.col("id") == last).select("id", "path", "language", "start_line", "end_line", "content").orderBy("content").limit(1)


@query("SELECT language, count(*) AS n FROM chunks GROUP BY language")
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    return lookup.language_stats(table(spark, d, "chunks"))


@query("WITH n AS (SELECT language, count(*) AS n FROM chunks GROUP BY language) SELECT language, n, row_number() OVER (ORDER BY n DESC, language NULLS LAST) AS place FROM n")
def language_order(spark: SparkSession, d: str) -> DataFrame:
    """Languages with most chunks first, and their places."""
    n = lookup.language_order(table(spark, d, "chunks"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("language"))).cast("bigint"))  # one row for each language


@query("SELECT md5(concat(path, ':', start_line, '-', end_line, '  (', coalesce(language, ''), ')', chr(10), '```', coalesce(language, ''), chr(10), content, chr(10), '```')) AS text_md5 FROM chunks")
def chunk_details(spark: SparkSession, d: str) -> DataFrame:
    return search.format_chunk(table(spark, d, "chunks")).select(F.md5("text").alias("text_md5"))


@query("SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT path) FROM chunks) AS paths_with_chunks, count(*) AS file_rows, count(DISTINCT path) AS files FROM files")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return lookup.index_totals(table(spark, d, "chunks"), table(spark, d, "files"))


@query("SELECT id, path FROM chunks WHERE path LIKE '%/src/%.py'")
def path_like_filter(spark: SparkSession, d: str) -> DataFrame:
    return scope(table(spark, d, "chunks"), path_glob="*/src/*.py").select("id", "path")


@query("SELECT id, path FROM chunks WHERE path NOT LIKE '%/tests/%' AND language = 'python'")
def path_not_like_filter(spark: SparkSession, d: str) -> DataFrame:
    return scope(table(spark, d, "chunks"), language="python", path_glob_exclude="*/tests/*").select("id", "path")


# chunking

_DOC_FILES = "SELECT concat(coalesce(source, 'none'), '/', doc_id, '.txt') AS path, text AS content FROM documents"
_FRAMES = f"""WITH f AS ({_DOC_FILES}), l AS (SELECT path, string_split(content, chr(10)) AS lines FROM f WHERE length(content) BETWEEN 1 AND 500000),
w AS (SELECT path, len(lines) AS n, unnest(range(0, len(lines), 52)) AS i, lines FROM l),
c AS (SELECT path, n, i, array_to_string(lines[i + 1 : i + 60], chr(10)) AS content FROM w),
t AS (SELECT *, length(regexp_replace(regexp_replace(content, '^[\\s\\p{{Z}}\\x{{FEFF}}]+', ''), '[\\s\\p{{Z}}\\x{{FEFF}}]+$', '')) AS tl FROM c),
s AS (SELECT *, min(CASE WHEN tl < 100 THEN i END) OVER (PARTITION BY path) AS stop FROM t),
frames AS (SELECT path, (i + 1)::INT AS start_line, (CASE WHEN stop = 0 THEN n ELSE least(i + 60, n) END)::INT AS end_line, content FROM s
  WHERE stop IS NULL OR i < stop OR (i = 0 AND stop = 0 AND tl > 0))
"""


def _doc_files(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.lit("txt").alias("language"), F.col("text").alias("content"))


@query(_FRAMES + "SELECT path, start_line, end_line, md5(content) AS content_md5 FROM frames")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.frames(_doc_files(spark, d)).select("path", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(_FRAMES + "SELECT path, count(*) AS n FROM frames GROUP BY path")
def chunk_counts_per_file(spark: SparkSession, d: str) -> DataFrame:
    return chunking.frames(_doc_files(spark, d)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = """WITH l AS (SELECT id, start_line AS first, string_split(content, chr(10)) AS lines, content AS whole FROM chunks WHERE length(content) > 2000),
w AS (SELECT id, first, len(lines) AS n, whole, unnest(range(0, len(lines), 52)) AS i, lines FROM l),
c AS (SELECT id, first, n, i, whole, array_to_string(lines[i + 1 : i + 60], chr(10)) AS content FROM w),
s AS (SELECT *, min(CASE WHEN i > 0 AND length(content) < 100 THEN i END) OVER (PARTITION BY id, first, whole) AS stop FROM c)
SELECT DISTINCT id, (first + i)::INT AS start_line, (first + least(i + 60, n) - 1)::INT AS end_line, md5(content) AS content_md5 FROM s WHERE stop IS NULL OR i < stop"""


@query(_SPLIT)
def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where(F.length("content") > 2000)
    rows = c.select(F.col("id").alias("path"), "language", F.col("start_line").alias("first"), F.split("content", "\n", -1).alias("lines"))
    return chunking.split_oversize(rows).select(F.col("path").alias("id"), "start_line", "end_line", F.md5("content").alias("content_md5")).distinct()


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(parts) AS t, unnest(range(1, len(parts) + 1)) AS i FROM p),
q AS (SELECT doc_id, i, (sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 2)::INT AS s, length(t)::INT AS n FROM l),
f AS (SELECT doc_id, i, s, s + n AS e FROM q WHERE i = 1
UNION ALL SELECT q.doc_id, q.i, CASE WHEN f.e - f.s < 800 AND q.n < 800 AND q.s - f.e < 200 AND q.s + q.n - f.s <= 2000 THEN f.s ELSE q.s END, q.s + q.n FROM f JOIN q ON q.doc_id = f.doc_id AND q.i = f.i + 1)
SELECT doc_id, s, max(e) AS e FROM f GROUP BY doc_id, s"""
)
def merge_small_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of each document as ranges, folded."""
    docs = table(spark, d, "documents")
    parts = F.split("text", "\n\n", -1)
    ends = F.aggregate(
        parts, F.expr("cast(array() as array<struct<s:int,e:int>>)"),
        lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-2)) + 2).cast("int").alias("s"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-2)) + 2 + F.length(x)).cast("int").alias("e")))),
    )
    return docs.select("doc_id", chunking.merge_ranges(ends).alias("r")).select("doc_id", F.inline("r"))


@query()
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Definition chunks of the source texts in the chunk table, each taken as a file."""
    c = table(spark, d, "chunks").where("content IS NOT NULL AND path IS NOT NULL")
    files = c.select(F.concat("id", F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("path"), "content").distinct()
    return chunking.chunk_files(files).select("id", "path", "language", "start_line", "end_line", F.length("content").alias("chars"))


# text functions

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})))), ' ') AS tokens FROM documents")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.tokens(F.col("text"))), " ").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2 AND (regexp_matches(w, '[A-Z0-9_]') OR length(w) > 12)), lambda w: lower(w)))), ' ') AS literals FROM documents")
def literal_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.literals(F.col("text"))), " ").alias("literals"))


#: From the rule: a path that ends with a dot and a known extension has that one's language.
_LANGUAGE = "CASE " + " ".join(f"WHEN ends_with(path, '.{ext}') THEN '{lang}'" for ext, lang in text.LANGUAGE_OF.items()) + " END"


@query(f"SELECT DISTINCT path, {_LANGUAGE} AS language FROM file_listing")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_listing").select("path", text.language(F.col("path")).alias("language")).distinct()


@query("SELECT id, md5(CASE WHEN length(content) > 800 THEN content[1:800] || chr(10) || '... (truncated)' ELSE content END) AS preview_md5, md5(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')[1:120]) AS line_md5 FROM chunks")
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.md5(text.preview(F.col("content"))).alias("preview_md5"), F.md5(text.one_line(F.col("content"))).alias("line_md5"))


@query(
    f"""WITH {_duck_bm25(_N.tokens)}, top AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, id, content) AS rank FROM scored ORDER BY rank LIMIT 10)
SELECT rank, concat('[', rank, '] ', path, ':', start_line, '-', end_line, '  (', concat_ws(', ', language, 'via=keyword', concat('kw_hits=', {" + ".join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)}" for t in _N.literals)}), printf('bm25=%.2f', bm25)), ')', chr(10), 'id: ', id, chr(10), '```', coalesce(language, ''), chr(10),
CASE WHEN length(content) > 800 THEN content[1:800] || chr(10) || '... (truncated)' ELSE content END, chr(10), '```') AS text FROM top"""
)
def format_results(spark: SparkSession, d: str) -> DataFrame:
    got = search.search(table(spark, d, "chunks"), NAMED, None, mode="keyword")
    return search.format_results(got.rows, literals=True).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def format_hybrid_results(spark: SparkSession, d: str) -> DataFrame:
    """Formatted results with all four scores, and the lines above them as rank 0."""
    got = search.search(table(spark, d, "chunks"), NAMED, _query_chunk_vector(spark, d))
    return search.head(got.summary).select(F.lit(0).alias("rank"), "text").unionByName(search.format_results(got.rows, literals=True))


def _duck_top(q: text.Query, k: int, n: int) -> str:
    return f"(WITH {_duck_bm25(q.tokens)} SELECT {n} AS query, id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY scored.bm25 DESC, id, content) AS rank FROM scored ORDER BY scored.bm25 DESC, id, content LIMIT {k})"


@query(" UNION ALL ".join(_duck_top(q, 10, i) for i, q in enumerate((_P, _N, _L), 1)))
def search_batch(spark: SparkSession, d: str) -> DataFrame:
    """Several questions at once."""
    got = search.search_all(table(spark, d, "chunks"), [PLAIN, NAMED, LONG], [None] * 3, mode="keyword")
    return got.select("query", "id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {_duck_bm25(_P.tokens)}, top AS (SELECT path FROM scored ORDER BY bm25 DESC, id, content LIMIT 50), p AS (SELECT DISTINCT path FROM top),
st AS (SELECT path, max(mtime) AS stored FROM files GROUP BY path), dk AS (SELECT path, max(mtime_ms) AS m FROM file_listing WHERE is_file GROUP BY path)
SELECT count(*) AS looked_at, count(*) FILTER (WHERE floor(m) > floor(stored)) AS stale, count(*) FILTER (WHERE dk.path IS NULL) AS missing, min(CASE WHEN floor(m) > floor(stored) THEN p.path END) AS example
FROM p LEFT JOIN st ON p.path = st.path LEFT JOIN dk ON p.path = dk.path"""
)
def result_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the files of the found chunks have changed since."""
    rows = search.search(table(spark, d, "chunks"), PLAIN, None, k=50, mode="keyword").rows
    return incremental.freshness(rows, table(spark, d, "files"), table(spark, d, "file_listing"))


@query(
    f"""WITH {_duck_bm25(_P.tokens)}, top AS (SELECT * FROM scored ORDER BY bm25 DESC, id, content LIMIT 10)
SELECT id, path, language, start_line, end_line, round(bm25, 6) AS bm25, 'keyword' AS via, row_number() OVER (ORDER BY top.bm25 DESC, id, content) AS rank FROM top"""
)
def search_keyword_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = search.search(table(spark, d, "chunks"), PLAIN, None, mode="keyword").rows
    return rows.select("id", "path", "language", "start_line", "end_line", F.round("bm25", 6).alias("bm25"), "via", F.col("rank").cast("bigint").alias("rank"))


# incremental

_DISK = f"""disk AS (SELECT path, language, max(mtime_ms) AS mtime_ms FROM (SELECT path, mtime_ms, {_LANGUAGE} AS language FROM file_listing WHERE is_file) WHERE language IS NOT NULL GROUP BY path, language)"""
_STORED = "stored AS (SELECT path, max(mtime) AS stored FROM files GROUP BY path)"
_CHANGED = f"{_DISK}, {_STORED}, changed AS (SELECT disk.path, language, mtime_ms, floor(stored)::BIGINT AS stored_ms FROM disk LEFT JOIN stored ON disk.path = stored.path WHERE stored IS NULL OR mtime_ms IS NULL OR mtime_ms <> floor(stored))"


@query(f"WITH {_CHANGED} SELECT * FROM changed")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_files(table(spark, d, "file_listing"), table(spark, d, "files"))


@query(f"WITH {_DISK}, {_STORED} SELECT disk.path, mtime_ms, floor(stored)::BIGINT AS stored_ms FROM disk JOIN stored ON disk.path = stored.path WHERE mtime_ms > floor(stored)")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return incremental.stale_files(table(spark, d, "file_listing"), table(spark, d, "files"))


@query("SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM file_listing WHERE is_file)")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    return incremental.missing_files(table(spark, d, "file_listing"), table(spark, d, "files"))


@query(
    f"""WITH {_STORED}, seen AS (SELECT * FROM stored ORDER BY md5(path), path LIMIT 100),
there AS (SELECT path, max(mtime_ms) AS mtime_ms FROM file_listing WHERE is_file GROUP BY path)
SELECT count(*) AS looked_at, count(*) FILTER (WHERE floor(mtime_ms) > floor(stored)) AS stale, count(*) FILTER (WHERE there.path IS NULL) AS missing FROM seen LEFT JOIN there ON seen.path = there.path"""
)
def stale_sample(spark: SparkSession, d: str) -> DataFrame:
    return incremental.staleness(table(spark, d, "file_listing"), table(spark, d, "files"), 100)


@query(
    f"""WITH {_CHANGED}, n AS (SELECT path, count(*)::INT AS n FROM chunks GROUP BY path)
SELECT path, mtime, chunk_count FROM files WHERE path NOT IN (SELECT path FROM changed)
UNION ALL SELECT changed.path, floor(mtime_ms)::DOUBLE, coalesce(n, 0) FROM changed LEFT JOIN n ON changed.path = n.path"""
)
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    listing, files, chunks = (table(spark, d, t) for t in ("file_listing", "files", "chunks"))
    changed = incremental.changed_files(listing, files)
    return incremental.upserted(files, changed, incremental.file_rows(changed, chunks))


@query(f"WITH {_CHANGED} SELECT (SELECT count(*) FROM disk) AS on_disk, (SELECT count(*) FROM changed) AS changed, (SELECT count(*) FROM disk) - (SELECT count(*) FROM changed) AS skipped")
def index_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return incremental.run_counts(table(spark, d, "file_listing"), table(spark, d, "files"))


@query(
    """WITH a AS (SELECT path, max(floor(mtime))::BIGINT AS o FROM files GROUP BY path), b AS (SELECT path, max(mtime_ms) AS n FROM file_listing WHERE is_file GROUP BY path)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'unlink' ELSE 'change' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE b.path IS NULL OR o IS DISTINCT FROM n"""
)
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """The events that turn what is stored into what is on disk."""
    stored = table(spark, d, "files").select("path", F.floor("mtime").cast("bigint").alias("mtime_ms"), F.lit(True).alias("is_file"))
    return changes.events_between(stored, table(spark, d, "file_listing"))


_IGNORED = r"(^|/)(node_modules|\.git|dist|build|out|target|\.next|\.nuxt|\.turbo|\.cache|\.vercel|coverage)/|(^|/)([^/]*\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|\.DS_Store|[^/]*\.generated\.(ts|js)|[^/]*\.min\.(js|css))(/|$)"


@query(f"SELECT path, count(*) AS n FROM (SELECT path FROM file_listing WHERE is_file UNION ALL SELECT path FROM chunks) WHERE path IS NOT NULL AND NOT regexp_matches(path, '{_IGNORED}') GROUP BY path")
def kept_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of files and chunks that no ignore rule hides."""
    paths = table(spark, d, "file_listing").where("is_file").select("path").unionByName(table(spark, d, "chunks").select("path"))
    return files.not_ignored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")))


@query(f"SELECT path, kind, count(*) AS n FROM (SELECT path, kind, {_LANGUAGE} AS l FROM change_events) WHERE kind IN ('change', 'unlink') AND l IS NOT NULL AND NOT starts_with(path, '../') AND NOT starts_with(path, '/') GROUP BY path, kind")
def useful_events(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.useful(table(spark, d, "change_events")).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STORED}, few AS (SELECT DISTINCT path FROM files ORDER BY path LIMIT 40) SELECT path, stored FROM stored WHERE path IN (SELECT path FROM few)")
def stored_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of a list of paths."""
    f = table(spark, d, "files")
    paths = [r[0] for r in f.select("path").distinct().orderBy("path").limit(40).collect()]
    return incremental.stored_times(f.where(F.col("path").isin(paths))).select("path", "stored")


_LAST = """last AS (SELECT path, kind, event_time, seq FROM (SELECT path, kind, event_time, seq, row_number() OVER (PARTITION BY path ORDER BY event_time DESC NULLS LAST, seq DESC, kind DESC) AS r
FROM change_events WHERE path IS NOT NULL AND kind IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {_LAST} SELECT id, path, start_line, end_line FROM chunks WHERE path NOT IN (SELECT path FROM last WHERE kind = 'unlink')")
def delete_snapshot(spark: SparkSession, d: str) -> DataFrame:
    gone, _ = incremental.split_changes(table(spark, d, "change_events"))
    return incremental.deleted(table(spark, d, "chunks").select("id", "path", "start_line", "end_line"), gone)


def _kept_store(spark: SparkSession, d: str) -> Store:
    """The tables written as an index; then the changed files get their first chunks alone as
    new content, and unlinked paths are deleted."""
    store = Store(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    chunks, listed = table(spark, d, "chunks"), table(spark, d, "files")
    store.publish(chunks.where("path IS NOT NULL"), listed)
    changed = cut(incremental.changed_files(table(spark, d, "file_listing"), store.files()))
    store.upsert(changed, chunks.where("start_line = 1").join(changed, "path", "left_semi"))
    store.delete(incremental.split_changes(table(spark, d, "change_events"))[0])
    return store


_GONE = f"{_LAST}, gone AS (SELECT path FROM last WHERE kind = 'unlink')"


@query(
    f"""WITH {_CHANGED}, {_GONE} SELECT id, path, start_line, end_line, md5(content) AS content_md5, len(vector) AS dim FROM chunks
WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM gone) AND (start_line = 1 OR path NOT IN (SELECT path FROM changed))"""
)
def store_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the index on disk after an upsert and a delete."""
    c = _kept_store(spark, d).chunks()
    return c.select("id", "path", "start_line", "end_line", F.md5("content").alias("content_md5"), F.when(F.col("vector").isNotNull(), F.size("vector")).cast("bigint").alias("dim"))


@query(
    f"""WITH {_CHANGED}, {_GONE}, n AS (SELECT path, count(*)::INT AS n FROM chunks WHERE start_line = 1 GROUP BY path),
u AS (SELECT path, mtime, chunk_count FROM files WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT changed.path, floor(mtime_ms)::DOUBLE, coalesce(n, 0) FROM changed LEFT JOIN n ON changed.path = n.path)
SELECT path, mtime, chunk_count FROM u WHERE path NOT IN (SELECT path FROM gone)"""
)
def store_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the index on disk after an upsert and a delete."""
    return _kept_store(spark, d).files()


@query(f"WITH {_LAST} SELECT path, kind, event_time, seq FROM last")
def coalesce_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.coalesced(table(spark, d, "change_events"))


@query(
    """WITH e AS (SELECT DISTINCT seq, path, epoch_us(event_time) AS t FROM change_events WHERE path IS NOT NULL AND event_time IS NOT NULL),
g AS (SELECT path, t, CASE WHEN t - lag(t) OVER (PARTITION BY path ORDER BY t) < 2000000 THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT path, t, sum(new) OVER (PARTITION BY path ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT path, min(t) AS started_us, max(t) AS ended_us, count(*) AS n FROM r GROUP BY path, run"""
)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return incremental.bursts(table(spark, d, "change_events"))


@query(f"WITH {_LAST} SELECT path, kind, event_time, seq FROM last WHERE kind IN ('change', 'unlink')")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change log as a stream, micro-batches merged into the state of every path."""
    folder = f"{d}/change_events.parquet"
    single = any(f.rstrip("/").endswith("/change_events.parquet") for f in spark.read.parquet(folder).inputFiles())
    events = maintenance.read_events(spark, d, "change_events.parquet") if single else maintenance.read_events(spark, folder)
    work = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    state = maintenance.LatestState(spark, f"{work}/state")
    q = maintenance.maintain(events, state.merge, f"{work}/log", interval=None, known_languages=False)
    q.awaitTermination()
    return state.latest()
