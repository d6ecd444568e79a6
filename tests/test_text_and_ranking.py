import math

import pytest
from pyspark.sql import functions as F

from strataseek.functions import text
from strataseek.operators import fusion, keyword, lookup, semantic
from strataseek.operators.filters import clamp, scope
from strataseek.plans import search


@pytest.mark.parametrize(
    "query, tokens, literals",
    [
        ("Where do we handle JWT refresh", ["handle", "jwt", "refresh"], ["where", "jwt"]),
        ("user_id a I x2", ["user_id", "x2"], ["user_id", "x2"]),
        ("authenticationhandler", ["authenticationhandler"], ["authenticationhandler"]),
        ("the function", [], []),
        ("auth auth Auth", ["auth"], ["auth"]),
        ("", [], []),
        (None, [], []),
        ("été naïve", ["na", "ve"], []),
    ],
)
def test_tokenizer(spark, query, tokens, literals):
    assert text.tokenize(query) == (tokens, literals)
    row = spark.createDataFrame([(query,)], "q string").select(text.tokens(F.col("q")).alias("t"), text.literals(F.col("q")).alias("l")).first()
    assert (row.t or []) == tokens and (row.l or []) == literals


@pytest.mark.parametrize(
    "path, language",
    [("a.PY", None), ("a.py", "python"), ("Makefile", None), (".env", "env"), (".env.local", None), ("x.h", "c"), ("a.d/Makefile", None), ("a.yml", "yml"), ("a.yaml", "yaml"), ("b.mjs", "javascript"), ("", None), (None, None)],
)
def test_language(spark, path, language):
    assert spark.createDataFrame([(path,)], "p string").select(text.language(F.col("p"))).first()[0] == language


@pytest.mark.parametrize("tokens, df, score", [(["foo"], {"foo": 5}, 6.031859947363387), (["bar"], {"bar": 20}, 2.8224701428263663), (["foo", "bar"], {"foo": 5, "bar": 20}, 8.854330090189753), (["bar"], {}, 7.450717537580699), (["bar"], {"bar": 100}, 0.008783697950670969)])
def test_bm25(spark, tokens, df, score):
    row = spark.createDataFrame([("foo bar foo baz",)], "c string").select(keyword.bm25(tokens, df, 100, text.words(F.col("c")))).first()
    assert math.isclose(row[0], score, rel_tol=1e-12)


def test_bm25_of_nothing(spark):
    df = spark.createDataFrame([("",), ("!!",), (None,)], "c string")
    assert [r[0] for r in df.select(F.coalesce(keyword.bm25(["a"], {}, 5, text.words(F.col("c"))), F.lit(0.0))).collect()] == [0.0, 0.0, 0.0]


def lists(spark, a, b):
    s = spark.createDataFrame(a or [], "id string, rank int, distance double")
    k = spark.createDataFrame(b or [], "id string, rank int, bm25 double")
    return s, k


def test_fusion(spark):
    a, b = lists(spark, [("x", 0, 0.1), ("y", 1, 0.2), ("z", 2, 0.3), (None, 3, 0.4)], [("q", 0, 9.0), ("x", 1, 8.0), ("z", 6, 1.0)])
    rows = fusion.fuse(a, b, 10).collect()
    assert [r.id for r in rows] == ["x", "z", "q", "y"]
    by = {r.id: r for r in rows}
    assert by["x"].via == "both" and by["q"].via == "keyword" and by["y"].via == "semantic"
    assert math.isclose(by["z"].rrf, 0.03128054740957967, rel_tol=1e-12) and math.isclose(by["q"].rrf, 1 / 60, rel_tol=1e-12)
    assert by["q"].distance is None and by["x"].distance == 0.1 and by["x"].bm25 == 8.0
    weighted = {r.id: r.rrf for r in fusion.fuse(a, b, 10, 1.6).collect()}
    assert math.isclose(weighted["q"], 0.02666666666666667, rel_tol=1e-12)


def test_fusion_ties_duplicates_and_empty_lists(spark):
    a, b = lists(spark, [("x", 0, 0.1)], [("q", 0, 9.0)])
    assert [r.id for r in fusion.fuse(a, b, 10).collect()] == ["x", "q"]
    a, b = lists(spark, [("x", 0, 0.1), ("x", 1, 0.1)], [])
    assert math.isclose(fusion.fuse(a, b, 10).first().rrf, 1 / 60 + 1 / 61, rel_tol=1e-12)
    a, b = lists(spark, [], [])
    assert fusion.fuse(a, b, 10).count() == 0


@pytest.mark.parametrize(
    "literals, found, distance, keyword_mode, rows, level",
    [
        (True, False, 0.1, False, 3, "low"), (True, True, 0.55, False, 3, "high"), (True, True, None, True, 3, "high"), (True, True, 0.6, False, 3, "medium"), (False, False, 0.55, False, 3, "high"),
        (False, False, 0.76, False, 3, "low"), (False, False, 0.75, False, 3, "medium"), (False, False, None, True, 1, "high"), (False, False, None, True, 0, "medium"), (False, False, None, False, 1, "medium"),
    ],
)
def test_confidence(spark, literals, found, distance, keyword_mode, rows, level):
    df = spark.createDataFrame([(distance,)], "d double")
    assert df.select(fusion.confidence(F.lit(literals), F.lit(found), F.col("d"), F.lit(keyword_mode), F.lit(rows))).first()[0] == level


@pytest.mark.parametrize("value, k", [(0, 10), (-5, 1), (51, 50), (None, 10), ("abc", 10), (7, 7), (float("nan"), 10)])
def test_clamp(value, k):
    assert clamp(value, 1, 50, 10) == k


CHUNKS = "id string, path string, language string, start_line int, end_line int, content string, vector array<float>, words string, rank int, hits int"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], CHUNKS)


ROWS = [
    ("a:1-2", "src/a.py", "python", 1, 2, "def load_user_id(): return user_id", [1.0, 0.0]),
    ("b:1-2", "src/b.py", "python", 1, 2, "user-id 100% it's a\\b", [0.0, 1.0]),
    ("c:1-2", "tests/c.ts", "typescript", 1, 2, "LOAD everything user_id user_id", [0.6, 0.8]),
    ("d:1-2", "src/d.ts", None, 1, 2, None, None),
    ("e:1-2", None, "", None, None, "", [1.0]),
    ("f:1-2", "src/f.py", "python", 1, 2, "nothing", [float("nan"), 0.0]),
]


def test_literal_search_and_wildcards(spark):
    df = chunks(spark, ROWS)
    count = lambda t, m="contains": lookup.exists_summary(df, t, m).first().matches
    assert count("user_id") == 2 and count("user_id", "like") == 3
    assert count("100%") == 1 and count("it's") == 1 and count("a\\b") == 1 and count("a\\b", "like") == 1
    assert [r.path for r in lookup.exists_sample(df, "USER", 10).collect()] == ["src/a.py", "src/b.py", "tests/c.ts"]
    assert lookup.exists_summary(chunks(spark, []), "x").first() == (0, 0)


def test_scope(spark):
    df = chunks(spark, ROWS)
    ids = lambda **f: sorted(r.id[0] for r in scope(df, **f).collect())
    assert ids() == list("abcdef") and ids(language="python") == list("abf") and ids(path_glob="src/*.py") == list("abf")
    assert ids(path_glob_exclude="src/*") == ["c"] and ids(language="", path_glob=None) == list("abcdef") and ids(language="PYTHON") == []


def test_vector_search(spark):
    df = chunks(spark, ROWS)
    got = semantic.top(df, "vector", [1.0, 0.0], 10, ["id"]).collect()
    assert [(r.id[0], round(r.distance, 6)) for r in got] == [("a", 0.0), ("c", 0.8), ("b", 2.0)]
    assert [round(r.distance, 6) for r in semantic.top(df, "vector", [1.0, 0.0], 2, ["id"], "cosine").collect()] == [0.0, 0.4]
    long = [[float(i == j) for j in range(100)] for i in range(3)]
    wide = spark.createDataFrame([(i, v) for i, v in enumerate(long)] + [(7, None), (8, [1.0])], "id int, vector array<float>")
    assert [(r.id, r.distance) for r in semantic.top(wide, "vector", long[1], 3, ["id"]).collect()] == [(1, 0.0), (0, 2.0), (2, 2.0)]
    with pytest.raises(ValueError):
        semantic.top(df, "vector", [1.0, 0.0], 1, ["id"], "other")


def test_batch_search_equals_single(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(200)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec long, v array<float>")
    got = {}
    for r in semantic.batch_top(df.where("vec % 50 = 0"), df, "vec", "v", 4).collect():
        got.setdefault(r.query, []).append((r.rank, r.neighbour, r.distance))
    for q in (0, 50, 100, 150):
        one = [(r.vec, r.distance) for r in semantic.top(df, "v", rows[q][1], 4, ["vec"]).collect()]
        assert [(n, d) for _, n, d in sorted(got[q])] == one
    assert semantic.batch_top(df.where("false"), df, "vec", "v", 4).count() == 0


def test_search_modes(spark):
    df = chunks(spark, ROWS)
    hybrid = search.search(df, "load user_id", [1.0, 0.0])
    rows = hybrid.rows.orderBy("rank").collect()
    assert [r.id for r in rows[:2]] == ["c:1-2", "a:1-2"] and rows[0].via == "both" and rows[0].kw_hits == 2
    seen = hybrid.summary.first()
    assert seen.confidence == "medium" and round(seen.first_distance, 6) == 0.8 and seen.min_distance == 0.0
    keyword_rows = search.search(df, "load", None, mode="keyword").rows.collect()
    assert {r.id for r in keyword_rows} == {"a:1-2", "c:1-2"} and all(r.distance is None for r in keyword_rows)
    assert search.search(df, "the function", [1.0, 0.0], mode="keyword").mode == "semantic"
    assert search.search(df, "nowhere", [1.0, 0.0], language="rust").rows.count() == 0
    text_rows = search.format_results(hybrid.rows, True).orderBy("rank").collect()
    assert text_rows[0].text.startswith("[1] tests/c.ts:1-2  (typescript, via=both, kw_hits=2, dist=0.800, rrf=")
    with pytest.raises(ValueError):
        search.search(df, "", None)


def test_search_prefix_property(spark):
    df = chunks(spark, ROWS)
    few = [r.id for r in search.search(df, "load user_id", [1.0, 0.0], k=2).rows.orderBy("rank").collect()]
    many = [r.id for r in search.search(df, "load user_id", [1.0, 0.0], k=3).rows.orderBy("rank").collect()]
    assert many[:2] == few


def test_candidates_of_more_than_twelve_tokens(spark):
    """The thirteenth token finds rows only if it is asked for; both evaluators of distances agree."""
    tokens = [f"word{i:02d}" for i in range(13)]
    df = spark.createDataFrame([("a", "word00"), ("b", "word12"), ("c", None)], "id string, content string")
    assert [r.id for r in keyword.candidates(df, tokens).collect()] == ["a"]
    assert [r.id for r in keyword.candidates(df, tokens, most=None).orderBy("id").collect()] == ["a", "b"]
    assert keyword.with_bm25(df, ["word12"], {}, 3).where("id = 'b'").first().bm25 > 0 == keyword.with_bm25(df.where("id = 'a'"), ["word12"], {}, 3).first().bm25


@pytest.mark.parametrize("dim", [96, 97])
def test_distances_on_both_sides_of_the_switch(spark, dim):
    rows = [(k, [float((k * i) % 7) for i in range(dim)]) for k in range(5)] + [(9, None), (10, [1.0])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    q = [1.0] * dim
    for metric in semantic.METRICS[:2]:
        got = {r.k: r.distance for r in semantic.with_distance(df, "v", q, metric).collect()}
        want = {k: sum((x - 1) ** 2 for x in v) for k, v in rows[:5]}
        assert got == {k: pytest.approx(d if metric == "sqeuclidean" else d**0.5) for k, d in want.items()}
