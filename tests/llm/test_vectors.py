import numpy as np
import pytest

from strataseek.llm import neighbours as nb

DIM = 16
SCHEMA = "id string, path string, content string, vector array<float>, key string, vec string, d int, r int, l string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, "p", c, v, "x", "x", 1, 1, "x", "x") for i, c, v in rows], SCHEMA)


def clustered(n, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), DIM))
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, DIM))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.rint(v * 128) / 128


def brute(rows, k=5):
    contents = {}
    for i, c, _ in rows:
        contents.setdefault(i, set()).add(c)
    good = {i: np.array(v, np.float32) for i, c, v in rows if i is not None and len(contents[i]) == 1 and v is not None and len(v) == DIM and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    x = np.array([good[i] for i in ids], np.float64).reshape(-1, DIM)
    out = set()
    for a in range(len(ids)):
        d = ((x - x[a]) ** 2).sum(1)
        for b in [b for b in np.lexsort((np.arange(len(ids)), d)) if b != a][:k]:
            out.add(tuple(sorted((ids[a], ids[b]))))
    return out


def pairs(spark, rows):
    n = nb.neighbours(table(spark, rows), dim=DIM)
    return {tuple(sorted((r.id, r.neighbour))) for r in n.collect()}


def test_small_table_is_exact_with_ties_copies_and_dirt(spark):
    v = clustered(60, 1).tolist()
    rows = [(f"i{k:03d}", f"c{k}", v[k]) for k in range(60)]
    rows += [(f"h{k:03d}", "same", v[0]) for k in range(40)]  # a third of all rows share a vector
    rows += [rows[0], rows[0], ("i001", "other content", v[1]), ("n", "c", None), ("s", "c", [1.0] * 3), ("z", "c", [0.0] * DIM), ("q", "c", [float("nan")] * DIM), (None, "c", v[3]), ("nc", None, v[2]), ("nc", None, v[2]), ("m", "c", [None] + [1.0] * (DIM - 1))]
    assert pairs(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 7])
def test_tiny_tables(spark, n):
    rows = [(f"i{k}", "c", v) for k, v in enumerate(clustered(n, 2).tolist())]
    assert pairs(spark, rows) == brute(rows)


@pytest.mark.parametrize("coarse", [256, 5])
def test_recall_over_cells_of_one_and_two_levels(spark, monkeypatch, coarse):
    v = clustered(3000, 3, 0.02).tolist()
    rows = [(f"i{k:05d}", f"c{k}", v[k]) for k in range(3000)]
    want = brute(rows)
    monkeypatch.setattr(nb, "CELL_ROWS", 100)
    monkeypatch.setattr(nb, "COARSE", coarse)
    x = np.array(v, np.float32)
    cells = nb.fit_cells(table(spark, rows), DIM, len(rows))
    assert len(cells.coarse) == min(coarse, 30) and 25 <= cells.first[-1] <= 40
    home = cells.homes(x)
    count = (home >= 0).sum(1)
    assert (home[:, 0] >= 0).all() and 2 < count.mean() < 3 and np.bincount(home[home >= 0]).max() < 1500
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in home[:200])
    got = pairs(spark, rows)
    assert len(got & want) / len(want) > 0.95


def test_hot_vectors_have_no_group_of_their_size(spark):
    """A third of all rows share one vector, and many others are shared by some."""
    v = clustered(900, 6).tolist()
    rows = [(f"i{k:05d}", "c", v[k % 900]) for k in range(4000)] + [(f"h{k:05d}", "c", v[5]) for k in range(2000)]
    want = brute(rows)
    assert pairs(spark, rows) == want


def test_graph_recall_in_blocks():
    x = np.random.default_rng(4).standard_normal((3000, 24)).astype(np.float32)
    graph = nb.Graph(x, block=64)
    found = graph.search(x[:300], ef=64)
    d = ((x[:300, None] - x[None]) ** 2).sum(2)
    top = np.argsort(d, axis=1)[:, :5]
    assert np.mean([np.isin(top[i], found[i]).mean() for i in range(300)]) > 0.85
    assert all((links < len(x)).all() for links in graph.links)


def test_encoding_round_trip():
    rng = np.random.default_rng(5)
    for v in (np.rint(rng.standard_normal(DIM) * 20) / 128, rng.standard_normal(DIM), np.zeros(DIM), np.full(DIM, -1.0)):
        v = v.astype(np.float32)
        assert (nb.decode([nb.encode(v)])[0] == v).all()
    assert nb.encode(np.array([0.0, 1.0], np.float32)) == nb.encode(np.array([-0.0, 1.0], np.float32))


def test_neighbours_share_cells_where_coarse_borders_part_them(spark, monkeypatch):
    """Families of 12 vectors in many more topics than there are coarse centres, as in large tables."""
    dim, n = 128, 19_200
    rng = np.random.default_rng(7)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    topics = unit(rng.standard_normal((n // 48, 1, 1, dim)))
    families = unit(0.41 * topics + 0.91 * unit(rng.standard_normal((n // 48, 4, 1, dim))))
    v = (0.85 * families + 0.53 * unit(rng.standard_normal((n // 48, 4, 12, dim)))).reshape(n, dim)
    v = (np.rint(unit(v) * 128) / 128).astype(np.float32)
    monkeypatch.setattr(nb, "CELL_ROWS", 60)
    monkeypatch.setattr(nb, "COARSE", 64)
    monkeypatch.setattr(nb, "FINE_SAMPLE", 20)
    monkeypatch.setattr(nb, "SAMPLE", 1200)
    cells = nb.fit_cells(table(spark, [(f"i{k:05d}", "c", x) for k, x in enumerate(v.tolist())]), dim, n)
    home = cells.homes(v)
    assert len(cells.coarse) == 64 and 280 <= cells.first[-1] <= 360 and (home >= 0).sum(1).mean() < 3
    some = np.arange(0, n, 8)
    d = 2 - 2 * v[some] @ v.T
    d[np.arange(len(some)), some] = np.inf
    near = np.argsort(d, axis=1)[:, :5]
    met = (home[some][:, None, :, None] == home[near][:, :, None, :]) & (home[some] >= 0)[:, None, :, None]
    assert met.any((2, 3)).mean() > 0.97


@pytest.mark.parametrize("n", [1, 9, 30, 997])
def test_nearest_centres_are_those_of_all(n):
    rng = np.random.default_rng(8)
    x, c = rng.standard_normal((500, 20)).astype(np.float32), rng.standard_normal((n, 20)).astype(np.float32)
    for most in (1, 8):
        at, p = nb._nearest(x, c, most)
        assert np.allclose(p, -np.sort(-(x @ c.T), axis=1)[:, :most], atol=1e-5)
        assert np.allclose(p, np.take_along_axis(x @ c.T, at, 1), atol=1e-5)


def test_keys_are_made_without_coding_the_vectors(spark):
    v = clustered(40, 9).tolist() + (np.random.default_rng(9).standard_normal((20, DIM))).tolist()
    df = table(spark, [(f"i{k:03d}", f"c{k}", x) for k, x in enumerate(v)] + [("n", "c", None), ("z", "c", [0.0] * DIM)])
    keys, both = nb.packed(df, DIM, vec=False), nb.packed(df, DIM)
    assert keys.columns == ["id", "h", "key"]
    rows = {r.id: r for r in both.collect()}
    assert {r.id: (r.h, r.key) for r in keys.collect()} == {i: (r.h, r.key) for i, r in rows.items()}
    assert rows["n"].vec is None and rows["z"].key is None
    assert (nb.decode([rows[f"i{k:03d}"].vec for k in range(60)]) == np.array(v, np.float32)).all()


def test_beam_as_wide_as_the_graph_is_exact():
    x = np.random.default_rng(10).standard_normal((300, 24)).astype(np.float32)
    graph, q = nb.Graph(x), np.random.default_rng(11).standard_normal((40, 24)).astype(np.float32)
    start = np.tile([[graph.entry, 7, -1, 7]], (40, 1))
    rows, dist = graph.beam(q, start, 0, 320)
    d = ((q[:, None].astype(float) - x[None]) ** 2).sum(2)
    want = np.argsort(d, axis=1)
    assert (rows[:, :5] == want[:, :5]).mean() > 0.98 and (rows >= 0).sum(1).min() > 290
    has = rows >= 0
    assert all(len(set(r[h])) == h.sum() for r, h in zip(rows, has)) and np.isinf(dist[~has]).all()
    assert np.allclose(np.where(has, dist, 0), np.where(has, np.take_along_axis(d, np.maximum(rows, 0), 1), 0), atol=1e-3)


@pytest.mark.parametrize("whole", [True, False])
def test_lists_of_a_cell_have_exact_distances_with_ties(whole):
    x = np.random.default_rng(12).standard_normal((200, 16)).astype(np.float32)
    x = np.rint(x * 2).clip(-4, 4) / 8 if whole else x
    x = np.unique(x, axis=0)
    homes = np.full((len(x), 3), -1, np.int32)
    homes[:, 0] = 5
    row, other, dist = nb.cell_lists(x, x, 5, homes, np.zeros(len(x), int))
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (np.diff(row) >= 0).all() and (np.bincount(row, minlength=len(x)) >= 5).all()
    assert (dist == d[row, other]).all() if whole else np.allclose(dist, d[row, other], rtol=1e-12)
    got = set(zip(row.tolist(), other.tolist()))
    want = {(i, j) for i in range(len(x)) for j in np.flatnonzero(d[i] <= np.sort(d[i])[4]).tolist()}
    assert len(got & want) / len(want) > 0.98
