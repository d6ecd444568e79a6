import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataseek.functions.embedding import HashEmbedder, mean_pool
from strataseek.operators import chunking, incremental
from strataseek.plans.search import Engine, format_chunk
from strataseek.schema import CHUNKS, FILES, require
from strataseek.sources import files as sources
from strataseek.sources.changes import events_between
from strataseek.sources.store import Store
from strataseek.streaming import maintenance

LINE = "some words that make a line long enough"


def files(spark, rows):
    return spark.createDataFrame([(p, "txt", c, "x", 1) for p, c in rows], "path string, language string, content string, lines string, n int")


def spans(spark, content):
    return [(r.start_line, r.end_line) for r in chunking.frames(files(spark, [("p", content)])).orderBy("start_line").collect()]


@pytest.mark.parametrize(
    "n, expected",
    [(52, [(1, 52)]), (60, [(1, 60), (53, 60)]), (61, [(1, 60), (53, 61)]), (104, [(1, 60), (53, 104)]), (113, [(1, 60), (53, 112), (105, 113)]), (200, [(1, 60), (53, 112), (105, 164), (157, 200)])],
)
def test_frames(spark, n, expected):
    assert spans(spark, "\n".join([LINE] * n)) == expected


def test_frames_stop_rules(spark):
    assert spans(spark, "\n" * 60 + LINE * 9) == []
    assert spans(spark, "short\n" + "\n" * 60 + LINE * 9) == [(1, 62)]
    assert spans(spark, "\n".join([LINE] * 52 + [""] * 60 + [LINE] * 50)) == [(1, 60)]
    assert spans(spark, "") == [] and spans(spark, None) == [] and spans(spark, "x" * 500_001) == []
    assert spans(spark, "x" * 500_000) == [(1, 1)]
    assert spans(spark, " ﻿" * 200) == []


def loop_frames(text):
    lines = text.split("\n")
    out = []
    for i in range(0, len(lines), 52):
        part = "\n".join(lines[i : i + 60])
        t = len(part.strip(" \t\n\r\x0b\x0c"))
        if t < 100:
            if i == 0 and t:
                out.append((1, len(lines)))
            break
        out.append((i + 1, min(i + 60, len(lines))))
    return out


def test_frames_equal_a_loop(spark):
    rnd = random.Random(4)
    texts = ["\n".join(LINE if rnd.random() < rnd.choice([0.02, 0.5, 1]) else "" for _ in range(rnd.randrange(1, 260))) for _ in range(60)]
    got = {}
    for r in chunking.frames(files(spark, [(str(k), t) for k, t in enumerate(texts)])).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    assert {k: sorted(v) for k, v in got.items()} == {str(k): f for k, t in enumerate(texts) if (f := loop_frames(t))}


def loop_merge(ranges):
    out = []
    for s, e in sorted(ranges):
        if out and out[-1][1] - out[-1][0] < 800 and e - s < 800 and s - out[-1][1] < 200 and e - out[-1][0] <= 2000:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def test_merge_equals_a_loop(spark):
    rnd = random.Random(5)
    cases = [[], [(0, 799), (998, 1700)], [(0, 799), (999, 1700)], [(0, 800), (801, 900)], [(0, 700), (800, 1400), (1450, 2000)], [(0, 700), (800, 1400), (1450, 2001)]]
    for _ in range(80):
        at, r = 0, []
        for _ in range(rnd.randrange(12)):
            at += rnd.choice([0, 10, 150, 199, 200, 400])
            r.append((at, at + rnd.choice([5, 300, 799, 800, 1200])))
            at = r[-1][1]
        cases.append(r)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(cases)], "k int, r array<struct<s:int,e:int>>")
    for row in df.select("k", chunking.merge_ranges(F.col("r")).alias("m")).collect():
        assert [tuple(x) for x in row.m] == loop_merge(cases[row.k])


def test_code_chunks(spark):
    body = "".join(f"    value_{k} = compute_something({k}, value_{k})\n" for k in range(70))
    source = "import os\n\n" + "".join(f"def f{k}(a):\n    return a + {k}  # {'x' * 60}\n\n" for k in range(4)) + "class Big:\n" + body
    rows = [("r/a.py", source), ("r/b.py", "x = 1\n"), ("r/c.unknown", source), ("r/d.go", "package x\n\nfunc F() {\n" + "\tcall()\n" * 30 + "}\n"), ("r/e.py", None), ("r/f.py", "def broken(:\n" + LINE * 5)]
    got = {}
    for r in chunking.chunk_files(spark.createDataFrame(rows, "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.content))
        assert r.id == f"{r.path}:{r.start_line}-{r.end_line}"
    lines = source.split("\n")
    a = sorted(got["r/a.py"])
    assert a[0][:2] == (3, 13) and a[0][2] == "\n".join(lines[2:13])
    assert [x[:2] for x in a[1:]] == [(15, 74), (67, 85)] and a[1][2] == "\n".join(lines[14:74])
    assert got["r/b.py"][0][:2] == (1, 2) and [x[:2] for x in got["r/d.go"]] == [(3, 34)] and got["r/f.py"] and "r/c.unknown" not in got and "r/e.py" not in got


def test_ignore_rules(tmp_path):
    ig = sources.Ignore(["*.log", "!keep.log", "/top", "docs/*.md", "**/gen", "a/**/z.py", "build/", "# note", "", "x?.c", "[ab].txt"])
    hidden = ["a.log", "d/b.log", "top", "docs/a.md", "p/gen/x.py", "gen/y", "a/b/c/z.py", "a/z.py", "build/o", "q/build/o", "x1.c", "a.txt"]
    shown = ["keep.log", "d/top", "docs/x/a.md", "generate/x", "build.py", "xx1.c", "c.txt"]
    assert [p for p in hidden if not ig.ignores(p)] == [] and [p for p in shown if ig.ignores(p)] == []
    assert sources.build_ignore(str(tmp_path)).ignores("node_modules/a.js") and sources.build_ignore(str(tmp_path)).ignores("a.min.js")
    os.mkdir(tmp_path / ".git")
    assert sources.find_root(str(tmp_path)) == str(tmp_path)


def put(root, path, text, t):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)
    os.utime(full, (t, t))


def test_engine_indexes_incrementally(spark, tmp_path):
    root, data = tmp_path / "repo", tmp_path / "data"
    root.mkdir()
    put(root, "src/a.py", "def find_user():\n    return lookup('user')  # " + "x" * 90 + "\n", 1000)
    put(root, "docs/b.md", "\n".join([LINE] * 5), 1000)
    put(root, "node_modules/c.js", "function no() {}\n" * 20, 1000)
    put(root, "empty.py", "", 1000)
    engine = Engine(spark, str(root), str(data), make_embedder=lambda: HashEmbedder(32))
    first = engine.index()
    assert (first.changed, first.skipped, first.processed, first.unreadable, first.chunks, first.removed, first.percent) == (3, 0, 3, 0, 2, 0, 100)
    again = engine.index()
    assert (again.changed, again.skipped, again.processed, again.percent) == (0, 3, 0, 100)
    assert {r.path: r.chunk_count for r in engine.store.files().collect()} == {"src/a.py": 1, "docs/b.md": 1, "empty.py": 0}
    put(root, "src/a.py", "def find_account():\n    return lookup('account')  # " + "y" * 90 + "\n", 900)
    assert engine.staleness().first().stale == 0
    (root / "docs/b.md").unlink()
    assert engine.index().processed == 1
    assert engine.exists("account")[0].first().matches == 1 and engine.exists("find_user")[0].first().matches == 0
    assert engine.staleness().first() == (3, 0, 1)
    assert engine.index(prune_missing=True).removed == 1
    totals, languages = engine.stats()
    assert totals.first() == (1, 1, 2, 2) and [tuple(r) for r in languages.collect()] == [("python", 1)]
    found = engine.search("find_account", k=3).rows.first()
    assert engine.get_chunk(found.id).first().path == "src/a.py" and engine.get_chunk("no").count() == 0
    assert {r.path for r in sources.scan_tree(spark, str(root)).collect()} == {"src/a.py"}


def test_engine_applies_a_stream(spark, tmp_path):
    root, data, log = tmp_path / "repo", tmp_path / "data", tmp_path / "log"
    root.mkdir()
    for name in "abc":
        put(root, f"{name}.md", "\n".join([f"{name} {LINE}"] * 5), 1000)
    engine = Engine(spark, str(root), str(data), make_embedder=lambda: HashEmbedder(8))
    engine.index()
    put(root, "a.md", "\n".join([f"changed {LINE}"] * 5), 2000)
    put(root, "d.md", "\n".join([f"d {LINE}"] * 5), 2000)
    (root / "b.md").unlink()
    rows = [(1, "a.md", "change", 1), (2, "b.md", "change", 1), (3, "b.md", "unlink", 2), (4, "d.md", "unlink", 1), (5, "d.md", "change", 2), (6, "x.bin", "change", 1), (7, None, "change", 1), (8, "c.md", None, 1), (9, "gone.md", "change", 3)]
    df = spark.createDataFrame(rows, "seq long, path string, kind string, s long").select("seq", "path", "kind", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,0,s)").alias("event_time"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("arrived_at"))
    df.coalesce(1).write.parquet(str(log))
    maintenance.maintain(maintenance.read_events(spark, str(log)), engine.apply, str(tmp_path / "check"), interval=None).awaitTermination()
    got = {r.path: r.content[:7] for r in engine.store.chunks().collect()}
    assert {k: v.split()[0] for k, v in got.items()} == {"a.md": "changed", "c.md": "c", "d.md": "d"}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.chunks().count() == 0 and store.version() is None
    row = [("i", "p", "py", 1, 2, "c", [1.0])]
    chunks = spark.createDataFrame(row, CHUNKS)
    changed = spark.createDataFrame([("p", 5)], "path string, mtime_ms long")
    first = store.upsert(changed, chunks)
    assert store.get_chunk("i").count() == 1 and store.files().first() == ("p", 5.0, 1)
    assert store.upsert(changed, chunks) != first and store.chunks().count() == 1
    store.delete(changed)
    assert store.chunks().count() == store.files().count() == 0
    assert len([n for n in os.listdir(tmp_path / "s") if n != "current"]) == 2
    assert len(store._manifests()) == 2
    with pytest.raises(ValueError):
        require(chunks.withColumn("start_line", F.lit("1")), CHUNKS, "chunks")
    with pytest.raises(ValueError):
        require(chunks, FILES, "files")


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    rows = [(f"p{k}:1-2", f"p{k}", "py", 1, 2, f"c{k}", [float(k)]) for k in range(60)]
    changed = spark.createDataFrame([(r[1], 5) for r in rows], "path string, mtime_ms long")
    store.upsert(changed, spark.createDataFrame(rows, CHUNKS))
    before = store._state()["tables"]
    new = [("p7:1-3", "p7", "py", 1, 3, "new", [0.0]), ("p7:9-9", "p7", "py", 9, 9, "more", None)]
    one = spark.createDataFrame([("p7", 9)], "path string, mtime_ms long")
    store.upsert(one, spark.createDataFrame(new, CHUNKS))
    after = store._state()["tables"]
    assert all(sum(after[t][b] != before[t][b] for b in before[t]) == 1 for t in ("chunks", "files"))
    got = {r.id: r.content for r in store.chunks().collect()}
    assert got == {r[0]: r[5] for r in rows if r[1] != "p7"} | {"p7:1-3": "new", "p7:9-9": "more"}
    assert {r.path: r.chunk_count for r in store.files().collect()} == {r[1]: 2 if r[1] == "p7" else 1 for r in rows}
    assert store.get_chunk("p7:1-3").first().content == "new" and store.get_chunk("p7:1-2").count() == 0
    store.delete(changed.where("path < 'p3'"))
    assert Store(spark, str(tmp_path / "s")).chunks().where("path < 'p3'").count() == 0 and store.files().count() == sum(r[1] >= "p3" for r in rows)
    store.publish(spark.createDataFrame(rows[:3], CHUNKS), store.files().limit(0))
    assert store.chunks().count() == 3 and store.files().count() == 0


def test_an_unreadable_file_keeps_its_rows_and_is_tried_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    root.mkdir()
    for name in "ab":
        put(root, f"{name}.md", "\n".join([f"{name} {LINE}"] * 5), 1000)
    engine = Engine(spark, str(root), str(tmp_path / "data"), make_embedder=lambda: HashEmbedder(8))
    assert engine.index().chunks == 2
    for name in "ab":
        put(root, f"{name}.md", "\n".join([f"new {LINE}"] * 5), 2000)
    read = sources.read_contents
    monkeypatch.setattr(sources, "read_contents", lambda s, r, p: read(s, r, p).where("path <> 'b.md'"))
    run = engine.index()
    assert (run.changed, run.processed, run.unreadable, run.percent) == (2, 1, 1, 50)
    assert {r.path: r.content.split()[0] for r in engine.store.chunks().collect()} == {"a.md": "new", "b.md": "b"}
    assert {r.path: r.mtime for r in engine.store.files().collect()} == {"a.md": 2e6, "b.md": 1e6}
    monkeypatch.undo()
    run = engine.index()
    assert (run.changed, run.processed, run.skipped) == (1, 1, 1) and engine.index().changed == 0


def test_listing_in_tasks(spark, tmp_path):
    for k in range(40):
        put(tmp_path, f"d{k % 7}/e{k % 3}/f{k}.py", "x", 1000 + k)
    put(tmp_path, "top.py", "x", 1), put(tmp_path, "build/no.py", "x", 1), put(tmp_path, "noext", "x", 1), put(tmp_path, "d1/.gitignore", "", 1)
    want = {(f"d{k % 7}/e{k % 3}/f{k}.py", 1000_000 + k * 1000, True) for k in range(40)} | {("top.py", 1000, True)}
    for folders in (1, 4, 256):
        assert {tuple(r) for r in sources.list_tree(spark, str(tmp_path), folders=folders).collect()} == want
    asked = spark.createDataFrame([("top.py",), ("gone.py",), ("noext",), (None,), ("d1",)], "path string")
    assert [tuple(r) for r in sources.list_paths(asked, str(tmp_path), settle=0.2).collect()] == [("top.py", 1000, True)]
    with pytest.raises(OSError):
        sources.list_tree(spark, str(tmp_path / "absent")).collect()
    assert sources.list_tree(spark, str(tmp_path / "absent"), strict=False).count() == 0


def log_of(spark, folder, rows):
    """Rows (seq, path, kind, second of the day) as a file of the log."""
    df = spark.createDataFrame(rows, "seq long, path string, kind string, s long")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,0,s)")
    df.select("seq", "path", "kind", at.alias("event_time"), at.alias("arrived_at")).coalesce(1).write.mode("append").parquet(str(folder))


def test_service_scans_watches_and_answers(spark, tmp_path):
    root, log = tmp_path / "repo", tmp_path / "log"
    root.mkdir()
    put(root, "a.md", "\n".join([f"alpha_one {LINE}"] * 5), 1000)
    log_of(spark, log, [(1, "a.md", "unlink", 1)])
    engine = Engine(spark, str(root), str(tmp_path / "data"), make_embedder=lambda: HashEmbedder(8), settle=0.05)
    service = engine.serve(str(log), str(tmp_path / "check"), since=datetime(2024, 1, 1, 0, 0, 2), interval="200 milliseconds")
    service.await_idle()
    assert service.first_run.processed == 1 and service.error is None and engine.exists("alpha_one")[0].first().matches == 1
    put(root, "b.md", "\n".join([f"beta_two {LINE}"] * 5), 2000)
    log_of(spark, log, [(2, "b.md", "change", 3), (3, "none.md", "change", 3), (4, "../x.md", "change", 3)])
    service.stop()
    assert engine.exists("beta_two")[0].first().matches == 1 and not service.query.isActive
    put(root, "b.md", "\n".join([f"gamma {LINE}"] * 5), 3000)
    found = engine.search("beta_two", mode="keyword")
    assert engine.freshness(found.rows).first() == (1, 1, 0, "b.md")
    head, rows = engine.answer("beta_two", mode="keyword")
    assert head.first().text == "literal tokens: beta_two=1\nstale: 1 of 1 result files changed after indexing, such as b.md"
    assert rows.first().text.startswith("[1] b.md:1-5  (md, via=keyword, kw_hits=5")
    head, rows = engine.answer("absent_name", mode="keyword")
    assert head.first().text.split("\n") == ["literal tokens: absent_name=0", "confidence: low - no chunk holds a literal of the query", "  look for the exact text, search by keyword, or ask in other words", "no matches"] and rows.count() == 0
    assert format_chunk(engine.get_chunk("b.md:1-5")).first().text.startswith("b.md:1-5  (md)\n```md\nbeta_two")
    assert {(r.query, r.id) for r in engine.search_all(["beta_two", "alpha_one"], mode="keyword").collect()} == {(1, "b.md:1-5"), (2, "a.md:1-5")}
    quiet = Engine(spark, str(root), str(tmp_path / "data"), watch=False, startup_scan=False).serve(str(log), str(tmp_path / "c2"))
    assert quiet.query is None and quiet.first_run is None
    quiet.stop()


def test_latest_state_goes_on_after_a_restart(spark, tmp_path):
    log, state = tmp_path / "log", str(tmp_path / "state")

    def run():
        held = maintenance.LatestState(spark, state, buckets=4)
        maintenance.maintain(maintenance.read_events(spark, str(log)), held.merge, str(tmp_path / "check"), interval=None).awaitTermination()
        return {(r.path, r.kind, r.seq) for r in held.latest().collect()}

    log_of(spark, log, [(1, "a.md", "change", 1), (2, "b.md", "change", 1)])
    assert run() == {("a.md", "change", 1), ("b.md", "change", 2)}
    log_of(spark, log, [(3, "b.md", "unlink", 2), (4, "a.md", "unlink", 0)])
    assert run() == {("a.md", "change", 1), ("b.md", "unlink", 3)} == run()
    held = maintenance.LatestState(spark, state)
    held.merge(held.latest())
    assert held.latest().count() == 2


def test_diffs_with_dirt(spark):
    stored = spark.createDataFrame([("a.py", 5.5, 1), ("a.py", 4.0, 1), ("b.py", 9.0, None), ("gone.py", 1.0, 0), ("n.py", None, 1)], FILES)
    listing = spark.createDataFrame([("a.py", 5, True), ("b.py", 8, True), ("new.py", 1, True), ("d", 1, False), ("x.bin", 1, True), ("n.py", 1, True), ("t.py", None, True)], "path string, mtime_ms long, is_file boolean")
    assert {r.path for r in incremental.changed_files(listing, stored).collect()} == {"b.py", "new.py", "n.py", "t.py"}
    assert incremental.stale_files(listing, stored).count() == 0
    assert {r.path for r in incremental.missing_files(listing, stored).collect()} == {"gone.py"}
    assert incremental.changed_files(listing, stored, force=True).count() == 5
    assert incremental.changed_files(listing.where("false"), stored).count() == 0
    after = listing.where("path <> 'a.py'").withColumn("mtime_ms", F.when(F.col("path") == "b.py", 99).otherwise(F.col("mtime_ms")))
    assert {tuple(r) for r in events_between(listing, after).collect()} == {("a.py", "unlink"), ("b.py", "change")}


def test_bursts_and_coalescing(spark):

    rows = [(1, "p", "change", 0), (2, "p", "change", 1500), (2, "p", "change", 1500), (3, "p", "unlink", 3499), (4, "p", "change", 5499), (5, "q", None, 0), (6, None, "change", 0)]
    df = spark.createDataFrame(rows, "seq long, path string, kind string, ms long").withColumn("event_time", F.timestamp_millis("ms").cast("timestamp_ntz")).withColumn("arrived_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    assert sorted((r.path, r.n) for r in incremental.bursts(df).collect()) == [("p", 1), ("p", 3), ("q", 1)]
    assert [(r.path, r.kind, r.seq) for r in incremental.coalesced(df).collect()] == [("p", "change", 4)]
    assert incremental.bursts(df.where("false")).count() == incremental.coalesced(df.where("false")).count() == 0


def test_embedding():
    import numpy as np

    e = HashEmbedder(16)
    v = e.embed(["a b c", "a b c", ""])
    assert (v[0] == v[1]).all() and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[2].any()
    assert np.allclose(mean_pool(np.array([[[1.0], [3.0], [9.0]]]), np.array([[1, 1, 0]])), [[2.0]])
