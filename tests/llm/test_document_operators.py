import random
import re

import numpy as np
import pytest

from strataseek.llm import languages, leaks, packing

DOCS = "doc_id long, text string, lang string, item_id int, words string, n int, key string, position int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, 1, "x", 1, "x", 1) for i, t, la in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, "s", p, "x") for i, p in rows], "item_id long, suite string, passage string, doc_id string")


# leaks

PASSAGE = "Explain why a reader that resumes from wrapCalJor can observe narcal_panel only once per cycle, even though the writer publishes it twice."


def brute(rows, held):
    out = set()
    for d, t, _ in rows:
        w = leaks.words(t)
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, p in held:
            q = leaks.words(p)
            if any(tuple(q[k : k + 12]) in have for k in range(len(q) - 11)):
                out.add((d, i))
    return out


def test_leaks_in_many_disguises(spark):
    w = PASSAGE.split()
    shy = "­"
    rows = [
        (1, "intro " + PASSAGE + " outro", "en"), (2, PASSAGE.upper(), "en"), (3, "> " + "\n> ".join(w), "en"), (4, "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>", "en"),
        (5, "".join(c + shy for c in PASSAGE), None), (6, PASSAGE.replace("a", "а").replace("e", "е"), "en"), (7, '{"body": "' + PASSAGE.replace(" ", "\\n") + '"}', "en"),
        (8, " ".join(w[3:13]), "en"), (9, " ".join(w[3:14]), "en"), (10, " ".join(w[:8] + ["not"] + w[8:16]), "en"), (11, None, None), (12, "", "en"), (13, "word " * 30_000 + PASSAGE, "en"),
        (14, PASSAGE.replace("observe", "ob-\nserve"), "en"), (1, "intro " + PASSAGE + " outro", "en"),
    ]
    held = [(100, PASSAGE), (101, "Another start. " + " ".join(w[2:])), (102, None), (103, ""), (104, "too short to match"), (100, PASSAGE)]
    got = {tuple(r) for r in leaks.leaks(docs(spark, rows), items(spark, held)).collect()}
    assert {d for d, i in got if i == 100} == {1, 2, 3, 4, 5, 6, 7, 9, 13, 14}
    assert got - {(14, 100), (14, 101)} == {x for x in brute(rows, held) if x[0] != 14}


def test_leaks_across_long_markup_and_link_targets(spark):
    w = PASSAGE.split()
    a, b = " ".join(w[:8]), " ".join(w[8:16])
    long = " ".join(["lorem"] * 300)
    rows = [
        (1, f'{a} <a href="https://h/{"x/" * 300}" title="a > b">{b}</a>', "en"), (2, f"{a} <!-- {long} --> {b}", "en"), (3, f'{a} <img alt="{long}" src=\'data:{"A+/" * 500}\'/> {b}', "en"),
        (4, f"{' '.join(w[:7])} [{w[7]}](https://h/{'x/' * 300} \"a title\") {b}", "en"), (5, f"{a} ![](data:image/png;base64,{'A+/' * 500}) {b}", "en"), (6, f"{' '.join(w[:7])} [{w[7]}][some reference] {b}", "en"),
        (7, f"{a} <https://h/{'x/' * 300}> {b}", "en"), (8, f"x <y then {PASSAGE} and {long}, z> q", "en"), (9, f"{a} [not a link] (lorem) {b}", "en"), (10, f"<!-- open {PASSAGE}", "en"),
    ]
    got = {r.doc_id for r in leaks.leaks(docs(spark, rows), items(spark, [(100, PASSAGE)])).collect()}
    assert got == {1, 2, 3, 4, 5, 6, 7, 8, 10}


def test_markup_is_folded_in_linear_time():
    import time

    for s in ("<!-- ", '<a b="', "<a b='\" ", "<a ", "](", "][", "](("):
        t = time.process_time()
        leaks._variants(s * 50_000)
        assert time.process_time() - t < 5, s


def test_leaks_equal_brute_force_on_shuffled_text(spark):
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(30)]
    held = [(k, " ".join(rnd.choices(vocab, k=40))) for k in range(12)]
    rows = []
    for d in range(60):
        t = rnd.choices(vocab, k=30)
        if d % 3 == 0:
            p = held[rnd.randrange(12)][1].split()
            a = rnd.randrange(20)
            t[10:10] = p[a : a + rnd.randrange(9, 16)]
        rows.append((d, " ".join(t), "en"))
    rows += [(100 + k, rows[0][1], "en") for k in range(30)]
    got = {tuple(r) for r in leaks.leaks(docs(spark, rows), items(spark, held)).collect()}
    assert got == brute(rows, held)


def test_leaks_of_empty_tables(spark):
    assert leaks.leaks(docs(spark, []), items(spark, [(1, PASSAGE)])).count() == 0
    assert leaks.leaks(docs(spark, [(1, PASSAGE, "en")]), items(spark, [])).count() == 0


# packing


@pytest.mark.parametrize("capacity", [1, 7, 64, 500])
def test_plan_uses_the_histogram_exactly(capacity):
    rnd = np.random.default_rng(capacity)
    sizes = np.unique(rnd.integers(1, capacity + 1, 40))
    counts = rnd.integers(1, 200, len(sizes))
    left = dict(zip(sizes.tolist(), counts.tolist()))
    for times, pattern in packing.plan(sizes, counts, capacity):
        assert times > 0 and sum(a * m for a, m in pattern) <= capacity
        for a, m in pattern:
            left[a] -= times * m
    assert set(left.values()) == {0}


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choices(["alpha", "beta", "gamma,", "delta."], k=rnd.randrange(1, 120))), "en") for k in range(300)]
    rows += [(1000 + k, "same short text", "en") for k in range(200)] + [(5000, None, None), (5001, "", "en"), (5002, "long text " * 20_000, "en")]
    kinds = spark.createDataFrame([("small", 64, "x"), ("big", 512, "x"), ("small", 64, "x"), ("none", None, "x"), ("zero", 0, "x")], "container_kind string, capacity_tokens int, doc_id string")
    df = docs(spark, rows)
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    out = packing.pack(df, kinds).collect()
    for kind, capacity in (("small", 64), ("big", 512)):
        own = [r for r in out if r.container_kind == kind]
        seen, room = {}, {}
        for r in own:
            seen.setdefault(r.doc_id, []).append(r)
            if r.container_id is not None:
                room.setdefault(r.container_id, []).append(r)
        assert set(seen) == set(counts)
        for d, parts in seen.items():
            parts.sort(key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.n_tokens for r in parts) == counts[d]
            assert len(parts) == 1 if counts[d] <= capacity else all(r.n_tokens == capacity for r in parts[:-1])
            assert parts[0].container_id is not None or counts[d] == 0
        for rs in room.values():
            assert sum(r.n_tokens for r in rs) <= capacity and sorted(r.position for r in rs) == list(range(len(rs)))
        assert set(room) == set(range(len(room)))
        assert len(room) <= 1.05 * sum(counts.values()) / capacity + 2
    assert {r.container_kind for r in out} == {"small", "big"}


def test_packing_of_null_and_repeated_kinds(spark):
    kinds = spark.createDataFrame([(None, 10), ("a", 30), ("a", 20), ("a", 20), ("z", 0), ("n", None)], "container_kind string, capacity_tokens int")
    rows = [(k, "word " * (k % 25 + 1), "en") for k in range(60)]
    out = packing.pack(docs(spark, rows), kinds).collect()
    for kind, capacity in ((None, 10), ("a", 20)):
        mine = [r for r in out if r.container_kind == kind]
        room = {}
        for r in mine:
            room.setdefault(r.container_id, []).append(r.n_tokens)
        assert {r.doc_id for r in mine} == set(range(60)) and max(map(sum, room.values())) <= capacity
    assert {r.container_kind for r in out} == {None, "a"}


def test_packing_empty_tables(spark):
    kinds = spark.createDataFrame([("small", 64)], "container_kind string, capacity_tokens int")
    assert packing.pack(docs(spark, []), kinds).count() == 0
    assert packing.pack(docs(spark, [(1, "a", "en")]), kinds.where("false")).count() == 0


def test_leaks_of_a_hot_passage_in_salted_parts(spark, monkeypatch):
    """A third of the documents hold one passage; the filter grows with the items."""
    rows = [(k, f"intro {k} {PASSAGE}" if k % 3 == 0 else f"nothing of interest number {k}", "en") for k in range(300)]
    held = [(1, PASSAGE), (2, PASSAGE)]
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    got = {tuple(r) for r in leaks.leaks(docs(spark, rows), items(spark, held)).collect()}
    assert got == {(k, i) for k in range(0, 300, 3) for i in (1, 2)}
    assert [leaks.filter_bits(n) for n in (1, 2**16, 2**17, 2**30)] == [22, 22, 23, 30]
    monkeypatch.setattr(leaks, "LEAST_BITS", 16)
    assert {tuple(r) for r in leaks.leaks(docs(spark, rows), items(spark, held)).collect()} == got


# languages

SENTENCES = {
    "en": ["The watcher had never been tested with so many files.", "Please make sure that the parser still works before merging this branch.", "This section describes how the indexer decides which lines belong together.", "Nothing else depends on it, so the cache can be removed in the next release."],
    "de": ["Das alte Verhalten lässt sich wiederherstellen, sollte aber nicht mehr nötig sein.", "Nach der letzten Änderung wird der Zwischenspeicher dadurch langsamer.", "Dieser Abschnitt beschreibt, wie der Planer entscheidet, welche Zeilen zusammengehören.", "Ohne diese Korrektur würde das Modul alte Daten behalten."],
    "fr": ["Cette section explique comment le script décide quelles lignes vont ensemble.", "Sans cette correction, le filtre conserverait des données périmées pendant des minutes.", "Les deux équipes pensent que la configuration doit gérer cela.", "Merci de vérifier que le cache fonctionne encore avant la fusion."],
    "ru": ["Старое поведение можно вернуть, но это уже никому не должно быть нужно.", "В этом разделе описано, как фильтр выбирает строки, которые стоят рядом.", "Пожалуйста, проверьте, что журнал всё ещё работает.", "Без этого исправления планировщик хранит старые данные."],
}


def samples(spark, rows=None):
    rows = [(k, la, s) for la, ss in SENTENCES.items() for k, s in enumerate(ss * 3)] if rows is None else rows
    return spark.createDataFrame(rows, "sample_id long, lang string, text string")


def test_languages_labels_and_mixtures(spark):
    en, de, fr, ru = (SENTENCES[x] for x in ("en", "de", "fr", "ru"))
    fence = "```python\ndef f():\n    return 'das ist nicht die Sprache des Textes und so weiter'\n```"
    rows = [
        (1, " ".join(en), "en"), (2, " ".join(en), "de"), (3, " ".join(de), "Deutsch"), (4, " ".join(de), None), (5, " ".join(fr), "??"), (6, " ".join(ru), "ru-RU"),
        (7, " ".join(en) + "\n\n" + " ".join(fr[:2]), "en"), (8, "# " + de[1] + "\n\n" + " ".join(en), "EN"), (9, en[0] + "\n\n" + fence + "\n\n" + en[1], "eng"), (10, None, None), (11, "", ""),
        (12, "x = 1", None), (13, (" ".join(en) + "\n\n") * 300, "en"), (14, en[0] + " " + en[1] + "\n\n" + ru[0], "en"), (2, " ".join(en), "de"),
    ]
    got = {tuple(r) for r in languages.found(docs(spark, rows), samples(spark)).collect()}
    assert got - {(12, x) for x in SENTENCES} == {(2, "en"), (4, "de"), (5, "fr"), (7, "en"), (7, "fr"), (14, "en"), (14, "ru")}


def test_stretches_cover_their_text(spark):
    text = "\n\n".join(" ".join(SENTENCES[x][:3]) for x in ("en", "ru", "de"))
    out = languages.stretches(docs(spark, [(1, text, "en")]), samples(spark)).orderBy("start_char").collect()
    assert [r.lang for r in out] == ["en", "ru", "de"]
    for r, la in zip(out, ("en", "ru", "de")):
        got = set(re.findall(r"\w+", text[r.start_char : r.end_char]))
        assert got == set(re.findall(r"\w+", " ".join(SENTENCES[la][:3]))) and 0.5 < r.confidence <= 1


def test_long_texts_give_what_one_reading_gives(spark, monkeypatch):
    """Fences, paragraphs and names across the edge of a part, and lines longer than a part."""
    en, de, ru = (" ".join(SENTENCES[x]) for x in ("en", "de", "ru"))
    fence = "```\n" + f"{de}\n\n" * 9 + "```"
    text = f"{en}\n\n{ru}\n{en}\n\n{fence}\n{en} `{ru}` some_name.x\n# {de}\n\n{ru * 4}\n\n\n  \n{de}\n{en}\n\n~~~\n{ru}"
    prof = languages.Profiles(*languages.fit(samples(spark)))
    whole = languages._stretches(languages._sentences([text], prof), prof.langs)
    for size in (50, 333, 700, 1500):
        monkeypatch.setattr(languages, "BLOCK", size)
        got = languages._stretches(languages._read([text], prof), prof.langs)
        same = [c for c in whole.columns if c not in ("confidence", "cosine")]
        assert got[same].equals(whole[same]) and np.allclose(got[["confidence", "cosine"]], whole[["confidence", "cosine"]])
        assert [b - a for a, b in languages._blocks(["x", text, "y", "z"])] == [1, 1, 2]
    monkeypatch.undo()
    assert "de" not in set(whole["lang"][whole["start"] < text.index("some_name")])
    out = languages.stretches(docs(spark, [(1, "x y z " * 10 + "\n\n" + "\n\n".join([" ".join(SENTENCES["ru"])] * 6000), "ru")]), samples(spark)).collect()
    assert {r.lang for r in out if r.letter_groups > 100} == {"ru"} and max(r.end_char for r in out) > 1_000_000


def test_cosine_is_that_of_the_bundle(spark):
    langs, protos = languages.fit(samples(spark))
    prof = languages.Profiles(langs, protos)
    text = " ".join(SENTENCES["de"] * 3)
    read = languages._sentences([text], prof)
    (_, row), = languages._stretches(read, langs).iterrows()
    bundle = sum(prof.bind(read.codes[i : i + 500]).astype(float).sum(0) for i in range(0, len(read.codes), 500))
    exact = bundle @ prof.protos[:, langs.index("de")] / np.linalg.norm(bundle)
    assert row["lang"] == "de" and abs(row["cosine"] - exact) < 0.05 * exact


def test_label_of_a_language_beyond_the_list(spark):
    rows = [(k, "sv", "Det gamla beteendet kan återställas men ska inte längre behövas av någon.") for k in range(3)]
    both = samples(spark).unionByName(samples(spark, rows))
    got = languages.found(docs(spark, [(1, rows[0][2], "sv"), (2, rows[0][2], "en")]), both).collect()
    assert {tuple(r) for r in got} == {(2, "sv")}


def test_languages_of_empty_tables(spark):
    assert languages.found(docs(spark, []), samples(spark)).count() == 0
    assert languages.found(docs(spark, [(1, "some text here", None)]), samples(spark, [])).count() == 0


def test_group_scores_equal_bundles():
    rng = np.random.default_rng(1)
    protos = rng.standard_normal((3, languages.DIM))
    prof = languages.Profiles(["a", "b", "c"], protos)
    codes, _ = languages.groups(prof.symbols(prof.points("the quick brown fox über")))
    bundle = prof.bind(codes).astype(np.float64).sum(0)
    rows = prof.rows(codes)
    assert np.allclose(prof.scores[rows].sum(0), bundle @ prof.protos, rtol=1e-3, atol=0.5)


@pytest.mark.parametrize("label, code", [("en", "en"), ("English", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("DEU", "de"), ("日本語", "ja"), (" fr ", "fr"), ("und", None), ("??", None), ("", None), (None, None), ("sv", None)])
def test_label_code(spark, label, code):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(languages.label_code(df.l)).first()[0] == code
