"""Problem 8: the language of each document and of each stretch of it.

Hyperdimensional profiles. Every letter has a random vector of signs; a three-letter
group is bound from its letters' vectors, each permuted by its place, and a text is
the bundle (sum) of its groups. Language prototypes are bundles of labelled samples,
centred on their mean. The cosine of a bundle with a prototype is linear in the
groups, so each group's product with the prototypes is taken once, when it is first
met in a task, and a sentence's cosines are sums of those: same numbers, no bundle
held per sentence. All positions of an Arrow batch are handled by array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.runtime import table

DIM = 8192
SEED = 20240601
SYMBOLS = 128

# Spellings of the labels that name a language, in lower case.
LABELS = {
    "en": "en eng english anglais englisch inglés ingles inglese",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch espagnol",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano italienisch",
    "nl": "nl nld dut dutch nederlands niederländisch",
    "pl": "pl pol polish polski polnisch",
    "ru": "ru rus russian русский russisch",
    "ja": "ja jpn japanese 日本語 jp japanisch",
}
ALIASES = {alias: code for code, names in LABELS.items() for alias in names.split()}


def label_code(label, langs: list[str] = ()):
    """Two-letter code of a label in any spelling (region and script dropped); null if it is
    unusable. ``langs``: codes of further languages, which stand for themselves."""
    base = F.split(F.lower(F.trim(label)), "[-_.@ ]").getItem(0)
    table_ = F.create_map(*[x for pair in ({x.lower(): x for x in langs} | ALIASES).items() for x in map(F.lit, pair)])
    return table_[F.coalesce(base, F.lit(""))]


#: Letters stand below this code point.
LETTERS_END = 0x32400


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Code point -> symbol: 0 divides words, 1-26 are the letters a-z, the rest share 101 more."""
    lut = np.zeros(LETTERS_END, np.uint8)
    for cp in range(0x80, LETTERS_END):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            lut[cp] = 1 + low - 97 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 101
    lut[97:123] = np.arange(1, 27)
    lut[65:91] = np.arange(1, 27)
    return lut


class Profiles:
    """Letter vectors, and the products of letter groups with the prototypes."""

    def __init__(self, langs: list[str] = (), protos: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        self.letters = (rng.integers(0, 2, (SYMBOLS, DIM), np.int8) * 2 - 1).astype(np.int8)
        self.rolled = [np.roll(self.letters, k, axis=1) for k in (2, 1, 0)]
        self.lut = _symbols()
        self.langs = list(langs)
        if protos is not None:
            p = protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)
            p = p - p.mean(0)
            self.protos = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32).T.copy()
            self.row = np.full(SYMBOLS**3, -1, np.int32)
            self.scores = np.zeros((0, len(self.langs)), np.float32)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return self.rolled[0][a] * self.rolled[1][b] * self.rolled[2][c]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of ``scores`` for every code; codes not met before are bound now."""
        r = self.row[codes]
        if (r < 0).any():
            new = np.unique(codes[r < 0])
            parts = [self.bind(new[i : i + 1024]).astype(np.float32) @ self.protos for i in range(0, len(new), 1024)]
            self.row[new] = len(self.scores) + np.arange(len(new), dtype=np.int32)
            self.scores = np.concatenate([self.scores, *parts])
            r = self.row[codes]
        return r

    def points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)

    def symbols(self, cp: np.ndarray) -> np.ndarray:
        return np.where(cp < LETTERS_END, self.lut[np.minimum(cp, LETTERS_END - 1)], 0)


def groups(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter groups and the places of their middle letters; runs of dividers give none."""
    if len(sym) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = sym.astype(np.int64)
    at = np.flatnonzero(s[1:-1] > 0) + 1
    return s[at - 1] * SYMBOLS**2 + s[at] * SYMBOLS + s[at + 1], at


def _count(prof: Profiles, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter groups of texts and their counts, taken in blocks of bounded size."""
    codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in _blocks(texts):
        cp = prof.points("\n".join(texts[a:b]))
        c, n = np.unique(groups(np.where(_masked(cp), 0, prof.symbols(cp)))[0], return_counts=True)
        codes.append(c)
        counts.append(n)
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def _counts(pairs: Iterator[tuple[str, str]], prof: Profiles) -> pd.DataFrame:
    """(lang, text) pairs -> letter group counts of each language."""
    by: dict[str, list[str]] = {}
    for lang, text in pairs:
        by.setdefault(lang, []).append(text)
    parts = {lang: _count(prof, texts) for lang, texts in by.items()}
    none = np.empty(0, np.int64)
    return pd.DataFrame({
        "lang": np.repeat(np.array(list(parts), object), [len(c) for c, _ in parts.values()]),
        "code": np.concatenate([none, *(c for c, _ in parts.values())]), "n": np.concatenate([none, *(n for _, n in parts.values())]),
    })


def _bundle(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Group counts -> prototypes. A group weighs the logarithm of its count, so that the
    sentences a corpus repeats don't outweigh its other words. Bundles are summed in the
    tasks and by language; one vector for each language reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Profiles()
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                codes, w = part["code"].to_numpy(), np.log1p(part["n"].to_numpy())
                total = np.zeros(DIM, np.float32)
                for i in range(0, len(codes), 1024):
                    total += w[i : i + 1024].astype(np.float32) @ p.bind(codes[i : i + 1024]).astype(np.float32)
                yield pd.DataFrame({"lang": lang, "i": np.arange(DIM), "v": total.astype(np.float64)})

    merged = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = merged.mapInPandas(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    wide = rows.pivot(index="lang", columns="i", values="v").fillna(0.0).sort_index()
    return list(wide.index), wide.to_numpy()


def fit(samples: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes of the languages in ``samples`` (lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof = Profiles()
        for pdf in batches:
            pdf = pdf.dropna()
            yield _counts(zip(pdf["lang"], pdf["text"]), prof)

    return _bundle(samples.select("lang", "text").mapInPandas(run, "lang string, code bigint, n bigint"))


#: Labelled documents from which the prototypes are fitted again, about so many.
REFIT_DOCUMENTS = 4000


def refit(docs: DataFrame, samples: DataFrame, most: int = REFIT_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Prototypes from the samples and, in addition, from documents whose label agrees with
    the language that the samples alone give: a sample of about ``most`` documents by the
    hash of their id, however many there are. Short remarks become recognisable by this."""
    first = fit(samples)
    if not first[0]:
        return first
    buckets = max(1, -(-docs.count() // most))
    taken = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) == 0).select("text", label_code(F.col("lang"), first[0]).alias("lang")).dropna()
    model = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof = Profiles(*model.value)
        for pdf in batches:
            texts = [t.replace("\x00", " ") for t in pdf["text"]]
            labels = pdf["lang"].tolist()
            for a, b in _blocks(texts):
                s = _read(texts[a:b], prof).rows
                if not len(s):
                    continue
                s = s[~s["heading"]]
                main = s.groupby("doc")[prof.langs].sum().idxmax(axis=1)
                agreed = {k for k, lang in main.items() if lang == labels[a + k]}
                yield _counts(((main[k], texts[a + k][i:j]) for k, i, j in zip(s["doc"], s["start"], s["end"]) if k in agreed), prof)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof = Profiles()
        for pdf in batches:
            pdf = pdf.dropna()
            yield _counts(zip(pdf["lang"], pdf["text"]), prof)

    schema = "lang string, code bigint, n bigint"
    return _bundle(taken.mapInPandas(run, schema).unionAll(samples.select("lang", "text").mapInPandas(own, schema)))


_FENCE = re.compile(r"^[ >]{0,3}(```|~~~)|\x00", re.M)


def _fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced blocks; an open one ends with its document."""
    spans, start = [], None
    for m in _FENCE.finditer(text):
        if m[0] == "\x00":
            if start is not None:
                spans.append((start, m.start()))
            start = None
        elif start is None:
            start = m.start()
        else:
            spans.append((start, m.end()))
            start = None
    if start is not None:
        spans.append((start, len(text)))
    return spans


def _masked(cp: np.ndarray) -> np.ndarray:
    """Characters of names and code between prose: words with a digit, an underscore or a
    capital after a small letter, what stands between backticks, links and indented lines."""
    n = len(cp)
    low = (cp >= 97) & (cp <= 122)
    up = (cp >= 65) & (cp <= 90)
    digit = (cp >= 48) & (cp <= 57)
    under = cp == 95
    # a dot, slash, colon or at sign between word characters joins them: a.b(), http://x
    core = low | up | digit | under
    glue = np.zeros(n, bool)
    glue[1:-1] = ((cp[1:-1] == 46) | (cp[1:-1] == 47) | (cp[1:-1] == 64)) & core[:-2] & core[2:]
    word = core | glue
    odd = digit | under | glue
    odd[1:] |= up[1:] & low[:-1]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    token = np.cumsum(starts)
    bad = np.zeros(int(token[-1]) + 1 if n else 1, bool)
    bad[token[odd & word]] = True
    out = word & bad[token]
    newline = (cp == 10) | (cp == 0)
    line = np.cumsum(newline)
    first = np.flatnonzero(np.concatenate([[True], newline[:-1]])) if n else np.empty(0, np.int64)
    ticks = np.cumsum(cp == 96)
    out |= ((ticks - np.where(first > 0, ticks[first - 1], 0)[np.minimum(line - newline, len(first) - 1)]) % 2 == 1) if n else False
    if n:
        pad = np.concatenate([cp, np.zeros(4, cp.dtype)])
        indented = ((pad[first] == 32) & (pad[first + 1] == 32) & (pad[first + 2] == 32) & (pad[first + 3] == 32)) | (pad[first] == 9)
        out |= indented[np.minimum(line - newline, len(first) - 1)]
    return out


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets of the runs of equal, ascending ids, and the run of each element."""
    change = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    run = np.zeros(len(ids), np.int64)
    run[change[1:]] = 1
    return change, np.cumsum(run)


class Sentences(NamedTuple):
    """Sentences as rows, the letter groups of all of them and the row that each belongs to."""

    rows: pd.DataFrame
    codes: np.ndarray
    of: np.ndarray


NO_SENTENCES = Sentences(pd.DataFrame(), np.empty(0, np.int32), np.empty(0, np.int32))


def _sentences(texts: list[str], prof: Profiles, fences: list[tuple[int, int]] | None = None) -> Sentences:
    """One row for each sentence with letters: doc (place in the batch), para, start, end
    (code points), n (letter groups), heading, and a column of scores for each language.
    ``fences``: the fenced spans of the one text, where they are known already."""
    text = "\n" + "\x00".join(texts) + "\x00"  # so that the first and last letters have neighbours
    cp = prof.points(text)
    sym = prof.symbols(cp)
    sym = np.where(_masked(cp), 0, sym)
    for a, b in _fences(text) if fences is None else [(max(0, x + 1), max(0, y + 1)) for x, y in fences]:
        sym[a:b] = 0
    newline, zero = cp == 10, cp == 0
    stop = ((cp == 46) | (cp == 33) | (cp == 63)) & np.concatenate([(cp[1:] <= 32) | (cp[1:] == 34) | (cp[1:] == 41), [True]])
    wide = (cp == 0x3002) | (cp == 0xFF01) | (cp == 0xFF1F)
    cut_after = stop | wide | newline | zero
    sent = np.cumsum(cut_after) - cut_after
    doc = np.cumsum(zero) - zero
    # a paragraph ends at a line without visible characters
    visible = (cp > 32) & (cp != 0xFEFF)
    line = np.cumsum(newline | zero) - (newline | zero)
    blank = np.bincount(line, weights=visible, minlength=int(line[-1]) + 1) == 0
    para = (np.cumsum(blank))[line] + doc
    codes, at = groups(sym)
    if not len(codes):
        return NO_SENTENCES
    rows = prof.rows(codes)
    first, of = _dense(sent[at])
    score = np.add.reduceat(prof.scores[rows], first, axis=0)
    n = np.diff(np.append(first, len(at)))
    begin = at[first]
    end = at[np.append(first[1:], len(at)) - 1] + 1
    line_first = np.flatnonzero(np.concatenate([[True], (newline | zero)[:-1]]))
    lead = line_first[line[begin]]  # headings may stand behind a byte-order mark or quote marks
    for _ in range(3):
        lead = np.minimum(lead + np.isin(cp[lead], (0xFEFF, 32, 62)), len(cp) - 1)
    heading = cp[lead] == 35
    offset = np.concatenate([[1], np.flatnonzero(zero) + 1])
    out = pd.DataFrame({"doc": doc[begin], "para": para[begin], "start": begin - offset[doc[begin]], "end": end - offset[doc[begin]], "n": n, "heading": heading})
    out["cjk"] = np.add.reduceat((cp[at] >= 0x3040).astype(np.int64), first)
    return Sentences(pd.concat([out, pd.DataFrame(score, columns=prof.langs)], axis=1), codes.astype(np.int32), of.astype(np.int32))


#: A sentence is another language's than the rest only if that one leads by so much
#: (in units of the standard deviation of a score), over so many letters.
LEAD = 5.0
LEAST_LETTERS = 12


def _stretches(read: Sentences, langs: list[str]) -> pd.DataFrame:
    """Sentences -> stretches of one language: doc, start, end, lang, cosine, confidence, sentences, paragraphs.

    The cosine is that of the stretch's bundle with its language's centred prototype. The
    bundle's norm follows from the counts of its groups, whose vectors are orthogonal but
    for one part in the root of DIM. The confidence is the softmax of the languages'
    cosines in units of their standard deviation, 1 / root of DIM.
    """
    s = read.rows
    x = s[langs].to_numpy()
    doc = s["doc"].to_numpy()
    body = ~s["heading"].to_numpy()
    d_first, d_run = _dense(doc)
    has_body = np.add.reduceat(body, d_first) > 0
    weight = np.where(body | ~has_body[d_run], 1.0, 0.0)
    total = np.add.reduceat(x * weight[:, None], d_first, axis=0)
    main = total.argmax(1)[d_run]
    p_first, p_run = _dense(s["para"].to_numpy())
    p_total = np.add.reduceat(x, p_first, axis=0)
    n = s["n"].to_numpy()
    p_n = np.add.reduceat(n, p_first)
    letters = n + 2 * s["cjk"].to_numpy()
    p_letters = np.add.reduceat(letters, p_first)

    def choose(y, count, size, fallback):
        best = y.argmax(1)
        i = np.arange(len(y))
        lead = (y[i, best] - y[i, fallback]) / np.sqrt(count)
        return np.where((lead > LEAD) & (size >= LEAST_LETTERS), best, fallback)

    p_lang = choose(p_total, p_n, p_letters, main[p_first])
    lang = choose(x, n, letters, p_lang[p_run])
    lang = np.where(weight > 0, lang, main)
    # merge neighbours of one language
    key = d_run * len(langs) + lang
    g_first, g_run = _dense(key)
    g_x = np.add.reduceat(x, g_first, axis=0)
    g_lang = lang[g_first]
    key, count = np.unique(g_run[read.of] * np.int64(SYMBOLS**3) + read.codes, return_counts=True)
    norm = np.sqrt(DIM * np.bincount(key // SYMBOLS**3, count.astype(float) ** 2, len(g_first)))
    cosine = g_x / np.maximum(norm, 1e-9)[:, None]
    z = cosine * np.sqrt(DIM)
    z = np.exp(np.minimum(z - z.max(1, keepdims=True), 0))
    conf = z[np.arange(len(z)), g_lang] / z.sum(1)
    # whole paragraphs: every sentence of the paragraph has the language
    same = np.minimum.reduceat(lang, p_first) == np.maximum.reduceat(lang, p_first)
    whole = np.zeros(len(s), np.int64)
    whole[p_first] = same & (weight[p_first] > 0)
    return pd.DataFrame({
        "doc": doc[g_first], "start": s["start"].to_numpy()[g_first], "end": s["end"].to_numpy()[np.append(g_first[1:], len(s)) - 1],
        "lang": np.array(langs, object)[g_lang], "cosine": cosine[np.arange(len(z)), g_lang].astype(float), "confidence": conf,
        "sentences": np.add.reduceat((weight > 0).astype(np.int64), g_first), "paragraphs": np.add.reduceat(whole, g_first),
        "groups": np.add.reduceat(n, g_first),
    })


def stretches(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """Stretches in one language: doc_id, start_char, end_char, lang, cosine, confidence,
    sentences, paragraphs (whole ones), letter_groups.

    Null or empty texts and texts without prose give no stretch. Whole texts are read.
    Without samples there is no language to choose from and no row. Repeated rows are
    described once each; other columns are ignored.
    """
    langs, protos = refit(docs, samples)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start_char int, end_char int, lang string, cosine double, confidence double, sentences int, paragraphs int, letter_groups int"
    model = docs.sparkSession.sparkContext.broadcast((langs, protos))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prof = Profiles(*model.value)
        if not prof.langs:
            return
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), [(t or "").replace("\x00", " ") for t in pdf["text"]]
            for a, b in _blocks(texts):
                s = _read(texts[a:b], prof)
                if len(s.rows):
                    g = _stretches(s, prof.langs)
                    yield pd.DataFrame({"doc_id": ids[a + g["doc"].to_numpy()], "start_char": g["start"], "end_char": g["end"], "lang": g["lang"], "cosine": g["cosine"], "confidence": g["confidence"], "sentences": g["sentences"], "paragraphs": g["paragraphs"], "letter_groups": g["groups"]})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


#: Characters that are turned into arrays at once; a longer text is read line by line in parts.
BLOCK = 1_000_000

_BLANK_LINE = re.compile(r"^[\x00-\x09\x0b-\x20\ufeff]*\n", re.M)


def _read(texts: list[str], prof: Profiles) -> Sentences:
    """Sentences of a block of texts. One text above BLOCK characters is read in parts that end
    with a line, which changes nothing: sentences and names end with their line, fences are
    found in the whole text before, and paragraphs are numbered on from part to part. So
    its stretches are those of one reading, and memory grows with its sentences only."""
    if len(texts) != 1 or len(texts[0]) <= BLOCK:
        return _sentences(texts, prof)
    text, out, a, blank, n = texts[0], [], 0, 0, 0
    fences = _fences(text)
    while a < len(text):
        b = text.rfind("\n", a, a + BLOCK) + 1 or text.find("\n", a + BLOCK) + 1 or len(text)
        part = text[a:b]
        s = _sentences([part], prof, [(x - a, y - a) for x, y in fences if x < b and y > a])
        if len(rows := s.rows):
            out.append(Sentences(rows.assign(start=rows["start"] + a, end=rows["end"] + a, para=rows["para"] + blank), s.codes, s.of + n))
            n += len(rows)
        blank += len(_BLANK_LINE.findall(part))
        a = b
    if not out:
        return NO_SENTENCES
    return Sentences(pd.concat([s.rows for s in out], ignore_index=True), *(np.concatenate([s[k] for s in out]) for k in (1, 2)))


def _blocks(texts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``most`` characters, so that arrays stay small; one text is never
    divided, and one above it is a block of its own."""
    most = most or BLOCK
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if size:
        yield a, len(texts)


def languages(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """Languages of each document with prose: doc_id, lang, confidence, letter_groups, main.
    A language counts if it is the main one or fills a whole paragraph or two sentences."""
    per = stretches(docs, samples).groupBy("doc_id", "lang").agg(
        (F.sum(F.col("confidence") * F.col("letter_groups")) / F.sum("letter_groups")).alias("confidence"),
        F.sum("letter_groups").cast("bigint").alias("letter_groups"),
        F.sum("sentences").alias("s"),
        F.sum("paragraphs").alias("p"),
    )
    packed = per.groupBy("doc_id").agg(
        F.max_by("lang", F.struct("letter_groups", "lang")).alias("first"),
        F.collect_list(F.struct("lang", "confidence", "letter_groups", "s", "p")).alias("l"),
    )
    return (
        packed.select("doc_id", "first", F.inline("l"))
        .where((F.col("lang") == F.col("first")) | (F.col("s") >= 2) | (F.col("p") >= 1))
        .select("doc_id", "lang", "confidence", "letter_groups", (F.col("lang") == F.col("first")).alias("main"))
    )


def found(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents with a missing, unusable or wrong label or several languages."""
    known = [r[0] for r in samples.select("lang").dropna().distinct().collect()]  # one row for each language
    langs = languages(docs, samples).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))
    labels = docs.select("doc_id", label_code(F.col("lang"), known).alias("label"))
    return (
        labels.join(langs, "doc_id")
        .where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label")))
        .select("doc_id", F.explode("langs").alias("lang"))
        .distinct()
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each document's label names, null if it is unusable."""
    return table(spark, sf_dir, "documents").select("doc_id", label_code(F.col("lang")).alias("label"))


_FIRST = "regexp_split_to_array(lower(trim(lang)), '[-_.@ ]')[1]"
_NAMED = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items())
ORACLES = {"p8_labels": f"SELECT doc_id, CASE {_FIRST} {_NAMED} END AS label FROM documents"}
QUERIES = {"p8_labels": p8_labels, "p8_found": p8_found, "p8_stretches": p8_stretches}
