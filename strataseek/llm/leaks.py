"""Problem 7: passages of held-out items that got into documents.

Prefix-filtered set join. Items and documents become sequences of folded words and
of three-word shingles. A run of twelve words holds ten shingles in a row, so a
document can only match where ten shingles in a row are item shingles; one scan of
the corpus cuts these stretches out (a bitmap of item shingles, sized by their number
within bounds, tells which to keep). Item windows are joined to the stretches on the
rarest shingle of each window only (containment must be full, so one prefix token
is enough), the position fixes the one place where the window can lie, and the
twelve words are compared there. Equal stretches are joined once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions.runtime import cut, table

WORDS = 12
SHINGLE = 3
#: The filter of the corpus scan has about so many bits for each shingle of the items, within
#: these powers of two: 0.5 MB at least, 128 MB at most, above which more of the corpus passes it.
BITS_A_SHINGLE, LEAST_BITS, MOST_BITS = 64, 22, 30
#: Found passages up to which they are broadcast (about 100 bytes each), and by how many salts the
#: documents of one passage are spread beyond.
BROADCAST_ROWS, SALTS = 200_000, 64

# Letters of other scripts that look like a Latin one.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "γ": "y", "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h",
    "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
#: Tags to their real end: names and values of attributes, whatever their length, and addresses in brackets.
_LONG_TAG = re.compile(r"""</?[A-Za-z][\w:.-]*+(?:\s++[\w:@.*-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+|\s*+/)*+\s*+>|<[A-Za-z][A-Za-z0-9+.-]*+:[^\s<>]++>""")
#: Targets of Markdown links and images, as an address in the text or as a reference's name.
_TARGET = re.compile(r"""\]\(\s*+(?:<[^<>\n]*+>|(?:[^\s()]|\([^\s()]*+\))*+)(?:\s++(?:"[^"]*+"|'[^']*+'))?+\s*+\)|(?<=\])\[[^\[\]\n]*+\]""")
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|([nrtbf])|(["\\/]))')
_MARKS = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " " if m[2] else m[3]


def _uncommented(text: str) -> str:
    """Text without comments, each to its real end; an open one stays."""
    parts, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        parts.append(text[at:a])
        at = b + 3
    return " ".join([*parts, text[at:]])


def fold(text: str) -> str:
    """Lower case without markup, escapes, invisible characters, accents and look-alikes."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub(" ", _LONG_TAG.sub(" ", _uncommented(text)))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_FOLD)
        return text
    return text.lower()


def words(text: str | None) -> list[str]:
    """Folded words; null and empty texts have none."""
    return _WORD.findall(fold(text)) if text else []


def _codes(ws: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws), np.uint64, len(ws))


def _shingles(codes: np.ndarray) -> np.ndarray:
    if len(codes) < SHINGLE:
        return np.empty(0, np.uint64)
    h = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """Every twelve-word window of every passage: item_id, w, grams, words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["passage"]):
                for ws in _variants(text):
                    g = _shingles(_codes(ws)).view(np.int64)
                    for s in range(len(ws) - WORDS + 1):
                        out.append((item, g[s : s + WORDS - SHINGLE + 1].tolist(), ws[s : s + WORDS]))
            yield pd.DataFrame(out, columns=["item_id", "grams", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "passage").mapInPandas(run, f"item_id {kind}, grams array<bigint>, words array<string>").distinct()


def _variants(text: str | None) -> list[list[str]]:
    """Word sequences of a text: a hyphen at a line's end divides or is dropped, and
    Markdown targets are words or folded away."""
    texts = [text]
    if text and _BROKEN.search(text):
        texts.append(_BROKEN.sub("", text))
    if text and "](" in text or text and "][" in text:
        texts += [_TARGET.sub("] ", t) for t in texts]
    return [words(t) for t in dict.fromkeys(texts)]


_BROKEN = re.compile(r"(?<=\w)[-‐‑]\r?\n[ \t>*/#|]*(?=\w)")


def stretches(docs: DataFrame, bitmap) -> DataFrame:
    """Stretches of documents in which every shingle may be an item's:
    doc_id, key, grams, words. Only shingles ten or more in a row can hold a case."""
    least = WORDS - SHINGLE + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, packed = bitmap.value
        known = np.frombuffer(packed, np.uint8)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for ws in _variants(text):
                    if len(ws) < WORDS:
                        continue
                    g = _shingles(_codes(ws))
                    slot = _slot(g, bits)
                    hit = np.flatnonzero(known[slot >> 3] & (128 >> (slot & 7)))
                    if len(hit) < least:
                        continue
                    for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                        if len(part) >= least:
                            a, b = part[0], part[-1] + 1
                            ws_part = ws[a : b + SHINGLE - 1]
                            out.append((doc, g[a:b].view(np.int64).tolist(), ws_part))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "grams", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, grams array<bigint>, words array<string>")
    return found.withColumn("key", F.md5(F.concat_ws(" ", "words")))


def filter_bits(shingles: int) -> int:
    """Binary logarithm of the filter's size for so many shingles."""
    return min(MOST_BITS, max(LEAST_BITS, int(shingles * BITS_A_SHINGLE - 1).bit_length()))


def _bitmap(windows: DataFrame) -> tuple[int, bytes]:
    """(binary logarithm of the bits, the bits) of all item shingles. Pages of 4 kB are made in
    tasks; the driver lays them together, at most 2**MOST_BITS bits."""
    bits = filter_bits(windows.count() + WORDS)  # windows of a passage begin at every word
    page = 15

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << page, bool)
        held[pdf["s"].to_numpy() & ((1 << page) - 1)] = True
        return pd.DataFrame({"page": pdf["page"].iloc[:1], "b": [np.packbits(held).tobytes()]})

    slots = windows.select(F.explode("grams").alias("g")).select(F.shiftrightunsigned("g", 64 - bits).alias("s")).distinct()
    pages = slots.withColumn("page", F.shiftright("s", page)).groupBy("page").applyInPandas(fill, "page bigint, b binary")
    out = bytearray(1 << (bits - 3))
    for row in pages.toLocalIterator():
        out[row.page << (page - 3) : (row.page + 1) << (page - 3)] = row.b
    return bits, bytes(out)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold twelve words of an item in a row.

    Null texts, passages and those of fewer than twelve words match nothing; a passage
    of two items is reported for both; repeated rows count once; other columns are
    ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items))
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))
    segs = cut(stretches(docs, bitmap))
    uniq = segs.groupBy("key").agg(F.first("grams").alias("grams"), F.first("words").alias("words"), F.count_distinct("doc_id").alias("n"))
    placed = uniq.select("key", "words", "n", F.posexplode("grams").alias("pos", "gram"))
    rarity = placed.groupBy("gram").agg(F.sum("n").alias("docs"))
    numbered = windows.withColumn("window", F.md5(F.concat_ws(" ", F.col("item_id").cast("string"), F.array_join("words", " "))))
    tokens = numbered.select("item_id", "window", F.col("words").alias("wanted"), F.posexplode("grams").alias("at", "gram"))
    ranked = tokens.join(rarity, "gram", "left").withColumn(
        "r", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("docs", F.lit(0)), "gram", "at"))
    )
    prefix = ranked.where("r = 1 AND docs IS NOT NULL").select("item_id", "wanted", "at", "gram")
    start = F.col("pos") - F.col("at")
    hits = (
        placed.join(prefix, "gram")
        .where((start >= 0) & (start + WORDS <= F.size("words")))
        .where(F.slice("words", start + 1, WORDS) == F.col("wanted"))
        .select("key", "item_id")
        .distinct()
    )
    hits = cut(hits)
    if hits.count() <= BROADCAST_ROWS:
        both = segs.select("doc_id", "key").join(F.broadcast(hits), "key")
    else:  # a passage that many documents share is spread over tasks
        salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = segs.select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"])
    return both.select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p7_found": p7_found}
