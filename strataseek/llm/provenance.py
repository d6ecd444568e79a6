"""Problem 4: files nobody on the project wrote by hand.

Each chunk is reduced to sums (no content is shuffled), chunks to files by path. A
random forest on compression ratio, token entropy, identifier lengths, comment density
and line shapes tells machine-made text from hand-written text. It learns from labels
that its features don't see: notices in comments, which are taken out of the text
before it is measured, and the names that tools give. Notices decide for themselves
as well, since generated code may look like any other. Data carry no notice from which
a forest could learn them, so a rule on the lines' form decides beside the forest.
Third-party copies are groups of files whose code lines are equal without the comments,
one of which shows its origin.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.runtime import cut, table

# Extensions of source files; settings, prose and queries are no case.
SOURCE = "ts tsx js jsx mjs cjs rs py go java rb c h cpp cc cxx hpp hh php css scss sh bash zsh kt swift cs scala lua pl r".split()
HASH_COMMENTS = "py rb sh bash zsh php pl r".split()

#: Notices of a tool, in a comment line.
GENERATED = re.compile(
    r"do not (?:edit|modify)|auto-?generated\b|@generated\b|\bcode generated by\b|(?:created|generated|written|produced) automatically"
    r"|automatically (?:created|generated|produced)|machine output|machine[- ]generated|hand edits are overwritten|edits will be lost|changes will be lost"
    r"|automatisch (?:erzeugt|generiert)|nicht bearbeiten|généré automatiquement|ne pas modifier|generado automáticamente|no editar|generato automaticamente"
    r"|gerado automaticamente|automatisch gegenereerd|wygenerowano automatycznie|не редактировать|自動生成"
    r"|^\W*output of \S+ v?\d[\d.]* on \S+|emitted by \S+, rule \d+|\bgenerated (?:by|from|with) \S|regenerate (?:with|by)\b",
    re.I,
)
#: Notices of another project.
FOREIGN = re.compile(
    r"copied (?:unchanged |verbatim )?from\b|\bupstream: ?\S+|imported as is|@license\b|\(c\) [\w .-]{1,40}\b(?:authors|contributors)\b"
    r"|copyright (?:\(c\) )?(?:\d{4}[-, ]*)*(?:the )?[\w.-]+ (?:contributors|authors)\b|see https?://\S+/licen[cs]e|part of the [\w .-]{1,40} library\b"
    r"|vendored (?:from|copy)|third[- ]party (?:code|copy|library)",
    re.I,
)
#: What takes such words back.
OWN = re.compile(r"nothing|no longer|\bnot (?:auto-?)?generated|written by us|replaces|edit freely|by hand;|used before", re.I)
GENERATED_PATH = re.compile(
    r"(?:^|/)(?:gen|generated|autogen|__generated__)/(?:[^/]*/)*[^/]+$"
    r"|(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|rb)|OuterClass\.java|\.g\.(?:ts|dart|cs)|\.codegen\.\w+|\.generated\.\w+|_gen\.(?:go|rs)|\.designer\.cs)$"
)
FOREIGN_PATH = re.compile(r"(?:^|/)(?:vendor|third[_-]?party|bower_components|node_modules|extern|external|deps|Godeps|site-packages|Pods|Carthage|jspm_packages)/[^/]+/")
BUNDLED_PATH = re.compile(r"[.-](?:min|bundle|chunk|prod)\.(?:js|mjs|cjs|css)$|\.[0-9a-f]{6,16}\.(?:js|css)$")

_COMMENT = re.compile(r"^\s*(?://|/\*|\*|--|<!--|\"\"\"|;)")
_HASHED = re.compile(r"^\s*(?:#(?!!)|//|/\*|\*|\"\"\")")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_STRING = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"")
_NUMBER = re.compile(r"-?\b(?:0x[0-9a-fA-F]+|\d[\d.]*)\b")
_LIST = re.compile(r"(?:0, ?)+0?")
_NAME = re.compile(r"\w+")

FEATURES = ["ratio", "entropy", "identifier", "short", "comments", "line", "shape", "digits"]
SUMS = "chars packed tokens entropy_sum identifiers identifier_chars short comment_chars lines digits".split()


def _shape(line: str) -> str:
    """A line's form: every string s, number 0 and name a."""
    return _NAME.sub("a", _LIST.sub("0", _NUMBER.sub("0", _STRING.sub("s", line)))).strip()


def _measure(path: str, text: str) -> tuple:
    """Sums of one chunk, its line shapes' commonest one, flags and hashes of code lines."""
    ext = path.rpartition(".")[2]
    is_comment = (_HASHED if ext in HASH_COMMENTS else _COMMENT).match
    code, comment_chars, made, foreign = [], 0, False, False
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        if is_comment(s):
            comment_chars += len(s)
            if not OWN.search(s):
                made = made or bool(GENERATED.search(s))
                foreign = foreign or bool(FOREIGN.search(s))
            end = s.find("*/")
            s = s[end + 2 :].strip() if s.startswith("/*") and end >= 0 else ""
            if not s:
                continue
        code.append(s)
    body = "\n".join(code)
    tokens = _TOKEN.findall(body)
    counts = np.array(list(Counter(tokens).values()), float)
    p = counts / max(1, len(tokens))
    names = [t for t in tokens if t[0].isalpha() or t[0] in "_$"]
    shapes = Counter(map(_shape, code)).most_common(1)
    return (
        len(body), len(zlib.compress(body.encode("utf-8", "replace"), 3)), len(tokens), float(-(p * np.log2(np.maximum(p, 1e-12))).sum()) * len(tokens),
        len(names), sum(map(len, names)), sum(len(n) <= 2 for n in names), comment_chars, len(code), sum(map(str.isdigit, body)),
        shapes[0][0][:40] if shapes else "", shapes[0][1] if shapes else 0, made, foreign, [zlib.crc32(s.encode("utf-8", "replace")) for s in dict.fromkeys(code)],
    )


def files(chunks: DataFrame) -> DataFrame:
    """One row for each source path: sums, notices, and ``copy``, a key that files have in
    common whose code lines are the same (of those with COPY_LINES lines or more)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*SUMS, "shape_of", "shape_n", "made", "foreign", "code"]
        for pdf in batches:
            out = pd.DataFrame([_measure(p, t or "") for p, t in zip(pdf["path"], pdf["content"])], columns=names)
            out.insert(0, "path", pdf["path"].to_numpy())
            yield out

    schema = (
        "path string, chars bigint, packed bigint, tokens bigint, entropy_sum double, identifiers bigint, identifier_chars bigint, short bigint, "
        "comment_chars bigint, lines bigint, digits bigint, shape_of string, shape_n bigint, made boolean, foreign boolean, code array<bigint>"
    )
    source = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SOURCE)
    # equal rows once: those of one path and place hold equal text or are two versions, which both count
    rows = cut(chunks.where(source).select("path", "content").mapInPandas(run, schema))
    # a file's distinct code lines are never gathered: two steps of sums, however many they are
    lines = rows.select(F.xxhash64("path").alias("p"), F.explode("code").alias("x")).distinct()
    copies = lines.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum("x").cast("string"), F.bit_xor(F.xxhash64("x")).cast("string")).alias("copy"))
    per = rows.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.sum("shape_n").alias("shape_sum"),
        F.bool_or("made").alias("made"),
        F.bool_or("foreign").alias("foreign"),
    )
    safe = lambda c: F.greatest(F.col(c), F.lit(1))
    return per.withColumn("p", F.xxhash64("path")).join(copies, "p", "left").select(
        "path",
        (F.col("packed") / safe("chars")).alias("ratio"),
        (F.col("entropy_sum") / safe("tokens")).alias("entropy"),
        (F.col("identifier_chars") / safe("identifiers")).alias("identifier"),
        (F.col("short") / safe("identifiers")).alias("short"),
        (F.col("comment_chars") / (F.col("chars") + F.col("comment_chars") + 1)).alias("comments"),
        (F.col("chars") / safe("lines")).alias("line"),
        (F.col("shape_sum") / safe("lines")).alias("shape"),
        (F.col("digits") / safe("chars")).alias("digits"),
        "lines",
        "chars",
        (F.col("made") | F.col("path").rlike(GENERATED_PATH.pattern)).alias("generated"),
        (F.col("foreign") | F.col("path").rlike(FOREIGN_PATH.pattern)).alias("foreign"),
        F.when(F.col("k") >= COPY_LINES, F.col("copy")).alias("copy"),
    )


#: Distinct code lines from which on equal files are copies and not chance.
COPY_LINES = 4
#: Labelled files from which the forest is grown, at most about so many.
SAMPLE = 20_000
#: A file whose lines nearly all have one form is data, by this rule and not by the forest.
DATA_SHAPE, DATA_LINES = 0.85, 15
#: Without a notice or a tool's name, files of lines so long on average aren't taken as hand-written.
UNSURE_LINE = 90


def classified(chunks: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """path, generated, foreign, machine_made (by the forest or as data), probability (by the forest), copy.

    Rows with a null path are left out; a null or empty content has no text; settings,
    prose and SQL files don't appear; repeated rows weigh double in a file's sums only.
    With no labelled file of both kinds the forest isn't grown and only data are named.
    Both kinds are sampled at one rate, so that the probability keeps their proportion.
    Other columns are ignored; an empty table gives no rows.
    """
    f = cut(files(chunks.where("path IS NOT NULL").select("path", "content")))
    data = (F.col("shape") >= DATA_SHAPE) & (F.col("lines") >= DATA_LINES)
    noticed = F.col("generated") | F.col("foreign") | F.col("path").rlike(BUNDLED_PATH.pattern)
    label = F.when(noticed, 1.0).when(data | (F.col("line") >= UNSURE_LINE), F.lit(None)).otherwise(0.0)
    labelled = f.withColumn("label", label.cast("double"))
    total = labelled.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    counts = {r["label"]: r["n"] for r in total}
    if len(counts) < 2:
        return f.select("path", "generated", "foreign", data.alias("machine_made"), F.lit(0.0).alias("probability"), "copy")
    shape = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    share = min(1.0, sample / sum(counts.values()))
    taken = labelled.where("label IS NOT NULL").where(F.pmod(F.xxhash64("path"), F.lit(1_000_003)) / 1_000_003.0 < share)
    forest = RandomForestClassifier(numTrees=30, maxDepth=6, seed=1, maxMemoryInMB=64, subsamplingRate=0.8)
    model = forest.fit(shape.transform(taken.select(*FEATURES, "label").repartition(4)))
    scored = model.transform(shape.transform(f))
    p = vector_to_array("probability")[1]
    return scored.select("path", "generated", "foreign", ((p >= 0.5) | data).alias("machine_made"), p.alias("probability"), "copy")


def unwritten(chunks: DataFrame) -> DataFrame:
    """path, reason: generated, third-party or machine-made (minified, bundled, data).
    A copy of a third-party file is one too, whatever path it has."""
    c = classified(chunks)
    origins = c.where("foreign AND copy IS NOT NULL").select("copy").distinct().withColumn("copied", F.lit(True))
    return (
        c.join(origins, "copy", "left")
        .select(
            "path",
            F.when(F.col("generated"), "generated")
            .when(F.col("foreign") | F.coalesce("copied", F.lit(False)), "third-party")
            .when(F.col("machine_made"), "machine-made")
            .alias("reason"),
        )
        .where("reason IS NOT NULL")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten(table(spark, sf_dir, "chunks")).select("path").distinct()


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwritten(table(spark, sf_dir, "chunks"))


QUERIES = {"p4_found": p4_found, "p4_reasons": p4_reasons}
