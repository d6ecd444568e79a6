"""Files to chunks: frames of lines, and merged ranges of definitions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.text import TEXT_LANGUAGES, chunk_id, js_trim, language

# Fixed values of the chunker.
FRAME, STEP = 60, 52
MIN_CHARS, MAX_SOURCE = 100, 500_000
MERGE_SIDE, MERGE_GAP, MERGE_TOTAL = 800, 200, 2000


def _sized(most: int | None) -> Column:
    n = F.length("content")
    return n > 0 if most is None else n.between(1, most)


def frames(files: DataFrame, most: int | None = MAX_SOURCE) -> DataFrame:
    """Chunks of 60 lines that start every 52 lines, for rows (path, language, content).

    Columns: path, language, start_line, end_line, content. A frame whose text is shorter
    than 100 characters without outer white space ends its file; if it is the first, it is
    kept with the file's last line as its end, unless it is blank. Null, empty and
    oversized contents have no chunks. Lines end at ``\\n`` only.
    """
    ok = files.where(F.length("content").between(1, MAX_SOURCE)).select("path", "language", F.split("content", "\n", -1).alias("lines"))
    # frames of one file are decided within its row: no shuffle by path, and equal paths don't mix
    framed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - 1, F.lit(STEP)),
        lambda i: F.struct(i.alias("i"), F.array_join(F.slice("lines", i + 1, FRAME), "\n").alias("content")),
    )
    measured = ok.withColumn("f", framed).withColumn("n", F.size("lines")).withColumn("f", F.transform("f", lambda x: F.struct(x["i"].alias("i"), x["content"].alias("content"), F.length(js_trim(x["content"])).alias("t"))))
    stop = F.array_min(F.transform(F.filter("f", lambda x: x["t"] < MIN_CHARS), lambda x: x["i"]))
    kept = measured.withColumn("stop", stop).withColumn(
        "f", F.filter("f", lambda x: F.col("stop").isNull() | (x["i"] < F.col("stop")) | ((x["i"] == 0) & (F.col("stop") == 0) & (x["t"] > 0)))
    )
    # the outer form: for the inner one the optimizer adds a filter that builds the frames once more
    out = kept.select("path", "language", "n", "stop", F.inline_outer("f")).where("i IS NOT NULL")
    end = F.when(F.col("stop") == 0, F.col("n")).otherwise(F.least(F.col("i") + FRAME, F.col("n")))
    return out.select("path", "language", (F.col("i") + 1).alias("start_line"), end.alias("end_line"), "content")


def merge_ranges(ranges: Column) -> Column:
    """Neighbouring ranges (structs s, e; half open, in characters) folded together while both
    are below 800, less than 200 apart and at most 2000 together; ordered by start."""
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, x: Column) -> Column:
        joins = (
            (F.size(acc) > 0)
            & (last(acc)["e"] - last(acc)["s"] < MERGE_SIDE)
            & (x["e"] - x["s"] < MERGE_SIDE)
            & (x["s"] - last(acc)["e"] < MERGE_GAP)
            & (x["e"] - last(acc)["s"] <= MERGE_TOTAL)
        )
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["s"].alias("s"), x["e"].alias("e"))))
        return F.when(joins, merged).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return F.aggregate(F.array_sort(ranges), empty, step)


def range_chunks(files: DataFrame, ranges: Column) -> DataFrame:
    """Chunks of given ranges: a range above 2000 characters is framed (line numbers from its
    start; a later frame whose text is below 100 characters ends it), and chunks below 100
    characters without outer white space are dropped."""
    r = files.select("path", "language", "content", F.explode(ranges).alias("r")).select(
        "path",
        "language",
        (F.size(F.split(F.substring(F.col("content"), F.lit(1), F.col("r.s")), "\n", -1))).alias("first"),
        F.substring(F.col("content"), F.col("r.s") + 1, F.col("r.e") - F.col("r.s")).alias("text"),
    )
    lines = r.withColumn("lines", F.split("text", "\n", -1))
    small = lines.where(F.length("text") <= MERGE_TOTAL).select(
        "path", "language", F.col("first").alias("start_line"), (F.col("first") + F.size(F.split(F.regexp_replace("text", r".\z", ""), "\n", -1)) - 1).alias("end_line"), F.col("text").alias("content")
    )
    return small.unionByName(split_oversize(lines.where(F.length("text") > MERGE_TOTAL))).where(F.length(js_trim(F.col("content"))) >= MIN_CHARS)


def split_oversize(rows: DataFrame) -> DataFrame:
    """Frames of rows (path, language, first, lines): from line ``first`` on."""
    framed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - 1, F.lit(STEP)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("lines", i + 1, FRAME), "\n").alias("content"))
    )
    f = rows.withColumn("f", framed)
    stop = F.array_min(F.transform(F.filter("f", lambda x: (x["i"] > 0) & (F.length(x["content"]) < MIN_CHARS)), lambda x: x["i"]))
    kept = f.withColumn("stop", stop).withColumn("f", F.filter("f", lambda x: F.col("stop").isNull() | (x["i"] < F.col("stop"))))
    out = kept.select("path", "language", "first", F.size("lines").alias("n"), F.inline_outer("f")).where("i IS NOT NULL")
    return out.select(
        "path", "language", (F.col("first") + F.col("i")).alias("start_line"), (F.col("first") + F.least(F.col("i") + FRAME, F.col("n")) - 1).alias("end_line"), "content"
    )


Extractor = Callable[[str, str], list[tuple[int, int]] | None]


def python_ranges(source: str) -> list[tuple[int, int]] | None:
    """Character ranges of the outermost definitions of a Python source; None if it can't be read."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    offset = [0]
    for line in source.split("\n"):
        offset.append(offset[-1] + len(line) + 1)
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((offset[first - 1], min(len(source), offset[node.end_lineno] - 1)))
    return out


_TOP = re.compile(
    r"^(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|static|final|abstract|async|unsafe|const|declare|inline|extern)\s+)*"
    r"(?:function|class|interface|enum|struct|trait|impl|fn|func|type|namespace|module|mod|record|union|typedef)\b|^[\w:<>*&\[\] ]+\([^;]*\)[^;]*\{\s*$",
    re.M,
)


def brace_ranges(source: str) -> list[tuple[int, int]]:
    """Outermost definitions of a language with braces: from a line at the margin that begins
    one to the line at the margin that closes it. An approximation where no parser is at hand."""
    out = []
    at = 0
    while m := _TOP.search(source, at):
        end = re.compile(r"^(?:\}|end\b).*$", re.M).search(source, m.end())
        line_end = source.find("\n", m.end())
        line_end = len(source) if line_end < 0 else line_end
        stop = end.end() if end and "{" in source[m.start() : end.start()] or end and end[0].startswith("end") else line_end
        out.append((m.start(), max(stop, m.end())))
        at = max(stop, m.end())
    return out


def extract_ranges(lang: str, source: str) -> list[tuple[int, int]] | None:
    """Ranges of one source; languages without definitions have none."""
    if lang == "python":
        return python_ranges(source)
    return None if lang in TEXT_LANGUAGES else brace_ranges(source)


def chunk_files(files: DataFrame, extractor: Extractor = extract_ranges, most: int | None = MAX_SOURCE) -> DataFrame:
    """Chunks of files (path, content) with ids: code by its definitions, text and code
    without any by frames. Paths of unknown language have none. ``extractor`` gives the
    character ranges of a source and may wrap any parser. Contents above ``most``
    characters have none either; None sets no bound."""
    known = files.select("path", language(F.col("path")).alias("language"), "content").where("language IS NOT NULL").where(_sized(most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extractor(lang, text) or [] for lang, text in zip(pdf["language"], pdf["content"])]
            yield pdf.assign(r=[[{"s": s, "e": e} for s, e in r] for r in found])

    text = known.where(F.col("language").isin(TEXT_LANGUAGES))
    code = known.where(~F.col("language").isin(TEXT_LANGUAGES)).mapInPandas(run, "path string, language string, content string, r array<struct<s:int,e:int>>")
    merged = range_chunks(code.where(F.size("r") > 0), merge_ranges(F.col("r")))
    framed = frames(text.unionByName(code.where(F.size("r") == 0).drop("r")), most)
    out = merged.unionByName(framed)
    return out.select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), "path", "language", "start_line", "end_line", "content")

