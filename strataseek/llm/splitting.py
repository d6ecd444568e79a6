"""Problem 1: chunks above a size limit cut into pieces at natural boundaries.

The chunks of a file are read together, since what a chunk's first line stands in is
known from the lines before it. The file's units form a tree (sections, classes, their
methods); below the units, blank lines and indentation give the smaller nodes. Sibling
nodes are merged from the bottom up while they fit, and only a node that is too large
is opened. Pieces then take over whole lines of the piece before as far as they fit.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.runtime import table
from strataseek.llm.outline import Unit, outline

LIMIT = 2000
OVERLAP_LINES = 8
#: Room that is left for lines of the piece before.
RESERVE = 240


class Piece(NamedTuple):
    start: int  # first line, from 0, with the overlap
    own: int  # first line of its own
    end: int  # behind the last line
    text: str


def _groups(lines: list[str], a: int, b: int) -> list[tuple[int, int]]:
    """Lines a..b cut where the text is loosest: before a line after a blank one or of the
    least indentation; one group if there is no such place."""
    filled = [i for i in range(a, b) if lines[i].strip()]
    if len(filled) < 2:
        return [(a, b)]
    blank = [i for i in filled[1:] if not lines[i - 1].strip()]
    depth = {i: len(lines[i]) - len(lines[i].lstrip()) for i in filled}
    least = min(depth[i] for i in filled[1:])
    closing = ("}", ")", "]", "end", "</")
    outer = [i for i in filled[1:] if depth[i] == least and not lines[i].lstrip().startswith(closing)]
    cuts = blank if blank else outer
    if blank and len(outer) > len(blank) and max(y - x for x, y in zip([a, *blank], [*blank, b])) > (b - a) * 3 // 4:
        cuts = sorted({*blank, *outer})
    edges = [a, *cuts, b]
    return [(x, y) for x, y in zip(edges, edges[1:]) if x < y]


def _merged(parts: list[tuple[int, int]], size, most: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in parts:
        if out and out[-1][1] == x and size(out[-1][0], y) <= most:
            out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def pack(lines: list[str], units: list[Unit], limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[Piece]:
    """Pieces of a text given as lines. ``units``: its units in lines of the text. A line
    above the limit is cut within; its parts have the same line number."""
    total = [0]
    for s in lines:
        total.append(total[-1] + len(s) + 1)

    def size(a: int, b: int) -> int:
        return total[b] - total[a] - 1

    if size(0, len(lines)) <= limit:
        return [Piece(0, 0, len(lines), "\n".join(lines))]
    room = max(1, limit - min(RESERVE, limit // 4)) if overlap else limit

    def leaf(a: int, b: int) -> list[tuple[int, int]]:
        if size(a, b) <= room or b - a == 1:
            return [(a, b)]
        parts = _groups(lines, a, b)
        if len(parts) == 1:
            parts = [(i, i + 1) for i in range(a, b)]
        return _merged([p for x, y in parts for p in leaf(x, y)], size, room)

    def node(a: int, b: int, depth: int) -> list[tuple[int, int]]:
        """Lines a..b, whose units of ``depth`` or more are the children."""
        if size(a, b) <= room:
            return [(a, b)]
        starts = sorted({u.start for u in units if u.depth == depth and a < u.start < b})
        deeper = any(u.depth > depth and a < u.start < b for u in units)
        if not starts:
            return node(a, b, depth + 1) if deeper else leaf(a, b)
        edges = [a, *starts, b]
        children = [p for x, y in zip(edges, edges[1:]) for p in node(x, y, depth + 1)]
        return _merged(children, size, room)

    out: list[Piece] = []
    for a, b in node(0, len(lines), 0):
        if size(a, b) > limit:  # one long line
            text = lines[a]
            for i in range(0, len(text), limit):
                out.append(Piece(a, a, b, text[i : i + limit]))
            continue
        start = a
        while out and start > 0 and a - start < overlap and size(start - 1, b) <= limit and start - 1 >= out[-1].own:
            start -= 1
        out.append(Piece(start, a, b, "\n".join(lines[start:b])))
    return out


def _outline(known: dict[int, str], path: str | None) -> list[Unit]:
    """Units of a file given as lines by number, in those numbers. Lines that no row holds
    count as one blank line, however many they are."""
    numbers: list[int] = []
    lines: list[str] = []
    for i in sorted(known):
        if numbers and i > numbers[-1] + 1:
            numbers.append(i - 1)
            lines.append("")
        numbers.append(i)
        lines.append(known[i])
    last = len(numbers) - 1
    return [u._replace(start=numbers[u.start], own=numbers[u.own], end=numbers[min(u.end, last)]) for u in outline(lines, path)]


def _described(path: str | None, known: dict[int, str], large: list[tuple]) -> Iterator[tuple[tuple, list[str], list[Unit]]]:
    """(row, its lines, the units whose own line it has, in its lines) for the large rows of a
    file. ``known``: the file's lines by number."""
    if not large:
        return
    units = _outline(known, path)
    owns = [u.own for u in units]
    for row in large:
        _, _, start, content = row
        lines = content.split("\n")
        changed = {start + i: s for i, s in enumerate(lines) if known[start + i] != s}
        if changed:  # another version of these lines
            other = _outline({**known, **changed}, path)
            own = [u for u in other if start <= u.own < start + len(lines)]
        else:
            own = units[bisect_left(owns, start) : bisect_left(owns, start + len(lines))]
        yield row, lines, [u._replace(start=max(0, u.start - start), own=u.own - start, end=u.end - start) for u in own]


def _by_file(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with those of one file next to each other and in order, so that repeated ones
    stand together; one shuffle by file."""
    rows = chunks.select("id", "path", F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("content", F.lit("")).alias("content"), *columns)
    keyed = rows.withColumn("file", F.coalesce("path", F.col("id"), F.md5("content")))
    return keyed.repartition("file").sortWithinPartitions("file", "start_line", "id", "content", "language")


def _files(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[str | None, dict[int, str], list[tuple]]]:
    """(path, lines by number, rows above the limit) of one file after the other; a row is
    (id, language, start_line, content). Every file is read whole: each of its lines is
    held once, of the rows only those above the limit."""
    key, path, known, large, last = None, None, {}, [], None
    for pdf in batches:
        for id_, p, start, content, language, file in zip(pdf["id"], pdf["path"], pdf["start_line"], pdf["content"], pdf["language"], pdf["file"]):
            if file != key:
                yield path, known, large
                key, path, known, large, last = file, p, {}, [], None
            row = (id_, language, int(start), content)
            if row == last:
                continue
            last = row
            for i, s in enumerate(content.split("\n"), row[2]):
                known.setdefault(i, s)
            if len(content) > limit:
                large.append(row)
    yield path, known, large


def boundaries(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, line_no): the first line of every chunk above ``limit`` characters, and the lines
    of its file at which the nodes of the tree that are units begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for path, known, large in _files(batches, limit):
            for row, _, units in _described(path, known, large):
                out.extend((row[0], row[2] + n) for n in sorted({0, *(u.start for u in units)}))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["id", "line_no"])
                out = []
        yield pd.DataFrame(out, columns=["id", "line_no"])

    return _by_file(chunks, ["language"]).mapInPandas(run, "id string, line_no int").distinct()


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Pieces of the chunks above ``limit`` characters: id, path, language, piece, start_line,
    end_line, content, own_start_line (behind the lines shared with the piece before),
    source_md5 (of the chunk's content).

    Smaller chunks, and null or empty contents, have none. Lines end at ``\\n`` only. A null
    start_line counts as 1; a null path is a file of its own for each id; repeated rows count once;
    an id with two contents has the pieces of each. Other columns are ignored; an empty
    table gives no rows. Only a line above the limit is cut within.
    """
    names = ["id", "path", "language", "piece", "start_line", "end_line", "content", "own_start_line", "source_md5"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for path, known, large in _files(batches, limit):
            for (id_, language, start, content), lines, units in _described(path, known, large):
                source = hashlib.md5(content.encode("utf-8", "surrogatepass")).hexdigest()
                for n, p in enumerate(pack(lines, units, limit, overlap)):
                    out.append((id_, path, language, n, start + p.start, start + p.end - 1, p.text, start + p.own, source))
            if len(out) > 2_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return _by_file(chunks, ["language"]).mapInPandas(run, "id string, path string, language string, piece int, start_line int, end_line int, content string, own_start_line int, source_md5 string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(table(spark, sf_dir, "chunks"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "chunks"))


def p1_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk without their overlaps, joined again: (id,
    content_md5), which must be those of the chunks themselves."""
    p = pieces(table(spark, sf_dir, "chunks"))
    own = F.array_join(F.slice(F.split("content", "\n", -1), F.col("own_start_line") - F.col("start_line") + 1, F.size(F.split("content", "\n", -1))), "\n")
    parts = p.groupBy("id", "source_md5").agg(F.sort_array(F.collect_list(F.struct("piece", F.col("own_start_line").alias("at"), own.alias("own")))).alias("l"))
    # parts of one long line have one line number
    joined = F.aggregate(
        "l",
        F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["text"], F.when(acc["at"].isNull() | (acc["at"] == x["at"]), "").otherwise("\n"), x["own"]).alias("text"), x["at"].alias("at")),
    )
    return parts.select("id", F.md5(joined["text"]).alias("content_md5")).distinct()


ORACLES = {"p1_rejoined": "SELECT DISTINCT id, md5(content) AS content_md5 FROM chunks WHERE length(content) > 2000"}
QUERIES = {"p1_rejoined": p1_rejoined, "p1_found": p1_found, "p1_pieces": p1_pieces}
