"""Source trees: ignore rules, a listing of files, and their contents."""

from __future__ import annotations

import fnmatch
import os
import re
import stat
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.text import LANGUAGE_OF, language
from strataseek.schema import LISTING

# Folders and files that are never indexed.
ALWAYS_IGNORED = (
    "node_modules/ .git/ dist/ build/ out/ target/ .next/ .nuxt/ .turbo/ .cache/ .vercel/ coverage/ *.lock package-lock.json yarn.lock "
    "pnpm-lock.yaml .DS_Store *.generated.ts *.generated.js *.min.js *.min.css"
).split()


class Ignore:
    """Rules in the manner of an ignore file: later ones win, ``!`` takes back, a slash inside
    anchors at the root, a slash at the end means folders, ``**`` spans folders."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\r\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\")
            folder = line.endswith("/")
            body = line.strip("/")
            anchored = "/" in line.rstrip("/")
            self.rules.append((re.compile(("" if anchored else r"(?:.*/)?") + self._regex(body)), folder, keep))

    @staticmethod
    def _regex(glob: str) -> str:
        out = ""
        for part in re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?|\[[^\]]*\])", glob):
            out += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (fnmatch.translate(part)[4:-3] if part[:1] == "[" else re.escape(part))
        return out

    def _own(self, path: str, is_dir: bool) -> bool:
        hidden = False
        for rule, folder, keep in self.rules:
            if (is_dir or not folder) and rule.fullmatch(path):
                hidden = not keep
        return hidden

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """Whether a path, or a folder above it, is hidden."""
        parts = path.strip("/").split("/")
        return any(self._own("/".join(parts[: i + 1]), i + 1 < len(parts) or is_dir) for i in range(len(parts)))


def build_ignore(root: str, data_dir: str | None = None) -> Ignore:
    """The fixed rules, those of the root's ignore file, and the index's own folder if it is inside."""
    lines = list(ALWAYS_IGNORED)
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            lines += f.read().split("\n")
    except OSError:
        pass
    if data_dir:
        rel = os.path.relpath(os.path.abspath(data_dir), os.path.abspath(root))
        if not rel.startswith("..") and rel != ".":
            lines.append("/" + rel.replace(os.sep, "/") + "/")
    return Ignore(lines)


def find_root(start: str) -> str:
    """The nearest folder, from ``start`` upwards, with a ``.git`` in it; ``start`` if there is none."""
    own = Path(start).absolute()
    return str(next((p for p in [own, *own.parents] if (p / ".git").exists()), own))


def not_ignored(df: DataFrame, ignore: Ignore | None = None) -> DataFrame:
    """Rows whose path no rule hides; those of a null path are left out."""
    rules = ignore or Ignore(ALWAYS_IGNORED)

    @F.pandas_udf("boolean")
    def shown(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: p is not None and not rules.ignores(p))

    return df.where(shown("path"))


def _wanted(name: str) -> bool:
    return "." in name and name.rpartition(".")[2] in LANGUAGE_OF


def _stat(root: str, rel: str, settle: float = 0) -> tuple[str, int, bool] | None:
    """(path, mtime_ms, True) of a regular file, None if there is none. One written less
    than ``settle`` seconds ago is looked at again until it rests."""
    full = os.path.join(root, rel)
    try:
        seen = os.stat(full)
        while settle and (age := time.time() - seen.st_mtime) < settle:
            time.sleep(min(settle, max(0.01, settle - max(age, 0))))
            before, seen = seen, os.stat(full)
            if (before.st_mtime_ns, before.st_size) == (seen.st_mtime_ns, seen.st_size):
                break
        return (rel, seen.st_mtime_ns // 1_000_000, True) if stat.S_ISREG(seen.st_mode) else None
    except OSError:
        return None


def list_tree(spark: SparkSession, root: str, ignore: Ignore | None = None, strict: bool = True, folders: int = 256) -> DataFrame:
    """(path, mtime_ms, is_file) of the indexable files of a tree that the executors reach;
    ignored folders are not entered. The driver only opens folders from the root downwards
    until it has about ``folders`` of them; these are walked in tasks, and no file passes
    the driver. Unreadable folders are an error, or skipped with ``strict=False``."""
    ignore = ignore or build_ignore(root)

    def fail(e: OSError):
        if strict:
            raise e

    def children(rel: str) -> list[str]:
        try:
            with os.scandir(os.path.join(root, rel)) as entries:
                return sorted(rel + e.name + "/" for e in entries if e.is_dir(follow_symlinks=False) and not ignore.ignores(rel + e.name, True))
        except OSError as e:
            fail(e)
            return []

    flat, todo = [], [""]
    while todo and len(flat) + len(todo) < folders:
        flat.append(todo.pop(0))
        todo += children(flat[-1])

    def walk(batches):
        for pdf in batches:
            for start, deep in zip(pdf["folder"], pdf["deep"]):
                out = []
                for folder, subs, names in os.walk(os.path.join(root, start), onerror=fail):
                    rel = os.path.relpath(folder, root).replace(os.sep, "/")
                    rel = "" if rel == "." else rel + "/"
                    subs[:] = [d for d in subs if not ignore.ignores(rel + d, True)] if deep else []
                    out += [r for n in names if _wanted(n) and not ignore.ignores(rel + n) and (r := _stat(root, rel + n))]
                yield pd.DataFrame(out, columns=["path", "mtime_ms", "is_file"])

    starts = spark.createDataFrame([(f, False) for f in flat] + [(f, True) for f in todo], "folder string, deep boolean")
    return starts.repartition(min(folders, max(1, len(flat) + len(todo)))).mapInPandas(walk, LISTING)


def list_paths(paths: DataFrame, root: str, ignore: Ignore | None = None, settle: float = 0) -> DataFrame:
    """(path, mtime_ms, is_file) of those of the given paths that are indexable files now; only
    these are looked at. ``settle``: seconds a file must rest before it is taken."""

    def look(batches):
        for pdf in batches:
            out = [r for p in pdf["path"] if _wanted(p) and not (ignore and ignore.ignores(p)) and (r := _stat(root, p, settle))]
            yield pd.DataFrame(out, columns=["path", "mtime_ms", "is_file"])

    return paths.select("path").where("path IS NOT NULL").mapInPandas(look, LISTING)


def scan_tree(spark: SparkSession, root: str, ignore: Ignore | None = None) -> DataFrame:
    """(path, mtime_ms, is_file, content) of a tree on any file system Spark reads, listed and
    read in parallel; for trees too large for a listing on the driver. Files without a byte
    are left out: they have no chunks."""
    base = root.rstrip("/")
    rules = ignore or Ignore(ALWAYS_IGNORED)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + re.escape(re.sub(r"^[a-z0-9]+:/+", "/", base)) + "/*", "")
    named = raw.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.lit(True).alias("is_file"), F.col("content"))
    return not_ignored(named.where(language(F.col("path")).isNotNull()), rules).withColumn("content", F.decode("content", "UTF-8"))


def read_contents(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the listed paths, read in the tasks; unreadable ones are left out.
    The root must be reachable from the executors."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    with open(os.path.join(root, p), encoding="utf-8", errors="replace", newline="") as f:
                        out.append((p, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["path", "content"])

    return paths.select("path").mapInPandas(run, "path string, content string")
