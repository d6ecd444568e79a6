"""Tables on disk that are changed by path: buckets of the path's hash, of which a change
rewrites only those it touches, and the index made of two such tables."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.operators import incremental
from strataseek.schema import CHUNKS, FILES, require


def data_dir_for(root: str, base: str) -> str:
    """A folder of its own for every repository."""
    return posixpath.join(base, hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16])


class Tables:
    """Tables with a ``path`` column under one folder. Each bucket of a table is a folder of
    Parquet files; a manifest names the folder of every bucket. A change writes new folders
    for the buckets it touches and then a new manifest, so readers see all tables of one
    state, a failed write changes nothing, and what isn't touched isn't copied. The last
    ``keep`` states can be read; what none of them names is removed. One writer at a time.
    The number of buckets is fixed with the first write: choose it so that a bucket is
    a small share of the largest index that is expected."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schemas, self.keep = spark, path.rstrip("/"), schemas, keep
        self._buckets = buckets

    # files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        path, fs = self._fs()
        folder = path(self.path + "/current")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _manifest(self, name: str) -> dict:
        path, fs = self._fs()
        stream = fs.open(path(f"{self.path}/current/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _state(self) -> dict:
        """The current manifest: buckets, and for each table the version of each bucket that has rows."""
        found = self._manifests()
        return self._manifest(found[-1]) if found else {"version": None, "buckets": self._buckets, "tables": {name: {} for name in self.schemas}}

    def version(self) -> str | None:
        """Name of the current state; None before the first write."""
        return self._state()["version"]

    # reading

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")

    def read(self, name: str, only: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """A table, or the rows of some buckets of it."""
        held = (state or self._state())["tables"][name]
        folders = [f"{self.path}/{v}/{name}/bucket={b}" for b, v in held.items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*folders)

    # writing

    def _written(self, v: str, name: str) -> dict[str, str]:
        """Buckets of a table that have a folder in version ``v``."""
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{v}/{name}"))]
        return {n.removeprefix("bucket="): v for n in names if n.startswith("bucket=")}

    def replace(self, paths: DataFrame | None, rows: dict[str, DataFrame | Callable[[DataFrame], DataFrame]]) -> str:
        """Replace the rows of ``paths`` (all rows if None) in every table by new ones, which are
        of these paths only. A function is given what was just written of the table before
        (the touched buckets), so that nothing needs to be computed twice."""
        state = self._state()
        n, v = state["buckets"], uuid.uuid4().hex[:12]
        tables = {name: dict(held) for name, held in state["tables"].items()}
        touched = None if paths is None else [r[0] for r in paths.select(self.bucket(n).alias("b")).distinct().collect()]  # at most one for each bucket
        last = None
        for name, schema in self.schemas.items():
            new = rows[name]
            new = require(new if isinstance(new, DataFrame) else new(last), schema, name)
            if touched is not None:
                new = incremental.deleted(self.read(name, touched, state), paths).unionByName(new)
            # adaptive execution joins small buckets in a task and divides large ones
            placed = new.withColumn("bucket", self.bucket(n)).hint("rebalance", "bucket")
            placed.write.partitionBy("bucket").parquet(f"{self.path}/{v}/{name}")
            for b in list(tables[name]) if touched is None else touched:
                tables[name].pop(str(b), None)
            written = self._written(v, name)
            tables[name].update(written)
            last = self.read(name, None, {"tables": {name: written}})
        path, fs = self._fs()
        before = self._manifests()
        number = int(before[-1].split("_", 1)[0]) + 1 if before else 1
        out = fs.create(path(f"{self.path}/current/{number:012d}_{v}"), False)
        out.write(bytearray(json.dumps({"version": v, "buckets": n, "tables": tables}).encode()))
        out.close()
        self._sweep()
        return v

    def _sweep(self) -> None:
        """Remove old manifests and the folders that no other manifest names."""
        path, fs = self._fs()
        names = self._manifests()
        kept = [self._manifest(m)["tables"] for m in names[-self.keep :]]
        named = {f"{v}/{t}/bucket={b}" for tables in kept for t, held in tables.items() for b, v in held.items()}
        for m in names[: -self.keep]:
            for t, held in self._manifest(m)["tables"].items():
                for b, v in held.items():
                    if f"{v}/{t}/bucket={b}" not in named:
                        fs.delete(path(f"{self.path}/{v}/{t}/bucket={b}"), True)
            fs.delete(path(f"{self.path}/current/{m}"), False)
        used = {v.split("/", 1)[0] for v in named} | {self._manifest(m)["version"] for m in names[-self.keep :]}
        for s in fs.listStatus(path(self.path)):
            if re.fullmatch("[0-9a-f]{12}", s.getPath().getName()) and s.getPath().getName() not in used:  # left by a failed write
                fs.delete(s.getPath(), True)


class Store(Tables):
    """The index: ``chunks`` and ``files``, changed together."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        super().__init__(spark, path, {"chunks": CHUNKS, "files": FILES}, buckets, keep)

    def chunks(self) -> DataFrame:
        return self.read("chunks")

    def files(self) -> DataFrame:
        return self.read("files")

    def publish(self, chunks: DataFrame, files: DataFrame) -> str:
        """Both tables anew."""
        return self.replace(None, {"chunks": chunks, "files": files})

    def upsert(self, changed: DataFrame, chunks: DataFrame, removed: DataFrame | None = None) -> str:
        """Replace the rows of ``changed`` (path, mtime_ms) by new chunks and drop ``removed`` (path)."""
        gone = changed.select("path") if removed is None else changed.select("path").unionByName(removed.select("path"))
        return self.replace(gone.distinct(), {"chunks": chunks, "files": lambda written: incremental.file_rows(changed, written)})

    def delete(self, paths: DataFrame) -> str:
        none = {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        return self.replace(paths.select("path").distinct(), none)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        """The chunk of an id. Of one that begins with a path, as all that the engine makes,
        only the path's bucket is read."""
        state, only = self._state(), None
        if m := re.fullmatch(r"(.*):\d+-\d+", chunk_id, re.S):
            only = [self.spark.range(1).select(F.lit(m[1]).alias("path")).select(self.bucket(state["buckets"])).first()[0]]
        return self.read("chunks", only, state).where(F.col("id") == chunk_id).limit(1)

    def stored_times(self, paths: list[str]) -> DataFrame:
        """Times of some paths, each once."""
        return incremental.stored_times(self.files().where(F.col("path").isin(list(dict.fromkeys(paths)))))
