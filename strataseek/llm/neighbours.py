"""Problem 3: the k most similar vectors of every vector.

Distinct vectors are routed into cells around centres of unit length. A vector belongs to
its nearest cell and to those that are hardly farther, to COPIES cells on average: several
near a border, where neighbours part, and one inside a cell. The number of cells grows
with the table, and so does the sample that the centres are fitted on. They begin as fine
centres within coarse ones and are then moved together, without the coarse ones' borders;
rows are compared with all of them. Each cell holds a hierarchical
navigable small-world graph as flat arrays of neighbour numbers, into which rows are
inserted by searching it; exact distances order what the graph finds, and the lists of a
vector's cells are merged. Equal vectors are one node with their six smallest ids, so a
value that a third of all rows share stays one row of a cell.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions.runtime import cut, table

DIM = 768
K = 5
#: Cells of a vector on average and at most. How much farther than the nearest cell another one
#: may be is chosen by the sample so that the average holds.
COPIES, MOST_COPIES = 2.4, 8
#: Vectors for each cell, so a graph has about COPIES times as many nodes.
CELL_ROWS = 750
#: Centres that the driver fits, and the vectors it fits them on.
COARSE, SAMPLE = 128, 20_000
#: Fine centres in all (which are broadcast, 1.5 kB each), the vectors for each, one in how many
#: of them it begins with, and the rounds in which all are moved.
MOST_CELLS, FINE_SAMPLE, BEGIN, ROUNDS = 32_768, 160, 4, 4
PROJECTED = 64
SEED = 11
#: A beam's place that holds no row; it counts as opened.
NO_PLACE = np.iinfo(np.int64).max


# vectors as bytes


def plain(rows: np.ndarray) -> list[bytes]:
    """Rows as bytes without loss: a byte that names the form, then signed bytes over a power of
    two where all values fit, else floats."""
    out: list = [b""] * len(rows)
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256].astype(np.float32) + np.float32(0)
        rest = np.arange(len(part))
        for shift in (7, 5, 9):
            w = part[rest] * np.float32(1 << shift)
            fits = (np.abs(w).max(1) <= 127) & (w == np.rint(w)).all(1)
            for j, v in zip(rest[fits], w[fits].astype(np.int8)):
                out[i + j] = bytes([shift]) + v.tobytes()
            rest = rest[~fits]
            if not len(rest):
                break
        for j in rest:
            out[i + j] = b"\xff" + part[j].astype("<f4").tobytes()
    return out


def shrunk(b: bytes) -> bytes:
    """A plain row with its values Huffman coded."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 4, zlib.Z_HUFFMAN_ONLY)
    return b[:1] + z.compress(b[1:]) + z.flush()


def encode(v: np.ndarray) -> bytes:
    return shrunk(plain(v[None])[0])


def decode(parts) -> np.ndarray:
    """Encoded vectors -> float32 rows."""
    if not len(parts):
        return np.zeros((0, DIM), np.float32)
    bodies = [zlib.decompress(b[1:], -15) for b in parts]
    forms = [b[0] for b in parts]
    if forms[0] != 0xFF and forms.count(forms[0]) == len(forms):
        out = np.frombuffer(b"".join(bodies), np.int8).reshape(len(bodies), -1).astype(np.float32)
        out /= np.float32(1 << forms[0])
        return out
    rows = [np.frombuffer(b, "<f4") if form == 0xFF else np.frombuffer(b, np.int8) / np.float32(1 << form) for form, b in zip(forms, bodies)]
    return np.stack(rows).astype(np.float32)


def packed(chunks: DataFrame, dim: int = DIM, vec: bool = True) -> DataFrame:
    """id, h (hash of content), key (hash of the vector) and, if asked for, vec (its bytes); key
    and vec are null if the vector is not usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("vector")
            keys: list = [None] * len(col)
            vecs: list = [None] * len(col)
            sized = np.flatnonzero(col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            for k in range(0, len(sized), 1024):
                at = sized[k : k + 1024]
                flat = col.take(pa.array(at)).flatten().cast(pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(flat).all(1) & (flat != 0).any(1)
                for i, b in zip(at[good].tolist(), plain(flat[good])):
                    keys[i] = hashlib.blake2b(b, digest_size=16).digest()
                    if vec:
                        vecs[i] = shrunk(b)
            out = {"id": batch.column("id"), "h": batch.column("h"), "key": pa.array(keys, pa.binary())}
            yield pa.RecordBatch.from_pydict(out | {"vec": pa.array(vecs, pa.binary())} if vec else out)

    source = chunks.where("id IS NOT NULL").select("id", F.coalesce(F.xxhash64("content"), F.lit(0)).alias("h"), F.col("vector").cast("array<float>").alias("vector"))
    return source.mapInArrow(run, "id string, h bigint, key binary" + ", vec binary" * vec)


# shards


def _rotation(dim: int) -> np.ndarray:
    return (np.random.default_rng(SEED).standard_normal((dim, PROJECTED)) / np.sqrt(PROJECTED)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row's nearest centres (of unit length) and their products, nearest first."""
    n = len(centres)
    most = min(most, n)
    at, near = [np.empty((0, most), np.int64)], [np.empty((0, most), np.float32)]
    # centres in columns, of which only those with the largest products are looked into
    width = max(most, 2 * int(n**0.5))
    deep = -(-n // width)
    step = min(4096, max(64, (1 << 23) // n))
    room = np.full((min(step, len(x)), deep * width), -np.inf, np.float32)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        p = room[: len(part)]
        p[:, :n] = part @ centres.T
        if most == 1:
            got = p.argmax(1)[:, None]
        else:
            top = np.argpartition(-p.reshape(len(p), deep, width).max(1), most - 1, axis=1)[:, :most]
            cand = (top[:, None] + np.arange(deep)[:, None] * width).reshape(len(p), -1)
            got = np.take_along_axis(cand, np.argpartition(-np.take_along_axis(p, cand, 1), most - 1, axis=1)[:, :most], 1)
            got = np.take_along_axis(got, np.argsort(-np.take_along_axis(p, got, 1), axis=1, kind="stable"), 1)
        at.append(got)
        near.append(np.take_along_axis(p, got, 1))
    return np.concatenate(at), np.concatenate(near)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Centres of a sample by k-means, scaled to unit length, which keeps cells even."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        home = _nearest(sample, centres)[0][:, 0]
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        centres[used] = np.add.reduceat(sample[order], first, axis=0)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


class Cells:
    """Centres of cells; a coarse centre without fine ones is a cell itself. They are kept in
    half precision, in which they are broadcast."""

    def __init__(self, coarse: np.ndarray, fine: dict[int, np.ndarray] | None = None, margin: float = 0.0):
        self.coarse, self.margin = coarse, margin
        fine = [(fine or {}).get(c, coarse[c : c + 1]) for c in range(len(coarse))]
        self.first = np.concatenate([[0], np.cumsum([len(f) for f in fine])]).astype(np.int32)
        self.centres = np.concatenate(fine).astype(np.float16)
        self._single: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_single": None}

    def nearest(self, x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and products of each row's nearest cells (MOST_COPIES), nearest first. All
        centres are compared: neighbours often part at the coarse ones' borders."""
        if self._single is None:
            self._single = self.centres.astype(np.float32)
        return _nearest(x, self._single, most or MOST_COPIES)

    def moved(self, to: dict[int, np.ndarray]) -> Cells:
        """The same cells around other centres."""
        out = Cells(self.coarse)
        out.first, out.centres = self.first, self.centres.copy()
        for c, centre in to.items():
            out.centres[c] = centre
        return out

    def fit_margin(self, sample: np.ndarray, copies: float = COPIES) -> Cells:
        """Choose the margin by which the sample's rows have ``copies`` cells on average."""
        near = self.nearest(sample)[1]
        extra = np.sort((near[:, :1] - near[:, 1:]).ravel())
        self.margin = float(extra[min(len(extra) - 1, int((copies - 1) * len(sample)))]) if extra.size else 0.0
        return self

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the cells each row belongs to, nearest first, -1 behind them."""
        at, near = self.nearest(x)
        return np.where(near >= near[:, :1] - self.margin, at, -1).astype(np.int32)


# the graph


class Graph:
    """Hierarchical navigable small-world graph over the rows of ``x``: for each level an
    array of neighbour numbers, -1 where a row has fewer, and a last row of -1 for the missing
    one. Rows are inserted in blocks: a row's candidates are what a search of the graph so far
    finds and the few rows of its block, which is far smaller than the graph."""

    def __init__(self, x: np.ndarray, links: int = 12, ef: int = 28, block: int = 128):
        self.x, self.norm, self.ef, self.m = np.ascontiguousarray(x), (x**2).sum(1), ef, links
        rng = np.random.default_rng(SEED)
        n = len(x)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 5)
        self.links = [np.full((n + 1, links * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(self.level.max()) + 1)] if n else []
        order = rng.permutation(n)
        self.entry = -1
        for i in range(0, n, block):
            self._insert(order[i : i + block])

    def _insert(self, new: np.ndarray) -> None:
        at = np.full((len(new), 1), self.entry) if self.entry >= 0 else None
        for lv in range(len(self.links) - 1, -1, -1):
            own = np.flatnonzero(self.level[new] >= lv)
            ids, dist = np.full((len(own), 0), -1), np.full((len(own), 0), np.inf, np.float32)
            if at is not None and self.level[self.entry] >= lv:
                found, far = self.beam(self.x[new], at, lv, self.ef if lv == 0 else 8)
                at, ids, dist = found[:, :2], found[own], far[own]
            rows = new[own]
            d = self.norm[rows][:, None] + self.norm[rows] - 2 * (self.x[rows] @ self.x[rows].T)
            np.fill_diagonal(d, np.inf)
            k = min(self.ef, len(rows))
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.empty((0, 0), int)
            d = np.take_along_axis(d, near, 1)
            near = np.where(np.isfinite(d), rows[near], -1)
            self._link(rows, np.concatenate([ids, near], axis=1), np.concatenate([dist, d], axis=1), lv)
        top = new[self.level[new].argmax()]
        if self.entry < 0 or self.level[top] > self.level[self.entry]:
            self.entry = int(top)

    def _distance(self, rows: np.ndarray, cand: np.ndarray) -> np.ndarray:
        d = self.norm[rows][:, None] + self.norm[cand] - 2 * np.matmul(self.x[cand], self.x[rows][:, :, None])[:, :, 0]
        return np.where(cand < 0, np.inf, d)

    def _choose(self, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates: first those that are nearer to the row than
        to any one chosen before, then the nearest others."""
        out = np.full((len(cand), most), -1, np.int32)
        step = max(1, 200_000 // max(self.ef, most) ** 2)
        for i in range(0, len(cand), step):
            c, d = cand[i : i + step], dist[i : i + step]
            order = np.argsort(d, axis=1, kind="stable")[:, : max(self.ef, most)]
            c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
            xs, half = self.x.take(c, axis=0), self.norm[c] / 2
            # near[row, i, j]: candidate j is nearer to candidate i than to the row
            near = np.matmul(xs, xs.transpose(0, 2, 1)) - half[:, :, None] > (half - d / 2)[:, None]
            chosen = np.isfinite(d)
            for j in range(c.shape[1] - 1):
                chosen[:, j + 1 :] &= ~(near[:, j, j + 1 :] & chosen[:, j, None])
            rank = np.argsort(np.where(np.isfinite(d), ~chosen, 2), axis=1, kind="stable")[:, :most]
            got = np.where(np.isfinite(np.take_along_axis(d, rank, 1)), np.take_along_axis(c, rank, 1), -1)
            out[i : i + step, : got.shape[1]] = got
        return out

    def _link(self, rows: np.ndarray, cand: np.ndarray, dist: np.ndarray, lv: int) -> None:
        if not len(rows) or not cand.shape[1]:
            return
        width = self.links[lv].shape[1]
        mine = self._choose(cand, dist, width // 2)
        self.links[lv][rows, : mine.shape[1]] = mine
        # links back, of which a row keeps its nearest new ones before it chooses again
        src = np.repeat(rows, mine.shape[1])
        dst = mine.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        back = np.full((len(to), min(int(count.max(initial=0)), 4 * width)), -1)
        kept = place < back.shape[1]
        back[np.repeat(np.arange(len(to)), count)[kept], place[kept]] = src[kept]
        old = self.links[lv][to]
        back[(back[:, :, None] == old[:, None, :]).any(2)] = -1
        full = np.concatenate([old, back], axis=1)
        held = (full >= 0).sum(1)
        fits = held <= width
        if fits.any():
            part = full[fits]
            order = np.argsort(part < 0, axis=1, kind="stable")[:, :width]
            self.links[lv][to[fits]] = np.take_along_axis(part, order, 1)
        if (~fits).any():
            part = full[~fits]
            self.links[lv][to[~fits]] = self._choose(part, self._distance(to[~fits], part), width)

    def beam(self, q: np.ndarray, start: np.ndarray, lv: int, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of one level for all queries side by side: (rows, distances), nearest
        first. Each round opens the ``step`` nearest rows of a beam that are still unopened.
        A place of a beam is one number, so that sorting it moves all: the distance's bits, the
        row, and a last bit that is set once it is opened."""
        b, n = len(q), len(self.x)
        width = max(ef, start.shape[1])
        links, size, base = self.links[lv], (q**2).sum(1), np.arange(b) * (n + 1)
        seen = np.full(b * (n + 1), -1, np.int16)
        seen[n :: n + 1] = 0  # the place of a missing neighbour, -1
        out = np.full((b, width), NO_PLACE, np.int64)
        live, beams, found = np.arange(b), out.copy(), start
        while True:
            place = (base[live][:, None] + found).ravel()
            new = np.flatnonzero(seen.take(place) < 0)
            if len(new):
                at = place.take(new)
                r = new // found.shape[1]
                mark = (new - r * found.shape[1]).astype(np.int16)
                seen[at] = mark
                once = seen.take(at) == mark  # a row that is found twice in a round counts once
                at, r = at[once], r[once]
                row = live.take(r)
                v = at - base.take(row)
                d = size.take(row) + self.norm.take(v) - 2 * np.einsum("ij,ij->i", self.x.take(v, axis=0), q.take(row, axis=0))
                bits = np.maximum(d, np.float32(0)).astype(np.float32, copy=False).view(np.int32) & 0x7FFFFFFF
                key = (bits.astype(np.int64) << 32) | (v << 1)
                nearer = np.flatnonzero(key < beams[:, -1].take(r))
                r, key = r.take(nearer), key.take(nearer)
                count = np.bincount(r, minlength=len(live))
                more = np.full((len(live), width + int(count.max(initial=0))), NO_PLACE, np.int64)
                more[:, :width] = beams
                more[r, np.arange(width, width + len(r)) - np.repeat(np.cumsum(count) - count, count)] = key
                more.sort(axis=1)
                beams = more[:, :width]
            first = np.sort(np.where(beams & 1, NO_PLACE, beams), axis=1)[:, :step]
            beams |= beams <= first[:, -1:]
            on = first[:, 0] != NO_PLACE
            if not on.all():
                out[live[~on]] = beams[~on]
                live, beams, first = live[on], beams[on], first[on]
                if not len(live):
                    break
            opened = np.where(first == NO_PLACE, -1, (first >> 1) & 0x7FFFFFFF)
            found = links.take(opened, axis=0).reshape(len(live), -1)
        has = out != NO_PLACE
        return np.where(has, (out >> 1) & 0x7FFFFFFF, -1), np.where(has, (out >> 32).astype(np.int32).view(np.float32), np.float32(np.inf))

    def search(self, q: np.ndarray, own: np.ndarray | None = None, ef: int = 24) -> np.ndarray:
        """Rows near each query, nearest first, -1 where there are fewer. ``own``: the queries'
        own rows, -1 of no member; a search starts there as well."""
        out = []
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            at = np.full((len(part), 1), self.entry)
            for lv in range(int(self.level[self.entry]), 0, -1):
                at = self.beam(part, at, lv, 1)[0][:, :1]
            if own is not None:
                at = np.concatenate([at, own[i : i + 256, None]], axis=1)
            out.append(self.beam(part, at, 0, ef)[0])
        return np.concatenate(out)


def cell_lists(x: np.ndarray, low: np.ndarray, k: int, homes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a cell in order, for each the nearest other rows and their distances, with all
    that tie with the k-th: the graph over ``low`` finds candidates, exact distances order
    them. A pair that meets in a cell nearer to the row (``homes``, of which this is number
    ``rank``) is left to that one."""
    graph = Graph(low)
    norm = (x**2).sum(1)
    # sums of products of small multiples of 1/128 are exact in single precision
    single = norm.max() * 4 < 1024 and (x * 128 == np.rint(x * 128)).all()
    wide = x if single else x.astype(np.float64)
    found = graph.search(low, own=np.arange(len(x)))
    out = []
    for i in range(0, len(x), 64):
        rows = np.arange(i, min(i + 64, len(x)))
        cand = found[rows]
        near = wide.take(cand, axis=0, mode="wrap")
        if single:
            d = norm[rows][:, None] + norm[cand] - 2 * np.matmul(near, wide[rows][:, :, None])[:, :, 0]
        else:
            # differences, so that a pair has one distance in every cell
            near -= wide[rows][:, None]
            d = np.einsum("ijk,ijk->ij", near, near)
        d = np.where((cand < 0) | (cand == rows[:, None]), np.inf, d)
        last = np.sort(d, axis=1)[:, min(k, d.shape[1]) - 1]
        take = (d <= last[:, None]) & np.isfinite(d)
        theirs = homes[cand]
        for j in range(rank[rows].max()):
            take &= ~((theirs == homes[rows, j][:, None, None]).any(2) & (j < rank[rows])[:, None])
        r, c = np.nonzero(take)
        out.append((rows[r], cand[r, c], d[r, c].astype(float)))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _sampled(chunks: DataFrame, dim: int, n: int, most: int, draw: int) -> DataFrame:
    """About ``most`` of n distinct vectors, by the hash of their id and of the draw's number: key, vec."""
    share = F.pmod(F.xxhash64("id", F.lit(draw)), F.lit(max(1, n // most))) == 0
    return packed(chunks.where(share), dim).where("key IS NOT NULL").select("key", "vec").dropDuplicates(["key"])


def fit_cells(chunks: DataFrame, dim: int, n: int) -> Cells:
    """Cells for n distinct vectors. What reaches the driver is at most 2 x SAMPLE vectors and
    in each round MOST_CELLS centres in half precision."""
    cells = int(min(MOST_CELLS, n // CELL_ROWS))
    if cells <= MOST_COPIES:
        return Cells(np.zeros((1, dim), np.float32))
    rows = _sampled(chunks, dim, n, SAMPLE, 0).limit(2 * SAMPLE).collect()
    sample = decode([r.vec for r in rows])
    if len(sample) < 4 * MOST_COPIES:
        return Cells(np.zeros((1, dim), np.float32))
    # the margin is chosen on vectors that no centre was fitted on: those lie nearer to theirs
    some = len(sample) // 4
    sample, held, apart = sample[some:], sample[:some], [(r.key,) for r in rows[:some]]
    coarse = fit_centres(sample, min(cells, COARSE))
    if cells <= COARSE:
        return Cells(coarse).fit_margin(held)
    share = np.bincount(_nearest(sample, coarse)[0][:, 0], minlength=len(coarse)) / len(sample)
    wanted = np.maximum(1, np.rint(share * cells)).astype(int)
    spark = chunks.sparkSession
    drawn = cut(_sampled(chunks, dim, n, cells * FINE_SAMPLE, 1).join(F.broadcast(spark.createDataFrame(apart, "key binary")), "key", "left_anti"))

    def by_nearest(part: DataFrame, to: Cells) -> DataFrame:
        shared = spark.sparkContext.broadcast(to)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    vec = batch.column("vec").slice(i, 1024)
                    cell = shared.value.nearest(decode(vec.to_pylist()), 1)[0][:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), vec], names=["cell", "vec"])

        return part.select("vec").mapInArrow(run, "cell int, vec binary").groupBy("cell")

    def result(group: pa.Table, centres: np.ndarray) -> pa.Table:
        return pa.table({"cell": group["cell"].slice(0, 1), "centres": pa.array([centres.astype(np.float16).tobytes()], pa.binary())})

    def begin(group: pa.Table) -> pa.Table:
        return result(group, fit_centres(decode(group["vec"].to_pylist()), int(wanted[group["cell"][0].as_py()])))

    def move(group: pa.Table) -> pa.Table:
        total = sum(decode(group["vec"].slice(i, 1024).to_pylist()).sum(0) for i in range(0, group.num_rows, 1024))
        return result(group, total / max(np.linalg.norm(total), 1e-12))

    def collected(groups, step) -> dict[int, np.ndarray]:
        return {r.cell: np.frombuffer(r.centres, np.float16).reshape(-1, dim) for r in groups.applyInArrow(step, "cell int, centres binary").collect()}

    first = drawn.where(F.pmod(F.xxhash64("key"), F.lit(BEGIN)) == 0)
    out = Cells(coarse, collected(by_nearest(first, Cells(coarse)), begin))
    for _ in range(ROUNDS):
        out = out.moved(collected(by_nearest(drawn, out), move))
    return out.fit_margin(held)


def neighbours(chunks: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """(id, neighbour, distance): the k nearest other ids of every id with a usable vector,
    by squared Euclidean distance, equal distances by smaller id.

    Usable: ``dim`` values, all finite, not all zero. Rows with a null id, and ids whose
    rows disagree in content, take no part; repeated rows count once; of an id with
    several usable vectors the one of the smallest hash counts. Fewer than k other ids:
    all of them. Other columns are ignored; an empty table gives no rows. Approximate: a
    neighbour that belongs to none of the id's cells is missed.
    """
    spark = chunks.sparkSession
    ids = cut(
        packed(chunks, dim, vec=False)
        .groupBy("id")
        .agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("key").alias("key"))
        .where("a = b AND key IS NOT NULL")
        .select("id", "key")
    )
    first = Window.partitionBy("key").orderBy("id")
    heads = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    groups = cut(heads.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = groups.count()
    if not n:
        return spark.createDataFrame([], "id string, neighbour string, distance double")
    cells = spark.sparkContext.broadcast(fit_cells(chunks, dim, n))
    rotation = spark.sparkContext.broadcast(_rotation(dim))
    vectors = packed(chunks, dim).where("key IS NOT NULL").select("id", "key", "vec").dropDuplicates(["id", "key"])
    distinct = vectors.join(groups.select(F.col("ids")[0].alias("id"), "key", "ids"), ["id", "key"]).select("key", "ids", "vec")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                homes = cells.value.homes(decode(part.column("vec").to_pylist()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(homes) + 1) * homes.shape[1], pa.int32()), pa.array(homes.ravel()))
                for j in range(homes.shape[1]):
                    at = np.flatnonzero(homes[:, j] >= 0)
                    if len(at):
                        cols = [c.take(pa.array(at)) for c in (part.column("key"), part.column("ids"), part.column("vec"), lists)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(homes[at, j]), pa.array(np.full(len(at), j, np.int32))], names=["key", "ids", "vec", "homes", "cell", "rank"])

    def search(group: pa.Table) -> pa.Table:
        x, ids, rank = decode(group["vec"].to_pylist()), group["ids"].combine_chunks(), group["rank"].to_numpy()
        homes = group["homes"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        row, other, d = cell_lists(x, x @ rotation.value, k, homes, rank)
        near = ids.take(pa.array(other))
        size = near.value_lengths().to_numpy()
        begins = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(len(x) + 1))]
        begins = pa.array(begins, pa.int32())
        near, d = (pa.ListArray.from_arrays(begins, v) for v in (near.flatten(), pa.array(np.repeat(d, size))))
        return pa.table({"key": group["key"], "own": ids, "near": near, "d": d})

    routed = distinct.mapInArrow(route, "key binary, ids array<string>, vec binary, homes array<int>, cell int, rank int")
    lists = routed.groupBy("cell").applyInArrow(search, "key binary, own array<string>, near array<string>, d array<double>")
    # at most MOST_COPIES lists of a vector
    merged = lists.groupBy("key").agg(F.first("own").alias("own"), F.flatten(F.collect_list(F.arrays_zip("d", F.col("near").alias("id")))).alias("l"))
    own = F.transform("own", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    near = merged.select("own", F.slice(F.array_sort(F.array_distinct(F.concat(own, "l"))), 1, k + 1).alias("l"))
    # up to k ids of one vector: all are in ``own``; more: the smallest of them are each other's nearest
    few = near.where(F.size("own") <= k).select(F.explode("own").alias("id"), "l")
    many = groups.where(F.size("ids") > k).select("key", F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id"))).alias("l"))
    total = ids.count()
    hot = [r.key for r in ids.groupBy("key").count().where(F.col("count") > total / 1000).where("count > 1000").collect()]  # fewer than 1,000
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    of_many = ids.where(~is_hot).join(many.where(~is_hot), "key").unionByName(ids.where(is_hot).join(F.broadcast(many.where(is_hot)), "key"))
    every = few.unionByName(of_many.select("id", "l"))
    return (
        every.select("id", F.slice(F.filter("l", lambda s: s["id"] != F.col("id")), 1, k).alias("l"))
        .select("id", F.inline("l").alias("distance", "neighbour"))
        .select("id", "neighbour", "distance")
    )


def found(chunks: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the other's k nearest."""
    n = neighbours(chunks)
    return n.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "chunks"))


QUERIES = {"p3_found": p3_found}
