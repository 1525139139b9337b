"""Problem 6: the k most similar vectors for every vector, by cosine.

The rows are parted into blocks of up to about a thousand around one or several near centroids, so
that what is alike mostly comes to lie together.  Each block is parted again into cells: a row and all that lie within half
as much again as the angle to its k-th neighbour.  A cell keeps its centre and its widest angle.

Which cells a query needs is decided by a bound and not by a number: its k-th best score so far is
reached for certain, and a cell is left out only if the triangle inequality (angle to the centre
less the cell's widest angle) keeps all its rows below that score.  With the cosines of both
angles appended to queries and centres this test is one matrix product, so a query costs one
product per cell, and one per row of the cells that it needs.  Queries that need many cells first
get a better k-th score from the few cells they need most.  All margins are error bounds of single
precision; nothing is estimated, and what passes is scored again in double precision.

The cost is rows times cells.  With groups of some thirty rows that is a thirtieth of comparing all
rows, but it still grows with the square of the table while groups do not grow; rows without near
neighbours are cells of their own, and then it is the comparison of all rows.

Vectors are shuffled once, to their block.  Blocks and centres are then files in the shared folder
that tasks read as they need them; they are removed when the result is written.  Cells of centroids
that are too large for a block are cut by a hash of the id.  Exact copies are answered once and
unfolded at the end, so neither a crowded cell nor a group of copies ends in one task.

The centroids are fitted on a bounded sample (by a hash of the id); they bear on speed alone.

Defined results: a vector counts if it is not null, has exactly ``dim`` numbers, all finite, and
is not all zero; a null id is no row; of equal scores the smaller id wins; with fewer than k + 1
usable vectors all others are neighbours; an empty table gives an empty result; extra columns are
ignored.  Ids are unique.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.spark import cut, drop_folder, shared_folder

DIM = 384
SMALL_EXTRAS = 200_000
WIDEST = np.cos(np.radians(50))  # least cosine of a cell's rows to the row it began with
MANY = 64  # needed cells of a file of centres beyond which a query first gets a better k-th score
CENTRES = 8192  # centres aimed at per file
PER_CENTROID = 256  # rows; with more, centroids are means of so many groups that they tear groups apart
MOST_SAMPLE = 65_536


@dataclass(frozen=True)
class Settings:
    cell_size: int = 16  # without effect since cells follow the neighbours' angles; still accepted
    most_cells: int = 8192  # bounds the centroids, which go to every task (13 MB at 384 numbers)
    probes: int = 12  # without effect since the bound decides; still accepted
    block: int = 2048  # rows that one task holds, about twice the mean
    sample: int = 16_384  # rows the centroids are fitted on, or 16 for each centroid up to MOST_SAMPLE
    rounds: int = 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _error(dim: int) -> float:
    """Bound for the error of a product of two unit vectors in single precision."""
    return (dim + 8) * 2.0**-23


def _means(x: np.ndarray, label: np.ndarray, k: int, old: np.ndarray) -> np.ndarray:
    order = np.argsort(label, kind="stable")
    count = np.bincount(label, minlength=k)
    full = np.flatnonzero(count)
    out = old.copy()
    out[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
    return out


def _seeds(x: np.ndarray, cells: int, rng: np.random.Generator, step: int = 16) -> np.ndarray:
    """Rows far from each other, drawn by their squared distance to the ones drawn before."""
    at = [int(rng.integers(len(x)))]
    far = np.maximum(1 - x @ x[at[0]], 0).astype(np.float64)
    while len(at) < cells:
        far[at] = 0
        left = np.count_nonzero(far)
        if not left:
            break
        new = rng.choice(len(x), min(step, cells - len(at), left), replace=False, p=far / far.sum())
        at.extend(new.tolist())
        far = np.minimum(far, np.maximum(1 - (x @ x[new].T).max(1), 0))
    return x[at].copy()


def fit(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centroids of the raw vectors ``sample``, which come in a fixed order."""
    x = _unit(sample).astype(np.float32)
    centroids = _seeds(x, min(cells, len(x)), np.random.default_rng(7))
    for _ in range(rounds):
        centroids = _means(x, _nearest_centroid(x, centroids), len(centroids), centroids)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[a : a + 2048] @ centroids.T).argmax(1) for a in range(0, len(x), 2048)])


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id`` and ``vec``, the numbers in single precision as a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), _binary(x[fine] + np.float32(0))], names=["id", "vec"])

    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == dim)).mapInArrow(run, "id string, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Raw vectors of an Arrow column of binaries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), np.float32)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, int(at[-1] - at[0]) // 4, int(at[0])).reshape(len(column), dim)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * x.shape[1]
    at = (np.arange(len(x) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x.tobytes())])


def _place(rows: DataFrame, centroids: np.ndarray, start: np.ndarray, parts: np.ndarray, dim: int) -> DataFrame:
    """Adds the block: that of the nearest centroid, or one of its several by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _nearest_centroid(_unit(_matrix(batch.column(1), dim)).astype(np.float32), centroids) if batch.num_rows else np.zeros(0, int)
            blk = start[cell]
            several = np.flatnonzero(parts[cell] > 1)
            if len(several):
                ids = batch.column(0).take(pa.array(several)).to_pylist()
                blk[several] += np.array([zlib.crc32(i.encode()) for i in ids]) % parts[cell[several]]
            yield pa.RecordBatch.from_arrays([pa.array(blk, pa.int64()), batch.column(0), batch.column(1)], names=["blk", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "blk bigint, id string, vec binary")


def _blocks(size: np.ndarray, centroids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """By centroid, of estimated ``size``: its first block and how many it has.  The nearest share a block up to half its rows."""
    start, parts = np.full(len(size), -1), np.maximum(1, np.ceil(size / block)).astype(np.int64)
    blocks = 0
    for c in range(len(size)):
        if start[c] >= 0:
            continue
        start[c], room = blocks, block / 2 - size[c]
        if room > 0:
            free = np.flatnonzero((start < 0) & (size <= room))
            for o in free[np.argsort(-(centroids[free] @ centroids[c]), kind="stable")][:64].tolist():
                if size[o] <= room:
                    start[o] = blocks
                    room -= size[o]
        blocks += parts[c]
    return start, parts


def _write(folder: str, name: str, data: bytes) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def _read(folder: str, name: str) -> bytes:
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()


def _read_rows(folder: str, name: str, dim: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """The raw vectors of some spans of a block's rows."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}.vec") as f:
        parts = [f.read_at((b - a) * dim * 4, a * dim * 4) for a, b in spans]
    return np.frombuffer(b"".join(parts), np.float32).reshape(-1, dim)


def _read_ids(folder: str, name: str) -> np.ndarray:
    with pa.ipc.open_stream(_read(folder, f"{name}.ids")) as reader:
        return np.array(reader.read_all()["id"].to_pylist(), dtype=object)


def _own_best(x: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """The k best scores of every row within the block; -2 where there are fewer."""
    out = np.full((len(x), k), -2.0, np.float32)
    for a in range(0, len(x), step):
        score = x[a : a + step] @ x.T
        score[np.arange(len(score)), a + np.arange(len(score))] = -2
        _merge(out, np.arange(a, a + len(score)), score)
    return out


def _merge(best: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
    k = best.shape[1]
    if score.shape[1] > k:
        score = np.partition(score, score.shape[1] - k, axis=1)[:, -k:]
    best[at] = -np.sort(-np.concatenate([best[at], score], axis=1), axis=1)[:, :k]


def _cells(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The cell of every row; ``low``: its k-th score within the block.  The tightest rows begin cells."""
    reach = np.cos(1.5 * np.arccos(np.clip(low, 0.5, 1)))
    reach = np.maximum(reach, WIDEST)
    label = np.full(len(x), -1)
    left, cells = np.argsort(-low, kind="stable"), 0
    rows = x[left]
    while len(left):
        near = rows @ rows[0] >= reach[left[0]]
        near[0] = True
        label[left[near]] = cells
        cells += 1
        left, rows = left[~near], rows[~near]
    return label


def _settle(folder: str, k: int, dim: int):
    """Writes a block's rows in the order of its cells and gives the cells, with what the bound needs appended to each centre."""

    def run(key, block):
        raw = _matrix(block["vec"], dim)
        x = _unit(raw).astype(np.float32)
        label = _cells(x, _own_best(x, k)[:, k - 1])
        order = np.argsort(label, kind="stable")
        count = np.bincount(label)
        stop = np.cumsum(count)
        start = stop - count
        centre = np.add.reduceat(x[order].astype(np.float64), start, axis=0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        centre = centre.astype(np.float32)
        least = np.minimum.reduceat((x[order] * centre[label[order]]).sum(1, dtype=np.float64), start) - _error(dim)
        widest = np.arccos(np.clip(least, -1, 1))
        extra = np.stack([np.cos(widest), np.sin(widest), np.ones(len(widest)), 4.0 * (widest > np.pi / 2)], axis=1)
        name = uuid.uuid4().hex  # a repeated task writes files of its own
        _write(folder, f"{name}.vec", raw[order].tobytes())
        out = pa.BufferOutputStream()
        ids = block.select(["id"]).take(pa.array(order))
        with pa.ipc.new_stream(out, ids.schema) as writer:
            writer.write_table(ids)
        _write(folder, f"{name}.ids", out.getvalue().to_pybytes())
        n = len(count)
        wide = np.concatenate([centre, extra.astype(np.float32)], axis=1)
        columns = [pa.array([key[0].as_py()] * n, pa.int64()), pa.array([name] * n), pa.array(np.full(n, len(x)), pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), _binary(wide)]
        return pa.Table.from_arrays(columns, names=["blk", "name", "n", "start", "stop", "centre"])

    return run


def _centre_files(cells: DataFrame, folder: str, n: int, dim: int) -> list[str]:
    """The centres as files of about ``CENTRES`` each; the cells of a block lie in one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            t = pa.Table.from_batches(batches)
            name, out = uuid.uuid4().hex, io.BytesIO()
            np.savez(out, centre=_matrix(t["centre"], dim + 4), name=np.array(t["name"].to_pylist(), "S32"), n=np.asarray(t["n"]), start=np.asarray(t["start"]), stop=np.asarray(t["stop"]))
            _write(folder, f"{name}.npz", out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.npz"])], names=["file"])

    parts = -(-n // CENTRES)
    return [r.file for r in cells.repartition(parts, "blk").mapInArrow(run, "file string").collect()]


def asked(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries with what the bound needs appended: the product with a cell's centre is below zero only if no row of it can reach ``low``.

    angle to the centre <= widest + angle of low, as cosines; a query without k scores, or with a
    k-th score below zero, needs every cell, and so does every query a cell wider than a right angle.
    """
    t = np.arccos(np.clip(low.astype(np.float64) - 2 * _error(x.shape[1]), 0, 1))
    extra = np.stack([-np.cos(t), np.sin(t), 4.0 * (low <= 2 * _error(x.shape[1])), np.ones(len(x))], axis=1)
    return np.concatenate([x, extra.astype(np.float32)], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of raw vectors in double precision, summed in the order of the numbers, as SQL engines do."""
    a, b = a.astype(np.float64).T.copy(), b.astype(np.float64).T.copy()
    dot, aa, bb = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1])
    for p, q in zip(a, b, strict=True):
        dot += p * q
        aa += p * p
        bb += q * q
    return np.clip(dot / np.sqrt(aa * bb), -1, 1)


class _Search:
    """The k nearest of one block's rows."""

    def __init__(self, folder: str, name: str, n: int, k: int, dim: int) -> None:
        self.folder, self.name, self.k, self.dim = folder, name, k, dim
        self.ids = _read_ids(folder, name)
        self.raw = _read_rows(folder, name, dim, [(0, n)])
        self.x = _unit(self.raw).astype(np.float32)
        self.own = _own_best(self.x, k)
        self.best = self.own.copy()
        self.low = self.best[:, k - 1].copy()
        self.slack = 2 * _error(dim)
        self.found: list[tuple] = []  # query, other's id, score in single precision, exact score

    def hits(self, at: np.ndarray, file: dict) -> np.ndarray:
        need = asked(self.x[at], self.low[at]) @ file["centre"].T
        need[:, file["name"] == self.name.encode()] = -9
        return need

    def score(self, at: np.ndarray, need: np.ndarray, file: dict, keep: bool = True) -> None:
        """Scores the queries ``at`` against the cells marked in ``need``, block by block."""
        q, c = np.nonzero(need)
        if not len(q):
            return
        names, blk = np.unique(file["name"][c], return_inverse=True)
        order = np.argsort(blk, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(blk[order])) + 1):
            name = names[blk[group[0]]].decode()
            cells = np.unique(c[group])
            spans = [(int(file["start"][i]), int(file["stop"][i])) for i in cells] if len(cells) <= 8 else [(0, int(file["n"][cells[0]]))]
            raw = _read_rows(self.folder, name, self.dim, spans)
            x = _unit(raw).astype(np.float32)
            asking = at[np.unique(q[group])]
            ids = None
            for a in range(0, len(asking), 1024):
                some = asking[a : a + 1024]
                score = self.x[some] @ x.T
                _merge(self.best, some, score)
                self.low[some] = np.maximum(self.low[some], self.best[some, self.k - 1])
                if keep:
                    r, o = np.nonzero(score >= self.low[some, None] - self.slack)
                    if len(r):
                        ids = np.concatenate([_read_ids(self.folder, name)[i:j] for i, j in spans]) if ids is None else ids
                        self.found.append((some[r], ids[o], score[r, o], exact(self.raw[some[r]], raw[o])))

    def run(self, files: list[str]) -> None:
        n, wide = len(self.x), np.zeros(len(self.x), bool)
        most: list[tuple] = []  # of each file: what every query needs most there
        for f in files:
            file = self.load(f)
            for a in range(0, n, 1024):
                at = np.arange(a, min(a + 1024, n))
                need = self.hits(at, file)
                hit = need >= -2 * self.slack
                wide[at] |= hit.sum(1) > MANY
                if wide[at].any():
                    most.append((f, at, need.argmax(1), need.max(1)))
                hit[wide[at]] = False
                self.score(at, hit, file)
        if not wide.any():
            return
        # A better k-th score for those that need many cells: from the cells that they need most.
        self.best[wide] = self.own[wide]
        for f in files:
            file = self.load(f)
            for g, at, cell, value in most:
                if g == f:
                    hit = np.zeros((len(at), len(file["centre"])), bool)
                    some = np.flatnonzero(wide[at] & (value >= -2 * self.slack))
                    hit[some, cell[some]] = True
                    self.score(at, hit, file, keep=False)
        self.best[wide] = self.own[wide]
        self.found = [tuple(v[~wide[part[0]]] for v in part) for part in self.found]
        for f in files:
            file = self.load(f)
            some = np.flatnonzero(wide)
            for a in range(0, len(some), 1024):
                at = some[a : a + 1024]
                self.score(at, self.hits(at, file) >= -2 * self.slack, file)

    def load(self, name: str) -> dict:
        if getattr(self, "loaded", None) != name:
            with np.load(io.BytesIO(_read(self.folder, name))) as z:
                self.file = {key: z[key] for key in z.files}
            self.loaded = name
        return self.file

    def result(self) -> pa.Table:
        """id, other, score, rank"""
        for a in range(0, len(self.x), 1024):
            score = self.x[a : a + 1024] @ self.x.T
            score[np.arange(len(score)), a + np.arange(len(score))] = -9
            r, o = np.nonzero(score >= np.maximum(self.low[a : a + 1024, None] - self.slack, -2))
            self.found.append((a + r, self.ids[o], score[r, o], exact(self.raw[a + r], self.raw[o])))
        q, other, rough, score = (np.concatenate(v) for v in zip(*self.found, strict=True))
        fine = rough >= self.low[q] - self.slack
        q, other, score = q[fine], other[fine], score[fine]
        order = np.lexsort((other.astype(str), -score, q)) if len(q) else np.zeros(0, int)
        q, other, score = q[order], other[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        top = rank <= self.k
        return pa.Table.from_arrays([pa.array(self.ids[q[top]], pa.string()), pa.array(other[top], pa.string()), pa.array(score[top]), pa.array(rank[top], pa.int32())], names=["id", "other", "score", "rank"])


def _search(spark, folder: str, blocks: list[tuple[str, int]], files: list[str], k: int, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                search = _Search(folder, *blocks[i], k, dim)
                search.run(files)
                yield from search.result().to_batches(10_000)

    # A task for each block, the largest first.
    blocks = sorted(blocks, key=lambda b: -b[1])
    return spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(run, "id string, other string, score double, rank int")


def nearest(vectors: DataFrame, k: int = 5, id_col: str = "sid", vec_col: str = "embedding", dim: int = DIM, settings: Settings | None = None) -> DataFrame:
    """``id``, ``other``, ``score``, ``rank``: the k nearest of every usable vector."""
    s = settings or Settings()
    spark = vectors.sparkSession
    good = cut(usable(vectors, id_col, vec_col, dim))

    # Exact copies: only the k + 1 smallest ids of a group can be anyone's neighbours.
    keyed = good.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    by = Window.partitionBy("h1", "h2").orderBy("id")
    first = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(keyed.join(first, ["h1", "h2"]).select("id", "rep", "h1", "h2"))
    head = copies.select("id", "rep", F.row_number().over(by).alias("place")).where(F.col("place") <= k + 1).select("id", "rep")
    extras = copies.where("id <> rep").select("id")
    n_extras = extras.count()
    if n_extras:
        good = good.join(F.broadcast(extras) if n_extras <= SMALL_EXTRAS else extras, "id", "left_anti")

    rows = good.count()
    if not rows:
        return spark.createDataFrame([], "id string, other string, score double, rank int")
    cells = int(np.clip(round(rows / min(PER_CENTROID, s.block / 2)), 1, s.most_cells))
    wanted = max(s.sample, min(16 * cells, MOST_SAMPLE))
    sample = good.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < int(min(1, wanted / rows) * (1 << 30))).toArrow()
    if not sample.num_rows:
        sample = good.limit(1).toArrow()
    sample = sample.sort_by("id")
    drawn = _matrix(sample["vec"], dim)
    centroids = fit(drawn, cells, s.rounds)
    size = np.bincount(_nearest_centroid(_unit(drawn).astype(np.float32), centroids), minlength=len(centroids)) * (rows / len(drawn))
    start, parts = _blocks(size, centroids, s.block)

    folder = shared_folder(spark, "nearest")
    try:
        placed = _place(good, centroids, start, parts, dim)
        cells = cut(placed.groupBy("blk").applyInArrow(_settle(folder, k, dim), "blk bigint, name string, n int, start int, stop int, centre binary"))
        blocks = [(r.name, r.n) for r in cells.where("start = 0").select("name", "n").collect()]
        edges = cut(_search(spark, folder, blocks, _centre_files(cells, folder, cells.count(), dim), k, dim))
    finally:
        drop_folder(spark, folder)
    if not n_extras:
        return edges

    # A copy stands for the k + 1 smallest of its group; every member gets the group's answer.
    edges = edges.join(head.withColumnsRenamed({"rep": "other", "id": "twin"}), "other", "left").select("id", F.coalesce("twin", "other").alias("other"), "score")
    own = head.select(F.col("rep").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("score"))
    edges = edges.unionByName(own)
    top = _top(edges, k + 1)
    edges = top.join(copies.select(F.col("rep").alias("id"), F.col("id").alias("twin")), "id", "left").select(F.coalesce("twin", "id").alias("id"), "other", "score")
    return _top(edges.where("id <> other"), k)


def _top(edges: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return edges.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def neighbour_pairs(vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """``sid_a`` < ``sid_b``, one row per pair in which at least one is among the k nearest of the other."""
    near = nearest(vectors, k, **options)
    return near.select(F.least("id", "other").alias("sid_a"), F.greatest("id", "other").alias("sid_b")).distinct()
