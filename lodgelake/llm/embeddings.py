"""Embedding near-dedup with an inverted multi-index.

Each half of the unit vectors has a codebook of its own (k-means on a bounded sample); the product of the two
codebooks is a grid of cells, and every vector lies in one.  A vector's neighbours at a cosine of at least
``least`` are within r = sqrt(2 - 2 least) of it.  How far it is from the bisector between its own and another
centroid tells how likely a neighbour lies beyond.  The multi-sequence traversal visits cells in order of the two
halves' squared distances together, nearest first, and ends at a reach beyond which less than
1 - ``target_recall`` of the neighbours lie: the largest of that of a displacement without preferred direction
(about normal along any line, with deviation r / sqrt(dimension)) and those measured on the sample, its vectors
displaced to a cosine of ``least`` along differences of other sample vectors, and along differences of neighbours.
No neighbour lies further than r.  Visited cells are verified by exact cosines in
double precision, so no link below the threshold is made.  (Tests measure recall against brute force.)

Equal vectors are one class, counted with its size.  A vector visits cells of a larger number than its own, and each
pair is met once.  The members of a cell, and its visitors, are cut into blocks of about BLOCK, and a pair of blocks is
a group of its own: so a dense region is spread, a group holds at most 2 x BLOCK vectors, whatever visits a
cell, and no pair leaves a group: only numbers of links and a forest do.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths with each other.  A null vec_id is not compared: its component is null, and it is kept.
Rows that share a vec_id are one vertex: their vectors' components are joined, and all have one; each row's links are
counted.  An empty table gives an empty result.
Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelake.llm.common import cut, pick
from lodgelake.llm.graph import components, forest

SAMPLE, MOST_CENTROIDS, CELL_ROWS, KMEANS_ROUNDS = 4096, 1024, 256, 8
DRAWS = 16384  # displaced vectors that set a reach
BLOCK = 4096
_SLICE = 256
_GRID = 1 << 10  # cells of one dimension: _GRID x _GRID


def unit(blobs: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(KMEANS_ROUNDS):
        a = distances(x, c).argmin(axis=1)
        for i in np.unique(a):
            c[i] = x[a == i].mean(axis=0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


class Grid:
    """The two codebooks of one dimension."""

    def __init__(self, x: np.ndarray, k: int, least: float, target_recall: float):
        rng = np.random.default_rng(3)
        self.half = x.shape[1] // 2
        self.books = [codebook(part, k, rng) for part in self.halves(x)]
        self.apart = [np.sqrt(np.maximum(distances(c, c), 1e-300)) for c in self.books]
        self.reach = self.fitted(x, least, target_recall, rng)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (distances(p, c).argmin(axis=1) for p, c in zip(self.halves(x), self.books, strict=True))
        return a * _GRID + b

    def beyond(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half and vector its squared distance from the bisectors between its own and each centroid."""
        sides = []
        for p, c, apart in zip(self.halves(x), self.books, self.apart, strict=True):
            d = distances(p, c)
            own = d.argmin(axis=1)
            far = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * apart[own])
            far[np.arange(len(d)), own] = 0
            sides.append(far ** 2)
        return sides

    def fitted(self, x: np.ndarray, least: float, target_recall: float, rng: np.random.Generator) -> float:
        """How far a traversal goes, see above."""
        r = math.sqrt(2 - 2 * least)
        reach = NormalDist().inv_cdf(target_recall) * r / math.sqrt(x.shape[1])
        kinds = [(rng.integers(0, len(x), DRAWS), rng.integers(0, len(x), DRAWS))]
        near = []
        for s in range(0, len(x), _SLICE):
            cosine = x[s:s + _SLICE] @ x.T
            p, q = np.nonzero((cosine >= least) & (cosine < 1 - 1e-9))
            some = rng.permutation(len(p))[:DRAWS * _SLICE // len(x) + 1]
            near.append((p[some] + s, q[some]))
        kinds.append(tuple(np.concatenate(side) for side in zip(*near, strict=True)))
        for p, q in kinds:
            far = []
            for s in range(0, len(p), 1024):
                u = x[p[s:s + 1024]] - x[q[s:s + 1024]]
                base = x[rng.integers(0, len(x), len(u))]
                u -= (u * base).sum(axis=1, keepdims=True) * base
                length = np.linalg.norm(u, axis=1, keepdims=True)
                base, u = base[length[:, 0] > 1e-9], (u / np.maximum(length, 1e-9))[length[:, 0] > 1e-9]
                moved = least * base + math.sqrt(1 - least * least) * u
                for one, other in ((base, moved), (moved, base)):
                    cell = self.cells(other)
                    a, b = self.beyond(one)
                    at = np.arange(len(one))
                    far.append(a[at, cell // _GRID] + b[at, cell % _GRID])
            if far and sum(map(len, far)):
                reach = max(reach, math.sqrt(np.quantile(np.concatenate(far), target_recall, method="higher")))
        return min(reach, r)

    def traversal(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector the cells in order of distance, its own first, up to the reach."""
        reach = self.reach
        for one, two in zip(*self.beyond(x), strict=True):
            i, j = np.flatnonzero(one <= reach ** 2), np.flatnonzero(two <= reach ** 2)
            far = one[i][:, None] + two[j]
            near = np.flatnonzero(far.ravel() <= reach ** 2)
            near = near[np.argsort(far.ravel()[near], kind="stable")]
            yield i[near // len(j)] * _GRID + j[near % len(j)]


def _prepared(vectors: DataFrame) -> tuple[DataFrame, str]:
    field = vectors.schema["embedding"].dataType if "embedding" in vectors.columns else None
    single = isinstance(field, T.ArrayType) and isinstance(field.elementType, T.FloatType)
    dtype, kind = ("<f4", "array<float>") if single else ("<f8", "array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            col = col.fill_null([]) if col.null_count else col
            off = col.offsets.to_numpy()
            x = col.values.to_numpy(zero_copy_only=False).astype(dtype)
            bad, some = (np.concatenate([[0], np.cumsum(m)]) for m in (~np.isfinite(x), x != 0))
            ok = (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]])
            raw, w = x.tobytes(), x.itemsize
            blob = [raw[p * w:q * w] if good else None
                    for p, q, good in zip(off[:-1].tolist(), off[1:].tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(blob, pa.binary())], ["vec_id", "_v"])

    d = pick(vectors, {"vec_id": "bigint", "embedding": kind})
    return d.mapInArrow(run, "vec_id bigint, _v binary").withColumn("_k1", F.xxhash64("_v")).withColumn(
        "_k2", F.xxhash64(F.lit(91), "_v")), dtype


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The prepared rows; classes of equal vectors (_k1, _k2, _id, rep, size, _v); the vectors' number type."""
    rows, dtype = _prepared(vectors)
    rows = cut(rows)
    classes = rows.where("vec_id IS NOT NULL AND _v IS NOT NULL").groupBy("_k1", "_k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("_v").alias("_v"))
    return rows, cut(classes.withColumn("_id", F.xxhash64("_k1", "_k2"))), dtype


def _groups(classes: DataFrame, dtype: str, least: float, target_recall: float) -> DataFrame:
    """Rows of the groups that are verified: ``_group`` names one, ``_guest`` tells its two sides apart, and where
    ``_inner`` members are compared with each other as well."""
    spark = classes.sparkSession
    n = classes.count()
    sample = [r[0] for r in classes.orderBy("_id").limit(SAMPLE).select("_v").collect()]  # bounded
    k = max(1, min(MOST_CENTROIDS, math.ceil(math.sqrt(n / CELL_ROWS))))
    grids = {}
    for size in sorted({len(v) for v in sample}):
        x = unit([v for v in sample if len(v) == size], dtype)
        grids[size] = Grid(x, min(k, len(x)), least, target_recall)
    grids = spark.sparkContext.broadcast(grids)  # at most 2 x MOST_CENTROIDS half vectors per length in the sample

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every vector its own cell and the cells of a larger number that it visits."""
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                blobs = b.column("_v").to_pylist()
                size = np.array([len(v) for v in blobs], np.int64)
                cell, path = np.zeros(len(size), np.int64), [[]] * len(size)
                for s in np.unique(size).tolist():
                    at = np.flatnonzero(size == s)
                    grid, x, first = grids.value.get(s), unit([blobs[i] for i in at], dtype), s << 20
                    cell[at] = first + (grid.cells(x) if grid else 0)
                    for i, visits in zip(at.tolist(), grid.traversal(x) if grid else (), strict=False):
                        visits = np.asarray(visits, np.int64) + first
                        path[i] = visits[visits > cell[i]]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell), pa.array(path, pa.list_(pa.int64()))], [*b.schema.names, "_cell", "_path"])

    cells = cut(classes.select("_id", "size", "_v").mapInArrow(
        visited, "_id bigint, size bigint, _v binary, _cell bigint, _path array<bigint>"))
    # two rows per cell: the grid bounds their number
    part = BLOCK * 7 // 8  # blocks are dealt by hash, so some get a little more

    def blocks_of(cell: DataFrame) -> dict[int, int]:
        return {r[0]: math.ceil(r[1] / part) for r in cell.groupBy("_cell").count().collect()}

    member_blocks = blocks_of(cells)
    guest_blocks = {c: g for c, g in blocks_of(cells.select(F.explode("_path").alias("_cell"))).items() if c in member_blocks}
    blocks = spark.sparkContext.broadcast((member_blocks, guest_blocks))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, guests = blocks.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                row, cell, left, right, kind, guest = [], [], [], [], [], []

                def put(i: int, c: int, x: int, y: int, k_: int, is_guest: bool) -> None:
                    row.append(i), cell.append(c), left.append(x), right.append(y), kind.append(k_), guest.append(is_guest)

                for i, (id_, home, path) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_id", "_cell", "_path")),
                                                          strict=True)):
                    m, mine = members[home], id_ % members[home]
                    for other in range(m):  # blocks of the own cell
                        put(i, home, min(mine, other), max(mine, other), 0, mine > other)
                    for g in range(1, guests.get(home, 0)):  # visitors; the first block of them joins the members' own group
                        put(i, home, mine, g, 1, False)
                    for c in path:
                        if c in members:
                            g = (id_ >> 20) % guests[c]
                            for block in range(members[c]):
                                put(i, c, block, g if g else block, 1 if g else 0, True)
                name = [f"{c}/{k_}/{x}/{y}" for c, k_, x, y in zip(cell, kind, left, right, strict=True)]
                inner = [k_ == 0 and x == y for k_, x, y in zip(kind, left, right, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name, pa.string()), pa.array(inner, pa.bool_()), pa.array(guest, pa.bool_()),
                     *(b.column(c).take(pa.array(row, pa.int64())) for c in ("_id", "size", "_v"))],
                    ["_group", "_inner", "_guest", "_id", "size", "_v"])

    return cells.mapInArrow(dealt, "_group string, _inner boolean, _guest boolean, _id bigint, size bigint, _v binary")


def group_sizes(vectors: DataFrame, least: float = 0.95, target_recall: float = 0.9995) -> DataFrame:
    """Vectors in each group that a task verifies."""
    _, classes, dtype = _classes(vectors)
    return _groups(classes, dtype, least, target_recall).groupBy("_group").agg(F.count(F.lit(1)).alias("vectors")).select("vectors")


def near_duplicates(vectors: DataFrame, least: float = 0.95, target_recall: float = 0.9995) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows, classes, dtype = _classes(vectors)

    none = pa.table({c: pa.array([], pa.int64()) for c in ("_id", "links", "root")})

    def verified(t: pa.Table) -> pa.Table:
        guest = t.column("_guest").to_numpy()
        order = np.argsort(guest, kind="stable")  # members first
        m, inner = int((~guest).sum()), t.column("_inner")[0].as_py()
        if not m or (m == len(guest) and not inner):
            return none
        ids, size = t.column("_id").to_numpy()[order], t.column("size").to_numpy()[order]
        blobs = t.column("_v").to_pylist()
        x = unit([blobs[i] for i in order], dtype)
        links = np.zeros(len(ids), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0 if inner else m, len(ids), _SLICE):
            near = x[s:s + _SLICE] @ x[:m].T >= least
            own = np.arange(s, s + len(near))
            near &= own[:, None] > np.arange(m)  # a member meets the members before it, a guest meets all
            links[s:s + _SLICE] += near @ size[:m]
            links[:m] += near.T @ size[s:s + _SLICE]
            p, q = np.nonzero(near)
            a, b = forest(np.concatenate([a, ids[p + s]]), np.concatenate([b, ids[q]]))
        hit = np.flatnonzero(links)
        return pa.table({"_id": np.concatenate([ids[hit], a]), "links": np.concatenate([links[hit], 0 * a]),
                         "root": np.concatenate([ids[hit], b])})

    found = cut(_groups(classes, dtype, least, target_recall).groupBy("_group")
                .applyInArrow(verified, "_id bigint, links bigint, root bigint"))
    number = found.groupBy("_id").agg(F.sum("links").alias("_links"))
    # classes that rows of one id hold are joined as well: an id is one vertex
    good = F.col("vec_id").isNotNull() & F.col("_v").isNotNull()
    asked = rows.select("vec_id", F.when(good, F.xxhash64("_k1", "_k2")).alias("_id"))
    shared = asked.groupBy("vec_id").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count("_id").alias("_n"),
                                         F.count(F.lit(1)).alias("_m"))
    shared = cut(shared.where("vec_id IS NOT NULL AND _n > 0 AND (_lo <> _hi OR _n < _m)").select("vec_id", "_lo"))
    held = asked.join(shared, "vec_id").where("_id <> _lo").select(F.col("_lo").alias("a"), F.col("_id").alias("b"))
    comp = components(found.select(F.col("_id").alias("a"), F.col("root").alias("b")).union(held)).toDF("_id", "_c")
    whole = classes.join(number, "_id", "left").join(comp, "_id", "left").withColumn("_c", F.coalesce("_c", "_id"))
    smallest = whole.groupBy("_c").agg(F.min("rep").alias("component_id"))
    whole = cut(whole.join(smallest, "_c").select(
        "_id", (F.col("size") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"), "component_id"))
    # a row without a vector takes the component of its id's other rows
    bare = shared.join(whole, shared["_lo"] == whole["_id"]).select(F.col("vec_id").alias("_sid"), F.col("component_id").alias("_sc"))
    out = asked.join(whole, "_id", "left")
    return out.join(bare, (out["vec_id"] == bare["_sid"]) & out["_id"].isNull(), "left") \
        .select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component_id", "_sc", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; see the module for unusable vectors, ties and repeats."""
    return near_duplicates(vectors)
