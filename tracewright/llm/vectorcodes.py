"""Compression of vectors to codes: product quantisation fitted by dual-tree Lloyd rounds.

Vectors become integers and are cut into parts. A table of chunks holds, for
each part position, a tree over the chunk's parts: boxes of nodes, the sums of
what lies under them, and the parts in tree order. Each round meets these trees
with a tree over the codebook's entries. Bounds on the distance between boxes
throw out pairs of nodes; where one entry is left, the whole node is assigned
by its cached sums; only leaves that stay uncertain are compared by integers.
So codes and codebooks equal those of plain rounds exactly. What reaches the
driver in a round is the codebook's sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import released, small_batches, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of one chunk, and parts of one leaf.
CHUNK, LEAF = 4096, 32
#: Components from here on have no squared distance in 64 bits; such vectors count as not finite.
LIMIT = float(1 << 14)
_CHUNKS = "ids array<{id}>, labels array<{label}>, points array<binary>, orders array<binary>, bounds array<binary>, boxes array<binary>, sums array<binary>"


def usable(vector: Column, limit: float = LIMIT) -> Column:
    """Whether a vector is there, has components, and all of them are numbers below the limit."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < limit)), F.lit(False))


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), -1)


# -- trees --------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes in levels, the root first; node k has children 2k + 1 and 2k + 2 and the points ``order[bounds[k, 0]:bounds[k, 1]]``."""

    points: np.ndarray  # in tree order
    order: np.ndarray
    bounds: np.ndarray
    boxes: np.ndarray  # (node, lowest and highest, dimension)
    sums: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.bounds) + 1).bit_length() - 2

    def level(self, k: int) -> slice:
        return slice((1 << k) - 1, (2 << k) - 1)


def grow(points: np.ndarray, leaf: int) -> Tree:
    """A balanced tree: each node is halved along its widest dimension until leaves hold at most ``leaf`` points."""
    n, depth = len(points), 0
    while (n + (1 << depth) - 1) >> depth > leaf:
        depth += 1
    order, bounds = np.arange(n), np.zeros(((2 << depth) - 1, 2), np.int64)
    bounds[0] = 0, n
    for k in range((1 << depth) - 1):
        a, b = bounds[k]
        own, mid = order[a:b], (a + b + 1) // 2
        if b - a > 1:
            x = points[own]
            widest = int(np.argmax(x.max(0) - x.min(0)))
            order[a:b] = own[np.argpartition(x[:, widest], mid - a - (mid == b))]
        bounds[2 * k + 1], bounds[2 * k + 2] = (a, mid), (mid, b)
    points = points[order]
    boxes = np.zeros((len(bounds), 2, points.shape[1]), np.int64)
    sums = np.zeros((len(bounds), points.shape[1]), np.int64)
    for k in range(len(bounds) - 1, -1, -1):
        a, b = bounds[k]
        if b > a:
            boxes[k] = points[a:b].min(0), points[a:b].max(0)
            sums[k] = points[a:b].sum(0)
    return Tree(points, order, bounds, boxes, sums)


def _distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of each box of ``a`` from each of ``b``."""
    low, high = a[:, None, 0] - b[None, :, 1], a[:, None, 1] - b[None, :, 0]
    gap = np.maximum(np.maximum(low, -high), 0)
    far = np.maximum(np.abs(low), np.abs(high))
    return (gap * gap).sum(2), (far * far).sum(2)


def assign(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each point in tree order, sums and counts of each entry's points); ties go to the entry of lower index.

    Both trees are descended together. A pair of nodes goes when another entry node is nearer for all points of the node;
    equal bounds stay, so that ties are settled by integers.
    """
    m, d = len(entries.points), tree.points.shape[1]
    codes = np.full(len(tree.points), -1, np.int64)
    sums, counts = np.zeros((m, d), np.int64), np.zeros(m, np.int64)
    nodes = np.zeros(1, np.int64)
    alive = np.ones((1, 1), bool)
    down = 0
    for depth in range(tree.depth + 1):
        while True:
            level = entries.level(down)
            own = entries.bounds[level]
            alive = alive & (own[:, 1] > own[:, 0])
            near, far = _distances(tree.boxes[nodes], entries.boxes[level])
            best = np.where(alive, far, np.iinfo(np.int64).max).min(1)
            alive = alive & (near <= best[:, None])
            if down == entries.depth or depth < tree.depth:
                break
            down, alive = down + 1, np.repeat(alive, 2, axis=1)  # the last points meet single entries
        if down == entries.depth:
            single = alive.sum(1) == 1
            for k, e in zip(nodes[single], entries.order[entries.bounds[level][np.argmax(alive[single], 1), 0]] if m else []):
                a, b = tree.bounds[k]
                codes[a:b] = e
                sums[e] += tree.sums[k]
                counts[e] += b - a
            nodes, alive = nodes[~single], alive[~single]
        if depth < tree.depth:
            nodes = np.stack([2 * nodes + 1, 2 * nodes + 2], 1).ravel()
            alive = np.repeat(alive, 2, axis=0)
            if down < entries.depth:
                down, alive = down + 1, np.repeat(alive, 2, axis=1)
    if len(nodes):
        ranges = tree.bounds[nodes]
        size = ranges[:, 1] - ranges[:, 0]
        at = np.repeat(ranges[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
        apart = tree.points[at][:, None, :] - entries.points[None]  # leaf level: entry nodes and entries are in one order
        apart = (apart * apart).sum(2)
        place = entries.bounds[entries.level(entries.depth)]
        open_to = np.zeros((len(nodes), m), bool)
        for j, (a, b) in enumerate(place):
            open_to[:, a:b] = alive[:, j : j + 1]
        apart = np.where(np.repeat(open_to, size, axis=0), apart, np.iinfo(np.int64).max)
        by_index = np.empty_like(apart)
        by_index[:, entries.order] = apart
        found = np.argmin(by_index, 1) if len(at) else np.zeros(0, np.int64)
        codes[at] = found
        np.add.at(sums, found, tree.points[at])
        counts += np.bincount(found, minlength=m)
    return codes, sums, counts


# -- jobs ---------------------------------------------------------------------
def _chunks(batches: Iterator[pa.RecordBatch], scale: int, parts: int, chunk: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) -> a row for each chunk with the trees of its parts."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids, labels, vectors = (rows.column(k).combine_chunks() for k in range(3))
        x = integers(vectors, scale)
        trees = [grow(np.ascontiguousarray(p), leaf) for p in np.split(x, parts, axis=1)]
        each = lambda f, kind: pa.array([[f(t).astype(kind).tobytes() for t in trees]], pa.list_(pa.binary()))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), a) for a in (ids, labels)]
        return pa.RecordBatch.from_arrays(
            [*lists, each(lambda t: t.points, "<i4"), each(lambda t: t.order, "<i4"), each(lambda t: t.bounds, "<i4"), each(lambda t: t.boxes, "<i4"), each(lambda t: t.sums, "<i8")],
            ["ids", "labels", "points", "orders", "bounds", "boxes", "sums"])

    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, chunk - size)
            held.append(some)
            size, batch = size + some.num_rows, batch.slice(some.num_rows)
            if size == chunk:
                yield made(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield made(pa.Table.from_batches(held))


def _trees(batch: pa.RecordBatch, row: int, width: int) -> list[Tree]:
    columns = {c: batch.column(c)[row].as_py() for c in ("points", "orders", "bounds", "boxes", "sums")}
    read = lambda data, kind, *shape: np.frombuffer(data, kind).astype(np.int64).reshape(*shape)
    return [Tree(read(p, "<i4", -1, width), read(o, "<i4", -1), read(b, "<i4", -1, 2), read(x, "<i4", -1, 2, width), read(s, "<i8", -1, width))
            for p, o, b, x, s in zip(*columns.values())]


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and counts of each entry, a row for each component: (part, entry, at, total, n)."""
    parts, m, d = books.shape
    entries = [grow(b, 1) for b in books]
    sums, counts = np.zeros((parts, m, d), np.int64), np.zeros((parts, m), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            for p, tree in enumerate(_trees(batch, row, d)):
                _, s, c = assign(tree, entries[p])
                sums[p] += s
                counts[p] += c
    p, e, at = np.nonzero(np.repeat((counts > 0)[:, :, None], d, axis=2))
    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[p, e, at]), pa.array(counts[p, e])],
                                     ["part", "entry", "at", "total", "n"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, d = books.shape
    entries = [grow(b, 1) for b in books]
    for batch in batches:
        for row in range(batch.num_rows):
            ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
            codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
            for p, tree in enumerate(_trees(batch, row, d)):
                code, _, _ = assign(tree, entries[p])
                codes[tree.order, p] = code
                apart = tree.points - books[p][code]
                error[tree.order] += (apart * apart).sum(1)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])


def first_books(head: list[list], scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    x = np.floor(np.array(head, np.float64) * scale).astype(np.int64)
    return np.ascontiguousarray(np.stack(np.split(x, parts, axis=1)))


def updated(books: np.ndarray, rows: list) -> np.ndarray:
    """Entries replaced by the floors of their means; those without parts stay."""
    books = books.copy()
    for r in rows:
        books[r.part, r.entry, r.at] = r.total // r.n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
             parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors and the codebooks (part, entry, component): ``((id, label, code, error), books)``.

    * Rows without a vector, or with a component that is null, not finite, or 2^14 or more in size, take no part; nor do
      vectors of another length than that of the first row by id. Its length must be a multiple of ``parts`` (ValueError).
    * The codebook starts from the ``size`` smallest ids; rows that repeat an id come in the order of their vectors, null ids
      last. Fewer rows give fewer entries. Repeated rows each get a row; other columns are ignored; no rows give no rows.
    * code: two hex digits for each part; error: squared distances summed over parts.
    """
    rows = small_batches(vectors).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.filter(usable(F.col("vector")))
    by_id = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*by_id).select(F.size("vector").alias("n")).first()
    name = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {name['id']}, label {name['label']}, code string, error bigint"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    if first.n % parts:
        raise ValueError(f"vectors of {first.n} components do not part into {parts}")
    rows = rows.filter(F.size("vector") == first.n)
    books = first_books([r.vector for r in rows.orderBy(*by_id).limit(size).collect()], scale, parts)
    trees = written(rows.mapInArrow(lambda it: _chunks(it, scale, parts, chunk, leaf), _CHUNKS.format(**name)), "trees")
    for _ in range(rounds):
        now = books
        sums = trees.drop("ids", "labels", "orders").withColumn("orders", F.transform("bounds", lambda x: F.lit(b"")))
        sums = sums.mapInArrow(lambda it: _round(it, now), "part int, entry int, at int, total bigint, n bigint")
        books = updated(books, sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    last = books
    coded = written(trees.mapInArrow(lambda it: _coded(it, last), schema), "codes")
    released(trees)
    return coded, books


def compress_with_errors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """``(id_col, code, error, label_error, codebooks_sha256)``; errors of equal labels, nulls together, are summed beside each row."""
    coded, books = compress(vectors, id_col, vector_col, label_col, **how)
    whole = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = coded.join(whole, coded["label"].eqNullSafe(whole["of"]))
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
