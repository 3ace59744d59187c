"""Hard negatives by an inverted multi-index.

Vectors are integers cut into two halves, each with a codebook of its own; two
entries name a cell. Half of a score is at most the product with the entry and
the anchor's length times the entry's radius, so the sum of two such bounds
holds for all rows of a cell. Each anchor visits cells by falling bounds, which
a heap over the two sorted halves gives one by one, and stops when nothing that
is left can enter its result. So results are exact: the index decides only how
much is looked at. Cells are read as blocks of bounded size and anchors in
packs, met by an equality join on the cell, so a cell that holds a third of all
rows is many blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import released, small_batches, written
from tracewright.llm.vectorcodes import integers, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Window of negative scores, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Entries of a codebook: the fourth root of the rows, within these; rows of the fitting sample for each entry.
ENTRIES, SAMPLE = (2, 256), 64
#: Rows of a block and anchors of a pack.
BLOCK, PACK = 2048, 256
_FAR = 1 << 62
_STATE = "key bigint, id bigint, label bigint, vec binary, low array<bigint>, high array<bigint>, floor array<bigint>"
_VISIT = f"{_STATE}, cells array<int>, bound double"


@dataclass
class Index:
    books: list[np.ndarray]  # entries of each half
    radii: list[np.ndarray]
    filled: np.ndarray  # cells that hold rows
    width: int

    def halves(self, q: np.ndarray) -> list[np.ndarray]:
        cut = self.width // 2
        return [q[:cut], q[cut:]]

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the greatest and the least product of its entries' rows, rounded outwards."""
        out = []
        for part, book, radius in zip(self.halves(q), self.books, self.radii):
            product, reach = book @ part, np.linalg.norm(part) * radius
            slack = 1e-3 + 1e-9 * (np.abs(book) @ np.abs(part) + reach)
            out.append((product + reach + slack, product - reach - slack))
        return out


def in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sums: a heap that holds one open place in each row met so far."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)] if len(a) and len(b) else []
    while heap:
        less, i, j = heapq.heappop(heap)
        yield -less, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


def _fitted(sample: np.ndarray, size: int, rounds: int = 6) -> np.ndarray:
    """Entries for one half by a few rounds of means."""
    book = sample[:: max(1, len(sample) // size)][:size].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(sample, book)[0]
        for e in range(len(book)):
            own = sample[near == e]
            if len(own):
                book[e] = own.mean(0)
    return book


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = (book * book).sum(1)[None] - 2 * (x @ book.T)
    near = np.argmin(apart, 1)
    return near, np.linalg.norm(x - book[near], axis=1)


def _celled(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i4").reshape(-1, width).astype(np.float64)
        cut = width // 2
        (i, r), (j, s) = _nearest(x[:, :cut], books[0]), _nearest(x[:, cut:], books[1])
        cell = i * len(books[1]) + j
        columns = [batch.column(k) for k in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(r), pa.array(s)], [*batch.schema.names, "cell", "r", "s"])


def _packed(table: pa.Table) -> pa.Table:
    """The rows of a block as one row, by id."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    table = table.take(order)
    ids, labels = table.column("id").to_numpy().astype("<i8").tobytes(), table.column("label").to_numpy().astype("<i8").tobytes()
    return pa.table([pa.array([table.column("cell")[0].as_py()], pa.int32()), pa.array([ids]), pa.array([labels]), pa.array([b"".join(table.column("vec").to_pylist())])],
                    ["cell", "ids", "labels", "vecs"])


def _gathered(table: pa.Table) -> pa.Table:
    """The anchors of a pack as one row."""
    take = lambda c: pa.array([table.column(c).to_pylist()])
    longs = pa.list_(pa.int64())
    return pa.table([pa.array([table.column("cell")[0].as_py()], pa.int32()), take("key"), take("id"), take("label"), pa.array([b"".join(table.column("vec").to_pylist())]),
                     *[take(c).cast(pa.list_(longs)) for c in ("low", "high", "floor")]], ["cell", "keys", "own", "names", "asks", "low", "high", "floor"])


def _best(scores: np.ndarray, allowed: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``limit`` highest allowed scores of each row; ties go to lower columns."""
    n = scores.shape[1]
    wide = np.iinfo(np.int64).max // (2 * n)
    if np.abs(scores).max(initial=0) < wide:  # score and place in one number
        mixed = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
        at = np.argpartition(mixed, n - limit, axis=1)[:, n - limit :] if n > limit else np.broadcast_to(np.arange(n), scores.shape)
    else:
        at = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :limit]
    row = np.broadcast_to(np.arange(len(scores))[:, None], at.shape)
    good = allowed[row, at]
    return row[good], at[good]


def _scored(batches: Iterator[pa.RecordBatch], width: int, same: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """Packs of anchors beside blocks of rows -> (key, k, score, id): what may enter each anchor's windows."""
    exact = width < 512  # products of numbers below 2^22 then add up exactly in doubles
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
            a, b = (np.frombuffer(row[c], "<i4").reshape(-1, width).astype(np.float64 if exact else np.int64) for c in ("asks", "vecs"))
            scores = (a @ b.T).astype(np.int64)
            own, names = np.array(row["own"]), np.array(row["names"])
            fits = ((names[:, None] == labels[None]) == same) & (own[:, None] != ids[None])
            keys = np.array(row["keys"])
            for k in range(max(map(len, row["low"]))):
                has = np.array([len(x) > k for x in row["low"]])
                low, high, floor = (np.array([x[k] if len(x) > k else 0 for x in row[c]]) for c in ("low", "high", "floor"))
                allowed = fits & has[:, None] & (scores >= np.maximum(low, floor)[:, None]) & (scores <= high[:, None])
                if allowed.any():
                    i, j = _best(scores, allowed, limit)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(np.full(len(i), k, np.int32)), pa.array(scores[i, j]), pa.array(ids[j])],
                                                     ["key", "k", "score", "id"])


def _visits(batches: Iterator[pa.RecordBatch], index: Index, start: int, size: int) -> Iterator[pa.RecordBatch]:
    """Adds to each anchor the next cells by its bounds, and the bound of the first cell after them (null: none is left).

    Cells that lie above all windows with all their rows are passed over.
    """
    n, filled = len(index.books[1]), set(index.filled.tolist())
    for batch in batches:
        cells, bounds = [], []
        for vec, high in zip(batch.column("vec").to_pylist(), batch.column("high").to_pylist()):
            (up, down), (up2, down2) = index.bounds(np.frombuffer(vec, "<i4").astype(np.float64))
            walk = ((u, i, j) for u, i, j in in_order(up, up2) if i * n + j in filled)
            own = list(islice(walk, start, start + size + 1))
            cells.append([i * n + j for _, i, j in own[:size] if down[i] + down2[j] <= max(high)])
            bounds.append(own[size][0] if len(own) > size else None)
        columns = [batch.column(k) for k in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.list_(pa.int32())), pa.array(bounds, pa.float64())], [*batch.schema.names, "cells", "bound"])


def _search(state: DataFrame, blocks: DataFrame, index: Index, n_anchors: int, same: bool, limit: int, pack: int) -> DataFrame | None:
    """``(key, k, score, id)``: for each anchor and window the ``limit`` best rows, by rounds of ever more cells."""
    width, packs = index.width, max(1, -(-n_anchors // pack))
    best, start, size = None, 0, 2 * max(map(len, index.books))
    while True:
        a, b = start, size
        asked = written(state.mapInArrow(lambda it: _visits(it, index, a, b), _VISIT), "asked")
        rows = asked.select(F.explode("cells").alias("cell"), "key", "id", "label", "vec", "low", "high", "floor")
        packed = rows.groupBy("cell", F.pmod("key", F.lit(packs))).applyInArrow(
            _gathered, "cell int, keys array<bigint>, own array<bigint>, names array<bigint>, asks binary, low array<array<bigint>>, high array<array<bigint>>, floor array<array<bigint>>")
        both = packed.join(blocks.hint("merge"), "cell").drop("cell")
        found = both.mapInArrow(lambda it: _scored(it, width, same, limit), "key bigint, k int, score bigint, id bigint")
        found = found if best is None else best.unionByName(found)
        place = F.row_number().over(Window.partitionBy("key", "k").orderBy(F.desc("score"), "id"))
        best, old = written(found.withColumn("place", place).filter(F.col("place") <= limit).drop("place"), "best"), best
        floors = best.groupBy("key", "k").agg(F.when(F.count("*") == limit, F.min("score")).alias("floor")).filter("floor IS NOT NULL")
        floors = floors.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "floor"))).alias("floors"))
        left = asked.filter("bound IS NOT NULL").drop("cells", "floor").join(floors, "key", "left")
        floor = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("floors", i), F.lit(-_FAR)))
        left = left.withColumn("floor", floor)
        open_ = F.exists(F.arrays_zip("low", "floor"), lambda w: F.col("bound") >= F.greatest(w["low"], w["floor"]))
        state, was = written(left.filter(open_).select("key", "id", "label", "vec", "low", "high", "floor"), "open"), state
        released(asked, *([old] if old is not None else []), *([was] if start else []))
        start, size = start + size, size * 4
        if state.isEmpty():
            return best


def build(rows: DataFrame, n_rows: int, width: int, block: int = BLOCK, entries: tuple[int, int] = ENTRIES, sample: int = SAMPLE) -> tuple[Index, DataFrame, DataFrame]:
    """The index of ``rows(id, label, vec, anchor)``, its blocks, and the distinct rows with their cells.

    Codebooks are fitted on a sample of ``sample`` rows for each entry, those of smallest hash; every row is indexed, and
    radii cover all rows.
    """
    size = min(max(round(n_rows**0.25), entries[0]), entries[1])
    some = rows.select("vec").orderBy(F.xxhash64("id", "vec"), "id").limit(size * sample).collect()
    x = np.frombuffer(b"".join(r.vec for r in some), "<i4").reshape(-1, width).astype(np.float64)
    books = [_fitted(x[:, : width // 2], size), _fitted(x[:, width // 2 :], size)]
    kind = "id bigint, label bigint, vec binary, anchor boolean, cell int, r double, s double"
    cells = written(rows.mapInArrow(lambda it: _celled(it, books, width), kind).dropDuplicates(["id", "label", "vec"]), "cells")
    second = len(books[1])
    filled = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s"))  # at most as many rows as cells
    found = filled.collect()
    radii = [np.zeros(len(b)) for b in books]
    for c in found:
        radii[0][c.cell // second] = max(radii[0][c.cell // second], c.r)
        radii[1][c.cell % second] = max(radii[1][c.cell % second], c.s)
    index = Index(books, radii, np.array([c.cell for c in found], np.int64), width)
    pieces = filled.select("cell", F.ceil(F.col("n") / block).alias("pieces"))
    # broadcast, one row for each cell: a join by cell would leave the rows dealt by cell, and a hot cell in one task
    dealt = cells.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("id", "label", "vec"), F.col("pieces")))
    blocks = written(dealt.select("cell", "piece", "id", "label", "vec").groupBy("cell", "piece").applyInArrow(_packed, "cell int, ids binary, labels binary, vecs binary"), "blocks")
    return index, blocks, cells


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, pack: int = PACK,
                   entries: tuple[int, int] = ENTRIES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows for which ``anchor`` holds.

    * Scores are products of vectors of floor(scale * x); higher come first, ties by smaller id. An anchor's positives are the
      first rows of its label; a positive's negatives the first rows of other labels whose score lies between ``low`` and
      ``high`` hundredths of the positive's. A pair without such rows gives no row, nor does a positive of negative score.
    * Rows with a null id or label, without a vector, or with a component that is null, not finite, or 2^14 or more in size,
      take no part; nor do vectors of another length than that of the smallest id. Labels that are not whole numbers are
      compared by hash.
    * Repeated rows count once. Rows with an anchor's own id are neither positives nor negatives of it. Other columns are
      ignored; an empty table gives no rows.
    """
    vector = F.col(f"`{vector_col}`")
    whole = dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint")
    label = F.col(f"`{label_col}`").cast("bigint") if whole else F.xxhash64(f"`{label_col}`")
    rows = small_batches(vectors).filter(usable(vector) & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.alias("label"), vector.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    first = rows.groupBy().agg(F.min(F.struct("id", F.size("vector").alias("n"))).alias("first"), F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    if not first.anchors or not first.n:
        return rows.sparkSession.createDataFrame([], schema)
    width, spark = first["first"].n, rows.sparkSession
    to_bytes = F.arrow_udf(lambda a: pa.array([v.tobytes() for v in integers(a, scale).astype("<i4")], pa.binary()), "binary")
    rows = rows.filter(F.size("vector") == width).select("id", "label", to_bytes("vector").alias("vec"), "anchor")
    index, blocks, cells = build(rows, first.n, width, block, entries)

    longs = lambda x: F.array(F.lit(x).cast("bigint"))
    anchors = written(cells.filter("anchor").select(F.xxhash64("id", "label", "vec").alias("key"), "id", "label", "vec"), "anchors")
    state = anchors.select("*", longs(-_FAR).alias("low"), longs(_FAR).alias("high"), longs(-_FAR).alias("floor"))
    near = _search(state, blocks, index, first.anchors, True, positives, pack)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id")) - 1  # the window holds at most `positives` rows
    near = written(near.filter((F.col("score") >= 0)).select("key", rank.alias("k"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    window = F.expr(f"struct(k, (positive_score * {low} + 99) div 100 AS low, (positive_score * {high}) div 100 AS high)")
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(window)).alias("w"))
    state = anchors.join(windows, "key").select("key", "id", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"),
                                                F.transform("w", lambda w: F.lit(-_FAR).cast("bigint")).alias("floor"))
    state = written(state, "windows")
    if state.isEmpty():
        return spark.createDataFrame([], schema)
    far = _search(state, blocks, index, first.anchors, False, negatives, pack)
    named = far.join(near, ["key", "k"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    rank = F.row_number().over(Window.partitionBy("key", "k").orderBy(F.desc("score"), "id"))
    return named.select("anchor_id", "positive_id", rank.alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
