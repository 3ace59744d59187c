"""Logistic regression on text vectors whose coefficients never meet in one place.

Coefficients lie by part of the key space, as the terms of ``wordweights`` do. In a step each block of documents gets the
direction at its own terms and sends its gradient back, packed; the driver sees sums. Margins are linear along a direction, so
the line search reads a few numbers of each document and no term. Directions are conjugate gradients (Polak-Ribiere), which
need three numbers for each coefficient. Terms count from their means and in units of their deviations, as sparse columns of
very different sizes would need many steps otherwise; the vectors stay sparse, as the means act through the intercepts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.wordweights import WordWeights, numbers, weighed_block
from tracewright.session import released, written

_MARGINS = "block bigint, at binary, y binary, z binary, dz binary"
_HELD = "part bigint, block bigint, steps binary, inv binary, w binary, g binary, d binary, dots array<double>"
_SENT = "part bigint, block bigint, x binary"
_DOTS = 6


class _Matrix:
    """The vectors of a block: entries by document and by the block's own number of the term."""

    def __init__(self, row: dict, n_docs: int):
        counts, df, times = numbers(row["counts"], "u4"), numbers(row["docs"], "u4"), numbers(row["times"], "u4")
        self.rows, self.cols = len(counts), len(df)
        self.doc, self.col = np.repeat(np.arange(self.rows), counts), np.cumsum(numbers(row["cols"], "u4"), dtype=np.uint32).astype(np.int64)
        x = (1 + np.log(times)) * (np.log((1 + n_docs) / (1 + df[self.col].astype(np.float64))) + 1)
        self.x = x / np.sqrt(np.bincount(self.doc, x * x, self.rows))[self.doc]

    def times(self, d: np.ndarray) -> np.ndarray:
        """Margins (document, class) of coefficients (term, class)."""
        return np.stack([np.bincount(self.doc, self.x * v[self.col], self.rows) for v in d.T], 1)

    def back(self, r: np.ndarray, power: int = 1) -> np.ndarray:
        return np.stack([np.bincount(self.col, self.x**power * v[self.doc], self.cols) for v in r.T], 1)


def _wide(data: bytes, width: int, kind: str = "f8") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width)


def _kept(state: dict, width: int) -> list[np.ndarray]:
    """Scales and means, coefficients, gradient and direction of a part, which are stored in 32 bits."""
    return [_wide(state[c], 2 if c == "inv" else width, "f4").astype(np.float64) for c in ("inv", "w", "g", "d") if c in state]


def _probabilities(m: np.ndarray) -> np.ndarray:
    """Classes by margins; one margin is that of class 1 against class 0."""
    m = np.hstack([np.zeros_like(m), m]) if m.shape[1] == 1 else m
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _residuals(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _probabilities(m)
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y] = 1
    return p, (p - hit)[:, -m.shape[1]:]


def _labelled(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["at"], "i4"), np.frombuffer(row["y"], "i4"), _wide(row["z"], width), _wide(row["dz"], width)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(names: str, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names.split())


def _cut(row: dict, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, block, values) of a block's terms, which are in order of their parts."""
    at = 0
    for p in row["parts"]:
        yield p["part"], row["block"], np.ascontiguousarray(values[at : at + p["n"]]).tobytes()
        at += p["n"]


class TextFit:
    """Multinomial regression with a squared penalty on coefficients of scaled terms, as Spark's with ``standardization``.

    ``labels``: key, y (0, 1, ...). Two classes need one coefficient for each term: those of the classes differ in sign only.
    """

    def __init__(self, weights: WordWeights, labels: DataFrame, rounds: int = 50, reg: float = 0.01, tol: float = 1e-6, passes: int = 4):
        self.weights, self.passes, self.n_docs = weights, passes, weights.n_docs
        tables = [written(weights.packed(labels, passes, turn), "text_train") for turn in range(passes)]
        self.train = labels.sparkSession.read.schema(tables[0].schema).parquet(*[t.written_to for t in tables])
        found = {r.y: r.n for r in self.train.select(F.explode("ys").alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not found:
            raise ValueError("no labelled document has a term")
        self.rows, self.classes = sum(found.values()), max(2, 1 + max(found))
        self.width = width = 1 if self.classes == 2 else self.classes
        self.reg = reg / 2 if width == 1 else reg
        self.links = self.train.select(F.explode("parts").alias("p"), "block").select("p.part", "block", "p.steps")
        start = np.log1p([found.get(c, 0) for c in range(self.classes)])
        self.bias = start[1:] - start[:1] if width == 1 else start - start.mean()
        self._begin()
        self._descend(rounds, tol)
        released(self.margins, *tables)

    # ---- passes over blocks and parts ------------------------------------------------
    def _begin(self) -> None:
        width, n_docs, n = self.width, self.n_docs, self.rows

        def zero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                z = np.zeros((len(row["ys"]), width)).tobytes()
                yield _batch("block at y z dz", [(row["block"], np.array(row["at"], "i4").tobytes(), np.array(row["ys"], "i4").tobytes(), z, z)], [pa.int64()] + [pa.binary()] * 4)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                x = _Matrix(row, n_docs)
                times = np.bincount(np.array(row["at"], "i4"), minlength=x.rows).astype(float)[:, None]
                yield _batch("part block x", list(_cut(row, np.hstack([x.back(times), x.back(times, 2)]))), [pa.int64(), pa.int64(), pa.binary()])

        def scales(sums: pa.Table, held: pa.Table) -> pa.Table:
            size, s = _sums(sums, held, 2, "f8")
            var = (s[:, 1] - s[:, 0] ** 2 / n) / max(n - 1, 1)
            inv = np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 0)
            nothing = np.zeros((size, width))
            return _state(held, np.stack([inv, inv * s[:, 0] / n], 1), nothing, nothing, nothing, [])

        self.margins = written(self.train.select("block", "at", "ys").mapInArrow(zero, _MARGINS), "text_margins")
        sizes = self.weights.answers.groupBy("part").agg(F.max("size").alias("size")).filter("size > 0")
        empty = sizes.select("part", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("steps"), *[
            (F.expr("cast(cast(size as string) as binary)") if c == "inv" else F.lit(None).cast("binary")).alias(c) for c in ("inv", "w", "g", "d")],
            F.lit(None).cast("array<double>").alias("dots"))
        sent = self.train.mapInArrow(moments, _SENT)
        self.state = written(sent.groupBy("part").cogroup(self._held(empty).groupBy("part")).applyInArrow(scales, _HELD), "text_state")

    def _held(self, state: DataFrame) -> DataFrame:
        """State and links of a part in one group."""
        none = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in state.columns[3:]]
        return self.links.select("part", "block", "steps", *none).unionByName(state)

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        """A table of the next step in place of the one before."""
        before, after = getattr(self, name), written(df, f"text_{name}")
        setattr(self, name, after)
        released(before)
        return after

    def _move(self, step: float, beta: float) -> None:
        """Margins go ``step`` along the last direction; then those of the next one, -g + beta d, are made."""
        width, n_docs = self.width, self.n_docs

        def ship(held: pa.Table) -> pa.Table:
            state, links = _split(held)
            inv, _, g, d = _kept(state, width)
            x = ((beta * d - g) * inv[:, :1]).astype("f4")
            rows = [(state["part"], b, np.ascontiguousarray(x[at]).tobytes()) for b, at in links]
            return pa.Table.from_batches([_batch("part block x", rows, [pa.int64(), pa.int64(), pa.binary()])])

        def turn(block: pa.Table, sent: pa.Table) -> pa.Table:
            row = block.to_pylist()[0]
            at, _, z, dz = _labelled(row, width)
            d = np.concatenate([np.zeros((0, width), "f4")] + [_wide(r["x"], width, "f4") for r in sorted(sent.to_pylist(), key=lambda r: r["part"])])
            new = _Matrix(row, n_docs).times(d.astype(np.float64))[at]
            return pa.Table.from_batches([_batch("block at y z dz", [(row["block"], row["at"], row["y"], (z + step * dz).tobytes(), new.tobytes())], [pa.int64()] + [pa.binary()] * 4)])

        sent = self._held(self.state).groupBy("part").applyInArrow(ship, _SENT)
        blocks = self._blocks()
        self._keep("margins", blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(turn, _MARGINS))

    def _blocks(self, *more: Column) -> DataFrame:
        return self.train.select("block", "counts", "cols", "times", "docs", *more).join(self.margins.hint("merge"), "block")

    def _gradient(self, step: float, beta: float, bias: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients go ``step`` along -g + beta d, and get their gradient there, ``own`` being that of the intercepts.

        Returns products of vectors, and what gradient and direction are worth at the terms' means, summed over all parts.
        """
        width, n_docs, n, reg = self.width, self.n_docs, self.rows, self.reg

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                at, y, z, dz = _labelled(row, width)
                x = _Matrix(row, n_docs)
                r = _residuals(z + step * dz + bias, y)[1]
                r = np.stack([np.bincount(at, v, x.rows) for v in r.T], 1)
                yield _batch("part block x", list(_cut(row, x.back(r).astype("f4"))), [pa.int64(), pa.int64(), pa.binary()])

        def gather(sent: pa.Table, held: pa.Table) -> pa.Table:
            state, _ = _split(held)
            inv, w, g, d = _kept(state, width)
            d = beta * d - g
            w = w + step * d
            new = _sums(sent, held, width, "f4")[1] * inv[:, :1] / n - inv[:, 1:] * own + reg * w
            dots = [float((a * b).sum()) for a, b in ((w, new), (w, d), (new, new), (new, d), (d, d), (new, g))]
            return _state(held, inv, w, new, d, [*dots, *inv[:, 1] @ new, *inv[:, 1] @ d])

        cuts = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), p["n"].alias("n"))).alias("parts")
        sent = self._blocks(cuts).mapInArrow(back, _SENT)
        out = self._keep("state", sent.groupBy("part").cogroup(self._held(self.state).groupBy("part")).applyInArrow(gather, _HELD))
        total = np.array([x or 0.0 for x in out.agg(*[F.sum(F.get("dots", F.lit(i))) for i in range(_DOTS + 2 * width)]).first()])
        return total[:_DOTS], total[_DOTS : _DOTS + width], total[_DOTS + width :]

    def _along(self, steps: list[float], bias: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """For each step along the direction: loss, its first and second derivative, and residuals by class, summed over documents."""
        width = self.width

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(steps), 3 + width))
            for row in _rows(batches):
                _, y, z, dz = _labelled(row, width)
                by = dz + turn
                full = np.hstack([np.zeros_like(by), by]) if width == 1 else by
                for i, step in enumerate(steps):
                    p, r = _residuals(z + bias + step * by, y)
                    mean = (p * full).sum(1)
                    out[i] += [-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), (r * by).sum(), ((p * full**2).sum(1) - mean**2).sum(), *r.sum(0)]
            yield _batch("i v", [(i, list(v)) for i, v in enumerate(out)], [pa.int64(), pa.list_(pa.float64())])

        got = self.margins.mapInArrow(sums, "i bigint, v array<double>").groupBy("i").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(3 + width)])
        return np.array([list(r)[1:] for r in sorted(got.collect())]) / self.rows

    # ---- descent ---------------------------------------------------------------------
    def _descend(self, rounds: int, tol: float) -> None:
        width, reg = self.width, self.reg
        nothing = np.zeros(width)
        first = self._along([0.0], self.bias, nothing)[0]
        last, own = first[0], first[3:]  # gradient of the intercepts, which carry no penalty
        (wg, wd, gg, gd, dd, _), at_g, at_d = self._gradient(0.0, 0.0, self.bias, own)
        turn, step, beta, ww = nothing, 0.0, 0.0, 0.0
        for _ in range(rounds):
            before = gg + own @ own
            if before <= 1e-24:
                break
            self._move(step, beta)
            # the direction -g + beta d against w and itself; terms count from their means, so it turns the intercepts too
            turn = beta * turn - own
            wd, dd = beta * wd - wg, gg - 2 * beta * gd + beta * beta * dd
            turned = turn - (beta * at_d - at_g)
            step = self._search(lambda s: self._along(s, self.bias, turned), lambda s: reg * (wd + s * dd), reg * dd)
            ww += 2 * step * wd + step * step * dd
            at = self._along([step], self.bias, turned)[0]
            old, own = own, at[3:]
            self.bias = self.bias + step * turned
            (wg, wd, gg, gd, dd, both), at_g, at_d = self._gradient(step, beta, self.bias, own)
            beta = max(0.0, (gg + own @ own - both - own @ old) / before)
            loss = at[0] + reg * ww / 2
            if last - loss <= tol * abs(last):
                break
            last = loss
        self.loss = last

    @staticmethod
    def _search(along: Callable, slope: Callable, bend: float) -> float:
        """Step where the derivative is zero: it only grows, so two grids and a line between neighbours find it."""
        first = along([0.0])[0]
        d = first[1] + slope(0.0)
        if d >= 0:
            return 0.0
        guess = -d / max(first[2] + bend, 1e-12)
        steps = [0.0, *[guess * 2.0**k for k in range(-6, 11)]]
        for _ in range(2):
            values = [v[1] + slope(s) for s, v in zip(steps, along(steps))]
            k = next((k for k, v in enumerate(values) if v >= 0), None)
            if not k:
                return steps[-1] if k is None else steps[0]
            a, b, va, vb = steps[k - 1], steps[k], values[k - 1], values[k]
            steps = [a + (b - a) * i / 16 for i in range(17)]
        return a - va * (b - a) / (vb - va)

    # ---- answers ---------------------------------------------------------------------
    def answers(self, turn: int) -> DataFrame:
        """(key, probability) of every document that has terms, for the blocks of one pass."""
        width, bias, n_docs, mine = self.width, self.bias, self.n_docs, self.weights.part(self.passes, turn)

        def ship(answers: pa.Table, held: pa.Table) -> pa.Table:
            state = held.to_pylist()[0] if held.num_rows else None
            inv, w = _kept(state, width) if state else (np.zeros((0, 2)), np.zeros((0, width)))
            w = (w * inv[:, :1]).astype("f4")
            at = [np.cumsum(numbers(s, "u4").astype(np.int64)) for s in answers.column("steps").to_pylist()]
            return answers.append_column("x", pa.array([np.ascontiguousarray(w[i]).tobytes() for i in at], pa.binary()))

        def answer(block: pa.Table, sent: pa.Table) -> pa.Table:
            ids, doc, place, x = weighed_block(block, sent, n_docs)
            w = np.concatenate([np.zeros((0, width), "f4")] + [_wide(r["x"], width, "f4") for r in sorted(sent.select(["part", "x"]).to_pylist(), key=lambda r: r["part"])])
            have, row = np.unique(doc, return_inverse=True)
            p = _probabilities(np.stack([np.bincount(row, x * v[place], len(have)) for v in w.T], 1) + bias)
            offsets = pa.array(np.arange(len(have) + 1) * p.shape[1], pa.int32())
            return pa.table([ids.take(pa.array(have)), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], ["id", "probability"])

        links = self.weights.answers.filter(mine)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema) + ", x binary"
        sent = links.groupBy("part").cogroup(self.state.select("part", "inv", "w").groupBy("part")).applyInArrow(ship, schema)
        p = self.weights.blocks.filter(mine).groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(answer, f"id {self.weights.kind}, probability array<double>")
        return p.filter(F.col("id").isNotNull()).withColumnRenamed("id", self.weights.key)


def _split(held: pa.Table) -> tuple[dict, list[tuple[int, np.ndarray]]]:
    """State of a part, and the numbers of the terms of each block in it."""
    state, links = None, []
    for row in held.to_pylist():
        if row["block"] == -1:
            state = row
        else:
            links.append((row["block"], np.cumsum(numbers(row["steps"], "u4").astype(np.int64))))
    return state, links


def _sums(sent: pa.Table, held: pa.Table, width: int, kind: str) -> tuple[int, np.ndarray]:
    """Values of all blocks, summed by the terms of a part."""
    state, links = _split(held)
    size = len(state["inv"]) // 8 if state["w"] is not None else int(state["inv"])
    out = np.zeros((size, width))
    values = dict(zip(sent.column("block").to_pylist(), sent.column("x").to_pylist()))
    for block, at in links:
        out[at] += _wide(values[block], width, kind)  # a term is once in a block
    return size, out


def _state(held: pa.Table, inv: np.ndarray, w: np.ndarray, g: np.ndarray, d: np.ndarray, dots: list[float]) -> pa.Table:
    row = (held.column("part")[0].as_py(), -1, None, *[x.astype("f4").tobytes() for x in (inv, w, g, d)], [float(x) for x in dots])
    return pa.Table.from_batches([_batch("part block steps inv w g d dots", [row], [pa.int64(), pa.int64()] + [pa.binary()] * 5 + [pa.list_(pa.float64())])])
