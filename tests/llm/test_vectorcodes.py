"""Vector codes against plain rounds over all vectors and entries."""

import math

import numpy as np
import pytest

from tracewright.llm import vectorcodes as vc


def plain(rows, parts=8, size=16, rounds=6, scale=4096):
    rows = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(scale * v) for v in r[1]] for r in rows], dtype=object).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    cut = x.reshape(len(rows), parts, -1)
    books = cut[order[:size]].transpose(1, 0, 2).copy()

    def nearest():
        return ((cut[:, :, None] - books[None]) ** 2).sum(3).argmin(2)

    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    code = nearest()
    error = ((cut - books[np.arange(parts), code]) ** 2).sum((1, 2))
    return [(rows[i][0], "".join(f"{c:02x}" for c in code[i]), int(error[i]), rows[i][2]) for i in range(len(rows))], books


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, id int, code string").repartition(3)


def sample(n, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, 16)).astype(np.float32)
    x[: n // 4] += rng.integers(-2, 3, (n // 4, 1)).astype(np.float32)
    if grid:
        x = np.round(x * grid) / grid  # many ties
    return [(i, [float(v) for v in row], [None, 1, 2][i % 3]) for i, row in enumerate(x)]


@pytest.mark.parametrize("rows, chunk, leaf", [(sample(700, 1), 64, 4), (sample(700, 2, 2), 100, 8), (sample(9, 3), 4096, 32), (sample(300, 4, 1) + sample(300, 4, 1), 50, 3)])
def test_equals_plain_rounds(spark, rows, chunk, leaf):
    coded, books = vc.compress(table(spark, rows), chunk=chunk, leaf=leaf)
    want, want_books = plain(rows)
    assert (books == want_books).all()
    assert sorted(map(tuple, coded.select("id", "code", "error", "label").collect()), key=str) == sorted(want, key=str)


def test_whole_nodes_are_assigned_by_their_sums():
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 3, (4000, 2)) + rng.integers(0, 4, (4000, 1)) * 100).astype(np.int64)
    books = np.array([[0, 0], [100, 100], [200, 200], [300, 300]])
    tree = vc.grow(x, 32)
    tree_points = tree.points.copy()
    codes, sums, counts = vc.assign(tree, vc.grow(books, 1))
    want = ((tree_points[:, None] - books) ** 2).sum(2).argmin(1)
    assert (codes == want).all() and counts.sum() == 4000
    assert all((sums[e] == tree_points[want == e].sum(0)).all() for e in range(4))
    calls = []
    tree.points = Watched(tree.points, calls)
    vc.assign(tree, vc.grow(books, 1))
    assert sum(calls) < 1000  # most points are never looked at


class Watched:
    def __init__(self, x, calls):
        self.x, self.calls, self.shape = x, calls, x.shape

    def __len__(self):
        return len(self.x)

    def __getitem__(self, at):
        self.calls.append(len(self.x[at]))
        return self.x[at]


def test_rows_that_take_no_part(spark):
    good = sample(40, 6)
    bad = [(100, None, 1), (101, [], 1), (102, [0.5] * 15 + [None], 2), (103, [math.nan] + [0.0] * 15, 2), (104, [math.inf] * 16, None), (105, [0.25] * 8, 1), (-5, None, 1)]
    got = vc.compress_with_errors(table(spark, good + bad)).collect()
    want, books = plain(good)
    by = {r.vec_id: r for r in got}
    assert len(got) == 40 and {(i, by[i].code, by[i].error) for i in by} == {(i, c, e) for i, c, e, _ in want}
    label = {i: l for i, _, l in good}
    for i, r in by.items():
        assert r.label_error == sum(e for _, _, e, l in want if l == label[i])
        assert r.codebooks_sha256 == vc.digest(books)
    assert vc.compress_with_errors(table(spark, bad[:1])).count() == 0
    with pytest.raises(ValueError):
        vc.compress(table(spark, [(1, [0.5] * 9, 1)]))
    doubles, _ = vc.compress(table(spark, [(None, [0.5] * 16, 1), (None, [0.5] * 16, 1), (3, [1.0] * 16, 1)], "double"))
    assert sorted((r.id is None, r.code[:2]) for r in doubles.collect()) == [(False, "00"), (True, "01"), (True, "01")]
