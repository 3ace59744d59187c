"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hardnegatives as hn


def direct(rows, positives=5, negatives=10):
    rows = sorted({(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows
                   if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}, key=lambda r: r[0])
    out = []
    for i, label, q in (r for r in rows if r[0] % 10 == 0):
        score = [(sum(a * b for a, b in zip(q, v)), j, l == label) for j, l, v in rows if j != i]
        order = sorted(score, key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in order if s[2]][:positives]:
            fits = [s for s in order if not s[2] and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(i, j, k + 1, s[1], p, s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def table(spark, rows, label="int"):
    return spark.createDataFrame([(*r, 7, b"x") for r in rows], f"vec_id bigint, embedding array<float>, label {label}, id int, vec binary").repartition(3)


def sample(n, seed, width=12, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.4, (n, width)) + rng.normal(0, 1, (6, width))[rng.integers(0, 6, n)]
    x[: n // 5] = x[0]  # a group of copies
    if grid:
        x = np.round(x * grid) / grid
    return [(i - 20, [float(v) for v in row.astype(np.float32)], int(rng.integers(0, 4))) for i, row in enumerate(x)]


@pytest.mark.parametrize("rows, how", [
    (sample(400, 1), {"block": 20, "pack": 3, "entries": (5, 5)}),
    (sample(300, 2, grid=1), {"block": 7, "pack": 100}),
    (sample(120, 3, width=5), {"entries": (2, 2)}),
    ([(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.4, 9.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, 3.0], 3)], {}),
])
def test_equals_all_scores(spark, rows, how):
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, **how)
    assert sorted(map(tuple, got.collect())) == direct(rows)


def test_cells_come_by_falling_bounds_and_hold_all_scores():
    rng = np.random.default_rng(4)
    first, second = rng.normal(size=7), rng.normal(size=5)
    order = list(hn.in_order(first, second))
    assert [s for s, _, _ in order] == sorted((a + b for a in first for b in second), reverse=True) and len({(i, j) for _, i, j in order}) == 35
    x = rng.integers(-300, 300, (500, 6)).astype(np.float64)
    books = [hn._fitted(x[:, :3], 4), hn._fitted(x[:, 3:], 4)]
    near = [hn._nearest(x[:, :3], books[0]), hn._nearest(x[:, 3:], books[1])]
    radii = [np.array([r[n == e].max(initial=0) for e in range(4)]) for n, r in near]
    index = hn.Index(books, radii, np.arange(16), 6)
    for q in x[:20]:
        (up, down), (up2, down2) = index.bounds(q)
        score = x @ q
        assert (score <= up[near[0][0]] + up2[near[1][0]]).all() and (score >= down[near[0][0]] + down2[near[1][0]]).all()


def test_search_stops_before_all_cells(spark):
    rng = np.random.default_rng(6)
    centre = np.eye(16) * 4 + np.roll(np.eye(16), 1, 1) * 2
    at = rng.integers(0, 16, 3000)
    rows = [(i, [float(v) for v in (centre[a] + rng.normal(0, 0.01, 16)).astype(np.float32)], int(a % 3)) for i, a in enumerate(at)]
    looked = []
    plain, hn.released = hn.released, lambda *t: looked.extend(sum(len(r.cells) for r in x.select("cells").collect()) for x in t if "cells" in x.columns) or plain(*t)
    try:
        got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 500 == 0)
        got = got.collect()
    finally:
        hn.released = plain
    assert got and 0 < sum(looked) < 300, looked  # six anchors, two searches, up to 49 cells: 588


def test_rows_that_take_no_part(spark):
    good = sample(60, 7)
    bad = [(None, [0.5] * 12, 1), (500, None, 1), (510, [], 1), (520, [0.5] * 12, None), (530, [math.nan] * 12, 1), (540, [None] + [0.5] * 11, 1), (550, [math.inf] * 12, 1), (560, [9.0] * 3, 1)]
    got = hn.hard_negatives(table(spark, good + bad + good[:9]), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == direct(good)
    named = hn.hard_negatives(table(spark, [(i, v, f"l{l}") for i, v, l in good], "string"), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, named.collect())) == direct(good)
    assert hn.hard_negatives(table(spark, bad), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
