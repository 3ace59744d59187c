"""Resamples by split counts against drawn rows: same distribution, repeatable, and indifferent to tasks."""

import numpy as np
import pytest

from tracewright.fixed import LABELS
from tracewright.operators import resample, stats


def labelled(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.choice(len(LABELS), n, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.06, 0.04])
    wrong = lambda share: np.where(rng.random(n) < share, rng.integers(0, len(LABELS), n), y)
    rows = [(i, LABELS[t], LABELS[a], LABELS[b], int(i % 4 == 0)) for i, (t, a, b) in enumerate(zip(y, wrong(0.5), wrong(0.4)))]
    return spark.createDataFrame(rows, "run_id long, y string, a string, b string, half int")


def test_split_counts_have_the_moments_of_drawn_rows():
    sizes = np.array([50, 0, 7, 1, 30, 12, 900])
    got = resample.split_counts(sizes, 40_000, np.random.default_rng(1))
    n = sizes.sum()
    assert (got.sum(1) == n).all() and (got[:, 1] == 0).all() and (got >= 0).all()
    p = sizes / n
    assert np.allclose(got.mean(0), sizes, atol=0.2)
    want = n * (np.diag(p) - np.outer(p, p))
    assert np.allclose(np.cov(got.T), want, atol=2.5)
    assert resample.split_counts(np.array([5]), 3, np.random.default_rng(1)).tolist() == [[5]] * 3


def test_quantiles_agree_with_drawn_rows(spark):
    df = labelled(spark)
    rows = np.array([r.delta for r in stats.bootstrap_deltas(df, 2000, 7).collect()])
    split = np.array([r.delta for r in resample.split_bootstrap(df, ["y", "a", "b"], resample.macro_f1_delta(LABELS), 20_000, 7).collect()])
    assert len(split) == 20_000
    assert abs(rows.mean() - split.mean()) < 4 * rows.std() / np.sqrt(2000)
    assert abs(rows.std() / split.std() - 1) < 0.08
    for q in (0.025, 0.25, 0.5, 0.75, 0.975):
        assert abs(np.quantile(rows, q) - np.quantile(split, q)) < 0.25 * split.std()


def test_groups_repeat_exactly_on_any_number_of_tasks(spark):
    df = labelled(spark)
    get = lambda d, groups=(): {tuple(r) for r in resample.split_bootstrap(d, ["y", "a", "b"], resample.macro_f1_delta(LABELS), 500, 9, groups, block=64).collect()}
    both = get(df, ["half"])
    assert len(both) == 1000 and both == get(df.repartition(5), ["half"])
    assert get(df) == get(df.repartition(7))
    assert {h for h, _, _ in both} == {0, 1}


def test_recall_and_summary(spark):
    df = labelled(spark)
    some = stats.many_recall_resamples(df, LABELS[1], 4000, 5).first()
    own = df.filter(f"y = '{LABELS[1]}'").toPandas()
    assert some.mean_delta == pytest.approx((own.b == own.y).mean() - (own.a == own.y).mean(), abs=0.01)
    whole = stats.many_resamples(df, 4000, 5, ["half"]).collect()
    assert {r.half for r in whole} == {0, 1} and all(r.lo < r.mean_delta < r.hi and r.replicates == 4000 for r in whole)
