"""Resampling tests, paired tests, correlations and shift reports over result tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.fixed import LABELS
from tracewright.functions.numbers import count_where, finite, flag, ratio
from tracewright.functions.text import md5_int
from tracewright.operators.evaluate import macro_f1
from tracewright.operators.resample import bootstrap_cells, macro_f1_delta, recall_delta, split_bootstrap
from tracewright.plans.scan import chunk_of, percentiles, ranked, running
from tracewright.session import written


def _one() -> Column:
    return F.count(F.lit(1))


def value_bucket(c: str) -> Column:
    """Monotone coarse bucket of a number, used to cut a ranking into chunks."""
    return F.floor(F.signum(c) * F.log1p(F.abs(F.col(c))) * 1024).cast("long")


def _summary(deltas: DataFrame, keys: list[str] = ()) -> DataFrame:
    # one row per replicate: written, so that the resampling runs once
    d = written(deltas.withColumn("delta", F.round("delta", 12)), "deltas")
    g = d.groupBy(*keys).agg(F.avg("delta").alias("mean_delta"), _one().alias("replicates"),
                             (2 * F.least(F.avg(flag(F.col("delta") <= 0)), F.avg(flag(F.col("delta") >= 0)))).alias("p"))
    q = percentiles(d, list(keys), "delta", {"lo": 0.025, "hi": 0.975})
    return g.join(q, list(keys)) if keys else g.withColumns({"lo": q.select("lo").scalar(), "hi": q.select("hi").scalar()})


def bootstrap_deltas(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Macro F1 of B minus A on every resample of the rows (df: run_id, y, a, b)."""
    cells = written(bootstrap_cells(df, ["y", "a", "b"], replicates, seed), "cells")
    w = F.col("times")
    a = macro_f1(cells, ["replicate"], yp="a", weight=w).withColumnRenamed("macro_f1", "fa")
    b = macro_f1(cells, ["replicate"], yp="b", weight=w).withColumnRenamed("macro_f1", "fb")
    return a.join(b, "replicate").select("replicate", (F.col("fb") - F.col("fa")).alias("delta"))


def bootstrap_test(df: DataFrame, replicates: int, seed: int) -> DataFrame:
    return _summary(bootstrap_deltas(df, replicates, seed))


def recall_bootstrap(df: DataFrame, label: str, replicates: int, seed: int) -> DataFrame:
    """Difference of recall on the rows of one true label, resampled inside those rows."""
    pos = df.filter(F.col("y") == label)
    c = bootstrap_cells(pos, ["y", "a", "b"], replicates, seed)
    hit = lambda m: F.sum(F.when(F.col(m) == label, F.col("times")).otherwise(0)) / F.sum("times")
    return _summary(c.groupBy("replicate").agg((hit("b") - hit("a")).alias("delta")))


def many_resamples(df: DataFrame, replicates: int, seed: int, groups: list[str] = ()) -> DataFrame:
    """As ``bootstrap_test`` for any number of rows and replicates, and for each group: counts are split, rows are not drawn.

    The draws are others than those of ``bootstrap_test``; their distribution is the same.
    """
    return _summary(split_bootstrap(df, ["y", "a", "b"], macro_f1_delta(LABELS), replicates, seed, groups), groups)


def many_recall_resamples(df: DataFrame, label: str, replicates: int, seed: int) -> DataFrame:
    """As ``recall_bootstrap``, by split counts."""
    return _summary(split_bootstrap(df.filter(F.col("y") == label), ["y", "a", "b"], recall_delta(label), replicates, seed))


def fold_bootstrap(deltas: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Resampled mean of per-fold deltas (deltas: fold 0..k-1, delta)."""
    k = deltas.select(_one()).scalar()
    draws = deltas.select(F.col("fold").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    d = F.pmod(md5_int(F.concat_ws("_", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string"))), k)
    x = draws.select("replicate", d.alias("fold")).join(deltas.select("fold", "delta"), "fold")
    return _summary(x.groupBy("replicate").agg(F.avg("delta").alias("delta")))


def mcnemar(df: DataFrame) -> DataFrame:
    """Exact two-sided McNemar test; the binomial tail is a running sum of log ratios."""
    y, a, b = F.col("y"), F.col("a"), F.col("b")
    c = df.agg(count_where((b == y) & (a != y)).alias("fixed"), count_where((a == y) & (b != y)).alias("broke"))
    c = c.withColumns({"n": F.col("fixed") + F.col("broke"), "m": F.least("fixed", "broke")})
    size = 65536
    # 0..m in two explodes, so no row ever holds more than one chunk of the sequence
    k = c.select("n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / size))).alias("c"))
    k = k.select("n", "m", F.explode(F.sequence(F.col("c") * size, F.least(F.col("m"), F.col("c") * size + size - 1))).alias("k"))
    step = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.log((F.col("n") - F.col("k") + 1) / F.col("k")))
    s = running(k.withColumn("__g", F.lit(0)), ["__g"], ["k"], {"lc": ("sum", step)}, pos="k")
    tail = s.agg(F.sum(F.exp(F.col("lc") - F.col("n") * math.log(2.0))).alias("cdf"))
    p = F.least(F.lit(1.0), F.lit(2.0) * tail.scalar())
    return c.select("fixed", "broke", (F.col("fixed") - F.col("broke")).alias("net"), p.alias("p"))


def paired_summary(deltas: DataFrame) -> DataFrame:
    """Mean, spread, wins and t statistic of paired differences (one row per seed)."""
    g = deltas.agg(_one().alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("std"), F.min("delta").alias("min"),
                   F.max("delta").alias("max"), count_where(F.col("delta") > 0).alias("wins"))
    m = percentiles(deltas, [], "delta", {"median": 0.5}).scalar()
    return g.select("*", m.alias("median"), ratio("mean", F.col("std") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))


def wilcoxon_exact(deltas: DataFrame) -> DataFrame:
    """Exact signed-rank test: the distribution of the rank sum, one rank after the other.

    For differences of seeds or folds, one row each, which meet in one place; n of them cost n steps over their rank sums.
    """
    d = deltas.select(F.round("delta", 9).alias("d")).filter("d <> 0")
    w = Window.partitionBy().orderBy(F.abs("d"))
    r = d.withColumn("lo", F.rank().over(w)).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(F.abs("d"))))
    r = r.select("d", (F.col("lo") + (F.col("ties") - 1) / 2).alias("rank"))
    s = r.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum("rank").alias("total"), _one().alias("n"),
              F.sort_array(F.collect_list("rank")).alias("ranks"))
    # ranks are halves at the finest: element i holds the probability that twice the sum is i
    none = lambda k: F.array_repeat(F.lit(0.0), (2 * k).cast("int"))
    chance = F.aggregate("ranks", F.array(F.lit(1.0)), lambda acc, x: F.zip_with(
        F.concat(acc, none(x)), F.concat(none(x), acc), lambda out, plus: (out + plus) / 2))
    low = F.least(F.col("w_plus"), F.col("total") - F.col("w_plus"))
    tail = s.select("n", "w_plus", "total", low.alias("low"), F.posexplode(chance).alias("twice", "pr"))
    got = F.col("twice") / 2
    return tail.groupBy("n", "w_plus").agg(F.sum(F.when(F.least(got, F.col("total") - got) <= F.col("low"), F.col("pr")).otherwise(0.0)).alias("p"))


def strongest_correlations(block: DataFrame, target: str, cols: list[str], top: int = 5) -> DataFrame:
    """Largest absolute Pearson and Spearman correlations of ``target`` with the columns of a block.

    Ranks follow value and then run id. A ranking is cut into chunks by value and,
    as most values of a column may be equal, by ranges of run id inside a value.
    """
    r9 = [F.round(F.col(c).cast("double"), 9).alias(c) for c in [target, *cols]]
    x = block.select("run_id", *r9)
    # a constant column has no correlation: null here, where F.corr would divide by zero
    pearson = lambda c: F.try_divide(F.covar_pop(target, c), F.stddev_pop(target) * F.stddev_pop(c))
    pear = x.select(*[pearson(c).alias(c) for c in cols]).unpivot([], cols, "feature", "pearson")
    long = x.unpivot(["run_id"], [target, *cols], "feature", "value")
    rk = ranked(long, ["feature"], ["value", "run_id"], "r", chunk=F.struct(value_bucket("value").alias("v"), "value", chunk_of(long, "run_id").alias("i"))).select("run_id", "feature", "r")
    me = rk.filter(F.col("feature") == target).select("run_id", F.col("r").alias("r0"))
    spear = rk.filter(F.col("feature") != target).join(me, "run_id").groupBy("feature").agg(F.corr("r", "r0").alias("spearman"))
    j = pear.join(spear, "feature").select("feature", F.abs(finite("pearson")).alias("pearson"), F.abs(finite("spearman")).alias("spearman"))
    return j.orderBy(F.round("pearson", 6).desc(), "feature").limit(top)


def column_fingerprints(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select("run_id", *[F.round(F.col(c).cast("double") * 1e6).cast("long").alias(c) for c in cols]).unpivot(["run_id"], cols, "feature", "v")
    return long.groupBy("feature").agg(F.sum(md5_int(F.concat_ws("|", F.col("run_id").cast("string"), F.col("v").cast("string"))).cast("decimal(20,0)")).alias("print"))


def identical_columns(df: DataFrame, cols: list[str], fingerprints: Callable = column_fingerprints) -> DataFrame:
    """Groups of columns with the same values (to six digits) in every run: ``(first, n, columns)``.

    Fingerprints only propose: each proposed class is split by comparing its columns with its first one, all classes in one
    pass over the rows, and what differs is split again until nothing does. Colliding fingerprints cost passes, not truth.
    """
    proposed: dict = {}
    for r in fingerprints(df, cols).collect():  # one row for each column
        proposed.setdefault(r["print"], []).append(r.feature)
    todo, classes = [sorted(c) for c in proposed.values() if len(c) > 1], []
    number = lambda c: F.round(F.col(c).cast("double") * 1e6).cast("long")
    while todo:
        pairs = [(c[0], other) for c in todo for other in c[1:]]
        row = df.agg(*[F.sum(flag(~number(a).eqNullSafe(number(b)))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
        apart = {b for i, (_, b) in enumerate(pairs) if row[i]}
        classes += [c for c in ([x for x in group if x not in apart] for group in todo) if len(c) > 1]
        todo = [c for c in ([x for x in group if x in apart] for group in todo) if len(c) > 1]
    table = [(c[0], len(c), c) for c in classes]
    return df.sparkSession.createDataFrame(table, "first string, n int, columns array<string>")


def shift_report(df: DataFrame, part: Column, cols: list[str], top: int = 20) -> DataFrame:
    """Mean and median of every column in two parts and the relative shift of the mean."""
    long = df.withColumn("test", part).unpivot(["run_id", "test"], cols, "feature", "value")
    g = long.groupBy("feature").agg(F.avg(F.when(~F.col("test"), F.col("value"))).alias("train_mean"), F.avg(F.when(F.col("test"), F.col("value"))).alias("test_mean"))
    q = percentiles(long, ["feature", "test"], "value", {"m": 0.5})
    q = q.groupBy("feature").agg(F.max(F.when(~F.col("test"), F.col("m"))).alias("train_median"), F.max(F.when(F.col("test"), F.col("m"))).alias("test_median"))
    rel = (F.col("test_mean") - F.col("train_mean")) / (F.abs("train_mean") + 1e-9)
    return g.join(q, "feature").withColumn("rel_shift", rel).orderBy(F.round(F.abs("rel_shift"), 6).desc(), "feature").limit(top)


def matched_control(df: DataFrame, metrics: list[str], smallest: int = 5) -> DataFrame:
    """Mean difference of each metric between two arms inside strata of length tercile x topology x team size.

    df: run_id, n, topo_type, n_agents, arm ("right"/"wrong") and the metrics.
    """
    t = percentiles(df, [], "n", {"q1": 0.333, "q2": 0.667})
    n = F.col("n")
    third = F.when(n < t.select("q1").scalar(), 0).when(n < t.select("q2").scalar(), 1).otherwise(2)
    long = df.withColumn("third", third).unpivot(["third", "topo_type", "n_agents", "arm"], metrics, "metric", "value")
    right = F.col("arm") == "right"
    s = long.groupBy("metric", "third", "topo_type", "n_agents").agg(
        count_where(right).alias("nr"), count_where(~right).alias("nw"),
        (F.avg(F.when(right, F.col("value"))) - F.avg(F.when(~right, F.col("value")))).alias("d")).filter(
            (F.col("nr") >= smallest) & (F.col("nw") >= smallest))
    return s.groupBy("metric").agg(_one().alias("strata"), F.avg("d").alias("mean_delta"), F.stddev_pop("d").alias("spread"),
                                   F.avg(flag(F.round("d", 9) > 0)).alias("positive_share"))


def fold_signs(df: DataFrame, metrics: list[str]) -> DataFrame:
    """In how many folds the right arm is above the wrong arm (df: fold, arm, metrics)."""
    long = df.unpivot(["fold", "arm"], metrics, "metric", "value")
    right = F.col("arm") == "right"
    f = long.groupBy("metric", "fold").agg((F.avg(F.when(right, F.col("value"))) - F.avg(F.when(~right, F.col("value")))).alias("d"))
    return f.groupBy("metric").agg(_one().alias("folds"), count_where(F.round("d", 9) > 0).alias("positive"), F.avg("d").alias("mean_delta"))


def error_pool(df: DataFrame, metric: str) -> DataFrame:
    """Rows of the wrong arm whose metric is above the median of the right arm (df: arm, metric)."""
    ref = percentiles(df.filter("arm = 'right'"), [], metric, {"m": 0.5}).scalar()
    w = df.filter("arm = 'wrong'").withColumn("ref", ref)
    return w.agg(_one().alias("wrong_rows"), count_where(F.col(metric) > F.col("ref")).alias("above"), F.max("ref").alias("reference"))
