"""Fold assignment and resampling that repeat exactly: every choice comes from md5 of seed and id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tracewright.functions.text import md5_int
from tracewright.plans.scan import ranked

#: Of true label and two predictions there are 7 x 7 x 7.
MOST_CELLS = 1000


def seeded(seed: int | str, *cols: str) -> Column:
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def stratified_folds(df: DataFrame, k: int, seed: int, within: list[str] = (), label: str = "label", key: str = "run_id") -> DataFrame:
    """Fold 0..k-1 by rank of md5 inside each label (and inside ``within``).

    The rank is a chunked scan over md5 prefixes, so a label with a third of
    all runs is ranked by many tasks.
    """
    d = df.select(key, label, *within).withColumn("__h", seeded(seed, key))
    prefix = F.conv(F.substring("__h", 1, 3), 16, 10).cast("long")
    r = ranked(d, [*within, label], ["__h", key], "__r", chunk=prefix)
    return r.select(key, label, *within, (F.col("__r") % k).alias("fold"))


def grouped_folds(parents: DataFrame, copies: DataFrame, k: int, seed: int) -> DataFrame:
    """Copies (view_id, parent_id) take the fold of their parent run."""
    f = stratified_folds(parents, k, seed).select("run_id", "fold")
    own = f.select(F.col("run_id").cast("string").alias("view_id"), F.col("run_id").alias("parent_id"), "fold")
    return own.unionByName(copies.join(f.withColumnRenamed("run_id", "parent_id"), "parent_id").select("view_id", "parent_id", "fold"))


def nested_folds(df: DataFrame, outer: int, inner: int, seed: int) -> DataFrame:
    """Inner folds of the runs that each outer fold may fit on: (outer, run_id, fold)."""
    o = stratified_folds(df, outer, seed)
    fit = o.select("run_id", "label", F.explode(F.filter(F.sequence(F.lit(0), F.lit(outer - 1)).cast("array<bigint>"),
                                                        lambda x: x != F.col("fold"))).alias("outer_fold"))
    return stratified_folds(fit, inner, seed + 1, within=["outer_fold"])


def bootstrap_cells(df: DataFrame, cells: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, *cells, times): rows drawn with replacement, repeatably, as counts of the cells they fall in.

    Rows are thought of in order of their cell, so draw i of replicate b, md5(seed, b, i) mod n, tells the cell without
    meeting a row. Draws are counted where they are made: what is shuffled is one count for each replicate and cell.
    ``cells`` are class labels, so there are few combinations; more than ``MOST_CELLS`` are refused.
    """
    spark = df.sparkSession
    found = counted_cells(df, cells)
    n = sum(r.n for r in found)
    ends = [sum(r.n for r in found[: i + 1]) for i in range(len(found))]
    draws = spark.range(0, n * replicates).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), F.pmod("id", F.lit(max(n, 1))).alias("i"))
    d = F.pmod(md5_int(F.concat_ws("_", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string"))), F.lit(max(n, 1)))
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    # the draw is bound by the outer lambda: written into the inner one, its hash would be taken again for every bound
    cell = F.element_at(F.transform(F.array(d), lambda x: F.size(F.filter(bounds, lambda e: e <= x))), 1)
    times = draws.select("replicate", cell.alias("cell")).groupBy("replicate", "cell").agg(F.count(F.lit(1)).alias("times"))
    named = spark.createDataFrame([(i, *[r[c] for c in cells]) for i, r in enumerate(found)], StructType([StructField("cell", IntegerType()), *[df.schema[c] for c in cells]]))
    return times.join(named, "cell").select("replicate", *cells, "times")


def counted_cells(df: DataFrame, cells: list[str]) -> list:
    """Rows (*cells, n) in the order of the cells; at most ``MOST_CELLS``."""
    found = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).orderBy(*cells).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of {cells}")
    return found


def split_counts(sizes: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """(replicate, cell): resamples of ``sizes.sum()`` rows as counts of cells, without drawing rows.

    A binary tree over the cells: the root has all rows, and each node's rows are split between its halves by one
    binomial draw with the halves' shares. The leaves have the distribution of rows drawn with replacement.
    """
    totals = [sizes.astype(np.int64)]
    while len(totals[0]) > 1:
        low = totals[0]
        totals.insert(0, low[0::2] + np.r_[low[1::2], np.zeros(len(low) % 2, np.int64)])
    counts = np.full((replicates, 1), sizes.sum(), np.int64)
    for upper, lower in zip(totals, totals[1:]):
        left = lower[0::2]
        share = np.divide(left, upper, out=np.zeros(len(left)), where=upper > 0)
        first = rng.binomial(counts, share)
        counts = np.stack([first, counts - first], 2).reshape(replicates, -1)[:, : len(lower)]
    return counts


def split_bootstrap(df: DataFrame, cells: list[str], statistic: Callable[[np.ndarray], np.ndarray], replicates: int, seed: int, groups: list[str] = (), block: int = 1024) -> DataFrame:
    """(*groups, replicate, delta): a statistic of the counts (replicate, cell) of each resample of each group's rows.

    Cost is replicates x cells, whatever the number of rows. ``statistic`` gets counts in the order of all cells that occur,
    the ones of other groups being zero. Each block of replicates is seeded by seed, group and block, so results repeat on
    any number of tasks. Groups are few (slices); groups x cells are bounded like cells.
    """
    spark = df.sparkSession
    found = counted_cells(df, [*groups, *cells])
    names = sorted({tuple(r[c] for c in cells) for r in found}, key=str)
    kinds = sorted({tuple(r[g] for g in groups) for r in found}, key=str)
    sizes = np.zeros((len(kinds), len(names)), np.int64)
    for r in found:
        sizes[kinds.index(tuple(r[g] for g in groups)), names.index(tuple(r[c] for c in cells))] = r.n
    of = statistic(names)
    blocks = -(-replicates // block)

    def drawn(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                g, b = divmod(i, blocks)
                some = min(block, replicates - b * block)
                delta = of(split_counts(sizes[g], some, np.random.default_rng([seed, g, b])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some, g, np.int32)), pa.array(np.arange(some) + b * block), pa.array(delta.astype(np.float64))], ["g", "replicate", "delta"])

    tasks = max(1, min(len(kinds) * blocks, 4 * spark.sparkContext.defaultParallelism))
    out = spark.range(0, len(kinds) * blocks, 1, tasks).mapInArrow(drawn, "g int, replicate bigint, delta double")
    if not groups:
        return out.drop("g")
    named = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], StructType([StructField("g", IntegerType()), *[df.schema[g] for g in groups]]))
    return out.join(named, "g").select(*groups, "replicate", "delta")


def macro_f1_delta(labels: list[str]) -> Callable:
    """Statistic for cells (y, a, b): macro F1 of b minus that of a, over the classes present in the resample."""

    def of(names: list[tuple]) -> Callable[[np.ndarray], np.ndarray]:
        is_ = [np.array([[n[k] == c for c in labels] for n in names], np.float64).reshape(-1, len(labels)) for k in range(3)]

        def delta(counts: np.ndarray) -> np.ndarray:
            support = counts @ is_[0]
            score = []
            for k in (1, 2):
                whole = counts @ is_[k] + support
                f1 = np.divide(2 * (counts @ (is_[k] * is_[0])), whole, out=np.zeros_like(whole), where=whole > 0)
                score.append((f1 * (support > 0)).sum(1) / np.maximum((support > 0).sum(1), 1))
            return score[1] - score[0]

        return delta

    return of


def recall_delta(label: str) -> Callable:
    """Statistic for cells (y, a, b) of rows of one true label: recall of b minus that of a."""

    def of(names: list[tuple]) -> Callable[[np.ndarray], np.ndarray]:
        gain = np.array([(n[2] == label) * 1.0 - (n[1] == label) for n in names])
        return lambda counts: counts @ gain / np.maximum(counts.sum(1), 1)

    return of
