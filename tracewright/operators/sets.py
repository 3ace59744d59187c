"""Set operations on words, ids and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import content_words
from tracewright.sources.traces import Traces


def goal_word_sets(tr: Traces) -> DataFrame:
    w = content_words(F.col("text"))
    m = tr.plain_messages.select("run_id", "t", w.alias("w")).join(tr.runs.select("run_id", "goal_words"), "run_id")
    return m.select("run_id", "t", F.size(F.array_intersect("goal_words", "w")).alias("shared"),
                    F.size(F.array_except("goal_words", "w")).alias("only_goal"), F.size(F.array_union("goal_words", "w")).alias("either"))


def id_differences(left: DataFrame, right: DataFrame, key: str = "run_id") -> DataFrame:
    a, b = left.select(key).distinct(), right.select(key).distinct()
    dup = left.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(key)
    return (a.exceptAll(b).withColumn("side", F.lit("only_left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right")))
            .unionByName(dup.withColumn("side", F.lit("duplicate"))))


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables has."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def column_differences(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Largest absolute difference and number of differing rows per column."""
    j = a.select(*keys, *cols).join(b.select(*keys, *[F.col(c).alias(f"{c}__b") for c in cols]), keys)
    long = j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(c).cast("double") - F.col(f"{c}__b").cast("double")).alias("d"))
                                        for c in cols])).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.max("d").alias("max_diff"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("n_diff"))


def fold_violations(folds: DataFrame, ids: DataFrame, k: int, key: str = "run_id") -> DataFrame:
    """Ids not held exactly once, unknown ids, and empty folds; empty when the partition is sound."""
    held = folds.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    j = ids.select(key, F.lit(1).alias("known")).join(held, key, "full")
    rows = j.filter("known is null or c is null or c <> 1").select(F.col(key).cast("string").alias("what"), F.when(
        F.col("known").isNull(), "unknown id").when(F.col("c").isNull(), "never held").otherwise("held more than once").alias("problem"))
    every = folds.sparkSession.range(k).select(F.col("id").cast("string").alias("what"))
    empty = every.join(folds.select(F.col("fold").cast("string").alias("what")).distinct(), "what", "left_anti").withColumn("problem", F.lit("empty fold"))
    return rows.unionByName(empty)


def owners_without_block(owners: DataFrame, blocks: DataFrame, key: str = "run_id") -> DataFrame:
    """Groups that own rows but get no block, with their row counts."""
    return owners.groupBy(key).agg(F.count(F.lit(1)).alias("rows_lost")).join(blocks.select(key).distinct(), key, "left_anti")
