"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import released, written  # noqa: F401

#: Bytes of one Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of this session by bytes, as texts differ in length by orders of magnitude."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_key(text: Column) -> Column:
    """Second part of a document's key: rows that share id and text are one document."""
    return F.xxhash64(text)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row as one struct beside its key, so that no column name of the input can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.col(f"`{id_col}`").alias("k1"), text_key(F.col(f"`{text_col}`")).alias("k2"), row.alias("row"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["k1"].eqNullSafe(b["k1"]) & (a["k2"] == b["k2"])


def unpack(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``like`` out of the struct ``row``; those named in ``changed`` are replaced."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in like.columns])
