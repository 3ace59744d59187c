"""Cleaning of a document table in stages; each stage's rows are written and read again before the next one.

Every stage but the last returns the columns of ``documents``. Texts may be
null or empty, rows may repeat and the table may be empty; what then happens is
said at each operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, langid, linededup, neardup, pieces
from tracewright.llm.common import small_batches, table, written

TOKENIZER = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. The network learns from the stage's own labelled rows outside the held-out fold."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three lines go; a document of which nothing is left goes with them."""
    return linededup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are at least 0.8 similar the document with the smallest id stays."""
    return neardup.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether decoding these gives the text back."""
    model = pieces.load(public_tokenizers.path(TOKENIZER))
    rows = small_batches(docs).select(F.struct("*").alias("row"))
    text = F.col("row").getField("text")
    rows = rows.select("row", pieces.encoding(text, model)["ids"].alias("ids"))
    same = pieces.decoding(F.col("ids"), model) == F.replace(text, F.lit(pieces.MARK), F.lit(" "))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("ids", "n_ids", "round_trip")]
    return rows.select(*own, "ids", F.size("ids").cast("long").alias("n_ids"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_encoding", encode),
]

#: SQL cannot express the fingerprints, the network or the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
