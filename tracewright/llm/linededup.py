"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines that are not blank make a window. A window found
before, in an earlier document or earlier in the same one, covers its lines; the
covered positions of a document are merged and those lines removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keyed, same_key, small_batches, unpack, written

WINDOW = 3


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> a row for each window: 128 bits of its lines' hash, the key, first and last line number."""
    for batch in batches:
        rows, hashes, first, last = [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            lines = [x.strip() for x in (text or b"").split(b"\n")]
            filled = [j for j, x in enumerate(lines) if x]
            for a in range(len(filled) - size + 1):
                at = filled[a : a + size]
                hashes.append(xxhash.xxh3_128_digest(b"\n".join([lines[j] for j in at])))
                first.append(at[0])
                last.append(at[-1])
                rows.append(i)
        h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("k1").take(at), batch.column("k2").take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
            ["h1", "h2", "k1", "k2", "at", "to"])


def _place() -> Column:
    """Order of windows: by document id (null first), then by the text's hash, then by line."""
    return F.struct(F.col("k1").isNotNull().alias("known"), "k1", "k2", "at")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(k1, k2, spans)``: for each document with repeated windows, their first and last line numbers."""
    whole = keyed(small_batches(docs), id_col, text_col)
    kind = dict(whole.dtypes)["k1"]
    found = whole.select("k1", "k2", F.col("row").getField(text_col).alias("text")).mapInArrow(
        lambda it: _windows(it, size), f"h1 bigint, h2 bigint, k1 {kind}, k2 bigint, at int, to int")
    found = written(found, "windows")
    repeated = found.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeated = written(repeated, "repeated")
    later = found.join(repeated.hint("merge"), ["h1", "h2"]).filter(_place() > F.col("first"))
    return later.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "to")).alias("spans"))


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(text.to_pylist(), spans.to_pylist()):
        if t is None:
            out.append(None)
            continue
        lines = t.split("\n")
        gone = np.zeros(len(lines) + 1, np.int64)
        for x in s:
            gone[x["at"]] += 1
            gone[x["to"] + 1] -= 1
        left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        out.append({"text": "\n".join([lines[i] for i in left]), "removed": len(lines) - len(left)})
    return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.int64())]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: the input row, its text without repeated windows, and the counts of lines.

    * Lines are parted by line feeds and compared without outer ASCII white space; blank lines count for no window and go
      only between two lines of a removed window. Texts of fewer than three filled lines stay as they are.
    * The first occurrence by (id, hash of the text, line) stays; a null id comes first. Rows that repeat id and text are
      one document and get the same result. A null text stays null, with 0 lines. An empty table gives no rows.
    * Joins are sort-merge joins at every size: spans grow with the documents, so no size lets them be broadcast.
    * A document made of nothing but later occurrences gets an empty text; it is not dropped here.
    """
    whole = keyed(docs, id_col, text_col)
    spans = written(covered(docs, id_col, text_col, size), "spans")
    both = whole.join(spans.hint("merge"), same_key(whole, spans), "left").select("row", "spans")
    text = F.col("row").getField(text_col)
    cut = F.arrow_udf(_without, "struct<text:string,removed:bigint>")(F.when(F.col("spans").isNotNull(), text), F.col("spans"))
    done = both.select("row", cut.alias("cut"))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return done.select("row", F.coalesce("cut.text", text).alias("text"), lines.cast("long").alias("n_lines"),
                       F.coalesce("cut.removed", F.lit(0)).cast("long").alias("n_removed"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", size: int = WINDOW) -> DataFrame:
    """The documents with repeated passages removed, in the input's columns; those that lost every filled line are dropped.

    The character count, where the table has one, follows the text; untouched rows keep theirs.
    """
    out = dedup_lines(docs, id_col, text_col, size)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text_col: F.col("text")}
    if chars_col in docs.columns:
        old = F.col("row").getField(chars_col)
        changed[chars_col] = F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)[chars_col])).otherwise(old)
    return unpack(out, docs, **changed)
