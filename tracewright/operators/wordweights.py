"""TF-IDF of words and neighbouring pairs, counted by parts of the key space.

Terms are told apart by 64-bit keys: the hash of a word, and a mix of two for a
pair. A block of documents sends each part of the key space the distinct keys it
has, once and packed, and gets back which of them are terms and in how many
documents they occur; weights are made where the texts are. So no shuffle
carries a row for each term of a document. Two of m different terms share a
key with a chance of m * m / 2**65: one in 2000 for 130 million terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.session import written

#: Bytes of text in a block, for each part of the key space and in an Arrow batch; blocks in a file, whose rows are read at once.
BLOCK_BYTES, PART_BYTES, BATCH_BYTES, FILE_BLOCKS = 2 << 20, 12 << 20, 1 << 20, 4
_KNOWN = 1 << 17


class _Keys(dict):
    """Key of each word, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word)
        if len(self) < _KNOWN:
            self[word] = key
        return key


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second bytes, and so on: sorted or small numbers then compress well."""
    return x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def numbers(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(wide, len(data) // wide).T.copy().view(f">{kind}").ravel().astype(kind)


class _Terms:
    """Distinct keys of a block in order, and one entry for each (key, document): document, times and first place."""

    def __init__(self, texts: list[list[bytes | None]], known: _Keys):
        self.words: list[bytes] = []
        sizes, docs = [], []
        for d, some in enumerate(texts):
            for text in some or ():
                found = (text or b"").split()
                if found:
                    self.words += found
                    sizes.append(len(found))
                    docs.append(d)
        n = len(self.words)
        keys = np.fromiter(map(known.__getitem__, self.words), np.uint64, n)
        doc = np.repeat(np.array(docs, np.int32), sizes)
        last = np.zeros(n, bool)
        last[np.cumsum(np.array(sizes, np.int64)) - 1] = True
        left = np.flatnonzero(~last)
        keys = np.r_[keys, _pair_keys(keys[left], keys[left + 1])]
        doc = np.r_[doc, doc[left]]
        order = np.argsort(keys, kind="stable")  # documents of a key stay in order
        keys, doc, order = keys[order], doc[order], order.astype(np.int32)
        new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        entry = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]][: len(keys)])
        self.times = np.diff(np.r_[entry, len(keys)])
        self.doc, self.of = doc[entry], np.cumsum(new)[entry] - 1
        at = order[entry]
        self.pair = at >= n
        self.place = np.where(self.pair, left[np.maximum(at - n, 0)] if len(left) else 0, at)
        self.keys, self.docs = keys[new], np.bincount(self.of, minlength=int(new.sum()))

    def named(self, which: np.ndarray) -> pa.Array:
        """The terms of entries."""
        words = pa.array(self.words, pa.binary())
        place, pair = self.place[which], self.pair[which]
        out = words.take(pa.array(place))
        if pair.any():
            both = pc.binary_join_element_wise(words.take(pa.array(place[pair])), words.take(pa.array(place[pair] + 1)), b" ")
            out = pc.replace_with_mask(out, pa.array(pair), both)
        return out.cast(pa.string())


def _texts(column) -> list[list[bytes | None]]:
    return column.cast(pa.list_(pa.binary())).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, texts) of a task, some in a row."""
    task, number, held, have = TaskContext.get().partitionId() << 32, 0, [], 0

    def row() -> pa.RecordBatch:
        columns = [pa.concat_arrays([b.column(k) for b in held]) for k in range(2)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), *lists], ["block", "ids", "texts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += pc.sum(pc.binary_length(pc.list_flatten(batch.column(1)))).as_py() or 0
        if have >= size:
            yield row()
            held, have, number = [], 0, number + 1
    if held:
        yield row()


def _cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield int(part[a]), int(a), int(b)


def _asked(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each block with their documents, a row for each part of the key space."""
    known = _Keys()
    for batch in batches:
        for i in range(batch.num_rows):
            block, texts = batch.column(0)[i].as_py(), _texts(batch.column(1)[i].values)
            terms = _Terms(texts, known)
            del texts
            rows = [(p, block, planes(terms.keys[a:b]), planes(terms.docs[a:b].astype(np.uint32))) for p, a, b in _cuts(terms.keys, parts)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["part", "block", "keys", "docs"])


def _answered(table: pa.Table, least: int) -> pa.Table:
    """For each block which of its keys in this part are terms, in how many documents those occur, and their numbers in the part."""
    blocks = table.column("block").to_pylist()
    keys, docs = ([numbers(v, kind) for v in table.column(name).to_pylist()] for name, kind in (("keys", "u8"), ("docs", "u4")))
    ends = np.cumsum([len(k) for k in keys])
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(of, weights=np.concatenate(docs), minlength=len(every)).astype(np.int64)
    stay = df >= least
    number, size = np.cumsum(stay) - 1, int(stay.sum())
    rows = []
    for block, a, b in zip(blocks, [0, *ends[:-1]], ends):
        mine = of[a:b]
        kept = stay[mine]
        mine = mine[kept]
        steps = np.diff(number[mine], prepend=0)
        rows.append((table.column("part")[0].as_py(), block, size, len(kept), np.packbits(kept).tobytes(), planes(df[mine].astype(np.uint32)), planes(steps.astype(np.uint32))))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["part", "block", "size", "asked", "kept", "docs", "steps"])


def _weighed(block: pa.Table, answers: pa.Table, n_docs: int, first: dict[int, int] | None) -> tuple[pa.Array, _Terms, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, terms, the entries that have a weight, their weights, and the number of each key among all terms."""
    ids = block.column("ids").combine_chunks().flatten()
    terms = _Terms(_texts(block.column("texts").combine_chunks().flatten()), _Keys())
    kept, df, number = [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in sorted(answers.to_pylist(), key=lambda r: r["part"]):  # parts follow each other as keys do
        have = np.unpackbits(np.frombuffer(row["kept"], np.uint8), count=row["asked"]).astype(bool)
        kept.append(have)
        for out, fill in ((df, numbers(row["docs"], "u4")), (number, np.cumsum(numbers(row["steps"], "u4").astype(np.int64)) + (first or {}).get(row["part"], 0))):
            x = np.zeros(len(have), np.int64)
            x[have] = fill
            out.append(x)
    kept, df, number = (np.concatenate(x) for x in (kept, df, number))
    which = np.flatnonzero(kept[terms.of])
    of, doc = terms.of[which], terms.doc[which]
    w = (1 + np.log(terms.times[which])) * (np.log((1 + n_docs) / (1 + df[of])) + 1)
    size = np.sqrt(np.bincount(doc, weights=w * w, minlength=len(ids)))
    return ids, terms, which, w / size[doc], number


def weighed_block(block: pa.Table, answers: pa.Table, n_docs: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block's documents; for each entry its document, its place among the block's terms in order of their keys, and its weight."""
    ids, terms, which, w, _ = _weighed(block, answers, n_docs, None)
    place = np.full(len(terms.keys), -1)
    of = terms.of[which]
    used = np.unique(of)
    place[used] = np.arange(len(used))
    return ids, terms.doc[which], place[of], w


def _packed(block: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """The labelled documents of a block that have terms: how often each has which of the block's terms, and where these are."""
    texts = block.column("texts").combine_chunks().flatten()
    at, ys = (block.column(c)[0].as_py() for c in ("at", "ys"))
    ids, terms, which, _, number = _weighed(block, answers, 1, None)
    known = np.concatenate([np.zeros(0, np.int64)] + [_spread(r) for r in sorted(answers.to_pylist(), key=lambda r: r["part"])])
    doc, of, times = terms.doc[which], terms.of[which], terms.times[which]
    asked = np.zeros(len(texts), bool)
    asked[at] = True
    mine = asked[doc]
    order = np.lexsort((of[mine], doc[mine]))
    doc, of, times = doc[mine][order], of[mine][order], times[mine][order]
    have, counts = np.unique(doc, return_counts=True)
    used, col = np.unique(of, return_inverse=True)
    row = np.full(len(texts), -1)
    row[have] = np.arange(len(have))
    labelled = [(int(row[a]), int(y)) for a, y in zip(at, ys) if row[a] >= 0]
    cuts = [{"part": p, "n": b - a, "steps": planes(np.diff(number[used[a:b]], prepend=0).astype(np.uint32))} for p, a, b in _cuts(terms.keys[used], parts)]
    steps = np.diff(col.astype(np.uint32), prepend=np.uint32(0)) if len(col) else col.astype(np.uint32)
    out = {"block": [block.column("block")[0].as_py()], "at": [[a for a, _ in labelled]], "ys": [[y for _, y in labelled]], "counts": [planes(counts.astype(np.uint32))],
           "cols": [planes(steps)], "times": [planes(times.astype(np.uint32))], "docs": [planes(known[used].astype(np.uint32))], "parts": [cuts]}
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), _PACKED_TYPES)}).slice(0, 1 if labelled else 0)


def _spread(row: dict) -> np.ndarray:
    """Documents of each key a block asked a part for, 0 for those that are no terms."""
    have = np.unpackbits(np.frombuffer(row["kept"], np.uint8), count=row["asked"]).astype(bool)
    out = np.zeros(len(have), np.int64)
    out[have] = numbers(row["docs"], "u4")
    return out


_PACKED = "block bigint, at array<int>, ys array<int>, counts binary, cols binary, times binary, docs binary, parts array<struct<part:bigint,n:bigint,steps:binary>>"
_PACKED_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.list_(pa.struct([("part", pa.int64()), ("n", pa.int64()), ("steps", pa.binary())])))


class WordWeights:
    """TF-IDF of ``docs(key, text)``: 1 + ln tf, smoothed idf, unit length per document; terms of ``min_df`` or more documents.

    Rows that share a key are one document, whose texts meet in one task; a null key counts as one document and gets no rows.
    """

    def __init__(self, docs: DataFrame, key: str, text: str = "text", min_df: int = 5, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES):
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        self.key, self.kind = key, docs.schema["id"].dataType.simpleString()
        self.n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        more = written(docs.groupBy("id").count().filter("count > 1").select(F.col("id").alias("again")), "repeated")
        rows = docs.select("id", F.array("text").alias("texts"))
        if not more.isEmpty():
            same = docs["id"].eqNullSafe(more["again"])
            whole = docs.join(more, same, "left_semi").groupBy("id").agg(F.collect_list("text").alias("texts"))
            rows = docs.join(more, same, "left_anti").select("id", F.array("text").alias("texts")).unionByName(whole)
        self.blocks = written(rows.mapInArrow(lambda it: _blocks(it, block_bytes), f"block bigint, ids array<{self.kind}>, texts array<array<string>>"),
                              "term_blocks", rows_a_file=FILE_BLOCKS)
        self.parts = parts = max(1, math.ceil(size / part_bytes))
        asked = self.blocks.select("block", "texts").mapInArrow(lambda it: _asked(it, parts), "part bigint, block bigint, keys binary, docs binary")
        self.answers = written(asked.groupBy("part").applyInArrow(lambda t: _answered(t, min_df), "part bigint, block bigint, size bigint, asked bigint, kept binary, docs binary, steps binary"), "term_answers")

    def _some(self, part: Column | None, make, schema: str) -> DataFrame:
        blocks, answers = (t if part is None else t.filter(part) for t in (self.blocks, self.answers))
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(make, schema).filter(F.col("id").isNotNull())

    def rows(self) -> DataFrame:
        """(key, term, weight)."""
        n = self.n_docs

        def make(block: pa.Table, answers: pa.Table) -> pa.Table:
            ids, terms, which, w, _ = _weighed(block, answers, n, None)
            return pa.table([ids.take(pa.array(terms.doc[which])), terms.named(which), pa.array(w)], ["id", "term", "weight"])

        return self._some(None, make, f"id {self.kind}, term string, weight double").withColumnRenamed("id", self.key)

    def vocabulary(self) -> tuple[dict[int, int], int]:
        """Number of the first term of each part, and of all terms."""
        sizes = sorted(map(tuple, self.answers.groupBy("part").agg(F.max("size")).collect()))
        first, size = {}, 0
        for part, n in sizes:
            first[part], size = size, size + n
        return first, size

    def vectors(self, first: dict[int, int], passes: int = 1, turn: int = 0) -> DataFrame:
        """(key, indices, values), a row for each document that has terms; of several passes that of ``turn``."""
        n = self.n_docs

        def make(block: pa.Table, answers: pa.Table) -> pa.Table:
            ids, terms, which, w, number = _weighed(block, answers, n, first)
            order = np.argsort(terms.doc[which], kind="stable")  # a document's terms stay in order of their numbers
            doc, index, w = terms.doc[which][order], number[terms.of[which]][order], w[order]
            have, starts = np.unique(doc, return_index=True)
            offsets = pa.array(np.r_[starts, len(doc)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(index, pa.int32()), pa.array(w))]
            return pa.table([ids.take(pa.array(have)), *lists], ["id", "indices", "values"])

        return self._some(self.part(passes, turn), make, f"id {self.kind}, indices array<int>, values array<double>").withColumnRenamed("id", self.key)

    def part(self, passes: int, turn: int) -> Column:
        """Blocks of one of several passes."""
        return F.pmod(F.xxhash64("block"), F.lit(passes)) == turn

    def packed(self, labels: DataFrame, passes: int = 1, turn: int = 0) -> DataFrame:
        """A row for each block with labelled documents, see ``_packed``; ``labels``: key, y. Rows without a label are left out."""
        parts, mine = self.parts, self.part(passes, turn)
        ids = self.blocks.filter(mine).select("block", F.posexplode("ids").alias("at", self.key)).join(labels.filter("y is not null").hint("merge"), self.key)
        found = ids.groupBy("block").agg(F.collect_list(F.struct("at", F.col("y").cast("int").alias("y"))).alias("l")).select("block", F.col("l.at").alias("at"), F.col("l.y").alias("ys"))
        blocks = self.blocks.filter(mine).join(found.hint("merge"), "block")

        def make(block: pa.Table, answers: pa.Table) -> pa.Table:
            if not block.num_rows:
                return pa.table({f.name: pa.array([], t) for f, t in zip(fields, _PACKED_TYPES)})
            return _packed(block, answers, parts)

        fields = StructType.fromDDL(_PACKED).fields
        return blocks.groupBy("block").cogroup(self.answers.filter(mine).groupBy("block")).applyInArrow(make, _PACKED)
