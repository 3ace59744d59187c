"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the
radius must have one segment that differs in at most one bit (three segments
for a radius of four). Each segment is indexed once per bit with that bit
masked out, so such a pair meets in at least one variant; an equality grouping
on variants brings candidates together and the full distance is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keyed, same_key, small_batches, unpack, written
from tracewright.llm.components import components

RADIUS = 4
SHINGLE = 4
#: Fingerprints of one bucket that a task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20


def _bits(texts: list[bytes], size: int) -> bytes:
    """Fingerprint of one text given as pieces that end at white space."""
    ones, n, tail, seen = np.zeros(64, np.int64), 0, [], False

    def add(words: list[bytes], whole: bool) -> None:
        nonlocal ones, n
        joined = b" ".join(words)
        if whole:
            hashes = xxhash.xxh64_digest(joined, 42)
        else:
            length = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(length + 1) - 1
            start = end - length
            digest = xxhash.xxh64_digest
            hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(start[: len(words) - size + 1].tolist(), end[size - 1 :].tolist())])
        h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)

    for piece in texts:
        words = tail + piece.split()
        if len(words) >= size:
            add(words, False)
            seen = True
        tail = words[-(size - 1) :] if size > 1 else []
    if not seen and tail:
        add(tail, True)
    return np.packbits(2 * ones > n).tobytes() if n else bytes(8)


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        to = min(at + _PIECE, len(text))
        if to < len(text):
            space = _SPACE.search(text, to)
            to = space.start() if space else len(text)
        yield text[at:to]
        at = to


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text (null: as empty)."""
    return int.from_bytes(_bits(_pieces((text or "").encode().lower()), size), "big", signed=True)


def fingerprint_column(text, size: int = SHINGLE):
    """Column of signed 64-bit fingerprints, computed on Arrow batches. A..Z are lower-cased; words are cut at ASCII white space."""

    def batch(a: pa.Array) -> pa.Array:
        out = [int.from_bytes(_bits(_pieces(t.lower()), size), "big", signed=True) for t in (b or b"" for b in a.cast(pa.binary()).to_pylist())]
        return pa.array(out, pa.int64())

    return F.arrow_udf(batch, "bigint")(text)


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: the fewest for which ``radius`` flips leave one with at most one flip."""
    n = radius // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment(fp, first: int, width: int, without: int | None = None):
    """Value of a segment as a long, the bit ``without`` masked out."""
    mask = ((1 << width) - 1) << first
    if without is not None:
        mask &= ~(1 << without)
    return F.shiftrightunsigned(fp.bitwiseAND(F.lit(_signed(mask))), first)


def variants(fp, radius: int):
    """Array of all one-wildcard variants: the wildcard's number beside the rest of its segment."""
    return F.array(*[F.struct(F.lit(b).alias("bit"), _segment(fp, first, width, b).alias("rest"))
                     for first, width in segments(radius) for b in range(first, first + width)])


def _hot_buckets(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """(bit, rest, blocks) of variants that may hold more than ``block`` fingerprints.

    A variant joins two values of its segment, so it can only be large if one of
    those values is; that needs three counted rows for each fingerprint.
    """
    fp = F.col("fp")
    cut = segments(radius)
    values = prints.select(F.explode(F.array(*[F.struct(F.lit(first).alias("first"), _segment(fp, first, width).alias("value"))
                                               for first, width in cut])).alias("s")).select("s.*")
    hot = values.groupBy("first", "value").count().filter(F.col("count") > block)
    masks = F.array(*[F.struct(F.lit(first).alias("of"), F.lit(b).alias("bit"), F.lit(_signed(~(1 << (b - first)) & ((1 << 64) - 1))).alias("mask"))
                      for first, width in cut for b in range(first, first + width)])
    spread = hot.select("*", F.explode(masks).alias("m")).filter("m.of = first")
    return (spread.groupBy(F.col("m.bit").alias("bit"), F.col("value").bitwiseAND(F.col("m.mask")).alias("rest"))
            .agg((F.floor(F.sum("count") / block) + 2).cast("int").alias("blocks")))


def _walk(group: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect all fingerprints of a group within reach of each other: one for each that is reached."""
    rest, src, dst = np.unique(group), [], []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            found = rest[near]
            if len(found):
                src.append(np.full(len(found), at))
                dst.append(found)
                todo.extend(found)
                rest = rest[~near]
    return src, dst


def _links(batches: Iterator[pa.RecordBatch], radius: int, small: int = 4) -> Iterator[pa.RecordBatch]:
    """Verified links out of rows (bucket, fp) sorted by bucket. A bucket has a few blocks at most."""

    def found(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, len(g)])
        src, dst = [], []
        width = np.repeat(sizes, sizes)
        for k in range(1, min(small, int(sizes.max(initial=1)))):
            near = (g[k:] == g[:-k]) & (width[k:] <= small) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= radius)
            src.append(fp[:-k][near])
            dst.append(fp[k:][near])
        for i in np.flatnonzero(sizes > small):
            a, b = _walk(fp[starts[i] : starts[i] + sizes[i]], radius)
            src += a
            dst += b
        a = np.concatenate([np.zeros(0, np.uint64), *src]).view(np.int64)
        b = np.concatenate([np.zeros(0, np.uint64), *dst]).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        g, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(g):
            continue
        if held and held[-1][0][-1] == g[0] == g[-1]:
            held.append((g, fp))
            continue
        g = np.concatenate([*(x for x, _ in held), g])
        fp = np.concatenate([*(x for _, x in held), fp])
        last = np.searchsorted(g, g[-1])
        if last:
            yield found(g[:last], fp[:last])
        held = [(g[last:], fp[last:])]
    if held:
        yield found(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))


def _cross(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between different labels out of rows (bucket, fp, label) sorted by bucket: one for each two labels that meet in a bucket."""

    def found(fp: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        out, met = [], set()
        for i in range(len(fp) - 1):
            near = np.flatnonzero((np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) & (label[i + 1 :] != label[i])) + i + 1
            for j in near[np.unique(label[near], return_index=True)[1]]:
                two = min(label[i], label[j]), max(label[i], label[j])
                if two not in met:
                    met.add(two)
                    out.append((fp[i], fp[j]))
        return out

    held: list[list[np.ndarray]] = []

    def ended(rows: list[np.ndarray]) -> pa.RecordBatch:
        g, fp, label = rows
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        pairs = [p for a, b in zip(starts, [*starts[1:], len(g)]) for p in found(fp[a:b], label[a:b])]
        ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["src", "dst"])

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        rows[1] = rows[1].view(np.uint64)
        if not len(rows[0]):
            continue
        if held and held[-1][0][-1] == rows[0][0] == rows[0][-1]:
            held.append(rows)
            continue
        rows = [np.concatenate(x) for x in zip(*held, rows)]
        last = np.searchsorted(rows[0], rows[0][-1])
        if last:
            yield ended([x[:last] for x in rows])
        held = [[x[last:] for x in rows]]
    if held:
        yield ended([np.concatenate(x) for x in zip(*held)])


def _dealt(rows: DataFrame, groups, *more: str) -> DataFrame:
    """Rows by bucket, each bucket whole and in order inside one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.explode(groups).alias("bucket"), "fp", *more).repartition(n, "bucket").sortWithinPartitions("bucket")


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``prints(fp)``, distinct -> ``(src, dst)``: links within the radius that connect whatever all such links connect.

    Small buckets give all their links; in larger ones a walk gives one link for
    each fingerprint it reaches. A bucket of more than ``block`` fingerprints is
    cut into blocks, each walked by itself. What the blocks of a bucket then
    still miss are links between fingerprints of different components: only
    buckets that hold several components are compared by pairs of blocks, and
    two components give one link in each pair of blocks where they meet. So a
    dense bucket costs one link for each fingerprint, however many blocks it has.
    """
    spark = prints.sparkSession
    hot = written(_hot_buckets(prints, radius, block), "hot")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.repartition(n).select("fp", F.inline(variants(F.col("fp"), radius))).join(hot, ["bit", "rest"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    one = F.array(F.when(F.col("blocks").isNull(), F.xxhash64("bit", "rest")).otherwise(F.xxhash64("bit", "rest", own)))
    inside = written(_dealt(rows, one).mapInArrow(lambda it: _links(it, radius), "src bigint, dst bigint"), "inside")
    if hot.isEmpty():
        return inside
    labels = components(inside)
    named = prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"))
    crowd = written(named.select("fp", "label", F.inline(variants(F.col("fp"), radius))).join(hot, ["bit", "rest"]), "crowd")
    mixed = crowd.groupBy("bit", "rest").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("bit", "rest")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("bit", "rest", F.least(own, j), F.greatest(own, j)))
    across = _dealt(crowd.join(mixed, ["bit", "rest"]), pairs, "label").mapInArrow(lambda it: _cross(it, radius), "src bigint, dst bigint")
    return inside.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE,
                    block: int = BLOCK) -> DataFrame:
    """One row per input row: ``(id_col, fingerprint, component_id, fp)``.

    * fingerprint: 16 hex digits; a null text counts as empty, texts without words have fingerprint zero and are linked
      like any other; texts with fewer words than a shingle are one shingle.
    * component_id: the smallest id reachable over links of at most ``radius`` differing bits, itself included. Null ids
      never are the smallest unless a component has no other. Repeated rows each get a row.
    * Other columns of the input are ignored, so their names can't clash; an empty table gives an empty result.

    Exact copies meet by fingerprint before any link is sought, so a group of copies of any size is one fingerprint.
    """
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text_col}`"), size).alias("fp"))
    rows = written(rows, "prints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    labels = components(links(prints.select("fp"), radius, block))
    least = labels.join(prints, labels["node"] == prints["fp"]).groupBy("label").agg(F.min("first").alias("least"))
    named = written(labels.join(least, "label").select(F.col("node"), "least"), "named")
    known = written(prints.join(named, prints["fp"] == named["node"], "left")
                    .select(F.col("fp").alias("of"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("least")).alias("component")), "known")
    out = rows.join(known, rows["fp"] == known["of"])
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays (ties: the smallest text hash).

    Keeps all columns. Rows that repeat id and text stay once. A component whose ids are all null keeps one row.
    """
    whole = keyed(small_batches(docs), id_col, text_col)
    rows = written(whole.select("k1", "k2", fingerprint_column(F.col("row").getField(text_col), size).alias("fp")), "prints")
    prints = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("k1").isNull().alias("unnamed"), "k1", "k2")).alias("first")), "distinct")
    labels = components(links(prints.select("fp"), radius))
    group = prints.join(labels, prints["fp"] == labels["node"], "left").select(F.coalesce("label", "fp").alias("group"), "first")
    stay = written(group.groupBy("group").agg(F.min("first").alias("first")).select("first.k1", "first.k2").distinct(), "stay")
    kept = whole.join(stay.hint("merge"), same_key(whole, stay), "left_semi").dropDuplicates(["k1", "k2"])
    return unpack(kept, docs)
