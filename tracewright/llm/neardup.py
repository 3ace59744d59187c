"""Near copies by Jaccard similarity of word shingles, whole: fingerprints first, then what they miss.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more. Fingerprints within a few bits (deletion variants, as
in ``simhash``) connect dense groups by few links, but most pairs at 0.8 differ
in more bits. Those meet by prefixes: with the shingles in one order for all
texts, two sets that similar share a shingle among the first n - ceil(0.8 n) + 1
of each, so grouping by these loses no pair. Every link is checked exactly
before components are made, so no link rests on a fingerprint alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keyed, released, same_key, small_batches, unpack, written
from tracewright.llm.components import components
from tracewright.llm.simhash import BLOCK, RADIUS, links

SHINGLE = 5
#: Least similarity of near copies, as a fraction.
OVER, UNDER = 4, 5
#: One text in so many is counted to find frequent shingles, which come last in the order. This changes cost, never results.
SAMPLE, OFTEN, LIST = 16, 8, 1 << 16
_SET = "struct<node:bigint,n:int,fp:bigint,prefix:array<bigint>,bits:binary>"
#: Least width of a set's parity bits.
_BITS = 512
#: Bits a shingle of the parities that decide which pairs meet with their whole sets.
FINE = 8
#: Buckets of more sets carry their parities, so that pairs which cannot be near copies are not written out.
WIDE = 128
#: How often components take their nearest pair alone before all pairs that are left are checked. This changes cost, never results.
ROUNDS = 2


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than a shingle are one. A..Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        found = xxhash.xxh64_digest(joined, 42)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        digest = xxhash.xxh64_digest
        found = b"".join([digest(joined[a:b], 42) for a, b in zip((end - length)[: len(words) - size + 1].tolist(), end[size - 1 :].tolist())])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def _fingerprint(found: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def prefix(found: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 hashes, those in ``often`` (sorted, with their ranks) last."""
    n = len(found)
    if not n:
        return found
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        found = found[np.argsort(np.where(often[at] == found, rank[at], 0), kind="stable")]
    return found[: n + OVER * n // -UNDER + 1]


def parities(found: np.ndarray, bits: int = 1) -> bytes:
    """For each bit whether an odd number of hashes falls on it; a power of two of bits, more than ``bits`` times the hashes.

    Two sets differ in at least as many hashes as their parities differ in bits, of whichever of the two widths.
    """
    width = max(_BITS, 1 << (bits * len(found)).bit_length())
    return np.packbits(np.bincount((found & np.uint64(width - 1)).view(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the wider one folded to the width of the other."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    width = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, width)) ^ np.bitwise_xor.reduce(y.reshape(-1, width))).sum())


class Parities:
    """Parities of the sets of a bucket, folded to each width that occurs."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(b) for b in bits])
        self.folded, self.place = {}, {}
        for w in np.unique(self.width):
            some = np.flatnonzero(self.width >= w)
            self.place[w] = np.full(len(bits), -1)
            self.place[w][some] = np.arange(len(some))
            self.folded[w] = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, w // 8)) for i in some])

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Differing bits of set i and each of the others: a lower bound of the hashes that only one of them has."""
        out, least = np.zeros(len(others), np.int64), np.minimum(self.width[others], self.width[i])
        for w in np.unique(least):
            m, at = self.folded[w], self.place[w]
            here = least == w
            out[here] = np.bitwise_count(m[at[others[here]]] ^ m[at[i]]).sum(1)
        return out


def _differing_column(a: str, b: str) -> Column:
    return F.arrow_udf(lambda x, y: pa.array([differing(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.int32()), "int")(a, b)


def _bytes(a: pa.Array) -> list:
    return a.cast(pa.binary()).to_pylist()


def hashes_column(text: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([shingles(t).view(np.int64) for t in _bytes(a)], pa.list_(pa.int64())), "array<bigint>")(text)


def _fine_column(text: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([parities(shingles(t), FINE) for t in _bytes(a)], pa.binary()), "binary")(text)


def _set_column(text: Column, often: list[int]) -> Column:
    by = np.array(often, np.int64).view(np.uint64)
    order = np.argsort(by)
    by, rank = by[order], len(by) - order  # the most frequent shingle comes last

    def batch(a: pa.Array) -> pa.Array:
        rows = []
        for t in _bytes(a):
            s = shingles(t)
            rows.append({"node": xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63), "n": len(s), "fp": _fingerprint(s), "prefix": prefix(s, by, rank).view(np.int64), "bits": parities(s)})
        return pa.array(rows, pa.struct([("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())]))

    return F.arrow_udf(batch, _SET)(text)


def _often(texts: DataFrame) -> list[int]:
    """Frequent shingles of a sample, at most ``LIST``, the most frequent first."""
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.select(F.explode(hashes_column(F.col("text"))).alias("token")).groupBy("token").count().filter(F.col("count") >= OFTEN)
    return [r.token for r in counts.orderBy(F.desc("count"), "token").limit(LIST).collect()]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different labels and fitting sizes out of rows (bucket, node, n, label, bits) sorted by bucket. A bucket has a few blocks at most.

    Where a bucket has parities, pairs that these tell too far apart are left out.
    """

    def found(g, node, n, label, bits):
        held, rows = [], 0
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for a, b in zip(starts, [*starts[1:], len(g)]):
            known = Parities(list(bits[a:b])) if bits[a] is not None else None
            for i in range(a, b - 1):
                m = n[i + 1 : b]
                fits = (label[i + 1 : b] != label[i]) & (UNDER * np.minimum(m, n[i]) >= OVER * np.maximum(m, n[i]))
                if known is not None and fits.any():
                    at = np.flatnonzero(fits)
                    fits[at] = (UNDER + OVER) * known.apart(i - a, at + i + 1 - a) <= (UNDER - OVER) * (m[at] + n[i])
                other = node[i + 1 : b][fits]
                if len(other):
                    flip = other < node[i]
                    m, own = m[fits], np.full(len(other), n[i])
                    held.append((np.minimum(other, node[i]), np.maximum(other, node[i]), np.where(flip, m, own), np.where(flip, own, m)))
                    rows += len(other)
                if rows > 1 << 16:
                    yield out(held)
                    held, rows = [], 0
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in held])) for k in range(4)], ["src", "dst", "n", "m"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if not len(cols[0]):
            continue
        if held and held[-1][0][-1] == cols[0][0] == cols[0][-1]:
            held.append(cols)
            continue
        cols = [np.concatenate(x) for x in zip(*held, cols)]
        last = np.searchsorted(cols[0], cols[0][-1])
        if last:
            yield from found(*[c[:last] for c in cols])
        held = [[c[last:] for c in cols]]
    if held:
        yield from found(*[np.concatenate(x) for x in zip(*held)])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, n) sorted by token and node -> those whose token others have too, with its smallest node and that one's size."""
    held = None  # the first row of the last token, and whether it was given out
    for batch in batches:
        token, node, n = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if not len(token):
            continue
        given = False
        if held is not None:
            token, node, n, given = np.r_[held[0], token], np.r_[held[1], node], np.r_[held[2], n].astype(np.int32), held[3]
        new = np.r_[True, token[1:] != token[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        more = ~new | np.r_[token[1:] == token[:-1], False]
        last = first[-1]
        held = token[last], node[last], n[last], bool(more[last]) or given and last == 0
        more[0] &= not given
        yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (token, node, n, node[first], n[first])], ["token", "node", "n", "low", "m"])


def _near_enough(rows: DataFrame) -> DataFrame:
    """Pairs out of rows (src, dst, n, m), one for each prefix shingle that both have, that may be near copies.

    All of one prefix lies in the range of the other one's, so what it does not share there it shares nowhere.
    """
    pairs = rows.groupBy("src", "dst", "n", "m").agg(F.count("*").alias("c"))
    rest = lambda n: F.ceil(F.col(n) * OVER / UNDER) - 1
    return pairs.filter((OVER + UNDER) * (F.greatest(rest("n"), rest("m")) + F.col("c")) >= OVER * (F.col("n") + F.col("m"))).select("src", "dst")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` that the parities of ``sets(node, n, bits)`` do not tell too far apart; ``apart`` is the share of differing bits."""
    bits = lambda node, name: sets.select(F.col("node").alias(node), F.col("bits").alias(name), F.col("n").alias(f"n_{name}"))
    both = pairs.join(bits("src", "a"), "src").join(bits("dst", "b"), "dst")
    size, apart = F.col("n_a") + F.col("n_b"), _differing_column("a", "b")
    close = both.select("src", "dst", apart.alias("apart"), size.alias("size")).filter((UNDER + OVER) * F.col("apart") <= (UNDER - OVER) * F.col("size"))
    return close.select("src", "dst", (F.col("apart") / F.greatest("size", F.lit(1))).alias("apart"))


def _names(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """One document for each set that ``pairs`` name."""
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    return written(sets.join(nodes, "node", "left_semi").select("node", "n", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")), "names")


def _checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)``, a written table, that are near copies.

    Their texts are read for parities of ``FINE`` bits a shingle, which count all but a few of the differing shingles at
    an eighth to a quarter of a set's size; only what these leave meets with whole sets.
    """
    names = _names(pairs, sets)
    fine = docs.join(names, same_key(docs, names)).select("node", "n", _fine_column(F.col("text")).alias("bits"))
    fine = written(fine.dropDuplicates(["node"]), "fine")
    pairs = written(_close(pairs, fine).select("src", "dst"), "fits")
    released(names, fine)
    names = _names(pairs, sets)
    hashes = docs.join(names, same_key(docs, names)).select("node", hashes_column(F.col("text")).alias("hashes"))
    hashes = written(hashes.dropDuplicates(["node"]), "hashes")
    a = hashes.select(F.col("node").alias("src"), F.col("hashes").alias("a"))
    b = hashes.select(F.col("node").alias("dst"), F.col("hashes").alias("b"))
    same = F.size(F.array_intersect("a", "b"))
    both = pairs.join(a, "src").join(b, "dst")
    links = written(both.filter((OVER + UNDER) * same >= OVER * (F.size("a") + F.size("b"))).select("src", "dst"), "checked")
    released(names, hashes)
    return links


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with these."""
    for end, name in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    return pairs.filter("a <> b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that ``links(a, b)`` connect have become one."""
    new = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return labels.join(new, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("new", "label").alias("label"))


def _spread(close: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels after all near copies among ``close(src, dst, apart)`` are linked.

    In a dense group nearly all pairs are near copies and few of them are needed. So first each component takes the pair
    that is least apart, a few times over; what these connect needs no more checks. All other pairs are then checked.
    """
    for turn in range(ROUNDS + 1):
        open_ = written(_labelled(close, labels), "open")
        least = F.struct("apart", "src", "dst")
        picked = open_ if turn == ROUNDS else open_.select(F.explode(F.array("a", "b")).alias("label"), least.alias("x"), "a", "b").groupBy("label").agg(
            F.min_by(F.struct("x.src", "x.dst", "a", "b"), "x").alias("y")).select("y.*").distinct()
        picked = written(picked.select("src", "dst", "a", "b"), "picked")
        links = _checked(picked.select("src", "dst"), sets, docs).join(picked, ["src", "dst"]).select("a", "b").distinct()
        labels = written(_joined(labels, links), "joined")
        close = open_.select("src", "dst", "apart").join(picked.select("src", "dst"), ["src", "dst"], "left_anti")
    return labels


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def similar(sets: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sets(node, first, n, fp, prefix)``, one row a set, and ``docs(k1, k2, text)`` -> ``(node, label)`` of sets that have near copies.

    First come links that a group needs few of: fingerprints in reach, and each
    set with the smallest node that shares a shingle of its prefix. Only pairs
    that these leave in different components are then compared.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = sets.select(F.explode("prefix").alias("token"), "node", "n")
    meet = written(tokens.repartition(parts, "token").sortWithinPartitions("token", "node")
                   .mapInArrow(_meet, "token bigint, node bigint, n int, low bigint, m int"), "meet")
    prints = written(sets.filter("n > 0").groupBy("fp").agg(F.min("node").alias("least")), "least")
    first, second = prints.select(F.col("fp").alias("src"), F.col("least").alias("a")), prints.select(F.col("fp").alias("dst"), F.col("least").alias("b"))
    near = links(prints.select("fp"), RADIUS, block).distinct().join(first, "src").join(second, "dst").select(*_pair("a", "b"))
    equal = sets.join(prints, "fp").select(*_pair("node", "least"))
    hubs = _near_enough(meet.filter("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst"), "n", "m"))
    few = written(near.unionByName(equal).unionByName(hubs).filter("src <> dst").distinct(), "few")
    labels = components(_checked(written(_close(few, sets), "close"), sets, docs))

    marked = written(meet.select("token", "node", "n").join(labels, "node", "left")
                     .select("token", "node", "n", F.coalesce("label", "node").alias("label")), "marked")
    released(meet, few)
    open_tokens = marked.groupBy("token").agg(F.count("*").alias("of"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("token", "of")
    blocks = (F.floor(F.col("of") / block) + 2).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = F.when(F.col("of") <= block, F.array(F.xxhash64("token"))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("token", F.least(own, j), F.greatest(own, j))))
    # pairs inside a block meet in each of its block pairs: counted too often, they are checked all the same
    open_ = marked.join(open_tokens, "token")
    wide = open_.filter(F.col("of") > WIDE).join(sets.select("node", "bits"), "node")
    open_ = open_.filter(F.col("of") <= WIDE).withColumn("bits", F.lit(None).cast("binary")).unionByName(wide)
    rows = open_.select(F.explode(dealt).alias("bucket"), "node", "n", "label", "bits")
    pairs = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_pairs, "src bigint, dst bigint, n int, m int")
    pairs = written(_near_enough(pairs.filter("src <> dst")), "pairs")
    return _spread(written(_close(pairs, sets), "close"), labels, sets, docs)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays (ties: the smallest text hash).

    Keeps all columns. Rows that repeat id and text stay once; texts without words are copies of each other. A component
    whose ids are all null keeps one row.
    """
    whole = keyed(small_batches(docs), id_col, text_col)
    text = F.col("row").getField(text_col)
    often = _often(whole.select(text.alias("text")))
    rows = written(whole.select("k1", "k2", _set_column(text, often).alias("s")).select("k1", "k2", "s.*"), "sets")
    name = F.struct(F.col("k1").isNull().alias("unnamed"), "k1", "k2")
    sets = written(rows.groupBy("node").agg(F.min(name).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "distinct")
    released(rows)
    labels = similar(sets, whole.select("k1", "k2", text.alias("text")), block)
    group = sets.select("node", "first").join(labels, "node", "left").select(F.coalesce("label", "node").alias("group"), "first")
    stay = written(group.groupBy("group").agg(F.min("first").alias("first")).select("first.k1", "first.k2").distinct(), "stay")
    kept = whole.join(stay.hint("merge"), same_key(whole, stay), "left_semi").dropDuplicates(["k1", "k2"])
    return unpack(kept, docs)
