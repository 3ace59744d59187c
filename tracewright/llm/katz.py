"""Katz backoff language model of word pairs: counted, normalised and evaluated as Spark jobs.

A token follows a context, the token before it or the start of its text. Pair
counts are discounted by Good and Turing's estimate, words by the same; what a
context's pairs lose is given to all other words by their own probability, with
a backoff weight that makes each context's probabilities sum to one:

    p(w | h) = d(c(hw)) c(hw) / c(h)        where hw is in the pair table
             = a(h) p(w)                    elsewhere; a(h) is 1 for unseen h
    p(w)     = d(c(w)) c(w) / N             for words learned from
             = 1 - the sum of these         for the unknown word

Counts are kept by 64-bit hashes of words. Tasks count what they read and send
each part of the key space packed, so that the shuffles carry few bytes a token;
a frequent pair or word is one entry of each pack, so no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import released, small_batches, written
from tracewright.llm.simhash import _pieces

#: Counts up to this are discounted.
TOP = 5
#: Pairs seen less often are counted, and their share of a context goes to its backoff weight, but they get no row of their own.
LEAST = 2
#: Tokens that a task packs at once when it counts and when it looks up, and bytes of text for each part of the key space.
PACK, ASK, PART_BYTES = 1 << 20, 1 << 19, 8 << 20
#: Documents are scored in so many passes, one after the other, so that what a pass shuffles is gone before the next.
PASSES = 2
#: Keys of the start and the end of a text; words hold no space.
START, END = (xxhash.xxh64_intdigest(name) for name in (b" start", b" end"))
_KNOWN = 1 << 17
_COUNTED = "kind tinyint, h bigint, w bigint, n bigint"
_BIGRAM, _TOKEN, _OFTEN = range(3)


class Keys(dict):
    """Key of each word, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word)
        if len(self) < _KNOWN:
            self[word] = key
        return key


def token_keys(text: bytes, known: Keys) -> Iterator[np.ndarray]:
    """Keys of a text's words in order, in pieces of bounded size. A..Z are lower-cased; words are cut at ASCII white space."""
    for piece in _pieces(text.lower()):
        words = piece.split()
        yield np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _part_column(key: str, parts: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(parts), 32)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second bytes, and so on: sorted or small numbers then compress well."""
    return x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(wide, -1).T.copy().view(f">{kind}").ravel().astype(kind)


def _cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys."""
    part = _part(keys, parts)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield int(part[a]), int(a), int(b)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, one place of each, and the sums of n."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], order[starts], np.add.reduceat(n, starts) if len(starts) else n


# -- counting -----------------------------------------------------------------
def _pairs(batches: Iterator[pa.RecordBatch], parts: int, pack: int) -> Iterator[pa.RecordBatch]:
    """Counted pairs of the texts of a task, a row for each part of the key space and pack."""
    known, held, size = Keys(), [], 0

    def flush() -> pa.RecordBatch:
        h, w = (np.concatenate(x) for x in zip(*held))
        keys, at, n = _summed(pair_keys(h, w), np.ones(len(h), np.uint32))
        h, w = h[at], w[at]
        rows = [(p, _planes(h[a:b]), _planes(w[a:b]), _planes(n[a:b].astype(np.uint32))) for p, a, b in _cuts(keys, parts)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                          ["part", "h", "w", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            last = START
            for keys in token_keys(text or b"", known):
                if len(keys):
                    held.append((np.r_[np.uint64(last), keys[:-1]], keys))
                    last, size = keys[-1], size + len(keys)
                if size >= pack:
                    yield flush()
                    held, size = [], 0
            held.append((np.array([last], np.uint64), np.array([END], np.uint64)))
            size += 1
    if held:
        yield flush()


def _merged(table: pa.Table, least: int, top: int) -> pa.Table:
    """All that one part of the key space has: its pairs, what they give to the totals of words, and counts of counts."""
    h, w, n = (np.concatenate([_numbers(v, kind) for v in table.column(name).to_pylist()]) for name, kind in (("h", "u8"), ("w", "u8"), ("n", "u4")))
    keys, at, n = _summed(pair_keys(h, w), n.astype(np.int64))
    h, w = h[at], w[at]
    words, _, of_w = _summed(w, n)
    often, number = np.unique(n[n <= top + 1], return_counts=True)
    stay = n >= least
    none = lambda x: np.zeros(len(x), np.uint64)
    blocks = [(_BIGRAM, h[stay], w[stay], n[stay]), (_TOKEN, none(words), words, of_w), (_OFTEN, none(often), often.astype(np.uint64), number)]
    kinds = np.repeat(np.array([b[0] for b in blocks], np.int8), [len(b[1]) for b in blocks])
    columns = [np.concatenate([b[k] for b in blocks]).view(np.int64) for k in (1, 2)] + [np.concatenate([b[3] for b in blocks]).astype(np.int64)]
    return pa.table([pa.array(kinds), *map(pa.array, columns)], ["kind", "h", "w", "n"])


def discounts(often: dict[int, int], top: int = TOP) -> list[float]:
    """Katz's factors for counts 1 to ``top`` out of counts of counts; (r - 1/2) / r where they give no factor between 0 and 1."""
    n = [often.get(r, 0) for r in range(top + 2)]
    out = []
    for r in range(1, top + 1):
        d = 0.0
        if n[1] and n[r] and n[1] != (top + 1) * n[top + 1]:
            common = (top + 1) * n[top + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(count: Column, factors: list[float]) -> Column:
    return F.coalesce(*[F.when(count == r, F.lit(f)) for r, f in enumerate(factors, 1)], F.lit(1.0)) * count


class Model:
    """Tables of a fitted model: ``words(w, c, p)``, ``contexts(h, total, weight)`` and ``pairs(h, w, p, more)``; see ``fit``."""

    def __init__(self, words: DataFrame, contexts: DataFrame, pairs: DataFrame, n_tokens: int, n_words: int, unknown: float, parts: int):
        self.words, self.contexts, self.pairs = words, contexts, pairs
        self.n_tokens, self.n_words, self.unknown, self.parts = n_tokens, n_words, unknown, parts


def fit(texts: DataFrame, text_col: str = "text", least: int = LEAST, top: int = TOP, part_bytes: int = PART_BYTES, pack: int = PACK) -> Model:
    """Learn from every row of ``texts``. Null texts count as empty: they hold the end of a text only. No rows: only the unknown word is left.

    * words: c occurrences, probability p; ``unknown`` is the probability of the unknown word.
    * contexts: ``total`` of their occurrences, a row of each that has pairs; ``weight`` is the backoff weight. A context none
      of whose counts is discounted or left out counts once more, so that something is left for other words.
    * pairs: those seen at least ``least`` times. ``more`` is what log10 p exceeds the backed-off probability by.
    """
    spark = texts.sparkSession
    text = small_batches(texts).select(F.col(f"`{text_col}`").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    packed = text.mapInArrow(lambda it: _pairs(it, parts, pack), "part bigint, h binary, w binary, n binary")
    counted = written(packed.groupBy("part").applyInArrow(lambda t: _merged(t, least, top), _COUNTED), "ngrams", by=["kind"])
    kind = lambda k: counted.filter(F.col("kind") == k)

    words = written(kind(_TOKEN).groupBy("w").agg(F.sum("n").alias("c")), "words")
    small = [F.count(F.when(F.col("c") == r, 1)).alias(f"n{r}") for r in range(1, top + 2)]
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("words"), *small).first()
    one = discounts({r: row[f"n{r}"] for r in range(1, top + 2)}, top)
    lost = sum((1 - one[r - 1]) * r * row[f"n{r}"] for r in range(1, top + 1))
    total = row.tokens if lost else row.tokens + 1
    unknown = lost / total if lost else 1 / total
    words = words.select("w", "c", (_discounted(F.col("c"), one) / F.lit(float(total))).alias("p"))

    two = discounts({r.w: r.n for r in kind(_OFTEN).groupBy("w").agg(F.sum("n").alias("n")).collect()}, top)
    kept = kind(_BIGRAM).select("h", "w", _discounted(F.col("n"), two).alias("mass"))
    pairs = written(kept.join(words.select("w", F.col("p").alias("low")), "w"), "pairs")
    # a word is a context as often as it is a token, and each text has one start as it has one end
    start, end = (F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (START, END))
    totals = words.select(F.when(F.col("w") == end, start).otherwise(F.col("w")).alias("h"), "c")
    sums = pairs.groupBy("h").agg(F.sum("mass").alias("mass"), F.sum("low").alias("low"))
    of = F.when(F.col("mass") < F.col("c"), F.col("c")).otherwise(F.col("c") + 1).cast("double")
    contexts = sums.join(totals, "h").withColumn("total", of)
    weight = (1 - F.col("mass") / F.col("total")) / F.greatest(1 - F.col("low"), F.lit(unknown))
    contexts = written(contexts.select("h", "total", weight.alias("weight")), "contexts")
    p = F.col("mass") / F.col("total")
    weighted = written(pairs.join(contexts, "h").select("h", "w", p.alias("p"), (F.log10(p) - F.log10("low") - F.log10("weight")).alias("more")), "weighted")
    released(counted, pairs)
    return Model(words, contexts, weighted, int(row.tokens), int(row.words), unknown, parts)


# -- scoring ------------------------------------------------------------------
_ASKED = "part bigint, block bigint, keys binary, docs binary, times binary, ids array<{id}>, tokens array<bigint>"
_FOUND = "part bigint, block bigint, docs binary, more binary, base binary, known binary, ids array<{id}>, tokens array<bigint>"


def _asked(batches: Iterator[pa.RecordBatch], parts: int, pack: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """What the texts of a task need to look up, packed by part of the key space; documents are numbered inside blocks.

    A block ends with a document, so a very long one is looked up in several packs of its block. Its ids and token
    counts go along in a row of their own.
    """
    names = ["part", "block", "keys", "docs", "times", "ids", "tokens"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(kind), pa.list_(pa.int64())]
    known, task, number = Keys(), TaskContext.get().partitionId() << 32, 0
    held: list[tuple[np.ndarray, int, np.ndarray]] = []
    ids, tokens, size, whole = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        keys = np.concatenate([k for k, _, _ in held])
        docs = np.repeat(np.array([d for _, d, _ in held], np.uint32), [len(k) for k, _, _ in held])
        times = np.concatenate([t for _, _, t in held]).astype(np.uint32)
        order = np.argsort(keys)
        keys, docs, times = keys[order], docs[order], times[order]
        rows = [(p, task + number, _planes(keys[a:b]), _planes(docs[a:b]), _planes(times[a:b]), None, None) for p, a, b in _cuts(keys, parts)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number % parts, task + number, None, None, None, ids, tokens), types)], names)

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()):
            last, n = START, 0
            ends = iter([np.array([END], np.uint64)])
            for keys in (k for some in (token_keys(text or b"", known), ends) for k in some):
                if not len(keys):
                    continue
                before = np.r_[np.uint64(last), keys[:-1]]
                asked = [keys, pair_keys(before, keys)] + ([np.array([START], np.uint64)] if last == START else [])
                found, times = np.unique(np.concatenate(asked), return_counts=True)
                held.append((found, len(ids), times))
                last, n, size, whole = keys[-1], n + len(keys), size + len(keys), whole + len(keys)
                if size >= pack:
                    yield flush()
                    held, size = [], 0
            ids.append(i)
            tokens.append(n)
            if whole >= pack:
                if held:
                    yield flush()
                yield ended()
                held, ids, tokens, size, whole, number = [], [], [], 0, 0, number + 1
    if ids:
        if held:
            yield flush()
        yield ended()


def _looked_up(asked: pa.Table, table: pa.Table, kind: pa.DataType) -> pa.Table:
    """Sums by document of what one part of the key space knows about them."""
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    key = np.r_[key[order], np.uint64(0)]
    values = {c: np.r_[table.column(c).to_numpy()[order], 0] for c in ("more", "base", "known")}
    rows = []
    for row in asked.to_pylist() if asked.num_rows else []:
        if row["keys"] is None:
            rows.append((row["part"], row["block"], None, None, None, None, row["ids"], row["tokens"]))
            continue
        keys, docs, times = _numbers(row["keys"], "u8"), _numbers(row["docs"], "u4"), _numbers(row["times"], "u4")
        at = np.searchsorted(key[:-1], keys)
        good = key[at] == keys
        good &= at < len(key) - 1
        at, docs, times = at[good], docs[good].astype(np.int64), times[good]
        if len(at):
            sums = [np.bincount(docs, weights=values[c][at] * times) for c in ("more", "base", "known")]
            some = np.flatnonzero(np.bincount(docs))
            rows.append((row["part"], row["block"], some.astype(np.uint32).tobytes(), *(s[some].tobytes() for s in sums), None, None))
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(kind), pa.list_(pa.int64())]
    columns = zip(*rows) if rows else [[]] * 8
    return pa.table([pa.array(x, t) for x, t in zip(columns, types)], ["part", "block", "docs", "more", "base", "known", "ids", "tokens"])


def _added(table: pa.Table, kind: pa.DataType) -> pa.Table:
    """One row for each document of a block; parts are added in one order, whichever came first."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["docs"] or b"", r["more"] or b""))
    head = next(r for r in rows if r["ids"] is not None)
    sums = {c: np.zeros(len(head["ids"])) for c in ("more", "base", "known")}
    for row in rows:
        if row["docs"] is not None:
            docs = np.frombuffer(row["docs"], np.uint32)
            for c, total in sums.items():
                np.add.at(total, docs, np.frombuffer(row[c], np.float64))
    return pa.table([pa.array(head["ids"], kind), pa.array(head["tokens"], pa.int64()), pa.array(sums["known"].astype(np.int64)),
                     pa.array(sums["base"]), pa.array(sums["more"])], ["id", "tokens", "known", "base", "more"])


def _features(model: Model) -> DataFrame:
    """What each key adds to a text beyond an unknown word: of words, of contexts, and of pairs beyond backing off to their word."""
    log = F.log10
    less = math.log10(model.unknown)
    words = model.words.select(F.col("w").alias("key"), (log("p") - less).alias("own"), (log(F.col("c") + 0.5) - math.log10(0.5)).alias("base"), F.lit(1.0).alias("known"))
    back = model.contexts.select(F.col("h").alias("key"), log("weight").alias("back"))
    nothing = lambda c: F.coalesce(c, F.lit(0.0))
    single = words.join(back, "key", "full").select("key", (nothing("own") + nothing("back")).alias("more"), nothing("base").alias("base"), nothing("known").alias("known"))
    key = F.arrow_udf(lambda h, w: pa.array(pair_keys(*(x.to_numpy().view(np.uint64) for x in (h, w))).view(np.int64)), "bigint")
    double = model.pairs.select(key("h", "w").alias("key"), "more", F.lit(0.0).alias("base"), F.lit(0.0).alias("known"))
    return single.unionByName(double)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", pack: int = ASK, passes: int = PASSES) -> DataFrame:
    """One row per input row: ``(id_col, n_tokens, n_known, base_score, score)``.

    * score: log10 of the model's probability of the whole text, the sum over its tokens and its end; a word not learned from
      has the unknown word's probability. base_score: that of single words with half an occurrence added to each and to the
      unknown word. n_known: tokens that were learned from.
    * A null text is empty: one token, its end. Repeated rows each get a row, null ids stay null, other columns are ignored,
      an empty table gives no rows. A text of any length is looked up in packs of bounded size.
    * The rows are read from tables that the passes have written.
    """
    schema = docs.select(F.col(f"`{id_col}`").alias("id")).schema
    name, kind = schema["id"].dataType.simpleString(), _arrow_type(schema)
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    parts = model.parts
    table = _features(model).withColumn("part", _part_column("key", parts))
    done = []
    for k in range(passes):
        some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k)
        asked = some.mapInArrow(lambda it: _asked(it, parts, pack, kind), _ASKED.format(id=name))
        found = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(lambda a, b: _looked_up(a, b, kind), _FOUND.format(id=name))
        summed = found.groupBy("block").applyInArrow(lambda t: _added(t, kind), f"id {name}, tokens bigint, known bigint, base double, more double")
        done.append(written(summed, "scored"))
    summed = reduce(DataFrame.unionByName, done)
    n, v = model.n_tokens, model.n_words
    base = F.col("base") + F.col("tokens") * F.lit(math.log10(0.5 / (n + 0.5 * (v + 1))))
    whole = F.col("more") + F.col("tokens") * F.lit(math.log10(model.unknown))
    return summed.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
                         base.alias("base_score"), whole.alias("score"))


def _arrow_type(schema) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).field(0).type


def held_out(id_col: Column) -> Column:
    """Documents kept for judging the model: one in five by the checksum of their id as text. Null ids are learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents by a model of those that are not held out; see ``fit`` and ``score``."""
    model = fit(docs.filter(~held_out(F.col(f"`{id_col}`"))), text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
