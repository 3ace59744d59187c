"""Benchmark decontamination: SimHash of item-sized windows, a multi-index, and an exact check.

Texts are lower-cased and cut into words (``\\w+``); shingles are five words. A
window has as many shingles as a benchmark item. Its fingerprint is looked up in
the blocks of the items' fingerprints: cut into radius + 1 blocks, any two
fingerprints within the radius agree on one block. Whatever is within the radius
is then compared exactly, shingles weighted by how often they occur.

Before that, a window must hold as many shingles of any item as the similarity
needs at least (for a share t, 2t / (1 + t) of the item's shingles). That loses
nothing and leaves few windows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.llm.common import small_batches

SHINGLE = 5
SIMILARITY = 0.8
#: Of 64 bits. Windows of similarity 0.8 differ in 9 bits on average, with a deviation of 2.8.
RADIUS = 20
#: Characters of benchmark text that one pass over the documents holds in each task; more take further passes.
PASS_CHARS = 8 << 20
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_KNOWN = 200_000


class Words:
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _KNOWN:
            self.known.clear()
        known = self.known
        get = known.get
        out = [get(w) for w in words]
        if None in out:
            digest = xxhash.xxh64_intdigest
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[words[i]] = digest(words[i])
        return np.array(out, np.uint64)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Well-mixed 64-bit hash of each run of ``size`` word hashes."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * _MULTIPLIER + hashes[k : n + k]
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def simhashes(marks: np.ndarray, starts: np.ndarray, size: int) -> list[int]:
    """Fingerprints of the windows ``marks[s : s + size]``; each occurrence of a shingle weighs one."""
    bits = np.unpackbits(marks.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts + size] - sums[starts]
    return np.packbits(2 * ones > size, axis=1).view(">u8").ravel().tolist()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two shingle counts."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """Items of one pass: shingles, sizes, and fingerprints by block."""

    def __init__(self, items: list[tuple[object, str]], least: float = SIMILARITY, radius: int = RADIUS):
        self.least, self.radius = least, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        self.ids, self.counts, self.prints, self.sets = [], [], [], []
        self.index: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        hashed, every = Words(), [np.zeros(0, np.uint64)]
        for name, text in items:
            marks = shingles(hashed(_WORD.findall((text or "").lower())))
            if not len(marks):
                continue
            fp, i = simhashes(marks, np.zeros(1, np.int64), len(marks))[0], len(self.ids)
            for b, (shift, mask) in enumerate(self.blocks):
                self.index[len(marks), b, fp >> shift & mask].append(i)
            self.ids.append(name)
            self.counts.append(Counter(marks.tolist()))
            self.sets.append(np.unique(marks))
            self.prints.append(fp)
            every.append(marks)
        self.sizes = sorted({n for n, _, _ in self.index})
        self.known = np.unique(np.concatenate(every))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True

    def needed(self, own: int, window: int) -> int:
        """Shared shingles without which a window can't reach the similarity."""
        return int(np.ceil(self.least * (own + window) / (1 + self.least) - 1e-9))

    def candidates(self, size: int, fp: int) -> set[int]:
        found = {i for b, (shift, mask) in enumerate(self.blocks) for i in self.index.get((size, b, fp >> shift & mask), ())}
        return {i for i in found if (self.prints[i] ^ fp).bit_count() <= self.radius}

    def search(self, marks: np.ndarray) -> list[tuple[object, float, int, int]]:
        """(item, best similarity, first word, word after the last) of each item that a window comes near enough to."""
        if not self.sizes or not len(marks):
            return []
        hit = self.filter[marks >> np.uint64(44)]
        at = np.flatnonzero(hit)
        if len(at) < self.needed(self.sizes[0], min(self.sizes[0], len(marks))):
            return []
        place = np.minimum(np.searchsorted(self.known, marks[at]), len(self.known) - 1)
        hit[at] = self.known[place] == marks[at]
        hits = np.r_[0, np.cumsum(hit)]
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in self.sizes:
            wide = min(size, len(marks))
            starts = np.flatnonzero(hits[wide:] - hits[:-wide] >= self.needed(size, wide))
            if len(starts):
                lo, hi = int(starts[0]), int(starts[-1]) + wide
                for s, fp in zip(starts.tolist(), simhashes(marks[lo:hi], starts - lo, wide)):
                    for i in self.candidates(size, fp):
                        windows[i].append((s, wide))
        out = []
        for i, places in windows.items():
            own = sum(self.counts[i].values())
            where = np.minimum(np.searchsorted(self.sets[i], marks), len(self.sets[i]) - 1)
            mine = np.r_[0, np.cumsum(self.sets[i][where] == marks)]
            bound = sorted(((min(int(mine[s + n] - mine[s]), own), s, n) for s, n in places), key=lambda x: (-x[0], x[1]))
            best = (0.0, 0, 0)
            for most, s, n in bound:
                if most / (own + n - most) < max(self.least, best[0]) or most / (own + n - most) == best[0]:
                    break
                if (x := similarity(Counter(marks[s : s + n].tolist()), self.counts[i])) > best[0]:
                    best = (x, s, n)
            if best[0] >= self.least:
                out.append((self.ids[i], best[0], best[1], best[1] + best[2] + SHINGLE - 1))
        return sorted(out, key=lambda x: (x[2], x[3], str(x[0])))


def _passes(bench: DataFrame, id_col: str, text_col: str) -> list[list[tuple[object, str]]]:
    """The items in groups of bounded size, each collected by itself."""
    items = bench.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + chars // PASS_CHARS
    return [[(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()] for k in range(n)]


def matches_columns(text: Column, bench: DataFrame, id_col: str = "item_id", text_col: str = "text",
                    least: float = SIMILARITY, radius: int = RADIUS) -> list[Column]:
    """For each pass a column ``array<struct<item, similarity, start_word, end_word>>``: the items a text contains."""
    kind = dict(bench.dtypes)[id_col]
    empty = bench.limit(0).select(F.lit(None).cast(f"array<struct<item:{kind},similarity:double,start_word:bigint,end_word:bigint>>").alias("x"))
    schema = empty.schema["x"].dataType
    to_arrow = to_arrow_type(schema)

    def searcher(items):
        made: list = []  # the index is built once in each task, not for each batch

        def batch(texts: pa.Array) -> pa.Array:
            if not made:
                made.extend((Index(items, least, radius), Words()))
            index, hashed = made
            rows = [[dict(zip(("item", "similarity", "start_word", "end_word"), x)) for x in index.search(shingles(hashed(_WORD.findall((t or "").lower()))))]
                    for t in texts.to_pylist()]
            return pa.array(rows, to_arrow)

        return batch

    return [F.arrow_udf(searcher(items), schema)(text) for items in _passes(bench, id_col, text_col)]


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id_col, item_id, similarity, start_word, end_word)``: one row for each document and item it contains.

    A document contains an item if some window of as many shingles has a weighted Jaccard similarity of 0.8 or more with
    it; a document with fewer shingles is one window. The best window is returned, the first of equals. Null texts are
    empty; texts and items of fewer than five words have no shingle and match nothing; repeated rows of documents each
    give their rows, repeated items count once. Either table may be empty. Other columns are ignored.

    Documents are read in place, without a shuffle. The benchmark is a query set: it is sent to the tasks in passes of
    bounded size, however large it is.
    """
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = [rows.select("id", F.inline(c)) for c in matches_columns(F.col("text"), bench, item_col, item_text)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "similarity", "start_word", "end_word")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that contain no item (see ``contaminated``)."""
    out = small_batches(docs).select(F.struct("*").alias("row"))
    for c in matches_columns(F.col("row").getField(text_col), bench, item_col, item_text):
        out = out.filter(F.size(c) == 0)
    return out.select("row.*")
