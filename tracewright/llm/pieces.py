"""SentencePiece encoding and decoding over the piece lattice, with N-best segmentation.

The pieces of a model and their scores span a lattice over a text. Forward
Viterbi scores give the best path; they are also the exact distance to the start
that a backward A-star search needs, so the N best paths come out in order and
nothing else is expanded.

No piece holds a space mark after another character, so the lattice of a text
is a chain of small lattices (a word with its marks, a line feed). These are
solved once for each distinct word of a batch, all words side by side in numpy.
The N best of a text differ from the best one in the N - 1 words with the
smallest loss only: changing any other word costs no less than N - 1 paths that
are known already.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import small_batches

MARK = "▁"
_NONE = np.int64(-(1 << 60))
#: Characters solved together, and words solved side by side.
_CHARS, _SIDE = 1 << 19, 2048
#: Longer words are solved by themselves.
_LONG = 48
#: N-best lists and solved words that a task remembers.
_KNOWN, _WORDS_KNOWN = 10_000, 150_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(r"(?<! ) ")
_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@dataclass
class Model:
    """Pieces that span the lattice, the ids of bytes, and what each id decodes to."""

    scores: dict[str, tuple[int, int]]
    byte_ids: list[int]
    decoded: list[bytes]
    unknown: int


def load(path: str) -> Model:
    """Read a model file. Its scores must be whole numbers, as those of a merge-ranked vocabulary are; sums are exact."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, byte_ids, decoded = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            decoded.append(bytes([int(piece[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            decoded.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
        else:
            if score != int(score) or re.search(f"[^{MARK}]{MARK}|\n", piece):
                raise ValueError(f"piece {i} has a broken score, a space mark inside or a line feed")
            scores[piece] = int(score), i
            decoded.append(piece.replace(MARK, " ").encode())
    return Model(scores, byte_ids, decoded, min(s for s, _ in scores.values()) - 10)


class Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattice:
    """Solves words; made once in each task."""

    def __init__(self, model: Model):
        self.model = model
        self.longest = max(map(len, model.scores))
        hashes = {}
        for piece, (score, i) in model.scores.items():
            hashes[int(self._hash(np.array([[ord(c) for c in piece]], np.uint64))[-1][0, 0])] = score, i
        if len(hashes) != len(model.scores):
            raise ValueError("two pieces share a hash")
        self.keys = np.array(sorted(hashes), np.uint64)
        self.key_score = np.array([hashes[int(k)][0] for k in self.keys], np.int64)
        self.key_id = np.array([hashes[int(k)][1] for k in self.keys], np.int32)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True
        self.byte_ids = np.array(model.byte_ids, np.int32)
        self.paths: dict[tuple[str, int], list] = {}
        self.forget()

    def _hash(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length the hashes of all runs of so many characters."""
        out, h = [], np.full(codes.shape, 1469598103934665603, np.uint64)
        for k in range(min(self.longest, codes.shape[1])):
            h = (h[:, : codes.shape[1] - k] ^ codes[:, k:]) * _MULTIPLIER
            out.append(h ^ (h >> np.uint64(29)))
        return out

    # -- one word -------------------------------------------------------------
    def arcs(self, word: str, end: int) -> list[tuple[int, int, int]]:
        """(start, score, id) of the pieces that end here, longest first; id -1 is a character without a piece."""
        scores = self.model.scores
        out = [(a, *scores[word[a:end]]) for a in range(max(0, end - self.longest), end) if word[a:end] in scores]
        return out if out and out[-1][0] == end - 1 else [*out, (end - 1, self.model.unknown, -1)]

    def forward(self, word: str) -> list[int]:
        best = [0]
        for end in range(1, len(word) + 1):
            best.append(max(best[a] + s for a, s, _ in self.arcs(word, end)))
        return best

    def ids(self, word: str, path) -> list[int]:
        out = []
        while path:
            start, end, i, path = path
            out += [i] if i >= 0 else [self.model.byte_ids[b] for b in word[start:end].encode()]
        return out

    def nbest(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """(score, ids) of the n best segmentations: A-star from the end, guided by the forward scores.

        Among equal scores the path nearest to the start goes on, and of those the longest last piece, so a word of many
        equal paths is walked through once instead of level by level. A place is left at most n times: its n best ways
        to the end are then known, and others cannot be part of the n best.
        """
        if (word, n) in self.paths:
            return self.paths[word, n]
        best, out = self.forward(word), []
        heap, made, left = [(-best[-1], len(word), 0, 0, None)], 0, [n] * (len(word) + 1)
        while heap and len(out) < n:
            _, end, _, behind, path = heapq.heappop(heap)
            if end == 0:
                out.append((behind, self.ids(word, path)))
                continue
            if not left[end]:
                continue
            left[end] -= 1
            for start, score, i in self.arcs(word, end):
                if left[start]:
                    made += 1
                    heapq.heappush(heap, (-(best[start] + score + behind), start, made, behind + score, (start, end, i, path)))
        if len(self.paths) > _KNOWN:
            self.paths.clear()
        if len(word) <= _LONG:
            self.paths[word, n] = out
        return out

    # -- many words of about one length ---------------------------------------
    def side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, loss of the second best, the ids of all words, and their counts.

        Arrays have the place in a word before the word, so that each step runs over adjacent memory.
        """
        n, wide = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join([w.ljust(wide, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, wide)
        most = min(self.longest, wide)
        score = np.full((most, wide, n), _NONE)
        piece = np.full((most, wide, n), -1, np.int32)
        for k, h in enumerate(self._hash(codes.astype(np.uint64))):
            w, a = np.nonzero(self.filter[h >> np.uint64(44)])
            key = h[w, a]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = np.flatnonzero((self.keys[at] == key) & (a + k + 1 <= size[w]))
            w, a, at = w[good], a[good], at[good]
            score[k, a, w] = self.key_score[at]
            piece[k, a, w] = self.key_id[at]
        np.copyto(score[0], self.model.unknown, where=score[0] == _NONE)
        before = np.full((wide + 1, n), _NONE)
        back = np.zeros((wide + 1, n), np.int8)
        before[0] = 0
        for end in range(1, wide + 1):
            best, last = before[end], back[end]
            for k in range(min(most, end) - 1, -1, -1):  # longer pieces first: they win ties
                x = before[end - k - 1] + score[k, end - k - 1]
                np.copyto(last, k, where=x > best)
                np.maximum(best, x, out=best)
        after = np.full((wide + most + 1, n), _NONE)
        after[size, np.arange(n)] = 0
        for start in range(wide - 1, -1, -1):
            inside = start < size
            best = np.full(n, _NONE)
            for k in range(min(most, wide - start)):
                np.maximum(best, score[k, start] + after[start + k + 1], out=best)
            np.copyto(after[start], best, where=inside)
        best = before[size, np.arange(n)]
        # the best path, from its end; its arcs are then taken out of the lattice
        rows, end, found = np.arange(n), size.copy(), []
        through = score
        for k in range(most):
            through[k] += before[:wide]
            through[k] += after[k + 1 : k + 1 + wide]
        while len(rows):
            k = back[end, rows]
            start = end - k - 1
            through[k, start, rows] = _NONE * 2
            found.append((rows, start, piece[k, start, rows]))
            rows, end = rows[start > 0], start[start > 0]
        second = through.max(axis=(0, 1))
        loss = np.where(second > _NONE // 2, best - second, -_NONE)
        w, a, i = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(w * np.int64(wide) + a)
        w, a, i = w[order], a[order], i[order]
        code = np.where(i < 0, codes[w, a], 0)
        many = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        if (i < 0).any():
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            c, m, ids = np.repeat(code, many), np.repeat(many, many), np.repeat(i, many)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[m] | (c >> (6 * (m - 1)))
            byte = np.where(m == 1, c, np.where(nth == 0, lead, 0x80 | ((c >> (6 * (m - 1 - nth))) & 0x3F)))
            i = np.where(ids < 0, self.byte_ids[np.where(ids < 0, byte, 0)], ids)
        return best, loss, i, np.bincount(w, weights=many, minlength=n).astype(np.int64)

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score, loss, first place of the ids, count of ids of each word; and the ids."""
        score, loss, count = (np.zeros(len(words), np.int64) for _ in range(3))
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        ordered = size[order]
        flat, firsts, done, i = [], np.zeros(len(words), np.int64), 0, 0
        while i < len(order):
            head = int(ordered[i])
            if head > _LONG:
                word = words[order[i]]
                two = self.nbest(word, 2)
                at, ids = order[i : i + 1], np.array(two[0][1], np.int32)
                score[at], loss[at], count[at] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else -_NONE, len(ids)
            else:
                at = order[i : min(i + _SIDE, int(np.searchsorted(ordered, min(_LONG, head + 1 + head // 4), "right")))]
                score[at], loss[at], ids, count[at] = self.side_by_side([words[j] for j in at])
            firsts[at] = done + np.cumsum(count[at]) - count[at]
            flat.append(ids)
            done += len(ids)
            i += len(at)
        return score, loss, firsts, count, np.concatenate([np.zeros(0, np.int32), *flat])

    def learned(self, parts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the words in ``self.solved``; words not met before are solved first, all of them together."""
        if len(self.number) > _WORDS_KNOWN:
            self.forget()
        number, known = self.number.__getitem__, len(self.number)
        places = [np.fromiter(map(number, words), np.int64, len(words)) for words in parts]
        if len(self.number) > known:
            score, loss, first, count, ids = self.solve(list(islice(self.number, known, None)))
            new = score, loss, first + len(self.solved[4]), count, ids
            self.solved = [np.concatenate(x) for x in zip(self.solved, new)]
        return places

    def forget(self) -> None:
        self.number = Numbers()
        self.solved = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.int32)]

    # -- texts ----------------------------------------------------------------
    def encode(self, texts: list[str | None], n: int) -> list[dict | None]:
        out = [None if t is None else {"ids": [], "score": 0, "weak": []} for t in texts]
        parts, chars = [], 0

        def run():
            nonlocal parts, chars
            if parts:
                places = self.learned([words for _, words in parts])
                score, loss, first, count, ids = self.solved
                for (i, words), at in zip(parts, places):
                    c = count[at]
                    ends = np.cumsum(c)
                    own = out[i]
                    shift = sum(map(len, own["ids"]))
                    own["ids"].append(ids[np.repeat(first[at] - ends + c, c) + np.arange(ends[-1])])
                    own["score"] += int(score[at].sum())
                    if n > 1:
                        gaps = loss[at]
                        near = np.argpartition(gaps, n - 2)[: n - 1] if len(at) > n - 1 else np.arange(len(at))
                        own["weak"] += [(int(gaps[j]), shift + int(ends[j] - c[j]), words[j]) for j in near]
                        own["weak"] = sorted(own["weak"])[: n - 1]
            parts, chars = [], 0

        for i, text in enumerate(texts):
            at = 0
            while text and at < len(text):
                to = at + _CHARS
                cut = _CUT.search(text, to) if to < len(text) else None
                to = cut.start() if cut else len(text)
                marked = text[at:to].replace(" ", MARK)
                parts.append((i, _WORDS.findall(marked if at else MARK + marked)))
                chars += to - at
                at = to
                if chars >= _CHARS:
                    run()
        run()
        for own in out:
            if own is not None:
                own["ids"] = np.concatenate([np.zeros(0, np.int32), *own["ids"]])
                own["nbest"] = self._combine(own["score"], own.pop("weak"), n)
        return out

    def _combine(self, score: int, weak: list[tuple[int, int, str]], n: int) -> list[dict]:
        """The n best of a chain of words, most of them at their best: score, and the words that differ with their new ids."""
        paths: list[tuple[int, list]] = [(score, [])]
        for _, first, word in weak:
            options = self.nbest(word, n)
            size = len(options[0][1])
            more = [(s - options[0][0] + total, edits if not k else [*edits, {"first": first, "count": size, "ids": ids}])
                    for total, edits in paths for k, (s, ids) in enumerate(options)]
            paths = sorted(more, key=lambda x: -x[0])[:n]
        return [{"score": s, "edits": sorted(e, key=lambda x: x["first"])} for s, e in paths]

    def decode(self, ids: list[int]) -> str:
        table = self.model.decoded
        raw = b"".join([table[i] for i in ids])
        return (raw[1:] if ids and table[ids[0]][:1] == b" " else raw).decode("utf-8", "replace")


_ENCODED = "struct<ids:array<int>,score:bigint,nbest:array<struct<score:bigint,edits:array<struct<first:int,count:int,ids:array<int>>>>>>"


def _once(model: Model, use):
    made: list[Lattice] = []

    def batch(a: pa.Array) -> pa.Array:
        if not made:
            made.append(Lattice(model))
        return use(made[0], a)

    return batch


def encoding(text: Column, model: Model, n: int = 1) -> Column:
    """Column ``struct<ids, score, nbest>``: the best segmentation and, as edits of it, the n best in order.

    Scores are sums of piece scores; a character without a piece scores 10 less than the least piece and becomes its
    UTF-8 bytes. Of equal scores the one with the longer last piece comes first. A null text gives null, an empty one no
    ids. An edit replaces ``count`` ids from ``first`` on. A text with fewer segmentations than n has fewer.
    """
    edit = pa.struct([("first", pa.int32()), ("count", pa.int32()), ("ids", pa.list_(pa.int32()))])
    ranked = pa.list_(pa.struct([("score", pa.int64()), ("edits", pa.list_(edit))]))

    def use(lattice: Lattice, a: pa.Array) -> pa.Array:
        rows = lattice.encode(a.to_pylist(), n)
        null = pa.array([r is None for r in rows])
        ids = [np.zeros(0, np.int32) if r is None else r["ids"] for r in rows]
        ids = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32), np.concatenate([np.zeros(0, np.int32), *ids]))
        return pa.StructArray.from_arrays([ids, pa.array([r and r["score"] for r in rows], pa.int64()), pa.array([r and r["nbest"] for r in rows], ranked)],
                                          ["ids", "score", "nbest"], mask=null)

    return F.arrow_udf(_once(model, use), _ENCODED)(text)


def decoding(ids: Column, model: Model) -> Column:
    """Text of a column of ids; null ids give null. Space marks become spaces and the leading one, put there by encoding, goes."""
    def use(lattice: Lattice, a: pa.Array) -> pa.Array:
        flat, ends = a.values.to_numpy(zero_copy_only=False), a.offsets.to_pylist()
        return pa.array([lattice.decode(flat[x:y].tolist()) if ok else None for x, y, ok in zip(ends, ends[1:], a.is_valid().to_pylist())], pa.string())

    return F.arrow_udf(_once(model, use), "string")(ids)


def encode(docs: DataFrame, model: Model, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text, ids, score, nbest)``, a row per input row (see ``encoding``); other columns are ignored.

    Decoding gives the text back, but for literal space marks (U+2581), which become spaces.
    """
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    return rows.withColumn("e", encoding(F.col("text"), model, n)).select(id_col, "text", "e.ids", "e.score", "e.nbest")
