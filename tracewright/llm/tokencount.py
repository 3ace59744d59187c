"""Token counts by a finite-state transducer compiled from a tokenizer's merges.

Merging pairs by rank has a left-to-right form: of the tokens that end at a
position exactly one can follow the best tokens before it, namely the one that
stays apart from its neighbour when the two are merged by themselves. So a word is
counted by a deterministic transducer: a state holds the places where a token
may have begun (its trie node, the token before it, the count so far), and each
transition carries the tokens it emits. States and transitions are compiled when
they are first met and shared by all words.

A text is cut into chunks. Whatever state a chunk is entered in, only its head,
up to the first white space, depends on it; so a chunk's state map is its head,
the count between, and the tail it leaves open. Maps are composed in a tree, as a
parallel prefix scan does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import small_batches

#: Characters of a chunk.
CHUNK = 1 << 16
#: Compiled transitions, pairs and counted words that a task remembers; beyond that it compiles anew.
_KNOWN = 500_000
_NEVER = 1 << 60


@dataclass
class Vocabulary:
    """What the transducer is compiled from."""

    tokens: list[str]
    ranks: dict[tuple[str, str], int]
    special: list[str]
    words: str
    end: str
    #: Inside of a character class: what newer tables than the library's call a letter or number.
    newer: str
    #: Lower case of letters that the interpreter's tables do not know.
    lower: dict[int, str]


def load(path: str) -> Vocabulary:
    """Read a tokenizer file: NFC, white space, lower case; words by a pattern; byte-level merges with a word-end mark."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"]["pretokenizers"][0], spec["model"]
    if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or not (split["invert"] and split["behavior"] == "Removed"):
        raise ValueError("this kind of tokenizer is not known here")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Vocabulary(list(model["vocab"]), {m: i for i, m in enumerate(merges)}, [t["content"] for t in spec["added_tokens"]],
                      split["pattern"]["Regex"], model["end_of_word_suffix"] or "", *_newer(path))


def _newer(path: str) -> tuple[str, dict[int, str]]:
    """Letters and numbers of the pattern module that the tokenizer library, with older tables, takes for neither.

    As ranges of a character class; and lower case where the tables differ. Only what the interpreter's own tables do not assign is put to the library.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    cut, lower = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    late = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"))
    codes = [ord(c) for c in late if len(cut(c + "!")) == 1]
    firsts = [c for c in codes if c - 1 not in set(codes)]
    lasts = [c for c in codes if c + 1 not in set(codes)]
    differ = {ord(c): lower(c) for c in late if lower(c) != c.lower()}
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts)), differ


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


class Counts(dict):
    """Tokens of each word; counts what it does not know, and forgets everything when it is full."""

    def __init__(self, transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = n = self.transducer.word(word)
        return n


class Transducer:
    def __init__(self, v: Vocabulary):
        self.ranks, self.end, self.symbols = v.ranks, v.end, byte_symbols()
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for t in {*v.tokens, *self.symbols, *(s + v.end for s in self.symbols)}:
            node = 0
            for s in self.split(t):
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][s]
            self.token[node] = t
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
        self.pattern = regex.compile(v.words)
        self.newer = re.compile(f"[{v.newer}]") if v.newer else None
        self.lower = v.lower
        self.beyond = re.compile(rf"[{v.newer[:10]}-\U0010ffff]") if v.newer else None
        without = (rf"[\p{{{k}}}--[{v.newer}]]" for k in "LN")
        self.exact = regex.compile(v.words.replace(r"\p{L}", next(without)).replace(r"\p{N}", next(without)), regex.V1) if v.newer else self.pattern
        self.space = regex.compile(r"\s")
        self.counts = Counts(self)
        self.reset()

    def reset(self) -> None:
        start = ((0, None, 0),)
        self.keys, self.numbers = [start], {start: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.apart: dict[tuple[str | None, str], bool] = {}
        self.made: dict[str, tuple | None] = {}

    def split(self, token: str) -> list[str]:
        """Symbols of a token; the word-end mark belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def history(self, token: str) -> tuple[list[int], list[str], list[str]] | None:
        """Ranks of the merges that make a token, and its first and last part before each of them and at the end.

        None if merging its symbols does not give the token.
        """
        if token in self.made:
            return self.made[token]
        parts = self.split(token)
        ranks, left, right = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            rank = min(self.ranks.get(p, _NEVER) for p in zip(parts, parts[1:]))
            if rank == _NEVER:
                break
            out, j = [], 0
            while j < len(parts):
                pair = self.ranks.get((parts[j], parts[j + 1])) == rank if j + 1 < len(parts) else False
                out.append(parts[j] + parts[j + 1] if pair else parts[j])
                j += 1 + pair
            parts = out
            ranks.append(rank)
            left.append(parts[0])
            right.append(parts[-1])
        self.made[token] = (ranks + [_NEVER], left, right) if parts == [token] else None
        return self.made[token]

    def stays_apart(self, before: str | None, token: str) -> bool:
        """Whether merging the symbols of both tokens gives the two tokens: no merge across their border comes first."""
        key = before, token
        if key not in self.apart:
            a, b = self.history(before) if before is not None else ([_NEVER], [""], [""]), self.history(token)
            apart, i, j = a is not None and b is not None, 0, 0
            while apart and before is not None:
                across, ra, rb = self.ranks.get((a[2][i], b[1][j]), _NEVER), a[0][i], b[0][j]
                if across < ra and across <= rb:
                    apart = False
                elif ra == rb == _NEVER:
                    break
                elif ra <= rb:
                    i += 1
                else:
                    j += 1
            self.apart[key] = apart
        return self.apart[key]

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile a transition: next state, and tokens emitted (fewer than none, if tokens grow together)."""
        kept, last = [], None
        for node, before, count in self.keys[state]:
            to = self.trie[node].get(symbol)
            if to is not None:
                kept.append((to, before, count))
                if self.token[to] is not None and last is None and self.stays_apart(before, self.token[to]):
                    last = self.token[to], count + 1
        token, emitted = last
        key = tuple((n, b, c - emitted) for n, b, c in kept if self.trie[n]) + ((0, token, 0),)
        number = self.numbers.setdefault(key, len(self.keys))
        if number == len(self.keys):
            self.keys.append(key)
        self.moves[state, symbol] = number, emitted
        return number, emitted

    def word(self, word: str) -> int:
        """Tokens of one word of the pattern."""
        if len(self.moves) > _KNOWN or len(self.apart) > _KNOWN:
            self.reset()
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        state, total, moves = 0, 0, self.moves
        for s in symbols:
            step = moves.get((state, s)) or self.move(state, s)
            state = step[0]
            total += step[1]
        return total

    def run(self, text: str) -> int:
        """Tokens of a stretch of normalised text that is entered and left between words."""
        rare = self.newer is not None and not text.isascii() and self.beyond.search(text) and self.newer.search(text)
        return sum(map(self.counts.__getitem__, (self.exact if rare else self.pattern).findall(text)))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count None: no white space, the chunk is all head."""
        first = self.space.search(chunk)
        if first is None:
            return chunk, None, ""
        last = len(chunk)
        while not self.space.match(chunk, last - 1):
            last -= 1
        return chunk[: first.start()], self.run(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple[str, int | None, str]:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def stretch(self, text: str) -> int:
        """Tokens of raw text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case is taken character by character
            text = text.replace("Σ", "σ")
        if self.beyond is not None and self.lower and not text.isascii() and self.beyond.search(text):
            text = text.translate(self.lower)
        text = text.lower()
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.run(head) + (count or 0) + self.run(tail) for head, count, tail in maps)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.stretch(text)
        return len(self.special.findall(text)) + sum(map(self.stretch, self.special.split(text)))


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Column of token counts, without tokens for begin or end; a special token's string in a text is that token. Null: 0."""
    made: list[Transducer] = []

    def batch(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Transducer(vocabulary))
        return pa.array(map(made[0].count, texts.to_pylist()), pa.int64())

    return F.arrow_udf(batch, "bigint")(text)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)``, a row per input row. Null texts are empty; other columns are ignored."""
    text = F.col(f"`{text_col}`")
    out = small_batches(docs).select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                                     token_count(text, vocabulary).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
