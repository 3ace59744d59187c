"""Token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdefghijklmnopqrstuvwxyzéñ'’!?-_ 0123\n\tΣσİ漢字😀́Åक़ꟋꟜᲉ"
TEXTS = [None, "", " \n", "It's we'll 'select ''s x's'", "<|endoftext|>a<|startoftext|> <|endof text|>", "ΑΣ ΣΑΣ", "½ Ⅷ ٣ 12.5", "é ẛ̣", "a" * 3000, "a\x1cb\x85c\xa0d　e​f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def transducer():
    return tokencount.Transducer(tokencount.load(PATH))


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_equals_the_library(library, transducer):
    rng = random.Random(8)
    for text in TEXTS:
        assert transducer.count(text) == size(library, text), text
    for k in range(3000):
        text = "".join(rng.choice(ALPHABET if k % 2 else "aeinorstl'vd re") for _ in range(rng.randint(1, 80)))
        assert transducer.count(text) == size(library, text), text


def test_every_character(library, transducer):
    texts = [f"a{c}b {c}'S{c}1" for c in map(chr, range(1, 0x30000, 7)) if not 0xD800 <= ord(c) < 0xE000]
    assert [transducer.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose_in_any_grouping(library, transducer, monkeypatch):
    text = "the rain's in spain, it'll stay mainly 12 34 in theplainwithoutanyspace " * 3
    want = size(library, text)
    for n in (1, 2, 7, 31, 1000):
        monkeypatch.setattr(tokencount, "CHUNK", n)
        assert transducer.count(text) == want
    maps = [transducer.chunk_map(text[i : i + 9]) for i in range(0, len(text), 9)]
    a, b, c = maps[0], maps[1], maps[2]
    assert transducer.compose(transducer.compose(a, b), c) == transducer.compose(a, transducer.compose(b, c))


def test_pairs_stay_apart_as_merging_says(transducer):
    """The border check equals merging the pair's symbols from scratch."""
    def merged(parts):
        while len(parts) > 1:
            rank = min(transducer.ranks.get(p, 1 << 60) for p in zip(parts, parts[1:]))
            if rank == 1 << 60:
                break
            i = next(i for i, p in enumerate(zip(parts, parts[1:])) if transducer.ranks.get(p) == rank)
            parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]
        return parts

    rng, tokens = random.Random(6), [t for t in transducer.token if t]
    starts = [t for t in tokens if not t.endswith("</w>")]
    for _ in range(4000):
        a, b = rng.choice(starts), rng.choice(tokens)
        assert transducer.stays_apart(a, b) == (merged(transducer.split(a) + transducer.split(b)) == [a, b]), (a, b)
    for a, b in (("aa", "a"), ("a", "aa"), ("aa", "aa"), ("aaa", "aa"), ("aaaa", "a</w>")):
        if a in tokens and b in tokens:
            assert transducer.stays_apart(a, b) == (merged(transducer.split(a) + transducer.split(b)) == [a, b])


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "_KNOWN", 20)
    small = tokencount.Transducer(tokencount.load(PATH))
    text = " ".join(f"word{i}ing" for i in range(300))
    assert small.count(text) == size(library, text)


def test_operator(frame, library, long_text):
    texts = [*TEXTS, long_text, TEXTS[3]]
    out = tokencount.count_tokens(frame(list(enumerate(texts))), tokencount.load(PATH), limit=5).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out} == {
        (i, len((t or "").encode()), size(library, t), size(library, t) > 5) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(frame([]), tokencount.load(PATH)).count() == 0
