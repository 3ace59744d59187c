"""Katz model against a direct version: dictionaries of counts, every probability by its definition."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from tracewright.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


class Direct:
    def __init__(self, texts, least, top=5):
        self.words, self.pairs, self.total = Counter(), Counter(), Counter()
        for t in texts:
            last = 0  # the start
            for w in tokens(t):
                self.words[w] += 1
                self.pairs[last, w] += 1
                self.total[last] += 1
                last = w
        self.n = sum(self.words.values())
        one = katz.discounts(Counter(self.words.values()), top)
        two = katz.discounts(Counter(self.pairs.values()), top)
        d = lambda c, f: c * (f[c - 1] if c <= len(f) else 1)
        self.p = {w: d(c, one) for w, c in self.words.items()}
        whole = self.n if any(c <= top for c in self.words.values()) else self.n + 1
        self.p = {w: x / whole for w, x in self.p.items()}
        self.unknown = 1 - sum(self.p.values())
        self.q, self.weight = {}, {}
        for h in self.total:
            kept = {w: d(c, two) for (g, w), c in self.pairs.items() if g == h and c >= least}
            if kept:
                of = self.total[h] + (sum(kept.values()) >= self.total[h])
                self.q |= {(h, w): x / of for w, x in kept.items()}
                self.weight[h] = (1 - sum(kept.values()) / of) / (1 - sum(self.p[w] for w in kept))

    def of(self, h, w):
        return self.q[h, w] if (h, w) in self.q else self.weight.get(h, 1) * self.p.get(w, self.unknown)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.of(h, w)) for h, w in zip([0, *t], t))

    def base(self, text):
        return sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for w in tokens(text))


def corpus(seed=1, rows=60):
    rng = random.Random(seed)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 300}"
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(rows)]
    return [*texts, texts[5], texts[5], None, "", " \n", "one\x1ftwo é Ⅷ", "new words only"]


@pytest.mark.parametrize("least", [1, 2])
def test_scores_equal_the_definition(frame, least):
    texts = corpus()
    direct = Direct(texts[:50], least)
    for h in [0, "w1", "w2", "nothing", *list(direct.weight)[:40]]:  # each context's probabilities sum to one
        assert sum(direct.of(h, w) for w in direct.words) + direct.of(h, "nothing") == pytest.approx(1)
    model = katz.fit(frame([(i, t) for i, t in enumerate(texts[:50])]), least=least, part_bytes=500, pack=100)
    assert model.parts > 10 and model.n_tokens == direct.n and model.n_words == len(direct.words)
    out = {r.doc_id: r for r in katz.score(frame(list(enumerate(texts))), model, pack=70).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i].n_tokens == len(tokens(t)) and out[i].n_known == sum(w in direct.words for w in tokens(t))
        assert out[i].score == pytest.approx(direct.score(t)) and out[i].base_score == pytest.approx(direct.base(t))


def test_tables_are_normalised(frame):
    model = katz.fit(frame(list(enumerate(corpus(2)))), part_bytes=2000)
    p = {r.w: r.p for r in model.words.collect()}
    assert sum(p.values()) + model.unknown == pytest.approx(1)
    own = {}
    for r in model.pairs.collect():
        own.setdefault(r.h, {})[r.w] = r.p
    for r in model.contexts.collect():
        rest = 1 - sum(p[w] for w in own[r.h])
        assert sum(own[r.h].values()) + r.weight * rest == pytest.approx(1)


def test_nothing_is_discounted_or_learned(frame):
    often = frame([(i, "a b a b") for i in range(9)])
    model = katz.fit(often, top=2)
    direct = Direct(["a b a b"] * 9, 2, top=2)
    got = {r.doc_id: r.score for r in katz.score(frame([(1, "a b"), (2, "b a c"), (3, None)]), model).collect()}
    assert got == {i: pytest.approx(direct.score(t)) for i, t in ((1, "a b"), (2, "b a c"), (3, None))}
    none = katz.fit(frame([]))
    assert (none.unknown, none.n_tokens) == (1, 0)
    assert [(r.score, r.n_known) for r in katz.score(frame([(1, "a b")]), none).collect()] == [(0, 0)]
    assert katz.score(frame([]), model).count() == 0


def test_rows_ids_and_folds(frame, long_text):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b"), (None, None), *[(i, f"a b {i}") for i in range(2, 40)], (50, long_text)]
    out = katz.score_documents(frame(rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    direct = Direct([t for i, t in rows if not held(i) and i != 50], 2)
    assert all(r.held_out == held(r.doc_id) for r in out)
    assert {r.n_tokens for r in out if r.doc_id == 50} == {400_001}
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    if held(50):
        assert all(r.train_tokens == direct.n for r in out)


def test_sizes_of_packs_change_nothing(frame):
    rows = list(enumerate(corpus(4)))
    models = [katz.fit(frame(rows), part_bytes=size, pack=pack) for size, pack in ((1 << 20, 1 << 20), (300, 10))]
    a, b = ({r.doc_id: r for r in katz.score(frame(rows), m, pack=pack).collect()} for m, pack in zip(models, (1 << 20, 7)))
    assert all(a[i].score == pytest.approx(b[i].score, rel=1e-12) and a[i].n_known == b[i].n_known for i, _ in rows)
