"""Decontamination against a version that compares every window with every item."""

import random
import re
from collections import Counter

import pytest

from tracewright.llm import decontam


def direct(docs, items):
    cut = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])(re.findall(r"\w+", (t or "").lower()))
    out = {}
    for name, text in docs:
        marks = cut(text)
        for item, wanted in {(i, tuple(cut(t))) for i, t in items}:
            size, best = min(len(wanted), len(marks)), 0.0
            for p in range(len(marks) - size + 1) if size else ():
                a, b = Counter(marks[p : p + size]), Counter(wanted)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[name, item] = round(best, 9)
    return out


def sample(seed):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n)]
    items = [(i, words(rng.randint(5, 70))) for i in range(25)]
    docs = []
    for k in range(150):
        body = words(rng.randint(0, 120))
        if k % 2:
            _, item = rng.choice(items)
            item = list(item)
            for _ in range(k // 2 % 4):  # edits within and beyond the similarity
                item[rng.randrange(len(item))] = "edited"
            if k % 5 == 0:
                item.insert(len(item) // 2, "inserted")
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((k, " ".join(body).title() + "."))
    return docs, [(i, ", ".join(w)) for i, w in items] + [(90, "too short an item"), (91, None), (92, ""), (93, "again and " * 30)]


@pytest.mark.parametrize("chars", [8 << 20, 400])
def test_equals_all_pairs(spark, frame, monkeypatch, long_text, chars):
    monkeypatch.setattr(decontam, "PASS_CHARS", chars)
    docs, items = sample(2)
    docs += [(200, None), (201, ""), (202, "again and " * 40), (203, long_text + " " + items[0][1])]
    bench = frame([*items, items[0]], "item_id")
    rows = decontam.contaminated(frame(docs), bench).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    assert len(got) == len(rows) and got == direct(docs[:-1], items) | {(203, 0): 1.0} and len(got) > 15
    kept = decontam.drop_contaminated(frame(docs), bench)
    assert kept.columns == frame(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in got})


def test_places_and_repeated_rows(frame):
    item = " ".join(f"w{i}" for i in range(30))
    rows = decontam.contaminated(frame([(1, f"x y {item} z"), (1, f"x y {item} z"), (None, item)]), frame([(4, item)], "item_id")).collect()
    assert sorted((str(r.doc_id), r.item_id, r.start_word, r.end_word) for r in rows) == [("1", 4, 2, 32), ("1", 4, 2, 32), ("None", 4, 0, 30)]


def test_empty_tables(frame):
    docs, bench = frame([(1, "a b c d e f g")]), frame([(1, "a b c d e f g")], "item_id")
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 1
    assert decontam.drop_contaminated(docs, bench).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = random.Random(3)
    index = decontam.Index([(0, "a b c d e f g h")])
    fp = index.prints[0]
    for _ in range(300):
        n = rng.randint(0, 30)
        other = fp ^ sum(1 << b for b in rng.sample(range(64), n))
        assert (index.candidates(4, other) == {0}) == (n <= index.radius)
