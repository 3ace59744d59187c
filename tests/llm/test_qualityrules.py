"""Statistics against a direct version; rules learned from labels that follow a known rule."""

import random
import re
from collections import Counter

from tracewright.llm import qualityrules


def direct(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t\n", "one", "a b", "a b c", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z ", "é😀 #tag *b* <p>", "a\x1cb\x85c d", "a b c d a b c e b c d", " lead and trail \n"]


def test_statistics_equal_direct_version(frame, long_text):
    texts = [*TEXTS, long_text, long_text + " " + long_text, "b c d " * 50]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = qualityrules.statistics(frame(list(enumerate(texts)))).collect()
    assert {r.id: tuple(r[n] for n in names) for r in rows} == {i: direct(t) for i, t in enumerate(texts)}


def corpus():
    rng, rows, labels = random.Random(3), [], []
    for k in range(600):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(80)]
        bad = k % 3 == 0
        for i in range(rng.randint(20, 60) if bad else rng.randint(0, 3)):
            words[i] += "#"
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    return rows, labels


def test_learned_rules_and_base_rules(spark, frame):
    rows, labels = corpus()
    extra = [(1000, "short"), (1001, "x y z " * 60), (1002, None), (1003, rows[0][1]), (1003, rows[0][1]), (1004, rows[1][1])]
    labels = spark.createDataFrame([*labels, (5, 0), (2000, 0), (7, None), (None, 1)], "doc_id bigint, quality int")
    out = qualityrules.judge(frame(rows + extra), labels).collect()
    assert len(out) == len(rows) + len(extra)
    wrong = [r.doc_id for r in out if r.doc_id < 600 and r.kept != (r.doc_id % 3 != 0)]
    assert len(wrong) <= 6
    kept = {r.doc_id: r.kept for r in out}
    assert [kept[k] for k in (1000, 1001, 1002, 1003, 1004)] == [False, False, False, False, True]
    assert {r.doc_id for r in out if r.base_failed} == {1000, 1001, 1002}
    rules = qualityrules.learn(qualityrules.statistics(frame(rows)), labels)
    assert 1 <= len(rules.rules) <= qualityrules.RULES and all(1 <= len(r) <= qualityrules.LONGEST for r in rules.rules) and "symbols_per_word >" in str(rules)


def test_without_labels(spark, frame):
    docs, none = frame([(1, "a b c d e f " + " ".join(f"w{i}" for i in range(60))), (2, "x")]), spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.doc_id: r.kept for r in qualityrules.judge(docs, none).collect()} == {1: True, 2: False}
    assert qualityrules.judge(docs.limit(0), none).count() == 0
    one_kind = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert qualityrules.learn(qualityrules.statistics(docs), one_kind).rules == []


def test_covering_prefers_the_rule_that_holds():
    cells = [((i % 4, i // 4), 30 if i % 4 == 3 and i // 4 >= 2 else 0, 0 if i % 4 == 3 and i // 4 >= 2 else 30) for i in range(16)]
    rules = qualityrules.cover(cells, cells, [3, 3])
    assert len(rules) == 1 and sorted(rules[0]) == [(0, True, 2), (1, True, 1)]


def test_main_path_has_no_python(frame):
    plan = qualityrules.statistics(frame([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
