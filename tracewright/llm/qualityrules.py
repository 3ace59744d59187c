"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of each text are columns. From labelled documents Spark counts how
many good and bad ones fall into each cell of statistics cut at their
percentiles; sequential covering on that table grows conjunctions of thresholds
that hold for bad documents, prunes each on cells kept aside, takes out what it
covers and goes on. The list becomes one conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
FEW_WORDS = 50
REPEATED_PERCENT = 50
#: Labelled documents that the rules are learned from at most; those whose ids hash smallest.
SAMPLE = 40_000
#: Cuts of each statistic, thresholds of one rule, rules of the list.
CUTS, LONGEST, RULES = 8, 3, 12
#: Share of bad documents that a rule needs among what it covers, and how many it must cover (a quarter of it among those aside).
PRECISION, COVER = 0.95, 8


def _repeats(hashes: Column) -> Column:
    """Sorted array of (window hash, place) -> number of words in windows that occur twice or more."""
    n = F.size(hashes)
    null = F.lit(None).cast("struct<h:bigint,i:int>")
    before = F.concat(F.array(null), F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(hashes, 2, F.greatest(n - 1, F.lit(0))), F.array(null))
    twice = F.zip_with(F.zip_with(hashes, before, lambda x, b: F.struct(x["i"].alias("i"), x["h"].alias("h"), (x["h"] == b["h"]).alias("same"))), after,
                       lambda x, a: F.when(F.coalesce(x["same"], F.lit(False)) | F.coalesce(x["h"] == a["h"], F.lit(False)), x["i"]))
    return F.array_sort(F.array_compact(twice))


def _covered(places: Column) -> Column:
    """Words of three-word windows that begin at the sorted ``places``."""
    following = F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0)))
    steps = F.zip_with(places, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _kept_apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once: a generator of one row stands between them and whatever reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper)``, a row per input row.

    Words are parted by ASCII white space; a null text has none. Repeated windows are found by sorting a text's own window
    hashes (64 bits), so the cost is the text's length times its logarithm.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    rows = _kept_apart(rows, words=F.filter(F.split("t", SPACE), lambda w: w != ""), lines=F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    second, third = (F.slice("words", k, F.greatest(F.size("words") - 2, F.lit(0))) for k in (2, 3))
    first = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    windows = F.transform(F.arrays_zip(first.alias("a"), second.alias("b"), third.alias("c")), lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    rows = rows.select("id", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
                       (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).alias("n_symbols"),
                       F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                       (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).alias("n_upper"), F.sort_array(windows).alias("windows"))
    rows = _kept_apart(rows, w=F.col("windows")).drop("windows")
    rows = _kept_apart(rows, places=_repeats(F.col("w"))).drop("w")
    return rows.select("id", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
                       _covered(F.col("places")).cast("long").alias("n_repeat_words"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_upper").cast("long").alias("n_upper"))


#: What the rules are made of: shares and means, 0 where nothing is to be divided by.
def features() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {"symbols_per_word": share("n_symbols", "n_words"), "chars_per_word": share("word_chars", "n_words"),
            "repeated_words": share("n_repeat_words", "n_words"), "repeated_lines": share("n_dup_lines", "n_lines"),
            "upper_chars": share("n_upper", "word_chars"), "words": F.col("n_words").cast("double"), "words_per_line": share("n_words", "n_lines")}


def base_failed() -> Column:
    return (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


@dataclass
class Rules:
    """Ordered conjunctions of (feature, above, threshold); the first that holds rejects."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def rejected(self) -> Column:
        """Number of the first rule that holds, as a conditional expression; null if none does."""
        by, out = features(), F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules))):
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & (by[name] > cut if above else by[name] <= cut)
            out = F.when(holds, F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("bad if " + " and ".join(f"{n} {'>' if a else '<='} {c:.6g}" for n, a, c in r) for r in self.rules)


def _counts(cells: list[tuple[tuple[int, ...], int, int]], rule: list[tuple[int, bool, int]]) -> tuple[int, int]:
    bad = good = 0
    for bins, b, g in cells:
        if all(bins[f] > k if above else bins[f] <= k for f, above, k in rule):
            bad, good = bad + b, good + g
    return bad, good


def cover(grow: list, prune: list, cuts: list[int]) -> list[list[tuple[int, bool, int]]]:
    """Sequential covering of the bad cells. A cell is (bin of each feature, bad, good)."""
    out = []
    while len(out) < RULES:
        rule: list[tuple[int, bool, int]] = []
        inside = grow
        while len(rule) < LONGEST:
            sums: dict[tuple[int, int], list[int]] = {}
            for bins, b, g in inside:
                for f, k in enumerate(bins):
                    s = sums.setdefault((f, k), [0, 0])
                    s[0], s[1] = s[0] + b, s[1] + g
            bad, good = sum(c[1] for c in inside), sum(c[2] for c in inside)
            best = None
            for f, n in enumerate(cuts):
                b = g = 0
                for k in range(n):
                    s = sums.get((f, k), (0, 0))
                    b, g = b + s[0], g + s[1]
                    for above, x, y in ((False, b, g), (True, bad - b, good - g)):
                        if x >= COVER and y < good:
                            gain = x * ((x + 1) / (x + y + 2) - (bad + 1) / (bad + good + 2))
                            if best is None or gain > best[0]:
                                best = gain, (f, above, k)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            f, above, k = best[1]
            inside = [c for c in inside if (c[0][f] > k) == above]
            if not sum(c[2] for c in inside):
                break
        if not rule:
            break

        def worth(r):
            bad, good = _counts(prune, r)
            return (bad - good) / (bad + good + 1) if bad + good else -1.0

        while len(rule) > 1 and max(worth(rule[:i] + rule[i + 1 :]) for i in range(len(rule))) >= worth(rule):
            i = max(range(len(rule)), key=lambda i: worth(rule[:i] + rule[i + 1 :]))
            rule = rule[:i] + rule[i + 1 :]
        sure = [_counts(part, rule) for part in (grow, prune)]
        if any(b < least or b < PRECISION * (b + g) for (b, g), least in zip(sure, (COVER, COVER // 4))):
            break
        out.append(rule)
        held = [[c for c in part if not all(c[0][f] > k if above else c[0][f] <= k for f, above, k in rule)] for part in (grow, prune)]
        grow, prune = held
    return out


def learn(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Rules:
    """Learn from labelled statistics (label 0 is bad; nulls are left out), at most about SAMPLE documents.

    Documents that fail the base rules take no part. A third of the sample is kept aside for pruning. What comes to the
    driver is a table of counts by cell, no larger than the sample.
    """
    named = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label_col}`").alias("label")).dropna().dropDuplicates(["id"])
    n = named.count()
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    named = named.filter(hashed < int((1 << 32) * min(1.0, SAMPLE / max(n, 1)))).withColumn("aside", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(3)) == 0)
    by = features()
    table = stats.filter(~base_failed()).join(named, "id").select("label", "aside", *[c.alias(f) for f, c in by.items()])
    table = written(table, "labelled")
    at = [i / CUTS for i in range(1, CUTS)]
    found = table.groupBy().agg(*[F.percentile(f, F.array(*map(F.lit, at))).alias(f) for f in by]).first()
    most = table.groupBy("label").agg(*[F.min(f).alias(f"{f}_min") for f in by], *[F.max(f).alias(f"{f}_max") for f in by]).collect()
    cuts = {}
    for f in by:  # percentiles, and the range of either label
        edges = {r[f"{f}_{e}"] for r in most for e in ("min", "max")}
        cuts[f] = sorted({float(x) for x in [*(found[f] or []), *edges]})
    bins = [sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in by]
    cells = table.groupBy("aside", *bins).agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") != 0).alias("good")).collect()
    parts = [[(tuple(r[f] for f in by), r.bad, r.good) for r in cells if r.aside == side] for side in (False, True)]
    names = list(by)
    rules = cover(parts[0], parts[1], [len(cuts[f]) for f in names])
    used = sorted({(names[f], cuts[names[f]][k]) for rule in rules for f, _, k in rule})
    if not used:
        return Rules()
    # a threshold stands halfway between the labelled values on either side of its cut
    sides = table.groupBy().agg(*[x for i, (f, c) in enumerate(used) for x in (
        F.max(F.when(F.col(f) <= c, F.col(f))).alias(f"below{i}"), F.min(F.when(F.col(f) > c, F.col(f))).alias(f"above{i}"))]).first()
    middle = {u: u[1] if sides[f"below{i}"] is None or sides[f"above{i}"] is None else (sides[f"below{i}"] + sides[f"above{i}"]) / 2 for i, u in enumerate(used)}
    return Rules([[(names[f], above, middle[names[f], cuts[names[f]][k]]) for f, above, k in rule] for rule in rules])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule)``.

    kept: the base rules hold and no learned rule does; rule is the number of the first learned rule that does. Without
    labels, or with labels of one kind only, the base rules decide alone. Repeated rows each give a row.
    """
    stats = written(statistics(docs, id_col, text_col), "statistics")
    rule = learn(stats, labels, label_id, label_col).rejected()
    return stats.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~base_failed() & rule.isNull()).alias("kept"), rule.alias("rule"))
