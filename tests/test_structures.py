"""Structures that keep their shape at scale: oriented triangles around a hub, and column classes told apart by values."""

import itertools
import random

from pyspark.sql import functions as F

from tracewright.operators import matching, stats


def edges(spark, pairs, run=1):
    return spark.createDataFrame([(run, a, b) for a, b in pairs], "run_id long, src string, dst string")


def direct(pairs):
    have = set(pairs)
    nodes = sorted({x for p in pairs for x in p})
    return sum((a, b) in have and (b, c) in have and (c, a) in have for a, b, c in itertools.permutations(nodes, 3)) / 3


def test_triangles_equal_all_triples(spark):
    rng = random.Random(4)
    for n, m in ((5, 12), (9, 40), (12, 30)):
        pairs = list({(f"a{rng.randrange(n)}", f"a{rng.randrange(n)}") for _ in range(m)})
        got = matching.triangles(edges(spark, pairs)).collect()
        want = direct([p for p in pairs if p[0] != p[1]])
        assert (got[0].triangles if got else 0) == want


def test_a_hub_makes_few_wedges(spark):
    spokes = [p for i in range(10_000) for p in ((f"s{i:05d}", "hub"), ("hub", f"s{i:05d}"))]
    rim = [(f"s{i:05d}", f"s{i + 1:05d}") for i in range(0, 9_998)]
    pairs = matching.oriented(edges(spark, spokes + rim)).cache()
    m = pairs.count()
    assert matching.wedges(pairs).count() <= m * int(m**0.5)
    assert matching.wedges(pairs).count() < 3 * m  # the hub itself would make 50 million
    assert matching.triangles(edges(spark, spokes + rim)).first().triangles == 9_998
    pairs.unpersist()


def test_colliding_fingerprints_are_told_apart(spark):
    df = spark.range(300).select(F.col("id").alias("run_id"), (F.col("id") % 7).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 5).alias("c"),
                                 (F.col("id") % 5 + 1e-9).alias("d"), F.when(F.col("id") != 299, F.col("id") % 7).otherwise(6).alias("e"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("double").alias("g"))
    cols = list("abcdefg")
    same = lambda frame, names: spark.createDataFrame([(c, 1) for c in names], "feature string, print long")
    want = [("a", 2, ["a", "b"]), ("c", 2, ["c", "d"]), ("f", 2, ["f", "g"])]
    for prints in (same, stats.column_fingerprints):
        got = sorted(map(tuple, stats.identical_columns(df, cols, prints).collect()))
        assert [g for g in got if g[0] != "f"] == want[:2]
    assert sorted(map(tuple, stats.identical_columns(df, cols, same).collect())) == want
    assert stats.identical_columns(df, ["a", "c"]).count() == 0
