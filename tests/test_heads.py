"""Reports that fit many models read one written table, and answer every run whatever the partitions are."""

import pytest
from pyspark.sql import functions as F

from tracewright.fixed import FAULTS, LABELS
from tracewright.operators import heads as H
from tracewright.operators.localize import AGGREGATE_COLS, label_index, window_aggregates
from tracewright.operators.turns import CAUSAL_COLS, WINDOW_COLS
from tracewright.sources.traces import Traces

RUNS, TURNS = 210, 4


@pytest.fixture
def tr(spark):
    """Runs whose label is told by column a; the blocks behind it are left out."""
    turns = spark.range(RUNS * TURNS).select(F.expr(f"id div {TURNS}").alias("run_id"), F.expr(f"id % {TURNS}").alias("t"))
    tr = Traces.of_messages(turns)
    tr.__dict__["runs"] = tr.run_sizes.withColumn("goal", F.lit(""))
    y = label_index(F.col("label")).cast("double")
    tr._built["foundation"] = tr.truth.select("run_id", y.alias("a"), F.lit(1.0).alias("b"), (F.col("run_id") % 3).cast("double").alias("c"))
    return tr


@pytest.fixture
def made(monkeypatch):
    names, keep = [], H.written
    monkeypatch.setattr(H, "written", lambda df, name, *a, **kw: names.append(name) or keep(df, name, *a, **kw))
    return names


def test_transfer_scores_every_slice(tr, made):
    r = F.col("run_id")
    flags = tr.truth.select("run_id", (r < 100).alias("low"), (r % 2 == 0).alias("even"), F.lit(True).alias("all"), F.lit(False).alias("none"), (r < 7).alias("few"),
                            F.when(r < 50, True).alias("unknown"), F.col("label").isin(LABELS[:3]).alias("three"))
    names = ["low", "even", "all", "none", "few", "unknown", "three"]
    got = {x.slice: x for x in H.transfer_scores(tr, flags, names, ["a", "b", "c"], 5, 4).collect()}
    assert {s: x.n for s, x in got.items()} == {"low": 100, "even": 105, "few": 7, "unknown": 50, "three": 90}
    for s, x in got.items():  # a class that no fit saw is never answered, and a run of each class makes one fold only
        assert x.macro_f1 == 0 if s == "three" else x.macro_f1 > 0.5
        assert x.reference is None and x.penalty is None if s == "few" else x.reference > 0.5 and x.penalty == x.reference - x.macro_f1
    assert made == ["transfer_rows"]  # no fit or answer is a plan of joins and unions of its own
    assert H.transfer_scores(tr, flags, ["all", "none"], ["a", "b", "c"], 5, 4).count() == 0


def test_ablation_reads_one_table(tr, made):
    got = {x.dropped: x.macro_f1 for x in H.ablation(tr, {"told": ["a"], "other": ["b", "c"]}, 2, 5, 4).collect()}
    assert set(got) == {"nothing", "told", "other"} and got["other"] > 0.5 > got["told"]
    assert made == ["ablation_rows"]


def test_ranker_reads_one_table(spark, tr, made):
    at = F.when(F.col("t") == F.col("fault_turn"), label_index(F.col("label"))).otherwise(0).cast("double")
    x = tr.plain_messages.join(tr.truth, "run_id").select("run_id", "t", *[at.alias(c) for c in CAUSAL_COLS])
    tr._built["causal_turns"] = x
    folds = tr.truth.select("run_id", F.floor(F.col("run_id") / 7 % 2).alias("fold"))
    got = H.turn_ranker(tr, folds, 2, rounds=2, depth=3).join(tr.truth.withColumnRenamed("label", "y"), "run_id").collect()
    assert sorted((g.run_id, g.label) for g in got) == sorted((r, c) for r in range(RUNS) for c in FAULTS)
    assert all(g.t == g.fault_turn and g.p > 0.5 for g in got if g.label == g.y)
    assert all(g.t == 0 and g.p < 0.5 for g in got if g.y == "clean")
    assert made == ["ranker_rows", "ranked_turns", "ranked_turns"]


def test_stacking_writes_windows_once(tr, made):
    y = label_index(F.col("label")).cast("double")
    tr._built["windows"] = tr.plain_messages.join(tr.truth, "run_id").select("run_id", "t", *[y.alias(c) for c in WINDOW_COLS], y.alias("y"), F.lit(0.25).alias("weight"))
    p = H.stacked_label_probabilities(tr, 2, 2, trees=5, depth=4)
    assert H.probability_rows_ok(p, 7).filter("valid and complete").count() == RUNS
    right = H.decisions(p).join(tr.truth.select("run_id", F.col("label").alias("y")), "run_id").filter("label = y").count()
    assert right > RUNS / 2 and made.count("window_rows") == 1 and "train" not in made


def test_window_columns_equal_plain_ones(spark):
    """Chunks of 16 turns: equal values, runs shorter than three turns, a class under and over the high mark."""
    p = {(r, t, c): ((t * 7 + c * 3 + r) % 11 + 1) / 12 for r, n in ((1, 70), (2, 1), (3, 2), (4, 17)) for t in range(n) for c in range(7)}
    sizes = {r: 1 + max(t for q, t, _ in p if q == r) for r in (1, 2, 3, 4)}
    got = window_aggregates(spark.createDataFrame([(*k, v) for k, v in p.items()], "run_id long, t long, c long, p double").repartition(3),
                            spark.createDataFrame(list(sizes.items()), "run_id long, n long")).collect()
    assert len(got) == 4 and list(got[0].asDict()) == ["run_id", *AGGREGATE_COLS]
    for g in got:
        for c, name in enumerate(FAULTS, 1):
            v = [p[g.run_id, t, c] for t in range(sizes[g.run_id])]
            top = sorted(v, reverse=True)[:3]
            assert g[f"p_{name}_amax"] == top[0] and g[f"p_{name}_atop3"] == pytest.approx(sum(top) / len(top))
            assert g[f"p_{name}_pos_max"] == v.index(top[0]) / len(v) and g[f"p_{name}_area"] == pytest.approx(sum(v) / len(v))
            assert g[f"p_{name}_gap12"] == pytest.approx(top[0] - top[1] if len(top) > 1 else 0)
