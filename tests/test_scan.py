"""Chunked scans against plain Python, with one key that owns a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators.graph import scc_members
from tracewright.plans import scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    sizes = {0: 400, **{k: rng.randint(1, 120) for k in range(1, 14)}}
    return [(k, t, rng.choice([None, rng.randint(-9, 9)])) for k, n in sizes.items() for t in range(n)]


def test_running_all_kinds(spark, rows):
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = scan.running(df, ["k"], ["t"], {"s": ("sum", "v"), "x": ("max", "v", False), "l": ("last", "v")}).collect()
    back = scan.running(df, ["k"], ["t"], {"r": ("last", "v", False), "m": ("min", "v")}, reverse=True).collect()
    by = {}
    for k, t, v in rows:
        by.setdefault(k, []).append(v)
    for r in got:
        seen = by[r.k][: r.t + 1]
        vals = [v for v in seen if v is not None]
        assert r.s == sum(vals) and r.l == (vals[-1] if vals else None)
        prev = [v for v in seen[:-1] if v is not None]
        assert r.x == (max(prev) if prev else None)
    for r in back:
        after = [v for v in by[r.k][r.t + 1:] if v is not None]
        here = [v for v in by[r.k][r.t:] if v is not None]
        assert r.r == (after[0] if after else None) and r.m == (min(here) if here else None)


def test_framed_crosses_chunks(spark, rows):
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = scan.framed(df, ["k"], 5, 4, lambda w: {"s": F.sum("v").over(w.rowsBetween(-5, 4)), "p": F.lag("t").over(w)}).collect()
    assert len(got) == len(rows)
    by = {}
    for k, t, v in rows:
        by.setdefault(k, []).append(v)
    for r in got:
        win = [v for v in by[r.k][max(0, r.t - 5): r.t + 5] if v is not None]
        assert r.s == (sum(win) if win else None) and r.p == (r.t - 1 if r.t else None)


def test_lookup_sides_and_ties(spark):
    ev = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 9, "c"), (2, 1, "d")], "k long, t long, x string").withColumn("o", F.col("x") == "c")
    pt = spark.createDataFrame([(1, 5), (1, 9), (1, 40), (2, 0), (3, 3)], "k long, t long")

    def ask(direction, inclusive):
        r = scan.lookup(pt, ev, ["k"], {"x": ("last", "x"), "n": ("sum", F.lit(1))}, direction, inclusive, tie="o").collect()
        return {(a.k, a.t): (a.x, a.n) for a in r}

    assert ask("prev", False) == {(1, 5): (None, 0), (1, 9): ("a", 1), (1, 40): ("c", 3), (2, 0): (None, 0), (3, 3): (None, 0)}
    assert ask("prev", True)[(1, 9)] == ("c", 3)
    assert ask("next", False) == {(1, 5): ("b", 2), (1, 9): (None, 0), (1, 40): (None, 0), (2, 0): ("d", 1), (3, 3): (None, 0)}
    assert ask("next", True)[(1, 5)] == ("a", 3)


def test_percentiles_match_numpy(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[2] is not None], "k long, t long, v long")
    got = {r.k: r for r in scan.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    disc = {r.k: r.d for r in scan.percentiles(df, ["k"], "v", {"d": 0.9}, how="disc").collect()}
    by = {}
    for k, _t, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    for k, vs in by.items():
        assert got[k].a == pytest.approx(np.percentile(vs, 50)) and got[k].b == pytest.approx(np.percentile(vs, 90))
        assert disc[k] == sorted(vs)[int(np.ceil(0.9 * len(vs))) - 1]
    every = [v for vs in by.values() for v in vs]
    assert scan.percentiles(df, [], "v", {"m": 0.3}).first().m == pytest.approx(np.percentile(every, 30))


def test_bracket_levels_equal_a_stack(spark):
    rng = random.Random(11)
    rows = [(k, t, rng.choice([1, -1])) for k in range(4) for t in range(90)]
    got = {(r.k, r.t): r.level for r in scan.bracket_levels(spark.createDataFrame(rows, "k long, t long, d int"), ["k"], "d").collect()}
    depth = {}
    for k, t, d in rows:
        now = depth.get(k, 0)
        want = now + 1 if d > 0 else (now if now > 0 else None)
        depth[k] = now + 1 if d > 0 else max(0, now - 1)
        assert got[(k, t)] == want


def components(nodes, edges):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    for n in list(reach):
        for m in list(reach[n]):
            reach[n] |= reach[m]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("size,degree", [(7, 2), (70, 1)])
def test_components_small_and_large(spark, size, degree):
    rng = random.Random(size)
    edges, nodes, want = [], [], {}
    for run in range(3 if size < 60 else 1):
        ns = [f"n{i:03d}" for i in range(size)]
        es = {(rng.choice(ns), rng.choice(ns)) for _ in range(size * degree)}
        edges += [(run, a, b) for a, b in es]
        nodes += [(run, n) for n in ns]
        for n, c in components(ns, es).items():
            want[(run, n)] = c
    e = spark.createDataFrame(edges, "run_id long, src string, dst string")
    n = spark.createDataFrame(nodes, "run_id long, node string")
    assert {(r.run_id, r.node): r.comp for r in scc_members(e, n).collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_all_events_are_not_broadcast(spark):
    from tracewright.operators import turns
    from tracewright.sources.traces import Traces

    tr = Traces.load(spark, "/root/testdata/sf0.001")
    turns_of = tr.messages.select("run_id", "t", "sender")
    again = spark.range(10).selectExpr("id AS run_id", "id AS t").join(tr.messages.select("run_id", "t"), ["run_id", "t"])
    assert "BroadcastHashJoin" not in plan_of(again)
    scanned = scan.running(turns_of, ["run_id"], ["t"], {"x": ("max", "t")}, chunk=F.col("t"))  # every row is a chunk of its own
    assert "BroadcastHashJoin" not in plan_of(scanned)
    assert "BroadcastHashJoin" not in plan_of(turns_of.join(scanned.select("run_id", "t", "x"), ["run_id", "t"]))
    assert "BroadcastHashJoin" not in plan_of(turns.turn_windows(tr))


def test_run_blocks_are_planned_apart(spark):
    from tracewright.operators import runfeatures
    from tracewright.sources.traces import Traces

    plan = plan_of(runfeatures.run_block(Traces.load(spark, "/root/testdata/sf0.001")))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
