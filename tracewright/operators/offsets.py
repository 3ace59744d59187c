"""Log offsets of class decisions: every value of a grid scored in one pass by breakpoints, and a cross-fitted search.

A decision is the class with the largest ln(p) + offset, the lowest class on
ties. With all offsets but one held still, a run flips to that class at one
value, its breakpoint. Breakpoints are counted by grid value, and running sums
of what they change give the scores of the whole grid, so a pass costs one
aggregation of the runs however fine the grid is. Logarithms are rounded to
nine digits and offsets are whole numbers of grid units: decisions are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.fixed import LABELS, WEIGHTS
from tracewright.functions.numbers import flag
from tracewright.operators.basics import slices
from tracewright.operators.localize import label_index, peaks
from tracewright.operators.resample import stratified_folds
from tracewright.sources.traces import Traces

#: Grid of offsets, in units of 0.0125 (fixed values): the steps of the search and the bound.
UNIT, STEPS, BOUND = 0.0125, (16, 8, 4, 2, 1), 32
_DIGITS = 10**9
_UNIT = round(UNIT * _DIGITS)
_N = len(LABELS)


def decision_rows(tr: Traces, probs: DataFrame | None = None) -> DataFrame:
    """One row per run: what its decision depends on. ``probs`` is (run_id, c, p), model A's by default.

    logs: ln(max(p, 1e-15)) by class, in units of 1e-9; hits: whether a decision for the class hits class and turn.
    """
    probs = tr.label_probs.select("run_id", "c", F.col("pa").alias("p")) if probs is None else probs
    truth = tr.truth.select("run_id", label_index(F.col("label")).alias("y"), F.col("success").alias("s"), F.col("fault_turn").alias("ft"))
    x = probs.join(peaks(tr).select("run_id", "c", F.col("t").alias("tp")), ["run_id", "c"], "left").join(truth, "run_id")
    hit = (F.col("c") == F.col("y")) & (F.col("y") > 0) & (F.col("tp") >= 0) & (F.abs(F.col("tp") - F.col("ft")) <= 2)
    log = F.round(F.log(F.greatest("p", F.lit(1e-15))) * _DIGITS).cast("long")
    rows = x.groupBy("run_id", "y", "s").agg(F.sort_array(F.collect_list(F.struct("c", log.alias("log"), flag(hit).alias("hit")))).alias("k"))
    robust = slices(tr).filter("robust").select("run_id", F.lit(1).alias("robust"))
    rows = rows.join(robust, "run_id", "left").join(tr.pred.select("run_id", F.col("success").alias("sp")), "run_id")
    return rows.select("run_id", F.col("y").cast("int").alias("y"), "s", "sp", F.coalesce("robust", F.lit(0)).alias("robust"),
                       F.col("k.log").alias("logs"), F.transform("k.hit", lambda h: F.coalesce(h, F.lit(0))).alias("hits"))


def _shifts(units: dict[int, list[int]]) -> Column:
    return F.create_map(*[x for g, u in units.items() for x in (F.lit(g).cast("long"), F.array(*[F.lit(v * _UNIT).cast("long") for v in u]))])[F.col("g")]


def sweep(rows: DataFrame, units: dict[int, list[int]]) -> DataFrame:
    """``(g, c, u, macro_f1, robustness_f1, success_f1, fault_turn_hit2, composite)``: class c's offset at u, the others as in ``units``.

    ``rows`` are decision rows with a group g; each group has offsets of its own.
    """
    scored = rows.withColumn("score", F.zip_with("logs", _shifts(units), lambda a, b: a + b))
    events = []
    for c in range(1, _N):
        others = F.array(*[F.struct(F.col("score")[k].alias("score"), F.lit(-k).alias("less")) for k in range(_N) if k != c])
        best = F.array_max(others)
        o = -best["less"]
        # the smallest unit at which c wins: it must exceed a lower class and may equal a higher one
        gap = best["score"] + flag(o < c) - F.col("logs")[c]
        at = F.greatest(F.ceil(gap / F.lit(_UNIT)).cast("int"), F.lit(-BOUND))
        events.append(F.struct(F.lit(c).alias("c"), o.cast("int").alias("o"), at.alias("at")))
    flips = scored.select("g", "y", "robust", "hits", F.inline(F.array(*events)))
    change = lambda u, k, sign: F.struct(u.cast("int").alias("u"), k.cast("int").alias("k"), F.lit(sign).alias("sign"))
    o, c, at = F.col("o"), F.col("c"), F.col("at")
    changes = flips.select("g", "y", "robust", "hits", "c", F.inline(F.array(change(F.lit(-BOUND), o, 1), change(at, o, -1), change(at, c, 1)))).filter(F.col("u") <= BOUND)
    sign, right = F.col("sign"), flag(F.col("y") == F.col("k"))
    sums = {"pred": sign, "tp": sign * right, "rpred": sign * F.col("robust"), "rtp": sign * right * F.col("robust"), "hit": sign * F.element_at("hits", F.col("k") + 1)}
    found = changes.groupBy("g", "c", "u", "k").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    spark = rows.sparkSession
    grid = spark.createDataFrame([(g, c) for g in units for c in range(1, _N)], "g long, c int").select("g", "c", F.explode(F.sequence(F.lit(-BOUND), F.lit(BOUND))).alias("u"))
    grid = grid.select("g", "c", "u", F.explode(F.sequence(F.lit(0), F.lit(_N - 1))).alias("k"), *[F.lit(0).cast("long").alias(n) for n in sums])
    dense = found.unionByName(grid).groupBy("g", "c", "u", "k").agg(*[F.sum(n).alias(n) for n in sums])
    so_far = Window.partitionBy("g", "c", "k").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    curve = dense.select("g", "c", "u", "k", *[F.sum(n).over(so_far).alias(n) for n in sums])

    support = rows.select("g", F.col("y").alias("k"), "robust").groupBy("g", "k").agg(F.count("*").alias("n"), F.sum("robust").alias("rn"))
    s, sp = F.col("s"), F.col("sp")
    whole = rows.groupBy("g").agg(F.sum(flag(F.col("y") > 0)).alias("faulty"), F.sum(flag((s == 1) & (sp == 1))).alias("both"), F.sum(flag(s != sp)).alias("apart"))
    curve = curve.join(support, ["g", "k"], "left").na.fill(0, ["n", "rn"])
    f1 = lambda tp, pred, n: F.when(F.col(pred) + F.col(n) > 0, 2 * F.col(tp) / (F.col(pred) + F.col(n))).otherwise(F.lit(0.0))

    def macro(tp, pred, n):
        return F.coalesce(F.avg(F.when(F.col(n) > 0, f1(tp, pred, n))), F.avg(f1(tp, pred, n)))

    out = curve.groupBy("g", "c", "u").agg(macro("tp", "pred", "n").alias("macro_f1"), macro("rtp", "rpred", "rn").alias("robustness_f1"), F.sum("hit").alias("hit")).join(whole, "g")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumns({"success_f1": safe(2 * F.col("both"), 2 * F.col("both") + F.col("apart")), "fault_turn_hit2": safe(F.col("hit"), F.col("faulty"))})
    total = sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.select("g", "c", "u", *WEIGHTS, total.alias("composite"))


def search(rows: DataFrame, groups: list[int]) -> dict[int, tuple[list[int], float]]:
    """Offsets (in units) and composite of each group: the best legal step is taken while it improves, then steps are halved.

    Equal composites (to ten digits) prefer the smaller sum of squares, then the lower class, then the step up. All groups
    search side by side; a pass over the runs serves every step length until one of them moves. The driver sees grids only.
    """
    units, step = {g: [0] * _N for g in groups}, dict.fromkeys(groups, 0)
    now: dict[int, float] = {}
    while open_ := [g for g in groups if step[g] < len(STEPS)]:
        got = sweep(rows.filter(F.col("g").isin(open_)), {g: units[g] for g in open_}).select("g", "c", "u", "composite").collect()
        curve = {(r.g, r.c, r.u): round(r.composite, 10) for r in got}
        for g in open_:
            now[g] = curve[g, 1, units[g][1]]
            while step[g] < len(STEPS):
                moves = []
                for c in range(1, _N):
                    for sign in (1, -1):
                        u = units[g][c] + sign * STEPS[step[g]]
                        if abs(u) <= BOUND:
                            moves.append((-curve[g, c, u], sum(v * v for v in units[g]) - units[g][c] ** 2 + u * u, c, -sign, u))
                best = min(moves)
                if -best[0] > now[g]:
                    units[g] = [*units[g][: best[2]], best[4], *units[g][best[2] + 1 :]]
                    now[g] = -best[0]
                    break
                step[g] += 1
    return {g: (units[g], now[g]) for g in groups}


def fit_rows(rows: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Decision rows once for each fold they are not in: group g is fitted on the other folds' runs."""
    return rows.join(folds.select("run_id", "fold"), "run_id").select(
        "*", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda x: x != F.col("fold"))).alias("g")).drop("fold")


def decide(rows: DataFrame, units: dict[int, list[int]]) -> DataFrame:
    """Decision rows with a group -> the class index that each group's offsets choose, as ``c``."""
    score = F.zip_with("logs", _shifts(units), lambda a, b: a + b)
    return rows.withColumn("c", (F.array_position(score, F.array_max(score)) - 1).cast("int"))


def cross_fitted(tr: Traces, k: int = 3, seed: int = 42, probs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``((run_id, y, c, fold), (fold, offsets, fit_composite))``: each run decided by offsets that the other folds chose."""
    rows = decision_rows(tr, probs)
    folds = stratified_folds(tr.truth, k, seed)
    found = search(fit_rows(rows, folds, k), list(range(k)))
    own = rows.join(folds.select("run_id", F.col("fold").cast("long").alias("g")), "run_id")
    table = [(g, [u * UNIT for u in units], float(score)) for g, (units, score) in found.items()]
    return decide(own, {g: u for g, (u, _) in found.items()}).withColumnRenamed("g", "fold"), tr.spark.createDataFrame(table, "fold long, offsets array<double>, fit_composite double")
