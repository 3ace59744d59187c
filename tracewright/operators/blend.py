"""Decisions from probability tables: blends, thresholds and log offsets, each candidate scored in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import LABELS
from tracewright.functions.numbers import count_where, flag
from tracewright.operators.evaluate import composite, macro_f1
from tracewright.operators.localize import argmax, label_name, peaks
from tracewright.sources.traces import Traces


def grid(df: DataFrame, name: str, values: list) -> DataFrame:
    """Every row once per candidate value of a short fixed list."""
    return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def decided(tr: Traces, scored: DataFrame, key: str) -> DataFrame:
    """Truth and decision per candidate: largest score (lowest class on ties) with its peak turn."""
    d = scored.groupBy(key, "run_id").agg(argmax("score", "c").alias("c"))
    d = d.join(peaks(tr).select("run_id", "c", F.col("t").alias("tp")), ["run_id", "c"]).withColumn("yp", label_name(F.col("c")))
    t = tr.truth.select("run_id", F.col("label").alias("y"), F.col("success").alias("s"), F.col("fault_turn").alias("ft"))
    return d.join(t, "run_id").join(tr.pred.select("run_id", F.col("success").alias("sp")), "run_id")


def blend_curve(tr: Traces, alphas: list[float]) -> DataFrame:
    """Composite score of (1 - alpha) A + alpha B for every alpha."""
    g = grid(tr.label_probs, "alpha", alphas)
    g = g.withColumn("score", F.round((1 - F.col("alpha")) * F.col("pa") + F.col("alpha") * F.col("pb"), 9))
    return composite(tr, decided(tr, g, "alpha"), ["alpha"])


def best_alpha(curve: DataFrame) -> DataFrame:
    """Highest composite; the larger alpha wins ties."""
    c = F.round("composite", 9)
    return curve.orderBy(c.desc(), F.col("alpha").desc()).limit(1)


def gate_sweep(tr: Traces, thresholds: list[float]) -> DataFrame:
    """Two-stage decision: fault when P(fault) reaches the threshold, then the best fault class."""
    p = tr.label_probs
    two = p.groupBy("run_id").agg(F.max(F.when(F.col("c") == 0, 1 - F.col("pa"))).alias("fault"),
                                  F.max_by(F.when(F.col("c") > 0, F.col("c")), F.when(F.col("c") > 0, F.struct(F.col("pb"), -F.col("c")))).alias("kind"))
    g = grid(two, "threshold", thresholds).join(tr.truth.select("run_id", F.col("label").alias("y")), "run_id")
    g = g.withColumn("yp", F.when(F.round("fault", 9) >= F.col("threshold"), label_name(F.col("kind"))).otherwise("clean"))
    return macro_f1(g, ["threshold"])


def offset_candidates(base: list[float], step: float, bound: float = 0.40) -> list[list[float]]:
    """Neighbours of the offset vector: each fault class one step up or down, inside the bounds."""
    out = []
    for c in range(1, len(LABELS)):
        for sign in (1, -1):
            v = list(base)
            v[c] = round(v[c] + sign * step, 6)
            if abs(v[c]) <= bound + 1e-12:
                out.append(v)
    return out


def score_offsets(tr: Traces, candidates: list[list[float]]) -> DataFrame:
    """Composite of argmax(ln p + offset) for every candidate vector, scored together."""
    off = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in candidates])
    g = tr.label_probs.select("run_id", "c", "pa", F.posexplode(off).alias("candidate", "d"))
    shift: Column = F.get("d", F.col("c").cast("int"))
    g = g.withColumn("score", F.round(F.log(F.greatest("pa", F.lit(1e-15))) + shift, 9)).withColumn("candidate", F.col("candidate").cast("long"))
    return composite(tr, decided(tr, g, "candidate"), ["candidate"])


def averaged(tables: list[DataFrame]) -> DataFrame:
    """Mean of probability tables (run_id, c, p)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("run_id", "c").agg(F.avg("p").alias("p"))


def probability_checks(p: DataFrame) -> DataFrame:
    """Rows outside [0, 1] and runs whose classes do not sum to 1 or are not seven."""
    per = p.groupBy("run_id").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("k"), F.max(flag((F.col("p") < 0) | (F.col("p") > 1))).alias("out"))
    return per.agg(F.count(F.lit(1)).alias("runs"), count_where(F.col("out") > 0).alias("out_of_range"),
                   count_where(F.abs(F.col("s") - 1) > 1e-9).alias("bad_sum"), count_where(F.col("k") != len(LABELS)).alias("bad_classes"))
