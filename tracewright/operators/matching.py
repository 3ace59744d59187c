"""Joins between ordered events of a run, done as scans over one line per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.scan import lookup
from tracewright.sources.traces import Traces


def first_replies(tr: Traces) -> DataFrame:
    """Every assignment with the turn of its receiver's next message (null when none)."""
    a = tr.messages.filter("is_assign").select("run_id", F.col("receiver").alias("agent"), "t", "n", "sender", "intent")
    said = tr.messages.select("run_id", F.col("sender").alias("agent"), "t")
    return lookup(a, said, ["run_id", "agent"], {"reply_t": ("min", "t")}, direction="next").withColumnRenamed(
        "agent", "receiver")


def delivered_keys(tr: Traces) -> DataFrame:
    """Distinct (run, agent, intent) for which the agent delivered or produced something."""
    d = tr.messages.filter("is_delivery").select("run_id", F.col("sender").alias("receiver"), "intent")
    a = tr.artifacts.select("run_id", F.col("by").alias("receiver"), F.col("subtask").alias("intent"))
    return d.unionByName(a).distinct()


def undelivered(tr: Traces) -> DataFrame:
    """Assignments whose receiver never delivered that intent."""
    a = tr.messages.filter("is_assign").select("run_id", "t", "n", "sender", "receiver", "intent")
    return a.join(delivered_keys(tr), ["run_id", "receiver", "intent"], "left_anti")


def delivered_assignments(tr: Traces) -> DataFrame:
    """Assignments answered by a later same-intent message of the receiver, or ever delivered."""
    a = tr.messages.filter("is_assign").select("run_id", "t", "n", "sender", F.col("receiver").alias("agent"), "intent")
    said = tr.messages.select("run_id", F.col("sender").alias("agent"), "intent", "t")
    later = lookup(a, said, ["run_id", "agent", "intent"], {"later_t": ("min", "t")}, direction="next")
    keys = delivered_keys(tr).withColumn("ever", F.lit(True)).withColumnRenamed("receiver", "agent")
    both = later.join(keys, ["run_id", "agent", "intent"], "left")
    return both.filter(F.col("later_t").isNotNull() | F.col("ever")).select(
        "run_id", "t", "sender", F.col("agent").alias("receiver"), "intent")


def pair_edges(df: DataFrame, src: str = "sender", dst: str = "receiver") -> DataFrame:
    """Directed edges with counts and first turn."""
    return df.groupBy("run_id", F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs that have an edge in both directions (one row per pair).

    Both directions meet by grouping on the unordered pair, so no self join is needed.
    """
    e = edges.filter(F.col("src") != F.col("dst"))
    up = F.col("src") < F.col("dst")
    return e.groupBy("run_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.when(up, F.col("cnt"))).alias("cnt_ab"), F.max(F.when(~up, F.col("cnt"))).alias("cnt_ba"),
        F.max(F.when(up, F.col("first_t"))).alias("first_ab"), F.max(F.when(~up, F.col("first_t"))).alias("first_ba"),
        F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.sum("cnt").alias("cnt"),
    ).filter(F.col("cnt_ab").isNotNull() & F.col("cnt_ba").isNotNull())


def oriented(edges: DataFrame) -> DataFrame:
    """``(run_id, lo, hi, forth, back)``: each unordered pair once, from its end with fewer neighbours to the other one.

    forth and back (0 or 1) tell whether the edge lo -> hi and the edge hi -> lo are there. lo and hi are structs of degree and
    name. At most 2 sqrt(m) pairs of a run with m pairs leave one node, as each of them leads to a node with as many again.
    Pairs grow with the runs, so they are merged and never broadcast.
    """
    e = edges.filter(F.col("src") != F.col("dst"))
    up = F.col("src") < F.col("dst")
    pairs = e.groupBy("run_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.when(up, 1).otherwise(0)).alias("ab"), F.max(F.when(up, 0).otherwise(1)).alias("ba"))
    degree = pairs.select("run_id", F.explode(F.array("a", "b")).alias("node")).groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("d"))
    of = lambda end: degree.select("run_id", F.col("node").alias(end), F.struct("d", "node").alias(f"at_{end}"))
    j = pairs.join(of("a"), ["run_id", "a"]).join(of("b"), ["run_id", "b"])
    first = F.col("at_a") < F.col("at_b")
    return j.select("run_id", F.least("at_a", "at_b").alias("lo"), F.greatest("at_a", "at_b").alias("hi"),
                    F.when(first, F.col("ab")).otherwise(F.col("ba")).alias("forth"), F.when(first, F.col("ba")).otherwise(F.col("ab")).alias("back")).hint("merge")


def wedges(pairs: DataFrame) -> DataFrame:
    """``(run_id, x, y, z, ...)``: two oriented pairs x-y and x-z that leave x, y before z; of m pairs there are O(m sqrt(m))."""
    xy = pairs.select("run_id", F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("forth").alias("x_y"), F.col("back").alias("y_x"))
    xz = pairs.select("run_id", F.col("lo").alias("x"), F.col("hi").alias("z"), F.col("forth").alias("x_z"), F.col("back").alias("z_x"))
    return xy.join(xz, ["run_id", "x"]).filter(F.col("y") < F.col("z"))


def triangles(edges: DataFrame) -> DataFrame:
    """Directed triangles per run, each counted once.

    Every triple of agents is found at its end with fewest neighbours only, so a hub makes no wedges of its own.
    """
    pairs = oriented(edges)
    yz = pairs.select("run_id", F.col("lo").alias("y"), F.col("hi").alias("z"), F.col("forth").alias("y_z"), F.col("back").alias("z_y"))
    round_ = F.col("x_y") * F.col("y_z") * F.col("z_x") + F.col("x_z") * F.col("z_y") * F.col("y_x")
    found = wedges(pairs).join(yz, ["run_id", "y", "z"]).groupBy("run_id").agg(F.sum(round_).cast("double").alias("triangles"))
    return found.filter("triangles > 0")
