"""Communication-graph block and strongly connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numbers import ratio
from tracewright.operators.matching import pair_edges, reciprocal_pairs, triangles
from tracewright.plans.gather import gather
from tracewright.session import shared
from tracewright.sources.traces import Traces

BITS = 60  # nodes that fit one bigint mask


def scc_members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, node, comp): comp is the smallest node of the node's component.

    Runs with at most 60 agents keep their adjacency as bit masks in one small
    row and are closed in place, without any join. Larger graphs go through
    distributed reachability colouring; there is no cap.
    """
    sizes = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("k"))
    few = sizes.filter(F.col("k") <= BITS).select("run_id")
    small = _small_components(edges.join(few, "run_id", "left_semi"), nodes.join(few, "run_id", "left_semi"))
    big_ids = sizes.filter(F.col("k") > BITS).select("run_id")
    if big_ids.isEmpty():
        return small
    big = _large_components(edges.join(big_ids, "run_id", "left_semi"), nodes.join(big_ids, "run_id", "left_semi"))
    return small.unionByName(big)


def _small_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Transitive closure on bit masks, for runs of at most 60 agents: arrays of 60 names and 3540 edges at most."""
    listed = nodes.groupBy("run_id").agg(F.sort_array(F.collect_set("node")).alias("names"))
    named = edges.filter(F.col("src") != F.col("dst")).select("run_id", "src", "dst").distinct().groupBy("run_id").agg(
        F.collect_list(F.struct("src", "dst")).alias("es"))
    g = listed.join(named, "run_id", "left")
    one = F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, (i - 1).cast("int"))
    adj = F.transform("names", lambda v: F.aggregate(
        F.filter(F.coalesce("es", F.array().cast("array<struct<src:string,dst:string>>")), lambda e: e["src"] == v),
        F.lit(0).cast("bigint"), lambda acc, e: acc.bitwiseOR(bit(F.array_position("names", e["dst"])))))
    g = g.select("run_id", "names", adj.alias("adj"))
    has = lambda mask, i: F.call_function("shiftright", mask, i.cast("int")).bitwiseAND(one) == 1
    closed = F.aggregate(
        F.sequence(F.lit(0), F.size("names") - 1), F.col("adj"),
        lambda acc, k: F.transform(acc, lambda row: F.when(has(row, k), row.bitwiseOR(F.get(acc, k))).otherwise(row)))
    g = g.select("run_id", "names", closed.alias("reach"))
    # i and j share a component when each reaches the other; the smallest such j names it
    comp = F.transform("reach", lambda row, i: F.element_at("names", (F.array_min(F.filter(
        F.sequence(F.lit(0), F.size("names") - 1),
        lambda j: (j == i) | (has(row, j) & has(F.get("reach", j), i)))) + 1).cast("int")))
    pairs = g.select("run_id", F.explode(F.arrays_zip(F.col("names").alias("node"), comp.alias("comp"))).alias("x"))
    return pairs.select("run_id", "x.node", "x.comp")


def _large_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Colouring: the largest node reaching v is v's colour; its backward reach inside the colour is one component.

    Every step joins labels to edges (never more than one row per edge) and the
    state is written between rounds, so lineage stays short.
    """
    edges = shared(edges.filter("src <> dst").select("run_id", "src", "dst").distinct(), "scc_edges")
    left = shared(nodes.select("run_id", "node").distinct(), "scc_nodes")
    done: list[DataFrame] = []
    while not left.isEmpty():
        live = edges.join(left.withColumnRenamed("node", "src"), ["run_id", "src"], "left_semi").join(
            left.withColumnRenamed("node", "dst"), ["run_id", "dst"], "left_semi")
        colour = left.withColumn("colour", F.col("node"))
        while True:
            pushed = live.join(colour.withColumnRenamed("node", "src"), ["run_id", "src"]).groupBy(
                "run_id", F.col("dst").alias("node")).agg(F.max("colour").alias("c2"))
            nxt = shared(colour.join(pushed, ["run_id", "node"], "left").select(
                "run_id", "node", F.greatest("colour", "c2").alias("colour"),
                (F.col("c2") > F.col("colour")).alias("moved")), "scc_colour")
            colour = nxt.drop("moved")
            if nxt.filter("moved").isEmpty():
                break
        found = colour.filter("node = colour")
        while True:
            back = live.join(found.select("run_id", F.col("node").alias("dst"), "colour"), ["run_id", "dst"]).select(
                "run_id", F.col("src").alias("node"), "colour").join(colour, ["run_id", "node", "colour"], "left_semi")
            fresh = shared(back.distinct().join(found, ["run_id", "node"], "left_anti"), "scc_back")
            if fresh.isEmpty():
                break
            found = shared(found.unionByName(fresh), "scc_found")
        names = found.groupBy("run_id", "colour").agg(F.min("node").alias("comp"))
        done.append(found.join(names, ["run_id", "colour"]).select("run_id", "node", "comp"))
        left = shared(left.join(found, ["run_id", "node"], "left_anti"), "scc_left")
    return reduce(DataFrame.unionByName, done)


def run_nodes(tr: Traces) -> DataFrame:
    return tr.plain_messages.select("run_id", F.explode(F.array("sender", "receiver")).alias("node")).filter(
        "node <> ''").distinct()


def largest_scc(tr: Traces) -> DataFrame:
    members = scc_members(pair_edges(tr.messages), run_nodes(tr))
    sizes = members.groupBy("run_id", "comp").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy("run_id").agg(F.max("k").alias("g_largest_scc"), F.sum("k").alias("k")).select(
        "run_id", "g_largest_scc", ratio("g_largest_scc", "k").alias("g_scc_share"))


def graph_block(tr: Traces) -> DataFrame:
    """Degree, density, reciprocity, ping-pong and component columns of the message graph."""
    e = pair_edges(tr.messages)
    own = F.col("src") == F.col("dst")
    per = e.groupBy("run_id").agg(
        F.sum(F.when(own, 0).otherwise(1)).alias("g_edges"), F.sum(F.when(own, F.col("cnt")).otherwise(0)).alias("g_self_loops"),
        F.count(F.lit(1)).alias("g_n_pairs"), F.max("cnt").alias("g_max_pair"), F.sum("cnt").alias("n"),
        F.max(F.when(own, F.col("cnt"))).alias("own_max"))
    out_deg = e.filter(~own).groupBy("run_id", "src").agg(F.count(F.lit(1)).alias("d")).groupBy("run_id").agg(
        F.max("d").alias("g_max_out_deg"))
    in_deg = e.filter(~own).groupBy("run_id", "dst").agg(F.count(F.lit(1)).alias("d")).groupBy("run_id").agg(
        F.max("d").alias("g_max_in_deg"))
    rec = reciprocal_pairs(e).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("g_two_cycles"), F.max(F.least("cnt_ab", "cnt_ba")).alias("pp"))
    nodes = run_nodes(tr).groupBy("run_id").agg(F.count(F.lit(1)).alias("g_nodes"))
    j = gather(per, out_deg, in_deg, rec, nodes, triangles(e), largest_scc(tr)).na.fill(0)
    gn, ge = F.col("g_nodes"), F.col("g_edges")
    pp = F.greatest(F.col("pp"), F.coalesce("own_max", F.lit(0)))
    return j.select(
        "run_id", "g_nodes", "g_edges", ratio(ge, gn * (gn - 1)).alias("g_density"), "g_self_loops",
        ratio(F.col("g_two_cycles") * 2, ge).alias("g_reciprocity"), "g_two_cycles",
        F.col("triangles").alias("g_triangles"), "g_max_out_deg", ratio(ge, gn).alias("g_mean_out_deg"), "g_max_in_deg",
        "g_largest_scc", "g_scc_share", "g_n_pairs", "g_max_pair", ratio("g_max_pair", "n").alias("g_top_pair_share"),
        pp.alias("g_pingpong"), ratio(pp * 2, F.col("n")).alias("g_pingpong_share"))
