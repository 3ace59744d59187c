"""Filters, projections and slice flags over the trace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import MESSAGE_TYPES, TOPOLOGY_TYPES
from tracewright.functions.numbers import flag
from tracewright.functions.text import goal_domain, mask_agents, wait_target
from tracewright.plans.scan import chunk_of, percentiles, ranked, running
from tracewright.sources.runs import event_log
from tracewright.sources.traces import Traces


def assignments(tr: Traces) -> DataFrame:
    """Handoffs without refs: somebody was given a task."""
    return tr.messages.filter("is_assign")


def deliveries(tr: Traces) -> DataFrame:
    """Handoffs with refs: somebody delivered a result."""
    return tr.messages.filter("is_delivery")


def type_flags(tr: Traces) -> DataFrame:
    return tr.messages.select("run_id", "t", *[flag(F.col("type") == v).alias(f"type_{v}") for v in MESSAGE_TYPES])


def topology_flags(tr: Traces) -> DataFrame:
    return tr.topology.select("run_id", *[flag(F.col("topo_type") == v).alias(f"topo_{v}") for v in TOPOLOGY_TYPES])


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of a training schema in its order; absent ones become 0.0."""
    return df.select("run_id", *[(F.col(c) if c in df.columns else F.lit(0.0)).alias(c) for c in names])


def slice_flags(tr: Traces) -> DataFrame:
    """One row per run with the slices used in reports. Thresholds are exact percentiles (one row)."""
    team = tr.agents.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_agents"))
    intents = tr.plain_messages.groupBy("run_id").agg(F.max(F.when(F.col("intent") != "", 1).otherwise(0)).alias("i"))
    r = tr.runs.select("run_id", "n", "goal").join(team, "run_id").join(tr.topology, "run_id").join(intents, "run_id")
    lengths = percentiles(tr.runs, [], "n", {"p33": 0.33, "p50": 0.5, "p66r": 0.66, "p66": 2 / 3, "p80": 0.8})
    teams = percentiles(team, [], "n_agents", {"t80": 0.8})

    def q(df, c):
        return df.select(c).scalar()

    n = F.col("n")
    rare = F.col("topo_type").isin("mesh", "blackboard")
    return r.select(
        "run_id", ((n > q(lengths, "p50")) & rare).alias("robust"), (n > q(lengths, "p66")).alias("long"),
        (n >= q(lengths, "p80")).alias("longest_20"), (F.col("i") == 0).alias("no_intent"),
        (F.col("n_agents") >= q(teams, "t80")).alias("big_team"),
        (n <= q(lengths, "p33")).alias("len_short"),
        ((n > q(lengths, "p33")) & (n <= q(lengths, "p66r"))).alias("len_mid"),
        (n > q(lengths, "p66r")).alias("len_long"),
        (goal_domain(F.col("goal")) == "compliance_audit").alias("compliance"),
        *[(F.col("topo_type") == v).alias(f"topo_{v}") for v in TOPOLOGY_TYPES])


def slices(tr: Traces) -> DataFrame:
    return tr.once("slices", slice_flags)


def telemetry_flags(tr: Traces) -> DataFrame:
    m = tr.messages
    return m.groupBy("run_id").agg(
        F.min(F.col("intent") == "").alias("intents_empty"),
        F.avg(flag(F.size("refs") > 0)).alias("refs_share"),
        F.avg(flag(F.length("text").between(12, 30))).alias("short_text_share"))


def event_texts(tr: Traces) -> DataFrame:
    """One template line per event of the ordered log, agent ids masked, roles looked up."""
    role = tr.agents.select("run_id", "agent", "role")
    m = tr.plain_messages
    m = (m.join(role.select("run_id", F.col("agent").alias("sender"), F.col("role").alias("r1")),
                ["run_id", "sender"], "left")
         .join(role.select("run_id", F.col("agent").alias("receiver"), F.col("role").alias("r2")),
               ["run_id", "receiver"], "left"))
    none = lambda c: mask_agents(F.col(c))
    lines = [
        m.select("run_id", "t", F.lit("message").alias("kind"), F.concat(
            F.lit("event=message; type="), none("type"), F.lit("; sender role="),
            F.coalesce("r1", F.lit("[unknown]")), F.lit("; receiver role="), F.coalesce("r2", F.lit("[unknown]")),
            F.lit("; intent="), none("intent"), F.lit("; tool="), none("tool"), F.lit("; text="),
            mask_agents(F.col("text"), "[empty]")).alias("line")),
        tr.artifacts.join(role.withColumnRenamed("agent", "by"), ["run_id", "by"], "left").select(
            "run_id", "t", F.lit("artifact").alias("kind"), F.concat(
                F.lit("event=artifact; producer role="), F.coalesce("role", F.lit("[unknown]")),
                F.lit("; subtask="), none("subtask"), F.lit("; type="), none("type"), F.lit("; status="),
                none("status")).alias("line")),
        tr.state.join(role, ["run_id", "agent"], "left").select(
            "run_id", "t", F.lit("state").alias("kind"), F.concat(
                F.lit("event=state; writer role="), F.coalesce("role", F.lit("[unknown]")),
                F.lit("; key="), none("key"), F.lit("; op="), none("op"), F.lit("; value="),
                none("value")).alias("line")),
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def causal_metadata(tr: Traces) -> DataFrame:
    """Per event: position share, squashed time and log counts of artifacts and writes so far."""
    log = event_log(tr)
    one = lambda k: F.when(F.col("kind") == k, 1).otherwise(0)
    out = running(log, ["run_id"], ["seq"], {"arts": ("sum", one("artifact")), "writes": ("sum", one("state"))})
    i = F.col("seq") + 1
    t = F.col("t")
    return out.select("run_id", "seq", "kind", (i / (i + 1)).alias("place"), (t / (1 + F.abs(t))).alias("when_rel"),
                      F.log1p(F.col("arts")).alias("log_artifacts"), F.log1p(F.col("writes")).alias("log_writes"))


def first_seen_slots(tr: Traces) -> DataFrame:
    """1-based slot of every agent and task by first appearance in the run; blank values have slot 0."""
    m = tr.plain_messages
    seen = m.select("run_id", F.explode(F.array(
        F.struct(F.lit("agent").alias("kind"), F.col("sender").alias("name"), (F.col("t") * 2).alias("pos")),
        F.struct(F.lit("agent").alias("kind"), F.col("receiver").alias("name"), (F.col("t") * 2 + 1).alias("pos")),
        F.struct(F.lit("task").alias("kind"), F.col("intent").alias("name"), (F.col("t") * 2).alias("pos")),
    )).alias("x")).select("run_id", "x.*")
    first = seen.filter(F.col("name") != "").groupBy("run_id", "kind", "name").agg(F.min("pos").alias("pos"))
    out = ranked(first, ["run_id", "kind"], ["pos", "name"], "slot", chunk=chunk_of(first, "pos"))
    return out.select("run_id", "kind", "name", (F.col("slot") + 1).alias("slot"))


def slotted_messages(tr: Traces) -> DataFrame:
    slots = first_seen_slots(tr)
    agent = slots.filter("kind = 'agent'")
    task = slots.filter("kind = 'task'").select("run_id", F.col("name").alias("intent"), F.col("slot").alias("task_slot"))
    return (tr.plain_messages.select("run_id", "t", "sender", "receiver", "intent")
            .join(agent.select("run_id", F.col("name").alias("sender"), F.col("slot").alias("sender_slot")),
                  ["run_id", "sender"], "left")
            .join(agent.select("run_id", F.col("name").alias("receiver"), F.col("slot").alias("receiver_slot")),
                  ["run_id", "receiver"], "left")
            .join(task, ["run_id", "intent"], "left").na.fill(0, ["sender_slot", "receiver_slot", "task_slot"]))


def wait_events(tr: Traces) -> DataFrame:
    """Status messages that name the agent (and perhaps the task) they wait for."""
    m = tr.messages.withColumn("w", wait_target(F.col("type"), F.col("text"))).filter(F.col("w").isNotNull())
    return m.select("run_id", "t", "n", F.col("sender").alias("waiter"), "w.awaited", "w.task")
