"""Assignments matched with their deliveries, and everything known about each assignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.numbers import count_where, flag, ratio
from tracewright.operators.graph import run_nodes, scc_members
from tracewright.operators.matching import pair_edges, reciprocal_pairs
from tracewright.plans.gather import gather
from tracewright.plans.scan import bracket_levels, chain_lengths, chunk_of, lookup, percentiles, running
from tracewright.session import chunk_turns, shared
from tracewright.sources.traces import Traces

LC = ["run_id", "t", "n", "sender", "receiver", "intent"]


def _one() -> Column:
    return F.count(F.lit(1))


# ---- matching ---------------------------------------------------------------
def handoff_events(tr: Traces) -> DataFrame:
    # from the plain messages: words and goals of the full ones are not needed for a matching
    m = tr.plain_messages.filter("type = 'handoff' and size(refs) >= 0").join(tr.runs.select("run_id", "n"), "run_id")
    return m.select(*LC, F.when(F.size("refs") == 0, 1).otherwise(-1).alias("delta")).hint("merge")


def _paired(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events with ``level`` and, on an open event, the close event that pops it."""
    lv = bracket_levels(events, keys, "delta")
    nxt = ("last", F.when(F.col("delta") < 0, F.struct(F.col("t").alias("t"), F.col("sender").alias("sender"))), False)
    hit = running(lv.filter("level is not null"), [*keys, "level"], ["t"], {"close": nxt}, reverse=True)
    return hit.unionByName(lv.filter("level is null"), allowMissingColumns=True)


def match_newest(tr: Traces) -> DataFrame:
    """Keyed matching: a delivery closes the newest open assignment of its (run, intent)."""
    p = _paired(handoff_events(tr).filter("intent <> ''"), ["run_id", "intent"])
    return p.filter("delta > 0").select(*LC, F.col("close.t").alias("deliver_t"))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by agent, chunk and turn: inside a chunk a pop takes its agent's newest item that is still open.

    Items that ended before a pop are of no use to later ones either, so each event is handled once. Pops that find nothing
    stay pops, for the chunks before. Only the open items of one agent in one chunk are held from batch to batch.
    """
    group, stack, schema = None, [], None
    for batch in batches:
        schema, out = batch.schema, []
        for run, agent, c, kind, t, until, _ in zip(*[col.to_pylist() for col in batch.columns]):
            if (run, agent, c) != group:
                out += [(*group, "item", *item, None) for item in stack]
                group, stack = (run, agent, c), []
            if kind == "item":
                stack.append((t, until))
                continue
            while stack and stack[-1][1] is not None and stack[-1][1] < t:
                out.append((*group, "ended", *stack.pop(), None))
            out.append((*group, "taken", *stack.pop(), t) if stack else (*group, "pop", t, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
    if stack:
        out = [(*group, "item", *item, None) for item in stack]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)


def _taken(items: DataFrame, pops: DataFrame) -> DataFrame:
    """Items ``(run_id, agent, t, until)`` taken by pops ``(run_id, agent, t)``: ``(run_id, t, pop_t)``.

    In turn order a pop takes its agent's newest item that no pop took before and whose ``until`` has not passed. Every chunk
    of turns first settles what it can by itself: its own items are newer than all before, so this depends on nothing
    else. What is left of it are open items and pops that look further back. These go in rounds to the nearest chunk before
    with open items of the agent; a pop waits while an earlier one is still looking at a later chunk, so each chunk meets
    its pops in turn order. A task holds the open items of one agent in one chunk at a time.
    """
    ks = ["run_id", "agent"]
    c = chunk_of(items, "t")
    none = F.lit(None).cast("long")
    both = items.select(*ks, c.alias("c"), F.lit("item").alias("kind"), "t", "until", none.alias("pop_t")).unionByName(
        pops.select(*ks, c.alias("c"), F.lit("pop").alias("kind"), "t", none.alias("until"), none.alias("pop_t")))
    # the rows are few bytes and much work: a stated number of parts is not merged into few tasks
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replayed = lambda df: df.repartition(parts, *ks, "c").sortWithinPartitions(*ks, "c", "t", "kind").mapInArrow(_replayed, df.schema)
    first = shared(replayed(both), "replayed")
    taken = [first.filter("kind = 'taken'")]
    open_, wait = first.filter("kind = 'item'"), first.filter("kind = 'pop'")
    while True:
        places = open_.groupBy(*ks, "c").agg(_one().alias("k")).select(*ks, F.col("c").alias("t"), F.col("c").alias("at"), "k")
        ask = wait.select(*ks, F.col("c").alias("t"), F.col("t").alias("pop"))
        found = lookup(ask, places, ks, {"to": ("last", F.struct("at", "k"))}, direction="prev").filter("to is not null")
        found = found.select(*ks, F.col("pop").alias("t"), F.col("to.at").alias("c"), F.col("to.k").alias("k"))
        later = running(found, ks, ["t"], {"later": ("max", "c")}, pos="t")
        go = running(later.filter("c >= later"), [*ks, "c"], ["t"], {"nth": ("sum", F.lit(1).cast("long"))}, pos="t")
        found = shared(later.join(go.select(*ks, "t", "nth"), [*ks, "t"], "left"), "pops")
        if found.isEmpty():
            break
        served = found.filter("nth <= k")
        here = served.select(*ks, "c").distinct()
        met = open_.join(here, [*ks, "c"], "left_semi").unionByName(
            served.select(*ks, "c", F.lit("pop").alias("kind"), "t", none.alias("until"), none.alias("pop_t")))
        met = shared(replayed(met), "met")
        taken.append(met.filter("kind = 'taken'"))
        as_pop = lambda df, place: df.select(*ks, place.alias("c"), F.lit("pop").alias("kind"), "t", none.alias("until"), none.alias("pop_t"))
        # those that waited look from behind the place they had found, the others from that place on
        wait = as_pop(found.filter("nth is null"), F.col("c") + 1).unionByName(as_pop(found.filter("nth > k"), F.col("c"))).unionByName(met.filter("kind = 'pop'"))
        open_ = shared(open_.join(here, [*ks, "c"], "left_anti").unionByName(met.filter("kind = 'item'")), "open")
    return reduce(DataFrame.unionByName, taken).select("run_id", "t", "pop_t")


def _matched(tr: Traces) -> DataFrame:
    """One row per assignment: ``refs_t`` and ``refs_sender`` of the delivery that closed it last, ``stop_t`` of the first one.

    A delivery with a task closes the newest assignment of the task that no delivery of that task closed before, whatever
    its agent did meanwhile; without such an assignment, or without a task, it closes its agent's newest assignment that is
    open at that turn. So an assignment may be closed by its agent first and by its task later.
    """
    ev = handoff_events(tr)
    keyed = _paired(ev.filter("intent <> ''"), ["run_id", "intent"])
    ends = keyed.filter("delta > 0").select(*LC, F.col("close.t").alias("until"), F.col("close.sender").alias("until_sender"))
    ends = shared(ends.unionByName(ev.filter("delta > 0 and intent = ''").select(*LC), allowMissingColumns=True), "assigned")
    pops = keyed.filter("delta < 0 and level is null").select("run_id", F.col("sender").alias("agent"), "t").unionByName(
        ev.filter("delta < 0 and intent = ''").select("run_id", F.col("sender").alias("agent"), "t"))
    taken = _taken(ends.select("run_id", F.col("receiver").alias("agent"), "t", "until"), shared(pops, "agent_pops"))
    j = ends.join(taken, ["run_id", "t"], "left")
    return j.select(*LC, F.coalesce("until", "pop_t").alias("refs_t"), F.when(F.col("until").isNotNull(), F.col("until_sender")).when(
        F.col("pop_t").isNotNull(), F.col("receiver")).alias("refs_sender"), F.least("until", "pop_t").alias("stop_t"))


def matched(tr: Traces) -> DataFrame:
    return tr.once("matched", _matched)


# ---- what follows an assignment ---------------------------------------------
def _keys(*pairs) -> Column:
    return F.filter(F.array(*pairs), lambda x: x.isNotNull())


def _key(kind: str, *parts) -> Column:
    return F.concat_ws("|", F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts])


def acknowledgements(tr: Traces) -> DataFrame:
    """First non-handoff message of the receiver on the task (or without a task) before the delivery."""
    talk = tr.plain_messages.filter("type <> 'handoff'").select("run_id", "t", "sender", "intent")
    ev = talk.select("run_id", "t", F.explode(_keys(_key("p", "sender", "intent"), _key("s", "sender"))).alias("k"))
    keyed = F.col("intent") != ""
    pts = matched(tr).select("run_id", "t", F.explode(_keys(
        F.when(keyed, _key("p", "receiver", "intent")), F.when(keyed, _key("p", "receiver", F.lit(""))),
        F.when(~keyed, _key("s", "receiver")))).alias("k"))
    nxt = lookup(pts, ev, ["run_id", "k"], {"ack_t": ("min", "t")}, direction="next")
    per = nxt.groupBy("run_id", "t").agg(F.min("ack_t").alias("ack_t"))
    j = matched(tr).join(per, ["run_id", "t"], "left")
    ok = F.col("ack_t") < F.coalesce("stop_t", "n")
    return j.select(*LC, "refs_t", F.when(ok, F.col("ack_t")).alias("ack_t"))


def activity_counts(tr: Traces) -> DataFrame:
    """Non-handoff messages between an assignment and its delivery: by the owner, and by others on other tasks.

    Messages and the ends of assignments are dealt once by (run, chunk of turns) and counted by windows inside that chunk. What
    the other chunks of a long run hold comes as rows before the chunk's first turn and behind its last one. An open assignment
    ends with its run: it counts what follows it, so that no position gathers the open ones.
    """
    size = chunk_turns(tr.spark)
    one = F.lit(1).cast("long")
    talk = tr.plain_messages.filter("type <> 'handoff' and t is not null").select(
        "run_id", "t", F.col("sender").alias("agent"), "intent", one.alias("said"), F.when(F.col("intent") != "", one).alias("keyed"))
    end = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).alias("sign"))
    ends = F.when(F.col("stop_t").isNull(), F.array(end("t", 0))).otherwise(F.array(end("t", -1), end("stop_t", 1)))
    ends = matched(tr).filter("t is not null").select("run_id", F.col("t").alias("t0"), F.col("receiver").alias("agent"), "intent", F.explode(ends).alias("e"))
    line = talk.unionByName(ends.select("run_id", "t0", "agent", "intent", "e.t", "e.sign"), allowMissingColumns=True)
    line = line.withColumn("c", chunk_of(line, "t"))
    # only runs of several chunks need rows from other chunks: ids of long runs, few where turns are dense
    long = line.groupBy("run_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("run_id")
    parts = line.join(F.broadcast(long), "run_id", "left_semi")
    keys = {"all": [], "agent": ["agent"], "intent": ["intent"], "both": ["agent", "intent"]}
    for name, by in keys.items():
        w = Window.partitionBy("run_id", *by).orderBy("c")
        sums = parts.groupBy("run_id", *by, "c").agg(F.sum("said").alias("said"), F.sum("keyed").alias("keyed"))
        for frame, t in ((w.rowsBetween(Window.unboundedPreceding, -1), F.col("c") * size - 1), (w.rowsBetween(1, Window.unboundedFollowing), (F.col("c") + 1) * size)):
            line = line.unionByName(sums.select("run_id", *by, "c", t.alias("t"), F.sum("said").over(frame).alias(f"said_{name}"),
                                                F.sum("keyed").over(frame).alias(f"keyed_{name}")), allowMissingColumns=True)

    def counted(what: str, name: str) -> Column:
        w = Window.partitionBy("run_id", "c", *keys[name]).orderBy("t")
        x = F.coalesce(F.col(what), F.col(f"{what}_{name}"))
        upto, after = F.sum(x).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.sum(x).over(w.rangeBetween(0, Window.unboundedFollowing))
        return F.coalesce(F.when(F.col("sign") == 0, after).otherwise(F.col("sign") * upto), F.lit(0))

    others = counted("keyed", "all") - counted("keyed", "intent") - counted("keyed", "agent") + counted("keyed", "both")
    c = line.repartition("run_id", "c").select("run_id", "t0", "intent", "sign", counted("said", "agent").alias("own"), others.alias("other"))
    return c.filter("sign is not null").groupBy("run_id", F.col("t0").alias("t")).agg(
        F.sum("own").alias("n_owner_msgs"), F.sum(F.when(F.col("intent") != "", F.col("other")).otherwise(0)).alias("n_other_msgs"))


def next_artifacts(tr: Traces) -> DataFrame:
    """Earliest later artifact on the task by the receiver and by the sender of each keyed assignment."""
    a = tr.artifacts.filter("subtask <> ''").select("run_id", F.col("by").alias("agent"), F.col("subtask").alias("intent"), "t")
    pts = matched(tr).filter("intent <> ''").select("run_id", "intent", "t", F.explode(F.array(
        F.struct(F.col("receiver").alias("agent"), F.lit("to").alias("side")),
        F.struct(F.col("sender").alias("agent"), F.lit("from").alias("side")))).alias("x")).select(
            "run_id", "intent", "t", "x.*")
    nxt = lookup(pts, a, ["run_id", "agent", "intent"], {"a_t": ("min", "t")}, direction="next")
    return nxt.groupBy("run_id", "t").agg(
        F.min(F.when(F.col("side") == "to", F.col("a_t"))).alias("art_to_t"),
        F.min(F.when(F.col("side") == "from", F.col("a_t"))).alias("art_from_t"))


def _lifecycles(tr: Traces) -> DataFrame:
    ack = acknowledgements(tr).select("run_id", "t", "ack_t")
    j = (matched(tr).join(ack, ["run_id", "t"], "left").join(activity_counts(tr), ["run_id", "t"], "left")
         .join(next_artifacts(tr), ["run_id", "t"], "left"))
    refs = F.col("refs_t").isNotNull()
    art_close = F.coalesce("art_to_t", "art_from_t")
    j = j.select(
        *LC, F.col("ack_t").isNotNull().alias("acked"), "ack_t", (refs | art_close.isNotNull()).alias("delivered"),
        F.coalesce("refs_t", art_close).alias("deliver_t"),
        F.when(refs, "refs").when(art_close.isNotNull(), "artifact").alias("deliver_kind"),
        F.when(refs, F.col("refs_sender")).when(F.col("art_to_t").isNotNull(), F.col("receiver")).when(
            art_close.isNotNull(), F.col("sender")).alias("deliver_sender"),
        F.coalesce("n_owner_msgs", F.lit(0)).alias("n_owner_msgs"), F.coalesce("n_other_msgs", F.lit(0)).alias("n_other_msgs"),
        art_close.isNotNull().alias("has_artifact"), F.least("art_to_t", "art_from_t").alias("art_t"))
    j = j.withColumn("owner_delivered", F.col("delivered") & ((F.col("intent") != "") | (
        F.col("deliver_sender") == F.col("receiver"))))
    keyed = j.filter("intent <> ''")
    per = keyed.groupBy("run_id", "intent").agg(
        F.min("receiver").alias("r1"), F.max("receiver").alias("r2"), F.min("t").alias("first_t"),
        count_where(F.col("delivered")).alias("nd"),
        F.min(F.when(F.col("delivered"), F.col("deliver_sender"))).alias("d1"),
        F.max(F.when(F.col("delivered"), F.col("deliver_sender"))).alias("d2"))
    chain = running(keyed, ["run_id", "intent"], ["t"], {
        "prev": ("last", F.struct("receiver", "t", "delivered"), False)}).select("run_id", "t", "prev")
    j = j.join(per, ["run_id", "intent"], "left").join(chain, ["run_id", "t"], "left")
    moved = F.coalesce(F.col("r1") != F.col("r2"), F.lit(False))
    return j.select(
        *[c for c in keyed.columns], moved.alias("reassigned"), (moved & F.col("delivered")).alias("recovered"),
        (moved & (F.col("t") == F.col("first_t")) & F.col("owner_delivered")).alias("result_after_reassign"),
        F.coalesce(F.col("delivered") & (F.col("nd") > 1) & (F.col("d1") != F.col("d2")), F.lit(False)).alias("dup_delivery"),
        F.col("prev.receiver").alias("prev_owner"), F.col("prev.t").alias("prev_t"),
        F.col("prev.delivered").alias("prev_delivered"))


def lifecycles(tr: Traces) -> DataFrame:
    """One row per assignment with matching, acknowledgement, artifacts and reassignment."""
    return tr.once("lifecycles", _lifecycles)


# ---- run blocks ---------------------------------------------------------------
# Names of output columns.
LIFECYCLE_COLS = [
    "lc_n_lifecycles", "lc_n_delivered", "lc_n_unresolved", "lc_n_unacked", "lc_n_acked_nodeliver", "lc_unresolved_ratio",
    "lc_unresolved_per_msg", "lc_unresolved_per_agent", "lc_unresolved_per_intent", "lc_unresolved_last20pct",
    "lc_unresolved_last20pct_ratio", "lc_unresolved_firsthalf", "lc_first_unresolved_pos", "lc_mean_unresolved_pos",
    "lc_acked_ratio", "lc_ack_lat_mean", "lc_ack_lat_max", "lc_ack_lat_per_msg", "lc_del_lat_mean", "lc_del_lat_max",
    "lc_del_lat_p90", "lc_del_lat_per_msg", "lc_late_deliveries", "lc_late_per_assign", "lc_n_reassign",
    "lc_reassign_ratio", "lc_multi_owner_intents", "lc_multi_owner_ratio", "lc_result_after_reassign", "lc_recovered",
    "lc_recovered_ratio", "lc_dup_delivery_intents", "lc_dup_delivery_ratio", "lc_silent_after_assign",
    "lc_silent_after_assign_ratio", "lc_silent_other_intent", "lc_longest_unresolved_chain", "lc_no_progress_tail",
    "lc_delivered_ratio", "lc_orphan_assign_ratio"]


def last_turn() -> Column:
    return F.greatest(F.col("n") - 1, F.lit(1)).cast("double")


def lifecycle_block(tr: Traces) -> DataFrame:
    lc = lifecycles(tr)
    t, open_ = F.col("t"), ~F.col("delivered")
    end = last_turn()
    lat = F.when(F.col("delivered"), F.col("deliver_t") - t)
    per = lc.groupBy("run_id").agg(
        F.max("n").alias("n"), _one().alias("k"), count_where(F.col("delivered")).alias("d"), count_where(open_).alias("u"),
        count_where(~F.col("acked")).alias("ua"), count_where(F.col("acked") & open_).alias("an"),
        count_where(open_ & (t >= 0.8 * end)).alias("u20"), count_where(open_ & (t < 0.5 * end)).alias("uh"),
        F.min(F.when(open_, t)).alias("u_first"), F.avg(F.when(open_, t)).alias("u_mean"),
        F.avg(F.col("ack_t") - t).alias("am"), F.max(F.col("ack_t") - t).alias("ax"), F.avg(lat).alias("dm"),
        F.max(lat).alias("dx"), count_where(F.col("delivered") & (lat > 0.25 * end)).alias("late"),
        count_where(F.col("reassigned")).alias("re"), count_where(F.col("result_after_reassign")).alias("rar"),
        count_where(F.col("recovered")).alias("rec"), count_where(F.col("dup_delivery")).alias("dup"),
        count_where(open_ & (F.col("n_owner_msgs") > 0)).alias("sil"), count_where(open_ & (F.col("n_other_msgs") > 0)).alias("silo"),
        F.max("deliver_t").alias("last_d"), count_where(F.col("intent") == "").alias("orphan"))
    by_intent = lc.filter("intent <> ''").groupBy("run_id", "intent").agg(
        F.max(F.col("reassigned").cast("int")).alias("m"), F.max(F.col("dup_delivery").cast("int")).alias("dd")).groupBy(
            "run_id").agg(_one().alias("ni"), F.sum("m").alias("mi"), F.sum("dd").alias("di"))
    p90 = percentiles(lc.withColumn("lat", lat), ["run_id"], "lat", {"p90": 0.9})
    chain = chain_lengths(lc.select("run_id", "t", "delivered"), ["run_id"], ~F.col("delivered"), "c").groupBy(
        "run_id").agg(F.max("c").alias("chain"))
    team = tr.agents.groupBy("run_id").agg(_one().alias("ag"))
    j = gather(tr.runs.select("run_id"), per, by_intent, p90, chain, team)
    n, k, u = F.col("n"), F.col("k"), F.col("u")
    z = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double")
    vals = [k, F.col("d"), u, F.col("ua"), F.col("an"), ratio(u, k), ratio(u, n), ratio(u, "ag"), ratio(u, "ni"), F.col("u20"),
            ratio("u20", k), F.col("uh"), ratio("u_first", end), ratio("u_mean", end), ratio(k - F.col("ua"), k), F.col("am"),
            F.col("ax"), ratio("am", n), F.col("dm"), F.col("dx"), F.col("p90"), ratio("dm", n), F.col("late"), ratio("late", k),
            F.col("re"), ratio("re", k), F.col("mi"), ratio("re", k), F.col("rar"), F.col("rec"), ratio("rec", "re"), F.col("di"),
            ratio("dup", k), F.col("sil"), ratio("sil", k), F.col("silo"), F.col("chain"),
            ratio(F.greatest(n - 1 - F.col("last_d"), F.lit(0)), end), ratio("d", k), ratio("orphan", k)]
    no_progress = LIFECYCLE_COLS.index("lc_no_progress_tail")
    vals[no_progress] = F.when(F.col("last_d").isNotNull(), vals[no_progress])
    return j.select("run_id", *[z(v).alias(c) for c, v in zip(LIFECYCLE_COLS, vals)])


# Names of output columns.
DEADLOCK_COLS = [
    "dl_mutual_pairs", "dl_mutual_pairs_per_agent", "dl_mutual_unresolved_pairs", "dl_mutual_first_pos", "dl_tail_after_mutual",
    "dl_status_no_result", "dl_status_no_result_ratio", "dl_status_no_result_per_msg", "dl_unresolved_in_scc",
    "dl_unresolved_in_scc_ratio", "dl_status_chain_max", "dl_wait_in_no_intent"]


def status_without_result(tr: Traces) -> DataFrame:
    """Status turns with no delivery before the next status, and the chain they form."""
    m = tr.messages.filter("type = 'status' or is_delivery").select("run_id", "t", "n", "type")
    t, st = F.col("t"), F.col("type") == "status"
    m = running(m, ["run_id"], ["t"], {"next_d": ("min", F.when(~st, t), False), "next_s": ("min", F.when(st, t), False)},
                reverse=True)
    got = F.coalesce(F.col("next_d") < F.coalesce("next_s", "n"), F.lit(False))
    s = m.filter(st).select("run_id", "t", "n", (~got).alias("no_result"))
    return chain_lengths(s, ["run_id"], F.col("no_result"), "chain")


def deadlock_block(tr: Traces) -> DataFrame:
    lc = lifecycles(tr)
    open_ = lc.filter("not delivered")
    mutual = reciprocal_pairs(pair_edges(lc)).groupBy("run_id").agg(_one().alias("mp"), F.min("last_t").alias("first_mutual"))
    open_pairs = reciprocal_pairs(pair_edges(open_))
    mu = open_pairs.groupBy("run_id").agg(_one().alias("mu"))
    nodes = run_nodes(tr)
    comp = scc_members(pair_edges(lc), nodes)
    size = comp.groupBy("run_id", "comp").agg(_one().alias("k"))
    comp = comp.join(size.filter("k > 1"), ["run_id", "comp"], "left_semi")
    inside = (open_.join(comp.select("run_id", F.col("node").alias("sender"), F.col("comp").alias("c1")), ["run_id", "sender"])
              .join(comp.select("run_id", F.col("node").alias("receiver"), F.col("comp").alias("c2")), ["run_id", "receiver"])
              .filter("c1 = c2").groupBy("run_id").agg(_one().alias("in_scc")))
    blind = open_.filter("intent = '' and sender <> receiver").select(
        "run_id", F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).join(
            open_pairs.select("run_id", "a", "b"), ["run_id", "a", "b"], "left_semi").groupBy("run_id").agg(_one().alias("blind"))
    st = status_without_result(tr).groupBy("run_id").agg(
        count_where(F.col("no_result")).alias("snr"), _one().alias("s"), F.max("chain").alias("chain"))
    tot = lc.groupBy("run_id").agg(count_where(~F.col("delivered")).alias("u"))
    ag = nodes.groupBy("run_id").agg(_one().alias("ag"))
    j = gather(tr.runs.select("run_id", "n"), mutual, mu, inside, blind, st, tot, ag)
    end = last_turn()
    fm = F.col("first_mutual")
    vals = [F.col("mp"), ratio("mp", F.greatest(F.col("ag"), F.lit(1))), F.col("mu"), ratio(fm, end),
            F.greatest(F.lit(0.0), (F.col("n") - 1 - fm) / end), F.col("snr"), ratio("snr", "s"), ratio("snr", "n"), F.col("in_scc"),
            ratio("in_scc", "u"), F.col("chain"), F.col("blind")]
    vals[4] = F.when(fm.isNotNull(), vals[4])
    return j.select("run_id", *[F.coalesce(v, F.lit(0)).cast("double").alias(c) for c, v in zip(DEADLOCK_COLS, vals)])


# Names of output columns.
TEMPORAL_COLS = [
    "ua_age_max_rel", "ua_age_mean_rel", "ua_age_p90_rel", "ua_oldest_share_gt10", "ua_oldest_share_gt25",
    "ua_oldest_share_gt50", "bd_max_rel", "bd_at25", "bd_at50", "bd_at75", "bd_at100", "bd_slope", "bd_grows_late",
    "bd_tail_growth", "bd_recovery_events_rel", "ra_own_msgs_after_mean_rel", "ra_own_msgs_after_max_rel",
    "ra_active_to_end_frac", "ra_own_msgs_per_turn", "ra_other_arts_after_max_rel", "ra_other_arts_exists",
    "ra_frac_lost_while_active", "ra_silence_oldest", "rt_reassign_lat_mean_rel", "rt_reassign_after_50",
    "rt_late_reassign_noresult", "rt_old_owner_result_after", "ld_unresolved_after_last_art", "ld_silence_span_rel"]


def open_counter(opens: DataFrame, closes: DataFrame) -> DataFrame:
    """Open items after every event; a close comes before an open at the same turn. Inputs: (run_id, t)."""
    ev = opens.select("run_id", "t", F.lit(1).alias("delta")).unionByName(closes.select("run_id", "t", F.lit(-1).alias("delta")))
    # several closes can share a turn: sum them first so that (t, delta) is a unique order
    ev = ev.groupBy("run_id", "t", "delta").agg(F.sum("delta").alias("step"))
    return running(ev, ["run_id"], ["t", "delta"], {"open": ("sum", "step")}, pos="t")


def backlog(tr: Traces) -> DataFrame:
    lc = lifecycles(tr)
    return open_counter(lc, lc.filter("delivered").select("run_id", F.col("deliver_t").alias("t")))


def other_artifacts_after(tr: Traces) -> DataFrame:
    """Artifacts on other tasks by the receiver after each unresolved assignment."""
    a = tr.artifacts.filter("`by` <> ''")
    ev = a.select("run_id", "t", F.explode(F.array(_key("b", "by"), _key("s", "by", "subtask"))).alias("k"))
    pts = lifecycles(tr).filter("not delivered").select("run_id", "t", F.explode(F.array(
        F.struct(_key("b", "receiver").alias("k"), F.lit(1).alias("w")),
        F.struct(_key("s", "receiver", "intent").alias("k"), F.lit(-1).alias("w")))).alias("x")).select("run_id", "t", "x.*")
    c = lookup(pts, ev, ["run_id", "k"], {"c": ("sum", F.lit(1))}, direction="next")
    return c.groupBy("run_id", "t").agg(F.sum(F.col("w") * F.col("c")).alias("other_arts"))


def late_results(tr: Traces) -> DataFrame:
    """Tasks given out again whose original owner still delivered after the second assignment."""
    m = tr.messages
    res = m.filter("is_delivery and intent <> ''").select("run_id", F.col("sender").alias("owner"), "intent", "t").unionByName(
        tr.artifacts.filter("`by` <> '' and subtask <> ''").select(
            "run_id", F.col("by").alias("owner"), F.col("subtask").alias("intent"), "t"))
    res = res.groupBy("run_id", "owner", "intent").agg(F.max("t").alias("last_result_t"))
    lc = lifecycles(tr).filter("intent <> ''")
    first = lc.groupBy("run_id", "intent").agg(F.min_by("receiver", "t").alias("owner"), F.min("t").alias("first_t"),
                                               F.min(F.when(F.col("prev_t").isNotNull(), F.col("t"))).alias("second_t"))
    return first.filter("second_t is not null").join(res, ["run_id", "owner", "intent"]).filter("last_result_t > second_t")


def temporal_block(tr: Traces) -> DataFrame:
    lc = lifecycles(tr)
    last = tr.messages.filter("sender <> ''").groupBy("run_id", "sender").agg(F.max("t").alias("last_said"))
    arts = tr.artifacts.filter("`by` <> ''").groupBy("run_id").agg(F.max("t").alias("last_art"))
    x = (lc.join(last.withColumnRenamed("sender", "receiver"), ["run_id", "receiver"], "left").join(arts, "run_id", "left")
         .join(other_artifacts_after(tr), ["run_id", "t"], "left").withColumn("last_said", F.coalesce("last_said", F.lit(-1))))
    t, d, open_, end = F.col("t"), F.col("delivered"), ~F.col("delivered"), last_turn()
    age = F.when(open_, end - t)
    at = lambda q: count_where((t <= q * end) & (open_ | (F.col("deliver_t") > q * end)))
    early = open_ & (t <= 0.8 * end)
    again = F.col("prev_t").isNotNull()
    lat = F.when(again, t - F.col("prev_t"))
    per = x.groupBy("run_id").agg(
        F.max("n").alias("n"), _one().alias("k"), count_where(open_).alias("u"), count_where(d).alias("d"),
        F.max(age).alias("age_max"), F.avg(age).alias("age_mean"),
        *[count_where(age > q * end).alias(f"age{int(q * 100)}") for q in (0.1, 0.25, 0.5)],
        *[at(q).alias(f"b{int(q * 100)}") for q in (0.25, 0.5, 0.75, 1.0)],
        F.avg(F.when(open_, F.col("n_owner_msgs"))).alias("own_mean"), F.max(F.when(open_, F.col("n_owner_msgs"))).alias("own_max"),
        count_where(early).alias("early"), count_where(early & (F.col("last_said") > 0.8 * end)).alias("early_active"),
        F.avg(F.when(open_ & (end - t >= 1), F.col("n_owner_msgs") / (end - t))).alias("per_turn"),
        F.max(F.when(open_, F.col("other_arts"))).alias("oth"), count_where(open_ & (F.col("n_owner_msgs") > 0)).alias("act"),
        F.min_by(F.when(open_, F.col("last_said")), F.when(open_, t)).alias("oldest_said"),
        F.avg(lat).alias("re_lat"), count_where(again).alias("nre"), F.max(flag(again & (t > 0.5 * end))).alias("re50"),
        count_where(again & (lat > 0.25 * end) & ~F.col("prev_delivered")).alias("late_re"),
        F.max("last_art").alias("last_art"), count_where(open_ & (t > F.col("last_art"))).alias("after_art"))
    p90 = percentiles(lc.withColumn("age", age), ["run_id"], "age", {"age_p90": 0.9})
    peak = backlog(tr).filter("delta > 0").groupBy("run_id").agg(F.max("open").alias("peak"))
    late = late_results(tr).groupBy("run_id").agg(F.lit(1.0).alias("old_owner"))
    j = gather(tr.runs.select("run_id"), per, p90, peak, late)
    k, u = F.col("k"), F.col("u")
    b75, b100 = F.col("b75"), F.col("b100")
    said = F.col("oldest_said")
    vals = [ratio("age_max", end), ratio("age_mean", end), ratio("age_p90", end), ratio("age10", u), ratio("age25", u),
            ratio("age50", u), ratio("peak", k), ratio("b25", k), ratio("b50", k), ratio(b75, k), ratio(b100, k),
            (ratio(b100, k) - ratio("b25", k)) / 0.75, flag((b75 > 0) & (b100 >= b75)), ratio(b100 - b75, b75), ratio("d", k),
            ratio("own_mean", "n"), ratio("own_max", "n"), ratio("early_active", "early"), F.col("per_turn"), ratio("oth", "n"),
            flag(F.col("oth") > 0), ratio("act", u), flag((u > 0) & (said <= 0.5 * end)), ratio("re_lat", end), F.col("re50"),
            ratio("late_re", "nre"), F.col("old_owner"), F.when(F.col("last_art").isNotNull(), ratio("after_art", u)),
            F.when(said >= 0, ratio(F.greatest(F.lit(0.0), end - said), end))]
    return j.select("run_id", *[F.coalesce(v, F.lit(0)).cast("double").alias(c) for c, v in zip(TEMPORAL_COLS, vals)])


# ---- audit records --------------------------------------------------------------
def assignment_records(tr: Traces) -> DataFrame:
    return tr.once("assignment_records", _assignment_records)


def _assignment_records(tr: Traces) -> DataFrame:
    """One audit row per assignment: acknowledgement, delivery, artifact identity, activity, lifetime."""
    lc = lifecycles(tr)
    keyed = tr.artifacts.filter("subtask <> ''").select("run_id", F.col("subtask").alias("intent"), "t", "by")
    nxt = lookup(lc.filter("intent <> ''").select("run_id", "intent", "t"), keyed, ["run_id", "intent"],
                 {"a": ("last", F.struct(F.col("t").alias("t"), F.col("by").alias("who")))}, direction="next").select(
                     "run_id", "t", F.col("a.t").alias("any_t"), F.col("a.who").alias("artifact_by"))
    ever = keyed.select("run_id", "intent").distinct().withColumn("ever", F.lit(True))
    said = tr.plain_messages.select("run_id", F.col("sender").alias("receiver"), "t")
    wrote = tr.state.select("run_id", F.col("agent").alias("receiver"), "t")
    pts = lc.select("run_id", "receiver", "t")
    c1 = lookup(pts, said, ["run_id", "receiver"], {"c1": ("sum", F.lit(1)), "l1": ("max", "t")}, direction="next").drop("receiver")
    c2 = lookup(pts, wrote, ["run_id", "receiver"], {"c2": ("sum", F.lit(1))}, direction="next").drop("receiver")
    j = lc
    for b in (nxt, c1, c2):
        j = j.join(b, ["run_id", "t"], "left")
    j = j.join(ever, ["run_id", "intent"], "left")
    present = F.coalesce(F.col("ever"), F.lit(False)) | F.col("has_artifact")
    art_t = F.coalesce("art_t", "any_t")
    last = F.greatest("t", "ack_t", "deliver_t", art_t, "l1")
    open_end = ~F.col("delivered") & ~present & (last <= F.col("n") - 1)
    return j.select(
        "run_id", F.col("t").alias("handoff_turn"), "n", "sender", "receiver", "intent", "acked",
        F.col("ack_t").alias("ack_turn"), (F.col("ack_t") - F.col("t")).alias("ack_delay"), "delivered",
        F.col("deliver_t").alias("deliver_turn"), (F.col("deliver_t") - F.col("t")).alias("deliver_delay"), "deliver_sender",
        "deliver_kind", "prev_owner", present.alias("artifact_present"), "artifact_by", art_t.alias("artifact_turn"),
        F.coalesce((F.col("artifact_by") == F.col("receiver")) & (F.col("receiver") != ""), F.lit(False)).alias("artifact_is_receiver"),
        "reassigned", (F.col("delivered") & F.col("reassigned") & F.col("result_after_reassign")).alias("delivery_after_reassign"),
        "recovered", (F.col("owner_delivered") | F.coalesce(F.col("delivered") & (F.col("deliver_sender") == F.col("receiver")),
                                                           F.lit(False))).alias("owner_delivered"),
        (F.col("c1") + F.col("c2") > 0).alias("receiver_active_after"), F.col("c1").alias("n_owner_msgs_after"),
        last.alias("last_event_turn"), open_end.alias("unresolved_at_end"), (last - F.col("t")).alias("lifetime"))


# Names of output columns.
PROFILE_COLS = [
    "n_assign", "n_unresolved", "unresolved_share", "n_unresolved_after_ack", "unresolved_after_ack_share",
    "n_unresolved_receiver_active", "n_unresolved_reassigned", "n_recovered", "recovered_share", "n_identity_match",
    "identity_match_share", "n_receiver_delivery", "receiver_delivery_share", "longest_unresolved_lifetime",
    "longest_unresolved_rel", "first_unresolved_turn", "first_unresolved_rel", "single_unresolved_through_end",
    "max_simultaneous_unresolved", "any_unresolved", "unresolved_and_acked", "unresolved_and_active", "n_closed_by_refs",
    "n_closed_by_artifact", "refs_delivery_share", "n_reassigned_link", "n_reassigned_link_delivered", "n_msgs"]


def assignment_profile(tr: Traces) -> DataFrame:
    r = assignment_records(tr)
    un = F.col("unresolved_at_end")
    per = r.groupBy("run_id").agg(
        _one().alias("k"), count_where(un).alias("u"), count_where(un & F.col("acked")).alias("ua"),
        count_where(un & F.col("receiver_active_after")).alias("uc"), count_where(un & F.col("reassigned")).alias("ur"),
        count_where(F.col("recovered")).alias("rec"),
        count_where(F.col("artifact_present") & F.col("artifact_is_receiver")).alias("idm"),
        count_where(F.col("owner_delivered")).alias("rd"), F.max(F.when(un, F.col("lifetime"))).alias("longest"),
        F.min(F.when(un, F.col("handoff_turn"))).alias("first"), count_where(F.col("deliver_kind") == "refs").alias("cr"),
        count_where(F.col("deliver_kind") == "artifact").alias("ca"), count_where(F.coalesce("prev_owner", F.lit("")) != "").alias("link"),
        count_where((F.coalesce("prev_owner", F.lit("")) != "") & F.col("delivered")).alias("linkd"))
    peak = open_counter(r.select("run_id", F.col("handoff_turn").alias("t")), r.filter("delivered or artifact_present").select(
        "run_id", F.col("last_event_turn").alias("t"))).groupBy("run_id").agg(F.max("open").alias("peak"))
    j = tr.runs.select("run_id", "n").join(per, "run_id", "left").join(peak, "run_id", "left").na.fill(
        0, [c for c in per.columns if c not in ("run_id", "first", "longest")] + ["peak"])
    k, u, end = F.col("k"), F.col("u"), last_turn()
    vals = [k, u, ratio(u, k), F.col("ua"), ratio("ua", u), F.col("uc"), F.col("ur"), F.col("rec"), ratio("rec", k), F.col("idm"),
            ratio("idm", k), F.col("rd"), ratio("rd", k), F.coalesce("longest", F.lit(0)), ratio("longest", end),
            F.coalesce("first", F.lit(-1)), F.when(F.col("first").isNotNull(), ratio("first", end)).otherwise(-1.0), flag(u == 1),
            F.greatest(F.col("peak"), F.lit(0)), flag(u > 0), flag(F.col("ua") > 0), flag(F.col("uc") > 0), F.col("cr"), F.col("ca"),
            ratio("cr", k), F.col("link"), F.col("linkd"), F.col("n")]
    return j.select("run_id", *[v.cast("double").alias(c) for c, v in zip(PROFILE_COLS, vals)])
