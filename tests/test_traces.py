"""Hand-built runs with known answers."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions.text import normalise, wait_target
from tracewright.operators import evaluate as E
from tracewright.operators import lifecycles as L
from tracewright.operators import localize as K
from tracewright.operators import matching as M
from tracewright.operators import runfeatures as R
from tracewright.operators import turns as TU
from tracewright.operators import waits as W
from tracewright.sources.traces import Traces

MSG = "run_id long, t long, sender string, receiver string, type string, intent string, text string, tool string, refs array<string>"


def traces(spark, runs, artifacts=(), state=(), goal=""):
    rows = []
    for run, msgs in runs.items():
        for t, m in enumerate(msgs):
            d = dict(sender="a1", receiver="a2", type="inform", intent="", text="", tool="", refs=[])
            d.update(m)
            rows.append((run, t, d["sender"], d["receiver"], d["type"], d["intent"], d["text"], d["tool"], d["refs"]))
    m = spark.createDataFrame(rows, MSG)
    a = spark.createDataFrame(list(artifacts), "run_id long, t long, id string, by string, type string, subtask string, hash string, status string")
    s = spark.createDataFrame(list(state), "run_id long, t long, agent string, key string, op string, value string")
    ag = m.select("run_id", F.explode(F.array("sender", "receiver")).alias("agent")).distinct().withColumn("role", F.lit("worker"))
    goals = m.select("run_id").distinct().withColumn("goal", F.lit(goal))
    return Traces.of_messages(m, goals, a, s, ag)


def assign(to, intent, sender="a1"):
    return dict(sender=sender, receiver=to, type="handoff", intent=intent)


def deliver(who, intent):
    return dict(sender=who, receiver="a1", type="handoff", intent=intent, refs=["art_1"])


def pad(k):
    return [dict(sender="a9", receiver="a8", type="inform") for _ in range(k)]


def test_backlog_anchors_and_ages(spark):
    # 41 messages: one task never delivered from turn 0, one delivered at turn 30
    run = [assign("a2", "x"), assign("a3", "y"), *pad(28), deliver("a3", "y"), *pad(10)]
    b = L.temporal_block(traces(spark, {1: run})).first()
    assert (b.bd_at25, b.bd_at50, b.bd_at75, b.bd_at100) == (1.0, 1.0, 0.5, 0.5)
    assert b.ua_age_max_rel == 1.0 and b.bd_grows_late == 1.0 and b.bd_max_rel == 1.0


def test_empty_backlog_does_not_grow(spark):
    run = [assign("a2", "x"), deliver("a2", "x"), *pad(20)]
    b = L.temporal_block(traces(spark, {1: run})).first()
    assert b.bd_grows_late == 0.0 and b.bd_tail_growth == 0.0 and b.ua_age_max_rel == 0.0


def test_old_owner_delivers_after_reassignment(spark):
    run = [assign("a2", "x"), *pad(3), assign("a3", "x"), *pad(3), deliver("a2", "x"), *pad(3)]
    t = traces(spark, {1: run})
    assert L.temporal_block(t).first().rt_old_owner_result_after == 1.0
    rows = {r.t: r for r in L.lifecycles(t).collect()}
    # the delivery closes the newest assignment of the task
    assert not rows[0].delivered and rows[4].delivered and rows[4].deliver_sender == "a2" and rows[4].prev_owner == "a2"


def test_matching_equals_a_stack_replay(spark):
    import random

    rng = random.Random(3)
    runs = {r: [(assign if rng.random() < 0.55 else deliver)(f"a{rng.randint(2, 4)}", rng.choice(["x", "y", "z"])) for _ in range(70)] for r in range(3)}
    got = {(r.run_id, r.t): r.deliver_t for r in L.match_newest(traces(spark, runs)).collect()}
    want = {}
    for run, msgs in runs.items():
        stacks = {}
        for t, m in enumerate(msgs):
            st = stacks.setdefault(m["intent"], [])
            if not m.get("refs"):
                st.append(t)
                want[(run, t)] = None
            elif st:
                want[(run, st.pop())] = t
    assert got == want


WAITS = [("Blocked on a3: I need alpha first.", "a3", "alpha"), ("Waiting for a2 to deliver beta.", "a2", "beta"),
         ("I cannot proceed with this until a4 finishes gamma", "a4", "gamma"), ("On hold: delta from a5 has not arrived", "a5", "delta"),
         ("Still holding for a6 on eps", "a6", "eps"), ("My step depends on a7 closing zeta", "a7", "zeta")]


@pytest.mark.parametrize("text,agent,task", WAITS)
def test_wait_phrases(spark, text, agent, task):
    df = spark.createDataFrame([("status", text), ("inform", text)], "type string, text string")
    got = [r.w for r in df.select(wait_target(F.col("type"), F.col("text")).alias("w")).collect()]
    assert (got[0].awaited, got[0].task) == (agent, task) and got[1] is None


def wait(a, b, task):
    return dict(sender=a, receiver=b, type="status", text=f"Blocked on {b}: I need {task} first.")


def test_wait_graph_cases(spark):
    runs = {1: [wait("a1", "a2", "x"), *pad(4)],
            2: [wait("a1", "a2", "x"), *pad(2), wait("a2", "a1", "x"), wait("a1", "a2", "x"), wait("a2", "a1", "x"), *pad(5)],
            3: [wait("a1", "a2", "x"), wait("a2", "a1", "y"), *pad(3)]}
    b = {r.run_id: r for r in W.wait_block(traces(spark, runs)).collect()}
    assert (b[1].wg_n_wait_edges, b[1].wg_n_recip_pairs) == (1.0, 0.0)
    assert b[2].wg_n_recip_pairs == 1.0 and b[2].wg_has_same_subtask_recip_pair == 1.0 and b[2].wg_max_pair_repeat_after_onset == 2.0
    assert b[2].wg_earliest_recip_pos_rel == pytest.approx(3 / 10) and b[2].wg_max_pair_span_rel == pytest.approx(5 / 10)
    assert b[3].wg_n_recip_pairs == 1.0 and b[3].wg_n_same_subtask_recip_pairs == 0.0


def say(a, text="going round", kind="status"):
    return dict(sender=a, receiver="a9", type=kind, text=text)


def test_episodes(spark):
    far = [say("a1"), *[say("a5", f"filler {w}") for w in ("one", "two", "three", "four", "five", "six")]]
    runs = {1: [say(a) for a in ("a1", "a2", "a1", "a2")], 2: [say(a) for a in ("a1", "a2", "a3")],
            3: [*far, say("a1"), say("a1")],  # gap of seven splits 1 + 2
            4: [say("a1"), say("a5", "filler"), say("a1"), say("a5", "other"), say("a1")]}
    arts = [(4, 2, "i", "a1", "t", "s", "h", "final")]
    e = {r.run_id: r for r in W.episodes(traces(spark, runs, arts)).collect()}
    assert set(e) == {1, 2, 4}
    assert e[1].is_2cycle and e[1].consecutive and e[1].n_trajectory_segments == 4 and e[1].no_progress
    assert e[2].is_3cycle and e[2].length == 3
    assert e[4].interleaved and e[4].max_gap == 2 and e[4].n_artifacts_during == 1 and not e[4].no_progress and e[4].same_agent
    none = {r.run_id: r for r in W.episode_block(traces(spark, runs, arts)).collect()}[3]
    assert none.ep_n_episodes == 0.0 and none.ep_earliest_start_rel == -1.0


def test_hit_at_two(spark):
    rows = [("conflict", "conflict", 12, 10), ("deadlock", "deadlock", 10, 10), ("clean", "clean", -1, -1)]
    df = spark.createDataFrame(rows, "y string, yp string, ft int, tp int")
    assert E.hit_at(df, [2]).first().hit_2 == 1.0
    assert E.hit_at(df.withColumn("ft", F.when(F.col("ft") == 12, 13).otherwise(F.col("ft"))), [2]).first().hit_2 == 0.5
    assert E.hit_at(df.withColumn("yp", F.lit("clean")), [2]).first().hit_2 == 0.0


def test_macro_f1_ignores_absent_labels(spark):
    df = spark.createDataFrame([("clean", "clean"), ("conflict", "conflict")], "y string, yp string")
    assert E.macro_f1(df).first().macro_f1 == 1.0
    assert E.macro_f1(df.withColumn("yp", F.lit("deadlock"))).first().macro_f1 == 0.0


def test_normaliser_order(spark):
    df = spark.createDataFrame([("a2 made art_01 in 30 s!",)], "x string")
    assert df.select(normalise(F.col("x")).alias("n")).first().n == "a# made @ in # s"


def test_phrase_across_messages_is_counted(spark):
    run = [say("a1", "we will not"), say("a1", "arrived on"), say("a2", "hold budget"), say("a2", "of"), say("a1", "turns")]
    k = R.keywords(traces(spark, {1: run})).first()
    text = "we will not arrived on hold budget of turns"
    assert k.kw_wait == sum(text.count(w) for w in ("wait", "blocked", "hold", "depend", "not arrived", "cannot proceed", "on hold"))
    assert k.kw_stop == 1


def test_goal_drift_and_loop_rules(spark):
    run = [say("a1", "ship laptops"), *[say("a2", f"nothing {w}") for w in ("red", "blue", "green")], say("a1", "ship laptops")]
    loop = [say("a1", "ship laptops"), say("a2", "again"), say("a3", "again"), say("a2", "again"), say("a1", "done laptops")]
    t = traces(spark, {1: run, 2: loop}, goal="Ship the laptops")
    r = {x.run_id: x for x in K.rule_turns(t).collect()}
    assert r[1].goal_drift == 1 and r[2].runaway_loop == 1
    p = {x.run_id: x for x in R.positions(t).collect()}
    assert p[1].pos_goal_zero_run == pytest.approx(1 / 4)
    w = {(x.run_id, x.t): x for x in TU.turn_windows(t).collect()}
    assert w[(1, 3)].w_no_goal_streak == 3.0 and w[(2, 3)].w_loop_streak == 3.0 and w[(1, 4)].w_no_goal_streak == 0.0


def test_earliest_flip_and_alternation(spark):
    st = [(1, 1, "a1", "k", "set", "1"), (1, 3, "a2", "k", "set", "2"), (1, 4, "a1", "k", "override", "1"), (1, 5, "a1", "j", "set", "9")]
    t = traces(spark, {1: pad(8)}, state=st)
    s = R.state_block(t).first()
    assert (s.state_flips, s.state_alternating_flips, s.state_keys, s.state_overrides) == (2, 1, 2, 1)
    assert R.positions(t).first().pos_first_conflict_flip == pytest.approx(3 / 7)


def test_writes_of_one_turn_keep_their_order(spark):
    tr = traces(spark, {1: pad(4)})
    rows = [(1, 1, i, "a1", "k", "set", v) for i, v in enumerate(["9", "5", "9"])] + [(1, 2, 0, "a2", "other", "override", "1")]
    tr.__dict__["state"] = spark.createDataFrame(rows, "run_id long, t long, idx long, agent string, key string, op string, value string").orderBy(F.desc("idx"))
    b = R.state_block(tr).first()
    assert (b.state_flips, b.state_alternating_flips, b.state_max_writes_per_key) == (2, 1, 3)
    s = {r.t: r for r in TU.state_so_far(tr).collect()}
    assert [(s[t].writes, s[t].key_writes, s[t].key_values, s[t].flips, s[t].alts) for t in range(4)] == [
        (0, 0, 0, 0, 0), (3, 3, 2, 2, 1), (4, 1, 1, 2, 1), (4, 1, 1, 2, 1)]


def test_all_segments_of_an_episode(spark):
    say = lambda who: dict(sender=who, text="again and again")
    who = [f"a{i % 9}" for i in range(20)] + ["a8", "a8"]
    seg = W.episode_segments(traces(spark, {1: [say(w) for w in who]})).orderBy("segment").collect()
    assert [r.segment for r in seg] == list(range(1, 22)) and [r.agent for r in seg] == [*who[:20], "a8"]


def test_wilcoxon_for_any_number_of_differences(spark):
    from itertools import product

    from tracewright.operators import stats as T

    got = T.wilcoxon_exact(spark.createDataFrame([(x,) for x in (0.1, -0.2, 0.2, 0.4, 0.0, 0.5)], "delta double")).first()
    ranks, w = [1, 2.5, 2.5, 4, 5], 12.5
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=5)]
    assert got.n == 5 and got.w_plus == w and abs(got.p - sum(min(x, 15 - x) <= 2.5 for x in sums) / 32) < 1e-12
    many = T.wilcoxon_exact(spark.createDataFrame([(float(x),) for x in range(1, 61)], "delta double")).first()
    assert many.n == 60 and many.w_plus == 1830 and abs(many.p - 2.0**-59) < 1e-25


def test_resampled_cells_equal_resampled_rows(spark):
    import hashlib
    from collections import Counter

    from tracewright.operators.resample import bootstrap_cells

    rows = sorted(("xyz"[i % 3], "xy"[i % 2], "z") for i in range(17))
    want = Counter()
    for b in range(5):
        for i in range(17):
            want[(b, *rows[int(hashlib.md5(f"3_{b}_{i}".encode()).hexdigest()[:15], 16) % 17])] += 1
    got = bootstrap_cells(spark.createDataFrame(rows, "y string, a string, b string"), ["y", "a", "b"], 5, 3).collect()
    assert {(r.replicate, r.y, r.a, r.b): r.times for r in got} == dict(want)


def test_open_assignments_count_to_the_end_of_the_run(spark):
    talk = [dict(sender="a2", receiver="a1", intent="x"), dict(sender="a3", receiver="a1", intent="y"), dict(sender="a3", receiver="a1", intent="x")]
    run = [assign("a2", "x"), *talk, deliver("a2", "x"), assign("a2", "x"), *talk, *talk]
    got = {r.t: (r.n_owner_msgs, r.n_other_msgs) for r in L.activity_counts(traces(spark, {1: run})).collect()}
    assert got == {0: (1, 1), 5: (2, 2)}


def test_activity_is_counted_across_chunks_from_plain_messages(spark):
    who = ["a1", "a2", "a3"]
    run = []
    for i in range(60):
        talk = dict(sender=who[i % 3], receiver="a1", intent=["x", "y", ""][i // 3 % 3])
        run.append(assign(who[i % 2], ["x", "", "y"][i % 3]) if i in (1, 15, 16, 20, 33) else deliver(who[0], "x") if i in (18, 49) else talk)
    tr = traces(spark, {1: run})
    stop = {r.t: r for r in L.matched(tr).collect()}
    got = {r.t: (r.n_owner_msgs, r.n_other_msgs) for r in L.activity_counts(tr).collect()}
    said = [(i, r.sender, r.intent) for i, r in enumerate(tr.plain_messages.orderBy("t").collect()) if r.type != "handoff"]
    assert set(got) == set(stop) and {r.stop_t is None for r in stop.values()} == {True, False}
    for t, r in stop.items():
        between = [(s, x) for i, s, x in said if t < i < (r.stop_t or 60)]
        other = sum(s != r.receiver and x not in ("", r.intent) for s, x in between) if r.intent else 0
        assert got[t] == (sum(s == r.receiver for s, _ in between), other)
    assert "messages" not in tr.__dict__  # words and goals were not worked out for it


def test_run_files_with_text_ids_tools_and_targets(spark, tmp_path):
    import csv
    import json

    from tracewright.schema import TRAIN_CSV
    from tracewright.sources import runs as RF

    def run(name, writes, label, turn):
        messages = [{"t": 0, "from": "a1", "to": "a2", "type": "handoff", "intent": "x", "text": "do x", "tool": "", "refs": []},
                    {"t": 1, "from": "a2", "to": "a1", "type": "handoff", "intent": "x", "text": "done, see art_1", "tool": "search", "refs": ["art_1"]},
                    {"t": 2, "from": "", "to": "a1", "type": "system", "intent": "", "text": "note", "tool": "", "refs": []},
                    {"t": 3, "from": "a1", "to": "all", "type": "final", "intent": "x", "text": "the end", "tool": "", "refs": []}]
        agents = [{"id": "a1", "role": "orchestrator", "tools": ["search", "write"]}, {"id": "a2", "role": "worker", "tools": []}]
        state = [{"t": 1, "agent": "a2", "key": k, "op": "set", "value": v} for k, v in writes]
        return [name, "reach x", json.dumps(agents), json.dumps(state), json.dumps(messages),
                json.dumps([{"id": "art_1", "by": "a2", "t": 1, "type": "doc", "subtask": "x", "hash": "h", "status": "final"}]),
                json.dumps({"type": "star", "edges": [["a1", "a2"]]}), label, 1, turn]

    rows = [run("run-b", [("run_status", "completed")], "clean", -1), run("run-a", [("k", "9"), ("k", "5"), ("k", "9")], "conflict", 2)]
    with open(tmp_path / "runs.csv", "w", newline="") as f:
        csv.writer(f).writerows([[c.split()[0] for c in TRAIN_CSV.split(", ")], *rows])
    tr = RF.traces_of_runs(RF.decode_runs(RF.read_runs(spark, str(tmp_path / "runs.csv"), TRAIN_CSV)))
    b = {r.run_id: r for r in R.run_block(tr).collect()}
    assert set(b) == {"run-a", "run-b"} and b["run-a"].n_tools_declared == 2
    assert (b["run-b"].status_completed, b["run-a"].status_missing) == (1, 1)
    assert (b["run-a"].state_flips, b["run-a"].state_alternating_flips) == (2, 1)
    assert {(r.run_id, r.label, r.success, r.fault_turn, r.n) for r in tr.truth.collect()} == {("run-b", "clean", 1, -1, 4), ("run-a", "conflict", 1, 2, 4)}
    assert {r.run_id: r.delivered for r in L.lifecycles(tr).collect()} == {"run-a": True, "run-b": True}
    assert TU.turn_windows(tr).count() == 8


def test_events_of_one_turn_keep_the_order_of_their_source(spark):
    import json

    from tracewright.sources import runs as RF

    late = [f"late{i}" for i in range(40)]  # without a turn, more than two chunks of them
    messages = [{"t": 0, "from": "a1", "to": "a2", "type": "inform", "intent": "start"}, *[{"t": None, "from": "a1", "to": "a2", "type": "inform", "intent": x} for x in late]]
    arts = [{"id": x, "by": "a1", "t": t, "type": "doc", "subtask": "s", "hash": "h", "status": "final"} for t, x in [(0, "z"), (0, "b"), (0, "y"), (None, "q"), (None, "p")]]
    raw = spark.createDataFrame([("r", json.dumps(messages), json.dumps(arts), json.dumps([{"t": 0, "agent": "a1", "key": k, "op": "set", "value": "1"} for k in "ml"]), "[]", "{}")],
                                "run_id string, messages string, artifacts string, shared_state string, agents string, topology string")
    flat = RF.flatten(RF.decode_runs(raw))
    tr = Traces.of_messages(flat["messages"], None, flat["artifacts"].orderBy(F.desc("idx")), flat["state"], flat["agents"])
    got = [(r.seq, r.task if r.kind == "message" else r.src) for r in RF.event_log(tr).orderBy("seq").collect()]
    assert got == list(enumerate(["start", "m", "l", "z", "b", "y", *late, "q", "p"]))


def test_tables_of_run_files_and_pairs_of_agents_are_never_broadcast(spark):
    import json

    from tracewright.sources import runs as RF

    messages = [{"t": t, "from": f"a{t}", "to": f"a{(t + 1) % 3}", "type": "inform", "intent": "x"} for t in range(3)]
    raw = spark.createDataFrame([("r", "g", json.dumps(messages), "[]", "[]", "[]", "{}")],
                                "run_id string, goal string, messages string, artifacts string, shared_state string, agents string, topology string")
    tr = RF.traces_of_runs(RF.decode_runs(raw))
    triangles = M.triangles(M.pair_edges(tr.plain_messages))
    assert [tuple(r) for r in triangles.collect()] == [("r", 1.0)]
    for df in (triangles, tr.artifacts.join(tr.agents, "run_id"), tr.state.join(tr.goals, "run_id"), tr.plain_messages.join(tr.topology, "run_id")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def replay(events):
    """Matching one event after the other: (t, last close, first close) of each assignment; events are (t, open?, sender, receiver, intent)."""
    by_intent, by_agent, first, last = {}, {}, {}, {}
    for t, is_open, sender, receiver, intent in events:
        if is_open:
            by_agent.setdefault(receiver, []).append(t)
            if intent:
                by_intent.setdefault(intent, []).append(t)
            first[t] = last[t] = None
            continue
        found = None
        if intent and by_intent.get(intent):
            found = by_intent[intent].pop()
        else:
            found = max((a for a in by_agent.get(sender, []) if first[a] is None), default=None)
        if found is not None:
            first[found] = t if first[found] is None else first[found]
            last[found] = t
    return {(t, last[t], first[t]) for t in first}


def test_interleaved_matching_equals_a_replay(spark):
    import random

    from tracewright.operators import lifecycles

    rng, rows, want = random.Random(7), [], set()
    for run in range(1000):
        style = rng.choice([(0.5, 0.5), (0.8, 0.3), (0.2, 0.2), (0.5, 0.9)])  # how many events open, how many have a task
        agents, tasks, events = rng.randint(1, 4), rng.randint(1, 5), []
        half = rng.random() < 0.2  # first everything opens, then everything closes: pops look many chunks back
        for t in range(rng.choice([10, 30, 90, 200]) if run % 50 else 400):
            is_open = t < 100 if half else rng.random() < style[0]
            intent = f"k{rng.randrange(tasks)}" if rng.random() < style[1] else ""
            events.append((t, is_open, f"a{rng.randrange(agents)}", f"a{rng.randrange(agents)}", intent))
        rows += [(run, t, len(events), "handoff", s, r, i, "", "", [] if o else ["x"], "") for t, o, s, r, i in events]
        want |= {(run, *x) for x in replay(events)}
    names = ["run_id", "t", "n", "type", "sender", "receiver", "intent", "text", "tool", "refs", "goal"]
    frame = spark.createDataFrame(rows, "run_id long, t long, n long, type string, sender string, receiver string, intent string, text string, tool string, refs array<string>, goal string")
    ev = frame.select("run_id", "t", "n", "sender", "receiver", "intent", __import__("pyspark").sql.functions.expr("if(size(refs) = 0, 1, -1)").alias("delta"))
    assert names == frame.columns
    saved, lifecycles.handoff_events = lifecycles.handoff_events, lambda tr: ev
    try:
        got = {(r.run_id, r.t, r.refs_t, r.stop_t) for r in lifecycles._matched(None).collect()}
    finally:
        lifecycles.handoff_events = saved
    assert got == want


def test_replay_holds_a_group_across_batches():
    import pyarrow as pa

    kinds = pa.schema([("run_id", pa.int64()), ("agent", pa.string()), ("c", pa.int64()), ("kind", pa.string()), ("t", pa.int64()), ("until", pa.int64()), ("pop_t", pa.int64())])
    rows = [(1, "a1", 0, "pop", 0), (1, "a1", 0, "item", 1), (1, "a1", 0, "item", 2, 3), (1, "a1", 0, "pop", 4), (1, "a1", 1, "pop", 9), (1, "a2", 0, "item", 1), (2, "a2", 0, "pop", 5)]
    batch = pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*r, None, None))) for r in rows], schema=kinds)
    want = [(1, "a1", 0, "pop", 0, None, None), (1, "a1", 0, "ended", 2, 3, None), (1, "a1", 0, "taken", 1, None, 4), (1, "a1", 1, "pop", 9, None, None),
            (1, "a2", 0, "item", 1, None, None), (2, "a2", 0, "pop", 5, None, None)]
    for size in (1, 2, 3, len(rows)):
        out = list(L._replayed(iter([batch.slice(i, size) for i in range(0, len(rows), size)])))
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_turn_counters_are_not_shuffled_one_by_one(spark):
    import re

    t = traces(spark, {1: [assign("a2", "x"), *pad(40), deliver("a2", "x")], 2: pad(3)}, artifacts=[(1, 5, "art_1", "a2", "x", "x", "h", "final")])
    table = TU._turn_counters(t)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(run_id#\d+L?, k#", plan)
    rows = {(r.run_id, r.t): r for r in table.collect()}
    last = rows[(1, 41)]  # two chunks of 16 turns lie before it
    assert len(rows) == 45 and (last.intent_count, last.assigns, last.deliveries, last.arts, last.arts_for_intent, last.authors) == (2, 1, 1, 1, 1, 2)
    assert (last.pair_count, last.reverse_count, last.nodes, last.edges, rows[(1, 40)].pair_count) == (1, 1, 4, 3, 40)
