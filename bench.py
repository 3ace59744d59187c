"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewright import session  # noqa: E402
from tracewright.catalog import all_queries, base  # noqa: E402
from tracewright.operators import lifecycles, matching, runfeatures, turns, waits  # noqa: E402
from tracewright.sources.traces import Traces  # noqa: E402

HEADLINE = [
    "s7_event_log", "a0_run_block", "a15_graph", "a18_lifecycle_block", "a19_deadlock_block", "a20_temporal_block",
    "a21_wait_block", "a22_episode_block", "a23_task_block", "j1_first_replies", "j2_undelivered", "m2_lifecycles",
    "w15_episodes", "w22_causal_turns", "w23_turn_windows", "k5_rule_localiser", "e7_composite", "l11_tfidf_words",
    "t1_bootstrap",
]

#: Tables that several operators read; they are timed apart, so that no operator is charged for or spared another's work.
SHARED = {
    "streaks": lambda tr: tr.once("streaks", runfeatures.streaks),
    "state_changes": lambda tr: tr.once("state_changes", runfeatures.state_changes),
    "first_replies": lambda tr: tr.once("first_replies", matching.first_replies),
    "undelivered": lambda tr: tr.once("undelivered", matching.undelivered),
    "matched": lifecycles.matched, "event_log": waits.ordered_log, "episodes": waits.all_episodes, "turn_counters": turns.turn_counters,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.get_spark(cpus, partitions=int(cpus))
    all_queries()
    times: dict[str, float] = {}

    t0 = time.time()
    tr = Traces.load(spark, sf_dir)
    tr.messages.write.format("noop").mode("overwrite").save()
    times["trace_tables"] = round(time.time() - t0, 3)
    for name, build in SHARED.items():
        t0 = time.time()
        build(tr)
        times[f"shared_{name}"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        if name not in base.REGISTRY:
            continue
        t0 = time.time()
        base.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
