"""Scans, sinks, projections, filters and scalar functions."""

import uuid

from pyspark.sql import functions as F

from tracewright.catalog.base import (KEYWORDS, TOPOLOGY_TYPES, register, sql_keyword, sql_norm, sql_ratio, sql_words)
from tracewright.fixed import COMPLIANCE, MESSAGE_TYPES, WAIT_NOT_A_TASK, WAIT_PHRASES
from tracewright.functions.numbers import finite, ratio
from tracewright.functions.text import content_words, hash_bucket, key_form, keyword_count, mask_agents, whole_turn
from tracewright.operators import basics as B
from tracewright.schema import RUN_FIELDS
from tracewright.session import shared_dir
from tracewright.sources import runs as R

_FILES: dict = {}


def _csv(tr, gzip=False):
    """Export the traces once per session as run CSV (several rows per long run)."""
    key = (tr.spark.sparkContext.applicationId, tr.sf_dir, gzip)
    if key not in _FILES:
        path = f"{shared_dir(tr.spark)}/{key[0]}/runs-{uuid.uuid4().hex[:8]}"
        R.write_csv(R.export_runs(tr), path, gzip)
        _FILES[key] = path
    return _FILES[key]


def _decoded(tr):
    return R.decode_runs(R.read_runs(tr.spark, _csv(tr)))


register("s1_read_runs", "run_id,goal:s n_goal:l", lambda tr: R.read_runs(tr.spark, _csv(tr)).filter(
    "goal is not null").select("run_id", "goal", F.length("goal").alias("n_goal")),
    "SELECT run_id, goal, len(goal) AS n_goal FROM runs")
register("s2_pruned_scan", "run_id:l", lambda tr: tr.spark.read.parquet(f"{tr.sf_dir}/events.parquet").select(
    F.col("user_id").alias("run_id")), "SELECT user_id AS run_id FROM events")
register("s3_repeatable_sample", "run_id:l goal:s", lambda tr: R.sample_runs(
    tr.goals.select("run_id", "goal"), 25, 42),
    "SELECT run_id, goal FROM runs ORDER BY md5('42_' || run_id) LIMIT 25")
register("s4_gzip_csv", "run_id:s rows_read:l", lambda tr: R.read_runs(tr.spark, _csv(tr, True)).filter(
    "goal is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows_read")),
    "SELECT run_id, 1 AS rows_read FROM runs")
register("s5_decode_runs", "run_id:s n_messages,n_artifacts,n_writes,n_agents,n_edges:l", lambda tr: _decoded(tr).groupBy(
    "run_id").agg(*[F.sum(F.coalesce(F.size(c), F.lit(0))).alias(a) for c, a in [
        ("messages", "n_messages"), ("artifacts", "n_artifacts"), ("shared_state", "n_writes"),
        ("agents", "n_agents")]], F.sum(F.greatest(F.coalesce(F.size("topology.edges"), F.lit(0)), F.lit(0))).alias("n_edges")),
    """WITH m AS (SELECT run_id, count(*) c FROM messages GROUP BY 1), a AS (SELECT run_id, count(*) c FROM artifacts GROUP BY 1),
    s AS (SELECT run_id, count(*) c FROM state GROUP BY 1), g AS (SELECT run_id, count(*) c FROM agents GROUP BY 1),
    e AS (SELECT run_id, count(*) c FROM topology_edges GROUP BY 1),
    answer AS (SELECT m.run_id, m.c AS n_messages, coalesce(a.c, 0) AS n_artifacts, coalesce(s.c, 0) AS n_writes,
    coalesce(g.c, 0) AS n_agents, coalesce(e.c, 0) AS n_edges FROM m LEFT JOIN a USING (run_id) LEFT JOIN s USING (run_id)
    LEFT JOIN g USING (run_id) LEFT JOIN e USING (run_id))""")
register("s6_messages", "run_id:s t:l sender,receiver,type,intent,text,tool:s refs:as",
         lambda tr: R.flatten(_decoded(tr))["messages"],
         "SELECT * FROM messages")
register("s6_artifacts", "run_id:s t:l id,maker,type,subtask,hash,status:s", lambda tr: R.flatten(_decoded(tr))[
    "artifacts"].withColumnRenamed("by", "maker"), "SELECT * FROM artifacts")
register("s6_state_writes", "run_id:s t:l agent,key,op,value:s", lambda tr: R.flatten(_decoded(tr))["state"],
         "SELECT * FROM state")
register("s6_agents", "run_id:s agent,role:s", lambda tr: R.flatten(_decoded(tr))["agents"], "SELECT * FROM agents")
register("s6_topology_edges", "run_id:s src,dst:s", lambda tr: R.flatten(_decoded(tr))["topology_edges"],
         "SELECT * FROM topology_edges")
EVENT_LOG_SQL = """log AS (
  SELECT run_id, t, 0 AS rank, 'message' AS kind, '' AS src, sender AS actor, intent AS task FROM messages
  UNION ALL SELECT run_id, t, 1, 'state', key, agent, '' FROM state
  UNION ALL SELECT run_id, t, 2, 'artifact', id, maker, subtask FROM artifacts),
elog AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t IS NULL, t, rank, src) - 1 AS seq FROM log)"""
register("s7_event_log", "run_id,seq,t:l kind,src,actor,task:s", R.event_log,
         f"WITH {EVENT_LOG_SQL}, answer AS (SELECT * FROM elog)")


def _prediction_csv(tr):
    path = f"{shared_dir(tr.spark)}/{tr.spark.sparkContext.applicationId}/predictions-{uuid.uuid4().hex[:8]}"
    R.write_csv(tr.pred, path)
    return tr.spark.read.schema("run_id string, label string, success int, fault_turn int").option(
        "header", True).csv(path)


register("s8_prediction_sink", "run_id,label:s success,fault_turn:l", _prediction_csv,
         "SELECT * FROM pred")
register("s9_constant_answer", "run_id,label:s success,fault_turn:l", lambda tr: R.constant_answer(
    tr.spark.read.parquet(f"{tr.sf_dir}/labels.parquet"), order_col="doc_id")
    if R.missing_columns(tr.spark.read.parquet(f"{tr.sf_dir}/labels.parquet")) else tr.pred,
    "SELECT 'row_' || (row_number() OVER (ORDER BY doc_id) - 1) AS run_id, 'clean' AS label, 1 AS success, "
    "-1 AS fault_turn FROM labels")


def _report(tr):
    path = f"{shared_dir(tr.spark)}/{tr.spark.sparkContext.applicationId}/report-{uuid.uuid4().hex[:8]}"
    tr.pred.groupBy("label").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return tr.spark.read.schema("label string, n bigint").json(path)


register("s10_report_sink", "label:s n:l", _report, "SELECT label, count(*) AS n FROM pred GROUP BY label")

# ---- projections and filters ----
register("p1_assignments", "run_id,t:l sender,receiver,intent:s", B.assignments,
         "SELECT * FROM messages WHERE type = 'handoff' AND len(refs) = 0")
register("p1_deliveries", "run_id,t:l sender,receiver,intent:s refs:as", B.deliveries,
         "SELECT * FROM messages WHERE type = 'handoff' AND len(refs) > 0")
register("p2_type_flags", "run_id,t:l " + ",".join(f"type_{v}" for v in MESSAGE_TYPES) + ":d", B.type_flags,
         "SELECT run_id, t, " + ", ".join(f"CASE WHEN type = '{v}' THEN 1 ELSE 0 END AS type_{v}"
                                          for v in MESSAGE_TYPES) + " FROM messages")
register("p2_topology_flags", "run_id:l " + ",".join(f"topo_{v}" for v in TOPOLOGY_TYPES) + ":d", B.topology_flags,
         "SELECT run_id, " + ", ".join(f"CASE WHEN topo_type = '{v}' THEN 1 ELSE 0 END AS topo_{v}"
                                       for v in TOPOLOGY_TYPES) + " FROM topology")
register("p3_safe_ratio", "run_id:l final_per_status:d", lambda tr: tr.messages.groupBy("run_id").agg(
    ratio(F.sum((F.col("type") == "handoff").cast("int")), F.sum((F.col("type") == "final").cast("int"))).alias(
        "final_per_status")),
    f"SELECT run_id, {sql_ratio(chr(39).join(['sum(CASE WHEN type = ', 'handoff', ' THEN 1 ELSE 0 END)']), chr(39).join(['sum(CASE WHEN type = ', 'final', ' THEN 1 ELSE 0 END)']))} AS final_per_status FROM messages GROUP BY run_id")
register("p4_finite_or_zero", "event_id:l value,inverse:d", lambda tr: tr.spark.read.parquet(
    f"{tr.sf_dir}/events.parquet").select("event_id", finite(F.col("value")).alias("value"), finite(
        F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).when(F.col("user_id") % 5 == 1, F.lit(float("inf")))
        .otherwise(1.0 / (1 + F.col("user_id")))).alias("inverse")),
    "SELECT event_id, coalesce(value, 0.0) AS value, CASE WHEN user_id % 5 < 2 THEN 0.0 ELSE 1.0 / (1 + user_id) END "
    "AS inverse FROM events")
register("p5_aligned_columns", "run_id:l topo_mesh,n_tools,topo_star:d", lambda tr: B.aligned(
    B.topology_flags(tr), ["topo_mesh", "n_tools", "topo_star"]),
    "SELECT run_id, CASE WHEN topo_type = 'mesh' THEN 1 ELSE 0 END AS topo_mesh, 0 AS n_tools, "
    "CASE WHEN topo_type = 'star' THEN 1 ELSE 0 END AS topo_star FROM topology")
SLICES = ["robust", "long", "longest_20", "no_intent", "big_team", "len_short", "len_mid", "len_long", "compliance"] + [
    f"topo_{v}" for v in TOPOLOGY_TYPES]
SLICE_SQL = f"""ta AS (SELECT run_id, count(*) AS n_agents FROM agents GROUP BY run_id),
it AS (SELECT run_id, max(CASE WHEN intent <> '' THEN 1 ELSE 0 END) AS i FROM messages GROUP BY run_id),
th AS (SELECT quantile_cont(n, 0.33) AS p33, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.66) AS p66r,
       quantile_cont(n, 2.0 / 3) AS p66, quantile_cont(n, 0.8) AS p80 FROM runs),
tt AS (SELECT quantile_cont(n_agents, 0.8) AS t80 FROM ta),
slices AS (SELECT r.run_id, n > p50 AND topo_type IN ('mesh', 'blackboard') AS robust, n > p66 AS long,
  n >= p80 AS longest_20, i = 0 AS no_intent, n_agents >= t80 AS big_team, n <= p33 AS len_short,
  n > p33 AND n <= p66r AS len_mid, n > p66r AS len_long,
  regexp_matches(lower(goal), '{COMPLIANCE}') AS compliance,
  {', '.join(f"topo_type = '{v}' AS topo_{v}" for v in TOPOLOGY_TYPES)}
  FROM runs r JOIN ta USING (run_id) JOIN it USING (run_id) JOIN topology USING (run_id), th, tt)"""
register("p6_slice_flags", "run_id:l " + ",".join(SLICES) + ":b", B.slice_flags,
         f"WITH {SLICE_SQL}, answer AS (SELECT * FROM slices)")
register("p7_goal_domain", "doc_id:l domain:s", lambda tr: tr.spark.read.parquet(
    f"{tr.sf_dir}/documents.parquet").select("doc_id", B.goal_domain(F.col("text")).alias("domain")),
    f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{COMPLIANCE}') THEN 'compliance_audit' ELSE 'main_domain' END "
    "AS domain FROM documents")
register("p9_observable", "goal:s n_cols,n:l", lambda tr: (lambda o: o.filter("goal is not null").groupBy("goal").agg(
    F.lit(len(o.columns)).alias("n_cols"), F.count(F.lit(1)).alias("n")))(R.observable(R.read_runs(tr.spark, _csv(tr)))),
    f"SELECT goal, {len(RUN_FIELDS)} AS n_cols, count(*) AS n FROM runs GROUP BY goal")
register("p10_telemetry_flags", "run_id:l intents_empty:b refs_share,short_text_share:d", B.telemetry_flags,
         "SELECT run_id, bool_and(intent = '') AS intents_empty, avg(CASE WHEN len(refs) > 0 THEN 1.0 ELSE 0 END) AS refs_share, "
         "avg(CASE WHEN len(text) BETWEEN 12 AND 30 THEN 1.0 ELSE 0 END) AS short_text_share FROM messages GROUP BY run_id")

# ---- scalar functions ----
register("f1_normalise", "run_id,t:l norm:s", lambda tr: tr.messages, "SELECT * FROM messages")
register("f1_normalise_turns", "conv_id,turn:l norm:s", lambda tr: tr.spark.read.parquet(
    f"{tr.sf_dir}/conversations.parquet").select("conv_id", "turn", B_norm(F.col("text")).alias("norm")),
    f"SELECT conv_id, turn, {sql_norm('text')} AS norm FROM conversations")
register("f2_content_words", "doc_id:l words:as", lambda tr: tr.spark.read.parquet(
    f"{tr.sf_dir}/documents.parquet").select("doc_id", F.sort_array(content_words(F.col("text"))).alias("words")),
    f"SELECT doc_id, list_sort({sql_words('text')}) AS words FROM documents")
register("f3_goal_overlap", "run_id,t:l goal_ov:d", lambda tr: tr.messages, "SELECT * FROM messages")
register("f4_keyword_counts", "conv_id,turn:l " + ",".join(f"kw_{g}" for g in KEYWORDS) + ":l",
         lambda tr: tr.spark.read.parquet(f"{tr.sf_dir}/conversations.parquet").withColumn("low", F.lower("text")).select(
             "conv_id", "turn", *[keyword_count(F.col("low"), g).alias(f"kw_{g}") for g in KEYWORDS]),
         "WITH c AS (SELECT conv_id, turn, lower(text) AS low FROM conversations), answer AS (SELECT conv_id, turn, "
         + ", ".join(f"{sql_keyword('low', g)} AS kw_{g}" for g in KEYWORDS) + " FROM c)")


def _sql_wait():
    arms_a, arms_t = [], []
    bad = ", ".join(f"'{w}'" for w in WAIT_NOT_A_TASK)
    for a, t, g in WAIT_PHRASES:
        arms_a.append(f"WHEN regexp_matches(lower(text), '{a}') THEN regexp_extract(lower(text), '{a}', 1)")
        arms_t.append(f"WHEN regexp_matches(lower(text), '{a}') THEN CASE WHEN regexp_extract(lower(text), '{t}', {g}) "
                      f"IN ('', {bad}) THEN NULL ELSE regexp_extract(lower(text), '{t}', {g}) END")
    return (f"waits AS (SELECT * FROM (SELECT run_id, t, n, sender AS waiter, CASE {' '.join(arms_a)} END AS awaited, "
            f"CASE {' '.join(arms_t)} END AS task FROM messages WHERE type = 'status') WHERE awaited IS NOT NULL)")


WAITS_SQL = _sql_wait()
register("f5_wait_events", "run_id,t:l waiter,awaited,task:s", B.wait_events,
         f"WITH {WAITS_SQL}, answer AS (SELECT * FROM waits)")
register("f6_entropy", "run_id:l type_entropy:d", lambda tr: B_entropy(tr.messages, "type").withColumnRenamed(
    "entropy", "type_entropy"),
    """WITH c AS (SELECT run_id, type, count(*) AS c FROM messages GROUP BY 1, 2),
    s AS (SELECT *, sum(c) OVER (PARTITION BY run_id) AS z FROM c),
    answer AS (SELECT run_id, -sum((c / z) * ln(c / z + 1e-12)) AS type_entropy FROM s GROUP BY run_id)""")
register("f7_key_forms", "doc_id:l key:s turn:l", lambda tr: tr.spark.read.parquet(
    f"{tr.sf_dir}/documents.parquet").select("doc_id", key_form(F.concat(F.lit("  "), F.col("source"))).alias("key"),
                                            whole_turn(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string"))
                                                       .otherwise(F.col("lang"))).alias("turn")),
    "SELECT doc_id, nullif(lower(trim('  ' || source)), '') AS key, try_cast(CASE WHEN doc_id % 2 = 0 THEN "
    "CAST(n_chars AS VARCHAR) ELSE lang END AS BIGINT) AS turn FROM documents")
register("f8_canonical_value", "run_id,t:l canonical:s", lambda tr: tr.state.select(
    "run_id", "t", F.to_json(F.struct("key", "op", "value")).alias("canonical")),
    """SELECT run_id, t, '{"key":"' || key || '","op":"' || op || '","value":"' || value || '"}' AS canonical FROM state""")
register("f9_masked_text", "run_id,t:l masked:s", lambda tr: tr.messages.select(
    "run_id", "t", mask_agents(F.col("text"), "[empty]").alias("masked")),
    r"SELECT run_id, t, regexp_replace(text, '\b[aA][0-9]+\b', '[agent]', 'g') AS masked FROM messages")
register("f10_event_texts", "run_id,t:l kind,line:s", B.event_texts,
         r"""WITH nb AS (SELECT 1), answer AS (
  SELECT m.run_id, t, 'message' AS kind, 'event=message; type=' || type || '; sender role=' || a.role ||
    '; receiver role=' || b.role || '; intent=' || CASE WHEN intent = '' THEN '[none]' ELSE intent END || '; tool=' ||
    CASE WHEN tool = '' THEN '[none]' ELSE tool END || '; text=' || regexp_replace(text, '\ba[0-9]+\b', '[agent]', 'g') AS line
  FROM messages m JOIN agents a ON a.run_id = m.run_id AND a.agent = sender JOIN agents b ON b.run_id = m.run_id AND b.agent = receiver
  UNION ALL SELECT x.run_id, t, 'artifact', 'event=artifact; producer role=' || role || '; subtask=' ||
    CASE WHEN subtask = '' THEN '[none]' ELSE subtask END || '; type=' || type || '; status=' || status
  FROM artifacts x JOIN agents a ON a.run_id = x.run_id AND a.agent = maker
  UNION ALL SELECT s.run_id, t, 'state', 'event=state; writer role=' || role || '; key=' || key || '; op=' || op || '; value=' || value
  FROM state s JOIN agents a ON a.run_id = s.run_id AND a.agent = s.agent)""")
register("f11_causal_metadata", "run_id,seq:l kind:s place,when_rel,log_artifacts,log_writes:d", B.causal_metadata,
         f"""WITH {EVENT_LOG_SQL}, answer AS (SELECT run_id, seq, kind, (seq + 1.0) / (seq + 2.0) AS place,
  CAST(t AS DOUBLE) / (1 + abs(t)) AS when_rel,
  ln(1 + sum(CASE WHEN kind = 'artifact' THEN 1 ELSE 0 END) OVER w) AS log_artifacts,
  ln(1 + sum(CASE WHEN kind = 'state' THEN 1 ELSE 0 END) OVER w) AS log_writes
  FROM elog WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))""")
register("f12_token_buckets", "run_id,t,i,bucket:l", lambda tr: R.token_buckets(tr.plain_messages),
         r"""WITH w AS (SELECT run_id, t, regexp_extract_all(lower(text), '\w+') AS ws FROM messages),
  u AS (SELECT run_id, t, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
  answer AS (SELECT run_id, t, i, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) % 32768 + 1 AS bucket FROM u)""")
SLOT_SQL = """seen AS (SELECT run_id, 'agent' AS kind, sender AS name, 2 * t AS pos FROM messages UNION ALL
  SELECT run_id, 'agent', receiver, 2 * t + 1 FROM messages UNION ALL SELECT run_id, 'task', intent, 2 * t FROM messages),
firsts AS (SELECT run_id, kind, name, min(pos) AS pos FROM seen WHERE name <> '' GROUP BY 1, 2, 3),
slots AS (SELECT run_id, kind, name, row_number() OVER (PARTITION BY run_id, kind ORDER BY pos, name) AS slot FROM firsts)"""
register("f13_slots", "run_id,t,sender_slot,receiver_slot,task_slot:l", B.slotted_messages,
         f"""WITH {SLOT_SQL}, answer AS (SELECT m.run_id, m.t, a.slot AS sender_slot, b.slot AS receiver_slot,
  coalesce(c.slot, 0) AS task_slot FROM messages m JOIN slots a ON a.run_id = m.run_id AND a.kind = 'agent' AND a.name = sender
  JOIN slots b ON b.run_id = m.run_id AND b.kind = 'agent' AND b.name = receiver
  LEFT JOIN slots c ON c.run_id = m.run_id AND c.kind = 'task' AND c.name = intent)""")
register("f14_truncated", "doc_id:l head:s", lambda tr: tr.spark.read.parquet(f"{tr.sf_dir}/documents.parquet").select(
    "doc_id", F.substring("text", 1, 24).alias("head")), "SELECT doc_id, substr(text, 1, 24) AS head FROM documents")


def B_norm(c):
    from tracewright.functions.text import normalise
    return normalise(c)


def B_entropy(df, key):
    from tracewright.operators.runfeatures import entropy_of
    return entropy_of(df, key)
