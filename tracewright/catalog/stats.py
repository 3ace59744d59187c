"""Statistics, folds, blends, views, probes and audits."""

from pyspark.sql import functions as F

from tracewright.catalog.base import KEYWORDS, LABELS, register, sql_list, sql_ratio
from tracewright.catalog.evaluate import (AB_SQL, FAB_SQL, FOLD_SQL, LABS_SQL, PEAK_SQL, _folded, b, macro)
from tracewright.catalog.lifecycles import PROFILE_SQL
from tracewright.catalog.runblocks import ALL_COLS, BASE_SQL, cnt
from tracewright.catalog.scans import SLICE_SQL
from tracewright.fixed import WEIGHTS
from tracewright.operators import blend as B
from tracewright.operators import evaluate as E
from tracewright.operators import lifecycles as L
from tracewright.operators import offsets as O
from tracewright.operators import quality as Q
from tracewright.operators import resample as RS
from tracewright.operators import runfeatures as R
from tracewright.operators import sets as U
from tracewright.operators import stats as T
from tracewright.operators import turns as TU
from tracewright.operators import waits as W
from tracewright.operators.graph import graph_block

S = sql_ratio
REPS = 1000


def md5i(x):
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


def run_block(tr):
    return tr.once("run_block", R.run_block)


# ---- bootstrap ----
def boot_sql(src, seed, extra="y, a, b"):
    return f"""bi AS (SELECT run_id, {extra}, row_number() OVER (ORDER BY {extra}) - 1 AS i, count(*) OVER () AS m FROM {src}),
bd AS (SELECT replicate, {md5i(f"'{seed}_' || replicate || '_' || i")} % m AS i FROM bi, (SELECT unnest(range({REPS})) AS replicate)),
bw AS (SELECT d.replicate, {', '.join('x.' + e.strip() for e in extra.split(','))} FROM bd d JOIN bi x ON x.i = d.i)"""


SUMMARY = """answer AS (SELECT avg(delta) AS mean_delta, count(*) AS replicates, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi,
  2 * least(avg(CASE WHEN round(delta, 12) <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN round(delta, 12) >= 0 THEN 1.0 ELSE 0 END)) AS p FROM bs)"""
BCOLS = "mean_delta,lo,hi,p:d replicates:l"
BOOT = f"{macro('ba', 'bw', 'replicate', yp='a')}, {macro('bb', 'bw', 'replicate', yp='b')}, bs AS (SELECT replicate, bb.macro_f1 - ba.macro_f1 AS delta FROM ba JOIN bb USING (replicate))"
register("t1_bootstrap", BCOLS, lambda tr: T.bootstrap_test(E.model_labels(tr), REPS, 7), f"WITH {AB_SQL}, {boot_sql('ab', 7)}, {BOOT}, {SUMMARY}")
register("t1_bootstrap_deltas", "replicate:l delta:d", lambda tr: T.bootstrap_deltas(E.model_labels(tr), REPS, 7),
         f"WITH {AB_SQL}, {boot_sql('ab', 7)}, {BOOT}, answer AS (SELECT * FROM bs)")


def _long(tr):
    from tracewright.operators.basics import slices
    return E.model_labels(tr).join(slices(tr).filter("long").select("run_id"), "run_id", "left_semi")


register("t2_slice_bootstrap", BCOLS, lambda tr: T.bootstrap_test(_long(tr), REPS, 9),
         f"WITH {AB_SQL}, {SLICE_SQL}, abl AS (SELECT ab.* FROM ab JOIN slices USING (run_id) WHERE long), {boot_sql('abl', 9)}, {BOOT}, {SUMMARY}")
register("t2_recall_bootstrap", BCOLS, lambda tr: T.recall_bootstrap(E.model_labels(tr), "dropped_handoff", REPS, 11),
         f"WITH {AB_SQL}, pos AS (SELECT * FROM ab WHERE y = 'dropped_handoff'), {boot_sql('pos', 11)}, bs AS (SELECT replicate, avg({b('b = y')}) - avg({b('a = y')}) AS delta FROM bw GROUP BY 1), {SUMMARY}")
register("t3_fold_bootstrap", BCOLS, lambda tr: T.fold_bootstrap(E.by_group_delta(_folded(tr), "fold"), REPS, 13),
         f"""WITH {FAB_SQL}, dr AS (SELECT replicate, {md5i("'13_' || replicate || '_' || fold")} % (SELECT count(*) FROM fd) AS fold FROM fd, (SELECT unnest(range({REPS})) AS replicate)),
  bs AS (SELECT replicate, avg(delta) AS delta FROM dr JOIN fd USING (fold) GROUP BY 1), {SUMMARY}""")
register("t4_mcnemar", "fixed,broke,net:l p:d", lambda tr: T.mcnemar(E.model_labels(tr)),
         f"""WITH {AB_SQL}, c AS (SELECT {cnt('b = y AND a <> y')} AS fixed, {cnt('a = y AND b <> y')} AS broke FROM ab), k AS (SELECT *, unnest(range(least(fixed, broke) + 1)) AS k FROM c),
  q AS (SELECT sum(exp(lgamma(fixed + broke + 1) - lgamma(k + 1) - lgamma(fixed + broke - k + 1) - (fixed + broke) * ln(2.0))) AS cdf FROM k),
  answer AS (SELECT fixed, broke, fixed - broke AS net, least(1.0, 2 * cdf) AS p FROM c, q)""")


def _seeds(tr):
    return E.by_group_delta(E.model_labels(tr).withColumn("seed", F.col("run_id") % 6), "seed")


SEED_SQL = f"{AB_SQL}, sab AS (SELECT *, run_id % 6 AS seed FROM ab), {macro('sa', 'sab', 'seed', yp='a')}, {macro('sb', 'sab', 'seed', yp='b')}, sd AS (SELECT seed, sb.macro_f1 - sa.macro_f1 AS delta FROM sa JOIN sb USING (seed))"
register("t5_paired_summary", "n,wins,df:l mean,std,median,min,max,t:d", lambda tr: T.paired_summary(_seeds(tr)),
         f"""WITH {SEED_SQL}, answer AS (SELECT count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS std, quantile_cont(delta, 0.5) AS median, min(delta) AS "min", max(delta) AS "max",
  {cnt('delta > 0')} AS wins, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM sd)""")
register("t6_wilcoxon", "n:l w_plus,p:d", lambda tr: T.wilcoxon_exact(_seeds(tr)),
         f"""WITH {SEED_SQL}, d AS (SELECT round(delta, 9) AS d FROM sd WHERE round(delta, 9) <> 0),
  r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk, row_number() OVER (ORDER BY abs(d)) - 1 AS i FROM d),
  s AS (SELECT sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, sum(rk) AS z, count(*) AS n FROM r), p AS (SELECT unnest(range(CAST(pow(2, n) AS BIGINT))) AS bits FROM s),
  g AS (SELECT bits, sum(CASE WHEN (bits >> i) & 1 = 1 THEN rk ELSE 0 END) AS got FROM p, r GROUP BY 1),
  answer AS (SELECT any_value(n) AS n, any_value(w) AS w_plus, avg({b('least(got, z - got) <= least(w, z - w)')}) AS p FROM g, s)""")
CORR = [c for c in ALL_COLS if c != "n_messages"]


def corr_sql():
    pe = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr(round(n_messages, 9), round({c}, 9)) AS r FROM bm" for c in CORR)
    lg = " UNION ALL ".join(f"SELECT run_id, '{c}' AS feature, round({c}, 9) AS v FROM bm" for c in ["n_messages", *CORR])
    return f"""bm AS MATERIALIZED (SELECT * FROM base), pe AS ({pe}), lg AS ({lg}), rk AS (SELECT run_id, feature, row_number() OVER (PARTITION BY feature ORDER BY v, run_id) AS r FROM lg),
sp AS (SELECT x.feature, corr(x.r, y.r) AS s FROM rk x JOIN rk y ON x.run_id = y.run_id AND y.feature = 'n_messages' WHERE x.feature <> 'n_messages' GROUP BY 1),
answer AS (SELECT pe.feature, abs(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END) AS pearson, abs(s) AS spearman FROM pe JOIN sp USING (feature) ORDER BY round(abs(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END), 6) DESC, feature LIMIT 5)"""


register("t7_correlations", "feature:s pearson,spearman:d", lambda tr: T.strongest_correlations(run_block(tr), "n_messages", CORR), f"WITH {BASE_SQL}, {corr_sql()}")


def print_sql(cols, src="base"):
    lg = " UNION ALL ".join(f"SELECT run_id, '{c}' AS feature, CAST(round(CAST({c} AS DOUBLE) * 1000000) AS BIGINT) AS v FROM {src}" for c in cols)
    return f"lg AS ({lg}), fp AS (SELECT feature, sum({md5i('''run_id || '|' || v''')}) AS print FROM lg GROUP BY 1)"


register("t8_identical_columns", 'first:s n:l columns:as', lambda tr: T.identical_columns(run_block(tr), ALL_COLS),
         f"WITH {BASE_SQL}, {print_sql(ALL_COLS)}, answer AS (SELECT min(feature) AS \"first\", count(*) AS n, list(feature ORDER BY feature) AS columns FROM fp GROUP BY print HAVING count(*) > 1)")


def shift_sql(cols):
    lg = " UNION ALL ".join(f"SELECT run_id % 3 = 0 AS test, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM bm" for c in cols)
    return f"""bm AS MATERIALIZED (SELECT * FROM base), lg AS ({lg}), z AS (SELECT feature, avg(v) FILTER (WHERE NOT test) AS train_mean, avg(v) FILTER (WHERE test) AS test_mean, quantile_cont(v, 0.5) FILTER (WHERE NOT test) AS train_median,
  quantile_cont(v, 0.5) FILTER (WHERE test) AS test_median FROM lg GROUP BY 1), y AS (SELECT *, (test_mean - train_mean) / (abs(train_mean) + 1e-9) AS rel_shift FROM z),
answer AS (SELECT * FROM y ORDER BY round(abs(rel_shift), 6) DESC, feature LIMIT 20)"""


register("t9_feature_shift", "feature:s train_mean,test_mean,train_median,test_median,rel_shift:d", lambda tr: T.shift_report(run_block(tr), F.col("run_id") % 3 == 0, CORR + ["n_messages"]),
         f"WITH {BASE_SQL}, {shift_sql(CORR + ['n_messages'])}")
MM = ["unresolved_share", "n_unresolved", "longest_unresolved_rel", "receiver_delivery_share"]


def _arms(tr):
    arm = E.model_labels(tr).select("run_id", F.when(F.col("y") == F.col("a"), "right").otherwise("wrong").alias("arm"))
    ag = tr.agents.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_agents"))
    return L.assignment_profile(tr).select("run_id", *MM).join(arm, "run_id").join(tr.runs.select("run_id", "n"), "run_id").join(tr.topology, "run_id").join(ag, "run_id")


ARM_SQL = f"""{AB_SQL}, {PROFILE_SQL}, am AS (SELECT p.*, CASE WHEN y = ab.a THEN 'right' ELSE 'wrong' END AS arm, ab.n, topo_type, (SELECT count(*) FROM agents a WHERE a.run_id = p.run_id) AS n_agents
  FROM prof p JOIN ab USING (run_id) JOIN topology USING (run_id))"""


def arm_long(cols):
    return " UNION ALL ".join(f"SELECT {cols}, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM amx" for m in MM)


D = "avg(v) FILTER (WHERE arm = 'right') - avg(v) FILTER (WHERE arm = 'wrong')"
register("t11_matched_control", "metric:s strata:l mean_delta,spread,positive_share:d", lambda tr: T.matched_control(_arms(tr), MM, 2),
         f"""WITH {ARM_SQL}, amx AS (SELECT *, CASE WHEN n < (SELECT quantile_cont(n, 0.333) FROM am) THEN 0 WHEN n < (SELECT quantile_cont(n, 0.667) FROM am) THEN 1 ELSE 2 END AS third FROM am),
  lg AS ({arm_long('third, topo_type, n_agents, arm')}), s AS (SELECT metric, third, topo_type, n_agents, {D} AS d FROM lg GROUP BY 1, 2, 3, 4 HAVING {cnt("arm = 'right'")} >= 2 AND {cnt("arm = 'wrong'")} >= 2),
  answer AS (SELECT metric, count(*) AS strata, avg(d) AS mean_delta, stddev_pop(d) AS spread, avg({b('round(d, 9) > 0')}) AS positive_share FROM s GROUP BY 1)""")
register("t12_fold_signs", "metric:s folds,positive:l mean_delta:d", lambda tr: T.fold_signs(_arms(tr).join(RS.stratified_folds(tr.truth, 3, 42).select("run_id", "fold"), "run_id"), MM),
         f"""WITH {ARM_SQL}, {FOLD_SQL}, amx AS (SELECT am.*, fold FROM am JOIN folds USING (run_id)), lg AS ({arm_long('fold, arm')}), s AS (SELECT metric, fold, {D} AS d FROM lg GROUP BY 1, 2),
  answer AS (SELECT metric, count(*) AS folds, {cnt('round(d, 9) > 0')} AS positive, avg(d) AS mean_delta FROM s GROUP BY 1)""")
register("t13_error_pool", "wrong_rows,above:l reference:d", lambda tr: T.error_pool(_arms(tr), "n_unresolved"),
         f"""WITH {ARM_SQL}, m AS (SELECT quantile_cont(n_unresolved, 0.5) AS ref FROM am WHERE arm = 'right'), answer AS (SELECT count(*) AS wrong_rows, {cnt('n_unresolved > ref')} AS above, max(ref) AS reference FROM am, m WHERE arm = 'wrong')""")

# ---- folds ----
register("l1_folds", "run_id:l label:s fold:l", lambda tr: RS.stratified_folds(tr.truth, 3, 42), f"WITH {FOLD_SQL}, answer AS (SELECT * FROM folds)")
register("l1_document_folds", "doc_id,quality,fold:l", lambda tr: RS.stratified_folds(tr.spark.read.parquet(f"{tr.sf_dir}/labels.parquet"), 5, 7, label="quality", key="doc_id"),
         "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5('7_' || doc_id), doc_id) - 1) % 5 AS fold FROM labels")
LOSS_SQL = ", ".join(f"{md5i(f'''18 || '_{k}_' || run_id''')} % 1000 < {p} AS lose_{k}" for k, p in Q.LOSS.items())
VIEW_SQL = f"""lf AS (SELECT * FROM (SELECT run_id, {LOSS_SQL} FROM runs) WHERE {' OR '.join(f'lose_{k}' for k in Q.LOSS)}),
hm AS (SELECT m.run_id, m.t, row_number() OVER (PARTITION BY m.run_id ORDER BY md5('18_refs_' || m.run_id || '_' || m.t), m.t) - 1 < n // 2 AS pr,
  row_number() OVER (PARTITION BY m.run_id ORDER BY md5('18_text_' || m.run_id || '_' || m.t), m.t) - 1 < n // 2 AS px FROM messages m JOIN lf USING (run_id)),
views AS (SELECT run_id || '_v' AS view_id, run_id AS parent_id, t, sender, receiver, type, CASE WHEN lose_intent THEN '' ELSE intent END AS intent,
  CASE WHEN lose_text AND px THEN substr(text, 1, {md5i("'18_clip_' || run_id || '_' || t")} % 19 + 12) ELSE text END AS text, tool, CASE WHEN lose_refs AND pr THEN CAST([] AS VARCHAR[]) ELSE refs END AS refs
  FROM messages JOIN lf USING (run_id) JOIN hm USING (run_id, t))"""
MV = "view_id:s parent_id,t:l sender,receiver,type,intent,text,tool:s refs:as"
register("l2_grouped_folds", "view_id:s parent_id,fold:l", lambda tr: RS.grouped_folds(tr.truth, Q.lossy_messages(tr, 18).select("view_id", "parent_id").distinct(), 3, 42),
         f"WITH {FOLD_SQL}, {VIEW_SQL}, answer AS (SELECT CAST(run_id AS VARCHAR) AS view_id, run_id AS parent_id, fold FROM folds UNION ALL SELECT DISTINCT view_id, parent_id, fold FROM views JOIN folds ON run_id = parent_id)")
NEST_SQL = f"""{FOLD_SQL}, fit AS (SELECT run_id, label, o AS outer_fold FROM folds, (SELECT unnest(range(3)) AS o) WHERE o <> fold),
nested AS (SELECT run_id, label, outer_fold, (row_number() OVER (PARTITION BY outer_fold, label ORDER BY md5('43_' || run_id), run_id) - 1) % 2 AS fold FROM fit)"""
register("l3_nested_folds", "run_id,outer_fold,fold:l label:s", lambda tr: RS.nested_folds(tr.truth, 3, 2, 42), f"WITH {NEST_SQL}, answer AS (SELECT * FROM nested)")


def _window_targets(tr):
    from tracewright.operators.heads import window_targets
    return window_targets(tr)


register("l4_window_targets", "run_id,t:l target:s weight:d", _window_targets,
         """SELECT m.run_id, m.t, CASE WHEN label <> 'clean' AND abs(m.t - fault_turn) <= 2 THEN label ELSE 'background' END AS target,
  CASE WHEN label <> 'clean' AND abs(m.t - fault_turn) <= 2 THEN 0.125 ELSE 0.25 END AS weight FROM messages m JOIN truth USING (run_id)""")
register("j15_fit_and_held", "run_id,held:l", lambda tr: (lambda f: tr.runs.select("run_id").join(f.filter("fold = 1"), "run_id", "left_semi").withColumn("held", F.lit(1)).unionByName(
    tr.runs.select("run_id").join(f.filter("fold = 1"), "run_id", "left_anti").withColumn("held", F.lit(0))))(RS.stratified_folds(tr.truth, 3, 42)),
    f"WITH {FOLD_SQL}, answer AS (SELECT run_id, CASE WHEN fold = 1 THEN 1 ELSE 0 END AS held FROM folds)")
register("u5_fold_check", "what,problem:s", lambda tr: U.fold_violations(RS.stratified_folds(tr.truth, 3, 42).filter("run_id % 20 <> 0").unionByName(
    RS.stratified_folds(tr.truth, 3, 42).filter("run_id % 31 = 0")), tr.runs, 4),
    f"""WITH {FOLD_SQL}, f AS (SELECT run_id, fold FROM folds WHERE run_id % 20 <> 0 UNION ALL SELECT run_id, fold FROM folds WHERE run_id % 31 = 0), h AS (SELECT run_id, count(*) AS c FROM f GROUP BY 1),
  answer AS (SELECT CAST(r.run_id AS VARCHAR) AS what, CASE WHEN c IS NULL THEN 'never held' ELSE 'held more than once' END AS problem FROM runs r LEFT JOIN h USING (run_id) WHERE c IS NULL OR c <> 1
  UNION ALL SELECT CAST(k AS VARCHAR), 'empty fold' FROM (SELECT unnest(range(4)) AS k) WHERE k NOT IN (SELECT fold FROM f))""")
register("u6_owner_coverage", "run_id,rows_lost:l", lambda tr: U.owners_without_block(tr.plain_messages.select("run_id"), tr.artifacts.filter("t < 8").select("run_id")),
         "SELECT run_id, count(*) AS rows_lost FROM messages WHERE run_id NOT IN (SELECT run_id FROM artifacts WHERE t < 8) GROUP BY 1")
register("u1_with_views", MV, lambda tr: Q.with_views(tr, 18), f"WITH {VIEW_SQL}, answer AS (SELECT CAST(run_id AS VARCHAR) AS view_id, run_id AS parent_id, t, sender, receiver, type, intent, text, tool, refs FROM messages UNION ALL SELECT * FROM views)")
PARITY = ["n_assign", "undelivered_assign", "reply_delay_mean"]


def _nudged(tr):
    h = R.handoffs(tr)
    return h, h.withColumn("n_assign", F.col("n_assign") + F.when(F.col("run_id") % 25 == 0, 1).otherwise(0))


register("u4_row_differences", "run_id,n_assign,undelivered_assign:l side:s", lambda tr: (lambda a, c: U.row_differences(
    a.select("run_id", "n_assign", "undelivered_assign"), c.select("run_id", "n_assign", "undelivered_assign")))(*_nudged(tr)),
    f"WITH {BASE_SQL}, answer AS (SELECT run_id, n_assign, undelivered_assign, 'left' AS side FROM base WHERE run_id % 25 = 0 UNION ALL SELECT run_id, n_assign + 1, undelivered_assign, 'right' FROM base WHERE run_id % 25 = 0)")
register("u4_column_differences", "column:s max_diff:d n_diff:l", lambda tr: U.column_differences(*_nudged(tr), ["run_id"], PARITY),
         "SELECT 'n_assign' AS \"column\", 1 AS max_diff, count(*) AS n_diff FROM runs WHERE run_id % 25 = 0 UNION ALL SELECT 'undelivered_assign', 0, 0 UNION ALL SELECT 'reply_delay_mean', 0, 0")

# ---- blends ----
ALPHAS = [round(i * 0.05, 2) for i in range(21)]


def decided_sql(src, key):
    """Composite per candidate; src has (key, run_id, c, score)."""
    return f"""dq AS (SELECT *, row_number() OVER (PARTITION BY {key}, run_id ORDER BY score DESC, c) AS k FROM {src}),
dd AS (SELECT q.{key}, q.run_id, t.label AS y, {sql_list(LABELS)}[1 + q.c] AS yp, t.success AS s, p.success AS sp, t.fault_turn AS ft, k.t AS tp FROM dq q JOIN peaks k ON k.run_id = q.run_id AND k.c = q.c
  JOIN truth t ON t.run_id = q.run_id JOIN pred p ON p.run_id = q.run_id WHERE q.k = 1),
ddr AS (SELECT dd.* FROM dd JOIN slices USING (run_id) WHERE robust), {macro('dm', 'dd', key)}, {macro('dr', 'ddr', key)},
db AS (SELECT {key}, {S('2 * count(*) FILTER (WHERE s = 1 AND sp = 1)', '2 * count(*) FILTER (WHERE s = 1 AND sp = 1) + count(*) FILTER (WHERE s <> sp)')} AS success_f1,
  coalesce(avg({b('y = yp AND tp >= 0 AND abs(tp - ft) <= 2')}) FILTER (WHERE y <> 'clean'), 0) AS fault_turn_hit2 FROM dd GROUP BY 1),
dc AS (SELECT {key}, dm.macro_f1, coalesce(dr.macro_f1, 0) AS robustness_f1, success_f1, fault_turn_hit2, {WEIGHTS['macro_f1']} * dm.macro_f1 + {WEIGHTS['robustness_f1']} * coalesce(dr.macro_f1, 0)
  + {WEIGHTS['success_f1']} * success_f1 + {WEIGHTS['fault_turn_hit2']} * fault_turn_hit2 AS composite FROM dm LEFT JOIN dr USING ({key}) JOIN db USING ({key}))"""


BLEND_SQL = f"""{LABS_SQL}, {SLICE_SQL}, {PEAK_SQL}, ga AS (SELECT alpha, run_id, c, round((1 - alpha) * pa + alpha * pb, 9) AS score FROM label_probs,
  (SELECT CAST(unnest([{', '.join(map(str, ALPHAS))}]) AS DOUBLE) AS alpha)), {decided_sql('ga', 'alpha')}"""
CC = "macro_f1,robustness_f1,success_f1,fault_turn_hit2,composite:d"
register("l13_blend_curve", f"alpha:d {CC}", lambda tr: B.blend_curve(tr, ALPHAS), f"WITH {BLEND_SQL}, answer AS (SELECT * FROM dc)")
register("l13_best_alpha", f"alpha:d {CC}", lambda tr: B.best_alpha(B.blend_curve(tr, ALPHAS)), f"WITH {BLEND_SQL}, answer AS (SELECT * FROM dc ORDER BY round(composite, 9) DESC, alpha DESC LIMIT 1)")
register("j14_candidate_grid", "alpha:d run_id,c:l p:d", lambda tr: B.grid(tr.label_probs, "alpha", [0.0, 0.5, 1.0]).withColumn("p", (1 - F.col("alpha")) * F.col("pa") + F.col("alpha") * F.col("pb")),
         "SELECT alpha, run_id, c, (1 - alpha) * pa + alpha * pb AS p FROM label_probs, (SELECT CAST(unnest([0.0, 0.5, 1.0]) AS DOUBLE) AS alpha)")
THR = [round(0.05 + i * 0.01, 2) for i in range(91)]
register("l10_gate_sweep", "threshold,macro_f1:d", lambda tr: B.gate_sweep(tr, THR), f"""WITH {LABS_SQL},
  two AS (SELECT run_id, max(CASE WHEN c = 0 THEN 1 - pa END) AS fault, arg_max(c, wb * 10 - c) FILTER (WHERE c > 0) AS kind FROM label_probs JOIN lw USING (run_id, c) GROUP BY 1),
  gs AS (SELECT threshold, label AS y, CASE WHEN round(fault, 9) >= threshold THEN {sql_list(LABELS)}[1 + kind] ELSE 'clean' END AS yp FROM two JOIN truth USING (run_id),
  (SELECT CAST(unnest([{', '.join(map(str, THR))}]) AS DOUBLE) AS threshold)), {macro('answer', 'gs', 'threshold')}""")
CANDS = B.offset_candidates([0.0] * 7, 0.2)
register("l14_offset_step", f"candidate:l {CC}", lambda tr: B.score_offsets(tr, CANDS), f"""WITH {LABS_SQL}, {SLICE_SQL}, {PEAK_SQL},
  of AS (SELECT unnest({CANDS}) AS d, unnest(range({len(CANDS)})) AS candidate), go AS (SELECT candidate, run_id, c, round(ln(greatest(pa, 1e-15)) + d[c + 1], 9) AS score FROM label_probs, of),
  {decided_sql('go', 'candidate')}, answer AS (SELECT * FROM dc)""")


#: Decision rows as SQL: logarithms in units of 1e-9 and hits by class.
DECISION_SQL = f"""dk AS (SELECT l.run_id, list(CAST(round(ln(greatest(pa, 1e-15)) * 1000000000) AS BIGINT) ORDER BY l.c) AS logs,
  list(CASE WHEN l.c > 0 AND t.label = {sql_list(LABELS)}[1 + l.c] AND k.t >= 0 AND abs(k.t - t.fault_turn) <= 2 THEN 1 ELSE 0 END ORDER BY l.c) AS hits
  FROM label_probs l JOIN truth t USING (run_id) LEFT JOIN peaks k ON k.run_id = l.run_id AND k.c = l.c GROUP BY l.run_id),
dx AS MATERIALIZED (SELECT dk.*, list_position({sql_list(LABELS)}, t.label) - 1 AS y, t.success AS s, p.success AS sp, CASE WHEN robust THEN 1 ELSE 0 END AS rob
  FROM dk JOIN truth t USING (run_id) JOIN pred p USING (run_id) JOIN slices USING (run_id))"""


def offsets_scored_sql(name, src):
    """Scores of offset vectors on decision rows, each by itself; src has (g, id, units, run_id, y, s, sp, rob, logs, hits)."""
    f1 = "CASE WHEN {p} + {n} > 0 THEN 2.0 * {t} / ({p} + {n}) ELSE 0 END"
    one, rob = f1.format(p="pred", n="n", t="tp"), f1.format(p="rpred", n="rn", t="rtp")
    return f"""{name}d AS MATERIALIZED (SELECT g, id, y, s, sp, rob, hits, list_position(v, list_max(v)) - 1 AS c FROM (SELECT *, [logs[i + 1] + 12500000 * units[i + 1] FOR i IN range(7)] AS v FROM {src})),
{name}k AS (SELECT g, id, k, sum(CAST(c = k AS INT)) AS pred, sum(CAST(c = k AND y = k AS INT)) AS tp, sum(CAST(y = k AS INT)) AS n,
  sum(rob * CAST(c = k AS INT)) AS rpred, sum(rob * CAST(c = k AND y = k AS INT)) AS rtp, sum(rob * CAST(y = k AS INT)) AS rn FROM {name}d, (SELECT unnest(range(7)) AS k) GROUP BY g, id, k),
{name}m AS (SELECT g, id, coalesce(avg({one}) FILTER (WHERE n > 0), avg({one})) AS macro_f1, coalesce(avg({rob}) FILTER (WHERE rn > 0), avg({rob})) AS robustness_f1 FROM {name}k GROUP BY g, id),
{name}h AS (SELECT g, id, {sql_ratio('2 * count(*) FILTER (WHERE s = 1 AND sp = 1)', '(2 * count(*) FILTER (WHERE s = 1 AND sp = 1) + count(*) FILTER (WHERE s <> sp))')} AS success_f1,
  {sql_ratio('sum(hits[c + 1])', 'count(*) FILTER (WHERE y > 0)')} AS fault_turn_hit2 FROM {name}d GROUP BY g, id),
{name} AS MATERIALIZED (SELECT *, {WEIGHTS['macro_f1']} * macro_f1 + {WEIGHTS['robustness_f1']} * robustness_f1 + {WEIGHTS['success_f1']} * success_f1 + {WEIGHTS['fault_turn_hit2']} * fault_turn_hit2 AS composite
  FROM {name}m JOIN {name}h USING (g, id))"""


SWEEP_AT = [0, 8, -4, 0, 16, -32, 1]
register("l14_breakpoint_sweep", f"class,unit:l {CC}", lambda tr: O.sweep(O.decision_rows(tr).withColumn("g", F.lit(0).cast("long")), {0: SWEEP_AT}).withColumnsRenamed({"c": "class", "u": "unit"}),
         f"""WITH {LABS_SQL}, {SLICE_SQL}, {PEAK_SQL}, {DECISION_SQL}, grid AS (SELECT c * 100 + u AS id, c, u, [CASE WHEN i = c THEN u ELSE {SWEEP_AT}[i + 1] END FOR i IN range(7)] AS units
  FROM (SELECT unnest(range(1, 7)) AS c), (SELECT unnest(range(-32, 33)) AS u)), each AS (SELECT 0 AS g, id, units, dx.* FROM grid, dx), {offsets_scored_sql('sc', 'each')},
  answer AS (SELECT c AS class, u AS unit, sc.* EXCLUDE (g, id) FROM sc JOIN grid USING (id))""")


def search_sql(fit, groups, rounds=36):
    """The search written out: each round scores every legal neighbour of each group one by one; enough rounds for it to end. ``fit`` has decision rows with g."""
    steps = str(list(O.STEPS))
    out = [f"b0 AS (SELECT unnest({groups}) AS g, 0 AS id, [0, 0, 0, 0, 0, 0, 0] AS units)", "e0 AS (SELECT id, units, f.* FROM b0 JOIN fit f USING (g))", offsets_scored_sql("q0", "e0"),
           "s0 AS MATERIALIZED (SELECT b0.g, units, 0 AS step, round(composite, 10) AS now FROM b0 JOIN q0 USING (g))"]
    for i in range(1, rounds + 1):
        out += [f"""b{i} AS MATERIALIZED (SELECT * FROM (SELECT g, 2 * c + CASE WHEN sign < 0 THEN 1 ELSE 0 END AS id, [CASE WHEN i = c THEN units[i + 1] + sign * {steps}[step + 1] ELSE units[i + 1] END FOR i IN range(7)] AS units
  FROM s{i - 1}, (SELECT unnest(range(1, 7)) AS c), (SELECT unnest([1, -1]) AS sign) WHERE step < 5) WHERE list_max([abs(x) FOR x IN units]) <= 32)""",
                f"e{i} AS (SELECT id, units, f.* FROM b{i} JOIN fit f USING (g))", offsets_scored_sql(f"q{i}", f"e{i}"),
                f"""t{i} AS (SELECT g, units, round(composite, 10) AS top FROM q{i} JOIN b{i} USING (g, id)
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(composite, 10) DESC, list_sum([x * x FOR x IN units]), id) = 1)""",
                f"""s{i} AS MATERIALIZED (SELECT s.g, CASE WHEN top > now THEN t.units ELSE s.units END AS units, CASE WHEN t.g IS NULL OR top > now THEN step ELSE step + 1 END AS step, greatest(now, top) AS now
  FROM s{i - 1} s LEFT JOIN t{i} t USING (g))"""]
    return f"fit AS MATERIALIZED ({fit}), " + ",\n".join(out) + f", found AS (SELECT g, CASE WHEN step = 5 THEN units END AS units, now FROM s{rounds})"


def _offset_search(tr):
    units, best = O.search(O.decision_rows(tr).withColumn("g", F.lit(0).cast("long")), [0])[0]
    return tr.spark.createDataFrame([(float(best), [u * O.UNIT for u in units])], "composite double, offsets array<double>")


def _cross_fit_scores(tr):
    decided, table = O.cross_fitted(tr)
    held = decided.groupBy("fold").agg(F.avg(F.when(F.col("c") == F.col("y"), 1.0).otherwise(0.0)).alias("held_accuracy"))
    return table.join(held, "fold")


OFFSET_SQL = f"{LABS_SQL}, {SLICE_SQL}, {PEAK_SQL}, {DECISION_SQL}"
register("l14_offset_search", "composite:d offsets:ad", _offset_search,
         f"WITH {OFFSET_SQL}, {search_sql('SELECT 0 AS g, dx.* FROM dx', [0])}, answer AS (SELECT now AS composite, [0.0125 * u FOR u IN units] AS offsets FROM found)")
register("l14_cross_fit", "fold:l offsets:ad fit_composite,held_accuracy:d", _cross_fit_scores,
         f"""WITH {OFFSET_SQL}, {FOLD_SQL}, {search_sql('SELECT g, dx.* FROM dx JOIN folds USING (run_id), (SELECT unnest(range(3)) AS g) WHERE g <> fold', [0, 1, 2])},
  own AS (SELECT g, y, units, [logs[i + 1] + 12500000 * units[i + 1] FOR i IN range(7)] AS v FROM dx JOIN folds USING (run_id) JOIN found ON g = fold),
  held AS (SELECT g, avg(CASE WHEN list_position(v, list_max(v)) - 1 = y THEN 1.0 ELSE 0.0 END) AS held_accuracy FROM own GROUP BY g),
  answer AS (SELECT g AS fold, [0.0125 * u FOR u IN units] AS offsets, now AS fit_composite, held_accuracy FROM found JOIN held USING (g))""")
register("l15_average", "run_id,c:l p:d", lambda tr: B.averaged([tr.label_probs.select("run_id", "c", F.col("pa").alias("p")), tr.label_probs.select("run_id", "c", F.col("pb").alias("p"))]),
         "SELECT run_id, c, (pa + pb) / 2 AS p FROM label_probs")
register("l15_validity", "runs,out_of_range,bad_sum,bad_classes:l", lambda tr: B.probability_checks(tr.label_probs.select("run_id", "c", (F.col("pa") * F.when(F.col("run_id") % 9 == 0, 2).otherwise(1)).alias("p")).filter(
    "run_id % 14 <> 0 or c < 6")),
    """WITH z AS (SELECT run_id, c, pa * CASE WHEN run_id % 9 = 0 THEN 2 ELSE 1 END AS p FROM label_probs WHERE run_id % 14 <> 0 OR c < 6),
  g AS (SELECT run_id, sum(p) AS s, count(*) AS k, max(CASE WHEN p < 0 OR p > 1 THEN 1 ELSE 0 END) AS o FROM z GROUP BY 1),
  answer AS (SELECT count(*) AS runs, sum(o) AS out_of_range, count(*) FILTER (WHERE abs(s - 1) > 1e-9) AS bad_sum, count(*) FILTER (WHERE k <> 7) AS bad_classes FROM g)""")

# ---- views and probes ----
register("l19_lossy_messages", MV, lambda tr: Q.lossy_messages(tr, 18), f"WITH {VIEW_SQL}, answer AS (SELECT * FROM views)")
register("l19_lossy_artifacts", "view_id:s parent_id,t:l id,type,subtask,hash,status:s", lambda tr: Q.lossy_artifacts(tr, 18),
         f"WITH {VIEW_SQL}, answer AS (SELECT run_id || '_v' AS view_id, run_id AS parent_id, t, id, type, CASE WHEN lose_subtask THEN '' ELSE subtask END AS subtask, hash, status FROM artifacts JOIN lf USING (run_id))")
strip = "lower(text)"
for w in KEYWORDS["drift"]:
    strip = f"replace({strip}, '{w}', ' ')"
PROBE = {"mask": ("'item ' || t", "intent", "refs"), "keywords": (strip, "intent", "refs"), "intents": ("text", "''", "refs"), "refs": ("text", "intent", "CAST([] AS VARCHAR[])")}
for kind, (tx, it, rf) in PROBE.items():
    register(f"l20_probe_{kind}", "run_id,t:l text,intent:s refs:as", lambda tr, kind=kind: Q.probe_messages(tr, kind), f"SELECT run_id, t, {tx} AS text, {it} AS intent, {rf} AS refs FROM messages")
register("d1_leak_probe", "rows,rows_again,differing:l", lambda tr: Q.leak_probe(tr, R.handoffs), "SELECT count(*) AS rows, count(*) AS rows_again, 0 AS differing FROM runs")
register("d2_rename_probe", "rows,rows_again,differing:l", lambda tr: Q.rename_probe(tr, graph_block), "SELECT count(*) AS rows, count(*) AS rows_again, 0 AS differing FROM runs")
register("d3_future_probe", "rows,rows_again,differing:l", lambda tr: Q.future_probe(tr, TU.turn_counters, 30), "SELECT count(*) AS rows, count(*) AS rows_again, 0 AS differing FROM messages WHERE t <= 30")
RUN_BLOCKS = {"run_block": R.run_block, "positions": R.positions, "lifecycle": L.lifecycle_block, "deadlock": L.deadlock_block, "temporal": L.temporal_block, "waits": W.wait_block,
              "episodes": W.episode_block, "tasks": W.task_block}
TURN_TABLES = {"turn_counters": TU.turn_counters, "turn_windows": TU.turn_windows, "causal_turns": TU.causal_turns}
#: Tables with a fault planted, which the reports must find: targets and later turns.
PLANTED = lambda tr: tr.run_sizes.join(tr.truth.select("run_id", F.when(F.col("label") == "clean", 0).otherwise(1).alias("x")), "run_id").select("run_id", "x")
LENGTHS = lambda tr: tr.messages.select("run_id", "t", "n")
CUTS = [5, 30, 60]


def _listed(names, rows, flagged="false", n="count(*)", differing="0"):
    return " UNION ALL ".join(f"SELECT '{x}' AS block, {flagged} AS flagged, {n} AS rows, {differing} AS differing FROM {rows}" for x in names)


register("d1_leak_report", "block:s flagged:b rows,differing:l", lambda tr: Q.leak_report(tr, RUN_BLOCKS | TURN_TABLES | {"planted": PLANTED}),
         f"""SELECT * FROM ({_listed(RUN_BLOCKS | TURN_TABLES, '(SELECT 1)', n='0')} UNION ALL SELECT 'planted', true, count(*), 2 * count(*) FILTER (WHERE label <> 'clean') FROM truth)""")
register("d3_future_report", "table:s cut,rows,differing:l", lambda tr: Q.future_report(tr, {"turn_counters": TU.turn_counters, "planted": LENGTHS}, CUTS),
         f"""SELECT x.tab AS "table", cut, count(*) AS rows, CASE WHEN x.tab = 'planted' THEN 2 * count(*) FILTER (WHERE n > cut + 1) ELSE 0 END AS differing
  FROM messages, (SELECT unnest({CUTS}) AS cut), (SELECT unnest(['turn_counters', 'planted']) AS tab) x WHERE t <= cut GROUP BY 1, 2""")
register("d4_allowed_changes", "column:s changed:l allowed:b", lambda tr: Q.allowed_changes(tr, 18),
         f"""WITH {VIEW_SQL}, j AS (SELECT v.*, m.intent AS oi, m.text AS ox, m.refs AS orf FROM views v JOIN messages m ON m.run_id = v.parent_id AND m.t = v.t),
  answer AS (SELECT 'intent' AS "column", {cnt('intent <> oi')} AS changed, true AS allowed FROM j UNION ALL SELECT 'text', {cnt('text <> ox')}, true FROM j UNION ALL SELECT 'refs', {cnt('refs <> orf')}, true FROM j
  UNION ALL SELECT unnest(['sender', 'receiver', 'type', 'tool']), 0, false)""")
FP = ["run_id", "t", "sender", "receiver", "type", "intent", "text", "tool"]
register("d5_fingerprint", "rows:l print:s", lambda tr: Q.fingerprint(tr.plain_messages, FP), f"""SELECT count(*) AS rows, CAST(sum({md5i("concat_ws('|', " + ', '.join(FP) + ")")}) AS VARCHAR) AS print FROM messages""")
register("d5_document_fingerprint", "rows:l print:s", lambda tr: Q.fingerprint(tr.spark.read.parquet(f"{tr.sf_dir}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]),
         f"""SELECT count(*) AS rows, CAST(sum({md5i("concat_ws('|', doc_id, coalesce(text, '~'), coalesce(lang, '~'), coalesce(source, '~'), coalesce(CAST(n_chars AS VARCHAR), '~'))")}) AS VARCHAR) AS print FROM documents""")
register("d6_contract", "runs,gaps,label_turn_mismatch,bad_success,turn_outside:l", Q.contract_check, "SELECT count(*) AS runs, 0 AS gaps, 0 AS label_turn_mismatch, 0 AS bad_success, 0 AS turn_outside FROM truth")
CK = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM base" for c in ALL_COLS)
register("d7_column_check", "feature:s n,bad:l lo,hi:d constant:b", lambda tr: Q.column_check(run_block(tr).select("run_id", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ALL_COLS]), ALL_COLS),
         f"WITH {BASE_SQL}, lg AS ({CK}), answer AS (SELECT feature, count(*) AS n, {cnt('v IS NULL OR isnan(v) OR isinf(v)')} AS bad, min(v) AS lo, max(v) AS hi, min(round(v, 9)) = max(round(v, 9)) AS constant FROM lg GROUP BY 1)")


def _gate(tr):
    m = E.model_labels(tr).withColumn("all", F.lit(0))
    d = E.by_group_delta(m, "all").select(F.lit("macro_f1").alias("metric"), "delta")
    a = E.class_scores(m, yp="a").select("label", F.col("f1").alias("fa"))
    c = E.class_scores(m, yp="b").select("label", F.col("f1").alias("fb"))
    per = a.join(c, "label").select(F.concat(F.lit("f1_"), F.col("label")).alias("metric"), (F.col("fb") - F.col("fa")).alias("delta"))
    limits = [("macro_f1", 0.0)] + [(f"f1_{x}", -0.02) for x in LABELS] + [("absent_metric", 0.0)]
    return E.gate(d.unionByName(per), tr.spark.createDataFrame(limits, "metric string, least double"))


from tracewright.catalog.evaluate import scores  # noqa: E402

register("d8_gate", "metric:s least,delta:d passed:b", _gate, f"""WITH {AB_SQL}, {scores('ga', 'ab', yp='a')}, {scores('gb', 'ab', yp='b')},
  dl AS (SELECT 'f1_' || label AS metric, gb.f1 - ga.f1 AS delta FROM ga JOIN gb USING (label) UNION ALL SELECT 'macro_f1', avg(gb.f1) FILTER (WHERE gb.support > 0) - avg(ga.f1) FILTER (WHERE ga.support > 0) FROM ga JOIN gb USING (label)),
  lm AS (SELECT 'macro_f1' AS metric, 0.0 AS least UNION ALL SELECT 'f1_' || unnest({sql_list(LABELS)}), -0.02 UNION ALL SELECT 'absent_metric', 0.0),
  answer AS (SELECT lm.metric, least, delta, coalesce(round(delta, 9) >= least, false) AS passed FROM lm LEFT JOIN dl USING (metric))""")
