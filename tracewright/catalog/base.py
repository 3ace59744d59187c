"""Registry of queries: a Spark function, output columns with types, and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.fixed import KEYWORDS, LABELS, STOP_WORDS, TOPOLOGY_TYPES
from tracewright.sources.traces import Traces

_SPARK = {"l": "bigint", "d": "double", "s": "string", "b": "boolean", "as": "array<string>", "ad": "array<double>"}
_DUCK = {"l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "as": "VARCHAR[]"}


@dataclass
class Query:
    cols: list[tuple[str, str]]
    fn: Callable[[Traces], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def parse_cols(cols: str) -> list[tuple[str, str]]:
    """``"a,b:l x:d"`` -> [(a, l), (b, l), (x, d)]."""
    out = []
    for part in cols.split():
        names, kind = part.rsplit(":", 1)
        out += [(n, kind) for n in names.split(",")]
    return out


def register(name: str, cols: str, fn: Callable[[Traces], DataFrame], sql: str | None = None) -> None:
    assert name not in REGISTRY, name
    REGISTRY[name] = Query(parse_cols(cols), fn, sql)


def typed(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    """Fixed output types; doubles are rounded to 6 digits, as engines differ in the last bit."""
    out = []
    for name, kind in cols:
        c = F.col(f"`{name}`")
        if kind == "d":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "ad":
            c = F.transform(c, lambda x: F.round(x.cast("double"), 6) + F.lit(0.0))
        else:
            c = c.cast(_SPARK[kind])
        out.append(c.alias(name))
    return df.select(*out)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    return typed(q.fn(Traces.load(spark, sf_dir)), q.cols)


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql is None:
        return None
    outs = []
    for c, kind in q.cols:
        if kind == "d":
            outs.append(f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"')
        elif kind == "ad":
            outs.append(f'[round(CAST(x AS DOUBLE), 6) + 0.0 FOR x IN "{c}"] AS "{c}"')
        else:
            outs.append(f'CAST("{c}" AS {_DUCK[kind]}) AS "{c}"')
    body = q.sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body = body[len("WITH RECURSIVE"):]
        ctes = body
    elif body.upper().startswith("WITH"):
        ctes = body[len("WITH"):]
    else:
        ctes = f"answer AS ({body})"
    return f"WITH RECURSIVE {TRACES_SQL}, {ctes} SELECT {', '.join(outs)} FROM answer"


# ---- SQL pieces ------------------------------------------------------------
def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_norm(x: str) -> str:
    return (rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\d+', '#', 'g'), "
            rf"'art_\S+|a\d+', '@', 'g'), '[^a-z@#\s]', ' ', 'g'), '^\s+|\s+$', '', 'g')")


def sql_words(x: str) -> str:
    return (f"list_distinct([w FOR w IN regexp_extract_all(lower({x}), '[a-z]+') "
            f"IF len(w) > 2 AND NOT list_contains({sql_list(STOP_WORDS)}, w)])")


def sql_keyword(low: str, group: str) -> str:
    return "(" + " + ".join(
        f"(len({low}) - len(replace({low}, '{w}', ''))) // {len(w)}" for w in KEYWORDS[group]) + ")"


def sql_ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0.0), 0.0)"


TRACES_SQL = f"""
ev AS (
  SELECT user_id AS run_id, event_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
msg0 AS (
  SELECT run_id, t, n, event_id, ts, k, value, 'a' || (1 + k % 5) AS sender, 'a' || (1 + (k // 5) % 5) AS receiver,
         CASE event_type WHEN 'signup' THEN 'handoff' WHEN 'purchase' THEN 'handoff' WHEN 'error' THEN 'status'
              WHEN 'view' THEN 'inform' ELSE 'state_update' END AS type,
         CASE WHEN run_id % 8 = 0 THEN '' ELSE 'task_' || (k % 12) END AS intent,
         CASE WHEN event_type = 'error'
              THEN 'Blocked on a' || (1 + (k // 5) % 5) || ': I need task_' || (k % 12) || ' first.'
              ELSE event_type || ' task_' || (k % 12) || ' step ' || CAST(floor(value / 50) AS INTEGER) END AS text,
         CASE WHEN event_type = 'view' THEN 'tool_' || (k % 4) ELSE '' END AS tool,
         CASE WHEN event_type = 'purchase' THEN ['art_' || event_id] ELSE CAST([] AS VARCHAR[]) END AS refs,
         'Close task_' || (run_id % 12) || ' purchase step for signup' AS goal
  FROM ev),
msg1 AS (
  SELECT *, type = 'handoff' AND len(refs) = 0 AS is_assign, type = 'handoff' AND len(refs) > 0 AS is_delivery,
         {sql_norm('text')} AS norm, {sql_words('goal')} AS goal_words, {sql_words('text')} AS words
  FROM msg0),
messages AS (
  SELECT *, CASE WHEN len(goal_words) > 0
                 THEN CAST(len(list_intersect(goal_words, words)) AS DOUBLE) / len(goal_words) ELSE 0.0 END AS goal_ov
  FROM msg1),
runs AS (SELECT run_id, any_value(goal) AS goal, count(*) AS n, any_value(goal_words) AS goal_words
         FROM messages GROUP BY run_id),
artifacts AS (
  SELECT run_id, t, 'art_' || event_id AS id, sender AS maker, 'type_' || (k % 3) AS type, intent AS subtask,
         md5(CAST(k % 20 AS VARCHAR)) AS hash,
         CASE k % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'partial' ELSE 'copy' END AS status
  FROM msg0 WHERE len(refs) > 0),
state AS (
  SELECT run_id, t, sender AS agent, 'key_' || (k % 4) AS key, CASE WHEN k % 2 = 1 THEN 'override' ELSE 'set' END AS op,
         CAST(CAST(floor(value / 100) AS INTEGER) AS VARCHAR) AS value
  FROM msg0 WHERE type = 'state_update'),
agents AS (
  SELECT run_id, agent, CASE agent WHEN 'a1' THEN 'orchestrator' WHEN 'a2' THEN 'analyst' ELSE 'worker' END AS role
  FROM (SELECT run_id, sender AS agent FROM msg0 UNION SELECT run_id, receiver FROM msg0)),
topology AS (SELECT run_id, {sql_list(TOPOLOGY_TYPES)}[1 + run_id % 5] AS topo_type FROM runs),
topology_edges AS (SELECT run_id, 'a1' AS src, agent AS dst FROM agents WHERE agent <> 'a1'),
truth AS (
  SELECT run_id, n, {sql_list(LABELS)}[1 + run_id % 7] AS label, 1 - (run_id // 7) % 2 AS success,
         CASE WHEN run_id % 7 = 0 THEN -1 ELSE run_id % n END AS fault_turn
  FROM runs),
pred AS (
  SELECT run_id, {sql_list(LABELS)}[1 + (run_id % 7 + CASE WHEN run_id % 5 = 0 THEN 1 ELSE 0 END) % 7] AS label,
         CASE WHEN run_id % 9 = 0 THEN 1 - success ELSE success END AS success,
         CASE WHEN (run_id % 7 + CASE WHEN run_id % 5 = 0 THEN 1 ELSE 0 END) % 7 = 0 THEN -1
              ELSE CASE WHEN label = 'clean' THEN 0 ELSE fault_turn END + run_id % 4 END AS fault_turn
  FROM truth),
probs AS (
  SELECT run_id, t, c, CAST(1 + (t * 7 + c * 3 + run_id) % 11 AS DOUBLE)
         / sum(1 + (t * 7 + c * 3 + run_id) % 11) OVER (PARTITION BY run_id, t) AS p
  FROM (SELECT run_id, t, unnest(range(7)) AS c FROM msg0)),
lw AS (SELECT run_id, c, 1 + (run_id * 3 + c * 5) % 13 + CASE WHEN run_id % 7 = c AND run_id % 3 <> 0 THEN 8 ELSE 0 END AS wa,
         1 + (run_id * 7 + c * 11) % 17 + CASE WHEN run_id % 7 = c AND run_id % 4 <> 1 THEN 10 ELSE 0 END AS wb
       FROM (SELECT run_id, unnest(range(7)) AS c FROM runs)),
label_probs AS (SELECT run_id, c, CAST(wa AS DOUBLE) / sum(wa) OVER (PARTITION BY run_id) AS pa,
         CAST(wb AS DOUBLE) / sum(wb) OVER (PARTITION BY run_id) AS pb FROM lw)
"""
