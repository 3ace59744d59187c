"""Run tables with nested JSON columns: reading, decoding, flattening and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import md5_int
from tracewright.plans.scan import chunk_of, ranked
from tracewright.schema import NESTED, OBSERVABLE, RUN_CSV, RUN_FIELDS
from tracewright.session import shared
from tracewright.sources.traces import Traces


def read_runs(spark: SparkSession, path: str, schema: str = RUN_CSV) -> DataFrame:
    """CSV (plain or .gz) with quoted JSON fields. A run may span several rows (parts)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def decode_runs(runs: DataFrame) -> DataFrame:
    """JSON text columns to nested columns; null or blank text decodes to empty."""
    out = runs
    for name, ddl in NESTED.items():
        if name not in runs.columns:
            continue
        value = F.from_json(F.nullif(F.trim(F.col(name)), F.lit("")), ddl)
        if ddl.startswith("array"):
            value = F.coalesce(value, F.array().cast(ddl))
        out = out.withColumn(name, value)
    return out


def flatten(decoded: DataFrame) -> dict[str, DataFrame]:
    """The event tables of decoded runs."""
    def rows(col: str) -> DataFrame:
        return decoded.select("run_id", F.posexplode(col).alias("idx", "x")).withColumn("idx", F.col("idx").cast("long"))

    # the place in the source orders several events of one turn, and those without a turn
    agents = rows("agents").select("run_id", F.col("x.id").alias("agent"), "x.role", "x.tools")
    messages = rows("messages").select(
        "run_id", "x.t", F.col("x.from").alias("sender"), F.col("x.to").alias("receiver"), "x.type",
        F.coalesce("x.intent", F.lit("")).alias("intent"), F.coalesce("x.text", F.lit("")).alias("text"),
        F.coalesce("x.tool", F.lit("")).alias("tool"),
        F.coalesce("x.refs", F.array().cast("array<string>")).alias("refs"), "idx")
    artifacts = rows("artifacts").select("run_id", "x.t", "x.id", "x.by", "x.type", F.coalesce("x.subtask", F.lit("")).alias("subtask"), "x.hash", "x.status", "idx")
    state = rows("shared_state").select("run_id", "x.t", "idx", "x.agent", "x.key", "x.op", "x.value")
    edges = decoded.select("run_id", F.explode("topology.edges").alias("e")).select(
        "run_id", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    return {"agents": agents, "messages": messages, "artifacts": artifacts, "state": state, "topology_edges": edges}


def export_runs(tr: Traces) -> DataFrame:
    """Trace tables as run rows with JSON columns.

    A run is split into parts of at most one chunk of turns, so no row and no
    task ever holds more of a run than that; ``read_runs`` plus ``flatten``
    gives the tables back.
    """
    def parts(df: DataFrame, item: Column, name: str) -> DataFrame:
        return df.groupBy("run_id", chunk_of(df, "t").alias("part")).agg(
            F.to_json(F.sort_array(F.collect_list(item))).alias(name))

    m = parts(tr.plain_messages, F.struct("t", F.col("sender").alias("from"), F.col("receiver").alias("to"), "type",
                                          "intent", "text", "tool", "refs"), "messages")
    a = parts(tr.artifacts, F.struct("t", "id", "by", "type", "subtask", "hash", "status"), "artifacts")
    s = parts(tr.state, F.struct("t", "idx", "agent", "key", "op", "value"), "shared_state")
    team = tr.agents.groupBy("run_id").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(F.col("agent").alias("id"), "role")))).alias("agents"))
    edges = tr.topology_edges.groupBy("run_id").agg(F.sort_array(F.collect_list(F.array("src", "dst"))).alias("edges"))
    topo = tr.topology.join(edges, "run_id", "left").select(
        "run_id", F.to_json(F.struct(F.col("topo_type").alias("type"), "edges")).alias("topology"))
    head = tr.goals.join(team, "run_id", "left").join(topo, "run_id", "left").withColumn("part", F.lit(0).cast("long"))
    rows = m.join(a, ["run_id", "part"], "full").join(s, ["run_id", "part"], "full").join(
        head, ["run_id", "part"], "full")
    return rows.select(F.col("run_id").cast("string").alias("run_id"), *RUN_FIELDS)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def sample_runs(runs: DataFrame, limit: int, seed: int) -> DataFrame:
    """Repeatable sample: the ``limit`` runs with the smallest md5 of seed and id."""
    return runs.orderBy(F.md5(F.concat(F.lit(f"{seed}_"), F.col("run_id").cast("string")))).limit(limit)


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in ["run_id", *RUN_FIELDS] if c not in df.columns]


def constant_answer(df: DataFrame, id_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """Constant predictions for a table that is not a run table.

    Ids are the given ``id_col`` or ``row_<i>`` in the order of ``order_col``.
    """
    if id_col:
        ids = df.select(F.col(id_col).cast("string").alias("run_id"))
    else:
        numbered = ranked(df.select(order_col), [], [order_col], "i", chunk=chunk_of(df, order_col))
        ids = numbered.select(F.concat(F.lit("row_"), F.col("i").cast("string")).alias("run_id"))
    return ids.select("run_id", F.lit("clean").alias("label"), F.lit(1).alias("success"),
                      F.lit(-1).alias("fault_turn"))


def observable(runs: DataFrame) -> DataFrame:
    """Only the columns a model may see; targets and ids are dropped in the plan."""
    return runs.select(*[c for c in OBSERVABLE if c in runs.columns])


def event_log(tr: Traces) -> DataFrame:
    """Messages, state writes and artifacts of a run in one order (seq from 0); unknown turns last.

    Inside a turn messages come before state writes and artifacts, each in the order of their source (``idx``) where the
    tables have it. Events without a turn are cut into chunks by that place.
    """
    def place(df: DataFrame) -> Column:
        return (F.col("idx") if "idx" in df.columns else F.lit(0).cast("long")).alias("idx")

    m = tr.plain_messages.select("run_id", "t", F.lit(0).alias("rank"), F.lit("message").alias("kind"), place(tr.plain_messages),
                                 F.lit("").alias("src"), F.col("sender").alias("actor"), F.col("intent").alias("task"))
    s = tr.state.select("run_id", "t", F.lit(1).alias("rank"), F.lit("state").alias("kind"), "idx",
                        F.col("key").alias("src"), F.col("agent").alias("actor"), F.lit("").alias("task"))
    a = tr.artifacts.select("run_id", "t", F.lit(2).alias("rank"), F.lit("artifact").alias("kind"), place(tr.artifacts),
                            F.col("id").alias("src"), F.col("by").alias("actor"), F.col("subtask").alias("task"))
    log = m.unionByName(s).unionByName(a).withColumn("late", F.when(F.col("t").isNull(), 1).otherwise(0))
    c = F.coalesce(chunk_of(log, "t"), F.lit(2**61) + F.col("rank") * F.lit(2**40) + chunk_of(log, "idx"))
    return ranked(log, ["run_id"], ["late", "t", "rank", "idx", "src"], "seq", chunk=c).drop("late", "idx")


def token_buckets(messages: DataFrame) -> DataFrame:
    """Hashed word of every message position."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))
    words = F.when(F.size(words) == 0, F.array(F.lit("[empty]"))).otherwise(words)
    return messages.select("run_id", "t", F.posexplode(words).alias("i", "word")).select(
        "run_id", "t", "i", (F.pmod(md5_int(F.col("word")), F.lit(32768)) + 1).alias("bucket"))


def traces_of_runs(decoded: DataFrame, pred: DataFrame | None = None, probs: DataFrame | None = None, label_probs: DataFrame | None = None) -> Traces:
    """Traces of decoded runs, with ids of any type; truth where the table has targets.

    A run may span several rows. Predictions (run_id, label, success, fault_turn)
    and probabilities (run_id, t, c, p; run_id, c, pa, pb) are tables at hand.
    The event tables are written once, as many operators read them; like those of the fixture they are merged, never broadcast.
    """
    parts = {name: shared(df, f"run_{name}") for name, df in flatten(decoded).items()}
    targets = [c for c in ("label", "success", "fault_turn") if c in decoded.columns]
    kind = F.max("topology.type") if "topology" in decoded.columns else F.lit(None).cast("string")
    heads = shared(decoded.groupBy("run_id").agg(F.coalesce(F.max("goal"), F.lit("")).alias("goal"), F.coalesce(kind, F.lit("")).alias("topo_type"),
                                                 *[F.max(c).alias(c) for c in targets]), "run_heads")
    tr = Traces.of_messages(parts["messages"], heads.select("run_id", "goal"), parts["artifacts"], parts["state"], parts["agents"])
    given = {"topology": heads.select("run_id", "topo_type"), "topology_edges": parts["topology_edges"], "pred": pred, "probs": probs, "label_probs": label_probs}
    if len(targets) == 3:
        given["truth"] = tr.run_sizes.join(heads.select("run_id", *targets), "run_id").select(
            "run_id", "n", "label", F.col("success").cast("long").alias("success"), F.col("fault_turn").cast("long").alias("fault_turn"))
    tr.__dict__.update({k: v for k, v in given.items() if v is not None})
    return tr
