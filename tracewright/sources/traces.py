"""Trace tables: the view over the ``events`` table and the tables derived from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.fixed import LABELS, TOPOLOGY_TYPES
from tracewright.functions.text import content_words, normalise, overlap
from tracewright.plans.scan import ranked
from tracewright.session import shared

_CACHE: dict[tuple[str, str], "Traces"] = {}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their dense 0-based turn ``t`` inside the run (= user).

    Minutes are the chunks of the ranking, so even a user who owns a third of
    all events is numbered by many tasks.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    return ranked(ev, ["run_id"], ["ts", "event_id"], "t", chunk=minute)


def as_messages(ev: DataFrame) -> DataFrame:
    """The message columns of the fixture rule; ``ev`` must carry ``t``."""
    k = F.col("k")
    sender = F.concat(F.lit("a"), (1 + k % 5).cast("string"))
    receiver = F.concat(F.lit("a"), (1 + F.floor(k / 5) % 5).cast("string"))
    et = F.col("event_type")
    task = F.concat(F.lit("task_"), (k % 12).cast("string"))
    kind = (F.when(et.isin("signup", "purchase"), "handoff").when(et == "error", "status")
            .when(et == "view", "inform").otherwise("state_update"))
    refs = F.when(et == "purchase", F.array(F.concat(F.lit("art_"), F.col("event_id").cast("string")))).otherwise(
        F.array().cast("array<string>"))
    text = F.when(et == "error", F.concat(F.lit("Blocked on "), receiver, F.lit(": I need "), task, F.lit(" first."))
                  ).otherwise(F.concat(et, F.lit(" "), task, F.lit(" step "),
                                       F.floor(F.col("value") / 50).cast("int").cast("string")))
    return ev.select(
        "run_id", "t", sender.alias("sender"), receiver.alias("receiver"), kind.alias("type"),
        F.when(F.col("run_id") % 8 == 0, "").otherwise(task).alias("intent"),
        text.alias("text"),
        F.when(et == "view", F.concat(F.lit("tool_"), (k % 4).cast("string"))).otherwise("").alias("tool"),
        refs.alias("refs"), "event_id", "ts", "k", "value")


class Traces:
    """Trace tables of one data folder. Tables that many operators read are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build) -> DataFrame:
        """A derived table that several operators read: built and written on first use."""
        if name not in self._built:
            self._built[name] = shared(build(self), name)
        return self._built[name]

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> "Traces":
        from tracewright.session import chunk_turns

        key = (spark.sparkContext.applicationId, f"{sf_dir}#{chunk_turns(spark)}")
        if key not in _CACHE:
            _CACHE[key] = cls(spark, sf_dir)
        return _CACHE[key]

    @classmethod
    def of_messages(cls, messages: DataFrame, goals: DataFrame | None = None, artifacts: DataFrame | None = None,
                    state: DataFrame | None = None, agents: DataFrame | None = None) -> "Traces":
        """Traces from tables at hand (tests and the CSV reader)."""
        self = cls(messages.sparkSession, "")
        spark = messages.sparkSession
        self.__dict__["plain_messages"] = messages
        self.__dict__["artifacts"] = artifacts if artifacts is not None else spark.createDataFrame(
            [], "run_id long, t long, id string, by string, type string, subtask string, hash string, status string")
        state = state if state is not None else spark.createDataFrame(
            [], "run_id long, t long, idx long, agent string, key string, op string, value string")
        self.__dict__["state"] = state if "idx" in state.columns else state.withColumn("idx", F.lit(0).cast("long"))
        self.__dict__["goals"] = goals if goals is not None else messages.select("run_id").distinct().withColumn(
            "goal", F.lit(""))
        if agents is not None:
            self.__dict__["agents"] = agents
        return self

    # ---- events -> messages -------------------------------------------------
    @cached_property
    def plain_messages(self) -> DataFrame:
        return shared(as_messages(numbered_events(self.spark, self.sf_dir)), "messages")

    @cached_property
    def goals(self) -> DataFrame:
        u = F.col("run_id") % 12
        return self.plain_messages.select("run_id").distinct().withColumn(
            "goal", F.concat(F.lit("Close task_"), u.cast("string"), F.lit(" purchase step for signup")))

    @cached_property
    def run_sizes(self) -> DataFrame:
        return self.plain_messages.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def runs(self) -> DataFrame:
        """One row per run: goal, n (messages), goal words."""
        runs = self.goals.join(self.run_sizes, "run_id").withColumn("goal_words", content_words(F.col("goal")))
        return shared(runs, "runs")

    @cached_property
    def messages(self) -> DataFrame:
        """Messages with run length, role flags, normalised text and goal overlap."""
        m = self.plain_messages.join(self.runs.select("run_id", "n", "goal_words"), "run_id")
        words = content_words(F.col("text"))
        m = m.select(
            *self.plain_messages.columns, "n",
            ((F.col("type") == "handoff") & (F.size("refs") == 0)).alias("is_assign"),
            ((F.col("type") == "handoff") & (F.size("refs") > 0)).alias("is_delivery"),
            normalise(F.col("text")).alias("norm"),
            overlap(F.col("goal_words"), words).alias("goal_ov"),
        )
        return shared(m, "messages_full")

    # ---- the other trace tables --------------------------------------------
    @cached_property
    def artifacts(self) -> DataFrame:
        m, k = self.plain_messages, F.col("k")
        return m.filter((F.col("type") == "handoff") & (F.size("refs") > 0)).select(
            "run_id", "t", F.concat(F.lit("art_"), F.col("event_id").cast("string")).alias("id"),
            F.col("sender").alias("by"), F.concat(F.lit("type_"), (k % 3).cast("string")).alias("type"),
            F.col("intent").alias("subtask"), F.md5((k % 20).cast("string")).alias("hash"),
            F.when(k % 3 == 0, "final").when(k % 3 == 1, "partial").otherwise("copy").alias("status"))

    @cached_property
    def state(self) -> DataFrame:
        """State writes; ``idx`` orders those of one turn (the fixture has one)."""
        m, k = self.plain_messages, F.col("k")
        return m.filter(F.col("type") == "state_update").select(
            "run_id", "t", F.lit(0).cast("long").alias("idx"), F.col("sender").alias("agent"), F.concat(F.lit("key_"), (k % 4).cast("string")).alias("key"),
            F.when(k % 2 == 1, "override").otherwise("set").alias("op"),
            F.floor(F.col("value") / 100).cast("int").cast("string").alias("value"))

    @cached_property
    def agents(self) -> DataFrame:
        m = self.plain_messages
        ids = m.select("run_id", F.explode(F.array("sender", "receiver")).alias("agent")).distinct()
        return ids.withColumn("role", F.when(F.col("agent") == "a1", "orchestrator").when(
            F.col("agent") == "a2", "analyst").otherwise("worker"))

    @cached_property
    def topology(self) -> DataFrame:
        """One row per run: permitted-graph type."""
        return self.goals.select("run_id", _pick(TOPOLOGY_TYPES, F.col("run_id") % 5).alias("topo_type"))

    @cached_property
    def topology_edges(self) -> DataFrame:
        return self.agents.filter(F.col("agent") != "a1").select("run_id", F.lit("a1").alias("src"),
                                                                 F.col("agent").alias("dst"))

    @cached_property
    def truth(self) -> DataFrame:
        r = F.col("run_id")
        label = _pick(LABELS, r % 7)
        return self.runs.select(
            "run_id", "n", label.alias("label"), (1 - F.floor(r / 7) % 2).cast("long").alias("success"),
            F.when(label == "clean", F.lit(-1)).otherwise(r % F.col("n")).cast("long").alias("fault_turn"))

    @cached_property
    def pred(self) -> DataFrame:
        r = F.col("run_id")
        shift = F.when(r % 5 == 0, 1).otherwise(0)
        label = _pick(LABELS, (r % 7 + shift) % 7)
        t = self.truth
        base = F.when(F.col("label") == "clean", 0).otherwise(F.col("fault_turn"))
        return t.select(
            "run_id", label.alias("label"), F.when(r % 9 == 0, 1 - F.col("success")).otherwise(F.col("success")).alias("success"),
            F.when(label == "clean", F.lit(-1)).otherwise(base + r % 4).cast("long").alias("fault_turn"))

    @cached_property
    def label_probs(self) -> DataFrame:
        """Class probabilities of two label models A and B: one row per (run, class)."""
        r, y = F.col("run_id"), F.array_position(F.array(*[F.lit(v) for v in LABELS]), F.col("label")) - 1

        def weights(a: int, b: int, m: int, bonus: int, hit: Column) -> Column:
            return F.array(*[1 + (r * a + c * b) % m + F.when((y == c) & hit, bonus).otherwise(0) for c in range(7)])

        w = self.truth.select("run_id", weights(3, 5, 13, 8, r % 3 != 0).alias("wa"), weights(7, 11, 17, 10, r % 4 != 1).alias("wb"))
        z = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
        w = w.select("run_id", F.posexplode(F.arrays_zip("wa", "wb")).alias("c", "x"), z("wa").alias("za"), z("wb").alias("zb"))
        return w.select("run_id", F.col("c").cast("long").alias("c"), (F.col("x.wa") / F.col("za")).alias("pa"),
                        (F.col("x.wb") / F.col("zb")).alias("pb"))

    @cached_property
    def probs(self) -> DataFrame:
        """Window-class probabilities: one row per (run, turn, class)."""
        r, t = F.col("run_id"), F.col("t")
        weights = [(1 + (t * 7 + c * 3 + r) % 11) for c in range(7)]
        m = self.plain_messages.select("run_id", "t", F.array(*weights).alias("w"))
        m = m.select("run_id", "t", "w", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("z"))
        return m.select("run_id", "t", F.posexplode("w").alias("c", "x"), "z").select(
            "run_id", "t", F.col("c").cast("long").alias("c"), (F.col("x") / F.col("z")).alias("p"))
