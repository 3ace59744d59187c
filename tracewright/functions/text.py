"""Text expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.fixed import COMPLIANCE, KEYWORDS, STOP_WORDS, WAIT_NOT_A_TASK, WAIT_PHRASES


def normalise(text: Column) -> Column:
    """Lower case, digits to ``#``, artifact names to ``@``, other marks to blanks.

    The digit step runs first, so ``a2`` becomes ``a#`` and only ``art_...`` becomes ``@``.
    """
    t = F.regexp_replace(F.lower(text), r"\d+", "#")
    t = F.regexp_replace(t, r"art_\S+|a\d+", "@")
    t = F.regexp_replace(t, r"[^a-z@#\s]", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def content_words(text: Column) -> Column:
    """Distinct words of at least three letters that are not stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def overlap(goal_words: Column, words: Column) -> Column:
    """Share of the goal's words found in ``words``; 0 when the goal has none."""
    return F.when(F.size(goal_words) > 0, F.size(F.array_intersect(goal_words, words)) / F.size(goal_words)).otherwise(
        F.lit(0.0))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def keyword_count(lowered: Column, group: str) -> Column:
    total = F.lit(0).cast("long")
    for w in KEYWORDS[group]:
        total = total + occurrences(lowered, w)
    return total


def goal_domain(goal: Column) -> Column:
    return F.when(F.lower(F.coalesce(goal, F.lit(""))).rlike(COMPLIANCE), "compliance_audit").otherwise("main_domain")


def wait_target(msg_type: Column, text: Column) -> Column:
    """Struct (awaited, task) of the first matching wait phrase, null when none matches."""
    low = F.lower(text)
    out = F.lit(None).cast("struct<awaited:string,task:string>")
    for agent_rx, task_rx, group in reversed(WAIT_PHRASES):
        agent = F.regexp_extract(low, agent_rx, 1)
        task = F.regexp_extract(low, task_rx, group)
        task = F.when((task != "") & ~task.isin(WAIT_NOT_A_TASK), task)
        out = F.when(agent != "", F.struct(agent.alias("awaited"), task.alias("task"))).otherwise(out)
    return F.when(msg_type == "status", out)


def key_form(value: Column) -> Column:
    """Trimmed, case-folded key; blank becomes null."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def whole_turn(value: Column) -> Column:
    """Integer turn or null when the text is not a whole number."""
    return F.expr("null").cast("long") if value is None else value.try_cast("bigint")


def mask_agents(text: Column, fallback: str = "[none]") -> Column:
    t = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(fallback)).otherwise(text)
    return F.regexp_replace(t, r"(?i)(?<!\w)a[0-9]+(?!\w)", "[agent]")


def hash_bucket(token: Column, buckets: int = 32768) -> Column:
    """1-based bucket from the first eight hex digits of md5; equal in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(buckets)) + 1


def md5_int(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
