"""Fixed values of the task: classes, weights, word lists and text patterns."""

# Outcome classes in their official order.
LABELS = ["clean", "dropped_handoff", "duplicated_work", "deadlock", "conflict", "goal_drift", "runaway_loop"]
FAULTS = LABELS[1:]

# Weights of the composite score.
WEIGHTS = {"macro_f1": 0.50, "robustness_f1": 0.25, "success_f1": 0.15, "fault_turn_hit2": 0.10}

# Message and topology types.
MESSAGE_TYPES = ["handoff", "inform", "status", "state_update", "final", "system"]
TOPOLOGY_TYPES = ["star", "pipeline", "mesh", "hierarchical", "blackboard"]

# Keyword groups, counted as plain substrings.
KEYWORDS = {
    "wait": ["wait", "blocked", "hold", "depend", "not arrived", "cannot proceed", "on hold"],
    "conflict": ["disagree", "contradict", "overrid", "incorrect", "reject", "conflict", "wrong"],
    "repeat": ["again", "re-check", "recheck", "iterat", "repeat", "another pass", "looping", "one more",
               "still not"],
    "drift": ["side note", "expanding scope", "pivot", "new direction", "switching focus", "deprioritis",
              "deprioritiz", "also look into", "matters more"],
    "recovery": ["recover", "re-assign", "reassign", "retry", "fallback", "escalat", "mitigat", "repairing",
                 "takes over"],
    "stop": ["terminat", "stops the run", "halting", "stopping the run", "budget of turns", "no progress",
             "turn budget"],
    "done": ["final", "complete", "deliver", "ready", "wrapping up", "consolidat", "aggregated"],
}

# Words that carry no content.
STOP_WORDS = ["the", "a", "an", "for", "and", "of", "to", "in", "on", "with", "by", "is", "be", "all", "from",
              "before", "within", "end", "into", "as", "it", "we"]

# Goal words that mark the rare domain.
COMPLIANCE = r"compliance|audit|sweep|evidence\s*pack|red\s*flag|policy\s*update|\bdpa\b|\bmsa\b"

# Wait phrases; (phrase naming the awaited agent, phrase naming the task, group of the task).
WAIT_PHRASES = [
    (r"\bblocked on (a[0-9]+)\b", r"\bblocked on (a[0-9]+):.*?\bi need ([a-z][a-z0-9_]*)\b", 2),
    (r"\bwaiting for (a[0-9]+) to deliver\b", r"\bwaiting for (a[0-9]+) to deliver ([a-z][a-z0-9_]*)\b", 2),
    (r"\bcannot proceed\b.*?\buntil (a[0-9]+) finishes\b", r"\buntil (a[0-9]+) finishes ([a-z][a-z0-9_]*)\b", 2),
    (r"\bon hold:.*?\bfrom (a[0-9]+)\b", r"\bon hold: ([a-z][a-z0-9_]*) from (a[0-9]+)\b", 1),
    (r"\bstill holding for (a[0-9]+) on\b", r"\bholding for (a[0-9]+) on ([a-z][a-z0-9_]*)\b", 2),
    (r"\bmy step depends on (a[0-9]+) closing\b", r"\bdepends on (a[0-9]+) closing ([a-z][a-z0-9_]*)\b", 2),
]
# Words that are never a task name after a wait phrase.
WAIT_NOT_A_TASK = ["a", "and", "the", "it"]

# Repeat episodes.
EPISODE_MIN_LENGTH = 3
EPISODE_MAX_GAP = 6

# Turn windows.
RADIUS = 2
CONTEXT = 5
HIGH = 0.5
