"""Operators on run files: traces exported as CSV, read back with text ids, against the SQL of the operators themselves."""

from tracewright.catalog.base import REGISTRY, Query
from tracewright.catalog.scans import _decoded
from tracewright.operators import lifecycles as L
from tracewright.operators import runfeatures as R
from tracewright.operators import turns as T
from tracewright.operators import waits as W
from tracewright.sources.runs import traces_of_runs


def _from_runs(tr):
    """The traces of the exported files, made once."""
    if "run_files" not in tr.__dict__:
        tr.__dict__["run_files"] = traces_of_runs(_decoded(tr))
    return tr.__dict__["run_files"]


for name, like, operator in (("s11_from_runs_block", "a0_run_block", R.run_block), ("s11_from_runs_lifecycles", "m2_lifecycles", L.lifecycles),
                             ("s11_from_runs_windows", "w23_turn_windows", T.turn_windows), ("s11_from_runs_episodes", "w15_episodes", W.all_episodes)):
    REGISTRY[name] = Query(REGISTRY[like].cols, lambda tr, op=operator: op(_from_runs(tr)), REGISTRY[like].sql)
