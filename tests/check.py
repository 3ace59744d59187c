"""Developer check: python tests/check.py [--chunk N] [--sf 0.001] pattern..."""

import fnmatch
import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
from harness import compare, connect  # noqa: E402

from tracewright import session  # noqa: E402
from tracewright.catalog import all_queries, base  # noqa: E402

args = sys.argv[1:]
sf, chunk = "0.01", None
while args and args[0].startswith("--"):
    if args[0] == "--sf":
        sf = args[1]
    if args[0] == "--chunk":
        chunk = args[1]
    args = args[2:]
all_queries()
spark = session.get_spark(8)
if chunk:
    spark.conf.set(session.CHUNK_KEY, chunk)
d = f"/root/testdata/sf{sf}"
con = connect(d)
bad = 0
for name in base.REGISTRY:
    if args and not any(fnmatch.fnmatch(name, a) for a in args):
        continue
    t0 = time.time()
    try:
        if base.oracle(name) is None:
            n = base.run(name, spark, d).count()
            res = None if n else "no rows"
        else:
            res = compare(name, spark, con, d)
    except Exception as e:  # noqa: BLE001
        res = "ERROR " + str(e)[:1500]
        if "-v" in sys.argv:
            traceback.print_exc()
    bad += res is not None
    print(f"{'ok ' if res is None else 'BAD'} {name} {time.time() - t0:.1f}s {res or ''}", flush=True)
print("bad:", bad)
